"""Each operator against a brute-force version, on small tables with the odd
cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import base64
import hashlib
import html
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from treeloom.llm import byte_bpe, embeddings, exact_dedup, html_text, language_id, line_dedup, mixing, simhash, token_counts, token_files
from treeloom.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, fp string"
WORDS = "the of and to in river stone cloud lantern meadow copper winter violin harbor orchard signal velvet thunder maple anchor".split()


def made(seed=3, n=60):
    r = random.Random(seed)
    say = lambda k: " ".join(r.choice(WORDS) + str(r.randint(0, 9)) for _ in range(k))
    shared = [say(12) for _ in range(4)]
    rows = []
    for i in range(n):
        lines = [r.choice([say(r.randint(1, 30)), r.choice(shared), r.choice(shared) + " extra", ""]) for _ in range(r.randint(0, 5))]
        rows.append((i * 3, "\n".join(lines), r.choice(["en", "fr", None]), r.choice(["a", "b", "é", None]), 1, 2, "x"))
    rows += [(500 + i, rows[5][1], "en", "a", 1, 2, "x") for i in range(6)]
    rows += [(600, None, "en", "a", None, 2, "x"), (601, "", None, None, 0, 2, "x"), (602, "  \n\t", "fr", "z", 1, None, None), (602, "  \n\t", "fr", "z", 1, None, None),
             (603, "42 !!", "fr", "b", 1, 2, "x"), (None, rows[7][1], "fr", "b", 1, 2, "x"), (604, say(9000), "en", "b", 1, 2, "x"), (605, "É" * 70 + " ß ½ \u0000 \x1c x", "en", "b", 1, 2, "x"),
             (606, rows[8][1][:-1] + "q", "en", "b", 1, 2, "x"), (607, rows[5][1].upper(), "en", "b", 1, 2, "x")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def closed(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_dedup(docs).collect()
    rows = made()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_exact_dedup_long_shared_beginnings(spark):
    base = "ab" * 40_000
    texts = [base, base, base[:-1] + "c", base[:-1] + "c", base[:100] + "x" + base[101:], base[:64], base[:64], "ab" * 31 + "zz"]
    got = exact_dedup.exact_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {0: (1, 2), 1: (1, 2), 2: (3, 2), 3: (3, 2), 4: (4, 1), 5: (6, 2), 6: (6, 2), 7: (7, 1)}


def test_sainte_lague_is_highest_quotients():
    r = random.Random(1)
    for _ in range(200):
        votes = [r.choice([0, 1, 2, 3, 5, 8, 100, 1000, r.random() * 50]) for _ in range(r.randint(1, 8))]
        most = [r.choice([0, 1, 5, 1000]) for _ in votes]
        seats = r.randint(0, 60)
        want = [0] * len(votes)
        for _ in range(seats):
            open_ = [i for i in range(len(votes)) if want[i] < most[i] and votes[i] > 0]
            if not open_:
                break
            want[max(open_, key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert mixing.sainte_lague(np.array(votes, float), seats, np.array(most)).tolist() == want


def test_mix(docs, empty):
    got = mixing.mix(docs, shard_docs=8, block_tokens=4).collect()
    rows = made()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    total = Counter()
    for r in rows:
        total[r[3]] += size(r[1])
    names = sorted(n for n in total if n is not None) + [None]
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(names)
    while open_:
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if share[n] >= 2 * total[n]}
        if not over:
            target |= share
            break
        for n in over:
            target[n] = 2 * total[n]
            left -= target[n]
        open_ -= over
    taken = Counter()
    for r in got:
        assert r.source_size == total[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken == r.rounds * r.size + r.a1 - r.a0 + r.b1 - r.b0
        assert 0 <= r.a0 <= r.a1 <= r.size
        assert 0 <= r.b0 <= r.b1 <= r.size
        taken[r.source] += r.taken
    for n in names:
        assert abs(taken[n] - target[n]) <= 8, n
    again = mixing.mix(docs.repartition(5), shard_docs=8, block_tokens=4).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mix(empty).collect() == []


def simple_fingerprint(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] * bool(words)
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g, seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


@pytest.mark.parametrize("budget", [0, 2, 3])
def test_simhash(docs, empty, budget):
    got = simhash.simhash_groups(docs, 3, budget).collect()
    rows = made()
    fp = Counter((r[0], f"{simple_fingerprint(r[1], 3):016x}") for r in rows)
    assert Counter((r.doc_id, r.fingerprint) for r in got) == fp
    prints = sorted({int(f, 16) for _, f in fp})
    label = closed(prints, [(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= budget])
    low = {}
    for i, f in fp:
        if i is not None:
            low[label[int(f, 16)]] = min(i, low.get(label[int(f, 16)], i))
    assert all(r.component_id == low.get(label[int(r.fingerprint, 16)]) for r in got)
    assert simhash.simhash_groups(empty, 3, budget).collect() == []


@pytest.mark.parametrize("budget", [0, 1, 2, 3, 5])
def test_trie_links_join_what_all_pairs_join(spark, budget):
    r = random.Random(budget)
    vals = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(150):
        v = r.getrandbits(64)
        vals.add(v)
        for _ in range(r.choice([0, 1, 3])):
            for _ in range(r.randint(0, budget + 1)):
                v ^= 1 << r.randrange(64)
            vals.add(v)
    vals = sorted(vals)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    got = simhash.near_links(spark.createDataFrame([(signed(v),) for v in vals], "fp long"), budget, 7).collect()
    got = [(x.a % (1 << 64), x.b % (1 << 64)) for x in got]
    assert closed(vals, got) == closed(vals, [(a, b) for a, b in itertools.combinations(vals, 2) if (a ^ b).bit_count() <= budget])


def test_trie_pairs_are_all_pairs():
    r = np.random.default_rng(1)
    vals = np.unique(np.concatenate([r.integers(0, 1 << 63, 40, dtype=np.uint64), np.uint64(1 << 62) ^ (np.uint64(1) << r.integers(0, 64, 60, dtype=np.uint64))]))
    got = {(int(a), int(b)) for x, y in simhash.trie_pairs(vals, 1, 2) for a, b in zip(np.minimum(x, y), np.maximum(x, y), strict=True)}
    want = {(i, j) for i, j in itertools.combinations(range(len(vals)), 2) if vals[i] >> np.uint64(63) == vals[j] >> np.uint64(63) and int(vals[i] ^ vals[j]).bit_count() <= 2}
    assert got == want


def test_components(spark):
    from treeloom.llm.common import Scratch
    from treeloom.llm.components import connected_components
    r = random.Random(5)
    links = [(i, i + 1) for i in range(200, 260)] + [(r.randrange(100), r.randrange(100)) for _ in range(60)] + [(300, 300 + i) for i in range(50)] + [(7, 7), (-5, 3)]
    got = connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert {x.node: x.component for x in got} == closed(nodes, [x for x in links if x[0] != x[1]])
    assert len(got) == len(nodes)


def test_embeddings(spark):
    r = np.random.default_rng(2)
    rows, centers = [], r.standard_normal((4, 16))
    for i in range(120):
        v = centers[i % 4] + 0.14 * r.standard_normal(16) if i < 80 else r.standard_normal(16)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3) if i % 11 else None, "x"))
    rows += [(200 + i, rows[3][1], rows[3][2], "x") for i in range(5)] + [(210, [x * 2 for x in rows[3][1]], rows[3][2], "x")]
    rows += [(300, None, 1, "x"), (301, [], 1, "x"), (302, [0.0] * 16, 1, "x"), (303, [float("nan")] + [1.0] * 15, 1, "x"), (304, [None] + [1.0] * 15, 1, "x"),
             (305, [float("inf")] * 16, 1, "x"), (306, [1.0] * 8, 1, "x"), (307, [1.0] * 16, 1, "x"), (307, [1.0] * 16, 1, "x"), (None, rows[4][1], rows[4][2], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")
    got = embeddings.embedding_groups(df).collect()
    good = [i for i, x in enumerate(rows) if x[1] and x[2] is not None and all(v is not None and math.isfinite(v) for v in x[1]) and any(x[1])]
    links, n = [], Counter()
    for a, b in itertools.combinations(good, 2):
        u, v = np.array(rows[a][1]), np.array(rows[b][1])
        if rows[a][2] == rows[b][2] and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
            links.append((a, b))
            n[a] += 1
            n[b] += 1
    assert len(links) > 100
    label, low = closed(range(len(rows)), links), {}
    for i, x in enumerate(rows):
        if x[0] is not None:
            low[label[i]] = min(x[0], low.get(label[i], x[0]))
    want = Counter((x[0], n[i], low.get(label[i]), x[0] == low.get(label[i])) for i, x in enumerate(rows))
    assert Counter(tuple(x) for x in got) == want
    assert embeddings.embedding_groups(df.limit(0)).collect() == []


def test_embedding_cells_of_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 16)
    r = np.random.default_rng(4)
    c = r.standard_normal(8)
    rows = [(i, [float(x) for x in c + 0.05 * r.standard_normal(8)], 1) for i in range(150)]
    got = embeddings.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    m = np.array([x[1] for x in rows])
    m /= np.linalg.norm(m, axis=1)[:, None]
    assert {x.vec_id: x.n_links for x in got} == dict(enumerate(((m @ m.T >= 0.98).sum(axis=1) - 1).tolist()))


def greedy(word, first, rest):
    n, at = 0, 0
    while at < len(word):
        pieces = rest if at else first
        for z in range(len(word), at, -1):
            if word[at:z] in pieces:
                n, at = n + 1, z
                break
        else:
            return -1
    return n


def test_longest_match_counts_as_greedy_does():
    r = random.Random(1)
    for _ in range(300):
        piece = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 5)))
        first, rest = {piece() for _ in range(r.randint(0, 9))}, {piece() for _ in range(r.randint(0, 9))}
        a = token_counts.LongestMatch(first, rest)
        for _ in range(60):
            w = "".join(r.choice("abcd" if r.random() < 0.05 else "abc") for _ in range(r.randint(1, 12)))
            assert a.word(w) == greedy(w, first, rest), (w, first, rest)


def test_count_tokens(docs, empty):
    import sentencepiece
    path = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    first, rest = {p[1:] for p in pieces if p[0] == "▁"}, {p for p in pieces if p[0] != "▁"}
    want = Counter()
    for r in made():
        n = [greedy(w.decode(), first, rest) for w in (r[1] or "").encode().split()]
        want[r[0], len(n), sum(max(x, 1) for x in n), sum(x < 0 for x in n)] += 1
    assert Counter(tuple(r) for r in token_counts.count_tokens(docs, path).collect()) == want
    assert token_counts.count_tokens(empty, path).collect() == []


def plain_bpe():
    import public_tokenizers as P
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [*"ab'sdlvertm 0 1\n\n \t.,!Iİɐ", *map(chr, (0x85, 0xA0, 0x1C, 0x1F, 0xB, 0xC, 0, 0x2028, 0x180E, 0x3000, 0x1680, 0xE9, 0x301, 0x4E2D, 0x1F600, 0x200B, 0xFEFF, 0x1E9E, 0x3A3)),
       "  ", "'ll", " 's", "\r\n", "the ", "<|endoftext|>", "<|startoftext|>", " É", "ß"]


def odd_texts(n=3000):
    r = random.Random(9)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_byte_bpe_is_tiktoken_on_odd_texts():
    own, known = byte_bpe.codec(vocabulary("byte_bpe_50k.tiktoken")), plain_bpe()
    for t in odd_texts():
        ids = own.encode(t).tolist()
        assert ids == known.encode_ordinary(t), t
        assert own.decode(ids).decode() == t
        start, stop = own.spans(t, ids)
        assert all(t[a:z].encode().find(own.table[i]) >= 0 for a, z, i in zip(start, stop, ids, strict=True))


def test_byte_bpe_round_trip(docs, empty):
    path, known = vocabulary("byte_bpe_50k.tiktoken"), plain_bpe()
    want = Counter()
    for r in made():
        ids = known.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in byte_bpe.round_trip(docs, path).collect()) == want
    assert byte_bpe.round_trip(empty, path).collect() == []
    back = byte_bpe.decode_ids(byte_bpe.encode_documents(docs, path), path).select("doc_id", "decoded").collect()
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in back) == Counter((r[0], r[1] or "") for r in made())


def test_word_bpe_is_the_library_on_odd_texts():
    own = token_files.encoder(vocabulary("word_bpe_49k.json"))
    for t in odd_texts():
        assert own.encode(t).tolist() == own.whole.encode(t, add_special_tokens=False).ids, t


def test_variable_length_blocks():
    for k in (0, 1, 3, 4, 5, 999):
        v = np.random.default_rng(k).choice([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], k).astype(np.uint32)
        control, data = token_files.encode_block(v)
        assert len(control) == -(-k // 4)
        assert token_files.decode_block(control, data, k).tolist() == v.tolist()


def test_token_files(docs, empty, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    path = vocabulary("word_bpe_49k.json")
    whole = token_files.encoder(path).whole
    got = token_files.token_checks(token_files.token_files(docs, path)).collect()
    rows = {(r[0], r[1] or "") for r in made() if r[0] not in (None, 602)}
    at, by = 3 * 0, {r.doc_id: r for r in got}
    nulls = [r for r in got if r.doc_id is None]
    assert nulls[0].start == 0
    at = nulls[0].n_tokens
    for i, t in sorted(rows):
        ids = [*whole.encode(t, add_special_tokens=False).ids, 2]
        if i == 603:
            at += 2  # the repeated row: an end id each
        assert (by[i].start, by[i].n_tokens, by[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        at += len(ids)
    assert len(got) == len(made())
    assert token_files.token_checks(token_files.token_files(empty, path)).collect() == []


def removed_lines(rows, threshold=0.8, least=5):
    seen, out = [], defaultdict(set)
    for i, text in sorted({(-1 if r[0] is None else r[0], r[1]) for r in rows if r[1] is not None}):
        for k, line in enumerate(text.split("\n")):
            words = frozenset(line.encode().lower().split())
            if len(words) < least:
                continue
            if any(len(words & w) / len(words | w) >= threshold for w in seen):
                out[i].add(k)
            seen.append(words)
    return out


def test_line_dedup(docs, empty, monkeypatch):
    rows = made()
    gone = removed_lines(rows)
    assert sum(map(len, gone.values())) > 20
    want = Counter()
    for r in rows:
        lines = [] if r[1] is None else r[1].split("\n")
        out = gone[-1 if r[0] is None else r[0]]
        want[r[0], None if r[1] is None else "\n".join(x for k, x in enumerate(lines) if k not in out), len(lines), len(out), r[4]] += 1
    for hot, tried in ((2048, 4), (1, 0)):  # all words meet in pairs; all sets are settled in the second round
        monkeypatch.setattr(line_dedup, "HOT", hot)
        monkeypatch.setattr(line_dedup, "TRIED", tried)
        got = line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed", "n_chars").collect()
        assert Counter(tuple(r) for r in got) == want
    assert line_dedup.dedup_lines(empty).collect() == []


def test_line_dedup_when_the_first_candidates_fail(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "TRIED", 1)
    r = random.Random(2)
    rows = []
    for i in range(150):
        words = r.sample([f"w{k}" for k in range(14)], r.randint(5, 10))
        rows.append((i, " ".join(words), None, None, 0, 0, ""))
    gone = removed_lines(rows)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {x.doc_id for x in got if x.n_removed} == {i for i in gone if gone[i]}


def test_language_id(spark, empty):
    r = random.Random(1)
    syllables = {"en": "the ing tion and er on".split(), "fr": "é que les ou eau ment".split(), "de": "sch ung der ein ich keit".split()}
    rows = []
    for i in range(300):
        lang = r.choice(list(syllables))
        rows.append((i, " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(8, 200))), lang, "s", 1, 1, "x"))
    docs = spark.createDataFrame(rows, SCHEMA)
    learned = language_id.learn(docs.where(~language_id.held_out()))
    assert sorted(a for a, _ in learned) == ["de", "en", "fr"]
    got = language_id.identify(docs.withColumnRenamed("source", "lang_pred"), learned, min_margin=0.01).where(language_id.held_out()).collect()
    assert {x.doc_id for x in got} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(x.lang_pred == rows[x.doc_id][2] for x in got) >= 0.98 * len(got)
    assert all(0 <= x.lang_score <= 1 for x in got)
    odd = language_id.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 .,!"), (4, "x" * 3_000_000)], "doc_id long, text string"), learned).collect()
    assert [x.lang_pred == "und" for x in odd] == [True, True, True, False]
    assert [x.lang_accepted for x in odd][:3] == [False] * 3
    assert language_id.learn(empty) == []
    assert {x.lang_pred for x in language_id.identify(docs, []).collect()} == {"und"}


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site, name, and, such, things, here</h1></header>
<nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, many of them, for you, always, everywhere.</p></div>
<div id="page"><div class="sidebar"><p>Buy this, now, it is great, really great thing to buy now, yes.</p></div>
%s<div class="comments"><p>Nice article, thanks a lot for this, wow, so nice, really.</p></div></div>
<form><p>Enter, your, name, please, we would like to know it all.</p></form><footer>&copy; 2020, all rights, reserved, by, us, and others.</footer><script>if(a<b){"</p>"}</script></body>"""
BODY = "<p>First   paragraph &amp; more, with some text,\n long enough.<p>Second, unclosed &eacute;, <a href=q>link</a> and <i>mo</i>re<br>text <b>here</b>, long.</p>"


@pytest.mark.parametrize("body", [f"<article>{BODY}</article>", f'<div class="content">{BODY}</div>', f"<main><section>{BODY}</section></main>"])
def test_html_keeps_the_article(body):
    assert html_text.main_text(PAGE % body) == "First paragraph & more, with some text, long enough. Second, unclosed é, link and more text here, long."


def test_html_odd_pages(spark):
    texts = ["", "no tags, &lt;just&gt; text", "<div" * 50_000, "<div>" * 50_000 + "deep, but long enough to be a paragraph" + "</div>" * 9, "<p>unended <b", "<!-- <p>hidden</p>", "</p></div>x", "<p hidden>a</p>b", "<a href='>' title=it's>q</a>"]
    got = [html_text.main_text(t) for t in texts]
    assert got == ["", "no tags, <just> text", "", "deep, but long enough to be a paragraph", "unended", "", "x", "b", got[8]]
    pages = spark.createDataFrame([(1, "u", t, "clash") for t in texts] + [(2, None, None, None)], "page_id long, url string, html string, n_chars string")
    rows = html_text.extract(pages).collect()
    assert [r.text for r in rows] == [*got, ""]
    assert all(r.n_chars == len(r.text) for r in rows)
    assert html_text.extract(pages.limit(0)).collect() == []
    assert html.unescape("&eacute;") == "é"
