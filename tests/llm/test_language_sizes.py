"""Language ID against zstandard called window by window, and its odd cases."""

import random

import regex
import zstandard

from treeloom.llm import language_id
from treeloom.llm.language_id import classify, identify, learn, spelled

SAID = {"en": "the of and to in that was for with this river stone", "fr": "le la les et des une que pour dans avec rivière été", "hi": "हिन्दी भाषा में लिखा गया पाठ और नदी", "el": "και το της που για με από είναι ποτάμι"}


def made(n=200, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(SAID))
        rows.append((i, " ".join(r.choice(SAID[lang].split()) + r.choice(["", "", "!", " 42"]) for _ in range(r.randint(3, 200))), lang))
    rows += [(1000 + i, None, "en") for i in range(3)] + [(1010, "", "fr"), (1011, "½ ² 42 ①", "en"), (1012, "z", None), (None, rows[0][1], "en"), (1013, rows[1][1], "en"), (1013, rows[1][1], "en")]
    return rows


def slow(text, learned, level=6):
    """The language whose dictionary makes the windows smallest, and its lead."""
    if not text or not regex.search(r"\p{L}", text):
        return "und", 0.0
    raw = " ".join(regex.findall(r"[\p{L}\p{M}]+", text.lower())).encode()
    sizes = []
    for k, (lang, data) in enumerate(learned):
        total = 0
        for a in range(0, len(raw), 4096):
            known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            total += len(zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_dict_id=False).compress(raw[a:a + 4096]))
        sizes.append((total, k, lang))
    sizes.sort()
    return sizes[0][2], 1 - sizes[0][0] / sizes[1][0]


def test_against_separate_calls(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = learn(docs)
    assert {n for n, _ in learned} == set(SAID)
    got = identify(docs, learned, min_margin=0.01).collect()
    assert len(got) == len(rows)
    right = 0
    for x in got:
        lang, margin = slow(x.text, learned)
        assert (x.lang_pred, x.lang_accepted) == (lang, lang != "und" and margin >= 0.01)
        assert abs(x.lang_score - margin) < 1e-12
        right += x.lang_pred == x.lang
    assert right > 190
    assert len({(x.lang_pred, x.lang_score) for x in got if x.doc_id == 1013}) == 1


def test_letters_and_marks():
    learned = (("en", spelled(SAID["en"])), ("hi", spelled(SAID["hi"])))
    assert classify("½ ² 42 ①", learned) == ("und", 0.0)
    assert spelled("हिन्दी, हिन्दी!").decode() == "हिन्दी हिन्दी"
    assert spelled("É_a1b DON'T").decode() == "é a b don t"
    assert classify("हिन्दी भाषा", learned)[0] == "hi"


def test_ties_go_to_the_first_and_are_rejected(spark):
    same = spelled("one two three")
    assert classify("some words", (("b", same), ("a", same))) == ("b", 0.0)
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    row = identify(docs, [("b", same), ("a", same)], min_margin=0.01).first()
    assert (row.lang_pred, row.lang_score, row.lang_accepted) == ("b", 0.0, False)


def test_every_language_is_learned_whatever_its_number_or_length(spark):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"l{i:03d}") for i in range(100)]
    rows += [(200 + i, ("lang tekst " * 3000) + str(i), "long") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = learn(docs)
    assert len(learned) == 101
    assert learned[0][0] == "long"
    assert 0 < len(learned[0][1]) <= language_id.DICTIONARY
    assert sum(len(d) for _, d in learn(docs, dictionaries=101 * 20)) <= 101 * 20
    try:
        learn(docs, languages=100)
    except ValueError as e:
        assert "100 languages" in str(e)
    else:
        raise AssertionError


def test_a_sample_keeps_its_bound_and_copies_count_once(spark):
    rows = [(i, "copied text here", "en") for i in range(500)] + [(600 + i, f"{'abcdefghij'[i % 10]} own {'klmnop'[i % 6]}{'qrstuv'[i // 60 % 6]}", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    (_, words), = learn(docs, sample_docs=20)
    assert words.split().count(b"copied") <= 1
    assert len(words) < 20 * 20
    assert learn(docs, sample_docs=20) == learn(docs.repartition(2), sample_docs=20)


def test_the_margin_comes_from_texts_outside_the_dictionaries(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(SAID["en" if i % 2 else "fr"].split()) for _ in range(60)), "en" if i % 2 else "fr") for i in range(400)]
    # one word that no dictionary holds is a tie, labelled as the other language
    rows += [(1000 + i, "q" * (i % 7 + 3) + "zw"[i % 2], "fr") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = learn(docs.where("doc_id < 1000"), sample_docs=40)
    tied = [t for _, t, _ in rows[400:] if classify(t, tuple(learned))[1] < 0.001]
    monkeypatch.setattr(language_id, "EVIDENCE", 5)
    margin = language_id.choose_margin(docs, learned, sample_docs=40)
    wrong = [t for t in tied if classify(t, tuple(learned))[0] != "fr"]
    assert (margin > 0) == (2 * len(wrong) >= len(tied) > 0)
    monkeypatch.setattr(language_id, "EVIDENCE", 1000)
    assert language_id.choose_margin(docs, learned, sample_docs=40) == 0
    assert language_id.choose_margin(docs.where("doc_id < 1000"), learned, sample_docs=40) == 0
    assert language_id.choose_margin(docs.limit(0), learned) == 0
    assert language_id.choose_margin(docs, learned[:1]) == 0
