"""Token counts by greedy matching over the whole vocabulary."""

import random

from treeloom.llm import token_counts
from treeloom.llm.queries import vocabulary


def greedy_over(word, pieces, longest):
    """Longest match of mark + word; a character without a piece is its bytes."""
    n, at, text = 0, 0, "▁" + word
    while at < len(text):
        z = next((z for z in range(min(len(text), at + longest), at, -1) if text[at:z] in pieces), None)
        n, at = (n + len(text[at].encode()), at + 1) if z is None else (n + 1, z)
    return n


def test_tokens_of_mark_and_word(spark):
    import sentencepiece
    path = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    longest, r = max(map(len, pieces)), random.Random(4)
    words = ["2024-01-31", "7" * 1000, "élan", "日本語テキスト", "😀", "a😀b", "word", "▁▁x", "\U00012000\U00012001", "<0x41>"]
    words += ["".join(r.choice("abthein19é日😀-ßж▁") for _ in range(r.randint(1, 12))) for _ in range(500)]
    want = [greedy_over(w, pieces, longest) for w in words]
    got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), path).orderBy("doc_id").collect()
    assert [(x.n_words, x.n_tokens, x.n_unknown) for x in got] == [(1, n, 0) for n in want]


def test_spelling_and_lone_mark_in_small_vocabularies():
    r = random.Random(1)
    for _ in range(300):
        piece = lambda: "".join(r.choice("abc▁") for _ in range(r.randint(1, 5)))
        pieces = {"▁", *(piece() for _ in range(r.randint(0, 12)))}
        a = token_counts.LongestMatch({p[1:] for p in pieces if p[0] == "▁"}, pieces, True)
        for _ in range(60):
            w = "".join(r.choice("abcd▁é") for _ in range(r.randint(1, 12)))
            assert a.word(w) == greedy_over(w, pieces, 5), (w, pieces)
