"""Tokenizer files of other settings, letters at the edge of the plain ones,
offsets and the reversed byte table."""

import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from test_llm import SCHEMA, made, odd_texts

from treeloom.llm import byte_bpe, token_files
from treeloom.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


def test_every_letter_below_the_edge():
    own = token_files.encoder(PATH)
    assert own.apart
    texts = [f"{chr(c)} a{chr(c)}b {chr(c)}, x{chr(c)}. {chr(c)}{chr(c)}!" for c in range(0x20, 0x300) if not 0x7F <= c < 0xA0]
    got = own.encode_all(pa.array(texts))
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == own.whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("change", [
    lambda j: j.update(normalizer=None), lambda j: j["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"\S+"),
    lambda j: j["added_tokens"][0].update(content="stone"), lambda j: j["model"].update(byte_fallback=True)])
def test_other_settings_go_to_the_library(tmp_path, change):
    with open(PATH, encoding="utf-8") as f:
        held = json.load(f)
    change(held)
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(held, f)
    assert not token_files.by_words(path)
    own = token_files.WordBpe(path)
    texts = ["", "The Stone, a stone.", "don't É 12", *odd_texts(200)]
    for t, ids in zip(texts, own.encode_all(pa.array(texts)), strict=True):
        assert ids.tolist() == own.whole.encode(t, add_special_tokens=False).ids


def test_blocks_have_their_places(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 50)
    docs = spark.createDataFrame([r for r in made() if r[0] is not None], SCHEMA)
    got = {(r.doc_id, r.start): r.n_tokens for r in token_files.token_checks(token_files.token_files(docs.dropDuplicates(["doc_id"]), PATH)).collect()}
    at = 0
    for i, start in sorted(got):
        assert start == at
        at += got[i, start]


def test_splitter_comes_from_the_pattern():
    from public_tokenizers import PATTERN
    cut = byte_bpe.splitter(PATTERN)
    assert cut.findall("a\x1cb\x85 c") == ["a", "\x1c", "b", "\x85", " c"]
    assert byte_bpe.splitter(r"\S+|\s+").findall("a\x1cb 　c") == ["a\x1cb", " 　", "c"]
    assert regex.sub(r"\s", "", byte_bpe.SPACE) == byte_bpe.SPACE.replace(" ", "")
    other = byte_bpe.codec(vocabulary("byte_bpe_50k.tiktoken"), r"\p{L}+|\P{L}+")
    ids = other.encode("abc123 def")
    assert other.decode(ids) == b"abc123 def"


def test_offsets_and_the_reversed_table(spark):
    path = vocabulary("byte_bpe_50k.tiktoken")
    bpe = byte_bpe.codec(path)
    assert bpe.decode(range(256)) == b"".join(bpe.table[:256])
    assert bpe.decode([]) == b""
    text = "naïve 😀 test"
    ids = bpe.encode(text)
    start, stop = bpe.spans(text, ids)
    whole = text.encode()
    places = [len(whole[:k].decode(errors="ignore")) for k in range(len(whole) + 1)]
    at = 0
    for i, a, z in zip(ids, start, stop, strict=True):  # a part of a character spans it all
        size = len(bpe.table[i])
        assert text[a:z].encode().find(bpe.table[i]) >= 0
        assert a == places[at]
        at += size
    rows = byte_bpe.round_trip(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), path, spans=True).collect()
    assert {r.doc_id: r.spans_crc32 for r in rows} == {1: zlib.crc32(np.concatenate([start, stop]).astype("<u4").tobytes()), 2: 0, 3: 0}
