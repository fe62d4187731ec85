"""Byte-level BPE encoding and decoding with the tokenizers library."""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .vocab import Known, byte_chars, rank_file

# The Unicode property of white space, which patterns of public
# tokenizers mean by \s; Python's own notion differs.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def splitter(pattern: str):
    """A tokenizer's pattern for how text is cut before the merges."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))


LATIN, LEADS, MARKS = "\u0250", frozenset(" abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), frozenset(",.")


class ByteBpe:
    """Encoder and decoder for a rank file; one for each Python worker.

    The library's BPE model is built from the ranks: bytes become characters
    by the byte table, the merges are the pairs of known parts, in the order
    of their ranks; decoding turns the table round. Chunks of text between safe places are looked up first;
    the table of them is emptied when it is full, so its size is bounded.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import models

        ranks = rank_file(path)
        self.table = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.table[i] = piece
        self.shown = byte_chars()
        name = lambda piece: "".join(map(self.shown.__getitem__, piece))
        merges = []
        for piece in self.table:
            if len(piece) > 1:
                cut = _last_merge(piece, ranks)
                merges.append((name(piece[:cut]), name(piece[cut:])))
        self.model = models.BPE(vocab={name(p): i for p, i in ranks.items()}, merges=merges, cache_capacity=0)
        self.ranks = ranks
        self.pieces = splitter(pattern)
        self.names = list(map(name, self.table))
        # every stand-in is below U+0200
        self.back = np.zeros(512, dtype=np.uint8)
        self.back[[ord(c) for c in self.shown]] = np.arange(256)
        self.size = np.array([len(p) for p in self.table], dtype=np.int64)
        self.decimal = [str(i) for i in range(len(self.table))]
        self.known = Known(self.chunk, len(self.table), 75_000)

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        return [t.id for t in self.model.tokenize("".join(map(self.shown.__getitem__, raw)))]

    def chunk(self, text: str) -> list[int]:
        if not text:
            return []
        # a Latin word, and perhaps one mark after it, needs no pattern
        if text[1:].isalpha() and text[0] in LEADS and max(text) < LATIN:
            return self.piece(text)
        if text[-1:] in MARKS and text[1:-1].isalpha() and text[0] in LEADS and max(text) < LATIN:
            return self.piece(text[:-1]) + self.piece(text[-1])
        out = []
        for piece in self.pieces.findall(text):
            out += self.piece(piece)
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text. It is cut where no piece can reach across:
        before a space and round a line end, if neither stands at the end or
        next to other white space."""
        if "\0" in text or self._odd(text):
            return np.array(self.chunk(text), dtype=self.known.kind)
        return self.known.join(text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0"))

    _odd = staticmethod(regex.compile(rf"[{SPACE}](?:[{SPACE}]|\Z)|[{SPACE}--[ \n]]", regex.V1).search)

    def decode(self, ids) -> bytes:
        """The bytes that the characters of the tokens stand for. A character
        that tokens split is whole again, as its bytes are joined."""
        said = "".join(map(self.names.__getitem__, np.asarray(ids).tolist()))
        return self.back[np.frombuffer(said.encode("utf-16-le"), dtype="<u2")].tobytes()

    def spans(self, text: str, ids) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last character of each token. A token that holds
        part of a character spans that whole character, as its neighbour does."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        stop = np.cumsum(self.size[np.asarray(ids, dtype=np.int64)])
        start = stop - self.size[np.asarray(ids, dtype=np.int64)]
        return (char[start], char[stop - 1] + 1) if len(stop) else (stop, stop)


def _last_merge(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Where the two parts meet that the merges of lower rank leave of a piece."""
    own, parts = ranks[piece], [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 2:
        best = min((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best[0] >= own:
            raise ValueError(f"no merges make the piece of rank {own}")
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return len(parts[0])


def codec(path: str, pattern: str | None = None) -> ByteBpe:
    """The codec of a rank file and its pattern, the public one by default."""
    if pattern is None:
        from public_tokenizers import PATTERN as pattern  # noqa: N811
    return _codec(path, pattern)


@functools.cache
def _codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, stops): token ids of every whole text, and the
    character span of each token. Null text counts as empty and has no ids;
    null and repeated ids are kept as they are; an empty table gives no rows;
    other columns are ignored. A row holds one document's ids, no more."""
    def run(batches):
        bpe = codec(path)
        for b in batches:
            for i, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                ids = bpe.encode(text)
                start, stop = bpe.spans(text, ids)
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], pa.int64())] + [pa.array([np.asarray(v, dtype=np.int32)], pa.list_(pa.int32())) for v in (ids, start, stop)], ["doc_id", "ids", "starts", "stops"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, stops array<int>")


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with a column ``decoded`` (binary); null ids decode to nothing.
    Ids that are out of range fail the query."""
    schema = rows.select("*", F.lit(b"").alias("decoded")).schema

    def run(batches):
        bpe = codec(path)
        for b in batches:
            at = b.schema.get_field_index(ids_col)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bpe.decode(v or []) for v in b.column(at).to_pylist()], pa.binary())], [*b.schema.names, "decoded"])

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text is encoded,
    the ids are decoded again, and both are digested. Cases as in
    encode_documents; of the empty text the digests are those of nothing.
    ``spans`` adds spans_crc32, of the first and past-the-last characters of
    the tokens (little-endian unsigned 32-bit, all firsts, then all ends)."""
    def run(batches):
        bpe = codec(path)
        for b in batches:
            n, a, d, c = [], [], [], []
            for text in b.column(1).to_pylist():
                ids = bpe.encode(text)
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                d.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if spans:
                    start, stop = bpe.spans(text, ids)
                    c.append(zlib.crc32(stop.astype("<u4").tobytes(), zlib.crc32(start.astype("<u4").tobytes())))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), *([pa.array(c, pa.int64())] if spans else [])]
            yield pa.RecordBatch.from_arrays(cols, names)
        codec(path).known.forget()
        pa.default_memory_pool().release_unused()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", spans_crc32 long" * spans
    names = [f.split()[0] for f in schema.split(", ")]
    return _texts(docs, id_col, text_col).mapInArrow(lean(run), schema)
