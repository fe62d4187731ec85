"""Token ids in files: frequency-ranked, byte-aligned, with control bytes apart.

A file set is three tables. ``ranks`` has one row, the ids in order of falling
frequency (little-endian unsigned 32-bit). ``parts`` has a row for each block
of documents, in ascending order of their ids:

    part, number  a range of ids and a block within it, in corpus order
    count         ids in the block
    docs          the documents' ids
    lengths       ids of each document, little-endian unsigned 64-bit
    control       two bits an id, four ids a byte, the first in the low bits:
                  bytes of the coded id less one
    data          the coded ids: each id's place in ``ranks``, little-endian,
                  in as few bytes as hold it

``index`` has, for each block, its place in the corpus (``block``) and the
number of ids before it (``first``).

Parquet holds the rows, so that any store Spark can reach can hold the files
and a task that is run again leaves no half-written ones.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch
from .vocab import Known, byte_chars, tokenizer

BLOCK_IDS, ROWS = 1 << 18, 2000
#: Bytes of the four ids of each control byte, and their sum.
SIZES = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)
MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def encode_block(places: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of places (unsigned 32-bit)."""
    places = np.ascontiguousarray(places, dtype="<u4")
    size = 1 + (places > 0xFF) + (places > 0xFFFF) + (places > 0xFFFFFF)
    code = np.zeros(-(-len(places) // 4) * 4, dtype=np.uint8)
    code[: len(places)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    data = places.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def decode_block(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The places again: sizes come from a table by control byte, the values
    from four-byte reads at the running sum of the sizes."""
    size = SIZES[np.frombuffer(control, dtype=np.uint8)].ravel()[:count].astype(np.int64)
    stop = np.cumsum(size)
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    at = stop - size
    word = sum(raw[at + k].astype(np.uint32) << np.uint32(8 * k) for k in range(4)) if count else np.zeros(0, np.uint32)
    return word & MASKS[size - 1]


# The settings of a tokenizer file under which words may be
# encoded apart from each other.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
#: A Latin word and perhaps one mark: letters below U+0250, all of them
#: composed, whose case does not look around.
PLAIN = r"^[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+[,.]?$"


def by_words(path: str) -> bool:
    """Whether a tokenizer file has the settings that WordBpe knows, and added
    tokens that no plain word holds."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    added = held["added_tokens"]
    return (held["normalizer"] == NORMALIZER and held["pre_tokenizer"] == SPLITTER and held["truncation"] is None and MODEL.items() <= held["model"].items()
            and all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added))


class WordBpe:
    """Ids as the tokenizers library gives them for a whole text.

    Under the settings that ``by_words`` looks for, no pattern reaches across
    ASCII white space, so words are encoded apart and known ones looked up.
    Plain Latin words go, in lower case and without their mark, straight to the
    library's BPE model, all others through the library's whole chain. With a
    file of other settings the library encodes whole texts.
    """

    def __init__(self, path: str):
        self.whole = tokenizer(path)
        self.model = self.whole.model
        self.apart = by_words(path)
        self.shown = byte_chars()
        self.pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
        count = self.whole.get_vocab_size()
        self.known, self.stems = Known(self.word, count), Known(self.stem, count)
        self.kind = self.known.kind
        if self.apart:
            self.marks = [b"", *[self.known[m] for m in ",."]]

    def stem(self, stem: str) -> list[int]:
        """The ids of a plain word in lower case, with no mark."""
        return [t.id for t in self.model.tokenize(stem if stem.isascii() else "".join(map(self.shown.__getitem__, stem.encode())))]

    def word(self, word: str) -> list[int]:
        if word.isascii() and "<|" not in word and word.isprintable():
            return [t.id for p in self.pieces.findall(word.lower()) for t in self.model.tokenize(p)]
        return self.whole.encode(word, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all(pa.array([text], pa.string())))

    def codes(self, words: pa.Array) -> list[bytes]:
        """The ids of some different words, as bytes."""
        plain = pc.match_substring_regex(words, PLAIN)
        some = words.filter(plain)
        stems = pc.utf8_lower(pc.utf8_rtrim(some, ",.")).dictionary_encode()
        ids = list(map(self.stems.__getitem__, stems.dictionary.to_pylist()))
        mark = pc.ends_with(some, ",").cast(pa.int8()).to_numpy() + 2 * pc.ends_with(some, ".").cast(pa.int8()).to_numpy()
        out = np.empty(len(words), dtype=object)
        plain = plain.to_numpy(zero_copy_only=False)
        if len(some):
            marks = self.marks
            out[plain] = [ids[i] + marks[m] if m else ids[i] for i, m in zip(stems.indices.to_numpy().tolist(), mark.tolist(), strict=True)]
        if len(some) < len(words):
            out[~plain] = list(map(self.known.__getitem__, words.filter(pa.array(~plain)).to_pylist()))
        return out.tolist()

    def encode_all(self, texts):
        """The ids of each text. The different words of some texts at a time
        are looked up once each; the ids of a text are gathered by numpy."""
        if not self.apart:
            for text in texts.to_pylist():
                yield np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=self.kind)
            return
        for s in range(0, len(texts), ROWS):
            lists = pc.ascii_split_whitespace(texts.slice(s, ROWS))
            words = lists.flatten().dictionary_encode()
            codes = self.codes(words.dictionary)
            ids = np.frombuffer(b"".join(codes), dtype=self.kind)
            n = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes)) // self.kind.itemsize
            start = np.cumsum(n) - n
            at = words.indices.to_numpy(zero_copy_only=False)
            stop = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            for a, z in zip(np.concatenate([[0], stop[:-1]]), stop, strict=True):
                w = at[a:z]
                k = n[w]
                ends = np.cumsum(k)
                yield ids[np.repeat(start[w] - (ends - k), k) + np.arange(ends[-1])] if len(w) else ids[:0]


@functools.cache
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


def width(vocabulary: int) -> str:
    """How ids below ``vocabulary`` are held until they are written."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, path: str, end_id: int, kind: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text and the end id, as little-
    endian unsigned integers of ``kind`` in one binary value."""
    def run(batches):
        enc = encoder(path)
        for b in batches:
            for s in range(0, b.num_rows, ROWS):  # a few texts at a time
                part = b.slice(s, ROWS)
                ids = [np.append(v, end_id).astype(kind).tobytes() for v in enc.encode_all(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def _tally(kind, vocabulary):
    def run(batches):
        total = np.zeros(vocabulary, dtype=np.int64)
        for b in batches:
            parts, held = [], 0
            for v in b.column(0):
                parts.append(np.frombuffer(v.as_buffer(), dtype=kind))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    total += np.bincount(np.concatenate(parts), minlength=vocabulary)
                    parts, held = [], 0
            if parts:
                total += np.bincount(np.concatenate(parts), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    return run


def _pack(place, kind):
    """Blocks of the sorted documents of one partition."""
    def block(part, number, ids, docs):
        control, data = encode_block(place.value[np.concatenate(ids)])
        lengths = np.array([len(v) for v in ids], dtype="<u8")
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([int(lengths.sum())], pa.int64()),
             pa.array([docs], pa.list_(pa.int64())), pa.array([lengths.tobytes()], pa.binary()),
             pa.array([control], pa.binary()), pa.array([data], pa.binary())],
            ["part", "number", "count", "docs", "lengths", "control", "data"])

    def run(batches):
        ids, docs, held, number, part = [], [], 0, 0, None
        for b in batches:
            for p, d, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                part = p
                ids.append(np.frombuffer(v.as_buffer(), dtype=kind))
                docs.append(d)
                held += len(ids[-1])
                if held >= BLOCK_IDS:
                    yield block(part, number, ids, docs)
                    ids, docs, held, number = [], [], 0, number + 1
        if docs:
            yield block(part, number, ids, docs)

    return run


def write_tokens(ids: DataFrame, out: str, vocabulary: int) -> None:
    """Write (doc_id, ids) as a file set at ``out``, in ascending id order,
    null ids first, rows that repeat an id in any order.

    The tally of ids is summed on the executors first; at most ``vocabulary``
    rows of it come to the driver, and the table of places made of them is all
    that is broadcast. A document is never cut: a row holds at least one.
    """
    spark, kind = ids.sparkSession, width(vocabulary)
    tally = ids.select("ids").mapInArrow(_tally(kind, vocabulary), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    got = tally.orderBy(F.desc("n"), "id").limit(vocabulary).collect()
    ranks = np.array([r["id"] for r in got], dtype=np.int64)
    place = np.zeros(int(ranks.max()) + 1 if len(ranks) else 0, dtype=np.uint32)
    place[ranks] = np.arange(len(ranks), dtype=np.uint32)
    spark.createDataFrame([(ranks.astype("<u4").tobytes(),)], "ids binary").write.parquet(f"{out}/ranks")
    shared = spark.sparkContext.broadcast(place)
    ordered = ids.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    parts = ordered.select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "ids")
    parts.mapInArrow(_pack(shared, kind), "part long, number long, count long, docs array<bigint>, lengths binary, control binary, data binary").write.parquet(f"{out}/parts")
    # ids before each part, from a row for each part; those before a block
    # inside its part, from the rows of that part
    heads = spark.read.parquet(f"{out}/parts").select("part", "number", "count")
    own = W.partitionBy("part").orderBy("number").rowsBetween(W.unboundedPreceding, 0)
    totals = heads.groupBy("part").agg(F.sum("count").alias("all"), F.count("*").alias("blocks"))
    order = W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    totals = totals.select("part", (F.sum("all").over(order) - F.col("all")).alias("ids"), (F.sum("blocks").over(order) - F.col("blocks")).alias("before"))
    starts = heads.select("part", "number", (F.sum("count").over(own) - F.col("count")).alias("in")).join(totals, "part")
    starts.select("part", "number", (F.col("before") + F.col("number") + 1).alias("block"), (F.col("ids") + F.col("in")).alias("first")).write.parquet(f"{out}/index")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) from a file set: the ids of each document, and how
    many ids stand before it."""
    row = spark.read.parquet(f"{path}/ranks").first()
    shared = spark.sparkContext.broadcast(np.frombuffer(bytes(row["ids"]), dtype="<u4"))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                lengths = np.frombuffer(r["lengths"], dtype="<u8").astype(np.int64)
                stop = np.cumsum(lengths)
                ids = shared.value[decode_block(r["control"], r["data"], int(stop[-1]))]
                cut = [ids[a:z].tobytes() for a, z in zip(stop - lengths, stop, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["docs"], pa.int64()), pa.array(r["first"] + stop - lengths, pa.int64()), pa.array(cut, pa.binary())], ["doc_id", "start", "ids"])

    blocks = spark.read.parquet(f"{path}/parts").join(spark.read.parquet(f"{path}/index"), ["part", "number"])
    return blocks.select("first", "docs", "lengths", "control", "data").mapInArrow(run, "doc_id long, start long, ids binary")


def token_files(docs: DataFrame, path: str, end_id: int = 2, out: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, write the file set, read it back: (doc_id, start, ids).

    Null text counts as empty: the end id alone. Null ids come first; repeated
    ids are each written; an empty table gives an empty file set and no rows;
    other columns are ignored. Without ``out`` the files go to the shared
    folder.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    vocabulary = max(tokenizer(path).get_vocab_size(), end_id + 1)
    ids = scratch.keep(tokenize(docs, path, end_id, width(vocabulary), id_col, text_col))
    out = out or f"{scratch.root}/files"
    write_tokens(ids, out, vocabulary)
    scratch.drop(ids)
    return read_tokens(docs.sparkSession, out)


def token_checks(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read_tokens gives."""
    def run(batches):
        for b in batches:
            raw = [v.as_buffer() for v in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(v) // 4 for v in raw], pa.int64()), pa.array([zlib.crc32(v) for v in raw], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
