"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import functools
import re

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean

#: The bounded sample: documents of each language, characters of each document
#: at most, bytes of a dictionary and of all dictionaries together.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY, DICTIONARIES = 96, 16_384, 131_072, 1 << 25
#: More languages than this are an error, not a cap.
LANGUAGES = 4096
WINDOW = 4096
#: Labelled texts that choose a margin, the margins to choose from, and how
#: many of the texts must lie under one to speak for it.
JUDGED, MARGINS, EVIDENCE = 2048, (0.001, 0.002, 0.005, 0.01, 0.02), 30
#: Letters alone make a text one of a language; marks belong to their words.
LETTER = regex.compile(r"\p{L}")
LETTERS = regex.compile(r"[\p{L}\p{M}]+")
PLAIN = re.compile(r"[a-z]+")
UNKNOWN = "und"


def spelled(text: str) -> bytes:
    """The words of a whole text in lower case, without signs and digits, so
    that case and layout say nothing about the language."""
    text = text.lower()
    return " ".join((PLAIN if text.isascii() else LETTERS).findall(text)).encode("utf-8", "surrogatepass")


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", seed: int = 42, languages: int = LANGUAGES,
          sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, dictionary: int = DICTIONARY, dictionaries: int = DICTIONARIES) -> list[tuple[str, bytes]]:
    """(language, dictionary) pairs, the language with most documents first;
    of as many, by name.

    Learns every language there is from rows with text and a language; texts
    without letters teach nothing. The sample is bounded in documents,
    characters and bytes (the parameters): of each language the texts whose
    seeded hashes are lowest, and of a longer text a part that begins at a
    seeded place. A share of the hashes that holds about four times as many
    texts as needed is cut off first, so no task meets all of a language; the
    sample alone comes to the driver. Dictionaries share ``dictionaries``
    bytes, 128 kB each at most. Copies of a text count once. More than
    ``languages`` different languages raise a ValueError.
    """
    known, got = _sample(docs, text_col, lang_col, seed, languages, sample_docs, sample_chars)
    if not known:
        return []
    size = min(dictionary, dictionaries // len(known))
    out = []
    for r in sorted(known, key=lambda r: (-r["n"], r["lang"])):
        texts = [spelled(g["text"]) for g in got if g["lang"] == r["lang"]]
        if any(texts):
            out.append((r["lang"], b" ".join(t for t in texts if t)[-size:]))
    return out


def _sample(docs: DataFrame, text_col: str, lang_col: str, seed: int, languages: int, sample_docs: int, sample_chars: int, skip: int = 0):
    """The languages with their rows, and of each so many texts by the order of
    their hashes, after the first ``skip``."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    rows = rows.withColumn("place", F.xxhash64("text", F.lit(seed)))
    # one row for each language; over the bound it is not read further
    known = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("place").alias("texts")).limit(languages + 1).collect()
    if len(known) > languages:
        raise ValueError(f"more than {languages} languages")
    if not known:
        return [], []
    # hashes run from -2**63 to 2**63 - 1
    need = 4 * (skip + sample_docs)
    cuts = [(r["lang"], float(-2**63 + 2**64 * min(1.0, need / max(1, r["texts"])))) for r in known]
    few = rows.join(F.broadcast(docs.sparkSession.createDataFrame(cuts, "lang string, cut double")), "lang").where(F.col("place").cast("double") <= F.col("cut"))
    start = F.pmod(F.xxhash64("place", F.lit(seed)), F.greatest(F.char_length("text") - sample_chars, F.lit(0)) + 1).cast("int") + 1
    few = few.groupBy("lang", "place").agg(F.first(F.substring("text", start, F.lit(sample_chars))).alias("text"))
    few = few.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("place"))).where(F.col("n").between(skip + 1, skip + sample_docs))
    return known, sorted(few.collect(), key=lambda g: (g["lang"], g["place"]))


def choose_margin(docs: DataFrame, learned: list[tuple[str, bytes]], text_col: str = "text", lang_col: str = "lang", seed: int = 42, languages: int = LANGUAGES,
                  sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, judged: int = JUDGED) -> float:
    """The margin under which a prediction is no better than a guess: of the
    labelled texts that the dictionaries were not made of, the widest of
    MARGINS such that of those under it, EVIDENCE or more, half or fewer are
    right; 0, which rejects none, if there is no such margin. At most
    ``judged`` texts come to the driver."""
    if len(learned) < 2:
        return 0.0
    _, got = _sample(docs, text_col, lang_col, seed, languages, max(1, judged // len(learned)), sample_chars, sample_docs)
    model = tuple(learned)
    found = [(g["lang"], *classify(g["text"], model)) for g in got]
    found = [(margin, lang == said) for lang, said, margin in found if said != UNKNOWN]
    best = 0.0
    for m in MARGINS:
        under = [right for margin, right in found if margin < m]
        if len(under) >= EVIDENCE and sum(under) * 2 <= len(under):
            best = m
    return best


@functools.lru_cache(4)
def _compressors(learned: tuple, level: int):
    import zstandard as zstd

    out = []
    for _, raw in learned:
        d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append(zstd.ZstdCompressor(dict_data=d, level=level, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
    return out


def classify(text: str | None, learned: tuple, level: int = 6) -> tuple[str, float]:
    """(language, margin): the margin is the share of bytes by which the best
    dictionary beats the next, 0 to 1. The whole text counts, window by
    window, so that the dictionary stays in reach of all of it. Equal sizes go
    to the language with more training documents, with a margin of 0; where
    one language alone was learned, the margin is 1."""
    if not text or not learned or not LETTER.search(text):
        return UNKNOWN, 0.0
    raw = spelled(text)
    parts = [raw[i:i + WINDOW] for i in range(0, len(raw), WINDOW)]
    size = [sum(map(len, map(c, parts))) for c in _compressors(learned, level)]
    best = min(range(len(size)), key=size.__getitem__)
    rest = min((s for i, s in enumerate(size) if i != best), default=None)
    return learned[best][0], 1.0 if rest is None else 1 - size[best] / rest


def identify(docs: DataFrame, learned: list[tuple[str, bytes]], text_col: str = "text", min_margin: float = 0.0, level: int = 6) -> DataFrame:
    """The rows with lang_pred, lang_score and lang_accepted.

    lang_pred is a learned language, or ``und`` for null, empty and letterless
    texts or where nothing was learned; lang_accepted is false for ``und`` and
    for margins under ``min_margin``. Whole texts count, however long. Columns
    of these names are replaced; all others, nulls and repeated rows stay, and
    repeated rows get the same; an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_accepted")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score"), F.lit(True).alias("lang_accepted")).schema
    names = docs.columns
    # the dictionaries are as large as the sample's bound allows, no larger
    shared = docs.sparkSession.sparkContext.broadcast(tuple((a, bytes(b)) for a, b in learned))

    def run(batches):
        model = shared.value
        for b in batches:
            got = [classify(t, model, level) for t in b.column(names.index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[0] != UNKNOWN and g[1] >= min_margin for g in got], pa.bool_())],
                [*names, "lang_pred", "lang_score", "lang_accepted"])
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(lean(run), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the crc32 of the id as text leaves 0 when divided by 5; a null
    id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0
