"""Line dedup: an exact set-similarity join over the lines of a corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, small, text_of

#: Rarity comes from counts in 2 ** SKETCH buckets of word hashes, a table of
#: fixed size whatever the corpus; it is summed in chunks of 2 ** CHUNK.
SKETCH, CHUNK = 22, 16
#: A word's place in the order: LEVEL bits of rarity, then its hash.
LEVEL = 7
#: Words of more sets than HOT meet by pairs of words; buckets of still more
#: are dealt to cells of two parts of about HOT sets. Neither changes results.
HOT = 4096
#: Bytes of texts cut at once; a longer text is cut alone.
SECTION = 1 << 20
#: So many candidates of a set are verified first; sets with more, none of
#: which holds, have all theirs verified in a second round.
TRIED = 4
#: Pairs looked at, and rows of buckets held, at once.
PAIRS, HELD = 1 << 18, 1 << 17
#: Packed rows are dealt to groups of about so many words of lines, or rows
#: that meet; so many rows are packed together.
WORDS, ROWS, PACKED = 1 << 19, 1 << 16, 1 << 17
#: A list of hot words, or of large buckets, has no more than this.
LISTED = 1 << 20

#: Longer words are hashed one at a time.
LONG = 256
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _mix(h: np.ndarray, odd: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(odd)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _words(raw: np.ndarray, opens: np.ndarray):
    """(starts, stops, hashes) of the words of some bytes, A-Z as a-z; no word
    reaches across the places in ``opens``."""
    inside = (raw != 32) & ((raw - np.uint8(9)) > np.uint8(4))
    at = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    cut = opens[(opens > 0) & (opens < len(raw))]
    cut = np.unique(cut[inside[cut - 1] & inside[cut]])  # where a word ends and the next begins
    at = np.insert(at, np.repeat(np.searchsorted(at, cut), 2), np.repeat(cut, 2))
    if inside[0]:
        at = np.concatenate([[0], at])
    if inside[-1]:
        at = np.append(at, len(raw))
    a, z = at[::2], at[1::2]
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[:len(raw)] = raw + ((raw - np.uint8(65)) < np.uint8(26)) * np.uint8(32)
    # eight bytes from each place on
    eight = np.ndarray(len(raw), dtype="<u8", buffer=padded, strides=(1,))
    size = z - a
    hashes = _mix((eight[a] & _KEEP[np.minimum(size, 8)]) ^ (size.astype(np.uint64) << np.uint64(56)), 0xD6E8FEB86659FD93)
    more = np.flatnonzero((size > 8) & (size <= LONG))
    at = 8
    while len(more):
        part = eight[a[more] + at] & _KEEP[np.minimum(size[more] - at, 8)]
        hashes[more] = _mix(hashes[more] * np.uint64(0x9E3779B97F4A7C15) + part, 0xD6E8FEB86659FD93)
        at += 8
        more = more[size[more] > at]
    for k in np.flatnonzero(size > LONG):
        hashes[k] = xxhash.xxh64_intdigest(padded[a[k]:z[k]].tobytes(), seed=1)
    return a, z, hashes


def _bytes(column: pa.Array):
    """(offsets, data) of texts or bytes."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if large else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of spans that begin at ``start`` and are ``n`` long."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The values up to each of ``ends`` as bytes, without a copy."""
    offsets = (np.concatenate([[0], ends]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))])


def _pack(group: np.ndarray, rows: np.ndarray, n: np.ndarray | None = None, flat: np.ndarray | None = None) -> pa.RecordBatch:
    """A row (part, data, more) for each group of some packed rows; ``more``
    has the ``n`` values of ``flat`` that belong to each."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    last = np.flatnonzero(np.append(group[1:] != group[:-1], True))
    if flat is None:
        more = pa.nulls(len(last), pa.binary())
    else:
        more = _cut(flat[_spans((np.cumsum(n) - n)[order], n[order])], np.cumsum(n[order])[last])
    return pa.RecordBatch.from_arrays([pa.array(group[last].astype(np.int32)), _cut(rows.take(order), last + 1), more], PARTS)


PARTS = ["part", "data", "more"]
DEALT = "part int, data binary, more binary"


def _group(hashes: np.ndarray, groups: int) -> np.ndarray:
    group = (_mix(hashes, 0xA0761D6478BD642F) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
    return group.astype(np.min_scalar_type(groups))  # short numbers are sorted faster


def _gathered(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part")


def _whole(batches, kind: np.dtype, most: int):
    """(rows, values) of whole groups, about so many rows at a time."""
    def taken():
        data, more = [], []
        for b in held:
            for k, parts in ((1, data), (2, more)):
                offsets, raw = _bytes(b.column(k))
                parts.append(raw[offsets[0]:offsets[-1]])
        return np.concatenate(data).view(kind), np.concatenate(more).view(np.uint32)

    held, size, last = [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        part, at = b.column(0).to_numpy(), 0
        ends = _bytes(b.column(1))[0] // kind.itemsize
        for edge in np.flatnonzero(np.diff(part, prepend=part[0] if last is None else last)):
            if size + ends[edge] - ends[at] >= most:
                held.append(b.slice(at, edge - at))
                yield taken()
                held, size, at = [], 0, edge
        held.append(b.slice(at))
        size += ends[-1] - ends[at]
        last = part[-1]
    if held:
        yield taken()


def _lines(texts: pa.Array, at_once: int = SECTION, words: bool = True):
    """Chunks (texts, numbers, starts, stops, counts, words) of a column: of
    each line its text, number, bytes and number of words; and of the words
    (starts, stops, hashes), end to end, unless they are not asked for."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    offsets, data = _bytes(texts)
    first = 0
    while first < len(texts):
        last = max(int(np.searchsorted(offsets, offsets[first] + at_once, "right")) - 1, first + 1)
        lo = offsets[first]
        raw, opens = data[lo:offsets[last]], offsets[first:last + 1] - lo
        breaks = np.flatnonzero(raw == 10)
        of = np.concatenate([np.arange(last - first), np.searchsorted(opens[1:], breaks, "right")])
        by = np.argsort(of, kind="stable")
        text, start = of[by], np.concatenate([opens[:-1], breaks + 1])[by]
        head = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        number = np.arange(len(text)) - np.repeat(head, np.diff(np.append(head, len(text))))
        stop = np.append(start[1:] - 1, len(raw))
        ends = np.append(head[1:] - 1, len(text) - 1)
        stop[ends] = opens[1:]  # a text's last line has no line end
        if words and len(raw):
            a, z, hashes = _words(raw, opens[:-1][opens[:-1] < len(raw)])
        else:
            a = z = np.zeros(0, np.int64)
            hashes = np.zeros(0, np.uint64)
        counts = np.diff(np.append(np.searchsorted(a, start), len(a)))
        yield text + first, number, raw, start, stop, counts, hashes
        first = last


def _zip(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unzip(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def _chunks(table: np.ndarray, size: int):
    """Rows (chunk, data) of the parts of a table that hold anything."""
    parts = table.reshape(-1, size)
    at = np.flatnonzero(parts.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([_zip(parts[k]) for k in at], pa.binary())], ["chunk", "data"])


def _folded(rows: DataFrame, fold, kind, out, finish=_zip) -> DataFrame:
    """The parts of each chunk, of one kind, made one of another by ``fold``, a
    chunk at a time; ``finish`` makes the bytes of it."""
    def made(chunk, held):
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([finish(held)], pa.binary())], ["chunk", "data"])

    def run(batches):
        chunk, held = None, None
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = _unzip(data, kind)
                if k != chunk:
                    if held is not None:
                        yield made(chunk, held)
                    chunk, held = k, part.astype(out)
                else:
                    fold(held, part, out=held, casting="unsafe")
        if held is not None:
            yield made(chunk, held)

    return rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk int, data binary")


def _count(batches):
    total, held = np.zeros(1 << SKETCH, dtype=np.uint32), 0
    for b in batches:
        for *_, hashes in _lines(b.column(0)):
            held += len(hashes)
            if held >= 1 << 32:  # no count can overflow
                yield _chunks(total, 1 << CHUNK)
                total[:], held = 0, len(hashes)
            at, n = np.unique((hashes >> np.uint64(64 - SKETCH)).astype(np.uint32), return_counts=True)
            total[at] += n.astype(np.uint32)
    yield _chunks(total, 1 << CHUNK)


def _levels(texts: DataFrame) -> np.ndarray:
    """A level for each bucket of the sketch: 0 for words met once at most,
    then four steps to each power of two. At most 2 ** SKETCH bytes come to
    the driver, whatever the corpus holds."""
    def level(n):
        return np.where(n > 1, np.clip(np.ceil(4 * np.log2(np.maximum(n, 1))) - 3, 1, (1 << LEVEL) - 1), 0).astype(np.uint8).tobytes()

    counts = _folded(texts.mapInArrow(lean(_count), "chunk int, data binary"), np.add, np.uint32, np.uint64, level)
    table = np.zeros(1 << SKETCH, dtype=np.uint8)
    for row in counts.collect():  # a byte for each bucket
        table[row["chunk"] << CHUNK:(row["chunk"] + 1) << CHUNK] = np.frombuffer(bytes(row["data"]), np.uint8)
    return table


def _sets(hashes: np.ndarray, counts: np.ndarray, levels: np.ndarray):
    """(words, start, size): each line's distinct words, rarest first. A word
    is its level and the bits of its hash that are left beside it."""
    key = levels[(hashes >> np.uint64(64 - SKETCH)).astype(np.int64)].astype(np.uint64) << np.uint64(64 - LEVEL)
    key |= hashes & np.uint64((1 << (64 - LEVEL)) - 1)
    start = np.cumsum(counts) - counts
    order = np.argsort(counts, kind="stable")
    sizes, at = np.unique(counts[order], return_index=True)
    for n, a, z in zip(sizes, at, np.append(at[1:], len(order)), strict=True):
        if n > 1:  # lines of so many words are sorted together
            where = start[order[a:z]][:, None] + np.arange(n)
            key[where] = np.sort(key[where], axis=1)
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    fresh[start[counts > 0]] = True
    size = np.zeros(len(counts), np.int64)
    some = counts > 0
    if some.any():
        size[some] = np.add.reduceat(fresh.astype(np.int64), start[some])
    return key[fresh], np.cumsum(size) - size, size


def _sums(words: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int):
    """Of each set two sums of mixed words, which name it, and 128 parities: a
    word turns one of them, so two sets differ in as many words as parities,
    or more."""
    out = np.zeros((4, len(size)), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        at = start[some]
        one = _mix(words ^ np.uint64(seed * 2 + 1), 0x9E3779B97F4A7C15)
        out[0, some] = np.add.reduceat(one, at)
        out[1, some] = np.add.reduceat(_mix(words + np.uint64(seed), 0xC2B2AE3D27D4EB4F), at)
        bit = np.uint64(1) << (one & np.uint64(63))
        low = (one & np.uint64(64)) == 0
        out[2, some] = np.bitwise_xor.reduceat(np.where(low, bit, np.uint64(0)), at)
        out[3, some] = np.bitwise_xor.reduceat(np.where(low, np.uint64(0), bit), at)
    return out.view(np.int64)


def _least(threshold: float, n):
    """Words that a match shares with a set of n words, at least."""
    return np.ceil(threshold * n - 1e-9).astype(np.int64)


#: A line: the name, parities, size and prefix length of its set, its place
#: (``some`` is 0 where the document id is null), and how many words of the
#: prefix are in the sketch too seldom to be hot.
LINE = np.dtype([("d1", "<i8"), ("d2", "<i8"), ("low", "<i8"), ("high", "<i8"), ("doc", "<i8"), ("key", "<i8"),
                 ("line", "<i4"), ("n", "<i4"), ("cool", "<i4"), ("words", "<i4"), ("some", "<i4")])


def _warm() -> int:
    """The least level of words that may be hot."""
    return int(max(0, np.ceil(4 * np.log2(max(HOT, 1))) - 3))


def _ids(column: pa.Array):
    """(ids, whether there is one)."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _prefixes(levels, threshold: float, least: int, seed: int, groups: int):
    """Of each line a LINE and the prefix: so many of the rarest words of its
    set that a match shares two of them, where it shares two. Words met once
    are 0. Lines of one name are in one group."""
    warm = _warm()

    def packed(held):
        rows, flat = (np.concatenate(v) for v in zip(*held, strict=True))
        return _pack(_group(rows["d1"].astype(np.uint64), groups), rows, rows["words"].astype(np.int64), flat)

    def run(batches):
        held, size = [], 0
        for b in batches:
            (ids, some), keys = _ids(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
            for docs, numbers, _, _, _, counts, hashes in _lines(b.column(2)):
                words, start, n = _sets(hashes, counts, levels.value)
                at = np.flatnonzero(n >= least)
                if not len(at):
                    continue
                rows = np.zeros(len(at), LINE)
                for c, v in zip(("d1", "d2", "low", "high"), _sums(words, start, n, seed), strict=True):
                    rows[c] = v[at]
                docs, start, n = docs[at], start[at], n[at]
                many = np.minimum(n - _least(threshold, n) + 2, n)
                ends = np.cumsum(many)
                flat = words[_spans(start, many)]
                level = (flat >> np.uint64(64 - LEVEL)).astype(np.int64)
                short = _mix(flat, 0x165667B19E3779F9).astype(np.uint32)
                cool = np.add.reduceat((level < warm).astype(np.int64), ends - many)
                for c, v in (("doc", ids[docs]), ("key", keys[docs]), ("line", numbers[at]), ("n", n), ("cool", cool), ("words", many), ("some", some[docs])):
                    rows[c] = v
                held.append((rows, np.where(level == 0, np.uint32(0), np.maximum(short, np.uint32(1)))))
                size += len(rows) + len(flat) // 16
                if size >= PACKED // 2:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return run


#: What a line is: the only one of its set; the first of several; another of
#: them, which goes. CLASH is added where another set has half of its name.
ONLY, FIRST, REPEATED, CLASH = range(4)
SETS = "sid long, doc_id long, text_key long, line int, n int, cool int, low long, high long, prefix binary, role int"


def _whole_name(d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    return _mix(d1.view(np.uint64) ^ _mix(d2.view(np.uint64), 0xE7037ED1A0B428DB), 0x8EBC6AF09C88C6E3).view(np.int64)


def _named(batches):
    """Lines by their sets. A set's id is the first half of its name, or where
    another set has that, a hash of both halves. The first line by place stands
    for the set; lines of its own place are the same line."""
    for rows, flat in _whole(batches, LINE, WORDS // 8):
        order = np.lexsort([rows[c] for c in ("key", "line", "doc", "some", "d2", "d1")])
        n = rows["words"].astype(np.int64)
        start = (np.cumsum(n) - n)[order]
        rows = rows.take(order)  # take moves packed rows many times faster than rows[order]
        new = np.ones(len(rows), bool)
        half = rows["d1"][1:] == rows["d1"][:-1]
        new[1:] = ~half | (rows["d2"][1:] != rows["d2"][:-1])
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(rows)))
        first = np.repeat(head, count)
        role = np.where(new, np.where(np.repeat(count, count) > 1, FIRST, ONLY), REPEATED)
        clash = np.zeros(len(rows), bool)
        clash[1:] = half & new[1:]
        d1, d2 = np.ascontiguousarray(rows["d1"]), np.ascontiguousarray(rows["d2"])
        sid, role = np.where(clash, _whole_name(d1, d2), d1), role + CLASH * clash
        same = np.ones(len(rows), bool)
        for c in ("some", "doc", "line", "key"):
            same &= rows[c] == rows[c][first]
        at = np.flatnonzero(new | ~same)
        rows, role, sid = rows.take(at), role[at], sid[at]
        n = np.where(role == REPEATED, 0, rows["words"]).astype(np.int64)
        col = {c: pa.array(np.ascontiguousarray(rows[c])) for c in ("key", "line", "n", "cool", "low", "high")}
        doc = pa.array(np.ascontiguousarray(rows["doc"]), mask=rows["some"] == 0)
        prefix = _cut(flat[_spans(start[at], n)], np.cumsum(n))
        yield pa.RecordBatch.from_arrays(
            [pa.array(sid), doc, col["key"], col["line"], col["n"], col["cool"], col["low"], col["high"], prefix, pa.array(role, pa.int32())],
            [c.split()[0] for c in SETS.split(", ")])


#: Rows that meet in buckets: the bucket's key, the set, its document and
#: line, its size, the word's place and parities. ``side`` is 0, or in cells of
#: two parts, whose sets meet those of the other part only, 1 or 2.
MEET = np.dtype([("key", "<i8"), ("sid", "<i8"), ("rank", "<i8"), ("low", "<i8"), ("high", "<i8"), ("line", "<i4"), ("n", "<i4"), ("pos", "<i4"), ("side", "<i4")])
TEST = ["sid", "doc_id", "line", "n", "low", "high", "prefix"]


def _tail(threshold: float, b: pa.RecordBatch):
    """(n, p, words, start, count) of sets: the size, how many words of the
    prefix lead to buckets, and the prefixes end to end."""
    n = b.column(TEST.index("n")).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets, data = _bytes(b.column(TEST.index("prefix")))
    words, start = data[offsets[0]:offsets[-1]].view(np.uint32), (offsets - offsets[0]) // 4
    return n, n - _least(threshold, n) + 1, words, start[:-1], np.diff(start)


def _often(threshold: float):
    """Words of prefixes that may be hot."""
    def run(batches):
        for b in batches:
            _, p, words, start, _ = _tail(threshold, b)
            cool = np.minimum(b.column(len(TEST)).to_numpy(zero_copy_only=False), p)
            got = words[_spans(start + cool, p - cool)]
            yield pa.RecordBatch.from_arrays([pa.array(got[got != 0].view(np.int32))], ["word"])

    return run


def _meets(threshold: float, hot: np.ndarray, b: pa.RecordBatch):
    """(set, place, key) of the rows that meet, before large buckets are dealt:
    a row for each word of a set's prefix that other sets may hold. Hot words
    give a row for each word of the prefix after them: the first two words
    that a match shares are such a pair. A set whose match may share one word
    alone keeps its single row as well."""
    n, p, words, start, count = _tail(threshold, b)
    at = _spans(start, p)
    own = np.repeat(np.arange(len(n)), p)
    some = words[at] != 0
    at, own = at[some], own[some]
    key = words[at].astype(np.uint64) << np.uint64(32)
    if not len(hot):
        return own, at - start[own], key
    often = hot[np.minimum(np.searchsorted(hot, words[at]), len(hot) - 1)] == words[at]
    single = ~often | (_least(threshold, n) < 2)[own]
    later = np.where(often, (start + count)[own] - at - 1, 0)
    second = words[_spans(at + 1, later)]
    some = second != 0
    pair = np.repeat(np.arange(len(at)), later)[some]
    by = np.concatenate([np.flatnonzero(single), pair])
    key = np.concatenate([key[single], key[pair] | second[some]])
    return own[by], (at - start[own])[by], key


def _keys(threshold: float, hot):
    """The keys of buckets of pairs."""
    def run(batches):
        for b in batches:
            key = _meets(threshold, hot.value, b)[2]
            at = np.searchsorted(hot.value, (key >> np.uint64(32)).astype(np.uint32))
            key = key[hot.value[np.minimum(at, len(hot.value) - 1)] == key >> np.uint64(32)]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

    return run


class Buckets:
    """Where the rows of sets meet. Words of more than HOT sets meet by pairs
    of words; buckets of still more rows are dealt: a row's part is by its set,
    and each two parts are a cell, as is each part alone. The lists of both
    have LISTED entries at most: with so many rows that there may be more, HOT
    grows with the rows."""

    def __init__(self, sets: DataFrame, rows: int, threshold: float, warm: bool):
        spark, self.threshold = sets.sparkSession, threshold
        p = F.expr(f"n - cast(ceil({threshold!r} * n - 1e-9) as int) + 1")
        hot, large = np.zeros(0, np.uint32), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        if warm:
            most = max(HOT, rows // LISTED)
            found = sets.where(F.col("cool") < p).select(*TEST, "cool").mapInArrow(lean(_often(threshold)), "word int").groupBy("word").count()
            hot = np.sort(found.where(F.col("count") > most).select("word").toArrow()["word"].to_numpy().astype(np.int32).view(np.uint32))
        self.hot = spark.sparkContext.broadcast(hot)
        if len(hot):
            pairs = sets.select(*TEST).mapInArrow(lean(_keys(threshold, self.hot)), "key long").groupBy("key").count()
            pairs = pairs.where(F.col("count") > HOT)
            most = max(HOT, (pairs.agg(F.sum("count")).first()[0] or 0) // LISTED)
            got = pairs.where(F.col("count") > most).toArrow()
            key = got["key"].to_numpy().astype(np.int64).view(np.uint64)
            order = np.argsort(key)
            large = key[order], -(-got["count"].to_numpy().astype(np.int64)[order] // most)
        self.large = spark.sparkContext.broadcast(large)

    def rows(self, b: pa.RecordBatch) -> np.ndarray:
        """The rows of some sets that meet, as MEET."""
        own, pos, key = _meets(self.threshold, self.hot.value, b)
        side = np.zeros(len(own), np.int32)
        keys, parts = self.large.value
        sid = b.column(0).to_numpy(zero_copy_only=False)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            n = np.where(keys[at] == key, parts[at], 1)
            part = (_mix(sid[own].view(np.uint64), 0xE7037ED1A0B428DB) % n.astype(np.uint64)).astype(np.int64)
            other = _spans(np.zeros(len(n), np.int64), n)
            own, pos, key, part, n = (np.repeat(v, n) for v in (own, pos, key, part, n))
            low, high = np.minimum(part, other), np.maximum(part, other)
            cell = _mix(key ^ _mix((low * n + high + 1).astype(np.uint64), 0x8EBC6AF09C88C6E3), 0x589965CC75374CC3)
            key = np.where(n > 1, cell, key)
            side = np.where(low == high, 0, 1 + (part == high))
        out = np.zeros(len(own), MEET)
        ids, some = _ids(b.column(1))
        rank = np.where(some, ids, np.int64(-(1 << 63)))
        for c, v in (("key", key.view(np.int64)), ("sid", sid[own]), ("rank", rank[own]), ("pos", pos), ("side", side)):
            out[c] = v
        for c in ("line", "n", "low", "high"):
            out[c] = b.column(TEST.index(c)).to_numpy(zero_copy_only=False)[own]
        return out

    def deal(self, groups: int):
        """Rows that meet, packed; those of a bucket are in one group."""
        def run(batches):
            held, size = [], 0
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    held.append(self.rows(b.slice(at, 4096)))
                    size += len(held[-1])
                    if size >= PACKED:
                        rows = np.concatenate(held)
                        yield _pack(_group(rows["key"].astype(np.uint64), groups), rows)
                        held, size = [], 0
            if size:
                rows = np.concatenate(held)
                yield _pack(_group(rows["key"].astype(np.uint64), groups), rows)

        return run

    def keys(self):
        """The keys under which some sets meet others."""
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(self.rows(b)["key"]))], ["key"])

        return run

    def among(self, keys, still):
        """The rows under some keys, and whether their sets are open."""
        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    rows = self.rows(b.slice(at, 4096))
                    rows = rows.take(np.flatnonzero(keys.value.have(np.ascontiguousarray(rows["key"]))))
                    cols = [pa.array(np.ascontiguousarray(rows[c])) for c in MEET.names]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(still.value.have(np.ascontiguousarray(rows["sid"])))], [*MEET.names, "still"])

        return run


def _meeting(threshold: float, table):
    """Runs (early, late, apart): rows of one bucket that the length,
    positional and parity filters let pass, and in how many parities they
    differ. Rows lie by length, so the length filter is a range; of the
    shorter row the word is in the prefix that suffices for it."""
    col = {c: table[c].to_numpy() if isinstance(table, pa.Table) else np.ascontiguousarray(table[c]) for c in MEET.names}
    order = np.lexsort((col["n"], col["key"]))
    key, n, pos = col["key"][order], col["n"][order].astype(np.int64), col["pos"][order].astype(np.int64)
    new = np.zeros(len(order), np.int64)
    new[1:] = key[1:] != key[:-1]
    bucket = np.cumsum(new) << 32
    from_ = np.searchsorted(bucket | n, bucket | _least(threshold, n))
    share = threshold / (1 + threshold)
    index = n - pos >= np.ceil(share * 2 * n - 1e-9)
    before = np.concatenate([[0], np.cumsum(index)])
    index = np.flatnonzero(index)
    first, count = before[from_], before[:-1] - before[from_]
    rows = np.flatnonzero(count)
    low, high, side = col["low"].view(np.uint64)[order], col["high"].view(np.uint64)[order], col["side"][order]
    for s in _runs(count[rows], PAIRS):
        y = rows[s]
        k = count[y]
        at = np.repeat(y, k)
        x = index[_spans(first[y], k)]
        need = np.ceil(share * (n[x] + n[at]) - 1e-9)
        ok = np.minimum(n[at] - pos[at], n[x] - pos[x]) >= need
        ok &= (side[at] == 0) | (side[at] != side[x])
        x, at, most = x[ok], at[ok], (n[x] + n[at] - 2 * need)[ok]
        apart = np.bitwise_count(low[x] ^ low[at]).astype(np.int64) + np.bitwise_count(high[x] ^ high[at])
        ok = apart <= most
        x, at, apart = order[x[ok]], order[at[ok]], apart[ok]
        swap = np.zeros(len(x), bool)
        same = np.ones(len(x), bool)
        for c in ("rank", "line", "sid"):
            swap |= same & (col[c][x] > col[c][at])
            same &= col[c][x] == col[c][at]
        yield np.where(swap, at, x), np.where(swap, x, at), apart


def _candidates(threshold: float, tried: int):
    """Of the sets that meet in a bucket: for each the ``tried`` most alike, by
    their parities, of the earlier ones that the filters let pass, and whether
    there are more."""
    def flush(table):
        sid = np.ascontiguousarray(table["sid"])
        found = np.zeros(len(table), np.int64)
        late, early, more = [], [], []
        for x, y, apart in _meeting(threshold, table):
            by = np.lexsort((sid[x], apart, y))
            x, y = x[by], y[by]
            start = np.concatenate([[True], y[1:] != y[:-1]])[:len(y)]
            number = np.arange(len(y)) - np.maximum.accumulate(np.where(start, np.arange(len(y)), 0))
            found += np.bincount(y, minlength=len(found))
            keep = number < tried
            late.append(sid[y[keep]])
            early.append(sid[x[keep]])
            more.append(np.zeros(keep.sum(), bool))
        rest = np.unique(sid[found > tried])
        late, early, more = [*late, rest], [*early, rest], [*more, np.ones(len(rest), bool)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (late, early, more)], ["late", "early", "more"])

    return lambda batches: (flush(rows) for rows, _ in _whole(batches, MEET, HELD))


def _buckets(batches, rows: int, flush):
    """Whole buckets of sorted rows, about so many rows at a time."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        at = np.flatnonzero(np.diff(table["key"].to_numpy()))
        cut = int(at[-1]) + 1 if len(at) else 0
        if cut:  # the last bucket may go on in the next batch
            yield from flush(table.slice(0, cut).combine_chunks())
            table = table.slice(cut)
        held, size = table.combine_chunks().to_batches(), table.num_rows
    if held:
        yield from flush(pa.Table.from_batches(held).combine_chunks())


def _needed(threshold: float):
    """The sets whose words the second round compares, each once a run."""
    def flush(table):
        sid, still, parts = table["sid"].to_numpy(), table["still"].to_numpy(), [np.zeros(0, np.int64)]
        for x, y, _ in _meeting(threshold, table):
            open_ = still[y]
            parts.append(np.unique(sid[np.concatenate([x[open_], y[open_]])]))
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(parts)))], ["sid"])

    return lambda batches: _buckets(batches, HELD, flush)


def _settle(threshold: float):
    """Of the sets marked open, those to which an earlier one of their bucket
    comes up to the threshold: of pairs that pass the filters all words are
    compared, the most alike first."""
    def flush(table):
        sid, still, words, gone = table["sid"].to_numpy(), table["still"].to_numpy(), table["words"], np.zeros(0, np.int64)
        for x, y, apart in _meeting(threshold, table):
            open_ = still[y] & ~np.isin(sid[y], gone)
            x, y, apart = x[open_], y[open_], apart[open_]
            done, sets, more = -1, {}, []
            for i in np.lexsort((apart, y)):
                if y[i] == done:
                    continue
                if y[i] not in sets:  # rows come set by set: the one before is not needed again
                    sets = {y[i]: frozenset(words[int(y[i])].as_py())}
                a, b = frozenset(words[int(x[i])].as_py()), sets[y[i]]
                if len(a & b) >= threshold * len(a | b) - 1e-9:
                    done = y[i]
                    more.append(sid[done])
            gone = np.union1d(gone, np.array(more, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(gone)], ["sid"])

    return lambda batches: _buckets(batches, HELD // 4, flush)


def _runs(sizes: np.ndarray, most: int):
    """Slices of rows whose sizes add up to about ``most``; one at least."""
    if not len(sizes):
        return
    part = np.cumsum(sizes) // most
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(sizes)]])
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        yield slice(a, z)


class Names:
    """A bit table of names: whether one may be among those put in. Two bits a
    name, in 16 bits for each name or 2 ** 28 at most, 32 MB."""

    MOST = 28

    def __init__(self, ids: DataFrame):
        rows = ids.count()
        power = int(np.clip(np.ceil(np.log2(16 * rows + 1)), 20, self.MOST))
        self.shift = np.uint64(64 - power)

        def run(batches):
            table = np.zeros(1 << (power - 3), dtype=np.uint8)
            for b in batches:
                for at in self._places(b.column(0).to_numpy(zero_copy_only=False)):
                    np.bitwise_or.at(table, at >> 3, (128 >> (at & 7)).astype(np.uint8))
            yield _chunks(table, 1 << 17)

        self.bits = np.zeros(1 << (power - 3), dtype=np.uint8)
        size = 1 << 17
        # one job, not one for each partition
        got = _folded(ids.mapInArrow(run, "chunk int, data binary"), np.bitwise_or, np.uint8, np.uint8).toArrow()
        for k, data in zip(got["chunk"].to_pylist(), got["data"], strict=True):
            self.bits[k * size:(k + 1) * size] = _unzip(data.as_py(), np.uint8)

    def _places(self, names: np.ndarray):
        names = names.astype(np.int64).view(np.uint64)
        for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            yield (_mix(names, odd) >> self.shift).astype(np.int64)

    def have(self, names: np.ndarray) -> np.ndarray:
        ok = np.ones(len(names), bool)
        for at in self._places(names):
            ok &= (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return ok


def _places(ids, keys, lines, seed: int) -> np.ndarray:
    """Hashes of places of lines; a null id is 0."""
    return _mix(_mix(ids.view(np.uint64) + np.uint64(seed), 0x9E3779B97F4A7C15) ^ (keys.view(np.uint64) + lines.astype(np.uint64)), 0xC2B2AE3D27D4EB4F).view(np.int64)


def _placed(seed: int):
    def run(batches):
        for b in batches:
            keys, lines = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(_places(_ids(b.column(0))[0], keys, lines, seed))], ["place"])

    return run


def _members(levels, wanted, clashes: np.ndarray, least: int, seed: int):
    """The sets, and the words themselves, of the lines whose places are
    wanted; only these are hashed."""
    def run(batches):
        for b in batches:
            ids, keys = _ids(b.column(0))[0], b.column(1).to_numpy(zero_copy_only=False)
            for docs, numbers, raw, opens, stops, counts, _ in _lines(b.column(2), words=False):
                at = np.flatnonzero((stops > opens) & wanted.value.have(_places(ids[docs], keys[docs], numbers, seed)))
                if not len(at):
                    continue
                edge = np.zeros(len(raw) + 1, np.int8)
                edge[opens[at]] += 1
                edge[stops[at]] -= 1
                ends = np.concatenate([[0], np.cumsum((stops - opens)[at])])
                inside = raw[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
                lines = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(inside)])
                for _, _, raw_, opens_, stops_, counts, hashes in _lines(lines):
                    words, start, size = _sets(hashes, counts, levels.value)
                    sid, d2, _, _ = _sums(words, start, size, seed)
                    if len(clashes):
                        other = _whole_name(sid, d2)
                        sid = np.where(np.isin(other, clashes), other, sid)
                    data = raw_.tobytes()
                    found = {(int(sid[k]), b" ".join(sorted(set(data[opens_[k]:stops_[k]].lower().split())))) for k in np.flatnonzero(size >= least)}
                    if found:
                        sids, said = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(said, pa.binary()).cast(pa.string())], ["sid", "words"])

    return run


def line_matches(docs: DataFrame, scratch: Scratch, threshold: float, least: int, seed: int = 1) -> DataFrame:
    """(doc_id, text_key, lines): the numbers of the lines to remove."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text_key", "text")
    send = spark.sparkContext.broadcast
    table = _levels(docs.select("text"))
    levels = send(table)
    words = float(np.exp2((table.astype(np.float64) + 3) / 4).sum())  # or less
    packed = docs.mapInArrow(lean(_prefixes(levels, threshold, least, seed, 1 + int(words / WORDS))), DEALT)
    lines = scratch.keep(_gathered(packed).mapInArrow(lean(_named), SETS))
    sets = lines.where(F.col("role") != REPEATED)
    got = sets.agg(F.max("role"), F.sum(F.col("n") - F.expr(f"cast(ceil({threshold!r} * n - 1e-9) as int)") + 1)).first()
    rows, clashes = got[1] or 0, np.zeros(0, np.int64)
    if (got[0] or 0) >= CLASH:  # of n sets, about n * n / 2 ** 65
        clashes = sets.where(F.col("role") >= CLASH).select("sid").toArrow()["sid"].to_numpy()
    buckets = Buckets(sets, rows, threshold, bool((table >= _warm()).any()))
    tests = sets.select(*TEST)
    dealt = _gathered(tests.mapInArrow(lean(buckets.deal(1 + rows // ROWS)), DEALT))
    found = scratch.keep(dealt.mapInArrow(lean(_candidates(threshold, TRIED)), "late long, early long, more boolean").distinct())

    def members(places: DataFrame) -> DataFrame:
        """(sid, words, other): the words of the sets of lines at some places,
        and those of another of the lines, if there are other ones."""
        places = scratch.keep(places.select("doc_id", "text_key", "line").mapInArrow(_placed(seed), "place long"))
        said = docs.mapInArrow(lean(_members(levels, send(Names(places)), clashes, least, seed)), "sid long, words string").distinct()
        scratch.drop(places)
        return scratch.keep(said.groupBy("sid").agg(F.min("words").alias("words"), F.max("words").alias("other")))

    pairs = found.where("not more").select("late", "early")
    # all lines of sets that have several, and of the others those compared
    compared = pairs.select(F.explode(F.array("late", "early")).alias("sid")).distinct()
    some = members(lines.where(F.col("role") != ONLY).unionByName(lines.where(F.col("role") == ONLY).join(compared, "sid", "left_semi")))
    if not some.where("words != other").isEmpty():
        # two sets of one name: other names are given
        return line_matches(docs, scratch, threshold, least, seed + 1)
    side = lambda name: some.select(F.col("sid").alias(name), F.col("words").alias(f"w_{name}"))
    late, early = F.split("w_late", " "), F.split("w_early", " ")  # texts are less to shuffle than arrays
    both = F.size(F.array_intersect(late, early))
    gone = scratch.keep(pairs.join(side("late"), "late").join(side("early"), "early")
                        .where(both >= threshold * (F.size(late) + F.size(early) - both) - 1e-9).select(F.col("late").alias("sid")).distinct())
    scratch.drop(some)
    # sets with candidates left and none that reached the threshold
    open_ = scratch.keep(found.where("more").select(F.col("late").alias("sid")).distinct().join(gone, "sid", "left_anti"))
    scratch.drop(found)
    if not open_.isEmpty():
        met = scratch.keep(tests.join(open_, "sid", "left_semi").select(*TEST).mapInArrow(lean(buckets.keys()), "key long").distinct())
        fields = ", ".join(f"{c} {'long' if MEET[c].itemsize == 8 else 'int'}" for c in MEET.names)
        again = tests.mapInArrow(lean(buckets.among(send(Names(met)), send(Names(open_)))), f"{fields}, still boolean")
        again = scratch.keep(again.join(met, "key", "left_semi").select(*MEET.names, "still"))
        near = lambda df: df.repartition("key").sortWithinPartitions("key")
        needed = scratch.keep(near(again).mapInArrow(lean(_needed(threshold)), "sid long").distinct())
        full = members(sets.join(needed, "sid", "left_semi"))
        if not full.where("words != other").isEmpty():
            return line_matches(docs, scratch, threshold, least, seed + 1)
        again = again.join(full.select("sid", F.split("words", " ").alias("words")), "sid").select(*MEET.names, "still", "words")
        gone = scratch.keep(gone.unionByName(near(again).mapInArrow(lean(_settle(threshold)), "sid long")).distinct())
        scratch.drop(full)
    # of sets that go the first line goes too
    place = ["doc_id", "text_key", "line"]
    out = lines.where(F.col("role") == REPEATED).select(*place).unionByName(sets.select("sid", *place).join(gone, "sid", "left_semi").select(*place))
    out = scratch.keep(out.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line")).alias("lines")))
    scratch.drop(lines)
    return out


def dedup_lines(docs: DataFrame, threshold: float = 0.8, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove lines that match an earlier line of the corpus.

    A line is the set of its words (A-Z lower-cased, between ASCII white
    space). Lines are in order of document id, then of their numbers; a line
    goes if any earlier one has a Jaccard similarity of ``threshold`` (over 0,
    up to 1) or more to it, whether or not that one goes too. Lines of fewer
    than ``least`` distinct words stay and match nothing; at 1 these are the
    blank lines.

    Equal sets are grouped before they are joined. Words are ordered by rarity
    and sets meet by the words of their prefixes, pass the length, positional
    and parity filters, and are verified by the words themselves; so are the
    groups of equal sets. Hashes only bring sets together.

    Returns the rows of ``docs`` with the text that is left, and n_lines and
    n_removed (columns of these names are replaced). Null text stays null,
    with zeros; the empty text has one line. Null ids come first. Rows that
    repeat id and text are one document, and stay alike; of texts that share an
    id, lines of one number go in no set order. An empty table gives
    no rows; other columns stay. The memory of a task holds a chunk of lines
    or one bucket's rows, at most two parts of about HOT.
    """
    if not 0 < threshold <= 1 or least < 1:
        raise ValueError("threshold is over 0 and up to 1, least is 1 or more")
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.drop("n_lines", "n_removed")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_key"), text_of(text_col).alias("text"))
    gone = line_matches(narrow, scratch, threshold, least).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("lines").alias("__gone"))
    rows = docs.withColumn("__at", F.xxhash64(text_of(text_col)))
    rows = rows.join(F.broadcast(gone) if small(gone) else gone.hint("shuffle_hash"), F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__at") == F.col("__key")), "left")
    # lines have a column of their own, so that a text is cut once
    rows = rows.withColumn("__lines", F.when(F.col("__gone").isNotNull(), F.split(F.col(text_col), "\n", -1)))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone")), lambda i: F.get("__lines", i))
    text = F.when(F.col("__lines").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    breaks = F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(breaks + 1).cast("long")
    n_removed = F.coalesce(F.size("__gone"), F.lit(0)).cast("long")
    return rows.withColumns({"n_lines": n_lines, "n_removed": n_removed, text_col: text}).drop("__at", "__id", "__key", "__gone", "__lines")
