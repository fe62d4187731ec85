"""SimHash near-dedup by a binary trie self-join over fingerprints."""

from __future__ import annotations

from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, small, text_of
from .components import connected_components, forest

BITS = 64
CHUNK, HELD = 1 << 14, 1 << 18
SLICE = 1 << 16
#: Wide fingerprints of sets: a word of BITS bits is led by each of its LEADS
#: blocks of LEAD bits in turn. LEAF values of a trie node are compared at once.
LEAD, LEADS, LEAF = 14, 4, 16
#: Hashes turned at once; 255 at most, as they are counted in bytes.
TURNED = 248
#: A pair of sets this small may differ in more bits than the angle says.
FEW = 5
_BYTES = np.uint64(0x0101010101010101)


def _shingles(text: str | None, shingle: int):
    """Hashes of a text's shingles in order, in runs of at most SLICE."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    digest = xxhash.xxh64_intdigest
    while True:
        part = [digest(g, 42) for g, _ in zip(grams, range(SLICE), strict=False)]
        if part:
            yield np.array(part, dtype=np.uint64)
        if len(part) < SLICE:
            break


def _majority(parts) -> int:
    """The bits that are set in over half of some hashes."""
    total, ones = 0, np.zeros(BITS, dtype=np.int64)
    for h in parts:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash: a bit is set if set in over half the shingle hashes."""
    return _majority(_shingles(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a bigint."""
    def run(batches):
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def trie_pairs(vals: np.ndarray, depth: int, budget: int, more: np.ndarray | None = None, size: int = 1):
    """Pairs of positions in ``vals`` (sorted, no repeats) that share their
    first ``depth`` bits and differ in at most ``budget`` others; those of
    ``more``, a second word of each, count too.

    A trie node is a range of the sorted values. Node pairs are walked down
    together a bit at a time; a pair's differing bits add up and it is dropped
    beyond the budget. Two leaves, nodes of at most ``size`` values, are
    compared at once. Pairs wait on a stack in chunks, so memory does not
    follow the size of a bucket.
    """
    def near(x, y):
        far = np.bitwise_count(vals[x] ^ vals[y])
        ok = (far if more is None else far + np.bitwise_count(more[x] ^ more[y])) <= budget
        return x[ok], y[ok]

    top = vals >> np.uint64(BITS - depth)
    edge = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1], [True]]))
    lo, hi = edge[:-1], edge[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(lo[i:i + CHUNK], hi[i:i + CHUNK], lo[i:i + CHUNK], hi[i:i + CHUNK], np.zeros(len(lo[i:i + CHUNK]), np.int8), depth) for i in range(0, len(lo), CHUNK)]
    while stack:
        al, ah, bl, bh, far, d = stack.pop()
        if not len(al):
            continue
        own = al == bl
        leaf = (ah - al <= size) & (bh - bl <= size) & ~(own & (ah - al == 1))
        if leaf.any():
            x, span, k = al[leaf], (ah - al)[leaf], (bh - bl)[leaf]
            first, k = np.repeat(bl[leaf], span), np.repeat(k, span)
            x = np.repeat(x - (np.cumsum(span) - span), span) + np.arange(span.sum())
            y = np.repeat(first - (np.cumsum(k) - k), k) + np.arange(k.sum())
            x = np.repeat(x, k)
            x, y = near(x[x < y], y[x < y])
            if len(x):
                yield x, y
            al, ah, bl, bh, far, own = (v[~leaf] for v in (al, ah, bl, bh, far, own))
        if not len(al) or d == BITS:
            continue
        keep, bit = np.uint64(BITS - d), np.uint64(BITS - d - 1)
        cut = lambda l, h: np.clip(np.searchsorted(vals, (((vals[l] >> keep) << keep) if d else np.zeros(len(l), np.uint64)) | (np.uint64(1) << bit)), l, h)  # noqa: E731, E741
        am, bm = cut(al, ah), cut(bl, bh)
        kids = [(al, am, bl, bm, far, np.ones(len(al), bool)), (am, ah, bm, bh, far, np.ones(len(al), bool)),
                (al, am, bm, bh, far + 1, np.ones(len(al), bool)), (am, ah, bl, bm, far + 1, ~own)]
        out = []
        for p, q, r, s, f, ok in kids:
            ok = ok & (q > p) & (s > r) & (f <= budget) & ~((p == r) & (q - p == 1))
            out.append((p[ok], q[ok], r[ok], s[ok], f[ok]))
        al, ah, bl, bh, far = (np.concatenate(v) for v in zip(*out, strict=True))
        stack += [(al[i:i + CHUNK], ah[i:i + CHUNK], bl[i:i + CHUNK], bh[i:i + CHUNK], far[i:i + CHUNK], d + 1) for i in range(0, len(al), CHUNK)]


def _join_tries(width: int, budget: int):
    def links(block: int, vals: np.ndarray):
        shift = np.uint64(block * width)
        back = lambda v: (v >> shift) | (v << (np.uint64(BITS) - shift)) if shift else v
        a, b, held = [], [], 0
        depth = min(width, BITS - block * width)
        for x, y in trie_pairs(vals, depth, budget):
            a.append(x)
            b.append(y)
            held += len(x)
            if held > HELD:
                p, q = forest(np.concatenate(a), np.concatenate(b))
                a, b, held = [p], [q], len(p)
        if held:
            p, q = forest(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(back(vals[p]).view(np.int64)), pa.array(back(vals[q]).view(np.int64))], ["a", "b"])

    def run(batches):
        block, parts = None, []
        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            vals = (batch.column(1).to_numpy(zero_copy_only=False) ^ np.int64(-(1 << 63))).view(np.uint64)
            for at in np.split(np.arange(len(blocks)), np.flatnonzero(np.diff(blocks)) + 1):
                if not len(at):
                    continue
                if blocks[at[0]] != block:
                    if parts:
                        yield from links(block, np.concatenate(parts))
                    block, parts = int(blocks[at[0]]), []
                parts.append(vals[at])
            if not parts:
                continue
            depth = min(width, BITS - block * width)
            held = np.concatenate(parts)
            # whole buckets go as soon as there are enough of them
            if len(held) > HELD:
                top = held >> np.uint64(BITS - depth)
                end = int(np.searchsorted(top, top[-1]))
                if end:
                    yield from links(block, held[:end])
                    held = held[end:]
            parts = [held]
        if parts and block is not None:
            yield from links(block, np.concatenate(parts))

    return run


def near_links(fps: DataFrame, budget: int, partitions: int | None = None) -> DataFrame:
    """(a, b): links that join the same fingerprints as all pairs within
    ``budget`` differing bits. ``fps`` has one bigint column fp, distinct.

    budget + 1 tries, each led by another block of bits: of any linked pair at
    least one block is equal, so in that trie its first levels have no budget
    to spend, and subtrees below such a block can be joined apart.
    """
    blocks = budget + 1
    width = -(-BITS // blocks)
    turned = lambda i: (F.col("fp") if i == 0 else F.shiftleft("fp", i * width).bitwiseOR(F.shiftrightunsigned("fp", BITS - i * width)))
    rows = fps.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"), turned(i).alias("v"), F.shiftrightunsigned(turned(i), BITS - min(width, BITS - i * width)).alias("key"))
        for i in range(blocks)])).alias("r")).select("r.*")
    # the sign bit is turned over so that bigint order is the order of the bits
    rows = rows.select("block", F.col("v").bitwiseXOR(F.lit(-(1 << 63))).alias("v"), "key")
    rows = (rows.repartition(partitions, "block", "key") if partitions else rows.repartition("block", "key")).sortWithinPartitions("block", "v")
    return rows.select("block", "v").mapInArrow(_join_tries(width, budget), "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 5, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups of whole texts.

    Returns one row per input row: doc_id, fingerprint (16 hex digits),
    component_id (smallest doc_id reachable through links of at most
    ``budget`` differing bits, its own included). Copies share a fingerprint
    and are joined before any comparison.

    Null and empty texts and texts without words have fingerprint zero and
    link like any other; a text of fewer words than ``shingle`` is one
    shingle; rows with a null id take part and are never the smallest; rows
    that repeat an id are each returned; an empty table gives no rows; other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, shingle, id_col, text_col))
    reps = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = near_links(reps.select("fp"), budget)
    comp = connected_components(links, scratch)
    label = scratch.keep(reps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("component")))
    low = label.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = label.join(low, "component").select("fp", "component_id")
    return fps.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _chance(n: int, p: float, most: int) -> float:
    return sum(comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(most + 1))


def width_for(similarity: float, missed: float) -> tuple[int, int]:
    """(words, budget) of wide fingerprints: of two sets with this Jaccard
    similarity no try finds both in its budget with a chance of ``missed``.

    Sets of similarity s have a cosine of 2s / (1 + s) or more, and a bit
    differs with the chance of their angle. A try sees its lead block equal
    and the rest of its word and a second word within the budget.
    """
    p = acos(min(2 * similarity / (1 + similarity), 1)) / pi
    rest = 2 * BITS - LEAD
    budget = ceil(rest * p + 3 * sqrt(rest * p * (1 - p)))
    found = (1 - p) ** LEAD * _chance(rest, p, budget)
    return (ceil(log(missed) / log(1 - found) / LEADS) if found < 1 else 1), budget


def wide(h: np.ndarray, words: int) -> np.ndarray:
    """SimHash of a set of hashes in so many words of 64 bits."""
    salt = np.random.default_rng(64).integers(0, 1 << 63, words, dtype=np.uint64)
    ones = np.zeros((8, words, 8), np.int64)
    for i in range(0, len(h), TURNED):
        x = (h[i:i + TURNED, None] ^ salt) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        for k in range(8):  # the k-th bits of all bytes are counted together
            ones[k] += ((x >> np.uint64(k)) & _BYTES).sum(axis=0).view(np.uint8).reshape(words, 8)
    bits = (2 * ones > len(h)).transpose(1, 2, 0)
    return np.packbits(bits.reshape(words, -1), axis=1, bitorder="little").view(np.int64)[:, 0]


def _digest(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63)


def _set(text: str | None, shingle: int) -> np.ndarray:
    parts = list(_shingles(text, shingle))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _sketches(shingle: int, similarity: float, words: int):
    def run(batches):
        for b in batches:
            digests, fps = [], []
            for t in b.column(2).to_pylist():
                h = _set(t, shingle)
                digests.append(_digest(h))
                # smaller sets match only equal ones
                alone = not len(h) or len(h) / (len(h) + 1) < similarity - 1e-9
                fps.append(np.zeros(0, np.int64) if alone else wide(h, 1 + words * (2 if len(h) <= FEW else 1)))
            ends = pa.array(np.cumsum([0, *map(len, fps)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(digests, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(fps) if fps else [], pa.int64()))],
                ["doc_id", "text_key", "digest", "fp"])

    return run


def _deal(batches):
    """Tries of wide fingerprints, as (key, data): of each word, turned so that
    one of its lead blocks comes first, the values by their first bits, each
    with the fingerprint's first word, which names it."""
    for b in batches:
        fps = b.column(0)
        n, flat = np.diff(fps.offsets.to_numpy()), fps.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        start = np.cumsum(n) - n
        for word in range(1, int(n.max(initial=0))):
            at = start[n > word]
            for lead in range(LEADS):
                v = flat[at + word]
                shift = np.uint64(lead * LEAD)
                v = (v << shift) | (v >> (np.uint64(BITS) - shift)) if lead else v
                order = np.argsort(v, kind="stable")
                rows, top = np.stack([v, flat[at]], axis=1)[order], (v >> np.uint64(BITS - 6))[order].astype(np.int64)
                cut = np.flatnonzero(np.diff(top, prepend=-1))
                keys = ((word * LEADS + lead) << 6) | top[cut]
                data = [rows[i:j].tobytes() for i, j in zip(cut, np.append(cut[1:], len(rows)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(data, pa.binary())], ["key", "data"])


def _join_wide(budget: int):
    def links(parts):
        rows = np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 2)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        new = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
        first = np.flatnonzero(new)
        # equal values are one leaf
        a, b = [rows[~new, 1]], [rows[first[np.cumsum(new) - 1], 1][~new]]
        vals, name = rows[first, 0].copy(), rows[first, 1].copy()
        held = len(a[0])
        for x, y in trie_pairs(vals, LEAD, budget, name, LEAF):
            a.append(name[x])
            b.append(name[y])
            held += len(x)
            if held > HELD:
                p, q = forest(np.concatenate(a), np.concatenate(b))
                a, b, held = [p], [q], len(p)
        p, q = forest(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(q.view(np.int64))], ["a", "b"])

    def run(batches):
        key, held, parts = None, 0, []
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # a try goes as a whole, or as soon as enough of its buckets are there
                if parts and k != key and (k >> 6 != key >> 6 or held > HELD):
                    yield from links(parts)
                    held, parts = 0, []
                key, held = k, held + len(data) // 16
                parts.append(data)
        if parts:
            yield from links(parts)

    return run


def wide_links(fps: DataFrame, budget: int) -> DataFrame:
    """(a, b): links between the first words of wide fingerprints, a column fp
    of arrays, by a trie self-join of each of their other words from each of
    its lead blocks: values that share the block and differ in at most
    ``budget`` bits of word and first word together."""
    rows = fps.select("fp").mapInArrow(lean(_deal), "key long, data binary").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(lean(_join_wide(budget)), "a long, b long")


def joined(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Of each of some distinct sets the first one that is reachable through
    pairs of a Jaccard similarity of ``similarity`` or more.

    A set is compared, over an inverted index, with all that no earlier one
    reached; the index is rebuilt as these halve.
    """
    n = np.array([len(h) for h in sets], dtype=np.int64)
    label = np.full(len(sets), -1, np.int64)
    left, indexed = len(sets), 0
    for first in range(len(sets)):
        if label[first] >= 0:
            continue
        label[first], queue = first, [first]
        left -= 1
        while queue and left:
            if not indexed or 2 * left < indexed:
                at = np.flatnonzero(label < 0)
                vals, own, indexed = np.concatenate([sets[i] for i in at]), np.repeat(at, n[at]), left
                order = np.argsort(vals, kind="stable")
                vals, own = vals[order], own[order]
            x = queue.pop()
            lo, hi = np.searchsorted(vals, sets[x], "left"), np.searchsorted(vals, sets[x], "right")
            k = hi - lo
            met = own[np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            ids, both = np.unique(met[label[met] < 0], return_counts=True)
            hit = ids[both >= similarity * (n[x] + n[ids] - both) - 1e-9]
            label[hit] = first
            queue += hit.tolist()
            left -= len(hit)
    return label


def _joined(shingle: int, similarity: float):
    """(digest, kept) of the sets of each component, whose rows lie together."""
    def settle(texts: dict):
        digests = sorted(texts)
        label = joined([texts[d] for d in digests], similarity)
        return digests, [digests[i] for i in label]

    def run(batches):
        at, texts = None, {}
        for b in batches:
            out = []
            for component, digest, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if component != at:
                    out.append(settle(texts))
                    at, texts = component, {}
                if digest not in texts:
                    texts[digest] = _set(text, shingle)
            yield pa.RecordBatch.from_arrays([pa.array([v for got in out for v in got[i]], pa.int64()) for i in (0, 1)], ["digest", "group"])
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in settle(texts)], ["digest", "group"])

    return run


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, missed: float = 3e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts whose sets of shingles are alike.

    Returns one row per input row: doc_id, text_key (a hash of the text) and
    group. Texts are of one group that are reachable through pairs with a
    Jaccard similarity of ``similarity`` or more. Candidates are the links of a
    trie self-join of the sets' SimHash fingerprints, which are as wide, and
    its budget as large, as the similarity asks for: a pair of just that
    similarity has no link with a chance of ``missed``. Candidates only say
    which texts are looked at together: all pairs of a candidates' component
    are then settled by their whole sets, so no pair below ``similarity``
    links.

    Texts without words are alike; otherwise as in simhash_groups. A task holds
    the sets of one component of candidates, equal ones once.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    words, budget = width_for(similarity, missed)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_key"), text_of(text_col).alias("text"))
    rows = scratch.keep(texts.mapInArrow(lean(_sketches(shingle, similarity, words)), "doc_id long, text_key long, digest long, fp array<long>"))
    sets = scratch.keep(rows.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("at"), F.first("fp").alias("fp")))
    links = wide_links(sets.where(F.size("fp") > 0), budget)
    named = sets.where(F.size("fp") > 0).select("digest", F.get("fp", F.lit(0)).alias("name"), "at")
    # fingerprints of one first word are one node
    several = named.groupBy("name").count().where(F.col("count") > 1).select(F.col("name").alias("node"), F.col("name").alias("component"))
    comp = connected_components(links, scratch)
    comp = scratch.keep(comp.unionByName(several.join(comp, "node", "left_anti")))
    wanted = scratch.keep(named.join(comp, named["name"] == comp["node"]).select("digest", "component", F.col("at.doc_id").alias("__id"), F.col("at.text_key").alias("__key")))
    looked = texts.join(F.broadcast(wanted) if small(wanted) else wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")))
    looked = looked.select("component", "digest", "text").repartition("component").sortWithinPartitions("component")
    group = scratch.keep(looked.mapInArrow(lean(_joined(shingle, similarity)), "digest long, group long"))
    out = scratch.keep(rows.select("doc_id", "text_key", "digest").join(F.broadcast(group) if small(group) else group, "digest", "left")
                       .select("doc_id", "text_key", F.coalesce("group", "digest").alias("group")))
    for t in (rows, sets, comp, wanted, group):
        scratch.drop(t)
    return out
