"""Word-piece token counts by a linear longest-match automaton."""

from __future__ import annotations

import functools
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED, LONGEST = 300_000, 64
#: The mark of a piece that begins a word, in the vocabulary file.
WORD_START = "▁"


def _spelt(ch: str) -> int:
    return len(ch.encode("utf-8", "surrogatepass"))


class LongestMatch:
    """Counts greedy longest-match pieces without building them.

    A trie holds the pieces that begin a word and, under a second root, those
    that continue one. Where no child follows, a node's failure link leads to
    the node of what is left when the pieces that greedy matching is by then
    sure of are popped; how many it pops is stored with it. Each character
    moves down the trie once, so a word costs time in proportion to its length.
    The empty string in ``first`` is the lone mark: a word of which no other
    piece begins with the mark is it and what continues. With ``spell`` a
    character without a piece counts as its UTF-8 bytes; else a word with no
    full match counts as one unknown token.
    """

    def __init__(self, first: set[str], rest: set[str], spell: bool = False):
        self.spell = spell
        self.next: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                at = root
                for ch in piece:
                    to = self.next[at].get(ch)
                    if to is None:
                        to = self.next[at][ch] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                    at = to
                if piece:
                    ends[at] = True
        size = len(self.next)
        self.fail, self.pops = [-1] * size, [0] * size
        if "" in first:
            self.fail[0], self.pops[0] = 1, 1
        queue = deque((root, ch, to) for root in (0, 1) for ch, to in self.next[root].items())
        while queue:
            up, ch, at = queue.popleft()
            if ends[at]:
                self.fail[at], self.pops[at] = 1, 1
            else:
                z, n = self.fail[up], self.pops[up]
                while z >= 0 and ch not in self.next[z]:
                    n += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[at], self.pops[at] = self.next[z][ch], n
                elif spell and (up > 0 or "" in first):
                    self.fail[at], self.pops[at] = 1, n + _spelt(ch)
            queue.extend((at, c, to) for c, to in self.next[at].items())
        self.cache: dict[bytes, int] = {}

    def word(self, word: str) -> int:
        """Pieces of a word; -1 if it has no full match."""
        nxt, fail, pops, at, n = self.next, self.fail, self.pops, 0, 0
        for ch in word:
            to = nxt[at].get(ch)
            while to is None:
                n += pops[at]
                if at == 1 and self.spell:
                    n, to = n + _spelt(ch), 1
                    break
                at = fail[at]
                if at < 0:
                    return -1
                to = nxt[at].get(ch)
            at = to
        while at != 1:
            n += pops[at]
            at = fail[at]
            if at < 0:
                return -1
        return n

    def text(self, text: str) -> tuple[int, int, int]:
        """(words, tokens, unknown words) of a text."""
        words = text.encode("utf-8", "surrogatepass").split()
        cache, tokens, unknown = self.cache, 0, 0
        for w in words:
            n = cache.get(w)
            if n is None:
                n = self.word(w.decode("utf-8", "surrogatepass"))
                if len(w) <= LONGEST:
                    if len(cache) >= CACHED:
                        cache.clear()
                    cache[w] = n
            if n < 0:
                unknown += 1
            else:
                tokens += n
        return len(words), tokens + unknown, unknown


@functools.cache
def automaton(path: str) -> LongestMatch:
    """From a sentence-piece file: greedy longest match of mark + word over all
    pieces; the byte pieces spell characters that have none. Control pieces
    are no text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    pieces = {sp.id_to_piece(i) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return LongestMatch({p[1:] for p in pieces if p.startswith(WORD_START)}, pieces, sum(map(sp.is_byte, ids)) == 256)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every whole text.

    Words are runs without ASCII white space. Null text counts as empty, with
    zeros; a word without a full match, which a vocabulary with byte pieces does
    not leave, counts as one token; null and repeated
    ids are kept as they are; an empty table gives no rows; other columns are
    ignored. The table of known words is bounded.
    """
    def run(batches):
        count = automaton(path).text
        for b in batches:
            got = [count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[i] for g in got], pa.int64()) for i in range(3))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
