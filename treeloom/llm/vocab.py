"""Reading vocabulary files, once for each Python worker."""

from __future__ import annotations

import base64
import functools
from array import array

import numpy as np

#: The printable stand-ins of byte-level vocabularies: these bytes stand for
#: themselves, the others take the code points from 256 on, in order.
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_chars() -> list[str]:
    """The character that stands for each byte."""
    odd = iter(range(256, 512))
    plain = set(PLAIN_BYTES)
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def rank_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@functools.cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Known(dict):
    """Ids of words met before, as bytes of unsigned 16- or 32-bit integers.

    Words over LONGEST characters are not kept. When there are ``cached`` of them
    they become the older generation, from which a word met again comes back,
    and the one older is dropped: so the size is bounded.
    """

    CACHED, LONGEST = 150_000, 48

    def __init__(self, ids_of, count: int, cached: int = CACHED):
        super().__init__()
        self.cached = cached
        self.ids_of, self.code = ids_of, "H" if count <= 1 << 16 else "I"
        self.kind, self.older = np.dtype(self.code), {}

    def __missing__(self, word):
        ids = self.older.get(word)
        if ids is None:
            ids = array(self.code, self.ids_of(word)).tobytes()
        if len(word) <= self.LONGEST:
            if len(self) >= self.cached:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def forget(self) -> None:
        """Hold nothing; for the end of a task, as its worker lives on."""
        self.clear()
        self.older = {}

    def join(self, words) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype=self.kind)
