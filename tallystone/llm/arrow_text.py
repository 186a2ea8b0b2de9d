"""Word and shingle hashing over Arrow batches with numpy; runs in Python workers."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept between batches."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def give_back() -> None:
    """Returns memory that Arrow and the C library keep for later to the system; workers live longer than their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches, text_at: int, max_bytes: int = 1 << 20):
    """(slice of a batch, its texts as bytes or None) with about max_bytes of text each; a longer text comes alone."""
    for batch in batches:
        col = batch.column(text_at)
        if not pa.types.is_binary(col.type) and not pa.types.is_large_binary(col.type):
            col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
        start, size, texts = 0, 0, []
        for i, value in enumerate(col):
            text = value.as_py()
            if texts and size + len(text or b"") > max_bytes:
                yield batch.slice(start, i - start), texts
                start, size, texts = i, 0, []
            texts.append(text)
            size += len(text or b"")
        if texts:
            yield batch.slice(start), texts
        give_back()


class Words:
    """The white-space words (A-Z in lower case) of some texts: hashes of runs of words, with no Python loop over words."""

    def __init__(self, texts: list[bytes | None]):
        split = [(t or b"").lower().split() for t in texts]
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        joined = b" ".join([b" ".join(w) for w in split if w])
        data = np.frombuffer(joined + b" ", np.uint8)
        self.ends = np.flatnonzero(data == 32)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]).astype(np.int64)
        if not self.counts.sum():
            self.ends, self.starts = self.ends[:0], self.starts[:0]
        up, self._down = _powers(len(data))
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64)])

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """64-bit hash of the words first..last, single spaces between them, for each pair of word numbers."""
        s, e = self.starts[first], self.ends[last]
        return mixed((self._sums[e] - self._sums[s]) * self._down[s])

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, text after text, and where each text's begin; a text of fewer words is one run."""
        n = np.where(self.counts == 0, 0, np.maximum(self.counts - k + 1, 1))
        at = np.concatenate([[0], np.cumsum(n)])
        first = np.arange(at[-1]) + np.repeat(self.first[:-1] - at[:-1], n)
        last = np.minimum(first + k - 1, np.repeat(self.first[1:] - 1, n))
        return self.hashes(first, last), at
