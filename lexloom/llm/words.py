"""Words of many texts at once: their places in the texts' bytes, and 64-bit numbers for words and for runs of words, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text handled at once
CHUNK_BYTES = 1 << 20
#: bytes up to which powers are kept
KEPT_BYTES = (2 << 20) + 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX
    x = (x ^ (x >> _SHIFT)) * _MIX
    return x ^ (x >> _SHIFT)


#: a number for each value of a byte
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base, and of its inverse modulo 2**64, from 0 to n - 1; longer ones are not kept."""
    if _powers and len(_powers[0]) >= n:
        return _powers
    size = max(n, KEPT_BYTES)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    made = []
    for base in (_BASE, inverse):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if size == KEPT_BYTES:
        _powers[:] = made
    return made


def slices(batches: Iterator[pa.RecordBatch], column: str | int = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of at most `limit` bytes of the column, a single longer value apart."""
    for batch in batches:
        at = column if isinstance(column, int) else batch.schema.get_field_index(column)
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(upto[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


@dataclass(frozen=True)
class Words:
    """data: all texts' bytes in UTF-8, text k from offsets[k] on. Word i is data[starts[i]:ends[i]]; text k has the words
    bounds[k] to bounds[k + 1] - 1."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def numbers(self) -> np.ndarray:
        """A number for each word: a polynomial over its bytes modulo 2**64, mixed with its length."""
        power, inverse = _powers_to(len(self.data) + 1)
        with np.errstate(over="ignore"):
            upto = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * power[: len(self.data)], out=upto[1:])
            whole = (upto[self.ends] - upto[self.starts]) * inverse[self.starts]
            return mixed(whole + (self.ends - self.starts).astype(np.uint64) * _BASE)

    def joined(self, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
        """The kept words of each text joined by one blank: bytes of all texts, and where each text begins."""
        kept = np.arange(len(self.starts)) if keep is None else np.flatnonzero(keep)
        starts, ends = self.starts[kept], self.ends[kept]
        bounds = np.searchsorted(kept, self.bounds)
        last = np.zeros(len(kept), bool)
        last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
        gap = ends[~last]  # a later word of the text follows, so white space is there
        steps = np.zeros(len(self.data) + 2, np.int8)
        steps[starts] += 1
        np.subtract.at(steps, ends + ~last, 1)
        inside = np.cumsum(steps[: len(self.data)], dtype=np.int8) > 0
        data = self.data.copy()
        data[gap] = 32
        sizes = np.concatenate([[0], np.cumsum(ends - starts + ~last)])
        return data[inside].tobytes(), sizes[bounds]

    def texts(self) -> list[memoryview]:
        data = memoryview(self.data)
        return [data[a:b] for a, b in zip(self.offsets.tolist(), self.offsets[1:].tolist())]

    def words(self, k: int) -> list[bytes]:
        """The words of text k."""
        spans = zip(self.starts[self.bounds[k] : self.bounds[k + 1]].tolist(), self.ends[self.bounds[k] : self.bounds[k + 1]].tolist())
        return [self.data[a:b].tobytes() for a, b in spans]


def words_of(texts: pa.Array | list[str | None], apart: np.ndarray = _SPACE) -> Words:
    """Maximal runs of bytes, in UTF-8, other than those that `apart` marks: blank and U+0009 to U+000D if not said otherwise.
    Null texts have none."""
    if isinstance(texts, list):
        texts = pa.array(texts, pa.large_string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~apart[data]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    heads, tails = offsets[:-1][offsets[:-1] < len(data)], offsets[1:][offsets[1:] > 0] - 1
    begin[heads], finish[tails] = inside[heads], inside[tails]
    starts = np.flatnonzero(begin)
    return Words(data, offsets, starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets))


_NO_TERM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_ODD = r"[^\x00-\x7f\pL\pN]"


def terms_of(texts: pa.Array | list[str | None]) -> Words:
    """Maximal runs of letters and numbers, in lower case (each character by itself)."""
    if isinstance(texts, list):
        texts = pa.array(texts, pa.string())
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    odd = pc.match_substring_regex(low, _ODD)
    if pc.any(odd).as_py():
        low = pc.replace_with_mask(low, odd, pc.replace_substring_regex(low.filter(odd), _ODD, " "))
    return words_of(low, _NO_TERM)


def runs(x: np.ndarray, n: int) -> np.ndarray:
    """A number for each n consecutive entries of x: a polynomial modulo 2**64, by doubling, then mixed."""
    if len(x) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power, size, done, out = x, 1, 0, None
        base = _BASE
        while True:
            if n & size:
                if out is None:
                    out, scale = power, base
                else:  # out covers `done` entries, then power's follow
                    m = len(x) - done - size + 1
                    out = out[:m] * base + power[done : done + m]
                done += size
            if done == n:
                break
            m = len(power) - size
            power = power[:m] * base + power[size : size + m]
            base = base * base
            size *= 2
        return mixed(out[: len(x) - n + 1])


def whole(bounds: np.ndarray, n: int) -> np.ndarray:
    """For each place where a run of n entries fits into the whole array, whether it stays inside one text."""
    total = int(bounds[-1])
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(total)
    return room[: max(0, total - n + 1)] >= n


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n consecutive entries, by doubling."""
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = n - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def sliding_max(x: np.ndarray, n: int) -> np.ndarray:
    return ~sliding_min(~x, n)
