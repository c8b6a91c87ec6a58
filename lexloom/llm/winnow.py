"""Content-selected word grams: equal runs of `window` words select the same gram at the same place.

A window of `window` words holds window - gram + 1 grams; its anchor is the gram with the least number. Two windows with
equal words have equal anchors, so whatever recurs in windows is found among recurring anchors, which are few.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from lexloom.llm import words


@dataclass(frozen=True)
class Winnow:
    window: int
    gram: int

    @property
    def span(self) -> int:
        return self.window - self.gram + 1

    def grams(self, x: np.ndarray) -> np.ndarray:
        return words.runs(x, self.gram)

    def anchors(self, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each window, the number of its anchor; 0 where the window is not inside one text (see words.Words)."""
        if len(grams) < self.span:
            return np.empty(0, np.uint64)
        return np.where(words.whole(bounds, self.window), words.sliding_min(grams, self.span), np.uint64(0))

    def selected(self, grams: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """Positions of the grams that are some window's anchor; all places of equal grams."""
        if not len(anchors):
            return np.empty(0, np.int64)
        pad = np.zeros(self.span - 1, np.uint64)
        return np.flatnonzero(words.sliding_max(np.concatenate([pad, anchors, pad]), self.span) == grams)


def at_most_twice(texts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, number) once, or twice if it occurs more than once; by text."""
    order = np.lexsort((numbers, texts))
    texts, numbers = texts[order], numbers[order]
    third = np.zeros(len(texts), bool)
    third[2:] = (texts[2:] == texts[:-2]) & (numbers[2:] == numbers[:-2])
    return texts[~third], numbers[~third]


def places(texts: np.ndarray, numbers: np.ndarray, lists: pa.ListArray, flat: pa.Array | None = None) -> np.ndarray:
    """Where each (text, number) is in that text's list of numbers, counted over all lists, or -1."""
    key = lambda t, x: words.mixed(x ^ words.mixed(t.astype(np.uint64) + np.uint64(1)))
    wanted = (lists.flatten() if flat is None else flat).to_numpy().view(np.uint64)
    if not len(wanted):
        return np.full(len(numbers), -1)
    keys = key(np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), wanted)
    order = np.argsort(keys)
    found, keys = key(texts, numbers), keys[order]
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    return np.where(keys[at] == found, order[at], -1)


def members(texts: np.ndarray, numbers: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Whether each (text, number) is in that text's list of numbers."""
    return places(texts, numbers, lists) >= 0


def outline(winnow: Winnow, with_sha: bool = False, twice: bool = False):
    """(doc_id, digest, n_words[, sha], anchors) of each text: digest of its bytes, sha of its words joined by blanks, and the
    anchor of each place, or with `twice` each at most twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, 1):
            w = words.words_of(batch.column(1))
            grams = winnow.grams(w.numbers())
            at = winnow.selected(grams, winnow.anchors(grams, w.bounds))
            texts, numbers = w.text_of[at], grams[at]
            if twice:
                texts, numbers = at_most_twice(texts, numbers)
            places = np.searchsorted(texts, np.arange(batch.num_rows + 1))
            anchors = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(numbers.view(np.int64)))
            digests = pa.array([hashlib.md5(t).digest() for t in w.texts()], pa.binary())
            columns = [batch.column(0), digests, pa.array(w.counts), anchors]
            names = ["doc_id", "digest", "n_words", "anchors"]
            if with_sha:
                joined, bounds = w.joined()
                columns.insert(3, pa.array([hashlib.sha256(joined[a:b]).hexdigest() for a, b in zip(bounds.tolist(), bounds[1:].tolist())], pa.string()))
                names.insert(3, "sha")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run
