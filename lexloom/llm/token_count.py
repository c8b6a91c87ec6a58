"""Greedy longest-match token counts by a linear automaton.

The vocabulary is a trie over bytes. Every node has a failure link and the number of tokens that taking the link pops, so
that a text is read byte by byte with no backtracking and no pieces are built: at a byte with no child, add the popped
count and follow the link; at a word's end, add what the node still holds. Counts equal those of cutting the longest
vocabulary entry again and again from the left.

A word is a maximal run of bytes other than ASCII white space, matched with the word mark (a blank) in front. The
vocabulary must have every single byte; ``load_ranks`` reads a file of base-64 tokens which has them.

Defined results: null and empty texts have 0 words and 0 tokens. Repeated rows each give a row, an empty table gives
none, other columns are neither read nor returned. A text of any length is read whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.words import slices

WORD_MARK = b" "
CACHE_WORDS = 400_000


def load_ranks(path: str) -> list[bytes]:
    return [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip()]


class LongestMatchAutomaton:
    """children[v]: byte to node. link[v]: where to go on when no child fits, -1 if nothing of v can be popped (only for
    nodes that cannot fail with a full byte vocabulary). popped[v]: tokens popped on the way. rest[v]: tokens in v's string."""

    def __init__(self, tokens: Iterable[bytes]):
        self.children: list[dict[int, int]] = [{}]
        final = [False]
        for token in tokens:
            v = 0
            for b in token:
                nxt = self.children[v].get(b)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[v][b] = nxt
                    self.children.append({})
                    final.append(False)
                v = nxt
            if v:
                final[v] = True
        missing = [b for b in range(256) if not final[self.children[0].get(b, 0)]]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        n = len(self.children)
        self.link, self.popped, self.rest = [0] * n, [0] * n, [0] * n
        queue = [0]
        for u in queue:  # breadth first: links lead to shallower nodes
            for b, v in self.children[u].items():
                queue.append(v)
                if final[v]:
                    self.link[v], self.popped[v] = 0, 1
                else:
                    z, pops = self.link[u], self.popped[u]
                    while b not in self.children[z]:
                        pops += self.popped[z]
                        z = self.link[z]
                    self.link[v], self.popped[v] = self.children[z][b], pops
                # the string of v, if it ends here: pop along links down to the root
                z, pops = v, 0
                while z:
                    pops += self.popped[z]
                    z = self.link[z]
                self.rest[v] = pops

    def count(self, word: bytes) -> int:
        children, link, popped = self.children, self.link, self.popped
        v = total = 0
        for b in word:
            nxt = children[v].get(b)
            while nxt is None:
                total += popped[v]
                v = link[v]
                nxt = children[v].get(b)
            v = nxt
        return total + self.rest[v]


class _Counts(dict):
    """Counts of words met so far; emptied when full, which changes no result."""

    def __init__(self, automaton: LongestMatchAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = self[word] = self.automaton.count(WORD_MARK + word)
        return n


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens for each row; one pass, no shuffle. The automaton is built once in each Python worker's task."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(_automaton(vocabulary_path))
        for batch in slices(batches, 1):
            words, tokens = [], []
            for text in batch.column(1).to_pylist():
                split = text.encode("utf-8", "surrogatepass").split() if text else []
                words.append(len(split))
                tokens.append(sum(map(counts.__getitem__, split)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return slim.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_tokens bigint")


_BUILT: dict[str, LongestMatchAutomaton] = {}


def _automaton(path: str) -> LongestMatchAutomaton:
    """Kept in the Python worker, which serves many tasks; its size is the vocabulary's."""
    if path not in _BUILT:
        _BUILT[path] = LongestMatchAutomaton(load_ranks(path))
    return _BUILT[path]
