"""Token counts: greedy longest-match word pieces, counted in linear time.

The vocabulary is a trie. Where a node has no edge for the next byte, its failure
link leads to the node from which matching goes on, and the number of pieces that
are finished on the way (popped) is known beforehand. A word so takes a step
or a link per byte, and no piece is ever built.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import buffers

#: Words of a task whose counts are remembered.
MEMORY = 400_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a file with lines ``base64 rank``."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """``count(word)``: pieces of the greedy longest match; 1 where some part matches no piece (unknown word)."""

    def __init__(self, edges: dict[int, int], fail: list[int], popped: list[int]):
        self.edges, self.fail, self.popped = edges, fail, popped

    @classmethod
    def build(cls, vocabulary: Iterable[bytes]) -> Automaton:
        edges: dict[int, int] = {}
        parent, byte, final = [-1], [0], [False]
        for token in vocabulary:
            v = 0
            for c in token:
                to = edges.get(v << 8 | c)
                if to is None:
                    to = edges[v << 8 | c] = len(parent)
                    parent.append(v), byte.append(c), final.append(False)
                v = to
            if v:
                final[v] = True
        children: list[list[int]] = [[] for _ in parent]
        for v in range(1, len(parent)):
            children[parent[v]].append(v)
        fail, popped = [-1] * len(parent), [0] * len(parent)
        queue = deque(children[0])
        while queue:
            v = queue.popleft()
            queue.extend(children[v])
            if final[v]:
                fail[v], popped[v] = 0, 1
                continue
            z, n = fail[parent[v]], popped[parent[v]]
            while z >= 0 and (z << 8 | byte[v]) not in edges:
                n += popped[z]
                z = fail[z]
            if z >= 0:
                fail[v], popped[v] = edges[z << 8 | byte[v]], n
        return cls(edges, fail, popped)

    def count(self, word: bytes) -> int:
        edges, fail, popped = self.edges, self.fail, self.popped
        v = n = 0
        for c in word:
            to = edges.get(v << 8 | c)
            while to is None:
                n += popped[v]
                v = fail[v]
                if v < 0:
                    return 1
                to = edges.get(v << 8 | c)
            v = to
        while v:
            n += popped[v]
            v = fail[v]
            if v < 0:
                return 1
        return n

    def arrays(self) -> tuple[np.ndarray, ...]:
        e = np.array(list(self.edges.items()), dtype=np.int64).reshape(-1, 2)
        return e[:, 0], e[:, 1], np.array(self.fail, np.int32), np.array(self.popped, np.int32)

    @classmethod
    def of_arrays(cls, keys, values, fail, popped) -> Automaton:
        return cls(dict(zip(keys.tolist(), values.tolist())), fail.tolist(), popped.tolist())


class _Memory(dict):
    def __init__(self, automaton: Automaton, mark: bytes):
        self.automaton, self.mark = automaton, mark

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        n = self.automaton.count(self.mark + word)
        if len(word) <= 64:
            self[word] = n
        return n


def token_counts(
    docs: DataFrame, vocabulary: Iterable[bytes], doc_id: str = "doc_id", text: str = "text", mark: bytes = b" "
) -> DataFrame:
    """``(doc_id, n_bytes, n_words, n_tokens)`` (long) for each row of ``docs``.

    A word is a run of other than ASCII white space; ``mark`` is put before it, so that
    tokens that begin with the mark are the pieces that begin a word. The pieces of a word are the greedy longest
    match over its UTF-8 bytes; a word with an unmatched part is one token. A null or
    blank text has no words. Texts of any length are read whole, rows are kept as
    they are, null ids too, and an empty table gives an empty one. The automaton is broadcast; its size is the vocabulary's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton.build(vocabulary).arrays())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(Automaton.of_arrays(*shared.value), mark)
        for batch in batches:
            data, at = buffers(batch.column(1))
            view = memoryview(data)
            n_words, n_tokens = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                words = bytes(view[a:b]).split()
                n_words.append(len(words))
                n_tokens.append(sum(map(memory.__getitem__, words)))
            yield pa.record_batch(
                [batch.column(0), pa.array(np.diff(at)), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_words", "n_tokens"],
            )

    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, n_bytes long, n_words long, n_tokens long")
