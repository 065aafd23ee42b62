"""Greedy word-piece counts in time linear in the text, without building pieces.

A word is a run of ``[^\\x20\\x09-\\x0D]`` bytes with one space in front; greedy
longest match takes, from the left, the longest vocabulary entry each time. The
vocabulary is a byte trie. A node's failure link says where matching goes on
when no child fits, and its popped count says how many pieces are complete by
then, so a word is read once and only counts are added. Counts of words a
worker has met are kept in a bounded table.

Defined cases: null text counts as empty: 0 words, 0 tokens. A word with a byte
that the vocabulary cannot match is one token. Words of any length are read
whole. Columns ``n_words`` and ``n_tokens`` replace columns of those names.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks

CACHED_WORDS = 400_000


class PieceCounter:
    """Longest-match automaton over a set of byte strings."""

    def __init__(self, vocabulary: Iterable[bytes]):
        child: list[dict[int, int]] = [{}]
        final = [False]
        for entry in vocabulary:
            node = 0
            for byte in entry:
                if byte not in child[node]:
                    child[node][byte] = len(child)
                    child.append({})
                    final.append(False)
                node = child[node][byte]
            final[node] = node != 0
        fail: list[int] = [-1] * len(child)  # -1: matching cannot go on
        popped = [0] * len(child)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in child[parent].items():
                queue.append(node)
                if final[node]:
                    fail[node], popped[node] = 0, 1
                    continue
                count, state = popped[parent], fail[parent]
                while state > 0 and byte not in child[state]:
                    count += popped[state]
                    state = fail[state]
                if state >= 0 and byte in child[state]:
                    fail[node], popped[node] = child[state][byte], count
        self.child, self.fail, self.popped = child, fail, popped

    def count(self, word: bytes) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        node = total = 0
        for byte in word:
            while byte not in child[node]:
                if fail[node] < 0:
                    return 1
                total += popped[node]
                node = fail[node]
            node = child[node][byte]
        while node:
            if fail[node] < 0:
                return 1
            total += popped[node]
            node = fail[node]
        return total


class WordCounts(dict):
    """Counts of words by look-up; a missing one runs the automaton."""

    def __init__(self, counter: PieceCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        count = self[word] = self.counter.count(b" " + word)
        return count


@lru_cache(maxsize=4)
def word_counts(path: str) -> WordCounts:
    return WordCounts(PieceCounter(read_ranks(path)))


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Add ``n_words`` and ``n_tokens`` of the whole ``text``, by the vocabulary file at ``path``."""

    @F.pandas_udf("n_words long, n_tokens long")
    def counts(texts: pd.Series) -> pd.DataFrame:
        known = word_counts(path)
        rows = []
        for text in texts:
            words = (text or "").encode("utf-8").split()  # bytes split at the six ASCII spaces only
            rows.append((len(words), sum(map(known.__getitem__, words))))
        return pd.DataFrame(rows, columns=["n_words", "n_tokens"], dtype="int64")

    free = "_counts"
    while free.lower() in [c.lower() for c in docs.columns]:
        free += "_"
    both = docs.withColumn(free, counts.asNondeterministic()("text"))
    return both.withColumns({"n_words": F.col(f"{free}.n_words"), "n_tokens": F.col(f"{free}.n_tokens")}).drop(free)
