"""Token counts under a unigram model, by dynamic programming on a trie.

Pre-tokens (byte-level pre-splitting, as in byte-pair vocabularies) are inserted in a trie of bytes. The best score of a
prefix - the largest sum of log probabilities over its splits into vocabulary pieces - belongs to its node, so prefixes
that pre-tokens share are scored once; the node where a pre-token ends stores its number of pieces. A document's count is
the sum over its pre-tokens.

The vocabulary is a file of byte pieces in order of rank. Its pieces get the probabilities of Zipf's law over ranks,
log p = -log(rank + OFFSET): an assumption that stands in for the missing training counts and is a parameter. Ties in score
go to fewer pieces.

Null and empty texts have 0 tokens; a row for every row of the input. Texts of any length are counted whole: their
pre-tokens are taken in parts, and a pre-token of more than LONG bytes, which no other is likely to share, is scored with no
more than the last scores in memory and leaves no nodes.
"""

from __future__ import annotations

import base64
import math
from array import array
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.presplit import Splitter
from tidemark.llm.shared import map_batches, spread, texts_of

OFFSET = 2.7
#: Nodes and pre-tokens a worker keeps; a full trie is begun anew, which changes no count.
NODES, WORDS = 600_000, 250_000
LONG = 2_048
#: Scores that differ by less are equal; sums of logs over different splits differ in their last bits.
SAME = 1e-9


def pieces_of(path: str, offset: float = OFFSET) -> dict[bytes, float]:
    """Log probabilities of a rank file's pieces."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return {piece: -math.log(rank + offset) for piece, rank in ranks.items()}


class Trie:
    """Forward scores by node. The root is node 0."""

    def __init__(self, pieces: dict[bytes, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        self.backward: dict[int, int] = {}  # a trie of the pieces read backwards
        self.ends = array("d", [math.inf])
        for piece, score in pieces.items():
            node = 0
            for byte in reversed(piece):
                key = node << 8 | byte
                node = self.backward.get(key, 0)
                if not node:
                    node = self.backward[key] = len(self.ends)
                    self.ends.append(math.inf)
            self.ends[node] = score
        self.reset()

    def reset(self) -> None:
        self.children: dict[int, int] = {}
        self.best = array("d", [0.0])
        self.count = array("i", [0])

    def insert(self, word: bytes) -> int:
        """The number of pieces in the best split of the word; new prefixes are scored on the way."""
        if len(word) > LONG:
            return self.scored_alone(word)
        children, best, count, backward, ends = self.children, self.best, self.count, self.backward, self.ends
        path = [0]
        for at, byte in enumerate(word):
            key = path[-1] << 8 | byte
            node = children.get(key)
            if node is None:
                node = children[key] = len(best)
                top, fewest, behind, begin = -math.inf, 0, 0, at
                while begin >= 0:  # every piece that ends here, the shortest first
                    behind = backward.get(behind << 8 | word[begin])
                    if behind is None:
                        break
                    if (own := ends[behind]) <= 0:
                        before = path[begin]
                        total, pieces = best[before] + own, count[before] + 1
                        if total > top + SAME or total > top - SAME and pieces < fewest:
                            top, fewest = total, pieces
                    begin -= 1
                best.append(top)
                count.append(fewest)
            path.append(node)
        return count[path[-1]]


    def scored_alone(self, word: bytes) -> int:
        """The same for a long word, with scores of the last places only: a ring of the longest piece's length."""
        backward, ends, size = self.backward, self.ends, self.longest + 1
        best, count = array("d", [0.0]) * size, array("q", [0]) * size
        for at in range(len(word)):
            top, fewest, behind, begin = -math.inf, 0, 0, at
            while begin >= 0:  # every piece that ends here, the shortest first
                behind = backward.get(behind << 8 | word[begin])
                if behind is None:
                    break
                if (own := ends[behind]) <= 0:
                    total, pieces = best[begin % size] + own, count[begin % size] + 1
                    if total > top + SAME or total > top - SAME and pieces < fewest:
                        top, fewest = total, pieces
                begin -= 1
            best[(at + 1) % size], count[(at + 1) % size] = top, fewest
        return count[len(word) % size]


class Counts(dict):
    """Pre-token -> number of pieces, filled by the trie."""

    def __init__(self, trie: Trie):
        self.trie, self.before = trie, {}

    def __missing__(self, word: str) -> int:
        n = self.before.get(word)
        if n is None:
            n = self.trie.insert(word.encode("utf-8", "surrogatepass"))
        if len(word) <= LONG:
            self[word] = n
        return n

    def age(self) -> None:
        if len(self) > WORDS:
            self.before = dict(self)
            self.clear()
        if len(self.trie.best) > NODES:
            self.trie.reset()


def count_tokens(df: DataFrame, pieces: dict[bytes, float], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, n_pretokens): no shuffle; every task has its own trie."""
    shared = df.sparkSession.sparkContext.broadcast((pieces, Splitter()))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        own, splitter = shared.value
        counts = Counts(Trie(own))

        def one(text: str) -> tuple[int, int]:
            n = n_words = 0
            for words in splitter.parts(text):
                counts.age()
                n, n_words = n + sum(map(counts.__getitem__, words)), n_words + len(words)
            return n, n_words

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, words = zip(*map(one, texts_of(batch, text_column)), strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(words, pa.int64())], names=[id_column, "n_tokens", "n_pretokens"])

        return work

    return map_batches(spread(df.select(id_column, text_column)), f"{id_column} {df.schema[id_column].dataType.simpleString()}, n_tokens long, n_pretokens long", make)
