"""BPE by a tokenization automaton.

The automaton accepts exactly those token sequences that merging would produce. It starts as one state with a loop for
every byte. Each merge (u, v) -> w, in order of rank, adds a gadget: an arc w beside every path u v, to where v led; the
state after u is split off from the states that other tokens reach, and loses its arc v. The construction here keeps the
automaton factored: a state is its parent, the merge at which it was split off, and the arcs that it lost itself. An arc w
exists where the arc u existed when w was made, so whether a state has an arc follows from the left parts of the token
and the losses along the state's ancestry; transitions looked up once stay in a table.

Encoding a pre-split word walks the automaton over the word's bytes. One path at most spells the word; tokens are tried
longest first, and a state that failed at a position is not entered there again. So the walk is no single pass over a full
transition table; a word's result is kept in a table of words. Decoding emits the labels of the arcs.

The vocabulary is a tokenizers-library JSON file with byte-level pre-splitting; its added tokens are matched as that
library does. Nulls count as empty texts; empty texts have no tokens; texts of any length are encoded whole, their
pre-tokens in parts, and long words are kept in no table. Repeated rows give equal results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.presplit import Splitter
from tidemark.llm.shared import map_batches, spread, texts_of

#: Words in each of the two generations of a worker's table, and transitions kept in the automaton's.
WORDS = 240_000
LONG = 1_024
ARCS = 400_000


@cache
def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """The compiled merges. Tokens are numbers; state 0 is the start."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        n = len(labels)
        self.labels, self.size = labels, n
        self.left = array("i", [-1]) * n
        self.rank = array("i", [-1]) * n
        self.target = array("i", [0]) * n
        self.parent = array("i", [-1])
        self.born = array("i", [0])
        self.lost: dict[int, int] = {}
        dead = set()
        owners = array("i", [n + 1])
        for r, (u, v, w) in enumerate(merges):
            self.left[w], self.rank[w] = u, r
            state, beyond = self.target[u], self.target[v]
            if u in dead or v in dead or not self._has(state, v):
                dead.add(w)
                continue
            owners[self.target[w]] -= 1
            self.target[w] = beyond
            owners[beyond] += 1
            if owners[state] > 1:
                owners[state] -= 1
                self.parent.append(state)
                self.born.append(r)
                owners.append(1)
                self.target[u] = state = len(self.parent) - 1
            self.lost[state * n + v] = r
        self.ids = {label: t for t, label in enumerate(labels) if label and t not in dead}
        self.lengths = array("i", map(len, labels))
        self.nodes: dict[int, int] = {}
        self.token_at = array("i", [-1])
        for label, token in self.ids.items():  # a trie of the labels: which arcs can spell the next bytes
            node = 0
            for byte in label:
                key = node << 8 | byte
                node = self.nodes.get(key, 0)
                if not node:
                    node = self.nodes[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = token
        self.table: dict[int, bool] = {}

    def _has(self, state: int, token: int) -> bool:
        """Whether the arc of token leaves the state: no ancestor lost it, or a left part of it before it was made."""
        n, until = self.size, 1 << 30
        while state >= 0:
            made, part = 1 << 30, token
            while part >= 0:
                when = self.lost.get(state * n + part)
                if when is not None and when < until and when <= made:
                    return False
                made, part = self.rank[part], self.left[part]
            until, state = self.born[state], self.parent[state]
        return True

    def _spelled(self, word: bytes, at: int) -> list[int]:
        """The tokens whose labels the word has at this place, the shortest first."""
        found, node, nodes, token_at = [], 0, self.nodes, self.token_at
        for k in range(at, len(word)):
            node = nodes.get(node << 8 | word[k])
            if node is None:
                break
            if (token := token_at[node]) >= 0:
                found.append(token)
        return found

    def walk(self, word: bytes) -> list[int]:
        """The tokens of the one path that spells the word."""
        if (whole := self.ids.get(word)) is not None:
            return [whole]
        table, target, lengths, n, size = self.table, self.target, self.lengths, self.size, len(word)
        if len(table) > ARCS:
            table.clear()
        # a place on the path is three numbers; the arcs left to try are spelled again when the walk comes back to it
        path, ends, states, left = array("I"), array("q", [0]), array("q", [0]), array("q", [0])
        options = self._spelled(word, 0)
        failed = set()
        while ends:
            at, state = ends[-1], states[-1]
            while options:
                token = options.pop()
                key = state * n + token
                there = table.get(key)
                if there is None:
                    there = table[key] = self._has(state, token)
                if not there:
                    continue
                end, to = at + lengths[token], target[token]
                if end == size:
                    path.append(token)
                    return path.tolist()
                if failed and (end, to) in failed:
                    continue
                path.append(token)
                left[-1] = len(options)
                ends.append(end)
                states.append(to)
                left.append(0)
                options = self._spelled(word, end)
                break
            else:
                failed.add((at, state))
                ends.pop()
                states.pop()
                left.pop()
                if ends:
                    path.pop()
                    options = self._spelled(word, ends[-1])[: left[-1]]
        raise ValueError("no path spells the word; the vocabulary lacks single bytes")


class Codec:
    """Pre-splitting, added tokens, and the automaton with a bounded table of words."""

    def __init__(self, file: str):
        spec = json.loads(file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        size = max([*vocab.values(), *added.values()]) + 1
        labels = [b""] * size
        for text, k in vocab.items():
            labels[k] = bytes(letters[c] for c in text)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.automaton = Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.labels = list(labels)
        for text, k in added.items():
            self.labels[k] = text.encode()
        self.added, self.splitter = added, Splitter()
        self.compiled()

    def compiled(self) -> None:
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words = Words(self.automaton)

    def __getstate__(self) -> dict:
        return {"automaton": self.automaton, "labels": self.labels, "added": self.added, "splitter": self.splitter}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.compiled()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        parts, at = [], 0
        for m in self.cut.finditer(text):
            parts += [self._plain(text[at : m.start()]), self.added[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*parts, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        found = []
        for words in self.splitter.parts(text):
            self.words.age()
            found.append(b"".join(map(self.words.__getitem__, words)))
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        labels = self.labels
        return b"".join(map(labels.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


class Words(dict):
    """Word -> its ids; a missing word is taken over from the generation before, or walked through the automaton."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.before = automaton, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = array("I", self.automaton.walk(word.encode("utf-8", "surrogatepass"))).tobytes()
        if len(word) <= LONG:
            self[word] = ids
        return ids

    def age(self) -> None:
        if len(self) > WORDS:
            self.before = dict(self)
            self.clear()


def codec_of(path: str) -> Codec:
    """Compile a vocabulary file; on the driver only, the executors get the tables."""
    with open(path, encoding="utf-8") as f:
        return Codec(f.read())


def with_tokens(df: DataFrame, codec: Codec, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string): every text of df, encoded and decoded again."""
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        own = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [own.encode(t) for t in texts_of(batch, text_column)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([memoryview(x).cast("I").tolist() for x in ids], pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids])], names=[id_column, "ids", "decoded"])

        return work

    return map_batches(spread(df.select(id_column, text_column)), f"{id_column} {df.schema[id_column].dataType.simpleString()}, ids array<int>, decoded string", make)


def token_digests(df: DataFrame, codec: Codec, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the same, digested row by row. One row per row of df."""
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        own = shared.value

        def one(text: str) -> tuple[int, str, str]:
            ids = own.encode(text)
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids, decoded = zip(*map(one, texts_of(batch, text_column)), strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

        return work

    return map_batches(spread(df.select(id_column, text_column)), f"{id_column} {df.schema[id_column].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
