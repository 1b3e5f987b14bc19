"""N-gram Jaccard self-join: documents whose sets of word n-grams overlap by a threshold, as classes.

A document's set holds 64-bit hashes of its n-grams. All sets are sorted in one global order, rare n-grams first: the HOT
most frequent ones by how many documents have them, counted over all documents on the upper halves of the hashes, and
before them all others by hash. Two sets that reach the threshold share an n-gram among the first n - ceil(t n) + 1 of
each (prefix filter), so a join on prefix n-grams meets all candidates. Candidates pass a length filter, a positional
filter on the n-grams they share in their prefixes, a suffix filter - a bound of how many n-grams only one of two sets
has, from how many each has in every PART of the hashes, taken on narrow rows before any set is sent - and one exact
verification: no pair is verified twice.

Large groups of copies do not make all pairs. Equal sets are one node. Then every node is verified against one pivot. The
pivot of an n-gram is the node that has the fewest rarer n-grams before it - in a group of edited copies the one with
the fewest edits, which is nearest to all others - and a node takes the pivot that it meets most often. What that links
is a class; the full join afterwards takes only pairs whose classes differ, which loses no link between classes.
The links found are those that span the classes: most links inside a class are neither verified nor counted, and nothing
here gives the number of links of a document or the pairs of a class.

Hash joins work on packed arrays: a task sends one row for each range of hashes rather than one for each n-gram, and a
reducer holds one range, whose size follows from the number of input partitions. An n-gram that more than SPLIT
documents have is dealt over several reducers by set; each chooses a pivot, and these get a pivot among them. Frequencies
are counted within a task before they are sent. The full join is by n-gram and band of sizes. What remains of hot keys
there is an n-gram early in the prefixes of very many sets of like size that are in different classes: such pairs have
to be looked at, in partitions that adaptive execution splits.

Null and empty texts have no n-grams, size 0 and link with nothing; their class is their own id. Repeated rows get the
same result each. Null ids are smaller than none: a class takes its smallest non-null id. Texts of any length are hashed
whole, in pieces. Collisions of 64-bit hashes are taken as equality (at 10^9 distinct sets, odds of 3 in 100 that any
two collide).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.shared import forget, give_back, map_batches, slices, spread, written

N = 5
#: Jaccard threshold as a fraction of whole numbers, so that it is compared exactly.
UP, DOWN = 75, 100
#: N-grams ranked by frequency, and the least frequency of one; steps of a doubling of frequency that are told apart
#: where the ranks end.
HOT = 1 << 18
LEAST_HOT = 3
STEPS = 8
#: Sets of one n-gram that a reducer takes.
SPLIT = 1 << 12
#: Bands of sizes to a growth of e.
BANDS = 8
#: Parts of the hashes in which the suffix filter counts.
PARTS = 32
#: Bytes of text hashed at once, and hashes gathered before they are sent.
TEXT_SLICE = 1 << 20
GATHER = 1 << 20

U = np.uint64
SEED, BASE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTES = mixed(np.arange(1, 257, dtype=U) * SEED)


@dataclass
class Sets:
    """Distinct n-gram hashes of some documents: sorted within each, where each begins, how many, a key of each set."""

    hashes: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


def keys_of(hashes: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A key of each set, from the sum of its mixed hashes and its size."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[U(0)], np.cumsum(mixed(hashes + SEED))])
        return mixed(sums[begins[1:]] - sums[begins[:-1]] + sizes.astype(U) * BASE).view(np.int64)


def sets_of(texts: pa.Array, n: int = N) -> Sets:
    """The sets of a slice of texts."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    count = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + count + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    long = np.flatnonzero(np.diff(offsets) > TEXT_SLICE).tolist()
    if not long:
        return _short_sets(raw[offsets[0] : offsets[-1]], offsets - offsets[0], n)
    found, at = [], 0
    for k in [*long, count]:
        if k > at:
            found.append(_short_sets(raw[offsets[at] : offsets[k]], offsets[at : k + 1] - offsets[at], n))
        if k < count:
            found.append(_long_set(raw[offsets[k] : offsets[k + 1]], n))
        at = k + 1
    sizes = np.concatenate([x.sizes for x in found])
    return Sets(np.concatenate([x.hashes for x in found]), np.concatenate([[0], np.cumsum(sizes)]), sizes, np.concatenate([x.keys for x in found]))


def _long_set(raw: np.ndarray, n: int) -> Sets:
    """The set of one long text, hashed in pieces of TEXT_SLICE bytes; a word may go on in the next piece."""
    found: list[np.ndarray] = []
    held = total = 0
    tail = np.empty(0, U)  # the last n - 1 words
    open_sum, open_length = U(0), 0  # of a word that the end of a piece has cut

    def take(words: np.ndarray) -> None:
        nonlocal tail, held, total, found
        total += len(words)
        words = np.concatenate([tail, words])
        grams = np.zeros(max(0, len(words) - n + 1), U)
        for k in range(n):
            grams = grams * BASE + words[k : k + len(grams)]
        tail = words[max(0, len(words) - n + 1) :]
        found.append(np.unique(mixed(grams + U(n) * SEED)))
        held += len(found[-1])
        if held > 2 * len(found[0]) + TEXT_SLICE:
            found = [np.unique(np.concatenate(found))]
            held = len(found[0])

    with np.errstate(over="ignore"):
        for at in range(0, len(raw), TEXT_SLICE):
            piece = raw[at : at + TEXT_SLICE]
            solid = ~SPACES[piece]
            starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
            ends = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]])) + 1
            if open_length and not solid[0]:
                take(mixed(np.array([open_sum + U(open_length) * SEED])))
                open_sum, open_length = U(0), 0
            if not len(starts):
                continue
            lengths = ends - starts
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            powers = np.cumprod(np.full(int(lengths.max()), BASE, U))
            place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
            sums = np.add.reduceat(BYTES[LOWER[piece[solid]]] * powers[place], first)
            lengths = lengths.astype(U)
            if open_length:
                sums[0] = open_sum + sums[0] * U(pow(int(BASE), open_length, 1 << 64))
                lengths[0] += U(open_length)
                open_sum, open_length = U(0), 0
            if solid[-1] and at + TEXT_SLICE < len(raw):
                open_sum, open_length = sums[-1], int(lengths[-1])
                sums, lengths = sums[:-1], lengths[:-1]
            take(mixed(sums + lengths * SEED))
        if open_length:
            take(mixed(np.array([open_sum + U(open_length) * SEED])))
        if 0 < total < n:
            whole = U(0)
            for word in tail:
                whole = whole * BASE + word
            found = [mixed(np.array([whole + U(total) * SEED]))]
    hashes = np.unique(np.concatenate(found)) if found else np.empty(0, U)
    sizes = np.array([len(hashes)])
    begins = np.array([0, len(hashes)])
    return Sets(hashes, begins, sizes, keys_of(hashes, begins, sizes))


def _short_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> Sets:
    count = len(offsets) - 1
    with np.errstate(over="ignore"):
        solid = ~SPACES[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], solid[:-1]]) & ~edge[:-1] if len(raw) else solid
        after = np.concatenate([solid[1:], [False]]) & ~edge[1:] if len(raw) else solid
        starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        lengths = ends - starts
        words_of = np.searchsorted(offsets, starts, "right") - 1
        n_words = np.bincount(words_of, minlength=count)
        if len(starts):
            letters = LOWER[raw[solid]]
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            powers = np.cumprod(np.full(int(lengths.max()), BASE, U))
            place = np.arange(len(letters)) - np.repeat(first, lengths)
            words = mixed(np.add.reduceat(BYTES[letters] * powers[place], first) + lengths.astype(U) * SEED)
        else:
            words = np.empty(0, U)
        # n-grams of documents with n words or more
        total = len(words)
        grams = np.zeros(max(0, total - n + 1), U)
        for k in range(n):
            grams = grams * BASE + words[k : k + len(grams)]
        same = words_of[: len(grams)] == words_of[n - 1 :] if len(grams) else np.empty(0, bool)
        hashes, owner = mixed(grams[same] + U(n) * SEED), words_of[: len(grams)][same]
        # shorter ones are one n-gram as a whole
        short = np.flatnonzero((n_words > 0) & (n_words < n))
        if len(short):
            at = np.concatenate([[0], np.cumsum(n_words)])
            whole = np.zeros(len(short), U)
            for k in range(n - 1):
                there = k < n_words[short]
                whole[there] = whole[there] * BASE + words[at[short[there]] + k]
            hashes = np.concatenate([hashes, mixed(whole + n_words[short].astype(U) * SEED)])
            owner = np.concatenate([owner, short])
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        if len(hashes):
            new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
            hashes, owner = hashes[new], owner[new]
        sizes = np.bincount(owner, minlength=count)
        begins = np.concatenate([[0], np.cumsum(sizes)])
    return Sets(hashes, begins, sizes, keys_of(hashes, begins, sizes))


def planes(x: np.ndarray) -> bytes:
    """Little-endian bytes by significance, which compress well where high bytes are alike."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def unplanes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def _frequency_rows(docs: DataFrame, ranges: int) -> DataFrame:
    """(range, hashes, counts): the upper halves of all hashes, counted, sorted and packed as differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            halves, n = np.unique(np.concatenate(gathered), return_counts=True)
            n = n.astype(np.uint32)
            cuts = np.searchsorted(halves, (np.arange(ranges + 1, dtype=np.uint64) << U(32)) // U(ranges)).tolist()
            spans = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            if spans:
                blobs = [planes(np.diff(halves[a:b], prepend=np.uint32(0))) for _, a, b in spans], [planes(n[a:b]) for _, a, b in spans]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in spans], pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], names=["range", "hashes", "counts"])

        for batch in batches:
            for part in slices(batch, TEXT_SLICE):
                found = (sets_of(part.column("text")).hashes >> U(32)).astype(np.uint32)
                gathered.append(found)
                size += len(found)
                if size >= GATHER:
                    yield from flush()
                    gathered, size = [], 0
        if size:
            yield from flush()
        gathered = []
        give_back()

    return docs.select("text").mapInArrow(run, "range int, hashes binary, counts binary")


def hot_hashes(docs: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The upper halves of the most frequent hashes, in ascending order of frequency, and their frequencies.

    Frequencies are cut into levels, STEPS to a doubling. All above the level in which HOT is reached are taken, and of that
    level the halves below a bound that its count gives: HOT in all, but for a few hundred more or less.
    """

    def count(table: pa.Table) -> pa.Table:
        values = np.concatenate([np.cumsum(unplanes(x, np.uint32), dtype=np.uint32) for x in table.column("hashes").to_pylist()])
        n = np.concatenate([unplanes(x, np.uint32) for x in table.column("counts").to_pylist()])
        order = np.argsort(values, kind="stable")
        values, n = values[order], n[order]
        heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        values, n = values[heads], np.add.reduceat(n.astype(np.int64), heads)
        often = n >= LEAST_HOT
        found = pa.table({"half": values[often].astype(np.int64), "n": n[often]})
        del values, n, order, heads, often
        give_back()
        return found

    counts = written(_frequency_rows(docs, ranges).groupBy("range").applyInArrow(count, "half long, n long"), "frequencies")
    counts_level = F.floor(F.log2("n") * STEPS)
    # one row a level: 63 * STEPS at most
    levels = sorted(((r["level"], r["c"]) for r in counts.groupBy(counts_level.alias("level")).agg(F.count("*").alias("c")).collect()), reverse=True)
    taken, wanted = 0, F.lit(True)
    for level, c in levels:
        if taken + c > HOT:
            bound = (HOT - taken) * (1 << 32) // c
            wanted = (counts_level > level) | ((counts_level == level) & (F.col("half") < bound))
            break
        taken += c
    hot = counts.filter(wanted).toArrow()
    forget(counts)
    half, n = hot.column("half").to_numpy(), hot.column("n").to_numpy()
    order = np.lexsort((half, n))
    return half[order].astype(np.uint32), n[order]


class Order:
    """Ranks of hashes: 0 for all that are not hot. And over how many reducers a hash is dealt."""

    def __init__(self, hot: np.ndarray, n: np.ndarray):
        order = np.argsort(hot, kind="stable")
        self.sorted, self.rank = hot[order], (order + 1).astype(np.int32)
        self.shares = (n[order] // SPLIT + 1).astype(np.int64)

    def _at(self, hashes: np.ndarray, values: np.ndarray, other: int) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(hashes), other, values.dtype)
        half = (hashes >> U(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.sorted, half), len(self.sorted) - 1)
        return np.where(self.sorted[at] == half, values[at], other)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return self._at(hashes, self.rank, 0)

    def dealt(self, hashes: np.ndarray) -> np.ndarray:
        return self._at(hashes, self.shares, 1)


def prefix_size(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - -(-n * UP // DOWN) + 1, 0)


def _prefix_rows(docs: DataFrame, order: Order, ranges: int) -> DataFrame:
    """(range, hash, key, size, place): the prefixes of all sets, packed by range of hashes; a set once per task.

    Ranges beyond the first `ranges` are further shares of them, for the hashes that are dealt over several reducers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value, set()
        gathered, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, key, n, place = (np.concatenate(x) for x in zip(*gathered, strict=True))
            group = ((h >> U(32)) * U(ranges) >> U(32)).astype(np.int64)
            group += ranges * (key.view(U) % order.dealt(h).astype(U)).astype(np.int64)
            by = np.lexsort((h, group))
            group, h, key, n, place = group[by], h[by], key[by], n[by], place[by]
            cuts = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(h)]
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            if spans:
                yield pa.RecordBatch.from_arrays([pa.array([int(group[a]) for a, _ in spans], pa.int64()), *(pa.array([planes(x[a:b]) for a, b in spans], pa.binary()) for x in (h, key, n, place))], names=["range", "hash", "key", "size", "place"])

        for batch in batches:
            for part in slices(batch, TEXT_SLICE):
                sets = sets_of(part.column("text"))
                fresh = np.zeros(len(sets.sizes), bool)
                for k, key in enumerate(sets.keys.tolist()):
                    if sets.sizes[k] and key not in seen:
                        seen.add(key)
                        fresh[k] = True
                owner = sets.owner()
                keep = fresh[owner]
                owner, h = owner[keep], sets.hashes[keep]
                by = np.lexsort((h, order(h), owner))
                owner, h = owner[by], h[by]
                sizes = np.where(fresh, sets.sizes, 0)
                begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
                place = np.arange(len(h)) - begins[owner]
                first = place < prefix_size(sizes)[owner]
                owner = owner[first]
                gathered.append((h[first], sets.keys[owner], sizes[owner].astype(np.uint32), place[first].astype(np.uint32)))
                size += len(owner)
                if size >= GATHER // 2:
                    yield from flush()
                    gathered, size = [], 0
        if size:
            yield from flush()
        gathered, seen = [], None
        give_back()

    return docs.select("text").mapInArrow(run, "range long, hash binary, key binary, size binary, place binary")


def shared_prefixes(docs: DataFrame, order: Order, ranges: int) -> DataFrame:
    """(hash, key, n, place, pivot, pivot_n, dealt) of prefix n-grams that two sets or more have.

    pivot: the set with the fewest rarer n-grams; of an n-gram that is dealt out, that of the set's own share.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def meet(table: pa.Table) -> pa.Table:
        h, key, n, place = (np.concatenate([unplanes(x, t) for x in table.column(c).to_pylist()]) for c, t in (("hash", U), ("key", np.int64), ("size", np.uint32), ("place", np.uint32)))
        by = np.lexsort((key, h))
        h, key, n, place = h[by], key[by], n[by], place[by]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])])
        h, key, n, place = h[new], key[new], n[new], place[new]
        by = np.lexsort((key, place, h))
        h, key, n, place = h[by], key[by], n[by], place[by]
        heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        counts = np.diff(np.append(heads, len(h)))
        split = shared.value.dealt(h[heads]) > 1
        many = np.repeat((counts > 1) | split, counts)
        pivot, pivot_n = np.repeat(key[heads], counts)[many], np.repeat(n[heads], counts)[many]
        kinds = (h.view(np.int64)[many], key[many], n[many].astype(np.int32), place[many].astype(np.int32), pivot, pivot_n.astype(np.int32), np.repeat(split, counts)[many])
        found = pa.table(dict(zip(("hash", "key", "n", "place", "pivot", "pivot_n", "dealt"), kinds, strict=True)))
        del h, key, n, place, by, new, kinds, pivot, pivot_n
        give_back()
        return found

    rows = _prefix_rows(docs, order, ranges).groupBy("range").applyInArrow(meet, "hash long, key long, n int, place int, pivot long, pivot_n int, dealt boolean")
    return written(rows, "prefixes")


def handle() -> list[Column]:
    """128 bits of a document's id and text: what a set is fetched by, whether or not ids repeat or are null."""
    return [F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("h2")]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a handle, key, n and parts in place of the text; the key of an empty set is null.

    parts: how many hashes of the set are in each of PARTS equal parts of all hashes, 255 for more.
    """
    kept = [f for f in docs.schema if f.name != "text"]

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = sets_of(batch.column("text"))
            cells = sets.owner() * PARTS + (sets.hashes >> U(64 - PARTS.bit_length() + 1)).astype(np.int64)
            parts = np.minimum(np.bincount(cells, minlength=len(sets.sizes) * PARTS), 255).astype(np.uint8)
            parts = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PARTS), len(sets.sizes), [None, pa.py_buffer(parts.tobytes())]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), batch.column("h1"), batch.column("h2"), pa.array(sets.keys, pa.int64(), mask=sets.sizes == 0), pa.array(sets.sizes, pa.int64()), parts], names=[*(f.name for f in kept), "h1", "h2", "key", "n", "parts"])

        return work

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "h1 long, h2 long, key long, n long, parts binary"
    return map_batches(docs.select(*(f.name for f in kept), *handle(), "text"), schema, make, TEXT_SLICE)


def sets_of_keys(docs: DataFrame, reps: DataFrame, keys: DataFrame, few: bool = False) -> DataFrame:
    """(key, hashes) of the sets with these keys, one row each; reps: (key, h1, h2) of a document with each key.

    few: the keys become a table first, whose size then decides whether they go to the texts or texts are dealt out.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = sets_of(batch.column("text"))
            blobs = [sets.hashes[a:b].tobytes() for a, b in zip(sets.begins[:-1], sets.begins[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(sets.keys, pa.int64()), pa.array(blobs, pa.binary())], names=["key", "hashes"])

        return work

    wanted = reps.select("key", "h1", "h2").join(keys, "key").select("h1", "h2")
    wanted = written(wanted, "wanted") if few else wanted.hint("merge")
    # rows may repeat; a merge join has dealt and sorted them by these columns already
    rows = docs.select("text", *handle()).join(wanted, ["h1", "h2"]).dropDuplicates(["h1", "h2"]).select("text")
    found = written(map_batches(rows, "key long, hashes binary", make, TEXT_SLICE), "sets")
    if few:
        forget(wanted)
    return found


def least_overlap(a: int, b: int) -> int:
    """The smallest intersection with which sets of these sizes reach the threshold."""
    return -(-UP * (a + b) // (UP + DOWN))


def apart(x: np.ndarray, y: np.ndarray, most: int, depth: int = 2) -> int:
    """A lower bound of the number of elements that only one of two sorted sets has (suffix filter)."""
    bound = abs(len(x) - len(y))
    if depth == 0 or bound > most or not len(x) or not len(y):
        return bound
    middle = y[len(y) // 2]
    i, j = int(np.searchsorted(x, middle)), len(y) // 2
    left, right = abs(i - j), abs((len(x) - i) - (len(y) - j))
    if left + right > most:
        return left + right
    left = apart(x[:i], y[:j], most - right, depth - 1)
    return left + (apart(x[i:], y[j:], most - left, depth - 1) if left + right <= most else right)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    need = least_overlap(len(x), len(y))
    if need > min(len(x), len(y)):
        return False
    if apart(x, y, len(x) + len(y) - 2 * need) > len(x) + len(y) - 2 * need:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


def far_apart(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m elements cannot reach the threshold, from their counts in each part (suffix filter)."""
    apart_ = np.abs(x.astype(np.int64) - y.astype(np.int64)).sum(axis=1)
    need = -(-UP * (n + m) // (UP + DOWN))
    return np.maximum(apart_, np.abs(n - m)) > n + m - 2 * need


def near_enough(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that pass the suffix filter, on rows of a key, a size and PARTS bytes."""
    side = lambda c: reps.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("parts").alias(f"parts_{c}"))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, y = (np.frombuffer(b"".join(batch.column(f"parts_{c}").to_pylist()), np.uint8).reshape(-1, PARTS) for c in "ab")
            far = far_apart(x, y, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            return batch.select(["a", "b"]).filter(pa.array(~far))

        return work

    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    return written(map_batches(rows.select("a", "b", "n_a", "n_b", "parts_a", "parts_b"), "a long, b long", make), "near")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach the threshold; sets: (key, hashes)."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ok = [linked(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            return batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return work

    return written(map_batches(both.select("a", "b", "x", "y"), "a long, b long", make), "links")


def keys_in(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()


def once(pairs: DataFrame) -> DataFrame:
    """Each pair in one direction, once."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def pivot_pairs(prefixes: DataFrame) -> DataFrame:
    """Two pairs at most for each key: with the pivot that it meets most often, and of a pivot of a share with the pivot of shares."""
    long_enough = F.least("n", "pivot_n") * DOWN >= F.greatest("n", "pivot_n") * UP
    heads = prefixes.filter("dealt and key = pivot").select("hash", "key", "n", "place")
    first = heads.groupBy("hash").agg(F.min(F.struct("place", "key", "n")).alias("first")).select("hash", F.col("first.key").alias("pivot"), F.col("first.n").alias("pivot_n"))
    met = [prefixes, heads.join(first, "hash")]
    best = []
    for rows in met:
        votes = rows.filter((F.col("key") != F.col("pivot")) & long_enough).groupBy("key", "pivot").agg(F.count("*").alias("c"))
        best.append(votes.groupBy("key").agg(F.max(F.struct("c", "pivot")).alias("best")).select(F.col("key").alias("a"), F.col("best.pivot").alias("b")))
    return once(best[0].unionByName(best[1]))


def class_pairs(prefixes: DataFrame, classes: DataFrame, tried: DataFrame) -> DataFrame:
    """All candidate pairs (a, b) of different classes but those tried, once each, after the length and positional filters."""
    rows = prefixes.select("hash", "key", "n", "place").join(classes.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    mixed_ = rows.groupBy("hash").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("hash")
    rows = rows.join(mixed_, "hash", "left_semi")
    # An n-gram at a place meets only sets of sizes with which it can be the first shared: n - place, what is left, has to
    # hold least_overlap(n, m). So sets are joined by bands of sizes too, and two large classes of one size that share what
    # comes late in their prefixes do not meet. Bounds of bands are widened by a little, which costs a few pairs and loses none.
    band = lambda n: F.floor(F.log(F.greatest(n, F.lit(1))) * BANDS).cast("int")
    largest = F.least(F.col("n") * (DOWN / UP), (F.col("n") - F.col("place")) * ((UP + DOWN) / UP) - F.col("n"))
    bands = F.sequence(band(F.col("n") * (UP / DOWN) * (1 - 1e-9)), band(largest * (1 + 1e-9)))
    rows = rows.filter(largest * (1 + 1e-9) >= F.col("n") * (UP / DOWN)).withColumn("own", band(F.col("n"))).withColumn("other", F.explode(bands))
    rows = written(rows, "open")
    x = rows.select("hash", F.col("own").alias("band"), F.col("other").alias("band_"), *(F.col(c).alias(f"{c}_a") for c in ("key", "n", "place", "label")))
    y = rows.select("hash", F.col("other").alias("band"), F.col("own").alias("band_"), *(F.col(c).alias(f"{c}_b") for c in ("key", "n", "place", "label")))
    long_enough = F.least("n_a", "n_b") * DOWN >= F.greatest("n_a", "n_b") * UP
    # at the first n-gram that both share, no more is shared than what is left of either; at later ones the bound is only
    # stricter, which confines a pair to the prefixes that its own two sizes need
    in_reach = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) * (UP + DOWN) >= (F.col("n_a") + F.col("n_b")) * UP
    met = x.join(y, ["hash", "band", "band_"]).filter((F.col("key_a") < F.col("key_b")) & (F.col("label_a") != F.col("label_b")) & long_enough & in_reach)
    met = met.groupBy("key_a", "key_b", "n_a", "n_b").agg(F.count("*").alias("c"), F.max("place_a").alias("last_a"), F.max("place_b").alias("last_b"))
    # what both share after the last n-gram shared in the prefixes is no more than what follows it in the shorter rest
    most = F.col("c") + F.least(F.col("n_a") - F.col("last_a"), F.col("n_b") - F.col("last_b")) - 1
    met = met.filter(most * (UP + DOWN) >= (F.col("n_a") + F.col("n_b")) * UP).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    found = written(met.join(tried, ["a", "b"], "left_anti"), "pairs")
    forget(rows)
    return found


def labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with key and n in place of the text, and (key, rep, label) of every set; sets of one label are a class."""
    docs = spread(docs)
    ranges = max(8, 4 * docs.rdd.getNumPartitions())
    nodes = written(keyed(docs), "nodes")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h1", "h2", "n", "parts")).alias("best")
    reps = nodes.filter("key is not null").groupBy("key").agg(best).select("key", F.col("best.doc_id").alias("rep"), "best.h1", "best.h2", "best.n", "best.parts")
    reps = written(reps, "reps")
    order = Order(*hot_hashes(docs, ranges))
    prefixes = shared_prefixes(docs, order, ranges)
    tried = written(pivot_pairs(prefixes), "tried")
    near = near_enough(tried, reps)
    sets = sets_of_keys(docs, reps, keys_in(near))
    links = verified(near, sets)
    classes = components(links)
    left = class_pairs(prefixes, classes, tried)
    forget(prefixes, tried, near)
    near = near_enough(left, reps)
    more = sets_of_keys(docs, reps, keys_in(near).join(sets.select("key"), "key", "left_anti"), few=True)
    rest = verified(near, sets.unionByName(more))
    forget(left, near, sets, more)
    if not rest.isEmpty():
        before, classes = classes, components(links.unionByName(rest))
        forget(before)
    named = reps.select("key", "rep").join(classes.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = written(named, "named")
    forget(links, rest, reps, classes)
    return nodes, named


def ngram_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text)."""
    nodes, named = labelled(docs.select("doc_id", "text"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "label").select("key", "component_id")
    size = F.col("n").alias("n_shingles")
    own = nodes.filter("key is null").select("doc_id", size, F.col("doc_id").alias("component_id"))
    return nodes.filter("key is not null").join(named, "key").select("doc_id", size, "component_id").unionByName(own)


def row_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, row, label) for every row of docs (doc_id, row, text) that has n-grams; rows of one label are a class."""
    nodes, named = labelled(docs.select("doc_id", "row", "text"))
    return nodes.filter("key is not null").join(named.select("key", "label"), "key").select("doc_id", "row", "label")
