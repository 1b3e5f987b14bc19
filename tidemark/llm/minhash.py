"""MinHash near-duplicate classes: banded candidates, sequential Bayesian verification, exact confirmation.

A document's set holds 64-bit hashes of its distinct n-grams; equal sets are one node. A node's signature has BANDS x ROWS
minima of multiply-shift hashes. Nodes that agree in all rows of a band are candidates: sets of the threshold's similarity
meet with probability 1 - (1 - t^ROWS)^BANDS, 99.98 per cent for 0.85.

A candidate pair is judged on its signatures in batches of BATCH minima. After k minima of which m agree, the posterior
probability that the similarity reaches the threshold, from a uniform prior, is that of at most m successes in k + 1 trials
at the threshold; as soon as it falls below MISS the pair is given up. Every survivor is verified on the full sets, so no
link is wrong; a true one is given up with a probability of about MISS a batch at the threshold itself, and less above.

Large groups of copies do not make all pairs. In each bucket the pivot is the node that meets most others over all its
buckets - in a group of edited copies that is the one with the fewest edits. Each node is tried against the pivot that it
shares most buckets with; what that links is a class. Then buckets in which several classes meet give the pairs of
different classes, each pair once. Of a bucket with more than CROWD nodes pairs are not listed: its nodes are dealt into
blocks of BLOCK_NODES, signatures of two blocks are compared in a task, batch after batch, and only what the posterior
leaves is kept, by the first bucket that two nodes share. Links within a class are not looked for.

Survivors are verified by pivot: a pivot's set goes once to each of its shards, whose size is bounded in hashes, and
each node's set goes to its shard.

Null and empty texts have no n-grams, size 0, and are a class of their own id. Repeated rows get the same result. A class
takes its smallest id that is not null. No rows give no rows; columns other than id and text are dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.ngram_join import TEXT_SLICE, U, handle, keys_in, mixed, once, sets_of, sets_of_keys
from tidemark.llm.shared import forget, give_back, map_batches, spread, written

#: Jaccard threshold as a fraction of whole numbers, so that it is compared exactly.
UP, DOWN = 85, 100
BANDS, ROWS = 32, 8
#: Minima compared between two looks at the posterior, and the posterior probability at which a pair is given up.
BATCH, MISS = 32, 1e-4
#: Nodes of a bucket with several classes from which on its pairs are compared in blocks of so many nodes.
CROWD, BLOCK_NODES = 8, 512
#: Hashes of sets in one shard of a pivot.
SHARD = 1 << 13
#: Hashes worked on at once.
BLOCK = 1 << 15

MINIMA = BANDS * ROWS
with np.errstate(over="ignore"):
    MULTIPLIERS = mixed(np.arange(1, MINIMA + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
    ADDENDS = mixed(np.arange(1, MINIMA + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F))


def signatures(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Minima of every set: one row a set, MINIMA columns of 32 bits; of an empty set, zeros."""
    sizes = np.diff(begins)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), MINIMA), np.uint32)
    if not len(full):
        return out
    with np.errstate(over="ignore"):
        # several sets of few hashes at once; of a large set one stretch after another
        at = 0
        while at < len(full):
            end = at + 1
            while end < len(full) and begins[full[end] + 1] - begins[full[at]] <= BLOCK:
                end += 1
            rows = full[at:end]
            low, high = int(begins[rows[0]]), int(begins[rows[-1] + 1])
            best = np.full((MINIMA, len(rows)), np.iinfo(U).max, U)
            for start in range(low, high, BLOCK):
                part = hashes[start : min(high, start + BLOCK)]
                heads = (begins[rows] - low).astype(np.int64) if len(rows) > 1 else np.zeros(1, np.int64)
                for k in range(MINIMA):
                    best[k] = np.minimum(best[k], np.minimum.reduceat(part * MULTIPLIERS[k] + ADDENDS[k], heads))
            out[rows] = (best >> U(32)).astype(np.uint32).T
            at = end
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of each signature, different for different bands."""
    with np.errstate(over="ignore"):
        rows = signature.reshape(len(signature), BANDS, ROWS).astype(U)
        found = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), rows.shape[:2])
        for k in range(ROWS):
            found = mixed(found * U(0xD6E8FEB86659FD93) + rows[:, :, k])
    return found.view(np.int64)


def least_matches() -> list[tuple[int, int]]:
    """(k, m): after k minima, a pair with fewer than m that agree is given up."""
    found = []
    for k in range(BATCH, MINIMA + 1, BATCH):
        below, m = 0.0, 0
        while m <= k:
            below += comb(k + 1, m) * (UP / DOWN) ** m * (1 - UP / DOWN) ** (k + 1 - m)
            if below >= MISS:
                break
            m += 1
        found.append((k, m))
    return found


def plausible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of signatures are left after all batches; a pair given up takes no part in later batches."""
    left, agreed = np.arange(len(x)), np.zeros(len(x), np.int64)
    for k, least in least_matches():
        agreed = agreed + (x[left, k - BATCH : k] == y[left, k - BATCH : k]).sum(axis=1)
        kept = agreed >= least
        left, agreed = left[kept], agreed[kept]
        if not len(left):
            break
    return left


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, key, n, minima, bands) of every row; key, minima and bands of an empty set are null.

    Minima and bands are given with the first document of a set in a batch only; of the minima, the lower 16 bits, by which
    unlike ones agree once in 65,536 times.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = sets_of(batch.column("text"))
            first = np.zeros(len(sets.keys), bool)
            first[np.unique(sets.keys, return_index=True)[1]] = True
            first &= sets.sizes > 0
            hashes, sizes = sets.hashes[first[sets.owner()]], sets.sizes[first]
            found = signatures(hashes, np.concatenate([[0], np.cumsum(sizes)]))
            minima, bands = iter(found.astype(np.uint16)), iter(band_hashes(found))
            blobs = [next(minima).tobytes() if f else None for f in first]
            lists = [next(bands).tolist() if f else None for f in first]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h1", "h2")), pa.array(sets.keys, pa.int64(), mask=sets.sizes == 0), pa.array(sets.sizes, pa.int64()), pa.array(blobs, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "h1", "h2", "key", "n", "minima", "bands"])

        return work

    return map_batches(docs.select("doc_id", *handle(), "text"), "doc_id long, h1 long, h2 long, key long, n long, minima binary, bands array<long>", make, TEXT_SLICE)


def long_enough(a: str = "n", b: str = "m"):
    """Length filter: sets whose sizes are too far apart cannot reach the threshold."""
    return F.least(a, b) * DOWN >= F.greatest(a, b) * UP


def pivot_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): each node and the pivot that it meets most often; shared: (bucket, key, n, size)."""
    score = shared.groupBy("key").agg(F.sum("size").alias("score"))
    pivots = shared.join(score, "key").groupBy("bucket").agg(F.max(F.struct("score", "key", "n")).alias("top")).select("bucket", F.col("top.key").alias("pivot"), F.col("top.n").alias("m"))
    votes = shared.join(pivots, "bucket").filter((F.col("key") != F.col("pivot")) & long_enough()).groupBy("key", "pivot").agg(F.count("*").alias("c"))
    return once(votes.groupBy("key").agg(F.max(F.struct("c", "pivot")).alias("best")).select(F.col("key").alias("a"), F.col("best.pivot").alias("b")))


def open_buckets(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, key, n, label, size) of the buckets in which nodes of several classes meet, as a table."""
    rows = shared.drop("size").join(classes.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    several = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).filter("low < high").select("bucket", "size")
    return written(rows.join(several, "bucket"), "open")


def listed_pairs(rows: DataFrame, tried: DataFrame) -> DataFrame:
    """Candidates (a, b) of different classes in small buckets but those tried, once each."""
    side = lambda x: rows.filter(F.col("size") <= CROWD).select("bucket", *(F.col(c).alias(f"{c}_{x}") for c in ("key", "n", "label")))
    met = side("a").join(side("b"), "bucket").filter((F.col("key_a") < F.col("key_b")) & (F.col("label_a") != F.col("label_b")) & long_enough("n_a", "n_b"))
    pairs = met.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()
    return written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")


def compared_pairs(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): what sequential verification leaves of the pairs of different classes in crowded buckets, once each."""

    def compare(table: pa.Table) -> pa.Table:
        low, high, bucket = (table.column(c)[0].as_py() for c in ("low", "high", "bucket"))
        order = np.argsort(table.column("key").to_numpy(), kind="stable")
        key, n, label, block = (table.column(c).to_numpy()[order] for c in ("key", "n", "label", "block"))
        minima = np.frombuffer(b"".join(table.column("minima").to_pylist()), np.uint16).reshape(-1, MINIMA)[order]
        bands = np.array(table.column("bands").to_pylist(), np.int64)[order]
        first, least = least_matches()[0]
        found = []
        for x in range(len(key)):
            if block[x] not in (low, high):
                continue
            y = np.arange(x + 1, len(key))
            apart = (label[y] != label[x]) & ((np.minimum(n[y], n[x]) * DOWN) >= np.maximum(n[y], n[x]) * UP)
            y = y[apart & (np.minimum(block[y], block[x]) == low) & (np.maximum(block[y], block[x]) == high)]
            y = y[(minima[y, :first] == minima[x, :first]).sum(axis=1) >= least]
            if len(y):
                y = y[(bands[y] == bands[x])[np.arange(len(y)), (bands[y] == bands[x]).argmax(axis=1)]]
                y = y[bands[x][(bands[y] == bands[x]).argmax(axis=1)] == bucket]
                y = y[plausible(np.broadcast_to(minima[x], (len(y), MINIMA)), minima[y])]
                found.append(np.stack([np.full(len(y), key[x]), key[y]]))
        both = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        give_back()
        return pa.table({"a": both[0], "b": both[1]})

    crowded = rows.filter(F.col("size") > CROWD).withColumn("blocks", F.ceil(F.col("size") / BLOCK_NODES)).withColumn("block", F.expr("pmod(xxhash64(key), blocks)"))
    pairs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = crowded.select("bucket", "key", "n", "label", "block", pairs.alias("other")).join(reps.select("key", "minima", "bands"), "key")
    met = met.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "key", "n", "label", "block", "minima", "bands")
    return written(met.groupBy("bucket", "low", "high").applyInArrow(compare, "a long, b long").distinct(), "compared")


def surviving(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs that sequential verification of their signatures leaves."""
    side = lambda c: reps.select(F.col("key").alias(c), F.col("minima").alias(f"minima_{c}"))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, y = (np.frombuffer(b"".join(batch.column(f"minima_{c}").to_pylist()), np.uint16).reshape(-1, MINIMA) for c in "ab")
            return batch.select(["a", "b"]).take(pa.array(plausible(x, y)))

        return work

    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    return written(map_batches(rows.select("a", "b", "minima_a", "minima_b"), "a long, b long", make), "plausible")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return DOWN * shared >= UP * (len(x) + len(y) - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach the threshold; sets: (key, hashes), sizes: (key, n).

    The side of a pair that is in more pairs is its pivot; a pivot's set is sent once for each SHARD hashes of the others.
    """
    ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).groupBy("key").agg(F.count("*").alias("c"))
    named = lambda c: ends.select(F.col("key").alias(c), F.col("c").alias(f"c_{c}"))
    turned = pairs.join(named("a"), "a").join(named("b"), "b")
    larger = F.col("c_a") >= F.col("c_b")
    turned = turned.select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("pivot"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("key"))
    turned = written(turned.join(sizes.select("key", "n"), "key"), "turned")
    shards = turned.groupBy("pivot").agg((F.floor(F.sum("n") / SHARD) + 1).alias("shards"))
    dealt = turned.join(shards, "pivot").select("pivot", "key", F.expr("pmod(xxhash64(key), shards)").alias("shard"))
    others = dealt.join(sets, "key")
    own = sets.select(F.col("key").alias("own"), F.col("hashes").alias("own_hashes"))
    pivots = dealt.select(F.col("pivot").alias("own"), F.col("shard").alias("own_shard")).distinct().join(own, "own")

    def check(pivot: pa.Table, others: pa.Table) -> pa.Table:
        found = []
        if pivot.num_rows and others.num_rows:
            x = np.frombuffer(pivot.column("own_hashes")[0].as_buffer(), U)
            keys = others.column("key").to_pylist()
            found = [k for k, y in zip(keys, others.column("hashes"), strict=True) if linked(x, np.frombuffer(y.as_buffer(), U))]
        name = pivot.column("own")[0].as_py() if found else 0
        give_back()
        return pa.table({"a": pa.array([name] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    links = pivots.groupBy("own", "own_shard").cogroup(others.groupBy("pivot", "shard")).applyInArrow(check, "a long, b long")
    links = written(links, "links")
    forget(turned)
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text); kept: the id is its class's."""
    docs = spread(docs.select("doc_id", "text"))
    nodes = written(signed(docs), "nodes")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h1", "h2", "n")).alias("best")
    reps = nodes.filter("key is not null").groupBy("key").agg(first, F.first("minima", True).alias("minima"), F.first("bands", True).alias("bands"))
    reps = written(reps.select("key", F.col("best.doc_id").alias("rep"), "best.h1", "best.h2", "best.n", "minima", "bands"), "reps")
    banded = reps.select("key", "n", F.explode("bands").alias("bucket"))
    full = banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = written(banded.join(full, "bucket").select("bucket", "key", "n", "size"), "shared")
    tried = written(pivot_pairs(shared), "tried")
    near = surviving(tried, reps)
    sets = sets_of_keys(docs, reps, keys_in(near))
    links = confirmed(near, sets, reps)
    classes = components(links)
    forget(near)
    rows = open_buckets(shared, classes)
    left, compared = listed_pairs(rows, tried), compared_pairs(rows, reps)
    forget(shared, rows)
    few = surviving(left, reps)
    near = written(few.unionByName(compared.join(tried, ["a", "b"], "left_anti")).distinct(), "near")
    forget(left, few, compared, tried)
    more = sets_of_keys(docs, reps, keys_in(near).join(sets.select("key"), "key", "left_anti"), few=True)
    rest = confirmed(near, sets.unionByName(more), reps)
    forget(near, sets, more)
    if not rest.isEmpty():
        before, classes = classes, components(links.unionByName(rest))
        forget(before)
    named = reps.select("key", "rep").join(classes.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = written(named.join(smallest, "label").select("key", "component_id"), "named")
    forget(links, rest, reps, classes)
    own = nodes.filter("key is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    found = nodes.filter("key is not null").select("doc_id", "key", "n").join(named, "key").select("doc_id", "n", "component_id").unionByName(own)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
