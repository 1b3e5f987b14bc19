"""Exact top-k search of binary codes by incremental multi-index hashing.

A code of at most 64 bits is cut into m segments of about log2(rows) bits. A code within distance m * r + a of a query
agrees with it up to r bits in one of the first a + 1 segments or up to r - 1 bits in one of the others, so once every
segment has been searched that far, each code within that distance has been seen and verified. Radii grow by one a
round. The k-th verified distance bounds what a query still has to look for: segments that need no larger radius are
left out, codes beyond it are dropped where they are met, and a query whose k-th distance is covered is done.

A probe of a bucket is no row. The index is cut into cells, by the upper bits of a segment's value, of about CELL codes
and stored packed. A query goes, for each segment, to the cells whose upper bits differ from its own by no more than
the radius; there the rest of the radius is spent on the lower bits, by lookups in a table of the cell. Cells with more
than BLOCK codes, such as those of a value that a third of all rows have, are cut into blocks and their queries into
slices, each block and slice a task's group of its own.

Equal codes are one entry of the index, of which only the smallest ids can be results, and queries with equal codes
share their search, so repeated vectors make no large group.

Codes are the signs of vectors: bit i is set where element i is positive; null and missing elements are not positive. Null
vectors have no code: they ask nothing and are never found. Repeated (id, vector) rows count once. Ties in distance go
to the smaller id. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import forget, give_back, written

#: Least and most bits of a segment, codes of a cell, most upper bits that name cells, codes of a block.
LEAST, MOST = 8, 32
CELL, MOST_UPPER = 4096, 16
BLOCK = 1 << 18
FIRST_RADIUS = 1
#: Lookups and candidates that a task has in hand at once.
AT_ONCE = 1 << 19

U = np.uint64


def sign_code(vector: Column, dims: int) -> Column:
    """The signs of a vector as a 64-bit code."""
    if dims > 64:
        raise ValueError("codes have at most 64 bits")
    bit = lambda code, i: code.bitwiseOR(F.when(F.get(vector, i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.when(vector.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.lit(dims - 1)), F.lit(0).cast("long"), bit))


@dataclass(frozen=True)
class Segment:
    """Bits [start, start + width) of a code; the upper bits of the value name a cell, the lower ones a bucket in it."""

    number: int
    start: int
    width: int
    upper: int

    @property
    def lower(self) -> int:
        return self.width - self.upper

    def cell(self, code: Column) -> Column:
        return F.shiftrightunsigned(code, self.start + self.lower).bitwiseAND(F.lit((1 << self.upper) - 1).cast("long")) if self.upper else F.lit(0).cast("long")

    def buckets(self, codes: np.ndarray) -> np.ndarray:
        return (codes.view(U) >> U(self.start) & U((1 << self.lower) - 1)).astype(np.int64)


def segments(rows: int, dims: int) -> list[Segment]:
    """Segments of about log2(rows) bits that together are the code, their widths as equal as can be."""
    m = ceil(dims / min(max(round(log2(max(rows, 2))), LEAST), MOST))
    upper = min(max(round(log2(max(rows, 1) / CELL)), 0), MOST_UPPER)
    widths = [dims // m + (k < dims % m) for k in range(m)]
    return [Segment(k, sum(widths[:k]), w, min(upper, w - 1)) for k, w in enumerate(widths)]


def masks(bits: int, flips: int) -> list[int]:
    """All values of so many bits with this many set."""
    return [sum(1 << b for b in own) for own in combinations(range(bits), flips)]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


CELL_KEY = ["segment", "cell", "block", "slice"]


def packed_index(codes: DataFrame, parts: list[Segment]) -> DataFrame:
    """(segment, cell, block, blocks, codes, ids, copies): the index, a row for each block of a cell; codes: (code, id, copies)."""
    rows = reduce(DataFrame.unionByName, (codes.withColumns({"segment": F.lit(p.number), "cell": p.cell(F.col("code"))}) for p in parts))
    blocks = rows.groupBy("segment", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(blocks, ["segment", "cell"]).withColumn("block", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        part = parts[table.column("segment")[0].as_py()]
        code = table.column("code").to_numpy()
        order = np.argsort(part.buckets(code), kind="stable")
        blobs = {c: pa.array([np.ascontiguousarray(table.column(c).to_numpy()[order]).tobytes()], pa.binary()) for c in ("code", "id", "copies")}
        return pa.table({c: table.column(c)[:1] for c in ("segment", "cell", "block", "blocks")} | {"codes": blobs["code"], "ids": blobs["id"], "copies": blobs["copies"]})

    return written(rows.groupBy("segment", "cell", "block").applyInArrow(pack, "segment int, cell long, block int, blocks int, codes binary, ids binary, copies binary"), "index")


def looked_up(part: Segment, index: tuple[np.ndarray, np.ndarray, np.ndarray], query: np.ndarray, far: np.ndarray, flips: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """(query, distance, id, code, copies) of what the probes of a block find within far (-1: any): most for each query at most."""
    codes, ids, copies = index
    starts = np.searchsorted(part.buckets(codes), np.arange((1 << part.lower) + 1))
    own = part.buckets(query)
    found: list[tuple[np.ndarray, ...]] = []

    def best(rows: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
        q, dist, at = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((ids[at], dist, q))
        q, dist, at = q[order], dist[order], at[order]
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (at[1:] != at[:-1])]) if len(q) else np.empty(0, bool)
        q, dist, at = q[new], dist[new], at[new]
        heads = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
        place = np.arange(len(q)) - np.repeat(heads, np.diff(np.append(heads, len(q))))
        keep = place < most
        return [(q[keep], dist[keep], at[keep])]

    for n in np.unique(flips).tolist():
        look = np.array(masks(part.lower, n), np.int64)
        rows = np.flatnonzero(flips == n)
        step = max(1, AT_ONCE // max(1, len(look)))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            values = (own[some][:, None] ^ look[None, :]).ravel()
            begin, count = starts[values], starts[values + 1] - starts[values]
            asked = np.repeat(some, len(look))
            asked, begin, count = asked[count > 0], begin[count > 0], count[count > 0]
            ends = np.cumsum(count)
            cuts = [0, *np.flatnonzero(np.diff(ends // AT_ONCE, prepend=0)).tolist(), len(count)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                c = count[a:b]
                place = np.repeat(begin[a:b] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(int(c.sum()))
                who = np.repeat(asked[a:b], c)
                dist = np.bitwise_count(query[who].view(U) ^ codes[place].view(U)).astype(np.int32)
                near = (far[who] < 0) | (dist <= far[who])
                found.append((query[who[near]], dist[near], place[near]))
                if sum(len(x[0]) for x in found) > AT_ONCE:
                    found = best(found)
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    q, dist, at = best(found)[0]
    return q, dist, ids[at], codes[at], copies[at]


FOUND = "query long, distance int, id long, code long, copies long"


def round_of(open_: DataFrame, index: DataFrame, parts: list[Segment], radii: list[int], most: int) -> DataFrame:
    """What the open queries (query, far) find in one round of these radii: FOUND rows."""
    m = len(parts)
    # segment, flips of lower bits and mask of upper bits of every cell to go to: as one string constant, for thousands of
    # literals would weigh on every plan that the driver keeps. MOST_UPPER bounds it, whatever the number of rows.
    look = [(p.number, r, r - up, x) for p in parts for r in radii for up in range(max(0, r - p.lower), min(r, p.upper) + 1) for x in masks(p.upper, up)]
    if not look:
        return open_.sparkSession.createDataFrame([], FOUND)
    step = F.split(F.col("look"), ":")
    asked = open_.withColumn("look", F.explode(F.split(F.lit(",".join(":".join(map(str, x)) for x in look)), ",")))
    asked = asked.select("query", "far", *(step[k].cast("int").alias(c) for k, c in enumerate(("segment", "radius", "flips"))), step[3].cast("long").alias("mask"))
    asked = asked.filter(F.col("far").isNull() | (F.col("radius") <= F.floor((F.col("far") - F.col("segment")) / m)))
    own = F.element_at(F.array(*(p.cell(F.col("query")) for p in parts)), F.col("segment") + 1)
    probes = asked.select("query", "far", "segment", "flips", own.bitwiseXOR(F.col("mask")).alias("cell"))
    cells = index.groupBy("segment", "cell").agg(F.max("blocks").alias("blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    probes = probes.join(cells, ["segment", "cell"]).withColumn("slice", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).withColumn("block", every(F.col("blocks"))).drop("blocks")
    blocks = index.withColumn("slice", every(F.col("blocks"))).drop("blocks")

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in FOUND.split(", ")]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        found: tuple[np.ndarray, ...] = tuple(np.empty(0, np.int64) for _ in names)
        if left.num_rows and right.num_rows:
            table = tuple(np.frombuffer(right.column(c)[0].as_buffer(), np.int64) for c in ("codes", "ids", "copies"))
            far = left.column("far").fill_null(-1).to_numpy()
            found = looked_up(parts[right.column("segment")[0].as_py()], table, left.column("query").to_numpy(), far, left.column("flips").to_numpy(), most)
        result = pa.table({n: pa.array(x, t) for n, x, t in zip(names, found, kinds, strict=True)})
        give_back()
        return result

    return probes.groupBy(*CELL_KEY).cogroup(blocks.groupBy(*CELL_KEY)).applyInArrow(look, FOUND)


def top_k(index: DataFrame, queries: DataFrame, k: int, dims: int = 64) -> DataFrame:
    """(query_id, id, distance, place): the k nearest of index (id, code) to each of queries (id, code), but itself."""
    spark = index.sparkSession
    rows = written(index.filter(F.col("code").isNotNull()).select("id", "code").distinct(), "codes")
    asked = written(queries.filter(F.col("code").isNotNull()).select("id", "code").distinct(), "queries")
    first = Window.partitionBy("code").orderBy("id")
    members = written(rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1).select("id", "code"), "members")
    n_rows = rows.count()
    codes = members.groupBy("code").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    parts = segments(codes.count(), dims)
    table = packed_index(codes, parts)
    m, want = len(parts), min(k + 1, n_rows)  # the query itself is among the rows
    open_ = asked.select(F.col("code").alias("query")).distinct().withColumn("far", F.lit(None).cast("int"))
    found = spark.createDataFrame([], FOUND)
    done, rounds = [], []
    widest = max(p.width for p in parts)
    nearest_first = Window.partitionBy("query").orderBy("distance", "id")
    nearer = Window.partitionBy("query").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
    radius = FIRST_RADIUS
    while n_rows:
        near = round_of(open_, table, parts, list(range(radius + 1)) if radius == FIRST_RADIUS else [radius], want)
        best = near.unionByName(found).dropDuplicates(["query", "code"]).withColumn("place", F.row_number().over(nearest_first)).filter(F.col("place") <= want).drop("place")
        # copies of a code are rows too: as many distances as it takes for the rows wanted, ties whole
        best = best.withColumn("nearer", F.coalesce(F.sum("copies").over(nearer), F.lit(0))).filter(F.col("nearer") < want).drop("nearer")
        state = best.groupBy("query").agg(F.sum("copies").alias("n"), F.max("distance").alias("far"))
        covered = F.col("far") <= m * (radius + 1) - 1
        state = state.withColumn("far", F.when(F.col("n") >= want, F.col("far"))).withColumn("done", (F.col("n") >= want) & (covered | (F.col("n") >= n_rows)) | F.lit(radius >= widest)).drop("n")
        state = open_.select("query").join(state, "query", "left").withColumn("done", F.coalesce("done", F.lit(radius >= widest)))
        best = written(state.join(best, "query", "left"), f"radius{radius}")
        rounds.append(best)
        done.append(best.filter("done and id is not null").drop("done", "far"))
        found = best.filter("not done and id is not null").drop("done", "far")
        open_ = best.filter("not done").select("query", "far").distinct()
        if open_.isEmpty():
            break
        radius += 1
    result = reduce(DataFrame.unionByName, done, found)
    result = result.select("query", "distance", "code").join(members, "code").drop("code")
    result = asked.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(result, "query")
    result = result.filter(~((F.col("query_id") == F.col("id")) & (F.col("distance") == 0)))
    order = Window.partitionBy("query_id", "query").orderBy("distance", "id")
    result = result.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("query_id", "id", "distance", "place")
    result = written(result, "nearest")
    forget(rows, asked, members, table, *rounds)
    return result


def nearest(df: DataFrame, k: int = 10, every: int = 50, id_column: str = "vec_id", vector_column: str = "embedding", dims: int = 64) -> DataFrame:
    """The k nearest rows of every row whose id is divisible by `every`, against all rows."""
    codes = df.select(F.col(id_column).alias("id"), sign_code(F.col(vector_column), dims).alias("code"))
    return top_k(codes, codes.filter(F.col("id") % every == 0), k, dims)
