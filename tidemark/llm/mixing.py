"""Mixing sources to target weights with DataFrame operations only.

Each source gets a target in words. Complete epochs over a source come first; the rest of its target is an
Efraimidis-Spirakis sample: every document draws an exponential key divided by its quality weight, documents are taken
in the order of their keys and a prefix sum of their sizes meets the budget.

The prefix sum has three levels, so that no source has to fit into one task: keys fall into BUCKETS ranges, FINE of them
make a coarse one, sizes are summed per source and range, and only the range in which the budget ends is sorted document
by document.

Nulls: a null text has size 0, a null source is a source of its own (the last), a null id draws its key from its size
alone. Sources of size 0 have target 0. Ties in the key are ordered by id and size; rows equal in those are alike.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import WORD, named, written

#: Fixed values of the mix: weights by the sources' order, share of all words, most repeats of a source.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
BUCKETS = 4096
FINE = 64
#: A plan of no more sources than this is broadcast to the documents; a larger one is joined by shuffle.
BROADCAST_SOURCES = 50_000

#: Characters that clean prose does not have; a document's quality weight falls with their share.
NOISE = "#$%&*|<>{}[]=!0123456789"


def sizes(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """1 for clean prose down to 1/8; never 0, so that every document can be drawn."""
    length = F.length(text)
    clean = F.length(F.translate(text, NOISE, ""))
    return F.when(length > 0, F.greatest(F.lit(0.125), 1.0 - 4.0 * (length - clean) / length)).otherwise(F.lit(0.125))


def uniform(doc_id: Column, size: Column) -> Column:
    """In (0, 1), from an MD5 of id and size: reruns and other engines agree."""
    digest = F.md5(F.concat_ws(":", doc_id.cast("string"), size.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) with the target of each: shares by weight, capped, the excess reshared by weight.

    The fixed point of capping and resharing is found in closed form: in the order of cap / weight the capped sources
    come first, and the level of the others is what is left over their weights. One row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    choose = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    df = per_source.withColumn("weight", choose.cast("long")).withColumn("cap", F.col("source_size") * repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    df = df.withColumns({
        "cap_before": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weight_from": F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "budget": F.sum("source_size").over(every) * share,
    })
    df = df.withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("weight_from"))
    # the first source in this order that stays under its cap sets the level of all that follow
    df = df.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(every)["level"])
    target = F.when(F.col("level").isNull() | (F.col("level") >= F.col("ratio")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return df.select("source", "source_size", target.alias("target"))


def drawn(df: DataFrame) -> DataFrame:
    """(keep..., source, size, key, bucket): what the sampling needs of each document; bucket grows with key."""
    key = -F.log(F.col("u")) / F.col("quality")
    return df.withColumn("key", key).withColumn("bucket", F.floor((1.0 - F.exp(-F.col("key"))) * BUCKETS).cast("int")).drop("u", "quality")


def _edge(plan: DataFrame, sums: DataFrame) -> DataFrame:
    """plan (source, ..., from) with the range of keys in which the rest of each source's budget ends, and from: what is before it.

    Ranges are those of the source, or of what plan has in `within`; no more than BUCKETS / FINE or FINE rows a source.
    """
    inner = ["within"] if "within" in plan.columns else []
    sums = sums.groupBy(F.col("source").alias("s"), *(F.col(c).alias(f"{c}_s") for c in inner), "range").agg(F.sum("in_bucket").alias("in_range"))
    on = F.col("source").eqNullSafe(F.col("s"))
    for c in inner:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_s"))
    rows = plan.join(sums, on, "left").drop("s", *(f"{c}_s" for c in inner))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("from") + F.coalesce(F.sum("in_range").over(upto), F.lit(0)))
    best = F.max(F.when(F.col("before") <= F.col("rest"), F.struct("before", "range"))).alias("best")
    kept = ["source", "source_size", "target", "epochs", "rest"]
    return rows.groupBy(*kept).agg(best).select(*kept, F.col("best.range").alias("range"), F.col("best.before").alias("from"))


def take(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs (doc_id, source, size, key, bucket) with source_size, target, taken.

    plan has one row a source, docs has any number. The plan with the ranges in which budgets end is a table, whose rows are
    counted: up to BROADCAST_SOURCES it goes to the documents, which then are not dealt out by source; a larger one is joined
    by shuffle, in which adaptive execution splits hot sources.
    """
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    sums = docs.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    edge = _edge(plan.withColumn("from", F.lit(0).cast("long")), sums.withColumn("range", F.floor(F.col("bucket") / FINE)))
    edge = _edge(edge.withColumnRenamed("range", "within"), sums.withColumn("range", F.col("bucket").cast("long")).withColumn("within", F.floor(F.col("bucket") / FINE)))
    edge = edge.select(F.col("source").alias("s"), "source_size", "target", "epochs", "rest", F.col("range").alias("edge_bucket"), F.col("from").alias("edge_before"))
    edge = written(edge, "edge")
    edge = F.broadcast(edge) if edge.count() <= BROADCAST_SOURCES else edge
    rows = docs.join(edge, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # buckets below the edge are whole, those above are out, the edge itself is ordered
    clear = rows.filter(F.col("bucket") != F.col("edge_bucket")).withColumn("extra", (F.col("bucket") < F.col("edge_bucket")).cast("long"))
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    fine = rows.filter(F.col("bucket") == F.col("edge_bucket")).withColumn("so_far", F.col("edge_before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    fine = fine.withColumn("extra", (F.col("so_far") + F.col("size") / 2 <= F.col("rest")).cast("long")).drop("so_far")
    both = clear.unionByName(fine)
    return both.withColumn("repeats", F.col("epochs") + F.col("extra")).withColumn("taken", F.col("size") * F.col("repeats"))


def narrow(df: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """(doc_id, source, size, key, bucket): all that the mix needs of the documents, read from the text once."""
    text = F.col(text_column)
    docs = df.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), sizes(text).alias("size"), quality(text).alias("quality"))
    return drawn(written(docs.withColumn("u", uniform(F.col("doc_id"), F.col("size"))), "mix"))


def mix(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, repeats), a row for every row of df."""
    docs = narrow(df, id_column, text_column, source_column)
    plan = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    return take(docs, plan).select("doc_id", "source", "size", "source_size", "target", "taken", "repeats")


def mixture(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The rows of the mix themselves: every row of df as often as the mix takes it, with the columns of df.

    The mix of a source is its epochs and the last document drawn beyond them, so the texts need no shuffle: each row
    compares its own key with that of its source. Rows that repeat the last one drawn are taken with it.
    """
    docs = narrow(df, id_column, text_column, source_column)
    plan = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    place = lambda d: F.struct(F.col("key"), d.isNull().alias("no_id"), d.alias("id"), F.col("size"))
    last = F.max(F.when(F.col("extra") == 1, place(F.col("doc_id")))).alias("last")
    per_source = written(take(docs, plan).groupBy("source").agg(F.max("epochs").alias("epochs"), last).withColumnRenamed("source", "mix_source"), "plan")
    if per_source.count() <= BROADCAST_SOURCES:
        per_source = F.broadcast(per_source)
    text, source, doc_id = F.col(text_column), F.col(source_column), F.col(id_column)
    # the columns of df may have any names: those added here are longer than all of them
    size, u, key, own_source, copy = (f"{n}_{'_' * max(map(len, df.columns))}" for n in ("size", "u", "key", "source", "copy"))
    rows = df.withColumn(size, sizes(text)).withColumn(u, uniform(doc_id, F.col(size)))
    rows = rows.withColumn(key, -F.log(F.col(u)) / quality(text))
    per_source = per_source.select(F.col("mix_source").alias(own_source), F.struct("epochs", "last").alias(copy))
    rows = rows.join(per_source, source.eqNullSafe(F.col(own_source)))
    own = F.struct(F.col(key).alias("key"), doc_id.isNull().alias("no_id"), doc_id.alias("id"), F.col(size).alias("size"))
    extra = F.coalesce((own <= F.col(copy)["last"]).cast("int"), F.lit(0))
    rows = rows.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(copy)["epochs"].cast("int") + extra)))
    return rows.select(*(named(c) for c in df.columns))
