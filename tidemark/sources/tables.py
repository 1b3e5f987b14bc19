"""Reading and writing tables: fixed schemas, year-split files, gzip CSV, sorted yearly sinks, manifests."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.scratch import delete, exists, forget, path_and_system, rename, shared_path, written


def read_table(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table; with a schema, no file is opened to infer one."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def read_years(spark: SparkSession, folder: str, name: str, first: int, last: int, schema: T.StructType | None = None) -> DataFrame:
    """Files <name>_<year>.parquet as one table; only the files of the asked years are listed and read."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*(f"{folder}/{name}_{y}.parquet" for y in range(first, last + 1)))


#: What the file of rows without a date is named for.
UNDATED = "undated"


def read_where(spark: SparkSession, folder: str, name: str, date_col: str, predicate: Column, schema: T.StructType | None = None) -> DataFrame:
    """The rows of the files <name>_<year>.parquet for which predicate, a condition on the date column alone, is true.

    Which years it may hold in is found by evaluating it on every day of the years that there are files of, and on no
    date for the file of undated rows: ranges, lists, months, or-ed conditions and calls of functions all lead to exactly
    the files that have such a day. Only those are read, by the Parquet reader, with the predicate and the columns pushed
    down. Days are 366 a year at most, whatever the size of the data. The column has to be a date: a time within a day
    would not be seen.
    """
    there, system = path_and_system(spark, f"{folder}/{name}_*.parquet")
    labels = {m[1] for status in system.globStatus(there) if (m := re.fullmatch(rf"{re.escape(name)}_(\d+|{UNDATED})\.parquet", status.getPath().getName()))}
    if not labels:
        raise FileNotFoundError(f"{folder}/{name}_<year>.parquet")
    reader = spark.read.schema(schema) if schema else spark.read
    of = lambda chosen: reader.parquet(*(f"{folder}/{name}_{y}.parquet" for y in chosen))
    kind = (schema or of(sorted(labels)[:1]).schema)[date_col].dataType
    if not isinstance(kind, T.DateType):
        raise TypeError(f"{date_col} is no date but {kind.simpleString()}")
    years = spark.createDataFrame([(y, int(y) if y != UNDATED else None) for y in sorted(labels)], "label string, year int")
    days = years.select("label", F.explode(F.sequence(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)))).alias(date_col))
    days = days.unionByName(years.filter("year is null").select("label", F.lit(None).cast("date").alias(date_col)))
    asked = sorted(r["label"] for r in days.filter(predicate).select("label").distinct().collect())
    # a predicate that no day fulfils reads one file's footer and no rows
    return of(asked).filter(predicate) if asked else of(sorted(labels)[:1]).filter(F.lit(False))


def read_csv_gz(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A headed UTF-8 CSV with ISO dates, gzipped or not. One gzip file is one task: repartition after it if large."""
    return spark.read.csv(path, schema=schema, header=True, dateFormat="yyyy-MM-dd", encoding="UTF-8", enforceSchema=False)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The same content as Parquet or as headed CSV."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format {fmt!r}")
    writer = df.write.mode("error")
    writer.parquet(path) if fmt == "parquet" else writer.csv(path, header=True, dateFormat="yyyy-MM-dd")


def write_by_year(df: DataFrame, path: str, date_col: str, sort: Iterable[str], files_per_year: int = 1) -> None:
    """One folder a year with files_per_year files, each sorted; rows without a date go to a folder of their own.

    A year's rows are dealt over its files by a hash of the sort columns, each file by a task of its own, so neither a large
    year nor a code that holds much of it is one task. Years are few whatever the size of the data.
    """
    sort = list(sort)
    dated = df.withColumn("year", F.year(date_col))
    first, last = dated.agg(F.min("year"), F.max("year")).first()
    if first is None:
        first = last = 0
    # place 0 is that of rows without a date
    place = F.coalesce(F.col("year") - first + 1, F.lit(0)) * files_per_year + F.pmod(F.xxhash64(*sort), F.lit(files_per_year))
    dealt = dated.repartitionById((last - first + 2) * files_per_year, place.cast("int"))
    dealt.sortWithinPartitions("year", *sort).write.mode("error").partitionBy("year").parquet(path)


#: Rows written to learn how many bytes one takes, the share of a file's bound that a file is meant to fill, and the rows that
#: one task sorts at most.
SAMPLE_ROWS, FILL, TASK_ROWS = 200_000, 0.8, 1 << 21


def bytes_of_row(df: DataFrame, rows: int, sort: list[str]) -> float:
    """Bytes that a row takes in a file written as df's are, measured on a sorted sample in the shared folder that is deleted again."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "sample")
    some = df.sample(min(1.0, SAMPLE_ROWS / max(rows, 1)), seed=7).coalesce(1)
    some.sortWithinPartitions(*sort).write.parquet(path)
    there, system = path_and_system(spark, path)
    size, count = system.getContentSummary(there).getLength(), spark.read.schema(df.schema).parquet(path).count()
    delete(spark, path)
    return size / count if count else 1.0


def write_sorted_years(df: DataFrame, path: str, date_col: str, sort: Iterable[str], most_bytes: int) -> None:
    """One folder a year, in each as few files of at most most_bytes as its rows need, which follow each other in `sort`.

    Rows are dealt by ranges of (year, sort) whose bounds Spark samples, so the files of a year hold disjoint ranges and
    their footers let readers skip them; a code that holds much of a year is cut by what follows in `sort`. How many
    ranges there are follows from measured bytes, not from the years: a stray date costs one file. No file has more than
    TASK_ROWS rows, as one task sorts it. Files that came out larger than the bound are cut again (see _cut_large). Rows
    without a date go to a folder of their own.
    """
    sort = list(sort)
    dated = df.withColumn("year", F.year(date_col))
    rows = dated.count()
    each = bytes_of_row(df, rows, sort)
    most_rows = max(1, min(TASK_ROWS, int(FILL * most_bytes / each)))
    dealt = dated.repartitionByRange(max(1, -(-rows // most_rows)), "year", *sort)
    dealt.sortWithinPartitions("year", *sort).write.mode("error").option("maxRecordsPerFile", most_rows).partitionBy("year").parquet(path)
    while _cut_large(df.sparkSession, path, dated.schema, most_bytes):
        pass


def _cut_large(spark: SparkSession, path: str, schema: T.StructType, most_bytes: int) -> bool:
    """Cut the files that are larger than most_bytes, each into stretches of its rows as they lie; whether there were any.

    A file of one row stays as it is. Only the rows of such files are read and written again.
    """
    there, system = path_and_system(spark, f"{path}/year=*/*.parquet")
    large = {s.getPath().toString(): s.getLen() for s in system.globStatus(there) if s.getLen() > most_bytes}
    if not large:
        return False
    rows = spark.read.schema(schema).option("basePath", path).parquet(*sorted(large))
    # a file of a year is named once in its folder, and its name is unique below `path` by the number of its task
    rows = rows.select("*", F.regexp_extract("_metadata.file_path", "[^/]+/[^/]+$", 0).alias("_file"), F.col("_metadata.row_index").alias("_at"))
    counts = {r["_file"]: r["n"] for r in rows.groupBy("_file").agg(F.count("*").alias("n")).collect()}
    of = {p: "/".join(p.split("/")[-2:]) for p in large}
    large = {p: size for p, size in large.items() if counts[of[p]] > 1}
    if not large:
        return False
    cuts, pieces = [], 0
    for p, size in sorted(large.items()):
        n = counts[of[p]]
        each = max(1, min(int(n * FILL * most_bytes / size), -(-n // 2)))
        cuts.append((of[p], each, pieces))
        pieces += -(-n // each)
    places = spark.createDataFrame(cuts, "_file string, _each long, _first long")
    placed = rows.join(F.broadcast(places), "_file").withColumn("_place", (F.col("_first") + F.floor(F.col("_at") / F.col("_each"))).cast("int"))
    dealt = placed.repartitionById(pieces, F.col("_place")).sortWithinPartitions("year", "_place", "_at")
    dealt.select(*schema.names).write.mode("append").partitionBy("year").parquet(path)
    for p in large:
        delete(spark, p)
    return True


def write_years(df: DataFrame, folder: str, name: str, date_col: str, sort: Iterable[str], most_bytes: int) -> None:
    """<name>_<year>.parquet for each year, and <name>_undated.parquet if rows have no date, as write_sorted_years writes them.

    Rows are written once; a year is as many files, and so tasks, as it has bytes. There is no column for the year.
    """
    spark, split = df.sparkSession, f"{folder}/{name}-split"
    write_sorted_years(df, split, date_col, sort, most_bytes)
    there, system = path_and_system(spark, f"{split}/year=*")
    for status in system.globStatus(there):
        year = status.getPath().getName().partition("=")[2]
        rename(spark, status.getPath().toString(), f"{folder}/{name}_{int(year) if year.isdigit() else UNDATED}.parquet")
    delete(spark, split)


def drop_cols(df: DataFrame, *names: str) -> DataFrame:
    """Columns that are not published."""
    return df.drop(*names)


#: Bytes read at once while a file is hashed, and the schemes whose files are hashed so.
CHUNK, STREAMED = 8 << 20, ("file", "hdfs")


def sha256_of(path: str) -> str:
    """SHA-256 of a file, read in chunks: memory does not follow its size. path is as Spark names it: file:/... or hdfs://..."""
    digest = hashlib.sha256()
    local = path.partition(":")[2] if path.startswith("file:") else None
    if local is not None:
        stream = open("/" + local.lstrip("/"), "rb")  # noqa: SIM115
    else:
        system, name = pa_fs.FileSystem.from_uri(path)
        stream = system.open_input_stream(name)
    with stream:
        while chunk := stream.read(CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def _digests(batches):
    for batch in batches:
        paths = batch.column("path")
        yield pa.RecordBatch.from_arrays([paths, batch.column("size"), pa.array([sha256_of(p) for p in paths.to_pylist()], pa.string())], ["path", "size", "sha256"])


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, sha256) of every file below a folder, hashed on the executors; paths are relative to the folder.

    A file is read by one task, in chunks, since SHA-256 goes from its first byte to its last; tasks are files of about
    equal bytes together. Only on file systems that are not in STREAMED a file becomes one value, of less than 2 GB.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    named = files.select("path", F.col("length").alias("size"))
    if folder.partition(":")[0] in STREAMED:
        hashed = named.mapInArrow(_digests, "path string, size long, sha256 string")
    else:
        hashed = named.withColumn("sha256", F.sha2(files["content"], 256))
    hashed = hashed.withColumn("path", F.substring("path", len(folder) + 2, 1 << 30))
    # Spark lists files without bytes but never reads them
    within = [(re.sub("^file:/+", "file:/", unquote(p))[len(folder) + 1 :],) for p in files.inputFiles()]
    empty = spark.createDataFrame(within, "path string").join(named.select(F.substring("path", len(folder) + 2, 1 << 30).alias("path")), "path", "left_anti")
    return hashed.unionByName(empty.select("path", F.lit(0).cast("long").alias("size"), F.lit(hashlib.sha256().hexdigest()).alias("sha256")))


def verify_manifest(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """(path, state): listed files that are ok, missing or changed, and files that no entry lists.

    manifest, digests: (path, size, sha256) with paths relative to the same folder, compared whole.
    """
    a, b = manifest.select("path", "size", "sha256"), digests.select("path", F.col("size").alias("s"), F.col("sha256").alias("h"))
    state = F.when(F.col("s").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when((F.col("size") == F.col("s")) & (F.col("sha256") == F.col("h")), "ok").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def refresh_days(target: str, source: DataFrame, day: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Bring the table at `target`, one folder a day, up to date with `source`; gives the days it has written: (day).

    build makes the table's rows of some days from the source's rows of those days, and keeps the column `day`. Beside the
    table lies the count and digest of each day's source rows as they were when it was written. Only days that differ are
    built again, and only their folders are overwritten; days that are gone from the source, or of which build makes
    nothing, lose theirs. So late rows change their own days, a second run with the same source writes nothing, and a run
    that ended between the table and its digests is repeated. Days are as many as the calendar has. Rows without a day
    are left out.
    """
    spark = source.sparkSession
    rows = source.filter(F.col(day).isNotNull())
    hashed = F.xxhash64(*(F.col(c) for c in sorted(source.columns)))
    now = rows.groupBy(day).agg(F.count("*").alias("n"), F.sum(hashed.cast("decimal(20,0)")).alias("digest"))
    now = written(now, "digests")
    table, seen = f"{target}/table", f"{target}/digests"
    if exists(spark, seen):
        before = spark.read.schema(now.schema).parquet(seen)
        kept = [F.col(f"now.{c}").eqNullSafe(F.col(f"before.{c}")) for c in now.columns]
        changed = now.alias("now").join(before.alias("before"), kept[0], "full_outer").filter(~(kept[1] & kept[2]) | F.col("now.n").isNull() | F.col("before.n").isNull())
        changed = changed.select(F.coalesce(F.col(f"now.{day}"), F.col(f"before.{day}")).alias(day))
    else:
        changed = now.select(day)
    changed = written(changed, "changed")
    built = build(rows.join(changed, day, "left_semi"))
    built.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(table)
    # what is built no more: few days, named by their folders
    made = spark.read.schema(built.schema).parquet(table).select(day).distinct() if exists(spark, table) else changed.limit(0)
    for r in made.join(changed, day, "left_semi").join(built.select(day).distinct(), day, "left_anti").collect():
        delete(spark, f"{table}/{day}={r[day]}")
    replaced = f"{target}/digests-next"
    now.write.mode("overwrite").parquet(replaced)
    delete(spark, seen)
    rename(spark, replaced, seen)
    forget(now)
    return changed
