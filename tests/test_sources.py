import gzip
import hashlib
import subprocess
import sys
from datetime import date

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import scratch, tables

SCHEMA = T.StructType([T.StructField("code", T.StringType()), T.StructField("date", T.DateType()), T.StructField("v", T.DoubleType())])


@pytest.fixture
def frame(spark):
    return spark.createDataFrame([(f"c{i % 3}", date(2019 + i % 4, 1 + i % 12, 1), float(i)) for i in range(24)], SCHEMA)


def test_gzip_csv(spark, tmp_path):
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write("code,date,v\na,2024-01-31,1.5\nb,,\n")
    assert [tuple(r) for r in tables.read_csv_gz(spark, str(tmp_path / "x.csv.gz"), SCHEMA).orderBy("code").collect()] == [("a", date(2024, 1, 31), 1.5), ("b", None, None)]


def test_twins_have_the_same_content(spark, frame, tmp_path):
    tables.write_table(frame, str(tmp_path / "p"))
    tables.write_table(frame, str(tmp_path / "c"), "csv")
    a, b = spark.read.parquet(str(tmp_path / "p")), spark.read.csv(str(tmp_path / "c"), schema=SCHEMA, header=True)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    with pytest.raises(ValueError):
        tables.write_table(frame, str(tmp_path / "z"), "xml")


@pytest.mark.parametrize("files", [1, 3])
def test_yearly_sink_is_sorted_and_whole(spark, frame, tmp_path, files):
    tables.write_by_year(frame, str(tmp_path / "y"), "date", ["code", "date"], files)
    assert spark.read.parquet(str(tmp_path / "y")).count() == frame.count()
    years = [d for d in (tmp_path / "y").iterdir() if d.is_dir()]
    assert len(years) == 4 and all(1 <= len(list(d.glob("*.parquet"))) <= files for d in years)
    for file in (tmp_path / "y").rglob("*.parquet"):
        t = pq.ParquetFile(file).read().to_pylist()
        assert t == sorted(t, key=lambda r: (r["code"], r["date"]))


def test_year_files_are_one_table_and_only_asked_years_are_read(spark, tmp_path):
    for y in (2019, 2020, 2021):
        pq.write_table(pa.table({"code": ["a"], "y": [y]}), tmp_path / f"t_{y}.parquet")
    df = tables.read_years(spark, str(tmp_path), "t", 2019, 2020)
    assert sorted(r.y for r in df.collect()) == [2019, 2020] and len(df.inputFiles()) == 2


def test_a_date_predicate_reads_the_files_of_its_years(spark, tmp_path):
    rows = [(f"c{i % 5}", date(2018 + i % 5, 1 + i % 12, 1 + i % 28) if i % 11 else None, float(i)) for i in range(300)]
    tables.write_years(spark.createDataFrame([*rows, ("x", date(2020, 12, 31), 1e3), ("x", date(2021, 1, 1), 1e3)], SCHEMA), str(tmp_path), "t", "date", ["code", "date"], 1 << 20)
    rows += [("x", date(2020, 12, 31), 1e3), ("x", date(2021, 1, 1), 1e3)]
    assert sorted(p.name for p in tmp_path.iterdir()) == [*(f"t_{y}.parquet" for y in range(2018, 2023)), "t_undated.parquet"]
    d, day = F.col("date"), lambda *x: F.lit(date(*x))
    cases = [
        (d.between(day(2020, 12, 30), day(2021, 1, 2)), lambda x: x and date(2020, 12, 30) <= x <= date(2021, 1, 2), {"2020", "2021"}),
        (d >= day(2022, 1, 1), lambda x: x and x >= date(2022, 1, 1), {"2022"}),
        (d.isNull() | (F.year(d) == 2019), lambda x: x is None or x.year == 2019, {"2019", "undated"}),
        ((F.month(d) == 12) & ~d.isin(day(2018, 12, 12)) & (d < day(2020, 1, 1)), lambda x: x and x.month == 12 and x != date(2018, 12, 12) and x < date(2020, 1, 1), {"2018", "2019"}),
        (F.lit(True), lambda x: True, {"2018", "2019", "2020", "2021", "2022", "undated"}),
    ]
    for schema in (SCHEMA, None):
        for predicate, plain, years in cases:
            found = tables.read_where(spark, str(tmp_path), "t", "date", predicate, schema)
            assert sorted(map(tuple, found.collect()), key=repr) == sorted((r for r in rows if plain(r[1])), key=repr)
            assert {p.rsplit("t_", 1)[1].split(".")[0] for p in found.inputFiles()} == years
    assert tables.read_where(spark, str(tmp_path), "t", "date", d > day(2030, 1, 1), SCHEMA).count() == 0
    with pytest.raises(FileNotFoundError):
        tables.read_where(spark, str(tmp_path), "none", "date", F.lit(True))
    with pytest.raises(TypeError, match="no date"):
        tables.read_where(spark, str(tmp_path), "t", "v", F.lit(True), SCHEMA)


def test_a_file_beyond_two_gigabytes_is_hashed_in_little_memory(spark, tmp_path):
    size, zeros, digest = 3 << 30, bytes(1 << 20), hashlib.sha256()
    for _ in range(size >> 20):
        digest.update(zeros)
    folder = tmp_path / "odd name=%20"
    folder.mkdir()
    with open(folder / "large.bin", "wb") as f:
        f.truncate(size)
    (folder / "empty.bin").touch()
    found = {r["path"]: (r["size"], r["sha256"]) for r in tables.file_digests(spark, str(tmp_path), "*.bin").collect()}
    assert found == {"odd name=%20/large.bin": (size, digest.hexdigest()), "odd name=%20/empty.bin": (0, hashlib.sha256().hexdigest())}
    code = f"import resource; from tidemark.sources.tables import sha256_of; a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; sha256_of({'file:' + str(folder / 'large.bin')!r}); print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a) // 1024)"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 200


def test_a_year_has_all_its_files_and_undated_rows_one(spark, tmp_path):
    rows = [(f"c{i}", date(2019 + i % 2, 1, 1) if i % 7 else None, float(i)) for i in range(400)]
    tables.write_by_year(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "y"), "date", ["code", "date"], 4)
    assert {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "y").iterdir() if d.is_dir()} == {"year=2019": 4, "year=2020": 4, "year=__HIVE_DEFAULT_PARTITION__": 4}
    tables.write_by_year(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), "date", ["code"])


def test_manifest(spark, tmp_path):
    files = {"a.txt": b"one", "b.txt": b"two", "d/c.txt": b"three", "README.md": b"top", "d/README.md": b"inner", "d/e/README.md": b"innermost"}
    (tmp_path / "d" / "e").mkdir(parents=True)
    for name, text in files.items():
        (tmp_path / name).write_bytes(text)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    listed = [("a.txt", 3, sha(b"one")), ("b.txt", 3, sha(b"xxx")), ("gone.txt", 1, "0"), ("README.md", 3, sha(b"top")), ("d/README.md", 5, sha(b"other"))]
    manifest = spark.createDataFrame(listed, "path string, size long, sha256 string")
    got = [tuple(r) for r in tables.verify_manifest(manifest, tables.file_digests(spark, str(tmp_path))).collect()]
    assert sorted(got) == sorted([("a.txt", "ok"), ("b.txt", "changed"), ("gone.txt", "missing"), ("d/c.txt", "unlisted"), ("README.md", "ok"), ("d/README.md", "changed"), ("d/e/README.md", "unlisted")])


class Elsewhere:
    """A session of a cluster that names no shared folder."""

    conf = {}
    sparkContext = type("Context", (), {"master": "spark://host:7077"})


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"])
def test_no_cluster_writes_to_a_folder_of_one_machine(master):
    Elsewhere.sparkContext.master = master
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_root(Elsewhere)
