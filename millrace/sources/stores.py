"""Tables that are published whole: a cache addressed by its contents, a sink behind checks, and batches that are written once.

Everything is written beside its place first and moved there by renaming its folder, so a reader sees the table
before or the table after. Paths may be on any file system that Spark reaches; where renaming a folder is no
single step, as on object stores, a reader may meet it half done.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

SIDECAR = "digest.json"


class _Folder:
    """A folder and its file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.files.exists(self.path)

    def delete(self) -> None:
        self.files.delete(self.path, True)

    def move(self, to: str) -> bool:
        """Whether it could be renamed: False if something is there."""
        where = self.jvm.org.apache.hadoop.fs.Path(to)
        if self.files.exists(where):
            return False
        self.files.mkdirs(where.getParent())
        return self.files.rename(self.path, where)

    def write(self, text: str) -> None:
        self.files.mkdirs(self.path.getParent())
        out = self.files.create(self.path, True)
        out.write(bytearray(text.encode()))
        out.close()


def read_small(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    if not _Folder(spark, path).exists():
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def digest(df: DataFrame) -> str:
    """A digest of a table's columns, types and rows in any order: the same for the same rows, however often one occurs is counted in.

    One pass: two 64-bit hashes of each row, summed up in decimals. Maps are read as their entries in order of the keys.
    """
    names = sorted(df.columns)
    plain = [F.array_sort(F.map_entries(c)).alias(c) if t.startswith("map<") else F.col(c) for c, t in sorted(df.dtypes)]
    rows = df.select(*plain)
    # A null and where it stands count too.
    marks = F.array(*(F.col(c).isNull() for c in names)) if names else F.array()
    one, two = F.xxhash64(*names, marks), F.xxhash64(F.lit(1), marks, *names)
    sums = rows.agg(F.count("*").alias("n"), *(F.sum(h.cast("decimal(38,0)")).cast("string").alias(a) for h, a in ((one, "a"), (two, "b")))).first()
    kinds = [f"{c}:{t}" for c, t in sorted(df.dtypes)]
    return hashlib.sha256(json.dumps([kinds, sums["n"], sums["a"], sums["b"]]).encode()).hexdigest()


@dataclass(frozen=True)
class Cached:
    table: DataFrame
    computed: bool
    key: str


def load_or_compute(spark: SparkSession, folder: str, inputs: dict[str, DataFrame], parameters: dict, compute: Callable[[], DataFrame]) -> Cached:
    """What ``compute`` gives, from ``folder`` if it is there for these inputs and parameters, with a sidecar that agrees.

    The key is a digest of the inputs' rows and of the parameters; a changed row or parameter computes anew, beside what is there for
    others. The sidecar holds the digest of the result's rows: a table that does not agree with it is replaced.
    """
    told = {"inputs": {n: digest(df) for n, df in sorted(inputs.items())}, "parameters": parameters}
    key = hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()
    place = f"{folder}/{key}"
    sidecar = read_small(spark, f"{place}/{SIDECAR}")
    if sidecar and _Folder(spark, f"{place}/data").exists():
        held = spark.read.parquet(f"{place}/data")
        if json.loads(sidecar).get("rows") == digest(held):
            return Cached(held, False, key)
    staged = f"{folder}/.staged-{uuid.uuid4().hex}"
    compute().write.parquet(f"{staged}/data")
    rows = digest(spark.read.parquet(f"{staged}/data"))
    _Folder(spark, f"{staged}/{SIDECAR}").write(json.dumps(told | {"rows": rows}, sort_keys=True, default=str))
    if sidecar or _Folder(spark, place).exists():  # torn or tampered with
        _Folder(spark, place).delete()
    if not _Folder(spark, staged).move(place):
        _Folder(spark, staged).delete()  # another application was faster, with the same rows
    return Cached(spark.read.parquet(f"{place}/data"), True, key)


@dataclass(frozen=True)
class Published:
    verdict: str
    broken: dict[str, int]
    published: bool


def publish(df: DataFrame, path: str, checks: dict[str, Callable[[DataFrame], DataFrame]], fatal: list[str]) -> Published:
    """Write ``df`` beside ``path``, count what each check finds in the written table, and move it to ``path`` only if none is broken.

    A check gives the rows that violate it. Verdicts: FAIL if a ``fatal`` check is broken, INCOMPLETE if another is, else COMPLETE. What
    stood at ``path`` before is replaced by a complete table and otherwise stays; a table that is not published is deleted.
    """
    spark = df.sparkSession
    staged, old = f"{path}.staged-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    written = spark.read.schema(df.schema).parquet(staged)
    found = {name: check(written).count() for name, check in checks.items()}
    broken = {name: n for name, n in found.items() if n}
    verdict = "FAIL" if any(n in broken for n in fatal) else "INCOMPLETE" if broken else "COMPLETE"
    if broken:
        _Folder(spark, staged).delete()
        return Published(verdict, broken, False)
    had = _Folder(spark, path).exists() and _Folder(spark, path).move(old)
    if not _Folder(spark, staged).move(path):
        if had:
            _Folder(spark, old).move(path)
        raise OSError(f"{path} was taken by another writer")
    _Folder(spark, old).delete()
    return Published(verdict, broken, True)


def finite(df: DataFrame) -> DataFrame:
    """Numbers that are NaN or infinite as null."""
    limit = F.lit(float("inf"))
    bad = lambda c: F.isnan(c) | (F.abs(c) == limit)
    return df.select(*(F.when(~bad(F.col(f.name)), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in df.schema))


def append_batch(df: DataFrame, path: str, batch_id: int | str) -> bool:
    """Append ``df`` to the JSON lines in ``path`` as batch ``batch_id``; False, with nothing written, if that batch is there: so a batch
    that is delivered again changes nothing. To be used with foreachBatch. Nulls are written as nulls, and so are numbers that are not finite."""
    spark = df.sparkSession
    place = f"{path}/batch={batch_id}"
    if _Folder(spark, place).exists():
        return False
    staged = f"{path}/.staged-{uuid.uuid4().hex}"
    finite(df).write.option("ignoreNullFields", "false").json(staged)
    if not _Folder(spark, staged).move(place):
        _Folder(spark, staged).delete()
        return False
    return True


def six_digits(value: Column) -> Column:
    """A finite double with six significant digits."""
    return F.format_string("%.5e", value).try_cast("double")


def plain_json(df: DataFrame) -> DataFrame:
    """(json): each row as JSON with its keys in order and six significant digits; a number that is not finite is an error."""
    limit = F.lit(float("inf"))
    out = []
    for name, kind in sorted(df.dtypes):
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.when(F.isnan(c) | (F.abs(c) == limit), F.raise_error(F.lit(f"{name} is not a finite number"))).otherwise(six_digits(c.cast("double")))
        out.append(c.alias(name))
    return df.select(F.to_json(F.struct(*out), {"ignoreNullFields": "false"}).alias("json"))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header and exactly these columns; nulls are empty, booleans true and false."""
    df.select(*columns).write.option("header", True).option("nullValue", "").option("emptyValue", '""').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of a CSV with a header. Columns are read as ``schema`` says and found by name; a column of ``required`` that the
    header lacks is an error. problems: (problem, key, n) for keys that are null or that several rows have."""
    header = spark.read.option("header", True).csv(path).columns  # reads one line
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    text = spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in header)).csv(path)
    kinds = spark.createDataFrame([], schema).schema
    rows = text.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in kinds if f.name in header))
    name = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key))
    null = F.bool_or(F.greatest(*(F.col(k).isNull() for k in key), F.lit(False)))
    counted = rows.groupBy(name.alias("key")).agg(F.count("*").alias("n"), null.alias("null"))
    problem = F.when(F.col("null"), "null key").when(F.col("n") > 1, "repeated key")
    return rows, counted.select(problem.alias("problem"), "key", "n").filter("problem is not null")


def read_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of JSON lines in one or many files. Blank lines are passed over.

    A line that can't be read is ``torn`` if it is the last of its file, as a writer that was killed leaves it, and ``malformed`` anywhere else.
    problems: (file, at, line, problem). Only unreadable lines are compared with their files' last lines; ``at`` grows along a file.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    # Within a block rows are numbered in order, as one task reads it.
    lines = text.filter(F.trim("line") != "").select("file", F.struct("block", "row").alias("at"), "line")
    read = lines.withColumn("r", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowNonNumericNumbers": "false"}))
    ok = F.col("r").isNotNull() & F.col("r._bad").isNull()
    last = lines.groupBy("file").agg(F.max("at").alias("last"))
    bad = read.filter(~ok).select("file", "at", "line").join(last, "file")
    problems = bad.select("file", "at", "line", F.when(F.col("at") == F.col("last"), "torn").otherwise("malformed").alias("problem"))
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return read.filter(ok).select("file", *(F.col(f"r.{n}").alias(n) for n in names)), problems


def strictly(rows: DataFrame, problems: DataFrame) -> DataFrame:
    """``rows`` if no line is malformed; torn last lines are let pass. Raises ValueError, which names the first ones."""
    bad = problems.filter("problem = 'malformed'").orderBy("file", "at").limit(3).collect()
    if bad:
        raise ValueError("not valid JSON: " + "; ".join(f"{r['file']}: {r['line'][:80]!r}" for r in bad))
    return rows


def files(spark: SparkSession, path: str, pattern: str, names: dict[str, str], extensions: tuple[str, ...] = ()) -> DataFrame:
    """(path, size, ...) of the files below ``path``, at any depth, whose names match the regular expression ``pattern``: a column for
    each of ``names``, which give the pattern's groups in order their names and types. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))
    name = F.element_at(F.split("path", "/"), -1)
    found = found.filter(name.rlike(f"^(?:{pattern})$"))
    if extensions:
        found = found.filter(F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*extensions))
    return found.select("path", "size", *(F.regexp_extract(name, f"^(?:{pattern})$", i).try_cast(kind).alias(n) for i, (n, kind) in enumerate(names.items(), 1)))
