"""Violations of rules as rows, verdicts over them, and documents that are read without giving up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, n, first_key): how many rows break each rule, and the least key of those; rules nobody breaks have n = 0.

    All rules are looked at in one pass; a rule that is null for a row isn't broken."""
    counts = [F.struct(F.lit(name).alias("rule"), F.count_if(broken).alias("n"), F.min(F.when(broken, F.col(key))).alias("first_key")) for name, broken in rules.items()]
    return rows.agg(F.array(*counts).alias("told")).select(F.inline("told"))


def duplicates(rows: DataFrame, keys: list[str], rule: str, first: str) -> DataFrame:
    """The same for keys that occur twice or more: n counts such keys."""
    twice = rows.groupBy(*keys).agg(F.count("*").alias("k"), F.min(first).alias("key")).filter("k > 1")
    return twice.agg(F.lit(rule).alias("rule"), F.count("*").alias("n"), F.min("key").alias("first_key"))


def orphans(rows: DataFrame, parents: DataFrame, key: str, rule: str) -> DataFrame:
    """The same for rows whose key is not among the parents."""
    lost = rows.join(parents.select(key), key, "left_anti")
    return lost.agg(F.lit(rule).alias("rule"), F.count("*").alias("n"), F.min(key).alias("first_key"))


def verdict(found: list[DataFrame], fatal: list[str]) -> DataFrame:
    """(checks, broken, verdict): FAIL if a fatal rule is broken, INCOMPLETE if another one is, else COMPLETE."""
    whole = reduce(DataFrame.unionByName, found)
    bad = F.col("n") > 0
    stop = F.count_if(bad & F.col("rule").isin(fatal)) > 0
    return whole.agg(F.count("*").alias("checks"), F.count_if(bad).alias("broken"), F.when(stop, "FAIL").when(F.count_if(bad) > 0, "INCOMPLETE").otherwise("COMPLETE").alias("verdict"))


def parsed(lines: DataFrame, line: str, schema: str) -> DataFrame:
    """``lines`` with ``record`` (null if it can't be read) and ``problem``. NaN and infinities are no JSON numbers.

    The schema names the fields; a line that is torn, is no object or has a value of another type is a problem, not an error."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowNonNumericNumbers": "false"}
    read = lines.withColumn("record", F.from_json(line, f"{schema}, _corrupt string", options))
    bad = F.col("record").isNull() | F.col("record._corrupt").isNotNull()
    return read.withColumn("problem", F.when(F.col(line).isNull(), "missing").when(bad, "unreadable")).withColumn("record", F.when(~bad, F.col("record").dropFields("_corrupt")))


def leaves(rows: DataFrame, key: str) -> DataFrame:
    """(key, path, value): the leaves of nested columns by their dotted names, as text; arrays are leaves."""
    def walk(kind: StructType, at: str) -> list[str]:
        return [p for f in kind.fields for p in (walk(f.dataType, f"{at}{f.name}.") if isinstance(f.dataType, StructType) else [f"{at}{f.name}"])]

    names = [p for p in walk(rows.schema, "") if p != key]
    told = F.array(*(F.struct(F.lit(p).alias("path"), F.col(p).cast("string").alias("value")) for p in names))
    return rows.select(key, F.inline(told))


def differing_lists(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """(only_one, only_two, both): the keys on either side only, and on both."""
    a, b = one.select(key).distinct().withColumn("a", F.lit(1)), two.select(key).distinct().withColumn("b", F.lit(1))
    return a.join(b, key, "full_outer").agg(F.count_if(F.col("b").isNull()).alias("only_one"), F.count_if(F.col("a").isNull()).alias("only_two"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


def nan_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """(name, n_nan, whole): NaNs or nulls in each column, and whether it is all or nothing."""
    gone = [F.struct(F.lit(c).alias("name"), F.count_if(F.col(c).isNull() | F.isnan(c)).alias("n_nan"), F.count("*").alias("n")) for c in names]
    return rows.agg(F.array(*gone).alias("told")).select(F.inline("told")).select("name", "n_nan", ((F.col("n_nan") == 0) | (F.col("n_nan") == F.col("n"))).alias("whole"))
