"""Telling documents apart: by id and text, as ids may repeat or be null."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.lineage import temporary

from . import bloom


#: Bytes of the batches that Spark hands to Python, and the setting that holds them. Its default, 64 MB, is in memory several times over.
BATCH_BYTES, BATCH_SETTING, BATCH_DEFAULT = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(rows: DataFrame) -> DataFrame:
    """``rows``; from here on its session hands out smaller batches, unless it was told a size."""
    conf = rows.sparkSession.conf
    if conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return rows


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text (null: empty) and text_hash, which together with doc_id names the document."""
    docs = small_batches(docs)
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select("doc_id", whole.alias("text"), F.xxhash64(whole).alias("text_hash"))


def attach(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on doc_id and text_hash; null ids are equal. The key columns come out once, from the left."""
    right = right.withColumnsRenamed({"doc_id": "__doc_id", "text_hash": "__text_hash"})
    both = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("text_hash") == F.col("__text_hash"))
    return left.join(right, both, how).drop("__doc_id", "__text_hash")


def with_matches(
    docs: DataFrame, find: Callable[[], DataFrame], column: str, work: Callable[[pa.Array, pa.Array, pa.Array], pa.Array], kind: str
) -> DataFrame:
    """The keyed ``docs`` with ``done`` (of type ``kind``), which is work(text, matches, skip): matches is ``column`` of what
    ``find`` gives (a row for each document with matches) or null, and where skip is true the result is null and not used. Of the
    tables that ``find`` makes only its result stays.

    Only texts that may have matches, by a bounded filter on their keys, are shuffled; the others pass through. The filter is
    looked into by the same Python worker that does the work, as a task's second worker would need as much memory again.
    """
    with temporary(docs.sparkSession) as keep:
        found = keep(find(), "found")
    key = F.xxhash64("doc_id", "text_hash")
    hit = bloom.build(found.select(key.alias("h")))

    def run(text: pa.Array, matches: pa.Array, key: pa.Array) -> pa.Array:
        skip = np.zeros(len(text), bool)
        if hit is not None and key.null_count < len(key):
            skip = hit.value.contains(pc.fill_null(key, 0).to_numpy(zero_copy_only=False))
        return work(text, matches, pa.array(skip))

    done = lambda matches, key: F.arrow_udf(run, kind).asNondeterministic()("text", matches, key)
    near = attach(docs.filter(bloom.maybe(key, hit)), found, "left").withColumn("done", done(F.col(column), F.lit(None).cast("bigint"))).drop(column)
    if hit is None:
        return near
    far = docs.withColumn("done", done(F.lit(None).cast(found.schema[column].dataType), key)).filter("done is not null")
    return near.unionByName(far)
