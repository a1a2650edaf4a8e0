"""Language of web pages by fusing several kinds of evidence.

For each page and language, the log posterior adds up

* the likelihood of the page's text under byte-trigram models, learned from labelled documents and
  tempered, as trigrams of one text are not independent;
* how often pages of that language declare the language that the page's markup declares;
* how often addresses with the page's suffix (the host's last label) hold that language;
* a prior from the host, smoothed towards its domain, and that towards all pages.

The last three are learned from the pages themselves: the text alone gives every page a soft label,
and grouped aggregations sum these up for each declaration, suffix, domain and host. A page's own soft
label is taken out of the sums before they are used for it.

Everything that is broadcast is bounded: one table of ``BUCKETS`` numbers for each of at most ``BLOCK``
languages. With more languages, the texts are read once for each block of them, and the likelihoods are
joined, so no language is left out. Sums for hosts and domains stay tables and are joined.

Edge cases: a null or empty page has no text evidence and gets its language from the rest; a null or
odd address has an empty host; without any labelled document every language is null and
probabilities are null; an empty table gives an empty result; ties go to the first language by name; texts of any length
count whole; rows may repeat, ids may be null, extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.lineage import stash

from . import textbytes as tb
from .keys import small_batches

BUCKETS = 1 << 16
#: Languages whose tables are broadcast at a time (64 * 65536 * 4 bytes).
BLOCK = 64
#: A text's log likelihood ratio counts as that of this many independent trigrams at most.
EVIDENCE = 30.0


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each byte trigram."""
    data = tb.LOWER[data].astype(np.uint64)
    at = tb.whole_grams(offsets, 3)
    row = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - 2, 0))
    code = data[at] | data[at + 1] << np.uint64(8) | data[at + 2] << np.uint64(16)
    return row, (tb.mix(code) & np.uint64(BUCKETS - 1)).astype(np.int64)


def trigram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all labelled documents."""

    def run(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, hi, data, offsets in tb.slices(batch.column("text")):
                names = sorted(set(langs[lo:hi]))
                code = np.array([names.index(x) for x in langs[lo:hi]], np.int64)
                row, bucket = _trigrams(data, offsets)
                key, n = np.unique(code[row] * BUCKETS + bucket, return_counts=True)
                named = pa.array(names, pa.string()).take(pa.array(key // BUCKETS))
                yield pa.RecordBatch.from_arrays([named, pa.array((key % BUCKETS).astype(np.int32)), pa.array(n)], ["lang", "bucket", "n"])

    held = labelled.filter("lang is not null and text is not null").select("lang", "text")
    return held.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, block: int = BLOCK) -> list[tuple[list[str], np.ndarray]]:
    """Blocks of languages, by name, and for each language the log probability of every bucket (add one half).
    The blocks are read one after another; one has at most block * BUCKETS counts."""
    counts = stash(trigram_counts(labelled), "trigrams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # names of languages
    out = []
    for lo in range(0, len(langs), block):
        names = langs[lo : lo + block]
        logs = np.full((len(names), BUCKETS), 0.5)
        table = counts.filter(F.col("lang").isin(names)).toArrow()
        row = pc.index_in(table["lang"], pa.array(names, pa.string())).to_numpy()
        np.add.at(logs, (row, table["bucket"].to_numpy()), table["n"].to_numpy())
        out.append((names, np.log(logs / logs.sum(axis=1, keepdims=True)).astype(np.float32)))
    return out


def plain_text(html: Column) -> Column:
    """The text of a page: without scripts, styles, comments and tags."""
    html = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(html, r"<[^>]*>", " ")


def declared(html: Column) -> Column:
    """The primary language that the markup declares; empty if none."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?i)<html\b[^>]*\slang\s*=\s*["']?([a-z]{2,3})""", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def text_likelihood(text: Column, model) -> Column:
    """The tempered log likelihood of each language of a block given a text only, in the model's order."""

    def run(texts: pa.Array) -> pa.Array:
        logs = model.value
        parts = [np.zeros((0, len(logs)))]
        for lo, hi, data, offsets in tb.slices(texts):
            row, bucket = _trigrams(data, offsets)
            total = np.stack([np.bincount(row, weights[bucket], hi - lo).astype(float) for weights in logs], axis=1)
            count = np.bincount(row, minlength=hi - lo)
            parts.append(total * (np.minimum(count, EVIDENCE) / np.maximum(count, 1))[:, None])
        flat = np.concatenate(parts)
        steps = pa.array(np.arange(len(flat) + 1) * len(logs), pa.int32())
        return pa.ListArray.from_arrays(steps, pa.array(flat.ravel()))

    return F.arrow_udf(run, "array<double>").asNondeterministic()(text)


def softened(read: DataFrame, blocks: list) -> DataFrame:
    """``read`` with ``soft``, the probabilities of all languages given the text, in place of the text."""
    spark = read.sparkSession
    if len(blocks) > 1:  # numbered and written at once, as the blocks' results are joined by the number
        read = stash(read.withColumn("row__", F.monotonically_increasing_id()), "read")
    logs = read.withColumn("logs", text_likelihood(F.col("text"), spark.sparkContext.broadcast(blocks[0][1])))
    for _, table in blocks[1:]:
        more = stash(read.select("row__", text_likelihood(F.col("text"), spark.sparkContext.broadcast(table)).alias("more")), "more")
        logs = logs.join(more, "row__").withColumn("logs", F.concat("logs", "more")).drop("more")
    top = logs.drop("text", "row__").withColumn("best", F.array_max("logs"))
    top = top.withColumn("weights", F.transform("logs", lambda x: F.exp(x - F.col("best"))))
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return top.withColumn("total", total).withColumn("soft", F.transform("weights", lambda x: x / F.col("total"))).drop("logs", "best", "weights", "total")


def _sums(pages: DataFrame, key: str, k: int) -> DataFrame:
    """The soft labels summed up for each value of ``key``: (key, key_sums array)."""
    sums = F.array(*(F.sum(F.col("soft")[j]) for j in range(k)))
    return pages.groupBy(key).agg(sums.alias(f"{key}_sums"))


def identify(pages: DataFrame, labelled: DataFrame, smoothing: float = 5.0) -> DataFrame:
    """page_id, host, declared, text_lang, lang and its probability, for each row of ``pages``."""
    blocks = fit(small_batches(labelled))
    langs = [x for names, _ in blocks for x in names]
    name = host(F.col("url"))
    read = pages.select("page_id", name.alias("host"), declared(F.col("html")).alias("declared"), plain_text(F.col("html")).alias("text"))
    read = read.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    if not langs:
        none = F.lit(None).cast("string")
        return read.select("page_id", "host", "declared", none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("probability"))
    k = len(langs)
    soft = stash(softened(read, blocks), "soft")
    whole = soft.agg(*(F.sum(F.col("soft")[j]) for j in range(k))).first()
    whole = [float(x or 0.0) for x in whole]
    joined = soft
    for key in ("declared", "suffix", "domain", "host"):
        joined = joined.join(_sums(soft, key, k), key)

    def rest(sums: Column) -> Column:
        return F.greatest(F.lit(0.0), F.aggregate(sums, F.lit(0.0), lambda a, x: a + x) - 1)

    total = sum(whole)
    sums = F.array(*map(F.lit, whole))

    def odds(j: Column) -> Column:
        own = F.get("soft", j)
        overall = (F.greatest(F.lit(0.0), F.get(sums, j) - own) + 1) / (max(total - 1, 0.0) + k)

        def share(key: str, prior: Column) -> Column:
            held = F.col(f"{key}_sums")
            return (F.greatest(F.lit(0.0), F.get(held, j) - own) + smoothing * prior) / (rest(held) + smoothing)

        # P(declaration | language), up to a factor that all languages share.
        says, by_suffix = share("declared", overall) / overall, share("suffix", overall) / overall
        by_host = share("host", share("domain", overall))
        return F.log(F.greatest(own, F.lit(1e-300))) + F.log(says) + F.log(by_suffix) + F.log(by_host)

    joined = joined.select("page_id", "host", "declared", "soft", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), odds).alias("odds"))
    names = F.array(*map(F.lit, langs))
    best = F.array_position("odds", F.array_max("odds"))
    weight = F.aggregate("odds", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("odds")))
    return joined.select(
        "page_id",
        "host",
        "declared",
        F.element_at(names, F.array_position("soft", F.array_max("soft")).cast("int")).alias("text_lang"),
        F.element_at(names, best.cast("int")).alias("lang"),
        (1 / weight).alias("probability"),
    )
