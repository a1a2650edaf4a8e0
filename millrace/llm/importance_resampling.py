"""Importance resampling towards a target distribution.

Documents and target texts are bags of hashed runs of 1 to ``most_run`` words. A bucket's *gain* is the logarithm
of how much more often the target hits it than the documents do; a document's weight is the sum of its runs'
gains, looked up in one array. Weight plus Gumbel noise, which is a hash of the id, makes the score, and the
highest scores are a draw without replacement in proportion to the weights.

The draw is exact at any size. Rows are ordered by one composite key, the score (high first) and then the id
(low first), read as a number of 128 bits; the key of the last row drawn is found digit by digit: each round
counts the rows that begin with the digits found so far, by their next digit, and at most 2**``DIGIT_BITS``
counts reach the driver. Only rows up to that key are sorted by range and ranked; all others pass by. No more
rounds are made than the range of the keys needs.

Texts are read twice, once for the counts and once for the weights, and never shuffled: a task sends one row
for each bucket. Gains are broadcast: one number for each of ``buckets``, whatever the input.

Edge cases: null and empty texts have no words, weight 0 and no part in the draw unless ``least_words`` is 0; an
empty table gives an empty result, an empty target is counted as no runs at all; texts and words of any length are
read whole. An id that is null hashes as an empty string and comes after all others among equal scores; repeated
rows are ranked one by one, those of one id in order of their texts' hashes. Extra columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranking import numbered
from millrace.plans.lineage import stash

from . import textbytes as tb
from .keys import small_batches

DIGIT_BITS = 12
#: Words here are runs of ASCII letters and digits and of everything beyond ASCII.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Longer spans than this are hashed one by one.
_LONG = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each byte span: one byte of all spans at a time, the longest spans first so that those that go on stay together."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    order = order[np.searchsorted(-size[order], -_LONG, "left") :]
    out = np.zeros(len(starts), np.uint32)
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    at, left = starts[order], size[order]
    held = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, "left"))  # those with more than k bytes
        held[:n] = (held[:n] >> np.uint32(8)) ^ _CRC[(held[:n] ^ data[at[:n] + k]) & np.uint32(0xFF)]
    out[order] = held ^ np.uint32(0xFFFFFFFF)
    return out


def _runs(data: np.ndarray, offsets: np.ndarray, most_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the CRC-32 of every run of words, how many runs each row has, how many words), the runs row by row and length by length."""
    data = tb.LOWER[data]
    starts, ends, first = tb.spans(_INSIDE[data], offsets)
    words = np.diff(first)
    if most_run == 1:
        return crc32s(data, starts, ends), words, words
    # One blank between the words of a row, so that runs are spans too.
    keep = _INSIDE[data]
    keep[ends[ends < len(data)]] = True
    place = np.cumsum(keep) - 1
    data = np.where(_INSIDE[data], data, np.uint8(0x20))[keep]
    starts, ends = place[starts], place[ends - 1] + 1
    parts, rows = [], []
    for n in range(1, most_run + 1):
        at = tb.whole_grams(first, n)
        parts.append(crc32s(data, starts[at], ends[at + n - 1]))
        rows.append(tb.rows_of(first)[at])
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return np.concatenate(parts)[order], np.bincount(row, minlength=len(words)), words


def bucket_counts(texts: DataFrame, most_run: int, buckets: int) -> DataFrame:
    """(bucket, n): how many runs of words of the whole texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in tb.slices(batch.column("text")):
                total += np.bincount(_runs(data, offsets, most_run)[0] % np.uint32(buckets), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(hit, pa.int64()), "n": pa.array(total[hit], pa.int64())})

    return texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, most_run: int, buckets: int) -> np.ndarray:
    """Each bucket's gain: 1000 times the logarithm of the smoothed shares' ratio, rounded down."""
    counts = bucket_counts(docs, most_run, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t"))
    counts = counts.unionByName(bucket_counts(target, most_run, buckets).select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t")))
    table = counts.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toArrow()  # a row for each bucket at most
    s, t = np.zeros(buckets), np.zeros(buckets)
    at = table["bucket"].to_numpy()
    s[at], t[at] = table["s"].to_numpy(), table["t"].to_numpy()
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


_WEIGHED = "struct<n_words: bigint, n_features: bigint, weight: bigint>"


def weighed(text: Column, array) -> Column:
    """A struct of each text's n_words, n_features and weight; ``array``: (most_run, gains) as a broadcast value."""

    def run(texts: pa.Array) -> pa.Array:
        most_run, gain = array.value
        parts: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
        for _, _, data, offsets in tb.slices(texts):
            crc, features, words = _runs(data, offsets, most_run)
            bounds = np.concatenate([[0], np.cumsum(features)])
            parts.append((words, features, tb.sums(gain[crc % np.uint32(len(gain))], bounds)))
        columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)]
        return pa.StructArray.from_arrays(columns, ["n_words", "n_features", "weight"])

    return F.arrow_udf(run, _WEIGHED).asNondeterministic()(text)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down: the same for an id on any machine."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _flip(key: Column) -> Column:
    """With the highest bit turned over: what was in the order of unsigned numbers is in that of signed ones, and the reverse."""
    return key.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))


def _unsigned(x: int) -> int:
    return x & ((1 << 64) - 1)


def last_key(keys: DataFrame, wanted: int, digit_bits: int = DIGIT_BITS) -> tuple[int, int] | None:
    """The ``wanted``-th smallest of the keys (hi, lo), two bigints read as one unsigned number of 128 bits; null if there are fewer.

    ``keys`` is read once for the range and once for each digit that the range leaves open.
    """
    flipped = [_flip(F.col(c)) for c in ("hi", "lo")]
    ends = keys.agg(F.count("*").alias("n"), F.min(F.struct(*flipped)).alias("least"), F.max(F.struct(*flipped)).alias("most")).first()
    if not 1 <= wanted <= ends["n"]:
        return None
    least, most = (reduce(lambda a, x: a << 64 | _unsigned(x ^ -(1 << 63)), ends[k], 0) for k in ("least", "most"))
    found, open_bits, before = least, (least ^ most).bit_length(), 0
    while open_bits:
        width = min(digit_bits, open_bits, (open_bits - 1) % 64 + 1)  # a digit lies in one of the two parts
        open_bits -= width
        part, shift = ("hi", open_bits - 64) if open_bits >= 64 else ("lo", open_bits)
        known = found >> (open_bits + width) << (open_bits + width)
        same = F.lit(True)
        for c, value, free in (("hi", known >> 64, max(0, open_bits + width - 64)), ("lo", _unsigned(known), min(64, open_bits + width))):
            if free < 64:
                same &= F.shiftrightunsigned(c, free) == F.lit((value >> free) - ((value >> free >> 63) << 64))
        digit = F.shiftrightunsigned(part, shift).bitwiseAND(F.lit((1 << width) - 1))
        counts = sorted(map(tuple, keys.filter(same).groupBy(digit.alias("d")).count().collect()))
        for d, n in counts:
            if before + n >= wanted:
                break
            before += n
        found = known | d << open_bits
        if n == 1:  # the rest of the key is that of one row
            row = keys.filter(same & (digit == F.lit(d))).first()
            return row["hi"], row["lo"]
    return tuple(x - (x >> 63 << 64) for x in (found >> 64, _unsigned(found)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, most_run: int = 1, buckets: int = 10000, least_words: int = 20, seed: int = 2024
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each row of ``docs``: rank 1, 2, .. for the floor(percent * N / 100)
    highest scores among the N documents with at least ``least_words`` words, null for the others."""
    texts = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    gain = gains(texts, target, most_run, buckets)
    array = docs.sparkSession.sparkContext.broadcast((most_run, gain))
    scored = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), weighed(F.col("text"), array).alias("x"))
    score = F.col("x.weight") + noise(F.col("doc_id"), seed)
    # Unsigned, the key's first part falls as the score rises and the second rises with the id.
    hi, lo = _flip(F.bitwise_not(score)), F.coalesce(_flip(F.col("doc_id")), F.lit(-1).cast("bigint"))
    rows = stash(scored.select("doc_id", "text_hash", "x.*", score.alias("score"), hi.alias("hi"), lo.alias("lo")), "scored")
    able = rows.filter(F.col("n_words") >= least_words)
    wanted = able.count() * percent // 100
    last = last_key(able.select("hi", "lo"), wanted)
    named = ["doc_id", "n_words", "n_features", "weight", "score"]
    if last is None:
        return rows.select(*named, F.lit(None).cast("bigint").alias("rank"))
    # Rows that share the last key are told apart by the ranks.
    key = F.struct(_flip(F.col("hi")).alias("hi"), _flip(F.col("lo")).alias("lo"))
    edge = F.struct(*(_flip(F.lit(x).cast("bigint")).alias(c) for c, x in zip(("hi", "lo"), last, strict=True)))
    drawn = (F.col("n_words") >= least_words) & (key <= edge)
    ranked = numbered(rows.filter(drawn).withColumn("key", key), [], ["key", "text_hash"])
    rank = (F.col("i") + 1).cast("bigint")
    return ranked.select(*named, F.when(rank <= wanted, rank).alias("rank")).unionByName(
        rows.filter(~drawn).select(*named, F.lit(None).cast("bigint").alias("rank"))
    )
