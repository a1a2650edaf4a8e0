"""Language-model scores from a log-frequency Bloom filter.

The training texts' unigrams and bigrams are counted, and each count c is quantised to a level on a
logarithmic scale. An n-gram of level q is put into a Bloom filter q times, as (n-gram, 1) ..
(n-gram, q); its level is read back by probing for level 1, 2, ... until a probe fails. A wrong hit can
only raise a level, and ever less likely by more than one.

The probability of a token after another is the mixture  l * c(ab) / c(a) + (1 - l) * p(b)  with p(b)
= (c(b) + 0.5) / (N + 0.5 (V + 1)); the weight l depends on the level of c(a) and is chosen by the
likelihood of the training texts with each token's own occurrence taken out of the counts.

The filter is made of blocks. An n-gram belongs to one block, so its partial counts from all tasks meet
in one group, of bounded size, that sums them up and fills the block's bits. The filter grows with
the number of training tokens. Up to ``MOST_BYTES`` it is broadcast; beyond, its blocks stay a table, and
each slice of texts sends its distinct n-grams to the blocks, whose answers come back to the slice.

The base score needs exact unigram counts: the ``FREQUENT`` most frequent words are broadcast, which
covers most tokens, and the rest is joined with the table of counts.

Edge cases: a null or empty text is just its end token; rows may repeat; a null id is in the training
set; without any training token, all counts are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.lineage import stash

from . import textbytes as tb
from .keys import small_batches

#: The largest filter that is broadcast.
MOST_BYTES = 1 << 27
BITS_PER_TOKEN = 6
BLOCK_WORDS = 1 << 13
#: Blocks that are asked together where they stay a table, and about how many n-grams make up a group that asks them.
SHELF, GROUP_GRAMS = 16, 1 << 22
#: How many of the most frequent words have their exact counts broadcast (16 bytes each).
FREQUENT = 1 << 18
#: Bytes of text that are worked through at a time, and tokens whose levels are.
SLICE_BYTES, CHUNK = (1 << 21) - 4096, 1 << 18
END = np.uint64(0x5851F42D4C957F2D)
_LOW = np.uint64((1 << 48) - 1)
GRID = np.array([0.0, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])


def _steps() -> np.ndarray:
    """The smallest count of each level: exact while small, then a fifth more each time."""
    steps = [1]
    while steps[-1] < 1 << 50:
        steps.append(max(steps[-1] + 1, int(steps[-1] * 1.2)))
    return np.array(steps)


STEPS = _steps()
#: The count that a level stands for: the middle of its range; level 0 is 0.
COUNTS = np.concatenate([[0.0], (STEPS[:-1] + STEPS[1:] - 1) / 2])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens of a slice, an end after each row's words, and where each row starts."""
    data = tb.LOWER[data]
    starts, ends, first = tb.word_spans(data, offsets)
    words = np.insert(tb.span_hashes(data, starts, ends), first[1:], END)
    return words, first + np.arange(len(first))


def bigrams(words: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it; before a row's first token there is an end."""
    before = np.concatenate([[END], words[:-1]])
    with np.errstate(over="ignore"):
        return tb.mix(before * np.uint64(0x9E3779B97F4A7C15) + tb.mix(words + np.uint64(1)))


@dataclass
class LogFilter:
    """The filter's 64-bit words, block after block."""

    words: np.ndarray
    blocks: int

    def block_of(self, grams: np.ndarray) -> np.ndarray:
        return (tb.mix(grams) % np.uint64(self.blocks)).astype(np.int64)

    def levels(self, grams: np.ndarray, base: np.ndarray | int, most: int = 254) -> np.ndarray:
        """The level of each n-gram: how many probes in a row succeed. base: its block's first word."""
        out = np.zeros(len(grams), np.uint8)
        active = np.arange(len(grams))
        base = np.broadcast_to(np.asarray(base), len(grams))
        for q in range(1, most):
            at, mask = _bits(grams[active], q)
            hit = (self.words[base[active] + at] & mask) == mask
            active = active[hit]
            if not len(active):
                break
            out[active] = q
        return out


def _bits(grams: np.ndarray, q) -> tuple[np.ndarray, np.ndarray]:
    """(word in the block, bits) of the probes for level q."""
    with np.errstate(over="ignore"):
        x = tb.mix((grams & _LOW) + np.uint64(0xD1342543DE82EF95) * np.asarray(q).astype(np.uint64))
    mask = np.zeros(len(grams), np.uint64)
    for shift in (40, 46, 52, 58):
        mask |= np.uint64(1) << ((x >> np.uint64(shift)) & np.uint64(63))
    return (x & np.uint64(BLOCK_WORDS - 1)).astype(np.int64), mask


def fill_block(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A block's words, from its n-grams and their partial counts."""
    distinct, place = np.unique(grams & _LOW, return_inverse=True)
    level = np.searchsorted(STEPS, np.bincount(place, counts, len(distinct)), "right")
    at, mask = _bits(np.repeat(distinct, level), tb.spread(np.ones(len(level), np.int64), level))
    words = np.zeros(BLOCK_WORDS, np.uint64)
    np.bitwise_or.at(words, at, mask)
    return words


def word_counts(training: DataFrame) -> DataFrame:
    """(h, n): every distinct token of the training texts, the end included, with its exact count."""

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in tb.slices(batch.column("text"), SLICE_BYTES):
                h, n = np.unique(tokens(data, offsets)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return training.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def filter_blocks(training: DataFrame, blocks: int) -> DataFrame:
    """(block, words): the filter of all unigrams and bigrams of the training texts."""
    index = LogFilter(np.zeros(0, np.uint64), blocks)

    def count(batches):
        for batch in batches:
            for _, _, data, offsets in tb.slices(batch.column("text"), SLICE_BYTES):
                words, _ = tokens(data, offsets)
                grams, n = np.unique(np.concatenate([words, bigrams(words)]), return_counts=True)
                block = index.block_of(grams)
                order = np.argsort(block, kind="stable")
                grams, n, block = grams[order], n[order].astype(np.int32), block[order]
                cut = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                low = np.ascontiguousarray(grams.view(np.uint8).reshape(-1, 8)[:, :6])  # the block tells the rest
                ends = np.append(cut[1:], len(grams))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block[cut].astype(np.int32)),
                        pa.array([low[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary()),
                        pa.array([n[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary()),
                    ],
                    ["block", "grams", "counts"],
                )

    def fill(group: pa.Table) -> pa.Table:
        low = np.frombuffer(b"".join(group["grams"].to_pylist()), np.uint8).reshape(-1, 6)
        grams = np.zeros((len(low), 8), np.uint8)
        grams[:, :6] = low
        counts = np.frombuffer(b"".join(group["counts"].to_pylist()), np.int32)
        words = fill_block(grams.view(np.uint64).ravel(), counts)
        return pa.table({"block": group["block"][:1], "words": pa.array([words.tobytes()], pa.binary())})

    counted = training.select("text").mapInArrow(count, "block int, grams binary, counts binary")
    return counted.groupBy("block").applyInArrow(fill, "block int, words binary")


def _levels_here(text: Column, shared) -> Column:
    """A struct (one, two): the levels of the unigram and of the bigram at each token, a byte each, from the broadcast filter."""

    def run(texts: pa.Array) -> pa.Array:
        columns: tuple[list, list] = ([], [])
        index = shared.value
        for _, _, data, offsets in tb.slices(texts, SLICE_BYTES // 2):
            words, first = tokens(data, offsets)
            distinct, place = np.unique(words, return_inverse=True)
            one = index.levels(distinct, index.block_of(distinct) * BLOCK_WORDS)[place]
            pairs = bigrams(words)
            two = index.levels(pairs, index.block_of(pairs) * BLOCK_WORDS)
            cut = first.tolist()
            for column, raw in zip(columns, (one.tobytes(), two.tobytes()), strict=True):
                column += [raw[i:j] for i, j in zip(cut, cut[1:], strict=False)]
        return pa.StructArray.from_arrays([pa.array(c, pa.binary()) for c in columns], ["one", "two"])

    return F.arrow_udf(run, "struct<one: binary, two: binary>").asNondeterministic()(text)


def _cut(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(slice, rows, texts): runs of rows with about ``slice_bytes`` bytes of text, a row each."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows, texts = batch.column("row"), batch.column("text")
            for lo, hi, _, _ in tb.slices(texts, slice_bytes):
                lists = [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), c.slice(lo, hi - lo)) for c in (rows, texts)]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], ["slice", "rows", "texts"])
                number += 1

    return docs.select("row", "text").mapInArrow(run, "slice bigint, rows array<bigint>, texts array<string>")


def _distinct(texts: pa.Array, index: LogFilter) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A slice's distinct n-grams in the order of their blocks, these blocks, the places of the unigrams and
    then of the bigrams of all tokens among them, and where each row starts."""
    _, _, data, offsets = next(tb.slices(texts, 1 << 62))
    words, first = tokens(data, offsets)
    grams, place = np.unique(np.concatenate([words, bigrams(words)]), return_inverse=True)
    block = index.block_of(grams)
    order = np.argsort(block, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return grams[order], block[order], rank[place], first


def _ask(slices: DataFrame, blocks: int, salts: int) -> DataFrame:
    """(shelf, salt, slice, grams): each distinct n-gram of a slice once, packed by shelf of ``SHELF`` blocks."""
    index = LogFilter(np.zeros(0, np.uint64), blocks)

    def run(batches):
        for batch in batches:
            for number, texts in zip(batch.column("slice").to_pylist(), batch.column("texts"), strict=True):
                grams, block, _, _ = _distinct(texts.values, index)
                shelf = block // SHELF
                cut = np.flatnonzero(np.append(True, shelf[1:] != shelf[:-1]))
                ends = np.append(cut[1:], len(grams))
                salt = int(tb.mix(np.array([number], np.uint64))[0] % np.uint64(salts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shelf[cut].astype(np.int32)),
                        pa.array(np.full(len(cut), salt, np.int32)),
                        pa.array(np.full(len(cut), number, np.int64)),
                        pa.array([grams[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary()),
                    ],
                    ["shelf", "salt", "slice", "grams"],
                )

    return slices.select("slice", "texts").mapInArrow(run, "shelf int, salt int, slice bigint, grams binary")


def _levels_exchanged(docs: DataFrame, table: DataFrame, blocks: int, slice_bytes: int = SLICE_BYTES, group_grams: int = GROUP_GRAMS) -> DataFrame:
    """The same, with the probes sent to the blocks and the answers sent back.

    A slice asks for each of its n-grams once, however often it occurs. A shelf's probes are dealt over groups of about
    ``group_grams``, each with its own copy of the shelf, so a group is bounded whatever the words' frequencies. Slices and shelves
    grow alike with the corpus, and so the number of copies of a shelf does not grow.
    """
    index = LogFilter(np.zeros(0, np.uint64), blocks)

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asked):
            return pa.table({"slice": pa.array([], pa.int64()), "shelf": pa.array([], pa.int32()), "levels": pa.array([], pa.binary())})
        shelf = asked["shelf"][0].as_py()
        words = np.zeros(SHELF * BLOCK_WORDS, np.uint64)
        for block, raw in zip(held["block"].to_pylist(), held["words"].to_pylist(), strict=True):
            at = (block - shelf * SHELF) * BLOCK_WORDS
            words[at : at + BLOCK_WORDS] = np.frombuffer(raw, np.uint64)
        levels = []
        for raw in asked["grams"]:
            grams = np.frombuffer(raw.as_py(), np.uint64)
            levels.append(LogFilter(words, blocks).levels(grams, (index.block_of(grams) - shelf * SHELF) * BLOCK_WORDS).tobytes())
        return pa.table({"slice": asked["slice"], "shelf": asked["shelf"], "levels": pa.array(levels, pa.binary())})

    def gather(held: pa.Table, told: pa.Table) -> pa.Table:
        _, _, place, first = _distinct(held["texts"].chunk(0)[0].values, index)
        level = np.frombuffer(b"".join(told.sort_by("shelf")["levels"].to_pylist()), np.uint8)
        cut = first.tolist()
        columns = [[raw[i:j] for i, j in zip(cut, cut[1:], strict=False)] for raw in (part.tobytes() for part in np.split(level[place], 2))]
        return pa.table({"row": held["rows"].chunk(0)[0].values, "one": pa.array(columns[0], pa.binary()), "two": pa.array(columns[1], pa.binary())})

    slices = stash(_cut(docs, slice_bytes), "slices")
    grams = slices.count() * (slice_bytes // 4)  # few words are shorter
    salts = 1 + grams // (-(-blocks // SHELF) * group_grams)
    shelves = table.withColumn("shelf", F.floor(F.col("block") / SHELF).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = _ask(slices, blocks, salts).groupBy("shelf", "salt").cogroup(shelves.groupBy("shelf", "salt"))
    told = asked.applyInArrow(answer, "slice bigint, shelf int, levels binary")
    return slices.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(gather, "row bigint, one binary, two binary")


@dataclass(frozen=True)
class Model:
    """N, V, the level of the end token, and the weight of bigrams by the level of the first token."""

    n: int
    v: int
    end: int
    weights: tuple[float, ...] = ()

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.n + 0.5 * (self.v + 1))

    def parts(self, one: np.ndarray, two: np.ndarray, first: np.ndarray, out: int = 0) -> tuple[np.ndarray, ...]:
        """(level of the token before, bigram part, unigram part) at each token; ``out``: occurrences taken out."""
        before = np.concatenate([[self.end], one[:-1]])
        before[first[:-1]] = self.end
        context = np.maximum(COUNTS[before] - out, 0)
        pair = np.minimum(np.maximum(COUNTS[two] - out, 0), np.minimum(context, np.maximum(COUNTS[one] - out, 0)))
        share = np.divide(pair, context, out=np.zeros(len(one)), where=context > 0)
        return before, share, self.unigram(np.maximum(COUNTS[one] - out, 0))


def _packed(ones: pa.Array, twos: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The levels of runs of rows, about CHUNK tokens at a time, and where each row's start."""
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(ones).to_numpy(zero_copy_only=False))]).astype(np.int64)
    row = 0
    while row < len(ones):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + CHUNK, "right")) - 1)
        one, two = (np.frombuffer(b"".join(c.slice(row, stop - row).to_pylist()), np.uint8) for c in (ones, twos))
        yield one, two, ends[row : stop + 1] - ends[row]
        row = stop


def fit_weights(levels: DataFrame, model: Model) -> Model:
    """Choose each context level's weight by the training texts, every token's own occurrence left out."""

    def run(batches):
        for batch in batches:
            gains, seen = np.zeros((256, len(GRID))), np.zeros(256, np.int64)
            for one, two, first in _packed(batch.column("one"), batch.column("two")):
                before, pair, single = model.parts(one, two, first, out=1)
                seen += np.bincount(before, minlength=256)
                for g, weight in enumerate(GRID):
                    gains[:, g] += np.bincount(before, np.log10(weight * pair + (1 - weight) * single), 256)
            level, g = np.nonzero(np.repeat(seen[:, None] > 0, len(GRID), axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(level.astype(np.int32)), pa.array(g.astype(np.int32)), pa.array(gains[level, g])], ["level", "g", "gain"])

    sums = levels.select("one", "two").mapInArrow(run, "level int, g int, gain double").groupBy("level", "g").agg(F.sum("gain").alias("gain")).collect()
    gains = np.full((256, len(GRID)), -np.inf)
    gains[:, 0] = -1e300
    for r in sums:  # 256 levels and the grid
        gains[r["level"], r["g"]] = r["gain"]
    return Model(model.n, model.v, model.end, tuple(GRID[gains.argmax(axis=1)]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def scores(docs: DataFrame, most_bytes: int = MOST_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """A row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    texts = small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    training = texts.filter("not held_out")

    counts = stash(word_counts(training), "counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "h").limit(frequent).toArrow().sort_by("h")
    exact = spark.sparkContext.broadcast((top["h"].to_numpy(), top["n"].to_numpy()))

    blocks = max(1, n * BITS_PER_TOKEN // (64 * BLOCK_WORDS))
    table = filter_blocks(training, blocks)
    rows = _exact_part(texts.withColumn("row", F.monotonically_increasing_id()), exact)
    if blocks * BLOCK_WORDS * 8 <= most_bytes:
        words = np.zeros(blocks * BLOCK_WORDS, np.uint64)
        for r in table.toLocalIterator():
            words[r["block"] * BLOCK_WORDS : (r["block"] + 1) * BLOCK_WORDS] = np.frombuffer(r["words"], np.uint64)
        shared = spark.sparkContext.broadcast(LogFilter(words, blocks))
        # Written at once, so that a row keeps its number.
        plain = stash(rows.withColumn("levels", _levels_here(F.col("text"), shared)).drop("text").select("*", "levels.*").drop("levels"), "levels")
    else:
        rows = stash(rows, "rows")
        plain = stash(rows.drop("text").join(_levels_exchanged(rows, stash(table, "filter"), blocks), "row"), "levels")

    ends = counts.filter(F.col("h") == int(END.view(np.int64))).agg(F.max("n")).first()[0] or 0
    model = Model(n, v, int(np.searchsorted(STEPS, ends, "right")))
    model = fit_weights(plain.filter("not held_out"), model)
    known = plain.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("k")).join(counts, "h")
    late = known.groupBy("row").agg(F.sum("k").alias("late_known"), F.sum(F.col("k") * F.log10((F.col("n") + 0.5) / 0.5)).alias("late_gain"))
    out = plain.withColumn("score", _score(model)("one", "two")).drop("one", "two").join(late, "row", "left")
    total = float(np.log10(n + 0.5 * (v + 1)))
    rare = F.size("rare") * float(np.log10(0.5))  # as if unknown; late_gain makes up for those that are known
    base = F.col("known_part") + rare + F.coalesce("late_gain", F.lit(0.0)) - F.col("n_tokens") * total
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("late_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )


def _exact_part(rows: DataFrame, exact) -> DataFrame:
    """Rows with n_tokens, how many of them are frequent words, their sum of log10(c + 0.5), and the hashes of the rest."""

    def run(text: pa.Array) -> pa.Array:
        h, n = exact.value
        parts: list[list] = [[], [], [], []]
        for _, _, data, offsets in tb.slices(text, SLICE_BYTES):
            words, first = tokens(data, offsets)
            signed = words.view(np.int64)
            at = np.minimum(np.searchsorted(h, signed), max(len(h) - 1, 0))
            found = h[at] == signed if len(h) else np.zeros(len(words), bool)
            logs = np.zeros(len(words))
            logs[found] = np.log10(n[at[found]] + 0.5)
            parts[0].append(np.diff(first))
            parts[1].append(tb.sums(found, first))
            parts[2] += [float(logs[i:j].sum()) for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            rare = np.concatenate([[0], np.cumsum(~found)])[first]
            parts[3].append(pa.ListArray.from_arrays(pa.array(rare, pa.int32()), pa.array(signed[~found])))
        flat = [np.concatenate([np.zeros(0, np.int64), *p]) for p in parts[:2]]
        lists = pa.concat_arrays(parts[3]) if parts[3] else pa.array([], pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([pa.array(flat[0]), pa.array(flat[1]), pa.array(parts[2], pa.float64()), lists], ["n_tokens", "n_known", "known_part", "rare"])

    kind = "struct<n_tokens: bigint, n_known: bigint, known_part: double, rare: array<bigint>>"
    marked = rows.withColumn("x", F.arrow_udf(run, kind).asNondeterministic()("text"))
    return marked.select("row", "doc_id", "held_out", "text", "x.*")


def _score(model: Model):
    """A UDF: the model's log10 probability of a text, from its levels."""

    def run(ones: pa.Array, twos: pa.Array) -> pa.Array:
        out: list[float] = []
        weights = np.array(model.weights)
        for one, two, first in _packed(ones, twos):
            before, pair, single = model.parts(one, two, first)
            logs = np.log10(weights[before] * pair + (1 - weights[before]) * single)
            out += [float(logs[i:j].sum()) for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        return pa.array(out, pa.float64())

    return F.arrow_udf(run, "double").asNondeterministic()
