"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds its distinct word shingles (hashed to 64 bits). Two collections of ``t`` small
MinHash signatures of ``WIDTH`` values each are computed; a table key is a *pair* of signatures, one
from either collection. So t * t tables of 2 * WIDTH values each need only 2 * WIDTH * t hash functions
instead of 2 * WIDTH * t * t. ``t`` is chosen so that a pair of documents at the threshold shares no key
with a probability of at most ``miss``; every pair that shares a key is followed up exactly. Keys are only
formed of signatures that the document shares with another one.

Documents with equal sets are one class from the start, and only one row of a class goes on. The
documents of a key are not paired with each other. They are compared with a *lead*, the document that shares
most signatures with others or that one's lead, which links most groups of near copies at once, from the texts. Documents of a group that
are still in different components are told apart by what sets them apart from the lead p. With D(x) for the
symmetric difference of x and p, r and a for the numbers of elements that x lacks and adds, j for the threshold, and
g = r + j a, documents x and y are linked if and only if

    (1 + j) |D(x) & D(y)| >= g(x) + g(y) - (1 - j) |p|.

A link between two components has an end that is not in the lead's. So those documents of a group meet the whole group, in blocks of at most
``FEW`` documents and ``BLOCK_BYTES`` of elements, two blocks at a time: a product of 0/1 rows counts the elements that many have in common, pairs are added up for the
others. Both are exact. Pairs of blocks are quadratic in a group, rows are not: a pair of blocks gives at most a link for each of its documents.

Edge cases: null and empty texts have an empty set and are linked with nothing; a document with fewer
words than a shingle has its whole word sequence as its only shingle; ids may repeat or be null (a
document is named by id and text hash, and equal sets are one class); an empty table gives an empty result; extra
columns play no part.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.lineage import stash, temporary

from . import bloom
from . import textbytes as tb
from .keys import small_batches
from .token_alignment import components as union_find

SIGNED_TYPE = "struct<n_shingles: bigint, set_hash: binary, signatures: array<bigint>>"
COMPARED_TYPE = "struct<linked: boolean, size: bigint, lacks: array<bigint>, adds: array<bigint>>"
#: Pairs of texts that are compared at a time.
PAIRS = 256
#: Documents of a block, and bytes of the elements that set them apart from the lead.
FEW, BLOCK_BYTES = 1 << 10, 1 << 21
#: Elements that a step multiplies, pairs that a step adds up, and how many products take the time of one added pair.
COLUMNS, ADDED, PRODUCTS = 1 << 12, 1 << 21, 100

#: MinHash values in a signature: with eight in a key, documents that share a passage seldom meet.
WIDTH = 4


def tables(threshold: float, miss: float = 1e-4) -> int:
    """The size t of either collection: (1 - j**WIDTH)**t is at most half of ``miss`` at similarity j."""
    return math.ceil(math.log(miss / 2) / math.log(1 - threshold**WIDTH))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, sorted, one row after another, and where each row's start."""
    data = tb.LOWER[data]
    starts, ends, first = tb.word_spans(data, offsets)
    words = tb.span_hashes(data, starts, ends)
    at = tb.whole_grams(first, n)
    row = tb.rows_of(first)[at]
    grams = tb.gram_hashes(words, n)[at]
    count = np.diff(first)
    for k in range(1, n):  # shorter rows: the whole sequence
        short = np.flatnonzero(count == k)
        if len(short):
            grams = np.concatenate([grams, tb.gram_hashes(words, k)[first[short]]])
            row = np.concatenate([row, short])
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(len(offsets)))


@lru_cache(maxsize=8)
def _functions(t: int) -> tuple[np.ndarray, np.ndarray]:
    values = np.random.default_rng(4).integers(1, 1 << 63, (2, 2 * WIDTH * t), dtype=np.uint64)
    return values[0] | np.uint64(1), values[1]


def signatures(grams: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """An array (rows with a set, 2 * t) of signatures of WIDTH MinHash values each: one collection, then the other."""
    starts = first[:-1]
    odd, add = _functions(t)
    out = np.zeros((2 * t, len(starts)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(2 * WIDTH * t):
            x = grams * odd[k] + add[k]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            out[k // WIDTH] = tb.mix(out[k // WIDTH] * np.uint64(3) + np.minimum.reduceat(x, starts))
    return out.T


def signed(text: Column, n: int, t: int) -> Column:
    """A struct for each text: the set's size, a 128-bit hash of the set, and its signatures (none for an empty set)."""

    def run(texts: pa.Array) -> pa.Array:
        sizes, hashes, signs = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.uint64)], [np.zeros((0, 2 * t), np.uint64)]
        for lo, hi, data, offsets in tb.slices(texts):
            grams, first = shingle_sets(data, offsets, n)
            count = np.diff(first)
            full = np.flatnonzero(count)
            sizes.append(count)
            two = np.zeros((hi - lo, 2), np.uint64)
            if len(full):
                bounds = first[full]
                with np.errstate(over="ignore"):
                    two[full, 0] = np.add.reduceat(tb.mix(grams ^ np.uint64(11)), bounds)
                    two[full, 1] = np.add.reduceat(tb.mix(tb.mix(grams) ^ np.uint64(12)), bounds)
                signs.append(signatures(grams, np.append(bounds, len(grams)), t))
            hashes.append(two)
        sizes = np.concatenate(sizes)
        ends = pa.array(np.append(0, np.cumsum(sizes > 0) * 2 * t), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(signs).ravel().view(np.int64)))
        places = pa.array(np.arange(0, (len(sizes) + 1) * 16, 16), pa.int32())
        names = pa.Array.from_buffers(pa.binary(), len(sizes), [None, places.buffers()[1], pa.py_buffer(np.concatenate(hashes).tobytes())])
        return pa.StructArray.from_arrays([pa.array(sizes), names, lists], ["n_shingles", "set_hash", "signatures"])

    return F.arrow_udf(run, SIGNED_TYPE).asNondeterministic()(text)


def packed(text: Column, key: Column, chosen) -> Column:
    """Each text whose key may be in the filter, compressed: it takes less room than the hashes of its set. The others as null."""

    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        press = zstandard.ZstdCompressor(level=3)
        may = chosen.value.contains(keys.to_numpy(zero_copy_only=False)) if chosen else np.ones(len(texts), bool)
        return pa.array([press.compress((t.as_py() or "").encode()) if m else None for t, m in zip(texts, may, strict=True)], pa.binary())

    return F.arrow_udf(run, "binary").asNondeterministic()(text, key)


def _sets(packs: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted shingle hashes of each packed text."""
    open_ = zstandard.ZstdDecompressor()
    texts = pa.array([open_.decompress(p.as_py()) for p in packs], pa.binary()).cast(pa.string())
    out: list[np.ndarray] = []
    for _, _, data, offsets in tb.slices(texts):
        grams, first = shingle_sets(data, offsets, n)
        out += [grams[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return out


def compared(lead: Column, other: Column, n: int, percent: int) -> Column:
    """A struct for each pair of packed texts: whether they are linked, the size of the lead's set, and the
    elements that the other one lacks and adds."""

    def run(leads: pa.Array, others: pa.Array) -> pa.Array:
        linked, sizes, lacks, adds = [], [], [], []
        for lo in range(0, len(leads), PAIRS):
            part = leads.slice(lo, PAIRS).dictionary_encode()
            ours = _sets(part.dictionary, n)
            for k, y in zip(part.indices.to_pylist(), _sets(others.slice(lo, PAIRS), n), strict=True):
                x = ours[k]
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared = y[at] == x
                both = int(np.count_nonzero(shared))
                also = np.zeros(len(y), bool)
                also[at[shared]] = True
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
                sizes.append(len(x))
                lacks.append(x[~shared].view(np.int64))
                adds.append(y[~also].view(np.int64))
        lists = []
        for column in (lacks, adds):
            ends = pa.array(np.cumsum([0, *map(len, column)]), pa.int32())
            lists.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *column]))))
        return pa.StructArray.from_arrays([pa.array(linked, pa.bool_()), pa.array(sizes, pa.int64()), *lists], ["linked", "size", "lacks", "adds"])

    return F.arrow_udf(run, COMPARED_TYPE).asNondeterministic()(lead, other)


def components(links: DataFrame) -> DataFrame:
    """(node, root): connected components of the links (a, b), by alternating large-star and small-star
    steps; root is the smallest node. Each step is a grouping and a join, and is written before the next."""
    with temporary(links.sparkSession) as keep:
        edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
        state = None
        while True:
            both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
            large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = large.filter("u > v").distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
            edges = stash(small.filter("u > v").distinct(), "edges")
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == state or not now[0]:
                return keep(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "components")
            state = now


def _compare(pairs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """(lead, node, linked, size, lacks, adds) of the pairs (lead, node)."""
    one = sets.select(F.col("node").alias("lead"), F.col("pack").alias("x"))
    two = sets.select("node", F.col("pack").alias("y"))
    near = pairs.join(one, "lead").join(two, "node")
    return stash(near.select("lead", "node", compared(F.col("x"), F.col("y"), n, percent).alias("c")).select("lead", "node", "c.*"), "compared")


def _common(x: np.ndarray, of_x: np.ndarray, nx: int, y: np.ndarray, of_y: np.ndarray, ny: int) -> np.ndarray:
    """(nx, ny): how many elements each two documents have in common; x, of_x: elements and the documents that have them."""
    both, code = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = code[: len(x)], code[len(x) :]
    in_x, in_y = np.bincount(x, minlength=len(both)), np.bincount(y, minlength=len(both))
    many = PRODUCTS * in_x * in_y > nx * ny
    out = np.zeros((nx, ny), np.float32)  # whole numbers up to 2**24
    at = np.cumsum(many) - 1
    (px, rx), (py, ry) = ((at[c[many[c]]], r[many[c]]) for c, r in ((x, of_x), (y, of_y)))
    n = int(many.sum())
    for lo in range(0, n, COLUMNS):
        a, b = (np.zeros((k, min(COLUMNS, n - lo)), np.float32) for k in (nx, ny))
        for m, c, r in ((a, px, rx), (b, py, ry)):
            here = (c >= lo) & (c < lo + COLUMNS)
            m[r[here], c[here] - lo] = 1
        out += a @ b.T
    few = (in_x > 0) & (in_y > 0) & ~many
    x, of_x, y, of_y = x[few[x]], of_x[few[x]], y[few[y]], of_y[few[y]]
    order = np.argsort(y, kind="stable")
    y, of_y = y[order], of_y[order]
    starts, counts = np.searchsorted(y, x), in_y[x]
    step = np.cumsum(counts) // ADDED
    for lo, hi in itertools.pairwise([*np.flatnonzero(np.diff(step, prepend=-1)).tolist(), len(x)]):
        pairs = np.repeat(of_x[lo:hi], counts[lo:hi]) * ny + of_y[tb.spread(starts[lo:hi], counts[lo:hi])]
        np.add.at(out.reshape(-1), pairs, np.float32(1))
    return out


class _Block(NamedTuple):
    """Documents of a group: node, component, whether that is not the lead's, g in hundredths, elements and whose they are."""

    node: np.ndarray
    root: np.ndarray
    outer: np.ndarray
    own: np.ndarray
    apart: np.ndarray
    of: np.ndarray

    @classmethod
    def read(cls, members: pa.Array) -> _Block:
        node, root, outer, own = (members.field(c).to_numpy(zero_copy_only=False) for c in ("node", "root", "outer", "own"))
        apart = members.field("apart")
        sizes = np.diff(apart.offsets.to_numpy())
        return cls(node, root, outer, own, apart.flatten().to_numpy(), np.repeat(np.arange(len(node)), sizes))


def _ties(x: _Block, y: _Block, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of components, as few as tie together what the links between documents of x and y tie. size: the lead's."""
    common = _common(x.apart, x.of, len(x.node), y.apart, y.of, len(y.node)).astype(np.int64)
    near = (100 + percent) * common >= x.own[:, None] + y.own - (100 - percent) * size
    u, v = np.nonzero(near & (x.outer[:, None] | y.outer) & (x.root[:, None] != y.root))
    roots, code = np.unique(np.concatenate([x.root[u], y.root[v]]), return_inverse=True)
    least = union_find(code[: len(u)], code[len(u) :], len(roots))
    tied = np.flatnonzero(least != np.arange(len(roots)))
    return roots[tied], roots[least[tied]]


def _rest(told: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): the links that tie components together, between documents of a group (see above). Pairs of blocks are dealt to tasks one by one."""
    spark = told.sparkSession
    ours = roots.select(F.col("node").alias("lead"), F.col("root").alias("lead_root"))
    placed = told.join(roots, "node", "left").join(ours, "lead", "left").withColumns({"root": F.coalesce("root", "node"), "lead_root": F.coalesce("lead_root", "lead")})
    own = 100 * F.size("lacks") + percent * F.size("adds")
    kept = ("lead", "node", "root", (F.col("root") != F.col("lead_root")).alias("outer"), "size", own.cast("bigint").alias("own"), F.concat("lacks", "adds").alias("apart"))
    members = stash(placed.select(*kept), "members")

    # A group that fits is one block. Another's blocks 0 to n_outer - 1 hold the documents that are not in the lead's component.
    room = lambda which: F.greatest(F.ceil(F.count_if(which) / F.lit(FEW)), F.ceil(F.coalesce(F.sum(F.when(which, F.size("apart"))), F.lit(0)) / F.lit(BLOCK_BYTES // 8)))
    groups = members.groupBy("lead").agg(room(F.lit(True)).alias("n_all"), room(F.col("outer")).alias("n_outer"), room(~F.col("outer")).alias("n_inner"), F.count("*").alias("k"))
    one = F.col("n_all") == 1
    groups = groups.filter("k > 1 and n_outer > 0").select("lead", F.when(one, 1).otherwise(F.col("n_outer")).alias("n_outer"), F.when(one, 0).otherwise(F.col("n_inner")).alias("n_inner"))
    h = F.xxhash64("node")
    block = F.when(F.col("outer") | (F.col("n_inner") == 0), F.pmod(h, "n_outer")).otherwise(F.col("n_outer") + F.pmod(h, F.greatest("n_inner", F.lit(1))))
    member = F.struct("node", "root", "outer", "own", "apart")
    dealt = members.join(stash(groups, "open"), "lead").withColumn("block", block).groupBy("lead", "block", "n_outer", "n_inner", "size").agg(F.collect_list(member).alias("members"))
    dealt = stash(dealt, "blocks")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = F.col("n_outer") + F.col("n_inner") - 1
    lower = dealt.filter("block < n_outer").select("lead", "size", F.col("block").alias("lo"), F.explode(F.sequence("block", most)).alias("hi"), F.col("members").alias("x"))
    upper = dealt.filter("block > 0").select("lead", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("block", F.col("n_outer")) - 1)).alias("lo"), F.col("block").alias("hi"), F.col("members").alias("y"))
    pairs = lower.repartition(n, "lead", "lo", "hi").join(upper.repartition(n, "lead", "lo", "hi"), ["lead", "lo", "hi"], "left").filter("lo = hi or y is not null").select("size", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for i in range(len(batch)):
                x, y = (_Block.read(batch.column(c)[i].values) if batch.column(c)[i].is_valid else None for c in ("x", "y"))
                found.append(_ties(x, y or x, batch.column("size")[i].as_py(), percent))
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _ranked(score: str, node: str) -> Column:
    """One number that orders by score, then by node."""
    return F.least(F.col(score), F.lit(10**12 - 1)).cast("decimal(12,0)") * F.lit(str(1 << 63)).cast("decimal(19,0)") + F.col(node).cast("decimal(20,0)")


def _node(rank: str) -> Column:
    return F.pmod(F.col(rank), F.lit(str(1 << 63)).cast("decimal(19,0)")).cast("bigint")


def _led(topped: DataFrame) -> DataFrame:
    """(top, rank): the leads of documents. topped: (top, rank) of the first document of a key and the others. A key's documents, the first with them,
    get the lead that the first one has by its own keys, if any: else a large group of near copies has about a lead for each key."""
    own = topped.groupBy("rank").agg(F.max("top").alias("lead")).withColumnRenamed("rank", "top")
    leads = topped.select("top").distinct().join(own, "top", "left").withColumn("lead", F.coalesce("lead", "top"))
    every = topped.join(leads, "top").select("lead", "rank").unionAll(leads.select("lead", F.col("top").alias("rank")))
    return every.filter("lead <> rank").distinct().withColumnRenamed("lead", "top")


def linked(groups: DataFrame, sets: DataFrame, ranks: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, root) of the nodes with a link, root being the same for all nodes of a component.
    groups: (lead, node); ranks: (node, rank), by which leads are chosen."""
    with temporary(sets.sparkSession) as keep:
        told = _compare(groups, sets, n, percent)
        roots = _joined(None, told.filter("linked").select(F.col("lead").alias("a"), F.col("node").alias("b")), keep)
        return _joined(roots, _rest(told, roots, percent), keep)


def _joined(roots: DataFrame | None, links: DataFrame, keep) -> DataFrame:
    """The roots after new links (a, b), as a table that ``keep`` writes unless nothing changes."""
    if roots is None:
        return keep(components(links), "roots")
    one = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    two = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    between = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    between = stash(between.filter("a <> b"), "between")
    if between.isEmpty():
        return roots
    moved = components(between)
    old = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return keep(old.unionAll(moved.join(roots, "node", "left_anti").select("node", "root")), "roots")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = 1e-4) -> DataFrame:
    """A row for each row of ``docs``: doc_id, text_hash, n_shingles, component_id (the smallest doc_id of
    the documents reachable by links, itself included) and kept (doc_id = component_id).

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets.
    """
    with temporary(docs.sparkSession) as keep:
        return keep(_classes(docs, shingle, percent, miss), "near_duplicates")


def _classes(docs: DataFrame, shingle: int, percent: int, miss: float) -> DataFrame:
    t = tables(percent / 100, miss)
    texts = small_batches(docs).select("doc_id", F.col("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    marked = stash(texts.select("doc_id", "text_hash", signed(F.col("text"), shingle, t).alias("s")).select("doc_id", "text_hash", "s.*"), "signed")

    # One row for each distinct set; the smallest id stands for the class. Written at once, so that a node keeps its number.
    classes = marked.filter("n_shingles > 0").groupBy("set_hash").agg(
        F.min(F.coalesce("doc_id", F.lit(1 << 62))).alias("least"), F.first("signatures").alias("signatures"), F.min(F.xxhash64("doc_id", "text_hash")).alias("h")
    )
    classes = stash(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    shown = classes.select("node", F.posexplode("signatures").alias("at", "v"))
    met = stash(shown.groupBy("at", "v").agg(F.count("*").alias("k")).filter("k > 1"), "met")
    sharing = shown.join(met, ["at", "v"]).groupBy("node").agg(F.sum("k").alias("score"), F.collect_list(F.struct("at", "v")).alias("signs"))
    left, right = (F.filter("signs", lambda s: s["at"] < t), F.filter("signs", lambda s: s["at"] >= t))
    pair = F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.xxhash64(x["at"], y["at"], x["v"], y["v"]))))
    sharing = stash(sharing.select("node", _ranked("score", "node").alias("rank"), pair.alias("keys")).filter("size(keys) > 0"), "sharing")
    keys = sharing.select("rank", F.explode("keys").alias("key"))
    led = stash(keys.groupBy("key").agg(F.count("*").alias("k"), F.max("rank").alias("top")).filter("k > 1").select("key", "top"), "led")
    topped = stash(keys.join(led, "key").filter("rank <> top").select("top", "rank").distinct(), "topped")
    groups = stash(_led(topped).select(_node("top").alias("lead"), _node("rank").alias("node")), "groups")

    # The texts of one document of each class that shares a key. The filter lets a few others pass, which the join drops.
    met = groups.select("node").unionAll(groups.select("lead")).distinct()
    one = stash(classes.select("node", "h").join(met, "node"), "chosen")
    h = F.xxhash64("doc_id", "text_hash")
    whole = texts.select(h.alias("h"), packed(F.col("text"), h, bloom.build(one.select("h"))).alias("pack")).filter("pack is not null")
    sets = stash(one.join(whole, "h").dropDuplicates(["node"]).select("node", "pack"), "sets")
    roots = linked(groups, sets, sharing.select("node", "rank"), shingle, percent).join(classes.select("node", "set_hash"), "node").select("root", "set_hash")
    roots = roots.withColumnRenamed("root", "root_node").join(classes.select(F.col("node").alias("root_node"), F.col("set_hash").alias("root")), "root_node").select("set_hash", "root")
    named = classes.select("set_hash", "least").join(roots, "set_hash", "left").withColumn("root", F.coalesce("root", "set_hash"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.select("set_hash", "root").join(least, "root").select("set_hash", "component")
    out = marked.drop("signatures").join(named, "set_hash", "left")
    component = F.when(F.col("n_shingles") > 0, F.nullif("component", F.lit(1 << 62))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
