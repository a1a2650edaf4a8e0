"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

Every string of ``length`` bytes is a *window*. A byte goes if a window over it also starts earlier: in
a document with a smaller id, or further to the left in the same one.

Suffixes are dealt out by content: a window belongs to its *anchor*, the substring of 32 bytes with
the smallest hash in it. Equal windows have equal anchors, and consecutive windows mostly share
one, so a run of windows travels as one short context. Anchors are counted first; contexts of an
anchor that occurs once cannot match and stay where they are. The others are grouped in buckets of
bounded size. In a bucket, batches of contexts arrive in document order. Each batch gets a suffix array
(the places of its windows, sorted), which is merge-scanned against the existing levels for windows that are known,
and becomes the newest level; levels of about equal size are merged, so there are logarithmically many.
``extend`` does the same for batches of documents that arrive one after another, with levels kept as tables.

Skew: equal contexts of one task travel once. An anchor with more than ``HOT`` occurrences (a passage
that a large share of the documents hold) isn't put into a bucket; its windows are grouped one by one by
a 128-bit hash, with partial aggregation.

Edge cases: a null text is empty; texts shorter than a window lose nothing; very long texts are worked
through piece by piece; rows with one id count as one document; rows without an id are left whole and
match nothing; an empty table gives an empty result. Extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.lineage import stash, temporary

from . import bloom
from . import textbytes as tb
from .keys import keyed, with_matches

LENGTH, ANCHOR = 100, 32
#: Occurrences of an anchor beyond which its windows are grouped one by one.
HOT = 10_000
BUCKET_BYTES = 1 << 20
#: Contexts in a batch that gets a suffix array of its own.
BATCH = 1024


class SuffixLevels:
    """Suffix arrays: bytes with the places of their windows in sorted order, each at least twice as long as the next newer one."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def windows(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The windows at the places, as strings of bytes that compare whole."""
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, self.length)[places]).view(f"S{self.length}").ravel()

    def add(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Which of a batch's windows (places in document order) were known or occur earlier in the batch."""
        keys = self.windows(data, places)
        order = np.argsort(keys, kind="stable")
        array = keys[order]
        first = np.ones(len(array), bool)
        first[1:] = array[1:] != array[:-1]
        held = np.zeros(len(array), bool)
        for level in self.levels:
            held |= merge_scan(self.windows(*level), array)
        self._push(data, places[order[first & ~held]])
        known = np.empty(len(array), bool)
        known[order] = held | ~first
        return known

    def _push(self, data: np.ndarray, places: np.ndarray) -> None:
        if len(places):
            self.levels.append((data, places))
        while len(self.levels) > 1 and len(self.levels[-2][1]) < 2 * len(self.levels[-1][1]):
            (new, at), (old, there) = self.levels.pop(), self.levels.pop()
            whole, both = np.concatenate([old, new]), np.concatenate([there, at + len(old)])
            self.levels.append((whole, both[np.argsort(self.windows(whole, both), kind="stable")]))  # two sorted runs


def merge_scan(level: np.ndarray, array: np.ndarray) -> np.ndarray:
    """Which entries of a sorted array stand in the sorted level: both are merged, and an entry is known if the run of
    its equals begins with one of the level."""
    whole = np.concatenate([level, array])
    order = np.argsort(whole, kind="stable")  # two sorted runs; equals of the level come first
    merged = whole[order]
    new = np.ones(len(merged), bool)
    new[1:] = merged[1:] != merged[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(merged)), 0))
    out = np.empty(len(whole), bool)
    out[order] = order[start] < len(level)
    return out[len(level) :]


def _pieces(batch: pa.RecordBatch, length: int) -> Iterator[tuple]:
    """(ids, text hashes, first byte's place, bytes, offsets) of slices; a text beyond the limit comes in
    pieces that overlap by length - 1 bytes, so that each window is in one of them."""
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    hashes = batch.column("text_hash").to_numpy(zero_copy_only=False)
    for lo, hi, data, offsets in tb.slices(batch.column("text")):
        step = tb.SLICE_BYTES
        if hi - lo > 1 or len(data) <= step:
            yield ids[lo:hi], hashes[lo:hi], 0, data, offsets
            continue
        for base in range(0, len(data), step):
            part = data[base : base + step + length - 1]
            yield ids[lo:hi], hashes[lo:hi], base, part, np.array([0, len(part)])


def _anchored(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (row, first window, windows, anchor's place, anchor's hash)."""
    grams = tb.gram_hashes(tb._byte_values(3)[data], ANCHOR)
    at = tb.whole_grams(offsets, length)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    width = length - ANCHOR + 1
    best, place, span = grams, np.arange(len(grams), dtype=np.int32), 1
    while span < width:  # the leftmost smallest hash of spans that double
        jump = min(span, width - span)
        left, right = best[:-jump], best[jump:]
        take = right < left
        best, place = np.where(take, right, left), np.where(take, place[jump:], place[:-jump])
        span += jump
    anchor, row = place[at].astype(np.int64), tb.rows_of(np.append(0, np.cumsum(np.maximum(np.diff(offsets) - length + 1, 0))))
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    run = np.flatnonzero(new)
    return row[run], at[run], np.diff(np.append(run, len(at))), anchor[run], grams[anchor[run]]


def anchors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(h, n): the hashes of the anchors of each slice of texts, with how often they occur there."""

    def run(batches):
        for batch in batches:
            for _, _, _, data, offsets in _pieces(batch, length):
                h, n = np.unique(_anchored(data, offsets, length)[4], return_counts=True)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return docs.mapInArrow(run, "h bigint, n bigint")


_MATCH = "doc_id bigint, text_hash bigint, start bigint, n bigint"
_SENT = _MATCH + ", kind int, lead int, h bigint, w bigint, v bigint, context binary"
_KNOWN, _CONTEXT, _WINDOW = 0, 1, 2


def contexts(docs: DataFrame, repeated, hot, length: int = LENGTH) -> DataFrame:
    """What is sent on about the runs of windows whose anchor occurs twice or more, by ``kind``: runs that
    an equal run of the same slice precedes (and so go), contexts, and single windows of hot anchors."""

    def rows(kind: int, ids, hashes, base, row, start, n, lead=None, h=None, w=None, v=None, context=None) -> pa.RecordBatch:
        size = len(row)
        null = lambda t: pa.nulls(size, t)
        columns = {
            "doc_id": pa.array(ids[row].astype(np.int64)),
            "text_hash": pa.array(hashes[row].astype(np.int64)),
            "start": pa.array(start + base),
            "n": pa.array(n),
            "kind": pa.array(np.full(size, kind, np.int32)),
            "lead": null(pa.int32()) if lead is None else pa.array(lead.astype(np.int32)),
            "h": null(pa.int64()) if h is None else pa.array(h.view(np.int64)),
            "w": null(pa.int64()) if w is None else pa.array(w.view(np.int64)),
            "v": null(pa.int64()) if v is None else pa.array(v.view(np.int64)),
            "context": null(pa.binary()) if context is None else pa.array(context, pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches):
        for batch in batches:
            for ids, hashes, base, data, offsets in _pieces(batch, length):
                row, at, n, anchor, h = _anchored(data, offsets, length)
                again = repeated.value.contains(h) if repeated else np.ones(len(h), bool)
                row, at, n, anchor, h = row[again], at[again], n[again], anchor[again], h[again]
                order = np.lexsort((at, ids[row]))  # document order, as far as this slice goes
                row, at, n, anchor, h = row[order], at[order], n[order], anchor[order], h[order]
                start = at - offsets[row]
                raw = data.tobytes()
                whole = [raw[i:j] for i, j in zip(at.tolist(), (at + n + length - 1).tolist(), strict=True)]
                seen: dict[bytes, int] = {}
                known = np.array([seen.setdefault(c, k) != k for k, c in enumerate(whole)], bool)
                if known.any():
                    yield rows(_KNOWN, ids, hashes, base, row[known], start[known], n[known])
                warm = hot.value.contains(h) if hot else np.ones(len(h), bool)  # too many to tell: all one by one
                pick = np.flatnonzero(~known & ~warm)
                if len(pick):
                    yield rows(_CONTEXT, ids, hashes, base, row[pick], start[pick], n[pick], lead=(anchor - at)[pick], h=h[pick], context=[whole[k] for k in pick.tolist()])
                pick = np.flatnonzero(~known & warm)
                if len(pick):
                    w = tb.spread(at[pick], n[pick])
                    r = np.repeat(row[pick], n[pick])
                    one = tb.gram_hashes(tb._byte_values(5)[data], length)[w]
                    two = tb.gram_hashes(tb._byte_values(6)[data], length)[w]
                    order = np.lexsort((two, one))
                    same = np.zeros(len(w), bool)
                    same[1:] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
                    later = np.zeros(len(w), bool)
                    later[order] = same  # lexsort is stable, so the first in document order leads
                    ones = np.ones(len(w), np.int64)
                    place = w - offsets[r]
                    if later.any():
                        yield rows(_KNOWN, ids, hashes, base, r[later], place[later], ones[later])
                    yield rows(_WINDOW, ids, hashes, base, r[~later], place[~later], ones[~later], w=one[~later], v=two[~later])

    return docs.mapInArrow(run, _SENT)


def match_bucket(bucket: pa.Table, length: int = LENGTH) -> pa.Table:
    """The runs of windows of a bucket's contexts that occur earlier: (doc_id, text_hash, start, n). With a column
    ``old``, those with it come first, and only the runs of the others are returned."""
    old = "old" in bucket.column_names
    bucket = bucket.sort_by([("old", "descending")] * old + [("doc_id", "ascending"), ("start", "ascending")]).combine_chunks()
    ids, hashes, start, n = (bucket[c].to_numpy() for c in ("doc_id", "text_hash", "start", "n"))
    whole = bucket["context"].to_pylist()
    lead = bucket["lead"].to_pylist()
    seen: dict[bytes, int] = {}
    known = np.array([seen.setdefault(c, k) != k for k, c in enumerate(whole)], bool)
    out = [np.stack([np.flatnonzero(known), np.zeros(known.sum(), np.int64), n[known]], axis=1)]
    by_anchor: dict[bytes, int] = {}
    fresh = np.flatnonzero(~known).tolist()
    for k in fresh:
        gram = whole[k][lead[k] : lead[k] + ANCHOR]
        by_anchor[gram] = by_anchor.get(gram, 0) + 1
    live = [k for k in fresh if by_anchor[whole[k][lead[k] : lead[k] + ANCHOR]] > 1]
    family = SuffixLevels(length)
    for b in range(0, len(live), BATCH):
        part = np.array(live[b : b + BATCH])
        data = np.frombuffer(b"".join([whole[k] for k in part.tolist()]), np.uint8)
        count = n[part]
        base = np.concatenate([[0], np.cumsum(count + length - 1)[:-1]])
        at = tb.spread(base, count)
        gone = family.add(data, at)
        edge = np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8))
        # Runs of matches, cut where the next context begins.
        first = np.concatenate([[0], np.cumsum(count)])
        cuts = np.zeros(len(gone) + 1, bool)
        cuts[first] = True
        head = np.flatnonzero((edge == 1) | (cuts & np.append(gone, False)))
        tail = np.flatnonzero((edge == -1) | (cuts & np.insert(gone, 0, False)))
        owner = np.searchsorted(first, head, "right") - 1
        out.append(np.stack([part[owner], head - first[owner], tail - head], axis=1))
    k, shift, size = np.concatenate(out).astype(np.int64).T
    if old:
        new = ~bucket["old"].to_numpy(zero_copy_only=False)[k]
        k, shift, size = k[new], shift[new], size[new]
    return pa.table({"doc_id": ids[k], "text_hash": hashes[k], "start": start[k] + shift, "n": size})


def extend(levels: list[DataFrame], docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, list[DataFrame]]:
    """A new batch of documents against an index that earlier batches left: (runs, levels).

    runs: (doc_id, text_hash, runs) of the batch's windows that stand in a level or earlier in the batch. levels: the index's
    tables of contexts, the largest first, with the batch's as the newest; of two of about equal size one is made, so
    that there are logarithmically many. Levels are tables in the shared folder that a later call, or a later
    application that reads them again, goes on with. The levels handed in are left as they are: those that the new list has no more
    can be released once the new list is kept. Older levels count as earlier, whatever the ids. In a bucket,
    the levels' contexts come first, in document order, then the batch's, each block of them with a suffix array.
    """
    with temporary(docs.sparkSession) as keep:
        none = bloom.build(docs.sparkSession.range(0).select(F.col("id").alias("h")))
        named = keyed(docs).filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "text_hash")
        sent = stash(contexts(named, None, none, length), "contexts")
        own = sent.filter(F.col("kind") == _CONTEXT).select("doc_id", "text_hash", "start", "n", "lead", "h", "context")
        whole = own.withColumn("old", F.lit(False))
        for level in levels:
            whole = whole.unionByName(level.join(own.select("h").distinct(), "h", "left_semi").withColumn("old", F.lit(True)))
        size = whole.agg(F.sum(F.length("context"))).first()[0] or 0
        bucketed = whole.withColumn("bucket", F.pmod("h", F.lit(max(1, size // BUCKET_BYTES)))).drop("h")
        matched = bucketed.groupBy("bucket").applyInArrow(lambda t: match_bucket(t, length), _MATCH)
        known = sent.filter(F.col("kind") == _KNOWN).select("doc_id", "text_hash", "start", "n")
        runs = matched.unionAll(known).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
        runs = keep(runs, "runs")
        merged, size, levels = own, own.count(), list(levels)
        while levels and levels[-1].count() < 2 * size:
            merged = levels.pop().unionByName(merged)
            size = merged.count()
        return runs, [*levels, keep(merged, "level")]


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text_hash, runs): runs (start, n) of windows of keyed documents that also start earlier."""
    named = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "text_hash")
    counts = stash(anchors(named, length).groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1"), "anchors")
    repeated, hot = bloom.build(counts.select("h")), bloom.build(counts.filter(F.col("n") > HOT).select("h"))
    sent = stash(contexts(named, repeated, hot, length), "contexts")

    size = sent.filter(F.col("kind") == _CONTEXT).agg(F.sum(F.length("context"))).first()[0] or 0
    buckets = max(1, size // BUCKET_BYTES)
    in_buckets = sent.filter(F.col("kind") == _CONTEXT).select("doc_id", "text_hash", "start", "n", "lead", "context", F.pmod("h", F.lit(buckets)).alias("bucket"))
    matched = in_buckets.groupBy("bucket").applyInArrow(lambda t: match_bucket(t, length), _MATCH)

    single = sent.filter(F.col("kind") == _WINDOW).select("doc_id", "text_hash", "start", "n", "w", "v")
    first = single.groupBy("w", "v").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("k")).filter("k > 1")
    later = single.join(first, ["w", "v"]).filter(F.struct("doc_id", "start") > F.col("first")).select("doc_id", "text_hash", "start", "n")

    known = sent.filter(F.col("kind") == _KNOWN).select("doc_id", "text_hash", "start", "n")
    runs = matched.unionAll(later).unionAll(known)
    return runs.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def _stay(size: int, runs: list | None, length: int) -> np.ndarray:
    cut = np.zeros(size + 1, np.int64)
    for r in runs or []:
        cut[r["start"]] += 1
        cut[r["start"] + r["n"] + length - 1] -= 1
    return np.cumsum(cut)[:-1] == 0


DIGEST_TYPE = "struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string>"


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(text: pa.Array, runs: pa.Array, skip: pa.Array) -> pa.Array:
        out: tuple[list, ...] = ([], [], [], [])
        for t, r, passed in zip(text, runs, skip.to_pylist(), strict=True):
            data = np.frombuffer(b"" if passed else t.as_py().encode(), np.uint8)
            stay = _stay(len(data), r.as_py(), length)
            spans = int(np.count_nonzero(~stay[1:] & stay[:-1]) + (len(stay) > 0 and not stay[0]))
            values = (len(data), int(np.count_nonzero(~stay)), spans, hashlib.sha256(data[stay].tobytes()).hexdigest())
            for column, value in zip(out, values, strict=True):
                column.append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
        return pa.StructArray.from_arrays(columns, ["n_bytes", "n_removed", "n_spans", "kept_sha256"], mask=pa.array(skip.to_numpy(zero_copy_only=False)))

    whole = keyed(docs)
    return with_matches(whole, lambda: repeats(whole, length), "runs", run, DIGEST_TYPE).select("doc_id", "done.*")


def strip(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text): the texts without the repeated bytes; characters that lose a byte go whole."""

    def run(text: pa.Array, runs: pa.Array, skip: pa.Array) -> pa.Array:
        out = []
        for t, r, passed in zip(text, runs, skip.to_pylist(), strict=True):
            data = np.frombuffer(b"" if passed else t.as_py().encode(), np.uint8)
            out.append(data[_stay(len(data), r.as_py(), length)].tobytes().decode(errors="ignore"))
        return pa.StructArray.from_arrays([pa.array(out, pa.string())], ["text"], mask=pa.array(skip.to_numpy(zero_copy_only=False)))

    whole = keyed(docs)
    return with_matches(whole, lambda: repeats(whole, length), "runs", run, "struct<text: string>").select("doc_id", "done.text")
