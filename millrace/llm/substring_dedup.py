"""Removal of repeated passages by fixed-block anchors.

A passage is a window of ``window`` consecutive words. Each document is cut into non-overlapping
reference blocks of half a window, so a window of an earlier document holds one of its blocks
whole. The blocks are indexed; every rolling window of a block's length of every document probes
the index. A block that another document holds too is *shared*: around each place where a shared
block occurs, the hit is extended to whole windows, and equal windows are grouped. A word goes if
a window over it also starts in a document with a smaller id; neighbouring such windows make up the
maximal repeats.

The index is first used as a bounded filter inside the scan (see bloom), so that only a few
probes are shuffled; probes and windows are grouped with partial aggregation, which takes hot
passages, and pairs of documents are never formed. The texts are read again instead of being stored or
shuffled: once for the windows' least documents, once for the places of those windows that do repeat.
Texts that lose nothing stay in their tasks.

Words are hashed to 64 bits, windows to 96 bits of the sequence of word hashes.

Edge cases: null and empty texts have no words; texts shorter than a window lose nothing; rows may
repeat, and rows with one id count as one document; rows without an id are left whole and are no
reference; an empty table gives an empty result. Extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.lineage import stash

from . import bloom
from . import textbytes as tb
from .keys import keyed, with_matches

WINDOW = 50


def _words(batch: pa.RecordBatch, limit: int = tb.SLICE_BYTES) -> Iterator[tuple]:
    """(doc_id of each row, word hashes, first word of each row) of slices of a batch with doc_id and text."""
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    for lo, hi, data, offsets in tb.slices(batch.column("text"), limit):
        starts, ends, first = tb.word_spans(data, offsets)
        yield ids[lo:hi], tb.span_hashes(data, starts, ends), first


def _frame(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def blocks(docs: DataFrame, size: int) -> DataFrame:
    """(h): the hash of each reference block, the non-overlapping runs of ``size`` words."""

    def run(batches):
        for batch in batches:
            for _, words, first in _words(batch):
                count = np.diff(first) // size
                at = tb.spread(np.zeros(len(count), np.int64), count) * size + np.repeat(first[:-1], count)
                if len(at):
                    yield _frame(h=tb.gram_hashes(words, size)[at].view(np.int64))

    return docs.select("doc_id", "text").mapInArrow(run, "h bigint")


def probes(docs: DataFrame, size: int, index) -> DataFrame:
    """(h, doc_id, own): every rolling window of ``size`` words that may be in the index; ``own`` for
    those that are the document's own reference blocks."""

    def run(batches):
        for batch in batches:
            for ids, words, first in _words(batch):
                at = tb.whole_grams(first, size)
                h = tb.gram_hashes(words, size)[at]
                row = tb.rows_of(first)[at]
                hit = index.value.contains(h) if index else np.ones(len(h), bool)
                at, h, row = at[hit], h[hit], row[hit]
                if len(at):
                    yield _frame(h=h.view(np.int64), doc_id=ids[row].astype(np.int64), own=(at - first[row]) % size == 0)

    return docs.select("doc_id", "text").mapInArrow(run, "h bigint, doc_id bigint, own boolean")


def shared_blocks(probed: DataFrame) -> DataFrame:
    """(h): blocks of a document that a document with a greater id holds too."""
    least = F.min(F.when(F.col("own"), F.col("doc_id")))
    return probed.groupBy("h").agg(least.alias("least"), F.max("doc_id").alias("last")).filter("least < last").select("h")


def windows(docs: DataFrame, window: int, size: int, shared, repeated=None) -> DataFrame:
    """(w, v, doc_id, text_hash, pos): the windows around every place where a shared block occurs, named by two
    hashes; with ``repeated``, only those whose first hash is in that filter."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text_hash").to_numpy(zero_copy_only=False)
            row0 = 0
            for ids, words, first in _words(batch):
                hashes = texts[row0 : row0 + len(ids)]
                row0 += len(ids)
                at = tb.whole_grams(first, size)
                if shared:
                    at = at[shared.value.contains(tb.gram_hashes(words, size)[at])]
                near = np.zeros(len(words) + 1, np.int64)  # a window holds the block if it starts up to window - size before it
                np.add.at(near, np.maximum(at - (window - size), 0), 1)
                np.add.at(near, at + 1, -1)
                starts = tb.whole_grams(first, window)
                starts = starts[np.cumsum(near)[starts] > 0]
                w = tb.gram_hashes(words, window)[starts]
                if repeated and len(starts):
                    held = repeated.value.contains(w)
                    starts, w = starts[held], w[held]
                if len(starts):
                    row = tb.rows_of(first)[starts]
                    v = tb.gram_hashes(tb.mix(words ^ np.uint64(window)), window)[starts]
                    yield _frame(
                        w=w.view(np.int64),
                        v=(v >> np.uint64(32)).astype(np.uint32).view(np.int32),
                        doc_id=ids[row].astype(np.int64),
                        text_hash=hashes[row].astype(np.int64),
                        pos=(starts - first[row]).astype(np.int32),
                    )

    return docs.select("doc_id", "text", "text_hash").mapInArrow(run, "w bigint, v int, doc_id bigint, text_hash bigint, pos int")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, starts): for keyed documents, the windows that also start in a document with a smaller id."""
    size = window // 2
    named = docs.filter("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    index = bloom.build(blocks(named, size).distinct())
    shared = bloom.build(shared_blocks(probes(named, size, index)))
    found = windows(named, window, size, shared).select("w", "v", "doc_id").groupBy("w", "v").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"))
    repeated = stash(found.filter("least < last").select("w", "v", "least"), "repeated")
    places = windows(named, window, size, shared, bloom.build(repeated.select("w")))
    later = places.join(repeated, ["w", "v"]).filter("doc_id > least")
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("starts"))


def _gone(first: np.ndarray, rows: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    return tb.covered(int(first[-1]), first[rows] + starts, window)


def kept_text(data: np.ndarray, offsets: np.ndarray, starts: pa.Array, window: int) -> Iterator[tuple[int, int, bytes]]:
    """For each row: its words, the words removed, and the bytes of those that stay, joined by one space."""
    begin, end, first = tb.word_spans(data, offsets)
    lengths = pc.fill_null(pc.list_value_length(starts), 0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(starts)), lengths)
    gone = _gone(first, rows, starts.flatten().to_numpy(zero_copy_only=False), window)
    raw = data.tobytes()
    for r in range(len(offsets) - 1):
        lo, hi = first[r], first[r + 1]
        stay = np.flatnonzero(~gone[lo:hi]) + lo
        yield hi - lo, hi - lo - len(stay), b" ".join([raw[i:j] for i, j in zip(begin[stay].tolist(), end[stay].tolist(), strict=True)])


DIGEST_TYPE = "struct<n_words: bigint, n_removed: bigint, kept_sha256: string>"


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256."""

    def run(text: pa.Array, starts: pa.Array, skip: pa.Array) -> pa.Array:
        out: tuple[list, list, list] = ([], [], [])
        passed = skip.to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in tb.slices(pc.if_else(skip, None, text)):
            for n, gone, kept in kept_text(data, offsets, starts.slice(lo, hi - lo), window):
                for column, value in zip(out, (int(n), int(gone), hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
        types = (pa.int64(), pa.int64(), pa.string())
        columns = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
        return pa.StructArray.from_arrays(columns, ["n_words", "n_removed", "kept_sha256"], mask=pa.array(passed))

    whole = keyed(docs)
    return with_matches(whole, lambda: repeats(whole, window), "starts", run, DIGEST_TYPE).select("doc_id", "done.*")


def strip(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words taken out of their texts, otherwise as they are. The white space
    between two words that stay next to each other stays too; a text that loses nothing is unchanged."""

    def run(text: pa.Array, starts: pa.Array, skip: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for t, s, passed in zip(text, starts, skip.to_pylist(), strict=True):
            if passed or not s.is_valid:
                out.append(None if passed else t.as_py())
                continue
            data = np.frombuffer(t.as_py().encode(), np.uint8)
            begin, end, first = tb.word_spans(data, np.array([0, len(data)]))
            at = np.array(s.as_py(), np.int64)
            gone = _gone(first, np.zeros(len(at), np.int64), at, window)
            # Each removed word goes with the white space before it.
            cut = np.zeros(len(data) + 1, np.int64)
            before = np.concatenate([[0], end[:-1]])
            np.add.at(cut, before[gone], 1)
            np.add.at(cut, end[gone], -1)
            out.append(data[np.cumsum(cut)[:-1] == 0].tobytes().decode())
        return pa.StructArray.from_arrays([pa.array(out, pa.string())], ["text"], mask=pa.array(skip.to_numpy(zero_copy_only=False)))

    names = docs.columns
    whole = docs.withColumnsRenamed({c: f"{c}__" for c in names if c not in ("doc_id", "text")}).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    done = with_matches(whole, lambda: repeats(keyed(docs), window), "starts", run, "struct<text: string>").withColumn("text", F.col("done.text"))
    return done.select(*(c if c in ("doc_id", "text") else F.col(f"{c}__").alias(c) for c in names))
