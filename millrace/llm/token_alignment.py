"""Alignment of two tokenizers' tokens: byte-level BPE (A) and a sentence-piece model (B).

The tokens of a text under A and under B are the two sides of a graph, with a *link* wherever the byte
ranges of an A token and a B token overlap. Its connected components, found by union-find, are the minimal
groups: the shortest runs of A tokens and of B tokens that spell the same bytes. The members of a component
are expanded into its links, and the links are counted by id pair over the whole corpus.

Spread over the cluster:

1. ``slices``: runs of documents with about ``SLICE_BYTES`` of text are encoded in their tasks. Both tokenizers
   begin anew at a single blank between two characters that are no white space (checked for the vocabulary in
   hand), so the distinct parts between such blanks are encoded and linked once a slice, and those met
   twice once for the slices of a task, as far as there is room. A slice is kept as one
   row: its table of distinct id pairs with the number of documents that hold each, and for each document the
   table's entries it holds, and how often.
2. ``pair_counts``: the slices' numbers are added up by pair; an A id's best pair is found among at most as
   many pairs as B has ids.
3. ``digests``: each slice asks once for each entry of its table; the answers come back to the slice's row,
   where the documents' sums are made. A pair that all documents hold is one row for each slice, so no key is
   hot, and nothing is broadcast but the two vocabularies.

Memory: a task holds the tokens of one slice, or of one text if that is longer, and of the table of slices one file of ``FILE_SLICES``; a part without such blanks is
handed to the tokenizers whole.

Edge cases: a text that is null or empty, or that either tokenizer does not give back byte by byte with a
leading blank, has no tokens: zeros and an empty digest. Repeated rows count as documents of their own; ids may
be null; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.lineage import stash

from . import textbytes as tb
from .keys import small_batches

SLICE_BYTES = 1 << 20
#: Slices of a file: a task that reads them holds a file's at once.
FILE_SLICES = 8
#: Linked parts that a worker keeps for the slices that follow.
MOST_PARTS = 1 << 17
#: Parts that the libraries get at a time, as one text where that falls into them again.
_AT_ONCE = 256
#: A blank between two characters that no Unicode table takes for white space.
_CUT = re.compile(r" (?<=[!-~\w] )(?=[!-~\w])")
_BLANK = "▁"
MARKS = (",", "|", ";", "")
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


class Tokenizers:
    """The two libraries with the bytes of every id."""

    def __init__(self, byte_bpe: str, piece_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        from .bpe_automaton import _byte_symbols

        self.a = Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True  # their strings in a text are then ordinary text
        number = {x: b for b, x in enumerate(_byte_symbols())}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(number[x] for x in token)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        found = [_BYTE_PIECE.fullmatch(p) for p in pieces]
        self.b_bytes = [bytes([int(m[1], 16)]) if m else p.replace(_BLANK, " ").encode() for p, m in zip(pieces, found, strict=True)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        #: Ids as text with the mark that may follow, one list of all ids for each mark.
        self.most = max(len(self.a_bytes), len(pieces))
        self.said = [f"{i}{m}" for m in MARKS for i in range(self.most)]
        #: Whether no piece goes on behind a blank that follows something else.
        self.parts = not any(_BLANK in p.lstrip(_BLANK) for p in pieces)

    def cut(self, text: str) -> list[str]:
        """Parts of ``text`` that can be encoded on their own; the blanks between them are left out, as each part gets one."""
        return _CUT.split(text) if self.parts else [text]

    def encode(self, parts: list[str]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Which parts both give back with a leading blank, and by A and by B their tokens: (where each part's begin, one more at the end; the ids)."""
        told = []
        for few in (parts[i : i + _AT_ONCE] for i in range(0, len(parts), _AT_ONCE)):
            whole = self._joined(few)
            told += [whole] if whole else [self._joined([p]) or self._alone(p) for p in few]
        ok, n_a, a, n_b, b = (np.concatenate([x[i] for x in told] or [np.zeros(0, np.int64)]) for i in range(5))
        return ok.astype(bool), (np.concatenate([[0], np.cumsum(n_a)]), a), (np.concatenate([[0], np.cumsum(n_b)]), b)

    def _both(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of a blank and a text, if both give it back."""
        by_a, by_b = self.a.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids, self.b.encode(text)
        want = f" {text}".encode()
        for ids, table in ((by_a, self.a_bytes), (by_b, self.b_bytes)):
            if b"".join(map(table.__getitem__, ids)) != want:
                return None
        return np.array(by_a, np.int64), np.array(by_b, np.int64)

    def _joined(self, parts: list[str]) -> tuple | None:
        """Several parts as one text, if it falls into them."""
        text = " ".join(parts)
        if len(parts) > 1 and self.cut(text) != parts or not (found := self._both(text)):
            return None
        ends, counts = np.cumsum([len(p.encode()) + 1 for p in parts]), []
        for ids, size in zip(found, (self.a_size, self.b_size), strict=True):
            at = np.cumsum(size[ids])
            last = np.searchsorted(at, ends)
            if (at[last] != ends).any():
                return None
            counts.append(np.diff(last, prepend=-1))
        return np.ones(len(parts), np.int64), counts[0], found[0], counts[1], found[1]

    @staticmethod
    def _alone(part: str) -> tuple:
        """A part that is not given back: no tokens."""
        none = np.zeros(0, np.int64)
        return np.zeros(1, np.int64), np.zeros(1, np.int64), none, np.zeros(1, np.int64), none


@lru_cache(maxsize=2)
def _tokenizers(byte_bpe: str, piece_model: bytes) -> Tokenizers:
    return Tokenizers(byte_bpe, piece_model)


def read_vocabularies(spark: SparkSession, byte_bpe: str, piece_model: str):
    """Both vocabulary files as one broadcast value: its size is that of the files, whatever the input."""
    with open(byte_bpe, encoding="utf-8") as a, open(piece_model, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component in the graph of ``n`` nodes with the edges u[i]-v[i], by union-find:
    greater roots are hooked below smaller ones, then every path is halved until it is flat."""
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above
    return parent


class Links(NamedTuple):
    """Parts of texts with their tokens, linked. ``first_*``: where each part's own ones begin, one more at the end."""

    ok: np.ndarray  # whether both tokenizers give back the part's bytes; the others have nothing below
    first_a: np.ndarray
    a: np.ndarray  # token ids
    first_b: np.ndarray
    b: np.ndarray
    first_link: np.ndarray
    link_a: np.ndarray  # the tokens of each link, as places in a and b
    link_b: np.ndarray
    group_a: np.ndarray  # the group of each token, counted from 0 over all parts
    group_b: np.ndarray


def link(parts: list[str], t: Tokenizers) -> Links:
    """Encode each part and link its tokens."""
    ok, (first_a, a), (first_b, b) = t.encode(parts)
    end_a, end_b = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    # Between two neighbouring ends lie bytes of exactly one A token and one B token: a link.
    ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
    ends = ends[np.diff(ends, prepend=0) > 0]
    link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    root = components(link_a, link_b + len(a), len(a) + len(b))
    roots, group = np.unique(root, return_inverse=True)
    # A part's last link is that of its last A token.
    first_link = np.concatenate([[0], np.searchsorted(link_a, first_a[1:])])
    return Links(ok, first_a, a, first_b, b, first_link, link_a, link_b, group[: len(a)], group[len(a) :])


def group_strings(x: Links, t: Tokenizers) -> list[str]:
    """Each part's groups as ``a1,a2|b1;a3|b2,b3``."""
    ids, group = np.concatenate([x.a, x.b]), np.concatenate([x.group_a, x.group_b])
    side = np.repeat([0, 1], [len(x.a), len(x.b)])
    order = np.argsort(group, kind="stable")  # a group's A tokens stand before its B tokens
    ids, group, side = ids[order], group[order], side[order]
    cut = x.first_a + x.first_b
    mark = np.zeros(len(ids), np.int64)
    if len(ids):
        mark[:-1][side[:-1] != side[1:]] = MARKS.index("|")
        mark[:-1][group[:-1] != group[1:]] = MARKS.index(";")
        mark[cut[1:][cut[1:] > 0] - 1] = MARKS.index("")
    said = list(map(t.said.__getitem__, (ids + mark * t.most).tolist()))
    return ["".join(said[lo:hi]) for lo, hi in itertools.pairwise(cut.tolist())]


class Parts(NamedTuple):
    """What a slice needs of each distinct part: whether it is given back, its numbers of tokens and groups, its links as id pairs, its groups' string."""

    ok: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    pairs: np.ndarray
    strings: list[str]

    def first(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.n_links)])

    def taken(self, which: np.ndarray) -> Parts:
        """Some of them, in order."""
        at = tb.spread(self.first()[which], self.n_links[which])
        return Parts(*(x[which] for x in self[:5]), self.pairs[at], [self.strings[i] for i in which.tolist()])

    def with_(self, more: Parts) -> Parts:
        return Parts(*(np.concatenate(x) for x in zip(self[:6], more[:6], strict=True)), self.strings + more.strings)


def parts_of(x: Links, t: Tokenizers) -> Parts:
    groups = np.zeros(len(x.ok), np.int64)
    np.add.at(groups, tb.rows_of(x.first_a), np.diff(x.group_a, prepend=-1) != 0)
    pairs = x.a[x.link_a] << 32 | x.b[x.link_b]
    return Parts(x.ok, np.diff(x.first_a), np.diff(x.first_b), groups, np.diff(x.first_link), pairs, group_strings(x, t))


class Known:
    """Parts that a worker has met twice in a slice, for the slices that follow; begun anew when there are too many."""

    def __init__(self, t: Tokenizers) -> None:
        self.t = t
        self.number: dict[str, int] = {}
        self.parts = parts_of(link([], t), t)

    def look_up(self, said: list[str], ends: set[str] = frozenset()) -> tuple[Parts, np.ndarray]:
        """The parts in hand, and the place of each of ``said`` among them; ``ends``: those that begin or end a text."""
        fresh = dict.fromkeys(said)
        for p in fresh.keys() & self.number.keys():
            del fresh[p]
        held = len(self.number)
        for p in fresh.keys() & ends:  # some of those can't be joined; they come last
            del fresh[p]
            fresh[p] = None
        own = dict(zip(fresh, itertools.count(held), strict=False))
        codes = np.fromiter(map((self.number | own).__getitem__, said), np.int64, len(said))
        new = parts_of(link(list(own), self.t), self.t)
        both = self.parts.with_(new)
        often = np.flatnonzero(np.bincount(codes[codes >= held] - held, minlength=len(own)) > 1)
        if held + len(often) > MOST_PARTS:
            self.number, self.parts, held = {}, parts_of(link([], self.t), self.t), 0
        names = list(own)
        self.number.update(zip([names[i] for i in often[:MOST_PARTS].tolist()], itertools.count(held), strict=False))
        self.parts = self.parts.with_(new.taken(often[:MOST_PARTS]))
        return both, codes


def _sums(values: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return tb.sums(values[codes], bounds)


_SLICE = (
    "slice bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, "
    "first array<int>, entry array<int>, times array<int>, pair array<bigint>, holds array<bigint>"
)


def _slice(ids: list, texts: list[str], known: Known) -> dict[str, list]:
    """One slice's row, but for its number."""
    said = [known.t.cut(x) if x else [] for x in texts]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in said])]).astype(np.int64)
    parts, codes = known.look_up(list(itertools.chain.from_iterable(said)), {p for x in said for p in (*x[:1], *x[-1:])})
    # A text with a part that is not given back has no tokens at all.
    whole = _sums((~parts.ok).astype(np.int64), codes, bounds) == 0
    row = tb.rows_of(bounds)
    codes, row = codes[whole[row]], row[whole[row]]
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    strings = list(map(parts.strings.__getitem__, codes.tolist()))
    digest = [hashlib.sha256(";".join(strings[lo:hi]).encode()).hexdigest() if hi > lo else "" for lo, hi in itertools.pairwise(bounds.tolist())]
    used, codes = np.unique(codes, return_inverse=True)
    parts = parts.taken(used)
    pair, entry = np.unique(parts.pairs, return_inverse=True)
    at = tb.spread(parts.first()[codes], parts.n_links[codes])
    held, times = np.unique(np.repeat(row, parts.n_links[codes]) * len(pair) + entry[at], return_counts=True)
    of, entry = held // max(len(pair), 1), held % max(len(pair), 1)
    return {
        "doc_id": ids,
        "n_a": _sums(parts.n_a, codes, bounds),
        "n_b": _sums(parts.n_b, codes, bounds),
        "n_groups": _sums(parts.n_groups, codes, bounds),
        "n_links": _sums(parts.n_links, codes, bounds),
        "groups_sha256": digest,
        "first": np.searchsorted(of, np.arange(len(texts) + 1)),
        "entry": entry,
        "times": times,
        "pair": pair,
        "holds": np.bincount(entry, minlength=len(pair)),
    }


def _record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([columns[f.name]], f.type) for f in schema], schema=schema)


def slices(docs: DataFrame, vocabularies, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The first step: a row for each slice. To be written once, as slices are numbered by task."""
    number = pa.int64()
    lists = {"groups_sha256": pa.string(), "first": pa.int32(), "entry": pa.int32(), "times": pa.int32()}
    schema = pa.schema([("slice", number), *((c.split()[0], pa.list_(lists.get(c.split()[0], number))) for c in _SLICE.split(", ")[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(_tokenizers(*vocabularies.value))
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, _, _ in tb.slices(batch.column("text"), slice_bytes):
                texts = batch.column("text").slice(lo, hi - lo).to_pylist()
                yield _record(schema, slice=n, **_slice(ids.slice(lo, hi - lo).to_pylist(), texts, known))
                n += 1

    return small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _SLICE)


def pair_counts(sliced: DataFrame) -> DataFrame:
    """(pair, a, b, n_docs, best): in how many documents each pair of ids is linked, and whether no pair of its A id is in more."""
    each = sliced.select(F.explode(F.arrays_zip("pair", "holds")).alias("x")).select("x.pair", "x.holds")
    counts = each.groupBy("pair").agg(F.sum("holds").alias("n_docs")).withColumn("a", F.shiftrightunsigned("pair", 32))
    most = F.max("n_docs").over(Window.partitionBy("a"))
    return counts.select("pair", "a", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n_docs", (F.col("n_docs") == most).alias("best"))


def digests(docs: DataFrame, vocabularies, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    sliced = stash(slices(docs, vocabularies, slice_bytes), "slices", FILE_SLICES)
    counts = pair_counts(sliced).select("pair", "n_docs", "best")
    asked = sliced.select("slice", F.posexplode("pair").alias("at", "pair"))
    told = asked.join(counts, "pair").groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("at", "n_docs", "best"))).alias("told"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    both = sliced.select("slice", *names, "first", "entry", "times").join(told, "slice", "left")
    kept = pa.schema([(c, pa.string() if c == "groups_sha256" else pa.int64()) for c in [*names, "n_best", "count_sum"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                x = {c: batch.column(c).slice(i, 1).flatten() for c in [*names, "first", "entry", "times", "told"]}
                at, times, bounds = (x[c].to_numpy(zero_copy_only=False) for c in ("entry", "times", "first"))
                n, best = (x["told"].field(k).to_numpy(zero_copy_only=False) for k in ("n_docs", "best"))
                sums = [tb.sums(times * v[at].astype(np.int64) if len(at) else np.zeros(0, np.int64), bounds) for v in (best, n)]
                yield pa.RecordBatch.from_arrays([*(x[c] for c in names), *map(pa.array, sums)], schema=kept)

    kinds = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'bigint'}" for c in [*names, "n_best", "count_sum"])
    return both.mapInArrow(run, kinds)


GROUPS_TYPE = "array<struct<a: array<int>, b: array<int>, bytes: int>>"


def groups(text: Column, vocabularies) -> Column:
    """Each text's minimal groups in order: the ids of A and of B, and the number of bytes they spell; an empty array without tokens."""

    def one(text: str | None, t: Tokenizers) -> list[dict]:
        x = link(t.cut(text), t) if text else None
        if x is None or not x.ok.all():
            return []
        out: list[dict] = []
        for side, group, ids in (("a", x.group_a, x.a), ("b", x.group_b, x.b)):
            for g, i in zip(group.tolist(), ids.tolist(), strict=True):
                if g == len(out):
                    out.append({"a": [], "b": [], "bytes": 0})
                out[g][side].append(i)
                out[g]["bytes"] += len(t.a_bytes[i]) * (side == "a")
        return out

    def run(texts: pa.Array) -> pa.Array:
        t = _tokenizers(*vocabularies.value)
        ids = pa.list_(pa.int32())
        return pa.array([one(x.as_py(), t) for x in texts], pa.list_(pa.struct([("a", ids), ("b", ids), ("bytes", pa.int32())])))

    return F.arrow_udf(run, GROUPS_TYPE).asNondeterministic()(text)
