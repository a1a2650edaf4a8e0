"""Alignment of two tokenizers against whole-text encoding by their libraries."""

import random

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm import token_alignment
from millrace.llm.queries import BYTE_BPE, PIECE_MODEL
from pyspark.sql import functions as F

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, slice int, pair string, n_a int"


@pytest.fixture(scope="module")
def both():
    with open(FILES[0], encoding="utf-8") as a, open(FILES[1], "rb") as b:
        return token_alignment.Tokenizers(a.read(), b.read())


def texts():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdéhlnorstÄ") for _ in range(r.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    odd = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\tb", "it's 's  x", "<|endoftext|> is <s> text</s>", "a ▁ b", "▁", "x y 　z", "日本語 のテキスト", "\U0001f600 ́e é"]
    odd += ["\x00 \x1c a \x85 b ᠎ c", "a  b", "  x", "... ... !", "12 345 6789", "<0x41> <unk>"]
    base = prose(300)
    return odd + [base, base, "a" * 3000, "ab " * 2000, prose(6000)] + [prose(r.randint(1, 80)) for _ in range(40)]


def expected(rows):
    return sorted((repr(rows[k][0]), *v) for k, v in brute.alignments(rows, *FILES).items())


def got(spark, docs, **options):
    out = token_alignment.digests(docs, token_alignment.read_vocabularies(spark, *FILES), **options)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    return sorted((repr(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in out.collect())


@pytest.mark.parametrize("slice_bytes", [1, 2000, 4 << 20])
def test_digests_against_whole_texts(spark, slice_bytes):
    """Nulls, empty and long texts, repeated rows, ids that are null or occur twice, clashing columns; slices of every size."""
    rows = [(i, t, 1, "p", 2) for i, t in enumerate(texts())] + [(None, "no id here", 1, "p", 2), (3, "a second three", 1, "p", 2)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(spark, docs, slice_bytes=slice_bytes) == expected({k: (r[0], r[1]) for k, r in enumerate(rows)})


def test_files_of_slices_are_small(spark, monkeypatch):
    """A task that reads a table holds the rows of a file at once, and slices are large."""
    made = []
    stash = token_alignment.stash
    monkeypatch.setattr(token_alignment, "stash", lambda *x, **named: made.append(stash(*x, **named)) or made[-1])
    rows = [(i, f"text {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert got(spark, docs, slice_bytes=1) == expected(dict(enumerate(rows)))
    held = [r["count"] for r in made[0].groupBy(F.input_file_name()).count().collect()]
    assert sum(held) == 100 and max(held) <= token_alignment.FILE_SLICES


def test_store_of_parts_is_bounded(both, monkeypatch):
    monkeypatch.setattr(token_alignment, "MOST_PARTS", 3)
    known = token_alignment.Known(both)
    for said in (["a", "b", "a", "b", "c"], ["c", "a", "d", "d", "c"], ["x", "x", "y", "y", "z", "z", "w", "w"], ["w", "x", "a"], []):
        parts, codes = known.look_up(said)
        assert len(known.number) <= 3 and len(known.parts.ok) == len(known.number)
        alone = token_alignment.parts_of(token_alignment.link(said, both), both)
        got = parts.taken(codes)
        assert got.strings == alone.strings and got.pairs.tolist() == alone.pairs.tolist() and got.n_groups.tolist() == alone.n_groups.tolist()


def test_empty_table(spark):
    assert got(spark, spark.createDataFrame([], SCHEMA)) == []
    assert got(spark, spark.createDataFrame([(1, None, 1, "", 1)], SCHEMA)) == [("1", 0, 0, 0, 0, 0, 0, "")]


def test_registered_files():
    assert (BYTE_BPE, PIECE_MODEL) == FILES


def test_query_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {k: (r["doc_id"], r["text"]) for k, r in enumerate(docs.collect())}
    assert got(spark, docs) == expected(rows)


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=40) | st.text(alphabet="ab' s\n\t▁.1é", max_size=60))
def test_parts_are_encoded_as_in_the_whole_text(both, text):
    parts = both.cut(text)
    ok, (_, a), (_, b) = both.encode(parts)
    want = both.a.encode(f" {text}", add_special_tokens=False).ids, both.b.encode(text)
    spelled = [b"".join(t[i] for i in ids) == f" {text}".encode() for t, ids in ((both.a_bytes, want[0]), (both.b_bytes, want[1]))]
    assert ok.all() == all(spelled)
    assert not ok.all() or (a.tolist(), b.tolist()) == want


def test_components():
    r = np.random.default_rng(1)
    u, v = r.integers(0, 300, 250), r.integers(0, 300, 250)
    least = list(range(300))
    for _ in range(300):
        for x, y in zip(u, v, strict=True):
            least[x] = least[y] = min(least[x], least[y])
    assert token_alignment.components(u, v, 300).tolist() == least


def test_groups_spell_the_text(spark, both):
    rows = [(i, t) for i, t in enumerate(texts())]
    groups = token_alignment.groups(F.col("text"), token_alignment.read_vocabularies(spark, *FILES))
    for text, found in spark.createDataFrame(rows, "doc_id bigint, text string").select("text", groups).collect():
        for g in found:
            a, b = (b"".join(t[i] for i in g[s]) for t, s in ((both.a_bytes, "a"), (both.b_bytes, "b")))
            assert a == b and len(a) == g["bytes"]
        if found:
            assert b"".join(both.a_bytes[i] for g in found for i in g["a"]) == f" {text}".encode()
