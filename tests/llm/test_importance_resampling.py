"""Importance resampling against plain Python."""

import random
import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm import importance_resampling as ir

SCHEMA = "doc_id bigint, text string, score int, hi int, weight string"


def texts():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdéhlnorstÄ7") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = prose(60)
    return [None, "", " ?! ", "one", "x" * 5000, "y" * 64 + " " + "z" * 65, base, base, base.upper(), prose(20000)] + [prose(r.randint(1, 60)) for _ in range(120)]


@pytest.fixture(scope="module")
def rows():
    rows = [(i, t) for i, t in enumerate(texts())]
    return rows + [(None, rows[9][1]), (None, rows[9][1]), (50, rows[50][1]), (51, "another text of id 51 " * 9), (-(1 << 63), "least " * 25), ((1 << 63) - 1, "most " * 25)]


@pytest.fixture(scope="module")
def target():
    r = random.Random(9)
    return [" ".join(r.choice("abcdé") + r.choice("abn7") for _ in range(30)) for _ in range(20)] + [None, ""]


def in_order(found):
    return sorted((tuple(r) for r in found), key=repr)


@pytest.mark.parametrize("options", [{}, {"percent": 37, "most_run": 3, "buckets": 97, "least_words": 0, "seed": 1}, {"percent": 100}, {"percent": 0}])
def test_against_plain_python(spark, rows, target, options):
    """Nulls, empty and long texts and words, ties, repeated rows, clashing columns, the ends of the ids' range."""
    docs = spark.createDataFrame([(i, t, 1, 2, "w") for i, t in rows], SCHEMA).repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    out = ir.resample(docs, goal, **options)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    settings_ = {"percent": 10, "most_run": 1, "buckets": 10000, "least_words": 20, "seed": 2024} | options
    assert in_order(out.collect()) == in_order(brute.resampled(rows, target, **settings_))


def test_empty_tables(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert ir.resample(none, none.select("text")).collect() == []
    expected = brute.resampled(rows, [], 10, 1, 10000, 20, 2024)
    assert in_order(ir.resample(docs, none.select("text")).collect()) == in_order(expected)


def test_runs_do_not_cross_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id bigint, text string").coalesce(1)
    found = {r["bucket"] for r in ir.bucket_counts(docs, 2, 1 << 20).collect()}
    assert found == {zlib.crc32(x) % (1 << 20) for x in (b"a", b"b", b"c", b"d", b"a b", b"c d")}


@pytest.mark.parametrize("bits", [5, 12])
def test_last_key(spark, bits):
    """The k-th key for every k, over keys that differ in either part, with ties and both ends of the range."""
    r = random.Random(bits)
    edge = [-(1 << 63), -1, 0, (1 << 63) - 1]
    for keys in (
        [(r.choice([3, 4, 70000]), r.randrange(5)) for _ in range(12)],
        [(r.choice(edge), r.choice(edge)) for _ in range(9)],
        [(7, r.randrange(1 << 40)) for _ in range(9)],
        [(5, 5)] * 4,
    ):
        table = spark.createDataFrame(keys, "hi bigint, lo bigint").coalesce(1)
        order = sorted(keys, key=lambda k: tuple(x % (1 << 64) for x in k))
        ks = (1, len(keys) // 2, len(keys) - 1, len(keys)) if bits == 12 else (len(keys) // 2,)
        assert [ir.last_key(table, k, bits) for k in ks] == [order[k - 1] for k in ks]
        assert ir.last_key(table, 0, bits) is None and ir.last_key(table, len(keys) + 1, bits) is None


@settings(max_examples=100, deadline=None)
@given(spans=st.lists(st.binary(max_size=90), max_size=20))
def test_crc32s(spans):
    ends = np.cumsum([len(s) for s in spans]).astype(np.int64)
    starts = ends - np.array([len(s) for s in spans], np.int64)
    assert ir.crc32s(np.frombuffer(b"".join(spans), np.uint8), starts, ends).tolist() == [zlib.crc32(s) for s in spans]


def test_draw_leans_to_the_target(spark):
    """Among documents of one word each, those of the target are drawn far more often."""
    rows = [(i, " ".join(["alpha" if i % 5 == 0 else "beta"] * 20)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    drawn = ir.resample(docs, spark.createDataFrame([("alpha " * 50,)], "text string"), percent=10).filter("rank is not null").collect()
    assert len(drawn) == 60 and all(r["doc_id"] % 5 == 0 for r in drawn)
