"""The registered queries against SQL, and the pipeline against plain Python, on the smallest tables."""

import brute
import corpus_pipeline
import pytest
from compare import connect, differences
from millrace.llm import quality_rules
from millrace.llm.queries import QUERIES, VOCABULARY
from millrace.llm.sql import ORACLES
from tokenizers import Tokenizer


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, sf_dir, name):
    assert not differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])


def _documents(folder, spark, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality int, n_tokens string, found int, w string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("i", "an item that no document of this table holds at all, not even in part, as its words are others")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_on_odd_rows(spark, sf_dir, tmp_path):
    """Null and empty texts, ids that are null or occur twice, copies, repeated rows, a very long text, columns with clashing names, among the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    plain = {r["doc_id"]: r["text"] for r in corpus_pipeline.STAGES[1][1](spark, corpus_pipeline.STAGES[0][1](spark, docs, sf_dir), sf_dir).collect()}
    large = [i for i in sorted(plain) if len(plain[i]) > 500]
    one, two = large[0], large[-1]
    long = " ".join(plain[two].split()[k % 90] + plain[one].split()[k % 80] for k in range(40_000))
    odd = [(5001, None), (5002, ""), (5003, "too short"), (5004, plain[one]), (None, plain[two].upper() + " and an end of its own"), (two, plain[two]), (5005, long), (one, "another text of this id")]
    rows = [(i, t, "en", "s", None if t is None else len(t), 7, "x", 1, "y") for i, t in texts + odd]
    out = corpus_pipeline.run(spark, _documents(tmp_path, spark, rows))
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "quality", "found", "w", "n_tokens", "ids", "decoded_sha256"]
    got = out.collect()
    assert all(r["quality"] == 7 and r["found"] == 1 and r["w"] == "y" and r["n_tokens"] == len(r["ids"]) for r in got)
    kept = [r["doc_id"] for r in got]
    assert not {5001, 5002, 5003, 5004} & set(kept) and kept.count(one) == 1  # nothing to keep, a copy, and a short text
    assert kept.count(two) == 2  # rows that are one document
    assert set(kept) <= {*plain, None, 5005} and len(set(kept) - {None, 5005}) >= 0.9 * len(plain)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, _documents(tmp_path, spark, [])).collect() == []


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in quality_rules.score(docs).filter("quality.kept").collect()}
    rows = {r["doc_id"]: (r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept}
    component, _ = brute.near_components(rows, 5, 80)
    rows = {k: v for k, v in rows.items() if component[k] == k}
    words, gone = brute.repeated_words(rows, 50)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    library = Tokenizer.from_file(VOCABULARY)
    want = {}
    for k in rows:
        text = " ".join(w for w, g in zip(words[k], gone[k], strict=True) if not g)
        if not brute.contamination(text, items)[3]:
            want[k] = library.encode(text, add_special_tokens=False).ids
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want
