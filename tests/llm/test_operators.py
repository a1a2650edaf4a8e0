"""The operators on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import json
import random
import sys
import textwrap
import unicodedata

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm import bpe_automaton, chat_format, decontaminate, language_id, license_scan, lm_scoring, minhash_dedup, pipeline_stages, quality_rules, substring_dedup, suffix_dedup
from millrace.llm.queries import VOCABULARY
from millrace.sources.tables import read_table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SCHEMA = "doc_id bigint, text string, n_words int, quality int, row string, lang string, source string"


def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdéhlnorstÄ") for _ in range(r.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    base = prose(200)
    near = base.split(" ")
    near[50] = "changed"
    out = [None, "", " \n\t ", "one", "Two words", passage, f"{prose(20)} {passage} {prose(7)}", f"{passage}\n{passage}", base, base, " ".join(near), base.upper(), "x " * 300]
    out += [f"{prose(30)}\n{passage}", prose(30000), "a" * 5000, "\n".join([prose(8)] * 9), "wow!! " * 40, "p$$ q## r%% " * 30]
    return out + [prose(r.randint(1, 120)) for _ in range(40)] + ["".join(r.choice("ab \n") for _ in range(700))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7, 1, "r", "en" if i % 2 else "fr", "s") for i, t in enumerate(texts())]
    rows += [(5, rows[5][1], 7, 1, "r", None, None), (None, "a text without an id " * 30, 7, 1, "r", "en", "s")]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def keyed_rows(docs):
    """{row number: (doc_id, text)}."""
    return dict(enumerate((r["doc_id"], r["text"]) for r in docs.collect()))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_quality_counts(docs, empty):
    out = quality_rules.score(docs).select("text", "quality.*").collect()
    assert len(out) == docs.count()
    for r in out:
        want = brute.counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert rows_of(quality_rules.score(empty)) == []


def test_quality_model_finds_rare_defects():
    """Documents with one rare defect are told from good ones although no other rule agrees."""
    good, junk = [1, 1, 1, 1, 2, 2, 2], [0, 1, 1, 1, 2, 2, 2]
    model = quality_rules.estimate(np.array([good, junk, [1, 0, 1, 1, 2, 1, 2]]), np.array([900.0, 60.0, 40.0]))
    weights = model.weights()
    odds = [model.base() + sum(weights[k][v] for k, v in enumerate(b)) for b in (good, junk)]
    assert odds[0] > 0 > odds[1]
    assert quality_rules.estimate(np.zeros((0, 7), int), np.zeros(0)).prior == 0.85


def test_quality_verdicts(docs):
    """Probabilities and verdicts against EM in plain Python."""
    out = quality_rules.score(docs).select("quality.*", quality_rules.votes(F.col("quality")).alias("code")).collect()
    ballots = [tuple(r["code"] // 3**k % 3 for k in range(len(quality_rules.RULES))) for r in out]
    want = brute.posterior(ballots)
    for r, b in zip(out, ballots, strict=True):
        assert abs(r["probability"] - want[b]) < 1e-6
        assert r["kept"] == (not r["base_failed"] and want[b] >= 0.5)


def test_long_lines_are_told_apart():
    """Two strings that sums of powers modulo 2**64 can't tell apart, whatever the base."""
    import pyarrow as pa

    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    counts = quality_rules._counts(pa.array([f"{one}\n{two}", f"{one}\n{one}"])).to_pylist()
    assert [c["n_dup_lines"] for c in counts] == [0, 1]


def test_labels_agree(spark, sf_dir):
    out = quality_rules.score(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "quality.kept", "quality.base_failed")
    told = out.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    right = [r["kept"] == (r["quality"] == 1) for r in told if not r["base_failed"]]
    assert sum(right) >= 0.95 * len(right)


def test_lm_base_and_exchange(docs, empty, keyed_rows):
    want = sorted(((keyed_rows[k][0],) + v for k, v in brute.base_scores(keyed_rows).items()), key=repr)
    here = lm_scoring.scores(docs).collect()
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in here), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose(sorted(g[5] for g in got), sorted(w[5] for w in want))
    sent = lm_scoring.scores(docs, most_bytes=0, frequent=3).collect()
    assert np.allclose(sorted(r["score"] for r in here), sorted(r["score"] for r in sent))
    assert np.allclose(sorted(r["base_score"] for r in here), sorted(r["base_score"] for r in sent))
    assert rows_of(lm_scoring.scores(empty)) == []


def test_lm_scores(docs, keyed_rows, monkeypatch):
    """With so much room that the filter makes no false hits."""
    monkeypatch.setattr(lm_scoring, "BITS_PER_TOKEN", 2000)
    want = sorted(brute.model_scores(keyed_rows, lm_scoring.STEPS.tolist(), lm_scoring.GRID.tolist()).values())
    assert np.allclose(sorted(r["score"] for r in lm_scoring.scores(docs).collect()), want)


def test_lm_exchange_asks_once_a_slice(spark):
    texts = ["word " * 3000 + f"w{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string").repartition(4).cache()
    table = lm_scoring.filter_blocks(docs, 40).cache()
    slices = lm_scoring._cut(docs, 30000).cache()
    assert slices.count() >= 20
    asked = lm_scoring._ask(slices, 40, 3).withColumn("n", F.length("grams") / 8)
    assert asked.agg(F.sum("n")).first()[0] < 20 * slices.count()  # not 6000 for each text
    assert asked.select("salt").distinct().count() == 3
    words = np.zeros(40 * lm_scoring.BLOCK_WORDS, np.uint64)
    for r in table.collect():
        words[r["block"] * lm_scoring.BLOCK_WORDS : (r["block"] + 1) * lm_scoring.BLOCK_WORDS] = np.frombuffer(r["words"], np.uint64)
    shared = spark.sparkContext.broadcast(lm_scoring.LogFilter(words, 40))
    here = docs.select("row", lm_scoring._levels_here(F.col("text"), shared).alias("x")).select("row", "x.*")
    sent = lm_scoring._levels_exchanged(docs, table, 40, 30000, 9000)
    key = lambda r: r["row"]
    assert sorted(here.collect(), key=key) == sorted(sent.select("row", "one", "two").collect(), key=key)


def test_lm_filter_levels():
    grams = np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.uint64)
    counts = np.random.default_rng(2).integers(1, 50, 3000)
    words = lm_scoring.fill_block(np.concatenate([grams, grams]), np.concatenate([counts, counts]))
    level = lm_scoring.LogFilter(words, 1).levels(grams, 0)
    assert (level >= np.searchsorted(lm_scoring.STEPS, 2 * counts, "right")).all()


def test_lm_beats_base_on_held_out(spark, sf_dir):
    out = lm_scoring.scores(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert out[1] > out[0]


def test_suffix_dedup(docs, empty, keyed_rows):
    want = {}
    for i, (b, gone) in brute.repeated_bytes({i: t for i, t in keyed_rows.values() if i is not None}, 100).items():
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        want[i] = (len(b), sum(gone), spans, brute.sha(kept))
    got = rows_of(suffix_dedup.digests(docs))
    assert len(got) == len(keyed_rows)
    for i, *rest in got:
        if i is not None and i != 5:  # rows that repeat count as one document
            assert tuple(rest) == want[i], i
    assert next(r for r in got if r[0] is None)[2] == 0
    assert rows_of(suffix_dedup.digests(empty)) == []


def test_suffix_dedup_hot_and_pieces(spark, monkeypatch):
    """The same with every anchor hot, and with texts cut into small pieces."""
    from millrace.llm import bloom, textbytes

    r = random.Random(3)
    part = "".join(r.choice("abcd") for _ in range(400))
    data = {i: "".join(r.choice("abcd") for _ in range(r.randint(0, 300))) + part * (i % 3) for i in range(12)}
    df = spark.createDataFrame(list(data.items()), "doc_id bigint, text string")
    want = {i: sum(g) for i, (_, g) in brute.repeated_bytes(data, 100).items()}
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.digests(df).collect()} == want
    ids = np.arange(1)
    monkeypatch.setattr(textbytes, "SLICE_BYTES", 256)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(ids), "text_hash": pa.array(ids), "text": pa.array([part * 3])})
    seen = set()
    for _, _, base, data_, offsets in suffix_dedup._pieces(batch, 100):
        row, at, n, _, _ = suffix_dedup._anchored(data_, offsets, 100)
        for s, k in zip(at.tolist(), n.tolist(), strict=True):
            seen.update(range(base + s, base + s + k))
    assert seen == set(range(1200 - 99))
    monkeypatch.setattr(bloom, "MOST_BYTES", 0)  # no filter: everything is sent on
    monkeypatch.setattr(suffix_dedup, "HOT", 10_000)
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.digests(df).collect()} == want


@pytest.mark.parametrize("n", [0, 5, 3000])
def test_filter_reads_its_hashes_once(spark, n):
    """They need not be a table; its size follows their number, and none of them is missed."""
    from millrace.llm import bloom

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    hashes = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, n, dtype=np.int64)
    given = spark.createDataFrame([(int(h),) for h in hashes], "h bigint").mapInArrow(seen, "h bigint")
    words = bloom.build(given).value
    assert read.value == n
    assert len(words.words) == max(1 << 10, 1 << n.bit_length())
    assert words.contains(hashes).all()
    assert words.contains(np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 10_000, dtype=np.int64)).sum() < 100


def test_suffix_levels_stay_few():
    family, r = suffix_dedup.SuffixLevels(4), np.random.default_rng(0)
    seen = set()
    for _ in range(40):
        data = r.integers(97, 100, 33).astype(np.uint8)
        for k, known in enumerate(family.add(data, np.arange(30))):
            window = data[k : k + 4].tobytes()
            assert known == (window in seen)
            seen.add(window)
    assert len(family.levels) <= 8


def test_suffix_index_of_batches(spark):
    """Batches that arrive one after another, against levels that are tables."""
    r = random.Random(12)
    part = ["".join(r.choice("abcdé") for _ in range(300)) for _ in range(3)]
    texts = {i: "".join(r.choice("abcd") for _ in range(r.randint(0, 200))) + (part[i % 3] if i % 2 else "") + ("x" * (i * 10)) for i in range(24)}
    want = {i: sum(gone) for i, (_, gone) in brute.repeated_bytes(texts, 100).items()}
    levels, got = [], {}
    for lo in range(0, 24, 4):
        batch = spark.createDataFrame([(i, texts[i]) for i in range(lo, lo + 4)], "doc_id bigint, text string")
        runs, levels = suffix_dedup.extend(levels, batch)
        for row in runs.collect():
            size = len(texts[row["doc_id"]].encode())
            got[row["doc_id"]] = size - int(suffix_dedup._stay(size, row["runs"], 100).sum())
    assert {i: got.get(i, 0) for i in texts} == want
    assert len(levels) <= 3


def test_suffix_strip(docs, keyed_rows):
    want = {i: bytes(c for c, g in zip(b, gone, strict=True) if not g).decode(errors="ignore") for i, (b, gone) in brute.repeated_bytes({i: t for i, t in keyed_rows.values() if i is not None}, 100).items()}
    for r in suffix_dedup.strip(docs).collect():
        if r["doc_id"] is not None and r["doc_id"] != 5:  # rows that repeat count as one document
            assert r["text"] == want[r["doc_id"]]


def test_minhash(docs, empty, keyed_rows):
    component, sets = brute.near_components(keyed_rows, 3, 85)
    want = sorted(((keyed_rows[k][0], len(sets[k]), component[k], keyed_rows[k][0] == component[k]) for k in keyed_rows), key=repr)
    got = sorted((tuple(r) for r in minhash_dedup.near_duplicates(docs, 3, 85).drop("text_hash").collect()), key=repr)
    assert got == want
    assert rows_of(minhash_dedup.near_duplicates(empty, 3, 85)) == []


def test_minhash_chain(spark):
    """Documents that are linked only through others, and a large group of near copies."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    chain = [[word() for _ in range(100)]]
    for _ in range(6):
        nxt = list(chain[-1])
        nxt[r.randrange(100)] = word()
        nxt[r.randrange(100)] = word()
        chain.append(nxt)
    base = [word() for _ in range(120)]
    copies = [[*base[:k], word(), *base[k + 1 :]] for k in range(40)]
    rows = {i: (i, " ".join(w)) for i, w in enumerate(chain + copies)}
    component, _ = brute.near_components(rows, 3, 85)
    df = spark.createDataFrame(list(rows.values()), "doc_id bigint, text string")
    assert {x["doc_id"]: x["component_id"] for x in minhash_dedup.near_duplicates(df, 3, 85).collect()} == component


def near_group(r, n, words, most):
    """n texts of so many words with up to ``most`` words changed each, and copies of a few of them changed again."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(words)]
    out = []
    for k in range(n):
        text = list(out[r.randrange(len(out))] if k % 4 == 3 else base)
        for _ in range(r.randint(0, most)):
            text[r.randrange(words)] = word()
        out.append(text)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("few", [1, 8])
def test_minhash_below_threshold(spark, monkeypatch, few):
    """Groups most of whose pairs are just below the threshold, searched by leads or pair by pair."""
    monkeypatch.setattr(minhash_dedup, "FEW", few)
    r = random.Random(few)
    rows = dict(enumerate((i, t) for i, t in enumerate(near_group(r, 90, 120, 9) + near_group(r, 60, 40, 4))))
    component, sets = brute.near_components(rows, 3, 85)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash_dedup.near_duplicates(spark.createDataFrame(list(rows.values()), "doc_id bigint, text string"), 3, 85).collect()}
    assert len(set(component.values())) > 10
    assert got == {k: (len(sets[k]), component[k]) for k in rows}


def test_minhash_pairs_follow_documents(spark, monkeypatch):
    """In a group of near copies below the threshold, texts are compared about once a document, whatever is in common among those that the lead is not linked with."""
    compared, compare = [], minhash_dedup._compare
    monkeypatch.setattr(minhash_dedup, "_compare", lambda pairs, *rest: compared.append(pairs.count()) or compare(pairs, *rest))
    rows = dict(enumerate((i, t) for i, t in enumerate(near_group(random.Random(3), 300, 120, 9))))
    component, _ = brute.near_components(rows, 3, 85)
    got = {x["doc_id"]: x["component_id"] for x in minhash_dedup.near_duplicates(spark.createDataFrame(list(rows.values()), "doc_id bigint, text string"), 3, 85).collect()}
    assert got == component and len(set(component.values())) > 10
    assert sum(compared) <= 2 * len(rows)


def test_near_duplicates_stage_compares_as_many_pairs_as_documents(spark, monkeypatch):
    """The pipeline's stage, with longer shingles and a lower threshold."""
    compared, compare = [], minhash_dedup._compare
    monkeypatch.setattr(minhash_dedup, "_compare", lambda pairs, *rest: compared.append(pairs.count()) or compare(pairs, *rest))
    rows = dict(enumerate((i, t) for i, t in enumerate(near_group(random.Random(6), 300, 150, 9))))
    component, _ = brute.near_components(rows, 5, 80)
    kept = pipeline_stages.near_duplicates(spark, spark.createDataFrame(list(rows.values()), "doc_id bigint, text string"), "").collect()
    assert sorted(x["doc_id"] for x in kept) == sorted(set(component.values())) and len(kept) > 10
    assert sum(compared) <= 2 * len(rows)


@pytest.mark.parametrize("limit", [1, 1 << 12])
def test_minhash_common_elements(monkeypatch, limit):
    """Elements in common, multiplied and added up a few at a time."""
    r = random.Random(limit)
    monkeypatch.setattr(minhash_dedup, "COLUMNS", limit)
    monkeypatch.setattr(minhash_dedup, "ADDED", limit)
    monkeypatch.setattr(minhash_dedup, "PRODUCTS", 20)
    sides = [[set(r.sample(range(40), r.randint(0, 9))) | set(r.sample(range(40, 900), r.randint(0, 60))) for _ in range(n)] for n in (17, 31)]
    flat = [(np.array([e for s in side for e in s], np.int64), np.repeat(np.arange(len(side)), [len(s) for s in side]), len(side)) for side in sides]
    assert minhash_dedup._common(*flat[0], *flat[1]).tolist() == [[len(x & y) for y in sides[1]] for x in sides[0]]


def test_minhash_recall(spark):
    """All links of 1,200 pairs near the threshold are found (the bound is one in ten thousand)."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = []
    for k in range(1200):
        text = [word() for _ in range(60)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join([*text[: 60 - k % 5], *(word() for _ in range(k % 5))]))]
    component, _ = brute.near_components(dict(enumerate(rows)), 3, 85)
    linked = {rows[k][0] for k in component if component[k] != rows[k][0]}
    got = {x["doc_id"] for x in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).filter("not kept").collect()}
    assert len(linked) > 500 and got == linked


def test_substring(docs, empty, keyed_rows):
    words, gone = brute.repeated_words(keyed_rows, 50)
    want = sorted(((keyed_rows[k][0], len(w), sum(gone[k]), brute.sha(" ".join(x for x, g in zip(w, gone[k], strict=True) if not g))) for k, w in words.items()), key=repr)
    assert sorted(rows_of(substring_dedup.digests(docs)), key=repr) == want
    assert rows_of(substring_dedup.digests(empty)) == []
    stripped = substring_dedup.strip(docs)
    assert stripped.columns == docs.columns
    left = sorted(((r["doc_id"], len(brute.SPACED.findall(r["text"] or ""))) for r in stripped.collect()), key=repr)
    assert left == sorted(((w[0], w[1] - w[2]) for w in want), key=repr)


def test_substring_writes_only_what_it_joins(docs, monkeypatch):
    """Each table is a file a task or more; what only fills a filter is none."""
    from millrace.llm import keys

    written = []
    note = lambda df, label="step", write=substring_dedup.stash: written.append(label) or write(df, label)
    monkeypatch.setattr(substring_dedup, "stash", note)
    found = substring_dedup.repeats(keys.keyed(docs.select("doc_id", "text")))
    assert found.count() > 0 and written == ["repeated"]


def test_language(spark, sf_dir, empty):
    pages, known = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "documents"))
    odd = spark.createDataFrame([(-1, None, None), (-2, "", "x"), (-3, "no address", "<html lang='fr'>"), (-3, "no address", "<html lang='fr'>")], "page_id bigint, url string, html string")
    out = language_id.identify(pages.select("page_id", "url", "html").unionByName(odd), known).collect()
    assert len(out) == pages.count() + 4
    told = {r["page_id"]: r["lang"] for r in out}
    right = [told[r["page_id"]] == r["html"].split('lang="')[1][:2] for r in pages.collect()]
    assert sum(right) >= 0.95 * len(right)
    assert all(0 < r["probability"] <= 1 + 1e-9 for r in out)
    none = language_id.identify(odd, empty).collect()
    assert len(none) == 4 and all(r["lang"] is None for r in none)


def test_language_brute(spark):
    r = random.Random(4)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(2, 6)))
    prose = lambda letters, n: " ".join(word(letters) for _ in range(n))
    alphabets = {"aa": "abcd", "bb": "cdef", "cc": "éghb"}
    known = [(k, prose(a, 60)) for k, a in alphabets.items()] + [(None, "x y"), ("aa", None), ("aa", "A B CD")]
    pages = []
    for i in range(40):
        lang = r.choice(list(alphabets))
        text = r.choice(["", prose(alphabets[lang], r.randint(0, 8)), prose("abcdefgh", 3)])
        pages.append((i % 37, f"http://h{i % 5}.{lang}.org/{i}", f'<html lang="{lang}"><p>{text}</p>' if i % 3 else text, 9, "x"))
    pages += [(90, None, None, 9, "x"), (91, "", "q" * 300_000, 9, "x")]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string, lang int, soft string")
    labelled = spark.createDataFrame(known, "lang string, text string")
    plain = table.select("page_id", language_id.host(F.col("url")).alias("h"), language_id.declared(F.col("html")).alias("d"), language_id.plain_text(F.col("html")).alias("t")).collect()
    want = sorted((p["page_id"], lang, q) for p, (lang, q) in zip(plain, brute.languages([(p["h"], p["d"], p["t"]) for p in plain], known), strict=True))
    for block in (language_id.BLOCK, 2):  # all languages at once, and two at a time
        fit = language_id.fit
        language_id.fit = lambda x, fit=fit, block=block: fit(x, block)
        try:
            got = language_id.identify(table, labelled).collect()
        finally:
            language_id.fit = fit
        got = sorted((g["page_id"], g["lang"], g["probability"]) for g in got)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-4)  # single precision
    assert rows_of(language_id.identify(table.limit(0), labelled)) == []


RECORDS = [
    {"prompt": "a\\b<|end|>\n", "response": "[INST]\\s"},
    {"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": "y\\l<s>"}]},
    {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]},
    {"instruction": "i", "input": "", "output": 3},
    {"zzz": 1},
]


def test_chat_layouts(spark):
    rows = [(i, json.dumps(r)) for i, r in enumerate(RECORDS)] + [(8, "no record"), (9, None)]
    out = chat_format.format_records(spark.createDataFrame(rows, "id int, record string"))
    got = {r["id"]: r for r in out.select("*", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    assert [tuple(x) for x in got[0]["t"]] == [("user", "a\\b<|end|>\n"), ("assistant", "[INST]\\s")]
    assert got[1]["l"] == "y\\l<s>" and got[2]["layout"] == "from_value" and got[3]["l"] == "3"
    assert [tuple(x) for x in got[2]["t"]] == [("user", "q"), ("assistant", "")]
    assert all(got[k]["layout"] is None for k in (4, 8, 9))


def test_chat_round_trip(spark):
    r = random.Random(2)
    bits = ["<|turn|>", "<|end|>\n", "</s>", "<s>", "[INST]", "[/INST]", "\\", "\\b", "\\l", "\\s", "\\n", "\n", "b", "l", "é", '"', " "]
    rows = [(i, t, r.choice(["user", "assistant", "ro\\le\n"]), "".join(r.choice(bits) for _ in range(r.randint(0, 9)))) for i in range(60) for t in range(r.randint(1, 5))]
    rows += [(99, 0, None, None), (99, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    done = chat_format.format_records(chat_format.records_of_rows(df, "conv_id", "turn", "role", "text"))
    got = {x["conv_id"]: [tuple(y) for y in x["t"]] for x in done.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t")).collect()}
    for c in got:
        assert got[c] == [(b or "", t or "") for i, _, b, t in sorted(rows, key=lambda x: (x[1], x[2] or "", x[3] or "")) if i == c]
    assert rows_of(chat_format.format_records(chat_format.records_of_rows(df.limit(0), "conv_id", "turn", "role", "text"))) == []


def test_decontaminate(spark, docs, empty, keyed_rows):
    items = [(1, keyed_rows[5][1]), (2, "one"), (3, None), (4, "  "), (10, "Two words"), (11, keyed_rows[8][1]), (12, "x x x")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = decontaminate.report(docs, bench)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(r["item_ids"])), r["contaminated"]) for r in out.collect()), key=repr)
    want = []
    for i, t in keyed_rows.values():
        n, hit, ids, bad = brute.contamination(t, items)
        want.append((i, n, hit, tuple(sorted(ids)), bad))
    assert got == sorted(want, key=repr)
    assert rows_of(decontaminate.report(empty, bench)) == []
    assert all(not r["contaminated"] for r in decontaminate.report(docs, bench.limit(0)).collect())


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "alpha beta beta gamma"), (2, "alpha beta one two three four beta gamma"), (3, "alpha beta gamma")], "doc_id bigint, text string")
    whole = decontaminate.keyed(docs)
    windows = decontaminate.item_windows(bench)
    asked = decontaminate.query_terms(windows, decontaminate.term_counts(whole, windows))
    near = decontaminate.proximity(decontaminate.postings(whole, asked), asked, 1)
    assert {r["doc_id"] for r in near.collect()} == {1, 3}


def test_licences(spark, empty):
    lines = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Some words about nothing at all.", "This work is licensed under the GNU General Public License, version 3."]
    rows = [(i, f"First line here.\n{t}\nlast line") for i, t in enumerate(lines)] + [(8, None), (9, ""), (9, "")]
    out = license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = {r["doc_id"]: r["families"] for r in out}
    assert len(out) == 7 and got[0] == ["mit"] and got[1] == ["cc_by_nc"] and got[2] == [] and got[3] == ["gpl"] and got[8] == [] and got[9] == []


def test_licences_outside_templates_are_unknown(spark):
    lines = ["Licensed under the Eclipse Public License, version 2.0.", "Licensed under the GNU Affero General Public License, version 3.", "Licensed under CC BY-ND 4.0."]
    lines += [text for texts in license_scan.TEMPLATES.values() for text in texts]
    out = license_scan.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")).collect()
    got = [r["families"] for r in sorted(out, key=lambda r: r["doc_id"])]
    assert all(x in ([], ["unknown"]) for x in got[:3]) and got[0] == ["unknown"]
    assert got[3:] == [[family] for family, texts in license_scan.TEMPLATES.items() for _ in texts]


MIT_TEXT = """MIT License

Copyright (c) 2020 Some Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
AS_IS = """Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""


def test_licences_whole_texts_tags_and_ordinary_words(spark, sf_dir):
    """Among the documents, whose lines are the negatives that are trained on."""
    cases = [
        (MIT_TEXT, ["mit"]),
        ("This file is under MIT.", ["mit"]),
        ("SPDX-License-Identifier: Apache-2.0", ["apache"]),
        ("// SPDX-License-Identifier: MIT", ["mit"]),
        ("GPLv3 licensed. See COPYING.", ["gpl"]),
        ("Licensed under the terms of the GNU LGPL v2.1 or later.", ["lgpl"]),
        (AS_IS, ["apache"]),
        ("She got a licence for her garden and a permission slip for the trip.", []),
        ("The court granted the license of the driver, free of charge.", []),
        ("Der Hund ging mit dem Mann unter den Baum und blieb dort.", []),
        ("word " * 60_000, []),
        (None, []),
        ("", []),
    ]
    schema = "doc_id bigint, text string, line string, words int, family string, prediction int, sure boolean"
    rows = [(None if i == 1 else i, text, "x", 1, "y", 2, True) for i, (text, _) in enumerate(cases)]
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    table = spark.createDataFrame([*rows, rows[0]], schema).unionByName(corpus, allowMissingColumns=True)
    out = [r for r in license_scan.scan(table).collect() if (r["doc_id"] or 0) < 1000]
    assert len(out) == len(rows) + 1
    got = {1 if r["doc_id"] is None else r["doc_id"]: r["families"] for r in out}
    assert got == {i: families for i, (_, families) in enumerate(cases)}


def test_licences_empty_table(spark, empty):
    assert license_scan.scan(empty).collect() == []


def test_licences_wrapped(spark):
    notices = [(family, texts[k]) for family, texts in license_scan.TEMPLATES.items() for k in (0, 1)]
    rows = []
    for width in (70, 45):
        for family, text in notices:
            wrapped = textwrap.fill(text, width, initial_indent=" * ", subsequent_indent=" * ", break_long_words=False, break_on_hyphens=False)
            rows.append((len(rows), f"Some words about nothing at all.\n *\n{wrapped}\n\nlast line\n", family))
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["families"], r["n_paragraphs"], r["n_licence"]) for r in license_scan.scan(table.union(table.limit(1))).collect()}
    assert got == {i: ([family], 3, 1) for i, _, family in rows}


def test_licences_only_what_can_count_is_classified(spark, sf_dir):
    """op9: the features of every line used to be made. What is left is all that holds a word of the vocabulary or a template, by looking at every line."""
    texts = [x for several in license_scan.TEMPLATES.values() for x in several] + [*license_scan.OTHERS, *license_scan.ORDINARY]
    texts += [x.upper() for x in texts] + [" ".join(x.split()[::-1]) for x in texts] + [" ".join(x.split()[:-2]) for x in texts]
    texts += ["LİCENSE K\u212a", "_rights_ reserved, reproduced: no part of this publication may be", "released under the mit", "Er ging mit under the released", "apache 2.0 license", "account by", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs = docs.unionByName(read_table(spark, sf_dir, "documents").select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    units = license_scan.units(docs.withColumn("text_hash", F.lit(0)))
    every = units.withColumn("words", license_scan.words(F.col("line"))).localCheckpoint()
    want = every.filter(F.col("line").rlike(license_scan._VOCABULARY) | (license_scan.overlap(F.col("words"), None) >= license_scan.OVERLAP)).select("doc_id", "par", "first", "last", "line").collect()
    got = license_scan._possible(units).select("doc_id", "par", "first", "last", "line").collect()
    assert sorted(got) == sorted(want) and 100 < len(got) < units.count() / 2


def test_licences_documents_that_may_count(spark, sf_dir):
    """op9: every document used to be cut into lines. What is left out holds no unit that can count, also of words from several lines."""
    texts = [x for several in license_scan.TEMPLATES.values() for x in several] + [*license_scan.OTHERS, *license_scan.ORDINARY]
    texts += [x.upper() for x in texts] + [x.replace(" ", "\n") for x in texts] + [x.replace("-", "-\n") for x in texts] + [" ".join(x.split()[::-1]) for x in texts] + [" ".join(x.split()[1:]) for x in texts]
    texts += ["creative\n123\ncommons", "cc\n7\nby", "\u00e9cc by", "mit\u0301 the released", "L\u0130CENSE", "account by the limit", "Er ging mit der Familie", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs = docs.unionByName(read_table(spark, sf_dir, "documents").select((F.col("doc_id") + 100_000).alias("doc_id"), "text")).fillna("", ["text"])
    want = {r["doc_id"] for r in license_scan._possible(license_scan.units(docs.withColumn("text_hash", F.lit(0)))).select("doc_id").distinct().collect()}
    got = {r["doc_id"] for r in docs.filter(license_scan._may_count(F.col("text"))).select("doc_id").collect()}
    assert want <= got and len(got) < len(texts) + 40


def test_licences_held_back_examples(spark):
    wrong = spark.createDataFrame([(1.0, 1.0, 0.4), (-1.0, 2.0, 0.6), (2.0, 2.0, 0.7)], "label double, prediction double, p double")
    assert license_scan._threshold(wrong) == 0.7
    assert license_scan._threshold(wrong.filter("label > 0")) == 0
    assert license_scan._threshold(wrong.filter("label < 0")) > 1


@pytest.fixture(scope="module")
def both():
    with open(VOCABULARY, encoding="utf-8") as f:
        return bpe_automaton.Automaton(json.load(f)), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=40) | st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=60) | st.text(alphabet="abcdeinorst'<|>0 ΣΑς", max_size=80))
def test_bpe_against_library(both, text):
    automaton, library = both
    want = library.encode(text, add_special_tokens=False).ids
    got = automaton.encode(text)
    assert got.tolist() == want
    assert automaton.decode(got) == library.decode(want, skip_special_tokens=False)


def test_bpe_combining_marks(both):
    """Each mark before and after marks of low and high order, and random pairs of marks."""
    marks = [chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    r = random.Random(11)
    pairs = [x + y for m in marks for x, y in ((m, "\u0334"), ("\u0301", m), (m, "\u0301"))] + [r.choice(marks) + r.choice(marks) for _ in range(4000)]
    texts = ["e" + p for p in pairs] + ["\U00011935\U00011930", "\U00011938\u0301"]
    want = [e.ids for e in both[1].encode_batch(texts, add_special_tokens=False)]
    assert [both[0].encode(t).tolist() for t in texts] == want


def test_bpe_rows(spark, docs, empty, both):
    vocabulary = bpe_automaton.read_vocabulary(spark, VOCABULARY)
    out = docs.select("text", bpe_automaton.digests(F.col("text"), vocabulary).alias("d"), bpe_automaton.ids(F.col("text"), vocabulary).alias("i")).collect()
    for r in out:
        want = both[1].encode(r["text"] or "", add_special_tokens=False).ids
        assert r["i"] == want and r["d"]["n_tokens"] == len(want)
        assert r["d"]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert rows_of(empty.select(bpe_automaton.digests(F.col("text"), vocabulary))) == []


def test_bpe_long_pieces(both):
    r = random.Random(6)
    for text in ("a" * 300_000, "".join(r.choice("abcdeé") for _ in range(50_000)), "x1" * 20_000):
        assert both[0].encode(text).tolist() == both[1].encode(text, add_special_tokens=False).ids


def test_bpe_stores_are_bounded(both, monkeypatch):
    for name in ("MOST_STATES", "MOST_WORDS", "MOST_CHUNKS"):
        monkeypatch.setattr(bpe_automaton, name, 5)
    both[0].forget()
    r = random.Random(8)
    text = " ".join("".join(r.choice("abcdeghinorst") for _ in range(r.randint(1, 12))) for _ in range(300))
    assert both[0].encode(text).tolist() == both[1].encode(text, add_special_tokens=False).ids
    for word in text.split():
        assert both[0].encode(word).tolist() == both[1].encode(word, add_special_tokens=False).ids
    assert len(both[0].states) <= 5 + 12 and len(both[0].chunks) <= 9 and len(both[0].older) <= 9 and len(both[0].words) <= 5
    both[0].forget()
    assert len(both[0].states) == 1 and not (both[0].chunks or both[0].older or both[0].words)


def test_control_strings(both):
    text = "<|startoftext|>Hi <|endoftext|> there <|endoftext|"
    assert both[0].encode(text).tolist() == both[1].encode(text, add_special_tokens=False).ids
