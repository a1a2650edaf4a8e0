"""Benchmark decontamination with a distributed positional inverted index.

Every run of 13 words of a benchmark item (or the whole of a shorter item) is a *window*. A *term* is a pair
of neighbouring words (a single word in windows of one word). The index keeps, of the training texts, the
postings (term, document, position) of the terms that are asked for: each window's rarest, by
their counts over all documents. A posting of a term that stands at place o of a window says that the window
could start at position - o; so the lists, shifted by their offsets, are intersected from the rarest
term on, by grouping on (document, window, start). What is left is compared with the texts word
by word, which makes the matches exact. Proximity matches allow each term ``SLACK`` places off.

Two passes over the texts explode their terms: one counts the benchmark's terms, one keeps the
postings, which are stored as a table. Both join with the few terms before anything is shuffled. The terms are
broadcast if there are at most ``BROADCAST_TERMS``; a larger benchmark is joined by shuffling. The texts
themselves are not shuffled: candidates are broadcast up to the same bound, and beyond it joined with the texts by
document, where Spark may put a filter of its own before the shuffle. Everything is DataFrame operations.

Edge cases: null and empty texts have no words, and items without words have no windows; documents
are told apart by id and text, so rows may repeat and ids may be null; empty tables give empty results;
a text may hold any number of matches, which are one array of its row; extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.lineage import stash, temporary

from .keys import attach, keyed

LENGTH = 13
#: Up to this many terms or candidates are broadcast: 2**20 hashes and phrases are below 200 MB.
BROADCAST_TERMS = 1 << 20
#: Places that a term may be off in a proximity match.
SLACK = 3
#: How many of a window's terms have their lists intersected before the texts are compared.
DEPTH = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text: letters, digits and everything beyond ASCII; A-Z in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BREAK), "")


def item_windows(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """(phrase, n, items): the distinct windows, their number of words and the ids of their items."""
    listed = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))
    phrases = F.transform(starts, lambda i: F.array_join(F.slice("w", i, length), " "))
    return (
        listed.select("item_id", F.explode(F.array_distinct(phrases)).alias("phrase"))
        .groupBy("phrase")
        .agg(F.collect_set("item_id").alias("items"))
        .select("phrase", F.size(F.split("phrase", " ")).alias("n"), "items")
    )


def _terms(df: DataFrame) -> DataFrame:
    """A small side of a join on words: broadcast behind a check of its size."""
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def _terms_of(w: Column, single: bool) -> Column:
    """The terms of an array of words, by place: pairs of neighbours, hashed, or single words."""
    if single:
        return F.transform(w, lambda x: F.xxhash64(x))
    return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.lit(" "), F.get(w, i + 1)))


def _window_terms(windows: DataFrame) -> DataFrame:
    """(phrase, single, offset, term) of each window."""
    w = F.split("phrase", " ")
    terms = F.when(F.col("n") == 1, _terms_of(w, True)).otherwise(_terms_of(w, False))
    return windows.select("phrase", (F.col("n") == 1).alias("single"), F.posexplode(terms).alias("offset", "term"))


def _tokens(docs: DataFrame, asked: DataFrame, *columns: str) -> DataFrame:
    """(columns, pos, term) of all terms that are asked for."""
    kinds = [r["single"] for r in asked.select("single").distinct().collect()]  # two at most
    held = docs.select(*columns, words(F.col("text")).alias("w"))
    parts = [held.select(*columns, F.posexplode(_terms_of(F.col("w"), kind)).alias("pos", "term")).join(_terms(asked.filter(F.col("single") == kind).select("term").distinct()), "term") for kind in kinds or [False]]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def term_counts(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(term, df): how often each term of the windows occurs in all documents; 0 if it never does."""
    asked = _window_terms(windows).select("single", "term").distinct()
    found = _tokens(docs, asked).groupBy("term").agg(F.count("*").alias("df"))
    return asked.join(found, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def query_terms(windows: DataFrame, counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(term, single, phrase, offset, needed, lead): the rarest terms of each window, if all of its terms occur; lead is the least offset."""
    places = _window_terms(windows).join(counts, "term")
    order = Window.partitionBy("phrase").orderBy("df", "offset")
    ranked = places.select("*", F.row_number().over(order).alias("r"), F.min("df").over(Window.partitionBy("phrase")).alias("least"))
    rare = ranked.filter((F.col("r") <= depth) & (F.col("least") > 0))
    phrase = Window.partitionBy("phrase")
    return rare.select("term", "single", "phrase", "offset", F.count("*").over(phrase).alias("needed"), F.min("offset").over(phrase).alias("lead"))


def postings(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The index: (term, doc_id, text_hash, pos) of the terms that are asked for."""
    return _tokens(docs, asked, "doc_id", "text_hash")


def intersect(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, text_hash, phrase, start) at which all lists of a window, shifted by their offsets, agree."""
    at = index.join(_terms(asked.drop("single")), "term").withColumn("start", F.col("pos") - F.col("offset")).filter("start >= 0")
    agreed = at.groupBy("doc_id", "text_hash", "phrase", "start").agg(F.count_distinct("offset").alias("k"), F.max("needed").alias("needed"))
    return agreed.filter("k = needed").drop("k", "needed")


def proximity(index: DataFrame, asked: DataFrame, slack: int) -> DataFrame:
    """(doc_id, text_hash, phrase, start) near which the rarest terms of a window all occur, each at
    most ``slack`` words from where the one at ``start`` puts it.

    Joined on the number of a block of slack + 1 places, so that only near places meet.
    """
    at = index.join(_terms(asked.drop("single")), "term").withColumn("start", F.col("pos") - F.col("offset"))
    at = at.select("doc_id", "text_hash", "phrase", "start", "offset", "needed", "lead", F.floor(F.col("start") / (slack + 1)).alias("block"))
    leads = at.filter("offset = lead")
    leads = leads.select("doc_id", "text_hash", "phrase", F.col("start").alias("here"), F.explode(F.array(*(F.col("block") + d for d in (-1, 0, 1)))).alias("block"))
    near = leads.join(at.drop("lead"), ["doc_id", "text_hash", "phrase", "block"]).filter(F.abs(F.col("start") - F.col("here")) <= slack)
    met = near.groupBy("doc_id", "text_hash", "phrase", F.col("here").alias("start")).agg(F.count_distinct("offset").alias("k"), F.max("needed").alias("needed"))
    return met.filter("k = needed").drop("k", "needed")


def exact_matches(docs: DataFrame, index: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, text_hash, phrase, start, n): every occurrence of a window in the keyed documents."""
    candidates = stash(intersect(index, asked).withColumn("n", F.size(F.split("phrase", " "))), "candidates")
    grouped = candidates.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("phrase", "start", "n")).alias("found"))
    grouped = F.broadcast(grouped) if candidates.count() <= BROADCAST_TERMS else grouped
    # Rows may repeat, and then so do their matches here; what reads them counts each place once.
    joined = attach(docs, grouped).select("doc_id", "text_hash", "found", words(F.col("text")).alias("w"))
    right = F.filter("found", lambda m: F.array_join(F.slice("w", m["start"] + 1, m["n"]), " ") == m["phrase"])
    return joined.select("doc_id", "text_hash", F.inline(right))


def report(docs: DataFrame, items: DataFrame, length: int = LENGTH, slack: int = SLACK) -> DataFrame:
    """A row for each row of ``docs``: doc_id, text_hash, n_words, n_hit, item_ids, contaminated, near_ids.

    A document is contaminated if words in a matched window are at least a twentieth of its words.
    near_ids: the items with a proximity match, exact ones included.
    """
    whole = keyed(docs)
    with temporary(docs.sparkSession) as keep:
        windows = stash(item_windows(items, length), "item_windows")
        asked = stash(query_terms(windows, term_counts(whole, windows)), "asked")
        index = stash(postings(whole, asked), "postings")
        matches = stash(exact_matches(whole, index, asked), "matches")
        doc = ["doc_id", "text_hash"]
        runs = matches.select(*doc, "start", (F.col("start") + F.col("n")).alias("end")).groupBy(*doc, "start").agg(F.max("end").alias("end"))
        earlier = Window.partitionBy(*doc).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(earlier), F.lit(0))))
        hits = runs.select(*doc, fresh.alias("fresh")).groupBy(*doc).agg(F.sum("fresh").alias("n_hit"))
        named = matches.select(*doc, "phrase").distinct().join(windows.select("phrase", F.explode("items").alias("item_id")), "phrase")
        listed = named.groupBy(*doc).agg(F.collect_set("item_id").alias("item_ids"))
        near = proximity(index, asked, slack).select(*doc, "phrase").distinct().join(windows.select("phrase", F.explode("items").alias("item_id")), "phrase")
        near = near.groupBy(*doc).agg(F.collect_set("item_id").alias("near_ids"))
        found = keep(attach(near, attach(hits, listed), "left"), "found")
    counted = whole.select("doc_id", "text_hash", F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    out = attach(counted, found, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    none = F.array().cast(f"array<{items.schema['item_id'].dataType.simpleString()}>")
    return out.select(
        "doc_id",
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("item_ids", none).alias("item_ids"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("near_ids", none).alias("near_ids"),
    )
