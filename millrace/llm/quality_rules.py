"""Document quality by weak supervision.

Rules look at counts taken from the whole text and vote *good*, vote *bad* or abstain. Their
accuracies are not set by hand: expectation-maximisation estimates them, with the share of good
documents, from how the rules agree. The posterior probability that a document is good then
replaces the usual "must pass every rule".

The counts are made in one pass over the texts inside the scan's own tasks, nothing is shuffled
but the number of documents for each combination of votes. There are at most 3**len(RULES) such
combinations whatever the input, so the estimation itself runs on the driver.

Edge cases: a null or empty text has no words and fails the base rule; rows may repeat, ids may be
null, further columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .keys import small_batches

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_letters",
    "n_shouts",
    "n_sentence_ends",
    "n_stutters",
)
COUNTS_TYPE = "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a") : ord("z") + 1] = True


def _repeats(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (row, key) whether it occurs twice or more, and whether it occurred before."""
    with np.errstate(over="ignore"):
        whole = tb.mix(key + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(whole, kind="stable")
    same = whole[order][1:] == whole[order][:-1]
    again, before = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    before[order[1:][same]] = True
    return again, before


def _count(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, first = tb.word_spans(data, offsets)
    row = tb.rows_of(first)
    words = tb.span_hashes(data, starts, ends)
    out = {"n_words": np.diff(first)}
    out["word_chars"] = tb.sums(~tb.SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    out["n_symbols"] = tb.sums(_SYMBOL[data], offsets)
    out["n_upper"] = tb.sums(_UPPER[data], offsets)
    out["n_letters"] = tb.sums(_LETTER[data], offsets)
    out["n_shouts"] = tb.sums((data[ends - 1] == ord("!")) & (ends - starts > 1), first)
    out["n_sentence_ends"] = tb.sums(np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8)), first)
    stutter = np.zeros(len(words), bool)
    stutter[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    out["n_stutters"] = tb.sums(stutter, first)

    breaks = np.flatnonzero(data == 0x0A)
    line_row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.argsort(line_start, kind="stable")
    order = order[np.argsort(line_row[order], kind="stable")]
    line_row, line_start = line_row[order], line_start[order]
    line_end = np.minimum(np.append(line_start[1:] - 1, len(data)), offsets[line_row + 1])
    line_end = np.where(np.append(line_row[1:] == line_row[:-1], False), line_end, offsets[line_row + 1])
    wordy = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_row, line_start, line_end = line_row[wordy], line_start[wordy], line_end[wordy]
    _, before = _repeats(line_row, tb.span_hashes(data, line_start, line_end, seed=2))
    out["n_dup_lines"] = np.bincount(line_row[before], minlength=len(offsets) - 1)
    out["n_lines"] = np.bincount(line_row, minlength=len(offsets) - 1)

    at = tb.whole_grams(first, 5)
    again, _ = _repeats(row[at], tb.gram_hashes(words, 5)[at])
    out["n_repeat_words"] = tb.sums(tb.covered(len(words), at[again], 5), first)
    return out


def _counts(text: pa.Array) -> pa.Array:
    parts = {c: [np.zeros(0, np.int64)] for c in COUNTS}
    for _, _, data, offsets in tb.slices(text):
        for name, values in _count(data, offsets).items():
            parts[name].append(values)
    return pa.StructArray.from_arrays([pa.array(np.concatenate(parts[c]).astype(np.int64)) for c in COUNTS], list(COUNTS))


def text_counts(text: Column) -> Column:
    """A struct with the counts of COUNTS for each text."""
    return F.arrow_udf(_counts, COUNTS_TYPE).asNondeterministic()(text)  # else the optimiser may evaluate it twice


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])


def _share(counts: Column, part: str, whole: str = "n_words") -> Column:
    return counts[part] / F.greatest(counts[whole], F.lit(1))


def _defect(bad: Column) -> tuple[Column, Column]:
    """A rule that votes bad or abstains."""
    return bad, F.lit(False)


#: name -> when the rule votes bad and when it votes good, from the struct of counts; else it abstains.
RULES = {
    "symbols": lambda c: _defect(_share(c, "n_symbols") > 0.1),
    "shouting": lambda c: _defect((_share(c, "n_shouts") > 0.2) | ((c["n_letters"] >= 20) & (_share(c, "n_upper", "n_letters") > 0.5))),
    "repeats": lambda c: _defect((_share(c, "n_repeat_words") > 0.2) | (_share(c, "n_stutters") > 0.2)),
    "lines": lambda c: _defect(_share(c, "n_dup_lines", "n_lines") > 0.3),
    "word_length": lambda c: ((_share(c, "word_chars") < 2.5) | (_share(c, "word_chars") > 14), _share(c, "word_chars").between(3, 8)),
    "sentences": lambda c: ((c["n_words"] >= 50) & (_share(c, "n_sentence_ends") < 0.005), _share(c, "n_sentence_ends").between(0.01, 0.4)),
    "length": lambda c: (c["n_words"] < 10, c["n_words"] >= 50),
}


def votes(counts: Column, rules: dict = RULES) -> Column:
    """All votes of a document as one number: base three, a digit for each rule (0 bad, 1 abstains, 2 good)."""
    pairs = [rule(counts) for rule in rules.values()]
    digits = [F.when(bad, 0).when(good, 2).otherwise(1) * 3**k for k, (bad, good) in enumerate(pairs)]
    return reduce(lambda a, b: a + b, digits).cast("int")


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and how often each rule votes bad, abstains, votes good in either class."""

    prior: float
    if_good: np.ndarray
    if_bad: np.ndarray

    def weights(self) -> np.ndarray:
        """What each vote adds to the log odds; abstaining says nothing, as a bad document mostly has one defect."""
        return np.log(self.if_good / self.if_bad) * [1, 0, 1]

    def base(self) -> float:
        return float(np.log(self.prior / (1 - self.prior)))

    def accuracies(self) -> np.ndarray:
        """The probability that a rule is right where it votes."""
        right = self.prior * self.if_good[:, 2] + (1 - self.prior) * self.if_bad[:, 0]
        cast = right + self.prior * self.if_good[:, 0] + (1 - self.prior) * self.if_bad[:, 2]
        return right / cast

    def log_odds(self, counts: Column, rules: dict = RULES) -> Column:
        """Log odds that a document is good, from its struct of counts."""
        odds = F.lit(self.base())
        for (bad, neither, good), rule in zip(self.weights().tolist(), rules.values(), strict=True):
            is_bad, is_good = rule(counts)
            odds = odds + F.when(is_bad, bad).when(is_good, good).otherwise(neither)
        return odds


def first_guess(m: int, prior: float) -> LabelModel:
    """Where EM starts: most documents are good, false alarms are rare, and a defect shows in few bad documents."""
    return LabelModel(prior, np.tile([0.002, 0.4, 0.598], (m, 1)), np.tile([0.2, 0.4, 0.4], (m, 1)))


def estimate(
    ballots: np.ndarray, documents: np.ndarray, prior: float = 0.85, false_alarms: float = 0.005, rounds: int = 200
) -> LabelModel:
    """EM over distinct ballots (rows of 0, 1, 2) and how many documents cast each.

    ``prior``, the share of good documents, is given: the rules alone don't tell a corpus with
    few bad documents from one with few good ones. ``false_alarms`` bounds how often a rule may
    vote bad on good documents; without it, a defect that comes with no other drifts into the good class.
    """
    model = start = first_guess(ballots.shape[1], prior)
    cast = np.stack([ballots == v for v in range(3)], axis=2).astype(float)
    for _ in range(rounds):
        odds = model.base() + np.einsum("nmv,mv->n", cast, model.weights())
        p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        good, bad = documents * p, documents * (1 - p)
        # As if ten more documents, of the first guess, had been seen in each class.
        if_good = (np.einsum("n,nmv->mv", good, cast) + 10 * start.if_good) / (good.sum() + 10)
        if_bad = (np.einsum("n,nmv->mv", bad, cast) + 10 * start.if_bad) / (bad.sum() + 10)
        alarms = np.minimum(if_good[:, 0], false_alarms)
        if_good[:, 1:] *= ((1 - alarms) / (1 - if_good[:, 0]))[:, None]
        if_good[:, 0] = alarms
        new = LabelModel(prior, if_good, if_bad)
        done = np.allclose(new.weights(), model.weights(), atol=1e-8)
        model = new
        if done:
            break
    return model


def fit(docs: DataFrame, counts: Column, rules: dict = RULES) -> LabelModel:
    """Estimate how the rules vote from the votes on all documents."""
    seen = docs.select(votes(counts, rules).alias("code")).groupBy("code").count().collect()  # 3**len(rules) rows at most
    codes = np.array([r["code"] for r in seen], np.int64)
    ballots = codes[:, None] // 3 ** np.arange(len(rules)) % 3
    return estimate(ballots, np.array([r["count"] for r in seen], float))


def score(docs: DataFrame, text: str = "text", keep_at: float = 0.5, rules: dict = RULES) -> DataFrame:
    """``docs`` with a struct column ``quality``: the counts, base_failed, probability and kept.

    The texts are read twice: once for the vote counts, once for the verdicts. A column of
    ``docs`` called quality is replaced.
    """
    marked = small_batches(docs).withColumn("quality", text_counts(F.col(text)))
    q = F.col("quality")
    odds = fit(marked, q, rules).log_odds(q, rules)
    return marked.withColumn(
        "quality",
        F.struct(
            "quality.*",
            base_failed(q).alias("base_failed"),
            (1 / (1 + F.exp(-odds))).alias("probability"),
            (~base_failed(q) & (odds >= float(np.log(keep_at / (1 - keep_at))))).alias("kept"),
        ),
    )
