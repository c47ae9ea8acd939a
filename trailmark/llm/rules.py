"""Quality rules with risk-controlled thresholds.

Four measures of a text are compared with cutoffs of its stratum (the language): symbols a character of words, the share of
repeated lines, the share of words in repeated three-word windows, and the mean word length.  Labelled rows are dealt
in two by a hash of their id.  The smaller part, for tuning, lays a path: from no cutoffs on, each step tightens the rule
that catches the most bad rows for a good one, and more than ``COST`` of them, until there is no such step.
The larger part, the holdout, tests the path: a step is taken as long as the exact (Clopper-Pearson) binomial upper
bound of the share of good documents that all cutoffs together reject stays under ``RISK``; the walk stops at the first
that doesn't hold.  Testing in this order, fixed before the holdout is seen, needs no correction within a stratum;
over strata the error level is divided by their number (Bonferroni).  So with probability 1 - ``LEVEL`` no stratum loses
more than RISK of its good documents to the cutoffs, whichever rule rejects them.

Rows are counted in Spark by the cells of the cutoffs that they lie in: at most (GRID + 1) ** 4 counts a part and stratum.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, NULL_ID, public_id, written

SYMBOLS = "#*$%&|<>"
RISK, LEVEL, COST = 0.02, 0.05, 20
MIN_WORDS, MAX_REPEAT = 50, 50
#: One labelled row in TUNING lays the path; the others are the holdout.
TUNING = 4
#: Candidate cutoffs of each rule, lenient first; a text is rejected above its cutoff.
GRID = {
    "symbols": [0.5, 0.4, 0.3, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01, 0.005],
    "lines": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.05],
    "repeats": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.175, 0.15, 0.125, 0.1, 0.08, 0.06, 0.04, 0.02, 0.01],
    "length": [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0, 11.0, 10.5, 10.0, 9.5, 9.0, 8.5, 8.0],
}
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    words = text.encode("utf-8").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, ASCII_SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.encode("utf-8").split(b"\n") if x.strip()]  # lines with a word
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        count = Counter(windows)
        if len(count) < len(windows):
            hit = np.fromiter((count[w] > 1 for w in windows), bool, n - 2)
            over = np.zeros(n, bool)
            for k in range(3):
                over[k : k + n - 2] |= hit
            repeat = int(over.sum())
    return n, chars, symbols, len(lines), dup, repeat


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, rk and stratum plus the measures of the whole text.  Null text: none of anything."""
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([measure(t) for t in b.column("text").to_pylist()], np.int64).reshape(-1, len(names))
            cols = [b.column("doc_id"), b.column("rk"), b.column("stratum"), *(pa.array(got[:, k]) for k in range(len(names)))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "rk", "stratum", *names])

    return docs.mapInArrow(each, f"doc_id long, rk long, stratum string, {MEASURES}")


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))


def values() -> dict[str, Column]:
    return {
        "symbols": _ratio("n_symbols", "word_chars"),
        "lines": _ratio("n_dup_lines", "n_lines"),
        "repeats": _ratio("n_repeat_words", "n_words"),
        "length": _ratio("word_chars", "n_words"),
    }


def binomial_tail(rejected: int, n: int, p: float) -> float:
    """The probability of ``rejected`` or fewer of n at rate p, exactly: the incomplete beta function's continued fraction."""
    if rejected >= n:
        return 1.0
    a, b, x = n - rejected, rejected + 1, 1 - p  # the regularised I_x(a, b)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(a: float, b: float, x: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        out, m = d, 0
        while True:
            m += 1
            for term in (
                m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d, c = 1 + term * d, 1 + term / c
                d = 1 / (d if abs(d) > tiny else tiny)
                c = c if abs(c) > tiny else tiny
                out *= c * d
            if abs(c * d - 1) < 1e-14:
                return out

    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def holds(rejected: int, n: int, risk: float, level: float) -> bool:
    """Whether the Clopper-Pearson upper bound of the rate is ``risk`` or less."""
    return n > 0 and binomial_tail(rejected, n, risk) <= level


def path(good: np.ndarray, bad: np.ndarray, good_n: np.ndarray, bad_n: np.ndarray) -> list[tuple[int, ...]]:
    """Vectors of cutoffs (how many candidates of each rule are passed over; a row is rejected where a cell is less), from
    none on.  good, bad: rows of cells, with how often they stand."""
    full = [len(g) for g in GRID.values()]
    at, steps = list(full), [tuple(full)]
    kept_good, kept_bad = np.ones(len(good), bool), np.ones(len(bad), bool)
    while True:
        best = None
        for r, most in enumerate(full):
            start = 0 if at[r] == most else at[r] + 1
            caught = np.bincount(bad[kept_bad, r], bad_n[kept_bad], most + 1).cumsum()
            lost = np.bincount(good[kept_good, r], good_n[kept_good], most + 1).cumsum()
            for c in range(start, most):
                step = caught[c] / (lost[c] + 1), caught[c]
                if caught[c] > COST * lost[c] and (best is None or step > best[0]):
                    best = step, r, c
        if best is None:
            return steps
        _, r, c = best
        at[r] = c
        kept_good &= good[:, r] > c
        kept_bad &= bad[:, r] > c
        steps.append(tuple(at))


def rejects(cells: np.ndarray, cutoffs: tuple[int, ...]) -> np.ndarray:
    full = [len(g) for g in GRID.values()]
    return np.any([cells[:, r] <= c for r, c in enumerate(cutoffs) if c < full[r]] or [np.zeros(len(cells), bool)], axis=0)


def thresholds(known: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """known (doc_id, stratum, measures and q: 1 good, else bad) -> stratum and a cutoff for each rule (infinite: none)."""

    def cell(rule: str, v: Column) -> Column:
        """The number of candidate cutoffs that v isn't above."""
        return F.size(F.filter(F.array(*(F.lit(float(x)) for x in GRID[rule])), lambda x: v <= x)).alias(rule)

    tuning = (F.pmod(F.xxhash64("doc_id", F.lit("tuning")), F.lit(TUNING)) == 0).alias("tuning")
    counted = known.select("stratum", tuning, (F.col("q") == 1).alias("good"), *(cell(r, v) for r, v in values().items()))
    counted = written(counted.groupBy(*counted.columns).agg(F.count(F.lit(1)).alias("n")), "cells")
    each = level / max(1, counted.select("stratum").distinct().count())

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        def part(tuning: bool, good: bool) -> tuple[np.ndarray, np.ndarray]:
            own = pdf[(pdf["tuning"] == tuning) & (pdf["good"] == good)]
            return own[list(GRID)].to_numpy(np.int64), own["n"].to_numpy(np.int64)

        (good, good_n), (bad, bad_n) = part(True, True), part(True, False)
        held, held_n = part(False, True)
        taken = tuple(len(g) for g in GRID.values())
        for cutoffs in path(good, bad, good_n, bad_n)[1:]:
            if not holds(int(held_n[rejects(held, cutoffs)].sum()), int(held_n.sum()), risk, each):
                break
            taken = cutoffs
        out = {"stratum": [pdf["stratum"].iloc[0]]}
        for (rule, grid), c in zip(GRID.items(), taken, strict=True):
            out[rule] = [grid[c] if c < len(grid) else math.inf]
        return pd.DataFrame(out)

    schema = "stratum string, " + ", ".join(f"{r} double" for r in GRID)
    return counted.groupBy("stratum").applyInPandas(choose, schema)


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """doc_id, rk (a hash of the text), the measures, base_failed and kept of every row of ``docs`` (doc_id, text, lang).

    kept: not base_failed, and under every cutoff of the row's stratum.  Null text: no words, base_failed.  A null language is a
    stratum of its own.  A stratum with too few good rows in the holdout to bound the risk (149 where it is the only one,
    217 where there are four) has no cutoffs.  Labels with a null quality or of ids not in ``docs`` don't count; repeated
    labels of an id count once, as the lowest.  Empty tables: no rows.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"),
    ).withColumn("rk", F.xxhash64("text"))
    found = written(measured(rows), "measures")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    found = found.withColumn("base_failed", failed)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("q"))
    known = known.where("doc_id is not null and q is not null").groupBy("doc_id").agg(F.min("q").alias("q"))
    # The base rules don't depend on labels; the risk that cutoffs add is measured on good rows that pass them.
    passed = found.where("not base_failed").join(known, "doc_id")
    cutoffs = written(thresholds(passed, risk, level), "cutoffs")
    for rule in GRID:
        cutoffs = cutoffs.withColumnRenamed(rule, f"max_{rule}")
    over = F.lit(False)
    for rule, v in values().items():
        over = over | F.coalesce(v > F.col(f"max_{rule}"), F.lit(False))
    return (
        found.join(cutoffs, "stratum", "left")
        .withColumn("kept", ~F.col("base_failed") & ~over)
        .withColumn("doc_id", public_id())
    )
