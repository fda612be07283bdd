"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn and adds a shallow tree on one feature's bins each time; the trees of a feature
sum up to one lookup table. The pairs that explain most of what is left get tables of their own, boosted the same way. A
score is the logistic of an intercept and a sum of looked-up bins, taken for a whole batch of rows at once.

The model is fitted on at most ``FIT_ROWS`` labelled rows, of which only the features reach the driver. Every document is
scored on its whole text.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm import common

FIT_ROWS, FOLD, HELD_OUT, THRESHOLD = 20_000, 5, 0, 0.3
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE, LEAST = 32, 12, 4, 40, 0.2, 10
FEATURES = ["log_words", "word_length", "upper_share", "digit_share", "symbol_share", "bars_per_word", "shouts_per_word",
            "function_share", "different_share", "repeated_lines", "symbol_ends", "log_line", "wide_share", "stops_per_word"]
#: Frequent function words of the corpus's languages.
FUNCTION_WORDS = frozenset("""a an and are as at be by for from in is it of on or that the this to was with
    das dem den der des die ein eine für im ist mit nicht sich und von zu auf als
    au dans de du elle en est et il la le les par pas pour que qui sur un une
    al con del el es las lo los no para por se su una y""".split())
#: Class of each byte: 0 other, 1 lower-case letter, 2 upper-case letter, 3 digit, 4 white space, 5 symbol, 6 beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(97, 123)]], _CLASS[[*range(65, 91)]], _CLASS[[*range(48, 58)]] = 1, 2, 3
_CLASS[[32, *range(9, 14)]], _CLASS[list(b"#$%&*+/<=>@\\^_`{|}~[]")], _CLASS[128:] = 4, 5, 6


def features_of(text: bytes) -> list[float]:
    """The features of one whole text, all of them 0 where there is nothing to count."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    group = np.bincount(_CLASS, weights=counts, minlength=7)
    words = text.split()
    n, size = max(1, len(words)), max(1.0, float(len(text)))
    lowered = [w.lower().rstrip(b".,;:") for w in words]
    lines = [x for x in text.split(b"\n") if x]
    function = sum(map(_FUNCTION.__contains__, lowered))
    ends = sum(map(_SYMBOL_END.__contains__, [w[-1] for w in words]))
    return [float(np.log1p(len(words))), (size - group[4]) / n if words else 0.0, group[2] / max(1.0, group[1] + group[2]), group[3] / size,
            group[5] / size, counts[124] / n, counts[33] / n, function / n, len(set(lowered)) / n,
            1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0, ends / n, float(np.log1p(len(text) / max(1, len(lines)))), group[6] / size, counts[46] / n]


_FUNCTION = frozenset(w.encode() for w in FUNCTION_WORDS)
_SYMBOL_END = frozenset(b"#$%&*!|<>=@~^_")


@dataclass
class Model:
    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)             # of each feature, ascending
    tables: list[np.ndarray] = field(default_factory=list)           # a value for each of its bins
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)   # features, bin maps, table

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows of ``x``: lookups and additions of whole columns."""
        out = np.full(len(x), self.intercept)
        bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]
        for b, table in zip(bins, self.tables, strict=True):
            out += table[b]
        for i, j, mi, mj, table in self.pairs:
            out += table[mi[bins[i]], mj[bins[j]]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Newton steps of a tree of at most ``2**depth`` leaves over ordered bins; g, h, n: gradient, curvature and rows of each bin."""
    if depth:
        gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
        gain = gl ** 2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
        gain[(nl < LEAST) | (n.sum() - nl < LEAST)] = -1
        if len(gain) and gain.max() > 1e-9:
            k = int(gain.argmax()) + 1
            return np.concatenate([shallow_tree(g[:k], h[:k], n[:k], depth - 1), shallow_tree(g[k:], h[k:], n[k:], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + 1))


def shallow_grid(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """The same over a grid of two features' bins: the best cut of one, then the best cut of the other on either side."""
    best = None
    for axis in (0, 1):
        a, b, c = (np.moveaxis(m, axis, 0) for m in (g, h, n))
        for k in range(1, len(a)):
            step, gain = np.empty_like(a), 0.0
            for part in (slice(0, k), slice(k, None)):
                inner = shallow_tree(a[part].sum(0), b[part].sum(0), c[part].sum(0), 1)
                step[part] = inner
                gain += float((inner * a[part].sum(0)).sum())
            if best is None or gain > best[1]:
                best = np.moveaxis(step, 0, axis), gain
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit on rows ``x`` with labels 0/1. No rows: every score is 1/2; one class only: a constant near it."""
    if not len(y):
        return Model(0.0)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(rate / (1 - rate))))
    if len(np.unique(y)) < 2:
        return model
    d = x.shape[1]
    model.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    margin = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(d):
            g, h = slopes()
            m = len(model.tables[j])
            step = RATE * shallow_tree(*(np.bincount(bins[j], w, m) for w in (g, h, np.ones(len(y)))))
            model.tables[j] += step
            margin += step[bins[j]]
    coarse = [np.arange(len(t)) * min(PAIR_BINS, len(t)) // len(t) for t in model.tables]
    wide = [int(c.max()) + 1 for c in coarse]

    def grid(i: int, j: int) -> tuple[np.ndarray, tuple[np.ndarray, float]]:
        cell = coarse[i][bins[i]] * wide[j] + coarse[j][bins[j]]
        g, h = slopes()
        return cell, shallow_grid(*(np.bincount(cell, w, wide[i] * wide[j]).reshape(wide[i], wide[j]) for w in (g, h, np.ones(len(y)))))

    gains = sorted(((grid(i, j)[1][1], i, j) for i in range(d) for j in range(i) if wide[i] > 1 and wide[j] > 1), reverse=True)
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((wide[i], wide[j]))) for _, i, j in gains[:PAIRS]]
    for _ in range(ROUNDS // 4):
        for i, j, _, _, table in model.pairs:
            cell, (step, _) = grid(i, j)
            table += RATE * step
            margin += RATE * step.ravel()[cell]
    return model


def raw(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the features of at most ``fit_rows`` labelled documents outside the held-out fold."""
    common.small_batches(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def values(texts: pd.Series) -> pd.Series:
        return pd.Series([features_of(x) for x in texts])

    chosen = common.labelled(labels, label, FOLD, HELD_OUT, fit_rows)
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")        # fit_rows ids at most
            .select("doc_id", "y", values(raw(F.col("text"))).alias("x")))
    # a doc_id that stands for several rows may not pass the bound
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(fit_rows).collect()
    return fit(np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in got], float))


def score_of(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features_of(t) for t in texts], float).reshape(-1, len(FEATURES))
        return pd.Series(model.scores(x) if model.cuts else np.full(len(x), 1 / (1 + np.exp(-model.intercept))))

    return score(raw(text))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: ``doc_id, held_out, score, predicted``.

    Null and empty texts are scored on features that are all 0; a null doc_id is not held out. Repeated rows get equal
    scores. Labels of unknown documents, null labels and other columns have no effect. An empty table gives none.
    """
    model = trained(docs, labels)
    out = docs.select("doc_id", F.coalesce(common.in_fold(F.col("doc_id"), FOLD, HELD_OUT), F.lit(False)).alias("held_out"),
                      score_of(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents scored below the threshold, all columns kept."""
    model = trained(docs, labels)
    rows = docs.select(F.struct("*").alias("row"), score_of(F.col("text"), model).alias("score"))
    return rows.where(F.col("score") >= THRESHOLD).select("row.*")
