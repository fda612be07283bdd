"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and four-letter word beginnings; the vocabulary is the terms whose presence depends most on the label in
the fitting sample. Document frequencies and term counts cover the whole corpus and whole texts. The index holds labelled
examples in blocks of 64: for each term a block of weights and their maximum. A query first bounds every block by the
maxima, then scores blocks in falling order of the bound and stops when no block left can beat its k-th best, so the
neighbours are exact. Votes weighted by similarity are calibrated on the examples' own votes, each left out of its own.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from faultline.llm import common
from faultline.session import cut_lineage

FIT_ROWS, EXAMPLES, TERMS = 20_000, 4096, 1024
FOLD, HELD_OUT, THRESHOLD = 4, 2, 0.3
NEIGHBOURS, BLOCK, POWER, EVIDENCE = 15, 64, 4.0, 3
PREFIX = 4
WORDS = re.compile(r"[^\W\d_]+")
VECTOR = "doc_id long, terms array<int>, counts array<int>"


def terms_of(text: str) -> Counter:
    """Counts of the words of a whole text, lower-cased, and of their beginnings (marked by ``*``)."""
    words = Counter(WORDS.findall(text.lower()))
    out = Counter(words)
    for w, n in words.items():
        if len(w) > PREFIX:
            out[w[:PREFIX] + "*"] += n
    return out


def vocabulary(docs: DataFrame, chosen: DataFrame) -> list[str]:
    """The ``TERMS`` terms with the largest chi-square against the label in the sample; ties go to the smaller term."""
    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(t, y) for text, y in zip(b["text"], b["y"], strict=True) for t in terms_of(text)]
            yield pd.DataFrame(rows, columns=["term", "y"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "y")
    n, pos = chosen.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < pos < n:
        return []
    seen = texts.mapInPandas(spread, "term string, y int").groupBy("term").agg(F.sum("y").alias("a"), (F.count("*") - F.sum("y")).alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    c, d = pos - a, (n - pos) - b
    chi = (a * d - b * c) ** 2 * n / ((a + b) * F.greatest(c + d, F.lit(1.0)) * pos * (n - pos))
    top = seen.where("a + b >= 3").select("term", chi.alias("chi")).orderBy(F.desc("chi"), "term").limit(TERMS)
    return sorted(r["term"] for r in top.collect())                              # TERMS strings


def vectors(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``(doc_id, terms, counts)`` over the vocabulary, for every document."""
    place = {t: i for i, t in enumerate(terms)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [sorted((place[t], n) for t, n in terms_of(x).items() if t in place) for x in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "terms": [[t for t, _ in f] for f in found], "counts": [[n for _, n in f] for f in found]})

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(count, VECTOR)


def frequencies(stored: DataFrame, size: int) -> dict[int, int]:
    """Documents that hold each term, added up inside each task first."""
    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(size, np.int64)
        for b in batches:
            n += np.bincount(np.concatenate([np.zeros(0, np.int64), *b["terms"]]).astype(np.int64), minlength=size)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"t": some, "n": n[some]})

    return dict(stored.select("terms").mapInPandas(local, "t long, n long").groupBy("t").agg(F.sum("n")).collect())   # TERMS numbers


def unit(terms, counts, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights (logarithmic counts) of one sparse vector, scaled to length 1."""
    w = (1 + np.log(np.asarray(counts, np.float64))) * idf[np.asarray(terms, np.int64)]
    norm = math.sqrt(float(w @ w))
    return w / norm if norm else w


@dataclass
class Index:
    ids: np.ndarray                    # of the examples, block by block; -1 fills the last block
    labels: np.ndarray
    weights: np.ndarray                # a row for each example: its share of the votes
    blocks: np.ndarray                 # (block, term, lane): weights of 64 examples for each term
    tops: np.ndarray                   # (term, block): the largest of them
    idf: np.ndarray
    base: float                        # share of label 1 among what the examples stand for
    curve: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def nearest(self, terms, weights: np.ndarray, k: int = NEIGHBOURS, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of the k most similar examples, exactly; ties go to the smaller place. Zeros do not count."""
        terms = np.asarray(terms, np.int64)
        bounds = weights @ self.tops[terms]
        places, values, floor = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or bounds[b] < floor * (1 - 1e-6):
                break                                                # no block left can reach the k-th best
            s = weights @ self.blocks[b][terms]
            if 0 <= leave - b * BLOCK < BLOCK:
                s[leave - b * BLOCK] = 0
            hit = np.flatnonzero((s > 0) & (s >= floor * (1 - 1e-6)))
            places, values = np.concatenate([places, hit + b * BLOCK]), np.concatenate([values, s[hit]])
            if len(values) > k:
                keep = np.lexsort((places, -values))[:k]
                places, values, floor = places[keep], values[keep], float(values[keep[-1]])
        order = np.lexsort((places, -values))
        return places[order], values[order]

    def vote(self, places: np.ndarray, values: np.ndarray) -> float:
        """Share of label 1 among the neighbours, each weighing its similarity to the fourth power, with a little of the base rate."""
        w = values ** POWER * self.weights[places]
        prior = 0.02
        return float((w @ self.labels[places] + prior * self.base) / (w.sum() + prior))

    def score(self, votes: np.ndarray) -> np.ndarray:
        return np.interp(votes, *self.curve)


def rising(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling neighbours that fall; mean x and mean y of each pool."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        pools.append([w[i], w[i] * x[i], w[i] * y[i]])
        while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    n, sx, sy = np.array(pools).T
    return sx / n, sy / n


def build(rows: list[tuple[int, list[int], list[int], int]], idf: np.ndarray, totals: dict[int, int]) -> Index:
    """Index of labelled vectors. ``totals``: labelled rows of each class that the examples stand for."""
    unit_rows = [(i, t, unit(t, c, idf), y) for i, t, c, y in rows]
    # examples that share their heaviest term stand together, so that block maxima are close to what the blocks hold
    unit_rows.sort(key=lambda r: (r[1][int(r[2].argmax())] if len(r[1]) else -1, r[0]))
    n, v = len(unit_rows), max(1, len(idf))
    nb = max(1, -(-n // BLOCK))
    blocks = np.zeros((nb, v, BLOCK), np.float32)
    ids, labels, weights = np.full(nb * BLOCK, -1, np.int64), np.zeros(nb * BLOCK), np.zeros(nb * BLOCK)
    here = Counter(r[3] for r in unit_rows)
    for p, (i, t, w, y) in enumerate(unit_rows):
        blocks[p // BLOCK, t, p % BLOCK] = w
        ids[p], labels[p], weights[p] = i, y, totals.get(y, 0) / here[y]
    scale = weights[:n].mean() if n else 1.0
    base = totals.get(1, 0) / max(1, sum(totals.values()))
    index = Index(ids, labels, weights / (scale or 1.0), blocks, np.ascontiguousarray(blocks.max(2).T), idf, base)
    if len(here) == 2:
        votes = np.array([index.vote(*index.nearest(t, w, leave=p)) for p, (_, t, w, _) in enumerate(unit_rows)])
        index.curve = rising(votes, labels[:n], weights[:n])
    else:
        index.curve = (np.array([0.0]), np.array([base]))
    return index


def fitted(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> tuple[Index, DataFrame]:
    """The index and the stored vectors of all documents.

    Bounds: ``FIT_ROWS`` labelled rows choose the vocabulary, ``examples`` of them (half of either label where there are
    as many) are indexed; frequencies for IDF come from every document.
    """
    common.small_batches(docs.sparkSession)
    chosen = cut_lineage(common.labelled(labels, "toxic", FOLD, HELD_OUT, FIT_ROWS))
    terms = vocabulary(docs, chosen)
    stored = cut_lineage(vectors(docs, terms))
    total = stored.count()
    df = frequencies(stored, len(terms))
    idf = np.array([math.log((1 + total) / (1 + df.get(i, 0))) + 1 for i in range(len(terms))])
    totals = dict(chosen.groupBy("y").agg(F.count("*")).collect())
    rows = []
    for y in (0, 1):
        n = max(examples // 2, examples - totals.get(1 - y, 0))
        some = chosen.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        rows += [tuple(r) for r in stored.join(F.broadcast(some), "doc_id").orderBy("doc_id", "terms", "counts").limit(n).select("doc_id", "terms", "counts", "y").collect()]
    return build(rows, idf, totals), stored


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: ``doc_id, held_out, score, predicted, evidence`` (nearest examples: doc_id, label, similarity).

    Null, empty and other texts without a term of the vocabulary have no neighbour and get the calibrated base rate's vote.
    A null doc_id is not held out. Without labels of both classes every score is the labelled rows' share of label 1 (0
    if there are none). Repeated rows get equal scores; other columns are not read; an empty table gives none.
    """
    index, stored = fitted(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(index)         # bounded by TERMS x EXAMPLES
    schema = "doc_id long, score double, evidence array<struct<doc_id:long,label:int,similarity:double>>"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            votes, evidence = [], []
            for t, c in zip(b["terms"], b["counts"], strict=True):
                places, values = own.nearest(t, unit(t, c, own.idf)) if len(t) else (np.zeros(0, np.int64), np.zeros(0))
                votes.append(own.vote(places, values))
                evidence.append([{"doc_id": int(own.ids[p]), "label": int(own.labels[p]), "similarity": round(float(v), 6)}
                                 for p, v in zip(places[:EVIDENCE], values[:EVIDENCE], strict=True)])
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": own.score(np.array(votes)), "evidence": evidence})

    out = stored.mapInPandas(score, schema)
    return out.select("doc_id", F.coalesce(common.in_fold(F.col("doc_id"), FOLD, HELD_OUT), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
