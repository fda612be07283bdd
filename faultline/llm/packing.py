"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents of equal length are interchangeable, so the packing is planned on the histogram of lengths, which has at most as
many entries as a sequence has places, however many documents there are: pieces above a third of the capacity are matched
greedily, the largest with the largest that still fits beside it, at most two in a bin; shorter ones go, longest first,
into the tightest gap that takes them. Whole classes of equal bins are filled in one step. Pieces then look up their place
by length and rank among the pieces of that length.
"""
from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from faultline.llm import common, tokens
from faultline.session import cut_lineage

CAPACITY, END_ID = 4096, 1


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each document's ids and the end id, cut at ``capacity``.

    A null or empty text has the end id alone. ``ids`` holds little-endian unsigned 32-bit ids. Other columns are not read.
    """
    path = path or tokens.default_path()
    width, end = 4 * capacity, END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokens.encoder(path)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids = encoder.encode([text])[0] + end
                for p, lo in enumerate(range(0, len(ids), width)):
                    part = ids[lo:lo + width]
                    rows.append((doc_id, p, lo // 4, len(part) // 4, zlib.crc32(part), part)[:6 if with_ids else 5])
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:6 if with_ids else 5]).astype({"doc_id": "Int64"})
        encoder.rest()

    common.small_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return read.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Segments ``(length, first rank, first sequence, pieces a sequence, offset)`` and the number of sequences.

    The k-th piece after a segment's first rank stands in sequence ``first + k // per`` at ``offset + k % per * length``.
    """
    left = {x: n for x, n in histogram.items() if n}
    rank = dict.fromkeys(left, 0)
    segments: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}                      # free places: classes (first sequence, sequences)
    order: list[int] = []                                            # the free places that occur, ascending
    made = 0

    def put(length: int, first: int, bins: int, per: int, offset: int, last: int | None = None) -> None:
        segments.append((length, rank[length], first, per, offset))
        n = last if last is not None else bins * per
        rank[length] += n
        left[length] -= n

    def open_gap(free: int, first: int, bins: int) -> None:
        if free and bins:
            if free not in gaps:
                insort(order, free)
                gaps[free] = []
            gaps[free].append((first, bins))

    large = sorted(x for x in left if 3 * x > capacity)
    while large:
        a = large[-1]
        at = bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else None
        if b == a and left[a] == 1:
            b = large[at - 1] if at else None
        if b is None:
            n = left[a]
            put(a, made, n, 1, 0)
            open_gap(capacity - a, made, n)
        elif b == a:
            n = left[a] // 2
            put(a, made, n, 2, 0)
            open_gap(capacity - 2 * a, made, n)
        else:
            n = min(left[a], left[b])
            put(a, made, n, 1, 0)
            put(b, made, n, 1, a)
            open_gap(capacity - a - b, made, n)
        made += n
        large = [x for x in large if left[x]] if not left[a] or (b is not None and not left[b]) else large
    for x in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[x]:
            at = bisect_left(order, x)
            if at == len(order):                                     # no gap takes it: new bins
                per = capacity // x
                bins = -(-left[x] // per)
                open_gap(capacity, made, bins)
                made += bins
                continue
            free = order[at]
            first, bins = gaps[free].pop()
            if not gaps[free]:
                del gaps[free]
                order.pop(at)
            per = free // x
            full = min(bins, left[x] // per)
            if full:
                put(x, first, full, per, capacity - free)
                open_gap(free - per * x, first, full)
            rest = left[x] if full < bins else 0
            if rest:                                                 # fewer than fill one more bin
                put(x, first + full, 1, per, capacity - free, rest)
                open_gap(free - rest * x, first + full, 1)
            open_gap(free, first + full + bool(rest), bins - full - bool(rest))
    return np.array(segments, np.int64).reshape(-1, 5), made


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``doc_id, piece, length``; every other column is kept.

    Sequences are filled from 0 without gaps. Repeated rows are packed as pieces of their own; a null doc_id is one like
    any other. Which of equally long pieces takes which place is settled by a hash of (doc_id, piece).
    """
    kept = cut.columns
    rows = cut.select(F.struct("*").alias("row"), "length", F.xxhash64("doc_id", "piece").alias("mixed"), F.lit(1).cast("long").alias("one"))
    rows = rows.withColumn("bucket", F.pmod("mixed", F.lit(256)))
    counts = dict(rows.groupBy("length").agg(F.count("*")).collect())           # at most one number for each place of a sequence
    segments, _ = plan(counts, capacity)
    segments = segments[np.lexsort((segments[:, 1], segments[:, 0]))]
    shared = cut.sparkSession.sparkContext.broadcast(segments)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seg = shared.value
        size, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(seg[:, 0] * (1 << 44) + seg[:, 1], size * (1 << 44) + r, side="right") - 1
        k = r - seg[at, 1]
        return pd.DataFrame({"sequence_id": seg[at, 2] + k // seg[at, 3], "offset": seg[at, 4] + k % seg[at, 3] * size})

    ranked = common.running_total(rows, ["length"], "bucket", ["mixed", "row.doc_id", "row.piece"], "one", "rank")
    return ranked.withColumn("place", place("length", "rank")).select(*[F.col("row")[c].alias(c) for c in kept], "place.*")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, a row for each piece of each document."""
    return packed(cut_lineage(pieces(docs, path, capacity)), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` of packed pieces with their ``ids``: at most one capacity of ids in a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
