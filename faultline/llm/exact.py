"""Exact deduplication with a two-pass Bloom filter.

Pass one puts every text's hash into a filter with two planes, "seen" and "seen again". Pass two tests each row against
the second plane: rows whose hash was certainly met once pass straight through, only the others are shuffled and compared
by SHA-256 of the whole normalised text. The filter can err to one side only, so the result is exact at any fill.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm import common
from faultline.session import cut_lineage

SLICE = 1 << 16                        # bits of a slice: 8 kB a plane
MAX_BITS = 1 << 27                     # the second plane is broadcast: 16 MB at most; fuller filters shuffle more rows
BITS_PER_ROW = 16
SENT_TOGETHER = 1 << 20


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_sha256, key)``: SHA-256 of the text lower-cased in A-Z only (null text: empty), and 64 bits of it."""
    return docs.select("doc_id", digest_of(F.col("text")).alias("text_sha256")).withColumn("key", F.xxhash64("text_sha256"))


def digest_of(text: Column) -> Column:
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), common.UPPER, common.LOWER).cast("binary"), 256)


def filter_bits(rows: int) -> int:
    """A power of two near 16 bits a row, between one slice and the broadcast bound."""
    bits = SLICE
    while bits < min(rows * BITS_PER_ROW, MAX_BITS):
        bits *= 2
    return bits


def positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions for each 64-bit key, one row a key."""
    k = keys.astype(np.int64).view(np.uint64)
    return np.stack([k & np.uint64(bits - 1), (k >> np.uint64(33)) * np.uint64(0x9E3779B1) & np.uint64(bits - 1)], 1).astype(np.int64)


def repeated_plane(hashes: DataFrame, rows: int, least: int = 2) -> tuple[int, DataFrame]:
    """The plane "seen again" as ``(slice, bits)``: a bit is on if two rows set it (``least`` 1: any row).

    Tasks combine their own rows first and send sorted positions with a flag "twice here"; each slice is summed up by one
    group, whose input is at most one entry for a bit and task.
    """
    bits = filter_bits(rows)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[np.ndarray] = []
        for b in batches:
            waiting.append(b["key"].to_numpy())
            if sum(map(len, waiting)) >= SENT_TOGETHER:
                yield from slices(np.concatenate(waiting))
                waiting = []
        if waiting:
            yield from slices(np.concatenate(waiting))

    def slices(keys: np.ndarray) -> Iterator[pd.DataFrame]:
        p, n = np.unique(positions(keys, bits), return_counts=True)
        names, starts = np.unique(p // SLICE, return_index=True)
        at = (p % SLICE).astype("<u2")
        rows = [(s, at[lo:hi].tobytes(), at[lo:hi][n[lo:hi] > 1].tobytes()) for s, lo, hi in zip(names, starts, np.append(starts[1:], len(p)), strict=True)]
        yield pd.DataFrame(rows, columns=["slice", "once", "twice"])

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(SLICE, np.int64)
        for once, twice in zip(parts["once"], parts["twice"], strict=True):
            count[np.frombuffer(once, "<u2")] += 1
            count[np.frombuffer(twice, "<u2")] += 1
        return pd.DataFrame({"slice": [key[0]], "bits": [np.packbits(count >= least, bitorder="little").tobytes()]})

    sent = hashes.select("key").mapInPandas(local, "slice long, once binary, twice binary")
    return bits, sent.groupBy("slice").applyInPandas(merge, "slice long, bits binary")


def possibly_repeated(keyed: DataFrame, rows: int, hashes: DataFrame | None = None) -> DataFrame:
    """Adds ``maybe``: false only where no other row has the same ``key``. ``hashes``: the same keys, if stored apart."""
    bits, plane = repeated_plane(keyed if hashes is None else hashes, rows)
    return tested(keyed, bits, plane)


def tested(keyed: DataFrame, bits: int, plane: DataFrame) -> DataFrame:
    """Adds ``maybe``: false only where the plane ``(slice, bits)`` does not hold ``key``."""
    filled = np.zeros(bits // 8, np.uint8)
    for s, part in plane.collect():                                  # the filter itself: at most MAX_BITS / 8 bytes
        filled[s * SLICE // 8:(s + 1) * SLICE // 8] = np.frombuffer(part, np.uint8)
    shared = keyed.sparkSession.sparkContext.broadcast(filled)

    @F.pandas_udf("boolean")
    def hit(keys: pd.Series) -> pd.Series:
        p = positions(keys.to_numpy(), bits)
        return pd.Series(((shared.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(1))

    return keyed.withColumn("maybe", hit("key"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row for each document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest doc_id stays. Null
    texts count as empty, and empty texts equal each other. A null doc_id loses to any other; a group without any doc_id
    keeps one row. Of rows repeated with the same doc_id and text one stays, the others count as copies. Other columns
    are not read; an empty table gives an empty result.
    """
    hashes = cut_lineage(digests(docs))
    tagged = possibly_repeated(hashes, hashes.count())
    alone = tagged.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    rest = tagged.where("maybe").select("doc_id", "text_sha256")
    # rows repeated with one doc_id are counted first, so that exactly one of them stays
    rest = rest.groupBy("text_sha256", "doc_id").agg(F.count("*").alias("copies"))
    groups = cut_lineage(rest.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")))
    found = rest.join(groups, "text_sha256").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return alone.union(found.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without exact copies, all columns kept; the same rules as ``exact_groups``.

    Rows met once pass straight through. The others are reduced to one row a text inside each task before they travel, so
    a text that a third of all rows share sends one row from each task. Of rows equal in text and doc_id the one with the
    largest hash of all its columns stays.
    """
    hashes = cut_lineage(digests(docs).select("key"))
    keyed = docs.select(F.struct("*").alias("row"), digest_of(F.col("text")).alias("text_sha256"))
    tagged = possibly_repeated(keyed.withColumn("key", F.xxhash64("text_sha256")), hashes.count(), hashes)
    once = tagged.where("not maybe").select("row")
    best = tagged.where("maybe").groupBy("text_sha256").agg(F.max_by("row", F.struct("row.doc_id", common.row_hash("row"))).alias("row")).select("row")
    return once.union(best).select("row.*")
