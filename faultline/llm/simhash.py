"""SimHash near-duplicates: fingerprints of 3-word shingles, linked at a small Hamming distance by bit-sliced comparison.

Two fingerprints that differ in at most two bits agree in three of five blocks, so candidates share one of ten keys of
three blocks. Inside a key, bit planes are stored vertically: one word holds the same bit of 64 fingerprints, distances to
all of them are counted at once by carry-save counters, and a comparison is abandoned once every lane is over the radius.
Keys shared by more than ``GROUP`` different fingerprints take an exact way of linear size: every member looks up the 65
centres within one bit, since two fingerprints within two bits share a centre and all that share one are within two bits.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm import common, exact
from faultline.session import cut_lineage

SHINGLE, SEED, RADIUS = 3, 42, 2
GROUP = 512
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]           # (lowest bit, bits)


def fingerprint_of(text: bytes) -> int:
    """A bit is 1 if set in over half of the shingles' hashes; no words: zero. A-Z are lower-cased, nothing else."""
    words = text.lower().split()                                     # bytes split at \x20 and \x09-\x0D only
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:])], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` with the 64 bits as a signed long."""
    common.small_batches(docs.sparkSession)
    return docs.select("doc_id", fp_of(F.col("text")).alias("fp"))


def fp_of(text: Column) -> Column:
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(x) for x in texts], np.uint64).view(np.int64))

    return fp(F.coalesce(text, F.lit("")).cast("binary"))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def over_radius(planes: np.ndarray, queries: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, int]:
    """Lanes that differ in more than two bits, and how many words of planes were read for it.

    ``planes``: (64, groups, words), ``queries``: (64, groups, members) all-ones or zero words, ``over``: (groups, members,
    words) with the lanes set that need no answer. Counters of weight one and two are kept bit-sliced; what carries out of
    them is over the radius for good. Every eight planes the words whose lanes are all over are abandoned.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = over.copy().reshape(-1)
    at = np.flatnonzero(out != full)
    g, q, w = np.unravel_index(at, over.shape)
    ones = np.zeros(len(at), np.uint64)
    twos, lanes, read = ones.copy(), out[at], 0
    for j in range(64):
        x = planes[j][g, w] ^ queries[j][g, q]
        carry = ones & x
        ones ^= x
        lanes |= twos & carry
        twos ^= carry
        lanes |= twos & ones
        read += len(at)
        if j % 8 == 7:
            open_ = lanes != full
            if not open_.all():
                out[at[~open_]] = full
                at, g, q, w, ones, twos, lanes = (v[open_] for v in (at, g, q, w, ones, twos, lanes))
            if not len(at):
                break
    out[at] = lanes
    return out.reshape(over.shape), read


def sliced(bits: np.ndarray) -> np.ndarray:
    """(groups, lanes, 64) bits to (64, groups, words) with 64 lanes a word; lanes is a multiple of 64."""
    g, lanes, _ = bits.shape
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little").transpose(2, 0, 1)).view("<u8").reshape(64, g, lanes // 64)


def links_within(groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For groups of different fingerprints: each member and the smallest position it reaches by links inside its group.

    Returns flat arrays (member value, representative value), members that link to nobody left out.
    """
    left, right = [], []
    sizes = np.array([len(g) for g in groups])
    for words in np.unique((sizes + 63) // 64):
        same = [groups[i] for i in np.flatnonzero((sizes + 63) // 64 == words)]
        lanes = int(words) * 64
        step = max(1, 4096 // lanes)
        for lo in range(0, len(same), step):
            part = same[lo:lo + step]
            value = np.zeros((len(part), lanes), np.uint64)
            valid = np.zeros((len(part), lanes), bool)
            for i, g in enumerate(part):
                value[i, :len(g)], valid[i, :len(g)] = g, True
            bits = np.unpackbits(value.view(np.uint8).reshape(len(part), lanes, 8), axis=2, bitorder="little")
            # planes in which members differ most are read first, so that words are abandoned early
            share = bits.reshape(-1, 64).mean(0)
            order = np.argsort(np.abs(share - 0.5), kind="stable")
            bits = np.ascontiguousarray(bits[:, :, order])
            planes = sliced(bits)
            empty = np.ascontiguousarray(np.packbits(~valid, axis=1, bitorder="little")).view("<u8")         # (groups, words)
            lane = np.arange(lanes)
            label = np.arange(value.size).reshape(value.shape)
            pairs = []
            for q in range(0, max(map(len, part)), 64):              # 64 members of every group at a time
                member = bits[:, q:q + 64, :].transpose(2, 0, 1)
                upto = np.packbits(lane[None, :] <= q + np.arange(member.shape[2])[:, None], axis=1, bitorder="little").view("<u8")
                closed = empty[:, None, :] | upto[None, :, :]        # a member is compared with later ones only
                closed[~valid[:, q:q + 64]] = np.uint64(0xFFFFFFFFFFFFFFFF)
                over, _ = over_radius(planes, np.uint64(0) - member.astype(np.uint64), closed)
                near = np.unpackbits(np.ascontiguousarray(~over).view(np.uint8), axis=2, bitorder="little").astype(bool)
                g, a, b = np.nonzero(near)
                pairs.append((label[g, a + q], label[g, b]))
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            root = label.ravel().copy()
            while len(a):
                before = root.copy()
                np.minimum.at(root, b, root[a])
                np.minimum.at(root, a, root[b])
                root = root[root]
                if (before == root).all():
                    break
            moved = np.flatnonzero(root != label.ravel())
            left.append(value.ravel()[moved])
            right.append(value.ravel()[root[moved]])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return join(left), join(right)


def links(different: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between different fingerprints ``fp`` that connect exactly what links at the radius connect.

    Members of a key are linked to the smallest they reach in it, so edges stay in proportion to members.
    """
    def key(i: int, blocks: tuple[int, ...]) -> Column:
        parts = [F.shiftrightunsigned("fp", BLOCKS[b][0]).bitwiseAND(F.lit((1 << BLOCKS[b][1]) - 1)) for b in blocks]
        return F.struct(F.lit(i).cast("byte").alias("table"), (
            F.shiftleft(parts[0], 26).bitwiseOR(F.shiftleft(parts[1], 13)).bitwiseOR(parts[2])).alias("bits"))

    keys = F.array(*[key(i, blocks) for i, blocks in enumerate(combinations(range(5), 3))])
    keyed = different.select("fp", F.explode(keys).alias("key")).select("fp", "key.table", "key.bits")
    counts = keyed.groupBy("table", "bits").agg(F.count("*").alias("n")).where("n > 1")
    common.small_batches(different.sparkSession)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = links_within([np.asarray(g, np.int64).view(np.uint64) for g in batch["fps"]])
            if len(a):
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).drop_duplicates()

    counts = cut_lineage(counts)                                     # keys met once are not written
    small = (keyed.join(counts.where(F.col("n") <= GROUP), ["table", "bits"])
             .groupBy("table", "bits").agg(F.collect_list("fp").alias("fps"))        # at most GROUP of 8 bytes
             .select("fps").mapInPandas(compare, "a long, b long"))
    large = keyed.join(counts.where(F.col("n") > GROUP), ["table", "bits"]).select("fp").distinct()
    centres = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << j if j < 63 else -(1 << 63)).cast("long")) for j in range(64)])
    around = large.select("fp", F.explode(centres).alias("centre"))
    stars = (around.groupBy("centre").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)   # 65 at most
             .select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b"))
    return small.union(stars).distinct()


def grouped(marked: DataFrame) -> DataFrame:
    """``(fp, first_id, root)`` for each different fingerprint of ``(doc_id, fp)``; root names its component."""
    different = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = common.components(links(different))
    return cut_lineage(different.join(roots, different["fp"] == roots["node"], "left")
                       .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row for each document: ``doc_id, fp, component_id`` (smallest doc_id reachable by links, itself included).

    Null texts count as empty. Texts without words share fingerprint zero, which links like any other. A null doc_id is
    never the component's id unless all its members lack one. Repeated rows stay repeated. An empty table gives none.
    """
    marked = cut_lineage(fingerprints(docs))
    placed = grouped(marked)
    lowest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = cut_lineage(placed.join(lowest, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest doc_id; all columns kept.

    Of rows repeated with that doc_id the one with the smallest fingerprint and text hash stays, of rows equal in these the
    one with the smallest hash of all columns; a group whose members all lack a doc_id keeps one row.

    Rows that stay as the only ones of their key pass a Bloom filter of the other keys and never travel; only rows that it
    may hold are shuffled to be told apart.
    """
    key = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    common.small_batches(docs.sparkSession)
    marked = cut_lineage(docs.select(*key, fp_of(F.col("text")).alias("fp")))
    placed = grouped(marked)
    copies = marked.groupBy("doc_id", "text_hash", "fp").agg(F.count("*").alias("copies"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "text_hash")
    first = placed.join(copies, "fp").groupBy("root").agg(F.min(rank).alias("first"))
    stays = first.select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), F.lit(True).alias("stays"))
    same = copies["doc_id"].eqNullSafe(stays["doc_id"]) & (copies["text_hash"] == stays["text_hash"])
    told = cut_lineage(copies.join(stays, same, "left").select(copies["doc_id"], copies["text_hash"], "copies", F.coalesce("stays", F.lit(False)).alias("stays"))
                       .where("not stays or copies > 1").withColumn("key", F.xxhash64("doc_id", "text_hash")))
    bits, plane = exact.repeated_plane(told, told.count(), least=1)
    keyed = docs.select(F.struct("*").alias("row"), *key).withColumn("key", F.xxhash64("doc_id", "text_hash"))
    tested = exact.tested(keyed, bits, plane)
    alone = tested.where("not maybe").select("row.*")
    rest, told = tested.where("maybe").alias("r"), told.alias("t")
    found = rest.join(told, (F.col("r.key") == F.col("t.key")) & F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("r.text_hash") == F.col("t.text_hash")), "left")
    missed = found.where("stays IS NULL").select("row.*")                            # the filter erred
    one = (found.where("stays").select("r.doc_id", "r.text_hash", "row").withColumn("h", common.row_hash("row")).groupBy("doc_id", "text_hash")
           .agg(F.min_by("row", "h").alias("row")).select("row.*"))
    return alone.union(missed).union(one)
