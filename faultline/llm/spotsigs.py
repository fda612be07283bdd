"""SpotSigs document fingerprints, in DataFrame operations only.

A signature is a common word and the chain of the next content words after it. A document's fingerprint is the set of its
signatures; two fingerprints are compared by Jaccard similarity. Candidates for near duplicates are pruned by set size
(partitions of sizes whose ratio allows the threshold) and by the rarest signatures of a set, of which a similar one must
share at least one.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline.llm import common
from faultline.llm.common import let
from faultline.session import cut_lineage

#: Anchors: very frequent words of the languages at hand.
ANCHORS = sorted(set("""a an and are as at be by for from in is it of on or that the this to was with
    das dem den der des die ein eine für im ist mit nicht sich und von zu auf als
    au dans de du elle en est et il la le les par pas pour que qui sur un une
    al con del el es las lo los no para por se su una y""".split()))
CHAIN = 2                              # content words of a chain
RUN = 8                                # content words in a row after which each further one stands as an anchor of its own
THRESHOLD = 0.8


def signatures(text: Column) -> Column:
    """Sorted set of 32-bit signature hashes of a whole text that is not null.

    Words are runs of letters and digits, lower-cased. Where more than ``RUN`` content words follow each other (tables,
    lists, unknown languages), each further one starts a chain without an anchor. Texts in which nothing starts a chain get
    the chains of all neighbouring words, or their words, or their characters, as one signature; the empty text has none.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def chains(w: Column) -> Column:
        content = F.filter(F.transform(w, lambda x, i: F.when(~x.isin(ANCHORS), i)), lambda i: i.isNotNull())
        return let(content, lambda p: starts(w, p))

    def starts(w: Column, p: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(p) - CHAIN)

        def starts_chain(j: Column) -> Column:
            at, before, far = F.get(p, j), F.get(p, j - 1), F.get(p, j - RUN)
            return ((at > 0) & (before.isNull() | (before < at - 1))) | (at - far == RUN)

        def chain(j: Column) -> Column:
            at = F.get(p, j)
            anchor = F.when(F.get(p, j - 1) == at - 1, F.lit("")).otherwise(F.get(w, at - 1))
            return F.hash(anchor, *[F.get(w, F.get(p, j + k)) for k in range(CHAIN)])

        anchored = F.when(F.size(p) >= CHAIN, F.transform(F.filter(places, starts_chain), chain))
        return let(anchored, lambda found: F.when(F.size(found) > 0, found).otherwise(neighbours(w)))

    def neighbours(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(w) - CHAIN), lambda i: F.hash(*[F.get(w, i + k) for k in range(CHAIN)]))
        return (F.when(F.size(w) >= CHAIN, pairs).when(F.size(w) > 0, F.array(F.hash(F.array_join(w, " "))))
                .when(text != "", F.array(F.hash(text))).otherwise(F.array().cast("array<int>")))

    return F.array_sort(F.array_distinct(let(words, chains)))


def digest(sigs: Column) -> Column:
    """A fingerprint's short name: equal for equal sets."""
    return F.lower(F.lpad(F.hex(F.xxhash64(F.size(sigs), sigs)), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of signatures; two empty sets are alike.

    Where one of them is empty, nothing is intersected.
    """
    both = F.size(F.array_intersect(a, b))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .otherwise(let(both, lambda n: n / (F.size(a) + F.size(b) - n))))


def keyed(docs: DataFrame) -> DataFrame:
    """Adds the key of a document, ``d`` and ``h``: its doc_id (null: 0) and a hash of its text and of whether it has a doc_id."""
    return docs.withColumns({"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), "h": F.xxhash64("text", F.isnull("doc_id"))})


def following(docs: DataFrame) -> DataFrame:
    """``(doc_id, d, h, n_chars, next_d, next_h)``: the document after each by ascending doc_id, the first after the last.

    A document is a doc_id and a text; null doc_ids come first, rows repeated in both count once.
    """
    ids = keyed(docs).select("doc_id", "d", "h", F.char_length("text").cast("long").alias("n_chars")).distinct()
    ids = cut_lineage(common.numbered(ids, ["doc_id", "h", "n_chars"]))
    n = max(1, ids.count())
    after = ids.select((F.pmod(F.col("idx") - 1, F.lit(n))).alias("idx"), F.col("d").alias("next_d"), F.col("h").alias("next_h"))
    return cut_lineage(ids.join(after, "idx").drop("idx"))


def edited(docs: DataFrame) -> DataFrame:
    """One row for each document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``,
    and ``signatures`` (how many).

    The edited text has its last quarter of characters, rounded down, replaced by as many first characters of the next
    document (all of it if it is shorter). Null texts count as empty. A single document is its own next one. Rows repeated
    with doc_id and text are one document to their neighbours and stay as often as they stand. Other columns are not read;
    an empty table gives none.

    Texts are shuffled once, by their key; what the next document gives (a quarter and its signatures) is shuffled back.
    """
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = following(whole)
    rows = keyed(whole).select("d", "h", "text").withColumn("sigs", signatures(F.col("text")))
    asked = order.select(F.col("next_d").alias("d"), F.col("next_h").alias("h"), F.col("d").alias("of_d"), F.col("h").alias("of_h"), "doc_id", "n_chars",
                         F.floor(F.col("n_chars") / 4).cast("int").alias("quarter"), F.expr("int(n_chars >= 0)").alias("first"))
    # of rows repeated in doc_id and text only the first is asked; the number costs nothing, as the join sorts by the key anyway
    nth = F.row_number().over(W.partitionBy("d", "h").orderBy("d", "h"))
    given = (rows.withColumn("nth", nth).join(asked, ["d", "h"]).where("nth <= first")
             .select(F.col("of_d").alias("d"), F.col("of_h").alias("h"), "doc_id", "n_chars", "quarter", F.expr("substring(text, 1, quarter)").alias("tail"), F.col("sigs").alias("next_sigs")))
    both = rows.join(given, ["d", "h"]).select("doc_id", "sigs", "next_sigs", "n_chars", F.concat(F.expr("substring(text, 1, cast(n_chars - quarter as int))"), "tail").alias("edited"))
    both = both.withColumn("edited_sigs", signatures(F.col("edited")))
    return both.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digest(F.col("sigs")).alias("fingerprint"),
                       digest(F.col("edited_sigs")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
                       likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"), F.size("sigs").alias("signatures"))


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(a, b, similarity)``: pairs of different fingerprints (by digest, a < b) with a Jaccard similarity of ``threshold`` or more.

    Documents with equal fingerprints are one; ``members`` lists them. A set meets only sets of its own and the next size
    class, on signatures among its rarest ``size - ceil(threshold * size) + 1``, so common signatures are not joined on;
    pairs met more than once are made distinct before they are compared. Empty sets are alike only among themselves.

    No query uses this: one rare signature shared by many different sets makes all their pairs.
    """
    sets = cut_lineage(members(docs).select("digest", "sigs").dropDuplicates(["digest"]))
    each = sets.select("digest", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    seen = each.groupBy("sig").agg(F.count("*").alias("df"))
    ordered = (each.join(seen, "sig").groupBy("digest", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("all")))
    rare = F.slice("all", F.lit(1), (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).cast("int"))
    level = F.floor(F.log(F.col("n")) / F.lit(-math.log(threshold))).cast("int")
    keyed = cut_lineage(ordered.select("digest", "n", level.alias("level"), F.posexplode(rare).alias("pos", "r")).select("digest", "n", "level", "pos", F.col("r.sig").alias("sig")))
    left = keyed.select(F.col("digest").alias("a"), F.col("n").alias("n_a"), F.col("level").alias("part"), "sig")
    right = keyed.select(F.col("digest").alias("b"), F.col("n").alias("n_b"), F.explode(F.array("level", F.col("level") - 1)).alias("part"), "sig")
    wide = (F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b") - 1e-9) & (F.col("a") != F.col("b"))
    found = left.join(right, ["part", "sig"]).where(wide).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one, two = sets.select(F.col("digest").alias("a"), F.col("sigs").alias("sigs_a")), sets.select(F.col("digest").alias("b"), F.col("sigs").alias("sigs_b"))
    alike = found.join(one, "a").join(two, "b").select("a", "b", likeness(F.col("sigs_a"), F.col("sigs_b")).alias("similarity"))
    return alike.where(F.col("similarity") >= threshold)


def members(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, sigs)`` of every row."""
    sigs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", signatures(F.col("text")).alias("sigs"))
    return sigs.select("doc_id", digest(F.col("sigs")).alias("digest"), "sigs")
