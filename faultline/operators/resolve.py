"""Name resolution and containment joins by equality keys: no name is compared with every other name."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline import rules
from faultline.operators.asof import _day


def contains_pairs(needles: DataFrame, hay: DataFrame, by: list[str], needle: str, text: str, gram: int = 4) -> DataFrame:
    """(by, needle, text) with ``needle`` inside ``text``, for needles of any length but zero.

    A needle is looked up by substrings of one size: the largest power of two that it holds, ``gram`` at least, its own
    length if it is shorter than that. Such a substring is at least half of the needle, so needles that differ in a few
    characters (numbered names) do not meet at the characters they share, and a text is cut once for each size in use, a
    handful. A needle with a substring that no text has is in none; the others keep their rarest one, and the candidates
    are checked. Values are distinct per ``by`` before anything is cut.
    """
    long = F.length(needle)
    size = F.when(long < gram, long).otherwise(F.greatest(F.lit(gram), F.pow(F.lit(2.0), F.floor(F.log2(long))).cast("int")))

    def grams(df, col):
        spots = F.sequence(F.lit(1), F.length(col) - F.col("_z") + 1)
        return df.select(*by, col, "_z", F.explode(F.array_distinct(F.transform(spots, lambda i: F.substring(F.col(col), i, F.col("_z"))))).alias("_g"))

    names = needles.select(*by, needle).where(long > 0).distinct().withColumn("_z", size)
    sizes = names.groupBy().agg(F.collect_set("_z").alias("_zs"))                 # one row, as many sizes as the longest needle has binary digits
    texts = (hay.select(*by, text).distinct().join(F.broadcast(sizes), F.lit(True)).select(*by, text, F.explode("_zs").alias("_z")).where(F.length(text) >= F.col("_z")))
    n, h, key = grams(names, needle), grams(texts, text), [*by, "_z", "_g"]
    freq = h.groupBy(*key).agg(F.count("*").alias("_f"))
    anchor = (n.join(freq, key, "left").groupBy(*by, "_z", needle).agg(F.min_by("_g", F.struct("_f", "_g")).alias("_g"), (F.count("_f") == F.count("*")).alias("_all"))
              .where("_all").drop("_all"))
    return anchor.join(h, key).where(F.contains(F.col(text), F.col(needle))).select(*by, needle, text)


def resolve_names(names: DataFrame, entities: DataFrame, tokens: DataFrame) -> DataFrame:
    """names: base, issuer_id, relationship → entity_id, group_id, matched_by.

    entities: name, how, entity_id, group_id (one row per known name); tokens: token, group_id, match.
    Order: self reference, exact or alias, longest token (prefix, or anywhere), stated relationship, unresolved.
    Token lookups join on substrings of the lengths that tokens have.
    """
    groups = entities.groupBy("entity_id").agg(F.first("group_id").alias("_ig"))
    known = entities.select(F.col("name").alias("base"), F.col("entity_id").alias("_e"), F.col("group_id").alias("_g"), F.col("how").alias("_how"))
    lengths = tokens.agg(F.collect_set(F.length("token")).alias("_lens"))         # one row, at most the longest token
    left = names.select("base").distinct().join(known.select("base"), "base", "left_anti")
    cut = left.join(F.broadcast(lengths), F.lit(True)).withColumn("_n", F.explode("_lens")).where(F.length("base") >= F.col("_n"))
    spots = cut.select("base", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("base") - F.col("_n") + 1),
                                                        lambda i: F.substring(F.col("base"), i, F.col("_n")))).alias("_at", "token"))
    hit = (spots.join(tokens.select("token", F.col("group_id").alias("_tg"), "match"), "token").where((F.col("_at") == 0) | (F.col("match") == "contains"))
           .groupBy("base").agg(F.max_by("_tg", F.struct(F.length("token"), "token")).alias("_tg")))
    t = (names.join(known, "base", "left").join(hit, "base", "left")
         .join(groups.withColumnRenamed("entity_id", "issuer_id"), "issuer_id", "left"))
    own = F.col("base").isin(*rules.SELF_NAMES) & F.col("issuer_id").isNotNull()
    related = F.col("relationship").isin(*rules.IN_ISSUER_GROUP) & F.col("_ig").isNotNull()
    return t.select(
        *names.columns,
        F.when(own, F.col("issuer_id")).otherwise(F.col("_e")).alias("entity_id"),
        F.when(own, F.col("_ig")).when(F.col("_e").isNotNull(), F.col("_g")).when(F.col("_tg").isNotNull(), F.col("_tg"))
         .when(related, F.col("_ig")).alias("group_id"),
        F.when(own, "self_reference").when(F.col("_e").isNotNull(), F.col("_how")).when(F.col("_tg").isNotNull(), "group_token")
         .when(related, "relationship").otherwise("unresolved").alias("matched_by"),
    ).withColumn("node_id", F.coalesce("entity_id", F.concat(F.lit("N_"), "base")))


def match_titles(wanted: DataFrame, listed: DataFrame, tolerance: int = 3, shortest: int = 8) -> DataFrame:
    """wanted: id, key, date; listed: key, date → id, found ('same', 'contained' or null).

    Same normalised title within a few days, else one title inside the other (at least ``shortest`` characters).
    Dates are bucketed by the tolerance, so a title repeated daily is not joined with all its copies.
    """
    width = tolerance + 1
    b = lambda c: F.floor(_day(F.col(c)) / width)
    w = wanted.withColumn("_b", F.explode(F.array(b("date") - 1, b("date"), b("date") + 1)))
    l = listed.select("key", F.col("date").alias("_d")).distinct().withColumn("_b", b("_d"))
    same = (w.join(l, ["key", "_b"]).where(F.abs(F.datediff("date", "_d")) <= tolerance).select("id").distinct())
    rest = wanted.join(same, "id", "left_anti")
    keys = rest.where(F.length("key") >= shortest).select(F.col("key").alias("a")).distinct()
    texts = listed.where(F.length("key") >= shortest).select(F.col("key").alias("b")).distinct()
    inside = contains_pairs(keys, texts, [], "a", "b", gram=shortest).select("a")
    around = contains_pairs(texts, keys, [], "b", "a", gram=shortest).select("a")
    part = rest.join(inside.union(around).distinct().withColumnRenamed("a", "key"), "key", "left_semi").select("id")
    return (wanted.join(same.withColumn("_s", F.lit("same")).unionByName(part.withColumn("_s", F.lit("contained"))), "id", "left")
            .withColumnRenamed("_s", "found"))
