"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations only.

Each source's documents lie end to end in a shuffled order on a line of words, cut into blocks of equal length that may be
walked again from the start. Slot i of the mix takes the golden-ratio point of i; the source whose stretch of the
cumulative weights holds the point fills the slot with its next block. A source stops at its target, inside a block if
need be, and what the schedule leaves open to it is appended, so each source gives its target to the word.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline.llm import common
from faultline.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE, MOST, BLOCK = 1.5, 2, 1024
PERIOD = 1 << 31
GOLDEN = 1327217885                    # odd number next to 2**31 / golden ratio: i * GOLDEN mod 2**31 visits every point
CELLS = 1024                           # stretches of [0, 1) on which slots meet sources
MOST_SOURCES = 10_000                  # a table of so many sources' borders is broadcast
BUCKET_DIGITS = 3                      # hexadecimal digits of the shuffle hash that name a bucket


def words_in(text: Column) -> Column:
    """Number of runs without white space; null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))


def sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)``, written once: texts are read no more after this."""
    return cut_lineage(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")))


def targets(measured: DataFrame) -> DataFrame:
    """``(source, idx, weight, source_size, target)``: sources by code point, null last, weighing 3, 1, 2, 3, ...

    Shares of 150 % of all words; a target above twice its source's size stops there, and the excess is shared among the
    others by weight until none is above. One number for all sources (the level) reaches the driver in each round.
    """
    own = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    own = own.withColumn("_null", F.col("source").isNull())
    ranked = common.numbered(own, ["_null", "source"]).drop("_null")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("idx") % len(WEIGHTS) + 1).cast("int"))
    ranked = cut_lineage(ranked.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:                                                      # a source once at its cap stays there: the level only rises
        capped = F.col("cap") <= F.lit(level) * F.col("weight")
        left, open_weight = ranked.agg(F.lit(SHARE * total) - F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)),
                                       F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        new = left / open_weight if open_weight else level
        if new == level:
            break
        level = new
    target = F.when(F.col("cap") <= F.lit(level) * F.col("weight"), F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return cut_lineage(ranked.select("source", "idx", "weight", "source_size", target.alias("target")))


def schedule(wanted: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(slot, idx, rank)``: the source ``idx`` gives its block ``rank`` (from 0, walking its line again after the end) at ``slot``.

    Points and sources meet on equal cells of [0, 1), ranks are counted by runs of slots first, so neither a heavy source
    nor many small ones gather in a task.
    """
    spark = wanted.sparkSession
    goal = F.floor("target").cast("long")
    need = wanted.select("idx", goal.alias("goal")).where("goal > 0").withColumn("need", F.ceil(F.col("goal") / block).cast("long"))
    need = common.running_total(need.withColumn("_chunk", F.floor(F.col("idx") / 4096)), [], "_chunk", ["idx"], "goal", "before")
    need = cut_lineage(need.drop("_chunk"))
    total, slots = need.agg(F.sum("goal"), F.sum("need")).first()
    if not total:
        return spark.createDataFrame([], "slot long, idx long, rank long")
    low, high = F.col("before") / F.lit(total) * CELLS, (F.col("before") + F.col("goal")) / F.lit(total) * CELLS
    held = (need.select("idx", "need", low.alias("low"), high.alias("high"))
            .withColumn("cell", F.explode(F.sequence(F.floor("low"), F.least(F.floor("high"), F.lit(CELLS - 1))))))
    point = (F.col("id") % PERIOD * GOLDEN % PERIOD) / PERIOD * CELLS
    drawn = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.floor("point"))
    given = drawn.join(held, "cell").where("point >= low and point < high").select("slot", "idx", "need")
    given = given.withColumn("run", F.floor(F.col("slot") / 65536)).withColumn("one", F.lit(1).cast("long"))
    ranked = common.running_total(given, ["idx"], "run", ["slot"], "one", "rank").where("rank < need").select("slot", "idx", "rank")
    ranked = cut_lineage(ranked)
    have = ranked.groupBy("idx").agg(F.count("*").alias("have"))
    missing = need.join(have, "idx", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < need")
    tail = missing.select("idx", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("rank"))
    tail = tail.select((F.lit(slots) + F.col("rank")).alias("slot"), "idx", "rank")
    return ranked.unionByName(tail)


def laid_out(measured: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds ``source_size``, ``target``, ``idx`` and ``start``, the first word's place on the source's shuffled line."""
    keyed = measured.join(wanted, measured["source"].eqNullSafe(wanted["source"])).select(
        "doc_id", wanted["source"].alias("source"), "size", wanted["idx"], "source_size", "target", shuffle_key(F.col("doc_id")).alias("key"))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    return common.running_total(keyed, ["idx"], "bucket", ["key", "doc_id", "size"], "size", "start")


def placed(measured: DataFrame, wanted: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(doc_id, idx, size, start, slot, rank, from_word, words)``: the pieces of documents that fill each slot."""
    line = laid_out(measured, wanted).where("size > 0")
    rounds = line.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))))
    first = F.col("start") + F.col("round") * F.col("source_size")
    laps = rounds.withColumn("a", first).withColumn("b", F.least(first + F.col("size"), F.floor("target"))).where("a < b")
    blocks = laps.withColumn("rank", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    from_, to = F.greatest("a", F.col("rank") * block), F.least("b", (F.col("rank") + 1) * block)
    return blocks.join(slots, ["idx", "rank"]).select("doc_id", "idx", "size", "start", "slot", "rank", (from_ - F.col("a")).alias("from_word"), (to - from_).alias("words"))


def taken_words(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, key, size, source_size, target, taken, first_slot)``, a row for each document."""
    measured = sizes(docs)
    wanted = targets(measured)
    line = cut_lineage(laid_out(measured, wanted))
    pieces = placed(measured, wanted, schedule(wanted))
    taken = pieces.groupBy("idx", "start", "doc_id", "size").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    same = [line["idx"] == taken["idx"], line["start"] == taken["start"], line["size"] == taken["size"], line["doc_id"].eqNullSafe(taken["doc_id"])]
    return line.join(taken, same, "left").select(
        line["doc_id"], "source", "key", line["size"], "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")


def mixed(docs: DataFrame) -> DataFrame:
    """One row for each document: ``doc_id, size, source_size, target, taken, first_slot``.

    ``first_slot`` is the first slot of the mix that holds some of the document (null: none). ``taken`` counts the words that the mix takes, repeats included: none, once, twice, or a part in the one document where
    a source's target falls. A null source is a source of its own. Texts without words have size 0 and give none; rows
    repeated with one doc_id lie next to each other as documents of their own. An empty table gives an empty result.
    """
    return taken_words(docs).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def mixture(docs: DataFrame) -> DataFrame:
    """The documents of the mix with all their columns: a row for each time that a document is taken.

    The document where a source's target falls is cut to the words taken, joined by single spaces; ``n_chars`` follows
    the text. Documents that the mix does not take go.

    Along a source's shuffled line documents are taken twice, then once, then not at all. Texts stay where they are and look
    up these borders of their source; only rows with the doc_id of a border document, and those without words, which
    go, meet their own counts.
    """
    counted = cut_lineage(taken_words(docs))
    place = F.struct("key", "doc_id")
    times = F.when(F.col("taken") == 0, 0).when(F.col("taken") == F.col("size"), 1).when(F.col("taken") == 2 * F.col("size"), 2)
    by_doc = (counted.where("size > 0").groupBy("source", "key", "doc_id")
              .agg(F.min(F.coalesce(times, F.lit(-1))).alias("low"), F.max(F.coalesce(times, F.lit(-1))).alias("high")))
    mixed_up = (F.col("low") < 0) | (F.col("low") != F.col("high"))
    borders = cut_lineage(by_doc.groupBy("source").agg(
        F.max(F.when(~mixed_up & (F.col("low") == 2), place)).alias("twice"), F.max(F.when(~mixed_up & (F.col("low") >= 1), place)).alias("once"),
        F.collect_list(F.when(mixed_up, place)).alias("border")))                    # the target falls into one document
    few = borders.count() <= MOST_SOURCES
    b = (F.broadcast(borders) if few else borders).select(F.col("source").alias("_source"), "twice", "once", "border")
    own = F.struct(shuffle_key(F.col("doc_id")).alias("key"), F.col("doc_id").alias("doc_id"))
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("_of"), own.alias("place"))
    rows = rows.join(b, F.col("_of").eqNullSafe(F.col("_source")))
    at_border = F.exists("border", lambda x: x.eqNullSafe(F.col("place")))
    laps = F.when(F.col("place") <= F.col("twice"), 2).when(F.col("place") <= F.col("once"), 1).otherwise(0)
    whole = (rows.where(~at_border).where(F.regexp_like("row.text", F.lit(common.WORD)))
             .select("row", F.explode(F.array_repeat(F.lit(0), laps)).alias("lap")).select("row.*"))
    cut_docs = rows.where(at_border).select("row.*")
    return whole.unionByName(border_rows(cut_docs, counted.select(F.col("source").alias("_source"), F.struct("key", "doc_id").alias("place"), "doc_id", "size", "taken")
                                         .join(b.select(F.col("_source").alias("_of"), "border"), F.col("_source").eqNullSafe(F.col("_of")))
                                         .where(at_border)))


def border_rows(docs: DataFrame, counted: DataFrame) -> DataFrame:
    """The rows of the documents in which targets fall, each as often and as long as ``counted`` (doc_id, size, taken) says."""
    each = counted.where("taken > 0").groupBy(F.struct("doc_id", "size").alias("k")).agg(F.array_sort(F.collect_list("taken")).alias("takes"))   # rows of one doc_id
    keyed = docs.select(F.struct("*").alias("row"), F.struct("doc_id", words_in(F.col("text")).alias("size")).alias("k")).withColumn("h", common.row_hash("row"))
    nth = F.row_number().over(W.partitionBy("k").orderBy("h"))
    hit = keyed.withColumn("nth", nth).join(each, "k").select("row", F.col("k.size").alias("size"), F.get("takes", F.col("nth") - 1).alias("taken"))
    hit = hit.where("taken > 0").withColumn("words", F.explode(F.transform(
        F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")).cast("long")),
        lambda i: F.least("size", F.col("taken") - (i - 1) * F.col("size")))))
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(common.WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("row.text"))
    out = hit.withColumn("row", F.col("row").withField("text", text))
    if "n_chars" in docs.columns:
        out = out.withColumn("row", F.col("row").withField("n_chars", F.char_length("row.text").cast(docs.schema["n_chars"].dataType)))
    return out.select("row.*")


#: The same for DuckDB; the slots are those of the golden-ratio walk.
SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM d GROUP BY source),
    w AS (SELECT *, [3, 1, 2][idx % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
    levels AS (SELECT 0 AS i, CAST(-1.0 AS DOUBLE) AS level UNION ALL
      SELECT i + 1, (SELECT (CAST(1.5 AS DOUBLE) * sum(source_size) - coalesce(sum(cap) FILTER (cap <= level * weight), 0))
        / sum(weight) FILTER (NOT cap <= level * weight) FROM w) FROM levels WHERE i < 60),
    g AS (SELECT max(level) AS level FROM levels),
    t AS (SELECT w.*, CASE WHEN cap <= level * weight THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target FROM w, g),
    l AS (SELECT d.doc_id, d.size, t.idx, source_size, target, row_number() OVER () AS row, CAST(sum(d.size) OVER (PARTITION BY t.idx ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null')),
        d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    need AS (SELECT idx, goal, CAST(ceil(goal / {BLOCK}) AS BIGINT) AS need, CAST(sum(goal) OVER (ORDER BY idx) AS BIGINT) - goal AS before, CAST(sum(goal) OVER () AS BIGINT) AS total
      FROM (SELECT idx, CAST(floor(target) AS BIGINT) AS goal FROM t) WHERE goal > 0),
    held AS (SELECT *, before::DOUBLE / total * {CELLS} AS low, (before + goal)::DOUBLE / total * {CELLS} AS high FROM need),
    drawn AS (SELECT slot, (slot % {PERIOD} * {GOLDEN} % {PERIOD})::DOUBLE / {PERIOD} * {CELLS} AS point FROM range((SELECT CAST(sum(need) AS BIGINT) FROM need)) r(slot)),
    given AS (SELECT idx, slot, need, row_number() OVER (PARTITION BY idx ORDER BY slot) - 1 AS rank FROM drawn JOIN held ON point >= low AND point < high),
    slots AS (SELECT idx, rank, slot FROM given WHERE rank < need UNION ALL
      SELECT idx, rank, (SELECT CAST(sum(need) AS BIGINT) FROM need) + rank FROM (SELECT idx, unnest(range(need)) AS rank FROM need) m WHERE NOT EXISTS (SELECT 1 FROM given g WHERE g.idx = m.idx AND g.rank = m.rank)),
    laps AS (SELECT row, idx, start + lap * source_size AS a, least(start + lap * source_size + size, CAST(floor(target) AS BIGINT)) AS b FROM l, range({MOST}) x(lap)),
    blocks AS (SELECT row, idx, a, b, unnest(generate_series(a // {BLOCK}, (b - 1) // {BLOCK})) AS rank FROM laps WHERE a < b),
    met AS (SELECT row, CAST(sum(least(b, (rank + 1) * {BLOCK}) - greatest(a, rank * {BLOCK})) AS BIGINT) AS taken, min(slot) AS first_slot FROM blocks JOIN slots USING (idx, rank) GROUP BY row)
    SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot FROM l LEFT JOIN met USING (row)"""
