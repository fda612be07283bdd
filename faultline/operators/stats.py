"""Study statistics. Draws are a data dimension; shuffles are ordered by a hash, so they repeat exactly."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline.operators.ordering import positions, text_bucket, with_average_rank


def ln_factorial(n: Column) -> Column:
    """ln n!: a sum for small n, the Stirling series (error below 1e-15) from 256 on."""
    x = n.cast("double")
    exact = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(256)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, k: a + F.ln(k.cast("double")))
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * F.lit(3.141592653589793) * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n <= 256, exact).otherwise(series)


def ln_choose(n: Column, k: Column) -> Column:
    return ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)


def spread(rows: DataFrame, lo: str, hi: str, out: str, chunk: int = 4096) -> DataFrame:
    """A row for each whole number from ``lo`` to ``hi``, by way of chunks, so that no row holds the whole range."""
    starts = rows.withColumn("_c", F.explode(F.sequence(F.floor(F.col(lo) / chunk).cast("bigint"), F.floor(F.col(hi) / chunk).cast("bigint"))))
    inside = F.sequence(F.greatest(F.col("_c") * chunk, F.col(lo).cast("bigint")), F.least(F.col("_c") * chunk + chunk - 1, F.col(hi).cast("bigint")))
    return starts.where(F.col(lo) <= F.col(hi)).withColumn(out, F.explode(inside)).drop("_c")


def fisher_greater(tables: DataFrame, by: list[str], a: str, b: str, c: str, d: str) -> DataFrame:
    """(by, p): one-sided exact p of 2×2 tables, the tail spread over rows."""
    n1, n2, k = F.col(a) + F.col(b), F.col(c) + F.col(d), F.col(a) + F.col(c)
    t = spread(tables.select(*by, n1.alias("_n1"), n2.alias("_n2"), k.alias("_k"), F.col(a).alias("_lo"), F.least(n1, k).alias("_hi")), "_lo", "_hi", "_x")
    n1, n2, k, x = F.col("_n1"), F.col("_n2"), F.col("_k"), F.col("_x")
    term = F.exp(ln_choose(n1, x) + ln_choose(n2, k - x) - ln_choose(n1 + n2, k))
    return t.where(k - x <= n2).withColumn("_t", term).groupBy(*by).agg(F.sum("_t").alias("p"))


def auc(rows: DataFrame, by: list[str], score: str, y: str, weight: str | None = None) -> DataFrame:
    """(by, auc, n_pos, n_neg): positives above negatives, half credit for ties; null without both classes.

    Negatives are ranked as weighted value counts, positives are looked up in them: no pairs are formed.
    """
    w = F.col(weight) if weight else F.lit(1)
    known = rows.where(F.col(score).isNotNull()).withColumn("_s", F.col(score)).withColumn("_w", w)
    neg = F.when(F.col(y), 0).otherwise(F.col("_w"))
    pos = positions(known, by, "_s", weight=neg)
    wins = (known.where(F.col(y)).groupBy(*by, "_s").agg(F.sum("_w").alias("_p")).join(pos, [*by, "_s"])
            .groupBy(*by).agg(F.sum(F.col("_p") * (F.col("before") + F.col("ties") / F.lit(2.0))).alias("_wins"), F.sum("_p").alias("n_pos"), F.max("n").alias("n_neg")))
    return wins.select(*by, F.try_divide(F.col("_wins"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"), "n_pos", "n_neg")


def spearman(rows: DataFrame, by: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """(by, rho, n) from tie-averaged ranks."""
    r = with_average_rank(with_average_rank(rows, by, x, "_rx").drop("n"), by, y, "_ry")
    return r.groupBy(*by).agg(F.when(F.count("*") >= least, F.corr("_rx", "_ry")).alias("rho"), F.count("*").alias("n"))


def shuffled_position(rows: DataFrame, by: list[str], hash_: str, out: str, chars: int = 3) -> DataFrame:
    """1-based position in the order of a hash (or another text); its first ``chars`` characters cut a group into buckets."""
    r = rows.withColumn("_hb", text_bucket(F.col(hash_), chars))
    ahead = (r.groupBy(*by, "_hb").agg(F.count("*").alias("_c"))
             .withColumn("_skip", F.coalesce(F.sum("_c").over(W.partitionBy(*by).orderBy("_hb").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c"))
    return (r.join(ahead, [*by, "_hb"]).withColumn(out, F.col("_skip") + F.row_number().over(W.partitionBy(*by, "_hb").orderBy(hash_))).drop("_hb", "_skip"))


def draw_hash(draw: Column, key: Column) -> Column:
    return F.md5(F.concat(draw.cast("string"), F.lit("|"), key.cast("string")))


def with_draws(rows: DataFrame, draws: int, key: Column, out: str = "draw") -> DataFrame:
    """Rows repeated per draw with the hash that orders the draw."""
    return rows.withColumn(out, F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_h", draw_hash(F.col(out), key))


def resampled(rows: DataFrame, numbered: DataFrame, unit: str, values: list[str], draws: int, most: int = 2_000_000) -> DataFrame:
    """(draw, values, w): how often a draw holds each combination of values, when whole units are drawn with replacement.

    ``numbered`` numbers the units from 0 (``i``); the i-th pick of a draw follows from a hash of both. A task makes whole
    draws and looks its picks up, so what leaves it is bounded by draws x combinations, not by picks. Up to ``most`` rows are
    looked up in a broadcast table, more in a join.
    """
    held = rows.join(numbered, unit).select("i", *values)
    n = max(numbered.count(), 1)
    every = rows.sparkSession.range(0, draws * n, 1, min(draws, 256)).select(F.expr(f"id div {n} + 1").alias("draw"), (F.col("id") % n).alias("_at"))
    at = F.conv(F.substring(draw_hash(F.col("draw"), F.col("_at")), 1, 8), 16, 10).cast("bigint") % n
    pick = every.select("draw", F.coalesce(at, F.lit(0).cast("bigint")).alias("i"))              # never null, so the hash is not copied into a filter
    if rows.count() <= most:
        return pick.join(F.broadcast(held), "i").groupBy("draw", *values).agg(F.count("*").alias("w"))
    return pick.groupBy("draw", "i").agg(F.count("*").alias("_w")).join(held, "i").groupBy("draw", *values).agg(F.sum("_w").alias("w"))


MERSENNE = (1 << 31) - 1
ROUNDS = 8                             # of the network that permutes row numbers


def mixed(value: Column, draw: Column, turn: int) -> Column:
    """A whole number below 2^31 that looks unrelated to its arguments; products stay below 2^63."""
    y = (value * 1103515 + draw * 69069 + (turn * 7919 + 1)) % MERSENNE
    for factor in (48271, 69621):
        y = (y * factor + 12345) % MERSENNE
        y = y.bitwiseXOR(F.shiftright(y, 13))
    return y


def radices(n: int) -> tuple[int, int]:
    """Two numbers near the root of ``n`` whose product is ``n`` or little more."""
    root = max(1, int(n ** 0.5))
    while root * root < n:
        root += 1
    a = min(range(max(1, root // 2), root + 1), key=lambda x: (-(-n // x) * x - n, -x))
    return a, -(-n // a)


def permuted(rows: DataFrame, sizes: dict, by: str, place: str, draw: str, out: str) -> DataFrame:
    """Adds ``out``: where a draw's permutation sends ``place`` (0 to n - 1 within ``by``); no row is sorted or moved.

    A keyed Feistel network over two digits with the radices of ``n``; a value that falls beyond ``n`` is sent on until it
    does not, which takes at most one step more than the product of the radices exceeds ``n``. ``sizes``: n of each ``by``.
    """
    fits = {k: radices(n) for k, n in sizes.items()}
    pick = lambda f: F.coalesce(*[F.when(F.col(by) == F.lit(k), F.lit(f(k)).cast("bigint")) for k in sizes]) if sizes else F.lit(1)
    a, b, n = pick(lambda k: fits[k][0]), pick(lambda k: fits[k][1]), pick(lambda k: sizes[k])
    t = rows.withColumn("_a", a).withColumn("_b", b).withColumn("_n", n).withColumn(out, F.col(place).cast("bigint"))
    steps = max((fits[k][0] * fits[k][1] - sizes[k] + 1 for k in sizes), default=0)
    for step in range(steps):
        t = t.withColumn("_l", F.floor(F.col(out) / F.col("_b"))).withColumn("_r", F.col(out) % F.col("_b"))
        for turn in range(ROUNDS):
            side, other, radix = ("_l", "_r", "_a") if turn % 2 == 0 else ("_r", "_l", "_b")
            t = t.withColumn(side, (F.col(side) + mixed(F.col(other), F.col(draw), turn)) % F.col(radix))
        moved = F.col("_l") * F.col("_b") + F.col("_r")
        t = t.withColumn(out, moved if step == 0 else F.when(F.col(out) >= F.col("_n"), moved).otherwise(F.col(out)))
    return t.drop("_a", "_b", "_n", "_l", "_r")


def permuted_correlation(ranks: DataFrame, by: str, place: str, x: str, y: str, draws: int, most: int = 2_000_000) -> DataFrame:
    """(by, draw, rho): correlation of ``x`` with ``y`` dealt out anew in each draw; ``place`` numbers the rows from 0.

    Only the sum of products changes between draws: each row looks up the y of its draw's place and products are added up
    before they are shuffled. The y of all groups are broadcast as arrays up to ``most`` values, beyond that joined.
    """
    sizes = {r[by]: r["n"] for r in ranks.groupBy(by).agg(F.count("*").alias("n")).collect()}        # a number for each date
    moments = ranks.groupBy(by).agg(F.count("*").alias("_n"), F.sum(x).alias("_sx"), F.sum(y).alias("_sy"), F.sum(F.col(x) * F.col(x)).alias("_sxx"),
                                    F.sum(F.col(y) * F.col(y)).alias("_syy"))
    drawn = ranks.select(by, place, x).withColumn("draw", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(draws).cast("bigint"))))
    drawn = permuted(drawn, sizes, by, place, "draw", "_to")
    if sum(sizes.values()) <= most:
        held = ranks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(place, y))).alias("_p")).select(by, F.col("_p")[y].alias("_ys"))
        met = drawn.join(F.broadcast(held), by).withColumn("_y", F.get("_ys", F.col("_to").cast("int")))
    else:
        # a generated column: the network's expressions are not copied into a filter on the join key
        apart = drawn.select(by, "draw", x, F.explode(F.array("_to")).alias("_to"))
        met = apart.join(ranks.select(by, F.col(place).alias("_to"), F.col(y).alias("_y")), [by, "_to"])
    sums = met.groupBy(by, "draw").agg(F.sum(F.col(x) * F.col("_y")).alias("_sxy"))
    c = F.col
    spread_ = F.sqrt((c("_n") * c("_sxx") - c("_sx") * c("_sx")) * (c("_n") * c("_syy") - c("_sy") * c("_sy")))
    return sums.join(moments, by).select(by, "draw", F.try_divide(c("_n") * c("_sxy") - c("_sx") * c("_sy"), spread_).alias("rho"))


def stratified_statistic(rows: DataFrame, stratum: list[str], exposed: str, y: str) -> DataFrame:
    """Per stratum the counts that decide the exposed-minus-expected statistic, and the statistic itself."""
    t = rows.groupBy(*stratum).agg(F.count("*").alias("n"), F.count_if(F.col(exposed)).alias("e"), F.count_if(F.col(y)).alias("k"),
                                   F.count_if(F.col(exposed) & F.col(y)).alias("x"))
    return t.withColumn("stat", F.col("x") - F.col("e") * F.col("k") / F.col("n"))


def permutation_p(strata: DataFrame, stratum: list[str], draws: int) -> DataFrame:
    """(observed, hits, p): exposure flags shuffled inside strata.

    After a shuffle the number of exposed positives of a stratum is hypergeometric in its counts, so each draw
    takes one number per stratum from that distribution (by a hash between 0 and 1) instead of moving rows.
    """
    lo = F.greatest(F.lit(0), F.col("e") + F.col("k") - F.col("n")).cast("bigint")
    support = spread(strata.select(*stratum, "n", "e", "k", lo.alias("_lo"), F.least("e", "k").alias("_hi")), "_lo", "_hi", "x").drop("_lo")
    prob = F.exp(ln_choose(F.col("k"), F.col("x")) + ln_choose(F.col("n") - F.col("k"), F.col("e") - F.col("x")) - ln_choose(F.col("n"), F.col("e")))
    cdf = _running(support.withColumn("_p", prob), stratum, "x", "_p")
    key = F.concat_ws("|", *[F.col(s).cast("string") for s in stratum])
    # strata are few, their draws and values are not: neither side is to be sent whole
    u = with_draws(strata.select(*stratum, "n", "e", "k"), draws, key).hint("merge").withColumn("u", F.conv(F.substring("_h", 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12)))
    # a value owns the stretch of [0, 1) between its predecessor's sum and its own; stretches meet the draws on equal cells
    top = F.when(F.col("x") == F.col("_hi"), F.lit(2.0)).otherwise(F.col("cdf"))
    cell = lambda c: F.least(F.floor(c * CELLS), F.lit(CELLS)).cast("int")
    held = (cdf.select(*stratum, "x", F.when(F.col("x") == F.greatest(F.lit(0), F.col("e") + F.col("k") - F.col("n")), F.lit(-1.0)).otherwise(F.col("cdf") - F.col("_p")).alias("_from"), top.alias("_to"))
            .withColumn("_cell", F.explode(F.sequence(F.greatest(cell(F.col("_from") - 1e-12), F.lit(0)), F.greatest(cell(F.col("_to")), F.lit(0))))))
    pick = (u.withColumn("_cell", cell(F.col("u"))).join(held, [*stratum, "_cell"]).where((F.col("_from") - 1e-12 < F.col("u")) & (F.col("u") <= F.col("_to")))
            .groupBy("draw", *stratum, "n", "e", "k").agg(F.min("x").alias("x")))
    drawn = pick.groupBy("draw").agg(F.sum(F.col("x") - F.col("e") * F.col("k") / F.col("n")).alias("s"))
    seen = strata.agg(F.sum("stat").alias("observed"))                      # one row
    return (drawn.join(F.broadcast(seen), F.lit(True)).groupBy("observed")
            .agg(F.count_if(F.col("s") >= F.col("observed") - 1e-9).alias("hits"))
            .withColumn("p", (1 + F.col("hits")) / F.lit(1 + draws)))


CELLS = 1024


def _running(rows: DataFrame, by: list[str], order: str, value: str, chunk: int = 4096) -> DataFrame:
    """Adds ``cdf``, the sum of ``value`` up to each row by whole number ``order``, through sums of chunks."""
    r = rows.withColumn("_c", F.floor(F.col(order) / chunk))
    base = r.groupBy(*by, "_c").agg(F.sum(value).alias("_s")).select(
        *by, "_c", F.coalesce(F.sum("_s").over(W.partitionBy(*by).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_base"))
    inside = F.sum(value).over(W.partitionBy(*by, "_c").orderBy(order))
    return r.withColumn("_in", inside).join(base, [*by, "_c"]).withColumn("cdf", F.col("_base") + F.col("_in")).drop("_c", "_in", "_base")


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half


def ols(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, slope, t, n) from sums."""
    r = rows.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"))
    resid = F.col("_syy") - F.col("slope") * F.col("_sxy")
    se = F.sqrt(F.try_divide(F.greatest(resid, F.lit(0.0)), (F.col("n") - 2) * F.col("_sxx")))
    return r.select(*by, "slope", F.try_divide(F.col("slope"), se).alias("t"), "n")


def greedy_events(shocks: DataFrame, by: list[str], threshold: float, gap: int) -> DataFrame:
    """(by, idx, shock): days at or above the threshold; within ``gap`` days of a larger kept day none is kept.

    A day larger than every open day around it is certain to be kept, and its neighbours are certain to fall;
    this is repeated until nothing is open. Equal sizes go to the earlier day.
    """
    from faultline.session import cut_lineage
    open_ = cut_lineage(shocks.where(F.abs("shock") >= threshold).select(*by, "idx", "shock", F.abs("shock").alias("_a")))
    kept = None
    while True:
        w = W.partitionBy(*by).orderBy("idx").rangeBetween(-gap, gap)      # one series, bounded by the calendar
        top = F.max(F.struct("_a", (-F.col("idx")).alias("i"))).over(w)
        marked = open_.withColumn("_keep", (top["_a"] == F.col("_a")) & (-top["i"] == F.col("idx")))
        near = F.max(F.col("_keep").cast("int")).over(w) == 1
        marked = cut_lineage(marked.withColumn("_near", near))
        new = marked.where("_keep").select(*by, "idx", "shock")
        kept = new if kept is None else kept.unionByName(new)
        open_ = marked.where("not _near").select(*by, "idx", "shock", "_a")
        if open_.isEmpty():
            return kept


def collapse_repeats(events: DataFrame, by: list[str], date: str, days: int) -> DataFrame:
    """Events kept when more than ``days`` after the last kept one; folded over the distinct days of a key."""
    per_day = events.groupBy(*by).agg(F.array_sort(F.collect_set(date)).alias("_d"))      # bounded by the calendar
    start = F.expr("cast(array() as array<date>)")
    keep = F.aggregate("_d", start, lambda acc, d: F.when((F.size(acc) > 0) & (F.datediff(d, F.try_element_at(acc, F.lit(-1))) <= days), acc)
                       .otherwise(F.array_append(acc, d)))
    return per_day.select(*by, F.explode(keep).alias(date))


def nested_logistic(rows: DataFrame, fold: str, features: list[str], y: str, ridge: float = 1e-2, steps: int = 50) -> DataFrame:
    """(model, fold, key columns, y, margin): out-of-fold log-odds of the models on the first 1, 2, ... features.

    Every row trains the models of all other folds and is scored by those of its own. Features are standardised on the
    training rows, the intercept is not shrunk. All models and folds take their Newton step together: one aggregate gives
    the sums of each, of which models x folds small rows reach the driver. Folds are few (evaluation dates).
    """
    import numpy as np
    spark, d = rows.sparkSession, len(features)
    own = rows.where(F.col(y).isNotNull()).dropna(subset=features).withColumn("_y", F.col(y).cast("double"))
    folds = own.select(fold).distinct().withColumnRenamed(fold, "_f")
    pairs = own.join(F.broadcast(folds), F.lit(True))                                   # a row for each fold
    train = pairs.where(F.col(fold) != F.col("_f"))
    scale = train.groupBy("_f").agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(features)], *[F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(features)])
    z = [F.when(F.col(f"_s{i}") > 0, (F.col(c) - F.col(f"_m{i}")) / F.col(f"_s{i}")).otherwise(F.col(c) - F.col(f"_m{i}")) for i, c in enumerate(features)]
    from faultline.session import cut_lineage
    scale = cut_lineage(scale)
    zs = F.array(F.lit(1.0), *z).alias("_z")
    train = cut_lineage(train.join(F.broadcast(scale), "_f").select("_f", "_y", zs))
    names = [r[0] for r in folds.collect()]
    coef = {(m, f): np.zeros(m + 1) for m in range(1, d + 1) for f in names}
    kind = rows.schema[fold].dataType.simpleString()

    def table():
        return F.broadcast(spark.createDataFrame([(m, f, [float(x) for x in [*b, *[0.0] * (d - m)]]) for (m, f), b in coef.items()], f"model int, _f {kind}, _b array<double>"))

    dot = F.aggregate(F.zip_with("_z", "_b", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    for _ in range(steps if names else 0):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), dot))))
        at = train.join(table(), "_f").withColumn("_p", p)
        grad = [F.sum((F.col("_y") - F.col("_p")) * F.col("_z")[i]).alias(f"g{i}") for i in range(d + 1)]
        hess = [F.sum(F.col("_p") * (1 - F.col("_p")) * F.col("_z")[i] * F.col("_z")[j]).alias(f"h{i}_{j}") for i in range(d + 1) for j in range(i + 1)]
        move = 0.0
        for r in at.groupBy("model", "_f").agg(*grad, *hess).collect():
            m, key = r["model"] + 1, (r["model"], r["_f"])
            shrink = np.diag([0.0, *[ridge] * (m - 1)])
            g = np.array([r[f"g{i}"] for i in range(m)]) - shrink @ coef[key]
            h = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] for j in range(m)] for i in range(m)]) + shrink
            step = np.linalg.lstsq(h, g, rcond=None)[0]
            coef[key] = coef[key] + step
            move = max(move, float(np.abs(step).max()))
        if move < 1e-8:
            break
    test = pairs.where(F.col(fold) == F.col("_f")).join(F.broadcast(scale), "_f").withColumn("_z", F.array(F.lit(1.0), *z))
    return test.join(table(), "_f").select("model", fold, *[c for c in rows.columns if c not in (fold, y, *features)], y, dot.alias("margin"))
