"""Event studies, permutation tests, series tests."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from faultline import rules
from faultline.catalog import graph as g
from faultline.catalog.readings import on_the_way, scored_steps
from faultline.catalog.registry import query
from faultline.catalog.scoring import DAY, day, metrics, snapshot
from faultline.catalog.views import AS_OF, Views, add_view, cents
from faultline.operators import stats
from faultline.operators.asof import asof_join, date_array, interval_join, latest_as_of
from faultline.operators.ordering import medians, order_statistics, with_average_rank
from faultline.session import cut_lineage

# ------------------------------------------------------------------ panel
add_view("loss_events", """SELECT f.code, p.available_by AS date, f.period, f.revenue - f.cost - f.tax AS np, round(-(f.revenue - f.cost - f.tax) / abs(nullif(f.assets - f.liab, 0)), 6) AS loss_to_equity
  FROM facts_q f JOIN period_public p USING (period) WHERE f.revenue - f.cost - f.tax < 0 AND f.assets <> f.liab AND -(f.revenue - f.cost - f.tax) / abs(f.assets - f.liab) >= 0.05""")
add_view("panel", """SELECT f.as_of, f.code, c.group_id, f.peer_group, f.total_score AS score, f.tier = 'weak' AS weak, coalesce(h.n, 0) > 0 AS hard, coalesce(l.n, 0) > 0 AS soft, coalesce(h.n, 0) > 0 OR coalesce(l.n, 0) > 0 AS y1,
  coalesce(bool_or(CASE WHEN f.tier = 'weak' THEN true END) OVER (PARTITION BY f.as_of, c.group_id), false) AND (sum(CASE WHEN f.tier = 'weak' THEN 1 ELSE 0 END) OVER (PARTITION BY f.as_of, c.group_id) - CASE WHEN f.tier = 'weak' THEN 1 ELSE 0 END) > 0 AS group_peer_weak
  FROM fragility f JOIN companies c USING (code)
  LEFT JOIN (SELECT d.as_of, entity_id, count(*) AS n FROM signals s JOIN dates d ON s.date > d.as_of AND s.date <= d.as_of + INTERVAL 12 MONTH WHERE signal_type = 'credit_event' AND severity = 'high' GROUP BY ALL) h ON h.as_of = f.as_of AND h.entity_id = f.code
  LEFT JOIN (SELECT d.as_of, code, count(*) AS n FROM loss_events s JOIN dates d ON s.date > d.as_of AND s.date <= d.as_of + INTERVAL 12 MONTH GROUP BY ALL) l ON l.as_of = f.as_of AND l.code = f.code
  WHERE f.total_score IS NOT NULL""")


def loss_events(v: Views) -> DataFrame:
    from faultline.functions.periods import available_by
    c = F.col
    np_, eq = c("revenue") - c("cost") - c("tax"), c("assets") - c("liab")
    return (v.facts_q.withColumn("np", np_).withColumn("loss_to_equity", F.round(F.try_divide(-np_, F.abs(eq)), 6))
            .where((np_ < 0) & (F.try_divide(-np_, F.abs(eq)) >= rules.LOSS_SHARE)).select("code", available_by(c("period")).alias("date"), "period", "np", "loss_to_equity"))


def panel(v: Views) -> DataFrame:
    def build(v: Views) -> DataFrame:
        s = snapshot(v).where("total_score is not null").select("as_of", "code", "peer_group", F.col("total_score").alias("score"), (F.col("tier") == "weak").alias("weak"))
        spans = s.select("as_of", "code").withColumn("_from", F.date_add("as_of", 1)).withColumn("_to", F.add_months("as_of", 12))
        hit = lambda pts, name: (interval_join(spans, pts, ["code"], "_from", "_to", "date").select("as_of", "code").distinct().withColumn(name, F.lit(True)))
        hard = hit(v.signals.where("signal_type = 'credit_event' and severity = 'high'").select(F.col("entity_id").alias("code"), "date"), "hard")
        soft = hit(loss_events(v).select("code", "date"), "soft")
        t = s.join(v.companies.select("code", "group_id"), "code").join(hard, ["as_of", "code"], "left").join(soft, ["as_of", "code"], "left").fillna(False, ["hard", "soft"])
        peers = t.groupBy("as_of", "group_id").agg(F.count_if("weak").alias("_w"))
        return (t.join(peers, ["as_of", "group_id"], "left").withColumn("y1", F.col("hard") | F.col("soft"))
                .withColumn("group_peer_weak", F.coalesce(F.col("_w") - F.col("weak").cast("int") > 0, F.lit(False))).drop("_w"))
    return v.stored("panel", build)


@query("V14 J18", f"SELECT {DAY}, code, score, weak, hard, soft, y1, group_id, group_peer_weak FROM panel")
def study_panel(v: Views):
    """Company × date panel with outcomes of the following year."""
    return panel(v).select(day(), "code", "score", "weak", "hard", "soft", "y1", "group_id", "group_peer_weak")


@query("V15", "SELECT code, CAST(date AS VARCHAR) AS date, period, np, loss_to_equity FROM loss_events")
def large_loss_events(v: Views):
    return loss_events(v).select("code", day("date"), "period", "np", "loss_to_equity")


_LNC = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
add_view("rate_table", """SELECT sample, count(CASE WHEN weak THEN 1 END) AS n_weak, count(CASE WHEN weak AND y THEN 1 END) AS ev_weak, count(CASE WHEN NOT weak THEN 1 END) AS n_other, count(CASE WHEN NOT weak AND y THEN 1 END) AS ev_other FROM (
  SELECT 'y1' AS sample, weak, y1 AS y FROM panel UNION ALL SELECT 'hard', weak, hard FROM panel UNION ALL SELECT 'soft', weak, soft FROM panel UNION ALL SELECT 'y1_' || year(as_of), weak, y1 FROM panel) GROUP BY sample""")


@query("V1 V4 A22", f"""SELECT t.*, round(ev_weak / n_weak, 6) AS rate_weak, round(ev_other / n_other, 6) AS rate_other, round(ev_weak / n_weak / nullif(ev_other / n_other, 0), 6) AS lift, p.p, CASE WHEN ev_weak / n_weak / nullif(ev_other / n_other, 0) IS NULL OR
    ev_weak / n_weak / nullif(ev_other / n_other, 0) < 1.5 THEN 'failed' WHEN p.p < 0.05 THEN 'passed' ELSE 'direction_only' END AS verdict FROM rate_table t JOIN (
  SELECT sample, round(sum(exp({_LNC('n_weak', 'x')} + {_LNC('n_other', '(ev_weak + ev_other - x)')} - {_LNC('(n_weak + n_other)', '(ev_weak + ev_other)')})), 6) AS p FROM rate_table, generate_series(0, (SELECT max(n_weak) FROM rate_table)) s(x)
  WHERE x >= ev_weak AND x <= least(n_weak, ev_weak + ev_other) AND ev_weak + ev_other - x <= n_other GROUP BY sample) p USING (sample)""")
def event_rate_tables(v: Views):
    """Event rates of weak and other companies, lift, exact p and verdict, for several outcomes."""
    s = F.explode(F.array(F.struct(F.lit("y1").alias("sample"), F.col("y1").alias("y")), F.struct(F.lit("hard").alias("sample"), F.col("hard").alias("y")),
                          F.struct(F.lit("soft").alias("sample"), F.col("soft").alias("y")), F.struct(F.concat(F.lit("y1_"), F.year("as_of")).alias("sample"), F.col("y1").alias("y"))))
    t = (panel(v).select("weak", s.alias("s")).select("weak", "s.sample", "s.y").groupBy("sample").agg(
        F.count_if("weak").alias("n_weak"), F.count_if(F.col("weak") & F.col("y")).alias("ev_weak"), F.count_if(~F.col("weak")).alias("n_other"), F.count_if(~F.col("weak") & F.col("y")).alias("ev_other")))
    t = t.withColumn("_b", F.col("n_weak") - F.col("ev_weak")).withColumn("_d", F.col("n_other") - F.col("ev_other"))
    p = stats.fisher_greater(t, ["sample"], "ev_weak", "_b", "ev_other", "_d").select("sample", F.round("p", 6).alias("p"))
    rw, ro = F.try_divide(F.col("ev_weak"), F.col("n_weak")), F.try_divide(F.col("ev_other"), F.col("n_other"))
    lift = F.try_divide(rw, ro)
    verdict = F.when(lift.isNull() | (lift < rules.LIFT_BAR), "failed").when(F.col("p") < rules.P_BAR, "passed").otherwise("direction_only")
    return t.join(p, "sample").select("sample", "n_weak", "ev_weak", "n_other", "ev_other", F.round(rw, 6).alias("rate_weak"), F.round(ro, 6).alias("rate_other"),
                                      F.round(lift, 6).alias("lift"), "p", verdict.alias("verdict"))


add_view("auc_long", """SELECT as_of, year(as_of) AS year, p.code, y1, unnest(['score', 'debt_ratio', 'net_margin', 'prior_loss']) AS predictor, unnest([score, debt_ratio, -net_margin, CASE WHEN l.np IS NOT NULL THEN CAST(l.np < 0 AS INT) END]::DOUBLE[]) AS s
  FROM panel p JOIN metrics_all m USING (as_of, code) LEFT JOIN (SELECT as_of, code, arg_max(np, year) AS np FROM (SELECT code, year, revenue - cost - tax AS np FROM annual), dates WHERE make_date(CAST(year + 1 AS INT), 4, 30) <= as_of GROUP BY ALL) l USING (as_of, code)""")


@query("V2 V16 W15", """SELECT a.predictor, a.year, count(DISTINCT a.code) AS n_pos, count(DISTINCT b.code) AS n_neg, round(avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END)::DOUBLE, 6) AS auc
  FROM auc_long a JOIN auc_long b ON a.predictor = b.predictor AND a.year = b.year WHERE a.y1 AND NOT b.y1 AND a.s IS NOT NULL AND b.s IS NOT NULL GROUP BY a.predictor, a.year""")
def predictor_auc(v: Views):
    """AUC of the score and of single indicators per year, ties counted half."""
    return stats.auc(predictors(v), ["predictor", "year"], "s", "y1").where("n_neg > 0").select("predictor", "year", "n_pos", "n_neg", F.round("auc", 6).alias("auc"))


def predictors(v: Views) -> DataFrame:
    from faultline.catalog.history import annual
    a = annual(v).select("code", "year", (F.col("revenue") - F.col("cost") - F.col("tax")).alias("np"), F.make_date(F.col("year") + 1, F.lit(4), F.lit(30)).alias("public"))
    loss = latest_as_of(a, ["code"], "public", AS_OF, ["np"]).select("code", "as_of", (F.col("np") < 0).cast("double").alias("prior_loss"))
    t = (panel(v).select("as_of", "code", "score", "y1").join(metrics(v).select("as_of", "code", "debt_ratio", (-F.col("net_margin")).alias("net_margin")), ["as_of", "code"])
         .join(loss, ["as_of", "code"], "left").withColumn("year", F.year("as_of")))
    return t.unpivot(["as_of", "year", "code", "y1"], ["score", "debt_ratio", "net_margin", "prior_loss"], "predictor", "s")


#: Draws as published: resampled companies, and permutations.
DRAWS, PERMUTATIONS = 2_000, 10_000
_N = "(SELECT count(*) FROM (SELECT DISTINCT code FROM panel))"


@query("V3", f"""WITH codes AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS i FROM (SELECT DISTINCT code FROM panel)),
  pick AS (SELECT draw, (CAST('0x' || substr(md5(draw || '|' || i), 1, 8) AS BIGINT)) % {_N} AS j FROM codes, generate_series(1, {DRAWS}) d(draw)),
  mult AS (SELECT draw, code, count(*) AS w FROM pick JOIN codes ON codes.i = pick.j GROUP BY ALL),
  r AS (SELECT draw, w, score, y1 FROM mult JOIN panel USING (code)),
  a AS (SELECT a.draw, sum(a.w * b.w * CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END)::DOUBLE / sum(a.w * b.w) AS auc FROM r a JOIN r b ON a.draw = b.draw WHERE a.y1 AND NOT b.y1 GROUP BY a.draw)
  SELECT count(*) AS draws, round(list_sort(list(auc))[CAST(floor(0.025 * count(*)) AS INT) + 1], 6) AS lo, round(list_sort(list(auc))[CAST(floor(0.975 * count(*)) AS INT)], 6) AS hi FROM a""")
def bootstrap_interval(v: Views):
    """Percentile interval of the AUC, resampling companies with all their dates; multiplicities instead of copies."""
    codes = panel(v).select("code").distinct().withColumn("_g", F.lit(1))
    numbered = cut_lineage(stats.shuffled_position(codes, ["_g"], "code", "_k", chars=6).select("code", (F.col("_k") - 1).alias("i")))
    rows = cut_lineage(stats.resampled(panel(v).select("code", "score", "y1"), numbered, "code", ["score", "y1"], DRAWS))       # read twice below
    a = stats.auc(rows, ["draw"], "score", "y1", "w").withColumn("_g", F.lit(1))
    cut = order_statistics(a, ["_g"], "auc", {"lo": F.floor(F.lit(0.025) * F.col("n")), "hi": F.floor(F.lit(0.975) * F.col("n")) - 1})
    return cut.select(F.col("n").alias("draws"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


add_view("exposed_panel", """SELECT p.as_of, p.code, p.peer_group, p.y1, EXISTS (SELECT 1 FROM g_ranked r, generate_series(1, 3) t(i) WHERE r.as_of = p.as_of AND i <= len(r.ds) AND r.ds[i] = p.code AND r.lis[i] AND r.ds[i] <> r.seed
    AND NOT list_contains(r.rs, 'R4') AND (list_contains(r.rs[:i], 'R1') OR list_contains(r.rs[:i], 'R2')) AND r.score >= 5) AS exposed FROM panel p""")


def exposed_panel(v: Views) -> DataFrame:
    r = on_the_way(scored_steps(v).where("score >= 5")).withColumnRenamed("node", "code").withColumn("exposed", F.lit(True))
    return panel(v).join(r, ["as_of", "code"], "left").fillna(False, ["exposed"])


@query("V5", f"""SELECT {DAY}, peer_group, n, e, k, x, round(x - e * k / n, 6) AS stat FROM (SELECT as_of, peer_group, count(*) AS n, count(CASE WHEN exposed THEN 1 END) AS e, count(CASE WHEN y1 THEN 1 END) AS k, count(CASE WHEN exposed AND y1 THEN 1 END) AS x FROM exposed_panel GROUP BY ALL)""")
def stratified_excess(v: Views):
    """Events of exposed companies above what their stratum leads one to expect."""
    return stats.stratified_statistic(exposed_panel(v), ["as_of", "peer_group"], "exposed", "y1").select(day(), "peer_group", "n", "e", "k", "x", F.round("stat", 6).alias("stat"))


@query("V6", f"""WITH st AS (SELECT as_of, peer_group, count(*) AS n, count(CASE WHEN exposed THEN 1 END) AS e, count(CASE WHEN y1 THEN 1 END) AS k, count(CASE WHEN exposed AND y1 THEN 1 END) AS x FROM exposed_panel GROUP BY ALL),
  sup AS (SELECT st.as_of, st.peer_group, st.n, st.e, st.k, s.v, exp({_LNC('k', 's.v')} + {_LNC('(n - k)', '(e - s.v)')} - {_LNC('n', 'e')}) AS pr FROM st, generate_series(0, (SELECT max(n) FROM st)) s(v) WHERE s.v >= greatest(0, e + k - n) AND s.v <= least(e, k)),
  cdf AS (SELECT *, sum(pr) OVER (PARTITION BY as_of, peer_group ORDER BY v) AS c FROM sup),
  u AS (SELECT draw, st.*, CAST('0x' || substr(md5(draw || '|' || as_of || '|' || peer_group), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM st, generate_series(1, {PERMUTATIONS}) d(draw)),
  pick AS (SELECT u.draw, u.as_of, u.peer_group, u.n, u.e, u.k, min(c.v) AS v FROM u JOIN cdf c ON c.as_of = u.as_of AND c.peer_group = u.peer_group AND (c.c >= u.u OR c.v = least(u.e, u.k)) GROUP BY ALL),
  s AS (SELECT draw, sum(v - e * k / n) AS s FROM pick GROUP BY draw), o AS (SELECT sum(x - e * k / n) AS observed FROM st)
  SELECT round(any_value(observed), 6) AS observed, count(CASE WHEN s >= observed - 1e-9 THEN 1 END) AS hits, round((1 + count(CASE WHEN s >= observed - 1e-9 THEN 1 END)) / {PERMUTATIONS + 1}, 6) AS p FROM s, o""")
def stratified_permutation(v: Views):
    st = stats.stratified_statistic(exposed_panel(v), ["as_of", "peer_group"], "exposed", "y1")
    return stats.permutation_p(st, ["as_of", "peer_group"], PERMUTATIONS).select(F.round("observed", 6).alias("observed"), "hits", F.round("p", 6).alias("p"))


add_view("xy", """SELECT m.as_of, m.code, m.debt_ratio AS x, m.vol_20d AS y FROM metrics_all m WHERE m.debt_ratio IS NOT NULL AND m.vol_20d IS NOT NULL""")
add_view("xy_ranks", """SELECT *, rank() OVER (PARTITION BY as_of ORDER BY x) + (count(*) OVER (PARTITION BY as_of, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY as_of ORDER BY y) + (count(*) OVER (PARTITION BY as_of, y) - 1) / 2.0::DOUBLE AS ry FROM xy""")


def xy(v: Views) -> DataFrame:
    return metrics(v).where("debt_ratio is not null and vol_20d is not null").select("as_of", "code", F.col("debt_ratio").alias("x"), F.col("vol_20d").alias("y"))


@query("V7 W15", f"SELECT {DAY}, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM xy_ranks GROUP BY as_of")
def rank_correlation(v: Views):
    return stats.spearman(xy(v), ["as_of"], "x", "y").select(day(), F.round("rho", 6).alias("rho"), "n")


add_view("perm_n", """SELECT as_of, n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM (SELECT as_of, n, arg_max(a, {'e': -(CAST(ceil(n / a) AS BIGINT) * a - n), 'a': a}) AS a FROM (
  SELECT as_of, n, unnest(generate_series(greatest(1, CAST(ceil(sqrt(n)) AS BIGINT) // 2), CAST(ceil(sqrt(n)) AS BIGINT))) AS a FROM (SELECT as_of, count(*) AS n FROM xy_ranks GROUP BY as_of)) GROUP BY as_of, n)""")
add_view("perm_0", f"""SELECT draw, as_of, rx, row_number() OVER (PARTITION BY draw, as_of ORDER BY code) - 1 AS t, n, a, b FROM xy_ranks JOIN perm_n USING (as_of), generate_series(1, {PERMUTATIONS}) d(draw)""")
_STEPS = 4                             # written out in the SQL; the plan takes as many as it needs


def _mix_sql(value: str, turn: int) -> list[str]:
    """The mixing function as columns m0 to m4, each of the one before."""
    return [f"({value} * 1103515 + draw * 69069 + {turn * 7919 + 1}) % 2147483647", "(m * 48271 + 12345) % 2147483647", "xor(m, m >> 13)", "(m * 69621 + 12345) % 2147483647", "xor(m, m >> 13)"]


_from, _at = "perm_0", 0
for _step in range(_STEPS):
    add_view(f"perm_s{_step}", f"SELECT *, t // b AS l, t % b AS r FROM {_from}")
    _from = f"perm_s{_step}"
    for _turn in range(stats.ROUNDS):
        _side, _other, _radix = ("l", "r", "a") if _turn % 2 == 0 else ("r", "l", "b")
        _inner = f"SELECT draw, as_of, rx, t, n, a, b, l, r, {_mix_sql(_other, _turn)[0]} AS m FROM {_from}"
        for _m in _mix_sql(_other, _turn)[1:]:
            _inner = f"SELECT * REPLACE ({_m} AS m) FROM ({_inner})"
        add_view(f"perm_t{_at}", f"SELECT draw, as_of, rx, t, n, a, b, {'(l + m) % a AS l, r' if _side == 'l' else 'l, (r + m) % b AS r'} FROM ({_inner})")
        _from, _at = f"perm_t{_at}", _at + 1
    add_view(f"perm_e{_step}", f"SELECT draw, as_of, rx, {'l * b + r' if _step == 0 else 'CASE WHEN t >= n THEN l * b + r ELSE t END'} AS t, n, a, b FROM {_from}")
    _from = f"perm_e{_step}"


@query("V8", f"""WITH ys AS (SELECT as_of, ry, row_number() OVER (PARTITION BY as_of ORDER BY code) - 1 AS t FROM xy_ranks),
  d AS (SELECT p.draw, p.as_of, corr(p.rx, ys.ry) AS rho FROM {_from} p JOIN ys ON ys.as_of = p.as_of AND ys.t = p.t GROUP BY p.draw, p.as_of), o AS (SELECT as_of, corr(rx, ry) AS rho FROM xy_ranks GROUP BY as_of)
  SELECT CAST(o.as_of AS VARCHAR) AS as_of, round(any_value(o.rho), 6) AS rho, count(CASE WHEN d.rho >= o.rho - 1e-9 THEN 1 END) AS hits, round((1 + count(CASE WHEN d.rho >= o.rho - 1e-9 THEN 1 END)) / {PERMUTATIONS + 1}, 6) AS p FROM o JOIN d USING (as_of) GROUP BY o.as_of""")
def correlation_permutation(v: Views):
    """Permutation p of a rank correlation: each draw's permutation is computed, no draw is sorted."""
    r = with_average_rank(with_average_rank(xy(v), ["as_of"], "x", "rx").drop("n"), ["as_of"], "y", "ry").drop("n")
    base = cut_lineage(stats.shuffled_position(r, ["as_of"], "code", "_k", chars=6).withColumn("i", F.col("_k") - 1).select("as_of", "i", "rx", "ry"))
    rho = stats.permuted_correlation(base, "as_of", "i", "rx", "ry", PERMUTATIONS).withColumnRenamed("rho", "d")
    seen = base.groupBy("as_of").agg(F.corr("rx", "ry").alias("rho"))
    hits = F.count_if(F.col("d") >= F.col("rho") - 1e-9)
    return rho.join(seen, "as_of").groupBy(day(), "rho").agg(hits.alias("hits")).select("as_of", F.round("rho", 6).alias("rho"), "hits", F.round((1 + F.col("hits")) / F.lit(PERMUTATIONS + 1), 6).alias("p"))


@query("V13", f"""SELECT {DAY}, round(median(CASE WHEN exposed THEN score END), 6) AS exposed_median, round(median(CASE WHEN NOT exposed THEN score END), 6) AS other_median,
  CASE WHEN median(CASE WHEN exposed THEN score END) > median(CASE WHEN NOT exposed THEN score END) THEN 'as_expected' ELSE 'not_supported' END AS verdict FROM exposed_panel JOIN panel USING (as_of, code) GROUP BY as_of""")
def group_medians(v: Views):
    m = medians(exposed_panel(v), ["as_of", "exposed"], "score")
    t = m.groupBy("as_of").agg(F.max(F.when(F.col("exposed"), F.col("median"))).alias("a"), F.max(F.when(~F.col("exposed"), F.col("median"))).alias("b"))
    return t.select(day(), F.round("a", 6).alias("exposed_median"), F.round("b", 6).alias("other_median"), F.when(F.col("a") > F.col("b"), "as_expected").otherwise("not_supported").alias("verdict"))


@query("V17", """SELECT sample, count(*) AS n, count(CASE WHEN y THEN 1 END) AS events FROM (SELECT 'all' AS sample, y1 AS y FROM panel UNION ALL SELECT 'without_listed', soft OR EXISTS (
  SELECT 1 FROM signals s WHERE s.entity_id = p.code AND signal_type = 'credit_event' AND severity = 'high' AND s.date > p.as_of AND s.date <= p.as_of + INTERVAL 12 MONTH AND magnitude < 1000000) FROM panel p) GROUP BY sample""")
def exclusion_sensitivity(v: Views):
    """Outcome with and without a listed set of events."""
    s = panel(v).select("as_of", "code", "soft", "y1")
    spans = s.withColumn("_from", F.date_add("as_of", 1)).withColumn("_to", F.add_months("as_of", 12))
    events = v.signals.where("signal_type = 'credit_event' and severity = 'high'").select("event_id", F.col("entity_id").alias("code"), "date", "magnitude")
    listed = events.where("magnitude >= 1000000").select("event_id")
    kept = events.join(listed, "event_id", "left_anti").select("code", "date")
    hard = interval_join(spans, kept, ["code"], "_from", "_to", "date").select("as_of", "code").distinct().withColumn("hard2", F.lit(True))
    t = s.join(hard, ["as_of", "code"], "left").select("y1", (F.col("soft") | F.coalesce("hard2", F.lit(False))).alias("y1b"))
    both = F.explode(F.array(F.struct(F.lit("all").alias("sample"), F.col("y1").alias("y")), F.struct(F.lit("without_listed").alias("sample"), F.col("y1b").alias("y"))))
    return t.select(both.alias("s")).groupBy("s.sample").agg(F.count("*").alias("n"), F.count_if("s.y").alias("events"))


@query("V20", """SELECT source, n, ok, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS lo, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS hi
  FROM (SELECT source, count(*) AS n, count(CASE WHEN quality = 1 THEN 1 END) AS ok, count(CASE WHEN quality = 1 THEN 1 END) / count(*) AS p, 1.959963984540054::DOUBLE AS z FROM labels JOIN documents USING (doc_id) GROUP BY source)""")
def wilson_intervals(v: Views):
    d = v.table("labels").join(v.table("documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("ok"))
    lo, hi = stats.wilson(F.col("ok"), F.col("n"))
    return d.select("source", "n", "ok", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("V21", f"""SELECT code, CAST(date AS VARCHAR) AS date, tier IN ('weak', 'medium') AS rated_before, coalesce(rank <= 5, false) AS ranked_before, coalesce(evidence, false) AS evidence_before FROM (
  SELECT e.code, e.date, f.tier, (SELECT min(rank) FROM g_fsteps s WHERE s.as_of = e.as_of AND s.dst = e.code) AS rank, EXISTS (SELECT 1 FROM signals s WHERE s.entity_id = e.code AND s.date <= e.as_of AND s.severity IN ('medium', 'high')) AS evidence
  FROM (SELECT entity_id AS code, date, max(as_of) AS as_of FROM signals, dates WHERE signal_type = 'credit_event' AND severity = 'high' AND as_of < date GROUP BY ALL) e JOIN fragility f ON f.code = e.code AND f.as_of = e.as_of)""")
def backtest_criteria(v: Views):
    """Was each event's company rated, ranked and evidenced in the snapshot before it?"""
    from faultline.catalog.readings import finding_steps
    e = (v.signals.where("signal_type = 'credit_event' and severity = 'high'").select(F.col("entity_id").alias("code"), "date").distinct()
         .withColumn("as_of", F.array_max(F.filter(date_array(AS_OF), lambda d: d < F.col("date")))).where("as_of is not null"))
    rank = finding_steps(v).groupBy("as_of", F.col("dst").alias("code")).agg(F.min("rank").alias("rank"))
    first = v.signals.where("severity in ('medium', 'high')").groupBy(F.col("entity_id").alias("code")).agg(F.min("date").alias("_first"))
    t = e.join(snapshot(v).select("as_of", "code", "tier"), ["as_of", "code"]).join(rank, ["as_of", "code"], "left").join(first, "code", "left")
    return t.select("code", day("date"), F.col("tier").isin("weak", "medium").alias("rated_before"), F.coalesce(F.col("rank") <= 5, F.lit(False)).alias("ranked_before"),
                    F.coalesce(F.col("_first") <= F.col("as_of"), F.lit(False)).alias("evidence_before"))


@query("V12")
def leave_one_year_out(v: Views):
    """Three nested models (margin, + score, + exposure), each date left out in turn, AUC over the pooled predictions."""
    margin = metrics(v).select("as_of", "code", "net_margin")
    t = exposed_panel(v).join(margin, ["as_of", "code"]).select("as_of", "code", "net_margin", F.col("score").cast("double").alias("score"), F.col("exposed").cast("double").alias("exposed"), "y1")
    scored = stats.nested_logistic(cut_lineage(t), "as_of", ["net_margin", "score", "exposed"], "y1")
    return stats.auc(scored.withColumn("margin", F.round("margin", 9)), ["model"], "margin", "y1").select("model", F.round("auc", 6).alias("auc"), "n_pos", "n_neg")


# ------------------------------------------------------------------ series
add_view("cal", "SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM prices_b)")
add_view("rets", """SELECT p.symbol, c.idx, CASE WHEN abs(ln(p.close / q.close)) > 1.1 THEN NULL ELSE ln(p.close / q.close) END AS ret FROM prices_b p JOIN cal c USING (date) JOIN cal c0 ON c0.idx = c.idx - 1 JOIN prices_b q ON q.symbol = p.symbol AND q.date = c0.date""")


def calendar(v: Views) -> DataFrame:
    """Trading days numbered; the calendar is a small table whatever the data volume."""
    return v.stored("calendar", lambda v: v.prices_b.select("date").distinct().withColumn("idx", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("date"))))


def daily_returns(v: Views, jump: float = 1.1) -> DataFrame:
    """Log return against the previous calendar day; null above the jump bound."""
    p = v.prices_b.join(F.broadcast(calendar(v)), "date").select("symbol", "idx", "close")       # bounded by the calendar
    q = p.select("symbol", (F.col("idx") + 1).alias("idx"), F.col("close").alias("_prev"))
    r = F.ln(F.col("close") / F.col("_prev"))
    return p.join(q, ["symbol", "idx"]).select("symbol", "idx", F.when(F.abs(r) <= jump, r).alias("ret"))


@query("W19", "SELECT symbol, idx, round(ret, 6) AS ret FROM rets")
def calendar_returns(v: Views):
    return daily_returns(v).select("symbol", "idx", F.round("ret", 6).alias("ret"))


add_view("shocks", """SELECT idx, shock, strftime(date, '%Y-%m') AS month FROM (SELECT c.idx, c.date, avg(ret) AS shock FROM rets JOIN cal c USING (idx) GROUP BY c.idx, c.date) WHERE shock IS NOT NULL""")
add_view("ev", "SELECT idx, shock FROM (SELECT idx, round(shock, 9) AS shock, row_number() OVER (PARTITION BY month ORDER BY abs(round(shock, 9)) DESC, idx) AS k FROM shocks) WHERE k = 1 AND abs(shock) >= 0.2")
add_view("rel_ret", """SELECT e.idx, r.symbol, sum(r.ret - m.mean) AS rel FROM ev e JOIN (SELECT e.idx AS ev, r.symbol, r.idx, r.ret FROM ev e JOIN rets r ON r.idx BETWEEN e.idx AND e.idx + 1 WHERE r.ret IS NOT NULL
    QUALIFY count(*) OVER (PARTITION BY e.idx, r.symbol) = 2) r ON r.ev = e.idx JOIN (SELECT ev, idx, avg(ret) AS mean FROM (SELECT e.idx AS ev, r.symbol, r.idx, r.ret FROM ev e JOIN rets r ON r.idx BETWEEN e.idx AND e.idx + 1 WHERE r.ret IS NOT NULL
    QUALIFY count(*) OVER (PARTITION BY e.idx, r.symbol) = 2) GROUP BY ev, idx) m ON m.ev = r.ev AND m.idx = r.idx GROUP BY e.idx, r.symbol""")


def shock_series(v: Views) -> DataFrame:
    return daily_returns(v).groupBy("idx").agg(F.round(F.avg("ret"), 9).alias("shock")).where("shock is not null").withColumn("series", F.lit("market"))


def monthly_events(v: Views) -> DataFrame:
    """The largest shock of each month."""
    s = shock_series(v).join(F.broadcast(calendar(v)), "idx").withColumn("month", F.date_format("date", "yyyy-MM"))   # bounded by the calendar
    return s.groupBy("month").agg(F.max(F.struct(F.abs("shock").alias("a"), (-F.col("idx")).alias("i"), "shock")).alias("b")).where("b.a >= 0.2").select((-F.col("b.i")).alias("event"), "b.shock")


def relative_returns(v: Views) -> DataFrame:
    """Two-day return minus the mean of the symbols priced on both days, per event."""
    e = monthly_events(v).withColumn("idx", F.explode(F.array(F.col("event"), F.col("event") + 1)))
    r = e.join(daily_returns(v).where("ret is not null"), "idx")
    full = r.groupBy("event", "symbol").agg(F.count("*").alias("c")).where("c = 2").drop("c")
    r = r.join(full, ["event", "symbol"], "left_semi")
    mean = r.groupBy("event", "idx").agg(F.avg("ret").alias("m"))
    return r.join(mean, ["event", "idx"]).groupBy("event", "symbol").agg(F.sum(F.col("ret") - F.col("m")).alias("rel"))


@query("W18", "SELECT idx AS event, symbol, round(rel, 6) AS rel FROM rel_ret")
def relative_event_returns(v: Views):
    return relative_returns(v).select("event", "symbol", F.round("rel", 6).alias("rel"))


add_view("sizes", "SELECT p_brand AS symbol, round(avg(p_retailprice), 6) AS exposure FROM part GROUP BY p_brand")
add_view("zs", """SELECT idx, CASE WHEN count(*) >= 4 THEN corr(ra, rb) END * sign(any_value(shock)) AS z FROM (SELECT r.idx, e.shock, rank() OVER (PARTITION BY r.idx ORDER BY exposure) + (count(*) OVER (PARTITION BY r.idx, exposure) - 1) / 2.0::DOUBLE AS ra,
  rank() OVER (PARTITION BY r.idx ORDER BY round(rel, 9)) + (count(*) OVER (PARTITION BY r.idx, round(rel, 9)) - 1) / 2.0::DOUBLE AS rb FROM rel_ret r JOIN ev e USING (idx) JOIN sizes USING (symbol)) GROUP BY idx""")


def event_z(v: Views) -> DataFrame:
    return v.stored("event_z", build_event_z)


def build_event_z(v: Views) -> DataFrame:
    expo = v.table("part").groupBy(F.col("p_brand").alias("symbol")).agg(F.round(F.avg("p_retailprice"), 6).alias("exposure"))
    r = relative_returns(v).withColumn("rel", F.round("rel", 9)).join(expo, "symbol")
    s = stats.spearman(r, ["event"], "exposure", "rel", least=4)
    return s.join(monthly_events(v), "event").select("event", (F.signum("shock") * F.col("rho")).alias("z"), "n")


@query("V9", "SELECT idx AS event, round(z, 6) AS z FROM zs WHERE z IS NOT NULL")
def shock_event_z(v: Views):
    """Expected sign times rank correlation of exposure and relative return, events with enough firms."""
    return event_z(v).where("z is not null").select("event", F.round("z", 6).alias("z"))


@query("V10", f"""WITH pool AS (SELECT idx, round(z, 9) AS z FROM zs WHERE z IS NOT NULL), d AS (SELECT draw, avg(z) AS m FROM (SELECT draw, z, row_number() OVER (PARTITION BY draw ORDER BY md5(draw || '|' || idx)) AS k FROM pool, generate_series(1, {PERMUTATIONS}) t(draw)) WHERE k <= 8 GROUP BY draw),
  o AS (SELECT avg(z) AS observed FROM (SELECT z FROM pool ORDER BY idx DESC LIMIT 8)) SELECT round(any_value(observed), 6) AS observed, count(CASE WHEN m >= observed - 1e-9 THEN 1 END) AS hits FROM o LEFT JOIN d ON true""")
def placebo_permutation(v: Views):
    """Mean z of the latest eight events against eight drawn from the pool without replacement."""
    pool = event_z(v).where("z is not null").select("event", F.round("z", 9).alias("z"))
    drawn = stats.shuffled_position(stats.with_draws(pool, PERMUTATIONS, F.col("event")), ["draw"], "_h", "k").where("k <= 8").groupBy("draw").agg(F.avg("z").alias("m"))
    seen = pool.orderBy(F.desc("event")).limit(8).agg(F.avg("z").alias("observed"))              # the eight latest events, one row
    # one row per draw on the broadcast side
    return seen.join(F.broadcast(drawn), F.lit(True), "left").groupBy("observed").agg(F.count_if(F.col("m") >= F.col("observed") - 1e-9).alias("hits")).select(F.round("observed", 6).alias("observed"), "hits")


@query("W20")
def greedy_shock_days(v: Views):
    """Large shocks first, none within ten trading days of a kept one, for every symbol."""
    s = daily_returns(v).where("ret is not null").select("symbol", "idx", F.round("ret", 9).alias("shock"))
    return stats.greedy_events(s, ["symbol"], 0.5, rules.SHOCK_GAP)


@query("W21", """SELECT s.idx, round(s.shock, 6) AS shock FROM shocks s WHERE abs(s.shock) < 0.2 AND round(s.shock, 9) <> 0 AND NOT EXISTS (SELECT 1 FROM ev e WHERE abs(e.idx - s.idx) <= 10)""")
def placebo_days(v: Views):
    """Days below the threshold and not near an event: an anti-join on the days around events."""
    near = monthly_events(v).select(F.explode(F.sequence(F.col("event") - rules.SHOCK_GAP, F.col("event") + rules.SHOCK_GAP)).alias("idx")).distinct()
    return shock_series(v).where("abs(shock) < 0.2 and shock <> 0").join(near, "idx", "left_anti").select("idx", F.round("shock", 6).alias("shock"))


add_view("weekly", """SELECT symbol, isoyear(date) AS y, week(date) AS w, arg_max(close, date) AS close, dense_rank() OVER (ORDER BY isoyear(date), week(date)) AS k FROM prices_b GROUP BY symbol, isoyear(date), week(date)""")
add_view("weekly_r", "SELECT a.symbol, a.k, a.close / b.close - 1 AS r FROM weekly a JOIN weekly b ON b.symbol = a.symbol AND b.k = a.k - 1")


def weekly_returns(v: Views) -> DataFrame:
    """Close of the last trading day of each ISO week and the return over consecutive listed weeks."""
    y, w = F.extract(F.lit("yearofweek"), "date"), F.weekofyear("date")
    wk = v.prices_b.groupBy("symbol", y.alias("y"), w.alias("w")).agg(F.max_by("close", "date").alias("close"))
    order = wk.select("y", "w").distinct().withColumn("k", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("y", "w")))      # weeks of the calendar
    wk = wk.join(F.broadcast(order), ["y", "w"]).select("symbol", "k", "close")
    prev = wk.select("symbol", (F.col("k") + 1).alias("k"), F.col("close").alias("_p"))
    return wk.join(prev, ["symbol", "k"]).select("symbol", "k", (F.col("close") / F.col("_p") - 1).alias("r"))


@query("W23", "SELECT symbol, k, round(r, 6) AS r FROM weekly_r")
def weekly_closes(v: Views):
    return weekly_returns(v).select("symbol", "k", F.round("r", 6).alias("r"))


@query("V11 W24", """SELECT symbol, kind, round(slope, 6) AS slope, round(slope / nullif(sqrt(greatest(syy - slope * sxy, 0) / ((n - 2) * sxx)), 0), 4) AS t, n FROM (
  SELECT a.symbol, kind, count(*) AS n, regr_slope(a.r, m.r) AS slope, regr_sxx(a.r, m.r) AS sxx, regr_syy(a.r, m.r) AS syy, regr_sxy(a.r, m.r) AS sxy FROM weekly_r a JOIN (SELECT 'real' AS kind, k, avg(r) AS r FROM weekly_r GROUP BY k
  UNION ALL SELECT 'shifted', k + 26, avg(r) FROM weekly_r GROUP BY k) m USING (k) GROUP BY a.symbol, kind)""")
def weekly_sensitivity(v: Views):
    """Slope and t value of each series on the mean series, and on the mean shifted by 26 weeks."""
    r = weekly_returns(v)
    mean = r.groupBy("k").agg(F.avg("r").alias("m"))
    both = mean.withColumn("kind", F.lit("real")).unionByName(mean.withColumn("k", F.col("k") + 26).withColumn("kind", F.lit("shifted")))
    return stats.ols(r.join(both, "k"), ["symbol", "kind"], "m", "r").select("symbol", "kind", F.round("slope", 6).alias("slope"), F.round("t", 4).alias("t"), "n")


add_view("sidx", "SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY date) AS i FROM prices_s")
add_view("crises", "SELECT DISTINCT entity_id AS code, date AS day FROM signals WHERE signal_type = 'credit_event' AND severity = 'high'")
add_view("event_rets", """SELECT c.code, d.day, f.close / b.close - 1 AS ret FROM companies c, (SELECT DISTINCT day FROM crises) d JOIN LATERAL (SELECT max(i) AS i FROM sidx s WHERE s.code = c.code AND s.date < d.day) x ON true
  JOIN sidx b ON b.code = c.code AND b.i = x.i JOIN sidx f ON f.code = c.code AND f.i = x.i + 5""")


@query("W16 W17", """SELECT e.code, CAST(e.day AS VARCHAR) AS day, round(r.ret, 6) AS ret, round((p.s - r.ret) / nullif(p.n - 1, 0), 6) AS bench, round(r.ret - (p.s - r.ret) / nullif(p.n - 1, 0), 6) AS excess, p.n - 1 AS n_peers FROM crises e JOIN companies c ON c.code = e.code
  JOIN event_rets r ON r.code = e.code AND r.day = e.day JOIN (SELECT peer_group, day, sum(ret) AS s, count(*) AS n FROM event_rets JOIN companies USING (code) GROUP BY ALL) p ON p.peer_group = c.peer_group AND p.day = e.day""")
def event_reaction(v: Views):
    """Five-day return after an event and its excess over equal-weighted peers."""
    crises = v.signals.where("signal_type = 'credit_event' and severity = 'high'").select(F.col("entity_id").alias("code"), F.col("date").alias("day")).distinct()
    c = v.companies.select("code", "peer_group")
    days = crises.join(c, "code").select("peer_group", "day").distinct()                      # bounded by the calendar of each peer group
    w = W.partitionBy("code").orderBy("date")                                                 # one series, bounded by the calendar
    p = v.prices_s.withColumn("_later", F.lead("close", 5).over(w)).select("code", "date", "close", "_later")
    asked = c.join(F.broadcast(days), "peer_group").withColumn("_before", F.date_sub("day", 1))
    r = (asof_join(asked, p, ["code"], "_before", "date", ["close", "_later"]).where("close is not null and _later is not null")
         .withColumn("ret", F.col("_later") / F.col("close") - 1))
    peers = r.groupBy("peer_group", "day").agg(F.sum("ret").alias("s"), F.count("*").alias("n"))
    bench = F.try_divide(F.col("s") - F.col("ret"), F.col("n") - 1)
    return (r.join(crises, ["code", "day"], "left_semi").join(peers, ["peer_group", "day"])
            .select("code", day("day"), F.round("ret", 6).alias("ret"), F.round(bench, 6).alias("bench"), F.round(F.col("ret") - bench, 6).alias("excess"), (F.col("n") - 1).alias("n_peers")))


@query("W22", """WITH RECURSIVE d AS (SELECT entity_id, signal_type, date, row_number() OVER (PARTITION BY entity_id, signal_type ORDER BY date) AS i FROM (SELECT DISTINCT entity_id, signal_type, date FROM signals WHERE severity <> 'info')),
  r AS (SELECT entity_id, signal_type, i, date, date AS kept FROM d WHERE i = 1 UNION ALL SELECT d.entity_id, d.signal_type, d.i, d.date, CASE WHEN datediff('day', r.kept, d.date) > 90 THEN d.date ELSE r.kept END FROM r JOIN d ON d.entity_id = r.entity_id AND d.signal_type = r.signal_type AND d.i = r.i + 1)
  SELECT entity_id, signal_type, CAST(date AS VARCHAR) AS date FROM r WHERE date = kept""")
def collapsed_events(v: Views):
    """Repeats within 90 days of the last kept event of the same kind are dropped."""
    e = v.signals.where("severity <> 'info'").select("entity_id", "signal_type", "date")
    return stats.collapse_repeats(e, ["entity_id", "signal_type"], "date", rules.COLLAPSE_DAYS).select("entity_id", "signal_type", day("date"))


@query("W25", """SELECT entity_id, n, high, last_sev > first_sev AS escalates, array_to_string(list_transform(ds[-4:], lambda x: x), ' > ') AS chain FROM (SELECT entity_id, count(*) AS n, count(CASE WHEN sev = 3 THEN 1 END) AS high, arg_min(sev, d) AS first_sev, arg_max(sev, d) AS last_sev,
  list(CAST(d AS VARCHAR) || ' ' || t ORDER BY d) AS ds FROM (SELECT entity_id, date AS d, max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS sev, min(signal_type) AS t FROM signals GROUP BY entity_id, date) GROUP BY entity_id)""")
def escalation(v: Views):
    """Did the latest signal day become more severe than the first, and the last four steps."""
    sev = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).when(F.col("severity") == "low", 1).otherwise(0)
    d = v.signals.groupBy("entity_id", "date").agg(F.max(sev).alias("sev"), F.min("signal_type").alias("t"))
    ends = d.groupBy("entity_id").agg(F.count("*").alias("n"), F.count_if(F.col("sev") == 3).alias("high"), (F.max_by("sev", "date") > F.min_by("sev", "date")).alias("escalates"))
    k = F.row_number().over(W.partitionBy("entity_id").orderBy(F.desc("date")))
    last = (d.withColumn("k", k).where("k <= 4").groupBy("entity_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", "t"))), lambda s: F.concat(s["date"].cast("string"), F.lit(" "), s["t"])), " > ").alias("chain")))
    return ends.join(last, "entity_id")
