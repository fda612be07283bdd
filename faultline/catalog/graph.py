"""Relations, seeds, bounded paths and what is read from them."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from faultline import rules
from faultline.catalog.registry import query
from faultline.catalog.scoring import day, snapshot
from faultline.catalog.views import AS_OF, Views, add_view
from faultline.functions.scalars import lookup
from faultline.operators.asof import active_as_of, date_array
from faultline.plans import propagation as pg

BY = ["as_of"]


def active_edges(v: Views) -> DataFrame:
    return (active_as_of(v.edges, AS_OF, F.coalesce("valid_from", "announcement_date"), F.col("valid_to"))
            .withColumn("basis", F.lit("disclosed")))


def nodes(v: Views) -> DataFrame:
    return v.stored("nodes", build_nodes)


def build_nodes(v: Views) -> DataFrame:
    """Suppliers of one region stand for unlisted parent groups: they have no rating, but the listed members of a group of
    the next nation give them a proxy."""
    rated = snapshot(v).select("as_of", "code", "tier", "total_score")
    c = v.companies.withColumn("as_of", F.explode(date_array(AS_OF))).withColumn("rated", F.col("peer_group") != "AFRICA")
    parts = F.split(F.substring(F.col("group_id"), 2, 40), "_")
    parent_of = F.concat(F.lit("G"), (parts[0].cast("int") + 1) % 25, F.lit("_"), parts[1])
    own = (c.join(rated, ["as_of", "code"], "left")
           .select("as_of", F.col("code").alias("node"), F.when(F.col("rated"), F.col("tier")).alias("tier"), "equity",
                         F.col("rated").alias("listed"), "rated", "group_id", "industry", F.when(F.col("rated"), F.col("total_score")).alias("total_score"),
                         F.when(~F.col("rated"), parent_of).alias("proxy_of")))
    return pg.with_proxies(own, proxies(v), BY).select("as_of", "node", "tier", "equity", "listed", "rated", "group_id", "industry", "total_score", "proxied")


def proxies(v: Views) -> DataFrame:
    return pg.group_proxies(snapshot(v).where("peer_group <> 'AFRICA'").select("as_of", "code", "total_score"), v.companies, BY)


def industry_links(v: Views) -> DataFrame:
    parts = F.split(F.substring(F.col("industry"), 2, 40), "_")
    return (v.companies.select("industry").distinct()
            .select(F.col("industry").alias("src_industry"),
                    F.concat(F.lit("I"), (parts[0].cast("int") + 1) % 7, F.lit("_"), parts[1]).alias("dst_industry")))


def active_signals(v: Views) -> DataFrame:
    return active_as_of(v.signals, AS_OF, F.col("valid_from"), F.col("valid_to")).withColumnRenamed("event_id", "signal_id")


def seeds(v: Views, n: DataFrame) -> DataFrame:
    return pg.assemble_seeds(active_signals(v), pg.opaque_seeds(active_edges(v), n, BY), n, BY)


def paths(v: Views) -> DataFrame:
    return v.stored("paths", lambda v: pg.enumerate_paths(stored_seeds(v), stored_steps(v), nodes(v), BY, industry_links(v)))


def stored_seeds(v: Views) -> DataFrame:
    return v.stored("seeds", lambda v: seeds(v, nodes(v)))


def stored_steps(v: Views) -> DataFrame:
    return v.stored("steps", lambda v: pg.typed_steps(active_edges(v), BY))


def scored_routes(v: Views) -> DataFrame:
    return v.stored("scored_routes", lambda v: pg.best_routes(pg.scoring(listed_routes(v)), BY).where("score > 0"))


def listed_routes(v: Views) -> DataFrame:
    return pg.listed_routes(stored_seeds(v), stored_steps(v), nodes(v), BY, industry_links(v))


def findings(v: Views) -> DataFrame:
    return v.stored("key_paths", lambda v: pg.summarize(paths(v), BY, ranked=True)[0])


# ------------------------------------------------------------------ SQL side
add_view("g_edges", "SELECT d.as_of, e.* FROM edges e JOIN dates d ON valid_from <= as_of AND as_of <= valid_to")
add_view("g_proxy", """SELECT as_of, group_id, round(s, 1) AS proxy_score, CASE WHEN s >= 60 THEN 'weak' WHEN s >= 40 THEN 'medium' ELSE 'strong' END AS proxy_tier, members, top FROM (
  SELECT as_of, group_id, round(coalesce(sum(total_score * w) / nullif(sum(w), 0), avg(total_score)), 6) AS s, count(*) AS members,
    array_to_string(list(code ORDER BY w DESC, code)[:4], ',') AS top
  FROM (SELECT f.as_of, f.code, c.group_id, f.total_score, CAST(greatest(c.equity, 0) AS DOUBLE) AS w FROM fragility f JOIN companies c USING (code)
    WHERE f.total_score IS NOT NULL AND c.peer_group <> 'AFRICA') GROUP BY as_of, group_id)""")
add_view("g_nodes", """SELECT d.as_of, c.code AS node, CASE WHEN c.peer_group <> 'AFRICA' THEN f.tier ELSE x.proxy_tier END AS tier, c.equity,
  c.peer_group <> 'AFRICA' AS rated, c.group_id, c.industry, CASE WHEN c.peer_group <> 'AFRICA' THEN f.total_score END AS total_score
  FROM companies c CROSS JOIN dates d LEFT JOIN fragility f ON f.code = c.code AND f.as_of = d.as_of
  LEFT JOIN g_proxy x ON c.peer_group = 'AFRICA' AND x.as_of = d.as_of AND x.group_id = 'G' || ((CAST(split_part(substr(c.group_id, 2), '_', 1) AS INT) + 1) % 25) || '_' || split_part(c.group_id, '_', 2)""")
add_view("g_steps", """SELECT as_of, src, shock, dst, rule, round(sum(amount_wan), 4) AS amount_wan, count(*) AS rows,
  max({'a': coalesce(amount_wan, -1), 'e': source_doc || ' 第' || source_page || '页：' || evidence_text}).e AS evidence FROM (
  SELECT *, dst_id AS src, 'credit' AS shock, src_id AS dst, 'R1' AS rule FROM g_edges WHERE edge_type = 'guarantee'
  UNION ALL SELECT *, src_id, 'supply', dst_id, 'R2' FROM g_edges WHERE edge_type IN ('supply', 'service', 'lease')
  UNION ALL SELECT *, dst_id, 'credit', src_id, 'R2' FROM g_edges WHERE edge_type IN ('supply', 'service', 'lease'))
  GROUP BY as_of, src, shock, dst, rule""")
add_view("g_opaque", """SELECT as_of, dst_id AS node, max({'f': first, 's': src_id, 'sev': severity}).sev AS severity FROM (
  SELECT t.*, CASE WHEN amount * 1e4 / n.equity >= 0.5 THEN 'high' WHEN amount * 1e4 / n.equity >= 0.1 THEN 'medium' END AS severity FROM (
    SELECT as_of, src_id, dst_id, sum(amount_wan) AS amount, min(announcement_date) AS first FROM g_edges e
    WHERE edge_type = 'guarantee' AND relationship NOT IN ('wholly_owned_subsidiary', 'controlled_subsidiary') AND amount_wan IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM g_nodes n WHERE n.as_of = e.as_of AND n.node = e.dst_id AND rated) GROUP BY ALL) t
  JOIN g_nodes n ON n.as_of = t.as_of AND n.node = t.src_id AND n.equity > 0) WHERE severity IS NOT NULL GROUP BY as_of, dst_id""")
add_view("g_signal_seeds", """SELECT as_of, entity_id AS node, shock, date, signal_type, severity FROM (
  SELECT *, row_number() OVER (PARTITION BY as_of, entity_id, shock ORDER BY severity <> 'high', date, event_id) AS rk FROM (
    SELECT *, CASE WHEN signal_type IN ('supply_disruption', 'capacity_reduction') THEN 'supply'
      WHEN signal_type IN ('credit_event', 'credit_exposure', 'share_pledge') THEN 'credit' END AS shock
    FROM signals JOIN dates ON valid_from <= as_of AND as_of <= valid_to WHERE severity IN ('medium', 'high')) WHERE shock IS NOT NULL) WHERE rk = 1""")
add_view("g_seeds", """SELECT as_of, node, shock, CASE WHEN use_sig THEN sig ELSE coalesce(op, wk) END AS severity,
  CASE WHEN use_sig THEN 'signal' WHEN op IS NOT NULL THEN 'opaque' ELSE 'weak' END AS kind,
  CASE WHEN use_sig THEN date || ' ' || signal_type END AS reason FROM (
  SELECT *, sig IS NOT NULL AND (op IS NULL OR (sig = 'high' AND op <> 'high')) AS use_sig FROM (
    SELECT as_of, node, shock, max(sig) AS sig, max(date) AS date, max(signal_type) AS signal_type, max(op) AS op, max(wk) AS wk FROM (
      SELECT as_of, node, shock, severity AS sig, date, signal_type, NULL AS op, NULL AS wk FROM g_signal_seeds
      UNION ALL SELECT as_of, node, 'credit', NULL, NULL, NULL, severity, NULL FROM g_opaque
      UNION ALL SELECT as_of, node, 'credit', NULL, NULL, NULL, NULL, 'medium' FROM g_nodes WHERE rated AND tier = 'weak') GROUP BY ALL)))""".replace("GROUP BY ALL)))", "GROUP BY as_of, node, shock))"))
add_view("g_links", """SELECT DISTINCT industry AS src_industry, 'I' || ((CAST(split_part(substr(industry, 2), '_', 1) AS INT) + 1) % 7) || '_' || split_part(industry, '_', 2) AS dst_industry FROM companies""")
add_view("g_opts", """SELECT o.as_of, o.node, o.shock, o.dst, o.rule, o.amount_wan, coalesce(n.tier, 'unknown') AS dst_tier, coalesce(n.rated, false) AS dst_listed,
  o.rule = 'R4' OR o.amount_wan IS NULL OR n.equity IS NULL OR n.equity <= 0 OR o.amount_wan * 1e4 / n.equity >= 0.01 AS material FROM (
  SELECT as_of, src AS node, shock, dst, rule, amount_wan FROM g_steps
  UNION ALL SELECT a.as_of, a.node, 'credit', b.node, 'R3', NULL FROM g_nodes a JOIN g_nodes b ON a.as_of = b.as_of AND a.group_id = b.group_id AND a.node <> b.node AND b.rated
  UNION ALL SELECT a.as_of, a.node, 'supply', b.node, 'R4', NULL FROM g_nodes a JOIN g_links l ON a.industry = l.src_industry
    JOIN g_nodes b ON b.as_of = a.as_of AND b.industry = l.dst_industry AND b.tier = 'weak') o
  LEFT JOIN g_nodes n ON n.as_of = o.as_of AND n.node = o.dst""")
_LEVEL = "CASE {0} WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 END"
_NAME = "CASE {0} WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END"


def add_hops(prefix: str, seed_view: str, opts: str, by: str = "as_of") -> None:
    """SQL of the path search, one view per hop."""
    add_view(f"{prefix}f0", f"""SELECT {by}, node AS seed, shock, node, {_LEVEL.format('severity')} AS level, [node] AS visited, '' AS key, false AS grouped,
      CAST([] AS VARCHAR[]) AS ds, CAST([] AS VARCHAR[]) AS rs, CAST([] AS VARCHAR[]) AS ts, CAST([] AS VARCHAR[]) AS decs, CAST([] AS VARCHAR[]) AS sevs,
      CAST([] AS DOUBLE[]) AS ams, CAST([] AS BOOLEAN[]) AS lis FROM {seed_view}""")
    on = " AND ".join(f"o.{b.strip()} = f.{b.strip()}" for b in by.split(","))
    for k in (1, 2, 3):
        add_view(f"{prefix}x{k}", f"""SELECT f.*, o.dst, o.rule, o.dst_tier,
          CASE WHEN o.dst IS NULL THEN NULL WHEN NOT o.material THEN 'immaterial' WHEN o.dst_tier = 'strong' THEN 'absorbed'
            WHEN o.dst_tier <> 'weak' AND f.level = 1 THEN 'end' WHEN o.dst_tier <> 'weak' THEN 'weakened' ELSE 'continue' END AS decision,
          o.amount_wan, o.dst_listed FROM {prefix}f{k - 1} f LEFT JOIN {opts} o ON {on} AND o.node = f.node AND o.shock = f.shock
            AND NOT list_contains(f.visited, o.dst) AND NOT (o.rule = 'R3' AND f.grouped)""")
        add_view(f"{prefix}d{k}", f"""SELECT {by}, seed, shock, key || '>' || rule || ':' || dst AS key, list_append(ds, dst) AS ds, list_append(rs, rule) AS rs,
          list_append(ts, dst_tier) AS ts, list_append(decs, decision) AS decs, list_append(sevs, {_NAME.format('level')}) AS sevs, list_append(ams, amount_wan) AS ams,
          list_append(lis, dst_listed) AS lis, decision IN ('immaterial', 'absorbed', 'end') OR rule = 'R4' OR {k} = 3 AS stop,
          dst AS node, CASE WHEN dst_tier = 'weak' THEN level ELSE level - 1 END AS level, list_append(visited, dst) AS visited, grouped OR rule = 'R3' AS grouped
          FROM {prefix}x{k} WHERE dst IS NOT NULL
          UNION ALL SELECT {by}, seed, shock, key, ds, rs, ts, decs, sevs, ams, lis, true, node, level, visited, grouped FROM {prefix}x{k} WHERE dst IS NULL AND {k} > 1""")
        if k < 3:
            add_view(f"{prefix}f{k}", f"SELECT {by}, seed, shock, node, level, visited, key, grouped, ds, rs, ts, decs, sevs, ams, lis FROM {prefix}d{k} WHERE NOT stop")
    add_view(f"{prefix}paths", " UNION ALL ".join(
        f"SELECT {by}, seed, shock, key, ds, rs, ts, decs, sevs, ams, lis FROM {prefix}d{k} WHERE stop" for k in (1, 2, 3)))


def add_summary(prefix: str, by: str = "as_of") -> None:
    add_view(f"{prefix}cut", f"""SELECT *, coalesce(list_max(list_transform(generate_series(1, len(ds)), lambda i: CASE WHEN lis[i] THEN i ELSE 0 END)), 0) AS last FROM {prefix}paths""")
    add_view(f"{prefix}heads", f"""SELECT *, array_to_string(list_transform(generate_series(1, last), lambda i: rs[i] || ':' || ds[i]), '>') AS route,
      CASE WHEN len(ds) > last THEN coalesce(ams[last + 1], 0) ELSE 0 END AS beyond_first, ds[last + 1:] AS far,
      CASE sevs[1] WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS sev FROM {prefix}cut WHERE last > 0""")
    add_view(f"{prefix}keyed", f"""SELECT {by}, seed, route, arg_max({{'shock': shock, 'ds': ds[:last], 'rs': rs[:last], 'ts': ts[:last], 'ams': ams[:last], 'lis': lis[:last], 'sev': sev}},
        sev * 2 + CASE shock WHEN 'credit' THEN 1 ELSE 0 END) AS b,
      round(sum(beyond_first), 4) AS beyond_amount_wan, len(list_distinct(flatten(list(far)))) AS beyond FROM {prefix}heads GROUP BY {by}, seed, route""")
    add_view(f"{prefix}scored", f"""SELECT *, round(sev * (1 + log10(1 + amount / 1e4)) * listed_reach, 2) AS full_score FROM (
      SELECT {by}, seed, route, b.shock, b.sev, beyond_amount_wan, beyond, b.ds AS ds, b.rs AS rs, b.ts AS ts, b.lis AS lis, b.ams AS ams,
        array_to_string(b.rs, '+') AS rules, list_contains(b.rs, 'R4') AS scenario,
        array_to_string(list_transform(list_filter(generate_series(1, len(b.ds)), lambda i: b.lis[i]), lambda i: b.ds[i]), '>') AS listed_seq,
        coalesce(b.ams[1], 0) + coalesce(b.ams[2], 0) + coalesce(b.ams[3], 0) AS amount,
        list_sum(list_transform(generate_series(1, len(b.ds)), lambda i: CASE WHEN NOT b.lis[i] THEN 0.0 WHEN b.ts[i] = 'weak' THEN 1.0 WHEN b.ts[i] = 'medium' THEN 0.5 ELSE 0.0 END))::DOUBLE AS listed_reach
      FROM {prefix}keyed)""")
    add_view(f"{prefix}findings", f"""SELECT {by}, seed, listed_seq, rules, route, shock, CASE WHEN scenario THEN 0.0 ELSE full_score END AS score, scenario,
      CASE WHEN scenario THEN full_score END AS scenario_score, round(amount / 1e4, 6) AS amount_yi, listed_reach, beyond, beyond_amount_wan, alternatives, route_rules, ds, rs, ts, lis, ams FROM (
      SELECT *, row_number() OVER (PARTITION BY {by}, seed, listed_seq ORDER BY CASE WHEN scenario THEN 0.0 ELSE full_score END DESC, rules, route) AS rk,
        count(*) OVER (PARTITION BY {by}, seed, listed_seq) - 1 AS alternatives,
        array_to_string(list_sort(list_distinct(list(rules) OVER (PARTITION BY {by}, seed, listed_seq))), ',') AS route_rules FROM {prefix}scored) WHERE rk = 1""")


add_hops("g_", "g_seeds", "g_opts")
add_summary("g_")
DAY = "CAST(as_of AS VARCHAR) AS as_of"
FINDING = ["seed", "listed_seq", "rules", "route", "shock", "score", "scenario", "scenario_score", "amount_yi", "listed_reach", "beyond",
           "beyond_amount_wan", "alternatives", "route_rules"]


@query("G4 A1 F23 P4", f"SELECT {DAY}, src, shock, dst, rule, amount_wan, rows, evidence FROM g_steps")
def typed_steps(v: Views):
    return pg.typed_steps(active_edges(v), BY).select(day(), "src", "shock", "dst", "rule", "amount_wan", "rows", "evidence")


@query("G9 G10 A2", f"SELECT {DAY}, node, shock, severity, kind, reason FROM g_seeds")
def propagation_seeds(v: Views):
    return stored_seeds(v).select(day(), "node", "shock", "severity", "kind", "reason")


@query("G5 G6 G7 G8 F16", f"""SELECT DISTINCT {DAY}, seed, shock, substr(key, 2) AS key, array_to_string(decs, '>') AS decisions, array_to_string(sevs, '>') AS severities FROM g_paths""")
def propagation_paths(v: Views):
    return pg.path_strings(paths(v)).select(day(), "seed", "shock", F.substring("key", 2, 10_000).alias("key"), "decisions", "severities")


@query("G11 G13 G14 F25", f"SELECT {DAY}, {', '.join(FINDING)} FROM g_findings")
def key_paths(v: Views):
    return findings(v).select(day(), *FINDING)


@query("G12", f"""SELECT {DAY}, seed, len(list_distinct(flatten(list(ds)))) AS parties, round(sum(coalesce(ams[1], 0)), 4) AS amount_wan
  FROM g_cut WHERE last = 0 GROUP BY as_of, seed""")
def local_reach(v: Views):
    return pg.summarize(paths(v), BY)[1].select(day(), "seed", "parties", "amount_wan")


@query("A6 A24", f"SELECT {DAY}, group_id, proxy_score, proxy_tier, members, top FROM g_proxy")
def group_proxies(v: Views):
    return proxies(v).select(day(), "group_id", "proxy_score", "proxy_tier", "members", "top")
