"""What new documents add to the stored graph, and graded supply routes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline import rules
from faultline.catalog import graph as g
from faultline.catalog.registry import query
from faultline.catalog.scoring import day
from faultline.catalog.views import AS_OF, Views, add_view
from faultline.functions.scalars import lookup
from faultline.operators.graph import weakest_routes
from faultline.plans import propagation as pg

DAY = "CAST(as_of AS VARCHAR) AS as_of"
NEW_DAYS = 14                          # documents published in so many days before a date are its new ones
BY = ["as_of"]
RECENT = f"date_diff('day', {{0}}, as_of) < {NEW_DAYS}"


def recent(published: str) -> Column:
    return F.datediff("as_of", F.col(published)) < NEW_DAYS


def new_and_old(v: Views) -> tuple[DataFrame, DataFrame]:
    """Relations of the new documents, and the stored base."""
    e = g.active_edges(v)
    return e.where(recent("announcement_date")), e.where(~recent("announcement_date"))


def new_seeds(v: Views) -> DataFrame:
    """The seeds that new documents' serious signals state, as the stored seeds state them."""
    fresh = g.active_signals(v).where(recent("date"))
    kind = F.col("signal_type")
    shock = F.when(kind.isin(*rules.SUPPLY_SIGNALS), "supply").when(kind.isin(*rules.CREDIT_SIGNALS), "credit")
    named = fresh.where(F.col("severity").isin("medium", "high")).select("as_of", F.col("entity_id").alias("node"), shock.alias("shock")).where("shock is not null").distinct()
    return g.stored_seeds(v).join(named, ["as_of", "node", "shock"], "left_semi")


def increment(v: Views) -> DataFrame:
    def build(v: Views) -> DataFrame:
        new, old = new_and_old(v)
        base, seeds, links = pg.typed_steps(old, BY), new_seeds(v), g.industry_links(v)
        known = g.stored_seeds(v).join(seeds.select("as_of", "node", "shock"), ["as_of", "node", "shock"], "left_anti")
        opened: list[DataFrame] = []
        pg.enumerate_paths(known, base, g.nodes(v), BY, links, frontiers=opened)
        return pg.new_paths(opened, seeds, base, pg.typed_steps(new, BY), g.nodes(v), BY, links)
    return v.stored("new_paths", build)


_TYPED = """SELECT as_of, src, shock, dst, rule, round(sum(amount_wan), 4) AS amount_wan FROM (
  SELECT *, dst_id AS src, 'credit' AS shock, src_id AS dst, 'R1' AS rule FROM i_edges WHERE edge_type = 'guarantee'
  UNION ALL SELECT *, src_id, 'supply', dst_id, 'R2' FROM i_edges WHERE edge_type IN ('supply', 'service', 'lease')
  UNION ALL SELECT *, dst_id, 'credit', src_id, 'R2' FROM i_edges WHERE edge_type IN ('supply', 'service', 'lease')) GROUP BY ALL"""
add_view("i_edges", f"SELECT * FROM g_edges WHERE NOT ({RECENT.format('announcement_date')})")
add_view("i_steps", _TYPED)
add_view("i_opts", """SELECT s.as_of, s.src AS node, s.shock, s.dst, s.rule, s.amount_wan, coalesce(n.tier, 'unknown') AS dst_tier, coalesce(n.rated, false) AS dst_listed,
  s.amount_wan IS NULL OR n.equity IS NULL OR n.equity <= 0 OR s.amount_wan * 1e4 / n.equity >= 0.01 AS material FROM i_steps s LEFT JOIN g_nodes n ON n.as_of = s.as_of AND n.node = s.dst
  UNION ALL SELECT * FROM g_opts WHERE rule IN ('R3', 'R4')""")
add_view("i_named", f"""SELECT DISTINCT as_of, entity_id AS node, CASE WHEN signal_type IN ('supply_disruption', 'capacity_reduction') THEN 'supply' ELSE 'credit' END AS shock
  FROM signals JOIN dates ON valid_from <= as_of AND as_of <= valid_to WHERE severity IN ('medium', 'high') AND {RECENT.format('date')}
    AND signal_type IN ('supply_disruption', 'capacity_reduction', 'credit_event', 'credit_exposure', 'share_pledge')""")
add_view("i_seeds", "SELECT s.* FROM g_seeds s WHERE NOT EXISTS (SELECT 1 FROM i_named n WHERE n.as_of = s.as_of AND n.node = s.node AND n.shock = s.shock)")
g.add_hops("i_", "i_seeds", "i_opts")
_LIST = "array_to_string(list_transform({0}, lambda x: coalesce(CAST(x AS VARCHAR), '-')), '>')"
_PATH = f"as_of, seed, shock, substr(key, 2) AS key, array_to_string(decs, '>') AS decisions, array_to_string(sevs, '>') AS severities, ams"


@query("G30", f"""SELECT {DAY}, seed, shock, key, decisions, severities, {_LIST.format('list_transform(ams, lambda a: CAST(round(a * 100) AS BIGINT))')} AS amounts
  FROM (SELECT DISTINCT {_PATH} FROM g_paths EXCEPT SELECT DISTINCT {_PATH} FROM i_paths)""")
def new_document_paths(v: Views):
    """Paths that the new documents of a date add: full search minus the search over the stored base.

    Relations and signals of the last days are the increment; a path is made only if it starts from a new signal, uses a
    new relation, or uses one whose amount the new documents change.
    """
    amounts = F.array_join(F.transform("steps", lambda s: F.coalesce(F.round(s["amount_wan"] * 100).cast("long").cast("string"), F.lit("-"))), ">")
    return (pg.path_strings(increment(v)).select(day(), "seed", "shock", F.expr("substring(key, 2)").alias("key"), "decisions", "severities", amounts.alias("amounts")))


@query("G30", f"""SELECT {DAY}, entity, CAST(sum(e) AS BIGINT) AS relations, CAST(sum(s) AS BIGINT) AS signals FROM (
    SELECT as_of, src_id AS entity, 1 AS e, 0 AS s FROM g_edges WHERE {RECENT.format('announcement_date')} UNION ALL SELECT as_of, dst_id, 1, 0 FROM g_edges WHERE {RECENT.format('announcement_date')}
    UNION ALL SELECT as_of, entity_id, 0, 1 FROM signals JOIN dates ON valid_from <= as_of AND as_of <= valid_to WHERE {RECENT.format('date')}) GROUP BY as_of, entity""")
def new_document_entities(v: Views):
    """Everybody the new documents of a date involve, with the relations and signals that name them."""
    new = new_and_old(v)[0]
    ends = new.select("as_of", F.explode(F.array("src_id", "dst_id")).alias("entity"), F.lit(1).alias("e"), F.lit(0).alias("s"))
    told = g.active_signals(v).where(recent("date")).select("as_of", F.col("entity_id").alias("entity"), F.lit(0).alias("e"), F.lit(1).alias("s"))
    return ends.unionByName(told).groupBy(day(), "entity").agg(F.sum("e").alias("relations"), F.sum("s").alias("signals"))


# ------------------------------------------------------------------ supply routes with channel and weakest grade
add_view("r_edges", """SELECT as_of, src_id AS src, dst_id AS dst, CASE WHEN bool_or(edge_type = 'supply') THEN 'A' WHEN count(*) > 1 THEN 'B' ELSE 'C' END AS grade,
  CASE WHEN bool_or(edge_type = 'supply') THEN 'deliveries' ELSE 'services' END AS effect, round(max(amount_wan), 4) AS amount_wan FROM g_edges WHERE edge_type IN ('supply', 'service') GROUP BY as_of, src_id, dst_id""")
add_view("r_starts", "SELECT DISTINCT as_of, node FROM g_seeds WHERE shock = 'supply' AND kind = 'signal' AND severity = 'high'")
_ROUTES = """routes(as_of, node, depth, grade, route, effect, amount_wan) USING KEY (as_of, node) AS (SELECT as_of, node, 0 AS depth, '' AS grade, [node] AS route, NULL::VARCHAR AS effect, NULL::DOUBLE AS amount_wan FROM r_starts
  UNION SELECT as_of, node, depth, b.grade, b.route, b.effect, b.amount_wan FROM (
    SELECT r.as_of, e.dst AS node, r.depth + 1 AS depth, min({'grade': greatest(r.grade, e.grade), 'route': list_append(r.route, e.dst), 'effect': e.effect, 'amount_wan': e.amount_wan}) AS b
    FROM routes r JOIN r_edges e ON e.as_of = r.as_of AND e.src = r.node
    WHERE NOT EXISTS (SELECT 1 FROM recurring.routes p WHERE p.as_of = r.as_of AND p.node = e.dst) GROUP BY r.as_of, e.dst, r.depth + 1))"""
STRENGTH = "round(CASE grade WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.7 ELSE 0.4 END::DOUBLE * CASE WHEN amount_wan > 0 THEN least(1.0, 0.35 + log10(1 + amount_wan / 1e4) / 3) ELSE 0.3 END, 3)"


@query("G18", f"""WITH RECURSIVE {_ROUTES} SELECT {DAY}, route[1] AS start, node, depth, grade,
    array_to_string(list_transform(route[2:-2], lambda x: coalesce(names[x], x)), ' → ') AS channel, effect,
    CASE WHEN amount_wan > 0 THEN CAST(round(amount_wan) AS BIGINT) || ' 万' ELSE '—' END AS size, {STRENGTH} AS strength FROM routes, (SELECT map(list(code), list(name)) AS names FROM companies) m WHERE depth > 0""")
def supply_routes(v: Views):
    """Each company a supply shock reaches, once: its route's hops merged into a channel, the weakest grade along it, and
    the size and strength of its last hop."""
    e = g.active_edges(v).where(F.col("edge_type").isin("supply", "service"))
    supply = F.max((F.col("edge_type") == "supply"))
    edges = e.groupBy("as_of", F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).agg(
        F.when(supply, "A").when(F.count("*") > 1, "B").otherwise("C").alias("grade"), F.when(supply, "deliveries").otherwise("services").alias("effect"),
        F.round(F.max("amount_wan"), 4).alias("amount_wan"))
    starts = g.stored_seeds(v).where("shock = 'supply' and kind = 'signal' and severity = 'high'").select("as_of", "node")
    found = weakest_routes(edges, starts, ["as_of"])
    named = (found.select("as_of", "node", F.posexplode("middle").alias("k", "code")).join(v.companies.select("code", "name"), "code", "left")
             .groupBy("as_of", "node").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("name", "code").alias("name")))).alias("m"))
             .select("as_of", "node", F.array_join(F.col("m")["name"], " → ").alias("channel")))
    amount = F.col("last.amount_wan")
    size = F.when(amount > 0, F.least(F.lit(1.0), 0.35 + F.log10(1 + amount / 1e4) / 3)).otherwise(0.3)
    return (found.join(named, ["as_of", "node"], "left")
            .select(day(), "start", "node", "depth", "grade", F.coalesce("channel", F.lit("")).alias("channel"), "last.effect",
                    F.when(amount > 0, F.concat(F.round(amount).cast("long").cast("string"), F.lit(" 万"))).otherwise("—").alias("size"),
                    F.round(lookup(F.col("grade"), rules.GRADE_WEIGHT, 0.4) * size, 3).alias("strength")))
