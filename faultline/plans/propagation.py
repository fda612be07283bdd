"""Bounded, tier-gated path search over typed relations, for all evaluation dates and seeds together.

``by`` names the columns that separate independent graphs (evaluation date, and for example a variant).
Group and industry steps are never written out as pairs beforehand: they are looked up for the nodes on the
current frontier only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline import rules
from faultline.functions.scalars import evidence, first_match, level_name, level_number, lookup, tier_of
from faultline.operators.ordering import text_bucket, with_row_number
from faultline.session import cut_lineage, sorted_joins

STEP = ["rule", "src", "dst", "severity", "dst_tier", "decision", "basis", "evidence", "amount_wan", "dst_listed"]


def group_proxies(fragility: DataFrame, companies: DataFrame, by: list[str]) -> DataFrame:
    """(by, group_id): equity-weighted score of the group's rated members, plain mean when no weight, top members."""
    member = (fragility.join(companies.select("code", "group_id", "equity"), "code")
              .where(F.col("total_score").isNotNull() & F.col("group_id").isNotNull())
              .withColumn("_w", F.greatest(F.coalesce(F.col("equity"), F.lit(0)), F.lit(0)).cast("double")))
    top = (member.withColumn("_k", F.row_number().over(W.partitionBy(*by, "group_id").orderBy(F.desc("_w"), "code")))
           .where("_k <= 4").groupBy(*by, "group_id")                      # a limit on the label, not on the score
           .agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("_k", "code"))), lambda m: m["code"])).alias("top")))
    score = F.coalesce(F.try_divide(F.sum(F.col("total_score") * F.col("_w")), F.sum("_w")), F.avg("total_score"))
    return (member.groupBy(*by, "group_id").agg(F.round(score, 6).alias("_s"), F.count("*").alias("members"))
            .select(*by, "group_id", F.round("_s", 1).alias("proxy_score"), tier_of(F.col("_s")).alias("proxy_tier"), "members")
            .join(top, [*by, "group_id"]))


def with_proxies(nodes: DataFrame, proxies: DataFrame, by: list[str]) -> DataFrame:
    """Nodes whose tier, where they have none of their own, is the proxy of the group that ``proxy_of`` names.

    Only parent groups name one. Leave the call out for a search without proxies.
    """
    p = proxies.select(*by, F.col("group_id").alias("proxy_of"), "proxy_tier")
    return (nodes.join(p, [*by, "proxy_of"], "left").withColumn("tier", F.coalesce("tier", "proxy_tier"))
            .withColumn("proxied", F.col("proxy_tier").isNotNull() & ~F.col("rated")).drop("proxy_tier"))


def typed_steps(edges: DataFrame, by: list[str]) -> DataFrame:
    """Directed steps: guarantees run party → guarantor (credit), trades forward (supply) and back (credit).

    Parallel rows of one relation are merged here, once: amounts add up, the largest row is the evidence.
    """
    trade = F.col("edge_type").isin(*rules.TRADE_EDGES)
    way = lambda rule, shock, a, b: F.struct(F.lit(rule).alias("rule"), F.lit(shock).alias("shock"),
                                             F.col(a).alias("src"), F.col(b).alias("dst"))
    ways = (F.when(F.col("edge_type") == "guarantee", F.array(way("R1", "credit", "dst_id", "src_id")))
            .when(trade, F.array(way("R2", "supply", "src_id", "dst_id"), way("R2", "credit", "dst_id", "src_id"))))
    proof = evidence(F.col("source_doc"), F.col("source_page"), F.col("evidence_text"))
    rows = edges.select(*by, F.explode(ways).alias("w"), "amount_wan", proof.alias("evidence"), "basis")
    return (rows.groupBy(F.col("w.src").alias("src"), F.col("w.dst").alias("dst"), *by, F.col("w.shock").alias("shock"),
                         F.col("w.rule").alias("rule"))                    # a node first: rows are sorted by their leading key
            .agg(F.sum("amount_wan").alias("amount_wan"), F.count("*").alias("rows"),
                 F.max(F.struct(F.coalesce("amount_wan", F.lit(-1.0)).alias("a"), "evidence", "basis")).alias("_top"))
            .select(*by, "src", "shock", "dst", "rule", F.round("amount_wan", 4).alias("amount_wan"), "rows",
                    "_top.evidence", "_top.basis"))


def opaque_seeds(active_edges: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """Guaranteed non-subsidiaries without a rating; severity by guarantee ÷ guarantor equity. Of several
    guarantors the one whose guarantee was announced last counts."""
    rated = nodes.where("rated").select(*by, F.col("node").alias("dst_id"))
    totals = (active_edges.where((F.col("edge_type") == "guarantee") & ~F.coalesce(F.col("relationship"), F.lit("")).isin(*rules.SUBSIDIARY)
                                 & F.col("amount_wan").isNotNull())
              .join(rated, [*by, "dst_id"], "left_anti")
              .groupBy(*by, "src_id", "dst_id").agg(F.sum("amount_wan").alias("amount"), F.min("announcement_date").alias("first")))
    share = F.col("amount") * 1e4 / F.col("equity")
    severity = F.when(share >= rules.OPAQUE_HIGH, "high").when(share >= rules.OPAQUE_MEDIUM, "medium")
    return (totals.join(nodes.where("equity > 0").select(*by, F.col("node").alias("src_id"), "equity"), [*by, "src_id"])
            .withColumn("severity", severity).where("severity is not null")
            .groupBy(*by, F.col("dst_id").alias("node")).agg(F.max_by("severity", F.struct("first", "src_id")).alias("severity")))


def assemble_seeds(signals_active: DataFrame, opaque: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """Opaque parties, then signals (a high signal replaces a seed that is not high), then weak companies."""
    kind = F.col("signal_type")
    shock = F.when(kind.isin(*rules.SUPPLY_SIGNALS), "supply").when(kind.isin(*rules.CREDIT_SIGNALS), "credit")
    serious = (signals_active.where(F.col("severity").isin("medium", "high")).withColumn("shock", shock).where("shock is not null"))
    # first high signal, or else the first one: the smallest (not high, date, id)
    first = F.min(F.struct((F.col("severity") != "high").alias("_n"), "date", "signal_id", "severity", "signal_type"))
    sig = (serious.groupBy(*by, F.col("entity_id").alias("node"), "shock").agg(first.alias("s"))
           .select(*by, "node", "shock", F.col("s.severity").alias("sig"), "s.date", "s.signal_type"))
    op = opaque.select(*by, "node", F.lit("credit").alias("shock"), F.col("severity").alias("op"))
    wk = nodes.where("rated and tier = 'weak'").select(*by, "node", F.lit("credit").alias("shock"), F.lit("medium").alias("wk"))
    merged = sig.join(op, [*by, "node", "shock"], "full").join(wk, [*by, "node", "shock"], "full")
    by_signal = F.col("sig").isNotNull() & (F.col("op").isNull() | ((F.col("sig") == "high") & (F.col("op") != "high")))
    return merged.select(*by, "node", "shock", F.when(by_signal, F.col("sig")).otherwise(F.coalesce("op", "wk")).alias("severity"),
                         F.when(by_signal, "signal").when(F.col("op").isNotNull(), "opaque").otherwise("weak").alias("kind"),
                         F.when(by_signal, F.concat(F.col("date").cast("string"), F.lit(" "), "signal_type")).alias("reason"))


def _options(frontier: DataFrame, steps: DataFrame, nodes: DataFrame, links: DataFrame | None, by: list[str]) -> DataFrame:
    """Next steps of the nodes on the frontier, with what is needed to decide them."""
    here = frontier.select(*by, "node", "shock").distinct()
    info = nodes.select(*by, F.col("node").alias("dst"), F.coalesce("tier", F.lit("unknown")).alias("dst_tier"),
                        F.col("equity").alias("dst_equity"), F.col("listed").alias("dst_listed"), "group_id", "industry")
    direct = (steps.withColumnRenamed("src", "node").join(here, ["node", "shock", *by], "left_semi")
              .join(info.drop("group_id", "industry"), ["dst", *by], "left")
              .select(*by, "node", "shock", "dst", "rule", "amount_wan", "basis", "evidence", "dst_tier", "dst_equity", "dst_listed"))
    mine = here.join(nodes.select(*by, "node", "group_id", "industry"), [*by, "node"])
    group = (mine.where("shock = 'credit' and group_id is not null")
             .join(info.where("dst_listed").drop("industry"), [*by, "group_id"]).where("dst <> node")
             .select(*by, "node", "shock", "dst", F.lit("R3").alias("rule"), F.lit("entity_table").alias("basis"),
                     F.col("group_id").alias("evidence"), "dst_tier", "dst_equity", "dst_listed"))
    out = direct.unionByName(group, allowMissingColumns=True)
    if links is not None:
        downstream = (mine.where("shock = 'supply'").join(links.withColumnRenamed("src_industry", "industry"), "industry")
                      .select(*by, "node", "shock", F.col("dst_industry").alias("industry"))
                      .join(info.where("dst_tier = 'weak'").drop("group_id"), [*by, "industry"])
                      .select(*by, "node", "shock", "dst", F.lit("R4").alias("rule"), F.lit("industry_approx").alias("basis"),
                              F.col("industry").alias("evidence"), "dst_tier", "dst_equity", "dst_listed"))
        out = out.unionByName(downstream, allowMissingColumns=True)
    return (out.withColumn("dst_tier", F.coalesce("dst_tier", F.lit("unknown")))
            .withColumn("dst_listed", F.coalesce("dst_listed", F.lit(False))))


def material() -> Column:
    """Amount at least 1 % of the next company's equity; what cannot be judged does not stop a path."""
    unknown = F.col("amount_wan").isNull() | F.col("dst_equity").isNull() | (F.col("dst_equity") <= 0)
    return unknown | (F.col("amount_wan") * 1e4 / F.col("dst_equity") >= rules.MATERIALITY)


def start(seeds: DataFrame, by: list[str]) -> DataFrame:
    """The frontier before the first hop, a row for each seed."""
    return seeds.select(*by, F.col("node").alias("seed"), "shock", "node", level_number(F.col("severity")).alias("level"),
                        F.array("node").alias("visited"), F.lit("").alias("key"), F.lit(False).alias("grouped"),
                        F.expr("cast(array() as array<struct<rule:string,src:string,dst:string,severity:string,dst_tier:string,"
                               "decision:string,basis:string,evidence:string,amount_wan:double,dst_listed:boolean>>)").alias("steps"))


def _joined(frontier: DataFrame, opts: DataFrame, by: list[str], how: str) -> DataFrame:
    """Branches beside each of their next steps, with what is decided about it."""
    o, f = opts.alias("o"), frontier.alias("f")
    cond = ((F.col("o.node") == F.col("f.node")) & (F.col("o.shock") == F.col("f.shock"))
            & ~F.array_contains("f.visited", F.col("o.dst")) & ~((F.col("o.rule") == "R3") & F.col("f.grouped")))
    for b in by:
        cond = cond & (F.col(f"o.{b}") == F.col(f"f.{b}"))
    grown = f.join(o, cond, how).select("f.*", *[F.col(f"o.{c}").alias(c) for c in opts.columns if c not in (*by, "node", "shock")])
    weak = F.col("dst_tier") == "weak"
    decision = first_match([((F.col("rule") != "R4") & ~material(), F.lit("immaterial")), (F.col("dst_tier") == "strong", F.lit("absorbed")),
                            (~weak & (F.col("level") == 1), F.lit("end")), (~weak, F.lit("weakened"))], F.lit("continue"))
    moved = F.col("dst").isNotNull()
    return (grown.withColumn("decision", F.when(moved, decision))
            .withColumn("key", F.when(moved, F.concat("key", F.lit(">"), "rule", F.lit(":"), "dst")).otherwise(F.col("key"))))


def grown_by(frontier: DataFrame, opts: DataFrame, by: list[str], how: str) -> DataFrame:
    """Branches one step longer; ``how`` = "left" keeps branches without an option, with a null dst."""
    step = F.struct("rule", F.col("node").alias("src"), "dst", level_name(F.col("level")).alias("severity"), "dst_tier",
                    "decision", "basis", "evidence", "amount_wan", "dst_listed")
    return _joined(frontier, opts, by, how).withColumn("steps", F.when(F.col("dst").isNotNull(), F.array_append("steps", step)).otherwise(F.col("steps")))


def _ended(last: bool) -> Column:
    return F.col("dst").isNull() | F.col("decision").isin("immaterial", "absorbed", "end") | (F.col("rule") == "R4") | F.lit(last)


def _onward(*carried: str) -> list:
    """The columns of the next frontier: what the last step changes, and what is carried as it is."""
    weak = F.col("dst_tier") == "weak"
    return ["seed", "shock", F.col("dst").alias("node"), F.when(weak, F.col("level")).otherwise(F.col("level") - 1).alias("level"),
            F.array_append("visited", F.col("dst")).alias("visited"), "key", (F.col("grouped") | (F.col("rule") == "R3")).alias("grouped"), *carried]


def divided(grown: DataFrame, by: list[str], last: bool) -> tuple[DataFrame, DataFrame]:
    """Finished branches, and the frontier of the next hop."""
    stop = _ended(last)
    done = grown.where(stop & (F.size("steps") > 0)).select(*by, "seed", "shock", "key", "steps")
    return done, grown.where(~stop).select(*by, *_onward("steps"))


def enumerate_paths(seeds: DataFrame, steps: DataFrame, nodes: DataFrame, by: list[str], links: DataFrame | None = None,
                    max_hops: int = rules.MAX_HOPS, frontiers: list[DataFrame] | None = None) -> DataFrame:
    """All finished branches: (by, seed, shock, key, steps).

    seeds: by, node, shock, severity; nodes: by, node, tier, equity, listed, rated, group_id, industry. ``frontiers``: a
    list that receives the branches that were open before each hop, for ``new_paths``.
    """
    frontier = start(cut_lineage(seeds), by)
    steps, nodes = sorted_joins(cut_lineage(steps)), sorted_joins(cut_lineage(nodes))        # read by every hop
    finished = None
    for hop in range(1, max_hops + 1):
        if frontiers is not None:
            frontiers.append(frontier)
        # a branch without an option stays, with a null dst
        grown = grown_by(frontier, _options(frontier, steps, nodes, links, by), by, "left")
        if hop < max_hops:
            grown = sorted_joins(cut_lineage(grown))
        done, frontier = divided(grown, by, hop == max_hops)
        finished = done if finished is None else finished.unionByName(done)
    return finished


STEP_KEY = ["src", "shock", "dst", "rule"]


def merged_steps(base: DataFrame, new: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Steps of ``new`` edges merged with parallel ones of the ``base``: (touched steps, all steps)."""
    key = [*by, *STEP_KEY]
    old = base.select(*key, *[F.col(c).alias(f"_{c}") for c in ("amount_wan", "rows", "evidence", "basis")])
    top = lambda name: F.when(F.col("_rows").isNull() | (F.coalesce("amount_wan", F.lit(-1.0)) >= F.coalesce("_amount_wan", F.lit(-1.0))),
                              F.col(name)).otherwise(F.col(f"_{name}")).alias(name)
    amount = F.when(F.col("amount_wan").isNull(), F.col("_amount_wan")).otherwise(F.round(F.col("amount_wan") + F.coalesce("_amount_wan", F.lit(0.0)), 4))
    touched = cut_lineage(new.join(old, key, "left").select(*key, amount.alias("amount_wan"), (F.col("rows") + F.coalesce("_rows", F.lit(0))).alias("rows"),
                                                            top("evidence"), top("basis")))
    return touched, base.join(touched.select(*key), key, "left_anti").unionByName(touched)


def new_paths(frontiers: list[DataFrame], new_seeds: DataFrame, base: DataFrame, new: DataFrame, nodes: DataFrame, by: list[str],
              links: DataFrame | None = None) -> DataFrame:
    """Finished branches that the ``new`` steps or ``new_seeds`` add to a search over ``base``: (by, seed, shock, key, steps).

    ``frontiers`` are the open branches of the base search before each hop. A hop extends branches that already hold
    something new by every step, and the base's branches by touched steps only, so nothing the base search has found is
    made again. A step whose merged amount changes counts as new.
    """
    touched, steps = merged_steps(base, new, by)
    steps, nodes = cut_lineage(steps), cut_lineage(nodes)
    fresh = start(cut_lineage(new_seeds), by)
    out = None
    for hop, old in enumerate(frontiers, 1):
        ends = touched.select(*by, F.col("src").alias("node"), "shock").distinct()
        near = old.join(ends, [*by, "node", "shock"], "left_semi")
        grown = (grown_by(fresh, _options(fresh, steps, nodes, links, by), by, "left")
                 .unionByName(grown_by(near, _options(near, touched, nodes, None, by).where("rule in ('R1', 'R2')"), by, "inner")))
        if hop < len(frontiers):
            grown = cut_lineage(grown)
        done, fresh = divided(grown, by, hop == len(frontiers))
        out = done if out is None else out.unionByName(done)
    return out


def path_strings(paths: DataFrame) -> DataFrame:
    """Flat columns for export and comparison."""
    text = lambda f: F.array_join(F.transform("steps", lambda s: F.coalesce(s[f].cast("string"), F.lit("-"))), ">")
    return paths.withColumn("decisions", text("decision")).withColumn("severities", text("severity")).withColumn("rules", text("rule"))


def _amount(steps: Column) -> Column:
    return F.aggregate(steps, F.lit(0.0), lambda a, s: a + F.coalesce(s["amount_wan"], F.lit(0.0)))


def _cut(paths: DataFrame) -> DataFrame:
    """Paths with ``_last``, the number of steps up to the last listed company."""
    last = F.coalesce(F.array_max(F.transform("steps", lambda s, i: F.when(s["dst_listed"], i + 1).otherwise(0))), F.lit(0))
    ends = F.try_element_at("steps", F.lit(-1))["dst_listed"]                          # most paths end at a listed company
    return paths.withColumn("_last", F.when(ends, F.size("steps")).otherwise(last))


def _kept(cut: DataFrame) -> DataFrame:
    """Paths that meet a listed company, with the steps up to the last one (``_head``) and their ``route``."""
    names = lambda arr: F.array_join(F.transform(arr, lambda s: F.concat(s["rule"], F.lit(":"), s["dst"])), ">")
    kept = cut.where("_last > 0").withColumn("_whole", F.col("_last") == F.size("steps"))
    kept = kept.withColumn("_head", F.when(F.col("_whole"), F.col("steps")).otherwise(F.slice("steps", 1, F.col("_last"))))
    return kept.withColumn("route", F.when(F.col("_whole"), F.substring("key", 2, 1 << 30)).otherwise(names(F.col("_head"))))


def _short() -> list[Column]:
    """What decides between cut paths, as numbers and names."""
    credit = F.col("shock") == "credit"
    listed = F.filter("_head", lambda x: x["dst_listed"])
    reach = F.aggregate(listed, F.lit(0.0), lambda a, x: a + lookup(x["dst_tier"], rules.REACH_TIER_WEIGHT, 0.0))
    return [F.array_join(listed["dst"], ">").alias("listed_seq"), F.array_join(F.col("_head")["rule"], "+").alias("rules"),
            # severity first, then credit before supply
            (level_number(F.col("_head")[0]["severity"]) * 2 + credit.cast("int")).alias("_sev"), credit.alias("_credit"),
            _amount(F.col("_head")).alias("_amount"), reach.alias("_reach")]


def _best() -> list[Column]:
    sides = [F.max(F.when(F.col("_credit"), F.col("_amount"))).alias("_a1"), F.max(F.when(~F.col("_credit"), F.col("_amount"))).alias("_a0")]
    return [F.max("_sev").alias("_sev"), F.max("_reach").alias("_reach"), *sides]


def _scores() -> tuple[Column, Column, Column]:
    """Of the best rows of a route: whether it is a credit path, its amount, its score."""
    first = F.col("_sev") % 2 == 1
    amount_yi = F.when(first, F.col("_a1")).otherwise(F.col("_a0")) / 1e4
    return first, amount_yi, F.round(F.floor(F.col("_sev") / 2) * (1 + F.log10(1 + amount_yi)) * F.col("_reach"), 2)


def cut_routes(paths: DataFrame, by: list[str]) -> DataFrame:
    """(by, seed, route, listed_seq, rules and the numbers that make a score): paths cut after their last listed company."""
    return _kept(_cut(paths)).select(*by, "seed", "route", *_short())


def listed_routes(seeds: DataFrame, steps: DataFrame, nodes: DataFrame, by: list[str], links: DataFrame | None = None,
                  max_hops: int = rules.MAX_HOPS) -> DataFrame:
    """``cut_routes`` of ``enumerate_paths``, searched without building paths.

    A branch carries the route, rules, amount and reach up to its last listed company as plain columns and moves them on when
    it meets the next one, so no array of steps is written, read or folded. ``steps`` and ``nodes`` are written tables.
    """
    text, number, weight = F.lit(""), F.lit(0.0), lookup(F.col("dst_tier"), rules.REACH_TIER_WEIGHT, 0.0)
    frontier = start(cut_lineage(seeds), by).drop("steps").select(
        "*", (F.col("level") * 2 + (F.col("shock") == "credit").cast("int")).alias("_sev"), text.alias("_way"), number.alias("_sum"),
        text.alias("route"), text.alias("rules"), text.alias("listed_seq"), number.alias("_amount"), number.alias("_reach"))
    carried = ["_sev", "_way", "_sum", "route", "rules", "listed_seq", "_amount", "_reach"]
    met, finished = F.col("dst").isNotNull() & F.col("dst_listed"), None
    for hop in range(1, max_hops + 1):
        grown = _joined(frontier, _options(frontier, steps, nodes, links, by).drop("basis", "evidence"), by, "left")
        grown = (grown.withColumns({"_way": F.when(F.col("dst").isNotNull(), F.concat("_way", F.lit("+"), "rule")).otherwise(F.col("_way")),
                                    "_sum": F.col("_sum") + F.coalesce("amount_wan", F.lit(0.0))})
                 .withColumns({"listed_seq": F.when(met, F.concat("listed_seq", F.lit(">"), "dst")).otherwise(F.col("listed_seq")),
                               "_reach": F.when(met, F.col("_reach") + weight).otherwise(F.col("_reach")),
                               **{to: F.when(met, F.col(c)).otherwise(F.col(to)) for to, c in (("route", "key"), ("rules", "_way"), ("_amount", "_sum"))}})
                 .select(*by, "seed", "shock", "node", "level", "visited", "key", "grouped", *carried, "dst", "rule", "dst_tier", "decision"))
        if hop < max_hops:
            grown = sorted_joins(cut_lineage(grown))
        done = grown.where(_ended(hop == max_hops) & (F.col("listed_seq") != "")).select(
            *by, "seed", *[F.substring(c, 2, 1 << 30).alias(c) for c in ("route", "listed_seq", "rules")], "_sev",
            (F.col("shock") == "credit").alias("_credit"), "_amount", "_reach")
        finished = done if finished is None else finished.unionByName(done)
        frontier = grown.where(~_ended(False)).select(*by, *_onward(*carried))
    return finished


def best_routes(routes: DataFrame, by: list[str]) -> DataFrame:
    """(by, seed, listed_seq, rules, route, score): the findings of ``summarize`` of cut routes, without their steps; rows are
    shuffled once, by seed and listed companies."""
    group = ["seed", "listed_seq", *by]                     # rows are sorted by their leading key
    per = routes.repartition(*group).groupBy(*group, "rules", "route").agg(*_best())
    per = per.withColumn("score", F.when(_scenario(), 0.0).otherwise(_scores()[2]))
    best = F.min(F.struct((-F.col("score")).alias("_s"), "rules", "route", "score")).alias("_b")
    return per.groupBy(*group).agg(best).select(*by, "seed", "listed_seq", "_b.rules", "_b.route", "_b.score")


def _scenario() -> Column:
    return F.array_contains(F.split("rules", r"\+"), "R4")


def scoring(routes: DataFrame) -> DataFrame:
    """Scenarios and routes that reach no weak or medium listed company score 0 and lose to any other."""
    return routes.where(~_scenario() & (F.col("_reach") > 0))


def scored_routes(paths: DataFrame, by: list[str]) -> DataFrame:
    """``best_routes`` with a score above 0, of paths at hand; what scores 0 is left out before rows are shuffled."""
    return best_routes(scoring(cut_routes(paths, by)), by).where("score > 0")


def summarize(paths: DataFrame, by: list[str], ranked: bool = False) -> tuple[DataFrame, DataFrame]:
    """Ranked findings and local reach.

    A path is cut after its last listed company; what lies beyond is folded into a count and an amount. Cut
    paths with the same listed companies in the same order are one finding with counted alternatives.

    All this is decided on short rows of numbers and names. The steps of a cut path follow from its seed, shock and route,
    so they meet the findings once, at the end. ``ranked`` adds ``rank``, the position of ``with_rank``.
    """
    cut = _cut(paths)
    kept = _kept(cut)
    keyed = [*by, "seed", "route"]
    short = kept.select(
        *keyed, *_short(),
        F.get("steps", F.col("_last"))["amount_wan"].alias("_beyond"), F.slice("steps", F.col("_last") + 1, rules.MAX_HOPS)["dst"].alias("_far"))
    # distinct far nodes are counted on rows, not in one collected set; a path's amount counts on its first row
    keyed = [*keyed, "listed_seq", "rules"]
    rows = short.select("*", F.posexplode_outer("_far").alias("_i", "_n")).drop("_far").repartition(*by, "seed", "route")
    most = lambda c: F.max(c).alias(c)
    per = rows.groupBy(*keyed, "_n").agg(*_best(), F.sum(F.when(F.coalesce("_i", F.lit(0)) == 0, F.coalesce("_beyond", F.lit(0.0))).otherwise(0.0)).alias("_b"))
    s = per.groupBy(*keyed).agg(most("_sev"), most("_reach"), most("_a1"), most("_a0"), F.round(F.sum("_b"), 4).alias("beyond_amount_wan"), F.count("_n").alias("beyond"))
    first, amount_yi, full = _scores()
    s = (s.withColumn("shock", F.when(first, "credit").otherwise("supply")).withColumn("amount_yi", F.round(amount_yi, 6)).withColumn("_full", full)
         .withColumn("scenario", _scenario())
         .withColumn("score", F.when(F.col("scenario"), 0.0).otherwise(F.col("_full")))
         .withColumn("scenario_score", F.when(F.col("scenario"), F.col("_full"))).withColumnRenamed("_reach", "listed_reach"))
    group = [*by, "seed", "listed_seq"]
    best = s.groupBy(*group).agg(
        F.min(F.struct((-F.col("score")).alias("_s"), "rules", "route", "shock", "score", "scenario", "scenario_score", "amount_yi",
                       "listed_reach", "beyond", "beyond_amount_wan")).alias("_b"),
        (F.count("*") - 1).alias("alternatives"),
        F.array_join(F.array_sort(F.collect_set("rules")), ",").alias("route_rules"))   # at most 84 rule strings exist
    best = best.select(*group, "_b.rules", "_b.route", "_b.shock", "_b.score", "_b.scenario", "_b.scenario_score", "_b.amount_yi",
                       "_b.listed_reach", "_b.beyond", "_b.beyond_amount_wan", "alternatives", "route_rules")
    one = [*by, "seed", "shock", "route"]
    if ranked:
        best = cut_lineage(best)                       # ranked and read again
        best = best.join(with_rank(best.select(*one, "score"), by).select(*one, "rank"), one)
    # equal paths up to the cut have equal steps: any of them stands for all
    findings = best.join(kept.select(*one, F.col("_head").alias("steps")), one).dropDuplicates(one)
    local = cut.where("_last = 0")
    parties = (local.select(*by, "seed", F.explode("steps").alias("s")).select(*by, "seed", "s.dst").distinct()
               .groupBy(*by, "seed").agg(F.count("*").alias("parties")))
    amounts = local.groupBy(*by, "seed").agg(F.round(F.sum(F.coalesce(F.col("steps")[0]["amount_wan"], F.lit(0.0))), 4).alias("amount_wan"))
    return findings, parties.join(amounts, [*by, "seed"])


def with_rank(findings: DataFrame, by: list[str]) -> DataFrame:
    """Position in the ranking of each graph: score descending, then seed and route."""
    keyed = findings.withColumn("_tie", F.concat_ws("|", "seed", "route"))
    return with_row_number(keyed, by, "score", "_tie", "rank", descending=True, tie_bucket=text_bucket(F.col("_tie"))).drop("_tie", "n")
