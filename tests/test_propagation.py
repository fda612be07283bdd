"""Path search: each rule and stop decision, and a brute-force enumerator on random graphs."""
import random

import pytest
from pyspark.sql import functions as F

from faultline.plans import propagation as pg

EDGE = "g int, edge_type string, src_id string, dst_id string, amount_wan double, source_doc string, source_page int, evidence_text string, basis string"
NODE = "g int, node string, tier string, equity double, listed boolean, rated boolean, group_id string, industry string"
SEED = "g int, node string, shock string, severity string"


def search(spark, edges, nodes, seeds):
    e = spark.createDataFrame([(1, *x, "doc", 1, "text", "disclosed") for x in edges], EDGE)
    n = spark.createDataFrame([(1, *x) for x in nodes], NODE)
    s = spark.createDataFrame([(1, *x) for x in seeds], SEED)
    return pg.enumerate_paths(s, pg.typed_steps(e, ["g"]), n, ["g"])


def node(name, tier=None, equity=1e11, listed=True, group=None):
    return (name, tier, equity, listed, tier is not None, group, None)


def shape(paths):
    return {(r.seed, tuple((s.rule, s.dst, s.decision, s.severity) for s in r.steps)) for r in paths.collect()}


def test_guarantee_continues_and_strong_absorbs(spark):
    edges = [("guarantee", "A", "B", 280000.0)]
    assert shape(search(spark, edges, [node("A", "weak", 1e9), node("B", None)], [("B", "credit", "high")])) == {("B", (("R1", "A", "continue", "high"),))}
    assert shape(search(spark, edges, [node("A", "strong", 1e9), node("B", None)], [("B", "credit", "high")])) == {("B", (("R1", "A", "absorbed", "high"),))}


def test_proxy_of_a_parent_group_absorbs_or_continues(spark):
    """An unrated parent takes its members' tier in the search; without proxies it only weakens the path."""
    e = spark.createDataFrame([(1, "supply", "A", "P", None, "doc", 1, "t", "disclosed"), (1, "supply", "P", "B", None, "doc", 1, "t", "disclosed")], EDGE)
    base = spark.createDataFrame([(1, "A", "weak", 1e9, True, True, None, None), (1, "B", "weak", 1e9, True, True, None, None), (1, "P", None, None, False, False, None, None)], NODE)
    n = base.withColumn("proxy_of", F.when(F.col("node") == "P", "G"))
    seeds = spark.createDataFrame([(1, "A", "supply", "high")], SEED)
    for tier, want in (("strong", (("R2", "P", "absorbed", "high"),)), ("weak", (("R2", "P", "continue", "high"), ("R2", "B", "continue", "high"))), (None, (("R2", "P", "weakened", "high"), ("R2", "B", "continue", "medium")))):
        proxies = spark.createDataFrame([(1, "G", tier)] if tier else [], "g int, group_id string, proxy_tier string")
        nodes = pg.with_proxies(n, proxies, ["g"])
        assert shape(pg.enumerate_paths(seeds, pg.typed_steps(e, ["g"]), nodes, ["g"])) == {("A", want)}


def test_small_amount_stops(spark):
    got = shape(search(spark, [("guarantee", "A", "B", 100.0)], [node("A", "weak", 1e11), node("B", None)], [("B", "credit", "high")]))
    assert got == {("B", (("R1", "A", "immaterial", "high"),))}


def test_medium_tiers_weaken_then_end(spark):
    edges = [("supply", "A", "B", None), ("supply", "B", "C", None)]
    got = shape(search(spark, edges, [node(x, "medium") for x in "ABC"], [("A", "supply", "medium")]))
    assert got == {("A", (("R2", "B", "weakened", "medium"), ("R2", "C", "end", "low")))}


def test_three_steps_at_most(spark):
    names = [f"N{i}" for i in range(7)]
    edges = [("supply", a, b, None) for a, b in zip(names, names[1:])]
    rows = search(spark, edges, [node(x, "weak") for x in names], [("N0", "supply", "high")]).collect()
    assert [len(r.steps) for r in rows] == [3]


def test_tail_of_unlisted_nodes_is_folded(spark):
    edges = [("supply", "A", "B", 30000.0), ("supply", "B", "X", 20000.0), ("supply", "X", "Y", 10000.0)]
    nodes = [node("A", "weak"), node("B", "weak", 1e9), node("X", None, None, False), node("Y", None, None, False)]
    f = pg.summarize(search(spark, edges, nodes, [("A", "supply", "high")]), ["g"])[0].collect()
    assert [(r.route, r.beyond, r.beyond_amount_wan, r.amount_yi) for r in f] == [("R2:B", 2, 20000.0, 3.0)]
    assert f[0].score == pytest.approx(round(3 * (1 + 0.6020599913) * 1.0, 2))


def test_group_spread_once(spark):
    nodes = [node(x, "weak", 1e9, True, "G") for x in "ABC"]
    got = shape(search(spark, [("supply", "Z", "Q", 1.0)], nodes, [("A", "credit", "high")]))
    assert got == {("A", (("R3", "B", "continue", "high"),)), ("A", (("R3", "C", "continue", "high"),))}


def brute(edges, nodes, seeds):
    info = {n[0]: n for n in nodes}
    out = set()
    merged = {}
    for t, s, d, a in edges:
        ways = [(d, "credit", s, "R1")] if t == "guarantee" else [(s, "supply", d, "R2"), (d, "credit", s, "R2")]
        for src, shock, dst, rule in ways:
            k = (src, shock, dst, rule)
            merged[k] = merged.get(k, 0.0) + a

    def walk(n, shock, level, path, seen):
        opts = [(d, r, a) for (s, sh, d, r), a in merged.items() if s == n and sh == shock]
        if shock == "credit":
            opts += [(m[0], "R3", None) for m in nodes if m[0] != n and m[3] and m[5] and m[5] == info[n][5]]
        opts = [o for o in opts if o[0] not in seen and not (o[1] == "R3" and any(p[0] == "R3" for p in path))]
        if not opts or len(path) >= 3:
            if path:
                out.add((seen[0], shock, tuple(path)))
            return
        for d, r, a in opts:
            tier, eq = info[d][1] or "unknown", info[d][2]
            if a is not None and eq and eq > 0 and a * 1e4 / eq < 0.01:
                decision = "immaterial"
            elif tier == "strong":
                decision = "absorbed"
            elif tier != "weak" and level == 1:
                decision = "end"
            else:
                decision = "continue" if tier == "weak" else "weakened"
            step = path + [(r, d, decision, level)]
            if decision in ("immaterial", "absorbed", "end"):
                out.add((seen[0], shock, tuple(step)))
            else:
                walk(d, shock, level if tier == "weak" else level - 1, step, seen + [d])

    for n, shock, sev in seeds:
        walk(n, shock, {"low": 1, "medium": 2, "high": 3}[sev], [], [n])
    return out


@pytest.mark.parametrize("trial", range(3))
def test_against_brute_force(spark, trial):
    rng = random.Random(trial)
    names = [f"n{i}" for i in range(9)]
    nodes = [node(x, rng.choice(["weak", "medium", "strong", None]), rng.choice([1e8, 1e9, 1e11, None]), rng.random() < 0.7, rng.choice(["G1", "G2", None])) for x in names]
    edges = [(rng.choice(["guarantee", "supply", "service"]), *rng.sample(names, 2), float(rng.randrange(100, 90000))) for _ in range(25)]
    seeds = [(x, shock, rng.choice(["medium", "high"])) for x in rng.sample(names, 4) for shock in ("credit", "supply")]
    level = {"low": 1, "medium": 2, "high": 3}
    got = {(r.seed, r.shock, tuple((s.rule, s.dst, s.decision, level[s.severity]) for s in r.steps)) for r in search(spark, edges, nodes, seeds).collect()}
    assert got == brute(edges, nodes, seeds)
