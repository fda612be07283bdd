"""Cleaning of capacity events: each rule fires and misses, values meet near misses in their context."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from faultline.plans import capacity as cp

RECORD = "struct<record_index:int,action:string,facility:string,product:string,capacity:double,unit:string,page:int,evidence:string>"
EVENTS = f"doc int, event_index int, event_type string, project_name string, records array<{RECORD}>"
PAGES = "doc int, page int, text string"


def rec(i, evidence, capacity=10.0, unit="万吨/年", action="new", product="p", page=1):
    return (i, action, None, product, capacity, unit, page, evidence)


def reasons(spark, kind, records, name="某项目", page="正文"):
    e = spark.createDataFrame([(1, 0, kind, name, records)], EVENTS)
    out = cp.suppressed(e, spark.createDataFrame([(1, 1, page)], PAGES)).first()
    return {x.record_index: x.action for x in out.log}, [r.record_index for r in out.records], out


CASES = [
    ("suspension", rec(0, "检修30天，影响产量10万吨"), {}, "move_temporary_loss_to_impact"),
    ("suspension", rec(0, "检修后淘汰，减少产量10万吨"), {}, None),
    ("capacity_construction", rec(0, "高炉"), {"name": "2024 年度投资计划"}, "remove_framework_item_capacity"),
    ("capacity_construction", rec(0, "高炉"), {"name": "投资计划说明会"}, None),
    ("termination", rec(0, "终止年产10万吨钢管项目"), {}, "remove_planned_capacity_of_adverse_project"),
    ("termination", rec(0, "终止年产20万吨钢管项目"), {}, None),
    ("termination", rec(0, "终止"), {"name": "年产 10 万吨轧钢"}, "remove_planned_capacity_of_adverse_project"),
    ("capacity_construction", rec(0, "年产10万吨钢管项目"), {}, None),
    ("termination", rec(0, "现有高炉10万吨", action="retired"), {}, "remove_existing_asset_background"),
    ("termination", rec(0, "关停现有高炉10万吨", action="retired"), {}, None),
    ("delay", rec(0, "完全达产后10万吨"), {}, "remove_hypothetical_adverse_capacity"),
    ("commissioning", rec(0, "完全达产后10万吨"), {}, None),
    ("commissioning", rec(0, "高炉", unit="m³"), {}, "remove_nonreplacement_equipment_spec"),
    ("capacity_replacement", rec(0, "高炉", unit="m³"), {}, None),
    ("capacity_construction", rec(0, "将形成年产10万吨"), {"page": "生产规模为 钢材 10 万吨/年"}, "remove_projected_product_breakdown"),
    ("capacity_construction", rec(0, "将形成年产10万吨"), {"page": "规模未定"}, None),
    ("capacity_construction", rec(0, "设备2台", unit="台"), {"page": "生产规模：10万吨/年"}, "remove_equipment_breakdown"),
    ("capacity_construction", rec(0, "新增产能2台", unit="台"), {"page": "生产规模：10万吨/年"}, None),
]


@pytest.mark.parametrize("kind, record, where, want", CASES)
def test_each_rule_fires_and_misses(spark, kind, record, where, want):
    log, kept, _ = reasons(spark, kind, [record], **where)
    assert log.get(0) == want and kept == ([] if want else [0])


def test_parts_of_a_total_within_one_percent(spark):
    parts = [rec(0, "合计", 100.0), rec(1, "其中：一期", 60.0), rec(2, "其中：二期", 40.9)]
    assert reasons(spark, "commissioning", parts)[0] == {1: "remove_capacity_breakdown", 2: "remove_capacity_breakdown"}
    assert reasons(spark, "commissioning", parts[:2] + [rec(2, "其中：二期", 41.1)])[0] == {}
    assert reasons(spark, "commissioning", parts[:2] + [rec(2, "其中：二期", 40.0, unit="吨/年")])[0] == {}
    assert reasons(spark, "commissioning", [rec(0, "合计", 60.0), rec(1, "其中：一期", 60.0)])[0] == {}


def test_upgrade_needs_two_words_and_loss_is_kept(spark):
    assert reasons(spark, "capacity_construction", [], page="实施大修和工艺改造")[2].event_type == "technical_upgrade"
    assert reasons(spark, "capacity_construction", [], page="实施大修")[2].event_type == "capacity_construction"
    loss = reasons(spark, "suspension", [rec(0, "停产 12 天", 3.0), rec(1, "停产5天", 4.0)])[2].loss
    assert (loss.amount, loss.unit, loss.days) == (3.0, "万吨", 12.0)


def test_sanitized(spark):
    rows = [rec(0, "a"), rec(1, "b", None), rec(2, "c", unit=None), rec(3, "d", unit=""), rec(4, "e", unit="万 元"), rec(5, "f", unit="元/吨"), rec(6, "g", unit="人民币亿元")]
    out = cp.sanitized(spark.createDataFrame([(1, 0, "x", None, rows)], EVENTS)).first()
    assert [r.record_index for r in out.records] == [0, 5]
    assert [(x.record_index, x.action.split("_")[1]) for x in out.log] == [(1, "incomplete"), (2, "incomplete"), (3, "incomplete"), (4, "monetary"), (6, "monetary")]


def test_merging_keeps_order_and_first_records(spark):
    a, b, c = rec(0, "a", 1.0), rec(0, "other evidence", 1.0), rec(1, "c", 2.0)
    e = spark.createDataFrame([
        (1, 0, "capacity_replacement", "X", [b, c]), (1, 1, "capacity_construction", "X", [a]), (1, 2, "capacity_replacement", "X", [c]), (1, 3, "capacity_replacement", "Y", [c]),
        (1, 4, "capacity_replacement", None, [a]), (2, 0, "commissioning", "p", [a]), (2, 1, "capacity_construction", "固定资产投资计划", []),
        (2, 2, "delay", "q", [c]), (2, 3, "capacity_construction", "年度投资计划", [a])], EVENTS)
    kept, log = cp.merged(e)
    assert {(r.doc, r.event_index): [x.evidence for x in r.records] for r in kept.collect()} == {
        (1, 1): ["a", "c"], (1, 3): ["c"], (1, 4): ["a"], (2, 1): [], (2, 2): ["c"]}
    assert sorted((r.doc, r.event_index, r.target) for r in log.collect()) == [(1, 0, 1), (1, 2, 1), (2, 0, 1), (2, 3, 1)]


@pytest.mark.parametrize("amount, unit, text, want", [
    (12000.0, "万元", "项目总投资12,000.00万元", (12000.0, "万元")),
    (12000.0, "万元", "项目总投资 1.2 亿元", (1.2, "亿元")),
    (12000.0, "万元", "项目总投资12,000.5万元", None),
    (12000.0, "万元", "项目总投资12,000万美元", None),
    (12000.0, "万元", "公司注册资本12000万元", None),
    (12000.0, "万元", "注册资本12000万元" + "甲" * 45 + "，建设投入12000万元", (12000.0, "万元")),
    (12000.0, "万元", "单位：万元 项目 12000 9000", (12000.0, "万元")),
    (12000.0, "万元", "单位：万元。项目 12000 9000", None),
    (8000.0, "万元", "投资（万元） 8,000.00  6,000.00", (8000.0, "万元")),
    (3.0, "万美元", "投资30000美元", (30000.0, "美元")),
])
def test_investment_in_context(spark, amount, unit, text, want):
    v = spark.createDataFrame([(1, 0, amount, unit)], "doc int, event_index int, amount double, unit string")
    r = cp.supported_investments(v, spark.createDataFrame([(1, 1, text), (1, 2, None), (2, 1, "12000万元")], PAGES)).first()
    assert (r.source_amount, r.source_unit) == (want or (None, None))


@pytest.mark.parametrize("day, text, want", [
    ("2024-03-05", "2024年3月5日正式投产", (True, True)), ("2024-03-05", "2024年03月05日 顺利投产", (True, True)),
    ("2024-03-05", "2024-03-05 投产后", (True, False)), ("2024-03-05", "预计2024年3月5日投产", (True, False)),
    ("2024-03-05", "2024年3月15日投产", (False, False)), ("2024-03-31", "2024年3月末完工", (True, False)), ("2024-02-29", "2024年2月底投产", (True, False)),
    ("2024-03-30", "2024年3月末完工", (False, False)), ("2024-03-05", "2024年3月5日高炉顺利出铁", (True, True)),
    ("2024-03-05", "2024年3月5日投产；预计年底全线建成投产", (True, False)), ("2024-03-05", "2024年3月5日全线投产；预计下月二期全线投产", (True, True)),
    ("2024-03-05", "2024年13月5日、2024年2月31日", (False, False)),
])
def test_dates_in_context(spark, day, text, want):
    v = spark.createDataFrame([(1, 0, dt.date.fromisoformat(day))], "doc int, event_index int, day date")
    r = cp.supported_dates(v, spark.createDataFrame([(1, 1, text), (1, 2, None)], PAGES)).first()
    assert (r.printed, r.commissioned) == want


def test_formal_capacity_is_recovered_once(spark):
    e = spark.createDataFrame([(1, 0, "capacity_construction", "a", [rec(0, "x", 5.0)]), (2, 0, "capacity_construction", "a", [rec(0, "x", 30.0)]),
                               (3, 0, "capacity_construction", "a", []), (3, 1, "delay", "b", []), (4, 0, "delay", "a", [])], EVENTS)
    p = spark.createDataFrame([(d, n, t) for d in range(1, 5) for n, t in ((2, "设计产能热卷1,030.5万吨/年"), (1, "新增产能：钢材30万吨/年"))], PAGES)
    out, log = cp.recovered_aggregate(e, p)
    assert [(r.doc, r.capacity, r.unit, r.page) for r in log.collect()] == [(1, 30.0, "万吨/年", 1)]
    added = out.where("doc = 1").first().records[-1]
    assert (added.facility, added.product, added.capacity, added.record_index) == ("钢材", "钢材产能", 30.0, None)


def test_thresholds_of_a_cited_rule(spark):
    m = spark.createDataFrame([(1, 1, "不高于 10mg"), (1, 2, "不高于10mg"), (1, 3, "10mg"), (1, 4, "不得超过10mg"), (1, 9, "不高于10mg")], "doc int, page int, evidence string")
    p = spark.createDataFrame([(1, 1, "根据《意见》要求，排放不高于\n10mg"), (1, 2, "排放不高于10mg，根据《意见》要求"), (1, 3, "根据《意见》要求10mg"),
                               (1, 4, "根据《意见》规定" + "甲" * 200 + "不得超过10mg")], PAGES)
    assert {r.page for r in cp.regulatory_thresholds(m, p).where("threshold").collect()} == {1}


def test_number_index_positions(spark):
    r = cp.number_index(spark.createDataFrame([(1, 1, "共 3 台, 1,200.5 万; 9"), (1, 2, ""), (1, 3, None), (1, 4, "无")], PAGES)).collect()
    assert [(x.page, x.pos, float(x.number), x.before, x.segment) for x in sorted(r, key=lambda x: x.pos)] == [
        (1, 1, 3.0, "共", "共3台,1,200.5万"), (1, 4, 1200.5, "共3台,", "共3台,1,200.5万"), (1, 13, 9.0, "共3台,1,200.5万;", "9")]


def test_greedy_pairs_follow_the_gold_order(spark):
    import random

    from faultline.plans import matching as mt

    r = random.Random(5)
    side = lambda n, lo: [(r.randrange(3), r.choice("ab"), i + lo, r.choice(["x", "y", "z", None]), r.choice([1, 2, None]), r.choice([1, 2, 3])) for i in range(n)]
    gold, pred = side(80, 0), side(70, 500)
    schema = "doc int, cat string, idx int, name string, f int, g int"
    got = mt.greedy_pairs(spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema), ["doc", "cat"], ["f", "g"], "name")
    want = set()
    for key in {(x[0], x[1]) for x in gold}:
        left = sorted(x for x in pred if x[:2] == key)
        left.sort(key=lambda x: x[2])
        for a in sorted((x for x in gold if x[:2] == key), key=lambda x: x[2]):
            if left:
                best = max(left, key=lambda b: 3 * (a[3] == b[3]) + (a[4] == b[4]) + (a[5] == b[5]))
                left.remove(best)
                want.add((*key, a[2], best[2]))
    assert {tuple(x) for x in got.collect()} == want


def test_new_paths_are_full_minus_base(spark):
    """Random graphs: the increment equals the search over all edges without what the base search had found."""
    import random

    from test_propagation import EDGE, NODE, SEED

    from faultline.plans import propagation as pg

    for seed in range(4):
        r = random.Random(seed)
        names = [f"N{i}" for i in range(9)]
        edge = lambda: (1, r.choice(["supply", "guarantee"]), *r.sample(names, 2), r.choice([None, 5e4, 2e5]), "d", 1, "t", "disclosed")
        old, new = [edge() for _ in range(14)], [edge() for _ in range(3)]
        nodes = spark.createDataFrame([(1, n, r.choice(["weak", "medium", "strong"]), 1e9, r.random() < 0.6, True, r.choice(["g1", "g2", None]), None) for n in names], NODE)
        known = spark.createDataFrame([(1, n, s, "high") for n in names[:4] for s in ("supply", "credit")], SEED)
        fresh = spark.createDataFrame([(1, names[5], "credit", "medium")], SEED)
        frame = lambda rows: pg.typed_steps(spark.createDataFrame(rows, EDGE), ["g"])
        shape = lambda df: {(x.seed, x.shock, tuple((s.rule, s.dst, s.decision, s.severity, s.amount_wan) for s in x.steps)) for x in df.collect()}
        opened = []
        base = shape(pg.enumerate_paths(known, frame(old), nodes, ["g"], frontiers=opened))
        full = shape(pg.enumerate_paths(known.unionByName(fresh), frame(old + new), nodes, ["g"]))
        rows = pg.new_paths(opened, fresh, frame(old), frame(new), nodes, ["g"])
        assert shape(rows) == full - base
        assert rows.count() == len(full - base)                      # none is made twice


def test_weakest_routes(spark):
    from faultline.operators.graph import weakest_routes

    e = spark.createDataFrame([(1, "a", "b", "A"), (1, "a", "c", "C"), (1, "b", "d", "B"), (1, "c", "d", "A"), (1, "d", "a", "A"), (1, "d", "e", "A"), (2, "a", "z", "C"), (1, "y", "b", "A")],
                              "g int, src string, dst string, grade string").withColumn("amount", F.lit(1.0))
    starts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "g int, node string")
    got = {(r.g, r.node): (r.start, r.depth, r.grade, r.middle) for r in weakest_routes(e, starts, ["g"]).collect()}
    assert got == {(1, "b"): ("a", 1, "A", []), (1, "c"): ("a", 1, "C", []), (1, "d"): ("a", 2, "B", ["b"]), (1, "e"): ("a", 3, "B", ["b", "d"]), (2, "z"): ("a", 1, "C", [])}
