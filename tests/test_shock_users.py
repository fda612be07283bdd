"""End users of a product shock: each company keeps a row and a grade of its own."""
from collections import Counter
from datetime import date

from faultline.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_each_end_user_has_its_own_grade(spark):
    users = QUERIES["layered_shock_users"].run(spark, SF).collect()
    sectors = QUERIES["layered_shock_sectors"].run(spark, SF).collect()
    folded = QUERIES["layered_shock_companies"].run(spark, SF).where("company LIKE 'sector %'").collect()
    reached = {r.sector for r in sectors}
    customers = [c for c in spark.read.parquet(f"{SF}/customer.parquet").collect() if c.c_mktsegment in reached]
    days = {r.as_of for r in sectors}
    want = set()
    for c in customers:
        year = 1999 if c.c_acctbal > 9000 else 2002 if c.c_acctbal > 8000 else None
        want |= {(d, c.c_mktsegment, f"C{c.c_custkey}", "B" if year and date(year + 1, 4, 30) <= date.fromisoformat(str(d)) else "C") for d in days}
    assert len(users) == len(want) and {tuple(r) for r in users} == want
    assert len({(r.as_of, r.grade) for r in users}) > len(days)
    size, best = Counter((r.as_of, r.sector) for r in users), {}
    for r in users:
        best[r.as_of, r.sector] = min(r.grade, best.get((r.as_of, r.sector), r.grade))
    of = {(r.as_of, r.shock, f"sector {r.sector}"): (size[r.as_of, r.sector], best[r.as_of, r.sector]) for r in sectors}
    assert of == {(r.as_of, r.shock, r.company): (r.effects, r.grade) for r in folded}
