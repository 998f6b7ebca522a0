"""Searches that many queries ask for alike."""

from atrium.operators import search


def test_queries_that_ask_the_same_are_looked_up_once(spark):
    names = ("Gate A", "Gate B", "Ａ  gate", "Shop")
    rows = [("v", f"e{n}", "unit", "retail", float(n % 2), {"en": name}, {"en": "old"}) for n, name in enumerate(names)]
    entries = search.search_index(spark.createDataFrame(rows, "venue_id string, feature_id string, feature_type string, category string, ordinal double, labels map<string,string>, alt_labels map<string,string>")).persist()
    asks = [(" GATE a", "all", 0.0), ("old", "all", 1.0), ("", "gates", 1.0), ("shop", None, None), ("nothing", "all", 0.0), (None, "all", 0.0), ("", "other", None)]
    many = spark.createDataFrame([(n, "v", *asks[n % len(asks)]) for n in range(700)], "query_id long, venue_id string, text string, category string, level_ordinal double")
    found = search.search(entries, many)
    want = {0: [("e0", 520)], 1: [("e1", 470), ("e3", 470), ("e2", 450), ("e0", 450)], 3: [("e3", 500)], 6: [("e2", 0), ("e0", 0), ("e1", 0), ("e3", 0)]}
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.feature_id, r.score))
    assert got == {n: want[n % len(asks)] for n in range(700) if n % len(asks) in want}
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    pairs = next(n for n, line in enumerate(plan) if "Join Inner" in line and "feature_id" not in line and "_venue" not in line)
    assert any("Aggregate" in line for line in plan[pairs:pairs + 8])
