"""Tree sums and unwrapping against a plain walk, on random trees with pruned nodes."""
import random

from pyspark.sql import functions as F

from feedloom.operators import dom
from feedloom.plans import extract_job


def tree(rng, page, n):
    """Rows (page_id, pre, last, parent, path, tag, attrs, text) of a random tree."""
    parent = [-1] + [rng.randrange(max(0, i - 4), i) for i in range(1, n)]
    order, children = [], {i: [j for j in range(n) if parent[j] == i] for i in range(-1, n)}

    def visit(i, path):
        at = len(order)
        order.append(None)
        for j in children[i]:
            visit(j, [*path, at])
        order[at] = (page, at, len(order) - 1, path[-1] if path else -1, path, rng.choice(["div", "b", "x-y"]), {}, None)

    for i in children[-1]:
        visit(i, [])
    return order


def nodes(spark, seed):
    rng = random.Random(seed)
    rows = [r for p in ("1", "2", "3") for r in tree(rng, p, rng.randrange(1, 40))]
    gone = {(r[0], r[1]) for r in rows if not r[4] is None and r[1] == r[2] and rng.random() < 0.3 and r[1]}  # leaves pruned before
    rows = [r for r in rows if (r[0], r[1]) not in gone]
    df = spark.createDataFrame(rows, "page_id string, pre int, last int, parent int, path array<int>, tag string, attrs map<string,string>, text string")
    return rows, df


def test_subtree_and_near_sums(spark):
    for seed in range(3):
        rows, df = nodes(spark, seed)
        got = {(r.page_id, r.pre): r for r in dom.near_sums(dom.subtree_sums(df, {"v": F.col("pre") + 1}), F.col("pre") + 1, ("one", "two")).collect()}
        assert len(got) == len(rows)
        for p, pre, last, _, _, *_ in rows:
            below = [r for r in rows if r[0] == p]
            assert got[p, pre].v == sum(r[1] + 1 for r in below if pre <= r[1] <= last)
            assert got[p, pre].one == (sum(r[1] + 1 for r in below if r[4][-1:] == [pre]) or None)
            assert got[p, pre].two == (sum(r[1] + 1 for r in below if r[4][-2:-1] == [pre]) or None)


def test_unwrap(spark):
    rows, df = nodes(spark, 9)
    gone = {(r[0], r[1]) for r in rows if r[5] == "x-y"}
    got = {(r.page_id, r.pre): (r.path, r.parent) for r in dom.unwrap(df, F.col("tag") == "x-y").collect()}
    want = {}
    for r in rows:
        if (r[0], r[1]) not in gone:
            path = [a for a in r[4] if (r[0], a) not in gone]
            want[r[0], r[1]] = (path, path[-1] if path else -1)
    assert got == want


def test_look_ahead(spark):
    for seed in range(3):
        rows, df = nodes(spark, seed)
        d = dom.with_contains(df, {"holds": F.col("tag") == "b"})
        d = dom.with_first_within(d, {"first": (F.col("tag") == "b", F.col("pre") * 2)})
        got = {(r.page_id, r.pre): (r.holds, r.first) for r in d.collect()}
        for p, pre, last, *_ in rows:
            below = sorted(r[1] for r in rows if r[0] == p and pre < r[1] <= last and r[5] == "b")
            assert got[p, pre] == (bool(below), below[0] * 2 if below else None)


def test_subtree_sums_of_chosen_nodes(spark):
    rows, df = nodes(spark, 4)
    got = {(r.page_id, r.pre): r.v for r in dom.subtree_sums(df, {"v": F.col("pre") + 1}, F.col("tag") == "b").collect()}
    for p, pre, last, _, _, tag, *_ in rows:
        assert got[p, pre] == (sum(r[1] + 1 for r in rows if r[0] == p and pre <= r[1] <= last) if tag == "b" else None)


def test_rules_go_over_the_parsed_pages_once(spark):
    pages = spark.createDataFrame([("1", "https://a.example.com/x", "<p>text</p>")], "page_id string, page_url string, html string")
    for clean in (extract_job.clean_standard, extract_job.clean_full):
        plan = clean(pages)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1
        assert "unboundedfollowing" not in plan.replace("unboundedpreceding$(), unboundedfollowing", "")
