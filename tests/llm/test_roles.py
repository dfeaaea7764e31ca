"""Role repair against exhaustive search."""
import itertools
import random
from collections import defaultdict

import pytest

from feedloom.llm import roles
from feedloom.llm.common import table
from feedloom.llm.roles import ASSISTANT, INSERT, MERGE, RELABEL, ROLES, START, UNKNOWN


def cheapest(names):
    """Least cost over every role and merge choice for each turn, empty turns put where needed."""
    best = None
    for taken in itertools.product(range(3), repeat=len(names)):
        for merged in itertools.product((0, 1), repeat=len(names)):
            cost, state, ok = 0, START, True
            for name, role, merges in zip(names, taken, merged):
                cost += 0 if name == ROLES[role] else UNKNOWN if name is None else RELABEL
                if merges:
                    ok, cost = ok and state == role, cost + MERGE
                elif (state, role) in roles._BETWEEN:
                    cost += INSERT * len(roles._BETWEEN[state, role])
                else:
                    ok = False
                state = role
            cost += INSERT * len(roles._CLOSING[state])
            if ok and (best is None or cost < best):
                best = cost
    return best


def cost_of(rows):
    total = 0
    for r in rows:
        name = roles._normal(r.role)
        total += 0 if name == r.repaired_role else UNKNOWN if name is None else RELABEL
        total += MERGE * ("merge" in r.action) + INSERT * (len(r.inserted) + len(r.closing))
    return total


def legal(rendered):
    names = [line[len("<turn role="):-1] for line in rendered.split("\n") if line.startswith("<turn role=")]
    if names and names[0] == "system":
        names = names[1:]
    return len(names) >= 2 and len(names) % 2 == 0 and all(n == ("user", "assistant")[k % 2] for k, n in enumerate(names))


@pytest.fixture(scope="module")
def odd_turns(spark):
    rng = random.Random(11)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 5)):
            rows.append((c, t, rng.choice(["system", "user", "assistant", "User ", "tool", None]), f"text {c} {t}"))
    rows += [(None, 0, "user", "a"), (None, None, None, None), (500, None, "assistant", ""), (501, 0, "user", "same"), (501, 0, "user", "same"),
             (502, 1, "user", "long " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    return df.selectExpr("*", "'clash' as rendered", "'clash' as conv")


@pytest.mark.parametrize("run", [2048, 1, 2])
def test_repairs_cost_least_and_are_legal(spark, odd_turns, run):
    got = defaultdict(list)
    for r in roles.repair(odd_turns, run=run).collect():
        got[r.conv_id].append(r)
    want = defaultdict(list)
    for r in odd_turns.collect():
        want[r.conv_id].append(r)
    assert set(got) == set(want)
    for c, rows in got.items():
        rows.sort(key=lambda r: r.pos)
        assert [r.pos for r in rows] == list(range(len(want[c])))
        assert sorted((str(r.turn), str(r.role)) for r in rows) == sorted((str(r.turn), str(r.role)) for r in want[c])
        assert cost_of(rows) == cheapest([roles._normal(r.role) for r in rows])
        assert legal("".join(r.rendered for r in rows)), c
    assert roles.repair(odd_turns.limit(0)).count() == 0


def pieced(names, cuts):
    """Decisions when the conversation is solved in runs that end at the cuts."""
    at = [0, *cuts, len(names)]
    parts = [names[a:b] for a, b in zip(at, at[1:])]
    states = [START, *roles.borders([roles.matrix(p) for p in parts])]
    return [d for p, first, last in zip(parts, states, states[1:]) for d in roles.solve(p, first, last)]


def test_no_cut_changes_a_decision():
    """Costs are small whole numbers, so that most conversations have several cheapest repairs."""
    rng = random.Random(4)
    for _ in range(400):
        names = [rng.choice([*ROLES, None]) for _ in range(rng.randrange(2, 14))]
        whole = roles.solve(names, START, None)
        for cut in range(1, len(names)):
            assert pieced(names, [cut]) == whole, (names, cut)
        assert pieced(names, list(range(1, len(names)))) == whole
        some = sorted(rng.sample(range(1, len(names)), rng.randrange(1, len(names))))
        assert pieced(names, some) == whole
    assert pieced([None, "assistant", None, None, "assistant", None, "user"], [3]) == roles.solve(
        [None, "assistant", None, None, "assistant", None, "user"], START, None)


@pytest.mark.parametrize("partitions", [1, 5, 23])
def test_a_long_conversation_goes_over_many_runs(spark, partitions):
    """The same rows whether the turns are solved in one run or in many, in one task or in many."""
    rng = random.Random(6)
    rows = [(c, t, rng.choice([*ROLES, None]), f"t{t}") for c in range(3) for t in range((400, 3, 90)[c])]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    want = [x for c in range(3) for x in roles.solve([r for k, _, r, _ in rows if k == c], START, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        many = sorted(roles.repair(df, run=7).collect(), key=lambda r: (r.conv_id, r.pos))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [("merge" in r.action, ROLES.index(r.repaired_role)) for r in many] == want
    assert many == sorted(roles.repair(df.coalesce(1)).collect(), key=lambda r: (r.conv_id, r.pos))
    assert legal("".join(r.rendered for r in many if r.conv_id == 0))


def test_legal_conversations_stay_as_they_are(spark, sf):
    turns = table(spark, sf, "conversations")
    got = roles.repair(turns).collect()
    assert len(got) == turns.count()
    by = defaultdict(list)
    for r in got:
        by[r.conv_id].append(r)
    assert ASSISTANT == 2
    for rows in by.values():
        rows.sort(key=lambda r: r.pos)
        assert legal("".join(r.rendered for r in rows))
        names = [r.role for r in rows]
        body = names[1:] if names[0] == "system" else names
        if body and len(body) % 2 == 0 and body == ["user", "assistant"] * (len(body) // 2):
            assert all(r.action == "start" and not r.inserted and not r.closing for r in rows)
