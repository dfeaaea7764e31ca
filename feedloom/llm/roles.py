"""Role repair of conversations at minimum cost, by dynamic programming over legal turns.

A legal sequence is an optional system turn, then user and assistant turns that alternate, the
user's first and an assistant's last. Every input turn takes one action:

* keep its role, or take another one (``RELABEL``; ``UNKNOWN`` if its role is no legal one);
* start a turn, before which missing turns are put in empty (``INSERT`` each), or merge into the
  turn before it, of the role it takes (``MERGE``).

The least total cost wins; of equal ones that with the fewest resulting turns. Of these, the last
turn's role decides, in ``ROLES`` order, then whether the last turn starts or merges, then the
role of the turn before it, and so on towards the first turn.

The state after a turn is the role of the turn it is in, so a run of turns is a small matrix of
costs from state to state, with the order in which ties between states before it are settled, and
runs compose. A conversation is therefore solved in runs of bounded length: their matrices are
combined, which fixes the state at every border, and each run is then solved between its borders.
A conversation of any length is spread over many tasks, and no result depends on the cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from feedloom.llm.common import keep

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = 3, 0, 1, 2
STATES = 4
RELABEL, UNKNOWN, INSERT, MERGE = 4, 2, 3, 1
RUN = 2048  # turns
RUN_CHARS = 4_000_000
NEVER = np.int64(1) << 60
TURN = np.int64(1)  # the lesser part of a weight counts resulting turns
COST = np.int64(1) << 32

# Empty turns that come between two turns, by the state before and the role that starts.
_BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}


def _step(role: str | None) -> np.ndarray:
    """Weights of [merges or not, state before, role taken] for a turn of this role."""
    known = ROLES.index(role) if role in ROLES else None
    out = np.full((2, STATES, 3), NEVER)
    for taken in range(3):
        own = 0 if taken == known else UNKNOWN if known is None else RELABEL
        out[1, taken, taken] = (own + MERGE) * COST
        for before in range(STATES):
            if (before, taken) in _BETWEEN:
                n = len(_BETWEEN[before, taken])
                out[0, before, taken] = (own + n * INSERT) * COST + (n + 1) * TURN
    return out


_STEPS = {r: _step(r) for r in (*ROLES, None)}


def _normal(role: str | None) -> str | None:
    role = role.strip().lower() if role else None
    return role if role in ROLES else None


def matrix(roles: list[str | None]) -> np.ndarray:
    """[0]: least weight of a run from each state before it to each state after it. [1]: for each
    state after it, the place of each state before it in the order that settles ties.

    Paths to one state are told apart from their ends: by the last decision, else by the places
    of their first states at the turn before.
    """
    total, place = np.full((STATES, STATES), NEVER), np.zeros((STATES, STATES), np.int64)
    np.fill_diagonal(total, 0)
    start = np.arange(STATES)[:, None]
    for role in roles:
        weight = (total[:, None, :, None] + _STEPS[role][None]).reshape(STATES, 2 * STATES, 3)
        last = weight.argmin(axis=1)  # the first of equal decisions: start before merge, then the state before
        cost = np.minimum(weight.min(axis=1), NEVER)
        order = np.where(cost < NEVER, last * STATES + place[start, last % STATES], NEVER)
        total, place = np.full((STATES, STATES), NEVER), np.zeros((STATES, STATES), np.int64)
        total[:, :3] = cost
        place[:, :3] = order.argsort(axis=0, kind="stable").argsort(axis=0)
    return np.stack([total, place])


def solve(roles: list[str | None], first: int, last: int | None) -> list[tuple[bool, int]]:
    """(merges, role taken) of each turn, from a state to a state; last None: the end is free,
    and a user's or system's turn at the end costs the empty turns that must follow."""
    n = len(roles)
    best = np.full((n + 1, STATES), NEVER)
    best[0, first] = 0
    for i, role in enumerate(roles):
        best[i + 1, :3] = np.minimum((best[i][None, :, None] + _STEPS[role]).min(axis=(0, 1)), NEVER)
    state = int(np.argmin(best[n] + _ENDING)) if last is None else last
    out = []
    for i in range(n - 1, -1, -1):
        weight = best[i][None, :] + _STEPS[roles[i]][:, :, state]
        merges, before = np.unravel_index(int(np.argmin(weight)), weight.shape)
        out.append((bool(merges), state))
        state = int(before)
    return out[::-1]


# Empty turns that end a conversation, by its last state.
_CLOSING = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: (), START: ()}
_ENDING = np.array([len(_CLOSING[s]) * (INSERT * COST + TURN) for s in range(STATES)])


def borders(matrices: list[np.ndarray]) -> list[int]:
    """The states between and after runs, on a path of least weight from START to the end; ties
    are settled as in a run."""
    best = [np.full(STATES, NEVER)]
    best[0][START] = 0
    for cost, _ in matrices:
        best.append(np.minimum((best[-1][:, None] + cost).min(axis=0), NEVER))
    states = [int(np.argmin(best[-1] + _ENDING))]
    for k in range(len(matrices) - 1, 0, -1):
        (cost, place), after = matrices[k], states[-1]
        weight = best[k] + cost[:, after]
        states.append(int(np.where(weight == weight.min(), place[:, after], STATES).argmin()))
    return states[::-1]


_TURNS = "array<struct<turn:bigint,role:string,text:string>>"
_RUNS = f"conv string, part bigint, run bigint, whole boolean, cells array<bigint>, turns {_TURNS}"
_OUT = ("conv string, part bigint, run bigint, pos bigint, turn bigint, role string, repaired_role string, action string, "
        "inserted array<string>, closing array<string>, rendered string")


def _runs(most: int):
    """Sorted rows (conv, turn, role, text, part) to runs of up to ``most`` turns. Conversations
    at the edges of a partition, or of several runs, may go on elsewhere: their runs are not whole."""
    def runs(batches) -> Iterator:
        import pandas as pd

        def row(conv, part, run, whole, turns):
            cells = [] if whole else matrix([_normal(t["role"]) for t in turns]).ravel().tolist()
            return conv, part, run, whole, cells, turns

        def frame(rows):
            return pd.DataFrame(rows, columns=["conv", "part", "run", "whole", "cells", "turns"])

        conv, part, run, turns, chars, edge, out, size = None, None, 0, [], 0, True, [], 0
        for pdf in batches:
            for c, turn, role, text, p in zip(pdf["conv"], pdf["turn"], pdf["role"], pdf["text"], pdf["part"]):
                if turns and (c != conv or len(turns) >= most or chars >= RUN_CHARS):
                    over = c != conv
                    out.append(row(conv, part, run, over and not edge and run == 0, turns))
                    run, edge = (0, False) if over else (run + 1, edge)
                    size, turns, chars = size + chars, [], 0
                    if len(out) >= 500 or size >= RUN_CHARS:
                        yield frame(out)
                        out, size = [], 0
                conv, part = c, p
                turns.append({"turn": None if pd.isna(turn) else int(turn), "role": role, "text": text})
                chars += len(text or "") + 32
        if turns:
            out.append(row(conv, part, run, False, turns))
        if out:
            yield frame(out)

    return runs


def _rendered(conv, part, run, turns, first: int, last: int | None, begins: bool, ends: bool, template: str) -> Iterator[tuple]:
    """Rows of a run. The pieces of a conversation, end to end in order, are its rendering."""
    roles = [_normal(t["role"]) for t in turns]
    state = first
    for k, (t, (merges, taken)) in enumerate(zip(turns, solve(roles, first, last))):
        put = () if merges else _BETWEEN[state, taken]
        close = _CLOSING[taken] if ends and k == len(turns) - 1 else ()
        text = t["text"] or ""
        if merges:
            piece = "\n" + text
        else:
            piece = "" if begins and k == 0 else "</turn>\n"
            piece += "".join(template.format(role=ROLES[r]) + "</turn>\n" for r in put) + template.format(role=ROLES[taken]) + text
        if ends and k == len(turns) - 1:
            piece += "</turn>\n" + "".join(template.format(role=ROLES[r]) + "</turn>\n" for r in close)
        kept = "merge" if merges else "start"
        action = kept if roles[k] == ROLES[taken] else f"relabel+{kept}"
        yield (conv, part, run, k, t["turn"], t["role"], ROLES[taken], action, [ROLES[r] for r in put], [ROLES[r] for r in close], piece)
        state = taken


def _solved(template: str):
    def run(batches) -> Iterator:
        import pandas as pd

        columns = [c.split(" ")[0] for c in _OUT.split(", ")]
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                turns = list(r.turns)
                last = None if r.ends else int(r.last)
                rows += _rendered(r.conv, r.part, r.run, turns, int(r.first), last, bool(r.begins), bool(r.ends), template)
            yield pd.DataFrame(rows, columns=columns)

    return run


def _bordered(pdf):
    """One conversation's run matrices to the states around each run."""
    pdf = pdf.sort_values(["part", "run"])
    last = borders([np.array(c, np.int64).reshape(2, STATES, STATES) for c in pdf["cells"]])
    n = len(last)
    return pdf[["conv", "part", "run"]].assign(
        first=[START, *last[:-1]], last=last, begins=[k == 0 for k in range(n)], ends=[k == n - 1 for k in range(n)])


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           template: str = "<turn role={role}>\n", run: int = RUN) -> DataFrame:
    """One row for each input turn: conv_id, pos, turn, role, repaired_role, action, inserted
    (empty turns put before it), closing (empty turns put after the last), rendered.

    Turns are ordered by turn number, then role and text; nulls come first. ``pos`` numbers a
    conversation's rows from 0. The ``rendered`` pieces of a conversation, joined in order, are
    the repaired sequence. A null conversation id is a conversation of its own; a role that is
    null or unknown after trimming and lower-casing is free to become any; a null text is empty;
    repeated rows are turns of their own and merge. Other columns are not read.

    Rows are dealt once, by range of (conversation, turn), so that a long conversation lies in
    many partitions. A run's matrix has 32 numbers: only these meet in one task.
    """
    named = turns.select(
        F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("conv"), F.col("turn"), F.col("role"), F.xxhash64("text")]
    dealt = named.repartitionByRange(*order).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id().cast("bigint"))
    runs = keep(dealt.mapInPandas(_runs(run), _RUNS))
    open_ = runs.filter(~F.col("whole"))
    schema = "conv string, part bigint, run bigint, first int, last int, begins boolean, ends boolean"
    around = open_.select("conv", "part", "run", "cells").groupBy("conv").applyInPandas(_bordered, schema)
    whole = runs.filter("whole").select("conv", "part", "run", "turns", F.lit(START).alias("first"), F.lit(ASSISTANT).alias("last"),
                                        F.lit(True).alias("begins"), F.lit(True).alias("ends"))
    same = F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.run") == F.col("b.run"))
    parts = open_.alias("a").join(around.alias("b"), same).select("a.conv", "a.part", "a.run", "a.turns", "b.first", "b.last", "b.begins", "b.ends")
    out = whole.union(parts).mapInPandas(_solved(template), _OUT)
    # Positions go on over a conversation's runs: a prefix sum over one small row a run.
    from pyspark.sql import Window

    before = Window.partitionBy("conv").orderBy("part", "run").rowsBetween(Window.unboundedPreceding, -1)
    shift = open_.select("conv", "part", "run", F.size("turns").alias("n")).withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)))
    same = F.col("o.conv").eqNullSafe(F.col("s.conv")) & (F.col("o.part") == F.col("s.part")) & (F.col("o.run") == F.col("s.run"))
    kind = turns.schema[conv_col].dataType
    return out.alias("o").join(shift.alias("s"), same, "left").select(
        F.col("o.conv").cast(kind).alias(conv_col), (F.col("o.pos") + F.coalesce("s.shift", F.lit(0))).alias("pos"),
        "o.turn", "o.role", "repaired_role", "action", "inserted", "closing", "rendered")
