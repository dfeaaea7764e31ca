import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import lexical
from feedloom.llm.common import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(docs, items, k=10):
    """(item id, rank, doc id, score) by the formula, over (id, text) pairs."""
    told = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    told = [(d, c, sum(c.values())) for d, c in told if c]
    big_n, big_l = len(told), sum(n for _, _, n in told)
    df = Counter(t for _, c, _ in told for t in c)
    out = []
    for item, text in items:
        wanted, scores = Counter(TERM.findall((text or "").translate(LOWER))), []
        for d, c, n in told:
            m = 25 + 75 * n * big_n // big_l
            s = sum(times * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                    for t, times in wanted.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d if d is not None else 0))
        out += [(item, r + 1, None if missing else d, -s) for r, (s, missing, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(docs, items, **kw):
    return sorted((tuple(r) for r in lexical.search(docs, items, **kw).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_equals_brute_force_on_the_tables(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(docs, items) == want


@pytest.mark.parametrize("seed", range(3))
def test_small_trees_batches_and_ties(spark, monkeypatch, seed):
    """Many portions, groups and batches; many documents of equal scores."""
    monkeypatch.setattr(lexical, "GROUP_BYTES", 60)
    monkeypatch.setattr(lexical, "BATCH_BYTES", 300 if seed else 8 << 20)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["née", "NÉE", "日本", "A1"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 12)))) for i in range(150)] + [(500 + i, "w1 w2 w3 w3") for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 9)))) for i in range(25)] + [(90, "w1, w1 W2; w3!")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert found(d, spark.createDataFrame(items, "item_id long, text string"), k=5, portion=40) == brute(docs, items, 5)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(1, "The née word"), (2, None), (3, ""), (4, "y" * 5000 + " zebra"), (None, "日本 x1"), (5, "unheard"), (1, "Zebra"), (6, "word " * 20_000 + "ab")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in items], "item_id int, text string, rank string, doc_id string")
    kept = [r for r in items if r != (1, "Zebra")]  # of one id the least text counts: "The" < "Zebra"
    assert found(odd_docs, df) == brute(docs, kept)
    assert found(no_docs, df) == [] and found(odd_docs, df.limit(0)) == [] and found(odd_docs.filter("text is null"), df) == []
    assert lexical.search(no_docs, df).dtypes == lexical.search(odd_docs, df).dtypes


def test_bounds_hold_and_prune():
    """Every node pair's bound is at least the scores below it, and most pairs are never scored."""
    rng = np.random.default_rng(1)

    def row(topic):
        t = np.unique(np.concatenate([rng.integers(topic * 50, topic * 50 + 50, 12), rng.integers(400, 410, 3)]))
        return t, np.where(t < 400, rng.integers(1, 1000, len(t)), rng.integers(1, 50, len(t)))

    docs, items = [row(i % 8) for i in range(600)], [row(i % 8) for i in range(40)]
    dense = np.zeros((2, 600, 410))
    for side, rows in enumerate((docs, items)):
        for i, (t, v) in enumerate(rows):
            dense[side, i, t] = v
    true = dense[1, :40] @ dense[0].T
    tree, root = lexical.DocTree(docs), lexical.item_tree(np.arange(40), items)
    walk = lexical.Walk(items, [root], np.ones(410, np.int64), np.ones(40, np.int64), 5)
    walk.tree = tree
    walk.column[tree.terms] = np.arange(len(tree.terms))
    todo, seen = [root], 0
    while todo:
        node = todo.pop()
        todo += node.children
        for level in range(len(tree.levels)):
            width = lexical.LEAF_DOCS * lexical.FAN ** level
            bound = walk.bounds(node, level, np.arange(len(tree.levels[level])))
            for j, b in enumerate(bound):
                seen += 1
                assert b >= true[np.ix_(node.items, tree.order[j * width:(j + 1) * width])].max()
    assert seen > 100 and sorted(tree.order) == list(range(600))
    walk = lexical.Walk(items, [root], np.ones(410, np.int64), np.ones(40, np.int64), 5)
    walk.portion(list(range(600)), docs, True)
    list(walk.found())
    again = lexical.Walk(items, [root], np.ones(410, np.int64), walk.least, 5)
    again.portion(list(range(600)), docs, False)
    got = {}
    for item, doc, score in again.found():
        got.setdefault(item, []).append((-score, doc))
    assert got == {i: sorted((-int(s), d) for d, s in enumerate(true[i]) if s > 0)[:5] for i in range(40)}
    assert again.scored < 0.5 * again.pairs
