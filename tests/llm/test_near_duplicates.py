"""SimHash, its keys and components against brute force."""
import random
import re

import numpy as np
import xxhash

from feedloom.llm import simhash
from feedloom.llm.common import table
from feedloom.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def all_links(fps):
    fps = np.array(sorted(set(fps)), np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= 3):
            yield int(fps[i]), int(fps[i + 1 + j])


def signed(values):
    return np.array(values, np.uint64).view(np.int64)


def test_linked_fingerprints_share_a_key():
    rng = random.Random(0)
    x = [rng.getrandbits(64) for _ in range(1500)]
    y = [v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for v in x]
    keys = [[set() for _ in x], [set() for _ in x]]
    for side, values in zip(keys, (x, y)):
        for row, key in zip(*map(np.ndarray.tolist, simhash.fuzzy_keys(signed(values)))):
            side[row].add(key)
    assert all(a & b for a, b in zip(*keys))


def test_forest_spans_with_few_edges():
    rng = random.Random(5)
    fps = sorted({sum(1 << b for b in rng.sample(range(50, 64), rng.randrange(4))) for _ in range(300)})
    edges = [tuple(int(np.int64(v).view(np.uint64)) for v in e) for e in simhash.forest(signed(fps))]
    want = roots(fps, all_links(fps))
    assert roots(fps, edges) == want and len(edges) == len(fps) - len(set(want.values()))


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == roots({n for e in real for n in e}, real)


def check(docs):
    rows = docs.collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    root = roots(set(fps), all_links(fps))
    least = {}
    for r, f in zip(rows, fps):
        if r.doc_id is not None:
            least[root[f]] = min(r.doc_id, least.get(root[f], r.doc_id))
    want = sorted(((r.doc_id, f"{f:016x}", least.get(root[f])) for r, f in zip(rows, fps)), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == want
    return root, fps, rows


def test_near_duplicates(spark, sf, odd_docs, no_docs):
    check(table(spark, sf, "documents"))
    root, fps, _ = check(odd_docs)
    stays = simhash.one_of_each(odd_docs)
    assert stays.columns == odd_docs.columns
    assert sorted(root[plain_fingerprint(r.text)] for r in stays.collect()) == sorted(set(root.values()))
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.one_of_each(no_docs).count() == 0


def test_hot_keys_go_on_in_blocks(spark, monkeypatch):
    """Many fingerprints around one, so that keys are hot: components stay whole."""
    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(700)})
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "AT_ONCE", 50)
    df = spark.createDataFrame([(int(v),) for v in signed(fps)], "_fp long")
    found = [tuple(int(np.int64(v).view(np.uint64)) for v in r) for r in simhash.links(df, hot=40).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    assert roots(fps, found) == roots(fps, all_links(fps))
