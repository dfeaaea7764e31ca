import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from feedloom.llm import sharding
from feedloom.llm.hilbert import hilbert_index


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 1), (2, 5), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    at = hilbert_index(grid, bits)
    assert sorted(at.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def test_shards_are_equal_gapless_runs_of_the_curve(odd_docs, no_docs):
    rows = sharding.document_rows(odd_docs)
    got = sharding.shard(rows, ["source", "lang", "size"], 7, ["text_crc32", "size", "doc_id"]).collect()
    raw = {(r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect()}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == raw and len(got) == odd_docs.count()
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append((r.slot, r.curve))
    sizes = Counter(r.shard for r in got)
    assert sorted(sizes) == list(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    whole = [c for s in sorted(shards) for _, c in sorted(shards[s])]
    assert whole == sorted(whole)
    assert all([k for k, _ in sorted(x)] == list(range(len(x))) for x in shards.values())
    assert sharding.shard(sharding.document_rows(no_docs), ["size"], 7, ["doc_id"]).count() == 0


def test_manifest_prunes_on_every_column(spark):
    rows = spark.range(4096).selectExpr("id", "id % 64 as x", "cast(id / 64 as int) as y", "'c' || (id % 3) as z")
    ends = sharding.manifest(sharding.shard(rows, ["x", "y"], 16, ["id"]), ["x", "y"]).collect()
    for d in "xy":
        assert sum(r[f"min_{d}"] <= 5 <= r[f"max_{d}"] for r in ends) <= 8


def test_written_shards_hold_the_table(spark, tmp_path):
    rows = spark.range(300).selectExpr("id as doc_id", "repeat('t', cast(id % 7 as int)) as text", "'s' as source", "'en' as lang")
    placed = sharding.shard(sharding.document_rows(rows), ["size"], 4, ["doc_id"])
    sharding.write(rows, placed, "doc_id", f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == {(r.doc_id, r.shard, r.slot) for r in placed.collect()}


def test_equal_texts_are_parted_by_cuts_alone(spark):
    rows = [(i, f"text {i % 40}" if i % 3 else "hot", f"s{i % 7}", ("en", "de", None)[i % 3]) for i in range(600)] + [(None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    like = sharding.together(sharding.document_rows(docs), ["text_hash", "text_crc32", "size"], ["source", "lang"], ["doc_id"])
    assert like.count() == len(rows)
    placed = sharding.shard(like, ["like_source", "like_lang", "size"], 24, ["text_crc32", "text_hash", "doc_id"]).collect()
    groups = defaultdict(list)
    for r in placed:
        groups[r.text_crc32].append(r.shard)
    # Groups lie in runs of neighbouring shards, and there are 23 cuts.
    assert all(set(x) == set(range(min(x), max(x) + 1)) for x in groups.values())
    assert sum(max(x) - min(x) for x in groups.values()) <= 23
    # Cells anew: each group's are those of its least row.
    least = {}
    for i, t, s, lang in sorted((r for r in rows if r[0] is not None), reverse=True):
        least[zlib.crc32(t.encode())] = (s, lang)
    assert all((r.like_source, r.like_lang) == least[r.text_crc32] for r in placed if r.doc_id is not None)
    cells = np.array([[c.asDict()[d] for d in "abc"] for c in spark.createDataFrame(placed).select(
        *[x.alias(d) for x, d in zip(sharding.quantised(like, ["like_source", "like_lang", "size"]), "abc")], "curve").collect()])
    assert hilbert_index(cells, sharding.BITS).tolist() == [r.curve for r in placed]
