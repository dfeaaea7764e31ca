"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint is cut into three segments, each decoded to its nearest Golay codewords: one or
six. Segments that differ in at most one bit share a codeword (see golay.py). With three
differing bits at most, either each segment has exactly one, and the triples of codewords meet;
or some segment has none, and of the other two one has at most one: its value and the other's
codeword meet. So a fingerprint has keys of two kinds, about fifty, and no link is lost. A key
holds 33 bits or more of the fingerprint, so few others meet by chance.

Only distinct fingerprints are keyed. Rows with one key are sorted together; links in them are
verified, and a spanning forest of them is kept, not all pairs. A key with very many
fingerprints goes on as pairs of blocks, which are tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from feedloom.llm.common import keep
from feedloom.llm.components import components
from feedloom.llm.golay import Golay

SHINGLE = 3
SEED = 42
BITS = 3  # differing bits that still link
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and bits
SMALL = 16  # fingerprints of a key whose links are all kept
HOT = 16_384  # fingerprints of a key that are compared in one task
BLOCK = 8192
AT_ONCE = 100_000  # shingles or rows


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits as a signed integer: those set in over half of the shingles' hashes."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z alone, ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start, n = end - length, max(1, len(words) - shingle + 1)
    stop = end[min(shingle, len(words)) - 1:]
    counts = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for k in range(0, n, AT_ONCE):
        spans = zip(start[k:min(n, k + AT_ONCE)].tolist(), stop[k:k + AT_ONCE].tolist())
        h = np.array([hashed(joined[a:b], SEED) for a, b in spans], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "_fp", columns: list[str] | None = None) -> DataFrame:
    """Adds the fingerprint as a long to ``columns`` (all by default). Map side only."""
    columns = columns if columns is not None else [c for c in docs.columns if c != out]

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = [fingerprint(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps, pa.int64())], names=[*batch.schema.names[1:], out])

    schema = StructType([docs.schema[c] for c in columns]).add(out, "long")
    return docs.select(F.col(text_col).cast("string").alias("_text"), *columns).mapInArrow(run, schema)


@lru_cache(maxsize=1)
def _golay() -> Golay:
    return Golay()


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and 64-bit keys: fingerprints at most three bits apart share a key."""
    golay, raw = _golay(), fps.view(np.uint64)
    parts = [(raw >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    near = [golay.nearest(p) for p in parts]
    parity = sum((np.bitwise_count(p) & 1).astype(np.int64) << i for i, p in enumerate(parts))
    parity = np.minimum(parity, 7 - parity)  # where each segment has one error, all parities differ
    (a, have_a), (b, have_b), (c, have_c) = near
    have = have_a[:, :, None, None] & have_b[:, None, :, None] & have_c[:, None, None, :]
    triple = a[:, :, None, None] << 24 | b[:, None, :, None] << 12 | c[:, None, None, :] | (parity << 36)[:, None, None, None]
    row = np.nonzero(have)[0]
    rows, keys = [row], [triple[have]]
    for i in range(3):
        for j in range(3):
            if i != j:
                codewords, there = near[j]
                rows.append(np.nonzero(there)[0])
                keys.append(((3 * i + j + 1) << 40 | parts[i][:, None] << 12 | codewords)[there])
    return np.concatenate(rows), np.concatenate(keys)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits. Of signed numbers numpy would count the absolute value's."""
    return np.bitwise_count((x ^ y).view(np.uint64))


def forest(fps: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Edges that span the components of distinct fingerprints linked at ``bits`` bits or fewer."""
    edges, waiting, rest = [], [], fps
    while len(rest) or waiting:
        if not waiting:
            waiting, rest = [rest[0]], rest[1:]
        here = waiting.pop()
        linked = _distance(rest, here) <= bits
        found = rest[linked]
        edges += [(int(here), int(x)) for x in found]
        waiting += list(found)
        rest = rest[~linked]
    return edges


def _small_links(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """All links within the groups of sorted keys."""
    found, at, step = [np.zeros((0, 2), np.int64)], np.arange(len(key)), 1
    while True:
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            return np.concatenate(found)
        linked = at[_distance(fp[at], fp[at + step]) <= BITS]
        found.append(np.column_stack([fp[linked], fp[linked + step]]))
        step += 1


def _links(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Links that keep every component whole, of complete groups of sorted keys."""
    if not len(key):
        return np.zeros((0, 2), np.int64)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    small = np.repeat(sizes <= SMALL, sizes)
    out = [_small_links(key[small], fp[small])]
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        out.append(np.array(forest(fp[s:s + n]), np.int64).reshape(-1, 2))
    return np.concatenate(out)


def _verify(hot: int | None):
    """Sorted rows (key, fp) to links (a, b); keys with over ``hot`` rows pass on, in blocks."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        none = np.zeros(0, np.int64)

        def rows(links=none.reshape(0, 2), key=none, block=none, fp=none):
            n, m = len(links), len(key)
            return pa.RecordBatch.from_arrays([
                pa.array(np.append(links[:, 0], np.zeros(m, np.int64)), mask=np.arange(n + m) >= n),
                pa.array(np.append(links[:, 1], np.zeros(m, np.int64)), mask=np.arange(n + m) >= n),
                pa.array(np.append(np.zeros(n, np.int64), key), mask=np.arange(n + m) < n),
                pa.array(np.append(np.zeros(n, np.int64), block), mask=np.arange(n + m) < n),
                pa.array(np.append(np.zeros(n, np.int64), fp), mask=np.arange(n + m) < n)], names=["a", "b", "key", "block", "fp"])

        held, size, passing, passed = [], 0, None, 0  # passing: the hot key whose rows pass on
        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            size += batch.num_rows
            if size < AT_ONCE:
                continue
            key, fp = (np.concatenate(x) for x in zip(*held))
            while len(key):
                if passing is not None:
                    n = int(np.searchsorted(key, passing, side="right"))
                    if n:
                        yield rows(key=key[:n], block=(passed + np.arange(n)) // BLOCK, fp=fp[:n])
                    passed += n
                    key, fp = key[n:], fp[n:]
                    if not len(key):
                        break
                    passing = None
                last = int(np.searchsorted(key, key[-1]))
                yield rows(_links(key[:last], fp[:last]))
                key, fp = key[last:], fp[last:]
                if hot is None or len(key) <= hot:
                    break
                passing, passed = key[0], 0
            held, size = [(key, fp)], len(key)
        if held:
            key, fp = (np.concatenate(x) for x in zip(*held))
            if passing is not None:
                n = int(np.searchsorted(key, passing, side="right"))
                yield rows(key=key[:n], block=(passed + np.arange(n)) // BLOCK, fp=fp[:n])
                key, fp = key[n:], fp[n:]
            yield rows(_links(key, fp))

    return run


_FOUND = "a long, b long, key long, block long, fp long"


def links(fps: DataFrame, fp_col: str = "_fp", hot: int = HOT) -> DataFrame:
    """Rows (a, b) whose graph has the components of all links between distinct fingerprints."""
    def key_rows(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, key = fuzzy_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    keyed = fps.select(fp_col).distinct().mapInArrow(key_rows, "key long, fp long")
    found = keep(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_verify(hot), _FOUND))
    passed = found.filter(F.col("key").isNotNull()).select("key", "block", "fp")
    out = found.filter(F.col("key").isNull()).select("a", "b").distinct()
    if passed.isEmpty():
        return out
    # Every pair of blocks of a hot key: a row goes to as many pairs as its key has blocks.
    last = passed.groupBy("key").agg(F.max("block").alias("last"))
    pairs = passed.join(last, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).select(
        F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "fp")
    rest = pairs.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_verify(None), _FOUND)
    return out.union(rest.select("a", "b")).distinct()


def classes(fps: DataFrame, fp_col: str = "_fp", hot: int = HOT) -> DataFrame:
    """One row for each distinct fingerprint: it, and the smallest (as a signed long) it reaches."""
    found = components(links(fps, fp_col, hot))
    return fps.select(F.col(fp_col).alias("_fp")).distinct().join(found.withColumnRenamed("node", "_fp"), "_fp", "left").select(
        "_fp", F.coalesce("root", "_fp").alias("_root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reached over links, the row's own included; null if all ids
    there are null. A text without words has the fingerprint zero and links like any other. Rows
    with equal texts, or repeated ids, are rows of their own; other columns are not read.
    """
    fps = keep(with_fingerprint(docs, text_col, columns=[id_col]))
    of = keep(classes(fps))
    # Ids meet their class by fingerprint; the smallest of a component is a minimum of minima.
    first = fps.groupBy("_fp").agg(F.min(id_col).alias("_first")).join(of, "_fp").groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = of.join(first, "_root").select("_fp", "component_id")
    return fps.join(named, "_fp").select(id_col, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id, all columns kept.

    Null ids come last. Of rows equal in id and fingerprint one stays. Everything is decided on
    narrow rows. Where ids tell all rows apart, as they mostly do, the texts are read twice and
    dealt once, for the rows that stay; else a row needs its fingerprint to be found again.
    """
    own, kept_id, kept_fp = "_fp", "_stays_id", "_stays_fp"
    while {own, kept_id, kept_fp} & set(docs.columns):
        own, kept_id, kept_fp = own + "_", kept_id + "_", kept_fp + "_"
    marked = with_fingerprint(docs, text_col, own)
    fps = keep(marked.select(id_col, F.col(own).alias("_fp")))
    order = F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), F.col("_fp").alias("fp"))
    least = fps.groupBy("_fp").agg(F.min(order).alias("x")).join(classes(fps), "_fp").groupBy("_root").agg(F.min("x").alias("x"))
    stays = least.select(F.col("x.id").alias(kept_id), F.col("x.fp").alias(kept_fp))
    repeated = fps.groupBy(id_col).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(id_col).isNull())
    if repeated.isEmpty():
        return docs.join(stays.select(kept_id), F.col(id_col) == F.col(kept_id), "left_semi")
    kept = marked.join(stays, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_fp)), "left_semi")
    return kept.dropDuplicates([id_col, own]).drop(own)
