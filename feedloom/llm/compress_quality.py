"""Quality score from compression with dictionaries of good and of bad labelled text.

A text resembles the class whose dictionary compresses it better. The bytes that the bad
dictionary costs over the good one, per byte of text, are calibrated on labelled texts that
neither dictionary has seen, together with the logarithm of the compressed share, which tells
mere repetition. Texts are compressed whole, in blocks, so that a dictionary weighs the same
at every place of a long text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 8192
DICT_BYTES = 112_640
FEW = 16  # bytes that temper both measures of short texts
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]  # of the difference, of the compressed share, constant


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned; a null id is not among them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _dictionary(texts: list[bytes]):
    import zstandard

    # In the order of their checksums: a long stretch of like texts would end the library's search.
    blocks = sorted((t[k:k + BLOCK] for t in texts for k in range(0, len(t), BLOCK)), key=lambda b: (zlib.crc32(b), b))
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: all of it serves
        return b"".join(blocks)[-DICT_BYTES:]


def _compressor(dictionary: bytes):
    import zstandard

    kind = zstandard.DICT_TYPE_AUTO if dictionary else zstandard.DICT_TYPE_RAWCONTENT
    held = zstandard.ZstdCompressionDict(dictionary or b"\0" * 8, dict_type=kind)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)


def _measures(texts: list[bytes], good, bad) -> np.ndarray:
    """Rows (difference per byte, logarithm of the share that the good dictionary leaves)."""
    out = np.zeros((len(texts), 2))
    for i, t in enumerate(texts):
        if not t:
            continue
        blocks = [t[k:k + BLOCK] for k in range(0, len(t), BLOCK)]
        a, b = (sum(len(c.compress(x)) for x in blocks) for c in (good, bad))
        out[i] = (b - a) / (len(t) + FEW), np.log((a + FEW) / (len(t) + FEW))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x, w = x / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def _sampled(raw: Column, key: Column, longest: int) -> Column:
    """The blocks of a text, or of a longer one those of the least hashes, in their order."""
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.octet_length(raw) / F.lit(BLOCK)).cast("int") - 1), lambda k: F.struct(
        F.xxhash64(key, k).alias("h"), k.alias("k")))
    some = F.sort_array(F.transform(F.slice(F.sort_array(blocks), 1, max(1, longest // BLOCK)), lambda b: b["k"]))
    chosen = F.when(F.octet_length(raw) <= longest, F.transform(blocks, lambda b: b["k"])).otherwise(some)
    return F.transform(chosen, lambda k: F.substring(raw, k * BLOCK + 1, F.lit(BLOCK)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", per_class: int = 1500, longest: int = BLOCK) -> Model:
    """Dictionaries and calibration from a bounded sample of the labelled rows.

    At most ``per_class`` ids of each class, the first by a hash, are broadcast to the documents.
    A text of more than ``longest`` bytes gives as many of its blocks as make that up, chosen by
    a hash from its whole length; so the sample is bounded, and no text is too long for it. An id
    with several rows or labels gives one, the text of the least checksum. Rows of ``held_out``
    are left out. Half of the sample makes the dictionaries, the other
    half the calibration, weighted to the classes' shares among all labelled rows.
    """
    labels = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(
        F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out("_id"))
    size = {r["_y"]: r["count"] for r in labels.groupBy("_y").count().collect()}  # two rows
    drawn = [labels.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    drawn = drawn[0].union(drawn[1]).dropDuplicates(["_id"])
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_raw"))
        .filter(F.octet_length("_raw") > 0)
        .join(F.broadcast(drawn), "_id")
        .select("_id", "_y", F.struct(F.crc32("_raw").alias("sum"), _sampled(F.col("_raw"), F.col("_id"), longest).alias("blocks")).alias("_t"))
        .groupBy("_id").agg(F.min(F.struct("_t.sum", "_y", "_t.blocks")).alias("_r"))
        .select("_id", "_r._y", "_r.blocks").collect()
    )
    rows.sort(key=lambda r: (zlib.crc32(str(r["_id"]).encode()), r["_id"]))
    drawn = [[r for r in rows if r["_y"] == y] for y in (0, 1)]
    texts = [[b"".join(map(bytes, r["blocks"])) for r in part] for part in drawn]
    if min(map(len, texts)) < 2:
        share = (size.get(1, 0) + 1) / (sum(size.values()) + 2)
        return Model(b"", b"", (0.0, 0.0, float(np.log(share / (1 - share)))))
    bad, good = (_dictionary(part[::2]) for part in texts)
    rest = [part[1::2] for part in texts]
    x = _measures(rest[0] + rest[1], _compressor(good), _compressor(bad))
    w = _logistic(x, np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])]))
    w[-1] += np.log(size[1] / size[0]) - np.log(len(rest[1]) / len(rest[0]))
    return Model(good, bad, tuple(map(float, w)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row for each row: id, held_out, score, predicted. Map side only.

    Null and empty texts measure (0, 0) and get the score of that. Repeated rows and null ids
    are kept; other columns are not read.
    """
    def run(batches) -> Iterator:
        import pyarrow as pa

        good, bad = _compressor(model.good), _compressor(model.bad)
        *w, constant = model.weights
        for batch in batches:
            x = _measures([(t or "").encode() for t in batch.column(1).to_pylist()], good, bad)
            p = 1 / (1 + np.exp(-np.clip(x @ np.array(w) + constant, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        good, bad = _compressor(model.good), _compressor(model.bad)
        *w, constant = model.weights
        for batch in batches:
            texts = batch.column(at).to_pylist()
            x = _measures([(t or "").encode() for t in texts], good, bad) @ np.array(w) + constant
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))) >= threshold))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)
