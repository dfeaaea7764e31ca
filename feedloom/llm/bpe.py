"""Byte-level BPE encoding and decoding with padded numpy matrices.

Pieces are bucketed by length and stand as rows of a padded matrix of byte ids. Each round,
every row finds its leftmost pair of least rank through a hash table of pairs, merges it and
is compacted; rows without a pair leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from feedloom.llm.pieces import Pieces, portions, spans

NONE = np.int64(1 << 40)  # rank of a pair that never merges
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, 64, 128, 256, 512)  # bytes of a piece, by bucket
WIDEST = WIDTHS[-1]  # longer pieces merge with a heap
CELLS = 1 << 21  # of one matrix


class PairTable:
    """Open addressing with linear probing; keys and merged ids in two arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int64)
        at, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            free = todo[self.keys[at[todo]] == -1]
            _, one = np.unique(at[free], return_index=True)  # one key for each free slot
            won = free[one]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the merged pair, NONE where there is none."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class Vocabulary:
    """Ranks of a ``.tiktoken`` file, as tables for encoding and decoding."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
        by_id = [b""] * (1 + max(self.ranks.values()))
        for token, i in self.ranks.items():
            by_id[i] = token
        self.token_bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.token_length = np.array([len(t) for t in by_id], np.int64)
        self.token_first = np.cumsum(self.token_length) - self.token_length
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {(self.ranks[t[:k]] << 32) | self.ranks[t[k:]]: i for t, i in self.ranks.items()
                 for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks}
        self.pairs = PairTable(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)))
        self.numerals = [str(i) for i in range(len(by_id))]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [p.encode() for p in pieces]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = np.fromiter((self.ranks.get(r, -1) for r in raw), np.int64, len(raw))
        open_ = whole < 0
        rows, ids, n = [np.flatnonzero(~open_)], [whole[~open_].astype(np.int32)], [np.ones(int((~open_).sum()), np.int64)]
        for i in np.flatnonzero(open_ & (length > WIDEST)).tolist():
            rows.append(np.array([i]))
            ids.append(self._merge_long(raw[i]))
            n.append(np.array([len(ids[-1])]))
        low = 0
        for width in WIDTHS:
            bucket = np.flatnonzero(open_ & (length > low) & (length <= width))
            low = width
            for part in np.array_split(bucket, -(-len(bucket) * width // CELLS)) if len(bucket) else []:
                rows.append(part)
                for kept, new in zip((ids, n), self._merge_rows(b"".join([raw[i] for i in part.tolist()]), length[part], width)):
                    kept.append(new)
        order, n = np.concatenate(rows), np.concatenate(n)
        first = np.cumsum(n) - n
        back = np.argsort(order)
        return spans(np.concatenate(ids), first[back], n[back]), n[back]

    def _merge_rows(self, raw: bytes, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of byte strings that stand end to end in ``raw``, all rows a merge a round."""
        rows = len(length)
        there = np.arange(width) < length[:, None]
        ids = np.full((rows, width), -1, np.int32)
        ids[there] = self.byte_ids[np.frombuffer(raw, np.uint8)]
        rank = np.full((rows, width), NONE, np.int64)  # of the pair that starts in a column
        row, col = np.nonzero(there[:, 1:])
        rank[row, col] = self.pairs.get(ids[row, col], ids[row, col + 1])
        live, out, count = np.arange(rows), np.full((rows, width), -1, np.int32), length.copy()
        while len(live):
            at = rank.argmin(axis=1)  # the first of equal ranks: leftmost
            best = rank[np.arange(len(live)), at]
            over = best == NONE
            if over.any():
                out[live[over], :ids.shape[1]] = ids[over]
                going = ~over
                live, ids, rank, at, best = live[going], ids[going], rank[going], at[going], best[going]
                if not len(live):
                    break
            # Compaction: what stands right of the merged pair moves one column to the left.
            rows, column = np.arange(len(live)), np.arange(ids.shape[1] - 1)
            ids[rows, at] = best
            ids = np.where(column > at[:, None], ids[:, 1:], ids[:, :-1])
            rank = np.where(column >= at[:, None], rank[:, 1:], rank[:, :-1])
            count[live] -= 1
            rank[rows, at] = NONE
            r = rows[at + 1 < count[live]]
            rank[r, at[r]] = self.pairs.get(ids[r, at[r]], ids[r, at[r] + 1])
            r = rows[at > 0]
            rank[r, at[r] - 1] = self.pairs.get(ids[r, at[r] - 1], ids[r, at[r]])
        return out[np.arange(width) < count[:, None]], count

    def _merge_long(self, raw: bytes) -> np.ndarray:
        """The same merges for one long piece: a heap of pairs over a linked list."""
        ids = self.byte_ids[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        first = self.pairs.get(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)

        def push(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                r = int(self.pairs.get(np.array([ids[i]]), np.array([ids[after[i]]]))[0])
                if r != NONE:
                    heapq.heappush(heap, (r, i, ids[i], ids[after[i]]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i])
            push(i)
        return np.array([x for x, there in zip(ids, alive) if there], np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return spans(self.token_bytes, self.token_first[ids], self.token_length[ids]).tobytes()


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=1)
def _coder(ranks_path: str | None) -> tuple[Vocabulary, Pieces]:
    """Built where the rows are, once a worker: the file is looked up on each executor."""
    words = Vocabulary(ranks_path or default_ranks())
    return words, Pieces(words.encode_pieces)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """One row (id, ids array<int>) for each row, whole texts; null text counts as empty.

    Repeated rows and null ids are kept, an empty text has an empty array, other columns are
    not read. Map side only: no shuffle. Every row goes through on its own, so a lost executor
    costs only its tasks.
    """
    def run(batches) -> Iterator:
        import pyarrow as pa

        coder = _coder(ranks_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            row = 0
            for part in portions(texts):
                ids = [*coder[1].encode(part)]
                ends = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(part)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))],
                    names=[id_col, "ids"])
                row += len(part)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """One row (id, bytes binary) for each row; null ids count as none."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        words = _coder(ranks_path)[0]
        for batch in batches:
            raw = [words.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=[id_col, "bytes"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """Encode and decode in one pass: number of ids, digest of the ids as decimals joined by a
    space, and digest of the decoded bytes. Rows as in ``encode``."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        words, pieces = _coder(ranks_path)
        for batch in batches:
            n, said, back = [], [], []
            for ids in pieces.encode([t or "" for t in batch.column(1).to_pylist()]):
                n.append(len(ids))
                said.append(hashlib.sha256(" ".join(map(words.numerals.__getitem__, ids.tolist())).encode()).hexdigest())
                back.append(hashlib.sha256(words.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
