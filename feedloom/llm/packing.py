"""Token sequences packed by shortest-pack-first over the length histogram.

1. Documents become ids, each closed by an end id, and are cut into pieces of at most
   ``capacity`` ids. Whole pieces fill sequences alone; only remainders need packing.
2. The histogram of piece lengths (at most ``capacity`` numbers) goes to the driver. Lengths
   are placed longest first: each goes to the packs with the fewest ids that still take it,
   where packs of one pattern are only counted. A pattern changes with its count, so the work
   depends on the number of lengths, not of documents.
3. Every pattern owns a run of sequence numbers; the places for a length, taken pattern by
   pattern, are met with the pieces of that length by rank. Ranks come from one range
   partitioning of narrow rows, which spreads a length however many pieces have it.
"""

from __future__ import annotations

import re
import zlib
from bisect import insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from feedloom.llm.common import keep, ranked
from feedloom.llm.pieces import PATTERN, Pieces

CAPACITY = 2048
END_ID = 1


class Encoder:
    """Ids as the tokenizer gives them: the texts are cut at its added tokens, which have ids of
    their own wherever they stand, and what lies between is encoded piece by piece."""

    def __init__(self, pieces: Pieces, added: dict[str, int]) -> None:
        self.pieces, self.added = pieces, added
        # At one place the longest added token counts.
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        held = [self.cut is not None and any(t in text for t in self.added) for text in texts]
        if not any(held):
            yield from self.pieces.encode(texts)
            return
        parts = [self.cut.split(text) if has else [text] for text, has in zip(texts, held)]  # every second one is a token
        plain = iter(list(self.pieces.encode([p for x in parts for p in x[::2]])))
        for x in parts:
            yield np.concatenate([next(plain) if k % 2 == 0 else np.array([self.added[p]], np.int32) for k, p in enumerate(x)])


@lru_cache(maxsize=1)
def _tokenizer(path: str | None) -> Encoder:
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    if "ByteLevel(add_prefix_space=False" not in repr(tokenizer.pre_tokenizer) or public_tokenizers.PATTERN != PATTERN:
        raise ValueError("only byte-level tokenizers that split by the stated pattern are supported")
    added = tokenizer.get_added_tokens_decoder()
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized and tokenizer.normalizer is not None for t in added.values()):
        raise ValueError("only added tokens that stand for themselves alone are supported")
    letters = _byte_letters()
    tokenize, letter = tokenizer.model.tokenize, np.array([letters.get(b, b) for b in range(256)], "<u4")

    def encode_new(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # All bytes to letters at once. A piece is one word to the model, which needs none of the
        # offsets of a whole encoding.
        raw = [p.encode() for p in pieces]
        text = letter[np.frombuffer(b"".join(raw), np.uint8)].tobytes().decode("utf-32-le")
        ids, length, a = [], [], 0
        for b in accumulate(map(len, raw)):
            got = tokenize(text[a:b])
            length.append(len(got))
            ids += [t.id for t in got]
            a = b
        return np.array(ids, np.int32), np.array(length, np.int64)

    return Encoder(Pieces(encode_new), {t.content: i for i, t in added.items()})


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: bytes that print stand
    for themselves, the others, in order, for the letters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(rest)}


def cut(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
        tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: id, start, length, ids_crc32, doc_tokens (and ids)."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        encode = _tokenizer(tokenizer_path).encode
        for batch in batches:
            row, start, length, crc, total, kept = [], [], [], [], [], []
            for k, ids in enumerate(encode([t or "" for t in batch.column(1).to_pylist()])):
                ids = np.append(ids, end_id).astype("<u4")
                for a in range(0, len(ids), capacity):
                    part = ids[a:a + capacity]
                    row.append(k)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
                    if with_ids:
                        kept.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns as (number of packs, their lengths in order), for lengths of 1 to ``capacity``.

    Every step either moves all packs of a pattern on or uses up the length at hand, so there
    are at most three new patterns a length.
    """
    packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by free room
    rooms: list[int] = []  # with packs, ascending

    def put(room: int, count: int, pattern: tuple[int, ...]) -> None:
        if count:
            if not packs[room]:
                insort(rooms, room)
            packs[room].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and rooms and rooms[-1] >= length:  # the most room: the shortest pack
            room = rooms[-1]
            count, pattern = packs[room].pop()
            if not packs[room]:
                rooms.pop()
            took = min(count, left)
            left -= took
            put(room, count - took, pattern)
            put(room - length, took, (*pattern, length))
        # None takes it: a new pack is the shortest until it is full, then comes another.
        each = capacity // length
        put(capacity - each * length, left // each, (length,) * each)
        if rest := left % each:
            put(capacity - rest * length, 1, (length,) * rest)
    return [p for room in rooms for p in packs[room]]


def _places(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), ordered, one for each place of a pattern."""
    rows, used, sequence = [], defaultdict(int), 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have a length from 1 to ``capacity``.

    Offsets in a sequence are gapless from 0. Equal rows each get a place of their own; an
    empty table stays empty. Columns of those two names in the input are replaced.
    """
    pieces = keep(pieces.drop("sequence_id", "offset"))
    histogram = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}  # capacity rows at most
    if bad := [n for n in histogram if n is None or not 0 < n <= capacity]:
        raise ValueError(f"lengths outside 1 to {capacity}: {bad[:5]}")
    places = _places(pack_histogram(histogram, capacity))
    before, first = 0, {}
    for n in sorted(histogram):
        first[n] = before
        before += histogram[n]
    first_rank = np.array([first.get(n, 0) for n in range(capacity + 1)], np.int64)
    key = places[:, 0] << 44 | places[:, 1]

    def place(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(1).to_numpy(zero_copy_only=False) - first_rank[n]
            row = places[np.searchsorted(key, n << 44 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])],
                names=[*batch.schema.names[2:], "sequence_id", "offset"])

    schema = StructType([*pieces.schema.fields]).add("sequence_id", "long").add("offset", "long")
    ranks = ranked(pieces, [F.col(length_col), *map(F.col, order)], "_rank")
    return ranks.select(F.col(length_col).alias("_length"), "_rank", *pieces.columns).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer_path: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Null and repeated ids are kept: each row is a
    document. Other columns are not read. Texts of any length are encoded in portions.
    """
    return pack(cut(docs, capacity, end_id, tokenizer_path=tokenizer_path), capacity)
