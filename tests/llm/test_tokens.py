"""Packing and byte-level BPE against the public libraries."""
import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from feedloom.llm import bpe, packing
from feedloom.llm.pieces import PATTERN, alike, character_kinds, cuts, split

ALPHABET = " \t\n\r\x0b\x1c\x85\xad\x00\x7f  　abcABC'sté中文😀0123٣!?.́ß"


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(1500)]
    return [*texts, "", "a" * 3000, "ab" * 2000, " " * 5000, "\n \n" * 300 + "x", "I'll don't 's'll '", "<|endoftext|>"]


@pytest.fixture(scope="module")
def exact():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_are_the_patterns_matches(odd_texts):
    assert PATTERN == P.PATTERN
    space = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    first = np.cumsum([0, *map(len, odd_texts)])
    joined = "".join(odd_texts)
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    at = split(joined, code, first, character_kinds()).tolist()
    got = [joined[a:b] for a, b in zip(at, [*at[1:], len(joined)])]
    assert got == [p for t in odd_texts for p in space.findall(t)]
    same = alike(code, np.array(at), np.diff([*at, len(joined)]))
    texts = defaultdict(set)
    for k, p in zip(same.tolist(), got):
        texts[k].add(p)
    assert all(len(x) == 1 for x in texts.values()) and len(texts) == len(set(got))


def test_long_texts_are_cut_between_pieces(exact):
    text = "some words don't end  here,\n" * 200
    parts = cuts(text, 100)
    assert len(parts) > 10 and "".join(parts) == text
    assert [i for p in parts for i in exact.encode_ordinary(p)] == exact.encode_ordinary(text)


def test_matrices_give_the_librarys_ids(odd_texts, exact):
    words, pieces = bpe._coder(None)
    for text, ids in zip(odd_texts, pieces.encode(odd_texts)):
        assert ids.tolist() == exact.encode_ordinary(text)
        assert words.decode(ids) == text.encode()


def test_tokenizer_pieces_give_whole_encodings(odd_texts):
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    odd_texts = [*odd_texts, "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", " <|endoftext|>\n\n  <|endoftext|>'s", "<|endoftext| >",
                 "<|<|endoftext|>|>", "x" * 50 + "<|endoftext|>" + "y " * 3000]
    for ids, e in zip(packing._tokenizer(None).encode(odd_texts), whole.encode_batch(odd_texts, add_special_tokens=False)):
        assert ids.tolist() == e.ids


def test_round_trip_rows(odd_docs, no_docs, exact):
    got = sorted(map(tuple, bpe.round_trip(odd_docs).collect()), key=str)
    want = []
    for r in odd_docs.select("doc_id", "text").collect():
        ids = exact.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode(bpe.encode(odd_docs))
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in back.collect()) == sorted(
        (str(r.doc_id), (r.text or "").encode()) for r in odd_docs.collect())
    assert bpe.round_trip(no_docs).count() == 0


def test_patterns_follow_the_plain_rule():
    """One item at a time: each goes to the shortest pack that takes it."""
    rng = random.Random(3)
    for _ in range(50):
        histogram = {rng.randrange(1, 33): rng.randrange(1, 9) for _ in range(rng.randrange(1, 12))}
        plain = []
        for n in sorted(histogram, reverse=True):
            for _ in range(histogram[n]):
                fit = [p for p in plain if 32 - sum(p) >= n]
                if fit:
                    min(fit, key=sum).append(n)
                else:
                    plain.append([n])
        got = packing.pack_histogram(histogram, 32)
        assert sorted(sum(p) for p in plain) == sorted(sum(p) for c, p in got for _ in range(c))
        used = defaultdict(int)
        for c, p in got:
            assert sum(p) <= 32
            for n in p:
                used[n] += c
        assert used == histogram


def test_every_id_lies_in_one_piece_of_one_sequence(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, capacity=64).collect()
    tokenizer = packing._tokenizer(None)
    docs = odd_docs.collect()
    want = defaultdict(int)
    for d, ids in zip(docs, tokenizer.encode([d.text or "" for d in docs])):
        ids = np.append(ids, 1).astype("<u4")
        for a in range(0, len(ids), 64):
            want[d.doc_id, a, len(ids[a:a + 64]), zlib.crc32(ids[a:a + 64].tobytes()), len(ids)] += 1
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    assert got == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(no_docs).count() == 0
