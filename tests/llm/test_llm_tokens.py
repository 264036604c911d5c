"""Token files and packing against the tokenizers library, text by text."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import AWKWARD, DATA, table
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rasterlines.llm import vectors
from rasterlines.llm.common import Scratch
from rasterlines.llm.packing import best_fit, pack_documents, rounds, sweep
from rasterlines.llm.token_files import decode_ranks, encode_ranks, read_token_files, write_token_files
from rasterlines.llm.tokenizing import ADD_PIECES, PieceEncoder, piece_encoder

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def plain(path, text, end):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)))
def test_variable_length_code_round_trip(values):
    control, data = encode_ranks(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert decode_ranks(control, data, len(values)).tolist() == values


TRICKY = st.text(st.sampled_from(list("aZ9 .,!?;:'\n\t-<|>é́İΣ  　\U0001f600中\x1c\x85")) | st.characters(exclude_categories=["Cs"]), max_size=60)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_piecewise_ids_are_those_of_the_whole_text(path):
    tokenizer = Tokenizer.from_file(path)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(TRICKY, max_size=4))
    def check(texts):
        raw, offsets = vectors.column_bytes(pa.array(texts, pa.string()))
        ids, at = piece_encoder(path).encode(raw, offsets)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    check()


@pytest.mark.parametrize("block_ids", [64, 1 << 17])
def test_token_files_round_trip(spark, block_ids):
    scratch = Scratch(spark, "t")
    write_token_files(table(spark, AWKWARD), scratch, WORD, 1, block_ids)
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, scratch.root).collect())
    assert sorted((str(d), n, c) for _, d, n, c in found) == sorted((str(d), len(x), crc(x)) for d, x in ((d, plain(WORD, t, 1)) for d, t in AWKWARD))
    at = 0
    for start, _, n, _ in found:
        assert start == at
        at += n
    ids = [d for _, d, _, _ in found]
    assert ids == sorted(ids, key=lambda d: -1 if d is None else d)


def test_empty_tables(spark):
    scratch = Scratch(spark, "t")
    write_token_files(table(spark, []), scratch, WORD, 1)
    assert read_token_files(spark, scratch.root).collect() == []
    assert pack_documents(table(spark, []), BYTE, 0, 2048, Scratch(spark, "p")).collect() == []


def packed_whole(rows, capacity):
    """Checks places and returns the number of sequences."""
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_whole_texts(spark):
    rows = pack_documents(table(spark, AWKWARD), BYTE, 0, 2048, Scratch(spark, "p")).collect()
    packed_whole(rows, 2048)
    want = []
    for doc_id, text in AWKWARD:
        ids = plain(BYTE, text, 0)
        first = len(ids) - (-(-len(ids) // 2048) - 1) * 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(str(doc_id), k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)


def decreasing(lengths, capacity):
    """Best fit of the longest first, one at a time: how many sequences."""
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        good = [g for g in gaps if g >= n]
        if good:
            gaps.remove(min(good))
            gaps.append(min(good) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(3))
def test_rounds_fill_about_as_well_as_one_at_a_time(spark, seed):
    rng = random.Random(seed)
    lengths = [[rng.randint(1, 100) for _ in range(300)], [34] * 100 + [33] * 50 + [1] * 30, [min(100, int(rng.paretovariate(0.8)) * 3) for _ in range(300)]][seed]
    df = spark.createDataFrame(list(enumerate(lengths)), "key bigint, length bigint")
    rows = best_fit(df, 100, Scratch(spark, "b")).join(df, "key").collect()
    assert len(rows) == len(lengths)
    assert packed_whole(rows, 100) <= 1.02 * decreasing(lengths, 100) + 1


def test_sweep_gives_each_gap_to_one_length():
    plan = sweep({7: 3, 3: 5}, {20: 1, 8: 1, 3: 2})
    assert plan == [(7, 0, 1, 8, 0, 1), (7, 1, 2, 20, 0, 2), (3, 0, 2, 3, 0, 1)]


def test_whole_table_is_packed_tightly(spark):
    docs = spark.read.parquet(str(DATA / "sf0.001/documents.parquet"))
    rows = pack_documents(docs, BYTE, 0, 2048, Scratch(spark, "p")).collect()
    assert packed_whole(rows, 2048) <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1


def test_rounds_move_no_rows(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(k, rng.randint(1, 100)) for k in range(400)], "key bigint, length bigint")
    scratch = Scratch(spark, "b")
    rows = best_fit(df, 100, scratch).join(df, "key").collect()
    assert len(rows) == 400 and packed_whole(rows, 100)
    assert [p.name for p in Path(scratch.root.removeprefix("file://")).iterdir()] == ["sorted"]


@given(st.lists(st.integers(1, 60), max_size=200), st.integers(60, 70))
def test_rounds_place_every_piece_once(lengths, capacity):
    seen, places = Counter(), {}
    for length, low, high, first, each, offset in rounds(dict(Counter(lengths)), capacity):
        for k in range(low, high):
            seen[length, k] += 1
            places.setdefault(first + (k - low) // each, []).append((offset + (k - low) % each * length, length))
    assert seen == Counter((n, k) for n, m in Counter(lengths).items() for k in range(m))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity


def test_new_pieces_are_encoded_few_at_a_time():
    encoder = PieceEncoder(BYTE)
    plain_tokenizer, sizes = encoder.tokenizer, []

    class Counting:
        def encode_batch(self, texts, add_special_tokens):
            sizes.append(len(texts))
            return plain_tokenizer.encode_batch(texts, add_special_tokens=add_special_tokens)

    encoder.tokenizer = Counting()
    text = " ".join(f"w{k}" for k in range(3 * ADD_PIECES))
    ids, _ = encoder.encode(*vectors.column_bytes(pa.array([text])))
    assert ids.tolist() == plain_tokenizer.encode(text, add_special_tokens=False).ids
    assert max(sizes) <= ADD_PIECES and sum(sizes) >= 3 * ADD_PIECES
