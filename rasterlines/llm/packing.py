"""Best-fit packing of token pieces into fixed-length sequences, in bulk-synchronous rounds.

A document's ids (tokenizer's plus an end id) longer than ``capacity`` are cut
into full pieces, the first piece taking the remainder.  All pieces are
range-sorted once by falling length and numbered within their length.  Then
rounds follow:

1. Gaps (free room of open sequences) are grouped by size.  Sequences are
   numbered as they are opened, and gaps of one size are ranges of numbers.
2. Successor sweep: from long to short, the pieces of one length take the
   smallest gaps that hold them and that no longer piece took; a gap of g
   holds g // length of them, as best fit would put them there one by one.
   The sweep needs only how many pieces and gaps there are of each size: at
   most 2 * capacity counts, whatever the data's size.
3. Conflicts go by rank: a sweep's result says which numbers of a length go to
   which range of sequences.
4. Gaps shrink by what they took.  Pieces left over stay for the next round.

When nothing fits, as many of the longest pieces left open sequences of their
own as the pieces left would fill at least, and the rounds go on.

A round works on counts and ranges alone, so no row is read or moved for it:
what the rounds decide, a few rows for each length, is broadcast once, and all
pieces find sequence and place by their length and number in one join.

Null and empty texts are documents of the end id alone.  Repeated rows are
packed like any others; a null doc_id stays null.  Other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors
from .common import Scratch
from .tokenizing import piece_encoder, with_last

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches):
        encoder = piece_encoder(tokenizer)
        for batch in batches:
            raw, offsets = vectors.column_bytes(batch.column(1))
            doc_ids = batch.column(0).cast(pa.int64())
            for i, j in vectors.slices(offsets, 1 << 20):
                ids, at = with_last(*encoder.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), end_id)
                counts = np.diff(at)
                pieces = -(-counts // capacity)
                doc = np.repeat(np.arange(i, j), pieces)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = np.repeat(counts - (pieces - 1) * capacity, pieces)
                length = np.where(nth == 0, first, capacity)
                start = np.where(nth == 0, 0, first + (nth - 1) * capacity)
                whole = memoryview(ids.astype("<u4").tobytes())
                begin = np.repeat(at[:-1], pieces) + start
                crc = [zlib.crc32(whole[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(doc)), pa.array(nth.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        vectors.trim()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, _PIECES)


def number_within(df: DataFrame, size: str, scratch: Scratch, name: str, descending: bool) -> tuple[DataFrame, dict[int, int]]:
    """Adds ``nth``: 0, 1, ... within each value of ``size``, in the order of ``key``; also how many rows each size has.

    Range-sorts, numbers each partition's rows of a size as they pass, writes
    that, and adds how many rows of the size earlier partitions have: one count
    for each size and partition that meet, at most sizes + partitions of them.
    """
    order = [F.desc(size) if descending else F.asc(size), F.asc("key")]
    fields = df.schema.names
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)

    def number(batches):
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            sizes = batch.column(fields.index(size)).to_numpy()
            if not len(sizes):
                continue
            new = np.concatenate([[sizes[0] != last], sizes[1:] != sizes[:-1]])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(sizes)), -1))
            nth = np.arange(len(sizes)) - begin + np.where(begin < 0, n - 1, 0)
            last, n = sizes[-1], int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth), pa.array(np.full(len(sizes), part, np.int32))], [*fields, "nth", "part"])

    parts = scratch.keep(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{kinds}, nth bigint, part int"), name)
    before, seen = [], defaultdict(int)
    for r in sorted(parts.groupBy("part", size).count().collect(), key=lambda r: r.part):
        if seen[r[size]]:
            before.append((r.part, r[size], seen[r[size]]))
        seen[r[size]] += r["count"]
    offsets = df.sparkSession.createDataFrame(before, f"part int, {size} {df.schema[size].dataType.simpleString()}, before bigint")
    return parts.join(F.broadcast(offsets), ["part", size], "left").select(*fields, (F.col("nth") + F.coalesce("before", F.lit(0))).alias("nth")), dict(seen)


def sweep(lengths: dict[int, int], gaps: dict[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit of the longest first, each gap used by one length.

    Both arguments count by size.  Returns (length, first piece, pieces, gap,
    first gap, pieces a gap).
    """
    out = []
    open_gaps: list[list[int]] = []  # (size, first free) of gaps at least as large as the length at hand, smallest last
    sizes = sorted(gaps, reverse=True)
    k = 0
    for length in sorted(lengths, reverse=True):
        while k < len(sizes) and sizes[k] >= length:
            open_gaps.append([sizes[k], 0])
            k += 1
        done, left = 0, lengths[length]
        while left and open_gaps:
            size, at = open_gaps[-1]
            each = size // length
            take = min(left, (gaps[size] - at) * each)
            out.append((length, done, take, size, at, each))
            done, left = done + take, left - take
            at += -(-take // each)
            if at == gaps[size]:
                open_gaps.pop()
            else:
                open_gaps[-1][1] = at
    return out


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same numbers in rising order, ranges that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][1] == a:
            a = out.pop()[0]
        out.append((a, b))
    return out


def rounds(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go, given how many there are.

    Returns (length, low, high, first, each, offset): pieces low to high of a
    length fill the sequences from ``first`` on, ``each`` to a sequence, from
    ``offset`` there.
    """
    waiting, taken = dict(lengths), dict.fromkeys(lengths, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # by size: ranges of sequences, the last number excluded
    out, opened = [], 0
    while waiting:
        left = defaultdict(list)
        counts = {size: sum(b - a for a, b in ranges) for size, ranges in gaps.items()}
        plan = sweep(waiting, counts) if counts else []
        if plan:
            unused = {size: ranges[::-1] for size, ranges in gaps.items()}
            for length, done, m, size, _, each in plan:  # a size's gaps are taken in rising order
                low, high = taken[length] + done, taken[length] + done + m
                while low < high:
                    a, b = unused[size].pop()
                    n = min(high - low, (b - a) * each)
                    full, rest = divmod(n, each)
                    out.append((length, low, low + n, a, each, capacity - size))
                    if full:
                        left[size - each * length].append((a, a + full))
                    a += full
                    if rest:
                        left[size - rest * length].append((a, a + 1))
                        a += 1
                    if a < b:
                        unused[size].append((a, b))
                    low += n
            for size, ranges in unused.items():
                left[size] += ranges
        else:
            total = sum(n * m for n, m in waiting.items())
            need = max(-(-total // capacity), sum(m for n, m in waiting.items() if 2 * n > capacity))
            plan = []
            for n in sorted(waiting, reverse=True):
                m = min(need, waiting[n])
                if m:
                    plan.append((n, 0, m))
                    out.append((n, taken[n], taken[n] + m, opened, 1, 0))
                    left[capacity - n].append((opened, opened + m))
                opened, need = opened + m, need - m
            for size, ranges in gaps.items():
                left[size] += ranges
        for n, _, m, *_ in plan:
            taken[n] += m
            waiting[n] -= m
        waiting = {n: m for n, m in waiting.items() if m}
        # Only gaps that some piece may still fit are carried on.
        gaps = {size: _merged(ranges) for size, ranges in left.items() if ranges and size >= min(waiting, default=capacity + 1)}
    return out


def placed(pieces: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """``pieces`` with sequence_id and offset; it has key (bigint, unique) and length (bigint, 1 to capacity)."""
    numbered, lengths = number_within(pieces, "length", scratch, "sorted", descending=True)
    plan = pieces.sparkSession.createDataFrame(rounds(lengths, capacity), "_length bigint, _low bigint, _high bigint, _first bigint, _each bigint, _offset bigint")
    found = numbered.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (F.col("nth") >= F.col("_low")) & (F.col("nth") < F.col("_high")))
    nth = F.col("nth") - F.col("_low")
    return found.select(*pieces.columns, (F.col("_first") + F.expr("(nth - _low) div _each")).alias("sequence_id"), (F.col("_offset") + nth % F.col("_each") * F.col("length")).alias("offset"))


def best_fit(pieces: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """key, sequence_id, offset for each piece; ``pieces`` as in ``placed``."""
    return placed(pieces.select("key", "length"), capacity, scratch).select("key", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, scratch: Scratch) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row."""
    pieces = scratch.keep(token_pieces(docs, tokenizer, end_id, capacity).withColumn("key", F.monotonically_increasing_id()), "pieces")
    return placed(pieces, capacity, scratch).drop("key")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, 2048, Scratch(spark, "packing"))
