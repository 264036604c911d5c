"""Token ids as binary files: frequency-ranked ids in byte-aligned variable-length code.

File format, two Parquet tables below one folder:

``vocabulary``  one row; ``ids[r]`` is the id of frequency rank r (most
    frequent first, ties by id).
``blocks``      the id stream in ascending doc_id order, cut at documents.
    ``file`` and ``block`` give the order.  A block's ids are replaced by
    ranks; rank v takes 1 to 4 little-endian bytes in ``data``, and ``control``
    holds the byte counts less one, two bits a value, four values a byte,
    lowest bits first.  ``doc_ids`` and ``lengths`` list its documents,
    ``before`` the ids of earlier blocks of the file.

Common ids have small ranks, so most take one byte.  Control bytes are apart
from data bytes: a reader turns each control byte into four lengths by one
table lookup, sums them to positions and gathers all values at once.

Null and empty texts give documents of the end id alone.  A null doc_id sorts
first.  Rows with equal doc_id are kept, ordered by their number of ids, then
by a hash of them.  Other columns
are ignored.  An empty table gives empty files.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors
from .common import Scratch
from .tokenizing import piece_encoder, with_last

#: Ids of a block at least, unless a file ends.
BLOCK_IDS = 1 << 17

_IDS = "doc_id bigint, n_tokens bigint, ids binary"
_BLOCKS = "file int, block int, before bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, control binary, data binary"

#: Byte counts of the four values that a control byte describes.
_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of values below 2**32."""
    v = ranks.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    used = np.arange(4, dtype=np.uint8) < size[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids of one document for the way between two jobs: byte planes, compressed."""
    planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack_ids(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed, max_output_size=4 * n + 1), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


def token_ids(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, packed ids (with the end id) of each row."""

    def encode(batches):
        encoder = piece_encoder(tokenizer)
        for batch in batches:
            raw, offsets = vectors.column_bytes(batch.column(1))
            for i, j in vectors.slices(offsets, 1 << 20):
                ids, at = with_last(*encoder.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), end_id)
                packed = [pack_ids(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(np.diff(at)), pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(encode, _IDS)


def id_counts(tokens: DataFrame) -> DataFrame:
    """id, n over all rows; each task sends every id once."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.bincount(unpack_ids(packed, n))
                if len(found) > len(total):
                    found, total = total, found
                total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    return tokens.select("n_tokens", "ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Writes ``vocabulary`` and ``blocks`` below ``scratch.root``."""
    spark = docs.sparkSession
    tokens = scratch.keep(token_ids(docs, tokenizer, end_id), "tokens")
    # At most one row for each id of the vocabulary.
    ranked = [r.id for r in id_counts(tokens).orderBy(F.desc("n"), "id").collect()]
    scratch.keep(spark.createDataFrame([(ranked,)], "ids array<bigint>"), "vocabulary")
    rank_of = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked))
    shared = spark.sparkContext.broadcast(rank_of)

    def encode(batches):
        rank_of, file = shared.value, TaskContext.get().partitionId()
        held, doc_ids, block, before, size = [], [], 0, 0, 0

        def flush():
            ranks = rank_of[np.concatenate(held)]
            control, data = encode_ranks(ranks)
            lengths = [len(x) for x in held]
            columns = [[file], [block], [before], [len(ranks)], [doc_ids], [lengths], [control], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "before", "n_ids", "doc_ids", "lengths", "control", "data"])

        for batch in batches:
            for doc_id, n, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(unpack_ids(packed, n))
                doc_ids.append(doc_id)
                size += n
                if size >= block_ids:
                    yield flush()
                    held, doc_ids, block, before, size = [], [], block + 1, before + size, 0
        if held:
            yield flush()

    blocks = tokens.withColumn("hash", F.xxhash64("ids")).repartitionByRange("doc_id", "n_tokens", "hash").sortWithinPartitions("doc_id", "n_tokens", "hash", "ids").drop("hash").mapInArrow(encode, _BLOCKS)
    scratch.keep(blocks, "blocks", "uncompressed")
    scratch.drop("tokens")


def read_token_files(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files.

    Decodes all blocks; ``start`` counts the ids of all documents before it.
    """
    blocks = spark.read.parquet(f"{root}/blocks")
    # One row a file: how many ids come before it.
    sizes = sorted((r.file, r.n) for r in blocks.groupBy("file").agg(F.sum("n_ids").alias("n")).collect())
    base, total = {}, 0
    for file, n in sizes:
        base[file] = total
        total += n
    vocabulary = spark.sparkContext.broadcast(np.array(spark.read.parquet(f"{root}/vocabulary").first().ids, "<u4"))

    def decode(batches):
        ids_of = vocabulary.value
        for batch in batches:
            for file, before, n, doc_ids, lengths, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = ids_of[decode_ranks(control, data, n)]
                ends = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(base[file] + before + ends - lengths), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    columns = blocks.select("file", "before", "n_ids", "doc_ids", "lengths", "control", "data")
    return columns.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, scratch.root)
