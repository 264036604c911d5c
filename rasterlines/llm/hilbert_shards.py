"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to 2**BITS steps: numbers at equal-depth cuts over
all rows, strings by hash at equal-depth cuts.  A row's cell has an index on
the Hilbert curve through the grid, so rows near each other on the curve are
near in every dimension.  Rows are range-sorted by that index and cut into runs
of equal counts (at most one apart): a shard spans few steps of each dimension,
and readers skip shards by their smallest and largest values.

Only DataFrame expressions are used.  Ranks come from a range-sorted, written
table: a row's place in its partition plus the sizes of the partitions before.

Nulls: a null dimension is the lowest step, a null text has 0 bytes, a null
doc_id sorts first within its cell.  Repeated rows and equal cells are ordered
by doc_id, text checksum and size; rows alike in all of them are
interchangeable.  Other columns are ignored by the query and kept by
``shard_files``.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

BITS = 5
#: Accuracy of the cuts: each is off by at most 1 / this of the rows.
CUT_ACCURACY = 10000


def quantised(df: DataFrame, dimensions: dict[str, Column], bits: int) -> DataFrame:
    """Adds a step 0 .. 2**bits - 1 for each dimension, cut at equal-depth quantiles over all rows."""
    share = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = df.agg(*(F.percentile_approx(c, share, CUT_ACCURACY).alias(n) for n, c in dimensions.items())).first()
    for name, column in dimensions.items():
        steps = sorted(cuts[name] or [])
        edges = F.array(*(F.lit(x) for x in steps)) if steps else None
        step = F.size(F.filter(edges, lambda e, c=column: e < c)) if steps else F.lit(0)
        df = df.withColumn(name, F.when(column.isNull(), 0).otherwise(step).cast("int"))
    return df


def hilbert_index(df: DataFrame, dimensions: list[str], bits: int, name: str) -> DataFrame:
    """Adds the index along the Hilbert curve of a cell given by its steps.

    The transposed form of the index is made bit plane by bit plane: exchange or
    invert lower bits, then Gray-code; its bits are then interleaved.
    """
    x = [f"_h{k}" for k in range(len(dimensions))]
    df = df.withColumns({h: F.col(d) for h, d in zip(x, dimensions, strict=True)})
    for bit in range(bits - 1, 0, -1):
        q, low = 1 << bit, (1 << bit) - 1
        for h in x:
            swap = (F.col(x[0]).bitwiseXOR(F.col(h))).bitwiseAND(F.lit(low))
            inverted = F.col(h).bitwiseAND(F.lit(q)) != 0
            if h == x[0]:
                df = df.withColumn(h, F.when(inverted, F.col(h).bitwiseXOR(F.lit(low))).otherwise(F.col(h)))
            else:
                df = df.withColumns({x[0]: F.when(inverted, F.col(x[0]).bitwiseXOR(F.lit(low))).otherwise(F.col(x[0]).bitwiseXOR(swap)), h: F.when(inverted, F.col(h)).otherwise(F.col(h).bitwiseXOR(swap))})
    for a, b in zip(x, x[1:], strict=False):
        df = df.withColumn(b, F.col(b).bitwiseXOR(F.col(a)))
    turn = F.lit(0)
    for bit in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(F.lit(1 << bit)) != 0, (1 << bit) - 1).otherwise(0))
    df = df.withColumn("_turn", turn).withColumns({h: F.col(h).bitwiseXOR(F.col("_turn")) for h in x})
    index = F.lit(0).cast("bigint")
    for bit in range(bits - 1, -1, -1):
        for h in x:
            index = index * 2 + F.shiftright(F.col(h), bit).bitwiseAND(F.lit(1))
    return df.withColumn(name, index).drop(*x, "_turn")


def _hash(column: str) -> Column:
    return F.when(F.col(column).isNotNull(), F.xxhash64(column))


def document_cells(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32 and cell (curve index over language, source and size) of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint"), (F.octet_length(text).cast("bigint") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _hash("lang").alias("_lang"), _hash("source").alias("_source"))
    steps = quantised(rows, {"lang_step": F.col("_lang"), "source_step": F.col("_source"), "size_step": F.col("size")}, bits)
    return hilbert_index(steps, ["lang_step", "source_step", "size_step"], bits, "cell").drop("_lang", "_source")


def cut_runs(rows: DataFrame, order: list[str], shards: int, scratch: Scratch) -> DataFrame:
    """Adds shard and slot: runs of the given order, counts at most one apart, slots gapless from 0."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.keep(placed, "placed").withColumns({"_part": F.expr("shiftright(_at, 33)"), "_nth": F.expr("_at & 8589934591")})
    before, total = [], 0
    # One row a partition.
    for r in sorted(placed.groupBy("_part").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_part"]):
        before.append((r["_part"], total))
        total += r.n
    offsets = rows.sparkSession.createDataFrame(before, "_part bigint, _before bigint")
    ranked = placed.join(F.broadcast(offsets), "_part").withColumn("_rank", F.col("_nth") + F.col("_before"))
    short, long = divmod(total, shards)  # the first ``long`` shards have one row more
    edge = long * (short + 1)
    shard = F.when(F.col("_rank") < edge, F.expr(f"_rank div {short + 1}")).otherwise(F.expr(f"{long} + (_rank - {edge}) div {max(short, 1)}"))
    slot = F.when(F.col("_rank") < edge, F.expr(f"_rank % {short + 1}")).otherwise(F.expr(f"(_rank - {edge}) % {max(short, 1)}"))
    return ranked.withColumns({"shard": shard.cast("int"), "slot": slot.cast("bigint")}).drop("_at", "_part", "_nth", "_before", "_rank")


def shard_documents(docs: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """doc_id, size, text_crc32, the steps, cell, shard and slot of each row."""
    return cut_runs(document_cells(docs), ["cell", "doc_id", "text_crc32", "size"], shards, scratch)


def shard_ranges(sharded: DataFrame) -> DataFrame:
    """What a reader prunes by: each shard's rows, bytes, and smallest and largest step of each dimension."""
    ranges = [f(c).alias(f"{n}_{c}") for c in ("lang_step", "source_step", "size_step") for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ranges)


def shard_files(docs: DataFrame, shards: int, scratch: Scratch, path: str) -> None:
    """Writes the documents, all columns, as one folder a shard in slot order.

    Rows join their place by doc_id, checksum, size and a number among rows alike
    in these, so repeated rows take as many places as they are.
    """
    alike = Window.partitionBy("_id", "_crc", "_size").orderBy("_order")
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), docs["doc_id"].cast("bigint").alias("_id"), F.crc32(text.cast("binary")).alias("_crc"), (F.octet_length(text).cast("bigint") + 16).alias("_size"), F.xxhash64(*docs.columns).alias("_order"))
    rows = rows.withColumn("_nth", F.row_number().over(alike))
    places = shard_documents(docs, shards, scratch).select(F.col("doc_id").alias("_to_id"), F.col("text_crc32").alias("_to_crc"), F.col("size").alias("_to_size"), "shard", "slot")
    places = places.withColumn("_to_nth", F.row_number().over(Window.partitionBy("_to_id", "_to_crc", "_to_size").orderBy("shard", "slot")))
    same = [F.col("_id").eqNullSafe(F.col("_to_id"))] + [F.col(f"_{c}") == F.col(f"_to_{c}") for c in ("crc", "size", "nth")]
    joined = rows.join(places, same).select("shard", "slot", "_row")
    placed = joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    placed.select(F.col("shard").alias("_shard"), "_row.*").write.partitionBy("_shard").parquet(path)


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs, 40, Scratch(spark, "hilbert")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
