"""Fixity audit of WARC replicas by Merkle trees.

A record's leaf is SHA-256 over a 0 byte and its bytes.  The leaves of a file
stand in offset order; each inner node is SHA-256 over a 1 byte and its up to
``FAN_OUT`` children's digests, and covers the offsets from its first child's
begin to its last child's end.  Replicas that agree in a file's root agree in
every byte of its records.  Where roots differ, only children of differing
nodes are compared, level by level, down to the records.

Trees are DataFrames with one row a node (file, level, nth, begin, end,
digest); a level is one aggregation over groups of at most FAN_OUT rows.

Nulls: null url or html count as empty; a null page_id is an ordinary record,
sorted first.  Repeated rows are records of their own.  A file or record that
only one replica has is reported as missing or added.  Other columns are
ignored.  Empty tables give empty trees and no findings.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

FAN_OUT = 16
#: Records of a file.
FILE_RECORDS = 1000

_END = b"\r\n\r\n"
#: Bytes inflated at a time.
_CHUNK = 1 << 16


def page_record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a page's WARC response record."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit(_END))


def leaf_digest(record: Column) -> Column:
    return F.sha2(F.concat(F.lit(b"\x00"), record), 256)


def file_layout(records: DataFrame, order: list[str], per_file: int, scratch: Scratch, name: str) -> DataFrame:
    """Adds file, nth, begin and end: records in the given order, ``per_file`` to a file, one after another.

    ``records`` has a size.  Ranks come from a range-sorted, written table; only
    one row a partition goes through the driver.
    """
    placed = records.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.keep(placed, name).withColumns({"_part": F.expr("shiftright(_at, 33)"), "_nth": F.expr("_at & 8589934591")})
    before, total = [], 0
    for r in sorted(placed.groupBy("_part").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_part"]):
        before.append((r["_part"], total))
        total += r.n
    offsets = records.sparkSession.createDataFrame(before, "_part bigint, _before bigint")
    ranked = placed.join(F.broadcast(offsets), "_part").withColumn("_rank", F.col("_nth") + F.col("_before"))
    ranked = ranked.withColumns({"file": F.expr(f"_rank div {per_file}"), "nth": F.expr(f"_rank % {per_file}")})
    from pyspark.sql import Window

    running = Window.partitionBy("file").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("end", F.sum("size").over(running)).withColumn("begin", F.col("end") - F.col("size")).drop("_at", "_part", "_nth", "_before", "_rank")


def merkle_tree(leaves: DataFrame, scratch: Scratch, name: str, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """Levels from the leaves (file, nth, begin, end, digest) to one root a file."""
    level = scratch.keep(leaves.select("file", "nth", "begin", "end", "digest"), f"{name}-0")
    levels = [level]
    while (level.agg(F.max("nth")).first()[0] or 0) > 0:
        children = F.sort_array(F.collect_list(F.struct("nth", "digest")))
        joined = F.aggregate(children, F.lit(b"\x01"), lambda a, c: F.concat(a, F.unhex(c["digest"])))
        level = level.groupBy("file", F.expr(f"nth div {fan_out}").alias("nth")).agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sha2(joined, 256).alias("digest"))
        level = scratch.keep(level.select("file", "nth", "begin", "end", "digest"), f"{name}-{len(levels)}")
        levels.append(level)
    return levels


def audit(ours: list[DataFrame], theirs: list[DataFrame], scratch: Scratch, fan_out: int = FAN_OUT) -> DataFrame:
    """file, nth, begin, end, finding (changed, missing, added) of each record in which the replicas differ.

    Trees of different height are compared from the lower one's top; a file is
    then one or a few nodes there.
    """
    top = min(len(ours), len(theirs)) - 1
    parents = None
    for k in range(top, -1, -1):
        a, b = ours[k], theirs[k]
        if parents is not None:
            inside = lambda df, p=parents: df.withColumn("_up", F.expr(f"nth div {fan_out}")).join(p.select("file", F.col("nth").alias("_up")), ["file", "_up"], "left_semi").drop("_up")
            a, b = inside(a), inside(b)
        b = b.select("file", "nth", *(F.col(c).alias(f"their_{c}") for c in ("begin", "end", "digest")))
        both = a.join(b, ["file", "nth"], "full").where(~F.col("digest").eqNullSafe(F.col("their_digest")))
        parents = scratch.keep(both, f"differing-{k}")
    finding = F.when(F.col("their_digest").isNull(), "missing").when(F.col("digest").isNull(), "added").otherwise("changed")
    return parents.select("file", "nth", F.coalesce("begin", "their_begin").alias("begin"), F.coalesce("end", "their_end").alias("end"), finding.alias("finding"))


def _member_end(content: bytes, at: int) -> int | None:
    """Where the gzip member at ``at`` ends; None if it is damaged or cut off."""
    inflate, start = zlib.decompressobj(31), at
    while start < len(content) and not inflate.eof:
        try:
            inflate.decompress(content[start : start + _CHUNK])
        except zlib.error:
            return None
        start = min(start + _CHUNK, len(content))
    return start - len(inflate.unused_data) if inflate.eof else None


def _next_member(content: bytes, at: int) -> int:
    """The first gzip member from ``at`` on that inflates to a WARC header; the end if there is none."""
    while (at := content.find(b"\x1f\x8b\x08", at)) >= 0:
        try:
            if zlib.decompressobj(31).decompress(content[at : at + _CHUNK], 5) == b"WARC/":
                return at
        except zlib.error:
            pass
        at += 1
    return len(content)


def record_spans(content: bytes):
    """(begin, end) of each record of a WARC file, damaged stretches among them."""
    at = 0
    while at < len(content):
        end = None
        if content[at : at + 2] == b"\x1f\x8b":
            end = _member_end(content, at)
        elif content[at : at + 5] == b"WARC/":
            head = content.find(b"\r\n\r\n", at)
            lengths = [x.split(b":", 1)[1] for x in content[at : max(head, at)].split(b"\r\n") if x.lower().startswith(b"content-length:")]
            if head >= 0 and lengths and lengths[0].strip().isdigit():
                end = min(head + 4 + int(lengths[0]) + len(_END), len(content))
        if end is None:
            end = _next_member(content, at + 1)
        yield at, end
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, nth, begin, end, digest of the records of WARC files, plain or with a gzip member each.

    ``file`` is the file's name.  Bytes that do not parse make one record up to
    the next gzip member that begins a WARC record, or else the file's end, so
    damage shows as a difference and nothing is left out.
    """

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = list(record_spans(content))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(spans)), pa.array(range(len(spans)), pa.int64()), pa.array([a for a, _ in spans], pa.int64()), pa.array([b for _, b in spans], pa.int64()), pa.array([content[a:b] for a, b in spans], pa.binary())],
                    ["file", "nth", "begin", "end", "record"],
                )

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(parse, "file string, nth bigint, begin bigint, end bigint, record binary").withColumn("digest", leaf_digest(F.col("record"))).drop("record")


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the pages' records against a drill copy in which some are damaged.

    In the copy, the last character of each page whose SHA-256 begins with a 0
    digit is replaced.  Every record comes with its place, leaf and the audit's
    finding (null: intact).
    """
    scratch = Scratch(spark, "warc-fixity")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = F.coalesce("html", F.lit(""))
    damaged = F.when((F.length(html) > 0) & F.sha2(html, 256).startswith("0"), F.concat(F.expr("left(coalesce(html, ''), length(coalesce(html, '')) - 1)"), F.lit("?"))).otherwise(html)
    record, copy = page_record(F.col("page_id"), F.col("url"), html), page_record(F.col("page_id"), F.col("url"), damaged)
    rows = pages.select(F.col("page_id").cast("bigint"), F.octet_length(record).cast("bigint").alias("size"), leaf_digest(record).alias("digest"), F.octet_length(copy).cast("bigint").alias("copy_size"), leaf_digest(copy).alias("copy_digest"))
    laid = scratch.keep(file_layout(rows, ["page_id", "digest"], FILE_RECORDS, scratch, "placed"), "records")
    ours = merkle_tree(laid, scratch, "ours")
    theirs = merkle_tree(laid.drop("digest").withColumnRenamed("copy_digest", "digest"), scratch, "theirs")
    found = audit(ours, theirs, scratch).select("file", "nth", "finding")
    roots = ours[-1].select("file", F.col("digest").alias("root"))
    return laid.join(found, ["file", "nth"], "left").join(roots, "file").select("page_id", "file", "nth", "begin", "end", "digest", "root", "finding")


_SQL_RECORD = r"""encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10)
    || html || chr(13) || chr(10) || chr(13) || chr(10))"""

OP5_SQL = rf"""
WITH RECURSIVE records AS (
  SELECT page_id, {_SQL_RECORD} AS record, length(html) > 0 AND sha256(html) LIKE '0%' AS damaged, row_number() OVER (ORDER BY page_id) - 1 AS r
  FROM (SELECT page_id, url, coalesce(html, '') AS html FROM pages)
), laid AS (
  SELECT page_id, r // {FILE_RECORDS} AS file, r % {FILE_RECORDS} AS nth, octet_length(record) AS size, sha256('\x00'::BLOB || record) AS digest, damaged FROM records
), tree AS (
  SELECT 0 AS level, file, nth, digest FROM laid
  UNION ALL
  SELECT level + 1, file, nth // {FAN_OUT}, sha256('\x01'::BLOB || unhex(string_agg(digest, '' ORDER BY nth)))
  FROM tree GROUP BY level, file, nth // {FAN_OUT}
  HAVING level < 3
), levels AS (SELECT CASE WHEN m < 1 THEN 0 WHEN m < {FAN_OUT} THEN 1 WHEN m < {FAN_OUT**2} THEN 2 ELSE 3 END AS top FROM (SELECT max(nth) AS m FROM laid))
SELECT page_id, file, nth, CAST(sum(size) OVER w - size AS BIGINT) AS begin, CAST(sum(size) OVER w AS BIGINT) AS "end", l.digest, t.digest AS root, CASE WHEN damaged THEN 'changed' END AS finding
FROM laid l JOIN (SELECT file, digest FROM tree, levels WHERE level = top) t USING (file)
WINDOW w AS (PARTITION BY file ORDER BY nth)
"""
