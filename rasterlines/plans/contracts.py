"""Contract, manifest and result-document queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from . import regions as P


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region is a bundle, its nations the artifacts in key order; one digest over tag, name and every artifact."""
    n = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.select("r_name", "n_nationkey", F.concat(F.lpad(F.hex(F.col("n_nationkey")), 2, "0"), F.hex(F.col("n_name").cast("binary")), F.lpad(F.hex(F.octet_length("n_name").cast("bigint")), 16, "0"), F.hex(F.sha2("n_name", 256).cast("binary"))).alias("part"))
    parts = n.groupBy("r_name").agg(F.count("*").alias("n_artifacts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "part"))), lambda z: z["part"]), "").alias("parts"))
    return parts.select("r_name", "n_artifacts", F.sha2(F.unhex(F.concat(F.hex(F.lit(b"bundle-v1")), F.hex(F.col("r_name").cast("binary")), "parts")), 256).alias("fingerprint"))


def operator_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def contract_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator counts of even and odd events of a user: which operators differ, and whether the two graphs are equal."""
    e = _read(spark, sf_dir, "events").select("user_id", "event_type", (F.col("event_id") % 2).alias("side"))
    counts = e.groupBy("user_id", "event_type").agg(F.count_if(F.col("side") == 0).alias("declared"), F.count_if(F.col("side") == 1).alias("measured"))
    return counts.groupBy("user_id").agg(F.count("*").alias("n_operators"), F.count_if(F.col("declared") != F.col("measured")).alias("n_differing"), F.bool_and(F.col("declared") == F.col("measured")).alias("equal"))


def allowlist_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order of urgent priority."""
    c, o = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statuses of each priority against all statuses: is anything missing or extra?"""
    o = _read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus")
    expected = o.agg(F.array_sort(F.collect_set("o_orderstatus")).alias("expected"))  # one row of three values
    d = o.groupBy("o_orderpriority").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("found")).join(F.broadcast(expected))
    return d.select("o_orderpriority", F.size(F.array_except("expected", "found")).cast("bigint").alias("n_missing"), F.size(F.array_except("found", "expected")).cast("bigint").alias("n_extra"))


def _codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(schema.ERRORS, "error_code string, http int, grpc string")


def error_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*(F.lit(c) for c, _, _ in schema.ERRORS))
    e = _read(spark, sf_dir, "events").select("event_id", F.element_at(codes, (F.col("event_id") % len(schema.ERRORS) + 1).cast("int")).alias("error_code"))
    e = e.join(F.broadcast(_codes(spark)), "error_code")
    body = F.to_json(F.struct(F.struct(F.col("error_code").alias("code"), F.concat(F.lit("request failed: "), "error_code").alias("message")).alias("error"), F.format_string("req-%d", "event_id").alias("request_id")))
    return e.select("event_id", "http", "grpc", body.alias("body"))


def metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    d = e.groupBy("event_type").agg(F.count_if(F.col("value") >= 50).alias("completed"), F.count_if(F.col("value") < 50).alias("failed"))
    return d.select("event_type", "completed", "failed", F.format_string('requests_total{type="%s"} %d', "event_type", F.col("completed") + F.col("failed")).alias("line"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of lines in reading order, those of low confidence left out: page_id, width, height, blocks."""
    d = P._ordered(P.regions(spark, sf_dir)).withColumn("left", F.filter("ordered", lambda z: z["confidence"] >= F.lit(0.75).cast("float")))
    point = lambda z, dx, dy: F.struct((z["x"] + dx).cast("float").alias("x"), (z["y"] + dy).cast("float").alias("y"))

    def block(z):
        polygon = F.struct(F.array(point(z, 0, 0), point(z, 20, 0), point(z, 20, 8), point(z, 0, 8)).alias("points"))
        text = F.concat(F.lit("line "), z["i"].cast("string"))
        word = F.struct(text.alias("text"), z["confidence"].alias("confidence"), polygon.alias("polygon"))
        return F.struct(polygon.alias("polygon"), F.array(F.struct(text.alias("text"), z["confidence"].alias("confidence"), polygon.alias("polygon"), F.array(word).alias("words"))).alias("lines"))

    return d.select("page_id", F.lit(P.PAGE_WIDTH).alias("width"), F.lit(P.PAGE_HEIGHT).alias("height"), F.transform("left", block).alias("blocks"))


def assemble_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _pages(spark, sf_dir).select("page_id", F.posexplode("blocks").alias("rank", "block"))
    line = F.col("block.lines")[0]
    return d.select("page_id", "rank", line["text"].alias("text"), line["confidence"].alias("confidence"), line["polygon"]["points"][2]["x"].alias("right"), F.size(line["words"]).alias("n_words"))


def page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.struct(F.lit(0).alias("index"), "width", "height", "blocks")
    d = _pages(spark, sf_dir).withColumn("result", F.to_json(F.struct(F.array(page).alias("pages"))))
    # Exploded from one value, so that each document is parsed once for both columns.
    d = d.select("page_id", "result", F.explode(F.array(F.from_json("result", schema.RESULT))).alias("back"))
    return d.select("page_id", F.size(F.col("back")["pages"][0]["blocks"]).cast("bigint").alias("n_blocks"), (F.to_json("back") == F.col("result")).alias("round_trip"))


def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = [("png,jpeg", "english", schema.MAX_ENCODED_BYTES, schema.MAX_BATCH_ITEMS, True)]
    return spark.createDataFrame(row, "formats string, languages string, max_encoded_bytes bigint, max_batch_items int, words boolean")


_CODES = "codes(error_code, http, grpc, k) AS (VALUES " + ", ".join(f"('{c}', {h}, '{g}', {k})" for k, (c, h, g) in enumerate(schema.ERRORS)) + ")"

QUERIES = {f.__name__: f for f in (manifest_fingerprint, operator_multiset, contract_compare, allowlist_anti_join, set_equality, error_envelope, metrics_rollup, assemble_page, page_json, capabilities)}

QUERIES_SQL = {
    "manifest_fingerprint": """WITH n AS (SELECT r_name, n_nationkey, lpad(hex(n_nationkey), 2, '0') || hex(encode(n_name)) || lpad(hex(octet_length(encode(n_name))), 16, '0') || hex(encode(sha256(n_name))) AS part FROM nation JOIN region ON n_regionkey = r_regionkey)
      SELECT r_name, count(*) AS n_artifacts, sha256(unhex(hex(encode('bundle-v1')) || hex(encode(r_name)) || string_agg(part, '' ORDER BY n_nationkey))) AS fingerprint FROM n GROUP BY r_name""",
    "operator_multiset": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type",
    "contract_compare": """WITH c AS (SELECT user_id, event_type, count(*) FILTER (event_id % 2 = 0) AS declared, count(*) FILTER (event_id % 2 = 1) AS measured FROM events GROUP BY user_id, event_type)
      SELECT user_id, count(*) AS n_operators, count(*) FILTER (declared <> measured) AS n_differing, bool_and(declared = measured) AS equal FROM c GROUP BY user_id""",
    "allowlist_anti_join": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "set_equality": """WITH o AS (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders), s AS (SELECT DISTINCT o_orderstatus FROM o)
      SELECT o_orderpriority, (SELECT count(*) FROM s) - count(s.o_orderstatus) AS n_missing, count(*) FILTER (s.o_orderstatus IS NULL) AS n_extra FROM o LEFT JOIN s USING (o_orderstatus) GROUP BY o_orderpriority""",
    "error_envelope": f"""WITH {_CODES} SELECT event_id, http, grpc, '{{"error":{{"code":"' || error_code || '","message":"request failed: ' || error_code || '"}},"request_id":"req-' || event_id || '"}}' AS body FROM events JOIN codes ON event_id % {len(schema.ERRORS)} = k""",
    "metrics_rollup": """SELECT event_type, count(*) FILTER (value >= 50) AS completed, count(*) FILTER (value < 50) AS failed, 'requests_total{type="' || event_type || '"} ' || count(*) FILTER (value >= 50 OR value < 50) AS line FROM events GROUP BY event_type""",
    "assemble_page": f"""WITH {P._ORDERED}, l AS (SELECT page_id, list_filter(o, lambda z: z.c >= 0.75::FLOAT) AS l FROM ordered WHERE len(list_filter(o, lambda z: z.c >= 0.75::FLOAT)) > 0)
      SELECT page_id, (unnest(range(1, len(l) + 1)) - 1)::INTEGER AS rank, 'line ' || unnest(l).i AS text, unnest(l).c AS confidence, (unnest(l).x + 20)::FLOAT AS "right", 1 AS n_words FROM l""",
    "page_json": f"WITH {P._ORDERED} SELECT page_id, len(list_filter(o, lambda z: z.c >= 0.75::FLOAT)) AS n_blocks, true AS round_trip FROM ordered",
    "capabilities": f"SELECT 'png,jpeg' AS formats, 'english' AS languages, {schema.MAX_ENCODED_BYTES}::BIGINT AS max_encoded_bytes, {schema.MAX_BATCH_ITEMS} AS max_batch_items, true AS words",
}
