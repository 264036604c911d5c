"""Lines and requests: bounded reading, JSON-RPC, raw headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..functions import routes, rpc
from ..operators import manifests
from ..sources import images, lines
from ..sources.shared import new_folder

#: Bytes of a line at most in ``bounded_lines``, and of a byte range of its files.
MOST, SPLIT = 400, 10_000
#: Paths and methods of the requests in ``http_routing``; some of them lead nowhere.
PATHS = ("/health/live", "/metrics", "/v1/ocr", "/v1/ocr:raw", "/v1/ocr/", "/mcp", "/")
METHODS = ("GET", "POST", "HEAD", "PUT")


def bounded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of the conversations' texts, as written to files and read back, and how often it is there; too long ones together."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    folder = new_folder(spark, "lines")
    # Every other text ends in a carriage return.
    value = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 2 == 1, "\r").otherwise(""))
    c.select(value.alias("value")).write.text(folder)
    lines.register(spark)
    found = spark.read.format("bounded_lines").option("max_bytes", MOST).option("split_bytes", SPLIT).load(folder)
    return found.groupBy(F.col("value").cast("string").alias("line"), "too_large").agg(F.count("*").alias("n"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, value, too_large: a JSON-RPC request for each event, one in twelve kinds a fault."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n, kind = F.col("event_id"), F.col("event_id") % 12
    body = (
        F.when(kind == 0, '"method":"initialize"')
        .when(kind == 1, '"method":"tools/list"')
        .when(kind == 2, '"method":"tools/call","params":{"name":"ocr_capabilities","arguments":{}}')
        .when(kind == 3, '"method":"tools/call","params":{"name":"ocr_models","arguments":{"a":1}}')
        .when(kind == 4, F.concat(F.lit('"method":"tools/call","params":{"name":"ocr_recognize","arguments":{"n":'), n.cast("string"), F.lit("}}")))
        .when(kind == 5, '"method":"tools/call","params":{"name":"ocr_batch","extra":1}')
        .when(kind == 6, '"method":"notifications/initialized"')
        .when(kind == 7, '"method":"nothing"')
        .when(kind == 8, '"method":7')
        .when(kind == 9, '"method":"tools/call"')
        .when(kind == 10, '"method":"tools/call","params":{"name":"other"}')
        .otherwise('"method":"initialize"')
    )
    ident = F.when(n % 5 == 0, "").when(n % 5 == 1, '"id":null,').when(n % 5 == 2, F.concat(F.lit('"id":"e'), n.cast("string"), F.lit('",'))).when(n % 5 == 3, F.concat(F.lit('"id":'), n.cast("string"), F.lit(","))).otherwise('"id":[1],')
    value = F.concat(F.lit("{"), ident, F.lit('"jsonrpc":"2.0",'), body, F.when(kind == 11, "").otherwise("}"))
    return e.select(n.alias("request_id"), value.alias("value"), (n % 100 == 99).alias("too_large"))


def rpc_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each request goes, or the error that answers it."""
    d = rpc.answered(rpc.routed(_requests(spark, sf_dir)), "rasterlines", "1")
    return d.select("request_id", "correlation", "silent", "target", "code", "message", "arguments", "answer")


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image metadata and options from headers, one request for each part."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    headers = F.map_filter(
        F.create_map(
            F.lit("X-Image-Format"), F.when(k % 7 == 0, "gif").when(k % 2 == 0, "png").otherwise("jpeg"),
            F.lit("content-type"), F.when(k % 11 == 0, "image/png").when(k % 2 == 0, "image/png").otherwise("image/jpeg"),
            F.lit("x-image-width"), F.when(k % 13 == 0, "+").when(k % 13 == 1, "99999999999").otherwise((F.col("p_size") * 8).cast("string")),
            F.lit("x-image-height"), F.when(k % 17 == 0, F.lit(None)).when(k % 17 == 1, "+64").otherwise("64"),
            F.lit("x-include-words"), F.when(k % 3 == 0, "false").when(k % 3 == 1, F.lit(None)).when(k % 19 == 2, "True").otherwise("true"),
            F.lit("x-minimum-confidence"), F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "1.5").when(k % 5 == 2, "0.25").when(k % 5 == 3, "nan").otherwise("1"),
        ),
        lambda _, v: v.isNotNull(),
    )
    d = images.raw_requests(p.select(k.alias("id"), headers.alias("headers"), F.col("p_name").cast("binary").alias("body")))
    return d.select("image_id", "format", "encoded_bytes", "width", "height", F.col("options.include_words").alias("include_words"), F.col("options.minimum_confidence").alias("minimum_confidence"), "error_code")


def profile_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the profile of each part says: keys, values, a run of numbers and the symbols, joined."""
    # A small file gives few tasks, a profile much work.
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_size").repartition(2 * spark.sparkContext.defaultParallelism)
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    quoted = lambda w: F.when(k % 4 == 0, F.concat(F.lit("'"), w, F.lit("''s'"))).when(k % 4 == 1, F.concat(F.lit('"'), w, F.lit('\\u00e9"'))).otherwise(w)
    words = F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("  - "), quoted(w)))
    text = F.concat(
        F.lit("Global:\n  model_name: "), F.col("p_brand"), F.lit("\r\n  use_space_char: "), F.when(k % 5 == 0, "false").otherwise("true"),
        F.lit("\nPreProcess:\n  shape:\n  - 3\n  - - "), size, F.lit("\n    - x\n    - 320\n"),
        F.when(k % 6 == 0, "  use_space_char: true\n").otherwise(""),
        F.lit("PostProcess:\n  character_dict:\n"), F.array_join(words, "\n\n"), F.when(k % 7 == 0, "\n\t- tab").when(k % 7 == 1, "\n  -\n").when(k % 7 == 2, "\n  - #no").otherwise("\nEnd:\n  - more"),
    )
    d = p.select(k.alias("part"), text.alias("t"))
    t = F.col("t")
    return d.select(
        "part",
        P.has_key(t, "PostProcess").alias("has_key"),
        P.has_value(t, "model_name", "Brand#13").alias("has_value"),
        P.optional_true(t, "use_space_char").alias("spaces"),
        P.has_sequence(t, [3, 12, 320]).alias("has_sequence"),
        F.array_join(P.dictionary(t), "|").alias("symbols"),
    )


def proto_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose messages may be left out: an absent message stands for defaults, a present one for zeros."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    metadata = F.when(k % 11 != 0, F.struct((k % 4).cast("int").alias("format"), F.when(k % 3 > 0, F.col("p_size").cast("bigint")).alias("encoded_bytes"), F.col("p_size").cast("bigint").alias("width"), F.lit(None).cast("bigint").alias("height")))
    language = F.when(k % 7 == 0, "english").when(k % 7 == 1, "french")
    options = F.when(k % 2 == 0, F.struct(language.alias("language"), F.when(k % 7 == 0, True).alias("include_words"), F.when(k % 7 == 0, F.lit(0.5).cast("float")).alias("minimum_confidence")))
    d = images.proto_requests(p.select(k.alias("id"), F.col("p_name").cast("binary").alias("image"), metadata.alias("metadata"), options.alias("options")))
    return d.select("image_id", "format", "encoded_bytes", "width", "height", F.col("options.include_words").alias("include_words"), F.col("options.minimum_confidence").alias("minimum_confidence"), "error_code")


def batch_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of batches of up to nine parts: bytes, and whether the batch is taken."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    item = F.struct(
        F.when(k % 23 == 0, "ab=c").otherwise(F.base64(F.col("p_name").cast("binary"))).alias("image_base64"),
        F.struct(F.lit("png").alias("format"), F.octet_length("p_name").cast("bigint").alias("encoded_bytes"), F.lit(8).cast("bigint").alias("width"), F.lit(8).cast("bigint").alias("height")).alias("metadata"),
    )
    batch = F.when(k % 40 < 9, F.floor(k / 40) * 10).otherwise(F.floor(k / 40) * 10 + 1 + F.floor(k % 40 / 5))
    d = p.select(batch.cast("bigint").alias("id"), F.struct(k.alias("k"), item.alias("item")).alias("z")).groupBy("id").agg(F.array_sort(F.collect_list("z"))["item"].alias("items"))
    found = images.batch_requests(d.select("id", F.to_json(F.struct("items")).alias("value")))
    return found.select("batch_id", F.col("position").cast("int").alias("position"), F.octet_length("content").cast("bigint").alias("n_bytes"), "error_code", "batch_error_code")


def manifest_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of four parts each as manifests of artifacts: what breaks the policy."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    revision = F.substring(F.sha2(k.cast("string"), 256), 1, 40)
    a = p.select(
        F.concat(F.lit("bundle-"), F.floor(k / 4).cast("string")).alias("bundle_id"),
        F.when(k % 4 < 2, "detector").otherwise("english_recognizer").alias("role"),
        F.when((k % 2 == 0) | (k % 59 == 3), "onnx_graph").otherwise("inference_config").alias("kind"),
        F.when(k % 37 == 1, F.concat(F.lit("a/"), k.cast("string"))).otherwise(F.concat(F.lit("f"), (k - F.when(k % 61 == 2, k % 4).otherwise(0)).cast("string"))).alias("filename"),
        F.when(k % 41 == 0, "").otherwise(F.col("p_brand")).alias("upstream_project"),
        F.when(k % 43 == 0, F.substring(revision, 1, 39)).otherwise(revision).alias("revision"),
        F.concat(F.when(k % 47 == 0, "https://example.org/").otherwise("https://huggingface.co/x/resolve/"), F.when(k % 53 == 0, "main").otherwise(revision), F.lit("/f")).alias("source_url"),
        F.when(k % 31 == 0, 70000).otherwise(F.col("p_size")).cast("bigint").alias("byte_length"),
        F.sha2("p_name", 256).alias("sha256"),
        F.when(k % 29 == 0, "MIT").otherwise("Apache-2.0").alias("license"),
        F.lit(1).alias("schema_version"),
    )
    return manifests.violations(a)


def http_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a request of each event goes, by method, path and size, or the error that answers it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id")
    paths = F.array(*(F.lit(p) for p in PATHS))
    methods = F.array(*(F.lit(m) for m in METHODS))
    d = e.select(n.alias("request_id"), F.get(methods, (F.floor(n / len(PATHS)) % len(METHODS)).cast("int")).alias("method"), F.get(paths, (n % len(PATHS)).cast("int")).alias("path"), F.floor(F.col("value") * 100).cast("bigint").alias("length"))
    return routes.routed(d, {"recognize_json": 2000, "rpc": 5000}).select("request_id", "target", "status", "error_code", "body")


QUERIES = {f.__name__: f for f in (bounded_lines, rpc_routing, raw_requests, profile_scan, proto_requests, batch_items, manifest_policy, http_routing)}

QUERIES_SQL = {
    "bounded_lines": f"""WITH p AS (SELECT string_split(coalesce(text, '') || CASE WHEN turn % 2 = 1 THEN chr(13) ELSE '' END, chr(10)) AS parts FROM conversations),
      l AS (SELECT unnest(parts) AS line FROM p)
      SELECT CASE WHEN large THEN NULL WHEN line LIKE '%' || chr(13) THEN left(line, length(line) - 1) ELSE line END AS line, large AS too_large, count(*) AS n
      FROM (SELECT line, octet_length(encode(line)) > {MOST} AS large FROM l) GROUP BY ALL""",
    "rpc_routing": """WITH e AS (SELECT event_id AS n, event_id % 12 AS kind, event_id % 5 AS i, event_id % 100 = 99 AS large FROM events),
      f AS (SELECT *, CASE WHEN large THEN -32600 WHEN kind = 11 THEN -32700 WHEN i = 4 OR kind = 8 THEN -32600 WHEN kind = 6 AND i <> 0 THEN -32600 WHEN kind = 7 THEN -32601 WHEN kind IN (3, 5, 9, 10) THEN -32602 END::INTEGER AS code,
        large OR kind IN (8, 11) OR i = 4 AS lost FROM e),
      g AS (SELECT *, CASE WHEN code IS NULL THEN NULL WHEN large THEN 'request too large' WHEN kind = 11 THEN 'parse error' WHEN code = -32600 THEN 'invalid request' WHEN kind = 7 THEN 'method not found' WHEN kind IN (3, 10) THEN 'unknown tool' ELSE 'invalid params' END AS message,
        CASE WHEN lost OR i IN (0, 1) THEN 'null' WHEN i = 2 THEN '"e' || n || '"' ELSE n::VARCHAR END AS correlation, NOT lost AND i = 0 AS silent,
        CASE WHEN code IS NULL THEN CASE kind WHEN 0 THEN 'initialize' WHEN 1 THEN 'tools/list' WHEN 2 THEN 'ocr_capabilities' WHEN 4 THEN 'ocr_recognize' WHEN 6 THEN 'notifications/initialized' END END AS target FROM f)
      SELECT n AS request_id, correlation, silent, target, code, message, CASE target WHEN 'ocr_capabilities' THEN '{}' WHEN 'ocr_recognize' THEN '{"n":' || n || '}' END AS arguments,
        CASE WHEN silent THEN NULL WHEN code IS NOT NULL THEN '{"jsonrpc":"2.0","id":' || correlation || ',"error":{"code":' || code || ',"message":"' || message || '","data":{"request_id":' || CASE WHEN code = -32602 THEN 0 ELSE n END || '}}}'
          WHEN target = 'initialize' THEN '{"jsonrpc":"2.0","id":' || correlation || ',"result":{"protocolVersion":"2025-03-26","capabilities":{"tools":{}},"serverInfo":{"name":"rasterlines","version":"1"}}}'
          WHEN target = 'tools/list' THEN '{"jsonrpc":"2.0","id":' || correlation || ',"result":{"tools":[{"name":"ocr_recognize"},{"name":"ocr_batch"},{"name":"ocr_capabilities"},{"name":"ocr_models"}]}}' END AS answer FROM g""",
    "raw_requests": """WITH p AS (SELECT p_partkey AS k, p_name, CASE WHEN p_partkey % 2 = 0 THEN 'png' ELSE 'jpeg' END AS format, p_size FROM part),
      q AS (SELECT *, k % 7 <> 0 AND NOT (k % 11 = 0 AND k % 2 = 1) AND k % 13 > 1 AND k % 17 <> 0 AND NOT (k % 3 = 2 AND k % 19 = 2) AND k % 5 NOT IN (1, 3) AS ok FROM p)
      SELECT k AS image_id, CASE WHEN ok THEN format END AS format, octet_length(encode(p_name)) AS encoded_bytes, CASE WHEN ok THEN p_size * 8 END::INTEGER AS width, CASE WHEN ok THEN 64 END AS height,
        CASE WHEN ok THEN k % 3 <> 0 END AS include_words, CASE WHEN ok THEN CASE k % 5 WHEN 0 THEN 0 WHEN 2 THEN 0.25 ELSE 1 END END::FLOAT AS minimum_confidence, CASE WHEN NOT ok THEN 'invalid_request' END AS error_code FROM q""",
    "profile_scan": """WITH p AS (SELECT p_partkey AS k, p_brand, p_size, list_transform(string_split(p_name, ' '), lambda w: CASE p_partkey % 4 WHEN 0 THEN w || chr(39) || 's' WHEN 1 THEN w || chr(233) ELSE w END) AS w FROM part)
      SELECT k AS part, true AS has_key, p_brand = 'Brand#13' AS has_value, k % 5 <> 0 AND k % 6 <> 0 AS spaces, p_size = 12 AS has_sequence, CASE WHEN k % 7 NOT IN (0, 2) THEN array_to_string(w, '|') END AS symbols FROM p""",
    "proto_requests": """WITH p AS (SELECT p_partkey AS k, p_name, p_size, k % 11 <> 0 AND k % 4 IN (1, 2) AND (k % 2 = 1 OR k % 7 = 0) AS ok FROM part)
      SELECT k AS image_id, CASE WHEN ok THEN CASE k % 4 WHEN 1 THEN 'png' ELSE 'jpeg' END END AS format, CASE WHEN ok THEN CASE WHEN k % 3 > 0 THEN p_size ELSE 0 END END::BIGINT AS encoded_bytes,
        CASE WHEN ok THEN p_size END::INTEGER AS width, CASE WHEN ok THEN 0 END AS height, CASE WHEN ok THEN true END AS include_words, CASE WHEN ok THEN CASE WHEN k % 2 = 1 THEN 0 ELSE 0.5 END END::FLOAT AS minimum_confidence,
        CASE WHEN NOT ok THEN 'invalid_request' END AS error_code FROM p""",
    "batch_items": """WITH p AS (SELECT p_partkey AS k, p_name, CASE WHEN p_partkey % 40 < 9 THEN p_partkey // 40 * 10 ELSE p_partkey // 40 * 10 + 1 + p_partkey % 40 // 5 END AS batch_id, p_partkey % 23 = 0 AS bad FROM part),
      b AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY k) - 1 AS position, bool_or(bad) OVER (PARTITION BY batch_id) OR count(*) OVER (PARTITION BY batch_id) > 8 AS refused FROM p)
      SELECT batch_id, position::INTEGER AS position, CASE WHEN NOT refused THEN octet_length(encode(p_name)) END AS n_bytes, CASE WHEN bad THEN 'invalid_request' END AS error_code, CASE WHEN refused THEN 'invalid_request' END AS batch_error_code FROM b""",
    "manifest_policy": """WITH p AS (SELECT p_partkey AS k, p_size, 'bundle-' || p_partkey // 4 AS bundle_id, CASE WHEN p_partkey % 37 = 1 THEN 'a/' || p_partkey ELSE 'f' || p_partkey - CASE WHEN p_partkey % 61 = 2 THEN p_partkey % 4 ELSE 0 END END AS filename,
        p_partkey % 2 = 0 OR p_partkey % 59 = 3 AS graph FROM part),
      b AS (SELECT bundle_id, count(*) AS n, count(DISTINCT (k % 4 < 2)::INTEGER * 2 + graph::INTEGER) AS kinds, count(DISTINCT filename) AS names FROM p GROUP BY bundle_id)
      SELECT bundle_id, 'filename' AS rule, filename FROM p WHERE k % 37 = 1
      UNION ALL SELECT bundle_id, 'upstream_project', filename FROM p WHERE k % 41 = 0
      UNION ALL SELECT bundle_id, 'revision', filename FROM p WHERE k % 43 = 0
      UNION ALL SELECT bundle_id, 'source_url', filename FROM p WHERE k % 47 = 0
      UNION ALL SELECT bundle_id, 'revision_in_url', filename FROM p WHERE k % 53 = 0
      UNION ALL SELECT bundle_id, 'byte_length', filename FROM p WHERE (k % 31 = 0 AND NOT graph) OR (k % 31 <> 0 AND p_size <= 0)
      UNION ALL SELECT bundle_id, 'license', filename FROM p WHERE k % 29 = 0
      UNION ALL SELECT bundle_id, 'artifacts', NULL FROM b WHERE n <> 4 OR kinds <> 4
      UNION ALL SELECT bundle_id, 'filenames', NULL FROM b WHERE names <> n""",
    "http_routing": f"""WITH r(m, p, target, most) AS (VALUES {", ".join(f"('{m}', '{p}', '{t}', {dict(recognize_json=2000, rpc=5000).get(t, 'NULL')})" for m, p, t in routes.ROUTES)}),
      e AS (SELECT event_id AS request_id, ({list(METHODS)})[(event_id // {len(PATHS)} % {len(METHODS)} + 1)::INTEGER] AS method, ({list(PATHS)})[(event_id % {len(PATHS)} + 1)::INTEGER] AS path, floor(value * 100)::BIGINT AS length FROM events),
      s AS (SELECT request_id, target, CASE WHEN p IS NULL THEN 404 WHEN m <> CASE method WHEN 'HEAD' THEN 'GET' ELSE method END THEN 405 WHEN length > most THEN 413 END::INTEGER AS status FROM e LEFT JOIN r ON path = p)
      SELECT request_id, CASE WHEN status IS NULL THEN target END AS target, status, CASE WHEN status IS NOT NULL THEN 'invalid_request' END AS error_code,
        CASE WHEN status IS NOT NULL THEN '{{"error":{{"code":"invalid_request","message":"the OCR request is invalid"}},"request_id":' || request_id || '}}' END AS body FROM s""",
}
