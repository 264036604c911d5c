"""Admission queries: documents, pages and suppliers stand in for requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import admission as A
from ..functions import recognition as R
from ..functions import raster


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metadata_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 4000 - 40000).alias("encoded_bytes"), (F.col("n_chars") * 3).cast("int").alias("width"), F.expr("cast(doc_id % 9000 as int)").alias("height"))
    return d.withColumn("error_code", A.metadata_error(F.col("encoded_bytes"), F.col("width"), F.col("height")))


def raster_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("case doc_id % 3 when 0 then unhex('89504E470D0A1A0A') when 1 then unhex('FFD8FFE0') else encode('GIF8', 'utf-8') end")
    d = _read(spark, sf_dir, "documents").select("doc_id", F.concat(start, F.coalesce("text", F.lit("")).cast("binary")).alias("content"), F.when(F.col("doc_id") % 2 == 0, "png").otherwise("jpeg").alias("declared"))
    d = d.withColumn("sniffed", A.sniffed_format(F.col("content")))
    return d.select("doc_id", "sniffed", F.coalesce(F.col("sniffed") == F.col("declared"), F.lit(False)).alias("accepted"))


def base64_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each text in base64 by rule and as measured; null for a null text."""
    d = _read(spark, sf_dir, "documents")
    n = F.octet_length("text").cast("bigint")
    return d.select("doc_id", A.base64_length(n).alias("wire_length"), F.length(F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\r\n]", "")).cast("bigint").alias("measured"))


def base64_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts encoded, and for two in three damaged: padding cut off, or a character outside the alphabet; null isn't accepted."""
    d = _read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\r\n]", "").alias("b"))
    d = d.withColumn("b", F.expr("case doc_id % 3 when 0 then b when 1 then rtrim('=', b) else concat('-', substring(b, 2)) end"))
    return d.select("doc_id", A.strict_base64(F.col("b")).isNotNull().alias("accepted"))


def text_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("origin"), "text")
    c = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.lit("conversations").alias("origin"), "text")
    return d.union(c).withColumn("ok", F.coalesce(R.text_admitted(F.col("text")), F.lit(False))).groupBy("origin", "ok").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def url_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages, one in three moved to a host of the list: which are on it, and which are https to a bare host."""
    moved = F.concat(F.element_at(F.array(*map(F.lit, ("https://", "http://", "https://user@"))), (F.expr("page_id div 3") % 3 + 1).cast("int")), F.element_at(F.array(*map(F.lit, A.MODEL_HOSTS)), (F.col("page_id") % len(A.MODEL_HOSTS) + 1).cast("int")), F.lit("/x"))
    d = _read(spark, sf_dir, "pages").withColumn("url", F.when(F.col("page_id") % 3 == 0, moved).otherwise(F.col("url"))).withColumn("host", F.regexp_extract("url", r"\A[a-z]+://([^/?#]*)", 1))
    site = F.regexp_extract("url", r"\Ahttps://([^/?#]*)", 1)
    return d.select("page_id", "host", A.allowed_url(F.col("url")).alias("model_host"), ((site != "") & ~F.contains(site, F.lit("@")) & ~F.contains(site, F.lit(":"))).alias("plain_https"))


def identifier_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    name = F.expr("case s_suppkey % 4 when 0 then s_name when 1 then replace(s_name, '#', '_') when 2 then '..' else repeat('x', cast(s_suppkey + 30 as int)) end")
    s = s.withColumn("name", name)
    return s.select("s_suppkey", A.safe_identifier(F.col("name")).alias("safe"))


def sha256_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    d = d.withColumn("h", F.expr("case doc_id % 3 when 0 then h when 1 then upper(h) else left(h, 63) end"))
    return d.select("doc_id", "h", A.lower_sha256(F.col("h")).alias("ok"))


def _dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language's distinct characters, in order: at most the characters there are, whatever the text."""
    d = _read(spark, sf_dir, "documents").where("text is not null")
    chars = d.select("lang", F.explode(F.array_distinct(F.split("text", ""))).alias("c")).where("c <> ''").distinct()
    return chars.groupBy("lang").agg(F.array_sort(F.collect_list("c")).alias("all_symbols")).withColumn("symbols", F.filter("all_symbols", lambda c: ~c.isin(" ", "\n")))


def dictionary_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dictionaries(spark, sf_dir)
    return d.select("lang", F.size("symbols").cast("bigint").alias("n"), A.dictionary_admitted("symbols").alias("ok"), A.dictionary_admitted("all_symbols").alias("with_space_ok"))


def dictionary_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dictionaries(spark, sf_dir).select("lang", A.dictionary_digest("symbols").alias("digest"))


def detector_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select("doc_id", F.expr("cast(n_chars % 3000 as int) + 1").alias("w"), F.expr("cast(doc_id % 1500 as int) + 1").alias("h"))
    d = d.withColumns({"pw": raster.padded_side(F.col("w"), F.col("w"), F.col("h")), "ph": raster.padded_side(F.col("h"), F.col("w"), F.col("h"))})
    d = d.withColumns({"tw": raster.detector_side(F.col("pw"), F.greatest("pw", "ph")), "th": raster.detector_side(F.col("ph"), F.greatest("pw", "ph"))})
    return d.select("doc_id", "w", "h", "tw", "th", raster.detector_scale(F.col("tw"), F.col("pw")).alias("scale_x"), raster.detector_scale(F.col("th"), F.col("ph")).alias("scale_y"))


def batch_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a batch: 1 to 8 items, bytes within the cap, and the first bad item's error for all."""
    c = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("bytes"))
    c = c.withColumn("item_error", F.when(F.col("bytes") == 0, "invalid_request").when(F.col("bytes") > 1200, "invalid_image"))
    g = c.groupBy("conv_id").agg(F.count("*").alias("n_items"), F.sum("bytes").alias("bytes"), F.min_by("item_error", F.when(F.col("item_error").isNotNull(), F.struct("turn", "item_error"))).alias("first_error"))
    error = F.when(~F.col("n_items").between(1, schema.MAX_BATCH_ITEMS), "invalid_request").when(F.col("bytes") > 4000, "invalid_request").otherwise(F.col("first_error"))
    return g.select("conv_id", "n_items", "bytes", error.alias("error_code"))


_LIMITS = f"encoded_bytes BETWEEN 1 AND {schema.MAX_ENCODED_BYTES} AND width BETWEEN 1 AND {schema.MAX_SIDE} AND height BETWEEN 1 AND {schema.MAX_SIDE} AND width::BIGINT * height <= {schema.MAX_PIXELS} AND width::BIGINT * height * 3 <= {schema.MAX_DECODED_BYTES}"
_CHARS = """chars AS (SELECT DISTINCT lang, unnest(string_split(text, '')) AS c FROM documents WHERE text IS NOT NULL), dicts AS (SELECT lang, list_sort(list(c)) AS all_symbols, list_sort(list(c) FILTER (c NOT IN (' ', chr(10)))) AS symbols FROM chars WHERE c <> '' GROUP BY lang)"""

QUERIES = {f.__name__: f for f in (metadata_admission, raster_magic, base64_lengths, base64_strict, text_admission, url_allowlist, identifier_admission, sha256_admission, dictionary_admission, dictionary_digest, detector_shapes, batch_all_or_nothing)}

QUERIES_SQL = {
    "metadata_admission": f"""WITH d AS (SELECT doc_id, n_chars * 4000 - 40000 AS encoded_bytes, (n_chars * 3)::INTEGER AS width, (doc_id % 9000)::INTEGER AS height FROM documents)
      SELECT *, CASE WHEN {_LIMITS} THEN NULL ELSE 'invalid_request' END AS error_code FROM d""",
    "raster_magic": """WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' END AS sniffed, CASE WHEN doc_id % 2 = 0 THEN 'png' ELSE 'jpeg' END AS declared FROM documents)
      SELECT doc_id, sniffed, coalesce(sniffed = declared, false) AS accepted FROM d""",
    "base64_lengths": "SELECT doc_id, (octet_length(encode(text)) + 2) // 3 * 4 AS wire_length, length(to_base64(encode(text))) AS measured FROM documents",
    "base64_strict": """WITH d AS (SELECT doc_id, to_base64(encode(text)) AS b FROM documents),
      m AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN b WHEN 1 THEN rtrim(b, '=') ELSE '-' || substring(b, 2) END AS b FROM d)
      SELECT doc_id, coalesce(length(b) % 4 = 0 AND regexp_full_match(b, '[A-Za-z0-9+/]*={0,2}'), false) AS accepted FROM m""",
    "text_admission": r"""WITH t AS (SELECT doc_id AS id, 'documents' AS origin, text FROM documents UNION ALL SELECT conv_id, 'conversations', text FROM conversations)
      SELECT origin, ok, count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT *, coalesce(regexp_full_match(text, '[\x20-\x7E]+'), false) AS ok FROM t) GROUP BY origin, ok""",
    "url_allowlist": f"""WITH u AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN (['https://', 'http://', 'https://user@'])[page_id // 3 % 3 + 1] || ({list(A.MODEL_HOSTS)})[page_id % {len(A.MODEL_HOSTS)} + 1] || '/x' ELSE url END AS url FROM pages),
      p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^https://([^/?#]*)', 1) AS site FROM u)
      SELECT page_id, host, site IN {A.MODEL_HOSTS} AS model_host, site <> '' AND NOT contains(site, '@') AND NOT contains(site, ':') AS plain_https FROM p""",
    "identifier_admission": """WITH s AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN replace(s_name, '#', '_') WHEN 2 THEN '..' ELSE repeat('x', s_suppkey + 30) END AS name FROM supplier)
      SELECT s_suppkey, regexp_full_match(name, '[A-Za-z0-9._-]{1,128}') AND name NOT IN ('.', '..') AS safe FROM s""",
    "sha256_admission": """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), m AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN h WHEN 1 THEN upper(h) ELSE left(h, 63) END AS h FROM d)
      SELECT doc_id, h, regexp_full_match(h, '[0-9a-f]{64}') AS ok FROM m""",
    "dictionary_admission": f"WITH {_CHARS} SELECT lang, len(symbols) AS n, len(symbols) > 0 AS ok, NOT list_contains(all_symbols, ' ') AS with_space_ok FROM dicts",
    "dictionary_digest": f"""WITH {_CHARS} SELECT lang, sha256(unhex(hex(encode('{A.DICTIONARY_TAG}')) || '00' || array_to_string(list_transform(symbols, lambda s: lpad(hex(octet_length(encode(s))), 8, '0') || hex(encode(s))), ''))) AS digest FROM dicts""",
    "detector_shapes": """WITH d AS (SELECT doc_id, (n_chars % 3000)::INTEGER + 1 AS w, (doc_id % 1500)::INTEGER + 1 AS h FROM documents),
      p AS (SELECT *, CASE WHEN w + h < 64 THEN greatest(w, 32) ELSE w END AS pw, CASE WHEN w + h < 64 THEN greatest(h, 32) ELSE h END AS ph FROM d),
      l AS (SELECT *, CASE WHEN greatest(pw, ph) > 960 THEN pw * 960 // greatest(pw, ph) ELSE pw END AS lw, CASE WHEN greatest(pw, ph) > 960 THEN ph * 960 // greatest(pw, ph) ELSE ph END AS lh FROM p),
      t AS (SELECT *, greatest(32, round_even((lw / 32.0)::DOUBLE, 0)::INTEGER * 32) AS tw, greatest(32, round_even((lh / 32.0)::DOUBLE, 0)::INTEGER * 32) AS th FROM l)
      SELECT doc_id, w, h, tw, th, (tw::FLOAT / pw::FLOAT)::FLOAT AS scale_x, (th::FLOAT / ph::FLOAT)::FLOAT AS scale_y FROM t""",
    "batch_all_or_nothing": f"""WITH c AS (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS bytes FROM conversations), e AS (SELECT *, CASE WHEN bytes = 0 THEN 'invalid_request' WHEN bytes > 1200 THEN 'invalid_image' END AS item_error FROM c),
      g AS (SELECT conv_id, count(*) AS n_items, sum(bytes)::BIGINT AS bytes, first(item_error ORDER BY turn, item_error) FILTER (item_error IS NOT NULL) AS first_error FROM e GROUP BY conv_id)
      SELECT conv_id, n_items, bytes, CASE WHEN n_items NOT BETWEEN 1 AND {schema.MAX_BATCH_ITEMS} THEN 'invalid_request' WHEN bytes > 4000 THEN 'invalid_request' ELSE first_error END AS error_code FROM g""",
}
