"""Serialised network graphs, one for each user's events: what is in them, and what is wrong with them."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import Contracts, operator_differences, outlet_differences, parts
from ..operators.graphs import Graphs, fields
from ..sources.shared import in_groups, limit_batches, new_folder


def varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def part(number: int, body: bytes | str) -> bytes:
    """A field of bytes, text or a message."""
    body = body.encode() if isinstance(body, str) else body
    return varint(number * 8 + 2) + varint(len(body)) + body


def numeral(number: int, n: int) -> bytes:
    return varint(number * 8) + varint(n)


def outlet(number: int, name: str, symbol: str, size: int) -> bytes:
    """An input or output: a tensor of element type 1 with a symbolic and a fixed dimension."""
    shape = part(1, part(2, symbol)) + part(1, numeral(1, size))
    return part(number, part(1, name) + part(2, part(1, numeral(1, 1) + part(2, shape))))


def model_of(user: int, events: list[dict]) -> bytes:
    """A model with a node for each event and a graph inside the node of each fifth; some can't be read, some are wrong."""
    nodes = []
    for e in events:
        n, made = e["event_id"], f"v{math.floor(e['value'])}"
        body = b""
        if n % 5 == 2:
            inner = part(1, part(1, made) + part(1, "i") + part(2, "y") + part(4, "Inner")) + outlet(11, "i" if n % 2 else "x", "n", 1) + outlet(12, "y", "n", 1)
            body = part(5, part(1, "body") + part(6, inner))
        nodes.append(part(1, part(1, f"v{e['k']}") + part(2, made) + part(4, e["event_type"]) + part(7, {0: "custom", 1: "ai.onnx"}.get(n % 40, "")) + body))
    graph = b"".join(nodes) + outlet(11, "x", "" if user % 11 == 5 else "batch", user % 4) + outlet(12, "v1", "n", 1)
    opset = part(8, numeral(2, 13))
    content = numeral(1, user % 9) + opset * (2 if user % 10 == 3 else 1) + part(7, graph)
    damage = user % 20
    return content[:-3] if damage == 7 else content + {9: numeral(9, 1), 11: part(25, ""), 15: part(2, "p" * 5000)}.get(damage, b"")


def generated_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_id, content: a model for each user, of the user's events."""

    def write(batches):
        # One model's events at a time are Python objects.
        ids = ((u, e) for batch in batches for u, e in zip(batch.column(0), batch.column(1), strict=True))
        for group in in_groups((u.as_py(), model_of(u.as_py(), e.as_py())) for u, e in ids):
            users, made = zip(*group, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(users, pa.int64()), pa.array(made, pa.binary())], ["model_id", "content"])

    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null")
    # A model is one file of at most 16 MB: its nodes are together anyway.
    event = F.struct("event_id", "event_type", "value", F.get_json_object("props", "$.k").alias("k"))
    limit_batches(spark)
    d = e.groupBy(F.col("user_id").cast("bigint").alias("model_id")).agg(F.array_sort(F.collect_list(event)).alias("events"))
    return d.mapInArrow(write, "model_id bigint, content binary")


def _written(rows: DataFrame, name: str) -> DataFrame:
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _graphs(spark: SparkSession, sf_dir: str) -> Graphs:
    return Graphs(_written(fields(generated_models(spark, sf_dir)), "graph-fields"))


def _contracts(spark: SparkSession, sf_dir: str) -> Contracts:
    return Contracts(_written(parts(generated_contracts(spark, sf_dir)), "contract-parts"))


def graph_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators of all graphs of each model that can be read."""
    return _graphs(spark, sf_dir).operators()


def graph_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each model breaks each rule; what can't be read breaks the rule wire."""
    g = _graphs(spark, sf_dir)
    unread = g.errors.select("model_id", F.lit("wire").alias("rule"), "error_code")
    return g.violations().select("model_id", "rule", "error_code").unionByName(unread).groupBy("model_id", "rule", "error_code").agg(F.count("*").alias("n"))


def graph_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that nodes use and nothing visible defines, and names of outer graphs that inner ones define again."""
    g = _graphs(spark, sf_dir)
    # Both read it, shadowed() twice.
    defined = _written(g.defined(), "graph-defined")
    undefined = g.undefined_inputs(defined).select("model_id", F.lit("undefined").alias("what"), "name")
    shadowed = g.shadowed(defined).select("model_id", F.lit("shadowed").alias("what"), "name")
    return undefined.unionByName(shadowed).groupBy("model_id", "what", "name").agg(F.count("*").alias("n"))


def graph_outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs and outputs of each model by position, with their dimensions."""
    dims = F.array_join(F.transform("dimensions", lambda z: F.coalesce(F.concat(F.lit("#"), z["number"].cast("string")), z["symbol"])), ",")
    return _graphs(spark, sf_dir).outlets().select("model_id", "role", "position", "name", "element_type", "rank", dims.alias("dimensions"))


def generated_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_id, value: a contract document for each user, of the graph that ``generated_models`` makes; by user_id % 7 some have a fault."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null")
    domain = F.when(F.col("event_id") % 40 == 0, "custom").when(F.col("event_id") % 40 == 1, "ai.onnx").otherwise("")
    ops = e.select("user_id", domain.alias("domain"), F.col("event_type").alias("op_type")).unionByName(e.where("event_id % 5 = 2").select("user_id", F.lit("").alias("domain"), F.lit("Inner").alias("op_type")))
    ops = ops.groupBy("user_id", "domain", "op_type").agg(F.count("*").alias("count"))
    d = ops.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("domain", "op_type", "count"))).alias("o"))
    u, fault = F.col("user_id"), F.col("user_id") % 7
    changed = F.expr("transform(o, (z, k) -> named_struct('domain', z.domain, 'op_type', z.op_type, 'count', z.count + if(k = 0, 1, 0)))")
    operators = F.when(fault == 2, F.expr("slice(o, 1, size(o) - 1)")).when(fault == 3, changed).when(fault == 4, F.reverse("o")).otherwise(F.col("o"))
    # Dimensions are numbers and texts side by side: written as text.
    ends = lambda name, symbol, size: F.concat(F.lit(f'[{{"name":"{name}","element_type":1,"dimensions":['), F.lit('"'), symbol, F.lit('",'), size.cast("string"), F.lit("]}]"))
    inputs = ends("x", F.when(u % 11 == 5, "").when(u % 11 == 6, "rows").otherwise("batch"), F.when(u % 13 == 1, 9).otherwise(u % 4))
    value = F.concat(
        F.when(fault == 6, "{").otherwise('{"role":"detector",'),
        F.when(fault == 5, '"comment":null,').otherwise(""),
        F.lit('"schema_version":1,"contract_id":"user-'), u.cast("string"),
        F.lit('","qualification":"qualified","artifact_sha256":"'), F.sha2(u.cast("string"), 256),
        F.lit('","artifact_byte_length":'), F.when(fault == 1, F.lit('"9"')).otherwise(F.lit("9")),
        F.lit(',"ir_version":'), (u % 9).cast("string"),
        F.lit(',"opsets":[{"domain":"","version":13}],"inputs":'), inputs,
        F.lit(',"outputs":'), ends("v1", F.lit("n"), F.lit(1)),
        F.lit(',"operators":'), F.to_json(operators), F.lit("}"),
    )
    return d.select(u.alias("model_id"), F.when(u % 17 == 3, F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value).alias("value"))


def contract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each contract document, by path."""
    return _contracts(spark, sf_dir).violations()


def contract_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators that a contract and its graph don't have as often, both ways; for models that both can be read."""
    c, g = _contracts(spark, sf_dir), _graphs(spark, sf_dir)
    readable = g.models().select("model_id").intersect(c.readable())
    declared = c.texts().where("list = 'operators'").select("model_id", "domain", F.col("name").alias("op_type"), F.col("number").alias("n"))
    return operator_differences(declared.join(readable, "model_id", "left_semi"), g.operators().join(readable, "model_id", "left_semi"))


def contract_outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs and outputs in which a graph isn't what its contract says, by position."""
    c, g = _contracts(spark, sf_dir), _graphs(spark, sf_dir)
    readable = g.models().select("model_id").intersect(c.readable())
    wanted = c.texts().where("list in ('inputs', 'outputs')").select("model_id", F.regexp_replace("list", "s$", "").alias("role"), F.col("item").alias("position"), "name", "element_type", "dimensions")
    found = g.outlets().select("model_id", "role", "position", "name", "element_type", "dimensions")
    return outlet_differences(wanted.join(readable, "model_id", "left_semi"), found.join(readable, "model_id", "left_semi"))


QUERIES = {f.__name__: f for f in (graph_operators, graph_violations, graph_names, graph_outlets, contract_documents, contract_operators, contract_outlets)}

_SQL = """e AS (SELECT event_id, user_id AS model_id, event_type, 'v' || floor(value)::BIGINT AS made, 'v' || json_extract_string(props, '$.k') AS used,
    CASE event_id % 40 WHEN 0 THEN 'custom' WHEN 1 THEN 'ai.onnx' ELSE '' END AS domain, event_id % 5 = 2 AS nested, event_id % 2 = 0 AS even FROM events WHERE user_id IS NOT NULL AND user_id % 20 NOT IN (7, 9, 11, 15)),
  m AS (SELECT DISTINCT model_id FROM e)"""

_ALL = """a AS (SELECT event_id, user_id AS model_id, event_type, CASE event_id % 40 WHEN 0 THEN 'custom' WHEN 1 THEN 'ai.onnx' ELSE '' END AS domain FROM events WHERE user_id IS NOT NULL),
  ops AS (SELECT model_id, domain, event_type AS op_type FROM a UNION ALL SELECT model_id, '', 'Inner' FROM a WHERE event_id % 5 = 2)"""

QUERIES_SQL = {
    "graph_operators": f"""WITH {_SQL} SELECT model_id, domain, event_type AS op_type, count(*) AS n FROM e GROUP BY ALL
      UNION ALL SELECT model_id, '', 'Inner', count(*) FROM e WHERE nested GROUP BY ALL""",
    "graph_violations": f"""WITH {_SQL} SELECT model_id, rule, error_code, count(*) AS n FROM (
        SELECT model_id, 'ir_version' AS rule, 'malformed_model' AS error_code FROM m WHERE model_id % 9 = 0
        UNION ALL SELECT model_id, 'repeated_opset', 'unsupported_model' FROM m WHERE model_id % 10 = 3
        UNION ALL SELECT model_id, 'dimension', 'malformed_model' FROM m WHERE model_id % 11 = 5
        UNION ALL SELECT model_id, 'operator', 'unsupported_model' FROM e WHERE domain = 'custom'
        UNION ALL SELECT model_id, 'repeated_output', 'malformed_model' FROM (SELECT model_id, made FROM e GROUP BY ALL HAVING count(*) > 1)
        UNION ALL SELECT DISTINCT user_id, 'wire', CASE user_id % 20 WHEN 7 THEN 'malformed_model' WHEN 15 THEN 'limit_exceeded' ELSE 'unsupported_model' END FROM events WHERE user_id % 20 IN (7, 9, 11, 15)
      ) GROUP BY ALL""",
    "graph_names": f"""WITH {_SQL}, outer_names AS (SELECT model_id, made AS name FROM e UNION SELECT model_id, 'x' FROM m)
      SELECT model_id, what, name, count(*) AS n FROM (
        SELECT model_id, 'undefined' AS what, used AS name FROM e ANTI JOIN outer_names o ON o.model_id = e.model_id AND o.name = e.used
        UNION ALL SELECT model_id, 'undefined', 'i' FROM e WHERE nested AND even
        UNION ALL SELECT model_id, 'shadowed', 'x' FROM e WHERE nested AND even
      ) GROUP BY ALL""",
    "graph_outlets": f"""WITH {_SQL} SELECT model_id, 'input' AS role, 0 AS position, 'x' AS name, 1::BIGINT AS element_type, 2 AS rank, CASE WHEN model_id % 11 = 5 THEN '' ELSE 'batch' END || ',#' || model_id % 4 AS dimensions FROM m
      UNION ALL SELECT model_id, 'output', 0, 'v1', 1, 2, 'n,#1' FROM m""",
    "contract_documents": f"""WITH {_ALL}, o AS (SELECT model_id, domain, op_type, count(*) AS n FROM ops GROUP BY ALL),
      k AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY domain, op_type) - 1 AS up, row_number() OVER (PARTITION BY model_id ORDER BY domain DESC, op_type DESC) - 1 AS down FROM o),
      placed AS (SELECT *, CASE WHEN model_id % 7 = 4 THEN down ELSE up END AS item FROM k WHERE model_id % 17 <> 3 AND (model_id % 7 <> 2 OR down > 0)),
      u AS (SELECT DISTINCT model_id FROM o)
      SELECT model_id, 'operators[' || item || '].domain' AS path, 'value' AS rule FROM placed WHERE domain = 'custom'
      UNION ALL SELECT model_id, 'operators[' || item || ']', 'order' FROM placed WHERE model_id % 7 = 4 AND item > 0
      UNION ALL SELECT model_id, '', 'no_object' FROM u WHERE model_id % 17 = 3
      UNION ALL SELECT u.model_id, path, rule FROM u JOIN (VALUES (5, 'comment', 'unknown_field'), (6, 'role', 'missing_field'), (1, 'artifact_byte_length', 'type')) f(fault, path, rule) ON u.model_id % 7 = fault WHERE model_id % 17 <> 3
      UNION ALL SELECT model_id, 'inputs[0].dimensions', 'value' FROM u WHERE model_id % 11 = 5 AND model_id % 17 <> 3
      UNION ALL SELECT model_id, 'ir_version', 'incomplete' FROM u WHERE model_id % 9 = 0 AND model_id % 17 <> 3
      UNION ALL SELECT u.model_id, 'operators', 'incomplete' FROM u ANTI JOIN placed p ON p.model_id = u.model_id WHERE u.model_id % 17 <> 3""",
    "contract_operators": f"""WITH {_ALL}, o AS (SELECT model_id, domain, op_type, count(*) AS n FROM ops GROUP BY ALL),
      k AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY domain, op_type) AS up, row_number() OVER (PARTITION BY model_id ORDER BY domain DESC, op_type DESC) AS down FROM o WHERE model_id % 17 <> 3 AND model_id % 20 NOT IN (7, 9, 11, 15))
      SELECT model_id, domain, op_type, CASE WHEN model_id % 7 = 3 THEN n + 1 END AS declared, n AS measured FROM k WHERE (model_id % 7 = 2 AND down = 1) OR (model_id % 7 = 3 AND up = 1)""",
    "contract_outlets": f"""WITH {_ALL} SELECT DISTINCT model_id, 'input' AS role, 0 AS position, 'dimensions' AS reason FROM ops
      WHERE model_id % 17 <> 3 AND model_id % 20 NOT IN (7, 9, 11, 15) AND (model_id % 11 = 6 OR model_id % 13 = 1)""",
}
