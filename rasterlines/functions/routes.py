"""Where requests by method and path go, and the answers to those that go nowhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema

# Method, path and target of each route.
ROUTES = [
    ("GET", "/health/live", "live"),
    ("GET", "/health/ready", "ready"),
    ("GET", "/metrics", "metrics"),
    ("GET", "/v1/status", "status"),
    ("GET", "/v1/capabilities", "capabilities"),
    ("GET", "/v1/models", "models"),
    ("POST", "/v1/ocr", "recognize_json"),
    ("POST", "/v1/ocr:raw", "recognize_raw"),
    ("POST", "/v1/ocr:batch", "recognize_batch"),
    ("POST", "/mcp", "rpc"),
]
# Element types of tensors by their number, from 1.
ELEMENT_TYPES = (
    "float32", "uint8", "int8", "uint16", "int16", "int32", "int64", "string", "bool", "float16", "float64", "uint32", "uint64", "complex64", "complex128",
    "bfloat16", "float8e4m3fn", "float8e4m3fnuz", "float8e5m2", "float8e5m2fnuz", "uint4", "int4",
)


def element_type(number: Column) -> Column:
    """The name of an element type; null for a number that isn't one."""
    return F.get(F.array(*map(F.lit, ELEMENT_TYPES)), (number - 1).cast("int"))


def error_body(code: Column, message: Column, request_id: Column) -> Column:
    return F.to_json(F.struct(F.struct(code.alias("code"), message.alias("message")).alias("error"), request_id.alias("request_id")))


def routed(requests: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """The columns of ``requests`` and target, status, error_code, body.

    ``requests`` has request_id (long), method, path and length (bytes).  A path
    that isn't there is 404, another method at a path 405, a body of more than the
    target's limit 413; HEAD goes where GET goes.  target and null elsewhere stand for a
    request that is to be done.  Null methods, paths and lengths: the path isn't
    there, another method, no body.
    """
    c = F.col
    rows = [(m, p, t, (limits or {}).get(t)) for m, p, t in ROUTES]
    table = F.broadcast(requests.sparkSession.createDataFrame(rows, "_method string, _path string, target string, _most bigint"))  # a row for each route
    d = requests.join(table, c("path") == c("_path"), "left")
    method = F.when(c("method") == "HEAD", "GET").otherwise(c("method"))
    status = F.when(c("_path").isNull(), 404).when(~F.coalesce(method == c("_method"), F.lit(False)), 405).when(F.coalesce(c("length") > c("_most"), F.lit(False)), 413)
    d = d.withColumn("status", status).withColumn("error_code", F.when(c("status").isNotNull(), "invalid_request"))
    body = F.when(c("status").isNotNull(), error_body(c("error_code"), F.lit(schema.MESSAGES["invalid_request"]), c("request_id")))
    return d.withColumn("body", body).withColumn("target", F.when(c("status").isNull(), c("target"))).drop("_method", "_path", "_most")
