"""JSON-RPC requests as columns: what is valid, where it goes, and what is answered at once.

A request is parsed into a variant, whose parts have types of their own: an id
may be left out, null, a text or a number, and comes back as it was.  An object
that names a field twice is no JSON here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tools by name in the order of their listing, and error numbers.
TOOLS = ("ocr_recognize", "ocr_batch", "ocr_capabilities", "ocr_models")
PARSE_ERROR, INVALID_REQUEST, NO_METHOD, INVALID_PARAMS, FAILED = -32700, -32600, -32601, -32602, -32003
# Fixed value: version of the protocol that is answered.
PROTOCOL = "2025-03-26"


def _kind(v: Column) -> Column:
    """Spark's name of a variant's type; null where there is none."""
    return F.schema_of_variant(v)


def error_envelope(correlation: Column, code: Column, message: Column, request_id: Column) -> Column:
    """The answer to a failed call; ``correlation`` is JSON text."""
    q = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    return F.concat(F.lit('{"jsonrpc":"2.0","id":'), correlation, F.lit(',"error":{"code":'), code.cast("string"), F.lit(',"message":'), q(message), F.lit(',"data":{"request_id":'), request_id.cast("string"), F.lit("}}}"))


def result_envelope(correlation: Column, structured: Column) -> Column:
    """The answer to a call that was done; both are JSON text."""
    return F.concat(F.lit('{"jsonrpc":"2.0","id":'), correlation, F.lit(',"result":{"content":[{"type":"text","text":"OCR operation completed"}],"structuredContent":'), structured, F.lit(',"isError":false}}'))


def routed(lines: DataFrame) -> DataFrame:
    """The columns of ``lines`` and correlation (the id as JSON text), silent (without an id), target, code, message, arguments.

    ``lines`` has request_id (long), value (text) and too_large (null: false); a null
    value is no JSON.  Targets are ``initialize``, ``tools/list``, ``notifications/initialized``
    and the tools; where there is an error code it is null.
    """
    c = F.col
    get = lambda v, path: F.try_variant_get(v, path, "variant")
    text = lambda v: F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))
    d = lines.withColumn("_v", F.try_parse_json("value"))
    is_object = F.coalesce(_kind(c("_v")).startswith("OBJECT"), F.lit(False))
    d = d.withColumns({"_id": F.when(is_object, get("_v", "$.id")), "_method": F.when(is_object, text(get("_v", "$.method"))), "_rpc": F.when(is_object, text(get("_v", "$.jsonrpc"))), "_params": F.when(is_object, get("_v", "$.params"))})
    id_kind = _kind(c("_id"))
    bad_id = id_kind.isNotNull() & ~(id_kind.isin("VOID", "STRING", "BIGINT", "DOUBLE", "FLOAT") | id_kind.startswith("DECIMAL"))
    invalid = bad_id | ~F.coalesce((c("_rpc") == "2.0") & c("_method").isNotNull(), F.lit(False))
    silent = id_kind.isNull()
    # Parameters of a call: a name, arguments, nothing else.
    keys = F.json_object_keys(F.to_json("_params"))
    name, arguments = text(get("_params", "$.name")), get("_params", "$.arguments")
    bad_params = ~F.coalesce(_kind(c("_params")).startswith("OBJECT") & name.isNotNull() & (F.size(F.array_except(keys, F.array(F.lit("name"), F.lit("arguments")))) == 0), F.lit(False))
    empty = F.coalesce(F.to_json(arguments) == "{}", F.lit(False))
    discovery = name.isin("ocr_capabilities", "ocr_models")
    unknown = ~F.coalesce(name.isin("ocr_recognize", "ocr_batch") | (discovery & empty), F.lit(False))
    call = c("_method") == "tools/call"
    known = c("_method").isin("initialize", "tools/list", "tools/call", "notifications/initialized")
    first = [
        (F.coalesce(c("too_large"), F.lit(False)), INVALID_REQUEST, "request too large"),
        (c("_v").isNull(), PARSE_ERROR, "parse error"),
        (invalid, INVALID_REQUEST, "invalid request"),
        ((c("_method") == "notifications/initialized") & ~silent, INVALID_REQUEST, "invalid request"),
        (~known, NO_METHOD, "method not found"),
        (call & bad_params, INVALID_PARAMS, "invalid params"),
        (call & unknown, INVALID_PARAMS, "unknown tool"),
    ]
    code = message = None
    for condition, number, words in first:
        code = F.when(condition, number) if code is None else code.when(condition, number)
        message = F.when(condition, words) if message is None else message.when(condition, words)
    no_id = F.coalesce(c("too_large"), F.lit(False)) | c("_v").isNull() | bad_id | ~F.coalesce((c("_rpc") == "2.0") & c("_method").isNotNull(), F.lit(False))
    d = d.withColumns({"correlation": F.when(no_id | silent, "null").otherwise(F.to_json("_id")), "silent": silent & ~no_id, "code": code, "message": message})
    target = F.when(c("code").isNull(), F.when(call, name).otherwise(c("_method")))
    d = d.withColumns({"target": target, "arguments": F.when(c("code").isNull() & call, F.to_json(arguments))})
    return d.drop("_v", "_id", "_method", "_rpc", "_params")


def answered(requests: DataFrame, server: str, version: str) -> DataFrame:
    """Adds ``answer`` to what ``routed`` gives: of errors, introductions and listings; null for calls that are still to be done and for silent requests.

    An error of a call's parameters has request 0.
    """
    c = F.col
    intro = F.concat(F.lit('{"jsonrpc":"2.0","id":'), "correlation", F.lit(f',"result":{{"protocolVersion":"{PROTOCOL}","capabilities":{{"tools":{{}}}},"serverInfo":{{"name":"{server}","version":"{version}"}}}}}}'))
    tools = ",".join(f'{{"name":"{t}"}}' for t in TOOLS)
    listing = F.concat(F.lit('{"jsonrpc":"2.0","id":'), "correlation", F.lit(f',"result":{{"tools":[{tools}]}}}}'))
    number = F.when(c("code") == INVALID_PARAMS, F.lit(0)).otherwise(c("request_id"))
    answer = F.when(c("code").isNotNull(), error_envelope(c("correlation"), c("code"), c("message"), number)).when(c("target") == "initialize", intro).when(c("target") == "tools/list", listing)
    return requests.withColumn("answer", F.when(~c("silent"), answer))
