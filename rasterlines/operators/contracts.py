"""Contract documents: what a graph is said to be, checked as a document and against what the graph is.

A document is strict JSON.  Its fields are rows: ``variant_explode`` gives each
object's keys with the path they stand at, so unknown, missing and wrongly typed
fields are named, item by item, instead of failing or being passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.checks import broken, union
from .graphs import MAX_MODEL_BYTES, MAX_NODES, MAX_RANK, MAX_TEXT_BYTES, STANDARD_DOMAINS, Graphs

# Limits of a document.
MAX_CONTRACT_BYTES = 64 * 1024
MAX_OPSETS = 64
MAX_OUTLETS = 128
# The fields of a document and of the items of its lists; int, text or list; ? for those that may be left out or null.
SPEC = {
    "": "schema_version:int contract_id:text role:text qualification:text artifact_sha256:text artifact_byte_length:int ir_version:int? opsets:list inputs:list outputs:list operators:list",
    "opsets": "domain:text version:int",
    "inputs": "name:text element_type:int? dimensions:list?",
    "outputs": "name:text element_type:int? dimensions:list?",
    "operators": "domain:text op_type:text count:int",
}
# What role and qualification may be.
ROLES = ("detector", "english_recognizer")
QUALIFICATIONS = ("provisional", "qualified")
_DIMENSIONS = "array<struct<number:bigint,symbol:string>>"
_LISTS = ("opsets", "inputs", "outputs", "operators")
_MOST = {"opsets": MAX_OPSETS, "inputs": MAX_OUTLETS, "outputs": MAX_OUTLETS, "operators": MAX_NODES}


def _exploded(d: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """``keep``, and pos, key and value of each element of a variant."""
    each = d.sparkSession.tvf.variant_explode(F.col("_v").outer())
    return d.select(*keep, F.col(column).alias("_v")).lateralJoin(each).select(*keep, "pos", "key", "value")


def _kind(value) -> Column:
    """int, text, list, object or null, or Spark's name of another type."""
    t = F.schema_of_variant(value)
    return F.when(t == "BIGINT", "int").when(t == "STRING", "text").when(t.startswith("ARRAY"), "list").when(t.startswith("OBJECT"), "object").when(t == "VOID", "null").otherwise(t)


def _spec(d: DataFrame) -> DataFrame:
    rows = [(part, *entry.rstrip("?").split(":"), entry.endswith("?")) for part, entries in SPEC.items() for entry in entries.split()]
    return F.broadcast(d.sparkSession.createDataFrame(rows, "list string, key string, wanted string, optional boolean"))  # a row for each field of SPEC


def parts(documents: DataFrame) -> DataFrame:
    """model_id, list, item, key, kind, number, text, dimensions, octets: the objects and fields of documents (model_id, value).

    The document itself has no list and item -1, an item of a list its place from
    0; a row without key stands for the object, with its size in bytes where it is
    a document.  number, text and dimensions (number or symbol) are of ints, texts and lists.
    model_ids are distinct; a null value is no JSON; other columns are ignored.
    """
    d = documents.select(F.col("model_id").cast("bigint"), F.lit("").alias("list"), F.lit(-1).alias("item"), F.octet_length("value").alias("octets"), F.try_parse_json("value").alias("value"))
    d = d.withColumn("kind", F.coalesce(_kind("value"), F.lit("none")))
    at = ["model_id", "list", "item"]
    top = _exploded(d.where("kind = 'object'"), "value", at)
    lists = top.where(F.col("key").isin(*_LISTS) & (_kind("value") == "list")).select("model_id", F.col("key").alias("list"), "value")
    items = _exploded(lists, "value", ["model_id", "list"]).select("model_id", "list", F.col("pos").alias("item"), "value", _kind("value").alias("kind"))
    inner = _exploded(items.where("kind = 'object'"), "value", at)
    whole = lambda rows, octets: rows.select(*at, F.lit(None).cast("string").alias("key"), "kind", F.lit(None).cast("bigint").alias("number"), F.lit(None).cast("string").alias("text"), F.lit(None).cast(_DIMENSIONS).alias("dimensions"), octets.cast("int").alias("octets"))
    number, text = (lambda x: F.when(_kind(x) == "int", F.try_variant_get(x, "$", "bigint"))), (lambda x: F.when(_kind(x) == "text", F.try_variant_get(x, "$", "string")))
    each = F.transform(F.try_variant_get("value", "$", "array<variant>"), lambda x: F.struct(number(x).alias("number"), text(x).alias("symbol")))
    dimensions = F.when((F.col("key") == "dimensions") & (F.col("list") != "") & (_kind("value") == "list"), each)
    fields = top.unionByName(inner).select(*at, "key", _kind("value").alias("kind"), number(F.col("value")).alias("number"), text(F.col("value")).alias("text"), dimensions.cast(_DIMENSIONS).alias("dimensions"), F.lit(None).cast("int").alias("octets"))
    return whole(d, F.col("octets")).unionByName(whole(items, F.lit(None))).unionByName(fields)


class Contracts:
    """Documents by their ``parts``, written by the caller."""

    def __init__(self, rows: DataFrame):
        self.documents = rows.where("key is null and item = -1")
        self.objects = rows.where("key is null and kind = 'object'").select("model_id", "list", "item")
        self.items = rows.where("key is null and item >= 0")
        self.fields = rows.where("key is not null")

    def readable(self) -> DataFrame:
        """model_id of the documents that are JSON objects."""
        return self.objects.where("item = -1").select("model_id")

    def texts(self) -> DataFrame:
        """model_id, list, item, domain, name (op_type or name), number (version or count), element_type, dimensions of the items of lists.

        Fields of other types than SPEC's are null.
        """
        at = lambda key, column: F.max_by(column, F.when(F.col("key") == key, 1))
        return self.fields.where("list <> ''").groupBy("model_id", "list", "item").agg(
            at("domain", "text").alias("domain"),
            F.coalesce(at("op_type", "text"), at("name", "text")).alias("name"),
            F.coalesce(at("version", "number"), at("count", "number")).alias("number"),
            at("element_type", "number").alias("element_type"),
            at("dimensions", "dimensions").alias("dimensions"),
        )

    def tops(self) -> DataFrame:
        """A row for each document with its single fields; those of other types than SPEC's are null."""
        single = [entry.rstrip("?").split(":") for entry in SPEC[""].split() if ":list" not in entry]
        top = self.fields.where("list = ''")
        return top.groupBy("model_id").agg(*(F.max_by("number" if kind == "int" else "text", F.when(F.col("key") == key, 1)).alias(key) for key, kind in single))

    def violations(self) -> DataFrame:
        """model_id, path, rule: a row for each thing wrong with a document."""
        c, text = F.col, F.lit
        at_item = F.concat("list", text("["), c("item").cast("string"), text("]"))
        in_item = lambda key: F.concat(at_item, text(f".{key}"))
        where = F.concat(F.when(c("list") == "", text("")).otherwise(F.concat(at_item, text("."))), c("key"))
        says = lambda rule, path: {"path": path, "rule": text(rule)}
        one = ["model_id"]
        d = self.documents
        size = ~F.coalesce(c("octets").between(1, MAX_CONTRACT_BYTES), F.lit(False))
        found = [broken(d, one, [(size, says("size", text(""))), (c("kind") != "object", says("no_object", text("")))])]
        t = self.fields.join(_spec(d), ["list", "key"], "left")
        kind = c("wanted").isNotNull() & (c("kind") != c("wanted")) & ~(c("optional") & (c("kind") == "null"))
        found.append(broken(t, one, [(c("wanted").isNull(), says("unknown_field", where)), (kind, says("type", where))]))
        found.append(broken(self.items, one, [(c("kind") != "object", says("type", at_item))]))
        needed = self.objects.join(_spec(d).where("not optional"), "list").join(self.fields, ["model_id", "list", "item", "key"], "left_anti")
        found.append(broken(needed, one, [(F.lit(True), says("missing_field", where))]))

        qualified = c("qualification") == "qualified"
        fine = {
            "schema_version": c("schema_version") == 1,
            "contract_id": F.octet_length("contract_id").between(1, MAX_TEXT_BYTES),
            "role": c("role").isin(*ROLES),
            "qualification": c("qualification").isin(*QUALIFICATIONS),
            "artifact_sha256": c("artifact_sha256").rlike(r"\A[0-9a-f]{64}\z"),
            "artifact_byte_length": c("artifact_byte_length").between(1, MAX_MODEL_BYTES),
        }
        top = self.tops()
        incomplete = (qualified & ~F.coalesce(c("ir_version") > 0, F.lit(False)), says("incomplete", text("ir_version")))
        found.append(broken(top, one, [*((~ok, says("value", text(key))) for key, ok in fine.items()), incomplete]))

        # The items of a list in their order, with what comes before and how long the list is.
        order = Window.partitionBy("model_id", "list").orderBy("item")
        tensor, named = c("list").isin("inputs", "outputs"), F.octet_length("name").between(1, MAX_TEXT_BYTES)
        key = F.struct("domain", F.coalesce("name", text("")).alias("name"), "number")
        same = Window.partitionBy("model_id", "list", F.when(tensor, text("")).otherwise(c("domain")), F.when(c("list") == "opsets", text("")).otherwise(c("name"))).orderBy("item")
        x = self.texts().withColumns({"_before": F.lag(key).over(order), "_same": F.row_number().over(same)})
        x = x.join(top.select("model_id", qualified.alias("_qualified")), "model_id", "left")
        bad = F.exists("dimensions", lambda z: ~F.coalesce((z["number"] >= 0) | F.octet_length(z["symbol"]).between(1, MAX_TEXT_BYTES), F.lit(False))) | (F.size("dimensions") > MAX_RANK)
        operator, whole = c("list") == "operators", (tensor | c("domain").isNotNull()) & ((c("list") == "opsets") | c("name").isNotNull())
        checks = {
            "domain": ~c("domain").isin(*STANDARD_DOMAINS),
            "op_type": operator & ~named,
            "name": tensor & ~named,
            "version": (c("list") == "opsets") & (c("number") <= 0),
            "count": operator & ~c("number").between(1, MAX_NODES),
            "element_type": tensor & (c("element_type") <= 0),
            "dimensions": tensor & bad,
        }
        most = F.create_map(*(F.lit(v) for pair in _MOST.items() for v in pair))
        more = [
            (~tensor & c("_before").isNotNull() & ~(c("_before") < key), says("order", at_item)),
            ((c("_same") > 1) & whole, says("repeated", at_item)),
            (c("item") == most[c("list")], says("length", c("list"))),
            (tensor & c("_qualified") & (c("element_type").isNull() | c("dimensions").isNull()), says("incomplete", at_item)),
        ]
        found.append(broken(x, one, [*((bad, says("value", in_item(key))) for key, bad in checks.items()), *more]))
        # What is said to be qualified has an item in every list.
        wanted = top.where(qualified).select("model_id", F.explode(F.array(*map(F.lit, _LISTS))).alias("list"))
        found.append(broken(wanted.join(self.items, ["model_id", "list"], "left_anti"), one, [(F.lit(True), says("incomplete", c("list")))]))
        return union(found)


def operator_differences(declared: DataFrame, measured: DataFrame) -> DataFrame:
    """model_id, domain, op_type, declared, measured: operators of which the two tables (model_id, domain, op_type, n) don't have as many.

    A side without the operator is null; null names match each other.
    """
    names = ("model_id", "domain", "op_type")
    said = declared.select(*(F.col(c).alias(f"_{c}") for c in names), F.col("n").alias("declared"))
    seen = measured.select(*names, F.col("n").alias("measured"))
    both = said.join(seen, [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in names], "full_outer")
    return both.where(~F.col("declared").eqNullSafe(F.col("measured"))).select(*(F.coalesce(f"_{c}", c).alias(c) for c in names), "declared", "measured")


def dimension_matches(number: Column, symbol: Column, wanted: Column) -> Column:
    """Whether a session's dimension (number, -1 with a symbol) is what a contract wants: its number exactly, or for a symbol the same or any positive number."""
    plain = F.coalesce(symbol, F.lit("")) == ""
    fixed = plain & (number == wanted["number"])
    free = ((number == -1) & symbol.eqNullSafe(wanted["symbol"])) | ((number > 0) & plain)
    return F.coalesce(F.when(wanted["number"].isNotNull(), fixed).otherwise(free), F.lit(False))


def outlet_differences(wanted: DataFrame, found: DataFrame, exact: bool = False) -> DataFrame:
    """model_id, role, position, reason: outlets that don't agree, by position.

    Both tables have model_id, role, position, name, element_type, dimensions
    (number, symbol); reasons are missing, extra, name, element_type, rank, dimensions.
    A session's dimensions may be narrower than a contract's symbols; with ``exact`` they are the same.
    """
    names, values = ("model_id", "role", "position"), ("name", "element_type", "dimensions")
    w = wanted.select(*(F.col(c).alias(f"_{c}") for c in (*names, *values)), F.lit(1).alias("_there"))
    f = found.select(*names, *values, F.lit(1).alias("there"))
    both = w.join(f, [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in names], "full_outer")
    actual = F.transform("dimensions", lambda z: F.struct(F.when(z["symbol"].isNotNull(), F.lit(-1)).otherwise(z["number"]).alias("number"), z["symbol"].alias("symbol")))
    alike = lambda a, b: a["number"].eqNullSafe(b["number"]) & a["symbol"].eqNullSafe(b["symbol"])
    paired = F.zip_with("dimensions", "_dimensions", alike) if exact else F.zip_with(actual, "_dimensions", lambda a, b: dimension_matches(a["number"], a["symbol"], b))
    same = lambda c: F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False))
    reason = (
        F.when(F.col("there").isNull(), "missing")
        .when(F.col("_there").isNull(), "extra")
        .when(~same("name"), "name")
        .when(~same("element_type"), "element_type")
        .when(~F.coalesce(F.size("dimensions") == F.size("_dimensions"), F.lit(False)) | F.col("_dimensions").isNull(), "rank")
        .when(~F.forall(paired, lambda x: x), "dimensions")
    )
    return both.select(*(F.coalesce(f"_{c}", c).alias(c) for c in names), reason.alias("reason")).where("reason is not null")


def admission(models: DataFrame, contracts: Contracts, graphs: Graphs) -> DataFrame:
    """model_id, error_code of each model (model_id, content): null where a qualified contract says exactly what it is.

    In this order: ``invalid_contract`` (none, or one with violations),
    ``provisional_contract``, ``contract_mismatch`` of size or digest, the graph's
    error (of several the first in alphabetical order), ``contract_mismatch`` of
    version, operator sets, inputs, outputs or operators.  model_ids are distinct.
    """
    top = contracts.tops()
    broken_ones = contracts.violations().select("model_id").distinct().withColumn("_broken", F.lit(True))
    graph_errors = graphs.errors.unionByName(graphs.violations().select("model_id", "error_code")).groupBy("model_id").agg(F.min("error_code").alias("_graph"))
    texts = contracts.texts()
    part = lambda *lists: texts.where(F.col("list").isin(*lists))
    opsets = operator_differences(part("opsets").select("model_id", "domain", F.lit("").alias("op_type"), F.col("number").alias("n")), graphs.opsets().select("model_id", "domain", F.lit("").alias("op_type"), F.col("version").alias("n")))
    operators = operator_differences(part("operators").select("model_id", "domain", F.col("name").alias("op_type"), F.col("number").alias("n")), graphs.operators())
    wanted = part("inputs", "outputs").select("model_id", F.regexp_replace("list", "s$", "").alias("role"), F.col("item").alias("position"), "name", "element_type", "dimensions")
    outlets = outlet_differences(wanted, graphs.outlets().drop("rank"), exact=True)
    versions = top.join(graphs.models().select("model_id", F.col("ir_version").alias("_ir")), "model_id").where(~F.col("ir_version").eqNullSafe(F.col("_ir")))
    differing = union([d.select("model_id") for d in (opsets, operators, outlets, versions)]).distinct().withColumn("_differs", F.lit(True))
    facts = models.select(F.col("model_id").cast("bigint"), F.octet_length("content").alias("_size"), F.sha2("content", 256).alias("_digest"))
    d = facts.join(top, "model_id", "left").join(broken_ones, "model_id", "left").join(graph_errors, "model_id", "left").join(differing, "model_id", "left")
    same = F.coalesce((F.col("_size") == F.col("artifact_byte_length")) & (F.col("_digest") == F.col("artifact_sha256")), F.lit(False))
    code = (
        F.when(F.col("_broken") | F.col("contract_id").isNull(), "invalid_contract")
        .when(F.col("qualification") != "qualified", "provisional_contract")
        .when(~same, "contract_mismatch")
        .when(F.col("_graph").isNotNull(), F.col("_graph"))
        .when(F.col("_differs"), "contract_mismatch")
    )
    return d.select("model_id", code.alias("error_code"))
