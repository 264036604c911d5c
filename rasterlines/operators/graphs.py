"""Network graphs as tables: the fields of serialised models, and what their structure must hold.

``fields`` is the only stage that sees bytes: it walks the protobuf wire format of
a model under budgets and gives a row for each field, or one row with the error
that ends the walk.  Nodes, values, tensors, operator sets and every rule
over them are groupings and joins of these rows.

Error codes: ``malformed_model``, ``limit_exceeded``, ``unsupported_model``, ``model_too_large``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import broken, union
from ..sources.shared import BATCH_BYTES, limit_batches

# Budgets of one model.
MAX_MODEL_BYTES = 16 * 1024 * 1024
MAX_FIELDS = 250_000
MAX_DEPTH = 32
MAX_TEXT_BYTES = 4 * 1024
MAX_NODES = 8_192
MAX_ATTRIBUTES = 65_536
MAX_TENSORS = 16_384
MAX_VALUES = 65_536
MAX_RANK = 16
#: Fields in a batch at most, as Python objects; also held back of a model's walk until it is in Arrow.
BATCH_FIELDS = 1 << 13
# The domains of the standard operators.
STANDARD_DOMAINS = ("", "ai.onnx")

# The fields admitted in each message of the model format, by number.
# v: a varint; f: four bytes; d: eight bytes; b: bytes; t: bytes of bounded length; -: known and refused; a name: a message.
ADMITTED = """
model        1v 2t 3t 4t 5v 6t 7:graph 8:opset 14:pair 20- 25-
opset        1t 2v
graph        1:node 2t 5:tensor 10t 11:value 12:value 13:value 14:annotation 15:sparse 16:pair
node         1t 2t 3t 4t 5:attribute 6t 7t 8t 9:pair
attribute    1t 2f 3v 4t 5:tensor 6:graph 7bf 8bv 9t 10:tensor 11:graph 13t 14:type 15:type 20v 21t 22:sparse 23:sparse
tensor       1bv 2v 3:segment 4bf 5bv 6b 7bv 8t 9b 10bd 11bv 12t 13:pair 14v 16:pair
segment      1v 2v
sparse       1:tensor 2:tensor 3bv
value        1t 2:type 3t 4:pair
type         1:tensor_type 4:sequence 5:map 6t 8:tensor_type 9:optional
tensor_type  1v 2:shape
sequence     1:type
optional     1:type
map          1v 2:type
shape        1:dimension
dimension    1v 2t 3t
pair         1t 2t
annotation   1t 2:pair
"""

_WIRE = {"v": 0, "d": 1, "b": 2, "t": 2, "-": 2, "f": 5}
#: Fields whose bytes needn't be text.
_RAW = {("attribute", 4), ("attribute", 9)}


def _admitted() -> dict[tuple[str, int, int], str]:
    """(message, number, wire type) to a kind of ``_WIRE`` or the name of a message."""
    out = {}
    for line in ADMITTED.strip().splitlines():
        message, *entries = line.split()
        for entry in entries:
            number, _, child = entry.partition(":")
            if child:
                out[message, int(number), 2] = child
            else:
                digits = number.rstrip("vfdbt-")
                for kind in number[len(digits) :]:
                    out[message, int(digits), _WIRE[kind]] = kind
    return out


FIELD_KINDS = _admitted()
_PLAIN = frozenset(_WIRE)


class WireError(ValueError):
    """What ends a walk; its text is the error code."""


def _varint(content: bytes, at: int, end: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= end or shift > 63:
            raise WireError("malformed_model")
        byte = content[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            if value >> 64:
                raise WireError("malformed_model")
            return value, at
        shift += 7


def walk(content: bytes):
    """(message, instance, number, child instance, scope, value, text, size) of each field, in the order of the bytes.

    An instance is a message; instances are numbered as they begin.  A scope is
    the path of the graphs a message lies in, as ``/1/17/``.
    """
    if not content:
        raise WireError("malformed_model")
    if len(content) > MAX_MODEL_BYTES:
        raise WireError("model_too_large")
    made = fields = at = 0
    stack = [("model", 0, "/", len(content))]
    while stack:
        message, instance, scope, end = stack[-1]
        if at == end:
            stack.pop()
            continue
        fields += 1
        if fields > MAX_FIELDS:
            raise WireError("limit_exceeded")
        # Most keys, values and sizes are one byte.
        key, at = (content[at], at + 1) if content[at] < 0x80 else _varint(content, at, end)
        number, wire = key >> 3, key & 7
        if not 0 < number < 1 << 32:
            raise WireError("malformed_model")
        kind = FIELD_KINDS.get((message, number, wire))
        if kind is None:
            raise WireError("unsupported_model")
        value = text = size = child = None
        if wire == 0:
            value, at = (content[at], at + 1) if at < end and content[at] < 0x80 else _varint(content, at, end)
            value -= (value >> 63) << 64
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            at += size
        else:
            size, at = (content[at], at + 1) if at < end and content[at] < 0x80 else _varint(content, at, end)
        if wire and at + (size if wire == 2 else 0) > end:
            raise WireError("malformed_model")
        if wire == 2:
            if kind == "-":
                raise WireError("unsupported_model")
            if kind not in _PLAIN:
                if len(stack) > MAX_DEPTH:
                    raise WireError("limit_exceeded")
                made += 1
                child = made
                stack.append((kind, made, f"{scope}{made}/" if kind == "graph" else scope, at + size))
            else:
                if kind == "t":
                    if size > MAX_TEXT_BYTES:
                        raise WireError("limit_exceeded")
                    if (message, number) not in _RAW:
                        try:
                            text = content[at : at + size].decode()
                        except UnicodeDecodeError as e:
                            raise WireError("malformed_model") from e
                at += size
        yield message, instance, number, child, scope, value, text, size


_COLUMNS = [("model_id", pa.int64()), ("place", pa.int32()), ("message", pa.string()), ("instance", pa.int32()), ("number", pa.int32()), ("child", pa.int32()), ("scope", pa.string()), ("value", pa.int64()), ("text", pa.string()), ("size", pa.int32()), ("error_code", pa.string())]
FIELDS = "model_id bigint, place int, message string, instance int, number int, child int, scope string, value bigint, text string, size int, error_code string"


def fields(models: DataFrame) -> DataFrame:
    """A row for each field of each model (model_id, content), or one with an error_code for a model that can't be read.

    Null and empty contents are ``malformed_model``; null model_ids are one model;
    repeated rows are walked each; other columns are ignored.
    """

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), _COLUMNS, strict=True)], [n for n, _ in _COLUMNS])

    def run(batches):
        rows, size = [], 0  # of models walked to their end
        for batch in batches:
            for k in range(batch.num_rows):
                model, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or b""
                full, own = [], []  # of this model, whose rows count only if the walk ends well
                try:
                    for place, row in enumerate(walk(content)):
                        own.append((model, place, *row, None))
                        if len(own) >= BATCH_FIELDS:
                            full.append(table(own))
                            own = []
                except WireError as e:
                    full, own = [], [(model, *[None] * 9, str(e))]
                yield from full
                rows += own
                size += len(content)
                if len(rows) >= BATCH_FIELDS or size >= BATCH_BYTES:
                    if rows:
                        yield table(rows)
                    rows, size = [], 0
        if rows:
            yield table(rows)

    limit_batches(models.sparkSession)
    return models.select(F.col("model_id").cast("bigint"), F.col("content").cast("binary")).mapInArrow(run, FIELDS)


def _texts(number: int) -> Column:
    """The texts of a repeated field, in their order."""
    return F.array_sort(F.collect_list(F.when(F.col("number") == number, F.struct("place", "text"))))["text"]


def _last(number: int, column: str, default) -> Column:
    """A single field: the last one counts, its default stands for none."""
    return F.coalesce(F.max_by(column, F.when(F.col("number") == number, F.col("place"))), F.lit(default))


def _is(message: str) -> Column:
    """Whether a field is a message of this kind."""
    fit = F.lit(False)
    for (of, number, _), kind in FIELD_KINDS.items():
        if kind == message:
            fit = fit | ((F.col("message") == of) & (F.col("number") == number))
    return fit


def _instances(rows: DataFrame, message: str, **columns: Column) -> DataFrame:
    """A row for each message of a kind, with what its own fields give; those without any field are there, too."""
    own = rows.where(F.col("message") == message).groupBy("model_id", "instance").agg(*(c.alias(n) for n, c in columns.items()))
    heads = rows.where(_is(message)).select("model_id", F.col("child").alias("instance"), F.col("instance").alias("parent"), F.col("message").alias("of"), F.col("number").alias("as_field"), "place", "scope")
    return heads.join(own, ["model_id", "instance"], "left")


class Graphs:
    """The tables of the models whose bytes could be walked; ``rows`` is what ``fields`` gives, written by the caller.

    An instance without fields has nulls for them, which stand for the defaults.
    """

    def __init__(self, rows: DataFrame):
        self.errors = rows.where("error_code is not null").select("model_id", "error_code")
        self.rows = rows.where("error_code is null").drop("error_code")

    def models(self) -> DataFrame:
        """model_id, ir_version, n_opsets, n_graphs."""
        own = F.col("message") == "model"
        count = lambda number: F.count_if(own & (F.col("number") == number))
        return self.rows.groupBy("model_id").agg(F.coalesce(F.max_by("value", F.when(own & (F.col("number") == 1), F.col("place"))), F.lit(0)).alias("ir_version"), count(8).alias("n_opsets"), count(7).alias("n_graphs"))

    def opsets(self) -> DataFrame:
        """model_id, domain, version."""
        d = _instances(self.rows, "opset", domain=_last(1, "text", ""), version=_last(2, "value", 0))
        return d.select("model_id", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("version", F.lit(0)).alias("version"))

    def graphs(self) -> DataFrame:
        """model_id, scope, depth (0 for the model's own graph), n_inputs, n_outputs."""
        counts = {"n_inputs": F.count_if(F.col("number") == 11), "n_outputs": F.count_if(F.col("number") == 12)}
        d = _instances(self.rows, "graph", **counts)
        scope = F.concat("scope", "instance", F.lit("/"))
        return d.select("model_id", scope.alias("scope"), (F.size(F.split(scope, "/")) - 3).alias("depth"), *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))

    def nodes(self) -> DataFrame:
        """model_id, scope, node (instance), place, op_type, domain, overload, inputs, outputs."""
        d = _instances(self.rows, "node", inputs=_texts(1), outputs=_texts(2), op_type=_last(4, "text", ""), domain=_last(7, "text", ""), overload=_last(8, "text", ""))
        none = F.lit(None).cast("array<string>")
        named = [F.coalesce(c, F.lit("")).alias(c) for c in ("op_type", "domain", "overload")]
        return d.select("model_id", "scope", F.col("instance").alias("node"), "place", *named, *(F.coalesce(c, F.array().cast("array<string>"), none).alias(c) for c in ("inputs", "outputs")))

    def values(self) -> DataFrame:
        """model_id, scope, role (input, output, value), position, value (instance), name."""
        d = _instances(self.rows, "value", name=_last(1, "text", ""))
        role = F.when(F.col("as_field") == 11, "input").when(F.col("as_field") == 12, "output").otherwise("value")
        return d.select("model_id", "scope", role.alias("role"), F.col("place").alias("position"), F.col("instance").alias("value"), F.coalesce("name", F.lit("")).alias("name"))

    def tensors(self) -> DataFrame:
        """model_id, scope, tensor, of (message it is in), as_field, parent, name, external."""
        external = F.coalesce(F.bool_or((F.col("number") == 13) | ((F.col("number") == 14) & (F.col("value") != 0))), F.lit(False))
        d = _instances(self.rows, "tensor", name=_last(8, "text", ""), external=external)
        return d.select("model_id", "scope", F.col("instance").alias("tensor"), "of", "as_field", "parent", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("external", F.lit(False)).alias("external"))

    def attributes(self) -> DataFrame:
        """model_id, scope, node, name, reference."""
        d = _instances(self.rows, "attribute", name=_last(1, "text", ""), reference=_last(21, "text", ""))
        return d.select("model_id", "scope", F.col("parent").alias("node"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("reference", F.lit("")).alias("reference"))

    def initializers(self) -> DataFrame:
        """model_id, scope, name: of dense tensors of a graph, and of the values of its sparse ones."""
        t = self.tensors()
        dense = t.where("of = 'graph' and as_field = 5").select("model_id", "scope", "name")
        sparse = self.sparse().where("as_field = 15 and of = 'graph'")
        return dense.unionByName(sparse.select("model_id", "scope", "name"))

    def sparse(self) -> DataFrame:
        """model_id, scope, of, as_field, name of the values, whether values and indices are there."""
        heads = _instances(self.rows, "sparse", has_values=F.bool_or(F.col("number") == 1), has_indices=F.bool_or(F.col("number") == 2))
        names = self.tensors().where("of = 'sparse' and as_field = 1").groupBy("model_id", F.col("parent").alias("instance")).agg(F.max_by("name", "tensor").alias("name"))
        d = heads.join(names, ["model_id", "instance"], "left")
        return d.select("model_id", "scope", "of", "as_field", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("has_values", F.lit(False)).alias("has_values"), F.coalesce("has_indices", F.lit(False)).alias("has_indices"))

    def outlets(self) -> DataFrame:
        """model_id, role, position (from 0), name, element_type, rank, dimensions of the model's own inputs and outputs.

        A dimension is (number, symbol), one of them null.  element_type is null
        for what is no tensor, rank for a tensor without a shape.
        """
        own = self.graphs().where("depth = 0").select("model_id", "scope")
        v = self.values().where("role <> 'value'").join(own, ["model_id", "scope"])
        child = lambda message, number: self.rows.where(f"message = '{message}' and number = {number} and child is not null").groupBy("model_id", "instance").agg(F.max_by("child", "place").alias("child"))
        step = lambda d, message, number, at, name: d.join(child(message, number).select("model_id", F.col("instance").alias(at), F.col("child").alias(name)), ["model_id", at], "left")
        v = step(step(step(v, "value", 2, "value", "type"), "type", 1, "type", "tensor"), "tensor_type", 2, "tensor", "shape")
        element = self.rows.where("message = 'tensor_type' and number = 1").groupBy("model_id", F.col("instance").alias("tensor")).agg(F.max_by("value", "place").alias("element_type"))
        v = v.join(element, ["model_id", "tensor"], "left")
        held = self.rows.where("message = 'dimension' and number in (1, 2)").groupBy("model_id", F.col("instance").alias("dimension")).agg(F.max_by(F.struct("value", "text"), "place").alias("held"))
        dims = self.rows.where("message = 'shape'").select("model_id", F.col("instance").alias("shape"), F.col("child").alias("dimension"), "place").join(held, ["model_id", "dimension"], "left")
        dims = dims.groupBy("model_id", "shape").agg(F.array_sort(F.collect_list(F.struct("place", F.col("held.value").alias("value"), F.col("held.text").alias("text")))).alias("all"))
        v = v.join(dims, ["model_id", "shape"], "left")
        plain = F.transform("all", lambda z: F.struct(z["value"].alias("number"), z["text"].alias("symbol")))
        dimensions = F.when(F.col("shape").isNotNull(), F.coalesce(plain, F.array().cast("array<struct<number:bigint,symbol:string>>")))
        from pyspark.sql.window import Window

        rank = F.row_number().over(Window.partitionBy("model_id", "role").orderBy("position")) - 1
        element_type = F.when(F.col("tensor").isNotNull(), F.coalesce("element_type", F.lit(0)))
        return v.select("model_id", "role", rank.alias("position"), "name", element_type.alias("element_type"), F.size(dimensions).alias("rank"), dimensions.alias("dimensions"))

    def operators(self) -> DataFrame:
        """model_id, domain, op_type, n: nodes of all graphs of a model."""
        return self.nodes().groupBy("model_id", "domain", "op_type").agg(F.count("*").alias("n"))

    def violations(self) -> DataFrame:
        """model_id, rule, error_code, subject: a row for each thing that is wrong in a model that could be walked."""
        c, one = F.col, ["model_id"]
        says = lambda rule, code, subject: {"rule": F.lit(rule), "error_code": F.lit(code), "subject": subject}
        malformed, unsupported, limit, nothing = "malformed_model", "unsupported_model", "limit_exceeded", F.lit(None)
        standard = c("domain").isin(*STANDARD_DOMAINS)
        several = lambda d, *by: d.groupBy("model_id", *by).agg(F.count("*").alias("n"))
        o, v, t, a, n, i, w = self.opsets(), self.values(), self.tensors(), self.attributes(), self.nodes(), self.initializers(), self.outlets()
        # Single assignment: within a graph, initializers and outputs that aren't left out have one name each.
        made = n.select("model_id", "scope", F.explode("outputs").alias("name")).unionByName(i).where("name <> ''")
        bad_dimension = F.exists("dimensions", lambda z: ~F.coalesce((z["number"] >= 0) | (z["symbol"] != ""), F.lit(False)))
        found = [
            broken(self.models(), one, [(c("ir_version") <= 0, says("ir_version", malformed, c("ir_version"))), (c("n_opsets") == 0, says("no_opset", malformed, nothing)), (c("n_graphs") == 0, says("no_graph", malformed, nothing))]),
            broken(o, one, [(~standard | (c("version") <= 0), says("opset", unsupported, c("domain")))]),
            broken(several(o, "domain"), one, [(c("n") > 1, says("repeated_opset", unsupported, c("domain")))]),
            broken(self.graphs(), one, [((c("n_inputs") == 0) | (c("n_outputs") == 0), says("graph_without_ends", malformed, c("scope")))]),
            broken(several(v, "scope", "role", "name"), one, [(c("name") == "", says("unnamed_value", malformed, c("role"))), ((c("n") > 1) & (c("name") != ""), says("repeated_value", malformed, c("name")))]),
            broken(t, one, [(c("external"), says("external_data", unsupported, c("name")))]),
            broken(self.sparse(), one, [(~c("has_values") | ~c("has_indices"), says("sparse_parts", malformed, c("name")))]),
            broken(i, one, [(c("name") == "", says("unnamed_initializer", malformed, nothing))]),
            broken(n, one, [((c("op_type") == "") | ~standard | (c("overload") != ""), says("operator", unsupported, F.concat_ws(":", "domain", "op_type")))]),
            broken(a, one, [((c("name") == "") | (c("reference") != ""), says("attribute", malformed, c("name")))]),
            broken(several(a, "node", "name"), one, [((c("n") > 1) & (c("name") != ""), says("repeated_attribute", malformed, c("name")))]),
            broken(several(made, "scope", "name"), one, [(c("n") > 1, says("repeated_output", malformed, c("name")))]),
            broken(
                w,
                one,
                [
                    (c("element_type").isNull(), says("no_tensor", unsupported, c("name"))),
                    ((c("element_type") <= 0) | (c("element_type").isNotNull() & c("dimensions").isNull()), says("tensor_type", malformed, c("name"))),
                    (c("rank") > MAX_RANK, says("rank", limit, c("name"))),
                    (bad_dimension, says("dimension", malformed, c("name"))),
                ],
            ),
        ]
        counts = [F.count_if(fit).alias(what) for what, fit in (("nodes", _is("node")), ("attributes", _is("attribute")), ("tensors", _is("tensor")), ("values", _is("value")))]
        most = {"nodes": MAX_NODES, "attributes": MAX_ATTRIBUTES, "tensors": MAX_TENSORS, "values": MAX_VALUES}
        found.append(broken(self.rows.where("child is not null").groupBy("model_id").agg(*counts), one, [(c(what) > n, says(f"many_{what}", limit, c(what))) for what, n in most.items()]))
        return union(found)

    def defined(self) -> DataFrame:
        """model_id, scope, name: what a graph's inputs, initializers and nodes give names to."""
        n = self.nodes().select("model_id", "scope", F.explode("outputs").alias("name"))
        v = self.values().where("role = 'input'").select("model_id", "scope", "name")
        return n.unionByName(v).unionByName(self.initializers()).where("name <> ''").distinct()

    def _outer(self) -> DataFrame:
        """model_id, scope, outer: each graph with itself and the graphs around it."""
        parts = F.split(F.col("scope"), "/")
        outer = F.explode(F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))
        return self.graphs().select("model_id", "scope", outer.alias("outer"))

    def undefined_inputs(self, defined: DataFrame | None = None) -> DataFrame:
        """model_id, scope, node, name: inputs that neither their graph nor one around it defines; ``defined`` is that table if the caller has it."""
        used = self.nodes().select("model_id", "scope", "node", F.explode("inputs").alias("name")).where("name <> ''").distinct()
        visible = self._outer().join((self.defined() if defined is None else defined).withColumnRenamed("scope", "outer"), ["model_id", "outer"]).select("model_id", "scope", "name").distinct()
        return used.join(visible, ["model_id", "scope", "name"], "left_anti").select("model_id", "scope", "node", "name")

    def shadowed(self, defined: DataFrame | None = None) -> DataFrame:
        """model_id, scope, outer, name: names that a graph defines again although one around it has them; ``defined`` as above."""
        d = self.defined() if defined is None else defined
        around = self._outer().where("outer <> scope").join(d.withColumnRenamed("scope", "outer"), ["model_id", "outer"])
        return d.join(around, ["model_id", "scope", "name"]).select("model_id", "scope", "outer", "name")
