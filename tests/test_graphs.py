"""The wire walk on small and damaged models, structure over nested graphs, and contract documents."""

from __future__ import annotations

import json

import pytest

from rasterlines.operators import graphs as G
from rasterlines.operators.contracts import Contracts, operator_differences, outlet_differences, parts
from rasterlines.plans.graphs import numeral, outlet, part, varint
from rasterlines.sources.shared import in_groups

NODE = part(1, "x") + part(2, "y") + part(4, "Relu")


def graph(nodes=b"", inputs=("x",), outputs=("y",), more=b""):
    return nodes + b"".join(outlet(11, n, "batch", 3) for n in inputs) + b"".join(outlet(12, n, "batch", 3) for n in outputs) + more


def model(body, ir=8, opsets=(("", 13),)):
    return numeral(1, ir) + b"".join(part(8, part(1, d) + numeral(2, v)) for d, v in opsets) + part(7, body)


def error(content):
    try:
        for _ in G.walk(content):
            pass
    except G.WireError as e:
        return str(e)
    return None




def test_varints():
    for n in (0, 1, 127, 128, 300, 2**32, 2**63, 2**64 - 1):
        assert G._varint(varint(n), 0, 10) == (n, len(varint(n)))
    for bad in (b"", b"\x80", b"\xff" * 10, b"\xff" * 9 + b"\x02", b"\x80" * 11 + b"\0"):
        with pytest.raises(G.WireError):
            G._varint(bad, 0, len(bad))


def test_fields_of_a_small_model():
    rows = list(G.walk(model(graph(part(1, NODE)))))
    assert [(r[0], r[2], r[6]) for r in rows if r[6] is not None and r[0] == "node"] == [("node", 1, "x"), ("node", 2, "y"), ("node", 4, "Relu")]
    assert rows[0][:3] == ("model", 0, 1) and rows[0][5] == 8
    assert next(r for r in rows if r[0] == "dimension" and r[2] == 1)[5] == 3
    assert [r[5] for r in G.walk(numeral(1, -5))] == [-5]


def test_every_beginning_is_an_error_or_a_shorter_model():
    whole = model(graph(part(1, NODE)))
    assert error(whole) is None
    for n in range(len(whole)):
        assert error(whole[:n]) in (None, "malformed_model")
    assert error(whole[: len(whole) - 3]) == "malformed_model"


def test_wire_errors():
    assert error(b"") == "malformed_model" and error(varint(0)) == "malformed_model"
    assert error(numeral(9, 1)) == error(part(1, "x")) == error(part(20, "")) == error(part(25, "")) == error(b"\x0b") == "unsupported_model"
    assert error(part(2, "p" * G.MAX_TEXT_BYTES)) is None and error(part(2, "p" * (G.MAX_TEXT_BYTES + 1))) == "limit_exceeded"
    assert error(part(2, b"\xff\xfe")) == "malformed_model" and error(part(7, part(1, part(5, part(4, b"\xff\xfe"))))) is None
    assert error(varint(2**32 * 8)) == "malformed_model" and error(varint((2**32 - 1) * 8) + b"\0") == "unsupported_model"
    assert error(part(7, part(5, numeral(2, 1) + part(9, b"abc") + varint(4 * 8 + 5) + b"1234" + varint(10 * 8 + 1) + b"12345678"))) is None
    assert error(part(7, part(5, varint(10 * 8 + 1) + b"1234567"))) == "malformed_model"
    assert error(b"\0" * (G.MAX_MODEL_BYTES + 1)) == "model_too_large"


def test_depth_and_field_budgets(monkeypatch):
    body = NODE  # the inside of a node: each round puts it into a graph in an attribute of another node
    depth = 2  # model, graph and node lie below the model
    while depth + 3 <= G.MAX_DEPTH:
        body, depth = part(5, part(6, part(1, body))), depth + 3
    assert error(part(7, part(1, body))) is None
    assert error(part(7, part(1, part(5, part(6, part(1, body)))))) == "limit_exceeded"
    monkeypatch.setattr(G, "MAX_FIELDS", 100)
    assert error(numeral(1, 1) * 100) is None and error(numeral(1, 1) * 101) == "limit_exceeded"


def made(spark, models):
    rows = spark.createDataFrame([(k, bytearray(c) if c is not None else None, 1) for k, c in models.items()], "model_id bigint, content binary, place int")
    return G.Graphs(G.fields(rows).cache())


def test_fields_come_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(G, "BATCH_FIELDS", 10)
    long, bad = numeral(1, 1) * 25, numeral(1, 1) * 25 + numeral(9, 1)
    models = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate([long, bad, b"", *[numeral(1, 3)] * 12])], "model_id bigint, content binary").coalesce(1)
    rows = [(r.model_id, r.place, r.error_code) for r in G.fields(models).collect()]
    assert rows == [(0, k, None) for k in range(25)] + [(1, None, "unsupported_model"), (2, None, "malformed_model")] + [(k, 0, None) for k in range(3, 15)]


def test_groups_are_bounded():
    items = [(k, b"x" * n) for k, n in enumerate((3, 3, 9, 1, 1, 1))] + [(6, None)]
    assert [[k for k, _ in g] for g in in_groups(items, 5, 3)] == [[0, 1], [2], [3, 4, 5], [6]]
    assert list(in_groups([], 5, 3)) == []


def test_structure(spark):
    tensor = part(8, "w")
    sparse = lambda *fields: part(15, b"".join(fields))
    models = {
        1: model(graph(part(1, NODE))),
        2: model(graph(part(1, NODE) * 2)),
        3: model(graph(part(1, NODE), more=part(5, part(8, "y")))),
        4: model(graph(part(1, NODE), more=part(5, tensor) * 2)),
        5: model(graph(part(1, NODE), more=part(5, b""))),
        6: model(graph(part(1, NODE), inputs=("x", "x"), outputs=("y", ""))),
        7: model(graph(part(1, NODE), inputs=())),
        8: model(graph(part(1, part(2, "y") + part(7, "com.example") + part(4, "Relu")) + part(1, part(2, "z")) + part(1, NODE.replace(b"y", b"u") + part(8, "o")))),
        9: model(graph(part(1, NODE + part(5, part(1, "a")) * 2 + part(5, b"") + part(5, part(1, "b") + part(21, "outer"))))),
        10: model(graph(part(1, NODE), more=part(5, tensor + numeral(14, 1)) + part(5, part(8, "v") + part(13, part(1, "location"))))),
        11: model(graph(part(1, NODE), more=sparse(part(1, tensor)) + sparse(part(1, tensor), part(2, b"")) + sparse(part(2, b"")))),
        12: model(graph(part(1, NODE)), ir=0, opsets=()),
        13: numeral(1, 8) + part(8, numeral(2, 13)),
        14: model(graph(part(1, NODE)), opsets=(("", 13), ("ai.onnx", 13), ("", 14), ("com.example", 1), ("ai.onnx", 0))),
        15: model(part(1, NODE) + part(11, part(1, "x") + part(2, part(4, b""))) + part(12, part(1, "y") + part(2, part(1, numeral(1, 0))))),
        16: model(part(1, NODE) + outlet(11, "x", "", -1) + part(12, part(1, "y") + part(2, part(1, numeral(1, 1) + part(2, part(1, b"") + part(1, numeral(1, 0))))))),
        17: model(part(1, NODE) + outlet(12, "y", "n", 1) + part(11, part(1, "x") + part(2, part(1, numeral(1, 1) + part(2, part(1, numeral(1, 2)) * 17))))),
        18: model(graph(part(1, part(2, "") * 2 + part(4, "Drop")))),
        19: None,
        20: b"",
    }
    g = made(spark, models)
    found: dict = {}
    for r in g.violations().collect():
        found.setdefault(r.model_id, []).append((r.rule, r.error_code, r.subject))
    m, u = "malformed_model", "unsupported_model"
    want = {
        2: [("repeated_output", m, "y")],
        3: [("repeated_output", m, "y")],
        4: [("repeated_output", m, "w")],
        5: [("unnamed_initializer", m, None)],
        6: [("repeated_value", m, "x"), ("unnamed_value", m, "output")],
        7: [("graph_without_ends", m, "/2/")],
        8: [("operator", u, ":"), ("operator", u, ":Relu"), ("operator", u, "com.example:Relu")],
        9: [("attribute", m, ""), ("attribute", m, "b"), ("repeated_attribute", m, "a")],
        10: [("external_data", u, "v"), ("external_data", u, "w")],
        11: [("repeated_output", m, "w"), ("sparse_parts", m, ""), ("sparse_parts", m, "w"), ("unnamed_initializer", m, None)],
        12: [("ir_version", m, "0"), ("no_opset", m, None)],
        13: [("no_graph", m, None)],
        14: [("opset", u, "ai.onnx"), ("opset", u, "com.example"), ("repeated_opset", u, ""), ("repeated_opset", u, "ai.onnx")],
        15: [("no_tensor", u, "x"), ("tensor_type", m, "y")],
        16: [("dimension", m, "x"), ("dimension", m, "y")],
        17: [("rank", "limit_exceeded", "x")],
    }
    assert {k: sorted(v, key=str) for k, v in found.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    assert {r.model_id: r.error_code for r in g.errors.collect()} == {19: m, 20: m}


def test_names_across_nested_graphs(spark):
    inner = part(1, part(1, "x") + part(1, "w") + part(1, "nowhere") + part(2, "x2") + part(4, "Add")) + part(1, part(1, "inside") + part(2, "y") + part(4, "Relu")) + outlet(11, "x", "n", 1) + outlet(12, "y", "n", 1)
    body = part(1, part(1, "x") + part(2, "y") + part(4, "If") + part(5, part(1, "then") + part(6, inner)))
    late = part(1, part(1, "inside") + part(1, "") + part(1, "x2") + part(2, "z") + part(4, "Relu"))
    g = made(spark, {1: model(graph(body + late, more=part(5, part(8, "w")) + part(15, part(1, part(8, "inside")) + part(2, b""))))})
    undefined = {(r.scope, r.name) for r in g.undefined_inputs().collect()}
    assert undefined == {("/2/5/", "nowhere"), ("/2/", "x2")}
    assert {(r.scope, r.outer, r.name) for r in g.shadowed().collect()} == {("/2/5/", "/2/", "x"), ("/2/5/", "/2/", "y")}
    assert {(r.op_type, r.n) for r in g.operators().collect()} == {("Add", 1), ("Relu", 2), ("If", 1)}
    assert sorted((r.depth, r.n_inputs, r.n_outputs) for r in g.graphs().collect()) == [(0, 1, 1), (1, 1, 1)]
    out = {r.role: (r.position, r.name, r.element_type, [tuple(d) for d in r.dimensions]) for r in g.outlets().collect()}
    assert out == {"input": (0, "x", 1, [(None, "batch"), (3, None)]), "output": (0, "y", 1, [(None, "batch"), (3, None)])}


def test_models_at_the_budgets(spark, monkeypatch):
    monkeypatch.setattr(G, "MAX_NODES", 3)
    g = made(spark, {1: model(graph(b"".join(part(1, part(2, f"y{k}") + part(4, "Relu")) for k in range(3)))), 2: model(graph(b"".join(part(1, part(2, f"y{k}") + part(4, "Relu")) for k in range(4))))})
    assert [(r.model_id, r.rule, r.subject) for r in g.violations().collect()] == [(2, "many_nodes", "4")]


GOOD = {
    "schema_version": 1, "contract_id": "a", "role": "detector", "qualification": "qualified", "artifact_sha256": "0" * 64, "artifact_byte_length": 5, "ir_version": 8,
    "opsets": [{"domain": "", "version": 13}], "inputs": [{"name": "x", "element_type": 1, "dimensions": ["batch", 3]}], "outputs": [{"name": "y", "element_type": 1, "dimensions": []}],
    "operators": [{"domain": "", "op_type": "Add", "count": 1}, {"domain": "", "op_type": "Relu", "count": 2}],
}


def test_contract_documents(spark):
    change = lambda **k: json.dumps(GOOD | k)
    without = lambda *k: json.dumps({x: v for x, v in GOOD.items() if x not in k})
    add, relu = GOOD["operators"]
    documents = {
        1: json.dumps(GOOD),
        2: change(qualification="provisional", ir_version=None, opsets=[], inputs=[{"name": "x"}], outputs=[], operators=[]),
        3: "", 4: "[]", 5: "{", 6: None, 7: "{}",
        8: json.dumps(GOOD)[:-1] + ',"role":"detector"}',
        9: change(more=1, opsets=[{"domain": "", "version": 13, "note": None}]),
        10: without("role", "ir_version", "opsets"),
        11: change(schema_version="1", role=None, inputs={}, operators=[add, 5], artifact_byte_length=5.5),
        12: change(schema_version=2, contract_id="", role="x", qualification="y", artifact_sha256="A" * 64, artifact_byte_length=0),
        13: change(operators=[relu, add]),
        14: change(operators=[add, add]),
        15: change(opsets=[{"domain": "", "version": 1}, {"domain": "", "version": 2}, {"domain": "ai.onnx", "version": 0}, {"domain": "b", "version": 1}]),
        16: change(inputs=[GOOD["inputs"][0]] * 2, outputs=[{"name": "", "element_type": 0, "dimensions": ["", -1, 1.5]}]),
        17: change(outputs=[{"name": "y", "element_type": None, "dimensions": [1] * 17}]),
        18: change(operators=[add | {"count": 0}, relu | {"op_type": ""}, relu | {"count": 9000}]),
        19: change(contract_id="x" * 70_000),
        20: change(outputs=[]),
        21: change(inputs=[{"name": f"x{k}", "element_type": 1, "dimensions": []} for k in range(129)]),
    }
    rows = spark.createDataFrame([(k, v, 1, "x") for k, v in documents.items()], "model_id bigint, value string, item int, text string")
    found: dict = {}
    for r in Contracts(parts(rows).cache()).violations().collect():
        found.setdefault(r.model_id, set()).add((r.path, r.rule))
    needed = {k for k in GOOD if k != "ir_version"}
    want = {
        3: {("", "size"), ("", "no_object")}, 4: {("", "no_object")}, 5: {("", "no_object")}, 6: {("", "size"), ("", "no_object")}, 8: {("", "no_object")},
        7: {(k, "missing_field") for k in needed},
        9: {("more", "unknown_field"), ("opsets[0].note", "unknown_field")},
        10: {("role", "missing_field"), ("opsets", "missing_field"), ("ir_version", "incomplete"), ("opsets", "incomplete")},
        11: {("schema_version", "type"), ("role", "type"), ("inputs", "type"), ("operators[1]", "type"), ("artifact_byte_length", "type"), ("inputs", "incomplete")},
        12: {(k, "value") for k in ("schema_version", "contract_id", "role", "qualification", "artifact_sha256", "artifact_byte_length")},
        13: {("operators[1]", "order")},
        14: {("operators[1]", "order"), ("operators[1]", "repeated")},
        15: {("opsets[1]", "repeated"), ("opsets[2].version", "value"), ("opsets[3].domain", "value")},
        16: {("inputs[1]", "repeated"), ("outputs[0].name", "value"), ("outputs[0].element_type", "value"), ("outputs[0].dimensions", "value")},
        17: {("outputs[0]", "incomplete"), ("outputs[0].dimensions", "value")},
        18: {("operators[0].count", "value"), ("operators[1].op_type", "value"), ("operators[1]", "order"), ("operators[2].count", "value")},
        19: {("", "size"), ("contract_id", "value")},
        20: {("outputs", "incomplete")},
        21: {("inputs", "length")},
    }
    assert found == want


def test_documents_against_graphs(spark):
    kind = "model_id bigint, domain string, op_type string, n bigint"
    declared = spark.createDataFrame([(1, "", "Add", 1), (1, "", "Relu", 2), (1, None, "Odd", 1), (2, "", "Add", 1)], kind)
    measured = spark.createDataFrame([(1, "", "Add", 1), (1, "", "Relu", 3), (1, None, "Odd", 1), (1, "", "Mul", 4)], kind)
    assert {tuple(r) for r in operator_differences(declared, measured).collect()} == {(1, "", "Relu", 2, 3), (1, "", "Mul", None, 4), (2, "", "Add", 1, None)}
    assert operator_differences(declared, declared).collect() == []
    kind = "model_id bigint, role string, position int, name string, element_type bigint, dimensions array<struct<number:bigint,symbol:string>>"
    fixed, free = lambda n: (n, None), lambda s: (None, s)
    rows = [("x", 1, [free("batch"), fixed(3)], "x", 1, [free("batch"), fixed(3)], None), ("x", 1, [free("batch")], "x", 1, [fixed(8)], None), ("x", 1, [free("batch")], "x", 1, [free("rows")], "dimensions"),
            ("x", 1, [free("batch")], "x", 1, [fixed(0)], "dimensions"), ("x", 1, [fixed(3)], "x", 1, [free("batch")], "dimensions"), ("x", 1, [fixed(3)], "x", 1, [fixed(4)], "dimensions"),
            ("x", 1, [], "x", 1, [fixed(4)], "rank"), ("x", 1, [], "x", 2, [], "element_type"), ("x", 1, [], "z", 1, [], "name"), ("x", None, [], "x", 1, [], "element_type"), ("x", 1, None, "x", 1, [], "rank")]
    wanted = spark.createDataFrame([(k, "input", 0, *r[:3]) for k, r in enumerate(rows)] + [(90, "output", 0, "y", 1, [])], kind)
    session = spark.createDataFrame([(k, "input", 0, *r[3:6]) for k, r in enumerate(rows)] + [(91, "output", 0, "y", 1, [])], kind)
    found = {r.model_id: r.reason for r in outlet_differences(wanted, session).collect()}
    assert found == {k: r[6] for k, r in enumerate(rows) if r[6]} | {90: "missing", 91: "extra"}


def test_names_that_graphs_define_are_made_once(spark, monkeypatch):
    from rasterlines.operators.graphs import Graphs
    from rasterlines.plans.graphs import graph_names

    calls, defined = [], Graphs.defined
    monkeypatch.setattr(Graphs, "defined", lambda self: calls.append(1) or defined(self))
    assert {r.what for r in graph_names(spark, "/root/testdata/sf0.001").collect()} == {"undefined", "shadowed"}
    assert len(calls) == 1
