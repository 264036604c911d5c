"""Bundles, batches and whole admissions on small cases."""

from __future__ import annotations

import base64
import hashlib
import json

import pytest
from test_graphs import NODE, graph, model

from rasterlines.operators import graphs as G
from rasterlines.operators import manifests
from rasterlines.operators.contracts import Contracts, admission, parts
from rasterlines.plans.graphs import part
from rasterlines.sources import images

REVISION = "0123456789abcdef0123456789abcdef01234567"
FIELDS = "bundle_id string, schema_version int, role string, kind string, upstream_project string, revision string, filename string, byte_length bigint, sha256 string, license string, source_url string, rule string"


def bundle(name, **changes):
    out = []
    for k, (role, kind) in enumerate([(r, t) for r in manifests.ROLES for t in manifests.KINDS]):
        row = {"bundle_id": name, "schema_version": 1, "role": role, "kind": kind, "upstream_project": "p", "revision": REVISION, "filename": f"f{k}", "byte_length": 65536, "sha256": "0" * 64, "license": "Apache-2.0", "source_url": f"https://huggingface.co/a/{REVISION}/f?x=1", "rule": "clash"}
        out.append(row | {c: v[k] if isinstance(v, list) else v for c, v in changes.items()})
    return out


def test_bundles(spark):
    bundles = {
        "good": bundle("good"),
        "a/b": bundle("a/b"),
        "version": bundle("version", schema_version=[1, 1, 2, 1]),
        "three": bundle("three")[:3],
        "twice": bundle("twice", role="detector"),
        "names": bundle("names", filename=["f", "f", "g", "h"]),
        "size": bundle("size", byte_length=[0, 65537, 65537, 65536]),
        "url": bundle("url", source_url=["http://huggingface.co/" + REVISION, "https://huggingface.co/a?" + REVISION, "https://user@huggingface.co/" + REVISION, None]),
        "nulls": bundle("nulls", license=[None, "Apache-2.0", "Apache-2.0", "Apache-2.0"], upstream_project=["p", "", "p", "p"], sha256=["0" * 64, "0" * 64, "A" * 64, "0" * 63], revision=[REVISION, REVISION, REVISION, "x" * 40]),
    }
    rows = [tuple(r.values()) for b in bundles.values() for r in b]
    table = spark.createDataFrame(rows, FIELDS)
    found: dict = {}
    for r in manifests.violations(table).collect():
        found.setdefault(r.bundle_id, []).append((r.rule, r.filename))
    want = {
        "a/b": [("bundle_id", None)],
        "version": [("schema_version", None)],
        "three": [("artifacts", None)],
        "twice": [("artifacts", None)],
        "names": [("filenames", None)],
        "size": [("byte_length", "f0"), ("byte_length", "f1")],
        "url": [("revision_in_url", "f0"), ("revision_in_url", "f1"), ("revision_in_url", "f3"), ("source_url", "f0"), ("source_url", "f2"), ("source_url", "f3")],
        "nulls": [("license", "f0"), ("revision", "f3"), ("revision_in_url", "f3"), ("sha256", "f2"), ("sha256", "f3"), ("upstream_project", "f1")],
    }
    assert {k: sorted(v, key=str) for k, v in found.items()} == want
    assert {r.bundle_id for r in manifests.admitted(table).collect()} == {"good"}
    assert [r.filename for r in manifests.artifact(table, "detector", "onnx_graph").where("bundle_id = 'good'").collect()] == ["f0"]


def test_batches(spark):
    item = lambda data: {"image_base64": base64.b64encode(data).decode(), "metadata": {"format": "png", "encoded_bytes": len(data), "width": 1, "height": 1}}
    documents = {1: {"items": [item(b"a"), item(b"bc")]}, 2: {"items": []}, 3: {"items": [item(b"a"), {"image_base64": "?"}]}, 4: {"items": [item(b"a")] * 9}, 5: {"items": None}, 6: {}, 7: {"items": [None, item(b"a")]}, 8: {"items": [item(b"abcd"), item(b"efgh")]}}
    lines = [(k, json.dumps(v), 5) for k, v in documents.items()] + [(9, "{", 5), (10, None, 5)]
    table = spark.createDataFrame(lines, "id bigint, value string, position int")
    found = images.batch_requests(table, most_bytes=7).collect()
    by = {k: sorted((r for r in found if r.batch_id == k), key=lambda r: -1 if r.position is None else r.position) for k in range(1, 11)}
    assert [(r.position, bytes(r.content), r.error_code, r.batch_error_code) for r in by[1]] == [(0, b"a", None, None), (1, b"bc", None, None)]
    assert all(r.content is None and r.batch_error_code == "invalid_request" for k in range(2, 11) for r in by[k])
    assert [len(by[k]) for k in range(1, 11)] == [2, 1, 2, 9, 1, 1, 2, 2, 1, 1] and [r.error_code for r in by[3]] == [None, "invalid_request"]
    done = spark.createDataFrame([(1, 1, "b"), (2, 0, "c"), (1, 0, "a"), (1, 2, None)], "batch_id bigint, position int, result string")
    assert {r.batch_id: r.results for r in images.batch_results(done).collect()} == {1: ["a", "b", None], 2: ["c"]}


@pytest.fixture(scope="module")
def admissions(spark):
    content = model(graph(part(1, NODE)))
    other = model(graph(part(1, NODE) * 2))
    outlet = lambda name: [{"name": name, "element_type": 1, "dimensions": ["batch", 3]}]
    good = {"schema_version": 1, "contract_id": "a", "role": "detector", "qualification": "qualified", "artifact_sha256": hashlib.sha256(content).hexdigest(), "artifact_byte_length": len(content), "ir_version": 8,
            "opsets": [{"domain": "", "version": 13}], "inputs": outlet("x"), "outputs": outlet("y"), "operators": [{"domain": "", "op_type": "Relu", "count": 1}]}
    of = lambda data: {"artifact_sha256": hashlib.sha256(data).hexdigest(), "artifact_byte_length": len(data)}
    changes = {
        1: ({}, content), 2: ({"role": "x"}, content), 3: ({"qualification": "provisional"}, content), 4: ({"artifact_byte_length": 9}, content), 5: ({"artifact_sha256": "0" * 64}, content),
        6: (of(other), other), 7: (of(content[:-3]), content[:-3]), 8: ({"ir_version": 7}, content), 9: ({"opsets": [{"domain": "", "version": 14}]}, content),
        10: ({"operators": [{"domain": "", "op_type": "Relu", "count": 2}]}, content), 11: ({"inputs": outlet("z")}, content), 12: ({"inputs": [outlet("x")[0] | {"dimensions": [8, 3]}]}, content), 13: ({"outputs": outlet("y") + outlet("z")}, content),
    }
    models = spark.createDataFrame([(k, bytearray(c)) for k, (_, c) in changes.items()] + [(14, bytearray(content))], "model_id bigint, content binary")
    documents = spark.createDataFrame([(k, json.dumps(good | c)) for k, (c, _) in changes.items()], "model_id bigint, value string")
    done = admission(models, Contracts(parts(documents).cache()), G.Graphs(G.fields(models).cache()))
    return {r.model_id: r.error_code for r in done.collect()}


def test_admission(admissions):
    mismatch = "contract_mismatch"
    assert admissions == {1: None, 2: "invalid_contract", 3: "provisional_contract", 4: mismatch, 5: mismatch, 6: "malformed_model", 7: "malformed_model", 8: mismatch, 9: mismatch, 10: mismatch, 11: mismatch, 12: mismatch, 13: mismatch, 14: "invalid_contract"}
