"""Profiles line by line against a plain reading; requests from protobuf; contours and crops of odd pages."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlines.functions import profiles as P
from rasterlines.operators import pixels, regions
from rasterlines.sources import images


def plain_dictionary(text):
    lines = text.split("\n")
    lines = [x.removesuffix("\r") for x in (lines[:-1] if lines[-1] == "" else lines)]
    at = next((k for k, x in enumerate(lines) if x.strip() == "character_dict:"), None)
    if at is None or "\t" in lines[at]:
        return None
    base, out = len(lines[at]) - len(lines[at].lstrip(" ")), []
    for line in lines[at + 1 :]:
        if not line.strip():
            continue
        if "\t" in line:
            return None
        if len(line) - len(line.lstrip(" ")) < base or not line.strip().startswith("- "):
            break
        v = line.strip()[2:].strip()
        if v.startswith('"'):
            try:
                v = json.loads(v)
            except ValueError:
                return None
        elif v.startswith("'") and len(v) >= 2 and v.endswith("'"):
            v = v[1:-1].replace("''", "'")
        elif not v or v.startswith("#"):
            return None
        out.append(v)
    return out if len(out) <= 436 else None


def run(spark, texts, *columns):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1:] for r in sorted(d.select("i", *(c(F.col("t")) for c in columns)).collect())]


def test_dictionaries(spark):
    pieces = ["  - a", "  - 'it''s'", '  - "\\u00e9\\""', "  - '", "- b", "    - c  ", "", "   ", "other: 1", "  -", "  - ", "  - #x", "\t- d", "  - \"bad", " - e\r", "  character_dict:", "  -f", "  - é"]
    rng = random.Random(9)
    texts = ["", "x", "character_dict:", "\tcharacter_dict:\n- a", "  character_dict:\n" + "  - a\n" * 436, "  character_dict:\n" + "  - a\n" * 437, "a: 1\n character_dict: \n - a\n- b\n"]
    texts += ["".join(rng.choice(["", "k: v\n"])) + "  character_dict:\n" + "\n".join(rng.choice(pieces[: rng.choice([6, len(pieces)])]) for _ in range(rng.randrange(7))) for _ in range(300)]
    assert [r[0] for r in run(spark, texts, P.dictionary)] == [plain_dictionary(t) for t in texts]
    assert sum(plain_dictionary(t) is None for t in texts) > 30 and sum(bool(plain_dictionary(t)) for t in texts) > 60
    assert run(spark, [None], P.dictionary, lambda t: P.has_key(t, "a"), lambda t: P.has_value(t, "a", "b"), lambda t: P.optional_true(t, "a"), lambda t: P.has_sequence(t, [1])) == [(None, False, False, False, False)]


def test_keys_values_and_runs(spark):
    texts = ["a:\n b: 1 \n  b : 2\nbc: 3\n", "  b:true\r\n", "b: true\nb: true", "b: false", " - 3\n- - 48\n  - x\n\u00a0- 320", "- 3\n- 47\n- 48", "- 4294967296\n- 3\n- +48\n- 320\n- 3", "- 3\n- 48", "- 99999999999999999999999999999999999999999\n- 3\n- 48\n- 320"]
    found = run(spark, texts, lambda t: P.has_key(t, "a"), lambda t: P.values(t, "b"), lambda t: P.has_value(t, "b", "1"), lambda t: P.optional_true(t, "b"), lambda t: P.has_sequence(t, [3, 48, 320]))
    assert found == [
        (True, ["1"], True, False, False),
        (False, ["true"], False, True, False),
        (False, ["true", "true"], False, False, False),
        (False, ["false"], False, False, False),
        (False, [], False, True, True),
        (False, [], False, True, False),
        (False, [], False, True, True),
        (False, [], False, True, False),
        (False, [], False, True, True),
    ]


def test_a_text_is_split_once(spark):
    for f in (P.dictionary, lambda t: P.has_sequence(t, [1, 2]), lambda t: P.optional_true(t, "a"), lambda t: P.has_key(t, "a"), lambda t: P.has_value(t, "a", "b")):
        assert str(f(F.col("t"))).count("split(") == 1


def test_messages_left_out(spark):
    kind = "id bigint, image binary, metadata struct<format:int,encoded_bytes:bigint,width:bigint,height:bigint>, options struct<language:string,include_words:boolean,minimum_confidence:float>, width string"
    meta = (1, 3, 8, 9)
    rows = [(1, b"abc", meta, None, "x"), (2, b"abc", meta, (None, None, None), "x"), (3, b"abc", meta, ("english", None, None), "x"), (4, b"abc", None, None, "x"), (5, None, (2, None, None, None), ("english", True, 1.0), "x"), (6, b"", (0, 3, 8, 9), None, "x"),
            (7, b"", (3, 3, 8, 9), None, "x"), (8, b"", meta, ("english", True, 1.5), "x"), (9, b"", meta, ("english", True, float("nan")), "x"), (10, b"", meta, ("English", True, 0.5), "x"), (None, b"", meta, None, "x")]
    found = {r.image_id: r for r in images.proto_requests(spark.createDataFrame(rows, kind)).collect()}
    assert {k for k, r in found.items() if r.error_code is None} == {1, 3, 5, None}
    assert found[1].options == ("english", True, 0.0) and found[3].options == ("english", False, 0.0)
    assert (bytes(found[5].content), *found[5][2:6]) == (b"", "jpeg", 0, 0, 0)
    assert all(r.content is None and r.width is None and r.options is None for r in found.values() if r.error_code)


def test_contours(spark):
    rng = np.random.default_rng(1)
    for _ in range(30):
        f = rng.random((7, 9)) < 0.8
        want = np.array([[f[y, x] and not all(0 <= y + j < 7 and 0 <= x + i < 9 and f[y + j, x + i] for j in (-1, 0, 1) for i in (-1, 0, 1)) for x in range(9)] for y in range(7)])
        assert (regions.boundary(f) == want).all()
    p = np.zeros((6, 6), np.float32)
    p[:5, :5] = 0.9
    rows = [(1, 6, 6, p.ravel().tolist()), (2, 6, 6, [0.0] * 36), (3, 6, 6, [1.0]), (4, None, 6, None), (5, 1, 1, [0.9])]
    found = {(r.image_id, r.component): r.pixels for r in regions.contours(spark.createDataFrame(rows, "image_id bigint, width int, height int, p array<float>"), 0.5).collect()}
    assert found == {(1, 0): [0, 1, 2, 3, 4, 6, 10, 12, 16, 18, 22, 24, 25, 26, 27, 28], (5, 0): [0]}


def test_crops_of_pages(spark):
    page = np.arange(5 * 4 * 3, dtype=np.uint8).reshape(5, 4, 3)
    quad = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    whole, tall, flat = quad((0, 0), (3, 0), (3, 2), (0, 2)), quad((0, 0), (1, 0), (1, 4), (0, 4)), quad((0, 0), (3, 0), (3, 0), (0, 0))
    rows = [(1, 4, 5, page.tobytes(), [whole, tall, flat], "x"), (2, 4, 4, page.tobytes(), [whole], "x"), (3, 4, 5, None, [whole], "x"), (4, 4, 5, page.tobytes(), [], "x"), (5, 4, 5, page.tobytes(), None, "x")]
    table = spark.createDataFrame(rows, "image_id bigint, width int, height int, rgb binary, quads array<array<struct<x:float,y:float>>>, rank string")
    found = {(r.image_id, r["rank"]): r for r in pixels.crops(table).collect()}
    assert set(found) == {(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)} and all(found[k].rgb is None and found[k].width is None for k in ((1, 2), (2, 0), (3, 0)))
    assert (np.frombuffer(found[1, 0].rgb, np.uint8).reshape(2, 3, 3) == page[:2, :3]).all()
    assert (found[1, 1].width, found[1, 1].height) == (4, 1) and (np.frombuffer(found[1, 1].rgb, np.uint8).reshape(1, 4, 3)[0] == page[:4, 0]).all()


@pytest.mark.parametrize("tail", ["", "\n", "\r\n", "\n\n"])
def test_lines(spark, tail):
    (found,) = run(spark, ["a\r\nb" + tail], P.lines)[0]
    assert found == ["a", "b"] + [""] * (tail == "\n\n")
