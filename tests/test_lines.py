"""Bounded lines for any byte ranges; requests and headers that the queries don't cover."""

from __future__ import annotations

import io
import itertools
import json
import random

from pyspark.sql import functions as F

from rasterlines.functions import rpc
from rasterlines.sources import images, lines


def plain(content: bytes, most: int):
    out, at = [], 0
    for k, part in enumerate(parts := content.split(b"\n")):
        last = k == len(parts) - 1
        if not (last and not part):
            large = len(part) > most
            out.append((at, None if large else part if last or not part.endswith(b"\r") else part[:-1], large))
        at += len(part) + 1
    return out


def test_lines_for_any_ranges_and_pieces():
    rng = random.Random(6)
    contents = [b"", b"\n", b"\r\n", b"a", b"a\r", b"\n\n", b"abc\r\n\r\r\nde", b"x" * 50] + [bytes(rng.choice(b"ab\r\n\n") for _ in range(rng.randrange(60))) for _ in range(60)]
    for content, size, piece, most in itertools.product(contents, (1, 2, 3, 7, 100), (1, 4, 64), (0, 2, 5)):
        found = [x for a in range(0, len(content), size) for x in lines.lines_of(io.BytesIO(content), a, min(a + size, len(content)), most, piece)]
        assert found == plain(content, most), (content, size, piece, most)


class Endless(io.RawIOBase):
    """A line of a gigabyte between two short ones, without its bytes anywhere."""

    SIZE = 1 << 30

    def __init__(self):
        self.at, self.read_bytes = 0, 0

    def seek(self, at, whence=0):
        self.at = at
        return at

    def read(self, n=-1):
        n = min(n, self.SIZE + 6 - self.at)
        out = bytearray(b"x" * n)
        for place, byte in ((1, 10), (self.SIZE + 2, 10), (self.SIZE + 5, 10)):
            if self.at <= place < self.at + n:
                out[place - self.at] = byte
        self.at += n
        self.read_bytes += n
        return bytes(out)


def test_a_line_of_a_gigabyte_takes_little_memory():
    import tracemalloc

    tracemalloc.start()
    found = list(lines.lines_of(Endless(), 0, Endless.SIZE + 6, 1000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, b"x", False), (2, None, True), (Endless.SIZE + 3, b"xx", False)] and peak < 1 << 22
    # A range that lies within the line reads no more than itself.
    stream = Endless()
    assert list(lines.lines_of(stream, 1 << 20, 2 << 20, 1000)) == [] and stream.read_bytes <= (1 << 20) + (1 << 19)


def test_source_in_batches_and_as_a_stream(spark, tmp_path):
    content = {"a.txt": b"one\r\ntwo\n" + b"y" * 30 + b"\nlast", "sub/b.txt": b"\nfour", "_hidden": b"no\n", "empty": b""}
    for name, data in content.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    lines.register(spark)
    want = {("one", False), ("two", False), (None, True), ("last", False), ("", False), ("four", False)}
    for size in (3, 1000):
        for root in (str(tmp_path), f"file://{tmp_path}"):
            found = spark.read.format("bounded_lines").option("max_bytes", 10).option("split_bytes", size).load(root)
            rows = [(r.value.decode() if r.value is not None else None, r.too_large) for r in found.select("value", "too_large").collect()]
            assert len(rows) == 6 and set(rows) == want
    stream = spark.readStream.format("bounded_lines").option("max_bytes", 10).load(str(tmp_path)).select(F.col("value").cast("string").alias("line"), "too_large")
    query = stream.writeStream.format("memory").queryName("seen_lines").option("checkpointLocation", str(tmp_path.parent / f"{tmp_path.name}-state")).start()
    try:
        query.processAllAvailable()
        assert {tuple(r) for r in spark.table("seen_lines").collect()} == want
        (tmp_path / "later.txt").write_bytes(b"later\n")
        query.processAllAvailable()
        assert spark.table("seen_lines").count() == 7
    finally:
        query.stop()
    empty = tmp_path / "nothing"
    empty.mkdir()
    assert spark.read.format("bounded_lines").load(str(empty)).collect() == []


def test_requests(spark):
    call = lambda params, **more: json.dumps({"jsonrpc": "2.0", "method": "tools/call", "params": params} | more)
    rows = {
        1: ('{"jsonrpc":"2.0","id":1.5,"method":"initialize"}', ("1.5", False, "initialize", None)),
        2: ('{"jsonrpc":"2.0","id":{},"method":"initialize"}', ("null", False, None, -32600)),
        3: ('{"jsonrpc":"2.0","id":true,"method":"initialize"}', ("null", False, None, -32600)),
        4: ('{"jsonrpc":"1.0","id":4,"method":"initialize"}', ("null", False, None, -32600)),
        5: ('{"jsonrpc":2.0,"method":"initialize"}', ("null", False, None, -32600)),
        6: ('[1]', ("null", False, None, -32600)),
        7: ("", ("null", False, None, -32700)),
        8: (None, ("null", False, None, -32700)),
        9: (call({"name": "ocr_models", "arguments": {}}, id="a\"bé"), ('"a\\"bé"', False, "ocr_models", None)),
        10: (call({"name": "ocr_models"}, id=10), ("10", False, None, -32602)),
        11: (call({"name": "ocr_models", "arguments": []}, id=11), ("11", False, None, -32602)),
        12: (call({"name": 5}, id=12), ("12", False, None, -32602)),
        13: (call(None, id=13), ("13", False, None, -32602)),
        14: (call({"name": "ocr_batch", "arguments": None}), ("null", True, "ocr_batch", None)),
        15: ('{"jsonrpc":"2.0","method":"nothing"}', ("null", True, None, -32601)),
        16: ('{"jsonrpc":"2.0","method":"notifications/initialized"}', ("null", True, "notifications/initialized", None)),
        17: ('{"jsonrpc":"2.0","id":null,"method":"notifications/initialized"}', ("null", False, None, -32600)),
        18: ('{"jsonrpc":"2.0","id":9007199254740993,"method":"tools/list","more":[{}]}', ("9007199254740993", False, "tools/list", None)),
    }
    table = spark.createDataFrame([(k, v, False, "x") for k, (v, _) in rows.items()] + [(19, '{"jsonrpc":"2.0","id":1,"method":"initialize"}', True, "x")], "request_id bigint, value string, too_large boolean, other string")
    found = {r.request_id: r for r in rpc.answered(rpc.routed(table), "s", "1").collect()}
    assert {k: (r.correlation, r.silent, r.target, r.code) for k, r in found.items()} == {k: v for k, (_, v) in rows.items()} | {19: ("null", False, None, -32600)}
    for r in found.values():
        assert (r.answer is None) == (r.silent or (r.target or "").startswith("ocr_"))
        if r.answer:
            answer = json.loads(r.answer)
            assert answer["jsonrpc"] == "2.0" and json.dumps(answer["id"], ensure_ascii=False) == r.correlation
            assert r.code is None or answer["error"] == {"code": r.code, "message": r.message, "data": {"request_id": 0 if r.code == -32602 else r.request_id}}
    done = spark.range(1).select(rpc.result_envelope(F.lit('"q"'), F.lit('{"results":[]}')).alias("r")).first().r
    assert json.loads(done)["result"]["structuredContent"] == {"results": []} and json.loads(done)["id"] == "q"


def test_raw_headers(spark):
    good = {"x-image-format": "png", "content-type": "image/png", "x-image-width": "8", "x-image-height": "9"}
    cases = [good, good | {"X-Include-Words": "false", "x-minimum-confidence": "1e-1"}, good | {"content-type": "image/png; q"}, good | {"x-image-width": "-8"}, good | {"x-image-width": " 8"}, {}, None,
             good | {"x-include-words": ""}, good | {"x-minimum-confidence": "-0.1"}, good | {"x-minimum-confidence": ".5"}, good | {"x-minimum-confidence": "0.5 "}, {k.upper(): v for k, v in good.items()}]
    table = spark.createDataFrame([(k, h, bytearray(b"abc"), "x") for k, h in enumerate(cases)] + [(90, good, None, "x")], "id bigint, headers map<string,string>, body binary, format string")
    found = {r.image_id: r for r in images.raw_requests(table).collect()}
    assert {k for k, r in found.items() if r.error_code is None} == {0, 1, 9, 11}
    assert found[0][2:6] == ("png", 3, 8, 9) and found[0].options == ("english", True, 0.0)
    assert found[1].options.include_words is False and abs(found[1].options.minimum_confidence - 0.1) < 1e-7
    assert all(r.content is None and r.options is None for r in found.values() if r.error_code)


def test_routes(spark):
    from rasterlines.functions import routes

    rows = [(1, "GET", "/health/live", 0), (2, "HEAD", "/metrics", None), (3, "HEAD", "/mcp", 0), (4, "POST", "/mcp", 11), (5, "POST", "/mcp", 10), (6, None, "/mcp", 0), (7, "GET", None, 0), (8, "get", "/metrics", 0), (9, "GET", "/metrics?x", 0), (10, "POST", "/v1/ocr", 99)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "request_id bigint, method string, path string, length bigint, target string").drop("target")
    found = {r.request_id: (r.target, r.status) for r in routes.routed(table, {"rpc": 10}).collect()}
    assert found == {1: ("live", None), 2: ("metrics", None), 3: (None, 405), 4: (None, 413), 5: ("rpc", None), 6: (None, 405), 7: (None, 404), 8: (None, 405), 9: (None, 404), 10: ("recognize_json", None)}
    names = [r.n for r in spark.range(0, 24).select(routes.element_type(F.col("id")).alias("n")).collect()]
    assert names[0] is None and names[1] == "float32" and names[22] == "int4" and names[23] is None


def test_small_ranges_share_tasks():
    from rasterlines.sources import lines

    files = lines._Files({"path": "/nowhere", "split_bytes": "10"})
    dealt = files.tasks({"a": 100_005, "b": 7, "c": 50_000})
    flat = [(x.path, x.start, x.end) for t in dealt for x in t.splits]
    assert flat == [(x.path, x.start, x.end) for x in files.splits({"a": 100_005, "b": 7, "c": 50_000})] and 200 < len(dealt) < 300
    assert [len(t.splits) for t in files.tasks({"a": 25})] == [1, 1, 1] and files.tasks({}) == []
