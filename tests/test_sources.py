"""Requests and image files as rows."""

from __future__ import annotations

import base64
import json

import numpy as np

from rasterlines.operators import png
from rasterlines.sources.images import image_files, requests


def test_requests_of_json_lines(spark):
    content = png.encode(np.full((4, 5, 3), 9, np.uint8))
    good = {"image_base64": base64.b64encode(content).decode(), "metadata": {"format": "png", "encoded_bytes": len(content), "width": 5, "height": 4}}
    rows = [
        (1, json.dumps(good)),
        (2, json.dumps(good | {"options": {"include_words": False, "minimum_confidence": 0.5}})),
        (3, json.dumps(good | {"image_base64": good["image_base64"].rstrip("=") + "-"})),
        (4, "no json"),
        (5, None),
        (6, json.dumps(good | {"options": {"minimum_confidence": 1.5}})),
        (7, json.dumps(good | {"metadata": {"format": "gif", "encoded_bytes": 1, "width": 5, "height": 2**40}})),
        (1, json.dumps(good)),
    ]
    found = requests(spark.createDataFrame(rows, "id bigint, value string")).orderBy("image_id").collect()
    assert [(r.image_id, r.error_code) for r in found] == [(1, None), (1, None), (2, None), *((k, "invalid_request") for k in range(3, 8))]
    assert bytes(found[0].content) == content and (found[0].width, found[0].height, found[0].encoded_bytes) == (5, 4, len(content))
    assert tuple(found[0].options) == ("english", True, 0.0) and tuple(found[2].options) == ("english", False, 0.5)
    assert requests(spark.createDataFrame([], "id bigint, value string")).collect() == []


def test_image_files_within_the_bound(spark, tmp_path):
    small, large = png.encode(np.zeros((2, 2, 3), np.uint8)), b"\xff\xd8\xff" + bytes(5000)
    for name, content in (("a.png", small), ("b.jpg", large), ("c.txt", b"text"), ("empty", b"")):
        (tmp_path / name).write_bytes(content)
    files = image_files(spark, f"file://{tmp_path}", most=4000)
    found = {r.path.rsplit("/", 1)[1]: r for r in files.collect()}
    assert set(found) == {"a.png", "c.txt"} and found["a.png"].format == "png" and found["c.txt"].format is None
    assert bytes(found["a.png"].content) == small and found["a.png"].encoded_bytes == len(small)
