"""Types, limits and the error table of the recognition pipeline."""

from __future__ import annotations

POINT = "struct<x:float,y:float>"
POLYGON = f"struct<points:array<{POINT}>>"
WORD = f"struct<text:string,confidence:float,polygon:{POLYGON}>"
LINE = f"struct<text:string,confidence:float,polygon:{POLYGON},words:array<{WORD}>>"
BLOCK = f"struct<polygon:{POLYGON},lines:array<{LINE}>>"
PAGE = f"struct<index:int,width:int,height:int,blocks:array<{BLOCK}>>"
RESULT = f"struct<pages:array<{PAGE}>>"

IMAGES = "image_id bigint, content binary, format string, encoded_bytes bigint, width int, height int"
RASTER = "struct<width:int,height:int,rgb:binary,source_format:string,orientation_applied:boolean>"
REQUEST = "image_base64 string, metadata struct<format:string,encoded_bytes:bigint,width:bigint,height:bigint>, options struct<language:string,include_words:boolean,minimum_confidence:float>"

# Product limits.
MAX_ENCODED_BYTES = 32 * 1024 * 1024
MAX_SIDE = 16384
MAX_PIXELS = 64 * 1024 * 1024
MAX_DECODED_BYTES = 192 * 1024 * 1024
MAX_BATCH_ITEMS = 8
MAX_BATCH_BYTES = 32 * 1024 * 1024
MAX_CANDIDATES = 1000
MAX_CROP_PIXELS = 64 * 1024 * 1024
CHUNK = 8
READING_ORDER_TOLERANCE = 10
ROW_SUM_TOLERANCE = 0.01

# Error code, HTTP status, gRPC status.
ERRORS = [
    ("invalid_request", 400, "INVALID_ARGUMENT"),
    ("invalid_image", 400, "INVALID_ARGUMENT"),
    ("model_unavailable", 503, "UNAVAILABLE"),
    ("overloaded", 429, "RESOURCE_EXHAUSTED"),
    ("deadline_exceeded", 504, "DEADLINE_EXCEEDED"),
    ("cancelled", 503, "CANCELLED"),
    ("internal", 500, "INTERNAL"),
]

# What is said of each error.
MESSAGES = {
    "invalid_request": "the OCR request is invalid",
    "invalid_image": "the raster image is invalid",
    "model_unavailable": "the OCR model bundle is unavailable",
    "overloaded": "the OCR service is temporarily overloaded",
    "deadline_exceeded": "the OCR request deadline was exceeded",
    "cancelled": "the OCR request was cancelled",
    "internal": "an internal OCR error occurred",
}
