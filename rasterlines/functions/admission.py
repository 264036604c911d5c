"""What is let in: metadata, encodings, identifiers, addresses, documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema

# File signatures.
PNG_SIGNATURE = bytes.fromhex("89504E470D0A1A0A")
JPEG_SIGNATURE = bytes.fromhex("FFD8FF")
# Fixed value: what the digest of a dictionary starts with, before a zero byte.
DICTIONARY_TAG = "paddle-character-dictionary-v1"
# Hosts that models may come from.
MODEL_HOSTS = ("huggingface.co", "cdn-lfs.hf.co", "cdn-lfs-us-1.hf.co", "cas-bridge.xethub.hf.co")


def sniffed_format(content: Column) -> Column:
    """png or jpeg by the first bytes, else null."""
    return F.when(F.substring(content, 1, 8) == F.lit(PNG_SIGNATURE), "png").when(F.substring(content, 1, 3) == F.lit(JPEG_SIGNATURE), "jpeg")


def metadata_error(encoded_bytes: Column, width: Column, height: Column) -> Column:
    """invalid_request if any declared size is zero or beyond the product's limits, else null."""
    pixels = width.cast("bigint") * height
    ok = encoded_bytes.between(1, schema.MAX_ENCODED_BYTES) & width.between(1, schema.MAX_SIDE) & height.between(1, schema.MAX_SIDE) & (pixels <= schema.MAX_PIXELS) & (pixels * 3 <= schema.MAX_DECODED_BYTES)
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(None).cast("string")).otherwise("invalid_request")


def base64_length(n: Column) -> Column:
    """Characters that n bytes take with padding."""
    return (F.floor((n + 2) / 3) * 4).cast("bigint")


def strict_base64(text: Column) -> Column:
    """The bytes of canonical base64 (right length, alphabet, padding and spare bits), else null."""
    shaped = (F.length(text) % 4 == 0) & text.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z")
    found = F.try_to_binary(text, F.lit("base64"))
    return F.when(shaped & (F.regexp_replace(F.base64(found), "[\r\n]", "") == text), found)


def safe_identifier(name: Column) -> Column:
    return name.rlike(r"\A[A-Za-z0-9._-]{1,128}\z") & ~name.isin(".", "..")


def lower_sha256(text: Column) -> Column:
    return text.rlike(r"\A[0-9a-f]{64}\z")


def allowed_url(url: Column, hosts=MODEL_HOSTS) -> Column:
    """https to one of the hosts, without user or port."""
    authority = F.regexp_extract(url, r"\Ahttps://([^/?#]*)", 1)
    return F.coalesce(authority.isin(*hosts), F.lit(False))


def dictionary_digest(symbols: str) -> Column:
    """SHA-256 over a tag and each entry's byte length (big-endian) and bytes."""
    tag = f"concat(encode('{DICTIONARY_TAG}', 'utf-8'), X'00')"
    return F.expr(f"sha2(aggregate({symbols}, {tag}, (a, s) -> concat(a, unhex(lpad(hex(octet_length(s)), 8, '0')), encode(s, 'utf-8'))), 256)")


def dictionary_admitted(symbols: str) -> Column:
    """Not empty, all distinct, one character each, none a space."""
    return F.expr(f"size({symbols}) > 0 and size(array_distinct({symbols})) = size({symbols}) and forall({symbols}, s -> char_length(s) = 1) and not array_contains({symbols}, ' ')")
