"""Manifests of model bundles: the policy that their artifacts have to keep, and artifacts by what they are for.

``artifacts`` has a row for each artifact: bundle_id, schema_version, role, kind,
upstream_project, revision, filename, byte_length, sha256, license, source_url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import admission as A
from ..functions.checks import broken, union

# What an artifact may be, its license, and the length of a profile at most.
ROLES = ("detector", "english_recognizer")
KINDS = ("onnx_graph", "inference_config")
LICENSE = "Apache-2.0"
MAX_PROFILE_BYTES = 64 * 1024


def artifact_checks() -> list[tuple[Column, str]]:
    """(is wrong, rule) of one artifact; what is null is wrong."""
    c = F.col
    path = F.regexp_extract("source_url", r"\Ahttps://[^/?#]*([^?#]*)", 1)
    fine = [
        (c("role").isin(*ROLES) & c("kind").isin(*KINDS), "kind"),
        (A.safe_identifier(c("filename")), "filename"),
        (c("upstream_project") != "", "upstream_project"),
        (c("revision").rlike(r"\A[0-9A-Fa-f]{40}\z"), "revision"),
        (A.allowed_url(c("source_url")), "source_url"),
        (F.contains(path, c("revision")), "revision_in_url"),
        ((c("byte_length") > 0) & ((c("kind") == "onnx_graph") | (c("byte_length") <= MAX_PROFILE_BYTES)), "byte_length"),
        (A.lower_sha256(c("sha256")), "sha256"),
        (c("license") == LICENSE, "license"),
    ]
    return [(~F.coalesce(ok, F.lit(False)), rule) for ok, rule in fine]


def violations(artifacts: DataFrame) -> DataFrame:
    """bundle_id, rule, filename: what is wrong with artifacts (by file) and with bundles (file null).

    A bundle has one artifact of each role and kind and files of different names.
    Null bundle_ids are one bundle, with a name that isn't allowed.
    """
    c = F.col
    each = broken(artifacts, ["bundle_id"], [(wrong, {"rule": F.lit(rule), "filename": c("filename")}) for wrong, rule in artifact_checks()])
    known = c("role").isin(*ROLES) & c("kind").isin(*KINDS)
    whole = artifacts.groupBy("bundle_id").agg(
        F.count("*").alias("n"),
        F.count_distinct(F.when(known, F.struct("role", "kind"))).alias("kinds"),
        F.count_distinct("filename").alias("names"),
        F.bool_and(F.coalesce(c("schema_version") == 1, F.lit(False))).alias("version"),
    )
    most = len(ROLES) * len(KINDS)
    nothing = lambda rule: {"rule": F.lit(rule), "filename": F.lit(None)}
    bundle = [(~F.coalesce(A.safe_identifier(c("bundle_id")), F.lit(False)), nothing("bundle_id")), (~c("version"), nothing("schema_version")), ((c("n") != most) | (c("kinds") != most), nothing("artifacts")), (c("names") != c("n"), nothing("filenames"))]
    return union([each, broken(whole, ["bundle_id"], bundle)])


def admitted(artifacts: DataFrame) -> DataFrame:
    """The artifacts of bundles without any violation."""
    bad = violations(artifacts).select(F.col("bundle_id").alias("_bad")).distinct()
    return artifacts.join(bad, F.col("bundle_id").eqNullSafe(F.col("_bad")), "left_anti")


def artifact(artifacts: DataFrame, role: str, kind: str) -> DataFrame:
    """The artifact of that role and kind of each bundle."""
    return artifacts.where((F.col("role") == role) & (F.col("kind") == kind))
