"""Metadata of runs."""

from __future__ import annotations

import hashlib
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTRACTION_SCHEMA, GRAPH_SCHEMA = "paper_extraction.v1", "graph_analysis.v1"


def utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def file_sha256(path: str) -> str:
    """Digest of a local file; empty if there is none."""
    try:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()
    except OSError:
        return ""


def run_metadata(spark: SparkSession, *, provider: str, model: str, prompt: str, prompt_path: str = "", now: str | None = None) -> DataFrame:
    row = spark.range(1).select(F.lit(EXTRACTION_SCHEMA).alias("schema_version"), F.sha2(F.encode(F.lit(prompt), "UTF-8"), 256).alias("prompt_sha256"), F.lit(prompt_path).alias("prompt_path"), F.lit(provider).alias("provider"), F.lit(model).alias("model"))
    return row.withColumn("created_at", F.lit(now or utc_now()))


def graph_metadata(source: dict[str, str], now: str | None = None) -> dict[str, str]:
    return {"schema_version": GRAPH_SCHEMA, "created_at": now or utc_now()} | {f"source_{k}": source.get(k, "") for k in ("schema_version", "prompt_sha256", "provider", "model")}
