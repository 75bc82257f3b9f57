"""Readers and writers: multi-file Parquet, JSON lines, a tolerant cache, step trees, CSV and manifests."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = "struct<step_idx: int, action_id: string, timestamp: string, observation: string, action_json: string, action_wire_json: string, rationale_gt: string, rationale_synth: string>"
TRAJECTORY = f"user_id string, session_id string, split string, persona string, steps array<{STEP}>"
CACHE = "action_id string, session_id string, step_idx int, split string, model string, rationale string"
SAMPLE = "user_id string, session_id string, step_idx int, action_id string, split string, prompt_text string, completion_text string, action_gt string, rationale_gt string, rationale_source string, n_prompt_tokens int, n_completion_tokens int, n_total_tokens int, n_history_full_html int, n_history_dropped_html int, current_truncated boolean"
PREDICTION = "user_id string, session_id string, step_idx int, completion string, action_gt string, rationale_gt string, is_session_last_step boolean"


def parquet_parts(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """All files by column name; no file gives an empty table, which needs a schema."""
    if not paths:
        return spark.createDataFrame([], schema or "session_id string")
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def split_parts(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """Files named split-*.parquet, with their split; a split without files is an error of the reader."""
    parts = [spark.read.option("mergeSchema", "true").parquet(f"{folder}/{s}-*.parquet").withColumn("split", F.lit(s)) for s in splits]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAJECTORY).json(path)


def cache(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a key; blank and malformed lines are skipped. ordinal: a file's order, then the lines' within it."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("ordinal"))
    rows = lines.select("ordinal", F.from_json("value", CACHE).alias("r")).select("ordinal", "r.*")
    return rows.where("action_id is not null")


def append_cache(rows: DataFrame, path: str) -> None:
    """Appends rows whose key is not there yet."""
    spark = rows.sparkSession
    try:
        held = cache(spark, path).select("action_id").distinct()
        rows = rows.join(held, "action_id", "left_anti")
    except Exception as e:  # the first write finds no folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").json(path)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).json(path)


def step_tree(spark: SparkSession, folder: str) -> DataFrame:
    """sessions/user_*/session_*/steps/*.json with the page file that each names; a missing file is an empty page."""
    steps = spark.read.option("multiLine", "true").schema("step_idx int, html_path string").json(f"{folder}/sessions/user_*/session_*/steps/*.json").withColumn("path", F.col("_metadata.file_path"))
    steps = steps.withColumn("session", F.regexp_extract("path", "/(session_[^/]*)/steps/", 1)).withColumn("root", F.regexp_extract("path", "^(.*)/steps/[^/]*$", 1))
    pages = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").text(f"{folder}/sessions", wholetext=True).withColumn("page_path", F.col("_metadata.file_path"))
    joined = steps.withColumn("page_path", F.concat("root", F.lit("/"), "html_path")).join(pages, "page_path", "left")
    return joined.select("session", "step_idx", F.coalesce("value", F.lit("")).alias("html"))


def write_samples(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    samples.write.mode(mode).option("compression", "zstd").partitionBy("split").parquet(path)


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).option("header", "true").csv(path)


def write_json(row: dict, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
    spark.createDataFrame([(json.dumps(row, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode(mode).text(path)


def manifest(params: dict, splits: DataFrame, revision: str = "unknown", now: datetime | None = None) -> dict:
    """Parameters, what made it, and the counters of each split (one row each)."""
    stats = {r["split"]: {k: v for k, v in r.asDict().items() if k != "split"} for r in splits.collect()}
    return {"params": params, "revision": revision[:12], "created": (now or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ"), "splits": stats}
