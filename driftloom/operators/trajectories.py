"""Sessions from actions: all-or-nothing validity, order, nested rows, and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.actions import internal_json, normalised, wire_json


def normalised_actions(raw: DataFrame) -> DataFrame:
    """Raw actions of some session, with type, click_type, name, text, valid and both JSON forms."""
    fields = normalised(F.col("action_type"), F.col("click_type"), F.col("semantic_id"), F.col("input_text"))
    kept = raw.where("session_id is not null").select("*", F.struct(*[v.alias(k) for k, v in fields.items()]).alias("_a")).drop("click_type")
    out = kept.select("*", "_a.*").drop("_a", "action_type", "semantic_id", "input_text")
    return out.withColumn("action_json", internal_json(F.col("type"), F.col("click_type"), F.col("name"), F.col("text"))).withColumn("action_wire_json", wire_json(F.col("type"), F.col("name"), F.col("text")))


def ordered_steps(raw: DataFrame) -> DataFrame:
    """Steps of valid sessions with step_idx from 0, by time and then event_id. One shuffle, on session_id."""
    by = Window.partitionBy("session_id")
    good = normalised_actions(raw).withColumn("_all", F.bool_and("valid").over(by)).where("_all").drop("_all", "valid")
    return good.withColumn("step_idx", (F.row_number().over(by.orderBy("ts", "event_id")) - 1).cast("int"))


def sessions(steps: DataFrame, personas: DataFrame) -> DataFrame:
    """One nested row per session: user_id, session_id, split, persona, steps."""
    fields = [c for c in ("step_idx", "action_id", "ts", "observation", "n_page", "action_json", "action_wire_json", "rationale") if c in steps.columns]
    nested = steps.groupBy("session_id").agg(F.first("user_id").alias("user_id"), F.first("split").alias("split"), F.sort_array(F.collect_list(F.struct(*fields))).alias("steps"))
    return nested.join(personas, "user_id", "left").withColumn("persona", F.coalesce("persona", F.lit("{}")))


def of_sessions(steps: DataFrame, table: DataFrame, ordinal: str) -> DataFrame:
    """Steps of the sessions in a table of sessions, with the user that it names; of rows with equal session_id the first by ordinal counts."""
    first = table.where("session_id is not null").groupBy("session_id").agg(F.min_by("user_id", ordinal).alias("user_id"))
    return steps.drop("user_id").join(first, "session_id")


def capped(steps: DataFrame, most: int) -> DataFrame:
    """Steps of the first sessions by session_id, most of them; a cap for trials."""
    return steps.join(F.broadcast(steps.select("session_id").distinct().orderBy("session_id").limit(most)), "session_id", "left_semi")


def session(nested: DataFrame, session_id: str):
    """The row of one session; LookupError if there is none."""
    found = nested.where(F.col("session_id") == session_id).head(1)
    if not found:
        raise LookupError(f"no session {session_id}")
    return found[0]


def samples(nested: DataFrame) -> DataFrame:
    """One sample per step t: its step, and the steps before it as history."""
    return nested.select("user_id", "session_id", "split", "persona", F.posexplode("steps").alias("t", "step"), "steps").withColumn("history", F.slice("steps", F.lit(1), F.col("t"))).drop("steps")
