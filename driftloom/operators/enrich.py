"""Filling missing rationales from an append-only cache, and through an injected model."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.text import str_or_none


def last_writes(writes: DataFrame) -> DataFrame:
    """action_id and rationale of the latest write of each key; rows without key drop out."""
    return writes.where("action_id is not null").groupBy("action_id").agg(F.max_by("rationale", "ordinal").alias("rationale"))


def pending(steps: DataFrame, cache: DataFrame) -> DataFrame:
    """Steps without a human rationale that the cache has no key for."""
    return steps.where(str_or_none(F.col("rationale")).isNull()).join(cache.select("action_id"), "action_id", "left_anti")


def with_cached(steps: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds _cached, the cache's text of a step; an empty text counts as missing."""
    return steps.join(cache.select("action_id", F.nullif("rationale", F.lit("")).alias("_cached")), "action_id", "left")


def materialized(steps: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds rationale_synth: the cached text for steps without a human one; an empty text counts as missing."""
    human = str_or_none(F.col("rationale"))
    return with_cached(steps.withColumn("rationale", human), cache).withColumn("rationale_synth", F.when(F.col("rationale").isNull(), F.col("_cached"))).drop("_cached")


def delay(attempt: int, limited: bool, jitter: Callable[[float], float]) -> float:
    """Seconds before the next attempt after an error."""
    return 60 * 2**attempt + jitter(5) if limited else 5 * 2**attempt + jitter(2)


#: What the message of an error about too many calls has.
LIMIT_WORDS = ("429", "rate", "quota", "resource_exhausted")


def limited(error: Exception) -> bool:
    return any(word in str(error).lower() for word in LIMIT_WORDS)


def bare(said: str) -> str:
    """Stripped, and without one pair of quotes around it."""
    said = said.strip()
    return said[1:-1].strip() if said[:1] in ('"', "'") and said[-1:] == said[:1] else said


def ask(client: Callable[[str], str], prompt: str, attempts: int = 5, is_limit=limited, sleep=time.sleep, seed: int = 0) -> str | None:
    """A model's answer; errors wait, empty answers are asked again at once, None after all attempts."""
    rng = random.Random(seed)
    for attempt in range(attempts):
        try:
            said = bare(client(prompt) or "")
        except Exception as e:  # any failure of the client is tried again
            sleep(delay(attempt, is_limit(e), lambda most: rng.uniform(0, most)))
            continue
        if said:
            return said
    return None


def synthesized(prompts: DataFrame, client: Callable[[str], str], per_minute: float | None = None, sleep=time.sleep) -> DataFrame:
    """action_id and rationale from a client called in each task; per_minute is shared out over the partitions."""
    n = prompts.rdd.getNumPartitions() if per_minute else 1

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gap, nxt = (60.0 * n / per_minute if per_minute else 0.0), 0.0
        for batch in batches:
            out = []
            for key, prompt in zip(batch["action_id"], batch["prompt"]):
                if gap:
                    now = time.monotonic()
                    if nxt > now:
                        sleep(nxt - now)
                    nxt = max(nxt, now) + gap
                out.append((key, ask(client, prompt, sleep=sleep)))
            yield pd.DataFrame(out, columns=["action_id", "rationale"])

    return prompts.select("action_id", "prompt").mapInPandas(work, "action_id string, rationale string")
