"""Scores of predicted actions: per step, per user, macro-F1, and outcomes of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INVALID = "__INVALID__"


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def f1_of(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}


def class_scores(labels: DataFrame) -> DataFrame:
    """label, support (of gt), support_pred, precision, recall, f1 of each label of pred and gt. labels may have n, how many rows a row stands for."""
    n = F.col("n") if "n" in labels.columns else F.lit(1)
    each = labels.select(F.explode(F.array_distinct(F.array("pred", "gt"))).alias("label"), "pred", "gt", n.cast("long").alias("n"))
    is_p, is_g = F.col("pred") == F.col("label"), F.col("gt") == F.col("label")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    sums = each.groupBy("label").agg(count(is_p & is_g).alias("tp"), count(is_p & ~is_g).alias("fp"), count(~is_p & is_g).alias("fn"))
    return sums.select("label", (F.col("tp") + F.col("fn")).alias("support"), (F.col("tp") + F.col("fp")).alias("support_pred"), *[v.alias(k) for k, v in f1_of(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def last_steps(rows: DataFrame, flag: str = "flagged", ordinal: str = "event_id") -> DataFrame:
    """One row per session: of flagged ones the last in file order; if no row at all is flagged, that of the highest step."""
    row = F.struct(*[c for c in rows.columns if c not in ("user_id", "session_id")])
    flagged = F.coalesce(flag, F.lit(False))
    ends = rows.groupBy("user_id", "session_id").agg(
        F.max_by(F.when(flagged, row), F.when(flagged, F.col(ordinal))).alias("_flagged"), F.max_by(row, F.struct(F.coalesce("step_idx", F.lit(0)), ordinal)).alias("_last")
    )
    # a scalar subquery over the same exchange: whether any row is flagged
    any_ = ends.agg(F.coalesce(F.bool_or(F.col("_flagged").isNotNull()), F.lit(False))).scalar()
    picked = ends.select("user_id", "session_id", F.when(any_, F.col("_flagged")).otherwise(F.col("_last")).alias("_r")).where("_r is not null")
    return picked.select("user_id", "session_id", "_r.*")


def outcome(last: DataFrame, predicted: Column, true: Column) -> DataFrame:
    """Counts, precision, recall and F1 of sessions that end in a purchase."""
    p, t = F.coalesce(predicted, F.lit(False)), F.coalesce(true, F.lit(False))
    sums = last.agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"), F.count("*").alias("n"))
    return sums.select("*", *[v.alias(k) for k, v in f1_of(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def advantages(rewards: DataFrame, group: list[str], reward: str = "reward") -> DataFrame:
    """Adds advantage: a rollout's reward against its group's mean, in population standard deviations (0 where all are alike)."""
    w = Window.partitionBy(*group)
    return rewards.withColumn("advantage", F.coalesce((F.col(reward) - F.avg(reward).over(w)) / F.nullif(F.stddev_pop(reward).over(w), F.lit(0.0)), F.lit(0.0)))


QUANTILES = (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))


def summarised(values: DataFrame, quantiles=QUANTILES, places: int | None = 1) -> DataFrame:
    """n, mean, quantiles (element int(q * (n - 1)) of the sorted values), max, min and sum for each measure. values: measure, value.

    Values are counted first, so a task gets each measure's distinct values, not its rows. Rounded to places, sums to none.
    """
    by = Window.partitionBy("measure")
    counted = values.where("value is not null").groupBy("measure", F.col("value").cast("double").alias("value")).agg(F.count("*").alias("c"))
    ranked = counted.withColumn("n", F.sum("c").over(by)).withColumn("upto", F.sum("c").over(by.orderBy("value")))
    shown = lambda x: x if places is None else F.round(x, places)
    at = [shown(F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("n") - 1)), F.col("value")))).alias(k) for k, q in quantiles]
    total = F.sum(F.col("value") * F.col("c"))
    return ranked.groupBy("measure").agg(F.max("n").alias("n"), shown(total / F.max("n")).alias("mean"), *at, shown(F.max("value")).alias("max"), shown(F.min("value")).alias("min"), F.round(total, 0).alias("sum"))


def paired(predictions: DataFrame, truths: DataFrame, key: str) -> DataFrame:
    """Each prediction with its truth; a row without the other one is an error when it is read."""
    both = predictions.withColumn("_p", F.lit(True)).join(truths.withColumn("_t", F.lit(True)), key, "full")
    checked = F.when(F.col("_p").isNull() | F.col("_t").isNull(), F.raise_error(F.concat(F.lit("prediction and truth don't pair at "), F.col(key).cast("string"))))
    return both.withColumn("_e", checked).where("_e is null").drop("_p", "_t", "_e")


def rationale_quality(pairs: DataFrame, score: Column) -> DataFrame:
    """n_paired and the mean score of rows whose pred_rationale and rationale_gt both say something (null without any); bertscore_f1 is null, as no model is here."""
    both = pairs.where("pred_rationale <> '' and rationale_gt <> ''")
    return both.agg(F.count("*").alias("n_paired"), F.avg(score).alias("rouge_l_f1"), F.lit(None).cast("double").alias("bertscore_f1"))


def evaluation(rates: DataFrame, f1: DataFrame, sessions: DataFrame) -> DataFrame:
    """The four headline numbers in one row. rates: nag, fg_type_acc; f1: macro_f1; sessions: f1; one row each."""
    one = lambda df, c: df.select(c).scalar()
    return rates.select(F.col("nag").alias("next_action_gen"), one(f1, "macro_f1").alias("action_type_macro_f1"), F.col("fg_type_acc").alias("fine_grained_type"), one(sessions, "f1").alias("session_outcome"))
