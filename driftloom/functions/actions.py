"""Actions: normalisation, validity, the two JSON forms, matching, rewards and per-step metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftloom.functions.text import json_string, str_or_none, strip

#: Closed vocabularies.
ACTION_TYPES = ("click", "input", "terminate")
CLICK_TYPES = ("review", "search", "product_option", "product_link", "other", "purchase", "nav_bar", "page_related", "quantity", "suggested_term", "cart_side_bar", "cart_page_select", "filter")
#: Reward weights.
HARD_CLICK, PRODUCT_OPTION, REVIEW_SEARCH, INPUT, TERMINATE, WRONG_CLICK, FORMAT_BONUS = 1000.0, 10.0, 1.0, 2000.0, 1.0, -1.0, 0.1


def normalised(action_type: Column, click_type: Column, semantic_id: Column, input_text: Column) -> dict[str, Column]:
    """type, click_type, name, text and valid: the fields that an action of its type has."""
    kind = F.lower(str_or_none(action_type))
    click = F.when(kind == "click", str_or_none(click_type))
    name = F.when(kind.isin("click", "input"), str_or_none(semantic_id))
    text = F.when(kind == "input", str_or_none(input_text))
    valid = F.coalesce(kind.isin(*ACTION_TYPES), F.lit(False)) & (click.isNull() | click.isin(*CLICK_TYPES))
    return {"type": kind, "click_type": click, "name": name, "text": text, "valid": valid}


def internal_json(kind: Column, click_type: Column, name: Column, text: Column) -> Column:
    """Sorted keys, nulls kept, with click_type."""
    return (
        F.when(kind == "click", F.concat(F.lit('{"click_type": '), json_string(click_type), F.lit(', "name": '), json_string(name), F.lit(', "type": "click"}')))
        .when(kind == "input", F.concat(F.lit('{"name": '), json_string(name), F.lit(', "text": '), json_string(text), F.lit(', "type": "input"}')))
        .when(kind == "terminate", F.lit('{"type": "terminate"}'))
    )


def wire_json(kind: Column, name: Column, text: Column) -> Column:
    """As internal_json, without click_type."""
    return F.when(kind == "click", F.concat(F.lit('{"name": '), json_string(name), F.lit(', "type": "click"}'))).otherwise(internal_json(kind, F.lit(None).cast("string"), name, text))


def completion(rationale: Column, wire: Column) -> Column:
    """The target text: action, then the stripped rationale."""
    return F.concat(F.lit('{"action": '), wire, F.lit(', "rationale": '), json_string(strip(F.coalesce(rationale, F.lit("")))), F.lit("}"))


def rendered_rationale(synth: Column, human: Column) -> Column:
    return F.coalesce(F.nullif(synth, F.lit("")), F.nullif(human, F.lit("")), F.lit(""))


def rationale_source(synth: Column, human: Column) -> Column:
    return F.when(F.coalesce(synth, F.lit("")) != "", "synthetic").when(F.coalesce(human, F.lit("")) != "", "human").otherwise("none")


def _slot(x: Column) -> Column:
    """Stripped; blank counts as absent."""
    return F.nullif(strip(x), F.lit(""))


def matches(p: str, g: str) -> Column:
    """Whether actions with these column prefixes are alike; absent slots are alike."""
    c = lambda k, s: F.col(f"{k}{s}")
    name = _slot(c(p, "name")).eqNullSafe(_slot(c(g, "name")))
    text = _slot(c(p, "text")).eqNullSafe(_slot(c(g, "text")))
    same = c(p, "type") == c(g, "type")
    return F.coalesce(same & F.when(c(g, "type") == "click", name).when(c(g, "type") == "input", name & text).otherwise(True), F.lit(False))


def reward(parsed: Column, rationale: Column, p: str = "pred_", g: str = "gt_", rl_only: bool = False, overrides: dict[str, float] | None = None) -> Column:
    """0 if unparsed; else the weight of a right or a wrong action, and a bonus for a rationale."""
    kind, click = F.col(f"{g}type"), F.col(f"{g}click_type")
    right = F.when(click == "product_option", PRODUCT_OPTION).when(click.isin("review", "search"), REVIEW_SEARCH).otherwise(HARD_CLICK)
    if overrides:
        table = F.create_map(*[x for k in sorted(overrides) for x in (F.lit(k), F.lit(float(overrides[k])))])
        right = F.coalesce(F.element_at(table, click), right)
    right = F.when(kind == "click", right).when(kind == "input", INPUT).when(kind == "terminate", TERMINATE).otherwise(0.0)
    wrong = F.lit(0.0) if rl_only else F.when(F.col(f"{p}type") == "click", WRONG_CLICK).otherwise(0.0)
    bonus = F.when(F.coalesce(strip(rationale), F.lit("")) != "", FORMAT_BONUS).otherwise(0.0)
    return F.when(parsed, F.when(matches(p, g), right).otherwise(wrong) + bonus).otherwise(0.0)


def step_metrics(parsed: Column, p: str = "pred_", g: str = "gt_") -> dict[str, Column]:
    """format_valid, type_acc, fg_type_acc (its slots are filled too), nag (and alike)."""
    same = parsed & F.coalesce(F.col(f"{p}type") == F.col(f"{g}type"), F.lit(False))
    name, text = _slot(F.col(f"{p}name")).isNotNull(), _slot(F.col(f"{p}text")).isNotNull()
    filled = same & F.when(F.col(f"{g}type") == "click", name).when(F.col(f"{g}type") == "input", name & text).otherwise(True)
    return {"format_valid": parsed.cast("int"), "type_acc": same.cast("int"), "fg_type_acc": filled.cast("int"), "nag": (filled & matches(p, g)).cast("int")}
