"""Prompts: their texts, rendering, and requests for rationales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts of a prompt.
SYSTEM = """\
<IMPORTANT>
Your task is to predict the immediate next action of a shopper.
You need to pretend that you are a real user shopping on amazon.com.
The history action, rationale, context and the user persona will be provided to you.
Ensure your prediction follows natural behavior sequences.
</IMPORTANT>

# Action Space
You predict a SINGLE action from the following three types:

- click: Click on a button or clickable element identified by `name`.
  {"type": "click", "name": "<element_name>"}

- input: Enter text into an input field identified by `name`.
  {"type": "input", "name": "<element_name>", "text": "<text>"}

- terminate: End the session — the shopper stops interacting with the page.
  {"type": "terminate"}

The `name` value MUST be copied verbatim from the `name="..."` attribute of
the corresponding element in the current page HTML. Do not invent names.

# Rationale
The rationale is the short reason WHY this specific shopper takes this
action, conditioned on their persona and what they have already done in this
session. Some history steps include real user-provided rationales; use them
as a guide to plausible reasoning style.

# Context
Your context is the simplified HTML of the Amazon page the shopper is
currently looking at, together with the shopper's persona and the recent
action history. The HTML retains interactive elements via `name="..."`
attributes and is the source of truth for valid action targets.

# Persona
The user persona reflects the user's demographics, personality, and shopping
preferences. Use it to ground your reasoning, BUT DO NOT RELY ON IT
exclusively — actual behavior is shaped more by what the shopper has just
seen and done in this session than by their abstract profile.

# Output Format
Produce a SINGLE JSON object — no surrounding prose, no code fences, no
extra keys — with exactly two top-level keys: "rationale" and "action".

{
  "rationale": "<one or two short sentences from the shopper's perspective>",
  "action":    <one of the three action shapes above>
}
"""
OMITTED = "[earlier page HTML omitted to fit context window]"
CUT = "\n<!-- current page HTML truncated for context length -->"
PERSONA, HISTORY, CURRENT = "## Shopper persona\n", "## Session history\n", "\n## Current page (step "
TASK = """

## Task
Predict the immediate next action this shopper takes on the current page.
Return a SINGLE JSON object with keys "rationale" and "action", matching the
output format specified in the system message. No prose, no code fences."""
FURNITURE = """\
## Page furniture (used across this shopping session)
The pages in this session reuse the chrome below. Wherever you see [[F1]],
[[F2]], ... inside any HTML below, expand it using the same-numbered block
in this section. These do not change across steps.
"""
STEP, PAGE, WHY, ACTION = "### Step ", "Page (HTML):\n", "Why: ", "Action: "
CHAT_SYSTEM, CHAT_USER, CHAT_ASSISTANT = "<|im_start|>system\n", "<|im_end|>\n<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"
#: Texts of a request for a rationale.
ASK = """
You are helping label a shopping-behavior dataset. Given a specific shopper's
persona, the Amazon page they were looking at, and the action they actually
took on that page, write a brief plausible rationale for WHY THIS SPECIFIC
SHOPPER took this action.

Rules:
- 1 to 2 short sentences, written in the first person from the shopper's
  perspective.
- Refer to concrete persona traits (demographics, shopping habits, stated
  preferences, personality) WHEN they plausibly explain the action.
- Do NOT invent facts that are not present in the persona or page.
- Do NOT restate the action verbatim ("I clicked X because I clicked X"); the
  rationale should explain motivation, not describe behavior.
- Output ONLY the rationale text. No preamble, no quotation marks, no JSON.

# Shopper persona
"""
ASK_EXAMPLES = "# Real shoppers' rationales (style reference)\n"
ASK_SNIPPET, ASK_ACTION, ASK_RATIONALE = "- Persona snippet: ", "\n  Action: ", "\n  Rationale: "
ASK_PAGE = "\n# Current page (HTML)\n"
ASK_TAKEN = "\n\n# Action this shopper took on this page\n"
ASK_END = "\n\n# Rationale (1-2 short sentences, first person, ONLY the rationale text):"
ASK_CUT = "\n<!-- observation truncated for synthesis context -->"
MAX_TOKENS = 8_000


def step_block(number: Column, page: Column, why: Column, wire: Column) -> Column:
    reason = F.when(why != "", F.concat(F.lit(WHY), why, F.lit("\n"))).otherwise("")
    return F.concat(F.lit(STEP), number.cast("string"), F.lit("\n" + PAGE), page, F.lit("\n\n"), reason, F.lit(ACTION), wire, F.lit("\n\n"))


def furniture_section(pieces: Column) -> Column:
    """The part of a compressed prompt that defines a session's furniture; a newline if it has none."""
    listed = F.array_join(F.transform(pieces, lambda p, i: F.concat(F.lit("[[F"), (i + 1).cast("string"), F.lit("]] =\n"), p, F.lit("\n"))), "")
    return F.when(F.size(pieces) > 0, F.concat(F.lit(FURNITURE), listed, F.lit("\n\n"))).otherwise("\n")


def user_prompt(persona: Column, blocks: Column, number: Column, current: Column, pieces: Column | None = None) -> Column:
    """blocks: array of step_block. With pieces (an array, may be empty) the compressed form."""
    section = F.lit("") if pieces is None else furniture_section(pieces)
    return F.concat(F.lit(PERSONA), persona, F.lit("\n\n"), section, F.lit(HISTORY), F.array_join(blocks, ""), F.lit(CURRENT), number.cast("string"), F.lit(")\n"), current, F.lit(TASK))


def chat(user: Column, system: str = SYSTEM) -> Column:
    return F.concat(F.lit(CHAT_SYSTEM + system + CHAT_USER), user, F.lit(CHAT_ASSISTANT))


def fixed_length() -> int:
    """Characters of a chat prompt without persona, furniture section, step blocks, number and current page."""
    return len(CHAT_SYSTEM + SYSTEM + CHAT_USER + CHAT_ASSISTANT + PERSONA + "\n\n" + HISTORY + CURRENT + ")\n" + TASK)


def examples(steps: DataFrame, personas: DataFrame, k: int = 3, seed: int = 0, most: int = 1200) -> DataFrame:
    """k human rationales of the train split in the order of a seeded hash: action_id, place (that hash), snippet (the persona's first characters), action_wire_json, rationale."""
    pool = steps.where("split = 'train' and rationale is not null").select("action_id", "user_id", "action_wire_json", "rationale")
    picked = pool.withColumn("place", F.md5(F.concat(F.lit(f"{seed}:" if seed else ""), "action_id"))).orderBy("place", "action_id").limit(k)
    return picked.join(personas, "user_id", "left").select("action_id", "place", F.substring(F.coalesce("persona", F.lit("{}")), 1, most).alias("snippet"), "action_wire_json", "rationale")


def examples_section(shown: DataFrame) -> Column:
    """The part of a request that shows a few examples (rows of the above), as a scalar subquery; empty without any."""
    text = F.concat(F.lit(ASK_SNIPPET), "snippet", F.lit(ASK_ACTION), "action_wire_json", F.lit(ASK_RATIONALE), "rationale", F.lit("\n"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", text.alias("text")))), lambda x: x.text), "")
    return shown.agg(F.when(F.count("*") > 0, F.concat(F.lit(ASK_EXAMPLES), lines, F.lit("\n"))).otherwise("")).scalar()


def synthesis_prompt(persona: Column, page: Column, wire: Column, shown: Column | str = "", most: int = 80_000) -> Column:
    """What is asked of a model that explains an action; shown: the examples' section; the page is cut at most characters."""
    cut = F.when(F.length(page) > most, F.concat(F.substring(page, 1, most), F.lit(ASK_CUT))).otherwise(page)
    return F.concat(F.lit(ASK), persona, F.lit("\n\n"), F.lit(shown) if isinstance(shown, str) else shown, F.lit(ASK_PAGE), cut, F.lit(ASK_TAKEN), wire, F.lit(ASK_END))
