"""Samples from sessions: history fitted to a token budget, prompts, completions and totals.

With an additive count (characters over chars_per_token, rounded up) a sample's fit follows from prefix
sums of lengths: the number of oldest pages to leave out is searched for by bisection, so no prompt is
rendered to count it, and no text is shuffled where none is asked for. Samples are rendered in Arrow
batches of sessions, by that number. With any other count, prompts are rendered and counted one after another.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.actions import completion, rationale_source
from driftloom.operators.compress import cut_out
from driftloom.operators.prompts import (
    ACTION, CHAT_ASSISTANT, CHAT_SYSTEM, CHAT_USER, CURRENT, CUT, FURNITURE, HISTORY, MAX_TOKENS, OMITTED, PAGE, PERSONA, STEP, SYSTEM, TASK, WHY, chat, fixed_length, furniture_section, step_block, user_prompt,
)

#: From keyed rows to the rows' texts.
Legs = Callable[[DataFrame], DataFrame]


#: The estimate before any prompt is counted, in characters: for a prompt, each step with its page, each step without it, and each piece of furniture.
BASE_CHARS, STEP_CHARS, GONE_CHARS, PIECE_CHARS = 2000, 300, 50, 200
#: A current page is halved while it is longer than this, in the plain packer and in the compressing one.
PLAIN_LEAST, LEAST = 1000, 100
#: Stand, in a session's prompt, for what changes from step to step; no page has them.
MARKS = tuple(f"\x00{i}\x00" for i in range(3))
#: Steps of a bisection; a session may have so many times two steps.
BITS = ", ".join(str(1 << b) for b in reversed(range(21)))


def sized(steps: DataFrame) -> DataFrame:
    """Adds n_cur, n_hist and n_why, the lengths of obs_cur, obs_hist and why, unless steps has them already: then it needs none of these texts."""
    for n, text in (("n_cur", "obs_cur"), ("n_hist", "obs_hist"), ("n_why", "why")):
        steps = steps if n in steps.columns else steps.withColumn(n, F.length(text))
    return steps


def step_costs(steps: DataFrame) -> DataFrame:
    """Adds full, dropped (block lengths with page and with marker), their sums and those of pages over the steps before, and peak (the largest saving up to here)."""
    why = F.col("n_why")
    base = len(STEP) + 1 + len(PAGE) + 2 + len(ACTION) + 2
    rest = base + F.length((F.col("step_idx") + 1).cast("string")) + F.when(why > 0, why + len(WHY) + 1).otherwise(0) + F.length("action_wire_json")
    upto = Window.partitionBy("session_id").orderBy("step_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("session_id").orderBy("step_idx").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    out = sized(steps).withColumn("full", (F.col("n_hist") + rest).cast("long")).withColumn("dropped", (F.lit(len(OMITTED)) + rest).cast("long"))
    out = out.withColumn("cum_full", total("full")).withColumn("cum_dropped", total("dropped")).withColumn("cum_page", total(F.col("n_hist").cast("long")))
    return out.withColumn("peak", F.max(F.col("cum_full") - F.col("cum_dropped")).over(upto))


def below(size: str, value: str, limit: str) -> str:
    """SQL: how many of the first size elements of a, whose value never falls, have one below the limit."""
    return f"aggregate(array({BITS}), 0, (c, p) -> if(c + p <= {size} and get(a, c + p - 1).{value} < {limit}, c + p, c))"


def session_rows(steps: DataFrame, personas: DataFrame, compressed: bool, *carried: str) -> DataFrame:
    """One row per session: its persona, furniture section, and a, the array of what is known of its steps, with the carried columns."""
    source = [rationale_source(F.col("rationale_synth"), F.col("rationale")).alias("source")] if "rationale_synth" in steps.columns else ["source"] if "source" in steps.columns else []
    known = [*source, F.col("n_cur").cast("long").alias("cur"), "cum_full", "cum_dropped", (F.col("cum_page") + (STEP_CHARS - GONE_CHARS) * F.col("step_idx")).alias("pages"), "cum_page", "peak"]
    pieces = F.col("pieces") if "pieces" in steps.columns else F.array().cast("array<string>")
    grouped = step_costs(steps.withColumn("pieces", pieces)).groupBy("session_id").agg(
        F.first("user_id").alias("user_id"), F.first("split").alias("split"), F.first("pieces").alias("pieces"), F.sort_array(F.collect_list(F.struct("step_idx", "action_id", *known, *carried))).alias("a")
    )
    if "obs_cur" in carried:
        # personas meet sessions by their ids alone, so that pages don't travel again
        people = steps.groupBy("session_id").agg(F.first("user_id").alias("user_id")).join(personas, "user_id", "left").select("session_id", "persona")
        met = grouped.join(people, "session_id")
    else:
        met = grouped.join(personas, "user_id", "left")
    section = furniture_section(F.col("pieces")) if compressed else F.lit("")
    return met.withColumn("persona", F.coalesce("persona", F.lit("{}"))).withColumn("section", section).withColumn("piece_chars", F.expr(f"aggregate(pieces, 0L, (x, p) -> x + length(p) + {PIECE_CHARS})"))


def fits(rows: DataFrame, budget: int, plain: bool) -> DataFrame:
    """Adds f, for each step: t (its element of a), pre_drop, k (pages left out, null if the current page must be cut), j (how often it is halved, or null) and n (characters)."""
    base = f"({fixed_length()} + length(persona) + length(section))"
    first = "0"
    if not plain:
        first = f"least(t.step_idx, {below('(t.step_idx + 1)', 'pages', f'({BASE_CHARS} + length(persona) + piece_chars + t.pages + {GONE_CHARS} * t.step_idx + t.cur + {STEP_CHARS} - {budget})')})"
    fixed = f"({base} + length(cast(t.step_idx + 1 as string)))"
    rows = rows.withColumn("f", F.expr(f"transform(a, t -> named_struct('t', t, 'pre_drop', {first}, 'over', {fixed} + t.cum_dropped, 'need', {fixed} + t.cur + t.cum_full - {budget}))"))
    saved = lambda i: f"(get(a, {i}).cum_full - get(a, {i}).cum_dropped)"
    # pages shorter than the marker make savings fall; only where that hides an early crossing are all numbers tried
    found = below("(f.t.step_idx + 1)", "peak", "f.need")
    k = f"case when {saved('f.pre_drop')} >= f.need then f.pre_drop when get(a, f.pre_drop).peak < f.need then nullif({found}, f.t.step_idx + 1) else get(filter(sequence(f.pre_drop, f.t.step_idx), i -> {saved('i')} >= f.need), 0) end"
    rows = rows.withColumn("f", F.expr(f"transform(f, f -> named_struct('t', f.t, 'pre_drop', f.pre_drop, 'over', f.over, 'need', f.need, 'k', {k}))"))
    # cur is a long: an int shifted by 32 or more is shifted by the rest of 32
    tried = f"filter(sequence(1, 40), i -> shiftright(f.t.cur, i - 1) > {PLAIN_LEAST if plain else LEAST})"
    j = f"if(f.k is null, coalesce(get(filter({tried}, i -> f.over + shiftright(f.t.cur, i) + {len(CUT)} <= {budget}), 0), array_max({tried})), null)"
    rows = rows.withColumn("f", F.expr(f"transform(f, f -> named_struct('t', f.t, 'pre_drop', f.pre_drop, 'over', f.over, 'need', f.need, 'k', f.k, 'j', {j}))"))
    n = f"case when f.k is not null then f.need + {budget} - {saved('f.k')} when f.j is null then f.over + f.t.cur else f.over + shiftright(f.t.cur, f.j) + {len(CUT)} end"
    return rows.withColumn("f", F.expr(f"transform(f, f -> named_struct('t', f.t, 'pre_drop', f.pre_drop, 'k', f.k, 'j', f.j, 'n', {n}))"))


def counters(rows: DataFrame, max_tokens: int, chars_per_token: int, plain: bool) -> list[Column]:
    """rows: with s, an element of f."""
    f = lambda c: F.col(f"s.{c}")
    n = F.ceil(f("n") / chars_per_token)
    return [
        f("t.step_idx").alias("step_idx"),
        f("t.action_id").alias("action_id"),
        f("pre_drop").cast("int").alias("pre_drop"),
        (n if plain else F.least(n, F.lit(max_tokens))).cast("int").alias("n_prompt_tokens"),
        F.when(f("k").isNull(), 0).otherwise(f("t.step_idx") - f("k")).cast("int").alias("n_history_full_html"),
        F.coalesce(f("k"), f("t.step_idx")).cast("int").alias("n_history_dropped_html"),
        f("k").isNull().alias("current_truncated"),
        *([f("t.source").alias("rationale_source")] if "source" in rows.schema["s"].dataType["t"].dataType.names else []),
    ]


def fitted(steps: DataFrame, personas: DataFrame, max_tokens: int = MAX_TOKENS, compressed: bool = True, chars_per_token: int = 4, plain: bool = False) -> DataFrame:
    """Counters of one sample per step, from lengths alone.

    steps: session_id, user_id, split, step_idx, action_id, why, action_wire_json, obs_cur, obs_hist, and pieces
    where furniture was replaced. The smallest number of oldest pages to leave out is found, from a first
    estimate on. If even without any of them it is too long, the current page is halved while over LEAST
    characters; what is then still over keeps the last max_tokens tokens. plain: the variant without
    estimate, that stops halving at PLAIN_LEAST and may stay over.
    """
    rows = fits(session_rows(steps, personas, compressed), chars_per_token * max_tokens, plain)
    one = rows.select("user_id", "session_id", "split", F.explode("f").alias("s"))
    return one.select("user_id", "session_id", "split", *counters(one, max_tokens, chars_per_token, plain))


def samples(steps: DataFrame, personas: DataFrame, max_tokens: int = MAX_TOKENS, compressed: bool = True, chars_per_token: int = 4, plain: bool = False, pages: Legs | None = None, humans: Legs | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """The whole samples, with the columns of sources.files.SAMPLE. steps as in fitted, with action_json, rationale and rationale_synth.

    pages and humans: where texts are kept apart, functions from keyed rows (session_id, step_idx and keys) to the
    rows' texts: obs_cur with obs_hist or with begin and end, the part of it that history shows (null: all); and rationale
    of those that have one. steps then has lengths (n_cur, n_hist, n_why), source, synth and these keys instead of texts,
    and each text goes through one shuffle, from its table to its session.
    """
    budget = chars_per_token * max_tokens
    given = [*TEXTS, "action_wire_json", "action_json"] if pages is None else [*keys, "synth", "action_wire_json", "action_json"]
    rows = fits(session_rows(steps, personas, compressed, *given), budget, plain)
    what = {c: f"f.t.{c}" for c in ("step_idx", "action_id", "source", "cur", "action_wire_json", "action_json")} | {c: f"f.{c}" for c in "kjn"} | {"why": "coalesce(f.t.why, '')" if pages is None else "f.t.synth"}
    what = ", ".join(f"'{k}', {v}" for k, v in what.items())
    head = rows.select("user_id", "session_id", "split", "persona", "pieces", F.expr(f"transform(f, f -> named_struct({what}))").alias("f"), *([F.expr(TEXT_ROWS).alias("texts")] if pages is None else []))
    if pages is None:
        whole = head
    else:
        keyed = rows.select("session_id", F.explode("f").alias("f")).select("session_id", "f.t.step_idx", *[f"f.t.{c}" for c in keys], "f.t.source")
        text = lambda df: F.struct("step_idx", *[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in TEXT.items()])
        legs = [head.select("session_id", F.struct(*[c for c in head.columns if c != "session_id"]).alias("head"))]
        legs += [df.select("session_id", text(df).alias("text")) for df in (pages(keyed), humans(keyed.where("source = 'human'")))]
        met = legs[0].unionByName(legs[1], allowMissingColumns=True).unionByName(legs[2], allowMissingColumns=True).repartition("session_id")
        whole = met.groupBy("session_id").agg(F.first("head", ignorenulls=True).alias("head"), F.collect_list("text").alias("texts")).select("session_id", "head.*", "texts")
    schema = ", ".join(f"{c} {kind}" for c, kind in whole.select("user_id").dtypes) + SAMPLE_TAIL
    return in_order(whole.mapInArrow(rendering(max_tokens, compressed, chars_per_token, plain, str(whole.schema["user_id"].dataType.simpleString())), schema))


#: The texts of a step, and those that a session's rows may have for one, each from its own leg.
TEXTS = ("obs_cur", "obs_hist", "why", "rationale")
TEXT = {"obs_cur": "string", "obs_hist": "string", "begin": "int", "end": "int", "rationale": "string"}
TEXT_ROWS = "transform(a, t -> named_struct('step_idx', t.step_idx, 'obs_cur', t.obs_cur, 'obs_hist', t.obs_hist, 'begin', cast(null as int), 'end', cast(null as int), 'rationale', t.rationale))"
SAMPLE_TAIL = ", session_id string, step_idx int, action_id string, split string, prompt_text string, completion_text string, action_gt string, rationale_gt string, rationale_source string, n_prompt_tokens int, n_completion_tokens int, n_total_tokens int, n_history_full_html int, n_history_dropped_html int, current_truncated boolean"
#: Samples go back to Spark by so many characters.
OUT_CHARS = 4_000_000


def rendering(max_tokens: int, compressed: bool, chars_per_token: int, plain: bool, user: str):
    """Function over Arrow batches of sessions: their prompts and completions. A prompt that is cut and still too long keeps its last characters."""
    budget = chars_per_token * max_tokens
    tokens = lambda n: -(-n // chars_per_token)

    def sample(s: dict):
        steps, pages, rationales = s["f"], {}, {}
        for x in s["texts"]:
            if x["obs_cur"] is not None:
                hist = x["obs_hist"]
                pages[x["step_idx"]] = x["obs_cur"], hist if hist is not None else cut_out(x["obs_cur"], x["begin"], x["end"])
            if x["rationale"] is not None:
                rationales[x["step_idx"]] = x["rationale"]
        begin, end = frame(s["persona"], s["pieces"] if compressed else None)
        full, gone = [], []
        for t in steps:
            i = t["step_idx"]
            page, hist = pages.get(i, ("", ""))
            rationale = rationales.get(i, "")
            why = t["why"] if t["why"] is not None else rationale
            k = i if t["k"] is None else t["k"]
            if t["j"] is not None:
                page = page[: t["cur"] >> t["j"]] + CUT
            text = begin + "".join(gone[:k]) + "".join(full[k:]) + f"{CURRENT}{i + 1})\n" + page + end
            if not plain and t["k"] is None and len(text) > budget:
                text = text[-budget:]
            said = completed(why, t["action_wire_json"])
            n, m = tokens(t["n"]) if plain else min(tokens(t["n"]), max_tokens), tokens(len(said))
            yield len(text) + len(said) + len(rationale), (s["user_id"], s["session_id"], i, t["action_id"], s["split"], text, said, t["action_json"], rationale, t["source"], n, m, n + m, 0 if t["k"] is None else i - k, k, t["k"] is None)
            full.append(block(i + 1, hist, why, t["action_wire_json"]))
            gone.append(block(i + 1, OMITTED, why, t["action_wire_json"]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64() if user == "bigint" else pa.int32() if user == "int" else pa.string()] + [ARROW[part.split(" ")[1]] for part in SAMPLE_TAIL[2:].split(", ")]
        names = ["user_id"] + [part.split(" ")[0] for part in SAMPLE_TAIL[2:].split(", ")]
        out, held = [], 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        for batch in batches:
            for i in range(batch.num_rows):
                for n, row in sample(batch.slice(i, 1).to_pylist()[0]):
                    out.append(row)
                    held += n
                    if held > OUT_CHARS:
                        yield done()
                        out, held = [], 0
        if out:
            yield done()

    return work


ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
#: Unicode white space, as a regular expression's (?U)\\s has it.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def frame(persona: str, pieces: list[str] | None) -> tuple[str, str]:
    """What stands before a prompt's history, and after its current page. As chat and user_prompt have it."""
    section = "" if pieces is None else FURNITURE + "".join(f"[[F{k}]] =\n{p}\n" for k, p in enumerate(pieces, 1)) + "\n\n" if pieces else "\n"
    return f"{CHAT_SYSTEM}{SYSTEM}{CHAT_USER}{PERSONA}{persona}\n\n{section}{HISTORY}", TASK + CHAT_ASSISTANT


def block(number: int, page: str, why: str, wire: str) -> str:
    """step_block of Python values."""
    return f"{STEP}{number}\n{PAGE}{page}\n\n" + (f"{WHY}{why}\n" if why else "") + f"{ACTION}{wire}\n\n"


def completed(why: str, wire: str) -> str:
    """completion of Python values."""
    return f'{{"action": {wire}, "rationale": {json.dumps(why.strip(BLANK), ensure_ascii=False)}}}'


def in_order(rows: DataFrame) -> DataFrame:
    from driftloom.sources.files import SAMPLE

    return rows.select(*[part.split(" ")[0] for part in SAMPLE.split(", ")])


def counted_fit(render: Callable[[int, str], str], count: Callable[[str], int], keep_last: Callable[[str, int], str], first: int, steps: int, page: str, most: int) -> tuple[str, int, int, bool]:
    """Prompt, tokens, pages left out and whether the current page was cut, of render(pages left out, current page), under any count."""
    for gone in range(first, steps + 1):
        text = render(gone, page)
        if (n := count(text)) <= most:
            return text, n, gone, False
    while len(page) > LEAST:
        page = page[: len(page) // 2]
        text = render(steps, page + CUT)
        if (n := count(text)) <= most:
            return text, n, steps, True
    return (keep_last(text, most), most, steps, True) if n > most else (text, n, steps, True)


def samples_by(steps: DataFrame, personas: DataFrame, count: Callable[[str], int], keep_last: Callable[[str, int], str], max_tokens: int = MAX_TOKENS, compressed: bool = True) -> DataFrame:
    """As samples, with any token counter. count(text): its tokens; keep_last(text, n): the text of its last n tokens. The first estimate takes four characters for a token."""
    from driftloom.sources.files import SAMPLE

    block = lambda page: step_block(F.col("step_idx") + 1, page, F.col("why"), F.col("action_wire_json"))
    said = {"block": block(F.col("obs_hist")), "gone": block(F.lit(OMITTED)), "completion": completion(F.col("why"), F.col("action_wire_json")), "rationale_gt": F.coalesce("rationale", F.lit(""))}
    rows = fits(session_rows(steps.withColumns(said), personas, compressed, "obs_cur", "action_json", *said), 4 * max_tokens, False).withColumn("first", F.expr("transform(f, f -> f.pre_drop)"))
    blocks, number, page = map(F.lit, MARKS)
    frame = chat(user_prompt(F.col("persona"), F.array(blocks), number, page, F.col("pieces") if compressed else None))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for session in batch.itertuples():
                begin, middle, before, end = re.split("|".join(MARKS), session.frame)
                out = []
                for t, step in enumerate(session.a):
                    render = lambda gone, page, t=t: begin + "".join([s["gone"] for s in session.a[:gone]] + [s["block"] for s in session.a[gone:t]]) + middle + str(t + 1) + before + page + end
                    text, n, gone, cut = counted_fit(render, count, keep_last, session.first[t], t, step["obs_cur"], max_tokens)
                    m = count(step["completion"])
                    out.append((session.user_id, session.session_id, step["step_idx"], step["action_id"], session.split, text, step["completion"], step["action_json"], step["rationale_gt"], step["source"], n, m, n + m, 0 if cut else t - gone, gone, cut))
                yield pd.DataFrame(out, columns=[part.split(" ")[0] for part in SAMPLE.split(", ")])

    return rows.select(F.col("user_id").cast("string").alias("user_id"), "session_id", "split", "a", "first", frame.alias("frame")).mapInPandas(work, SAMPLE)


def summary(packed: DataFrame, furniture: DataFrame | None = None) -> DataFrame:
    """What a split's samples amount to, rounded as in manifests. furniture: split, pieces of each session."""
    out = packed.groupBy("split").agg(
        F.countDistinct("session_id").alias("sessions"),
        F.count("*").alias("samples"),
        F.count_if("current_truncated").alias("samples_with_current_truncated"),
        F.round(F.avg("n_history_dropped_html"), 2).alias("mean_history_dropped_per_sample"),
        F.round(F.avg("n_prompt_tokens"), 1).alias("mean_prompt_tokens"),
        F.max("n_prompt_tokens").alias("max_prompt_tokens"),
        F.count_if(F.col("rationale_source") == "human").alias("rationale_human"),
        F.count_if(F.col("rationale_source") == "synthetic").alias("rationale_synthetic"),
    )
    if furniture is None:
        return out
    sums = furniture.select("split", F.size("pieces").alias("n"), F.expr("aggregate(pieces, 0L, (x, p) -> x + length(p))").alias("c")).groupBy("split")
    return out.join(sums.agg(F.sum("n").alias("furniture_pieces_total"), F.sum("c").alias("furniture_chars_total"), F.round(F.avg("c"), 1).alias("furniture_chars_per_session_mean")), "split", "left")


def fast_fit(base: int, full: list[int], dropped: list[int], most: int) -> int:
    """Number of oldest steps to drop: each drop swaps a step's full cost for its dropped one, until the sum fits."""
    total, k = base + sum(full), 0
    while total > most and k < len(full):
        total, k = total + dropped[k] - full[k], k + 1
    return k

