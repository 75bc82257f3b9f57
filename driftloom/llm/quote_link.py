"""Quotation linking: conversations in reply order, without quotes.

A line that begins with > is quoted, as many levels deep as it has >; a run of lines of one level is
a passage. Passages are normalised (lower case, white space to single spaces), hashed,
and joined with what the conversation's earlier messages say for themselves: each whole
body, paragraph and line outside quotes, hashed alike. The latest such message is the
passage's origin. A passage without one is taken apart into its lines and into its paragraphs:
of the earlier messages that hold more than half of either in order, the one that holds the
largest share is the origin, of equal ones the latest. Empty lines don't count; a part of a
line is no quote of it. A message answers the origin of its first linked passage of level 1, or
else the message before it. A message that is the first answer to its parent goes on in that
one's thread, any other begins a thread of its own; in reply order a conversation's threads
stand by their first message, each with its messages by turn.

Result for each message: conv_id, turn, role, n_quotes, n_linked (passages of any level with an origin),
parent_turn (null for the first), thread (turn of its first message), reply_pos (from 0), text
(without quotes, trimmed), formatted (role header, text and end mark). Null text is empty; null role
is "unknown"; a very long message is parsed whole; messages with null conv_id or turn form no replies: they keep null parent, thread and position;
repeated rows stay, ordered by role and text, and their parent is the turn before theirs;
other columns are ignored.

A conversation may hold a third of all messages: they are range-partitioned by (conversation, turn), and
what a message needs to know of those before it is computed within each slice of a
conversation and carried over between slices by a table with one row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.arrowkit import cut_lineage, n_partitions

#: The > before a line, with blanks between them. Character classes alone, so that long lines need no deep stack.
MARKS = r"^([ \t>]*>)[ \t]?"
PARAGRAPHS, LINES = r"\n[ \t]*\n", r"\n"


def normalised(text: str) -> Column:
    return F.expr(f"trim(regexp_replace(lower({text}), '(?U)\\\\s+', ' '))")


def parsed(messages: DataFrame) -> DataFrame:
    """Adds body (what is not quoted) and passages (level and text of each quoted run)."""
    level = f"length(regexp_replace(regexp_extract(x, '{MARKS}', 1), '[^>]', ''))".replace("\\", "\\\\")
    rest = f"regexp_replace(x, '{MARKS}', '')".replace("\\", "\\\\")
    lines = messages.withColumn("_lines", F.expr(f"transform(split(replace(coalesce(text, ''), '\\r\\n', '\\n'), '\\n'), x -> named_struct('level', {level}, 'line', {rest}))"))
    body = F.expr("array_join(transform(filter(_lines, x -> x.level = 0), x -> x.line), '\\n')")
    starts = F.expr("filter(transform(_lines, (x, i) -> if(i = 0 or x.level <> get(_lines, i - 1).level, i, -1)), i -> i >= 0)")
    passages = F.expr(
        """filter(transform(_starts, (s, i) -> named_struct('pos', i, 'level', get(_lines, s).level,
             'text', array_join(transform(slice(_lines, s + 1, coalesce(get(_starts, i + 1), size(_lines)) - s), x -> x.line), '\n'))), p -> p.level > 0)"""
    )
    return lines.withColumn("_starts", starts).withColumn("body", F.trim(body, F.lit(" \t\r\n"))).withColumn("passages", passages).drop("_lines", "_starts")


def units(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, kind (0 paragraphs, 1 lines), i (from 0), hash of each paragraph and line of a text that says something."""
    parts = [f"transform(split({text}, '{cut}'), x -> named_struct('kind', {kind}, 'said', x))".replace("\\", "\\\\") for kind, cut in enumerate((PARAGRAPHS, LINES))]
    at = rows.select(*keys, F.posexplode(F.expr(f"concat({', '.join(parts)})")).alias("i", "u"))
    return at.select(*keys, "u.kind", "i", normalised("u.said").alias("said")).where("said <> ''").select(*keys, "kind", "i", F.sha2("said", 256).alias("hash"))


def partly_linked(passages: DataFrame, messages: DataFrame) -> DataFrame:
    """conv_id, turn, pos, own, part: the earlier message that holds the largest share, and more than half, of a passage's lines or paragraphs in order."""
    passage = ["conv_id", "turn", "pos", "own"]
    key = [*passage, "kind"]
    quoted = cut_lineage(units(passages, "quoted", passage).withColumn("n", F.count("*").over(Window.partitionBy(*key))).where("n > 1"))
    wanted = quoted.select("conv_id", "kind", "hash").distinct()
    # repeated turns are told apart by their bodies
    bodies = messages.select("conv_id", F.col("turn").alias("part"), "body", F.xxhash64("body").alias("which")).distinct()
    held = cut_lineage(units(bodies, "body", ["conv_id", "part", "which"]).withColumnRenamed("i", "at").join(wanted, ["conv_id", "kind", "hash"], "left_semi"))
    # a message with more than half of n units has one of any n - n div 2 of them: those that the fewest messages hold find all candidates
    holding = held.select("conv_id", "part", "which", "kind", "hash").distinct()
    holders = holding.groupBy("conv_id", "kind", "hash").agg(F.count("*").alias("holders"))
    ranked = quoted.join(holders, ["conv_id", "kind", "hash"], "left").withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.coalesce("holders", F.lit(0)), "i")))
    found = ranked.where("rank <= n - n div 2").join(holding, ["conv_id", "kind", "hash"]).where("part < turn").select(*key, "part", "which").distinct()
    hits = found.join(quoted, key).join(held, ["conv_id", "part", "which", "kind", "hash"])
    lists = hits.groupBy(*key, "part", "which", "n").agg(F.expr("array_sort(collect_list(named_struct('i', i, 'down', -at)))").alias("hits"))
    # longest rising run of places: the fold keeps, for each length, the least place at which a run of it ends
    rising = "aggregate(hits, cast(array() as array<int>), (t, h) -> concat(filter(t, y -> y < -h.down), array(-h.down), slice(filter(t, y -> y >= -h.down), 2, size(t) + 1)))"
    most = lists.withColumn("held", F.size(F.expr(rising))).where("2 * held > n")
    return most.groupBy(*passage).agg(F.max_by("part", F.struct(F.col("held") / F.col("n"), "part")).alias("part"))


def linked_passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, pos, level, origin (turn, or null) of each quoted passage."""
    quotes = (
        messages.where("size(passages) > 0")
        .select("conv_id", "turn", F.explode("passages").alias("p"))
        .select("conv_id", "turn", "p.pos", "p.level", F.col("p.text").alias("quoted"), normalised("p.text").alias("said"))
        .where("said <> ''")
        .select("conv_id", "turn", "pos", "level", "quoted", F.sha2("quoted", 256).alias("own"), F.sha2("said", 256).alias("hash"))
    )
    wanted = quotes.select("conv_id", "hash").distinct()
    said = messages.select("conv_id", "turn", F.explode(F.expr("array_distinct(concat(array(body), split(body, '\\\\n[ \\\\t]*\\\\n'), split(body, '\\\\n')))")).alias("said"))
    origins = said.select("conv_id", "turn", F.sha2(normalised("said"), 256).alias("hash")).join(wanted, ["conv_id", "hash"], "left_semi").distinct()
    both = quotes.withColumn("origin", F.lit(None).cast("long")).unionByName(origins.select("conv_id", "turn", "hash", F.col("turn").alias("origin")), allowMissingColumns=True)
    # one passage may be quoted by very many messages: within slices of its rows, then carried over slices
    dealt = sliced(both, ["conv_id", "hash", "turn"])
    before = Window.partitionBy("conv_id", "hash", "slice").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv_id", "hash").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    lasts = dealt.groupBy("conv_id", "hash", "slice").agg(F.max("origin").alias("_last"))
    carry = lasts.select("conv_id", "hash", "slice", F.max("_last").over(earlier).alias("_carry"))
    near = dealt.withColumn("origin", F.max("origin").over(before)).where("pos is not null")
    whole = cut_lineage(near.join(carry, ["conv_id", "hash", "slice"]).select("conv_id", "turn", "pos", "level", "quoted", "own", F.coalesce("origin", "_carry").alias("origin")))
    left = whole.where("origin is null").select("conv_id", "turn", "pos", "own", "quoted").distinct()
    if left.limit(1).count():
        whole = whole.join(partly_linked(left, messages), ["conv_id", "turn", "pos", "own"], "left").withColumn("origin", F.coalesce("origin", "part"))
    return whole.select("conv_id", "turn", "pos", "level", "origin")


def carried(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds number (from 0 in the conversation) and previous (turn before), slice by slice. rows has conv_id, slice, turn."""
    within = Window.partitionBy("conv_id", "slice").orderBy(*order)
    local = rows.withColumn("number", F.row_number().over(within) - 1).withColumn("previous", F.max("turn").over(Window.partitionBy("conv_id", "slice").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)))
    slices = rows.groupBy("conv_id", "slice").agg(F.count("*").alias("n"), F.max("turn").alias("last"))
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = slices.select("conv_id", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"), F.max("last").over(earlier).alias("_last"))
    return local.join(carry, ["conv_id", "slice"]).withColumn("number", F.col("number") + F.col("_n")).withColumn("previous", F.coalesce("previous", "_last")).drop("_n", "_last")


def sliced(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds slice: rows are range-partitioned by the keys, and written, so that a slice stays what it is."""
    return cut_lineage(rows.repartitionByRange(n_partitions(rows.sparkSession), *keys).withColumn("slice", F.spark_partition_id()))


def link_quotes(conversations: DataFrame) -> DataFrame:
    """One row per message; see above."""
    given = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), "text")
    messages = sliced(parsed(given), ["conv_id", "turn"])
    known = messages.where("conv_id is not null and turn is not null")
    links = cut_lineage(linked_passages(known))
    counts = links.groupBy("conv_id", "turn").agg(F.count("origin").alias("n_linked"), F.min_by("origin", "pos").alias("_any"), F.expr("min_by(origin, pos) filter (where level = 1 and origin is not null)").alias("answers"))
    turns = known.select("conv_id", "slice", "turn").distinct()
    placed = carried(turns, ["turn"]).join(counts.drop("_any"), ["conv_id", "turn"], "left").withColumn("parent", F.coalesce("answers", "previous"))
    placed = cut_lineage(placed.select("conv_id", "slice", "turn", "parent", "previous", F.coalesce("n_linked", F.lit(0)).alias("n_linked")))

    # a run is a stretch of messages that each answer the one before as its first answer
    first = placed.where("parent is not null").groupBy("conv_id", "parent").agg(F.min("turn").alias("_first"))
    marked = placed.join(first, ["conv_id", "parent"], "left").withColumn("goes_on", F.coalesce(F.col("_first") == F.col("turn"), F.lit(False)))
    heads = marked.where("not goes_on or parent <> previous").select("conv_id", "turn", F.when(F.col("goes_on"), F.col("parent")).alias("joins"))
    starts = cut_lineage(heads)
    jumps = starts.where("joins is not null")
    head_of = Window.partitionBy("conv_id", "slice").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    begun = marked.withColumn("_head", F.when(~F.col("goes_on") | (F.col("parent") != F.col("previous")), F.col("turn")))
    local = begun.withColumn("run", F.max("_head").over(head_of))
    last = begun.groupBy("conv_id", "slice").agg(F.max("_head").alias("_last"))
    over = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    runs = local.join(last.select("conv_id", "slice", F.max("_last").over(over).alias("_carry")), ["conv_id", "slice"]).select("conv_id", "turn", "parent", "n_linked", F.coalesce("run", "_carry").alias("run"))
    runs = cut_lineage(runs)
    # runs that go on in an earlier run's thread: pointers are doubled until they stand still
    up = jumps.join(runs.select("conv_id", F.col("turn").alias("joins"), F.col("run").alias("above")), ["conv_id", "joins"]).select("conv_id", F.col("turn").alias("run"), "above")
    up = cut_lineage(up)
    while True:
        nxt = cut_lineage(up.join(up.select("conv_id", F.col("run").alias("above"), F.col("above").alias("top")), ["conv_id", "above"], "left").select("conv_id", "run", F.coalesce("top", "above").alias("above"), F.col("top").isNotNull().alias("moved")))
        moved = nxt.where("moved").limit(1).count()
        up = nxt.select("conv_id", "run", "above")
        if not moved:
            break
    threads = runs.join(up, ["conv_id", "run"], "left").select("conv_id", "turn", F.col("parent").alias("parent_turn"), "n_linked", F.coalesce("above", "run").alias("thread"))

    rows = messages.drop("slice").join(threads, ["conv_id", "turn"], "left")
    ordered = sliced(rows, ["conv_id", "thread", "turn"])
    real = ordered.where("thread is not null")
    numbered = carried(real, ["thread", "turn", "role", "text"]).withColumn("reply_pos", F.col("number").cast("long"))
    whole = numbered.drop("number", "previous", "slice").unionByName(ordered.where("thread is null").drop("slice").withColumn("reply_pos", F.lit(None).cast("long")))
    return whole.select(
        "conv_id",
        "turn",
        "role",
        F.size("passages").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "parent_turn",
        "thread",
        "reply_pos",
        F.col("body").alias("text"),
        F.concat(F.lit("<|"), "role", F.lit("|>\n"), "body", F.lit("\n<|end|>\n")).alias("formatted"),
    )
