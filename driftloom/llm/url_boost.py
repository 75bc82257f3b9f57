"""URL filter: longest-rule verdicts, and gradient-boosted trees for URLs that no rule fits.

Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to
?, # or the end; both empty for a null url or one without ://. A rule (host and path) fits its
host and all subdomains if the url's path starts with the rule's; the longest rule wins.

The method's verdict comes from boosted trees of depth DEPTH over lexical features: lengths,
depth, digit ratio, entropy of characters, parameter and separator counts, and two statistics of
the host's suffix (blocked share and frequency among the training URLs). They are trained with
logistic loss on every labelled URL: suffixes are counted over all of them, and bins end at exact
quantiles. Labels come from the caller, or else from
seed words: a URL counts as unwanted if a part of its host, between dots and hyphens, is one; the
trees see no words, so they carry that over to hosts that look alike. URLs whose features fall into
the same bins are one weighted row, as the trees can't tell them apart; sums are decimals, so that
their order doesn't matter. Each level of a tree is one group-by over (node, feature, bin) with at
most a few hundred rows. The trees become one SQL expression, so judging is a projection of the
scan, joined with the statistics of suffixes. Everything is DataFrame functions.

Result for each page: page_id, host, path, rule (null if none fits), verdict (allow or
block: the rule's, else the trees'), score (the trees' probability of block). Without any labelled
URL the score is 0.5 and the trees allow. Repeated rows give repeated rows; null page_id stays
null; very long urls are judged whole; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.arrowkit import HOT_ROWS, HOT_SHARE, cut_lineage, forget, n_partitions

#: Rules as host, path and verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Parts of hosts that label a URL as unwanted.
SEEDS = ("ad", "ads", "adult", "bet", "bets", "betting", "bingo", "casino", "cheap", "clickbait", "crack", "dating", "escort", "keygen", "loan", "loans", "lottery", "payday", "pharma", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "torrent", "track", "tracker", "viagra", "warez", "xxx")
ROUNDS, DEPTH, BINS, RATE, RIDGE, LEAST_WEIGHT = 10, 2, 8, 0.4, 1.0, 1.0
LEXICAL = ("f_length", "f_host", "f_path", "f_depth", "f_digits", "f_entropy", "f_parameters", "f_hyphens", "f_dots", "f_secure")
FEATURES = (*LEXICAL, "f_blocked", "f_common")


def ascii_lower(text: Column) -> Column:
    """A-Z only; all other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_urls(pages: DataFrame) -> DataFrame:
    """page_id, url (null: empty), host, path, suffix."""
    url = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")).withColumn("_at", F.instr("url", "://"))
    rest = url.withColumn("_rest", F.expr("if(_at > 0, substring(url, _at + 3), '')"))
    parts = rest.select("page_id", "url", ascii_lower(F.regexp_extract("_rest", "^[^/?#]*", 0)).alias("host"), F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1).alias("path"))
    return parts.withColumn("suffix", F.substring_index("host", ".", -1))


def rule_columns(parts: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and ruled, the name and the verdict of the longest rule that fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, kind in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return parts.withColumn("rule", name).withColumn("ruled", verdict)


def _count(text: str, what: str) -> Column:
    return F.expr(f"cast(length({text}) - length(replace({text}, '{what}', '')) as double)")


def lexical(parts: DataFrame) -> DataFrame:
    """Adds the lexical features."""
    size = F.greatest(F.length("url"), F.lit(1)).cast("double")
    entropy = F.expr("round(aggregate(transform(array_distinct(filter(split(url, ''), c -> c <> '')), c -> (length(url) - length(replace(url, c, ''))) / length(url)), 0D, (s, p) -> s - p * ln(p)), 6)")
    return (
        parts.withColumn("f_length", F.length("url").cast("double"))
        .withColumn("f_host", F.length("host").cast("double"))
        .withColumn("f_path", F.length("path").cast("double"))
        .withColumn("f_depth", _count("path", "/"))
        .withColumn("f_digits", (F.length("url") - F.length(F.regexp_replace("url", "[0-9]", ""))) / size)
        .withColumn("f_entropy", F.coalesce(entropy, F.lit(0.0)))
        .withColumn("f_parameters", _count("url", "=") + _count("url", "&"))
        .withColumn("f_hyphens", _count("url", "-"))
        .withColumn("f_dots", _count("host", "."))
        .withColumn("f_secure", F.col("url").startswith("https").cast("double"))
    )


def quantiles(rows: DataFrame, names: tuple[str, ...], shares: list[float]) -> list[list[float]]:
    """Exact quantiles of columns without nulls, interpolated as percentile() does. Distinct values are sorted in ranges, so no task holds all of a column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).alias("value")) for i, f in enumerate(names)])).alias("x")
    counts = rows.select(pairs).groupBy("x.feature", "x.value").agg(F.count("*").alias("n"))
    placed = cut_lineage(counts.repartitionByRange(n_partitions(rows.sparkSession), "feature", "value").withColumn("part", F.spark_partition_id()))
    sums: dict[int, list[tuple[int, int]]] = {}
    for r in placed.groupBy("feature", "part").agg(F.sum("n").alias("n")).orderBy("feature", "part").collect():
        sums.setdefault(r.feature, []).append((r.part, r.n))
    last = sum(n for _, n in sums[0]) - 1
    wanted = []
    for rank in sorted({f(last * q) for q in shares for f in (math.floor, math.ceil)}):
        for feature, parts in sums.items():
            before = 0
            for part, n in parts:
                if before <= rank < before + n:
                    wanted.append((feature, part, rank, rank - before))
                before += n
    places = F.broadcast(placed.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).cast("long").alias(k) for k, x in zip(("feature", "part", "rank", "place"), w)]) for w in wanted]))))
    running = placed.withColumn("upto", F.sum("n").over(Window.partitionBy("feature", "part").orderBy("value")))
    found = running.join(places, ["feature", "part"]).where("place >= upto - n and place < upto")
    value = {(r.feature, r.rank): r.value for r in found.select("feature", "rank", "value").collect()}
    forget(placed)

    def at(feature: int, position: float) -> float:
        low, high = math.floor(position), math.ceil(position)
        a, b = value[feature, low], value[feature, high]
        return a if a == b else (high - position) * a + (position - low) * b

    return [[at(i, last * q) for q in shares] for i in range(len(names))]


def join_suffixes(left: DataFrame, suffixes: DataFrame, how: str = "inner") -> DataFrame:
    """join_hot by suffix without Python: rows of hot suffixes don't meet in one task."""
    counts = left.groupBy("suffix").agg(F.count("*").alias("n"))
    keys = F.broadcast(cut_lineage(counts.where(F.col("n") > max(HOT_ROWS, left.count() // HOT_SHARE)).select("suffix")))
    few = F.broadcast(suffixes.join(keys, "suffix", "left_semi"))
    return left.join(keys, "suffix", "left_anti").join(suffixes, "suffix", how).unionByName(left.join(keys, "suffix", "left_semi").join(few, "suffix", how))


def _margin(start: float, trees: list[str]) -> str:
    return " + ".join([f"{start!r}D", *trees])


def seed_labels(parts: DataFrame) -> DataFrame:
    """Adds y: 1 for a URL with a seed word in its host, 0 for any other with a host, else null."""
    seeds = F.array(*[F.lit(s) for s in SEEDS])
    return parts.withColumn("y", F.when(F.col("host") != "", F.arrays_overlap(F.split("host", "[.-]"), seeds).cast("double")))


def train(parts: DataFrame) -> tuple[DataFrame | None, float, str | None]:
    """Statistics of all suffixes, overall blocked share, and the trees' margin as SQL (both None without labelled URLs). Every labelled URL counts."""
    labelled = cut_lineage(lexical(parts.where("y is not null")).select("suffix", F.col("y").cast("double").alias("y"), *LEXICAL))
    counted = cut_lineage(labelled.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("y").alias("s")))
    n, positive = counted.agg(F.sum("n"), F.sum("s")).first()
    if not n:
        return None, 0.5, None
    overall = (positive + 1) / (n + 2)
    suffixes = counted.select("suffix", F.round((F.col("s") + 5 * overall) / (F.col("n") + 5), 6).alias("f_blocked"), F.col("n").cast("double").alias("f_common"))
    rows = join_suffixes(labelled, suffixes)
    cuts = {f: sorted({round(q, 6) for q in qs}) for f, qs in zip(FEATURES, quantiles(rows, FEATURES, [i / BINS for i in range(1, BINS)]))}
    bins = [F.struct(F.lit(i).alias("feature"), sum((F.col(f) > c).cast("int") for c in cuts[f]).alias("bin")) for i, f in enumerate(FEATURES)]
    # any value of a feature stands for its bin
    table = cut_lineage(rows.groupBy(*[x.getField("bin").alias(f"b_{i}") for i, x in enumerate(bins)]).agg(F.count("*").alias("n"), F.sum("y").alias("s"), *[F.min(f).alias(f) for f in FEATURES]))
    forget(labelled)
    start = round(math.log(overall / (1 - overall)), 6)
    trees: list[str] = []

    def histogram(nodes: list[str]) -> dict[int, dict[int, dict[int, tuple[float, float]]]]:
        """Sums of gradient and curvature by node, feature and bin, in one job."""
        node = "case " + " ".join(f"when {c} then {k}" for k, c in enumerate(nodes)) + " end"
        p = f"(1 / (1 + exp(-({_margin(start, trees)}))))"
        rows = table.select(F.expr(node).alias("node"), F.expr(f"cast(s - n * {p} as decimal(38, 12))").alias("g"), F.expr(f"cast(n * {p} * (1 - {p}) as decimal(38, 12))").alias("h"), F.explode(F.array(*bins)).alias("x"))
        out: dict = {}
        for r in rows.groupBy("node", "x.feature", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            out.setdefault(r.node, {}).setdefault(r.feature, {})[r.bin] = (float(r.g), float(r.h))
        return out

    def gain(g: float, h: float) -> float:
        return g * g / (h + RIDGE)

    for _ in range(ROUNDS):
        nodes = ["true"]
        for _ in range(DEPTH):
            new, sums = [], histogram(nodes)
            for k, condition in enumerate(nodes):
                best = (1e-6, None, None)
                for i, hist in sorted(sums.get(k, {}).items()):
                    whole = [sum(x) for x in zip(*hist.values())]
                    g = h = 0.0
                    for b, cut in enumerate(cuts[FEATURES[i]]):
                        g, h = g + hist.get(b, (0, 0))[0], h + hist.get(b, (0, 0))[1]
                        if min(h, whole[1] - h) >= LEAST_WEIGHT / 4:
                            better = round(gain(g, h) + gain(whole[0] - g, whole[1] - h) - gain(*whole), 6)
                            if better > best[0]:
                                best = (better, FEATURES[i], cut)
                if best[1] is None:
                    new.append(condition)
                else:
                    new += [f"({condition} and {best[1]} <= {best[2]!r}D)", f"({condition} and {best[1]} > {best[2]!r}D)"]
            nodes = new
        sums, leaves = histogram(nodes), []
        for k, condition in enumerate(nodes):
            hist = next(iter(sums.get(k, {}).values()), {})
            g, h = (sum(x) for x in zip(*hist.values())) if hist else (0.0, 0.0)
            leaves.append(f"when {condition} then {round(RATE * g / (h + RIDGE), 6)!r}D")
        if len(nodes) == 1:
            break
        trees.append("case " + " ".join(leaves) + " else 0D end")
    forget(table)
    return suffixes, overall, _margin(start, trees)


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """One row per page; see above. labelled: url and y (1 unwanted, 0 wanted) to train on, or None for seed words."""
    parts = rule_columns(split_urls(pages))
    if labelled is None:
        training = seed_labels(parts)
    else:
        known = labelled.select("url", "y").groupBy("url").agg(F.max("y").alias("y"))
        training = split_urls(known.select(F.lit(None).cast("long").alias("page_id"), "url")).join(known, "url")
    suffixes, overall, margin = train(training)
    if margin is None:
        judged = parts.withColumn("score", F.lit(0.5))
    else:
        known = join_suffixes(parts, suffixes, "left").fillna({"f_blocked": overall, "f_common": 0.0})
        judged = lexical(known).withColumn("score", F.expr(f"1 / (1 + exp(-({margin})))"))
    verdict = F.coalesce("ruled", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
