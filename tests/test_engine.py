import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from driftloom import registry
from driftloom.functions.text import unquoted
from driftloom.operators import compress, enrich, metrics, parsing, redundancy, trajectories
from driftloom.operators.stemming import stem
from driftloom.sources import files
from driftloom.streaming.sessionize import append_each, first_writes, gap_sessions

SF = "/root/testdata/sf0.001"


def raw(spark, rows):
    return spark.createDataFrame(rows, "session_id string, user_id long, split string, event_id long, action_id string, ts string, action_type string, click_type string, semantic_id string, input_text string, observation string, rationale string")


def test_one_invalid_action_drops_its_session(spark):
    rows = [
        ("a", 1, "train", 2, "2", "t2", "click", "review", "n", None, "p2", None),
        ("a", 1, "train", 1, "1", "t1", "input", None, "n", "x", "p1", " "),
        ("b", 2, "test", 3, "3", "t1", "scroll", None, None, None, "p", "r"),
        ("b", 2, "test", 4, "4", "t2", "click", None, None, None, "p", "r"),
        (None, 3, "test", 5, "5", "t2", "click", None, None, None, "p", "r"),
        ("c", 3, "test", 7, "7", "t2", "terminate", None, None, None, None, "r"),
        ("c", 3, "test", 6, "6", "t2", "click", "purchase", None, None, "p", "r"),
    ]
    steps = trajectories.ordered_steps(raw(spark, rows))
    assert [tuple(r) for r in steps.select("session_id", "step_idx", "action_id").orderBy("session_id", "step_idx").collect()] == [("a", 0, "1"), ("a", 1, "2"), ("c", 0, "6"), ("c", 1, "7")]
    nested = trajectories.sessions(steps, spark.createDataFrame([(1, "{p}")], "user_id long, persona string"))
    got = {r.session_id: r for r in nested.collect()}
    assert got["a"].persona == "{p}" and got["c"].persona == "{}" and [s.action_id for s in got["a"].steps] == ["1", "2"]
    assert [(r.t, len(r.history)) for r in trajectories.samples(nested).where("session_id = 'a'").orderBy("t").collect()] == [(0, 0), (1, 1)]


def test_enrichment(spark):
    writes = spark.createDataFrame([("1", 1, "old"), ("1", 2, "new"), ("2", 3, ""), (None, 4, "x")], "action_id string, ordinal long, rationale string")
    cache = enrich.last_writes(writes)
    steps = spark.createDataFrame([("1", None), ("2", " "), ("3", None), ("4", "human")], "action_id string, rationale string")
    assert {r.action_id for r in enrich.pending(steps, cache).collect()} == {"3"}
    got = {r.action_id: (r.rationale, r.rationale_synth) for r in enrich.materialized(steps, cache).collect()}
    assert got == {"1": (None, "new"), "2": (None, None), "3": (None, None), "4": ("human", None)}


def test_client_retries():
    waits, answers = [], iter([RuntimeError("rate limit"), RuntimeError("down"), "", " said "])

    def client(_):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert enrich.ask(client, "p", sleep=waits.append) == "said"
    assert 60 <= waits[0] <= 65 and 10 <= waits[1] <= 12 and len(waits) == 2
    assert enrich.ask(lambda _: "", "p", sleep=waits.append) is None


@pytest.mark.parametrize("said", ["429", "Rate limit", "Quota exceeded", "RESOURCE_EXHAUSTED"])
def test_limits_are_known_by_their_words(said):
    assert enrich.limited(RuntimeError(said)) and not enrich.limited(RuntimeError("down"))


@pytest.mark.parametrize("said, bare", [(' "a b" ', "a b"), ("'a'", "a"), ('"', ""), ('"a', '"a'), ("", ""), ("\"a'", "\"a'"), ('" a "b" "', 'a "b"')])
def test_replies_lose_their_quotes(spark, said, bare):
    assert enrich.bare(said) == bare and (enrich.ask(lambda _: said, "p") or "") == bare
    assert spark.createDataFrame([(said,)], "s string").select(unquoted(F.col("s"))).first()[0] == bare


def test_synthesized(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "action_id string, prompt string")
    assert {tuple(r) for r in enrich.synthesized(df, lambda p: p.upper()).collect()} == {("1", "A"), ("2", "B")}


def macro(spark, pairs):
    df = metrics.class_scores(spark.createDataFrame(pairs, "pred string, gt string"))
    return {r.label: r for r in df.collect()}


def test_class_scores(spark):
    assert all(r.f1 == 1 for r in macro(spark, [("a", "a"), ("b", "b")]).values())
    got = macro(spark, [("a", "a"), ("a", "a"), ("a", "b"), (metrics.INVALID, "a")])
    assert got["b"].f1 == 0 and got[metrics.INVALID].support == 0 and abs(got["a"].f1 - 2 / 3) < 1e-12
    assert macro(spark, []) == {}


def test_class_scores_of_counted_rows(spark):
    pairs = [("a", "a"), ("a", "a"), ("a", "b"), (metrics.INVALID, "a")]
    counted = spark.createDataFrame([("a", "a", 2), ("a", "b", 1), (metrics.INVALID, "a", 1)], "pred string, gt string, n long")
    assert {r.label: r for r in metrics.class_scores(counted).collect()} == macro(spark, pairs)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["rouge_l", "numbered_html", "simplify_html", "evaluation_table", "samples_l2", "redundancy_furniture"])
def test_batches_to_python_are_bounded_by_bytes(spark, name):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    registry.QUERIES[name](spark, SF)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def test_last_steps(spark):
    rows = [(1, "a", 0, 1, None), (1, "a", 2, 2, None), (1, "a", 2, 3, None), (1, "b", None, 4, None)]
    schema = "user_id long, session_id string, step_idx int, event_id long, flagged boolean"
    assert {(r.session_id, r.event_id) for r in metrics.last_steps(spark.createDataFrame(rows, schema)).collect()} == {("a", 3), ("b", 4)}
    flagged = [(1, "a", 0, 1, True), (1, "a", 2, 2, None), (1, "a", 1, 3, True), (1, "b", 0, 4, False)]
    assert {(r.session_id, r.event_id) for r in metrics.last_steps(spark.createDataFrame(flagged, schema)).collect()} == {("a", 3)}


def test_outcome_percentile_and_advantage(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (None, None)], "p boolean, t boolean")
    r = metrics.outcome(df, F.col("p"), F.col("t")).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.n, r.precision, r.recall, r.f1) == (1, 1, 1, 1, 4, 0.5, 0.5, 0.5)
    v = spark.createDataFrame([(x,) for x in (1, 2, 3, 5, 7, 8, 9, 100)], "v int")
    r = metrics.summarised(v.select(F.lit("m").alias("measure"), F.col("v").alias("value"))).first()
    assert (r.n, r["mean"], r.p50, r.p90, r.p99, r["max"], r["min"], r["sum"]) == (8, 16.9, 5, 9, 9, 100, 1, 135)
    assert metrics.summarised(v.where("false").select(F.lit("m").alias("measure"), F.col("v").alias("value"))).count() == 0
    a = metrics.advantages(spark.createDataFrame([("g", 1.0), ("g", 3.0), ("h", 2.0)], "g string, reward double"), ["g"])
    assert sorted((x.g, x.advantage) for x in a.collect()) == [("g", -1.0), ("g", 1.0), ("h", 0.0)]


def test_files(spark, tmp_path):
    p = str(tmp_path)
    df = spark.createDataFrame([("1", "s", 0, "train", "m", "é")], files.CACHE)
    files.append_cache(df, f"{p}/cache")
    files.append_cache(df.unionByName(spark.createDataFrame([("2", "s", 1, "train", "m", "b")], files.CACHE)), f"{p}/cache")
    with open(f"{p}/cache/part-x.json", "w") as f:
        f.write('\n{bad\n{"session_id": "s"}\n')
    assert {(r.action_id, r.rationale) for r in files.cache(spark, f"{p}/cache").collect()} == {("1", "é"), ("2", "b")}
    for name, split in (("a", "train"), ("b", "test")):
        spark.range(2).withColumn(name, F.lit(1)).write.parquet(f"{p}/parts/{split}-0.parquet")
    got = files.split_parts(spark, f"{p}/parts")
    assert got.count() == 4 and set(got.columns) == {"id", "a", "b", "split"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.split_parts(spark, f"{p}/parts", ("train", "dev"))
    assert files.parquet_parts(spark, [], "x int").count() == 0
    files.write_csv(spark.range(3), f"{p}/csv")
    assert spark.read.option("header", "true").csv(f"{p}/csv").count() == 3
    m = files.manifest({"max": 1}, spark.createDataFrame([("train", 5)], "split string, samples long"), "0123456789abcdef")
    files.write_json(m, spark, f"{p}/m")
    assert json.loads(spark.read.text(f"{p}/m").first()[0])["splits"] == {"train": {"samples": 5}} and m["revision"] == "0123456789ab"


def test_step_tree(spark, tmp_path):
    d = tmp_path / "sessions/user_1/session_9"
    os.makedirs(d / "steps")
    (d / "steps/0.json").write_text('{"step_idx": 0, "html_path": "html/0.html"}')
    (d / "steps/1.json").write_text('{"step_idx": 1, "html_path": "html/none.html"}')
    os.makedirs(d / "html")
    (d / "html/0.html").write_text("<p>\nx</p>")
    assert {tuple(r) for r in files.step_tree(spark, str(tmp_path)).collect()} == {("session_9", 0, "<p>\nx</p>"), ("session_9", 1, "")}


def test_stream_is_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    batch = {(r.user_id, r.start, r.n_events) for r in gap_sessions(events).collect()}
    events.orderBy("ts").write.parquet(f"{tmp_path}/in")
    stream = gap_sessions(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("gaps").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.user_id, r.start, r.n_events) for r in spark.table("gaps").collect()} == batch


def test_stream_into_cache(spark, tmp_path):
    df = spark.createDataFrame([("1", "s", 0, "train", "m", "a"), ("1", "s", 0, "train", "m", "a")], files.CACHE)
    df.write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(files.CACHE).json(f"{tmp_path}/in").withColumn("at", F.current_timestamp())
    q = append_each(first_writes(stream), f"{tmp_path}/cache", f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert files.cache(spark, f"{tmp_path}/cache").count() == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_is_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    shown = lambda x: round(x, 9) if isinstance(x, float) else x
    rows = sorted(([str(shown(r[c])) for c in columns] for r in got.collect()))
    if name not in registry.ORACLES:
        assert rows or name == "furniture_pieces"
        return
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    con.execute("set timezone='UTC'")
    result = con.execute(registry.ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted([str(shown(r[i])) for i in order] for r in result.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["anchor_slice", "mode_dispatch_l2", "step_saving", "prompt_costs", "pre_drop_k", "pack_summary", "fit_counters_none", "fit_counters_l2", "fit_counters_tight", "fit_counters_plain"])
def test_lengths_need_no_shuffled_text(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(registry.QUERIES[name](spark, SF)._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffled = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert shuffled and not [x for x in shuffled if re.search(r"\b(html|observation|obs_\w+|rationale|why)#|doc_id#.*\btext#", x)]


def odd_sessions(spark):
    rng = random.Random(3)
    chrome = "".join(rng.choice("abc ") for _ in range(900))
    pages = ["", "x", chrome, chrome + "!", "!" + chrome, chrome[:256], chrome[:255] + "?", chrome + "?" * 300 + chrome, "?" * 600, None, "é" + chrome, chrome[:600] + "-" + chrome[600:]]
    steps = [(f"s{s}", i, rng.choice([2, 3, 4, 7, 10, 11] if s % 3 == 0 else range(len(pages)))) for s in range(40) for i in range(rng.randrange(1, 5))] + [("same", i, 2) for i in range(3)]
    steps = spark.createDataFrame(steps, "session_id string, step_idx int, page_id long").join(spark.createDataFrame(list(enumerate(pages)), "page_id long, observation string"), "page_id")
    return steps.cache(), steps.select("page_id", F.coalesce("observation", F.lit("")).alias("page")).distinct()


def test_pairs_from_the_ends_of_pages(spark):
    steps, pages = odd_sessions(spark)
    want = redundancy.adjacent(steps)
    got = redundancy.adjacent_of(steps.select("session_id", "step_idx", "page_id", F.length(F.coalesce("observation", F.lit(""))).alias("len")), pages)
    rows = lambda df: sorted(tuple(-1 if x is None else x for x in r) for r in df.select("session_id", "step_idx", "len", "before_len", "lcp", "lcs").collect())
    assert rows(got) == rows(want) and max(r.lcp or 0 for r in got.collect()) >= 900
    held = {}
    for r in steps.collect():
        held.setdefault(r.session_id, []).append(r.observation or "")
    assert {r.session_id: (r.n, r.prefix, r.suffix) for r in redundancy.shared_ends(got).collect()} == {k: (len(v), *redundancy.common_ends(v)) for k, v in held.items()}


def test_no_session_with_furniture_is_passed_over(spark):
    steps, pages = odd_sessions(spark)
    found = {r.session_id for r in compress.furnished(steps, compress.page_prints(pages)).collect()}
    held = {}
    for r in steps.collect():
        held.setdefault(r.session_id, []).append(r.observation or "")
    have = {k for k, v in held.items() if compress.find_furniture(v, n_samples=10**6) or compress.furniture_estimate(v)}
    assert have and have <= found < set(held) and "same" in found
    a = "".join(random.Random(i).choice("xyz") for i in range(500))
    for n in (0, 17, 300):
        assert set(compress.prints_of("p" * n + a[100:300])) & set(compress.prints_of(a + "q"))


def test_session_table_lookup_and_cap(spark):
    steps = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("b", 2, 0), ("c", 3, 0)], "session_id string, user_id long, step_idx int")
    table = spark.createDataFrame([("a", 7, 2), ("a", 8, 1), ("b", 9, 3), ("x", 1, 4), (None, 1, 5)], "session_id string, user_id long, ordinal long")
    assert sorted(map(tuple, trajectories.of_sessions(steps, table, "ordinal").select("session_id", "user_id", "step_idx").collect())) == [("a", 8, 0), ("a", 8, 1), ("b", 9, 0)]
    assert {r.session_id for r in trajectories.capped(steps, 2).collect()} == {"a", "b"}
    assert trajectories.session(steps, "b").user_id == 2
    with pytest.raises(LookupError):
        trajectories.session(steps, "z")


def test_pairs_must_match(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, p string")
    b = spark.createDataFrame([(1, "g"), (2, "h")], "id long, t string")
    assert sorted(map(tuple, metrics.paired(a, b, "id").select("id", "p", "t").collect())) == [(1, "x", "g"), (2, "y", "h")]
    for left, right in ((a, b.where("id = 1")), (a.where("id = 2"), b)):
        with pytest.raises(Exception, match="don't pair"):
            metrics.paired(left, right, "id").collect()


def test_rationale_quality(spark):
    rows = spark.createDataFrame([("a b", "a b"), ("a", "b"), (None, "a"), ("", "a"), ("a", None)], "pred_rationale string, rationale_gt string")
    r = metrics.rationale_quality(rows, parsing.rouge_l(F.col("pred_rationale"), F.col("rationale_gt"))).first()
    assert (r.n_paired, r.rouge_l_f1, r.bertscore_f1) == (2, 0.5, None)
    r = metrics.rationale_quality(rows.where("false"), F.lit(1.0)).first()
    assert (r.n_paired, r.rouge_l_f1) == (0, None)
    got = [x[0] for x in spark.createDataFrame([(" a ",), (" ",), (None,)], "s string").select(parsing.said(F.col("s"))).collect()]
    assert got == ["a", None, None]


@pytest.mark.parametrize(
    "word, out",
    [line.split() for line in """caresses caress|ponies poni|ties tie|caress caress|cats cat|feed feed|agreed agre|plastered plaster|bled bled|motoring motor|sing sing|conflated conflat|troubled troubl|sized size|hopping hop
tanned tan|falling fall|hissing hiss|fizzed fizz|failing fail|filing file|happy happi|sky sky|relational relat|conditional condit|rational ration|valenci valenc|digitizer digit|radicalli radic|differentli differ
vileli vile|analogousli analog|vietnamization vietnam|predication predic|operator oper|feudalism feudal|decisiveness decis|hopefulness hope|callousness callous|formaliti formal|sensitiviti sensit|sensibiliti sensibl
triplicate triplic|formative form|formalize formal|electriciti electr|electrical electr|hopeful hope|goodness good|revival reviv|allowance allow|inference infer|airliner airlin|gyroscopic gyroscop|adjustable adjust
defensible defens|irritant irrit|replacement replac|adjustment adjust|dependent depend|adoption adopt|homologou homolog|communism commun|activate activ|angulariti angular|homologous homolog|effective effect|bowdlerize bowdler
probate probat|rate rate|cease ceas|controll control|roll roll|dying die|news news|died die|flies fli|enjoy enjoy|is is|generously gener""".replace("\n", "|").split("|")],
)
def test_stems(word, out):
    assert stem(word) == out


def test_redundancy_of_small_sessions(spark):
    rows = [("a", 0, "xxAB"), ("a", 1, "xxCB"), ("a", 2, ""), ("b", 0, "alone"), ("c", 0, None), ("c", 1, "z")]
    steps = spark.createDataFrame(rows, "session_id string, step_idx int, observation string")
    r = redundancy.headroom(redundancy.adjacent(steps)).first()
    assert (r.raw_chars, r.dedup_chars, r.saving_pct_chars) == (9, 4 + 1 + 0 + 0 + 1, 33.3)
    r = redundancy.headroom(redundancy.adjacent(steps.where("session_id = 'b'"))).first()
    assert (r.raw_chars, r.dedup_chars, r.saving_pct_chars) == (0, 0, 0.0)
    got = {x.session_id: tuple(x)[1:] for x in redundancy.report(redundancy.per_session(steps)).collect()}
    assert got == {"a": (3, 8, 4, 2, 0), "c": (2, 1, 0, 0, 0)}
    m = {x.measure: x for x in metrics.summarised(redundancy.measures(steps)).collect()}
    assert len(m) == 10 and m["step_count"]["sum"] == 5 and m["adjacent_step_lcp_chars"].n == 1 and m["adjacent_step_ratio"]["mean"] == 0.8
    assert m["all_step_common_prefix_chars"]["max"] == 0 and m["html_chars_per_session_total"]["max"] == 8


def test_redundancy_report_file(spark, tmp_path):
    steps = spark.createDataFrame([("a", 0, "xxAB"), ("a", 1, "xxCB")], "session_id string, step_idx int, observation string")
    files.write_csv(redundancy.report(redundancy.per_session(steps)), f"{tmp_path}/csv")
    back = spark.read.option("header", "true").csv(f"{tmp_path}/csv")
    assert back.columns == ["session_id", "n_steps", "total_chars", "median_html", "adj_lcp_mean", "furniture_chars"] and tuple(back.first()) == ("a", "2", "8", "4", "2", "0")


def test_readers_of_lines(spark, tmp_path):
    from pyspark.sql import Row

    step = Row(step_idx=0, action_id="1", timestamp="t", observation="p", action_json="{}", action_wire_json="{}", rationale_gt=None, rationale_synth="s")
    df = spark.createDataFrame([("u", "s", "train", "{}", [step])], files.TRAJECTORY)
    files.write_jsonl(df, f"{tmp_path}/t")
    assert files.trajectories(spark, f"{tmp_path}/t").collect() == df.collect()
    p = spark.createDataFrame([("u", "s", 3, "{}", "{}", "r", True)], files.PREDICTION)
    files.write_jsonl(p, f"{tmp_path}/p")
    assert files.predictions(spark, f"{tmp_path}/p").collect() == p.collect()


def test_rouge_l_follows_the_rationales_not_the_ids(spark, monkeypatch):
    from driftloom.plans import queries

    rows = [(6, "six", True, "a b", "a b"), (7, "seven", True, "", "a b"), (8, "eight", True, "a b", ""), (9, "nine", True, "a b", None), (10, "ten", False, None, "a b"), (13, "more", True, "x", "y")]
    p = spark.createDataFrame(rows, "event_id long, action_id string, ok boolean, pred_rationale string, rationale_gt string")
    monkeypatch.setattr(queries, "parsed_predictions", lambda spark, d: p)
    assert {r.action_id for r in queries.rouge_l(spark, None).collect()} == {"six", "more"}


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.QUERIES) <= set(e.queries())
