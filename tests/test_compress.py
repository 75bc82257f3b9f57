import random

import pytest
from pyspark.sql import functions as F

from driftloom.operators import compress as C
from driftloom.operators import html as H
from driftloom.operators import packing as K
from driftloom.operators import prompts as P
from driftloom.operators.redundancy import common_all, common_ends, common_length, overlap
from driftloom.sources import files


def noise(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))


@pytest.fixture
def pages():
    rng = random.Random(1)
    head, foot = noise(rng, 500), noise(rng, 300)
    return [head + noise(rng, 400) + foot for _ in range(3)]


def test_furniture_is_found_and_reversible(spark, pages):
    pieces = C.find_furniture(pages)
    assert sum(map(len, pieces)) >= 700
    for page in pages:
        out = C.apply_furniture(page, pieces)
        assert len(out) < len(page) / 2
        for k, piece in enumerate(pieces, 1):
            out = out.replace(f"[[F{k}]]", piece)
        assert out == page
    df = spark.createDataFrame([(pages,)], "pages array<string>").withColumn("pieces", C.furniture(F.col("pages")))
    row = df.select("pieces", C.with_furniture(F.col("pages")[0], F.col("pieces")).alias("out"), C.estimated(F.col("pages")).alias("n")).first()
    assert row.pieces == pieces and row.out == C.apply_furniture(pages[0], pieces) and row.n > 300


def every_extent(base, pages, begin, end):
    """Grown one character at a time."""
    while end < len(base) and all(base[begin : end + 1] in p for p in pages):
        end += 1
    while begin and all(base[begin - 1 : end] in p for p in pages):
        begin -= 1
    return begin, end


def test_extents_are_those_grown_by_one_character():
    rng = random.Random(4)
    for _ in range(50):
        parts = [noise(rng, rng.randrange(1, 30)) for _ in range(4)]
        pages = ["".join(rng.choice(parts) for _ in range(8)) for _ in range(3)]
        shared = C.Shared(pages[0], pages)
        for start in range(0, len(pages[0]) - 5, 3):
            if shared(start, start + 5):
                assert shared.around(start, start + 5) == every_extent(pages[0], pages, start, start + 5)


def test_greedy_furniture(pages):
    head, foot = pages[0][:500], pages[0][-300:]
    assert C.greedy_furniture(pages) == [head, foot]
    assert C.greedy_furniture([]) == [] and C.greedy_furniture([head]) == [head]
    # a piece that begins between two windows is grown to the left as well
    rng = random.Random(6)
    odd = [noise(rng, 130) + head + noise(rng, 300) for _ in range(2)]
    assert C.greedy_furniture(odd)[0] == head
    assert C.greedy_furniture(pages, max_pieces=1) == [head]


def test_pieces_of_sessions(spark, pages):
    rows = [("a", i, p) for i, p in enumerate(pages)] + [("b", 0, "x" * 900), ("c", 0, None), ("c", 1, "y")]
    got = {(r.session_id, r.step_idx): r.pieces for r in C.with_pieces(spark.createDataFrame(rows, "session_id string, step_idx int, observation string")).collect()}
    assert got["a", 0] == got["a", 2] == C.find_furniture(pages) and got["b", 0] == got["c", 0] == got["c", 1] == []


def test_furniture_of_few_or_unlike_pages():
    assert C.find_furniture(["x" * 999]) == [] and C.find_furniture(["short", "other"]) == [] and C.find_furniture([]) == []
    rng = random.Random(2)
    assert C.find_furniture([noise(rng, 900), noise(rng, 900)]) == []


@pytest.mark.parametrize("anchor, found", [("buy", True), ("gone", False), ("", False), (None, False)])
def test_anchor_slice(spark, anchor, found):
    html = "x" * 4000 + '<a name="buy">' + "y" * 4000
    r = spark.createDataFrame([(html, anchor)], "h string, a string").select(C.anchor_slice(F.col("h"), F.col("a"), window=200).alias("r")).first().r
    assert r.found is found
    if found:
        assert 'name="buy"' in r.out and r.kept == 400 and r.elided == len(html) - 400
        assert r.out.startswith("<!-- 3803 chars elided (head) -->") and r.out.endswith(" chars elided (tail) -->")
    else:
        assert r.out == html and r.elided == 0 and r.kept == len(html)


def test_anchor_at_the_start(spark):
    r = spark.createDataFrame([('<a name="b">zz', "b")], "h string, a string").select(C.anchor_slice(F.col("h"), F.col("a"), window=200).alias("r")).first().r
    assert r.out == '<a name="b">zz' and r.found and r.elided == 0


@pytest.mark.parametrize("wire, name", [('{"name": "n.m", "type": "click"}', "n.m"), ('{"type": "terminate"}', None), ("{bad", None), ("[1]", None)])
def test_action_name(spark, wire, name):
    assert spark.createDataFrame([(wire,)], "w string").select(C.action_name(F.col("w"))).first()[0] == name


def test_common_lengths(spark):
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(2))
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common_length(a, b) == n
    assert common_ends(["abcx", "abdx", "abx"]) == (2, 1)
    row = spark.createDataFrame([("abc", "abd", ["ab", "ac"])], "a string, b string, p array<string>").select(overlap(F.col("a"), F.col("b")).alias("o"), common_all(F.col("p")).alias("c")).first()
    assert (row.o.lcp, row.o.lcs, row.c.prefix, row.c.suffix) == (2, 0, 1, 0)


def test_element_ids():
    page = '<form id=f><a href="x&amp;y">t<br>u</a><option>o</option></form><label name=q data-el-id=9>z<textarea id=i name=n></textarea><button>'
    assert H.element_ids_of(page) == {"0": "form#f", "1": "a", "2": "label[name=q]", "3": "textarea#i", "4": "button"}
    assert H.with_element_ids('<form id=f><a href="x&amp;y">t<br>u</a><option>o</option></form><label data-el-id=9>z') == '<form id="f" data-el-id="0"><a href="x&amp;y" data-el-id="1">t<br/>u</a><option>o</option></form><label data-el-id="2">z</label>'
    assert H.element_ids_of("") == {} and H.element_ids_of("plain < text") == {}


@pytest.mark.parametrize(
    "page, out",
    [
        # six kinds of tags go with all they hold
        ("<p>a<script>b</script><style>c</style><noscript>d</noscript><svg><a>e</a></svg><meta name=x><link href=y>f</p>", "<p>af</p>"),
        # seven attributes stay, and data-el-id
        ('<input id=a name=b type=c value=d placeholder=e aria-label=f href=g class=h style=i title=j data-el-id=3 disabled>', '<input id="a" name="b" type="c" value="d" placeholder="e" aria-label="f" href="g" data-el-id="3"/>'),
        # iframes and options are no special case; form stays
        ("<form><option>o</option></form><iframe src=x></iframe>", "<form><option>o</option></form><iframe></iframe>"),
        # long texts are stripped and cut, blank ones go, others stay as they are
        ("<p>  " + "w" * 201 + " </p><p> \n </p><p> b  c </p>", "<p>" + "w" * 200 + "...</p><p></p><p> b c </p>"),
        ("<p>" + "w" * 200 + "</p>", "<p>" + "w" * 200 + "</p>"),
        # a div or span without attributes and with one child gives way to it, however deep
        ("<div class=x><div><span><b>t</b></span></div></div>", "<b>t</b>"),
        ('<div id=k><span>t</span></div><div>a<b>c</b></div><div></div>', '<div id="k">t</div><div>a<b>c</b></div><div></div>'),
        ("<div> <span> </span> <p>x</p> </div>", "<div><span></span><p>x</p></div>"),
        # quotes and entities
        ("""<a name='say "x"' value="it's">a &amp; &lt;b&gt; &copy;</a>""", """<a name='say "x"' value="it's">a &amp; &lt;b&gt; ©</a>"""),
        ("<p>a<p>b</i></p><!-- n --><br></br>", "<p>a<p>b</p><!-- n --><br/></p>"),
        ("", ""),
    ],
)
def test_simplify(page, out):
    assert H.simplify_text(page) == out


def test_simplify_deep_pages():
    assert H.simplify_text("<p>" * 5000 + "x") == "<p>" * 5000 + "x" + "</p>" * 5000
    assert H.simplify_text("<div>" * 5000 + "x") == "x"


def test_fit_text():
    page = "<p>" + "x y " * 100 + "</p>"
    assert H.fit_text("short", 10) == "short" and H.fit_text("<div><b>t</b></div>", 12) == "<b>t</b>"
    assert H.fit_text(page, 50) == ("<p>" + "x y " * 100)[:50] + "\n[...observation truncated due to length...]"


def test_fit_observation(spark):
    rows = [(None,), ("<p>a</p>",), ("<p>" + "b" * 900 + "</p>",)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string").select(H.fit_observation(F.col("h"), 300)).collect()]
    assert got == [None, "<p>a</p>", H.fit_text(rows[2][0], 300)]


def rendered(persona, steps, t, drop, current, compressed=True, pieces=()):
    blocks = ""
    for i, (page, why, wire) in enumerate(steps[:t]):
        blocks += f"### Step {i + 1}\nPage (HTML):\n{P.OMITTED if i < drop else page}\n\n" + (f"Why: {why}\n" if why else "") + f"Action: {wire}\n\n"
    section = P.FURNITURE + "".join(f"[[F{k}]] =\n{p}\n" for k, p in enumerate(pieces, 1)) + "\n\n" if pieces else "\n" if compressed else ""
    user = f"{P.PERSONA}{persona}\n\n{section}{P.HISTORY}{blocks}{P.CURRENT}{t + 1})\n{current}{P.TASK}"
    return P.CHAT_SYSTEM + P.SYSTEM + P.CHAT_USER + user + P.CHAT_ASSISTANT


def loop_fit(persona, steps, current, t, most, pieces=(), plain=False):
    """The fit as a loop over rendered prompts, and the prompt."""
    history = steps[:t]
    text = lambda drop, cur: rendered(persona, steps, t, drop, cur, not plain, pieces)
    count = lambda drop, cur: -(-len(text(drop, cur)) // 4)
    k = t
    for drop in range(t + 1):
        if plain or 2000 + len(persona) + sum(len(p) + 200 for p in pieces) + 50 * drop + sum(len(p) + 300 for p, _, _ in history[drop:]) + len(current) + 300 <= 4 * most:
            k = drop
            break
    for drop in range(k, t + 1):
        if count(drop, current) <= most:
            return k, count(drop, current), t - drop, drop, False, text(drop, current)
    cut, n, said = current, count(t, current), text(t, current)
    while len(cut) > (1000 if plain else 100):
        cut = cut[: len(cut) // 2]
        n, said = count(t, cut + P.CUT), text(t, cut + P.CUT)
        if n <= most:
            break
    if n > most and not plain:
        n, said = most, said[-4 * most :]
    return k, n, 0, t, True, said


@pytest.fixture
def sessions(spark):
    """Steps (with page as current one, as history, why and action), people, and both as Python values."""
    rng = random.Random(9)
    rows, held = [], {}
    for s in range(7):
        pieces = ["chrome " * 30, "foot"] if s % 3 == 0 else []
        steps = []
        for _ in range(rng.randrange(1, 12)):
            # pages shorter than the marker of an omitted one, too
            page = "p" * rng.choice([0, 3, 20, 90, 400, 2500, 9000])
            steps.append((page[: len(page) // 2], rng.choice(["", "why not"]), '{"type": "terminate"}', page))
        held[s] = steps, pieces
        rows += [(f"s{s}", s, "train", i, f"{s}-{i}", why, wire, wire, cur, hist, pieces, why or None, None) for i, (hist, why, wire, cur) in enumerate(steps)]
    df = spark.createDataFrame(rows, "session_id string, user_id long, split string, step_idx int, action_id string, why string, action_wire_json string, action_json string, obs_cur string, obs_hist string, pieces array<string>, rationale string, rationale_synth string")
    people = spark.createDataFrame([(s, f'{{"name": "{s * 7}"}}') for s in range(5)], "user_id long, persona string")
    return df.repartition(3), people, held, {s: f'{{"name": "{s * 7}"}}' for s in range(5)} | {5: "{}", 6: "{}"}


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("most", [300, 700, 900, 1500, 3000, 6000])
def test_samples_are_the_loop(sessions, most, plain):
    steps, people, held, persona = sessions
    if plain:
        steps = steps.drop("pieces")
    counters = {(r.user_id, r.step_idx): r for r in K.fitted(steps, people, most, compressed=not plain, plain=plain).collect()}
    got = K.samples(steps, people, most, compressed=not plain, plain=plain)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in got.schema) == files.SAMPLE.replace("user_id string", "user_id bigint")
    n = 0
    for r in got.collect():
        parts, pieces = held[r.user_id]
        k, tokens, full, gone, cut, text = loop_fit(persona[r.user_id], [p[:3] for p in parts], parts[r.step_idx][3], r.step_idx, most, () if plain else pieces, plain)
        assert (r.n_prompt_tokens, r.n_history_full_html, r.n_history_dropped_html, r.current_truncated, r.prompt_text) == (tokens, full, gone, cut, text)
        c = counters[r.user_id, r.step_idx]
        assert (c.pre_drop, c.n_prompt_tokens, c.n_history_full_html, c.n_history_dropped_html, c.current_truncated) == (k, tokens, full, gone, cut)
        assert r.n_total_tokens == r.n_prompt_tokens + r.n_completion_tokens and r.n_completion_tokens == -(-len(r.completion_text) // 4)
        assert r.rationale_gt == parts[r.step_idx][1] and r.rationale_source == ("human" if r.rationale_gt else "none")
        n += 1
    assert n == len(counters) == sum(len(p) for p, _ in held.values())


def test_a_page_that_never_fits_is_halved_down_to_the_least(spark):
    """27616 >> 9 is the last half; 27616 >> 40 isn't 27616 >> 8."""
    page = "".join(f"{i} " for i in range(9000))[:27616]
    steps = spark.createDataFrame([("s", 1, "train", 0, "a", "", "{}", "{}", page, page, None, None)], "session_id string, user_id long, split string, step_idx int, action_id string, why string, action_wire_json string, action_json string, obs_cur string, obs_hist string, rationale string, rationale_synth string")
    r = K.samples(steps, spark.createDataFrame([(2, "p")], "user_id long, persona string"), 100).first()
    assert r.prompt_text == loop_fit("{}", [], page, 0, 100)[5] and f"\n{page[:53]}{P.CUT}" in r.prompt_text


@pytest.mark.parametrize("most", [700, 1500])
def test_samples_by_another_counter(sessions, most):
    steps, people, held, persona = sessions
    same = K.samples_by(steps, people, lambda t: -(-len(t) // 4), lambda t, n: t[-4 * n :], most)
    key = lambda df: sorted(map(tuple, df.withColumn("user_id", F.col("user_id").cast("string")).collect()))
    assert key(same) == key(K.samples(steps, people, most))
    # words as tokens: not additive over blocks
    words = K.samples_by(steps, people, lambda t: len(t.split()), lambda t, n: " ".join(t.split()[-n:]), 520).collect()
    assert words and all(r.n_prompt_tokens == len(r.prompt_text.split()) <= 520 for r in words)


def test_sample_files_and_summary(spark, sessions, tmp_path):
    steps, people, held, _ = sessions
    files.write_samples(K.samples(steps, people, 1500), f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    pieces = steps.groupBy("session_id").agg(F.first("split").alias("split"), F.first("pieces").alias("pieces"))
    total = K.summary(back, pieces)
    r = total.first()
    assert (r.sessions, r.samples) == (7, sum(len(p) for p, _ in held.values())) and r.max_prompt_tokens <= 1500
    assert r.furniture_pieces_total == 6 and r.furniture_chars_total == 3 * 214 and r.furniture_chars_per_session_mean == 91.7
    m = files.manifest({"max_prompt_tokens": 1500}, total)
    assert m["splits"]["train"]["samples"] == r.samples
    assert all(n.endswith(".zstd.parquet") for n in __import__("os").listdir(f"{tmp_path}/s/split=train") if n.startswith("part"))


@pytest.mark.parametrize("mode", ["none", "L1", "L2", "L1L2"])
def test_modes(spark, pages, mode):
    """What is current and what is history, by mode; pieces are restored by their definitions."""
    anchored = [p[:600] + '<a name="buy">' + p[600:] for p in pages]
    rows = [("a", i, p, '{"name": "buy", "type": "click"}' if i else '{"type": "terminate"}') for i, p in enumerate(anchored)]
    steps = spark.createDataFrame(rows, "session_id string, step_idx int, observation string, action_wire_json string")
    out = sorted(C.dispatch(C.with_pieces(steps) if "L1" in mode else steps, mode).collect(), key=lambda r: r.step_idx)
    pieces = C.find_furniture(anchored)
    if mode == "L1L2":
        shown = {r.step_idx: r.page for r in C.as_of(C.dispatch(C.with_pieces(steps), mode), 1).collect()}
        assert shown == {r.step_idx: r.obs_cur if r.step_idx == 1 else r.obs_hist for r in out}
    for r, page in zip(out, anchored):
        current = C.apply_furniture(page, pieces) if "L1" in mode else page
        assert r.obs_cur == current
        if "L2" in mode and r.step_idx:
            assert 'name="buy"' in r.obs_hist and r.obs_hist == spark.range(1).select(C.anchor_slice(F.lit(current), F.lit("buy"))["out"]).first()[0]
        else:
            assert r.obs_hist == current


def test_prompt_text(spark):
    steps = [("page one", "why", '{"type": "terminate"}'), ("page two", "", '{"a": 1}')]
    blocks = F.array(*[P.step_block(F.lit(i + 1), F.lit(p), F.lit(w), F.lit(a)) for i, (p, w, a) in enumerate(steps)])
    df = spark.range(1)
    plain = df.select(P.chat(P.user_prompt(F.lit("{}"), blocks, F.lit(3), F.lit("now")))).first()[0]
    assert plain == rendered("{}", [*steps, ("now", "", "")], 2, 0, "now", compressed=False)
    empty = df.select(P.chat(P.user_prompt(F.lit("{}"), blocks, F.lit(3), F.lit("now"), F.array().cast("array<string>")))).first()[0]
    assert empty == rendered("{}", [*steps, ("now", "", "")], 2, 0, "now") and len(empty) == len(plain) + 1
    full = df.select(P.user_prompt(F.lit("{}"), blocks, F.lit(3), F.lit("now"), F.array(F.lit("chrome")))).first()[0]
    assert "[[F1]] =\nchrome\n\n\n## Session history" in full


def test_synthesis_prompt(spark):
    steps = spark.createDataFrame([("1", 1, "train", "w1", "because"), ("2", 1, "train", "w2", None), ("3", 2, "test", "w3", "so")], "action_id string, user_id long, split string, action_wire_json string, rationale string")
    people = spark.createDataFrame([(1, "p" * 2000)], "user_id long, persona string")
    section = P.examples_section(P.examples(steps, people))
    row = spark.range(1).select(P.synthesis_prompt(F.lit("me"), F.lit("page"), F.lit("act"), section, most=3).alias("with"), P.synthesis_prompt(F.lit("me"), F.lit("page"), F.lit("act")).alias("without")).first()
    shown = "# Real shoppers' rationales (style reference)\n- Persona snippet: " + "p" * 1200 + "\n  Action: w1\n  Rationale: because\n\n"
    assert row["with"] == f"{P.ASK}me\n\n{shown}\n# Current page (HTML)\npag{P.ASK_CUT}{P.ASK_TAKEN}act{P.ASK_END}"
    assert row["without"] == f"{P.ASK}me\n\n\n# Current page (HTML)\npage{P.ASK_TAKEN}act{P.ASK_END}"


def test_fast_fit():
    assert K.fast_fit(10, [5, 5, 5], [1, 1, 1], 20) == 2 and K.fast_fit(100, [5], [1], 20) == 1 and K.fast_fit(1, [], [], 20) == 0
