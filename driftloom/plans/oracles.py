"""The same queries as SQL."""

from __future__ import annotations

ACTIONS = """
WITH np AS (SELECT count(*) AS n FROM pages), nd AS (SELECT count(*) AS n FROM documents),
ev AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS action_id, user_id, ts, event_type, props,
    CAST(user_id AS VARCHAR) || '_' || CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS session_id,
    CASE WHEN event_id % 211 = 0 THEN 'scroll' WHEN event_type IN ('click','view','purchase') THEN 'click' WHEN event_type = 'signup' THEN 'input' ELSE 'terminate' END AS action_type,
    CASE event_type WHEN 'click' THEN 'product_link' WHEN 'view' THEN 'review' WHEN 'purchase' THEN 'purchase' END AS raw_click,
    CASE WHEN event_type = 'signup' THEN regexp_extract(props, '([0-9]+)', 1) END AS input_text,
    CASE WHEN (user_id + (CAST(date_trunc('week', ts) AS DATE) - DATE '1970-01-01') // 7) % 5 = 0 THEN 'test' ELSE 'train' END AS split
  FROM events),
good AS (SELECT doc_id FROM labels WHERE quality = 1),
act AS (
  SELECT ev.*, action_type IN ('click','input','terminate') AS valid,
    p.html AS observation,
    CASE WHEN event_type <> 'error' THEN nullif(regexp_extract(p.html, 'href="([^"]*)"', 1), '') END AS semantic_id,
    CASE WHEN g.doc_id IS NOT NULL THEN d.text END AS raw_rationale
  FROM ev JOIN pages p ON p.page_id = ev.event_id % (SELECT n FROM np)
  LEFT JOIN documents d ON d.doc_id = ev.event_id % (SELECT n FROM nd)
  LEFT JOIN good g ON g.doc_id = d.doc_id),
norm AS (
  SELECT act.*, action_type AS type,
    CASE WHEN action_type = 'click' THEN raw_click END AS click_type,
    CASE WHEN action_type IN ('click','input') AND trim(semantic_id) <> '' THEN semantic_id END AS name,
    CASE WHEN action_type = 'input' AND input_text <> '' THEN input_text END AS text,
    raw_rationale AS rationale
  FROM act),
bad AS (SELECT DISTINCT session_id FROM ev WHERE action_type NOT IN ('click','input','terminate')),
step0 AS (
  SELECT norm.*, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS INTEGER) AS step_idx
  FROM norm WHERE session_id NOT IN (SELECT session_id FROM bad)),
steps AS (
  SELECT step0.*,
    CASE type WHEN 'click' THEN '{"click_type": ' || coalesce(CAST(to_json(click_type) AS VARCHAR), 'null') || ', "name": ' || coalesce(CAST(to_json(name) AS VARCHAR), 'null') || ', "type": "click"}'
      WHEN 'input' THEN '{"name": ' || coalesce(CAST(to_json(name) AS VARCHAR), 'null') || ', "text": ' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ', "type": "input"}'
      ELSE '{"type": "terminate"}' END AS action_json,
    CASE type WHEN 'click' THEN '{"name": ' || coalesce(CAST(to_json(name) AS VARCHAR), 'null') || ', "type": "click"}'
      WHEN 'input' THEN '{"name": ' || coalesce(CAST(to_json(name) AS VARCHAR), 'null') || ', "text": ' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ', "type": "input"}'
      ELSE '{"type": "terminate"}' END AS action_wire_json
  FROM step0),
writes AS (
  SELECT CAST(event_id AS VARCHAR) AS action_id, event_id AS ordinal, 'first ' || event_id AS rationale FROM events WHERE event_id % 3 = 0
  UNION ALL
  SELECT CAST(event_id AS VARCHAR), event_id + 1000000000, CASE WHEN event_id % 15 = 0 THEN '' ELSE 'again ' || event_id END FROM events WHERE event_id % 6 = 0),
cache AS (SELECT action_id, arg_max(rationale, ordinal) AS rationale FROM writes GROUP BY 1),
filled AS (
  SELECT s.*, CASE WHEN s.rationale IS NULL THEN nullif(c.rationale, '') END AS synth,
    coalesce(CASE WHEN s.rationale IS NULL THEN nullif(c.rationale, '') END, s.rationale, '') AS why
  FROM steps s LEFT JOIN cache c USING (action_id)),
persona AS (SELECT c_custkey AS user_id, max('{"name": "' || c_name || '", "segment": "' || c_mktsegment || '"}') AS persona FROM customer GROUP BY 1)
"""
#: Inside JSON, strings as Python and Spark escape them: DEL and non-ASCII stay.
SLICED = """
, anchored AS (SELECT *, CASE WHEN name IS NULL OR name = '' THEN 0 ELSE instr(observation, 'href="' || name || '"') END AS pos, length(observation) AS size FROM filled),
cut AS (SELECT *, pos > 0 AS found, greatest(0, pos - 601) AS l, least(size, pos + 599) AS r FROM anchored),
sliced AS (SELECT *, CASE WHEN found THEN (CASE WHEN l > 0 THEN '<!-- ' || l || ' chars elided (head) -->' ELSE '' END) || substring(observation, l + 1, r - l) || (CASE WHEN size > r THEN '<!-- ' || (size - r) || ' chars elided (tail) -->' ELSE '' END) ELSE observation END AS hist FROM cut)
"""


def costs(page: str) -> str:
    from driftloom.operators.prompts import ACTION, OMITTED, PAGE, STEP, WHY

    base, gone = len(STEP) + len(PAGE) + len(ACTION) + 5, len(OMITTED)
    return f"""
, cost AS (
  SELECT s.*, length({page}) AS hp,
    length(why) AS wl,
    {base} + length(CAST(step_idx + 1 AS VARCHAR)) + CASE WHEN why <> '' THEN length(why) + {len(WHY) + 1} ELSE 0 END + length(action_wire_json) AS rest
  FROM sliced s),
cum AS (
  SELECT *, CAST(hp + rest AS BIGINT) AS "full", CAST({gone} + rest AS BIGINT) AS dropped,
    CAST(coalesce(sum(hp + rest) OVER w, 0) AS BIGINT) AS cum_full, CAST(coalesce(sum({gone} + rest) OVER w, 0) AS BIGINT) AS cum_dropped, CAST(coalesce(sum(hp) OVER w, 0) AS BIGINT) AS cum_page
  FROM cost WINDOW w AS (PARTITION BY session_id ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


def fit(page: str, most: int, plain: bool = False) -> str:
    from driftloom.operators.packing import LEAST, PLAIN_LEAST
    from driftloom.operators.prompts import CUT, fixed_length

    tokens = "ceil(len / 4.0)" if plain else f"least(ceil(len / 4.0), {most})"
    return costs(page) + f"""
, lens AS (SELECT c.*, length(observation) AS cur, coalesce(length(persona), 2) AS pl, {fixed_length() + (not plain)} + coalesce(length(persona), 2) + length(CAST(step_idx + 1 AS VARCHAR)) AS fixed, coalesce(persona, '{{}}') AS who FROM cum c LEFT JOIN persona USING (user_id)),
pre AS (
  SELECT a.session_id, a.step_idx, min(b.step_idx) AS k FROM lens a JOIN lens b ON b.session_id = a.session_id AND b.step_idx <= a.step_idx
  WHERE {'true' if plain else f'2000 + a.pl + 50 * b.step_idx + (a.cum_page - b.cum_page) + 300 * (a.step_idx - b.step_idx) + a.cur + 300 <= {4 * most}'} GROUP BY 1, 2),
withpre AS (SELECT l.*, CAST(coalesce(p.k, l.step_idx) AS INTEGER) AS pre_drop FROM lens l LEFT JOIN pre p USING (session_id, step_idx)),
tries AS (
  SELECT a.session_id, a.step_idx, arg_min(a.fixed + a.cur + b.cum_dropped + a.cum_full - b.cum_full, b.step_idx) AS len, min(b.step_idx) AS k
  FROM withpre a JOIN lens b ON b.session_id = a.session_id AND b.step_idx BETWEEN a.pre_drop AND a.step_idx
  WHERE a.fixed + a.cur + b.cum_dropped + a.cum_full - b.cum_full <= {4 * most} GROUP BY 1, 2),
halves AS (
  SELECT a.session_id, a.step_idx, min(CASE WHEN a.fixed + a.cum_dropped + (a.cur >> j) + {len(CUT)} <= {4 * most} THEN j END) AS j, max(j) AS jmax
  FROM withpre a, range(1, 41) t(j) WHERE (a.cur >> (j - 1)) > {PLAIN_LEAST if plain else LEAST} GROUP BY 1, 2),
chosen AS (
  SELECT w.*, f.k, CASE WHEN f.k IS NULL THEN coalesce(h.j, h.jmax) END AS j,
    CASE WHEN f.k IS NOT NULL THEN f.len WHEN h.jmax IS NULL THEN w.fixed + w.cum_dropped + w.cur ELSE w.fixed + w.cum_dropped + (w.cur >> coalesce(h.j, h.jmax)) + {len(CUT)} END AS len
  FROM withpre w LEFT JOIN tries f USING (session_id, step_idx) LEFT JOIN halves h USING (session_id, step_idx)),
fitted AS (
  SELECT *, CAST({tokens} AS INTEGER) AS n_prompt_tokens, CAST(CASE WHEN k IS NULL THEN 0 ELSE step_idx - k END AS INTEGER) AS n_history_full_html,
    CAST(coalesce(k, step_idx) AS INTEGER) AS n_history_dropped_html, k IS NULL AS current_truncated,
    CASE WHEN synth <> '' THEN 'synthetic' WHEN rationale <> '' THEN 'human' ELSE 'none' END AS rationale_source
  FROM chosen)
"""


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rendered(page: str, most: int, plain: bool = False) -> str:
    """Adds shown, the whole prompt of each sample."""
    from driftloom.operators import prompts as P

    whole = f"{q(P.CHAT_SYSTEM + P.SYSTEM + P.CHAT_USER + P.PERSONA)} || who || {q(chr(10) * (2 if plain else 3) + P.HISTORY)} || coalesce(h.earlier, '') || {q(P.CURRENT)} || (step_idx + 1) || {q(')' + chr(10))} || CASE WHEN j IS NULL THEN observation ELSE left(observation, cur >> j) || {q(P.CUT)} END || {q(P.TASK + P.CHAT_ASSISTANT)}"
    block = lambda page: f"{q(P.STEP)} || (step_idx + 1) || {q(chr(10) + P.PAGE)} || {page} || chr(10) || chr(10) || CASE WHEN why <> '' THEN {q(P.WHY)} || why || chr(10) ELSE '' END || {q(P.ACTION)} || action_wire_json || chr(10) || chr(10)"
    return fit(page, most, plain) + f"""
, b AS (SELECT session_id, step_idx, {block(page)} AS block, {block(q(P.OMITTED))} AS gone FROM sliced),
h AS (
  SELECT f.session_id, f.step_idx, string_agg(CASE WHEN b.step_idx < f.n_history_dropped_html THEN b.gone ELSE b.block END, '' ORDER BY b.step_idx) AS earlier
  FROM fitted f JOIN b ON b.session_id = f.session_id AND b.step_idx < f.step_idx GROUP BY 1, 2),
w AS (SELECT f.*, {whole} AS whole FROM fitted f LEFT JOIN h USING (session_id, step_idx)),
texts AS (SELECT *, {'whole' if plain else f'CASE WHEN k IS NULL AND length(whole) > {4 * most} THEN right(whole, {4 * most}) ELSE whole END'} AS shown, {completion('why')} AS said FROM w)
"""


SAMPLES = """
SELECT CAST(user_id AS BIGINT) AS user_id, session_id, step_idx, action_id, split, md5(shown) AS prompt_text, md5(said) AS completion_text, action_json AS action_gt, md5(coalesce(rationale, '')) AS rationale_gt, rationale_source,
  n_prompt_tokens, CAST(ceil(length(said) / 4.0) AS INTEGER) AS n_completion_tokens, n_prompt_tokens + CAST(ceil(length(said) / 4.0) AS INTEGER) AS n_total_tokens, n_history_full_html, n_history_dropped_html, current_truncated FROM texts"""


PREDICTED = """
, pred0 AS (
  SELECT s.*, event_id % 7 AS m, event_id % 7 <> 5 AS ok,
    CASE WHEN event_id % 7 = 2 THEN (CASE WHEN type = 'terminate' THEN 'click' ELSE 'terminate' END) ELSE type END AS pt,
    CASE WHEN event_id % 7 = 2 AND type = 'terminate' THEN 'x' WHEN event_id % 7 = 1 AND type <> 'terminate' THEN coalesce(name, '') || '_x' ELSE name END AS pn
  FROM steps s),
pred1 AS (
  SELECT *, CASE WHEN ok THEN pt END AS pred_type,
    CASE WHEN ok AND pt <> 'terminate' AND trim(pn) <> '' THEN pn END AS pred_name,
    CASE WHEN ok AND pt = 'input' THEN text END AS pred_text,
    CASE WHEN ok THEN (CASE WHEN m = 6 THEN '' ELSE trim(coalesce(rationale, 'ok'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) END) END AS pred_rationale
  FROM pred0),
pred AS (
  SELECT *, coalesce(ok AND pt = type AND (type = 'terminate' OR (coalesce(trim(pred_name), '') = coalesce(trim(name), '') AND (type = 'click' OR coalesce(trim(pred_text), '') = coalesce(trim(text), '')))), false) AS matched,
    ok AND pt = type AS same,
    ok AND pt = type AND (type = 'terminate' OR (coalesce(trim(pred_name), '') <> '' AND (type = 'click' OR coalesce(trim(pred_text), '') <> ''))) AS slots
  FROM pred1)
"""


def reward(wrong: str, purchase: str) -> str:
    return f"""
SELECT action_id, CASE WHEN NOT ok THEN 0.0::DOUBLE ELSE
  (CASE WHEN matched THEN (CASE WHEN type = 'click' THEN (CASE WHEN click_type = 'purchase' THEN {purchase} WHEN click_type IN ('review', 'search') THEN 1.0::DOUBLE ELSE 1000.0::DOUBLE END) WHEN type = 'input' THEN 2000.0::DOUBLE ELSE 1.0::DOUBLE END)
    WHEN pt = 'click' THEN {wrong} ELSE 0.0::DOUBLE END) + (CASE WHEN pred_rationale <> '' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) END AS reward FROM pred"""


RATES = "count(*) AS n, avg(CAST(ok AS INTEGER)) AS format_valid, avg(CAST(same AS INTEGER)) AS type_acc, avg(CAST(slots AS INTEGER)) AS fg_type_acc, avg(CAST(slots AND matched AS INTEGER)) AS nag"
CLASSES = """
, lab AS (SELECT CASE WHEN ok THEN pt ELSE '__INVALID__' END AS p, type AS g FROM pred),
names AS (SELECT p AS label FROM lab UNION SELECT g FROM lab),
sums AS (SELECT label, count(*) FILTER (p = label AND g = label) AS tp, count(*) FILTER (p = label AND g <> label) AS fp, count(*) FILTER (p <> label AND g = label) AS fn FROM names, lab GROUP BY 1),
pr AS (SELECT label, tp + fn AS support, tp + fp AS support_pred, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS recall FROM sums),
cls AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM pr)
"""


def outcome(predicted: str, source: str) -> str:
    return f"""
, lastp AS (SELECT * FROM pred QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY step_idx DESC, event_id DESC) = 1),
known AS (SELECT name AS kname, arg_max(click_type, event_id) AS kclick FROM steps WHERE type = 'click' AND name IS NOT NULL GROUP BY 1),
o AS (SELECT coalesce({predicted}, false) AS p, coalesce(type = 'click' AND click_type = 'purchase', false) AS t FROM {source}),
c AS (SELECT count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn, count(*) AS n FROM o),
x AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS recall FROM c)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM x"""


def completion(said: str) -> str:
    blank = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
    return f"""'{{"action": ' || action_wire_json || ', "rationale": ' || CAST(to_json(trim({said}, {blank})) AS VARCHAR) || '}}'"""


#: Pages beside the one before, and the lengths of what they share at both ends.
PAIRS = """
, adj AS (SELECT session_id, step_idx, coalesce(observation, '') AS page, lag(coalesce(observation, '')) OVER (PARTITION BY session_id ORDER BY step_idx) AS prev, count(*) OVER (PARTITION BY session_id) AS steps_of FROM steps),
pairs AS (
  SELECT session_id, step_idx, steps_of, CAST(length(page) AS INTEGER) AS len, CAST(length(prev) AS INTEGER) AS before_len,
    CAST(CASE WHEN prev IS NOT NULL THEN coalesce(list_position(list_transform(list_zip(string_split(prev, ''), string_split(page, ''), true), lambda x: x[1] = x[2]), false) - 1, least(length(prev), length(page))) END AS INTEGER) AS lcp,
    CAST(CASE WHEN prev IS NOT NULL THEN coalesce(list_position(list_transform(list_zip(list_reverse(string_split(prev, '')), list_reverse(string_split(page, '')), true), lambda x: x[1] = x[2]), false) - 1, least(length(prev), length(page))) END AS INTEGER) AS lcs
  FROM adj)
"""
SHARED = """
, ends AS (SELECT session_id, count(*) AS n, min(coalesce(observation, '')) AS a, max(coalesce(observation, '')) AS b, min(reverse(coalesce(observation, ''))) AS c, max(reverse(coalesce(observation, ''))) AS d FROM steps GROUP BY 1),
shared AS (
  SELECT session_id, n, CAST(coalesce(list_position(list_transform(list_zip(string_split(a, ''), string_split(b, ''), true), lambda x: x[1] = x[2]), false) - 1, least(length(a), length(b))) AS INTEGER) AS prefix,
    CAST(coalesce(list_position(list_transform(list_zip(string_split(c, ''), string_split(d, ''), true), lambda x: x[1] = x[2]), false) - 1, least(length(c), length(d))) AS INTEGER) AS suffix
  FROM ends)
"""
MEASURES = """
, met AS (SELECT * FROM pairs WHERE steps_of > 1 AND lcp IS NOT NULL AND len > 0 AND before_len > 0),
totals AS (SELECT session_id, count(*) AS n, sum(len) AS s FROM pairs GROUP BY 1 HAVING count(*) > 1),
vals AS (
  SELECT 'html_chars_per_step' AS measure, len::DOUBLE AS v FROM pairs WHERE steps_of > 1
  UNION ALL SELECT 'adjacent_step_lcp_chars', lcp FROM met UNION ALL SELECT 'adjacent_step_lcs_chars', lcs FROM met UNION ALL SELECT 'adjacent_step_ratio', (lcp + lcs) / greatest(len, 1) FROM met
  UNION ALL SELECT 'step_count', n FROM totals UNION ALL SELECT 'html_chars_per_session_total', s FROM totals
  UNION ALL SELECT 'all_step_common_prefix_chars', prefix FROM shared WHERE n > 1 UNION ALL SELECT 'all_step_common_suffix_chars', suffix FROM shared WHERE n > 1),
placed AS (SELECT measure, v, row_number() OVER (PARTITION BY measure ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY measure) AS n FROM vals)
SELECT measure, max(n) AS n, round(sum(v) / max(n), 1) AS mean, """ + ", ".join(f"round(max(CASE WHEN i = CAST(floor({x}::DOUBLE * (n - 1)) AS BIGINT) THEN v END), 1) AS {k}" for k, x in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))) + """,
  round(max(v), 1) AS max, round(min(v), 1) AS min, round(sum(v), 0) AS sum FROM placed GROUP BY 1"""


FIT_COLUMNS = "SELECT session_id, step_idx, pre_drop, n_prompt_tokens, n_history_full_html, n_history_dropped_html, current_truncated FROM fitted"
EXAMPLES = """
, ex AS (SELECT action_id, md5(action_id) AS place, rationale, left(coalesce(persona, '{}'), 1200) AS snippet, action_wire_json FROM steps s LEFT JOIN persona p ON p.user_id = s.user_id WHERE split = 'train' AND rationale IS NOT NULL ORDER BY 2, 1 LIMIT 3)
"""


def asked() -> str:
    from driftloom.operators import prompts as P

    shown = f"(SELECT CASE WHEN count(*) > 0 THEN {q(P.ASK_EXAMPLES)} || string_agg({q(P.ASK_SNIPPET)} || snippet || {q(P.ASK_ACTION)} || action_wire_json || {q(P.ASK_RATIONALE)} || rationale || chr(10), '' ORDER BY place) || chr(10) ELSE '' END FROM ex)"
    page = f"CASE WHEN length(observation) > 80000 THEN left(observation, 80000) || {q(P.ASK_CUT)} ELSE observation END"
    return EXAMPLES + f", t AS (SELECT action_id, {q(P.ASK)} || coalesce(persona, '{{}}') || chr(10) || chr(10) || {shown} || {q(P.ASK_PAGE)} || {page} || {q(P.ASK_TAKEN)} || action_wire_json || {q(P.ASK_END)} AS x FROM steps s LEFT JOIN persona p ON p.user_id = s.user_id WHERE rationale IS NULL) SELECT action_id, CAST(length(x) AS INTEGER) AS n_chars, md5(x) AS md5 FROM t"


N_PAGE = "CAST(length(observation) AS INTEGER)"

ORACLES = {
    "verify_table_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("events", "pages", "documents", "labels", "customer", "conversations")),
    "verify_type_counts": ACTIONS + "SELECT split, action_type, count(*) AS n FROM ev GROUP BY 1, 2",
    "verify_click_counts": ACTIONS + "SELECT split, coalesce(raw_click, '<null>') AS click_type, count(*) AS n FROM ev WHERE action_type = 'click' GROUP BY 1, 2",
    "verify_len_stats": ACTIONS
    + f"SELECT split, min({N_PAGE}) AS min, CAST(floor(quantile_cont(length(observation), 0.5)) AS INTEGER) AS median, CAST(floor(quantile_cont(length(observation), 0.9)) AS INTEGER) AS p90, CAST(floor(quantile_cont(length(observation), 0.99)) AS INTEGER) AS p99, max({N_PAGE}) AS max FROM act GROUP BY 1",
    "verify_rationale_fraction": ACTIONS + "SELECT split, count(*) FILTER (length(coalesce(raw_rationale, '')) > 0) AS n_rationale, round(avg(CAST(length(coalesce(raw_rationale, '')) > 0 AS INTEGER)), 4) AS fraction FROM act GROUP BY 1",
    "user_overlap": ACTIONS + "SELECT count(*) AS n_users FROM (SELECT user_id FROM ev WHERE split = 'train' INTERSECT SELECT user_id FROM ev WHERE split = 'test')",
    "semantic_id_fd_check": ACTIONS + "SELECT semantic_id, count(DISTINCT raw_click) AS n_click_types, count(*) AS n FROM act WHERE action_type = 'click' AND semantic_id IS NOT NULL GROUP BY 1",
    "action_normalize": ACTIONS + "SELECT action_id, type, click_type, name, text, valid FROM norm",
    "action_json": ACTIONS + "SELECT action_id, action_json FROM steps",
    "action_wire_json": ACTIONS + "SELECT action_id, action_wire_json FROM steps",
    "action_match": ACTIONS + PREDICTED + "SELECT action_id, matched FROM pred",
    "trajectory_steps": ACTIONS + f"SELECT session_id, s.user_id, split, step_idx, action_id, type, {N_PAGE} AS n_page, CAST(coalesce(length(rationale), 0) AS INTEGER) AS n_rationale, coalesce(persona, '{{}}') AS persona FROM steps s LEFT JOIN persona p ON p.user_id = s.user_id",
    "trajectory_summary": ACTIONS
    + ", s AS (SELECT split, session_id, bool_and(valid) AS good, count(*) AS n, count(raw_rationale) FILTER (trim(raw_rationale) <> '') AS r FROM act GROUP BY 1, 2) SELECT split, count(*) FILTER (good) AS sessions, count(*) FILTER (NOT good) AS skipped, CAST(coalesce(sum(n) FILTER (good), 0) AS BIGINT) AS samples, CAST(coalesce(sum(r) FILTER (good), 0) AS BIGINT) AS rationales, coalesce(round(sum(r) FILTER (good) / sum(n) FILTER (good), 4), 0) AS fraction FROM s GROUP BY 1",
    "invalid_session_drop": ACTIONS + "SELECT session_id, count(*) FILTER (action_type = 'scroll') AS n_invalid, count(*) AS n_actions FROM ev GROUP BY 1 HAVING count(*) FILTER (action_type = 'scroll') > 0",
    "trajectory_nested": ACTIONS + "SELECT session_id, any_value(user_id) AS user_id, any_value(split) AS split, CAST(count(*) AS INTEGER) AS n_steps, arg_min(action_id, step_idx) AS first_action, arg_max(action_id, step_idx) AS last_action, CAST(sum(length(observation)) AS BIGINT) AS n_page FROM steps GROUP BY 1",
    "conversation_steps": "SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS step_idx, role, CAST(length(coalesce(text, '')) AS INTEGER) AS n_page FROM conversations",
    "samples_expand": ACTIONS
    + f"SELECT session_id, step_idx, action_id, step_idx AS n_history, CAST(coalesce(sum(length(observation)) OVER (PARTITION BY session_id ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_history_page, md5({completion("coalesce(rationale, '')")}) AS completion_md5 FROM steps",
    "rationale_source_counts": ACTIONS + "SELECT split, CASE WHEN synth <> '' THEN 'synthetic' WHEN rationale <> '' THEN 'human' ELSE 'none' END AS source, count(*) AS n FROM filled GROUP BY 1, 2",
    "completion_text": ACTIONS + f", t AS (SELECT action_id, {completion('why')} AS x FROM filled) SELECT action_id, CAST(length(x) AS INTEGER) AS n_chars, CAST(ceil(length(x) / 4.0) AS BIGINT) AS n_tokens, md5(x) AS md5 FROM t",
    "cache_last_wins": ACTIONS + "SELECT action_id, rationale FROM cache",
    "pending_steps": ACTIONS + "SELECT action_id, session_id, step_idx FROM steps WHERE (rationale IS NULL OR trim(rationale) = '') AND action_id NOT IN (SELECT action_id FROM cache)",
    "materialize_cache": ACTIONS + "SELECT action_id, synth AS rationale_synth, rationale IS NOT NULL AS human FROM filled",
    "materialize_summary": ACTIONS + "SELECT split, count(*) AS total, count(rationale) AS human, count(synth) AS synth, count(*) FILTER (rationale IS NULL AND synth IS NULL) AS missing FROM filled GROUP BY 1",
    "few_shot_examples": ACTIONS + EXAMPLES + "SELECT action_id, CAST(length(rationale) AS INTEGER) AS n_rationale, snippet, action_wire_json FROM ex",
    "synthesis_prompts": ACTIONS + asked(),
    "anchor_slice": ACTIONS + SLICED + "SELECT action_id, found, CAST(CASE WHEN found THEN l + size - r ELSE 0 END AS INTEGER) AS elided, CAST(CASE WHEN found THEN r - l ELSE size END AS INTEGER) AS kept, CAST(length(hist) AS INTEGER) AS n_out, md5(hist) AS md5 FROM sliced",
    "mode_dispatch_l2": ACTIONS + SLICED + f"SELECT session_id, step_idx, {N_PAGE} AS n_cur, CAST(length(hist) AS INTEGER) AS n_hist FROM sliced",
    "compression_saving": ACTIONS + SLICED + "SELECT session_id, CAST(sum(length(observation)) AS BIGINT) AS before, CAST(sum(length(hist)) AS BIGINT) AS after, round(100 * (1 - sum(length(hist)) / greatest(sum(length(observation)), 1)), 1) AS saving_pct FROM sliced GROUP BY 1",
    "step_saving": ACTIONS + SLICED + f"SELECT session_id, step_idx, {N_PAGE} AS before, CAST(length(hist) AS INTEGER) AS after, round(length(hist) / greatest(length(observation), 1), 3) AS ratio FROM sliced",
    "prompt_costs": ACTIONS + SLICED + costs("hist") + 'SELECT session_id, step_idx, "full", dropped, cum_full, cum_dropped FROM cum',
    "prompt_text": ACTIONS + SLICED + rendered("hist", 500_000_000) + "SELECT session_id, step_idx, CAST(length(shown) AS INTEGER) AS n_chars, md5(shown) AS md5 FROM texts",
    "pre_drop_k": ACTIONS + SLICED + fit("observation", 8000) + "SELECT session_id, step_idx, pre_drop FROM withpre",
    "fit_counters_none": ACTIONS + SLICED + fit("observation", 8000) + FIT_COLUMNS,
    "fit_counters_l2": ACTIONS + SLICED + fit("hist", 8000) + FIT_COLUMNS,
    "fit_counters_tight": ACTIONS + SLICED + fit("observation", 1200) + FIT_COLUMNS,
    "fit_counters_plain": ACTIONS + SLICED + fit("observation", 1200, True) + FIT_COLUMNS,
    "samples_none": ACTIONS + SLICED + rendered("observation", 8000) + SAMPLES,
    "samples_plain": ACTIONS + SLICED + rendered("observation", 1200, True) + SAMPLES,
    "samples_l2": ACTIONS + SLICED + rendered("hist", 8000) + SAMPLES,
    "samples_tight": ACTIONS + SLICED + rendered("hist", 1200) + SAMPLES,
    "pack_summary": ACTIONS
    + SLICED
    + fit("hist", 8000)
    + "SELECT split, count(DISTINCT session_id) AS sessions, count(*) AS samples, count(*) FILTER (current_truncated) AS samples_with_current_truncated, round(avg(n_history_dropped_html), 2) AS mean_history_dropped_per_sample, round(avg(n_prompt_tokens), 1) AS mean_prompt_tokens, max(n_prompt_tokens) AS max_prompt_tokens, count(*) FILTER (rationale_source = 'human') AS rationale_human, count(*) FILTER (rationale_source = 'synthetic') AS rationale_synthetic FROM fitted GROUP BY 1",
    "adjacent_overlap": ACTIONS + PAIRS + "SELECT session_id, step_idx, len, before_len, lcp, lcs FROM pairs",
    "headroom": ACTIONS
    + PAIRS
    + ", s AS (SELECT CAST(sum(len) AS BIGINT) AS raw_chars, CAST(sum(CASE WHEN lcp IS NULL THEN len ELSE greatest(0, len - lcp - lcs) END) AS BIGINT) AS dedup_chars FROM pairs WHERE steps_of > 1) SELECT raw_chars, dedup_chars, round(100 * (1 - dedup_chars / raw_chars), 1) AS saving_pct_chars FROM s",
    "common_prefix_all": ACTIONS + SHARED + "SELECT session_id, prefix, suffix FROM shared",
    "redundancy_summary": ACTIONS + PAIRS + SHARED + MEASURES,
    "session_redundancy": ACTIONS
    + PAIRS
    + "SELECT session_id, count(*) AS n_steps, CAST(sum(len) AS BIGINT) AS total_chars, CAST(floor(quantile_cont(len, 0.5)) AS BIGINT) AS median_html, CAST(round_even(coalesce(avg(lcp) FILTER (len > 0 AND before_len > 0), 0), 0) AS BIGINT) AS adj_lcp_mean FROM pairs WHERE steps_of > 1 GROUP BY 1",
    "token_summary": ACTIONS
    + ", st AS (SELECT session_id, CAST(ceil(length(observation) / 4.0) AS BIGINT) AS t FROM steps), t AS (SELECT 'per_step' AS name, t FROM st UNION ALL SELECT 'per_session_total', CAST(sum(t) AS BIGINT) FROM st GROUP BY session_id UNION ALL SELECT 'per_session_max_step', max(t) FROM st GROUP BY session_id UNION ALL SELECT 'persona', CAST(ceil(length(persona) / 4.0) AS BIGINT) FROM persona) SELECT name, count(*) AS n, avg(t) AS mean, quantile_cont(t, 0.5) AS median, quantile_cont(t, 0.9) AS p90, quantile_cont(t, 0.95) AS p95, quantile_cont(t, 0.99) AS p99, max(t) AS max, "
    + ", ".join(f"avg(CAST(t > {c} AS INTEGER)) AS over_{c}" for c in (8192, 16384, 32768, 65536))
    + " FROM t GROUP BY 1",
    "session_table_join": ACTIONS
    + ", e AS (SELECT session_id, min(event_id) AS o, any_value(user_id) AS u FROM ev GROUP BY 1), tab AS (SELECT session_id, o, u FROM e WHERE o % 9 <> 0 UNION ALL SELECT session_id, o + 1000000000, u + 1 FROM e WHERE o % 4 = 0), one AS (SELECT session_id, arg_min(u, o) AS user_id FROM tab GROUP BY 1) SELECT session_id, any_value(one.user_id) AS user_id, count(*) AS n_steps FROM steps JOIN one USING (session_id) GROUP BY 1",
    "session_tokens": ACTIONS + "SELECT session_id, CAST(sum(CAST(ceil(length(observation) / 4.0) AS BIGINT)) AS BIGINT) AS total, max(CAST(ceil(length(observation) / 4.0) AS BIGINT)) AS most, quantile_cont(length(observation), 0.5) AS median_page FROM steps GROUP BY 1",
    "short_sessions": ACTIONS + "SELECT session_id, count(*) AS n_steps, CAST(sum(length(observation)) AS BIGINT) AS n_page FROM steps GROUP BY 1 HAVING count(*) BETWEEN 3 AND 5 ORDER BY 3, 1 LIMIT 5",
    "parse_completion": ACTIONS + PREDICTED + "SELECT action_id, ok, md5(pred_rationale) AS rationale_md5, pred_type, CAST(NULL AS VARCHAR) AS pred_click_type, pred_name, pred_text FROM pred",
    "reward_values": ACTIONS + PREDICTED + reward("-1.0::DOUBLE", "1000.0::DOUBLE"),
    "reward_rl_only": ACTIONS + PREDICTED + reward("0.0::DOUBLE", "1000.0::DOUBLE"),
    "reward_by_click_type": ACTIONS + PREDICTED + reward("-1.0::DOUBLE", "5000.0::DOUBLE"),
    "reward_advantage": ACTIONS
    + PREDICTED
    + ", r AS (SELECT pred.session_id, x.* FROM ("
    + reward("-1.0::DOUBLE", "1000.0::DOUBLE").strip()
    + ") x JOIN pred USING (action_id)) SELECT action_id, round(coalesce((reward - avg(reward) OVER w) / nullif(stddev_pop(reward) OVER w, 0), 0), 6) + 0.0 AS advantage FROM r WINDOW w AS (PARTITION BY session_id)",
    "rationale_extract": ACTIONS + PREDICTED + "SELECT action_id, md5(nullif(pred_rationale, '')) AS rationale_md5 FROM pred",
    "step_scores": ACTIONS + PREDICTED + "SELECT action_id, CAST(ok AS INTEGER) AS format_valid, CAST(same AS INTEGER) AS type_acc, CAST(slots AS INTEGER) AS fg_type_acc, CAST(slots AND matched AS INTEGER) AS nag FROM pred",
    "overall_metrics": ACTIONS + PREDICTED + f"SELECT {RATES} FROM pred",
    "per_user_metrics": ACTIONS + PREDICTED + f"SELECT user_id, {RATES} FROM pred GROUP BY 1",
    "macro_f1_classes": ACTIONS + PREDICTED + CLASSES + "SELECT label, support, support_pred, precision, recall, f1 FROM cls",
    "macro_f1": ACTIONS + PREDICTED + CLASSES + "SELECT coalesce(avg(f1), 0) AS macro_f1 FROM cls",
    "last_step": ACTIONS + "SELECT user_id, session_id, step_idx, event_id FROM steps QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY step_idx DESC, event_id DESC) = 1",
    "last_step_flagged": ACTIONS + "SELECT user_id, session_id, step_idx, event_id FROM steps WHERE event_id % 5 = 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY event_id DESC) = 1",
    "session_outcome": ACTIONS + PREDICTED + outcome("false", "lastp"),
    "session_outcome_lookup": ACTIONS + PREDICTED + outcome("ok AND pt = 'click' AND kclick = 'purchase'", "lastp LEFT JOIN known ON kname = pred_name"),
    "evaluation_table": ACTIONS
    + PREDICTED
    + CLASSES
    + ", so AS (WITH "
    + outcome("ok AND pt = 'click' AND kclick = 'purchase'", "lastp LEFT JOIN known ON kname = pred_name").strip().removeprefix(",")
    + ") SELECT avg(CAST(slots AND matched AS INTEGER)) AS next_action_gen, (SELECT coalesce(avg(f1), 0) FROM cls) AS action_type_macro_f1, avg(CAST(slots AS INTEGER)) AS fine_grained_type, (SELECT f1 FROM so) AS session_outcome FROM pred",
    "gap_session_windows": "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n_events FROM g GROUP BY user_id, k",
}
