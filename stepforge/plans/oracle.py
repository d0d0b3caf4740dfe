"""Independent SQL for the core queries, in DuckDB's dialect, over the same tables.

Where the operators work inside nested rows, the SQL here unnests and uses
windows and joins, so the two share no method.
"""

from __future__ import annotations

from stepforge.config import ERROR_KEYWORDS, FILE_EXTENSIONS, LIMITS, NOISE_PATTERNS, PATH_PATTERN, TEST_KEYWORDS
from stepforge.operators import subsets
from stepforge.plans.core import COUNTED_CHARS, DIMENSIONS, FLAGSHIP_SIZE, SERIES, SHOWN, SUB_SCORES, subset_query_name

_LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E]"


def _alt(words: tuple[str, ...]) -> str:
    return "|".join(words)


_EDGE = r"""[\s"'`\x{A0}\x{200B}\x{FEFF}]+""".replace("'", "''")


def canonical_id(c: str) -> str:
    """Canonical trajectory id: edges, folders, file ending and prefix stripped in one pattern."""
    inner = rf"^{_EDGE.replace('+', '*')}(?:.*/)?(?:trajectory|traj|trj)?[-_:\s]*(.*?)(?:\.(?:jsonl?|txt|parquet))?{_EDGE.replace('+', '*')}$"
    return f"('trj-' || nullif(regexp_extract(lower({c}), '{inner}', 1), ''))"


def canonical_repo(c: str) -> str:
    """Canonical repository: host, ending and blanks stripped, ``__`` for the slash where there is none."""
    s = f"regexp_replace(lower({c}), '^{_EDGE}|{_EDGE}$', '', 'g')"
    s = f"regexp_replace({s}, '^(https?://[^/]+/|ssh://[^/]+/|git@[^:/]+[:/])', '')"
    s = f"regexp_replace(regexp_replace({s}, '\\s*/\\s*', '/', 'g'), '(\\.git)?/*$', '')"
    return f"nullif(CASE WHEN contains({s}, '/') THEN {s} ELSE replace({s}, '__', '/') END, '')"


# The last delivery and the last scoring of each trajectory.
LAST = f"""
st AS (SELECT * REPLACE ({canonical_id("trajectory_id")} AS trajectory_id, {canonical_repo("repo")} AS repo) FROM stats QUALIFY row_number() OVER (PARTITION BY {canonical_id("trajectory_id")} ORDER BY ingested_at DESC) = 1),
sc AS (SELECT * REPLACE ({canonical_id("trajectory_id")} AS trajectory_id, {canonical_repo("repo")} AS repo) FROM scored QUALIFY row_number() OVER (PARTITION BY {canonical_id("trajectory_id")} ORDER BY scored_at DESC) = 1)
"""

# Messages, actions with their observations, calls.
BASE = """
t AS (SELECT DISTINCT * FROM trajectories),
m AS (SELECT trajectory_id, i, trajectory[i].role AS role, trajectory[i].content AS content, trajectory[i].tool_calls AS calls
      FROM t, unnest(range(1, len(trajectory) + 1)) AS u(i)),
g AS (SELECT *, role = 'assistant' AND coalesce(len(calls), 0) > 0 AS acts,
        sum(CASE WHEN role = 'assistant' AND coalesce(len(calls), 0) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY trajectory_id ORDER BY i) AS k FROM m),
obs AS (SELECT trajectory_id, k, i, content FROM g WHERE role IN ('user', 'tool') AND content <> ''),
first_obs AS (SELECT trajectory_id, k, arg_min(content, i) AS obs FROM obs GROUP BY ALL),
act AS (SELECT trajectory_id, CAST(k - 1 AS INTEGER) AS idx, coalesce(calls[1].function.name, 'unknown') AS tool,
          substr(coalesce(calls[1].function.arguments, ''), 1, 200) AS args_prefix,
          array_to_string(list_transform(calls, lambda c: coalesce(c.function.name, 'unknown') || ' ' || coalesce(c.function.arguments, '')), ' ') AS action_text,
          coalesce(obs, '') AS obs
        FROM g LEFT JOIN first_obs USING (trajectory_id, k) WHERE acts),
call AS (SELECT trajectory_id, i, coalesce(c.function.name, 'unknown') AS name, coalesce(c.function.arguments, '') AS args
         FROM (SELECT trajectory_id, i, unnest(calls) AS c FROM g WHERE acts)),
ids AS (SELECT DISTINCT trajectory_id FROM t)
"""

METRICS = f"""
b1 AS (SELECT trajectory_id, count(*) AS n, sum(CASE WHEN rep THEN 1 ELSE 0 END) AS r FROM (
         SELECT a.trajectory_id, a.idx, a.idx - lag(a.idx) OVER (PARTITION BY trajectory_id, tool, args_prefix ORDER BY idx) <= 5 AS rep FROM act a) GROUP BY 1),
b2 AS (SELECT trajectory_id, sum(CASE WHEN regexp_matches(lower(obs), '{_alt(ERROR_KEYWORDS)}') AND tool = nxt THEN 1 ELSE 0 END) AS cycles FROM (
         SELECT *, lead(tool) OVER (PARTITION BY trajectory_id ORDER BY idx) AS nxt FROM act) GROUP BY 1),
c1 AS (SELECT trajectory_id, sum(length(content)) AS chars, count(*) AS n_obs,
         sum(list_sum(list_transform(list_filter(regexp_split_to_array(content, '{_LINES}'), lambda s: regexp_matches(lower(s), '{_alt(NOISE_PATTERNS)}')), lambda s: length(s)))) AS noise
       FROM obs GROUP BY 1),
kw AS (SELECT DISTINCT trajectory_id, idx, w FROM (
         SELECT trajectory_id, idx, list_extract(string_split(f, '/'), -1) AS w, true AS file FROM (
           SELECT trajectory_id, idx, unnest(regexp_extract_all(lower(obs), '[\\w./\\-]+\\.(?:{"|".join(FILE_EXTENSIONS)})\\b')) AS f FROM act)
         UNION ALL
         SELECT trajectory_id, idx, lower(e), false FROM (
           SELECT trajectory_id, idx, unnest(regexp_extract_all(obs, '\\b\\w+(?:Error|Exception|Warning)\\b')) AS e FROM act)) WHERE NOT file OR length(w) > 4),
use AS (SELECT kw.trajectory_id, kw.idx, kw.w, max(CASE WHEN act.idx IS NOT NULL THEN 1 ELSE 0 END) AS used
        FROM kw LEFT JOIN act ON act.trajectory_id = kw.trajectory_id AND act.idx > kw.idx AND contains(lower(act.action_text), kw.w) GROUP BY ALL),
c3 AS (SELECT trajectory_id, avg(used) AS ratio FROM use GROUP BY 1),
cnt AS (SELECT trajectory_id, name, count(*) AS n FROM call GROUP BY ALL),
ent AS (SELECT trajectory_id, sum(n) AS calls, count(*) AS kinds,
          CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0.0 END AS entropy
        FROM (SELECT *, n / sum(n) OVER (PARTITION BY trajectory_id) AS p FROM cnt) GROUP BY 1),
uq AS (SELECT trajectory_id, count(DISTINCT (name, substr(args, 1, 200))) / count(*) AS ratio,
         max(CASE WHEN name = 'execute_bash' AND regexp_matches(lower(substr(args, 1, 200)), '{_alt(TEST_KEYWORDS)}') THEN 1.0 ELSE 0.0 END) AS test FROM call GROUP BY 1),
tok AS (SELECT trajectory_id, CAST(sum(len(regexp_extract_all(concat_ws(' ', nullif(content, ''),
          array_to_string(flatten(list_transform(coalesce(calls, []), lambda c: [coalesce(c.function.name, ''), coalesce(c.function.arguments, '')])), ' ')), '\\w+|[^\\w\\s]'))) AS BIGINT) AS tokens,
          sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS turns FROM m GROUP BY 1),
meta AS (SELECT trajectory_id, max(instance_id) AS instance_id, max(repo) AS repo, max(exit_status) AS exit_status, max(coalesce(resolved, 0)) AS resolved, max(model_patch) AS model_patch FROM t GROUP BY 1),
raw AS (SELECT trajectory_id, instance_id, repo, coalesce(tokens, 0) AS total_tokens, CAST(coalesce(turns, 0) AS BIGINT) AS assistant_turns,
          CAST(coalesce(calls, 0) AS BIGINT) AS total_tool_calls, exit_status,
          lower(trim(coalesce(exit_status, ''))) = 'submit' AS ends_with_submit, lower(trim(coalesce(exit_status, ''))) <> 'submit' AS is_error_or_timeout,
          CAST(resolved AS BIGINT) AS resolved, coalesce(regexp_matches(model_patch, '\\S'), false) AS has_patch, CAST(coalesce(length(model_patch), 0) AS BIGINT) AS patch_length,
          coalesce(chars / n_obs, 0.0) AS avg_observation_length, CAST(coalesce(n_obs, 0) AS BIGINT) AS num_observations,
          coalesce(uq.ratio, 1.0) AS unique_action_ratio, CAST(coalesce(test, 0.0) AS DOUBLE) AS test_alignment_score,
          CASE WHEN coalesce(b1.n, 0) < 2 THEN 0.0 ELSE r / b1.n END AS redundant_cmds_ratio, CAST(coalesce(cycles, 0) AS BIGINT) AS error_retry_count,
          CAST(greatest(coalesce(b1.n, 0) - 1, 0) AS BIGINT) AS total_action_pairs, coalesce(coalesce(noise, 0) / chars, 0.0) AS obs_noise_char_ratio,
          coalesce(c3.ratio, 1.0) AS obs_utilization_ratio, coalesce(kinds, 0) AS kinds, CAST(coalesce(entropy, 0.0) AS DOUBLE) AS entropy
        FROM meta LEFT JOIN b1 USING (trajectory_id) LEFT JOIN b2 USING (trajectory_id) LEFT JOIN c1 USING (trajectory_id) LEFT JOIN c3 USING (trajectory_id)
          LEFT JOIN ent USING (trajectory_id) LEFT JOIN uq USING (trajectory_id) LEFT JOIN tok USING (trajectory_id))
"""

SCORES = """
v1 AS (SELECT *, .30 * trunc + .25 * outcome + .20 * step_eff + .15 * obs_noise + .10 * entropy AS composite_q FROM (
         SELECT *, CASE WHEN total_tokens = 0 THEN 0.0 ELSE least(total_tokens, 131072) / total_tokens END AS trunc,
           CASE WHEN NOT ends_with_submit THEN 0.0 WHEN resolved = 1 THEN 1.0 ELSE 0.5 END AS outcome,
           CASE WHEN total_tool_calls = 0 THEN 0.0 ELSE least(1.0, kinds / total_tool_calls * 10) END AS step_eff,
           CASE WHEN num_observations = 0 THEN 1.0 ELSE 1 - least(1.0, avg_observation_length / 10000) END AS obs_noise FROM raw)),
med AS (SELECT instance_id, median(assistant_turns) AS median_turns FROM v1 WHERE trunc >= 0.9 AND resolved = 1 GROUP BY 1),
v3 AS (SELECT *, (b2s + b3s) / 2 AS eff, (c2s + c3s) / 2 AS sty FROM (
         SELECT v1.*, gate, CASE WHEN gate THEN 1 - redundant_cmds_ratio END AS b1s, CASE WHEN gate THEN 1 - least(1.0, error_retry_count / 10) END AS b2s,
           CASE WHEN NOT gate THEN NULL WHEN median_turns > 0 AND assistant_turns > 0 THEN 1 - (greatest(0.5, least(3.0, assistant_turns / median_turns)) - 0.5) / 2.5 ELSE 0.5 END AS b3s,
           CASE WHEN gate THEN 1 - obs_noise_char_ratio END AS c1s, CASE WHEN gate THEN entropy END AS c2s, CASE WHEN gate THEN obs_utilization_ratio END AS c3s
         FROM (SELECT *, trunc >= 0.9 AND resolved = 1 AS gate FROM v1) v1 LEFT JOIN med ON med.instance_id = v1.instance_id))
"""

CHAT = """
t AS (SELECT DISTINCT * FROM trajectories),
m AS (SELECT trajectory_id, i, trajectory[i].role AS role, coalesce(trajectory[i].content, '') AS content, coalesce(trajectory[i].tool_calls, []) AS calls
      FROM t, unnest(range(1, len(trajectory) + 1)) AS u(i)),
c0 AS (SELECT trajectory_id, i, CASE role WHEN 'tool' THEN 'user' ELSE role END AS role,
         CASE WHEN role = 'tool' THEN '<tool_response>' || chr(10) || content || chr(10) || '</tool_response>'
              WHEN role = 'assistant' AND len(calls) > 0 THEN (CASE WHEN content <> '' THEN content || chr(10) ELSE '' END) ||
                array_to_string(list_transform(calls, lambda c: '<tool_call>' || chr(10) || '{"name": "' || coalesce(c.function.name, '') || '", "arguments": ' || coalesce(c.function.arguments, '{}') || '}' || chr(10) || '</tool_call>'), chr(10))
              ELSE content END AS content
       FROM m WHERE role IN ('system', 'user', 'assistant', 'tool')),
c1 AS (SELECT trajectory_id, row_number() OVER (PARTITION BY trajectory_id ORDER BY i) AS i, role, content FROM c0 WHERE NOT (role = 'assistant' AND content = '')),
c AS (SELECT * FROM c1 WHERE trajectory_id IN (SELECT trajectory_id FROM c1 GROUP BY 1 HAVING count(*) >= 2)),
txt AS (SELECT trajectory_id, string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY i) AS text FROM c GROUP BY 1),
n AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY i) AS j, lead(role) OVER (PARTITION BY trajectory_id ORDER BY i) AS next_role,
        lead(content) OVER (PARTITION BY trajectory_id ORDER BY i) AS next_content FROM c WHERE role <> 'system'),
sys AS (SELECT trajectory_id, count(*) AS n_sys FROM c WHERE role = 'system' GROUP BY 1),
turn AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY i) AS k FROM n WHERE role = 'user' AND next_role = 'assistant'),
first_reply AS (SELECT trajectory_id, arg_min(content, i) AS target FROM n WHERE role = 'assistant' GROUP BY 1),
fa AS (SELECT trajectory_id, CAST(coalesce(n_sys, 0) + 1 AS INTEGER) AS n_prompt, target FROM first_reply JOIN n USING (trajectory_id) LEFT JOIN sys USING (trajectory_id) WHERE n.j = 1 AND n.role = 'user'),
pair AS (SELECT trajectory_id, turn.next_content AS generated, fa.target AS truth FROM fa JOIN turn USING (trajectory_id) WHERE turn.k = 4)
"""

POOL = (
    LAST
    + f""",
pool AS (SELECT trajectory_id, composite_q AS score, coalesce(exit_status, '') AS exit_status, total_tokens FROM st),
train AS (SELECT DISTINCT {canonical_id("trajectory_id")} AS trajectory_id FROM split_rows WHERE subset_name IS NOT NULL)
"""
)

_GATE_COLS = ["composite_score", "efficiency_score", "style_score", *SUB_SCORES]
GATE = (
    LAST
    + f""",
gate AS (SELECT trajectory_id, {", ".join(_GATE_COLS)} FROM sc),
every AS (SELECT trajectory_id, composite_q, total_tokens, assistant_turns, ends_with_submit, resolved, repo FROM st)
"""
)


def _subset(spec: subsets.Subset) -> str:
    order = "md5('42:' || trajectory_id), trajectory_id" if spec.order is None else f"{spec.order} {'ASC' if spec.ascending else 'DESC'} NULLS LAST, trajectory_id"
    return f"(SELECT '{spec.name}' AS subset_name, trajectory_id, CAST({spec.order or 'NULL'} AS DOUBLE) AS order_score FROM {'every' if spec.pool == 'all' else 'gate'} ORDER BY {order} LIMIT {spec.size})"


MEMBERS = (
    GATE
    + ", built AS ("
    + " UNION ALL ".join(f"SELECT *, {'false' if s.pool == 'all' else 'true'} AS gated FROM {_subset(s)}" for s in subsets.catalogue())
    + "), members AS (SELECT built.subset_name, trajectory_id, order_score, "
    + ", ".join(f"CASE WHEN gated THEN gate.{c} END AS {c}" for c in _GATE_COLS)
    + ", every.* EXCLUDE (trajectory_id) FROM built LEFT JOIN gate USING (trajectory_id) LEFT JOIN every USING (trajectory_id))"
)

LOSS = (
    POOL
    + """,
lrows AS (SELECT split, trajectory_id, CASE WHEN trim(exit_status) <> '' THEN lower(trim(exit_status)) ELSE 'none' END AS model, 1 - score AS loss, total_tokens AS n_tokens
          FROM (SELECT DISTINCT split, """
    + canonical_id("trajectory_id")
    + """ AS trajectory_id FROM split_rows WHERE split IN ('gold', 'random', 'low_q')) JOIN pool USING (trajectory_id)),
loss AS (SELECT model, split, round(avg(loss), 6) AS mean_loss, round(stddev_pop(loss), 6) AS std_loss, round(exp(avg(loss)), 6) AS perplexity, count(loss) AS n_valid,
           count(*) - count(loss) AS n_failed, round(avg(n_tokens), 6) AS mean_tokens FROM lrows GROUP BY ALL)
"""
)

POINTS = LAST + ", pts AS (SELECT repo, round(avg(composite_q), 6) AS q, round(avg(assistant_turns), 6) AS turns, round(avg(total_tokens), 6) AS tokens FROM st WHERE repo IS NOT NULL GROUP BY 1)"


def _shuffled(split: str, source: str) -> str:
    return f"(SELECT '{split}' AS split, trajectory_id FROM {source} ORDER BY md5('42:{split}:' || trajectory_id), trajectory_id LIMIT {LIMITS.test_set_size})"


TESTS = (
    POOL
    + f""",
elig AS (SELECT * FROM pool WHERE trajectory_id NOT IN (SELECT trajectory_id FROM train)),
gold0 AS (SELECT * FROM elig WHERE score >= (SELECT quantile_cont(score, 0.9) FROM elig)),
gold1 AS (SELECT * FROM gold0 WHERE lower(exit_status) IN ('submit', 'success', 'resolved')),
gold2 AS (SELECT * FROM gold1 UNION SELECT * FROM gold0 WHERE (SELECT count(*) FROM gold1) < {LIMITS.test_set_size}),
gold AS {_shuffled("gold", "gold2")},
rest AS (SELECT * FROM elig WHERE trajectory_id NOT IN (SELECT trajectory_id FROM gold)),
low0 AS (SELECT * FROM rest WHERE score <= (SELECT quantile_cont(score, 0.1) FROM rest)),
low1 AS (SELECT * FROM low0 WHERE lower(exit_status) IN ('error', 'timeout', 'failed', 'exit_cost')),
low2 AS (SELECT * FROM low1 UNION SELECT * FROM low0 WHERE (SELECT count(*) FROM low1) < {LIMITS.test_set_size}),
low AS {_shuffled("low_q", "low2")},
rest2 AS (SELECT * FROM rest WHERE trajectory_id NOT IN (SELECT trajectory_id FROM low)),
rnd AS {_shuffled("random", "rest2")},
sets AS (SELECT * FROM gold UNION ALL SELECT * FROM low UNION ALL SELECT * FROM rnd)
"""
)


def _hist(table: str, column: str, bins: int, where: str = "true") -> str:
    return f"""
    WITH {LAST}, x AS (SELECT CAST({column} AS DOUBLE) AS v FROM {table} WHERE {column} IS NOT NULL AND {where}),
    b AS (SELECT min(v) AS lo, max(v) AS hi FROM x),
    y AS (SELECT CASE WHEN hi = lo THEN 1 ELSE CAST(least({bins}, floor((v - lo) / ((hi - lo) / {bins})) + 1) AS INTEGER) END AS bin, lo, hi FROM x, b)
    SELECT bin, round(lo + (bin - 1) * ((hi - lo) / {bins}), 6) AS lower_edge, count(*) AS n FROM y GROUP BY ALL"""


def _type(c: str) -> str:
    name = lambda names: f"""regexp_matches({c}, '"name"\\s*:\\s*"({names})"')"""
    return f"""CASE WHEN {name("execute_bash|bash|run_command")} THEN 'bash' WHEN {name("str_replace_editor|write_file|edit_file|create_file|str_replace")} THEN 'edit'
      WHEN {name("search|grep|find|read_file|view|open_file")} THEN 'search' WHEN regexp_matches({c}, '<think>|<reasoning>') THEN 'think'
      WHEN {name("finish|submit|exit")} THEN 'finish' WHEN contains({c}, '<tool_call>') THEN 'tool_call_other' ELSE 'text' END"""


def _paths(c: str) -> str:
    groups = " || ".join(f"regexp_extract_all({c}, '{PATH_PATTERN}', {i})" for i in (1, 2, 3))
    return f"list_distinct(list_filter(list_transform({groups}, lambda p: trim(trim(p), '\"')), lambda p: length(p) >= 3 AND contains(p, '/')))"


ACTIONS = (
    CHAT
    + f""",
fmt AS (SELECT *, {_type("generated")} AS pred_action_type, {_type("truth")} AS gt_action_type,
          {_paths("generated")} AS pg, {_paths("truth")} AS pt, regexp_extract(generated, '(?s)<tool_call>(.*?)</tool_call>', 1) AS body,
          regexp_matches(generated, '(?s)<tool_call>.*?</tool_call>') AS closed FROM pair),
rows AS (SELECT *, pred_action_type = gt_action_type AS action_type_match,
           CASE WHEN len(pg) = 0 AND len(pt) = 0 THEN 1.0 WHEN len(pg) = 0 OR len(pt) = 0 THEN 0.0 ELSE len(list_intersect(pg, pt)) / len(list_distinct(pg || pt)) END AS file_match_score,
           regexp_replace(generated, '^\\s+|\\s+$', '', 'g') = regexp_replace(truth, '^\\s+|\\s+$', '', 'g') AS exact_match,
           CASE WHEN NOT contains(generated, '<tool_call>') THEN 0.0 WHEN NOT closed THEN 0.25 WHEN NOT json_valid(body) THEN 0.3
             ELSE 0.5 + CASE WHEN list_contains(json_keys(body), 'name') THEN 0.25 ELSE 0 END + CASE WHEN list_contains(json_keys(body), 'arguments') THEN 0.25 ELSE 0 END END AS format_score FROM fmt)
"""
)

_SUB = {"b1_redundant_commands": "b1s", "b2_error_retry": "b2s", "b3_step_count_ratio": "b3s", "c1_observation_cleanliness": "c1s", "c2_action_diversity": "c2s", "c3_observation_utilization": "c3s"}
_V3 = ", ".join(f"round({x}, 6) AS {c}" for c, x in _SUB.items()) + ", round(eff, 6) AS efficiency_score, round(sty, 6) AS style_score, round(0.5 * eff + 0.5 * sty, 6) AS composite_score"
_RAW_DOUBLES = ("avg_observation_length", "unique_action_ratio", "test_alignment_score", "redundant_cmds_ratio", "obs_noise_char_ratio", "obs_utilization_ratio")
_RAW = ", ".join(
    f"round({c}, 6) AS {c}" if c in _RAW_DOUBLES else c
    for c in ("instance_id", "repo", "total_tokens", "assistant_turns", "total_tool_calls", "exit_status", "ends_with_submit", "is_error_or_timeout", "resolved", "has_patch", "patch_length", "avg_observation_length", "num_observations", "unique_action_ratio", "test_alignment_score", "redundant_cmds_ratio", "error_retry_count", "total_action_pairs", "obs_noise_char_ratio", "obs_utilization_ratio")
)


def _long(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM {table}" for c in columns)


# Words and single marks as the label mask counts them, letters and digits of any script.
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SPANS = r"""
p AS (SELECT trajectory_id, text, string_split(text, '<|im_start|>assistant') AS parts FROM txt),
span AS (SELECT trajectory_id, text, k, parts[k + 2] AS part, list_sum(list_transform(parts[1:k + 1], lambda s: length(s))) + k * 21 AS b FROM p, unnest(range(0, len(parts) - 1)) AS u(k)),
ends AS (SELECT *, b + 21 + length(regexp_extract(part, '(?s)^(.*?)(?:<\|im_end\|>|<\|im_start\|>|$)', 1)) AS e FROM span)
"""
#: Upper tail of the normal distribution, by a rational approximation good to 1e-7.
_TAIL = """(CASE WHEN {z} < 0 THEN 1 ELSE 0 END + CASE WHEN {z} < 0 THEN -1 ELSE 1 END * exp(-{z} * {z} / 2) / sqrt(2 * pi())
  * (.319381530 / (1 + .2316419 * abs({z})) - .356563782 / (1 + .2316419 * abs({z})) ** 2 + 1.781477937 / (1 + .2316419 * abs({z})) ** 3
     - 1.821255978 / (1 + .2316419 * abs({z})) ** 4 + 1.330274429 / (1 + .2316419 * abs({z})) ** 5))"""
_DRAW = "CAST(('0x' || substr(md5('42:' || r || ':' || slot), 1, 12)) AS UBIGINT)"


def _more() -> dict[str, str]:
    tail = lambda z: _TAIL.format(z=f"({z})")
    arrays = "SELECT DISTINCT trajectory_id, step_idx, lower(trim(tool)) AS tool, n_tokens FROM steps WHERE trajectory_id IS NOT NULL AND step_idx IS NOT NULL"
    draws = f"d AS (SELECT r, pts2.* FROM range({LIMITS.bootstrap_rounds}) AS a(r), (SELECT count(*) AS n FROM pts2), unnest(range(1, n + 1)) AS b(slot), pts2 WHERE pts2.k = {_DRAW} % n)"
    shown = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SHOWN.items())
    sizes = ", ".join(f"('{a}', {b}, '{c}')" for a, b, c in SERIES)
    both = "generated IS NOT NULL AND truth IS NOT NULL"
    return {
        "mann_whitney_p": f"""WITH {LAST}, x AS (SELECT composite_q AS v, coalesce(has_patch, false) AS g FROM st WHERE composite_q IS NOT NULL),
          r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS rk FROM x),
          a AS (SELECT count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, sum(rk) FILTER (g) AS r1, count(*) AS n FROM r),
          t AS (SELECT CAST(sum(n * n * n - n) AS DOUBLE) AS tie_sum FROM (SELECT count(*) AS n FROM x GROUP BY v)),
          u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 * n2 / 2 AS m, sqrt(n1 * n2 / 12 * (n + 1 - tie_sum / (n * (n - 1)))) AS sd FROM a, t),
          p AS (SELECT *, unnest(['less', 'greater', 'two-sided']) AS alternative, unnest([{tail("(m - u - 0.5) / sd")}, {tail("(u - m - 0.5) / sd")}, least(1, 2 * {tail("(abs(u - m) - 0.5) / sd")})]) AS pv FROM u)
          SELECT n1, n2, round(u, 6) AS u, tie_sum, round(u / (n1 * n2), 6) AS prob_superiority, alternative, round(pv, 4) AS p,
            CASE WHEN pv < .01 THEN '***' WHEN pv < .05 THEN '**' WHEN pv < .1 THEN '*' ELSE '' END AS stars FROM p""",
        "masked_loss": f"SELECT trajectory_id, round(avg(n_tokens) FILTER (tool = 'execute_bash'), 6) AS loss FROM ({arrays}) GROUP BY 1",
        "padded_batches": f"WITH n AS (SELECT trajectory_id, count(*) AS n, substr(md5(trajectory_id), 1, 2) AS batch FROM ({arrays}) GROUP BY 1) SELECT trajectory_id, batch, CAST(max(n) OVER (PARTITION BY batch) AS INTEGER) AS n, CAST(max(n) OVER (PARTITION BY batch) - n AS INTEGER) AS n_pad FROM n",
        "next_action_summary": f"""WITH {ACTIONS.replace("fmt AS (SELECT *,", "many AS (SELECT trajectory_id, s AS n_steps, turn.next_content AS generated, fa.target AS truth FROM (SELECT DISTINCT trajectory_id FROM c) CROSS JOIN unnest([3, 5, 7]) AS q(s) LEFT JOIN fa USING (trajectory_id) LEFT JOIN turn ON turn.trajectory_id = c.trajectory_id AND turn.k = s + 1), fmt AS (SELECT *,").replace("FROM (SELECT DISTINCT trajectory_id FROM c) CROSS", "FROM (SELECT DISTINCT trajectory_id FROM c) AS c CROSS").replace("SELECT trajectory_id, s AS n_steps", "SELECT c.trajectory_id, s AS n_steps").replace("AS closed FROM pair)", "AS closed FROM many)")}
          SELECT n_steps, count(*) FILTER ({both}) AS n_evaluated, count(*) FILTER (NOT ({both})) AS n_skipped, round(avg(CAST(action_type_match AS INTEGER)) FILTER ({both}), 6) AS action_type_acc,
            round(avg(file_match_score) FILTER ({both}), 6) AS file_match, round(avg(format_score) FILTER ({both}), 6) AS format_score, round(avg(CAST(exact_match AS INTEGER)) FILTER ({both}), 6) AS exact_match FROM rows GROUP BY 1""",
        "seq_summary": f"""WITH {CHAT}, {_SPANS}, l AS (SELECT trajectory_id, any_value(length(text)) AS n, sum(e - b) AS labelled FROM ends GROUP BY 1)
          SELECT count(*) AS n, CAST(min(n) AS INTEGER) AS least, CAST(max(n) AS INTEGER) AS most, round(avg(n), 6) AS mean, median(n) AS median, round(sum(labelled) * 100.0 / sum(n), 6) AS labelled_pct FROM l""",
        "run_counters": f"""WITH {CHAT}, l AS (SELECT {canonical_id("trajectory_id")} AS id, length(text) AS n FROM txt WHERE contains(text, '<|im_start|>assistant')),
          w AS (SELECT DISTINCT {canonical_id("trajectory_id")} AS id FROM split_rows WHERE split = 'gold'), r AS (SELECT {canonical_id("trajectory_id")} AS id, count(*) AS k FROM trajectories GROUP BY 1)
          SELECT CAST((SELECT sum(k) FROM r) AS BIGINT) AS n_scanned, count(*) AS n_wanted, count(r.id) AS n_found, count(l.id) AS n_processed, count(*) FILTER (l.n > {COUNTED_CHARS}) AS n_truncated, count(*) FILTER (r.id IS NOT NULL AND l.id IS NULL) AS n_skipped
          FROM w LEFT JOIN r USING (id) LEFT JOIN l USING (id)""",
        "model_losses": f"""WITH {LOSS}, o AS (SELECT CASE WHEN trim(exit_status) <> '' THEN lower(trim(exit_status)) ELSE 'none' END AS model, count(*) AS n, count(*) FILTER (resolved = 1) AS n_solved FROM st GROUP BY 1)
          SELECT model, n, n_solved, mean_loss FROM o JOIN loss USING (model) WHERE split = 'gold'""",
        "scaling_series": f"""WITH {LOSS}, z(strategy, size, model) AS (VALUES {sizes}), y AS (SELECT z.*, mean_loss FROM z LEFT JOIN (SELECT * FROM loss WHERE split = 'gold') USING (model))
          SELECT *, round(mean_loss - lag(mean_loss) OVER (PARTITION BY strategy ORDER BY size, model), 6) AS step FROM y""",
        "display_names": f"WITH {LOSS} SELECT split, CASE model {shown} ELSE model END AS name, mean_loss FROM loss",
        "label_tokens": f"""WITH {CHAT}, {_SPANS}, t1 AS (SELECT trajectory_id, any_value(len(regexp_extract_all(text, '{_TOKEN}'))) AS n, sum(greatest(0, least({LIMITS.sequence_tokens} - len(regexp_extract_all(substr(text, 1, CAST(b AS BIGINT)), '{_TOKEN}')), len(regexp_extract_all(substr(text, CAST(b AS BIGINT) + 1, CAST(e - b AS BIGINT)), '{_TOKEN}'))))) AS k FROM ends GROUP BY 1)
          SELECT trajectory_id, CAST(least(n, {LIMITS.sequence_tokens}) AS INTEGER) AS n_tokens, CAST(k AS INTEGER) AS n_labels FROM t1 WHERE k > 0""",
        "bootstrap_mean": f"""WITH {POINTS}, pts2 AS (SELECT q, row_number() OVER (ORDER BY q, repo) - 1 AS k FROM pts WHERE q IS NOT NULL), {draws}, m AS (SELECT avg(q) AS m FROM d GROUP BY r)
          SELECT (SELECT count(*) FROM pts2) AS n, (SELECT round(avg(q), 6) FROM pts2) AS mean, round(quantile_cont(m, .025), 6) AS lo, round(quantile_cont(m, .975), 6) AS hi FROM m""",
        "bootstrap_band": f"""WITH {POINTS}, pts2 AS (SELECT turns AS x, q AS y, row_number() OVER (ORDER BY repo) - 1 AS k FROM pts), {draws},
          f AS (SELECT regr_slope(y, x) AS s0, regr_intercept(y, x) AS i0 FROM pts2), g AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM d GROUP BY r),
          l AS (SELECT "at", s0 * "at" + i0 AS fit, CASE WHEN s IS NULL OR isnan(s) THEN s0 * "at" + i0 ELSE s * "at" + i END AS y FROM g, f, unnest([10.0, 20.0, 40.0]) AS u("at"))
          SELECT CAST("at" AS DOUBLE) AS "at", round(any_value(fit), 6) AS fit, round(greatest(0, least(1, quantile_cont(y, .025))), 6) AS lo, round(greatest(0, least(1, quantile_cont(y, .975))), 6) AS hi FROM l GROUP BY "at" """,
    }


def oracle_sql() -> dict[str, str]:
    """SQL by query name; queries on tokenisers, sequences and resampling have none."""
    raw = f"WITH {BASE}, {METRICS} "
    full = f"WITH {BASE}, {METRICS}, {SCORES} "
    stop = r"^(.*?)(?:<\|im_end\|>|<\|im_start\|>|$)"
    prefix = lambda k: f"WITH {CHAT} SELECT trajectory_id, CAST(coalesce(n_sys, 0) + {2 * k + 1} AS INTEGER) AS n_prompt, next_content AS target FROM turn LEFT JOIN sys USING (trajectory_id) WHERE k = {k + 1}"
    q = {
        "flagship": full + f"SELECT trajectory_id, instance_id, {_V3} FROM v3 WHERE gate ORDER BY composite_score DESC, trajectory_id LIMIT {FLAGSHIP_SIZE}",
        "action_obs_pairing": f"WITH {BASE} SELECT trajectory_id, idx AS step_idx, tool, args_prefix, action_text, obs AS obs_text FROM act",
        "raw_metrics": raw + f"SELECT trajectory_id, {_RAW} FROM raw",
        "redundant_cmds": raw + "SELECT trajectory_id, round(redundant_cmds_ratio, 6) AS redundant_cmds_ratio FROM raw",
        "error_retry": raw + "SELECT trajectory_id, error_retry_count, total_action_pairs FROM raw",
        "obs_noise": raw + "SELECT trajectory_id, round(obs_noise_char_ratio, 6) AS obs_noise_char_ratio FROM raw",
        "obs_keywords": raw + "SELECT trajectory_id, idx AS step_idx, w AS keyword FROM kw",
        "obs_utilization": raw + "SELECT trajectory_id, round(obs_utilization_ratio, 6) AS obs_utilization_ratio FROM raw",
        "unique_action_ratio": raw + "SELECT trajectory_id, round(unique_action_ratio, 6) AS unique_action_ratio, test_alignment_score FROM raw",
        "tool_counts": f"WITH {BASE} SELECT trajectory_id, name AS tool, count(*) AS n FROM call GROUP BY ALL",
        "token_totals": raw + "SELECT trajectory_id, total_tokens FROM raw",
        "action_entropy": raw + "SELECT trajectory_id, round(entropy, 6) AS action_diversity FROM raw",
        "score_v1": full + "SELECT trajectory_id, round(trunc, 6) AS truncation_ratio, CAST(outcome AS DOUBLE) AS outcome_success, round(step_eff, 6) AS step_efficiency, round(obs_noise, 6) AS observation_noise, round(entropy, 6) AS action_diversity, round(composite_q, 6) AS composite_q FROM v1",
        "score_v2": full
        + """, x AS (SELECT *, CASE WHEN md > 0 AND assistant_turns > 0 THEN least(1.0, md / assistant_turns) ELSE 0.0 END AS ratio FROM v1, (SELECT median(assistant_turns) AS md FROM v1)),
        y AS (SELECT *, outcome * .7 + test_alignment_score * .3 AS co, unique_action_ratio * .5 + ratio * .5 AS ef, obs_noise * .4 + entropy * .4 + unique_action_ratio * .2 AS st FROM x)
        SELECT trajectory_id, round(ratio, 6) AS step_count_ratio, round(co, 6) AS v2_correctness, round(ef, 6) AS v2_efficiency, round(st, 6) AS v2_style, round(trunc, 6) AS v2_completeness,
          round(co * .35 + ef * .30 + st * .25 + trunc * .10, 6) AS composite_v2 FROM y""",
        "score_v3": full + f"SELECT trajectory_id, gate AS passes_gate, {_V3} FROM v3",
        "task_median": full + "SELECT * FROM med",
        "gate_filter": "SELECT DISTINCT trajectory_id, total_tokens, round(least(total_tokens, 131072) / total_tokens, 6) AS truncation_ratio FROM stats WHERE total_tokens > 0 AND least(total_tokens, 131072) / total_tokens >= 0.9 AND resolved = 1",
        "outcome_flags": "SELECT DISTINCT trajectory_id, lower(trim(coalesce(exit_status, ''))) = 'submit' AS submitted, CAST(CASE WHEN NOT ends_with_submit THEN 0.0 WHEN resolved = 1 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS outcome FROM stats",
        "tool_histogram": f"WITH {LAST} SELECT lower(trim(e.key)) AS tool, CAST(sum(e.value) AS BIGINT) AS n_calls, count(*) AS n_rows FROM (SELECT unnest(map_entries(tool_call_counts)) AS e FROM st) GROUP BY 1",
        "outcome_composition": f"WITH {LAST} SELECT repo, count(*) AS n, count(*) FILTER (ends_with_submit AND resolved = 1) AS n_solved, count(*) FILTER (ends_with_submit AND resolved <> 1) AS n_submitted, count(*) FILTER (NOT ends_with_submit) AS n_error FROM st GROUP BY 1",
        "global_summary": f"WITH {LAST} SELECT count(*) AS n, round(avg(total_tokens), 6) AS mean_tokens, round(avg(assistant_turns), 6) AS mean_turns, round(avg(CAST(resolved = 1 AS INTEGER)), 6) AS resolved_rate, count(DISTINCT repo) AS n_repos FROM st",
        "gate_summary": f"WITH {LAST} SELECT count(*) AS n_all, count(*) FILTER (truncation_ratio >= 0.9) AS n_untruncated, count(*) FILTER (resolved = 1) AS n_resolved, count(*) FILTER (truncation_ratio >= 0.9 AND resolved = 1) AS n_pass FROM st",
        "top_repos": f"WITH {LAST} SELECT repo AS value, count(*) AS n FROM st WHERE repo IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 30",
        "describe_scored": f"WITH {LAST} SELECT metric, count(value) AS n, round_even(avg(value), 4) AS mean, round_even(stddev_samp(value), 4) AS std, round_even(min(value), 4) AS min, round_even(quantile_cont(value, .25), 4) AS q25, round_even(quantile_cont(value, .5), 4) AS q50, round_even(quantile_cont(value, .75), 4) AS q75, round_even(max(value), 4) AS max FROM ({_long('sc', DIMENSIONS)}) GROUP BY 1",
        "dim_variance": f"WITH {LAST} SELECT metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(median(value), 6) AS median, coalesce(stddev_samp(value) < 0.05, false) AS low_variance FROM ({_long('sc', SUB_SCORES)}) GROUP BY 1",
        "histogram_tokens": _hist("st", "total_tokens", 80, "total_tokens > 0"),
        "histogram_turns": _hist("st", "assistant_turns", 50),
        "histogram_composite": _hist("sc", "composite_score", 40),
        "boxplot_composite": f"""WITH {LAST}, x AS (SELECT repo AS grp, composite_score AS v FROM sc WHERE repo IS NOT NULL AND composite_score IS NOT NULL),
          q AS (SELECT grp, quantile_cont(v, .25) AS a, quantile_cont(v, .5) AS b, quantile_cont(v, .75) AS c FROM x GROUP BY 1),
          j AS (SELECT *, v >= a - 1.5 * (c - a) AND v <= c + 1.5 * (c - a) AS inside FROM x JOIN q USING (grp))
          SELECT grp, round(min(v) FILTER (inside), 6) AS whisker_low, round(any_value(a), 6) AS q25, round(any_value(b), 6) AS q50, round(any_value(c), 6) AS q75, round(max(v) FILTER (inside), 6) AS whisker_high, count(*) FILTER (NOT inside) AS n_outliers FROM j GROUP BY 1""",
        "schema_normalise": "SELECT DISTINCT trajectory_id, instance_id, repo, total_tokens, assistant_turns, total_tool_calls, exit_status, ends_with_submit, is_error_or_timeout, resolved, has_patch, patch_length, round(avg_observation_length, 6) AS avg_observation_length, num_observations, round(truncation_ratio, 6) AS truncation_ratio, round(composite_q, 6) AS composite_Q, passes_gate, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in [*SUB_SCORES, "efficiency_score", "style_score", "composite_score"])
        + " FROM scored",
        "subset_stats": f"""WITH {MEMBERS}, z AS (SELECT *, coalesce(composite_score, composite_q) AS q FROM members)
          SELECT subset_name, count(*) AS actual_size, CASE WHEN count(composite_score) > 0 THEN 'v3' ELSE 'v1' END AS score_version, round(avg(q), 6) AS mean_q, round(median(q), 6) AS median_q, round(stddev_samp(q), 6) AS std_q,
            round(min(q), 6) AS min_q, round(max(q), 6) AS max_q, round(avg(total_tokens), 6) AS mean_tokens, round(median(total_tokens), 6) AS median_tokens, round(avg(assistant_turns), 6) AS mean_turns,
            round(avg(CAST(ends_with_submit AS INTEGER)), 6) AS submit_rate, round(avg(CAST(resolved = 1 AS INTEGER)), 6) AS resolved_rate, count(DISTINCT repo) AS unique_repos,
            {", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in ("efficiency_score", "style_score", "b2_error_retry", "b3_step_count_ratio", "c2_action_diversity", "c3_observation_utilization", "order_score"))}, round(median(order_score), 6) AS median_order_score FROM z GROUP BY 1""",
        "subset_overlap": f"""WITH {MEMBERS}, s AS (SELECT subset_name, count(*) AS n FROM members GROUP BY 1)
          SELECT x.subset_name AS a, y.subset_name AS b, x.n AS n_a, y.n AS n_b, CAST(c AS BIGINT) AS common, round(coalesce(c / (x.n + y.n - c), 0.0), 6) AS jaccard
          FROM (SELECT x.*, y.*, (SELECT count(*) FROM members p JOIN members q USING (trajectory_id) WHERE p.subset_name = x.subset_name AND q.subset_name = y.subset_name) AS c FROM s x, s y WHERE x.subset_name < y.subset_name) AS z(xn, xc, yn, yc, c)
            JOIN s x ON x.subset_name = xn JOIN s y ON y.subset_name = yn""",
        "subset_outcomes": f"WITH {MEMBERS} SELECT subset_name, count(*) AS n, count(*) FILTER (ends_with_submit AND resolved = 1) AS n_solved, count(*) FILTER (ends_with_submit AND resolved <> 1) AS n_submitted, count(*) FILTER (NOT ends_with_submit) AS n_error FROM members GROUP BY 1",
        "training_ids": f"SELECT DISTINCT {canonical_id('trajectory_id')} AS trajectory_id FROM split_rows WHERE subset_name IS NOT NULL",
        "quantile_filter": f"WITH {POOL}, b AS (SELECT * FROM pool WHERE score >= (SELECT quantile_cont(score, 0.9) FROM pool)) SELECT trajectory_id FROM b WHERE lower(exit_status) IN ('submit', 'success', 'resolved') OR (SELECT count(*) FROM b WHERE lower(exit_status) IN ('submit', 'success', 'resolved')) < 1",
        "relaxed_pool": f"WITH {POOL} SELECT trajectory_id FROM pool WHERE score <= (SELECT quantile_cont(score, 0.1) FROM pool)",
        "exclude_chain": f"WITH {POOL} SELECT trajectory_id FROM pool WHERE trajectory_id NOT IN (SELECT trajectory_id FROM train)",
        "testsets": f"WITH {TESTS} SELECT * FROM sets",
        "testset_audit": f"WITH {TESTS} SELECT split, count(*) AS n, count(train.trajectory_id) AS n_leaked FROM sets LEFT JOIN train USING (trajectory_id) GROUP BY 1",
        "leakage_audit": f"WITH k AS (SELECT *, {canonical_id('trajectory_id')} AS id FROM split_rows), e AS (SELECT DISTINCT split, id FROM k WHERE split <> 'train') SELECT split, count(*) AS n, count(*) FILTER (id IN (SELECT id FROM k WHERE subset_name IS NOT NULL)) AS n_leaked FROM e GROUP BY 1",
        "fetch_rows": f"SELECT DISTINCT trajectory_id, exit_status, resolved FROM trajectories WHERE {canonical_id('trajectory_id')} IN (SELECT {canonical_id('trajectory_id')} FROM split_rows WHERE split = 'gold')",
        "experiment_subsets": f"SELECT name, subset, count(*) AS n FROM (SELECT DISTINCT trim(name) AS name, lower(trim(subset)) AS subset FROM experiments) JOIN (SELECT DISTINCT lower(trim(subset_name)) AS subset, {canonical_id('trajectory_id')} AS id FROM split_rows) USING (subset) GROUP BY ALL",
        "resume_unseen": f"SELECT DISTINCT trajectory_id FROM trajectories WHERE {canonical_id('trajectory_id')} NOT IN (SELECT {canonical_id('trajectory_id')} FROM stats WHERE resolved = 1)",
        "chat_render": f"WITH {CHAT} SELECT trajectory_id, text FROM txt",
        "assistant_spans": f"""WITH {CHAT}, p AS (SELECT trajectory_id, string_split(text, '<|im_start|>assistant') AS parts FROM txt),
          x AS (SELECT trajectory_id, k, parts[k + 2] AS part, list_sum(list_transform(parts[1:k + 1], lambda s: length(s))) + k * 21 AS b FROM p, unnest(range(0, len(parts) - 1)) AS u(k))
          SELECT trajectory_id, CAST(k AS INTEGER) AS k, CAST(b AS INTEGER) AS span_begin, CAST(b + 21 + length(regexp_extract(part, '(?s){stop}', 1)) AS INTEGER) AS span_end FROM x""",
        "seq_lengths": f"""WITH {CHAT}, p AS (SELECT trajectory_id, length(text) AS n_chars, string_split(text, '<|im_start|>assistant')[2:] AS parts FROM txt)
          SELECT trajectory_id, CAST(n_chars AS INTEGER) AS n_chars, CAST(list_sum(list_transform(parts, lambda s: 21 + length(regexp_extract(s, '(?s){stop}', 1)))) AS INTEGER) AS n_label_chars FROM p WHERE len(parts) > 0""",
        "prefix_truncation": prefix(3),
        "prefix_truncation_5": prefix(5),
        "prefix_truncation_7": prefix(7),
        "first_action": f"WITH {CHAT} SELECT trajectory_id, n_prompt, target FROM fa",
        "action_type": f"WITH {ACTIONS} SELECT trajectory_id, pred_action_type, gt_action_type, action_type_match FROM rows",
        "format_score": f"WITH {ACTIONS} SELECT trajectory_id, CAST(format_score AS DOUBLE) AS format_score FROM rows",
        "path_extract": f"WITH {ACTIONS} SELECT trajectory_id, unnest(pt) AS path FROM rows",
        "path_jaccard": f"WITH {ACTIONS} SELECT trajectory_id, round(file_match_score, 6) AS file_match_score FROM rows",
        "exact_match": f"WITH {ACTIONS} SELECT trajectory_id, exact_match FROM rows",
        "action_summary": f"WITH {ACTIONS} SELECT count(*) AS n_evaluated, round(avg(CAST(action_type_match AS INTEGER)), 6) AS action_type_acc, round(avg(file_match_score), 6) AS file_match, round(avg(format_score), 6) AS format_score, round(avg(CAST(exact_match AS INTEGER)), 6) AS exact_match FROM rows",
        "category_dist": f"WITH {ACTIONS} SELECT 'all' AS grp, gt_action_type AS category, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (), 3) AS share FROM rows GROUP BY 2",
        "loss_summary": f"WITH {LOSS} SELECT * FROM loss",
        "loss_pivot": f"WITH {LOSS} SELECT model, {', '.join(f'''round_even(max(mean_loss) FILTER (split = '{x}'), 4) AS {x}''' for x in ('gold', 'random', 'low_q'))} FROM loss GROUP BY 1",
        "ablation_delta": f"WITH {LOSS}, r AS (SELECT split, mean_loss AS ref FROM loss WHERE model = 'submit') SELECT model, split, mean_loss, round((mean_loss - ref) / ref * 100, 6) AS delta_pct FROM loss LEFT JOIN r USING (split)",
        "impact_rank": f"WITH {LOSS}, r AS (SELECT split, mean_loss AS ref FROM loss WHERE model = 'submit') SELECT model, split, CAST(row_number() OVER (PARTITION BY split ORDER BY round((mean_loss - ref) / ref * 100, 6) DESC NULLS LAST, model) AS INTEGER) AS impact FROM loss LEFT JOIN r USING (split) WHERE model <> 'submit'",
        "quality_gradient": f"WITH {LOSS}, p AS (SELECT model, {', '.join(f'''round_even(max(mean_loss) FILTER (split = '{x}'), 4) AS {x}''' for x in ('gold', 'random', 'low_q'))} FROM loss GROUP BY 1) SELECT *, coalesce(gold < random AND random < low_q, false) AS monotone FROM p",
        "scaling_delta": f"WITH {LOSS}, p(strategy, small, large) AS (VALUES ('cost', 'exit_cost', 'submit'), ('time', 'timeout', 'submit')) SELECT strategy, a.split, small, large, a.mean_loss AS loss_small, b.mean_loss AS loss_large, round(b.mean_loss - a.mean_loss, 6) AS delta FROM p JOIN loss a ON a.model = small JOIN loss b ON b.model = large AND b.split = a.split",
        "mann_whitney": f"""WITH {LAST}, x AS (SELECT composite_q AS v, coalesce(has_patch, false) AS g FROM st WHERE composite_q IS NOT NULL),
          r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS rk FROM x),
          a AS (SELECT count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, sum(rk) FILTER (g) AS r1 FROM r),
          t AS (SELECT sum(n * n * n - n) AS tie_sum FROM (SELECT count(*) AS n FROM x GROUP BY v))
          SELECT n1, n2, round(r1 - n1 * (n1 + 1) / 2, 6) AS u, CAST(tie_sum AS DOUBLE) AS tie_sum, round((r1 - n1 * (n1 + 1) / 2) / (n1 * n2), 6) AS prob_superiority FROM a, t""",
        "spearman": f"""WITH {POINTS}, r AS (SELECT rank() OVER (ORDER BY turns) + (count(*) OVER (PARTITION BY turns) - 1) / 2 AS a, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2 AS b FROM pts WHERE turns IS NOT NULL AND q IS NOT NULL),
          z AS (SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r)
          SELECT n, rho, CASE WHEN rho IS NULL THEN 'N/A (constant)' WHEN rho < -0.7 THEN 'strong negative' WHEN rho <= -0.4 THEN 'moderate negative' WHEN rho < 0.4 THEN 'weak' WHEN rho < 0.7 THEN 'moderate positive' ELSE 'strong positive' END AS interpretation FROM z""",
        "linear_fit": f"WITH {POINTS} SELECT round(regr_slope(tokens, turns), 6) AS slope, round(regr_intercept(tokens, turns), 6) AS intercept, regr_count(tokens, turns) AS n FROM pts",
        "incremental_merge": """WITH e AS (SELECT DISTINCT trajectory_id FROM scored WHERE passes_gate AND resolved = 1 AND assistant_turns < 20), n AS (SELECT DISTINCT trajectory_id FROM scored WHERE passes_gate AND assistant_turns >= 15)
          SELECT trajectory_id, 'existing' AS origin FROM e UNION ALL SELECT trajectory_id, 'new' FROM n WHERE trajectory_id NOT IN (SELECT trajectory_id FROM e)""",
        "seq_stats_steps": "SELECT count(*) AS n, min(n_tokens) AS least, max(n_tokens) AS most, round(avg(n_tokens), 6) AS mean, median(n_tokens) AS median FROM (SELECT DISTINCT trajectory_id, step_idx, n_tokens FROM steps)",
        "experiment_matrix": "SELECT hypothesis, count(*) AS n, round(sum(est_gpu_hours), 6) AS gpu_hours FROM (SELECT DISTINCT * FROM experiments) GROUP BY 1",
        "activity_windows": "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    }
    q |= _more()
    for spec in subsets.catalogue():
        q[subset_query_name(spec.name)] = f"WITH {GATE} SELECT subset_name, trajectory_id FROM {_subset(spec)}"
    return q
