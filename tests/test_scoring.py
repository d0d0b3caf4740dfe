"""Raw metrics and scores on hand-made trajectories, branch by branch, and against plain Python."""

import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stepforge.config import ERROR_KEYWORDS, NOISE_PATTERNS
from stepforge.operators import scores
from stepforge.operators import steps as ops
from stepforge.sources.schema import TRAJECTORIES


def call(name="execute_bash", args="ls"):
    return {"function": {"name": name, "arguments": args}}


def act(*calls, content=""):
    return {"role": "assistant", "content": content, "tool_calls": list(calls) or [call()]}


def obs(text, role="tool"):
    return {"role": role, "content": text, "tool_calls": None}


def table(spark, *trajectories, **over):
    rows = []
    for i, t in enumerate(trajectories):
        row = dict(trajectory_id=f"t{i}", instance_id="own__name-1", repo="own/name", exit_status="submit", resolved=1, model_patch="x", trajectory=t)
        rows.append(row | over)
    return spark.createDataFrame(rows, TRAJECTORIES)


def metrics(spark, *trajectories, **over):
    return sorted(ops.trajectory_stats(table(spark, *trajectories, **over)).collect(), key=lambda r: r.trajectory_id)


def test_no_and_one_action(spark):
    none, one, null = metrics(spark, [], [act()], None)
    for r in (none, one, null):
        assert (r.redundant_cmds_ratio, r.error_retry_count, r.total_action_pairs) == (0, 0, 0)
    assert (none.unique_action_ratio, none.obs_utilization_ratio, none.avg_observation_length) == (1, 1, 0)


def test_redundancy_window(spark):
    other = [act(call(args=str(i))) for i in range(5)]
    near, far = metrics(spark, [act(call(args="x")), *other[:4], act(call(args="x"))], [act(call(args="x")), *other, act(call(args="x"))])
    assert near.redundant_cmds_ratio == pytest.approx(1 / 6) and far.redundant_cmds_ratio == 0


def test_observation_slots(spark):
    t = [obs("Error: before", "user"), act(call(args="a")), obs(""), obs("first"), obs("Error: second"), act(call(args="b"))]
    steps = {r.step_idx: r.obs_text for r in ops.steps(table(spark, t)).collect()}
    assert steps == {0: "first", 1: ""}
    (r,) = metrics(spark, t)
    assert r.num_observations == 3 and r.error_retry_count == 0 and r.obs_noise_char_ratio == pytest.approx((13 + 13) / (13 + 5 + 13))


def test_first_call_is_the_signature(spark):
    t = [act(call(args="a"), call("think", "b")), act(call(args="a"), call("think", "c"))]
    (r,) = metrics(spark, t)
    assert r.redundant_cmds_ratio == 0.5 and r.unique_action_ratio == 0.75 and r.total_tool_calls == 4


def test_retry_needs_a_next_action_of_the_same_tool(spark):
    bad = obs("Traceback: boom")
    a, b, c = metrics(spark, [act(), bad, act()], [act(), bad, act(call("think", "x"))], [act(), bad])
    assert (a.error_retry_count, b.error_retry_count, c.error_retry_count) == (1, 0, 0)


def test_keywords(spark):
    a, b, c = metrics(
        spark,
        [act(), obs("see src/ab.py and a.py, ValueError"), act(call(args="cat ab.py valueerror"))],
        [act(call(args="ab.py")), obs("src/ab.py"), act(call(args="none"))],
        [act(), obs("nothing")],
    )
    assert (a.obs_utilization_ratio, b.obs_utilization_ratio, c.obs_utilization_ratio) == (1, 0, 1)


def test_flags_and_repeated_rows(spark):
    df = table(spark, [act()], exit_status=" Submit ", model_patch=" \n", resolved=None)
    (r,) = ops.trajectory_stats(df.unionByName(df)).collect()
    assert r.ends_with_submit and not r.has_patch and r.patch_length == 2 and r.resolved == 0
    (n,) = metrics(spark, [act()], exit_status=None, model_patch=None)
    assert n.is_error_or_timeout and n.patch_length == 0


def test_extra_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    df = table(spark, [act(), obs("x"), act()]).withColumns({"actions": F.lit(1), "calls": F.lit(2), "m": F.lit(3), "n": F.lit(4)})
    assert ops.trajectory_stats(df).count() == 1


def test_empty_table(spark):
    df = table(spark, [act()]).limit(0)
    assert scores.add_v3(scores.add_v1(ops.trajectory_stats(df))).count() == 0


def score_rows(spark, rows):
    base = dict(trajectory_id="t", instance_id="i", total_tokens=100, assistant_turns=10, resolved=1)
    return spark.createDataFrame([base | r for r in rows], "trajectory_id string, instance_id string, total_tokens long, assistant_turns long, resolved long")


def test_gate(spark):
    rows = [{"total_tokens": n} for n in (0, 145_635, 145_636, None)] + [{"resolved": 0}]
    assert [r.g for r in score_rows(spark, rows).select(scores.passes_gate().alias("g")).collect()] == [False, True, False, False, False]


def test_step_count_score(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10, 10.0), (4, 10.0), (35, 10.0), (5, None), (0, 10.0)], "assistant_turns long, m double")
    assert [round(r.s, 6) for r in df.select(scores.step_count_score(F.col("m")).alias("s")).collect()] == [0.8, 1.0, 0.0, 0.5, 0.5]


def test_entropy(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([3],), ([2, 2],), ([1, 3],), ([],)], "c array<long>")
    want = [0, 1, -(0.25 * math.log2(0.25) + 0.75 * math.log2(0.75)), 0]
    assert [r.e for r in df.select(ops.entropy(F.col("c")).alias("e")).collect()] == pytest.approx(want)


texts = st.sampled_from(["", "fine", "Error: x\nok", "see lib/ab.py", "KeyError in cd.json", "warning: a\n\nb"])
tools = st.tuples(st.sampled_from(["bash", "edit"]), st.sampled_from(["a", "b", "ab.py", "keyerror"]))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(tools.map(lambda t: act(call(*t))), texts.map(obs)), max_size=12))
def test_against_plain_python(spark, messages):
    acts, seen, all_obs = [], [], []
    for m in messages:
        if m["role"] == "assistant":
            f = m["tool_calls"][0]["function"]
            acts.append((f["name"], f["arguments"]))
            seen.append("")
        elif m["content"]:
            all_obs.append(m["content"])
            if acts and not seen[-1]:
                seen[-1] = m["content"]
    n = len(acts)
    b1 = sum(acts[i] in acts[max(0, i - 5) : i] for i in range(n)) / n if n > 1 else 0
    b2 = sum(any(k in seen[i].lower() for k in ERROR_KEYWORDS) and acts[i][0] == acts[i + 1][0] for i in range(n - 1))
    chars = sum(map(len, all_obs))
    noise = sum(len(line) for o in all_obs for line in o.splitlines() if any(p in line.lower() for p in NOISE_PATTERNS))
    used = total = 0
    for i, o in enumerate(seen):
        words = {w.rsplit("/", 1)[-1] for w in re.findall(r"[\w./\-]+\.(?:py|json)\b", o.lower())}
        words = {w for w in words if len(w) > 4} | {w.lower() for w in re.findall(r"\b\w+(?:Error|Exception|Warning)\b", o)}
        later = " ".join(f"{a} {b}" for a, b in acts[i + 1 :]).lower()
        total += len(words)
        used += sum(w in later for w in words)
    (r,) = metrics(spark, messages)
    assert (r.redundant_cmds_ratio, r.error_retry_count, r.obs_noise_char_ratio, r.obs_utilization_ratio) == pytest.approx((b1, b2, noise / chars if chars else 0, used / total if total else 1))
