"""Chat text, text metrics, statistics, evaluation sets, profiles, sinks and streams."""

import bisect
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from stepforge.operators import chat, evaluation, profile, ranks, statistics, steps, subsets, testsets, textmetrics
from stepforge.sources import readers, sinks, tables
from stepforge.sources.schema import TRAJECTORIES


def conversation(spark, *messages):
    rows = [("t", "i", "r", "submit", 1, "", [dict(role=r, content=c, tool_calls=t) for r, c, t in messages])]
    return chat.with_chat(spark.createDataFrame(rows, TRAJECTORIES))


CALL = [{"function": {"name": "bash", "arguments": '{"command": "ls"}'}}]


def test_chat_and_spans(spark):
    df = conversation(spark, ("system", "s", None), ("user", "u", None), ("assistant", None, CALL), ("tool", "o", None), ("assistant", "", None), ("assistant", "end", None))
    (r,) = df.select(chat.render().alias("text"), "chat").withColumn("spans", chat.assistant_spans("text")).collect()
    assert [m.role for m in r.chat] == ["system", "user", "assistant", "user", "assistant"]
    assert r.chat[2].content == '<tool_call>\n{"name": "bash", "arguments": {"command": "ls"}}\n</tool_call>'
    assert r.chat[3].content == "<tool_response>\no\n</tool_response>"
    marks = [r.text[s.begin : s.end] for s in r.spans]
    assert len(marks) == 2 and all(m.startswith("<|im_start|>assistant") and "<|im_end|>" not in m for m in marks)


def test_short_conversations_are_rejected(spark):
    assert conversation(spark, ("user", "u", None)).count() == 0
    assert conversation(spark).count() == 0


def test_prefix_and_first_action(spark):
    turns = [("user", f"u{i}", None) if k == 0 else ("assistant", f"a{i}", None) for i in range(3) for k in range(2)]
    df = chat.with_turns(conversation(spark, ("system", "s", None), *turns))
    (r,) = df.select(chat.prefix(2).alias("p"), chat.prefix(3).alias("q"), chat.first_action().alias("f")).collect()
    assert [m.content for m in r.p.prompt] == ["s", "u0", "a0", "u1", "a1", "u2"] and r.p.target == "a2" and r.q is None
    assert [m.content for m in r.f.prompt] == ["s", "u0"] and r.f.target == "a0"
    (none,) = chat.with_turns(conversation(spark, ("assistant", "a", None), ("user", "u", None))).select(chat.first_action().alias("f")).collect()
    assert none.f is None


def test_label_mask(spark):
    df = conversation(spark, ("user", "one two", None), ("assistant", "three", None)).select("trajectory_id", chat.render().alias("text")).withColumn("spans", chat.assistant_spans("text"))
    (r,) = chat.label_mask(df).collect()
    assert len(r.input_ids) == len(r.labels) == len(r.attention_mask) and 0 < sum(x != -100 for x in r.labels) < len(r.labels)
    assert all(x in (-100, i) for x, i in zip(r.labels, r.input_ids))
    assert chat.label_mask(df, limit=3).count() == 0  # no labelled token is left


def test_label_mask_hands_examples_on(spark):
    def encode(text):
        """The task's memory in MB, then 20,000 equal tokens."""
        with open("/proc/self/statm") as f:
            return [(int(f.read().split()[1]) * 4096 >> 20, 0, 1)] + [(1, 0, 1)] * 20_000

    df = spark.range(800).coalesce(1).select(F.col("id").cast("string").alias("trajectory_id"), F.lit("x").alias("text"), F.expr("array(named_struct('begin', 0, 'end', 1))").alias("spans"))
    rows = chat.label_mask(df, encode).select(F.col("input_ids")[0].alias("mb"), F.size("labels").alias("n")).collect()
    assert len(rows) == 800 and {r.n for r in rows} == {20_001}
    assert max(r.mb for r in rows) - min(r.mb for r in rows) < 100  # 16 million tokens


@pytest.mark.parametrize("limit", [1, 7, 40, 32_768])
def test_label_mask_of_words_is_that_of_places(spark, limit):
    long, places = "ab_1 \u00e9\u0301x, <|im_end|>\n" * 6000 + "w" * 70_000 + " ." * 40_000, [(0, 0), (3, 9), (9, 9), (9, 30), (31, 31), (120_000, 190_000)]
    texts = {"long": (long, places), "whole": (long, [(0, len(long))]), "inside": ("alpha beta gamma", [(2, 8), (8, 9), (13, 13)]), "end": ("a b", [(2, 9)]), "blank": (" \n ", [(0, 3)]), "empty": ("", [(0, 0)]), "none": ("a b", []), "nested": ("a b c d e f", [(2, 9), (4, 5)]), "lone": ("\U0001f600 \u0663\u00b2 \u4e2d\u6587 - x\x1cy\u00a0z", [(2, 4), (8, 9), (9, 11)])}
    df = spark.createDataFrame([(k, t, [dict(begin=b, end=e) for b, e in p]) for k, (t, p) in texts.items()], "trajectory_id string, text string, spans array<struct<begin: int, end: int>>")
    by_words, by_places = ({r.trajectory_id: r for r in chat.label_mask(df, encode, limit).collect()} for encode in (None, chat.word_tokens))
    assert by_words == by_places and "blank" not in by_words and ("whole" in by_words)
    assert {len(r.labels) for r in by_words.values()} <= set(range(1, limit + 1))


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(f(*map(F.col, names)).alias("x")).first().x


@pytest.mark.parametrize("text, score", [("no", 0), (None, 0), ("<tool_call>{", 0.25), ("<tool_call>{x</tool_call>", 0.3), ("<tool_call>{}</tool_call>", 0.5), ('<tool_call>{"name": 1}</tool_call>', 0.75), ('<tool_call>\n{"name": 1, "arguments": {}}\n</tool_call>', 1)])
def test_format_score(spark, text, score):
    assert one(spark, textmetrics.format_score, text) == score


@pytest.mark.parametrize("text, kind", [('"name": "bash"', "bash"), ('"name":"view"', "search"), ('"name": "open_file"', "search"), ("<think>", "think"), ('"name": "submit"', "finish"), ("<tool_call>", "tool_call_other"), ("hm", "text"), (None, "text")])
def test_action_type(spark, text, kind):
    assert one(spark, textmetrics.action_type, text) == kind


def test_paths(spark):
    paths = lambda t: one(spark, textmetrics.file_paths, t)
    assert sorted(paths('"path": "/a/b.py" and src/c.py x')) == ["/a/b.py", "src/c.py"]
    assert paths("none") == [] and paths(None) == []
    j = lambda a, b: one(spark, lambda x, y: textmetrics.jaccard(textmetrics.file_paths(x), textmetrics.file_paths(y)), a, b)
    assert (j("", ""), j("a/b.py", ""), j(" a/b.py", " a/b.py c/d.py")) == (1, 0, 0.5)


def test_similarity():
    assert textmetrics.rouge_l_score("a b c", "a x c") == pytest.approx(2 / 3)
    assert textmetrics.rouge_l_score("", "a") == textmetrics.rouge_l_score(None, None) == 0
    assert textmetrics.bleu4_score("a b c d e", "a b c d e") == pytest.approx(1)
    assert textmetrics.bleu4_score("x", "a") == 0


@pytest.mark.parametrize("u, alternative, p", [(20905, "less", 0.7832), (18551, "less", 0.1051), (17139, "less", 0.0067), (21177, "greater", 0.1544), (20572, "greater", 0.3105), (19331, "greater", 0.7187)])
def test_published_p_values(u, alternative, p):
    assert statistics.mann_whitney_p(200, 200, u, alternative=alternative) == pytest.approx(p, abs=5e-5)


def test_mann_whitney(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (2.0, False), (3.0, False), (None, True)], "v double, g boolean")
    r = statistics.mann_whitney(df, "v", F.col("g")).first()
    assert (r.n1, r.n2, r.u) == (2, 2, 0.5)
    e = statistics.mann_whitney(df.limit(0), "v", F.col("g")).first()
    assert (e.n1, e.n2) == (0, 0) and math.isnan(statistics.mann_whitney_p(0, 0, 0.0))


def test_spearman(spark):
    df = spark.createDataFrame([(0.91, 0.137), (0.47, 0.2), (0.46, 0.212), (0.41, 0.248)], "x double, y double")
    assert statistics.spearman(df, "x", "y").first().rho == -1
    assert statistics.spearman_p([4, 3, 2, 1], [1, 2, 3, 4]) == pytest.approx(2 / 24)
    assert statistics.spearman(df.withColumn("y", F.lit(1.0)), "x", "y").first().rho is None
    assert statistics.spearman(df.limit(2), "x", "y").first().rho is None


def test_bootstrap_is_repeatable(spark):
    df = spark.createDataFrame([(float(i), str(i)) for i in range(8)], "v double, k string")
    a, b = (statistics.bootstrap_mean(df, "v", ["k"], rounds=50).first() for _ in range(2))
    assert a == b and a.lo < a.mean < a.hi


def test_test_sets_are_disjoint(spark):
    pool = spark.createDataFrame([(f"trj-t{i}", i / 100, "submit" if i % 2 else "error") for i in range(100)], "trajectory_id string, score double, exit_status string")
    # Training ids are spelled otherwise: case, quotes, folder and ending, another dash, blanks.
    spell = ["TRJ-T{}", '"trj-t{}"', "runs/7/trj-t{}.json", "trj_t{}", " t{} ", "trajectory-t{}"]
    training = spark.createDataFrame([(spell[i // 10 % len(spell)].format(i),) for i in range(0, 100, 10)] + [(None,)], "trajectory_id string")
    rows = testsets.build(pool, training, n=4).collect()
    ids = [r.trajectory_id for r in rows]
    assert len(ids) == len(set(ids)) == 12 and not set(ids) & {f"trj-t{i}" for i in range(0, 100, 10)}
    assert {r.split for r in rows} == {"gold", "low_q", "random"}
    assert all(r.n_leaked == 0 for r in testsets.audit(testsets.build(pool, training, n=4), training).collect())
    leaked = spark.createDataFrame([("gold", "trj-t10"), ("gold", "Trj_t20"), ("gold", "trj-t11")], "split string, trajectory_id string")
    assert [tuple(r) for r in testsets.audit(leaked, training).collect()] == [("gold", 3, 2)]


def test_ranks_and_quantiles(spark):
    """Against a plain sort, with more values than a bucket holds, ties, NULLs, NaN, groups and no rows."""
    rng = random.Random(3)
    rows = [(g, rng.choice([None, float("nan"), round(rng.gauss(0, 1), 2), rng.random() ** 9])) for g in "aab" for _ in range(700)]
    df = spark.createDataFrame(rows + [("c", None)], "g string, v double")
    known = lambda g: sorted(v for k, v in rows if k in g and v is not None and v == v)

    def quantile(values, q):
        h = (len(values) - 1) * q
        lo = int(h)
        return values[lo] + (values[min(lo + 1, len(values) - 1)] - values[lo]) * (h - lo)

    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    assert ranks.quantiles(df, "v", shares).first().q == pytest.approx([quantile(known("ab"), q) for q in shares])
    by = {r.g: r.q for r in ranks.quantiles(df, "v", shares, ["g"]).collect()}
    assert by == {g: pytest.approx([quantile(known(g), q) for q in shares]) for g in "ab"}
    assert ranks.quantiles(df.limit(0), "v", [0.5]).first().q is None
    counts = df.filter("v is not null and not isnan(v)").groupBy("v").agg(F.count("*").alias("n"))
    values = known("ab")
    for r in ranks.running(counts, "v", "n").collect():
        assert r.before == bisect.bisect_left(values, r.v) and r.total == len(values)


def test_strict_pool_is_relaxed(spark):
    pool = spark.createDataFrame([(f"t{i}", i / 10, "error") for i in range(10)], "trajectory_id string, score double, exit_status string")
    assert testsets.quality_pool(pool, 0.5, True, ("submit",), 3).count() == 5
    assert testsets.quality_pool(pool, 0.5, True, ("submit",), 0).count() == 0


def test_missing_subset_is_an_error(spark):
    rows = spark.createDataFrame([("A", "t1")], "subset_name string, trajectory_id string")
    with pytest.raises(ValueError):
        testsets.training_ids(rows, ["A", "B"])
    with pytest.raises(ValueError):
        subsets.build_all(rows, rows, names=["nope"])


def test_subset_sizes_nest_and_clamp(spark):
    pool = spark.createDataFrame([(f"t{i}",) for i in range(30)], "trajectory_id string")
    small, large = (subsets.build(pool, subsets.Subset("R", "all", None, n)) for n in (5, 50))
    assert large.count() == 30 and {r.trajectory_id for r in small.collect()} <= {r.trajectory_id for r in large.collect()}


def test_profiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,), (float("nan"),)], "v double")
    d = profile.describe(df, ["v"]).first()
    assert (d.n, d.min, d.max, d.q50) == (4, 1, 10, 3)
    assert sum(r.n for r in profile.histogram(df, "v", 3).collect()) == 4
    assert profile.histogram(df.limit(0), "v", 3).count() == 0
    assert profile.histogram(df.filter("v = 1"), "v", 3).first().bin == 1


def test_normalise_schema(spark):
    df = spark.createDataFrame([("1", "x")], "a string, b string")
    assert profile.normalise_schema(df, {"a": "int", "b": "double", "c": "string"}).first().asDict() == {"a": 1, "b": None, "c": None}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("t1\n\n t2 \nt1\n")
    assert {r.trajectory_id for r in readers.read_ids(spark, str(tmp_path / "ids.txt")).collect()} == {"t1", "t2"}
    (tmp_path / "r.json").write_text(json.dumps({"base": {"gold": {"mean_loss": 1.5, "n_valid": 2}}}))
    r = readers.read_results(spark, str(tmp_path / "r.json")).first()
    assert (r.model, r.split, r.mean_loss, r.n_valid) == ("base", "gold", 1.5, 2)
    rows = spark.createDataFrame([("t1", 0.5, {"a": 1})], "trajectory_id string, composite_score double, m map<string,int>")
    sinks.write_subset(rows, str(tmp_path / "out"), "A")
    back, meta = readers.read_subset(spark, str(tmp_path / "out"), "A")
    assert back.count() == meta["actual_size"] == 1 and readers.discover_subsets(str(tmp_path / "out")) == ["A"]
    assert readers.read_csv(spark, str(tmp_path / "out/A/csv"), "trajectory_id string, composite_score double").first().composite_score == 0.5
    with pytest.raises(ValueError):
        readers.require(rows, ["nope"])
    assert "| t1 |" in sinks.markdown(rows.select("trajectory_id"), ["trajectory_id"])


def test_merge(spark):
    old, new = (spark.createDataFrame(r, "model string, v int") for r in ([("a", 1)], [("a", 2), ("b", 3)]))
    assert {tuple(r) for r in sinks.merge_results(old, new, ["model"]).collect()} == {("a", 1), ("b", 3)}
    assert {tuple(r) for r in sinks.merge_results(old, new, ["model"], force=True).collect()} == {("a", 2), ("b", 3)}


def test_stream_equals_batch(spark, data, tmp_path):
    from stepforge.operators.scores import add_v1
    from stepforge.operators.steps import trajectory_stats
    from stepforge.sources import table
    from stepforge.streaming.scoring import read_stream, score_stream

    rows = table(spark, data, "trajectories")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        score_stream(read_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    cols = ["trajectory_id", "composite_q", "error_retry_count"]
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*cols).collect()}
    want = {tuple(r) for r in add_v1(trajectory_stats(rows)).select(*cols).collect()}
    assert got == want


def test_spearman_and_mann_whitney_p():
    assert statistics.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    assert statistics.correlation_p(10, 0.6) == pytest.approx(0.066688, abs=1e-6)
    assert math.isnan(statistics.correlation_p(2, 0.5)) and statistics.correlation_p(5, 1.0) == 0


def test_rank_tests_as_columns(spark):
    df = spark.createDataFrame([(float(i), i % 3 == 0) for i in range(30)], "v double, g boolean")
    rows = {r.alternative: r for r in evaluation.mann_whitney_test(df, "v", F.col("g")).collect()}
    r = rows["less"]
    assert r.p == round(statistics.mann_whitney_p(r.n1, r.n2, r.u, r.tie_sum, "less"), 4) and set(rows) == {"less", "greater", "two-sided"}
    assert all(r.p is None for r in evaluation.mann_whitney_test(df.filter("g"), "v", F.col("g")).collect())
    xy = df.withColumn("w", F.col("v") * F.col("v"))
    assert evaluation.spearman_test(xy, "v", "w").first().asDict() == {"n": 30, "rho": 1.0, "p": 0.0, "interpretation": "strong positive"}
    assert evaluation.spearman_test(xy.limit(2), "v", "w").first().p is None


def test_losses_and_padding(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, None, 9.0], [1, 2, 3, -100], "x"), ("b", [1.0], [-100], "x"), ("c", None, None, "y")], "k string, losses array<double>, labels array<int>, batch string")
    assert {r.k: r.m for r in df.select("k", evaluation.masked_loss(F.col("losses"), F.col("labels")).alias("m")).collect()} == {"a": 1.5, "b": None, "c": None}
    assert {r.k: r.labels for r in evaluation.padded(df, "batch", "labels").collect()} == {"a": [1, 2, 3, -100], "b": [-100] * 4, "c": []}
    assert evaluation.display_name(F.col("k"), {}) is not None
    names = df.select(evaluation.display_name(F.col("k"), {"a": "A"}).alias("n"))
    assert sorted(r.n for r in names.collect()) == ["A", "b", "c"]


def test_json_arguments(spark):
    call = lambda a: [{"function": {"name": "bash", "arguments": a}}]
    c = [("user", "go", None), ("assistant", None, call('{"b":1,"a":"é"}')), ("assistant", "x", call("ls -la")), ("assistant", "x", call(None))]
    rows = [("t", "i", "r", "submit", 1, "", [dict(role=r, content=c, tool_calls=t) for r, c, t in c])]
    chats = chat.with_chat(spark.createDataFrame(rows, TRAJECTORIES), parse_arguments=True).first().chat
    assert '"arguments": {"b": 1, "a": "é"}}' in chats[1].content and '"arguments": ls -la}' in chats[2].content and '"arguments": {}}' in chats[3].content
    assert evaluation.json_text("[1,2]") == "[1, 2]" and evaluation.json_text("no") == "no" and evaluation.json_text(None) is None


def test_counters_and_summary(spark):
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "trajectory_id string")
    made = spark.createDataFrame([("a", 5), ("b", 50)], "trajectory_id string, length int")
    r = evaluation.run_counters(ids("a", "a", "b", "c", "d"), ids("a", "b", "c", "z"), made, "length", 10).first()
    assert tuple(r) == (5, 4, 3, 2, 1, 1)
    assert evaluation.run_counters(ids(), ids(), made.limit(0), "length", 10).first().n_scanned == 0


def test_token_hook(spark, tmp_path):
    import base64

    vocabulary = [bytes([b]) for b in range(256)] + [b"ab"]
    (tmp_path / "v").write_text("\n".join(f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate(vocabulary)))
    rows = [("t", "i", "r", "submit", 1, "", [dict(role="user", content="abab c", tool_calls=None)])]
    stats = steps.trajectory_stats(spark.createDataFrame(rows, TRAJECTORIES), tokens=steps.tokenizer_total(str(tmp_path / "v"), r"\w+|\s+"))
    assert stats.first().total_tokens == 4


def test_plain_files_deliver_once(spark, tmp_path):
    """Rows delivered twice in different files count once, compared by hash and place; rows that differ both stay."""
    one = ("t1", "i", "r", "submit", 1, "", [dict(role="user", content="hello", tool_calls=None)])
    other = (*one[:6], [dict(role="user", content="hello!", tool_calls=None)])
    for rows in ([one, one], [one, other], [("t2", *one[1:])]):
        spark.createDataFrame(rows, TRAJECTORIES).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    got = tables.delivered_once(spark.read.parquet(str(tmp_path / "t")), "trajectory_id", "trajectory").collect()
    assert sorted((r.trajectory_id, r.trajectory[0].content) for r in got) == [("t1", "hello"), ("t1", "hello!"), ("t2", "hello")]


def test_latest_row_stands(spark):
    df = spark.createDataFrame([("TRJ-a", 1, 1), ("trj-a", 2, 5), ("trj-a", 2, 5), ('"trj-b"', 1, 7), (None, 1, 1)], "trajectory_id string, at int, v int")
    assert {(r.trajectory_id, r.v) for r in tables.latest(df, "trajectory_id", "at").collect()} == {("trj-a", 5), ("trj-b", 7)}


def test_utilisation_of_long_trajectories(spark):
    """Last use per keyword equals a search of all later actions."""
    rng = random.Random(2)
    words = [f"file{i}.py" for i in range(12)]
    t = []
    for _ in range(150):
        t.append(dict(role="assistant", content="", tool_calls=[{"function": {"name": "bash", "arguments": " ".join(rng.sample(words, 2))}}]))
        t.append(dict(role="tool", content=f"see {rng.choice(words)} and {rng.choice(words)}", tool_calls=None))
    r = steps.trajectory_stats(spark.createDataFrame([("t", "i", "r", "submit", 1, "", t)], TRAJECTORIES)).first()
    texts = [m["tool_calls"][0]["function"]["arguments"] for m in t[::2]]
    found = used = 0
    for k, m in enumerate(t[1::2]):
        for w in {w for w in words if w in m["content"].split()}:
            found += 1
            used += any(w in x for x in texts[k + 1 :])
    assert r.obs_utilization_ratio == pytest.approx(used / found)
