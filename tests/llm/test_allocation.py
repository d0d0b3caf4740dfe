"""Problems 2, 3, 4, 5, 6, 9 and 10: invariants, brute force and edge cases."""

import hashlib
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepforge.llm import capping, grouped_split, mixing, packing, sampling, splitting, toxicity
from stepforge.llm.queries import queries

T0 = datetime(2025, 1, 1)


def test_first_fit_decreasing():
    rng = random.Random(2)
    for _ in range(50):
        cap = rng.randrange(5, 30)
        sizes = np.array([rng.randrange(1, cap + 1) for _ in range(rng.randrange(1, 40))])
        bins = packing.first_fit_decreasing(sizes, cap)
        free, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):  # the plain form
            b = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
            free += [cap] * (b == len(free))
            free[b] -= sizes[i]
            want[i] = b
        assert [want[i] for i in range(len(sizes))] == bins.tolist()


def test_packing(spark):
    rng = random.Random(4)
    items = [("e", 100, f"t{i}", rng.choice([1, 30, 60, 100, 101, 350])) for i in range(300)]
    df = spark.createDataFrame(items, "experiment string, context_length long, trajectory_id string, total_tokens long")
    rows = packing.pack(df, group=50).collect()
    got: Counter = Counter()
    used: Counter = Counter()
    for r in rows:
        got[r.trajectory_id] += r.tokens
        used[r.bin] += r.tokens
    assert got == Counter({k: n for _, _, k, n in items}) and max(used.values()) <= 100
    assert all(r.piece == 0 for r in rows if dict((k, n) for _, _, k, n in items)[r.trajectory_id] <= 100)
    spans = {}
    for r in rows:
        spans.setdefault(r.bin, []).append((r.start, r.start + r.tokens))
    assert all(a[1] <= b[0] for s in spans.values() for a, b in zip(sorted(s), sorted(s)[1:]))
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.bins(packing.pack(df)).first().filled > 0.9


def test_experiment_items(spark):
    exp = spark.createDataFrame([(" e1", "S", 10), ("e1", "S", 10), ("e2", "S", None)], "name string, subset string, context_length int")
    split = spark.createDataFrame([("S", "TRJ-A"), ("S", "trj_a"), ("S", "b"), ("S", "gone"), (None, "c")], "subset_name string, trajectory_id string")
    stats = spark.createDataFrame([("trj-a", 5, T0), ("trj-a", 7, T0 + timedelta(1)), ("trj-b", 0, T0), ("trj-c", 3, T0)], "trajectory_id string, total_tokens long, ingested_at timestamp")
    assert [tuple(r) for r in packing.experiment_items(exp, split, stats).collect()] == [("e1", 10, "trj-a", 7)]


def test_capping_against_sort(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 6 + ["b", "c", None]), rng.choice([None, float("nan"), 0.5, 0.5, rng.random(), 1.5, -1.0]), f"t{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "repo string, composite_score double, trajectory_id string").withColumn("n", F.lit(1))

    for cap in (0, 1, 7, 60, 1000):
        got = {r.trajectory_id for r in capping.capped(df, "repo", "composite_score", "trajectory_id", F.lit(cap)).collect()}
        want = {t for r, _, t in rows if r is None}
        for repo in ("hot", "b", "c"):
            key = lambda x: (x[1] is None or x[1] != x[1], -(x[1] if x[1] is not None and x[1] == x[1] else 0), hashlib.md5(x[2].encode()).hexdigest())
            want |= {t for _, _, t in sorted((x for x in rows if x[0] == repo), key=key)[:cap]}
        assert got == want, cap
    assert capping.cap_count(df.limit(0), 3).count() == 0


def test_capping_of_a_contributor_without_scores(spark):
    """One contributor holds most rows, all of one level: no task ranks more than a small range of hashes."""
    rows = [("hot", None, f"t{i}") for i in range(20_000)] + [("hot", 0.5, f"s{i}") for i in range(30)] + [("cold", 0.1, "c"), (None, None, "n")]
    df = spark.createDataFrame(rows, "repo string, composite_score double, trajectory_id string")
    order = sorted((hashlib.md5(f"t{i}".encode()).hexdigest(), f"t{i}") for i in range(20_000))
    got = [r.trajectory_id for r in capping.cap_count(df, 5000).collect()]
    assert sorted(got) == sorted([t for _, t in order[: 5000 - 30]] + [f"s{i}" for i in range(30)] + ["c", "n"])
    level = capping._above(df.filter("repo = 'hot' AND composite_score IS NULL").selectExpr("repo AS __c", "trajectory_id", "substring(md5(trajectory_id), 1, 4) AS __d", "5000L AS __left"), ["__d"])
    assert level[0].count() + level[1].count() >= 5000 and level[1].count() < 50


def test_capping_report(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.choice(["a", "b", None]), rng.random(), f"t{i}") for i in range(400)], "repo string, composite_score double, trajectory_id string")
    assert max(r.n_after for r in capping.report(df, capping.cap_share(df, 0.05)).filter("repo IS NOT NULL").collect()) == 20


def test_sampling(spark):
    df = spark.createDataFrame([(f"trj-{i}", T0 + timedelta(hours=i)) for i in range(2000)] + [(None, None)], "trajectory_id string, ingested_at timestamp")
    ids = lambda d, rate=0.1: {r.trajectory_id for r in sampling.sampled_ids(d, rate).collect()}
    whole = ids(df)
    assert whole == ids(df.repartition(13)) and 150 < len(whole) < 250
    early = ids(df.filter(F.col("ingested_at") < T0 + timedelta(hours=700)))
    assert early <= whole <= ids(df, 0.2)
    assert ids(df, 0) == set() and len(ids(df, 1)) == 2000
    assert ids(df.withColumn("trajectory_id", F.upper("trajectory_id"))) == whole
    steps = [r.n_sampled for r in sampling.stability(df, 0.1).orderBy("at").collect()]
    assert steps == sorted(steps) and steps[-1] == len(whole)
    assert sampling.sampled_ids(df.limit(0), 0.5).count() == 0 == sampling.stability(df.limit(0), 0.5).count()
    with pytest.raises(ValueError):
        sampling.sample(df, "trajectory_id", 1.5)


def test_merge_keeps_the_strongest_boundaries():
    pieces = splitting.merge([4, 4, 4, 4], [9, 1, 5, 1], 8)
    assert pieces == [(0, 1), (2, 3)]
    assert splitting.merge([], [], 5) == [] and splitting.merge([5], [9], 5) == [(0, 0)]


def test_atoms():
    text = "aaaa\n\nbbbb\nbbbb\n\ncccc"
    got = splitting.atoms(100, [text], 60, 5)
    assert sum(n for n, _ in got) == 100 and max(n for n, _ in got) <= 60 and {s for _, s in got[1:]} == {2}
    assert splitting.atoms(10, [], 4, 5) == [(4, 5), (4, 0), (2, 0)]
    assert sum(n for n, _ in splitting.atoms(1000, ["x" * 50, "y\n" * 100], 7, 5)) == 1000


def test_splitting(spark):
    stats = spark.createDataFrame([("trj-a", 1000, T0), ("trj-b", 100, T0), ("trj-c", 500, T0), ("trj-d", None, T0), ("trj-e", 350, T0)], "trajectory_id string, total_tokens long, ingested_at timestamp").withColumn("n", F.lit(1))
    steps = [("trj-a", i, "bash" if i % 3 else "edit", "x", "line\n" * 20, n, T0) for i, n in enumerate([100, None, 400, 50, 50, 250])]
    steps += steps[:2] + [("trj-e", 0, "bash", None, None, 400, T0)]
    steps = spark.createDataFrame(steps, "trajectory_id string, step_idx int, tool string, action_text string, obs_text string, n_tokens long, ingested_at timestamp").withColumn("chunk", F.lit(7))
    message = "struct<role: string, content: string, tool_calls: array<struct<function: struct<name: string, arguments: string>>>>"
    traj = spark.createDataFrame([("trj-c", [dict(role="user", content="one\n\ntwo\n\nthree", tool_calls=None)]), ("trj-a", None)], f"trajectory_id string, trajectory array<{message}>")
    rows = splitting.split(stats, steps, traj, 200, 20).orderBy("trajectory_id", "piece").collect()
    by = {}
    for r in rows:
        by.setdefault(r.trajectory_id, []).append(r)
    assert set(by) == {"trj-a", "trj-c", "trj-e"}  # trj-b fits, trj-d's length isn't known
    for key, length in (("trj-a", 1000), ("trj-c", 500), ("trj-e", 400)):
        pieces = by[key]
        assert all(p.n_tokens == p.end_token - p.start_token <= 200 for p in pieces)
        assert pieces[0].start_token == 0 and pieces[0].cut == "start" and pieces[-1].end_token == length
        assert all(b.start_token + b.overlap == a.end_token and 0 < b.overlap <= 20 for a, b in zip(pieces, pieces[1:]))
    assert [p.cut for p in by["trj-c"]][1:] == ["paragraph"] * (len(by["trj-c"]) - 1) and all(p.first_step is None for p in by["trj-c"])
    assert splitting.split(stats.limit(0), steps, traj, 200, 20).count() == 0
    assert splitting.split(stats, steps.limit(0), traj.limit(0), 200, 20).count() > 0
    with pytest.raises(ValueError):
        splitting.split(stats, steps, traj, 20, 20)


def test_splitting_over_chunk_edges(spark, monkeypatch):
    """Pieces of a trajectory that several tasks take apart: nothing is cut because of a chunk."""
    rng = random.Random(12)
    sizes = {"trj-a": [rng.randrange(1, 30) for _ in range(70)], "trj-b": [2] * 90, "trj-c": [150] * 9, "trj-d": [rng.choice([1, 90]) for _ in range(33)]}
    stats = spark.createDataFrame([(k, sum(v) + 5, T0) for k, v in sizes.items()], "trajectory_id string, total_tokens long, ingested_at timestamp")
    tool = lambda i: "edit" if i % 11 == 0 else "bash"
    steps = spark.createDataFrame([(k, i, tool(i), "x", "y", n, T0) for k, v in sizes.items() for i, n in enumerate(v)], "trajectory_id string, step_idx int, tool string, action_text string, obs_text string, n_tokens long, ingested_at timestamp")
    traj = spark.createDataFrame([], "trajectory_id string, trajectory array<struct<role: string, content: string, tool_calls: array<struct<function: struct<name: string, arguments: string>>>>>")
    whole = splitting.split(stats, steps, traj, 100, 10).collect()
    monkeypatch.setattr(splitting, "CHUNK", 4)
    got = splitting.split_all(stats, steps, traj, {100: 10, 60: 0})
    assert got.filter("context_length = 60").agg(F.max("n_tokens")).first()[0] <= 60
    got = got.filter("context_length = 100").collect()
    for key, v in sizes.items():
        pieces = sorted((r for r in got if r.trajectory_id == key), key=lambda r: r.piece)
        assert all(p.n_tokens == p.end_token - p.start_token <= 100 for p in pieces)
        assert pieces[0].start_token == 0 and pieces[-1].end_token == sum(v) + 5
        assert all(b.start_token + b.overlap == a.end_token for a, b in zip(pieces, pieces[1:]))
        n = len([r for r in whole if r.trajectory_id == key])
        assert len(pieces) <= n * 1.25 + 1, (key, len(pieces), n)
    pieces = sorted((r for r in got if r.trajectory_id == "trj-b"), key=lambda r: r.piece)
    assert {p.cut for p in pieces[1:]} == {"step"} and len(pieces) <= 4  # a piece spans many chunks


def test_min_cost_flow():
    flow = grouped_split.min_cost_flow(4, [(0, 1, 3, 1), (0, 2, 2, 2), (1, 3, 2, 0), (2, 3, 3, 0), (1, 2, 5, 0)], 0, 3)
    assert flow[0] == 3 and flow[1] == 2 and flow[2] + flow[3] == 5


@pytest.mark.parametrize("by", ["repo", "instance"])
def test_grouped_split(spark, by):
    rng = random.Random(8)
    rows = [(f"trj-{i}", f"own/hot" if rng.random() < 0.33 else f"own/r{int(rng.paretovariate(0.5)) % 300}", None, rng.randrange(2)) for i in range(4000)]
    rows = [(t, r if rng.random() > 0.1 else r.upper() + ".git", r.replace("/", "__") + f"-{rng.randrange(3)}", s) for t, r, _, s in rows] + [("x", None, None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "trajectory_id string, repo string, instance_id string, resolved int").withColumns({"n": F.lit(1), "size": F.lit(2)})
    got = grouped_split.assign(df, by)
    again = {tuple(r) for r in grouped_split.assign(df.repartition(7), by).collect()}
    assert {tuple(r) for r in got.collect()} == again and got.count() == len(rows)
    assert got.groupBy("entity").agg(F.count_distinct("split").alias("k")).filter("k > 1").count() == 0
    shares = {r.split: r.share for r in grouped_split.report(got).collect()}
    assert abs(shares["train"] - 0.8) < 0.02 and abs(shares["test"] - 0.1) < 0.02
    assert grouped_split.assign(df.limit(0), by).count() == 0
    with pytest.raises(ValueError):
        grouped_split.assign(df, "author")


def test_apportion():
    assert mixing.apportion([0.5, 0.3, 0.2], 10, [10, 10, 10]) == [5, 3, 2]
    assert mixing.apportion([0.5, 0.5], 10, [2, 100]) == [2, 8]
    assert mixing.apportion([1.0], 10, [3]) == [3] and mixing.apportion([], 5, []) == []

    def plain(w, seats, most):
        got = [0] * len(w)
        for _ in range(seats):
            open_ = [i for i in range(len(w)) if got[i] < most[i]]
            if not open_:
                break
            got[max(open_, key=lambda i: (w[i] / (2 * got[i] + 1), -i))] += 1
        return got

    rng = random.Random(9)
    for _ in range(100):
        w = [rng.random() for _ in range(4)]
        w = [x / sum(w) for x in w]
        assert mixing.apportion(w, 30, [99] * 4) == plain(w, 30, [99] * 4)


def test_mixing(spark):
    docs = [(i, f"text number {i} of some words " * (1 + i % 5), ["big", "BIG", "small", "none", None][i % 5]) for i in range(400)]
    docs += [(1000 + i, docs[0][1], "big") for i in range(50)] + [(2000, None, "big"), (2001, "", "big")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"n_tokens": F.lit(5), "key": F.lit("k"), "h": F.lit(1)})
    targets = spark.createDataFrame([("big", 0.7, 2), ("small", 0.3, 3), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    rows = mixing.mix(docs, targets).collect()
    assert {r.source for r in rows} == {"big", "small"} and max(r.copies for r in rows if r.source == "small") <= 3 and max(r.copies for r in rows if r.source == "big") <= 2
    assert not {r.doc_id for r in rows} & set(range(1000, 2002))  # repeated, NULL and empty texts
    shares = {r.source: r.share for r in mixing.shares(mixing.mix(docs, targets), targets).collect()}
    assert abs(shares["big"] - 0.7) < 0.02 and shares["absent"] == 0
    assert {tuple(r) for r in rows} == {tuple(r) for r in mixing.mix(docs.repartition(5), targets).collect()}
    assert mixing.mix(docs.limit(0), targets).count() == mixing.mix(docs, targets.limit(0)).count() == 0


def test_reading_disguises():
    r = toxicity.Reader(["you", "are", "useles", "coming", "idiot", "filthy"])
    flat = lambda t: [w for p in r.passages(t) for w in p]
    assert flat("y o u c o m i n g") == ["you", "coming"]
    assert flat("You are u5e1e55") == ["you", "are", "useles"]
    assert flat("an i*iot, f*lthy") == ["an", "idiot", "filthy"]
    assert flat("YOUUUU аre") == ["you", "are"]
    assert flat("") == [] and flat("`a_b` 12 SparseView") == ["<id>", "<n>", "<id>"]


def test_detector(spark):
    rng = random.Random(10)
    nouns, verbs = ["queue", "parser", "cache", "writer", "socket"], ["drops", "keeps", "reads", "sorts", "loads"]
    calm = lambda: f"The {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} before the {rng.choice(nouns)} starts."
    rude = lambda: f"You are a {rng.choice(['worthless', 'pathetic', 'stupid'])} {rng.choice(['clown', 'toad', 'worm'])} and nobody wants you here."
    docs, labels = [], []
    for i in range(400):
        bad = i % (5 if i < 250 else 15) == 0
        body = [calm() for _ in range(6)] + ([rude()] if bad else [])
        rng.shuffle(body)
        docs.append((i, " ".join(body), "Agent Log" if i % 2 else "agent_log"))
        if i < 250:
            labels.append((i, "r1", int(bad) if rng.random() > 0.03 else 1 - int(bad), T0))
    docs += [(1000, None, None), (1001, "", None), (1002, "You are a w0rthle55 t.o.a.d and nobody wants you here.", "x"), (1003, "word " * 60_000, "x")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame(labels + labels[:5] + [(3, "r2", None, T0), (None, "r1", 1, T0)], "doc_id long, reviewer string, toxic int, reviewed_at timestamp").withColumn("text", F.lit("clash"))
    scored = {r.doc_id: r for r in toxicity.scores(docs, toxicity.fit(docs, labels)).collect()}
    held_out = [(scored[i].abusive, i % 15 == 0) for i in range(250, 400)]
    assert sum(a == b for a, b in held_out) >= 0.97 * len(held_out)
    assert not scored[1000].abusive and scored[1001].score == 0 and scored[1002].abusive and not scored[1003].abusive
    rates = {r.source: r.n_documents for r in toxicity.rates(toxicity.scores(docs, toxicity.fit(docs, labels))).collect()}
    assert rates == {"agent_log": 400, "x": 2, None: 2}
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.scores(docs, none).filter("abusive").count() == 0
    assert toxicity.scores(docs.limit(0), none).count() == 0


def test_queries_run(spark, data):
    for name in ("p1_found", "p7_found", "p8_found", "p10_found"):
        assert queries()[name](spark, data).columns == {"p1_found": ["row_a", "row_b"], "p7_found": ["trajectory_id", "first_step", "last_step"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}[name]
    for name in ("p2_bins", "p3_report", "p4_sample", "p5_report", "p6_report", "p9_shares"):
        assert queries()[name](spark, data).count() > 0
