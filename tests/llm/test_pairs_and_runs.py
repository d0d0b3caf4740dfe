"""Problems 1, 7 and 8 against brute force, and their edge cases."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepforge.functions.fold import words
from stepforge.llm import leakage, overlap, runs

STEPS = "trajectory_id string, step_idx int, action_text string, started_at timestamp, ended_at timestamp, ingested_at timestamp"
T0 = datetime(2025, 1, 1)


def steps_table(spark, seqs, **extra):
    rows = [(k, i, a, T0 + timedelta(seconds=10 * i), T0 + timedelta(seconds=10 * i + 5), T0) for k, seq in seqs.items() for i, a in enumerate(seq)]
    df = spark.createDataFrame(rows, STEPS)
    return df.withColumns({c: F.lit(v) for c, v in extra.items()})


def bash(x):
    return None if x is None else 'execute_bash {"command": "%s"}' % x


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        assert overlap.common_subsequence(np.array(a, np.int64), np.array(b, np.int64)) == lcs(a, b)


def test_overlap_is_exact(spark):
    rng = random.Random(7)
    base = [[bash(f"c{rng.randrange(30)}") for _ in range(rng.randrange(1, 14))] for _ in range(12)]
    seqs = {}
    for i in range(40):
        s = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            s[rng.randrange(len(s))] = bash(f"n{rng.randrange(50)}")
        seqs[f"trj-{i}"] = s
    rows = [(i, "train" if i % 2 else "gold", f"trj-{i}", "S" if i % 2 else None) for i in range(40)]
    split = spark.createDataFrame(rows, "row_id long, split string, trajectory_id string, subset_name string").withColumns({"instance_id": F.lit(None).cast("string"), "key": F.lit("clash"), "steps": F.lit(1)})
    got = {(r.row_a, r.row_b) for r in overlap.overlaps(split, steps_table(spark, seqs, key="x", n=1)).collect()}
    want = {(min(i, j), max(i, j)) for i in range(0, 40, 2) for j in range(1, 40, 2) if lcs(seqs[f"trj-{i}"], seqs[f"trj-{j}"]) >= 0.6 * max(len(seqs[f"trj-{i}"]), len(seqs[f"trj-{j}"]))}
    assert got == want and want


def test_overlap_by_id_and_edges(spark):
    rows = [(1, "train", "trj-a", "S"), (2, "gold", ' "TRJ_A" ', None), (2, "gold", "a.json", None), (3, "low_q", "trj-b", None), (4, "gold", None, None), (None, "gold", "trj-a", None), (5, "train", "trj-a", "U")]
    split = spark.createDataFrame(rows, "row_id long, split string, trajectory_id string, subset_name string").withColumn("instance_id", F.lit(None).cast("string"))
    empty = steps_table(spark, {"trj-a": [bash("x")]}).limit(0)
    found = overlap.overlaps(split, empty)
    assert {(r.row_a, r.row_b, r.kind) for r in found.collect()} == {(1, 2, "id"), (2, 5, "id")}
    stats = spark.createDataFrame([("a", "o/n"), (None, None)], "trajectory_id string, repo string")
    assert {(r.eval_split, r.subset_name, r.repo, r.n_pairs) for r in overlap.report(found, stats).collect()} == {("gold", "S", "o/n", 1), ("gold", "U", "o/n", 1)}
    assert overlap.overlaps(split.limit(0), empty).count() == 0
    none = steps_table(spark, {"trj-a": [None] * 5, "trj-b": [None] * 5})
    assert {(r.row_a, r.row_b) for r in overlap.overlaps(split, none).collect()} == {(1, 2), (2, 5)}  # steps without text agree with nothing


def brute_runs(seqs):
    out = set()
    for k, seq in seqs.items():
        i = 0
        while i < len(seq):
            j = i
            while j + 1 < len(seq) and seq[i] is not None and seq[j + 1] == seq[i]:
                j += 1
            if j > i:
                out.add((k, i, j))
            i = j + 1
    return out


@pytest.mark.parametrize("chunk", [2, 3, 1024])
def test_runs_across_chunks(spark, monkeypatch, chunk):
    import importlib

    # The chunk size travels with the function's module, so workers must see the same one.
    monkeypatch.setattr(runs, "CHUNK", chunk)
    rng = random.Random(3)
    seqs = {f"t{i}": [bash(rng.choice("aab")) if rng.random() > 0.05 else None for _ in range(rng.randrange(1, 25))] for i in range(12)} | {"long": [bash("z")] * 23}
    df = steps_table(spark, seqs, chunk=9, sig=1)
    df = df.unionByName(df.withColumn("ingested_at", F.col("ingested_at") + F.expr("interval 3 days")).limit(40))
    if chunk != 1024:
        # Python workers import the module afresh; run the piece function here instead.
        import pyarrow as pa

        actions = runs.signed_steps(df).withColumn("chunk", F.floor(F.col("step_idx") / chunk))
        homes = F.when(F.pmod("step_idx", F.lit(chunk)) == chunk - 1, F.array("chunk", F.col("chunk") + 1)).otherwise(F.array("chunk"))
        chunks = actions.withColumn("chunk", F.explode(homes)).groupBy("trajectory_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("step_idx", "signature", "started_us", "ended_us"))).alias("steps"))
        pieces = pa.Table.from_batches(list(runs._pieces(chunks.toArrow().to_batches()))).to_pylist()
        got, open_run = set(), None
        for p in sorted(pieces, key=lambda p: (p["trajectory_id"], p["first_step"])):
            if p["open_left"]:
                open_run = (open_run[0], open_run[1], p["last_step"])
            else:
                if open_run and open_run[2] > open_run[1]:
                    got.add(open_run)
                open_run = (p["trajectory_id"], p["first_step"], p["last_step"])
        if open_run[2] > open_run[1]:
            got.add(open_run)
        assert got == brute_runs(seqs)
    else:
        importlib.reload(runs)
        rows = runs.runs(df).collect()
        assert {(r.trajectory_id, r.first_step, r.last_step) for r in rows} == brute_runs(seqs)
        long = next(r for r in rows if r.trajectory_id == "long")
        assert long.n_actions == 23 and long.duration_s == 225
        assert runs.collapsed(df).agg(F.sum("n_actions")).first()[0] == sum(map(len, seqs.values()))


def test_runs_edges(spark):
    df = steps_table(spark, {"t": [bash("a")] * 3})
    gap = df.filter("step_idx <> 1").withColumns({"ended_at": F.lit(None).cast("timestamp"), "started_at": F.lit(None).cast("timestamp")})
    assert runs.runs(gap).count() == 0
    assert runs.runs(df.limit(0)).count() == 0
    nameless = df.withColumn("trajectory_id", F.lit(None).cast("string"))
    assert runs.runs(nameless).count() == 0
    timeless = df.withColumns({"ended_at": F.lit(None).cast("timestamp"), "started_at": F.lit(None).cast("timestamp")})
    r = runs.runs(timeless).first()
    assert r.n_actions == 3 and r.duration_s is None


def test_suffix_order():
    rng = random.Random(5)
    depth = 7
    tokens = np.array([rng.randrange(4) for _ in range(300)] + [0] * depth, np.int32)
    order = leakage.suffix_order(tokens, depth)
    keys = [tuple(tokens[i : i + depth].tolist()) for i in order]
    keys = [k[: k.index(0)] if 0 in k else k for k in keys]  # texts end at a 0
    assert keys == sorted(keys) and set(order) == set(np.flatnonzero(tokens))
    query = np.array([[1, 2, 3], [2, 2, 0], [3, 0, 0]], np.int32)
    length = np.array([3, 2, 1])
    lo, hi = (leakage._bound(tokens, order, query, length, upper) for upper in (False, True))
    for q, n, a, b in zip(query.tolist(), length.tolist(), lo.tolist(), hi.tolist()):
        assert set(order[a:b].tolist()) == {i for i in range(300) if tokens[i : i + n].tolist() == q[:n]}


def test_longest_match():
    rng = random.Random(6)
    for _ in range(50):
        doc, item = ([rng.randrange(5) for _ in range(n)] for n in (60, 25))
        n, i, j = leakage.longest_match(doc, item)
        assert doc[i : i + n] == item[j : j + n] and 0 not in doc[i : i + n]
        grams = lambda x, k: {tuple(x[a : a + k]) for a in range(len(x) - k + 1) if 0 not in x[a : a + k]}
        assert not grams(doc, n + 1) & grams(item, n + 1)
    assert leakage.longest_match([0, 0], [0, 0]) == (0, 0, 0)


ITEM = "The reviewer of own/name asked for a masked stream under heavy load. Run 16fa0ad2 used tool finish 195 times before the metric appeared. Closing the stale lattice early saved 24 megabytes on the host."
STOCK = "Tell us in a few lines which step you took and which result you had hoped for."


def leak_docs(spark, texts):
    filler = [f"Document {i} speaks of matter {i * 7} and of nothing else in particular. {STOCK}" for i in range(300)]
    rows = [(i, t) for i, t in enumerate([*texts, *filler])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit(5), "source": F.lit("x")})
    items = spark.createDataFrame([(1, "gold", ITEM + " " + STOCK), (2, "gold", STOCK), (3, "low_q", None), (4, "low_q", STOCK)], "item_id long, eval_set string, text string")
    return docs, items


def test_leaks(spark):
    first, second, third = (s + "." for s in ITEM.rstrip(".").split(". "))
    docs, items = leak_docs(
        spark,
        [
            f"Intro. {third}\n\n{first.upper()}",  # other order, layout and case
            f"{second.replace('finish', 'just finish')} {third.replace('early ', '')}",  # altered
            f"&nbsp;{first.replace(' ', '&nbsp;')} <b>{second}</b>",  # mark-up
            second,  # a single sentence
            STOCK,  # a stock phrase
            "The reviewer of other/repo asked for a hidden vector in strict mode. Run 99aa00bb used tool think 7 times before the label appeared.",  # the same moulds
            None,
            "",
            f"{first} {second} " + "padding word " * 30_000,  # very long
            f"{first} {second}",
            f"{first} {second}",  # repeated
        ],
    )
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()}
    assert got == {(d, 1) for d in (0, 1, 2, 8, 9, 10)}
    found = leakage.leaks(docs, items)
    assert leakage.without_leaks(docs, found).count() == docs.count() - 6
    assert {(r.item_id, r.n_documents) for r in leakage.item_report(items, found).collect()} == {(1, 6), (2, 0), (3, 0), (4, 0)}
    assert leakage.leaks(docs.limit(0), items).count() == leakage.leaks(docs, items.limit(0)).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    first, second, _ = (s + "." for s in ITEM.rstrip(".").split(". "))
    docs, items = leak_docs(spark, [f"{first} {second}"])
    whole = leakage.leaks(docs, items).collect()
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 100)
    assert {(r.doc_id, r.item_id) for r in whole} == {(0, 1)}
    assert sorted(leakage.leaks(docs, items).collect()) == sorted(whole)  # figures, too, don't depend on the blocks
    assert (whole[0].longest_match, whole[0].doc_word, whole[0].item_word) == (len(words(first + " " + second)), 0, 0)


def test_match_longer_than_a_sentence(spark):
    """A verbatim match runs on over sentence ends and is as long as it is."""
    text = ". ".join(" ".join(f"word{k}x{j}" for j in range(12)) for k in range(9)) + "."
    docs, items = leak_docs(spark, ["Some other words first. " + text])
    items = items.unionByName(spark.createDataFrame([(9, "gold", text)], items.schema))
    got = {(r.doc_id, r.item_id): r for r in leakage.leaks(docs, items).collect()}
    assert (got[0, 9].longest_match, got[0, 9].doc_word, got[0, 9].item_word) == (108, 4, 0)


def test_stock_sentences_are_listed(spark):
    """A sentence that very many texts repeat on its own is set aside, and listed with its count."""
    alone = "Every archived shard prints its own heading before the first reading"
    docs = spark.createDataFrame([(i, f"Text {i} has matter {i * 3}. {alone}. It goes on with matter {i * 5}.") for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(1, f"{alone}. Nobody kept the yellow receipts of the second winter.")], "item_id long, text string")
    assert [(r.item_id, r.sentence, r.n_texts) for r in leakage.stock_sentences(docs, items).collect()] == [(1, alone.lower(), 40)]
    assert leakage.stock_sentences(docs, items.limit(0)).count() == 0
