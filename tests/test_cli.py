"""The command line, from raw trajectories to a report, on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from stepforge import cli
from stepforge.sources import readers


@pytest.fixture(scope="module")
def run(spark):
    def of(*argv):
        a = cli.parser().parse_args([str(x) for x in argv])
        a.run(spark, a)

    return of


@pytest.fixture(scope="module")
def out(run, data, tmp_path_factory):
    out = tmp_path_factory.mktemp("cli")
    run("score", "--trajectories", f"{data}/trajectories.parquet", "--out", out / "scores", "--export-splits")
    run("subset", "--scores", out / "scores", "--out", out / "subsets")
    return out


def test_score_and_resume(spark, run, data, out):
    n = spark.read.parquet(str(out / "scores/stats")).count()
    run("score", "--trajectories", f"{data}/trajectories.parquet", "--out", out / "scores", "--resume", "--skip-summary")
    assert spark.read.parquet(str(out / "scores/stats")).count() == n > 0
    assert spark.read.parquet(str(out / "scores/splits")).select("subset_name").distinct().count() == 16


def test_subsets_and_publishing(spark, run, out, capsys):
    assert len(readers.discover_subsets(str(out / "subsets"))) == 16
    run("subset", "--list")
    run("publish", "--subsets", out / "subsets", "--out", out / "published", "--only", "TopQ-500", "--dry-run")
    printed = capsys.readouterr().out
    assert "B2Only-Top500" in printed and "26 columns" in printed and not (out / "published").exists()
    run("publish", "--subsets", out / "subsets", "--out", out / "published", "--only", "TopQ-500")
    assert "composite_Q" in spark.read.parquet(str(out / "published/TopQ-500")).columns
    assert "| TopQ-500 |" in "\n".join(r.value for r in spark.read.text(str(out / "published/_card")).collect())


def test_prepare(spark, run, data, out, capsys):
    for _ in range(2):  # the second finds the examples there
        run("prepare", "--trajectories", f"{data}/trajectories.parquet", "--subsets", out / "subsets", "--subset", "Random-500", "--out", out / "examples", "--max-seq-len", 2000)
    assert "labelled_pct" in capsys.readouterr().out
    assert spark.read.parquet(str(out / "examples/Random-500")).agg(F.max(F.size("input_ids"))).first()[0] <= 2000


def test_test_sets(spark, run, data, out):
    run("test-sets", "--trajectories", f"{data}/trajectories.parquet", "--training", f"{data}/split_rows.parquet", "--scores-table", out / "scores/stats", "--out", out / "tests", "--size", 5)
    ids = spark.read.parquet(str(out / "tests/ids"))
    assert ids.groupBy("split").count().count() == 3 and spark.read.json(str(out / "tests/rows")).count() == ids.count()


def test_losses_actions_and_report(spark, run, data, out):
    rows = [(m, s, f"t{i}", 0.5 + 0.1 * i + (m == "base"), 10) for m in ("base", "x") for s in ("gold", "random", "low_q") for i in range(8)]
    spark.createDataFrame(rows, "model string, split string, trajectory_id string, loss double, n_tokens long").write.parquet(str(out / "losses"))
    for _ in range(2):
        run("perplexity", "--losses", out / "losses", "--out", out / "loss")
    assert spark.read.parquet(str(out / "loss/summary")).count() == 6
    pairs = [("x", "gold", f"t{i}", k, "<tool_call>a/b.py</tool_call>", "plain" if i else None) for i in range(4) for k in (3, 5)]
    spark.createDataFrame(pairs, "model string, split string, trajectory_id string, n_steps int, generated string, truth string").write.parquet(str(out / "generated"))
    run("next-action", "--generated", out / "generated", "--out", out / "next", "--truncate-steps", 3)
    run("first-action", "--generated", out / "generated", "--out", out / "first", "--num-samples", 2)
    assert spark.read.option("header", True).csv(str(out / "next")).first().n_skipped == "1"
    run("analyse", "--results", out / "losses", "--out", out / "report", "--reference", "base", "--hypotheses", '{"H1": ["x", "base", "less"]}')
    text = "\n".join(r.value for r in spark.read.text(str(out / "report")).collect())
    assert "| H1 | x | base | less |" in text and "Evaluation report" in text


def test_experiments(run, data, capsys):
    run("experiments", 1, 3, "--experiments", f"{data}/experiments.parquet")
    assert [line.split("\t")[0] for line in capsys.readouterr().out.splitlines()] == ["exp1", "exp2", "exp3"]
