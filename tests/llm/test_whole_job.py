"""Cases of the review: the operators do the whole job."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from stepforge.llm import grouped_split, leakage, mixing, overlap, splitting, toxicity
from stepforge.llm.queries import queries
from stepforge.sources import table


def test_joined_words_are_read():
    r = toxicity.Reader(["shut", "up", "you", "useles", "idiot", "go", "hang", "yourself", "tonight", "cache", "test", "limit"], ["cache", "test", "limit"])
    flat = lambda t: [w for p in r.passages(t) for w in p]
    assert flat("shut_up_you_useless_idiot") == ["shut", "up", "you", "useles", "idiot"]
    assert flat("go_hang_yourself_tonight") == ["go", "hang", "yourself", "tonight"]
    assert flat("ShutUpYouIdiot") == ["shut", "up", "you", "idiot"]
    assert flat("shut_up_y0u_1d10t")[-2:] == ["you", "idiot"]
    assert flat("the test_cache_limit and CacheLimit") == ["the", "<id>", "and", "<id>"]
    assert toxicity.Reader().passages("the shut_up_you") == [["the", "<id>"]]


def test_copies_of_a_leak_are_no_stock_phrase(spark):
    first = "the scheduler keeps seven stale tokens beside every frozen ledger"
    second = "nobody noticed that the purple adapter rewrites each receipt twice"
    stock = "please attach the complete output before you open this ticket"
    items = spark.createDataFrame([(1, f"{first}. {second}. {stock}.")], "item_id long, text string")
    docs = [(i, f"case {'x' * (i % 3)} says {first}. {second}." + " !" * i) for i in range(40)]
    docs += [(100 + i, f"word{i} other{i * 7} reads file{i}. {stock}. thing{i} stays{i}.") for i in range(80)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r.n_sentences for r in leakage.leaks(docs, items).collect()}
    assert found == dict.fromkeys(range(40), 2)


def test_copies_of_abuse_are_no_background(spark):
    calm = [f"The parser reads part {i} of the cache before the writer starts. The queue drops nothing here." for i in range(60)]
    rude = [f"The parser reads part {i} of the cache. You are a {w} clown and nobody wants you here." for i in range(8) for w in ("worthless", "stupid", "pathetic")]
    abuse = "You are a worthless toad and nobody wants you here."
    copies = [f"The writer sorts the part before the cache loads. {abuse}"] * 40
    texts = calm + rude + copies
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, "r", int(i >= 60)) for i in range(84)], "doc_id long, reviewer string, toxic int").withColumn("reviewed_at", F.lit(None).cast("timestamp"))
    found = toxicity.stock_phrases(docs).collect()
    shown = toxicity.stock_phrases(docs).filter("s IS NOT NULL").select("s", "n", F.explode("places").alias("doc_id")).join(docs, "doc_id")
    phrases = {(r.p.rstrip("."), r.n) for r in shown.select(toxicity.phrase().alias("p"), "n").collect()}
    assert ("The queue drops nothing here", 60) in phrases and ("You are a stupid clown and nobody wants you here", 8) in phrases
    assert any(p.startswith("The parser reads part 3 of") for p, _ in phrases)  # numbers may differ
    assert not any("toad" in p or "The writer sorts" in p for p, _ in phrases)  # copies are one text
    assert {(r.n, r.n_texts) for r in found if r.s is None} == {(85, 85)}
    d = toxicity.fit(docs, labels)
    assert d.judge().scores([abuse])[0][0] > d.threshold
    words = toxicity.Vocabulary(d.words)
    assert not {words.number.get(w) for w in ("toad", "clown")} & set((d.ordinary.codes % words.size).tolist())


def test_best_spans_against_a_plain_scan():
    rng = np.random.default_rng(4)
    ptr = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 60))])
    ratios = rng.integers(-3, 4, ptr[-1]) * toxicity.UNITS
    scorer = toxicity.Scorer(toxicity.Counts(), toxicity.Counts(), 3)
    score, begin, end = scorer.best_spans(ratios, ptr)
    for k, (a, b) in enumerate(zip(ptr.tolist(), ptr[1:].tolist())):
        sums = {(i, j): int(ratios[i:j].sum()) for i in range(a, b + 1) for j in range(i, b + 1)}
        assert sums[begin[k], end[k]] == max(sums.values())
        n = end[k] - begin[k]
        assert score[k] == (0 if n < toxicity.FEWEST_WORDS else max(sums.values()) / toxicity.UNITS / (n + toxicity.SHORT))


def test_kneser_ney_sums_to_one():
    words = toxicity.Vocabulary("abcde")
    rng = np.random.default_rng(5)
    text = rng.integers(1, 5, 400)
    codes = words.trigrams(text, np.arange(400) % 8)
    abusive, ordinary = (toxicity.Counts.of(c, np.ones(len(c)), 25) for c in (codes[:200], codes[200:]))
    scorer = toxicity.Scorer(abusive, ordinary, words.size)
    for a, b in ((0, 0), (0, 2), (1, 3), (4, 4)):
        kinds = (a * words.size + b) * words.size + np.flatnonzero(np.append(np.bincount(codes % words.size) > 0, True))
        assert abs(scorer.abusive.probability(kinds).sum() - 1) < 0.02
    assert scorer.abusive.counts.plus(ordinary).plus(ordinary, -1).n.tolist() == abusive.n.tolist()


def test_a_worker_keeps_detectors_apart(spark):
    """Two detectors used one after the other in the same workers score with their own models."""
    calm = [(toxicity.tokens(f"The parser reads part {i} of the cache before the writer starts."), 0) for i in range(40)]
    rude = [(toxicity.tokens(f"You are a stupid clown number {i} and nobody wants you here."), 1) for i in range(20)]
    docs = spark.createDataFrame([(1, "You are a stupid clown and nobody wants you here.", "x")], "doc_id long, text string, source string")
    trained, empty = toxicity.train(calm + rude), toxicity.train(calm)
    for _ in range(2):
        assert toxicity.scores(docs, trained).first().abusive and not toxicity.scores(docs, empty).first().abusive


def test_every_context_length_is_split(spark, data):
    lengths = {r[0] for r in table(spark, data, "experiments").filter("context_length > 0").select("context_length").distinct().collect()}
    stats = table(spark, data, "stats")
    want = {n: k for n in lengths if (k := splitting.oversized(stats, n).count())}
    rows = queries()["p5_split"](spark, data).groupBy("context_length").agg(F.count_distinct("trajectory_id").alias("k"), F.max("n_tokens").alias("most")).collect()
    assert len(want) > 1 and {r.context_length: r.k for r in rows} == want
    assert all(r.most <= r.context_length for r in rows)


def test_bootstrap_queries_resample_in_full(spark, data, monkeypatch):
    from stepforge.operators import statistics
    from stepforge.plans import core

    seen = []
    for name in ("bootstrap_mean", "bootstrap_band"):
        monkeypatch.setattr(statistics, name, lambda *a, **k: seen.append(k.get("rounds", statistics.LIMITS.bootstrap_rounds)))
        core.queries()[name](spark, data)
    assert seen == [2000, 2000]


def test_a_source_that_falls_short_leaves_the_others_their_shares(spark):
    docs = spark.createDataFrame([(i, f"text number {i} of some plain words", "big") for i in range(300)] + [(1000 + i, f"short text {i}", "Small One") for i in range(4)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small_one", 0.4, 1), ("small one", 0.9, 5), ("absent", 0.1, 1)], "source string, target_share double, max_repeats int")
    assert {tuple(r) for r in mixing.distinct_targets(targets).collect()} == {tuple(r) for r in mixing.distinct_targets(targets.repartition(3)).collect()}
    plain = targets.filter("source <> 'small one'")
    shares = {r.source: r for r in mixing.shares(mixing.mix(docs, plain, total_tokens=2000), plain).collect()}
    assert abs(shares["big"].tokens - 1000) < 20  # half of what was wanted, though the others lack most of theirs
    assert 0 < shares["small_one"].tokens < 40 and shares["absent"].tokens == 0 and shares["absent"].off_target == -0.1


def test_long_texts_are_counted_whole(spark):
    text = "word " * 30_000 + "x" * 200_000
    docs = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    assert mixing.token_counts(docs).first().n_tokens == len(mixing._encoding(mixing.TOKENIZER).encode_ordinary(text))


def test_grouped_split_near_the_best_allocation():
    """Large components go through the flow: the deviation is close to the least that any placement has."""
    rng = random.Random(8)
    for _ in range(20):
        sizes = [rng.randrange(1, 60) for _ in range(7)]
        shares = [0.6, 0.2, 0.2]
        total = sum(sizes)
        off = lambda where: sum(abs(sum(s for s, w in zip(sizes, where) if w == k) - total * shares[k]) for k in range(3))
        best = min(off(w) for w in itertools.product(range(3), repeat=len(sizes)))
        _, placed = grouped_split.allocate({}, [(f"e{i}", s, 0) for i, s in enumerate(sizes)], shares)
        assert off([placed[f"e{i}"] for i in range(len(sizes))]) <= best + 0.35 * total
    bundles = {(3, 0): (100, 300), (5, 1): (40, 200), (1, 0): (77, 77)}
    counts, placed = grouped_split.allocate(bundles, [("big", 150, 0), ("other", 60, 1)], [0.8, 0.1, 0.1])
    rows = [sum(n[k] * size for (size, _), n in counts.items()) + sum(r for name, r, _ in (("big", 150, 0), ("other", 60, 1)) if placed[name] == k) for k in range(3)]
    assert [sum(n) for n in counts.values()] == [bundles[b][0] for b in counts] and all(abs(r - 787 * s) <= 5 for r, s in zip(rows, [0.8, 0.1, 0.1]))


def test_hot_shingles_give_the_same_pairs(spark, monkeypatch):
    """Half of the sequences share their commonest calls; spreading them over tasks changes no result."""
    rng = random.Random(9)
    common = list(range(8))
    rows = []
    for i in range(120):
        own = [1000 * (i % 50) + j for j in range(6)]
        steps = common + own if i % 2 else own + [rng.randrange(10_000, 20_000) for _ in range(3)]
        rows.append((i, steps, i % 3 == 0, i % 3 != 0))
    classes = spark.createDataFrame(rows, "class long, steps array<long>, in_eval boolean, in_train boolean")
    plain = {(r.eval_class, r.train_class) for r in overlap.near_classes(classes).collect()}
    monkeypatch.setattr(overlap, "HOT", 10)
    monkeypatch.setattr(overlap, "PROBES", 5)
    spread = {(r.eval_class, r.train_class) for r in overlap.near_classes(classes).collect()}
    brute = {
        (a, b) for a, x, e, _ in rows for b, y, _, t in rows
        if e and t and a != b and overlap.common_subsequence(np.array(x), np.array(y)) >= 0.6 * max(len(x), len(y)) - 1e-9
    }
    assert plain == spread == brute and brute


def test_found_queries_give_rows(spark, data):
    """Every pN_found runs and finds something on the smallest tables, and its columns are those asked for."""
    want = {"p1_found": ["row_a", "row_b"], "p7_found": ["trajectory_id", "first_step", "last_step"], "p8_found": ["doc_id", "item_id"]}
    for name, columns in want.items():
        found = queries()[name](spark, data)
        assert found.columns == columns and found.count() > 0 and found.distinct().count() == found.count()
    first = queries()["p1_found"](spark, data)
    assert first.filter("row_a >= row_b").count() == 0


def test_classes_hold_what_pairs_hold(spark, data):
    """Membership and class pairs expand to the found pairs, and are no larger than the rows where copies abound."""
    rows, steps = table(spark, data, "split_rows"), table(spark, data, "steps")
    members, pairs = overlap.classified(rows, steps)
    ev = members.filter("NOT is_train").select(F.col("class").alias("eval_class"), F.col("row_id").alias("e"))
    tr = members.filter("is_train").select(F.col("class").alias("train_class"), F.col("row_id").alias("t"))
    wide = pairs.join(ev, "eval_class").join(tr, "train_class").filter("e <> t").select(F.least("e", "t").alias("row_a"), F.greatest("e", "t").alias("row_b")).distinct()
    found = queries()["p1_found"](spark, data)
    assert {tuple(r) for r in wide.collect()} == {tuple(r) for r in found.collect()}
    many = rows.limit(0).unionByName(spark.createDataFrame([(i, "train" if i % 2 else "gold", "S", "trj-x", None, None) for i in range(400)], rows.schema))
    members, pairs = overlap.classified(many, steps.limit(0))
    assert members.count() == 400 and pairs.count() == 1
