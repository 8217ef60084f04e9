"""Ancestors by lines of commits: random histories against plain walks, whatever the stretches, and what is moved for them."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import attribution, authorship, chains, content
from fleetlens.plans import derived


def histories(spark, seed, stretches, n=160):
    """A forest with side branches, a parent that isn't on record, and commits dealt to stretches by time, all together or anyhow."""
    r = random.Random(seed)
    parent = {f"c{i}": f"c{r.randint(max(0, i - 3), i - 1)}" if i and r.random() < 0.97 else None for i in range(n)} | {"lost": "unknown"}
    by = {"time": lambda i: i // 20, "one": lambda i: 0, "any": lambda i: r.randrange(9)}[stretches]
    rows = [(c, p, by(i)) for i, (c, p) in enumerate(parent.items())]
    return parent, spark.createDataFrame(rows, "id string, parent string, stretch int")


def above(parent, c, depth):
    out = []
    while parent.get(c) is not None and len(out) < depth:
        c = parent[c]
        out.append(c)
    return out


@pytest.mark.parametrize("stretches, depth", [("time", 1), ("time", 37), ("one", 37), ("any", 5)])
def test_lines_give_all_ancestors(spark, stretches, depth):
    parent, rows = histories(spark, depth, stretches)
    got = [tuple(x) for x in attribution.ancestor_closure(rows, depth).select("id", "ancestor", "steps").collect()]
    assert sorted(got) == sorted((c, a, k) for c in parent for k, a in enumerate(above(parent, c, depth), 1))


def test_circles_end_at_the_depth(spark):
    for stretches in ([0, 0, 0, 0], [0, 1, 0, 1]):
        parent = {"a": "b", "b": "c", "c": "a", "x": "b"}
        rows = [(c, p, s) for (c, p), s in zip(parent.items(), stretches, strict=True)]
        got = [tuple(x) for x in attribution.ancestor_closure(spark.createDataFrame(rows, "id string, parent string, stretch int"), 5).collect()]
        assert sorted(got) == sorted((c, a, k) for c in parent for k, a in enumerate(above(parent, c, 5), 1))


def test_a_chain_moves_lines_and_not_pairs(spark):
    n = 3 * chains.STRETCH
    commits = spark.range(n).select(F.format_string("c%06d", "id").alias("id"), F.lit("r").alias("repo_id"), F.col("id").cast("timestamp").alias("committed_at"))
    made = chains.lines(attribution.parents_by_time(commits))
    assert sorted((x["at"], len(x["ids"])) for x in made.na.fill("").collect()) == [("", chains.STRETCH), (f"c{chains.STRETCH - 1:06}", chains.STRETCH), (f"c{2 * chains.STRETCH - 1:06}", chains.STRETCH)]
    made = attribution.ancestor_closure(attribution.parents_by_time(commits))
    plan = made._jdf.queryExecution().executedPlan().toString()
    # Pairs come from a line of commits, after the last shuffle.
    assert plan.rindex("Generate explode") < plan.index("Exchange RoundRobinPartitioning")
    assert made.agg(F.count(F.lit(1)), F.sum("steps"), F.countDistinct("id")).head()[:] == (n * 500 - 500 * 501 // 2, sum(min(i, 500) * (min(i, 500) + 1) // 2 for i in range(n)), n - 1)


def test_lines_are_spread_out_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(chains, "PIECE", 15)
    for depth in (1, 4, 5, 37):  # 15, 3, 3 and 1 commits a piece
        parent, rows = histories(spark, depth, "time")
        got = [tuple(x) for x in attribution.ancestor_closure(rows, depth).select("id", "ancestor", "steps").collect()]
        assert sorted(got) == sorted((c, a, k) for c in parent for k, a in enumerate(above(parent, c, depth), 1))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = attribution.ancestor_closure(rows, 5)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    # A compiled stage, "*(n)", gathers all rows of one that it reads: the last one reads pieces, not lines.
    last = [x for x in plan if "*(" in x and x.split("*(")[1].split(")")[0] == plan[0].split("*(")[1].split(")")[0]]
    assert sum("Generate explode" in x for x in last) == 2
    cut = [x for x in plan if "Generate inline" in x]
    assert len(cut) == 1 and "*(" not in cut[0].split("Generate")[0]


@pytest.mark.parametrize("stretches, depth", [("time", 20), ("one", 20), ("any", 5)])
def test_pairs_on_one_chain_by_lines(spark, stretches, depth):
    parent, rows = histories(spark, depth + 1, stretches)
    r = random.Random(4)
    pairs = [(f"c{r.randrange(160)}", f"c{r.randrange(160)}") for _ in range(500)] + [(c, a) for c in parent for a in above(parent, c, depth + 1)[-2:]] + [("lost", "unknown"), ("c1", "c1")]
    got = [tuple(x) for x in content.on_chain(spark.createDataFrame(pairs, "id string, ancestor string"), rows, depth).select("id", "ancestor").collect()]
    assert sorted(got) == sorted({p for p in pairs if p[1] in above(parent, p[0], depth) and p[1] in parent})


def test_rounds_do_not_grow_with_a_chain(spark, monkeypatch):
    n, rounds = 2 * chains.STRETCH, []
    for module in (chains, content):
        monkeypatch.setattr(module, "kept", lambda df, keep=module.kept: rounds.append(df) or keep(df))
    commits = spark.range(n).select(F.format_string("c%06d", "id").alias("id"), F.lit("r").alias("repo_id"), F.col("id").cast("timestamp").alias("committed_at"))
    pairs = [(f"c{i:06}", f"c{i - k:06}") for i in range(600, n, 500) for k in (1, 500, 501, -1)]
    got = content.on_chain(spark.createDataFrame(pairs, "id string, ancestor string").where("ancestor < 'c004096'"), attribution.parents_by_time(commits))
    assert sorted(tuple(x) for x in got.collect()) == sorted((f"c{i:06}", f"c{i - k:06}") for i in range(600, n, 500) for k in (1, 500))
    assert len(rounds) <= 6


def test_histories_are_folded_once_for_looks(spark, tmp_path):
    texts = [(i, "\n".join(f"{i} line {k}" for k in range(i * 9)) + "\n" * (i % 2)) for i in range(6)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    steps = derived.file_histories(spark, str(tmp_path))
    settled = authorship.settled_credits(authorship.fold(steps))
    assert settled._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = sorted((x["event_id"], x["lines_generated"], x["lines_reworked"], len(x["spans"])) for x in settled.collect())
    assert got == [(f"e3-{i}", 1, 0, 1) for i in range(6)]
    whole = {x["file"]: x["lines"] for x in steps.where("seq = 1").collect()}
    for x in spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", authorship.text_lines(F.col("text")).alias("lines")).collect():
        assert whole[str(x["doc_id"])] == x["lines"]


def test_spans_are_the_runs_of_an_events_lines(spark):
    lines = {"e": [1, 2, 3, 5, 8, 9], "f": [4], "g": []}
    rows = [("map", "x", e, n) for e, at in lines.items() for n in at] + [("look", "x", e, n) for e in lines for n in range(3)] + [("map", "x", "edit", 6), ("map", "x", None, 7)]
    folded = spark.createDataFrame(rows, "kind string, file string, event_id string, line int")
    got = {x["event_id"]: [tuple(s) for s in x["spans"]] for x in authorship.settled_credits(folded).collect()}
    assert got == {"e": [(1, 3), (5, 5), (8, 9)], "f": [(4, 4)], "g": []}
