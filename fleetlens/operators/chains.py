"""First-parent histories as lines: runs of commits, each the parent of the one before it, so that questions about ancestors move lines instead of commits times ancestors.

Commits come in stretches, groups that keep most of them together with their parents, such as so many of a repository's commits by time.
Each stretch is parted into lines on its own. Results don't depend on stretches; a chain that changes stretch often takes more rounds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import kept

#: Commits of a stretch.
STRETCH = 2048
#: Rows that are sent to all tasks at most.
FEW = 100_000
#: Pairs of a piece of a line, the most that a task holds while it spreads lines out.
PIECE = 16_384


def lines(parents: DataFrame) -> DataFrame:
    """(line, ids, at): the commits of parents (id, parent, stretch), each in one line's ids, children first; at is the parent of a line's last commit.

    A line begins at a commit that is farthest from its stretch's upper end and goes up as far as no other line has taken the commits.
    """

    def part(stretch: pa.Table) -> pa.Table:
        ids, above = stretch["id"].to_pylist(), stretch["parent"].to_pylist()
        place = {x: i for i, x in enumerate(ids)}
        up = [place.get(x, -1) for x in above]
        level = [0] * len(ids)
        for i in range(len(ids)):
            way, j = [], i
            while j >= 0 and not level[j]:
                level[j] = -1
                way.append(j)
                j = up[j]
            if j >= 0 and level[j] < 0:
                # A circle: it is cut here, and its line's end has a parent in the line.
                up[way[-1]], j = -1, -1
            base = level[j] if j >= 0 else 0
            for k in reversed(way):
                base += 1
                level[k] = base
        taken, rows = [False] * len(ids), []
        for i in sorted(range(len(ids)), key=level.__getitem__, reverse=True):
            run, j = [], i
            while j >= 0 and not taken[j]:
                taken[j] = True
                run.append(j)
                j = up[j]
            if run:
                rows.append((ids[i], [ids[k] for k in run], above[run[-1]]))
        names, starts, ends = zip(*rows, strict=True)
        return pa.table({"line": pa.array(names, pa.string()), "ids": pa.array(starts, pa.list_(pa.string())), "at": pa.array(ends, pa.string())})

    return parents.where("id is not null").select("id", "parent", "stretch").groupBy("stretch").applyInArrow(part, "line string, ids array<string>, at string")


def places(made: DataFrame) -> DataFrame:
    """(id, line, pos) of every commit of lines()."""
    return made.select("line", F.posexplode("ids").alias("pos", "id")).select("id", "line", "pos")


def few(df: DataFrame, n: int) -> DataFrame:
    return df.hint("broadcast") if n <= FEW else df


def closure(parents: DataFrame, depth: int) -> DataFrame:
    """(id, ancestor, steps) along first parents (id, parent, stretch), up to depth.

    Every line gets the commits above its end, once for all its own; a round goes on to the end of the line reached. Pairs are spread out
    last, from a line's commits and those above, and never shuffled.
    """
    made = kept(lines(parents))
    found = []
    walkers = kept(made.where("at is not null").select(F.col("line").alias("of"), "at", F.lit(depth).alias("left")))
    while n := walkers.count():
        known = places(made).withColumnRenamed("id", "at").join(few(walkers, n), "at").select("of", "line", "pos")
        met = made.withColumnRenamed("at", "end").join(few(known, n), "line").select("of", "pos", "end", "ids")
        # A parent that isn't on record is an ancestor, of which no more is known.
        own = walkers.join(met, "of", "left").withColumn("part", F.when(F.col("ids").isNull(), F.array("at")).otherwise(F.slice("ids", F.col("pos") + 1, F.col("left"))))
        stepped = kept(own.select("of", "left", "part", "end"))
        found.append(stepped.select("of", "left", "part"))
        rest = F.col("left") - F.size("part")
        walkers = kept(stepped.where((rest > 0) & F.col("end").isNotNull()).select("of", F.col("end").alias("at"), rest.alias("left")))
    whole = made.select("line", "ids", F.lit(None).cast("array<string>").alias("above"))
    if found:
        parts = found[0]
        for more in found[1:]:
            parts = parts.unionByName(more)
        above = parts.groupBy(F.col("of").alias("line")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("turn"), "part"))), lambda x: x["part"])).alias("above"))
        whole = made.join(above, "line", "left").select("line", "ids", "above")
    # As many tasks as were asked for, though lines take little space: each is spread out to depth times its commits.
    path = whole.select(F.concat("ids", F.coalesce("above", F.array().cast("array<string>"))).alias("path"), F.size("ids").alias("long"))
    dealt = path.repartition(int(made.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Spark's compiled loops gather all that a row is spread out to before they hand it on, so a line is cut into pieces by a step that isn't compiled with them (transform).
    few_commits = max(1, PIECE // depth)
    cut = F.transform(F.sequence(F.lit(0), F.col("long") - 1, F.lit(few_commits)), lambda i: F.struct(F.slice("path", i + 1, F.lit(few_commits + depth)).alias("path"), F.least(F.lit(few_commits), F.col("long") - i).alias("long")))
    begun = dealt.select(F.inline(cut)).select("path", (F.size("path") - 1).alias("last"), F.explode(F.sequence(F.lit(0), F.col("long") - 1)).alias("i")).where("i < last")
    each = begun.select(F.get("path", F.col("i")).alias("id"), "path", "i", F.least(F.lit(depth), F.col("last") - F.col("i")).alias("far"))
    pairs = each.select("id", "path", "i", F.explode(F.sequence(F.lit(1), F.col("far"))).alias("steps"))
    return pairs.select("id", F.get("path", F.col("i") + F.col("steps")).alias("ancestor"), "steps")


def on_chain(pairs: DataFrame, parents: DataFrame, depth: int) -> DataFrame:
    """The pairs (id, ancestor) of which the second is reached from the first along first parents (id, parent, stretch) in 1 to depth steps, both on record.

    Two commits of a line are as far apart as their places; from another line a pair goes on to the end of its own and above. Histories have no circles here.
    """
    made = kept(lines(parents))
    place = places(made)
    asked = pairs.select("id", "ancestor").repartition("id").distinct()
    begun = asked.join(place, "id").join(place.select(F.col("id").alias("ancestor"), F.col("line").alias("to"), F.col("pos").alias("goal")), "ancestor")
    # done: steps to the place at which a pair stands.
    held = kept(begun.where("line <> to or goal > pos").select("id", "ancestor", "to", "goal", "line", "pos", F.lit(0).alias("done")))
    out = []
    ends = made.where("at is not null").select("line", "at", F.size("ids").alias("long"))
    n_ends = ends.count()
    above = kept(place.withColumnRenamed("id", "at").withColumnRenamed("line", "next").withColumnRenamed("pos", "from").join(few(ends, n_ends), "at").select("line", "long", "next", "from"))
    while True:
        met = (F.col("line") == F.col("to")) & (F.col("goal") >= F.col("pos"))
        steps = F.col("done") + F.col("goal") - F.col("pos")
        out.append(held.where(met & (steps > 0) & (steps <= depth)).select("id", "ancestor"))
        on = held.where(~met).join(few(above, n_ends), "line").withColumn("done", F.col("done") + F.col("long") - F.col("pos")).where(F.col("done") <= depth)
        held = kept(on.select("id", "ancestor", "to", "goal", F.col("next").alias("line"), F.col("from").alias("pos"), "done"))
        if held.isEmpty():
            break
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
