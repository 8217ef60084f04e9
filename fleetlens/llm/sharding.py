"""Sharding by balanced label propagation.

Rows start in shards of equal count. In each round a linked row looks for the shard that holds most
of its neighbours and wishes to move there if that cuts fewer links. Moves between two shards are
made in equal numbers, so counts never change: wishes from a to b are met first by wishes from
b to a; then, the largest gains first, by those rows of b that lose least by leaving, as long as the
move gains more than it costs. Rounds go on until no such exchange is left, or until several in a row
have kept no more links together. Shards with equally many of a group are told apart by a hash that
changes each round, so halves that swapped places once don't for ever. A group larger than a shard fills one and then the next.

Links come as memberships (id, group): all rows of a group are each other's neighbours, so a
group of any size costs a row per member and no pairs.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import rank_within, stash

#: Propagation has settled after so many rounds in a row that keep no more links together than before. A shard this full of one group is no longer a goal for its other members.
STALE, FULL = 6, 0.98
#: Groups with more rows than one in so many are joined by broadcast: there are at most HEAVY of them.
HEAVY = 1000
#: Rows of a group that are ranked in one piece.
PIECE = 10_000


def _join_groups(rows: DataFrame, per_group: DataFrame, heavy: DataFrame) -> DataFrame:
    """rows (.., group) with per_group's columns, left; heavy groups by broadcast, the rest by shuffle."""
    few = F.broadcast(heavy.select("group"))
    light = rows.join(few, "group", "left_anti").join(per_group.join(few, "group", "left_anti"), "group", "left")
    return light.unionByName(rows.join(few, "group", "left_semi").join(F.broadcast(per_group.join(few, "group", "left_semi")), "group", "left"))


def assign(nodes: DataFrame, members: DataFrame, shards: int = 8) -> DataFrame:
    """(id, shard) for nodes (id), counts at most one apart, from links members (id, group).

    Repeated ids in nodes are rows of their own that share a fate only by chance; members must
    name each id once. Ids without a group, or alone in it, have no links and make room for others.
    """
    spark = nodes.sparkSession
    state = rank_within(nodes.select("id"), [], ["id"], "r").select("id", F.pmod("r", F.lit(shards)).cast("int").alias("shard"))
    sizes = stash(members.groupBy("group").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "groups")
    n = nodes.count()
    heavy = stash(sizes.where(F.col("size") * HEAVY > n).select("group"), "heavy")
    linked = _join_groups(members.where("group is not null"), sizes, heavy).where("size > 1").select("id", "group", "size")
    state = stash(state.join(linked, "id", "left"), "shards")
    full = max(1, int(FULL * (n // shards)))
    most, stale, turn = -1.0, 0, 0
    while stale < STALE:
        turn += 1
        held = state.where("group is not null").groupBy("group", "shard").agg(F.count(F.lit(1)).alias("c"))
        tally = held.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("shard", "c"))).alias("tally"))  # at most `shards` entries
        seen = _join_groups(state.where("group is not null"), tally, heavy)
        # The goal: the shard with most of the group; ties by a hash that all members share for the round. A group that needs
        # several shards has as many goals, and its members go to the first that isn't full of it.
        order = F.array_sort(
            F.transform(
                F.map_entries("tally"),
                lambda e: F.struct((-e["value"]).alias("c"), F.xxhash64("group", e["key"], F.lit(turn)).alias("h"), e["key"].alias("k")),
            )
        )
        here = F.element_at("tally", F.col("shard"))
        goals = F.slice(order, 1, F.ceil(F.col("size") / full).cast("int"))
        best = F.get(F.filter(goals, lambda e: -e["c"] < F.lit(full)), 0)
        home = F.exists(goals, lambda e: (e["k"] == F.col("shard")) & (-e["c"] >= F.lit(full)))
        goal = F.when(home | best.isNull(), F.col("shard")).otherwise(best["k"])
        asked = seen.select("id", "group", "size", "shard", here.alias("here"), goal.alias("goal"), (-best["c"] - here + 1).alias("gain"))
        # Links won by a wish; links lost by a row that leaves, which is what it has in its shard.
        step = lambda x: F.when(x > 0, F.floor(F.log2(x.cast("double"))).cast("int") + 1).otherwise(F.lit(0))
        wish = (F.col("goal") != F.col("shard")) & (F.col("gain") > 0)
        linked_rows = asked.select("id", "group", "size", "shard", F.when(wish, F.col("goal")).otherwise(F.lit(-1)).alias("goal"), F.when(wish, step(F.col("gain"))).otherwise(step(F.col("here") - 1)).alias("step"))
        free = state.where("group is null").select("id", "group", "size", "shard", F.lit(-1).alias("goal"), F.lit(0).alias("step"))
        # Members of a group are ranked side by side, so that what must leave leaves together.
        piece = F.xxhash64("group", F.pmod("id", F.ceil(F.coalesce("size", F.lit(1)) / PIECE)), F.when(F.col("group").isNull(), F.col("id")))
        movers = stash(linked_rows.unionByName(free).withColumn("piece", piece), "wishes")
        ranked = stash(rank_within(movers, ["shard", "goal", "step"], ["group", "id"], "rank", salt=F.col("piece")), "movers")
        counts = {(r["shard"], r["goal"], r["step"]): r["n"] for r in ranked.groupBy("shard", "goal", "step").agg(F.count(F.lit(1)).alias("n")).collect()}  # shards x shards x 64 at most
        plan = _plan(counts, shards)
        if not plan:
            break
        moves = F.broadcast(spark.createDataFrame(plan, "shard int, goal int, step int, lo long, hi long, to int"))
        moved = ranked.join(moves, ["shard", "goal", "step"]).where("rank >= lo and rank < hi").select("id", "to")
        state = stash(state.join(moved, "id", "left").select("id", "group", "size", F.coalesce("to", "shard").alias("shard")), "shards")
        kept = held.agg(F.coalesce(F.sum(F.col("c").cast("double") * (F.col("c") - 1)), F.lit(0.0)).alias("kept")).head()["kept"]
        stale = 0 if kept > most else stale + 1
        most = max(most, kept)
    return state.select("id", "shard")


def _plan(counts: dict[tuple[int, int, int], int], shards: int) -> list[tuple[int, int, int, int, int, int]]:
    """Ranks [lo, hi) of rows (shard, goal or -1, step) that go `to` another shard, in equal numbers both ways between any two.

    A wish of step g gains at least 2^(g-1) links; a row of step c that leaves for it loses less than 2^c.
    """
    used: dict[tuple[int, int, int], int] = defaultdict(int)
    plan = []

    def take(key: tuple[int, int, int], n: int, to: int) -> None:
        if n:
            plan.append((*key, used[key], used[key] + n, to))
            used[key] += n

    def left(key: tuple[int, int, int]) -> int:
        return counts.get(key, 0) - used[key]

    steps = range(64)
    for a in range(shards):
        for b in range(a):  # wishes that meet
            both = min(sum(counts.get((x, y, g), 0) for g in steps) for x, y in ((a, b), (b, a)))
            for x, y in ((a, b), (b, a)):
                due = both
                for g in reversed(steps):
                    n = min(due, left((x, y, g)))
                    take((x, y, g), n, y)
                    due -= n
    for g in reversed(steps):
        for c in range(g):
            for b in range(shards):
                wanting = [(a, left((a, b, g))) for a in range(shards) if left((a, b, g))]
                spare, due = left((b, -1, c)), sum(n for _, n in wanting)
                for a, n in wanting:
                    n = min(left((b, -1, c)), n if due <= spare else -(-n * spare // due))
                    take((a, b, g), n, b)
                    take((b, -1, c), n, a)
    return plan


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): docs in shards whose counts differ by one at most, equal texts together where room allows.

    Size is the text's UTF-8 bytes plus 1; null text has size 1, the crc32 of no bytes, and no links.
    Rows that repeat a doc_id are told apart by their place in the ranking. slot is gapless from
    0 in each shard. Only ids and hashes are shuffled.
    """
    body = F.coalesce("text", F.lit(""))
    facts = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.when(F.col("text").isNotNull(), F.md5("text")).alias("group"))
    rows = stash(rank_within(stash(facts, "facts"), [], ["doc_id", "group"], "id"), "rows")
    placed = assign(rows.select("id"), rows.select("id", "group").where("group is not null"), shards)
    full = rows.join(placed, "id").select("doc_id", "size", "text_crc32", "shard", "id")
    return rank_within(stash(full, "placed"), ["shard"], ["id"], "slot").drop("id")
