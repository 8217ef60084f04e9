"""Aggregates over sessions, edits, commits and attribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import duration_ms, json_text, tool_family
from ..sources.fixtures import Tables
from .edits import ai_edits_scored
from .filters import UNKNOWN, Filters, active_repos
from .rounds import kept

ALL = Filters()
#: Minutes a gap between two events counts at most.
IDLE_MINUTES = 5


def local_day(ts: Column, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz))


def capped_gaps(events: DataFrame, idle: float = IDLE_MINUTES) -> DataFrame:
    """events (session_id, ts, id) + gap_us: microseconds since the session's event before, at most idle minutes; null for the first."""
    order = Window.partitionBy("session_id").orderBy("ts", "id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))
    return events.withColumn("gap_us", F.when(gap.isNotNull(), F.least(gap, F.lit(int(idle * 60_000_000)))))


def minutes(us: Column) -> Column:
    return us / F.lit(60_000_000.0)


def session_active(T: Tables, idle: float = IDLE_MINUTES) -> DataFrame:
    """(session_id, active_minutes)."""
    gaps = capped_gaps(T.events.where("session_id is not null").select("session_id", "ts", "id"), idle)
    return gaps.groupBy("session_id").agg(minutes(F.coalesce(F.sum("gap_us"), F.lit(0))).alias("active_minutes"))


def committed_ai(T: Tables, edits: DataFrame | None = None) -> DataFrame:
    """commit_sessions rows that count: all, or those whose session has an edit among `edits` in the commit's repository."""
    rows = T.commit_sessions.join(T.commits.select(F.col("id").alias("commit_id"), "repo_id", "committed_at"), "commit_id")
    return rows if edits is None else rows.join(edits.select("session_id", "repo_id").distinct(), ["session_id", "repo_id"], "left_semi")


def overview(T: Tables, f: Filters = ALL) -> DataFrame:
    """One row: edits, generated, replaced, sessions with edits, committed."""
    edits = ai_edits_scored(T, f)
    totals = edits.agg(F.count(F.lit(1)).alias("edits"), F.coalesce(F.sum("lines"), F.lit(0)).alias("generated"), F.coalesce(F.sum("lines_replaced"), F.lit(0)).alias("replaced"), F.countDistinct("session_id").alias("sessions"))
    committed = committed_ai(T, edits).agg(F.coalesce(F.sum("lines_attributed"), F.lit(0)).alias("committed"))
    return totals.crossJoin(committed)  # one row by one row


def top_model(edits: DataFrame) -> DataFrame:
    """(model, edits): the model with most edits; ties by name."""
    return edits.groupBy("model").agg(F.count(F.lit(1)).alias("edits")).orderBy(F.desc("edits"), "model").limit(1)


def commit_totals(T: Tables, f: Filters = ALL) -> DataFrame:
    """One row: commits, lines_added, committed, ai_share in per cent (at most 100; 0 without lines)."""
    chosen = T.commits.where(f.dated(F.col("committed_at")))
    chosen = chosen.where(F.col("repo_id").isin(*f.repos)) if f.repos else chosen.join(active_repos(T).withColumnRenamed("id", "repo_id"), "repo_id", "left_semi")
    per = T.commit_sessions.groupBy("commit_id").agg(F.sum("lines_attributed").alias("a"))
    sums = chosen.join(per, chosen["id"] == per["commit_id"], "left").agg(F.count(F.lit(1)).alias("commits"), F.coalesce(F.sum("lines_added"), F.lit(0)).alias("lines_added"), F.coalesce(F.sum("a"), F.lit(0)).alias("committed"))
    share = F.when(F.col("lines_added") > 0, F.least(F.lit(100.0), F.col("committed") * 100.0 / F.col("lines_added"))).otherwise(F.lit(0.0))
    return sums.withColumn("ai_share", share)


def session_spans(T: Tables) -> DataFrame:
    """(id, agent_slug, engineer_email, lo_us, hi_us): a session's own times, else those of its events."""
    seen = T.events.where("session_id is not null").groupBy("session_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    joined = T.sessions.join(seen, T.sessions["id"] == seen["session_id"], "left")
    return joined.select("id", "agent_slug", "engineer_email", "started_at", F.unix_micros(F.coalesce("started_at", "lo")).alias("lo_us"), F.unix_micros(F.coalesce("ended_at", "hi")).alias("hi_us"))


def working_hours(T: Tables, f: Filters = ALL) -> DataFrame:
    """One row: hours, by date, agent and engineer only."""
    own = Filters(f.start, f.end, agents=f.agents, engineers=f.engineers, tz=f.tz)
    spans = own.sessions(session_spans(T).withColumns({"model_slug": F.lit(None).cast("string"), "repo_id": F.lit(None).cast("string")}))
    return spans.where("lo_us is not null and hi_us is not null").agg((F.coalesce(F.sum(F.col("hi_us") - F.col("lo_us")), F.lit(0)) / F.lit(3.6e9)).alias("hours"))


def max_concurrent(T: Tables, f: Filters = ALL, bucket_us: int = 3_600_000_000) -> DataFrame:
    """One row: the most spans that overlap any one session's closed span, itself included.

    For a span [s, e] that is N(start <= e) - N(end < s). Both counts are prefix counts: totals of
    whole buckets before, plus a running count inside the bucket, so no span meets another in a join.
    """
    spans = session_spans(T).where(f.dated(F.col("started_at"))).where("lo_us is not null and hi_us is not null and lo_us <= hi_us").select("id", "lo_us", "hi_us")
    # kind: what a row adds to a count (1) or asks of it (0); starts at a time count for an end at that time, ends do not for a start.
    points = spans.select("id", F.explode(F.array(
        F.struct(F.lit("s").alias("of"), F.lit(1).alias("add"), F.col("lo_us").alias("at"), F.lit(0).alias("turn")),
        F.struct(F.lit("s").alias("of"), F.lit(0).alias("add"), F.col("hi_us").alias("at"), F.lit(1).alias("turn")),
        F.struct(F.lit("e").alias("of"), F.lit(1).alias("add"), F.col("hi_us").alias("at"), F.lit(1).alias("turn")),
        F.struct(F.lit("e").alias("of"), F.lit(0).alias("add"), F.col("lo_us").alias("at"), F.lit(0).alias("turn")),
    )).alias("p")).select("id", "p.*").withColumn("bucket", F.floor(F.col("at") / bucket_us))
    before = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = points.groupBy("of", "bucket").agg(F.sum("add").alias("n")).select("of", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("of", "bucket").orderBy("at", "turn", F.desc("add")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = points.withColumn("here", F.sum("add").over(inside)).join(base, ["of", "bucket"]).where("add = 0").select("id", "of", (F.col("base") + F.col("here")).alias("n"))
    per = counted.groupBy("id").agg(F.sum(F.when(F.col("of") == "s", F.col("n")).otherwise(-F.col("n"))).alias("n"))
    return per.agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_concurrent"))


TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")


def token_totals(T: Tables, f: Filters = ALL) -> DataFrame:
    """One row of four sums; null where no session reports, never zero for that."""
    own = Filters(f.start, f.end, agents=f.agents, engineers=f.engineers, tz=f.tz)
    return own.sessions(T.sessions).agg(*[F.sum(c).alias(c) for c in TOKENS])


def tokens_by_agent(T: Tables, f: Filters = ALL) -> DataFrame:
    own = Filters(f.start, f.end, agents=f.agents, engineers=f.engineers, tz=f.tz)
    return own.sessions(T.sessions).groupBy("agent_slug").agg(*[F.sum(c).alias(c) for c in TOKENS]).orderBy(F.desc_nulls_last("output_tokens"), "agent_slug")


NO_REPO = "(no repo)"


def breakdown(T: Tables, f: Filters = ALL, by: str = "agent") -> DataFrame:
    """(key, edits, generated, sessions, committed, top_model) by agent, model, engineer or repo.

    Edits and committed lines are summed apart and joined. Edits without a repository
    are '(no repo)', with nothing committed and no top model.
    """
    column = {"agent": "agent_slug", "model": "model", "engineer": "engineer_email", "repo": "repo_id"}[by]
    edits = ai_edits_scored(T, f).withColumn("key", F.col(column))
    if by != "repo":
        edits = edits.where("key is not null")
    # Scored once and kept by session, since three questions are asked of it.
    facts = kept(edits.groupBy("key", F.col("model").alias("edit_model"), "session_id", "repo_id").agg(F.count(F.lit(1)).alias("edits"), F.sum("lines").alias("generated")))
    main = facts.groupBy("key").agg(F.sum("edits").alias("edits"), F.sum("generated").alias("generated"), F.countDistinct("session_id").alias("sessions"))
    counted = committed_ai(T, facts)
    if by == "engineer":
        counted = counted.join(T.sessions.select(F.col("id").alias("session_id"), "engineer_email"), "session_id")
    if by == "model":
        counted = counted.withColumn("model", F.coalesce("model_slug", F.lit(UNKNOWN)))
    sums = counted.withColumn("key", F.col(column)).where("key is not null").groupBy("key").agg(F.sum("lines_attributed").alias("committed"))
    order = Window.partitionBy("key").orderBy(F.desc("n"), "model")
    tops = facts.where("key is not null").groupBy("key", F.col("edit_model").alias("model")).agg(F.sum("edits").alias("n")).withColumn("r", F.row_number().over(order)).where("r = 1").select("key", F.col("model").alias("top_model"))
    joined = main.join(sums, "key", "left").join(tops, "key", "left")
    return joined.select(F.coalesce("key", F.lit(NO_REPO)).alias("key"), "edits", "generated", "sessions", F.coalesce("committed", F.lit(0)).alias("committed"), "top_model")


def daily_activity(T: Tables, f: Filters = ALL, idle: float = IDLE_MINUTES) -> DataFrame:
    """(day, agent_slug, active_minutes, sessions, prompts, edits, generated, committed, commits) per local day and agent.

    Five streams of facts are brought to one shape and summed in a single aggregation. A gap
    belongs to the day of its later event and is taken after the window filter.
    """
    tz = f.tz
    of = T.sessions.select(F.col("id").alias("session_id"), F.col("agent_slug").alias("agent"), F.coalesce("model_slug", F.lit(UNKNOWN)).alias("model"), F.col("repo_id").alias("srepo"), "engineer_email")
    scope = of.where(f._among("agent", f.agents) & f._among("model", f.models) & f._among("srepo", f.repos) & f._among("engineer_email", f.engineers)).select("session_id", "agent")
    blank = {"us": "bigint", "session": "string", "prompts": "bigint", "edits": "bigint", "generated": "bigint", "committed": "bigint", "commit": "string"}

    def facts(df: DataFrame, **have: Column) -> DataFrame:
        return df.select("day", "agent", *[have.get(k, F.lit(None)).cast(t).alias(k) for k, t in blank.items()])

    events = T.events.where(f.dated(F.col("ts"))).select("session_id", "ts", "id").join(scope, "session_id").withColumn("day", local_day(F.col("ts"), tz))
    active = facts(capped_gaps(events, idle), us=F.col("gap_us"), session=F.col("session_id"))
    asked = T.prompts.where(f.dated(F.col("ts"))).select("session_id", "ts").join(scope, "session_id").withColumn("day", local_day(F.col("ts"), tz))
    edits = ai_edits_scored(T, f).withColumns({"day": local_day(F.col("ts"), tz), "agent": F.col("agent_slug")})
    landed = committed_ai(T).where(f.dated(F.col("committed_at")) & (F.col("lines_attributed") > 0)).select("session_id", "commit_id", "committed_at", "lines_attributed").join(scope, "session_id").withColumn("day", local_day(F.col("committed_at"), tz))
    rows = [active, facts(asked, prompts=F.lit(1)), facts(edits, edits=F.lit(1), generated=F.col("lines")), facts(landed, committed=F.col("lines_attributed"), commit=F.col("commit_id"))]
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return reduce(DataFrame.unionByName, rows).groupBy("day", F.col("agent").alias("agent_slug")).agg(
        minutes(F.coalesce(F.sum("us"), F.lit(0))).alias("active_minutes"), F.countDistinct("session").alias("sessions"), z("prompts"), z("edits"), z("generated"), z("committed"), F.countDistinct("commit").alias("commits")
    )


def activity_totals(daily: DataFrame) -> DataFrame:
    return daily.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("active_minutes", "sessions", "prompts", "edits", "generated", "committed")])


def with_delta(now: DataFrame, prior: DataFrame, flat: float = 0.02) -> DataFrame:
    """(metric, value, before, delta, trend): activity_totals of a window against those of the window before it.

    delta is the change as a share of the earlier value (null if that is 0); within the band of 2 % it is flat.
    """
    tall = lambda df, name: df.unpivot([], [F.col(c).cast("double").alias(c) for c in df.columns], "metric", name)
    both = tall(now, "value").join(tall(prior, "before"), "metric")
    delta = F.when(F.col("before") > 0, (F.col("value") - F.col("before")) / F.col("before"))
    return both.withColumn("delta", delta).withColumn("trend", F.when(F.col("delta").isNull(), None).when(F.abs("delta") < flat, "flat").when(F.col("delta") > 0, "up").otherwise("down"))


def daily_series(daily: DataFrame, spark_days: DataFrame) -> DataFrame:
    """(day, generated, committed, keep_rate) for every day of spark_days (day), zero where nothing happened; keep rate at most 1, 0 without lines."""
    sums = daily.groupBy("day").agg(F.sum("generated").alias("generated"), F.sum("committed").alias("committed"))
    filled = spark_days.join(sums, "day", "left").fillna(0, ["generated", "committed"])
    return filled.withColumn("keep_rate", F.when(F.col("generated") > 0, F.least(F.lit(1.0), F.col("committed") / F.col("generated"))).otherwise(F.lit(0.0)))


def edit_heatmap(T: Tables, f: Filters = ALL) -> DataFrame:
    """(weekday 0 = Sunday, hour, edits) in local time."""
    local = F.from_utc_timestamp("ts", f.tz)
    return ai_edits_scored(T, f).groupBy((F.dayofweek(local) - 1).alias("weekday"), F.hour(local).alias("hour")).agg(F.count(F.lit(1)).alias("edits"))


def tool_calls_of(T: Tables, f: Filters = ALL) -> DataFrame:
    """Tool calls with family and duration: id, session_id, ts, agent_slug, tool, family, ms. One without a name is of the family other; one without a session counts too."""
    of = T.sessions.select(F.col("id").alias("session_id"), F.col("model_slug").alias("__model"), "engineer_email")
    tool = json_text(F.col("payload"), "$.tool_name")
    model = F.coalesce("__model", json_text(F.col("payload"), "$.model"), F.lit(UNKNOWN))
    calls = T.events.where("event_type = 'PostToolUse' and payload is not null").join(of, "session_id", "left").withColumns({"tool": tool, "model": model})
    return f.events(calls).select("id", "session_id", "ts", "agent_slug", "tool", F.coalesce(tool_family(F.col("tool")), F.lit("other")).alias("family"), duration_ms(F.col("payload")).alias("ms"))


def tool_mix(T: Tables, f: Filters = ALL) -> DataFrame:
    """(agent_slug, family, calls, share of the agent's calls)."""
    counts = tool_calls_of(T, f).groupBy("agent_slug", "family").agg(F.count(F.lit(1)).alias("calls"))
    return counts.withColumn("share", F.col("calls") / F.sum("calls").over(Window.partitionBy("agent_slug")))


def time_split(T: Tables, f: Filters = ALL, cap_ms: float = IDLE_MINUTES * 60_000) -> DataFrame:
    """(family, calls, timed, wait_minutes): calls, those with a duration, and their time, each at most the cap."""
    capped = F.when(F.col("ms").isNotNull(), F.least(F.col("ms"), F.lit(float(cap_ms))))
    return tool_calls_of(T, f).groupBy("family").agg(F.count(F.lit(1)).alias("calls"), F.count("ms").alias("timed"), (F.coalesce(F.sum(capped), F.lit(0.0)) / 60_000.0).alias("wait_minutes"))


def slowest_calls(T: Tables, f: Filters = ALL, n: int = 5) -> DataFrame:
    """The n longest tool calls; ties by id."""
    return tool_calls_of(T, f).where("ms is not null").orderBy(F.desc("ms"), "id").limit(n).select("id", "agent_slug", "tool", "ms")


def untimed_agents(T: Tables, f: Filters = ALL) -> DataFrame:
    """(agent_slug): agents none of whose calls has a duration."""
    return tool_calls_of(T, f).groupBy("agent_slug").agg(F.count("ms").alias("n")).where("n = 0").select("agent_slug")


def session_outcomes(T: Tables) -> DataFrame:
    """(session_id, outcome): shipped with attributed lines in a commit, else edited, else explored."""
    shipped = T.commit_sessions.where("lines_attributed > 0").select("session_id").distinct().withColumn("s", F.lit(True))
    edited = ai_edits_scored(T).where("session_id is not null").select("session_id").distinct().withColumn("e", F.lit(True))
    of = T.sessions.select(F.col("id").alias("session_id")).join(shipped, "session_id", "left").join(edited, "session_id", "left")
    return of.select("session_id", F.when(F.col("s"), "shipped").when(F.col("e"), "edited").otherwise("explored").alias("outcome"))


def funnel(T: Tables, f: Filters = ALL) -> DataFrame:
    """One row: sessions, with_edits, with_commits; generated; committed; commits; each by its own date."""
    scope = f.sessions(T.sessions).select(F.col("id").alias("session_id"))
    out = scope.join(session_outcomes(T), "session_id")
    edited = ai_edits_scored(T, f)
    a = out.join(edited.select("session_id").distinct().withColumn("e", F.lit(1)), "session_id", "left").agg(F.count(F.lit(1)).alias("sessions"), F.count("e").alias("with_edits"), F.count_if(F.col("outcome") == "shipped").alias("with_commits"))
    b = edited.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("generated"))
    live = committed_ai(T).where(f.dated(F.col("committed_at")) & (F.col("lines_attributed") > 0))
    c = live.agg(F.coalesce(F.sum("lines_attributed"), F.lit(0)).alias("committed"), F.countDistinct("commit_id").alias("commits"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def lead_time(T: Tables, f: Filters = ALL) -> DataFrame:
    """One row: total, under_15m, over_1d of the times from a session's last edit in a commit's window to the commit, as recorded with the commit's sessions.

    A commit and session with attributed lines count once, by the commit's date and the session's agent, model, repository and engineer.
    """
    made = T.commits.select(F.col("id").alias("commit_id"), "committed_at")
    rows = T.commit_sessions.where("lines_attributed > 0").select("commit_id", "session_id", "last_event_ts").join(made, "commit_id")
    of = T.sessions.select(F.col("id").alias("session_id"), "agent_slug", "model_slug", "repo_id", "engineer_email")
    kept = f.sessions(rows.join(of, "session_id", "left"), "committed_at")
    gaps = kept.select((F.unix_micros("committed_at") - F.unix_micros("last_event_ts")).alias("gap"))
    return gaps.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("gap") < 900_000_000).alias("under_15m"), F.count_if(F.col("gap") >= 86_400_000_000).alias("over_1d"))


def model_table(T: Tables, f: Filters = ALL) -> DataFrame:
    """A row per agent and model over the sessions in scope; their events are not cut by date.

    A file is a path in a repository, the edit's own or its first range's; edits that name none touch none.
    """
    scope = f.sessions(T.sessions).select(F.col("id").alias("session_id"), "agent_slug", F.coalesce("model_slug", F.lit(UNKNOWN)).alias("model"), "output_tokens", "input_tokens")
    edits = ai_edits_scored(T).where("session_id is not null")
    count = F.count(F.lit(1))
    per_edit = edits.groupBy("session_id").agg(count.alias("edits"), F.sum("lines").alias("generated"))
    named = T.ranges.where("rel_file_path is not null").groupBy(F.col("event_id").alias("id")).agg(F.min_by("rel_file_path", "id").alias("__rel"))
    of_file = edits.join(named, "id", "left").select("session_id", F.coalesce("rel_file_path", "__rel").alias("f")).where("f is not null")
    touched = of_file.groupBy("session_id", "f").agg(count.alias("n")).groupBy("session_id").agg(count.alias("files"), F.count_if(F.col("n") > 1).alias("reedited"))
    own = T.events.where("session_id is not null").groupBy("session_id").agg(F.count_if(F.col("event_type") == "PostToolUse").alias("tools"), F.count_if(F.col("event_type") == "Stop").alias("turns"))
    prompts = T.prompts.groupBy("session_id").agg(count.alias("prompts"))
    landed = T.commit_sessions.where("lines_attributed > 0").groupBy("session_id").agg(F.sum("lines_attributed").alias("committed"), F.countDistinct("commit_id").alias("commits"))
    rows = scope
    for part in (per_edit, touched, own, prompts, landed, session_active(T)):
        rows = rows.join(part, "session_id", "left")
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rows.groupBy("agent_slug", "model").agg(
        count.alias("sessions"), F.count("edits").alias("sessions_with_edits"), z("edits"), z("generated"), z("files"), z("reedited"), z("tools"), z("turns"), z("prompts"), z("committed"), z("commits"),
        F.coalesce(F.sum("active_minutes"), F.lit(0.0)).alias("active_minutes"), F.sum("output_tokens").alias("output_tokens"), F.sum("input_tokens").alias("input_tokens"), F.count("committed").alias("shipped"),
    )


def model_metrics(rows: DataFrame, sort: str = "sessions", descending: bool = True) -> DataFrame:
    """Ratios of model_table's columns, null where the denominator is missing or 0; nulls last whichever way it is sorted."""
    ratio = lambda n, d, by=1.0: F.when(F.col(d) > 0, F.col(n) * F.lit(by) / F.col(d))
    made = rows.withColumns({"keep": ratio("committed", "generated"), "lines_per_1k": ratio("generated", "output_tokens", 1000.0), "tools_per_edit": ratio("tools", "edits"), "reedit_share": ratio("reedited", "files"), "shipped_share": ratio("shipped", "sessions")})
    return made.orderBy(F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort), "agent_slug", "model")


def status_counts(T: Tables) -> DataFrame:
    """One row: events without misfires, misfires, sessions, commits, repositories."""
    a = T.events.agg(F.count_if(F.col("event_type") != "hook_misfire").alias("events"), F.count_if(F.col("event_type") == "hook_misfire").alias("misfires"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return a.crossJoin(one(T.sessions, "sessions")).crossJoin(one(T.commits, "commits")).crossJoin(one(T.repositories, "repositories"))


def status_agents(T: Tables) -> DataFrame:
    """(agent_slug, events, misfires)."""
    return T.events.groupBy("agent_slug").agg(F.count_if(F.col("event_type") != "hook_misfire").alias("events"), F.count_if(F.col("event_type") == "hook_misfire").alias("misfires"))


def newest_commits(T: Tables, n: int = 10) -> DataFrame:
    return T.commits.orderBy(F.desc("committed_at"), "id").limit(n).select("id", "repo_id", "committed_at", "lines_added")
