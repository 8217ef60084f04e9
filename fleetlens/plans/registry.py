"""Queries by name over the supplied tables, and the same in DuckDB SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agents, attribution, blame, changes, filters, maintenance, metrics, normalize, sessions
from ..operators.edits import ai_edits_scored
from ..sources import git
from ..sources.fixtures import Tables, load
from . import authors, derived, oracles, oracles_authors, oracles_sessions, oracles_upkeep

Query = Callable[[SparkSession, str], DataFrame]


def over(question: Callable[[Tables], DataFrame]) -> Query:
    """A question about the tables as a query of (spark, sf_dir)."""
    return lambda spark, sf_dir: question(load(spark, sf_dir))


#: A filter of each kind, for queries that show what filters do.
SOME = filters.Filters(start=dt.date(2024, 1, 5), end=dt.date(2024, 1, 25), agents=("codex", "pi"), models=("m0", "unknown"))

QUERIES: dict[str, Query] = authors.QUERIES | {
    "ai_edits_scored": over(ai_edits_scored),
    "overview": over(metrics.overview),
    "top_model": over(lambda T: metrics.top_model(ai_edits_scored(T))),
    "commit_totals": over(metrics.commit_totals),
    "session_active": over(metrics.session_active),
    "working_hours": over(metrics.working_hours),
    "max_concurrent": over(metrics.max_concurrent),
    "token_totals": over(metrics.token_totals),
    "tokens_by_agent": over(metrics.tokens_by_agent),
    **{f"breakdown_{by}": over(lambda T, by=by: metrics.breakdown(T, by=by)) for by in ("agent", "model", "engineer", "repo")},
    "daily_activity": over(metrics.daily_activity),
    "edit_heatmap": over(metrics.edit_heatmap),
    "tool_mix": over(metrics.tool_mix),
    "time_split": over(metrics.time_split),
    "slowest_calls": over(metrics.slowest_calls),
    "untimed_agents": over(metrics.untimed_agents),
    "session_outcomes": over(metrics.session_outcomes),
    "funnel": over(metrics.funnel),
    "lead_time": over(metrics.lead_time),
    "lead_time_filtered": over(lambda T: metrics.lead_time(T, SOME)),
    "tool_mix_filtered": over(lambda T: metrics.tool_mix(T, SOME)),
    "model_table": over(lambda T: metrics.model_table(T).withColumn("active_minutes", F.round("active_minutes", 6))),
    "status_counts": over(metrics.status_counts),
    "status_agents": over(metrics.status_agents),
    "newest_commits": over(metrics.newest_commits),
    "active_repos": over(filters.active_repos),
    "filter_options": over(filters.filter_options),
    "candidate_ranges": over(attribution.candidate_ranges),
    "owned_lines": over(attribution.owned),
    "attribute_files": over(attribution.attribute_files),
    "attribute_sessions": over(attribution.attribute_sessions),
    "attribute_by_churn": over(attribution.attribute_by_churn),
    "line_runs": over(lambda T: attribution.line_runs(attribution.owned(T), ["commit_id", "file_path", "session_id"])),
    "commit_of_edit": over(attribution.commit_of_edit),
    "prompt_before": over(lambda T: attribution.prompt_before(T.events, T.prompts)),
    "checkout_groups": over(lambda T: attribution.checkout_groups(T.repositories)),
    "ancestors": over(lambda T: attribution.ancestor_closure(attribution.parents_by_time(T.commits))),
    "list_sessions": over(sessions.list_sessions),
    "session_detail": over(sessions.session_detail),
    "files_touched": over(sessions.files_touched),
    "session_commits": over(sessions.session_commits),
    "tool_calls": over(sessions.tool_calls),
    "stops": over(sessions.stops),
    "classify_prompts": over(lambda T: sessions.classify_prompts(T.prompts)),
    "build_turns": over(lambda T: sessions.turn_durations(sessions.build_turns(T))),
    "commit_turns": over(sessions.commit_turns),
    "file_rows": over(sessions.file_rows),
    "session_count": over(lambda T: sessions.session_count(T, filters.Filters(outcome="edited"))),
    "session_stats": over(sessions.session_stats),
    "idle_gaps": over(sessions.idle_gaps),
    "turn_blocks": over(sessions.turn_blocks),
    "build_sessions": over(lambda T: maintenance.build_sessions(T.events)),
    "session_repo": over(lambda T: maintenance.session_repo(T.events)),
    "session_engineer": over(lambda T: maintenance.session_engineer(T.sessions, T.commits)),
    "prune_counts": over(lambda T: maintenance.prune_counts(T, dt.datetime(2024, 1, 31), 15)),
    "latest_rows": over(lambda T: maintenance.latest_rows(T.events.where("session_id is not null").select("session_id", "event_type", "id", "ts"), ["session_id", "event_type"], ["ts", "id"])),
    "export_status": over(lambda T: maintenance.export_status({"events": T.events.withColumn("synced_at", F.col("lines_generated")), "sessions": T.sessions.withColumn("synced_at", F.col("ended_at"))})),
    "inspect_events": over(lambda T: maintenance.inspect_events(T.events, agent="codex", event_type="PostToolUse")),
    "redact_events": over(lambda T: normalize.redact_events(T.events).select("id", "session_id", "event_type", "lines_added", "payload")),
    "resolve_paths": over(lambda T: normalize.resolve_paths(T.events.select("id", "file_path"), T.repositories)),
    "parse_envelopes": over(lambda T: normalize.parse_envelopes(derived.envelopes(T)).groupBy("session_id", "ts", "event_type", "agent_slug", "model").agg(F.count(F.lit(1)).alias("n"))),
    "normalize_payloads": over(lambda T: agents.normalize_payloads(derived.native_payloads(T)).select(
        "id", *[F.get_json_object("payload", f"$.{path}").alias(name) for name, path in (
            ("event", "hook_event_name"), ("tool", "tool_name"), ("copilot_tool", "copilot_tool_name"), ("pi_tool", "pi_tool_name"), ("file_path", "tool_input.file_path"),
            ("old_string", "tool_input.old_string"), ("new_string", "tool_input.new_string"), ("content", "tool_input.content"))])),
    "parse_commit_log": over(lambda T: git.parse_commit_log(derived.commit_log(T))),
    "parse_numstat": over(lambda T: git.commit_totals_of(git.parse_numstat(derived.numstat(T)))),
    "parse_unified_diff": over(lambda T: git.parse_unified_diff(derived.diffs(T))),
    "blame": over(lambda T: blame.blame(T, blame.latest_lines(T))),
    "blame_summary": over(lambda T: blame.blame_summary(blame.blame(T, blame.latest_lines(T)))),
    "blame_sessions": over(lambda T: blame.blame_sessions(blame.blame(T, blame.latest_lines(T)))),
    "version_diff": lambda spark, sf_dir: changes.version_diff(derived.edited_versions(spark, sf_dir)).groupBy("file", "version").agg(F.count_if(F.col("kind") == "removed").alias("removed"), F.count_if(F.col("kind") == "added").alias("added")),
    "notes_round_trip": over(lambda T: git.read_notes(git.build_notes(derived.note_runs(T)))),
    "search_sessions": over(lambda T: filters.Filters(search="DEV 1", agents=("codex", "cursor", "pi")).session_list(T).select("id", "agent_slug", "engineer_name")),
    "cross_delivered": over(lambda T: normalize.drop_cross_delivered(derived.delivered(T)).groupBy("agent_slug", "shape").agg(F.count(F.lit(1)).alias("events"))),
    "event_files": over(lambda T: normalize.with_file_path(derived.named_files(T)).select("id", "file_path", "tool")),
    "trim_payloads": over(lambda T: normalize.trim_payloads(derived.long_payloads(T)).select(
        "id", F.octet_length("payload").alias("bytes"), (F.col("dropped_bytes") > 0).alias("dropped"), F.get_json_object("payload", "$.tool_response.code").alias("code"),
        F.octet_length(F.get_json_object("payload", "$.tool_response.stderr")).alias("stderr_bytes"), F.octet_length(F.get_json_object("payload", "$.tool_input.content")).alias("content_bytes"))),
}

ORACLE_SQL: dict[str, str] = oracles.SQL | oracles_sessions.SQL | oracles_upkeep.SQL | oracles_authors.SQL
