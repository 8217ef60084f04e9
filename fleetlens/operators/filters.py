"""The filter model: which events and sessions a question is about."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.fixtures import Tables

UNKNOWN = "unknown"


@dataclass(frozen=True)
class Filters:
    """Local days from start to end (both in), and chosen agents, models, repositories and engineers; empty: all."""

    start: dt.date | None = None
    end: dt.date | None = None
    agents: tuple[str, ...] = ()
    models: tuple[str, ...] = ()
    repos: tuple[str, ...] = ()
    engineers: tuple[str, ...] = ()
    search: str = ""
    outcome: str = ""
    tz: str = field(default="UTC")

    def days(self) -> int:
        """Days in the window, both ends in."""
        return (self.end - self.start).days + 1

    def prior(self) -> Filters:
        """The window of the same length just before."""
        shift = dt.timedelta(days=self.days())
        return replace(self, start=self.start - shift, end=self.end - shift)

    def dated(self, ts: Column) -> Column:
        """Whether a time falls in the window, compared in whole seconds."""
        local = F.date_trunc("second", F.from_utc_timestamp(ts, self.tz))
        ok = F.lit(True)
        if self.start:
            ok = ok & (local >= F.lit(dt.datetime.combine(self.start, dt.time())))
        if self.end:
            ok = ok & (local <= F.lit(dt.datetime.combine(self.end, dt.time(23, 59, 59))))
        return ok

    def _among(self, column: str, chosen: tuple[str, ...]) -> Column:
        return F.col(column).isin(*chosen) if chosen else F.lit(True)

    def events(self, edits: DataFrame) -> DataFrame:
        """Edits (ts, agent_slug, model, repo_id, engineer_email) that pass: event agent and repo, known or 'unknown' model."""
        return edits.where(self.dated(F.col("ts")) & self._among("agent_slug", self.agents) & self._among("model", self.models) & self._among("repo_id", self.repos) & self._among("engineer_email", self.engineers))

    def sessions(self, sessions: DataFrame, date_col: str = "started_at", repos: bool = True) -> DataFrame:
        """Sessions that pass, by the date column given; a null model is 'unknown'."""
        ok = self.dated(F.col(date_col)) & self._among("agent_slug", self.agents) & self._among("engineer_email", self.engineers)
        if self.models:
            ok = ok & F.coalesce("model_slug", F.lit(UNKNOWN)).isin(*self.models)
        return sessions.where(ok & self._among("repo_id", self.repos) if repos else ok)

    def session_list(self, T: Tables) -> DataFrame:
        """Sessions for the list: a null model passes no model filter; search looks in the session's texts, its repository's name and its prompts, ignoring case."""
        ok = self.dated(F.col("started_at")) & self._among("agent_slug", self.agents) & self._among("engineer_email", self.engineers) & self._among("repo_id", self.repos) & self._among("model_slug", self.models)
        found = T.sessions.where(ok)
        if not self.search:
            return found
        like = "%" + self.search.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        hit = T.prompts.where(F.col("prompt_text").ilike(like)).select(F.col("session_id").alias("id")).distinct().withColumn("__hit", F.lit(True))
        named = T.repositories.select(F.col("id").alias("repo_id"), F.col("name").alias("__name"))
        joined = found.join(named, "repo_id", "left").join(hit, "id", "left")
        texts = [c for c in ("id", "agent_slug", "model_slug", "branch", "engineer_email", "engineer_name", "__name") if c in joined.columns]
        met = reduce(or_, [F.coalesce(F.col(c).ilike(like), F.lit(False)) for c in texts])
        return joined.where(met | F.col("__hit")).select(*T.sessions.columns)


def active_repos(T: Tables) -> DataFrame:
    """(id): repositories with an event other than a misfire, a session, or a commit with attributed lines."""
    of_commits = T.commit_sessions.where("lines_attributed > 0").join(T.commits.select(F.col("id").alias("commit_id"), "repo_id"), "commit_id").select("repo_id")
    seen = T.events.where("event_type <> 'hook_misfire'").select("repo_id").unionByName(T.sessions.select("repo_id")).unionByName(of_commits).distinct()
    return T.repositories.join(seen, T.repositories["id"] == seen["repo_id"], "left_semi").select("id")


def filter_options(T: Tables) -> DataFrame:
    """(kind, value): what there is to choose from."""
    one = lambda df, kind, value: df.select(F.lit(kind).alias("kind"), value.alias("value")).where("value is not null")
    agents = one(T.sessions, "agent", F.col("agent_slug")).unionByName(one(T.events, "agent", F.col("agent_slug")))
    models = one(T.sessions, "model", F.col("model_slug")).unionByName(one(T.events, "model", F.get_json_object("payload", "$.model")))
    repos, people = one(active_repos(T), "repo", F.col("id")), one(T.sessions, "engineer", F.col("engineer_email"))
    return agents.unionByName(models).unionByName(repos).unionByName(people).distinct()
