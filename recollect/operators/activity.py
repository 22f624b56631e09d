"""Activity: gap-discounted minutes, timesheets, timelines, counters of sessions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import project_name
from ..sources.scratch import spool

GAP_US, HOUR_US, DAY_US = 1_800_000_000, 3_600_000_000, 86_400_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def gaps(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pu, us): neighbouring events of each key that are over 0 and at most 30 minutes apart.

    Events are windowed by hour, so without keys this is not one task either: a
    gap within the limit begins in the same or the previous hour, whose last
    event is carried over.
    """
    e = events.select(*keys, "id", micros(F.col("created_at")).alias("us")).withColumn("hour", F.floor(F.col("us") / HOUR_US))
    carried = e.groupBy(*keys, "hour").agg(F.max("us").alias("carry")).withColumn("hour", F.col("hour") + 1)
    w = Window.partitionBy(*keys, "hour").orderBy("us", "id")
    inner = e.withColumn("pu", F.lag("us").over(w))
    out = inner.join(carried, [*keys, "hour"], "left").withColumn("pu", F.coalesce("pu", "carry"))
    return out.filter((F.col("us") > F.col("pu")) & (F.col("us") - F.col("pu") <= GAP_US)).select(*keys, "pu", "us")


def daily_minutes(events: DataFrame, keys: list[str]) -> DataFrame:
    """Minutes of each UTC day (and key): gaps are split at midnight, and floored once for each row."""
    g = gaps(events, keys).withColumn("d", F.explode(F.sequence(F.expr(f"pu div {DAY_US}"), F.expr(f"us div {DAY_US}"))))
    part = F.least("us", (F.col("d") + 1) * DAY_US) - F.greatest("pu", F.col("d") * DAY_US)
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("d").cast("int")), "yyyy-MM-dd").alias("day")
    return g.groupBy(*keys, "d").agg(F.floor(F.sum(part) / 60_000_000).cast("long").alias("minutes")).select(*keys, day, "minutes")


def total_minutes(events: DataFrame, keys: list[str]) -> DataFrame:
    return gaps(events, keys).groupBy(*keys).agg(F.floor(F.sum(F.col("us") - F.col("pu")) / 60_000_000).cast("long").alias("minutes"))


def in_range(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.filter(F.expr(f"created_at >= TIMESTAMP_NTZ '{start}' AND created_at < TIMESTAMP_NTZ '{end}'"))


def activity_events(tools: DataFrame, prompts: DataFrame) -> DataFrame:
    """Tool calls and prompts as one stream of (session_id, created_at, kind, id)."""
    cols = ["session_id", "created_at", "id"]
    return tools.select(*cols, F.lit("tool").alias("kind")).unionByName(prompts.filter("deleted_at IS NULL").select(*cols, F.lit("prompt").alias("kind")))


def sessions_in_range(sessions: DataFrame, events: DataFrame, start: str, end: str) -> DataFrame:
    return sessions.join(in_range(events, start, end).select(F.col("session_id").alias("id")), "id", "left_semi")


def timesheet(sessions: DataFrame, events: DataFrame, start: str, end: str, project: str | None = None) -> DataFrame:
    """(session_id, project, day, minutes) for sessions with an event in the range; those without a gap get their first day and 0."""
    own = sessions.select(F.col("id").alias("session_id"), "project")
    own = own.filter(F.col("project") == project) if project else own
    ev = in_range(events, start, end).join(own, "session_id", "left_semi")
    first = ev.groupBy("session_id").agg(F.date_format(F.min("created_at"), "yyyy-MM-dd").alias("first_day"))
    days = daily_minutes(ev, ["session_id"])
    return first.join(days, "session_id", "left").join(own, "session_id").select("session_id", "project", F.coalesce("day", "first_day").alias("day"), F.coalesce("minutes", F.lit(0)).cast("long").alias("minutes"))


def timeline(df: DataFrame, pivot: int, n: int) -> DataFrame:
    """Live rows of the pivot's session, at most n before and n after it."""
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    session = df.filter(F.col("id") == pivot).select("session_id").limit(1)
    rows = df.filter("deleted_at IS NULL").join(session, "session_id", "left_semi").withColumn("rn", F.row_number().over(w))
    at = rows.withColumn("at", F.max(F.when(F.col("id") == pivot, F.col("rn"))).over(Window.partitionBy("session_id")))
    return at.filter(F.col("at").isNull() | (F.abs(F.col("rn") - F.col("at")) <= n)).select("id", "session_id", (F.col("rn") - F.col("at")).cast("long").alias("step"))


def since_last_save(prompts: DataFrame, saves: DataFrame) -> DataFrame:
    """Prompts of each session after its last real save (all of them where there is none)."""
    last = saves.filter("deleted_at IS NULL AND type NOT IN ('passive', 'session')").groupBy("session_id").agg(F.max("created_at").alias("last_save"))
    j = prompts.filter("deleted_at IS NULL").join(last, "session_id", "left")
    new = F.col("last_save").isNull() | (F.col("created_at") > F.col("last_save"))
    return j.groupBy("session_id").agg(F.sum(new.cast("long")).alias("n"))


def status(last: Column, ended: Column, as_of: str) -> Column:
    idle = last < F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL '30' MINUTE")
    return F.when(ended.isNotNull(), "cerrada").when(idle, "inactiva").otherwise("activa")


def age_label(ts: Column, as_of: str) -> Column:
    m = F.floor((micros(F.expr(f"TIMESTAMP_NTZ '{as_of}'")) - micros(ts)) / 60_000_000)
    return F.when(m < 1, "ahora").when(m < 60, F.concat(m, F.lit("m"))).when(m < 1440, F.concat(F.floor(m / 60), F.lit("h"))).otherwise(F.concat(F.floor(m / 1440), F.lit("d")))


def gate_violations(tools: DataFrame, sessions: DataFrame, gated: list[str]) -> DataFrame:
    """Uses of gated tools in sessions that have not searched."""
    idle = sessions.filter("search_count = 0 AND project <> 'unknown'").select(F.col("id").alias("session_id"))
    return tools.filter(F.col("tool_name").isin(gated)).join(idle, "session_id", "left_semi")


def trailing_count(events: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Events of each key in the seconds up to and with each event."""
    us = events.withColumn("us", micros(F.col("created_at")))
    w = Window.partitionBy(*keys).orderBy("us").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return us.withColumn("in_window", F.count(F.lit(1)).over(w)).drop("us")


def report(sessions: DataFrame, events: DataFrame, observations: DataFrame, start: str, end: str, project: str | None = None) -> DataFrame:
    """(day, session_id, minutes, day_minutes, total_minutes, observations): the timesheet of a range.

    ``events`` are tool calls and prompts; those of sessions that are not listed
    (or of another project than asked) are left out.  Minutes of a day and in
    total are over all sessions together, so time that sessions share counts
    once.  A session without a gap to measure has its first day with 0
    minutes; the ids of its live observations stand on its first day.
    """
    rows = timesheet(sessions, events, start, end, project)
    own = sessions.filter(F.col("project") == project) if project else sessions
    ev = in_range(events, start, end).join(own.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    days = daily_minutes(ev, []).withColumnRenamed("minutes", "day_minutes")
    total = total_minutes(ev, []).withColumnRenamed("minutes", "total_minutes")
    first = ev.groupBy("session_id").agg(F.date_format(F.min("created_at"), "yyyy-MM-dd").alias("day"))
    notes = observations.filter("deleted_at IS NULL").groupBy("session_id").agg(F.array_sort(F.collect_list("id")).alias("observations"))
    out = rows.join(days, "day", "left").join(first.join(notes, "session_id"), ["session_id", "day"], "left").crossJoin(F.broadcast(total))  # one row
    none = F.array().cast("array<bigint>")
    return out.select("day", "session_id", "minutes", F.coalesce("day_minutes", F.lit(0)).cast("long").alias("day_minutes"), "total_minutes", F.coalesce("observations", none).alias("observations"))


def overlapping(events: DataFrame) -> DataFrame:
    """(day, own, minutes, overlap): minutes summed over sessions, minutes of all together, and whether sessions ran at once."""
    own = daily_minutes(events, ["session_id"]).groupBy("day").agg(F.sum("minutes").alias("own"))
    return own.join(daily_minutes(events, []), "day").select("day", "own", "minutes", (F.col("own") > F.col("minutes")).alias("overlap"))


def admitted(us: np.ndarray, limit: int, window: int, taken: list[int] | None = None) -> np.ndarray:
    """Which calls, in order of time, find fewer than ``limit`` admitted ones in the window before them.

    ``taken`` are the last admitted before these, and is brought up to date.
    Refused calls are passed over by a search for the first that is free again.
    """
    taken = [] if taken is None else taken
    ok, i, n = np.zeros(len(us), bool), 0, len(us) if limit > 0 else 0
    while i < n:
        if len(taken) >= limit and taken[-limit] > us[i] - window:
            i += int(np.searchsorted(us[i:], taken[-limit] + window))
            continue
        taken.append(int(us[i]))
        ok[i] = True
        i += 1
        if len(taken) > 4 * limit:
            del taken[:-limit]
    return ok


def rate_limited(events: DataFrame, keys: list[str], limit: int = 120, seconds: int = 10) -> DataFrame:
    """(id, admitted): a call is admitted when fewer than ``limit`` admitted ones lie in the trailing window; refused calls don't count.

    Whether a call counts depends on those before it, so calls of one key are
    followed in order, but after a pause as long as the window nothing is left
    to remember: calls between pauses are followed apart, in many tasks.  A
    stretch in which no window has more than ``limit`` calls is admitted whole
    without being followed; the others stream through their tasks.
    """
    window = seconds * 1_000_000
    kind = dict(events.dtypes)["id"]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: list[int] = []
        for batch in batches:
            us = batch.column("us").to_numpy()
            starts = np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False))
            ok = [admitted(us[: starts[0] if len(starts) else len(us)], limit, window, taken)]
            for a, b in zip(starts, [*starts[1:], len(us)]):
                taken = []  # a new stretch
                ok.append(admitted(us[a:b], limit, window, taken))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(ok))], ["id", "admitted"])

    # calls lie in slices of time, so a hot key is not sorted in one task: what ends a pause or fills a window lies in the slice or the one before, whose last calls are put in front
    width = max(window, HOUR_US)
    e = events.select(*keys, "id", micros(F.col("created_at")).alias("us")).withColumn("slice", F.floor(F.col("us") / width))
    newest = Window.partitionBy(*keys, "slice").orderBy(F.desc("us"), F.desc("id"))
    carried = e.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= max(limit, 1)).drop("rn").withColumn("slice", F.col("slice") + 1)
    inside = Window.partitionBy(*keys, "slice").orderBy("us", "own", "id")
    e = e.withColumn("own", F.lit(True)).unionByName(carried.withColumn("own", F.lit(False)))
    e = e.withColumns({"pu": F.lag("us").over(inside), "full": F.lag("us", limit).over(inside) if limit > 0 else F.col("us")}).filter("own").drop("own")
    first = F.col("pu").isNull() | (F.col("us") - F.col("pu") >= window)
    e = e.withColumns({"first": first, "crowded": F.coalesce(F.col("us") - F.col("full") < window, F.lit(False))}).drop("pu", "full")
    upto = Window.partitionBy(*keys, "slice").orderBy("us", "id").rowsBetween(Window.unboundedPreceding, 0)
    e = spool(e.withColumn("begun", F.max(F.when(F.col("first"), F.col("us"))).over(upto)), "calls")

    def beside(rows: DataFrame, found: DataFrame, by: list[str], how: str) -> DataFrame:
        """Rows joined with what was found of their key, which may be null."""
        named = found.select(*(F.col(c).alias(f"__{c}") for c in by), *(c for c in found.columns if c not in by))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
        return rows.join(named, same, how).drop(*(f"__{c}" for c in by))

    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = e.groupBy(*keys, "slice").agg(F.max("begun").alias("before")).withColumn("before", F.max("before").over(earlier))
    e = beside(e, slices, [*keys, "slice"], "left").withColumn("stretch", F.coalesce("begun", "before")).select(*keys, "id", "us", "first", "crowded", "stretch")
    crowds = e.filter("crowded").select(*keys, "stretch").distinct()
    calm = beside(e, crowds, [*keys, "stretch"], "left_anti").select("id", F.lit(True).alias("admitted"))
    busy = beside(e, crowds, [*keys, "stretch"], "left_semi")
    busy = busy.repartition(*keys, "stretch").sortWithinPartitions(*keys, "stretch", "us", "id").select("id", "us", "first")
    return calm.unionByName(busy.mapInArrow(follow, f"id {kind}, admitted boolean"))


def nudges(events: DataFrame, actions: int, fallback_minutes: int) -> DataFrame:
    """(session_id, id, reason) of the checks at which a session is reminded to save.

    ``events`` are (session_id, id, created_at, kind) with kind 'start',
    'save', 'action', 'check' or 'end', after which nothing is known of the
    session until it starts again.  At a check, a session that is two minutes old
    is reminded when so many actions came since the last such reminder and over
    five minutes since the last save (reason 'actions'), else when the fallback
    has passed since the last save ('time').  A session that never started is
    never reminded; its reminders depend on one another, so each is followed in
    order by one task.
    """

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        started = saved = None
        done, out = 0, []
        for number, kind, us in zip(*(pdf.sort_values(["us", "id"])[c] for c in ("id", "kind", "us"))):
            if kind == "start":
                started, saved, done = us, us, 0
            elif started is None or kind == "end":
                started = None
            elif kind == "save":
                saved = us
            elif kind == "action":
                done += 1
            elif us - started >= 120_000_000:
                if done >= actions and us - saved > 300_000_000:
                    done = 0
                    out.append((number, "actions"))
                elif us - saved > fallback_minutes * 60_000_000:
                    out.append((number, "time"))
        made = pd.DataFrame(out, columns=["id", "reason"])
        made.insert(0, "session_id", pdf["session_id"].iloc[0])
        return made

    e = events.select("session_id", "id", "kind", micros(F.col("created_at")).alias("us"))
    return e.groupBy("session_id").applyInPandas(follow, "session_id string, id bigint, reason string")


def started(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Sessions with new ones (id, project, started_at), active since their start, their projects' names normalised; an id that is there stays as it is."""
    fresh = incoming.groupBy("id").agg(F.min_by(F.struct("project", "started_at"), "started_at").alias("s")).join(current.select("id"), "id", "left_anti")
    made = fresh.select("id", project_name(F.col("s.project")).alias("project"), "s.started_at", F.col("s.started_at").alias("last_activity_at"))
    return current.unionByName(made, allowMissingColumns=True)


def ended(sessions: DataFrame, ends: DataFrame) -> DataFrame:
    """Sessions after end events (session_id, created_at, summary): the last end, and the last summary that is not empty."""
    said = F.nullif(F.col("summary"), F.lit(""))
    last = ends.groupBy("session_id").agg(F.max("created_at").alias("__end"), F.max_by(said, F.when(said.isNotNull(), F.col("created_at"))).alias("__said"))
    j = sessions.join(last.withColumnRenamed("session_id", "id"), "id", "left")
    return j.withColumn("ended_at", F.coalesce("__end", "ended_at")).withColumn("summary", F.coalesce("__said", "summary")).drop("__end", "__said")


def with_calls(usage: DataFrame, calls: DataFrame, at: Column, after: Column) -> DataFrame:
    """Tool usage with calls (session_id, project, tool_name, n) appended at a time, numbered from ``after`` on in the order of ``n``; every call is a row."""
    new = calls.select((after + F.col("n")).cast("bigint").alias("id"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("session_id", "project", "tool_name")), at.alias("created_at"))
    return usage.unionByName(new)


def valid_prompts(prompts: DataFrame) -> DataFrame:
    """Prompts that are kept: those without a text or a project are passed over."""
    return prompts.filter("content <> '' AND project <> ''")
