"""URL filters by a temporal list join, in DataFrame functions only.

A list is a table of dated events: (list, kind, pattern, action, at), where ``add`` puts an entry on
a list and ``remove`` takes it off. Events become validity intervals: an entry holds from its ``add``
up to the pattern's next event. An as-of join then judges every capture by the entries that were
active when it was fetched.

Kinds: ``host`` (that host), ``domain`` (the host or any host below it), ``prefix`` (a host and the
leading segments of a path: ``host/a/b``).

The join runs on distinct hosts: a host's name and parents are joined with the entries once, which
gives a host its intervals; captures then meet their host's intervals and keep those that hold at
their time. The number of captures of a host never multiplies with its entries in a shuffle. The
hosts' table is broadcast after its size is checked; else AQE may split the captures of a hot host.

Defined results: a null or unparsable URL has a null host and matches nothing; a null fetch time is
in no interval; at one instant ``remove`` beats ``add``, and events of equal instants and actions
count once; events with a null pattern, kind or time, or an unknown action, are ignored; hosts
compare in lower case without port and trailing dot; repeated captures are judged each; columns
named like the results are replaced, others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.common import save

URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)"
#: Rows of the hosts' table that are broadcast, and entries they may hold together.
BROADCAST_ENTRIES = 200_000


def host_of(url: Column) -> Column:
    host = F.rtrim(F.lower(F.regexp_extract(url, URL, 1)), F.lit("."))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, URL, 2)


def validity(events: DataFrame) -> DataFrame:
    """(list, kind, pattern, since, until): until is null while the entry holds on."""
    fine = events.where("pattern is not null and kind is not null and at is not null and action in ('add', 'remove')")
    fine = fine.select("list", "kind", F.lower("pattern").alias("pattern"), "action", "at").distinct()
    order = Window.partitionBy("list", "kind", "pattern").orderBy("at", "action")
    held = fine.withColumn("until", F.lead("at").over(order)).where("action = 'add'")
    return held.where("until is null or until > at").select("list", "kind", "pattern", F.col("at").alias("since"), "until")


def entries_of_hosts(hosts: DataFrame, intervals: DataFrame) -> DataFrame:
    """(host, entries): the intervals of each host (distinct ``hosts``: host)."""
    labels = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = hosts.select("host", F.explode(names).alias("name"))
    slash = F.instr("pattern", "/")
    entry = intervals.withColumn("name", F.when(F.col("kind") == "prefix", F.substring_index("pattern", "/", 1)).otherwise(F.col("pattern")))
    entry = entry.withColumn("path", F.when((F.col("kind") == "prefix") & (slash > 0), F.rtrim(F.expr("substring(pattern, instr(pattern, '/'))"), F.lit("/"))).otherwise(""))
    met = named.join(entry, "name").where((F.col("kind") == "domain") | (F.col("name") == F.col("host")))
    return met.groupBy("host").agg(F.collect_list(F.struct("list", "kind", "pattern", "path", "since", "until")).alias("entries"))


def judge(captures: DataFrame, events: DataFrame, url: str = "url", fetched_at: str = "fetched_at", limit: int = BROADCAST_ENTRIES) -> DataFrame:
    """``captures`` with host, n_active (entries that match and were active), blocked, and entry: the
    most specific of them (longest pattern, then kind, pattern and list)."""
    added = ("host", "n_active", "blocked", "entry")
    rows = captures.select(*[F.col(f"`{c}`") for c in captures.columns if c not in added]).withColumn("host", host_of(F.col(url)))
    hosts = save(rows.where("host is not null").select("host").distinct(), "url-hosts")
    found = save(entries_of_hosts(hosts, validity(events)), "url-entries")
    held = found.agg(F.sum(F.size("entries"))).first()[0] or 0
    found = found.select(F.col("host").alias("__host"), F.col("entries").alias("__entries"))
    joined = rows.join(F.broadcast(found) if held <= limit else found, rows.host == F.col("__host"), "left")
    at, path = F.col(fetched_at), path_of(F.col(url))
    matches = lambda e: (
        (e.since <= at) & (e.until.isNull() | (at < e.until)) & ((e.path == "") | (path == e.path) | F.startswith(path, F.concat(e.path, F.lit("/"))))
    )
    active = F.coalesce(F.filter("__entries", matches), F.slice("__entries", 1, 0), F.array().cast(found.schema["__entries"].dataType))
    rank = F.transform("__active", lambda e: F.struct(-F.length(e.pattern), e.kind, e.pattern, e.list))
    judged = joined.withColumn("__active", active).withColumn("__first", F.array_min(rank))
    entry = F.when(F.size("__active") > 0, F.concat_ws(":", "__first.list", "__first.kind", "__first.pattern"))
    return judged.withColumns({"n_active": F.size("__active").cast("long"), "blocked": F.size("__active") > 0, "entry": entry}).drop("__host", "__entries", "__active", "__first")
