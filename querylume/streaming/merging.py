"""Merging of the parts that micro-batches leave, and removal of what was replaced.

Parts have levels. When a day of a table has FAN parts of one level, they become one of the
next, so a row is rewritten once per level, a logarithmic number of times, and a day never
has more than FAN - 1 parts of a level. Only the list of commits says which parts count, so
merging runs beside the ingest, its readers and retention: a merge whose parts changed
meanwhile is dropped, and what it wrote is removed later.
"""

import time
from collections import defaultdict
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from querylume.sources.files import balanced, delete_folder
from querylume.streaming.commits import SNAPSHOT_EVERY, Part
from querylume.streaming.ids import blocks_for, day_blocks, filters
from querylume.streaming.sinks import part_name, write_part
from querylume.streaming.store import WITHOUT_DAY, LogStore

FAN = 8
TABLES = ("main", "archive", "anomalies", "rejected", "live/hit_rate")


@dataclass
class Merge:
    """Parts of one day of a table that become one; with the filters of their ids."""

    parts: list
    level: int
    made: list = field(default_factory=list)

    def into(self, part):
        """The part they become, its rows being in ``part``."""
        return replace(
            part, level=self.level, state=self.parts[0].state,
            first=min(p.first for p in self.parts), last=max(p.last for p in self.parts))


def planned(parts, through: int, fan=FAN) -> list:
    """The merges due among the parts of one table, of batches up to ``through``: from the
    lowest level with ``fan`` parts of a day, and on through the levels that these fill."""
    groups = defaultdict(lambda: defaultdict(list))
    for p in parts:
        if p.last <= through and p.state != "gone":
            groups[p.day, p.state][p.level].append(p)
    merges = []
    for _, levels in sorted(groups.items()):
        level = min((k for k, held in levels.items() if len(held) >= fan), default=None)
        if level is None:
            continue
        taken = []
        while len(levels[level]) + bool(taken) >= fan:
            taken, level = taken + levels[level], level + 1
        merges.append(Merge(taken, level))
    return merges


def _merged_rows(df: DataFrame, table: str) -> DataFrame:
    if table == "live/hit_rate":
        df = df.groupBy("day", "bucket").agg(F.sum("hits").alias("hits"), F.sum("queries").alias("queries"))
    return balanced(df, table not in WITHOUT_DAY)


def _write_merged(spark, store, table, merges):
    """One job writes all merges of a table."""
    rows = store.read_parts(spark, table, [p for m in merges for p in m.parts])
    written = {p.day: p for p in write_part(_merged_rows(rows, table), store, Part(table, part_name("m")))}
    for m in merges:
        day = m.parts[0].day
        m.made = [m.into(written[day])] if day in written else []


def _write_filters(spark, store, live, merges):
    """Filters for the merged parts that take in parts with a filter, in place of theirs."""
    filtered = {(p.name, p.day): p for p in live.of("ids")}
    held = [(m, [filtered[p.name, p.day] for p in m.parts if (p.name, p.day) in filtered]) for m in merges]
    held = [(m, old) for m, old in held if old]
    if not held:
        return
    rows = store.read_parts(spark, "main", [p for m, _ in held for p in m.made]).select("day", "query_id")
    known = {r["day"]: r["n"] for r in rows.groupBy("day").agg(F.count("query_id").alias("n")).collect()}
    part = Part("ids", held[0][0].made[0].name)
    written = {p.day: p for p in write_part(filters(rows, day_blocks(spark, known)), store, part)}
    for m, old in held:
        new = written.get(m.parts[0].day)
        if new is not None:
            m.made.append(replace(m.into(new), blocks=blocks_for(known[new.date]), state="done"))
        m.parts = m.parts + old


def compact(spark, store: LogStore, through: int, tables=TABLES, days=None, fan=FAN) -> int:
    """Merge parts of batches up to ``through``, which the checkpoint no longer replays;
    returns how many parts went into others. Rows do not change, not even their
    ``batch_id``; of buckets the sums stay. Without enough new parts nothing is written.
    May run next to a stream into the same store, refreshes and retention: a merge of parts
    that these have changed meanwhile is dropped.
    """
    count = 0
    for table in tables:
        live = store.live(spark)
        merges = planned(live.of(table, None if table in WITHOUT_DAY else days), through, fan)
        if not merges:
            continue
        _write_merged(spark, store, table, merges)
        if table == "main":
            _write_filters(spark, store, live, merges)
        kept = []

        def change(now):
            kept[:] = [m for m in merges if all(now.parts.get(p.folder) == p for p in m.parts)]
            return ([p for m in kept for p in m.made], [p for m in kept for p in m.parts], None) if kept else None

        store.commit(spark, change)
        count += sum(len(m.parts) for m in kept)
    return count


def vacuum(spark, store: LogStore, older_than=86_400) -> list:
    """Delete folders that no commit lists any more (or ever did) and that were last written
    more than ``older_than`` seconds ago, longer than any writer or reader takes; returns
    them. Old commits that a newer whole one replaces go too."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    live = store.live(spark)
    listed = {p.folder for p in live.parts.values()}
    before = (time.time() - older_than) * 1000
    tables = [*TABLES, "ids", "distinct"] + sorted({p.table for p in live.parts.values() if p.table.startswith("summaries/")})
    gone = []
    for table in dict.fromkeys(tables):
        top = jvm.org.apache.hadoop.fs.Path(store.path(table))
        files = top.getFileSystem(conf)
        for part in files.listStatus(top) if files.exists(top) else []:
            name = part.getPath().getName()
            below = [part] if table in WITHOUT_DAY else [
                s for s in files.listStatus(part.getPath()) if s.isDirectory()]
            for folder in below:
                day = "" if table in WITHOUT_DAY else "/" + folder.getPath().getName()
                if f"{table}/{name}{day}" not in listed and folder.getModificationTime() <= before:
                    gone.append(f"{table}/{name}{day}")
    for folder in gone:
        delete_folder(spark, f"{store.root}/{folder}")
    start = live.version // SNAPSHOT_EVERY * SNAPSHOT_EVERY
    log = jvm.org.apache.hadoop.fs.Path(store.path("_commits"))
    files = log.getFileSystem(conf)
    for entry in files.listStatus(log) if files.exists(log) else []:
        name = entry.getPath().getName()
        if name.endswith(".json") and int(name.removesuffix(".json")) < start and (
                entry.getModificationTime() <= before):
            files.delete(entry.getPath(), False)
    return sorted(gone)
