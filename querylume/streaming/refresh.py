"""Refresh of the stored summaries by what changed since.

A summary holds additive counts per day. The commits say which parts of the main table a
summary has not counted yet, and which counted ones were replaced since. A refresh counts
the rows of these parts alone, those of replaced ones with a minus, adds them to the stored
counts of their days, and switches in the sums together with the note that the parts are
counted. So no row is counted twice, whatever is repeated, and no other row is read.
"""

from functools import partial

from pyspark.sql import DataFrame, functions as F

from querylume.jobs import run_together
from querylume.plans.distinct import KEYS, merged, query_sets
from querylume.plans.views import AMOUNTS, SUMMARIES
from querylume.sources.files import balanced
from querylume.streaming.commits import Part, marked
from querylume.streaming.sinks import part_name, write_part
from querylume.streaming.store import LogStore, added_up, summary_table


def _pending(live, days=None):
    return [p for p in live.of("main", days, gone=True) if p.state != "done"]


def days_to_refresh(spark, store: LogStore) -> list:
    """Days that got rows since they were last refreshed, oldest first. From the list of
    commits: no table is read."""
    return sorted({p.date for p in _pending(store.live(spark))})


def _signed(counts: DataFrame, name: str, sign: int) -> DataFrame:
    return counts.withColumns({c: F.col(c) * sign for c in AMOUNTS[name]})


def changes(spark, store: LogStore, name: str, parts) -> DataFrame:
    """What the rows of some parts add to a summary, and take off it where a part is gone."""
    counts = SUMMARIES[name][0]
    out = None
    for sign, state in ((1, "new"), (-1, "gone")):
        some = [p for p in parts if p.state == state]
        if some:
            one = _signed(counts(store.read_parts(spark, "main", some)), name, sign)
            out = one if out is None else out.unionByName(one)
    return out


def _refreshed(spark, store, live, parts, name, new_name):
    days = {p.date for p in parts}
    old = live.of(summary_table(name), days)
    change = changes(spark, store, name, parts)
    total = change.unionByName(store.read_parts(spark, summary_table(name), old)) if old else change
    part = Part(summary_table(name), new_name, first=-1, last=-1)
    return write_part(balanced(added_up(total, name)), store, part), old


def _refreshed_sets(spark, store, live, parts, new_name):
    """The sets of distinct queries of the parts' days: merged with those of the rows that
    came since. Ids cannot be taken out of a set, so a day some of whose counted rows were
    replaced is read again as a whole."""
    again = {p.date for p in parts if p.state == "gone"}
    days = {p.date for p in parts}
    held = live.of("main", again)
    old = live.of("distinct", days)
    rows = store.read_parts(spark, "main", held + [p for p in parts if p.date not in again])
    sets = query_sets(rows)
    kept = [p for p in old if p.date not in again]
    if kept:
        sets = merged(sets.unionByName(store.read_parts(spark, "distinct", kept)), KEYS)
    part = Part("distinct", new_name, first=-1, last=-1)
    return write_part(balanced(sets), store, part), old, held


def refresh_views(spark, store: LogStore, days=None, expired=()) -> list:
    """Bring the summaries of ``days`` (those that need it, for ``None``) up to date, but not
    of ``expired`` ones: what is left of such a day is not the day. Returns the days.

    Reads the rows that came since, and the stored counts of their days. May run next to a
    stream into the same store: when that, or retention, changed what was read, it begins
    again. A failure before the commit leaves the summaries as they were.
    """
    while True:
        live = store.live(spark)
        parts = [p for p in _pending(live, days) if p.date not in set(expired)]
        if not parts:
            return [] if days is None else sorted(set(days) - set(expired))
        name, made = part_name("r"), []

        def one(summary):
            made.append((*_refreshed(spark, store, live, parts, summary, name), []))

        run_together(spark, *[partial(one, summary) for summary in SUMMARIES],
                     lambda: made.append(_refreshed_sets(spark, store, live, parts, name)))
        old = [p for _, parts_before, _ in made for p in parts_before]
        read = [p for _, _, others in made for p in others]
        done = [False]

        def change(now):
            done[0] = all(now.parts.get(p.folder) == p for p in [*parts, *old, *read])
            if not done[0]:
                return None
            counted = marked([p for p in parts if p.state == "new"], "done")
            gone = [p for p in parts if p.state == "gone"]
            return [p for new, _, _ in made for p in new] + counted, old + gone, None

        store.commit(spark, change)
        if done[0]:
            return sorted({p.date for p in parts})
