"""Every decision of reading and synchronising, as functions from DataFrames to DataFrames.

Shapes: local (key, ts, ...), index (key, ts, ...), written (key), deletes (key),
committed rows (key, ts, value, ...). A key is in `local` once, in `index` once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grouping import group_column, packed_size


def without(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys.select("key"), "key", "left_anti")


def stale(local_ts: Column, remote_ts: Column) -> Column:
    """Whether the committed value must be fetched; a local timestamp 0 counts as none."""
    return remote_ts.isNotNull() & (local_ts.isNull() | (local_ts == 0) | (remote_ts > local_ts))


def _with_remote(local: DataFrame, index: DataFrame) -> DataFrame:
    return local.join(index.select("key", F.col("ts").alias("remote_ts")), "key", "left")


def changelog(local: DataFrame, index: DataFrame, written: DataFrame, now: Column | int | None = None) -> DataFrame:
    """key, local_ts, remote_ts (null: not committed) of what a push would write.

    A row is newer than the index, absent from it, or journaled. A journaled row
    that is not newer is restamped past the committed one (and to now, if given).
    """
    both = _with_remote(local, index).join(written.select("key", F.lit(True).alias("w")), "key", "left")
    due = F.col("remote_ts").isNull() | (F.col("ts") > F.col("remote_ts")) | F.col("w").isNotNull()
    after = F.col("remote_ts") + 1
    restamped = after if now is None else F.greatest(F.lit(now) if isinstance(now, int) else now, after)
    ts = F.when(F.col("w").isNotNull() & (F.col("ts") <= F.col("remote_ts")), restamped).otherwise(F.col("ts"))
    return both.where(due).select("key", ts.alias("local_ts"), "remote_ts")


def readable_changes(changes: DataFrame) -> DataFrame:
    """The change log with times instead of integers."""
    return changes.select("key", F.timestamp_micros("remote_ts").alias("remote_timestamp"), F.timestamp_micros("local_ts").alias("local_timestamp"))


def dropped_writes(written: DataFrame, local: DataFrame) -> DataFrame:
    """Journaled keys whose value is gone."""
    return without(written.select("key"), local)


def live_keys(local: DataFrame, index: DataFrame, deletes: DataFrame) -> DataFrame:
    return without(local.select("key").union(index.select("key")).distinct(), deletes)


def fetch_keys(local: DataFrame, index: DataFrame, written: DataFrame, deletes: DataFrame) -> DataFrame:
    """key and gid of committed rows that are newer than the local ones, or absent locally."""
    both = index.join(local.select("key", F.col("ts").alias("local_ts")), "key", "left")
    return without(without(both.where(stale(F.col("local_ts"), F.col("ts"))), written), deletes).select("key", "gid")


def fetch_plan(local: DataFrame, index: DataFrame, written: DataFrame, deletes: DataFrame, groups: int) -> DataFrame:
    """gid and n_keys to fetch."""
    keyed = index.select("key", "ts", group_column("key", groups).alias("gid"))
    return fetch_keys(local, keyed, written, deletes).groupBy("gid").agg(F.count("*").alias("n_keys"))


def due_rows(segments: DataFrame, index: DataFrame) -> DataFrame:
    """fetch_keys() with the index's length, of local records, one for each key."""
    both = index.select("key", "ts", "gid", "length").join(segments.select("key", "op", F.col("ts").alias("local_ts")), "key", "left")
    due = F.col("op").isNull() | ((F.col("op") == "C") & stale(F.col("local_ts"), F.col("ts")))
    return both.where(F.col("ts").isNotNull() & due).select("key", "gid", "length")


def removable(asked: DataFrame, ops: DataFrame, index: DataFrame) -> DataFrame:
    """key and known (committed, or null) of the keys asked for that are live; ops: key and op of the local records."""
    known = index.select("key", F.lit(True).alias("known"))
    both = asked.join(known, "key", "left").join(ops, "key", "left")
    return both.where(F.col("op").isin("W", "C") | (F.col("op").isNull() & F.col("known"))).select("key", "known")


def own_rows(local: DataFrame, index: DataFrame, written: DataFrame, deletes: DataFrame) -> DataFrame:
    """The local rows that hold: pending writes, and copies that are not staler than the committed row."""
    mine = local.join(written.select("key", F.lit(True).alias("w")), "key", "left")
    mine = without(mine.join(index.select("key", F.col("ts").alias("remote_ts")), "key", "left"), deletes)
    return mine.where(F.col("w").isNotNull() | ~F.coalesce(stale(F.col("ts"), F.col("remote_ts")), F.lit(False))).select("key", "ts", "value")


def merged_view(committed: DataFrame, local: DataFrame, written: DataFrame, deletes: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The live rows (key, ts, value): a pending write wins, then the newer of local and committed, without pending deletes.

    A union of two arms, so that conditions on keys reach the scans of both; the
    committed arm is joined with the local keys alone.
    """
    own = own_rows(local, committed.select("key", "ts") if index is None else index, written, deletes)
    hidden = own.select("key").union(deletes.select("key"))
    return without(committed.select("key", "ts", "value"), hidden).union(own)


def live_view(committed: DataFrame, segments: DataFrame, index: DataFrame) -> DataFrame:
    """merged_view() of local records (key, op, ts, value), one for each key, whose op tells pending writes (W), deletes (D) and copies (C)."""
    marked = segments.join(index.select("key", F.col("ts").alias("remote_ts")), "key", "left")
    own = (F.col("op") == "W") | ((F.col("op") == "C") & ~F.coalesce(stale(F.col("ts"), F.col("remote_ts")), F.lit(False)))
    hidden = marked.where(own | (F.col("op") == "D")).select("key")
    return without(committed.select("key", "ts", "value"), hidden).union(marked.where(own).select("key", "ts", "value"))


def bulk_get(requested: DataFrame, rows: DataFrame, default: Column | None = None) -> DataFrame:
    """A row for every request (pos, key), in request order, with the default where there is none."""
    found = requested.join(rows.select("key", "value", F.lit(True).alias("found")), "key", "left")
    value = F.col("value") if default is None else F.when(F.col("found").isNotNull(), F.col("value")).otherwise(default)
    return found.select("pos", "key", value.alias("value")).orderBy("pos")


def affected_groups(changes: DataFrame, deletes: DataFrame, groups: int) -> DataFrame:
    return changes.select("key").union(deletes.select("key")).select(group_column("key", groups).alias("gid")).distinct()


def repack(committed: DataFrame, writes: DataFrame, deletes: DataFrame, groups: int) -> DataFrame:
    """All members (key, ts, value, gid) of the groups that a push touches."""
    touched = affected_groups(writes, deletes, groups)
    old = committed.select("key", "ts", "value", group_column("key", groups).alias("gid")).join(F.broadcast(touched), "gid", "left_semi")
    new = writes.select("key", "ts", "value", group_column("key", groups).alias("gid"))
    return without(without(old, writes), deletes).select(new.columns).union(new)


def group_sizes(rows: DataFrame, groups: int) -> DataFrame:
    """gid, packed bytes and members."""
    size = F.sum(packed_size(F.col("key"), F.col("value"))) + 4
    return rows.groupBy(group_column("key", groups).alias("gid")).agg(size.alias("bytes"), F.count("*").alias("n"))


def manifest(old: DataFrame, repacked: DataFrame, touched: DataFrame) -> DataFrame:
    """gid and whether its live generation is the old or the new one; emptied groups leave."""
    kept = old.join(touched, "gid", "left_anti").select("gid", F.lit("old").alias("gen"))
    return kept.union(repacked.select("gid").distinct().select("gid", F.lit("new").alias("gen")))


def emptied_groups(repacked: DataFrame, touched: DataFrame) -> DataFrame:
    return touched.join(repacked, "gid", "left_anti")


def next_index(index: DataFrame, repacked: DataFrame, touched: DataFrame) -> DataFrame:
    """The index after a push: untouched entries, and those of the repacked groups."""
    new = repacked.select("key", "ts", "gid", F.octet_length("value").cast("long").alias("length"))
    return index.join(F.broadcast(touched), "gid", "left_anti").select(new.columns).union(new)


def local_changes(segments: DataFrame, index: DataFrame, now: int, group: Column) -> DataFrame:
    """key, op, ts, value, gid, late, was, due of all local records, found by one join.

    due: a push applies the record, as changelog() has it, with deletes. late: the
    write was not newer than the committed row and has got a new time. was: length
    of the committed value, null without one.
    """
    both = segments.join(index.select("key", F.col("ts").alias("remote_ts"), F.col("length").alias("was")), "key", "left")
    written = F.col("op") == "W"
    newer = F.col("remote_ts").isNull() | (F.col("ts") > F.col("remote_ts"))
    late = written & F.coalesce(F.col("ts") <= F.col("remote_ts"), F.lit(False))
    ts = F.when(late, F.greatest(F.lit(now), F.col("remote_ts") + 1)).otherwise(F.col("ts"))
    due = written | (F.col("op") == "D") | ((F.col("op") == "C") & newer)
    return both.select("key", "op", ts.cast("long").alias("ts"), "value", group.alias("gid"), late.alias("late"), "was", F.coalesce(due, F.lit(False)).alias("due"))


def packed_sizes(index: DataFrame, pending: DataFrame) -> DataFrame:
    """gid, packed bytes, members and late writes of the groups that a push touches, as they will be.

    What the index holds of a group, without what the changes replace (was), and with
    what they write; of committed rows only the lengths are read, and nothing is joined
    but sums of groups.
    """
    size = lambda length: F.lit(13) + F.octet_length("key") + length
    new = F.when(F.col("op") != "D", size(F.octet_length("value").cast("long")))
    old = F.when(F.col("was").isNotNull(), size(F.col("was")))
    changes = pending.groupBy("gid").agg(F.sum(F.col("late").cast("long")).alias("late"), F.sum(new).alias("more"), F.count(new).alias("n_more"), F.sum(old).alias("less"), F.count(old).alias("n_less"))
    held = index.groupBy("gid").agg(F.sum(size(F.col("length"))).alias("held"), F.count("*").alias("n_held"))
    none = lambda c: F.coalesce(c, F.lit(0))
    n = none("n_held") - F.col("n_less") + F.col("n_more")
    return changes.join(held, "gid", "left").select("gid", F.when(n > 0, none("held") - none("less") + none("more") + 4).otherwise(0).alias("bytes"), n.alias("n"), "late")


def lost_keys(index: DataFrame, committed: DataFrame) -> DataFrame:
    """Index entries without data."""
    return without(index.select("key"), committed)


def reconcile(local: DataFrame, index: DataFrame, pending: DataFrame, before: int | None) -> DataFrame:
    """Local keys that another writer deleted: not in the fresh index, not pending, not newer than the last ingest."""
    gone = without(without(local, index), pending)
    return gone.where(F.lit(False) if before is None else F.col("ts") <= before).select("key")


def reconciled(segments: DataFrame, index: DataFrame, before: int) -> DataFrame:
    """Local records, one for each key, with gone: whether reconcile() names the key."""
    there = index.select("key", F.lit(True).alias("there"))
    gone = (F.col("op") == "C") & F.col("there").isNull() & (F.col("ts") <= before)
    return segments.join(there, "key", "left").select(*segments.columns, F.coalesce(gone, F.lit(False)).alias("gone"))


def pruned(local: DataFrame, written: DataFrame, before: int) -> DataFrame:
    """What a prune keeps: rows from the time on, and pending writes."""
    flagged = local.join(written.select("key", F.lit(True).alias("w")), "key", "left")
    return flagged.where((F.col("ts") >= before) | F.col("w").isNotNull()).drop("w")


def clear_pending(index: DataFrame) -> DataFrame:
    return index.select("key", F.lit("D").alias("op"))


def latest_wins(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """For each key the value of the last row in a total order."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.max_by(value, F.struct(*order)).alias(value))


def fsck(expected: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orphans (listed, not expected) and missing (expected, not listed), by child."""
    return listing.join(expected.select("child"), "child", "left_anti"), expected.join(listing.select("child"), "child", "left_anti")


def unmanifested(index: DataFrame, manifest_gids: DataFrame) -> DataFrame:
    """Groups that the index names and the manifest doesn't."""
    return index.select("gid").distinct().join(manifest_gids, "gid", "left_anti")
