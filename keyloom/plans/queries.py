"""Queries over the test tables, and their SQL.

The orders table gives both sides of a table, by rule: the committed index holds
keys that 10 doesn't divide, local rows those that 3 divides, stamped a
millisecond later (even keys) or earlier; 21 divides pending writes, 35 (and not
21) pending deletes. A row's value is its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grouping import group_column
from ..operators import views

GROUPS, FINE, BEFORE = 11, 997, 900_000_000_000_000


class Sides:
    """The frames of the two-sided state."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
        micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz))")
        ok = F.col("o_orderkey")
        key = ok.cast("string").alias("key")
        row = lambda ts: [key, ts.alias("ts"), ok.cast("string").cast("binary").alias("value")]
        self.all = orders.select(*row(micros))
        self.committed = orders.where(ok % 10 != 0).select(*row(micros))
        self.index = self.committed.select("key", "ts")
        self.local = orders.where(ok % 3 == 0).select(*row(micros + F.when(ok % 2 == 0, 1000).otherwise(-1000)))
        self.written = orders.where(ok % 21 == 0).select(key)
        self.deletes = orders.where((ok % 35 == 0) & (ok % 21 != 0)).select(key)
        self.pending = self.written.union(self.deletes)
        self.requested = orders.where(ok % 10 == 3).select(ok.alias("pos"), key)
        self.writes = self.local.join(self.written, "key", "left_semi")

    def view(self) -> DataFrame:
        return views.merged_view(self.committed, self.local, self.written, self.deletes)

    def keyed(self, groups: int) -> DataFrame:
        return self.index.select("key", "ts", group_column("key", groups).alias("gid"))

    def touched(self) -> DataFrame:
        return views.affected_groups(self.writes, self.deletes, FINE)

    def repacked(self) -> DataFrame:
        return views.repack(self.committed, self.writes, self.deletes, FINE)


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.col("value").cast("string"))


def _sided(f):
    return lambda spark, sf_dir: f(Sides(spark, sf_dir))


def _next_index(s: Sides) -> DataFrame:
    index = s.committed.select("key", "ts", group_column("key", FINE).alias("gid"), F.octet_length("value").cast("long").alias("length"))
    return views.next_index(index, s.repacked(), s.touched())


def _discard(s: Sides) -> DataFrame:
    """The view after all pending changes are forgotten: the journaled local rows go, deletes are taken back."""
    none = s.written.limit(0)
    return views.merged_view(s.committed, views.without(s.local, s.written), none, none).select("key", "ts")


def _fsck(s: Sides) -> tuple[DataFrame, DataFrame]:
    child = lambda df: df.select(F.concat(F.lit("c/"), "key").alias("child"))
    return views.fsck(child(s.index), child(s.local))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("user"), "ts", "event_id")
    return views.latest_wins(events, "user", ["ts", "event_id"], "event_id")


QUERIES = {
    "changelog": _sided(lambda s: views.changelog(s.local, s.index, s.written)),
    "readable_changes": _sided(lambda s: views.readable_changes(views.changelog(s.local, s.index, s.written)).select("key", F.unix_micros("remote_timestamp").alias("remote_us"), F.unix_micros("local_timestamp").alias("local_us"))),
    "reconcile": _sided(lambda s: views.reconcile(s.local, s.index, s.pending, BEFORE)),
    "live_keys": _sided(lambda s: views.live_keys(s.local, s.index, s.deletes)),
    "length": _sided(lambda s: views.live_keys(s.local, s.index, s.deletes).agg(F.count("*").alias("n"))),
    "contains": _sided(lambda s: s.requested.select("key").join(views.live_keys(s.local, s.index, s.deletes).withColumn("there", F.lit(True)), "key", "left").select("key", F.coalesce("there", F.lit(False)).alias("there"))),
    "point_get": _sided(lambda s: _text(s.view().where((F.col("key") == "42"))).select("key", "value")),
    "get_timestamp": _sided(lambda s: s.view().where(F.col("key").isin("3", "6", "7", "10")).select("key", "ts")),
    "timestamps": _sided(lambda s: s.view().select("key", "ts")),
    "merged_view": _sided(lambda s: _text(s.view())),
    "bulk_get": _sided(lambda s: _text(views.bulk_get(s.requested, s.view(), F.lit(b"none").cast("binary")))),
    "fetch_plan": _sided(lambda s: views.fetch_plan(s.local, s.index, s.written, s.deletes, GROUPS)),
    "group_sizes": _sided(lambda s: views.group_sizes(s.committed, GROUPS)),
    "affected_groups": _sided(lambda s: s.touched()),
    "repack": _sided(lambda s: _text(s.repacked())),
    "manifest": _sided(lambda s: views.manifest(s.keyed(FINE).select("gid").distinct(), s.repacked(), s.touched())),
    "emptied_groups": _sided(lambda s: views.emptied_groups(s.repacked().where("gid % 7 <> 0"), s.touched())),
    "post_push_index": _sided(_next_index),
    "lost_keys": _sided(lambda s: views.lost_keys(s.index, s.local)),
    "prune_keep": _sided(lambda s: views.pruned(s.local.select("key", "ts"), s.written, BEFORE)),
    "pending_clear": _sided(lambda s: views.clear_pending(s.index)),
    "discard_view": _sided(_discard),
    "dropped_pending": _sided(lambda s: views.dropped_writes(s.pending, s.local)),
    "fsck_orphans": _sided(lambda s: _fsck(s)[0]),
    "fsck_missing": _sided(lambda s: _fsck(s)[1]),
    "fsck_unmanifested": _sided(lambda s: views.unmanifested(s.keyed(FINE), s.touched())),
    "latest_wins": _latest,
}

_SIDES = """
WITH o AS (SELECT o_orderkey AS ok, CAST(o_orderkey AS VARCHAR) AS key, epoch_us(o_orderdate) AS ts FROM orders),
idx AS (SELECT key, ts, ok FROM o WHERE ok % 10 <> 0),
loc AS (SELECT key, ts + CASE WHEN ok % 2 = 0 THEN 1000 ELSE -1000 END AS ts, ok FROM o WHERE ok % 3 = 0),
wri AS (SELECT key, ok FROM o WHERE ok % 21 = 0),
del AS (SELECT key, ok FROM o WHERE ok % 35 = 0 AND ok % 21 <> 0),
chg AS (
  SELECT l.key, CASE WHEN w.key IS NOT NULL AND l.ts <= r.ts THEN r.ts + 1 ELSE l.ts END AS local_ts, r.ts AS remote_ts
  FROM loc l LEFT JOIN idx r USING (key) LEFT JOIN wri w USING (key)
  WHERE r.key IS NULL OR l.ts > r.ts OR w.key IS NOT NULL),
liv AS (SELECT key FROM (SELECT key FROM loc UNION SELECT key FROM idx) WHERE key NOT IN (SELECT key FROM del)),
viw AS (
  SELECT key, CASE WHEN l.key IS NOT NULL AND (w.key IS NOT NULL OR r.key IS NULL OR r.ts <= l.ts) THEN l.ts ELSE r.ts END AS ts, key AS value
  FROM loc l FULL JOIN idx r USING (key) LEFT JOIN wri w USING (key) WHERE key NOT IN (SELECT key FROM del)),
wrt AS (SELECT l.key, l.ts FROM loc l SEMI JOIN wri w ON l.key = w.key),
tch AS (SELECT DISTINCT CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % 997 AS gid FROM (SELECT key FROM wrt UNION ALL SELECT key FROM del)),
mem AS (
  SELECT key, ts, CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % 997 AS gid FROM (
    SELECT key, ts FROM idx WHERE key NOT IN (SELECT key FROM wrt) AND key NOT IN (SELECT key FROM del) UNION ALL SELECT key, ts FROM wrt)
  WHERE CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % 997 IN (SELECT gid FROM tch)),
gix AS (SELECT key, ts, CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % 997 AS gid FROM idx)
"""

ORACLE_SQL = {k: _SIDES + v for k, v in {
    "changelog": "SELECT * FROM chg",
    "readable_changes": "SELECT key, remote_ts AS remote_us, local_ts AS local_us FROM chg",
    "reconcile": f"SELECT key FROM loc WHERE key NOT IN (SELECT key FROM idx) AND key NOT IN (SELECT key FROM wri) AND key NOT IN (SELECT key FROM del) AND ts <= {BEFORE}",
    "live_keys": "SELECT key FROM liv",
    "length": "SELECT count(*) AS n FROM liv",
    "contains": "SELECT key, key IN (SELECT key FROM liv) AS there FROM o WHERE ok % 10 = 3",
    "point_get": "SELECT key, value FROM viw WHERE key = '42'",
    "get_timestamp": "SELECT key, ts FROM viw WHERE key IN ('3', '6', '7', '10')",
    "timestamps": "SELECT key, ts FROM viw",
    "merged_view": "SELECT key, ts, value FROM viw",
    "bulk_get": "SELECT o.ok AS pos, o.key, CASE WHEN v.key IS NULL THEN 'none' ELSE v.value END AS value FROM o LEFT JOIN viw v USING (key) WHERE ok % 10 = 3 ORDER BY pos",
    "fetch_plan": f"SELECT CAST(CAST('0x' || substr(md5(r.key), 1, 8) AS BIGINT) % {GROUPS} AS INTEGER) AS gid, count(*) AS n_keys FROM idx r LEFT JOIN loc l USING (key) WHERE (l.key IS NULL OR r.ts > l.ts) AND r.key NOT IN (SELECT key FROM wri) AND r.key NOT IN (SELECT key FROM del) GROUP BY 1",
    "group_sizes": f"SELECT CAST(CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % {GROUPS} AS INTEGER) AS gid, CAST(sum(13 + 2 * octet_length(encode(key))) + 4 AS BIGINT) AS bytes, count(*) AS n FROM idx GROUP BY 1",
    "affected_groups": "SELECT CAST(gid AS INTEGER) AS gid FROM tch",
    "repack": "SELECT key, ts, key AS value, CAST(gid AS INTEGER) AS gid FROM mem",
    "manifest": "SELECT DISTINCT CAST(gid AS INTEGER) AS gid, 'old' AS gen FROM gix WHERE gid NOT IN (SELECT gid FROM tch) UNION ALL SELECT DISTINCT CAST(gid AS INTEGER), 'new' FROM mem",
    "emptied_groups": "SELECT CAST(gid AS INTEGER) AS gid FROM tch WHERE gid NOT IN (SELECT gid FROM mem WHERE gid % 7 <> 0)",
    "post_push_index": "SELECT key, ts, CAST(gid AS INTEGER) AS gid, CAST(octet_length(encode(key)) AS BIGINT) AS length FROM (SELECT * FROM gix WHERE gid NOT IN (SELECT gid FROM tch) UNION ALL SELECT * FROM mem)",
    "lost_keys": "SELECT key FROM idx WHERE key NOT IN (SELECT key FROM loc)",
    "prune_keep": f"SELECT key, ts FROM loc WHERE ts >= {BEFORE} OR key IN (SELECT key FROM wri)",
    "pending_clear": "SELECT key, 'D' AS op FROM idx",
    "discard_view": "SELECT key, CASE WHEN l.key IS NOT NULL AND (r.key IS NULL OR r.ts <= l.ts) THEN l.ts ELSE r.ts END AS ts FROM (SELECT * FROM loc WHERE key NOT IN (SELECT key FROM wri)) l FULL JOIN idx r USING (key)",
    "dropped_pending": "SELECT key FROM (SELECT key FROM wri UNION ALL SELECT key FROM del) WHERE key NOT IN (SELECT key FROM loc)",
    "fsck_orphans": "SELECT 'c/' || key AS child FROM loc WHERE key NOT IN (SELECT key FROM idx)",
    "fsck_missing": "SELECT 'c/' || key AS child FROM idx WHERE key NOT IN (SELECT key FROM loc)",
    "fsck_unmanifested": "SELECT DISTINCT CAST(gid AS INTEGER) AS gid FROM gix WHERE gid NOT IN (SELECT gid FROM tch)",
}.items()} | {
    "latest_wins": "SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id",
}
