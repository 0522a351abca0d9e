"""Queries that run a keyed table from its opening to a fresh reader, over the test tables, and their SQL.

The table holds the committed rows of plans.queries (orders whose key 10 doesn't
divide). Pending changes are writes of the keys that 21 divides, a millisecond
newer, and deletes of those that 35 (and not 21) divides.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import open_catalog
from ..operators.fsck import fsck
from ..operators.table import KeyedTable, open_table
from ..sources.session import Session
from .queries import BEFORE, GROUPS, Sides

LATER = 1000
#: Most bytes of a shuffled partition that is joined by hash.
HASHED = "16m"


class _Case:
    """A place of its own, and the rows to put there."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="tables-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
            shared = f"file://{shared}"
        # Joins whose partitions are all small hash one side instead of sorting both; larger ones are sorted, as ever.
        spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", HASHED)
        self.spark, self.sf_dir, self.place = spark, sf_dir, f"{shared.rstrip('/')}/table-{uuid.uuid4().hex}"
        sides = Sides(spark, sf_dir)
        self.rows = sides.committed
        self.deletes = sides.deletes
        self.writes = sides.all.join(sides.written, "key", "left_semi").select("key", (F.col("ts") + LATER).alias("ts"), F.concat(F.lit("w"), "key").cast("binary").alias("value"))

    def open(self, flag: str = "r", name: str = "", **options) -> KeyedTable:
        return open_table(self.spark, self.place, f"{self.place}.local/{name or uuid.uuid4().hex}", flag, **options)

    def pushed(self) -> KeyedTable:
        t = self.open("n", num_groups=GROUPS)
        t.upsert(self.rows)
        if not t.changes().push():
            raise RuntimeError("the push failed")
        return t

    def pending(self) -> KeyedTable:
        t = self.pushed()
        t.upsert(self.writes)
        t.remove(self.deletes)
        return t

    def read(self) -> DataFrame:
        """What a fresh reader sees."""
        return _text(self.open().to_df())

    def frame(self, rows: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.col("value").cast("string"))


def _push(c: _Case) -> DataFrame:
    c.pushed().close()
    return c.read()


def _pending_view(c: _Case) -> DataFrame:
    return _text(c.pending().to_df())


def _changes(c: _Case) -> DataFrame:
    return c.pending().changes().changelog()


def _push_changes(c: _Case) -> DataFrame:
    t = c.pending()
    if not t.changes().push():
        raise RuntimeError("the push failed")
    t.close()
    return c.read()


def _discard(c: _Case) -> DataFrame:
    t = c.pending()
    t.changes().discard()
    return _text(t.to_df())


def _clear(c: _Case) -> DataFrame:
    t = c.pending()
    t.clear()
    t.upsert(c.writes)
    t.changes().push()
    t.close()
    return c.read()


def _replace(c: _Case) -> DataFrame:
    c.pushed().close()
    t = c.open("n", num_groups=GROUPS)
    t.upsert(c.writes)
    t.changes().push()
    t.close()
    return c.read()


def _pull(c: _Case) -> DataFrame:
    """A reader with local copies of everything, after another writer's push."""
    t = c.pending()
    reader = c.open()
    reader.load_items()
    t.changes().push()
    t.close()
    reader.pull()
    return _text(reader.to_df())


def _offline(c: _Case) -> DataFrame:
    c.pushed().close()
    with c.open(name="copy") as reader:
        reader.load_items()
    return _text(c.open(name="copy", offline=True).to_df())


def _copy(c: _Case) -> DataFrame:
    t = c.pushed()
    t.copy_remote(f"{c.place}-copy")
    t.delete_remote()
    t.close()
    c.place += "-copy"
    return c.read()


def _map(c: _Case) -> DataFrame:
    return _text(c.pending().map(lambda k, v: (f"new_{k}", v + b"!") if int(k) % 3 == 0 else None))


def _get_items(c: _Case) -> DataFrame:
    t = c.pending()
    asked = [str(k) for k in range(40, 0, -1)]
    return c.frame([(k, v.decode()) for k, v in t.get_items(asked, b"none")], "key string, value string")


def _points(c: _Case) -> DataFrame:
    """get, get_timestamp and membership of single keys, with a new time for one."""
    t = c.pending()
    t.set_timestamp("4", BEFORE)
    found = ((str(k), t.get(str(k), b"none").decode(), t.get_timestamp(str(k), default=0), str(k) in t) for k in (4, 10, 21, 35, 70))
    return c.frame(list(found), "key string, value string, ts long, there boolean")


def _manifest(c: _Case) -> DataFrame:
    """The groups that a fresh reader's index and the stored generations hold after two pushes."""
    t = c.pending()
    t.changes().push()
    t.close()
    held = Session(c.spark, c.place).list_object_versions().where("live").select("gid")
    return c.open().index().groupBy("gid").agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).join(held, "gid")


def _lost(c: _Case) -> DataFrame:
    """Keys whose group was deleted from the store, as the integrity check tells them."""
    t = c.pushed()
    t.store.delete(f"groups/gen={t.head.manifest[3]}/gid=3")
    t.close()
    return fsck(c.spark, c.place, check_rows=True).lost


def _prune(c: _Case) -> DataFrame:
    t = c.pending()
    t.load_items()
    gone = t.prune(BEFORE)
    return c.frame([(gone, t._local().count())], "gone long, held long")


def _metadata(c: _Case) -> DataFrame:
    t = c.pushed()
    t.set_metadata({"rows": len(t)})
    t.changes().push()
    t.close()
    s = Session(c.spark, c.place)
    return c.frame([(s.get_type(), s.get_user_metadata()["rows"], s.initialized, s.writable())], "type string, n long, there boolean, writable boolean")


def _catalog(c: _Case) -> DataFrame:
    t = c.pushed()
    with open_catalog(c.spark, f"{c.place}-catalog", f"{c.place}-catalog.local", "n") as found:
        found["orders"] = c.place
        found.add(c.place, "gone")
        found.add(c.place, "described", {"owner": "x"})
        del found["gone"]
        found.changes().push()
    t.close()
    entries = open_catalog(c.spark, f"{c.place}-catalog", f"{c.place}-catalog.reader").entries()
    return entries.select("key", "entry_version", "type", "user_meta", (F.col("timestamp") == t.head.ts).alias("current"))


_CASES: dict[str, Callable[[_Case], DataFrame]] = {f"table{f.__name__}": f for f in (_push, _pending_view, _changes, _push_changes, _discard, _clear, _replace, _pull, _offline, _copy, _map, _get_items, _points, _manifest, _lost, _prune, _metadata, _catalog)}
QUERIES = {name: (lambda spark, sf_dir, f=f: f(_Case(spark, sf_dir))) for name, f in _CASES.items()}

_ROWS = f"""
WITH o AS (SELECT o_orderkey AS ok, CAST(o_orderkey AS VARCHAR) AS key, epoch_us(o_orderdate) AS ts FROM orders),
idx AS (SELECT key, ts, key AS value, ok FROM o WHERE ok % 10 <> 0),
wri AS (SELECT key, ts + {LATER} AS ts, 'w' || key AS value, ok FROM o WHERE ok % 21 = 0),
del AS (SELECT key FROM o WHERE ok % 35 = 0 AND ok % 21 <> 0),
viw AS (SELECT * FROM idx WHERE key NOT IN (SELECT key FROM wri) AND key NOT IN (SELECT key FROM del) UNION ALL SELECT * FROM wri),
gid AS (SELECT *, CAST(CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % {GROUPS} AS INTEGER) AS gid FROM viw)
"""

ORACLE_SQL = {k: _ROWS + v for k, v in {
    "table_push": "SELECT key, ts, value FROM idx",
    "table_pending_view": "SELECT key, ts, value FROM viw",
    "table_changes": "SELECT w.key, w.ts AS local_ts, i.ts AS remote_ts FROM wri w LEFT JOIN idx i USING (key)",
    "table_push_changes": "SELECT key, ts, value FROM viw",
    "table_discard": "SELECT key, ts, value FROM idx",
    "table_clear": "SELECT key, ts, value FROM wri",
    "table_replace": "SELECT key, ts, value FROM wri",
    "table_pull": "SELECT key, ts, value FROM viw",
    "table_offline": "SELECT key, ts, value FROM idx",
    "table_copy": "SELECT key, ts, value FROM idx",
    "table_map": "SELECT 'new_' || key AS key, value || '!' AS value FROM viw WHERE ok % 3 = 0",
    "table_get_items": "SELECT CAST(k AS VARCHAR) AS key, coalesce(v.value, 'none') AS value FROM range(1, 41) r(k) LEFT JOIN viw v ON v.ok = k",
    "table_points": f"SELECT CAST(k AS VARCHAR) AS key, coalesce(v.value, 'none') AS value, coalesce(CASE WHEN k = 4 THEN {BEFORE} ELSE v.ts END, 0) AS ts, v.key IS NOT NULL AS there FROM (SELECT unnest([4, 10, 21, 35, 70]) AS k) LEFT JOIN viw v ON v.ok = k",
    "table_manifest": "SELECT gid, count(*) AS n, CAST(sum(octet_length(encode(value))) AS BIGINT) AS bytes FROM gid GROUP BY gid",
    "table_lost": f"SELECT key FROM idx WHERE CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % {GROUPS} = 3",
    "table_prune": f"SELECT count(*) FILTER (ts < {BEFORE} AND key NOT IN (SELECT key FROM wri)) AS gone, count(*) FILTER (ts >= {BEFORE} OR key IN (SELECT key FROM wri)) AS held FROM viw",
    "table_metadata": "SELECT 'table' AS type, count(*) AS n, true AS there, true AS writable FROM idx",
    "table_catalog": "SELECT * FROM (VALUES ('orders', 1, 'table', NULL, true), ('described', 1, 'table', '{\"owner\": \"x\"}', true)) t(key, entry_version, type, user_meta, current)",
}.items()}
