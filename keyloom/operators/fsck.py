"""Integrity check of a committed table against its listing."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import INDEX, Connection, Head
from ..sources.store import Lock, Store
from . import views


@dataclass
class Report:
    committed: bool
    orphans: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    unmanifested: list[int] = field(default_factory=list)
    #: How many keys of the index have no whole row, and all of them (column key), read anew from the commit.
    n_lost: int = 0
    lost: DataFrame | None = None
    deleted: list[str] = field(default_factory=list)

    def __bool__(self) -> bool:
        return not (self.orphans or self.missing or self.unmanifested or self.n_lost)

    @property
    def lost_keys(self) -> list[str]:
        """All lost keys in order, brought to the driver; use `lost` where there may be very many."""
        return sorted(x.key for x in self.lost.collect()) if self.n_lost else []


def fsck(spark: SparkSession, conn: Connection | dict | str, delete_orphans: bool = False, min_age: float = 24 * 3600, check_rows: bool = False, lock_timeout: float = 300) -> Report:
    """Compares what is stored with what the commit names; orphans of some age can be swept, under the lock."""
    store = Store(spark, Connection.of(conn))
    lock = Lock(store, lock_timeout) if delete_orphans else None
    try:
        found = store.read("HEAD.json")
        head = Head.of(found) if found else Head()
        listed = [(f"groups/{g}/{c}", at) for g, _ in store.list("groups") if g.startswith("gen=") for c, at in store.list(f"groups/{g}") if c.startswith("gid=")]
        listed += [(f"index/{c}", at) for c, at in store.list("index")]
        named = [f"groups/gen={gen}/gid={g}" for g, gen in head.manifest.items()] + ([f"index/{head.commit}"] if head.commit else [])
        listing = spark.createDataFrame(listed, "child string, at long")
        expected = spark.createDataFrame([(x,) for x in named], "child string")
        orphans, missing = views.fsck(expected, listing)
        old = {x.child: x.at for x in orphans.collect()}
        report = Report(found is not None, sorted(old), sorted(x.child for x in missing.collect()))
        if head.commit and store.exists(f"index/{head.commit}"):
            index = spark.read.schema(INDEX).parquet(store.path(f"index/{head.commit}"))
            gids = spark.createDataFrame([(g,) for g in head.manifest], "gid int")
            report.unmanifested = sorted(x.gid for x in views.unmanifested(index, gids).collect())
            if check_rows:
                there = [f"groups/gen={gen}/gid={g}" for g, gen in head.manifest.items() if f"groups/gen={gen}/gid={g}" not in set(report.missing)]
                rows = spark.read.schema("key string, ts long, value binary").parquet(*map(store.path, there)) if there else spark.createDataFrame([], "key string, ts long, value binary")
                whole = rows.select("key", F.octet_length("value").cast("long").alias("length"))
                report.lost = index.join(whole, ["key", "length"], "left_anti").select("key")
                report.n_lost = report.lost.count()
        if delete_orphans:
            for child in sorted(old):
                if time.time() - old[child] >= min_age:
                    lock.verify()
                    store.delete(child)
                    report.deleted.append(child)
        return report
    finally:
        if lock:
            lock.release()
