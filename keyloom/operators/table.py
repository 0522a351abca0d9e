"""A keyed table: committed snapshot, local rows and journal behind one mapping."""

from __future__ import annotations

import datetime as dt
import functools
import json
import logging
import math
import operator
import os
import pickle
import re
import time
import uuid
import warnings
import weakref
from collections.abc import Callable, Iterable, Iterator, Mapping, MutableMapping
from typing import Any

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ClosedError, CompactionError, FormatError, GroupTooLargeError, IdentityError, IntegrityError, MissingTableError, OfflineError, PushInProgressError, ReadOnlyError
from ..functions.grouping import group_column, group_of, new_generation, next_prime
from ..model import ENTRY, FORMAT_VERSION, GROUP, INDEX, LOCAL, MOST_GROUP_BYTES, RESERVED, Connection, Head, MissingObject, PushResult
from ..sources.session import Session
from ..sources.store import Lock, Store
from . import views

log = logging.getLogger(__name__)

#: Single writes that are held in memory before they go to a local segment, and local segments before they are merged.
BUFFER, SEGMENTS = 1000, 8
#: Bytes of a file that a push writes, about; a larger group is spread over several.
FILE_BYTES = 256 << 20
#: What a local folder holds; nothing else in it is ever touched.
_OWN = ("state.json", "rows", "push", "index", "index.new")
_TEMPORARY = re.compile(r"\.|state\.json\.[0-9a-f]{32}\.tmp$")
#: The codecs of values; None takes and gives bytes.
CODECS: dict[str | None, tuple[Callable, Callable]] = {
    None: (lambda x: bytes(x), lambda x: bytes(x)),
    "str": (lambda x: x.encode(), lambda x: bytes(x).decode()),
    "json": (lambda x: json.dumps(x).encode(), lambda x: json.loads(bytes(x))),
    "pickle": (pickle.dumps, lambda x: pickle.loads(bytes(x))),
}
#: Keys are all different: a dictionary of them would be built in vain.
_PLAIN_KEYS = {"parquet.enable.dictionary#key": "false"}
_MISSING = ("FILE_NOT_EXIST", "PATH_NOT_FOUND", "FileNotFoundException", "does not exist")


def now_us() -> int:
    return time.time_ns() // 1000


def _gone(e: BaseException) -> bool:
    """Whether a file that a plan names was not there."""
    return any(x in str(e) for x in _MISSING)


def _unreachable(e: BaseException) -> bool:
    """Whether a store could not be reached, as against one that answered with damage or a refusal."""
    if isinstance(e, (ConnectionError, TimeoutError)):
        return True
    cause = e.java_exception if isinstance(e, Py4JJavaError) else None
    while cause is not None:
        name = cause.getClass().getName()
        if name.startswith(("java.net.", "javax.net.", "org.apache.hadoop.net.")) or name in ("java.io.IOException", "java.io.InterruptedIOException", "java.io.EOFException") or "Timeout" in name:
            return True
        cause = cause.getCause()
    return False


def timestamp_us(x: int | str | dt.datetime | None) -> int:
    """Microseconds since 1970: an integer, an ISO-8601 text with zone, or an aware datetime."""
    if x is None:
        return now_us()
    if isinstance(x, str):
        x = dt.datetime.fromisoformat(x)
    if isinstance(x, dt.datetime):
        if x.tzinfo is None:
            raise ValueError("a time needs a zone")
        x = int((x - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(microseconds=1))
    if isinstance(x, bool) or not isinstance(x, int):
        raise TypeError("a timestamp is an integer, a text or a datetime")
    if x <= 0:
        raise ValueError("a timestamp must be positive")
    return x


def open_table(spark: SparkSession, conn: Connection | dict | str, local: str, flag: str = "r", value_serializer: str | None = None, num_groups: int | None = None, lock_timeout: float = 300, force_lock: bool = False, offline: bool | str = False, type: str = "table", grouping: str = "md5") -> KeyedTable:
    """Opens a table. flag: r reads, w and c read and write, n replaces the committed table at the next push.

    offline: True uses local state alone, 'auto' falls back to it when the store can't be reached.
    """
    if flag not in ("r", "w", "c", "n"):
        raise ValueError("flag must be r, w, c or n")
    if value_serializer not in CODECS:
        raise ValueError(f"no serializer {value_serializer!r}")
    if offline not in (False, True, "auto"):
        raise ValueError("offline must be False, True or 'auto'")
    if offline and flag != "r":
        raise ReadOnlyError("offline tables are read-only")
    conn = Connection.of(conn)
    if conn.read_only and flag != "r":
        raise ReadOnlyError("the connection is for reading")
    return _KINDS.get(type, KeyedTable)(spark, conn, local, flag, value_serializer, None if num_groups is None else next_prime(num_groups), lock_timeout, force_lock, offline, type, grouping)


class KeyedTable(MutableMapping):
    """str -> value, with timestamps. Every bulk operation is a DataFrame plan; nothing is fetched until it is asked for."""

    def __init__(self, spark, conn, local, flag, serializer, num_groups, lock_timeout, force_lock, offline, type, grouping):
        self.spark, self.conn, self.flag, self.type, self.grouping = spark, conn, flag, type, grouping
        self.encode, self.decode = CODECS[serializer]
        self.writable, self.store, self._lock = flag != "r", None, None
        self.local = Store(spark, Connection(local if "://" in local else f"file://{os.path.abspath(local)}"))
        self.offline, self._buffer, self._pushing, self._open = offline is True, {}, False, True
        self._done = weakref.finalize(self, lambda: None)
        try:
            self.store = Store(spark, conn)
        except Exception as e:
            if not (offline is True or offline == "auto" and _unreachable(e)):
                raise
            self.offline = True
        try:
            if self.writable:
                self._lock = Lock(self.store, lock_timeout, force_lock)
                self._done = weakref.finalize(self, Lock.release, self._lock)
            self._start(num_groups, offline)
        except BaseException:
            if self._lock:
                self._lock.release()
            raise

    # State

    def _start(self, num_groups: int | None, offline: bool | str) -> None:
        state = self.local.read("state.json")
        head = None
        if not self.offline:
            try:
                # Read under the lock, so that no other writer's commit is missed.
                head = self._committed_head()
            except Exception as e:
                if offline != "auto" or not _unreachable(e):
                    raise
                self.offline = True
        if self.flag == "r" and head is None and state is None:
            raise MissingTableError(f"nothing at {self.conn.path}")
        if head and head.type != self.type:
            raise TypeError(f"{self.conn.path} holds a {head.type}")
        if state and head and state["uuid"] != head.uuid and self.flag != "n":
            raise IdentityError("local state belongs to another table")
        if state is None or self.flag == "n":
            if self.flag == "n" and head and num_groups is not None and head.num_groups not in (None, num_groups):
                raise ValueError(f"the committed table has {head.num_groups} groups")
            if state is None and (foreign := [x for x, _ in self.local.list() if x not in _OWN and not _TEMPORARY.match(x)]):
                raise ValueError(f"{self.local.root} holds other files ({foreign[0]}); give a folder of the table's own")
            for x in _OWN:
                self.local.delete(x)
            state = {"uuid": head.uuid if head else uuid.uuid4().hex, "segments": [], "seq": 0, "num_groups": None, "replace": False, "meta": None, "meta_ts": 0, "meta_pending": False, "ingest": None, "head": None}
        self.state = state
        if state["replace"]:
            warnings.warn("an unpushed replacement is pending", stacklevel=4)
        if self.flag == "n":
            state["replace"] = head is not None
        known = state["num_groups"]
        if head and not state["replace"] and (head.num_groups or head.commit):
            if num_groups is not None and head.num_groups != num_groups:
                warnings.warn(f"the committed table has {head.num_groups} groups; that holds", stacklevel=4)
            state["num_groups"] = head.num_groups
        elif known is not None:
            if num_groups is not None and num_groups != known:
                raise ValueError(f"this table was begun with {known} groups")
        else:
            state["num_groups"] = num_groups
        self.head = Head.of(state["head"]) if state["head"] else Head(uuid=state["uuid"], type=self.type)
        if head and head.ts != self.head.ts:
            self._adopt(head)
        self._save()

    def _committed_head(self) -> Head | None:
        found = self.store.read("HEAD.json")
        if found is None:
            return None
        if found.get("format_version", 1) > FORMAT_VERSION:
            raise FormatError(f"format {found['format_version']} is newer than {FORMAT_VERSION}")
        return Head.of(found)

    def _save(self) -> None:
        self.local.write("state.json", self.state)

    @property
    def groups(self) -> int:
        return self.state["num_groups"] or 1

    def _gid(self, key: str = "key"):
        return group_column(key, self.groups, self.grouping)

    # Frames

    def _none(self, schema: str) -> DataFrame:
        """No rows, in a form that the optimizer knows to be empty, so that joins with it go."""
        return self.spark.createDataFrame([], schema).limit(0)

    def _segments(self) -> DataFrame:
        """The last local record of each key: W pending write, D pending delete, C clean copy, X nothing."""
        if not self._open:
            raise ClosedError("the table is closed")
        self._flush()
        paths = [self.local.path(x) for x in self.state["segments"]]
        if not paths:
            return self._none(LOCAL)
        rows = self.spark.read.schema(LOCAL).parquet(*paths)
        if len(paths) > 1:
            rows = rows.groupBy("key").agg(F.max_by(F.struct("op", "ts", "value", "seq"), "seq").alias("r")).select("key", "r.*")
        return rows.where("op <> 'X'")

    def _ops(self) -> DataFrame:
        """key and op of _segments(), without reading times and values; the greatest number of a key is that of its last record."""
        if len(self.state["segments"]) + bool(self._buffer) < 2:
            return self._segments().select("key", "op")
        self._flush()
        rows = self.spark.read.schema(LOCAL).parquet(*(self.local.path(x) for x in self.state["segments"]))
        last = rows.groupBy("key").agg(F.max(F.col("seq") * 4 + F.instr(F.lit("WDC"), F.col("op"))).alias("n"))
        return last.where("n % 4 > 0").select("key", F.substring(F.lit("WDC"), (F.col("n") % 4).cast("int"), F.lit(1)).alias("op"))

    def _local(self) -> DataFrame:
        return self._segments().where("op in ('W', 'C')").select("key", "ts", "value")

    def _written(self) -> DataFrame:
        return self._segments().where("op = 'W'").select("key")

    def _deletes(self) -> DataFrame:
        return self._segments().where("op = 'D'").select("key")

    def _replacing(self) -> bool:
        return self.state["replace"] or not self.head.commit

    def index(self) -> DataFrame:
        """key, ts, gid, length of the committed rows; empty where they are to be replaced."""
        if self._replacing():
            return self._none(INDEX)
        return self.spark.read.schema(INDEX).parquet(self.store.path(f"index/{self.head.commit}"))

    def committed(self, gids: Iterable[int] | None = None) -> DataFrame:
        """key, ts, value, gen, gid of the live generations, read by partition."""
        if self._replacing() or not self.head.manifest:
            return self._none(GROUP)
        wanted = self.head.manifest if gids is None else {g: self.head.manifest[g] for g in gids if g in self.head.manifest}
        if not wanted:
            return self._none(GROUP)
        paths = [self.store.path(f"groups/gen={gen}/gid={g}") for g, gen in wanted.items()]
        return self.spark.read.schema(GROUP).option("basePath", self.store.path("groups")).parquet(*paths)

    def _missing_objects(self, gids: Iterable[int] | None = None) -> dict[int, str]:
        """gid -> path of the groups that the commit names and the store doesn't have."""
        wanted = self.head.manifest if gids is None else {g: self.head.manifest[g] for g in gids if g in self.head.manifest}
        there = {gen: {x for x, _ in self.store.list(f"groups/gen={gen}")} for gen in set(wanted.values())}
        return {g: f"groups/gen={gen}/gid={g}" for g, gen in wanted.items() if f"gid={g}" not in there[gen]}

    def to_df(self) -> DataFrame:
        """The live rows: key, ts, value."""
        if self.offline:
            self._require_local()
            return self._local()
        return self._healed(self._view)

    def _view(self, gids: Iterable[int] | None = None) -> DataFrame:
        """The live rows, of all groups or some."""
        if self.offline:
            return self._local()
        return views.live_view(self.committed(gids), self._segments(), self.index())

    def _require_local(self, keys: list[str] | None = None) -> None:
        missing = views.fetch_keys(self._local(), self.index_offline(), self._written(), self._deletes())
        if keys is not None:
            missing = missing.where(F.col("key").isin(keys))
        names = sorted(x.key for x in missing.collect())
        if names:
            raise OfflineError(f"not held locally: {', '.join(names)}")

    def index_offline(self) -> DataFrame:
        """The index as last read; offline it comes from the local copy."""
        if not self.offline:
            return self.index()
        if not self.local.exists("index"):
            return self._none(INDEX)
        return self.spark.read.schema(INDEX).parquet(self.local.path("index"))

    def _healed(self, action: Callable[[], Any]) -> Any:
        """Runs an action; if a file it needs has gone, reads the latest commit and tries once more."""
        try:
            return action()
        except Exception as e:
            if self.offline or not _gone(e):
                raise
            self._reread()
            try:
                return action()
            except Exception as again:
                if not _gone(again):
                    raise
                error = IntegrityError(f"the committed index names data that is gone: {str(again)[:300]}")
                error.missing = tuple(MissingObject(x) for x in self._missing_objects().values())
                raise error from again

    def _reread(self) -> None:
        """Takes the latest commit, whatever its time; if the commit has gone, nothing is committed."""
        if self._committed_head() is None:
            self.head = Head(uuid=self.state["uuid"], type=self.type)
        else:
            self.pull(force=True)

    def healed(self, action: Callable[[], Any]) -> Any:
        """Runs action(), which builds and runs plans on this table; if another writer's push has replaced files it reads, once more on the latest commit."""
        return self._healed(action)

    # Reading

    @property
    def session(self) -> Session:
        """What is committed, asked directly."""
        return Session(self.spark, self.conn)

    def _row(self, key: str) -> tuple[int, bytes] | None:
        if not self._open:
            raise ClosedError("the table is closed")
        if not isinstance(key, str):
            return None
        if key in self._buffer:
            op, ts, value = self._buffer[key]
            return (ts, value) if op == "W" else None

        def read():
            mine = self._segments().where(F.col("key") == key).first()
            if mine and mine.op == "D":
                return None
            if mine and (mine.op == "W" or self._replacing()):
                return mine.ts, bytes(mine.value)
            if self.offline:
                self._require_local([key])
                return (mine.ts, bytes(mine.value)) if mine else None
            g = group_of(key, self.groups, self.grouping)
            one = (F.col("gid") == g) & (F.col("key") == key)
            entry = self.index().where(one).select("key", "length")
            theirs = self.committed([g]).where(one).select("key", "ts", "value").join(entry, "key", "full").first()
            if theirs and theirs.length is not None and (theirs.value is None or len(theirs.value) != theirs.length):
                raise IntegrityError(f"{key!r} is in the index and not whole in its group")
            if theirs and theirs.value is not None and (mine is None or mine.ts == 0 or theirs.ts > mine.ts):
                return theirs.ts, bytes(theirs.value)
            return (mine.ts, bytes(mine.value)) if mine else None

        return self._healed(read)

    def get(self, key: str, default: Any = None) -> Any:
        row = self._row(key)
        return default if row is None else self.decode(row[1])

    def __getitem__(self, key: str) -> Any:
        row = self._row(key)
        if row is None:
            raise KeyError(key)
        return self.decode(row[1])

    def __contains__(self, key: object) -> bool:
        if not isinstance(key, str):
            return False
        if key in self._buffer:
            return self._buffer[key][0] == "W"
        return self._healed(lambda: bool(self.key_frame().where(F.col("key") == key).limit(1).count()))

    def key_frame(self) -> DataFrame:
        return views.live_keys(self._local(), self.index_offline(), self._deletes())

    def __iter__(self) -> Iterator[str]:
        return (x.key for x in self._healed(lambda: self.key_frame().toLocalIterator()))

    def keys(self) -> Iterator[str]:
        return iter(self)

    def __len__(self) -> int:
        return self._healed(lambda: self.key_frame().count())

    def items(self) -> Iterator[tuple[str, Any]]:
        return ((x.key, self.decode(x.value)) for x in self._healed(lambda: self.to_df().select("key", "value").toLocalIterator()))

    def values(self) -> Iterator[Any]:
        return (v for _, v in self.items())

    def timestamps(self, include_value: bool = False) -> Iterator[tuple]:
        names = ("key", "ts", "value") if include_value else ("key", "ts")
        rows = self._healed(lambda: self.to_df().select(*names).toLocalIterator())
        return ((x.key, x.ts, self.decode(x.value)) if include_value else (x.key, x.ts) for x in rows)

    def get_timestamp(self, key: str, include_value: bool = False, decode_value: bool = True, default: Any = None) -> Any:
        row = self._row(key)
        if row is None:
            return default
        return (row[0], self.decode(row[1]) if decode_value else row[1]) if include_value else row[0]

    def get_items(self, keys: Iterable[str], default: Any = None) -> Iterator[tuple[str, Any]]:
        """A pair for every key asked for, in that order."""
        wanted = list(keys)
        if not wanted:
            return iter(())
        asked = self.spark.createDataFrame(list(enumerate(wanted)), "pos long, key string")
        if self.offline:
            self._require_local(wanted)
        rows = self._healed(lambda: views.bulk_get(asked, self._within(wanted)).toLocalIterator())
        return ((x.key, default if x.value is None else self.decode(x.value)) for x in rows)

    def _within(self, keys: list[str]) -> DataFrame:
        """Live rows for some keys, of their groups alone."""
        return self._view(sorted({group_of(k, self.groups, self.grouping) for k in keys}))

    def load_items(self, keys: Iterable[str] | None = None) -> dict[str, MissingObject | str]:
        """Copies committed rows that are newer than the local ones to local state; {key: what is wrong} of those that can't be."""
        if self.offline:
            self._require_local(None if keys is None else list(keys))
            return {}
        wanted = None if keys is None else list(keys)

        def due() -> DataFrame:
            rows = views.due_rows(self._segments(), self.index())
            return rows if wanted is None else rows.join(self.spark.createDataFrame([(k,) for k in wanted], "key string"), "key", "left_semi")

        def told(rows: DataFrame) -> tuple[int, int]:
            """Number of rows, and the keys' hashes taken together."""
            return tuple(rows.select(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(key))"), F.lit(0))).first())

        def load() -> dict[str, MissingObject | str]:
            asked = due()
            found = asked.groupBy("gid").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(key))").alias("keys")).collect()
            gids = [x.gid for x in found]
            gone = self._missing_objects(gids)
            there = [x for x in found if x.gid not in gone]
            rows = asked.where(~F.col("gid").isin(list(gone))) if gone else asked
            rows = rows.select("key", "length").join(self.committed([x.gid for x in there]).select("key", "ts", "value"), "key")
            rows = rows.where(F.octet_length("value") == F.col("length")).select("key", "ts", "value")
            whole = self._append(rows, "C", lambda path: told(self.spark.read.schema(LOCAL).parquet(path)))
            failed: dict[str, MissingObject | str] = {}
            if not gone and whole == (sum(x.n for x in there), functools.reduce(operator.xor, (x.keys for x in there), 0)):
                return failed
            lost: dict[int, list[str]] = {}
            # What is due still.
            for x in due().select("key", "gid").collect():
                if x.gid in gone:
                    lost.setdefault(x.gid, []).append(x.key)
                else:
                    failed[x.key] = "in the index and not whole in its group"
            for g, names in lost.items():
                failed |= dict.fromkeys(names, MissingObject(gone[g], tuple(sorted(names))))
            return failed

        failed = self._healed(load)
        if failed:
            # The commit may have been replaced meanwhile.
            self._reread()
            failed = self._healed(load)
        self._copy_index()
        return failed

    def _copy_index(self) -> None:
        self.index().write.mode("overwrite").parquet(self.local.path("index.new"))
        self.local.delete("index")
        self.local.fs.rename(self.local._at("index.new"), self.local._at("index"))

    # Writing

    def _check(self, key: str | None = None) -> None:
        if not self._open:
            raise ClosedError("the table is closed")
        if not self.writable:
            raise ReadOnlyError("opened for reading")
        if key is not None and (not isinstance(key, str) or key.startswith(RESERVED)):
            raise ValueError(f"not a key: {key!r}")

    def set(self, key: str, value: Any, timestamp: int | str | dt.datetime | None = None, encode_value: bool = True) -> None:
        self._check(key)
        self._buffer[key] = ("W", timestamp_us(timestamp), self.encode(value) if encode_value else bytes(value))
        if len(self._buffer) >= BUFFER:
            self._flush()

    def __setitem__(self, key: str, value: Any) -> None:
        self.set(key, value)

    def update(self, other: Mapping | Iterable = (), /, **named: Any) -> None:
        for k, v in other.items() if isinstance(other, Mapping) else other:
            self.set(k, v)
        for k, v in named.items():
            self.set(k, v)

    def upsert(self, rows: DataFrame) -> None:
        """Writes a frame (key, value[, ts]); of repeated keys the row of greatest ts, then value, holds (a frame has no order of input).

        Keys are strings, values strings or bytes as the table's codec writes them, times positive; anything else is an error and writes nothing.
        """
        self._check()
        kinds = dict(rows.dtypes)
        if kinds.get("key") != "string" or kinds.get("value") not in ("string", "binary") or kinds.get("ts", "bigint") not in ("bigint", "int"):
            raise TypeError("a frame of key string, value string or binary, and ts long or none")
        ts = F.col("ts").cast("long") if "ts" in rows.columns else F.lit(now_us())
        rows = rows.select("key", ts.alias("ts"), F.col("value").cast("binary").alias("value"))
        bad = F.col("key").isNull() | F.col("key").startswith(RESERVED) | F.col("value").isNull() | F.col("ts").isNull() | (F.col("ts") <= 0)

        def check(path: str) -> None:
            if self.spark.read.schema("bad boolean").parquet(path).where("bad").limit(1).count():
                raise ValueError("keys, values and times must not be null, keys not reserved, and times positive")

        # Checked in what is written, so that the frame is computed once.
        last = rows.withColumn("bad", bad).groupBy("key").agg(F.max(F.struct("ts", "value")).alias("r"), F.max("bad").alias("bad"))
        self._append(last.select("key", "r.ts", "r.value", "bad"), "W", check)

    def __delitem__(self, key: str) -> None:
        self._check(key)
        if key not in self:
            raise KeyError(key)
        in_index = bool(self.index().where(F.col("key") == key).limit(1).count())
        self._buffer[key] = ("D" if in_index else "X", now_us(), b"")
        # A delete can't be told from the data, as a write can; it is kept at once.
        self._flush()

    def remove(self, rows: DataFrame) -> None:
        """Deletes the keys of a frame (key) that are there, in bulk; others are passed by."""
        self._check()
        if dict(rows.dtypes).get("key") != "string":
            raise TypeError("a frame of key string")
        there = views.removable(rows.select("key").distinct(), self._ops(), self.index())
        self._flush()
        self._segment(there.select("key", F.when(F.col("known"), "D").otherwise("X").alias("op"), F.lit(now_us()).alias("ts"), F.lit(b"").alias("value")))

    def set_timestamp(self, key: str, timestamp: int | str | dt.datetime) -> None:
        self._check(key)
        row = self._row(key)
        if row is None:
            raise KeyError(key)
        KeyedTable.set(self, key, row[1], timestamp, encode_value=False)

    def set_metadata(self, data: Any, timestamp: int | str | dt.datetime | None = None) -> None:
        self._check()
        self.state |= {"meta": json.dumps(data), "meta_ts": timestamp_us(timestamp), "meta_pending": True}
        self._save()

    def get_metadata(self, include_timestamp: bool = False) -> Any:
        data = None if self.state["meta"] is None else json.loads(self.state["meta"])
        return (data, self.state["meta_ts"] or None) if include_timestamp else data

    def clear(self) -> None:
        """Deletes every key at the next push; until then it can be discarded."""
        self._check()
        self._compactable()
        self._buffer.clear()
        self._rewrite(views.clear_pending(self.index()).select("key", "op", F.lit(now_us()).alias("ts"), F.lit(b"").alias("value")))
        self.state |= {"meta": self.head.meta, "meta_ts": self.head.meta_ts, "meta_pending": False}
        self._save()

    def prune(self, timestamp: int | str | dt.datetime | None = None) -> int:
        """Drops local copies older than the time (none without one) and merges segments; pending changes stay."""
        self._compactable()
        rows = self._segments()
        before = rows.count()
        if timestamp is not None:
            rows = rows.where((F.col("op") != "C") | (F.col("ts") >= timestamp_us(timestamp)))
        self._rewrite(rows.select("key", "op", "ts", "value"))
        return before - self._segments().count()

    def _compactable(self) -> None:
        if self._pushing:
            raise PushInProgressError("a push is reading local state")

    def _flush(self) -> None:
        if self._buffer:
            held, self._buffer = self._buffer, {}
            rows = [(k, op, ts, bytearray(v)) for k, (op, ts, v) in held.items()]
            self._segment(self.spark.createDataFrame(rows, "key string, op string, ts long, value binary").coalesce(1))

    def _append(self, rows: DataFrame, op: str, check: Callable[[str], Any] | None = None) -> Any:
        self._flush()
        return self._segment(rows.withColumn("op", F.lit(op)), check)

    def _segment(self, rows: DataFrame, check: Callable[[str], Any] | None = None) -> Any:
        """Writes a segment; check(path) is run before it counts, and if it fails the segment goes."""
        seq = self.state["seq"] + 1
        name = f"rows/{seq}-{uuid.uuid4().hex[:8]}"
        rows.withColumn("seq", F.lit(seq).cast("long")).write.options(**_PLAIN_KEYS).parquet(self.local.path(name))
        try:
            told = check(self.local.path(name)) if check else None
        except BaseException:
            self.local.delete(name)
            raise
        self.state |= {"seq": seq, "segments": [*self.state["segments"], name]}
        self._save()
        if len(self.state["segments"]) > SEGMENTS and not self._pushing:
            self._rewrite(self._segments().select("key", "op", "ts", "value"))
        return told

    def _rewrite(self, rows: DataFrame) -> None:
        """Replaces all segments by one."""
        old = self.state["segments"]
        seq = self.state["seq"] + 1
        name = f"rows/{seq}-{uuid.uuid4().hex[:8]}"
        rows.withColumn("seq", F.lit(seq).cast("long")).write.options(**_PLAIN_KEYS).parquet(self.local.path(name))
        self.state |= {"seq": seq, "segments": [name]}
        self._save()
        for x in old:
            self.local.delete(x)

    # Synchronising

    def changes(self) -> Changes:
        self.sync()
        return Changes(self)

    def sync(self) -> None:
        self._flush()

    def pull(self, force: bool = False) -> bool:
        """Reads the latest commit; whether there was a newer one."""
        if self.offline:
            raise OfflineError("offline")
        self._flush()
        head = self._committed_head()
        if head is None or (not force and head.ts == self.head.ts):
            return False
        if head.uuid != self.state["uuid"] and not self.state["replace"]:
            raise IdentityError("the committed table is another one")
        self._adopt(head)
        self._save()
        return True

    def _adopt(self, head: Head) -> None:
        before, self.head = self.state["ingest"], head
        if not self.state["replace"]:
            self.state["num_groups"] = head.num_groups
            if head.meta_ts > self.state["meta_ts"] and not self.state["meta_pending"]:
                self.state |= {"meta": head.meta, "meta_ts": head.meta_ts}
            if before is not None and self.state["segments"]:
                marked = views.reconciled(self._segments(), self.index(), before)
                n, held = marked.select(F.count_if("gone"), F.count_if(F.col("op") == "C")).first()
                if n:
                    if 4 * n > held:
                        warnings.warn(f"{n} of {held} local rows were deleted by another writer", stacklevel=2)
                    self._rewrite(marked.where(~F.col("gone")).select("key", "op", "ts", "value"))
        self.state |= {"head": head.record(), "ingest": head.ts}

    def map(self, func: Callable[[str, Any], tuple[str, Any] | None], keys: Iterable[str] | None = None) -> DataFrame:
        """func(key, value) for each live row, in the workers: a pair makes a row (key, value), None makes none."""
        wanted = None if keys is None else list(keys)
        rows = self.to_df() if wanted is None else self._healed(lambda: self._within(wanted)).where(F.col("key").isin(wanted))
        encode, decode = self.encode, self.decode

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [x for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (x := func(k, decode(v))) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.string()), pa.array([encode(v) for _, v in made], pa.binary())], names=["key", "value"])

        return rows.select("key", "value").mapInArrow(run, "key string, value binary")

    # The whole table

    def delete_remote(self) -> None:
        """Deletes the commit first, then the table's own folder; never siblings or locks."""
        self._check()
        self._lock.verify()
        self.store.delete("HEAD.json")
        for name, _ in self.store.list():
            self.store.delete(name)
        self.head = Head(uuid=self.state["uuid"], type=self.type)
        self.state |= {"head": None, "ingest": None}
        self._save()

    def copy_remote(self, to: Connection | dict | str) -> dict[int, str]:
        """Copies exactly the committed data to an empty place, the commit last; the copy keeps the identity.

        Every file is read and written by one task, without a shuffle. Groups that
        are missing are returned, and then nothing is committed there.
        """
        target = Store(self.spark, Connection.of(to))
        if target.exists("HEAD.json") or target.list():
            raise ValueError("the target is not empty")
        head = self._committed_head()
        if head is None:
            raise MissingTableError("nothing is committed")
        self.head = head
        if failed := {g: f"{x} is missing" for g, x in self._missing_objects().items()}:
            return failed
        if head.commit:
            if head.manifest:
                paths = [self.store.path(f"groups/gen={gen}/gid={g}") for g, gen in head.manifest.items()]
                rows = self.spark.read.schema(GROUP).option("basePath", self.store.path("groups")).parquet(*paths)
                rows.write.partitionBy("gen", "gid").parquet(target.path("groups"))
            self.spark.read.schema(INDEX).parquet(self.store.path(f"index/{head.commit}")).write.parquet(target.path(f"index/{head.commit}"))
        target.write("HEAD.json", head.record())
        return {}

    def close(self) -> None:
        if self._open:
            if self.writable:
                self._flush()
            self._open = False
            if self._lock:
                self._lock.release()
            self._done.detach()

    def __enter__(self) -> KeyedTable:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class Changes:
    """What differs from the committed table, and what to do about it."""

    def __init__(self, table: KeyedTable):
        self.table = table

    def pull(self) -> bool:
        return self.table.pull()

    def changelog(self) -> DataFrame:
        """key, local_ts, remote_ts."""
        t = self.table
        return t._healed(lambda: views.changelog(t._local(), t.index(), t._written(), now_us()))

    def iter_changes(self) -> Iterator[dict]:
        """key, remote_timestamp (None: not committed) and local_timestamp, in UTC."""
        at = lambda us: None if us is None else dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(microseconds=us)
        for x in self.changelog().toLocalIterator():
            yield {"key": x.key, "remote_timestamp": at(x.remote_ts), "local_timestamp": at(x.local_ts)}

    def deletes(self) -> DataFrame:
        """key of the pending deletes."""
        return self.table._deletes()

    def pending_deletes(self) -> frozenset[str]:
        return frozenset(x.key for x in self.deletes().collect())

    def discard(self, keys: Iterable[str] | None = None) -> None:
        """Forgets pending writes and deletes, of some keys or all; all also reverts metadata."""
        t = self.table
        t._check()
        rows = t._segments()
        drop = F.col("op").isin("W", "D")
        if keys is not None:
            drop = drop & F.col("key").isin(list(keys))
        t._rewrite(rows.where(~drop).select("key", "op", "ts", "value"))
        if keys is None:
            t.state |= {"meta": t.head.meta, "meta_ts": t.head.meta_ts, "meta_pending": False}
            t._save()

    def push(self, force_push: bool = False) -> PushResult:
        """Writes the touched groups as a new generation and commits them at once.

        Groups that can't be written are returned with the reason, keep their
        committed data, and their changes stay pending; the others are committed. A
        replacement is committed whole or not at all. A failure of the commit itself
        is raised.
        """
        t = self.table
        t._check()
        t._lock.verify()
        t.sync()
        latest = t._committed_head()
        if latest and latest.ts != t.head.ts and not t.state["replace"]:
            t._adopt(latest)
            t._save()
        t._pushing, folder = True, f"push/{uuid.uuid4().hex}"
        try:
            return self._push(force_push, folder)
        finally:
            t._pushing = False
            t.local.delete(folder)

    def _push(self, force: bool, folder: str) -> PushResult:
        t, state = self.table, self.table.state
        began, segments = time.time(), list(state["segments"])
        index = t.index()
        # Found once, by one join with the index, and kept beside the local rows, with those that stay as they are, until the push has ended.
        views.local_changes(t._segments(), index, now_us(), t._gid()).write.options(**_PLAIN_KEYS).partitionBy("due").parquet(t.local.path(folder))
        known = t.spark.read.schema("key string, op string, ts long, value binary, gid int, late boolean, was long, due boolean").parquet(t.local.path(folder))
        pending, as_they_are = known.where("due").drop("due"), known.where("not due")
        writes, deletes = pending.where("op <> 'D'").select("key", "ts", "value", "gid"), pending.where("op = 'D'").select("key")
        found = views.packed_sizes(index, pending).collect()
        sizes = {x.gid: (x.bytes, x.n) for x in found}
        if restamped := sum(x.late for x in found):
            warnings.warn(f"{restamped} pending writes are not newer than the committed rows and get a new time", stacklevel=5)
        touched, first = sorted(sizes), not t.head.commit
        if not (touched or force or state["meta_pending"] or state["replace"] or first):
            return PushResult(False)
        failures = {g: f"{GroupTooLargeError.__name__}: {sizes[g][0]} bytes; use more groups" for g in touched if sizes[g][0] > MOST_GROUP_BYTES}
        gone = {} if t._replacing() else t._missing_objects(touched)
        if gone:
            kept = index.where(F.col("gid").isin(list(gone)))
            warnings.warn(f"{views.without(views.without(kept, writes), deletes).count()} keys of {len(gone)} groups have lost their values and leave the index", stacklevel=5)
        log.info("push: %d groups, %d keys, %d bytes", len(touched), sum(n for _, n in sizes.values()), sum(b for b, _ in sizes.values()))

        def rows_of(gids: list[int], every: bool) -> DataFrame:
            old = t.committed([g for g in gids if g not in gone]).select("key", "ts", "value", "gid")
            return views.without(old, pending).union(writes if every else writes.where(F.col("gid").isin(gids)))

        live: dict[int, str] = {}
        made: list[str] = []

        def write(gids: list[int]) -> None:
            """Writes groups in one job; if it fails, in halves, so that what can't be written is found."""
            gen = new_generation(frozenset(t.head.manifest.values()))
            splits = max(1, math.ceil(sum(sizes[g][0] for g in gids) / len(gids) / FILE_BYTES))
            try:
                rows = rows_of(gids, len(gids) == len(touched)).repartition("gid", F.pmod(F.xxhash64("key"), F.lit(splits)))
                rows.sortWithinPartitions("gid", "key").write.options(**_PLAIN_KEYS).partitionBy("gid").parquet(t.store.path(f"groups/gen={gen}"))
            except Exception as e:
                t.store.delete(f"groups/gen={gen}")
                if len(gids) == 1:
                    failures[gids[0]] = f"{type(e).__name__}: {str(e)[:300]}"
                    return
                half = len(gids) // 2
                write(gids[:half])
                write(gids[half:])
                return
            made.append(gen)
            held = sorted(int(x[4:]) for x, _ in t.store.list(f"groups/gen={gen}") if x.startswith("gid="))
            live.update(dict.fromkeys(held, gen))
            for g in held:
                log.info("group %d: %d keys, %d bytes", g, sizes[g][1], sizes[g][0])

        if todo := [g for g in touched if g not in failures]:
            write(todo)
        done = [g for g in touched if g not in failures]
        log.info("written: %d groups, %d bytes in %.1f s; %d failed", len(done), sum(sizes[g][0] for g in done), time.time() - began, len(failures))
        commit = new_generation()

        def undo() -> None:
            for gen in made:
                t.store.delete(f"groups/gen={gen}")
            t.store.delete(f"index/{commit}")

        if failures and (state["replace"] or not (done or force or state["meta_pending"] or first)):
            undo()
            return PushResult(False, failures)
        if state["segments"][: len(segments)] != segments:
            undo()
            raise CompactionError("local state was compacted during the push")
        try:
            paths = [t.store.path(f"groups/gen={gen}/gid={g}") for g, gen in live.items()]
            row = "key string, ts long, value binary, gen string, gid int"
            fresh = t.spark.read.schema(row).option("basePath", t.store.path("groups")).parquet(*paths) if paths else t._none(row)
            new_index = views.next_index(index, fresh, t.spark.createDataFrame([(g,) for g in done], "gid int"))
            # The groups' files hold whole groups in order of keys, or large parts of them, so the entries need no shuffle.
            most = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
            new_index.coalesce(most).sortWithinPartitions("gid", "key").write.options(**_PLAIN_KEYS).parquet(t.store.path(f"index/{commit}"))
        except Exception as e:
            undo()
            return PushResult(False, dict.fromkeys(touched, f"{type(e).__name__}: {str(e)[:300]}"))
        before = {} if state["replace"] else t.head.manifest
        manifest = {g: x for g, x in before.items() if g not in set(done)} | live
        if state["meta_pending"]:
            meta, meta_ts = state["meta"], state["meta_ts"] if state["meta_ts"] > t.head.meta_ts else max(now_us(), t.head.meta_ts + 1)
        elif state["replace"]:
            meta, meta_ts = None, 0
        else:
            meta, meta_ts = t.head.meta, t.head.meta_ts
        head = Head(state["uuid"], t.type, max(now_us(), t.head.ts + 1), commit, state["num_groups"], manifest, meta, meta_ts)
        t._lock.verify()
        t.store.write("HEAD.json", head.record())
        log.info("committed %s: %d bytes", commit, len(json.dumps(head.record())))
        replaced, old_head = state["replace"], t.head
        t.head = head
        names = ["key", "op", "ts", "value"]
        clean = writes.where(~F.col("gid").isin(list(failures))) if failures else writes
        kept = clean.select("key", F.lit("C").alias("op"), "ts", "value").union(as_they_are.select(names))
        if failures:
            kept = kept.union(t._segments().where(F.col("op").isin("W", "D") & t._gid().isin(list(failures))).select(names))
        t._rewrite(kept)
        state |= {"head": head.record(), "ingest": head.ts, "replace": False, "meta_pending": False, "meta": meta, "meta_ts": meta_ts}
        t._save()
        self._collect_garbage(old_head, head, done, replaced)
        return PushResult(True, failures)

    def _collect_garbage(self, old: Head, new: Head, touched: list[int], replaced: bool) -> None:
        """Deletes exactly what the commit replaced; what fails is an orphan for fsck."""
        t = self.table
        try:
            if replaced:
                t._lock.verify()
            for g, gen in old.manifest.items():
                if new.manifest.get(g) != gen:
                    t.store.delete(f"groups/gen={gen}/gid={g}")
            for gen in set(old.manifest.values()) - set(new.manifest.values()):
                t.store.delete(f"groups/gen={gen}")
            if old.commit:
                t.store.delete(f"index/{old.commit}")
        except Exception as e:
            log.warning("orphans remain: %s", e)


#: Tables with a class of their own, by type.
_KINDS: dict[str, type[KeyedTable]] = {}
