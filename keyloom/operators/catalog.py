"""A catalogue: a keyed table of references to other tables."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MissingTableError
from ..model import Connection
from ..sources.session import Session
from . import table
from .table import KeyedTable, open_table

ENTRY_VERSION = 1
ENTRY = "entry_version int, type string, timestamp long, remote_meta string, user_meta string, remote_conn struct<path:string>"
_KEY = re.compile(r"[A-Za-z0-9._-]+")


def open_catalog(spark: SparkSession, conn: Connection | dict | str, local: str, flag: str = "r", **options: Any) -> Catalog:
    return open_table(spark, conn, local, flag, "json", type="catalog", **options)


class Catalog(KeyedTable):
    """key -> entry of a committed table. Assigning a connection to a key writes its entry."""

    def add(self, conn: Connection | dict | str, key: str | None = None, user_meta: Any = None) -> str:
        """Adds or renews the entry of a table; without a key it goes by the table's identity. Credentials are never kept."""
        self._check()
        conn = Connection.of(conn)
        if key is not None and not isinstance(key, str):
            raise TypeError("a catalogue's keys are strings")
        if key is not None and not _KEY.fullmatch(key):
            raise ValueError(f"not a catalogue key: {key!r}")
        meta = None if user_meta is None else json.dumps(user_meta)
        member = Session(self.spark, conn)
        own = member.get_uuid()
        if own is None:
            raise MissingTableError(f"nothing is committed at {conn.path}")
        own = uuid.UUID(str(own)).hex
        remote_meta = member.get_user_metadata()
        entry = {"entry_version": ENTRY_VERSION, "type": member.get_type(), "timestamp": member.get_timestamp(), "remote_meta": None if remote_meta is None else json.dumps(remote_meta), "user_meta": meta, "remote_conn": conn.public()}
        # Stamped with the time of writing, so that a change of user_meta alone is pushed.
        KeyedTable.set(self, key or own, entry)
        if key is not None and key != own and own in self:
            del self[own]
        return key or own

    def set(self, key: str, conn: Connection | dict | str, timestamp: int | str | dt.datetime | None = None, encode_value: bool = True) -> None:
        """The entry of a table under a key; the same as assigning it."""
        self.add(conn, key)

    def entries(self) -> DataFrame:
        """A row for each entry."""
        return self.to_df().select("key", F.from_json(F.col("value").cast("string"), ENTRY).alias("e")).select("key", "e.*")


table._KINDS["catalog"] = Catalog
