"""What is committed at a place, asked directly: identity, type, time, metadata, objects and their generations."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import ReadOnlyError
from ..model import Connection, Head
from .store import Store


class Session:
    """Reads the commit document anew at each question; nothing else is kept but whether the place takes writes."""

    def __init__(self, spark: SparkSession, conn: Connection | dict | str):
        self.conn = Connection.of(conn)
        self.store, self._writable = Store(spark, self.conn), None

    def _head(self) -> Head | None:
        found = self.store.read("HEAD.json")
        return Head.of(found) if found else None

    @property
    def initialized(self) -> bool:
        return self._head() is not None

    def get_uuid(self) -> uuid.UUID | None:
        head = self._head()
        return uuid.UUID(head.uuid) if head else None

    def get_type(self) -> str | None:
        head = self._head()
        return head.type if head else None

    def get_timestamp(self) -> int | None:
        """Microseconds since 1970 of the last commit."""
        head = self._head()
        return head.ts if head else None

    def get_user_metadata(self) -> Any:
        head = self._head()
        return json.loads(head.meta) if head and head.meta is not None else None

    def writable(self) -> bool:
        """Whether a document can be written and deleted there; tried once."""
        if self._writable is None:
            probe = f"probe-{uuid.uuid4().hex}"
            try:
                self._writable = not self.conn.read_only and self.store.create(probe, {})
                if self._writable:
                    self.store.delete(probe)
            except Exception:
                self._writable = False
        return self._writable

    def put_object(self, name: str, value: dict) -> None:
        """Writes one document at once, replacing one of that name."""
        self._may_write(name)
        self.store.write(name, value)

    def delete_object(self, name: str) -> str | None:
        """Deletes exactly the object named; what went wrong, if anything did."""
        self._may_write(name)
        try:
            self.store.delete(name)
        except Exception as e:
            return f"{type(e).__name__}: {str(e)[:300]}"
        return None

    def _may_write(self, name: str) -> None:
        if self.conn.read_only:
            raise ReadOnlyError("the connection is for reading")
        if not name or name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"not an object's name: {name!r}")

    def list_objects(self) -> DataFrame:
        """path, bytes and modified (seconds since 1970) of every file of the table."""
        return self.store.spark.createDataFrame(self.store.files(), "path string, bytes long, modified long")

    def list_object_versions(self) -> DataFrame:
        """gid, gen, modified, and whether the commit names it (live), of every stored generation of every group."""
        head = self._head() or Head()
        rows = [(int(c[4:]), g[4:], at, head.manifest.get(int(c[4:])) == g[4:]) for g, _ in self.store.list("groups") if g.startswith("gen=") for c, at in self.store.list(f"groups/{g}") if c.startswith("gid=")]
        return self.store.spark.createDataFrame(rows, "gid int, gen string, modified long, live boolean")
