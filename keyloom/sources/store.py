"""Files of a table on any Hadoop file system: atomic documents, exclusive locks, listings."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession

from ..errors import LockLostError
from ..model import Connection

#: Age in seconds at which another's lock may be broken.
LOCK_AGE = 2 * 3600


class Store:
    def __init__(self, spark: SparkSession, conn: Connection):
        self.spark, self.root = spark, conn.path.rstrip("/")
        conf = spark._jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())
        for k, v in conn.options.items():
            conf.set(k, str(v))
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        uri = self._path(self.root).toUri()
        self.fs = self._path(self.root).getFileSystem(conf)
        self.context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri() if uri.getScheme() is None else uri, conf)

    def path(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def _at(self, name: str):
        return self.fs.makeQualified(self._path(self.path(name)))

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._at(name))

    def read(self, name: str) -> dict | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self._at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        """Replaces a document at once: readers see the old or the new one."""
        temp = f"{name}.{uuid.uuid4().hex}.tmp"
        self._put(temp, value)
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        array = self.spark.sparkContext._gateway.new_array(rename, 1)
        array[0] = rename.OVERWRITE
        self.context.rename(self._at(temp), self._at(name), array)

    def _put(self, name: str, value: dict, overwrite: bool = True) -> None:
        stream = self.fs.create(self._at(name), overwrite)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()

    def create(self, name: str, value: dict) -> bool:
        """Writes a document only if there is none of its name."""
        if self.exists(name):
            return False
        try:
            self._put(name, value, overwrite=False)
        except Exception as e:
            if "already exists" in str(e).lower():
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def rename(self, old: str, new: str) -> bool:
        """Whether this call moved the document; of several callers one does."""
        try:
            return self.fs.rename(self._at(old), self._at(new))
        except Exception as e:
            if "FileNotFound" in str(e):
                return False
            raise

    def list(self, name: str = "") -> list[tuple[str, int]]:
        """Names and ages (time of change in seconds) directly under name."""
        if not self.exists(name):
            return []
        return [(x.getPath().getName(), x.getModificationTime() // 1000) for x in self.fs.listStatus(self._at(name))]

    def files(self, name: str = "") -> list[tuple[str, int, int]]:
        """Path below the root, bytes and time of change (seconds) of every file under name."""
        if not self.exists(name):
            return []
        out, root, found = [], self._at("").toUri().getPath().rstrip("/") + "/", self.fs.listFiles(self._at(name), True)
        while found.hasNext():
            x = found.next()
            out.append((x.getPath().toUri().getPath().removeprefix(root), x.getLen(), x.getModificationTime() // 1000))
        return out


class Lock:
    """A writer's lock beside the table, outside its folder."""

    def __init__(self, store: Store, timeout: float = 300, force: bool = False):
        self.store, self.token = Store(store.spark, Connection(f"{store.root}.lock")), uuid.uuid4().hex
        if force:
            self.store.delete("writer")
        end = time.time() + timeout
        while not self.store.create("writer", {"token": self.token, "at": time.time()}):
            held = self.store.read("writer") or {}
            if time.time() - held.get("at", time.time()) > LOCK_AGE:
                # Moved aside, which only one of several waiters can do, and put back if it was another lock by then.
                aside = f"broken-{self.token}"
                if self.store.rename("writer", aside):
                    if (self.store.read(aside) or {}).get("token") == held.get("token"):
                        self.store.delete(aside)
                    else:
                        self.store.rename(aside, "writer")
            elif time.time() > end:
                raise TimeoutError(f"{store.root} is locked by another writer")
            else:
                time.sleep(min(0.2, timeout))

    def verify(self) -> None:
        if (self.store.read("writer") or {}).get("token") != self.token:
            raise LockLostError("another writer holds the lock")

    def release(self) -> None:
        if (self.store.read("writer") or {}).get("token") == self.token:
            self.store.delete("writer")
