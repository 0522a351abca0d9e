"""Schemas and records of keyed tables."""

from __future__ import annotations

import uuid
import warnings
from dataclasses import asdict, dataclass, field

ENTRY = "key string, ts long, value binary"
GROUP = "key string, ts long, value binary, gen string, gid int"
INDEX = "key string, ts long, gid int, length long"
LOCAL = "key string, op string, ts long, value binary, seq long"
FORMAT_VERSION = 2
#: Largest packed group, in bytes, and the names that a table keeps for itself.
MOST_GROUP_BYTES, RESERVED = 2**32 - 1, "__keyloom_"


@dataclass(frozen=True)
class Connection:
    """Where a table is kept. Options (credentials, say) go to the file system and are never written out.

    A web address can only be read.
    """

    path: str
    options: dict = field(default_factory=dict, compare=False, repr=False)
    read_only: bool = False

    @classmethod
    def of(cls, x: Connection | dict | str) -> Connection:
        if isinstance(x, cls):
            return x
        if isinstance(x, str):
            return cls(x)
        if isinstance(x, dict):
            x = x.get("remote_conn", x)
            if not x.get("path"):
                raise ValueError("a connection needs a path")
            return cls(x["path"], dict(x.get("options", {})), bool(x.get("read_only", False)))
        raise TypeError(f"not a connection: {type(x).__name__}")

    def __post_init__(self):
        if not isinstance(self.path, str) or not self.path.strip("/ "):
            raise ValueError("a connection needs a path")
        if not isinstance(self.options, dict) or not all(isinstance(k, str) for k in self.options):
            raise TypeError("a connection's options go by names")
        scheme = self.path.partition("://")[0].lower()
        if scheme in ("http", "https"):
            object.__setattr__(self, "read_only", True)
        if scheme == "http":
            warnings.warn("values travel in the clear over http", stacklevel=3)

    def public(self) -> dict:
        return {"path": self.path}


@dataclass
class Head:
    """The commit: one small document, replaced atomically."""

    uuid: str = field(default_factory=lambda: uuid.uuid4().hex)
    type: str = "table"
    ts: int = 0
    commit: str = ""
    num_groups: int | None = None
    manifest: dict[int, str] = field(default_factory=dict)
    meta: str | None = None
    meta_ts: int = 0
    format_version: int = FORMAT_VERSION

    def record(self) -> dict:
        return asdict(self)

    @classmethod
    def of(cls, x: dict) -> Head:
        return cls(**x | {"manifest": {int(k): v for k, v in x["manifest"].items()}})


@dataclass(frozen=True)
class MissingObject:
    """A stored object that the commit names and that isn't there, with the keys whose values it held."""

    path: str
    keys: tuple[str, ...] = ()
    exists: bool = False

    def __str__(self) -> str:
        return f"{self.path} is missing"


@dataclass(frozen=True)
class PushResult:
    updated: bool
    failures: dict[int, str] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return self.updated and not self.failures
