"""Keyed, timestamped tables on Spark: versioned storage, change tracking and synchronisation."""

from .errors import ClosedError, CompactionError, FormatError, GroupTooLargeError, IdentityError, IntegrityError, LockLostError, MissingTableError, OfflineError, PushInProgressError, ReadOnlyError, TableError
from .model import Connection, MissingObject, PushResult
from .operators.catalog import open_catalog
from .operators.fsck import fsck
from .operators.table import Changes, KeyedTable, open_table
from .sources.session import Session

__all__ = ["Changes", "ClosedError", "CompactionError", "Connection", "FormatError", "GroupTooLargeError", "IdentityError", "IntegrityError", "KeyedTable", "LockLostError", "MissingObject", "MissingTableError", "OfflineError", "PushInProgressError", "PushResult", "ReadOnlyError", "Session", "TableError", "fsck", "open_catalog", "open_table"]
