"""Errors of keyed tables. Each also derives from the builtin that callers may already catch."""

from __future__ import annotations


class TableError(Exception):
    """Base of all."""


class ReadOnlyError(TableError, ValueError):
    """A write on a session opened for reading."""


class IdentityError(TableError, ValueError):
    """Local state belongs to another table."""


class MissingTableError(TableError, ValueError):
    """Neither a committed table nor local state is there."""


class FormatError(TableError, ValueError):
    """The stored format is newer than this engine."""


class GroupTooLargeError(TableError, ValueError):
    """A group's packed size passes the format's limit."""


class IntegrityError(TableError, OSError):
    """The committed index names data that the store doesn't have; `missing` lists the objects."""

    missing: tuple = ()


class LockLostError(TableError):
    """The writer's lock is no longer its own."""


class OfflineError(TableError):
    """A value that isn't held locally was asked for offline."""


class ClosedError(TableError, ValueError):
    """The table has been closed."""


class PushInProgressError(TableError, RuntimeError):
    """Local state can't be compacted while a push reads it."""


class CompactionError(TableError, RuntimeError):
    """Local state was compacted while a push read it."""
