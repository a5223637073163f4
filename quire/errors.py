"""Exceptions of the library."""


class QuireError(Exception):
    """Base of all errors raised here."""


class DatabaseError(QuireError):
    """Catalog or commit failed."""


class RecordNotFound(QuireError, KeyError):
    """No row with this key."""


class ReferencedDocumentNotFound(QuireError, KeyError):
    """A revision names a predecessor that is not stored."""


class DuplicateKeyError(QuireError):
    """A unique index would hold one key for several documents."""


class CommitConflict(DatabaseError):
    """Another writer committed since the batch began."""


class DeadlockError(DatabaseError):
    """Batches wait for keys that each other holds."""


class JsonError(QuireError, ValueError):
    """A text is no JSON; `kind` is one of eof, number, character, keyword, comma, key, colon, dupkey, unknown."""

    def __init__(self, kind: str):
        super().__init__(kind)
        self.kind = kind
