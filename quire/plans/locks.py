"""Locks on keys, held by batches of one process, with detection of deadlocks."""

from __future__ import annotations

import threading

from quire.errors import DeadlockError


class KeyLocks:
    """A key has one owner at a time. Waiting for it fails with DeadlockError if that would close a ring of owners who wait for
    each other; the owner that closes it gets the error, the others go on."""

    def __init__(self) -> None:
        self._changed = threading.Condition()
        self._owner: dict[object, object] = {}
        self._waits: dict[int, object] = {}

    def lock(self, owner: object, key: object) -> None:
        with self._changed:
            while (holder := self._owner.get(key)) is not None and holder is not owner:
                step = holder
                while step is not None:
                    step = self._owner.get(self._waits.get(id(step)))
                    if step is owner:
                        raise DeadlockError(key)
                self._waits[id(owner)] = key
                try:
                    self._changed.wait()
                finally:
                    self._waits.pop(id(owner), None)
            self._owner[key] = owner

    def try_lock(self, owner: object, key: object) -> bool:
        with self._changed:
            if self._owner.get(key, owner) is not owner:
                return False
            self._owner[key] = owner
            return True

    def release(self, owner: object) -> None:
        with self._changed:
            for key in [k for k, o in self._owner.items() if o is owner]:
                del self._owner[key]
            self._changed.notify_all()
