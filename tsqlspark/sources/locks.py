"""Reader-writer locks that belong to sessions, not threads."""

from __future__ import annotations

import threading
from collections import deque


class RwLock:
    """First come, first served: readers wait behind a queued writer; on release a writer goes first."""

    def __init__(self):
        self.ready, self.readers, self.writing, self.queue = threading.Condition(), 0, False, deque()

    def acquire(self, write: bool) -> None:
        with self.ready:
            me = object()
            self.queue.append((me, write))
            while not self._my_turn(me, write):
                self.ready.wait()
            self.queue = deque(x for x in self.queue if x[0] is not me)
            if write:
                self.writing = True
            else:
                self.readers += 1
            self.ready.notify_all()

    def _my_turn(self, me, write: bool) -> bool:
        if self.writing or (write and self.readers):
            return False
        for x, other in self.queue:
            if x is me:
                return True
            if write or other:  # somebody was here first, and one of the two wants to write
                return False
        return True

    def release(self, write: bool) -> None:
        with self.ready:
            if write:
                self.writing = False
                first = next((x for x in self.queue if x[1]), None)
                if first:
                    self.queue.remove(first)
                    self.queue.appendleft(first)
            else:
                self.readers -= 1
            self.ready.notify_all()
