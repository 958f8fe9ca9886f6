"""Search statistics kept by the driver. Query texts are stored as the first 8 bytes of their SHA-256 only."""

from __future__ import annotations

import hashlib
import time
from collections import deque
from dataclasses import dataclass, field


@dataclass
class Event:
    query_hash: str
    strategy: str
    seconds: float
    returned: int
    error: str = ""
    skip_reasons: tuple[str, ...] = ()
    at: float = field(default_factory=time.time)


@dataclass
class Diagnostics:
    strategy: str = ""
    skip_reasons: tuple[str, ...] = ()
    plan_seconds: float = 0.0


class SearchStats:
    def __init__(self, recent: int = 64):
        self.events: deque[Event] = deque(maxlen=max(1, recent))
        self.total = self.errors = self.zero = 0
        self.by: dict[str, dict] = {}

    def observe(self, query: str, strategy: str, seconds: float, returned: int, error: str = "", skip_reasons: tuple[str, ...] = ()) -> None:
        self.total += 1
        self.errors += bool(error)
        self.zero += not error and returned == 0
        s = self.by.setdefault(strategy, {"count": 0, "seconds": 0.0, "longest": 0.0, "returned": 0, "zero": 0, "errors": 0})
        s["count"] += 1
        s["seconds"] += seconds
        s["longest"] = max(s["longest"], seconds)
        s["returned"] += returned
        s["zero"] += not error and returned == 0
        s["errors"] += bool(error)
        self.events.append(Event(hashlib.sha256(query.encode()).hexdigest()[:16], strategy, seconds, returned, error, skip_reasons))

    def recent(self) -> list[Event]:
        """Newest first."""
        return list(reversed(self.events))
