"""Registry views that stay fresh for a while, as clients keep them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

#: Seconds for which a view is fresh, and further tries of a read that fails.
FRESH, RETRIES = 300.0, 1


class FreshViews:
    """Small views by name, read when asked for and again after FRESH seconds; a failed read is tried once more.

    Rows are held by the driver, so views are those of a registry, with a bound on their rows that is checked.
    """

    def __init__(self, read: Callable[[str], DataFrame], most: int = 10_000, clock: Callable[[], float] = time.monotonic):
        self.read, self.most, self.clock = read, most, clock
        self.held: dict[str, tuple[float, list]] = {}

    def get(self, name: str) -> list:
        now = self.clock()
        if name not in self.held or now - self.held[name][0] >= FRESH:
            self.held[name] = now, self._rows(name)
        return self.held[name][1]

    def refresh(self, name: str | None = None) -> None:
        """Forget a view, or all of them."""
        self.held = {} if name is None else {k: v for k, v in self.held.items() if k != name}

    def _rows(self, name: str) -> list:
        for left in range(RETRIES, -1, -1):
            try:
                rows = self.read(name).limit(self.most + 1).collect()
                break
            except Exception:
                if not left:
                    raise
        if len(rows) > self.most:
            raise ValueError(f"{name} has more than {self.most} rows")
        return rows
