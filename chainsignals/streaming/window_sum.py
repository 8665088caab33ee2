"""The sum over a queue, in constant time for each row that enters or leaves."""

from __future__ import annotations

from collections.abc import Iterable


class WindowSum:
    """A queue of numbers as two stacks, the older with the sums of all that is above the bottom.

    Nothing is subtracted, so what has left the queue leaves no rounding error behind.
    """

    def __init__(self, values: Iterable[float] = ()):
        self.newer: list[float] = list(values)
        self.newer_sum = sum(self.newer)
        #: From the newest on, the sum of what the older stack holds up to there.
        self.older: list[float] = []

    def append(self, value: float) -> None:
        self.newer.append(value)
        self.newer_sum += value

    def popleft(self) -> None:
        """Remove the oldest number."""
        if not self.older:
            total = 0.0
            for x in reversed(self.newer):
                total += x
                self.older.append(total)
            self.newer, self.newer_sum = [], 0.0
        self.older.pop()

    @property
    def total(self) -> float:
        return (self.older[-1] if self.older else 0.0) + self.newer_sum

    def __len__(self) -> int:
        return len(self.newer) + len(self.older)
