"""A first-in, first-out buffer of samples, as it is kept in a stream's state."""

from __future__ import annotations

import warnings

import numpy as np

OVERFLOW = ("grow", "raise", "drop", "overwrite")


class Buffer:
    """Rows of one width in order. `at` is the reading position: what lies before it has been read and can still be
    returned to with seek until room is needed. overflow: what happens when more unread rows come than `capacity` has
    room for: grow up to `most` rows, raise, drop the new ones, or overwrite the oldest (with a warning)."""

    def __init__(self, capacity: int, width: int = 1, overflow: str = "grow", most: int = 1 << 27):
        if overflow not in OVERFLOW:
            raise ValueError(f"unknown overflow strategy {overflow!r}")
        self.capacity, self.overflow, self.most = capacity, overflow, most
        self.rows, self.at = np.empty((0, width)), 0

    def available(self) -> int:
        return len(self.rows) - self.at

    def write(self, rows: np.ndarray) -> int:
        """The number of rows that were taken."""
        rows = np.asarray(rows, float).reshape(len(rows), -1)
        over = self.available() + len(rows) - self.capacity
        if over > 0:
            if self.overflow == "grow":
                if self.available() + len(rows) > self.most:
                    raise MemoryError(f"the buffer would exceed {self.most} rows")
                self.capacity = self.available() + len(rows)
            elif self.overflow == "raise":
                raise OverflowError(f"{over} rows too many for a buffer of {self.capacity}")
            elif self.overflow == "drop":
                rows = rows[: max(0, len(rows) - over)]
            else:
                warnings.warn(f"{over} unread rows are overwritten", RuntimeWarning, stacklevel=2)
        held = np.concatenate([self.rows, rows])
        gone = max(0, len(held) - self.capacity)
        self.rows, self.at = held[gone:], max(0, self.at - gone)
        return len(rows)

    def peek(self, n: int | None = None) -> np.ndarray:
        return self.rows[self.at : None if n is None else self.at + n]

    def peek_at(self, i: int) -> np.ndarray:
        if not 0 <= i < self.available():
            raise IndexError(f"{i} of {self.available()} unread rows")
        return self.rows[self.at + i]

    def peek_last(self) -> np.ndarray:
        if not len(self.rows):
            raise IndexError("the buffer is empty")
        return self.rows[-1]

    def read(self, n: int | None = None) -> np.ndarray:
        out = self.peek(n)
        self.at += len(out)
        return out

    def seek(self, n: int) -> int:
        """Moves the reading position by n, back for a negative one, as far as rows are held; the number moved."""
        before = self.at
        self.at = min(max(0, self.at + n), len(self.rows))
        return self.at - before

    def flush(self) -> None:
        self.rows, self.at = self.rows[:0], 0
