"""Results that a worker remembers in bounded memory."""

from __future__ import annotations

from collections.abc import Callable


class Generations(dict):
    """Values of bytes by text in two generations of about ``limit`` bytes each: when one is full, what it did not
    use is forgotten with the one before. ``make`` computes what is asked for and not remembered."""

    def __init__(self, limit: int, make: Callable[[str], bytes]):
        super().__init__()
        self.limit, self.make, self.size, self.old = limit, make, 0, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if self.size > self.limit:
            self.turn()
        self.size += 200 + len(key) + len(value)
        self[key] = value
        return value

    def turn(self) -> None:
        self.old, self.size = dict(self), 0
        self.clear()
