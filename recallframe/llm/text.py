"""Text helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a maximal run of bytes outside these six; ``bytes.split()`` cuts at the same six.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
#: Length of the longest key that a ``Memo`` keeps.
LONG = 256


def word_count(text: Column) -> Column:
    """Words of the whole text, 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")).cast("long")


class Memo(dict):
    """A dict that fills itself from ``make`` and starts anew at ``bound`` entries; keys longer than ``LONG`` aren't kept.

    Looking up with ``map(memo.__getitem__, keys)`` stays in C for known keys.
    """

    def __init__(self, make, bound: int):
        super().__init__()
        self.make, self.bound = make, bound

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONG:
            if len(self) >= self.bound:
                self.clear()
            self[key] = value
        return value
