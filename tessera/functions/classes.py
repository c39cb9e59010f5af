"""Character classes of Unicode 16, taken from the ICU library that Spark ships, and the split patterns made of them."""

from __future__ import annotations

import bisect
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import SparkSession

_FOUND: dict[str, Classes] = {}


def ranges_of(points: set[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for p in sorted(points):
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(a, b) for a, b in out]


def regex_class(ranges) -> str:
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


@dataclass(frozen=True)
class Classes:
    """Ranges of letters, numbers and spaces, and what the JVM's own classes lack of the first two."""

    letters: tuple[tuple[int, int], ...]
    numbers: tuple[tuple[int, int], ...]
    spaces: tuple[tuple[int, int], ...]
    more_letters: tuple[tuple[int, int], ...]
    more_numbers: tuple[tuple[int, int], ...]

    def classify(self, point: int) -> str:
        for name, ranges in (("S", self.spaces), ("L", self.letters), ("N", self.numbers)):
            k = bisect.bisect_right(ranges, (point, 0x110000)) - 1
            if k >= 0 and ranges[k][0] <= point <= ranges[k][1]:
                return name
        return "O"

    def _pattern(self, letters: str, numbers: str) -> str:
        w = regex_class(self.spaces)
        return f"'(?:[stmd]|re|ve|ll)| ?[\\p{{L}}{letters}]+| ?[\\p{{N}}{numbers}]+| ?[^{w}\\p{{L}}\\p{{N}}{letters}{numbers}]+|[{w}]+(?![^{w}])|[{w}]+"

    @cached_property
    def short(self) -> str:
        """For texts without a character from ``first_new`` on."""
        return self._pattern("", "")

    @cached_property
    def full(self) -> str:
        return self._pattern(regex_class(self.more_letters), regex_class(self.more_numbers))

    @cached_property
    def first_new(self) -> int | None:
        """The lowest character that the JVM's classes lack."""
        return min((r[0] for r in (*self.more_letters, *self.more_numbers)), default=None)


def classes(spark: SparkSession) -> Classes:
    """Found once for each application."""
    key = spark.sparkContext.applicationId
    if key not in _FOUND:
        jvm = spark._jvm

        def icu(name: str) -> list[tuple[int, int]]:
            found = jvm.com.ibm.icu.text.UnicodeSet(f"[:{name}:]")
            return [(found.getRangeStart(i), found.getRangeEnd(i)) for i in range(found.getRangeCount())]

        every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)

        def missing(name: str, ranges) -> tuple[tuple[int, int], ...]:
            known = set(map(ord, jvm.java.util.regex.Pattern.compile(f"\\P{{{name}}}+").matcher(every).replaceAll("")))
            want = {p for a, b in ranges for p in range(max(a, 0x80), b + 1)}
            return tuple(ranges_of(want - known))

        letters, numbers, spaces = icu("L"), icu("N"), icu("White_Space")
        _FOUND[key] = Classes(tuple(letters), tuple(numbers), tuple(spaces), missing("L", letters), missing("N", numbers))
    return _FOUND[key]
