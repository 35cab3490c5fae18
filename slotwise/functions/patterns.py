"""Configured Python patterns as Java patterns for Spark's regex functions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: '.' and '$' know only the line feed, and classes are Unicode's, as in Python.
FLAGS = "(?dU)"
#: Stands between the groups of a match; log lines hardly hold this control character.
MARK = "\x01"


@dataclass(frozen=True)
class Pattern:
    """A pattern in Java's dialect, with the numbers of its groups by name."""

    java: str
    names: dict[str, int]
    groups: int

    def found(self, text: Column) -> Column:
        """Whether it matches anywhere."""
        return text.rlike(self.java)

    def at_start(self) -> "Pattern":
        """The same pattern, only at the start of a text."""
        return Pattern(f"{FLAGS}^(?:{self.java.removeprefix(FLAGS)})", self.names, self.groups)

    def match(self, text: Column) -> Column:
        """All groups of the first match as an array, the whole match left out; an array of one element if there is none.

        One run of the pattern puts the groups between marks; only a text that holds the mark itself is
        matched group by group.  A group that took no part gives ''.  ``captured`` reads the groups.
        """
        # The match is found as a search does: at the first start at which it fits.
        whole = f"{FLAGS}\\A(?s:.*?)(?:{self.java.removeprefix(FLAGS)})(?s:.*)\\z"
        marked = F.regexp_replace(text, F.lit(whole), F.lit(MARK + "".join(f"${g}{MARK}" for g in range(1, self.groups + 1))))
        slowly = F.when(self.found(text), F.array(F.lit(""), *[F.regexp_extract(text, self.java, g) for g in range(1, self.groups + 1)], F.lit(""))).otherwise(F.array(text))
        return F.when(F.contains(text, F.lit(MARK)), slowly).otherwise(F.split(marked, MARK, -1))

    def captured(self, match: Column, group: int | str) -> Column:
        """A group from ``match``."""
        return F.get(match, self.names[group] if isinstance(group, str) else group)

    def group(self, text: Column, group: int | str) -> Column:
        """A group of the first match; '' if there is no match or the group took no part."""
        return F.regexp_extract(text, self.java, self.names[group] if isinstance(group, str) else group)


def portable(pattern: str) -> Pattern:
    """``pattern`` for Java: named groups become numbered ones, ends of text become Java's."""
    compiled = re.compile(pattern)
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(r"\z" if pattern[i + 1 : i + 2] == "Z" and not inside else pattern[i : i + 2])
            i += 2
        elif not inside and (m := re.compile(r"\(\?P<\w+>").match(pattern, i)):
            out.append("(")
            i = m.end()
        elif not inside and (m := re.compile(r"\(\?P=(\w+)\)").match(pattern, i)):
            out.append(f"(?:\\{compiled.groupindex[m[1]]})")
            i = m.end()
        else:
            if c == "[" and inside:
                out.append("\\")  # Java would open a nested class
            inside = c == "[" or inside and not (c == "]" and pattern[i - 1] != "[" and pattern[i - 2 : i] != "[^")
            out.append(c)
            i += 1
    return Pattern(FLAGS + "".join(out), dict(compiled.groupindex), compiled.groups)


def glob_pattern(glob: str) -> str:
    """A Java pattern for a whole name: * any run, ? any character, case ignored."""
    parts = {"*": ".*", "?": "."}
    return "(?is)^" + "".join(parts.get(c, re.escape(c)) for c in glob) + "$"


def matches_any(name: Column, globs: list[str]) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | name.rlike(glob_pattern(g))
    return found


def without_sequence(pattern: str, sequence_pattern: str) -> str | None:
    """The journal pattern for lines without a sequence: the marker's single occurrence is cut out, three groups must stay."""
    for marker in (sequence_pattern, r"No\[(\d+)\]"):
        if marker and pattern.count(marker) == 1:
            cut = pattern.replace(marker, "", 1)
            try:
                return cut if re.compile(cut).groups == 3 else None
            except re.error:
                return None
    return None
