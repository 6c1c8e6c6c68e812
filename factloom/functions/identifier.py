"""Identifier and qualified-name functions as columns. Case rules are ASCII only; non-ASCII characters count as lower-case letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HIGH = r"\x{80}-\x{10FFFF}"
_LOWER, _LETTER = f"[a-z{_HIGH}]", f"[A-Za-z{_HIGH}]"
#: Between a lower-case letter and an upper-case one, a letter and a digit, and before the last capital of an acronym.
_BOUNDARY = f"(?<={_LOWER})(?=[A-Z])|(?<={_LETTER})(?=[0-9])|(?<=[0-9])(?={_LETTER})|(?<=[A-Z])(?=[A-Z]{_LOWER})"
_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trim_ascii(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$", "")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def identifier_components(c: Column) -> Column:
    """TryConnect -> [try, connect]; HTTP2Server -> [http, 2, server]."""
    return F.filter(F.split(lower_ascii(F.regexp_replace(c, _BOUNDARY, " ")), _SEPARATOR), lambda x: x != "")


def contains_run(have: Column, wanted: Column) -> Column:
    """wanted stands in have as consecutive elements; an empty one never does. Components hold no separators."""
    joined = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return (F.size(wanted) > 0) & F.contains(joined(have), joined(wanted))


def qualified_name(owners: Column, name: Column) -> Column:
    """Owner names (an array) and the name, joined by '::'; an empty one is '(anonymous)'."""
    shown = lambda x: F.when(x == "", F.lit("(anonymous)")).otherwise(x)
    return F.array_join(F.concat(F.transform(owners, shown), F.array(shown(name))), "::")


class QualifiedQuery:
    """A qualified name to search: anchored by a leading '::', else a suffix at a '::'. Raises ValueError if malformed."""

    def __init__(self, query: str) -> None:
        self.anchored = query.startswith("::")
        self.text = query[2:] if self.anchored else query
        self.last = self.text.rpartition("::")[2]
        if not self.last or ":::" in self.text or self.text.startswith("::"):
            raise ValueError(f"malformed qualified name {query!r}")

    def matches(self, qualified: Column) -> Column:
        same = qualified == self.text
        return same if self.anchored else same | qualified.endswith("::" + self.text)
