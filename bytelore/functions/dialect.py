"""The two engines' spellings of the few functions in which they differ, so that a rule is written once as SQL text.

Spark evaluates the text through ``expr``; DuckDB runs the same rule as a check.  Patterns keep to what both engines'
regular expressions share and hold no quote.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

# Ranges of classes and the characters in them.
_RANGES = {"A-Z": string.ascii_uppercase, "a-z": string.ascii_lowercase, "0-9": string.digits, "A-F": "ABCDEF", "a-f": "abcdef"}


def _spelled(pattern: str) -> str:
    """The same pattern with ranges of letters and digits spelled out: Java looks such classes up in one table, ranges are a test each."""
    return re.sub("|".join(_RANGES), lambda m: _RANGES[m.group()], pattern)


@dataclass(frozen=True)
class Dialect:
    duck: bool = False

    def like(self, text: str, pattern: str, java: str | None = None, needs: str | None = None) -> str:
        """Whether the pattern occurs.  For Spark alone: ``java`` has the same matches and takes less time, ``needs`` is in every match."""
        if self.duck:
            return f"regexp_matches({text}, '{pattern}')"
        found = f"regexp_like({text}, r'{_spelled(java or pattern)}')"
        return f"({self.has(text, needs)} and {found})" if needs else found

    def count(self, text: str, pattern: str) -> str:
        return f"len(regexp_extract_all({text}, '{pattern}'))" if self.duck else f"regexp_count({text}, r'{_spelled(pattern)}')"

    def strip(self, text: str, pattern: str) -> str:
        """The text without what matches."""
        return f"regexp_replace({text}, '{pattern}', '', 'g')" if self.duck else f"regexp_replace({text}, r'{_spelled(pattern)}', '')"

    def lines(self, text: str, first: int, pattern: str) -> str:
        """How many of the first lines match."""
        if self.duck:
            return f"len(list_filter(string_split({text}, chr(10))[1:{first}], lambda x: regexp_matches(x, '{pattern}')))"
        return f"size(filter(slice(split({text}, '\\n', -1), 1, {first}), x -> regexp_like(x, r'{_spelled(pattern)}')))"

    def has(self, text: str, *needles: str) -> str:
        """Whether any of the needles occurs; a needle's line feeds and tabs are written as in Python."""
        return "(" + " or ".join(f"contains({text}, {self.text(n)})" for n in needles) + ")"

    @staticmethod
    def text(s: str) -> str:
        """A literal that both engines read alike."""
        parts: list[str] = []
        for piece in s.replace("\n", "\0\n\0").replace("\t", "\0\t\0").replace("\\", "\0\\\0").replace("'", "\0'\0").split("\0"):
            if piece:
                parts.append(f"chr({ord(piece)})" if piece in "\n\t\\'" else f"'{piece}'")
        return parts[0] if len(parts) == 1 else "concat(" + ", ".join(parts) + ")"

    def number(self, *conditions: str) -> str:
        return "(" + " + ".join(f"cast({c} as int)" for c in conditions) + ")"


SPARK, DUCK = Dialect(), Dialect(duck=True)
