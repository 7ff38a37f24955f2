"""Expressions that are written once and rendered for Spark SQL or for the checking engine's SQL.

An expression is a Python function of a :class:`Dialect` and SQL texts of its inputs. Spark runs it by ``expr`` inside
whole-stage code generation; the other rendering serves the oracle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    """How one engine spells what the engines spell differently."""

    spark: bool

    def text(self, value: str) -> str:
        """A string literal."""
        return f"r'{value}'" if self.spark else f"'{value}'"

    def like(self, col: str, pattern: str) -> str:
        """Whether a regular expression is found in a text."""
        return f"regexp_like({col}, {self.text(pattern)})" if self.spark else f"regexp_matches({col}, {self.text(pattern)})"

    def any_like(self, col: str, patterns: Sequence[str]) -> str:
        """Whether one of several is found; those bound to the start share one anchor, so that no engine tries them at every place."""
        bound, free = [p[1:] for p in patterns if p.startswith("^")], [p for p in patterns if not p.startswith("^")]
        tests = [self.like(col, "^(?:" + "|".join(f"(?:{p})" for p in bound) + ")")] if bound else []
        tests += [self.like(col, "|".join(f"(?:{p})" for p in free))] if free else []
        return tests[0] if len(tests) == 1 else f"({' or '.join(tests)})"

    def count(self, col: str, pattern: str) -> str:
        """Number of matches."""
        return f"cast(regexp_count({col}, {self.text(pattern)}) as bigint)" if self.spark else f"cast(len(regexp_extract_all({col}, {self.text(pattern)})) as bigint)"

    def extract(self, col: str, pattern: str, group: int = 1) -> str:
        """A group of the first match, or an empty text."""
        return f"regexp_extract({col}, {self.text(pattern)}, {group})"

    def extract_all(self, col: str, pattern: str, group: int = 0) -> str:
        """A group of all matches."""
        return f"regexp_extract_all({col}, {self.text(pattern)}, {group})"

    def replace(self, col: str, pattern: str, by: str) -> str:
        """Replace all matches by a literal text."""
        return f"regexp_replace({col}, {self.text(pattern)}, {self.text(by)})" if self.spark else f"regexp_replace({col}, {self.text(pattern)}, {self.text(by)}, 'g')"

    def has(self, col: str, part: str) -> str:
        """Whether a text holds another."""
        return f"contains({col}, {self.text(part)})"

    def any_of(self, col: str, parts: Sequence[str]) -> str:
        return "(" + " or ".join(self.has(col, p) for p in parts) + ")"

    def number_of(self, col: str, parts: Sequence[str]) -> str:
        """How many of the given texts occur."""
        return "cast(" + " + ".join(f"(case when {self.has(col, p)} then 1 else 0 end)" for p in parts) + " as bigint)"

    def strip(self, col: str) -> str:
        """Without ASCII white space at both ends."""
        return f"btrim({col}, ' \\u0009\\u000a\\u000b\\u000c\\u000d')" if self.spark else f"trim({col}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

    def words(self, col: str) -> str:
        return self.count(col, r"\S+")

    def words_from(self, col: str, number: int) -> str:
        """Whether a text has at least so many words; reads no further than these."""
        return self.like(col, rf"^\s*(?:\S+\s+){{{number - 1}}}\S")

    def guarded(self, col: str, parts: Sequence[str], test: str) -> str:
        """A costly test that needs one of the given characters, tried only where one occurs."""
        return f"({self.any_of(col, parts)} and {test})"

    def letters(self, col: str) -> str:
        return f"cast(length({col}) - length({self.replace(col, r'\p{L}+', '')}) as bigint)"

    def size(self, array: str) -> str:
        return f"cast(size({array}) as bigint)" if self.spark else f"cast(len({array}) as bigint)"

    def to_int(self, col: str) -> str:
        return f"try_cast({col} as bigint)"

    def split(self, col: str, sep: str) -> str:
        return f"split({col}, {self.text(sep)})" if self.spark else f"str_split_regex({col}, {self.text(sep)})"

    def keep(self, array: str, test: str) -> str:
        """Elements ``x`` of an array that pass a test."""
        return f"filter({array}, x -> {test})" if self.spark else f"list_filter({array}, lambda x: {test})"

    def each(self, array: str, value: str) -> str:
        return f"transform({array}, x -> {value})" if self.spark else f"list_transform({array}, lambda x: {value})"

    def distinct_sorted(self, array: str) -> str:
        return f"array_sort(array_distinct({array}))" if self.spark else f"list_sort(list_distinct({array}))"

    def join(self, array: str, sep: str) -> str:
        return f"array_join({array}, {self.text(sep)})" if self.spark else f"array_to_string({array}, {self.text(sep)})"

    def div(self, a: str, b: str) -> str:
        """Floor division of non-negative whole numbers."""
        return f"({a}) div ({b})" if self.spark else f"({a}) // ({b})"

    def double(self, col: str) -> str:
        return f"cast({col} as double)"

    def sha256(self, col: str) -> str:
        return f"sha2({col}, 256)" if self.spark else f"sha256({col})"


SPARK, CHECK = Dialect(True), Dialect(False)


def cases(*rules: tuple[str, str], otherwise: str) -> str:
    """An ordered choice: the first rule whose test holds."""
    return "case " + " ".join(f"when {test} then {value}" for test, value in rules) + f" else {otherwise} end"


def flag(test: str) -> str:
    """A test as a boolean that is never null."""
    return f"coalesce({test}, false)"
