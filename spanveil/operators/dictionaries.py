"""What a caller may add to the built-in detectors: names, patterns, and the word lists of the name detector."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions import fixed_values as fixed
from spanveil.functions.dialect import java_regex


@dataclass(frozen=True)
class NameLists:
    """Word lists of the known-name detector. All four are parameters; the defaults are the built-in lists."""

    first: frozenset[str] = frozenset(fixed.FIRST_NAMES)
    last: frozenset[str] = frozenset(fixed.LAST_NAMES)
    ambiguous: frozenset[str] = frozenset(fixed.AMBIGUOUS_WORDS)
    suppress: frozenset[str] = frozenset(fixed.SUPPRESS_WORDS)

    def extended(self, first: list[str] = (), last: list[str] = ()) -> NameLists:
        """These lists plus further first and last names (for example a national register)."""
        more_first = {w.strip().lower() for w in first} - {""}
        more_last = {w.strip().lower() for w in last} - {""}
        return replace(self, first=self.first | more_first, last=self.last | more_last)

    @classmethod
    def from_files(cls, first: str | None = None, last: str | None = None) -> NameLists:
        """The built-in lists with the first or last names of a file (on the driver) in their place."""
        lists = cls()
        if first:
            lists = replace(lists, first=frozenset(w.lower() for w in fixed.read_words(first)))
        if last:
            lists = replace(lists, last=frozenset(w.lower() for w in fixed.read_words(last)))
        return lists

    @property
    def candidates(self) -> list[str]:
        """Words of two or more ASCII letters that the detector can ever accept."""
        words = (self.first | self.last | self.ambiguous) - self.suppress
        return sorted(w for w in words if re.fullmatch("[a-z]{2,}", w))


@dataclass(frozen=True)
class CustomPattern:
    """A user-supplied format. ``flags`` as in a browser: any of g, i, m, s, u, y (always applied globally)."""

    regex: str
    flags: str = "gi"
    label: str = "Custom Pattern"
    placeholder: str = "CUSTOM_PII"
    name: str = ""  # what the id is made of where it isn't the label

    def __post_init__(self):
        unknown = set(self.flags) - set("gimsuy")
        if unknown:
            raise ValueError(f"unknown pattern flags: {sorted(unknown)}")
        probes = ["", "a", "a b", "1", "-"]
        flags = re.IGNORECASE if "i" in self.flags else 0
        try:
            compiled = re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", self.regex), flags)
        except re.error:
            return  # syntax Python lacks; Java decides
        if any(m.group(0) == "" for p in probes for m in compiled.finditer(p)):
            raise ValueError(f"pattern can match empty text: {self.regex!r}")

    @property
    def id(self) -> str:
        return f"custom_{self.name or self.label}"

    @classmethod
    def from_record(cls, record) -> CustomPattern:
        """From a record of a config: regex, and if given flags, label, placeholder; further keys are ignored. The id is
        made of the label, else of the placeholder, else it is custom_pattern."""
        if not isinstance(record, Mapping) or not isinstance(record.get("regex"), str):
            raise ValueError(f"not a pattern: {record!r}")
        given = {k: str(record[k]) for k in ("flags", "label", "placeholder") if record.get(k)}
        return cls(record["regex"], **given, name=given.get("label") or given.get("placeholder") or "pattern")

    @property
    def java(self) -> str:
        return java_regex(
            self.regex,
            ignore_case="i" in self.flags,
            multiline="m" in self.flags,
            dot_all="s" in self.flags,
        )


@dataclass(frozen=True)
class Dictionaries:
    """User dictionaries as an immutable value: pass it to the operators; an empty one switches it off.

    ``names`` are literals of the query plan; ``names_table`` (column ``name``) holds any number of further names, which
    are joined. Both have the same effect.
    """

    names: frozenset[str] = frozenset()
    patterns: tuple[CustomPattern, ...] = ()
    lists: NameLists = field(default_factory=NameLists)
    names_table: DataFrame | None = None

    def add_names(self, names) -> Dictionaries:
        names = list(names)
        if not all(isinstance(n, str) for n in names):
            raise ValueError("names must be strings")
        cleaned = {n.lower().strip() for n in names} - {""}
        return replace(self, names=self.names | cleaned)

    def add_patterns(self, patterns) -> Dictionaries:
        """Add patterns given as ``CustomPattern`` or as records with regex and optional flags, label, placeholder."""
        made = tuple(p if isinstance(p, CustomPattern) else CustomPattern.from_record(p) for p in patterns)
        return replace(self, patterns=self.patterns + made)

    def clear(self) -> Dictionaries:
        return Dictionaries(lists=self.lists)

    def stats(self) -> dict[str, int]:
        """Distinct names, those of the table included (which is read for it), and patterns."""
        return {"customNames": self.count_names(), "customPatterns": len(self.patterns)}

    def count_names(self) -> int:
        if self.names_table is None:
            return len(self.names)
        from spanveil.operators.custom_join import prepare_names  # which reads this module

        further = prepare_names(self.names_table)
        if self.names:
            further = further.where(~F.col("name").isin(sorted(self.names)))
        return len(self.names) + further.count()
