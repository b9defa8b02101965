"""The one-line query language: text to a specification, on the driver."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

TOKEN = re.compile(r'[^\s"]*"[^"]*"|[^\s"]+')

# Keys and units of the language.
AGE_UNITS = {
    **dict.fromkeys(("y", "year", "years", "yr"), 365.25 * 86400),
    **dict.fromkeys(("mo", "month", "months"), 30.44 * 86400),
    **dict.fromkeys(("w", "week", "weeks"), 7 * 86400),
    **dict.fromkeys(("d", "day", "days"), 86400),
    **dict.fromkeys(("h", "hour", "hours", "hr"), 3600),
    **dict.fromkeys(("m", "min", "mins", "minute", "minutes"), 60),
}
DATE_KEYS = ("before", "after", "since", "modified", "date", "dm", "older", "newer")
WITHIN_KEYS = ("modified", "date", "dm")
KIND_KEYS = {"file": "file", "folder": "folder", "folders": "folder", "dir": "folder"}
DATES = (
    re.compile(r"(?P<y>\d{4})(?:-(?P<m>\d{1,2})(?:-(?P<d>\d{1,2}))?)?"),
    re.compile(r"(?P<d>\d{1,2})[/.-](?P<m>\d{1,2})[/.-](?P<y>\d{4})"),
    re.compile(r"(?P<m>\d{1,2})[/.-](?P<y>\d{4})"),
)


@dataclass(frozen=True)
class Range:
    """lo <= x < hi, either end open; negated: not that."""

    lo: float | None
    hi: float | None
    negated: bool = False


@dataclass
class QuerySpec:
    name: list[str] = field(default_factory=list)
    name_not: list[str] = field(default_factory=list)
    content: list[str] = field(default_factory=list)
    content_not: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    paths_not: list[str] = field(default_factory=list)
    exts: list[str] = field(default_factory=list)
    exts_not: list[str] = field(default_factory=list)
    kind: str | None = None
    when: list[Range] = field(default_factory=list)
    sizes: list[Range] = field(default_factory=list)

    def put(self, what: str, negated: bool, value: str) -> None:
        getattr(self, what + "_not" if negated else what).append(value)


class Clock:
    """What now is, and in which zone days begin."""

    def __init__(self, now: float | None = None, zone: str = "UTC"):
        self.zone = ZoneInfo(zone)
        self.now = datetime.now(self.zone).timestamp() if now is None else now

    def period(self, text: str) -> tuple[float, float] | None:
        """Start and end of the year, month or day named; None if it names none. A month or day of 0 is not given."""
        text = text.strip().lower()
        if text in ("today", "yesterday"):
            day = datetime.fromtimestamp(self.now, self.zone).date() - timedelta(days=text == "yesterday")
            y, m, d = day.year, day.month, day.day
        else:
            hit = next((x for x in (p.fullmatch(text) for p in DATES) if x), None)
            if not hit:
                return None
            y, m, d = (int(hit.groupdict().get(k) or 0) for k in "ymd")
        try:
            start = datetime(y, m or (1 if not d else 0), d or 1)
            if d:
                end = start + timedelta(days=1)
            elif m:
                end = start + timedelta(days=calendar.monthrange(y, m)[1])
            else:
                end = datetime(y + 1, 1, 1)
        except (ValueError, OverflowError):
            return None
        return tuple(x.replace(tzinfo=self.zone).timestamp() for x in (start, end))

    def when(self, key: str, value: str) -> Range | None:
        if not value:
            return None
        if key in ("older", "newer"):
            age = seconds(value)
            if age is None:
                return None
            return Range(None, self.now - age) if key == "older" else Range(self.now - age, None)
        if ".." in value:
            first, last = (self.period(x) for x in value.split("..", 1))
            return Range(first[0], last[1]) if first and last and key in WITHIN_KEYS else None
        named = self.period(value)
        if not named:
            return None
        return {"before": Range(None, named[0]), "after": Range(named[1], None), "since": Range(named[0], None)}.get(key, Range(*named))


def seconds(text: str) -> float | None:
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([a-z]+)", text.strip().lower())
    return float(m[1]) * AGE_UNITS[m[2]] if m and m[2] in AGE_UNITS else None


def byte_count(text: str) -> int | None:
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([kmgt]?)b?", text.strip().lower())
    return int(float(m[1]) * 1024 ** " kmgt".index(m[2] or " ")) if m else None


def size_range(value: str) -> Range | None:
    """At least, but for `<`, `<=`, `=` and a..b (without b)."""
    value = value.strip().lower()
    if ".." in value:
        lo, hi = (byte_count(x) for x in value.split("..", 1))
        return None if lo is None or hi is None else Range(lo, hi)
    m = re.match(r"(>=|<=|>|<|=|)(.*)", value, re.S)
    n = byte_count(m[2])
    if n is None:
        return None
    return {"<": Range(None, n), "<=": Range(None, n + 1), "=": Range(n, n + 1)}.get(m[1], Range(n, None))


def is_path(token: str) -> bool:
    """C:, C:\\x, /x, \\\\host and ~ are scopes, not names."""
    return bool(re.match(r"[^\W\d_]:(?:$|[\\/])|/|\\\\|~", token))


def extensions(text: str) -> list[str]:
    """pdf; .DOCX -> .pdf .docx"""
    bare = (x.strip().lstrip(".").lower() for x in re.split(r"[;,]", text))
    return ["." + x for x in bare if x]


def parse(text: str | None, clock: Clock | None = None) -> QuerySpec:
    """The specification of a query; null and blank text filter nothing. A filter that is not finished yet is ignored; of several
    kinds the last counts, negated or not."""
    clock, spec = clock or Clock(), QuerySpec()
    for token in TOKEN.findall(text or ""):
        negated = token.startswith("!")
        token = token[negated:]
        key, colon, value = token.partition(":")
        key = key.lower() if colon else ""
        if key == "content":
            if value.strip():
                spec.put("content", negated, value.strip())
        elif key in DATE_KEYS or key == "size":
            value = value.strip('"').strip()
            found = size_range(value) if key == "size" else clock.when(key, value)
            if found:
                (spec.sizes if key == "size" else spec.when).append(Range(found.lo, found.hi, negated))
        elif key == "ext":
            for x in extensions(value):
                spec.put("exts", negated, x)
        elif key == "path":
            if value.strip('"'):
                spec.put("paths", negated, value.strip('"'))
        else:
            if key in KIND_KEYS:
                spec.kind, token = KIND_KEYS[key], value
            if token:
                bare = token.strip('"')
                spec.put("paths" if is_path(bare) else "name", negated, bare)
    return spec
