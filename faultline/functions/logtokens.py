"""Tokens, levels and clocks of log lines (plain Python, used inside Arrow batches)."""

from __future__ import annotations

import re
from calendar import timegm
from datetime import UTC, datetime

#: Level words -> severity.
LEVELS = {
    "fatal": "FATAL", "critical": "FATAL", "crit": "FATAL", "alert": "FATAL", "emerg": "FATAL", "emergency": "FATAL", "panic": "FATAL",
    "error": "ERROR", "err": "ERROR", "severe": "ERROR",
    "warn": "WARN", "warning": "WARN",
    "info": "INFO", "notice": "INFO", "information": "INFO",
    "debug": "DEBUG", "trace": "DEBUG", "verbose": "DEBUG", "fine": "DEBUG", "finer": "DEBUG", "finest": "DEBUG",
}
#: Syslog severity numbers 0-7.
SYSLOG = ["FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG"]
#: Key names of structured layouts.
LEVEL_KEYS = {"level", "severity", "lvl", "loglevel", "log_level", "log.level"}
TIME_KEYS = {"ts", "time", "timestamp", "@timestamp", "date", "datetime", "t"}
COMPONENT_KEYS = {"component", "logger", "module", "logger_name", "program", "app", "service"}

MONTHS = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}
_MON = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
TIME = (
    r"(?:\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?"
    r"|\d{4}/\d\d/\d\d \d\d:\d\d:\d\d(?:[.,]\d+)?"
    r"|\d\d\.\d\d\.\d{4} \d\d:\d\d:\d\d(?:[.,]\d+)?"
    rf"|(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) {_MON} +\d{{1,2}} \d\d:\d\d:\d\d(?:[.,]\d+)? \d{{4}}"
    rf"|{_MON} +\d{{1,2}} \d\d:\d\d:\d\d(?![\d:]))"
)
#: A level letter and a time without year, written as one word: E0102 15:04:05.000000.
MARK_TIME = r"\d{4} \d\d:\d\d:\d\d(?:\.\d+)?"
MARKS = {"I": "info", "W": "warn", "E": "error", "F": "fatal"}
LEVEL = rf"(?i:{'|'.join(sorted(LEVELS, key=len, reverse=True))})"
STRING = r'"(?:[^"\\]|\\.)*"'
WORD = r"[^\W\d][\w$]*(?:[.\-/$@][\w$]+)*"

#: What surrounds a line and is no part of it: terminal colours and blanks.
_COLOUR = re.compile(r"\x1b\[[0-9;?]*[A-Za-z]|\x1b[()][A-Z0-9]")
_TOKEN = re.compile(
    rf'(?P<mark>(?:^)[{"".join(MARKS)}]{MARK_TIME}(?![\d:]))|(?P<jkey>"[\w@.\-]+"\s*:)|(?P<time>{TIME})|(?P<str>{STRING})|(?P<key>[A-Za-z_@][\w.@\-]*=)(?=\S)'
    rf"|(?P<level>(?<![\w./\-]){LEVEL}(?![\w/\-]|\.\w)!?)|(?P<word>{WORD})|(?P<num>\d+(?:\.\d+)?)|(?P<punct>\S)"
)
_FULL_TIME, _FULL_LEVEL = re.compile(TIME), re.compile(LEVEL)
_CLASS = re.compile(r"[a-z][\w$]*(?:\.[\w$]+){2,}")


def clean_line(line: str) -> str:
    """``line`` without terminal colours and outer blanks."""
    if "\x1b" in line:
        line = _COLOUR.sub("", line)
    return line.strip()


def key_name(token: str) -> str:
    """The bare lower-case name of a key token such as ``"ts":`` or ``level=``."""
    return token.strip('":= \t').lower()


def tokens(line: str) -> list[str]:
    """The line as symbols: typed ones in angle marks, keys, words and punctuation as they are.

    ``<time> <level> <num> <str> <strtime> <strlevel>`` are types, ``<class>``
    a dotted name of three or more parts.  Keys count only in a line that opens
    with a brace or a key; elsewhere ``name=`` and ``"name":`` are ordinary text.
    """
    out, keyed = [], line.startswith("{")
    for m in _TOKEN.finditer(line):
        kind, text = m.lastgroup, m.group()
        if kind == "key" and not out:
            keyed = True
        if kind in ("jkey", "key") and not keyed:
            out.extend([text.strip('":= '), text[-1]])
            continue
        if kind == "str":
            inner = text[1:-1]
            out.append("<strtime>" if _FULL_TIME.fullmatch(inner) else "<strlevel>" if _FULL_LEVEL.fullmatch(inner) else "<str>")
        elif kind == "word":
            out.append("<class>" if _CLASS.fullmatch(text) else text)
        elif kind == "jkey":
            out.append(f'"{key_name(text)}":')
        elif kind in ("key", "punct"):
            out.append(text)
        else:
            out.append(f"<{kind}>")
    return out


def severity(text: str | None, number: str | None) -> str | None:
    """Severity of a level word, or of a syslog number (facility included)."""
    if text is not None:
        text = MARKS.get(text, text)
        return LEVELS.get(text.rstrip("!").lower())
    return SYSLOG[int(number) % 8] if number is not None else None


def clock_seconds(text: str | None, exported_micros: int | None) -> int:
    """UTC seconds of a log clock, fraction cut; -1 if there is none or it is no date.

    Clocks run on UTC unless an offset is written.  A time without year is the
    latest one not after the export; without an export time it has none.
    """
    if not text:
        return -1
    try:
        if text.isdigit():
            return int(text) // {10: 1, 13: 1000, 16: 10**6, 19: 10**9}[len(text)]
        if re.fullmatch(MARK_TIME, text):
            text = f"{list(MONTHS)[int(text[:2]) - 1]} {text[2:4]} {text[5:13]}"
        if text[2:3] == ".":
            date, clock = text[:10].split("."), text[11:19]
            return _seconds(int(date[2]), int(date[1]), int(date[0]), clock, 0)
        if text[0].isdigit():
            zone = re.search(r"([+-])(\d\d):?(\d\d)$", text[19:])
            offset = (int(zone[2]) * 3600 + int(zone[3]) * 60) * (-1 if zone[1] == "-" else 1) if zone else 0
            return _seconds(int(text[:4]), int(text[5:7]), int(text[8:10]), text[11:19], offset)
        parts = text.split()
        if len(parts) == 5:
            return _seconds(int(parts[4]), MONTHS[parts[1]], int(parts[2]), parts[3][:8], 0)
        if exported_micros is None:
            return -1
        for year in range(datetime.fromtimestamp(exported_micros // 10**6, UTC).year, 0, -1):
            if parts[1] in ("29",) and parts[0] == "Feb" and (year % 4 or (year % 100 == 0 and year % 400)):
                continue
            found = _seconds(year, MONTHS[parts[0]], int(parts[1]), parts[2], 0)
            if found * 10**6 <= exported_micros:
                return found
    except (ValueError, KeyError, IndexError):
        pass
    return -1


def _seconds(year: int, month: int, day: int, clock: str, offset: int) -> int:
    moment = datetime(year, month, day, int(clock[:2]), int(clock[3:5]), int(clock[6:8]))
    return timegm(moment.timetuple()) - offset
