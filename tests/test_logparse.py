from datetime import UTC, datetime

import pytest

from faultline.functions.logtokens import clean_line, clock_seconds, severity, tokens
from faultline.operators.logparse import GAP, SLOT, Miner, common_subsequence, join_templates, layout_of, parse_entries

SCHEMA = "log_id string, key_lines array<string>, error_message string, exported_at timestamp_ntz, us string, line string"
FIELDS = {"key_lines": "lines", "error_message": "text"}
AT = datetime(2026, 1, 10, 0, 0)


def sec(*args):
    return int(datetime(*args, tzinfo=UTC).timestamp())


def run(spark, logs):
    out = parse_entries(spark.createDataFrame([(*x, "", "") for x in logs], SCHEMA), "log_id", FIELDS, "exported_at")
    return sorted(tuple(r)[:7] for r in out.collect())


HEADS = [
    ("[ERROR] cannot find {w}", -1, "ERROR", ""),
    ("npm WARN cannot find {w}", -1, "WARN", "npm"),
    ("CRITICAL 2025-12-31T23:59:59Z [deploy.{w}] cannot find it", sec(2025, 12, 31, 23, 59, 59), "FATAL", "deploy.{w}"),
    ("2025-12-31 23:59:59,276 - c-{w} - NOTICE - cannot find it", sec(2025, 12, 31, 23, 59, 59), "INFO", "c-{w}"),
    ("2025-12-31 23:59:59 | SEVERE | c-{w} | cannot find it", sec(2025, 12, 31, 23, 59, 59), "ERROR", "c-{w}"),
    ("ts=2025-12-31T23:59:59.1Z level=trace component={w} msg=\"error at 5\"", sec(2025, 12, 31, 23, 59, 59), "DEBUG", "{w}"),
    ("level=err component={w} ts=2025-12-31T23:59:59.1Z msg=\"warn at 5\"", sec(2025, 12, 31, 23, 59, 59), "ERROR", "{w}"),
    ('{{"ts": "2025-12-31T23:59:59.1Z", "level": "warning", "logger": "{w}", "msg": "no \\"fatal\\" here"}}', sec(2025, 12, 31, 23, 59, 59), "WARN", "{w}"),
    ('{{"severity": "INFO", "time": 1767225599500, "component": "{w}", "message": "x"}}', sec(2025, 12, 31, 23, 59, 59), "INFO", "{w}"),
    ('{{"message": "error x", "component": "{w}", "@timestamp": "2025-12-31T23:59:59Z", "level": "DEBUG"}}', sec(2025, 12, 31, 23, 59, 59), "DEBUG", "{w}"),
    ("31.12.2025 23:59:59.188 *WARNING* [main] com.acme.core.{w} cannot find it", sec(2025, 12, 31, 23, 59, 59), "WARN", "com.acme.core.{w}"),
    ("2026-01-01T05:29:59.097+05:30  ERROR 11 --- [main] com.acme.core.{w} : cannot find it", sec(2025, 12, 31, 23, 59, 59), "ERROR", "com.acme.core.{w}"),
    ("<27>1 2025-12-31T23:59:59.173Z node-3 {w} 66 - - cannot find it", sec(2025, 12, 31, 23, 59, 59), "ERROR", "{w}"),
    ("Dec 31 23:59:59 node-3 {w}[44]: crit: cannot find it", sec(2025, 12, 31, 23, 59, 59), "FATAL", "{w}"),
    ("[Wed Dec 31 23:59:59.203888 2025] [{w}:emerg] [pid 7:tid 8] AH0: cannot find it", sec(2025, 12, 31, 23, 59, 59), "FATAL", "{w}"),
]
REST = ["    at com.acme.core.Loader.run(Loader.java:12)", "[cause] quota reached", "2026-02-21 is the date of the last good one", '{"hint":"clean first","code":667}', "Caused by: java.lang.IllegalStateException: kiln is closed", "", "(see attempt of 2026-01-16 04:13:22)"]


def test_every_layout(spark):
    logs, want = [], []
    for n, (text, at, level, component) in enumerate(HEADS):
        for w in ("alpha", "beta", "gamma"):
            key = f"l{n:02}{w}"
            head = text.format(w=w)
            logs.append((key, ["cut off beginning", "\x1b[31m  " + head + "\x1b[0m\r", *REST, head], head + "\n" + REST[0], AT))
            full = (at, level, component.format(w=w))
            want += [(key, "key_lines", 1, 1 + len(REST), *full), (key, "key_lines", 2 + len(REST), 1, *full), (key, "error_message", 0, 2, *full)]
    assert run(spark, logs) == sorted(want)


MORE_HEADS = [
    ("2025-12-31 23:59:59,123 [pool-1-{w}] ERROR com.acme.core.Loader - cannot find it", sec(2025, 12, 31, 23, 59, 59), "ERROR", "com.acme.core.Loader"),
    ("2025-12-31 23:59:59 [main] [tx {w}] WARN loader-{w}: cannot find it", sec(2025, 12, 31, 23, 59, 59), "WARN", "loader-{w}"),
    ("2025/12/31 23:59:59 [error] 123#0: *1 open() {w} failed", sec(2025, 12, 31, 23, 59, 59), "ERROR", ""),
    ("E1231 23:59:59.000000 1234 {w}.go:12] cannot find it", sec(2025, 12, 31, 23, 59, 59), "ERROR", ""),
    ("I1231 23:59:59.000001    7 {w}.cc:5] cannot find it", sec(2025, 12, 31, 23, 59, 59), "INFO", ""),
]


def test_layouts_with_bracketed_fields_slashed_dates_and_level_letters(spark):
    logs = [(f"l{n}{w}", ["cut off", text.format(w=w), REST[0]], None, AT) for n, (text, *_) in enumerate(MORE_HEADS) for w in ("alpha", "beta")]
    want = [(f"l{n}{w}", "key_lines", 1, 2, at, level, component.format(w=w)) for n, (_, at, level, component) in enumerate(MORE_HEADS) for w in ("alpha", "beta")]
    assert run(spark, logs) == sorted(want)


LONG = " ".join(f"part{n}" for n in range(30))
LONG_HEADS = [
    ("<27>1 2025-12-31T23:59:59.173Z " + "node." * 50 + "net loader 66 - - cannot find it", "ERROR", "loader"),
    ("2025-12-31 23:59:59.097  WARN 11 --- [" + "worker-" * 60 + "1] com.acme.core.Loader : cannot find it", "WARN", "com.acme.core.Loader"),
    (f"2025-12-31 23:59:59.097  ERROR 11 --- [{LONG}] com.acme.core.Loader : cannot find it", "ERROR", "com.acme.core.Loader"),
    (f"2025-12-31 23:59:59,123 [{LONG}] ERROR com.acme.core.Loader - cannot find it", "ERROR", "com.acme.core.Loader"),
    (f"2025-12-31 23:59:59 [{LONG}] [{LONG}] WARN loader-a: cannot find it", "WARN", "loader-a"),
]


@pytest.mark.parametrize("n", range(len(LONG_HEADS)))
def test_heads_of_any_length(spark, n):
    text, level, component = LONG_HEADS[n]
    assert run(spark, [("a", ["cut off", text, REST[0]], None, AT)]) == [("a", "key_lines", 1, 2, sec(2025, 12, 31, 23, 59, 59), level, component)]


def test_level_key_behind_any_number_of_keys(spark):
    keys = ", ".join(f'"k{n}": {n}' for n in range(300))
    deep = '"list": [1, [2, "x]"], 3], "o": {"level": "no", "p": {"q": 1}}'
    lines = [f'{{{keys}, {deep}, "message": "an \\"error\\" here", "level": "warn", "logger": "a"}}', " ".join(f"k{n}={n}" for n in range(300)) + ' note="level=info" level=error component=b msg="x level=info"']
    assert run(spark, [("a", lines, None, AT)]) == [("a", "key_lines", 0, 1, -1, "WARN", "a"), ("a", "key_lines", 1, 1, -1, "ERROR", "b")]


def test_programs_that_write_their_name_before_the_level_stay_apart(spark):
    logs = [(p, [f"{p} WARN cannot find it in pool", f"{p} ERR! cannot find it in pool"], None, AT) for p in ("npm", "yarn", "gulp")]
    assert [r[5:] for r in run(spark, logs)] == [("WARN", p) if n == 0 else ("ERROR", p) for p in ("gulp", "npm", "yarn") for n in range(2)]


def test_nulls_and_empties(spark):
    assert run(spark, []) == []
    logs = [("a", None, None, AT), ("b", [], "", AT), ("c", [None, "", "plain"], "npm task failed: x", AT), (None, ["[ERROR] x y", None], "[WARN] x y", None)]
    assert run(spark, logs[:3]) == []
    assert [r[1:] for r in run(spark, [logs[3]])] == [("error_message", 0, 1, -1, "WARN", ""), ("key_lines", 0, 2, -1, "ERROR", "")]


def test_very_long_lines(spark):
    logs = [(f"k{n}", ["[ERROR] " + f"w{n} " * 100_000, "rest " * 100_000], None, AT) for n in range(3)]
    assert run(spark, logs) == [(f"k{n}", "key_lines", 0, 2, -1, "ERROR", "") for n in range(3)]


def test_clock_without_year():
    us = lambda *a: sec(*a) * 10**6
    assert clock_seconds("Dec 31 10:00:00", us(2026, 1, 2)) == sec(2025, 12, 31, 10)
    assert clock_seconds("Jan  1 10:00:00", us(2026, 1, 2)) == sec(2026, 1, 1, 10)
    assert clock_seconds("Feb 29 10:00:00", us(2026, 1, 2)) == sec(2024, 2, 29, 10)
    assert clock_seconds("Jan 5 10:00:00", None) == clock_seconds("2026-13-01 10:00:00", 0) == clock_seconds(None, 0) == -1


@pytest.mark.parametrize(("word", "number", "want"), [("ERR!", None, "ERROR"), ("Emerg", None, "FATAL"), (None, "133", "INFO"), (None, "8", "FATAL"), ("nothing", None, None), (None, None, None)])
def test_severity(word, number, want):
    assert severity(word, number) == want


def test_subsequence_and_templates():
    a, b = "x <num> y z".split(), "x <num> q z".split()
    pairs = common_subsequence(a, b)
    assert [a[i] for i, _ in pairs] == ["x", "<num>", "z"]
    assert join_templates(a, b, pairs) == ["x", "<num>", SLOT, "z"]
    assert join_templates(["x", "z"], ["x", "q", "z"], [(0, 0), (1, 2)]) == ["x", GAP, "z"]
    miner = Miner()
    for w in ("alpha", "beta", "gamma"):
        miner.add(tokens(clean_line(f"[ERROR] cannot find {w} in pool")))
    assert list(miner.templates()) == [(["[", "<level>", "]", "cannot", "find", SLOT, "in", "pool"], 3)]


def test_no_layout_without_level():
    for line in REST[:4] + ["Java heap exhausted during step", "error rate 5% above threshold"]:
        assert layout_of(tokens(clean_line(line))) is None
