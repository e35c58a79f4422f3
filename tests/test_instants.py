from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.functions.instants import zone_abbreviations, zone_lookup
from faultline.operators.timenorm import normalise_times

ZONES = {1: "America/Los_Angeles", 2: "Europe/Berlin", 3: "Asia/Kolkata", 4: "Australia/Sydney", 5: "UTC", 6: "No/Such_Zone", 7: None}


def micros(*args, zone=UTC):
    return int((datetime(*args, tzinfo=zone) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


@pytest.fixture(scope="module")
def read(spark):
    programs = spark.createDataFrame(list(ZONES.items()), "program_id bigint, zone_name string")

    def run(values, **policies):
        rows = [(i, v, str(p) if p is not None else None, "x", "y") for i, (v, p) in enumerate(values)]
        df = spark.createDataFrame(rows, "row_id bigint, t string, program_id string, value string, utc_micros string")
        out = normalise_times(df, ["t"], "program_id", programs, **policies).collect()
        return [r["utc_micros"] for r in sorted(out, key=lambda r: r["row_id"])]

    return run


def test_spellings(read):
    want = micros(2026, 5, 15, 4, 7, 16)
    same = [
        "2026-05-14T21:07:16.000 PDT", "2026-05-14T21:07:16-07:00", "2026-05-15T04:07:16Z", "20260515T040716Z", "2026-05-14 21:07:16", "  2026-05-14 21:07:16.000 PDT ", "14.05.2026 21:07:16,000 PDT",
        "05/14/2026 9:07:16 PM PDT", "May 15, 2026 4:07:16 AM UTC", "Fri, 15 May 2026 04:07:16 +0000", "2026/05/15 04:07:16 UTC", "1778818036", "1778818036000", "1778818036000000", "1778818036000000000", "1.778818036E9",
        "1778818036,000000", "2026-05-14T21:07:16.000-07:00[America/Los_Angeles]", "14.05.2026 21:07:16",
    ]
    assert read([(v, 1) for v in same]) == [want] * len(same)


def test_digits_beyond_micros_are_cut(read):
    assert read([("2026-01-01T00:00:00.1234569Z", 1), ("1767225600.123456999", 1)]) == [micros(2026, 1, 1) + 123456] * 2


@pytest.mark.parametrize("value", [None, "", "   ", "nan", "N/A", "phase", "0000-00-00 00:00:00", "2026-02-30T10:15:00.000 PST", "2025-13-04T25:61:00.000 PDT", "2026-05-14T24:00:00Z", "2026-05-14T10:00:00 XYZ", "2026-05-14T10:00:00+25:00", "13/14/2026 1:00:00 PM PDT", "05/14/2026 13:00:00 PM PDT"])
def test_no_instant(read, value):
    assert read([(value, 1)]) == [None]


def test_zone_comes_from_the_program(read):
    local = "2026-07-01 12:00:00"
    assert read([(local, p) for p in (1, 2, 3, 4, 5, 6, 7, None, 99)]) == [micros(2026, 7, 1, 12, zone=ZoneInfo(ZONES[p])) for p in (1, 2, 3, 4, 5)] + [None] * 4


def test_abbreviation_without_program_has_its_only_meaning(read):
    assert read([("2026-07-01T12:00:00.000 PDT", None), ("2026-07-01T12:00:00.000 IST", None)]) == [micros(2026, 7, 1, 19), micros(2026, 7, 1, 6, 30)]


def test_standard_abbreviation_counts_in_summer(read):
    assert read([("2026-07-01T12:00:00.000 PST", 1)]) == [micros(2026, 7, 1, 20)]


def test_repeated_and_skipped_hours(read):
    twice, never = ("2025-11-02 01:30:00", 1), ("2025-03-09 02:30:00", 1)
    assert read([twice, never]) == [micros(2025, 11, 2, 8, 30), None]
    assert read([twice, never], ambiguous="later", nonexistent="shift") == [micros(2025, 11, 2, 9, 30), micros(2025, 3, 9, 10, 30)]
    assert read([twice], ambiguous="null") == [None]


def test_empty(read):
    assert read([]) == []


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.datetimes(datetime(1999, 1, 1), datetime(2037, 1, 1)), st.sampled_from([1, 2, 3, 4, 5])), min_size=1, max_size=20))
def test_offsets_round_trip(read, drawn):
    moments = [(t.replace(tzinfo=UTC).astimezone(ZoneInfo(ZONES[p])), p) for t, p in drawn]
    got = read([(t.strftime("%Y-%m-%dT%H:%M:%S.%f") + t.strftime("%z")[:3] + ":" + t.strftime("%z")[3:5], p) for t, p in moments])
    assert got == [int((t - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)) for t, _ in moments]


def test_abbreviations():
    assert zone_abbreviations("America/Los_Angeles") == {"PST": -8 * 3600, "PDT": -7 * 3600}
    assert zone_abbreviations("No/Such_Zone") is None


def test_lookup_keeps_one_row_a_key(spark):
    lookup, unique = zone_lookup(spark.createDataFrame([(1, "UTC"), (1, "Europe/Berlin"), (None, "UTC")], "program_id bigint, zone_name string"), "program_id", "zone_name")
    assert [(r["_zone_key"], r["zone_name"]) for r in lookup.collect()] == [(1, "Europe/Berlin")]
    assert unique["CET"] == 3600
