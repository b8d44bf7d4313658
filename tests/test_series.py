"""Series of events in the JVM against `occurrences`, which walks them one by one."""

import random

import pytest

from gleanwork.functions import recurrence

RULES = [
    "FREQ=WEEKLY;BYDAY=MO,WE;UNTIL=20240215", "FREQ=WEEKLY;BYDAY=WE,MO", "FREQ=WEEKLY;BYDAY=TU;COUNT=9", "FREQ=WEEKLY;BYDAY=TU;INTERVAL=2;COUNT=4", "FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,TU", "FREQ=DAILY;BYDAY=MO",
    "FREQ=DAILY", "FREQ=DAILY;UNTIL=20991231", "FREQ=DAILY;UNTIL=20240105T101112Z;INTERVAL=2", "UNTIL=20240301;FREQ=WEEKLY", "FREQ=DAILY;COUNT=5;UNTIL=20240103", "FREQ=DAILY;UNTIL=20240231", "FREQ=DAILY;UNTIL=20230101", "FREQ=DAILY;COUNT=512",
    "FREQ=DAILY;COUNT=600", "FREQ=WEEKLY;COUNT=3;COUNT=4", "freq=weekly;count=2", "FREQ=WEEKLY;BYDAY=SU,SU;COUNT=3", "FREQ=WEEKLY;BYDAY=MO,TU,WE,TH,FR,SA,SU", "FREQ=HOURLY", "FREQ=MONTHLY;COUNT=2", "FREQ=DAILY;;COUNT=2", "COUNT=2", "FREQ=DAILYINTERVAL=2", ";FREQ=DAILY;COUNT=2", "", None,
]


@pytest.fixture(scope="module")
def events(spark):
    random.seed(3)
    rows = []
    for rule in RULES:
        for _ in range(9):
            start = f"20{random.choice(['23', '24', '24', '99'])}-{random.randint(1, 12):02d}-{random.randint(1, 28):02d}T{random.randint(0, 23):02d}:11:12" + random.choice(["Z", ".250Z", "Z"])
            end = random.choice([None, start.replace(":11:", ":31:")])
            rows.append((len(rows), start, end, end is not None, rule))
    rows += [(len(rows), "", None, False, "FREQ=DAILY"), (len(rows) + 1, "no time", None, False, "FREQ=DAILY"), (len(rows) + 2, "2024-01-01T00:00:00Z", None, True, "FREQ=DAILY")]
    return spark.createDataFrame(rows, "doc_id bigint, start string, end string, end_given boolean, recurrence string")


@pytest.fixture(scope="module")
def want(events):
    return {r["doc_id"]: recurrence.occurrences(r["recurrence"], r["start"], r["end"], r["end_given"]) for r in events.collect()}


def test_expanded(events, want):
    got = sorted(tuple(r) for r in recurrence.expand_events(events).select("doc_id", "pos", "start", "end", "end_given").collect())
    assert got == sorted((i, k, *o) for i, every in want.items() for k, o in enumerate(every))


def test_days_of_the_week_stay_in_the_jvm(events):
    """They went to Python event by event."""
    some = events.filter(events["recurrence"].isin("FREQ=WEEKLY;BYDAY=MO,WE;UNTIL=20240215", "FREQ=WEEKLY;BYDAY=WE,MO", "FREQ=DAILY;UNTIL=20991231", "UNTIL=20240301;FREQ=WEEKLY"))
    assert {r["_kind"] for r in recurrence._series(some).select("_kind").collect()} == {1, 2}  # 1: envelopes


def test_extents(events, want):
    """What is counted is not written out: no row for an occurrence is made and grouped again."""
    df = recurrence.extents(events)
    assert {tuple(r) for r in df.collect()} == {(i, len(e), e[0][0], e[recurrence.CAP][0] if len(e) > recurrence.CAP else None) for i, e in want.items() if e}
    assert "sequence(" not in df._jdf.queryExecution().optimizedPlan().toString()
