"""Recurrence rules: the subset FREQ, INTERVAL, COUNT, UNTIL, BYDAY (weekly) and WKST, expanded to occurrences.

Up to CAP occurrences are expanded exactly; a rule that goes on keeps the rest as one tail interval, open or up to UNTIL.
Rules outside the subset give one envelope from the start to UNTIL, or open. Dates that a month or year lacks are skipped. A series ends where the
calendar does, with the year 9999: an occurrence that would reach beyond it is none.

Events without a rule, and those that repeat every so many days or weeks or on days of the week, are expanded in the JVM; the rest go through
Python in Arrow batches.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .time import month_length

CAP = 512
_DAYS = {"MO": 0, "TU": 1, "WE": 2, "TH": 3, "FR": 4, "SA": 5, "SU": 6}
_UNTIL = re.compile(r"(?:^|;)\s*UNTIL=(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2}))?", re.I)


def _instant(text: str) -> datetime | None:
    try:
        d = datetime.fromisoformat(text)
        return d.replace(tzinfo=UTC) if d.tzinfo is None else d.astimezone(UTC)
    except (ValueError, OverflowError):
        return None


def _text(d: datetime) -> str:
    return d.strftime("%Y-%m-%dT%H:%M:%S.") + f"{d.microsecond // 1000:03d}Z"


def until(rule: str) -> str | None:
    """The instant a rule ends at; a date alone means the end of that day."""
    m = _UNTIL.search(rule)
    return f"{m[1]}-{m[2]}-{m[3]}T{m[4] or '23'}:{m[5] or '59'}:{m[6] or '59'}.000Z" if m else None


def _whole(text: str | None, default):
    if text is None:
        return default
    return int(text) if re.fullmatch(r"\d+", text) and int(text) > 0 else 0


def _plus(at: datetime, by: timedelta) -> datetime | None:
    """at + by, or None beyond the calendar."""
    try:
        return at + by
    except OverflowError:
        return None


def _days(n: int) -> timedelta | None:
    return timedelta(days=n) if n <= 4_000_000 else None


def _starts(first: datetime, freq: str, step: int, days: list[int] | None):
    """Occurrences in order, as far as the calendar goes."""
    if freq in ("MONTHLY", "YEARLY"):
        months = step * (12 if freq == "YEARLY" else 1)
        at = first.year * 12 + first.month - 1
        for k in range(CAP * 8):
            year, month = divmod(at + k * months, 12)
            if year > 9999:
                return
            # a short month has no such day
            if first.day <= month_length(year, month + 1):
                yield first.replace(year=year, month=month + 1)
        return
    if days is not None and (len(days) > 1 or first.weekday() != days[0]):
        offsets = sorted({(d - first.weekday()) % 7 or 7 for d in days})
        yield first
        for week in range(CAP * 2):
            for offset in offsets:
                at = _plus(first, timedelta(days=7 * week + offset))
                if at is None:
                    return
                yield at
        return
    apart = _days(step * (7 if freq == "WEEKLY" else 1))
    at: datetime | None = first
    while at is not None:
        yield at
        at = _plus(at, apart) if apart is not None else None


def expand(rule: str, start: str, end: str | None = None, has_end: bool = False) -> list[tuple[str, str | None, bool]] | None:
    """(start, end, end given) of each occurrence and of the tail; None where the rule is outside the subset."""
    parts: dict[str, str] = {}
    for item in filter(None, (x.strip() for x in rule.split(";"))):
        name, mark, value = item.partition("=")
        if not mark or not name:
            return None
        parts[name.upper()] = value.upper()
    if set(parts) - {"FREQ", "INTERVAL", "COUNT", "UNTIL", "BYDAY", "WKST"} or parts.get("FREQ") not in ("DAILY", "WEEKLY", "MONTHLY", "YEARLY"):
        return None
    freq, step, count = parts["FREQ"], _whole(parts.get("INTERVAL"), 1), _whole(parts.get("COUNT"), None)
    if step == 0 or count == 0:
        return None
    days = None
    if "BYDAY" in parts:
        days = [_DAYS.get(d.strip()) for d in parts["BYDAY"].split(",")]
        if freq != "WEEKLY" or None in days or (step > 1 and len(days) > 1):
            return None
    last = None
    if "UNTIL" in parts:
        text = until("UNTIL=" + parts["UNTIL"])
        last = _instant(text) if text else None
        if last is None:
            return None
    first = _instant(start)
    if first is None or (has_end and end is None):
        return None
    if days is not None and step > 1 and first.weekday() != days[0]:
        return None
    length = None
    if end:
        stop = _instant(end)
        if stop is None:
            return None
        length = stop - first
    found: list[datetime] = []
    tail = None
    for at in _starts(first, freq, step, days):
        if (last is not None and at > last) or (length is not None and _plus(at, length) is None):
            break
        if len(found) == CAP:
            tail = at
            break
        found.append(at)
        if count is not None and len(found) == count:
            break
    if not found or (count is not None and len(found) < count and tail is None):
        return None
    out = [(_text(a), _text(a + length) if length is not None else None, length is not None) for a in found]
    if tail is not None:
        out.append((_text(tail), until(rule) if last is not None else None, True))
    return out


def occurrences(rule: str | None, start: str | None, end: str | None = None, has_end: bool = False) -> list[tuple[str, str | None, bool]]:
    """The timeline entries of an event: its occurrences, its envelope, or itself where it has no rule."""
    if not start:
        return []
    if not rule:
        return [(start, end, has_end)]
    got = expand(rule, start, end, has_end)
    return [(start, until(rule), True)] if got is None else got


_PART = r"(?:^|;){}=([^;]*)"
#: Rules read in the JVM: each part once, COUNT or UNTIL but not both.
_NAMED = r"(?:FREQ=(?:DAILY|WEEKLY)|INTERVAL=[1-9][0-9]{0,2}|COUNT=[1-9][0-9]{0,2}|UNTIL=[1-8][0-9]{7}(?:T[0-9]{6})?Z?|BYDAY=(?:MO|TU|WE|TH|FR|SA|SU)(?:,(?:MO|TU|WE|TH|FR|SA|SU))*)"
_SIMPLE = rf"^(?!.*(?:^|;)([A-Z]+)=.*;\1=)(?!.*COUNT.*UNTIL)(?!.*UNTIL.*COUNT){_NAMED}(?:;{_NAMED})*$"
_ISO = r"^[1-8][0-9]{3}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?Z$"
_DAY = 86_400_000_000


def _text_of(micros: Column) -> Column:
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _at(k: Column) -> Column:
    """The k-th occurrence: the start, then each of the offsets in turn, in period after period."""
    n = F.size("_offsets")
    days = F.floor((k - 1) / n) * F.col("_period") + F.get("_offsets", F.pmod(k - 1, n))
    return F.col("_a") + F.when(k > 0, days).otherwise(0) * F.lit(_DAY)


def _series(events: DataFrame) -> DataFrame:
    """Events with _kind (0 nothing, 1 one entry as it is, 2 a series by the columns below, 3 left to Python), and of a series _a (microseconds), _length,
    _period and _offsets (days), _last (text of UNTIL) and _n, how many entries it has, the tail among them."""
    spark = events.sparkSession
    rule = F.col("recurrence")
    rows = events.select("doc_id", "start", "end", F.coalesce("end_given", F.lit(False)).alias("end_given"), "recurrence")
    part = lambda name: F.nullif(F.regexp_extract("recurrence", _PART.format(name), 1), F.lit(""))
    begin, stop = (F.unix_micros(F.try_to_timestamp(c)) for c in ("start", "end"))
    rows = rows.withColumns({"_a": begin, "_length": stop - begin, "_freq": part("FREQ"), "_step": F.coalesce(part("INTERVAL").cast("int"), F.lit(1)), "_count": part("COUNT").cast("int"), "_by": F.split(part("BYDAY"), ","), "_until": part("UNTIL")})
    piece = lambda at, n, default: F.coalesce(F.nullif(F.substring("_until", at, n), F.lit("")), F.lit(default))
    timed = F.length("_until") >= 15
    clock = F.when(timed, F.concat_ws(":", *(F.substring("_until", k, 2) for k in (10, 12, 14)))).otherwise("23:59:59")
    rows = rows.withColumn("_last", F.when(F.col("_until").isNotNull(), F.concat(piece(1, 4, ""), F.lit("-"), piece(5, 2, ""), F.lit("-"), piece(7, 2, ""), F.lit("T"), clock, F.lit(".000Z"))))
    last = F.unix_micros(F.try_to_timestamp("_last"))
    weekday = F.weekday(F.timestamp_micros("_a"))  # Monday is 0
    number = F.create_map(*(F.lit(x) for kv in _DAYS.items() for x in kv))
    # days of the week other than the start's alone
    many = F.col("_by").isNotNull() & ((F.size("_by") > 1) | (number[F.get("_by", F.lit(0))] != weekday))
    apart = F.col("_step") * F.when(F.col("_freq") == "WEEKLY", 7).otherwise(1)
    offsets = F.when(many, F.array_sort(F.array_distinct(F.transform("_by", lambda d: F.pmod(number[d] - weekday - 1, F.lit(7)) + 1)))).otherwise(F.array(apart))
    rows = rows.withColumns({"_offsets": offsets, "_period": F.when(many, 7).otherwise(apart).cast("bigint"), "_end": last})
    before = F.aggregate("_offsets", F.lit(1).cast("bigint"), lambda n, d: n + F.greatest(F.floor((F.col("_end") - F.col("_a") - d * F.lit(_DAY)) / (F.col("_period") * F.lit(_DAY))) + 1, F.lit(0)))
    size = F.when(F.col("_count").isNotNull(), F.col("_count")).when(F.col("_end").isNull(), CAP + 1).when(F.col("_end") < F.col("_a"), 0).otherwise(before)
    rows = rows.withColumn("_n", F.least(size, F.lit(CAP + 1)).cast("int"))
    whole = F.col("start").rlike(_ISO) & F.col("_a").isNotNull() & ((~F.col("end_given") & F.coalesce("end", F.lit("")).eqNullSafe("")) | (F.col("end").rlike(_ISO) & F.col("_length").isNotNull()))
    asked = F.col("_freq").isNotNull() & (F.col("_by").isNull() | ((F.col("_freq") == "WEEKLY") & ((F.col("_step") == 1) | ~many))) & (F.coalesce("_count", F.lit(1)) <= CAP) & (F.col("_until").isNull() | F.col("_end").isNotNull())
    short = (F.col("_n") * F.col("_period") <= 360_000) & F.coalesce(F.col("_length") < 3650 * F.lit(_DAY), F.lit(True))
    # formats follow the session's zone, and texts here are UTC
    simple = F.coalesce(rule.rlike(_SIMPLE) & whole & asked & short, F.lit(False)) & F.lit(spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC"))
    kind = F.when(F.coalesce("start", F.lit("")) == "", 0).when(F.coalesce("recurrence", F.lit("")) == "", 1).when(simple, 2).otherwise(3)
    rows = rows.withColumn("_kind", kind)
    # a series that ends before it begins is its envelope
    none = (F.col("_kind") == 2) & (F.col("_n") == 0)
    each = {"end": F.when(none, F.col("_last")).otherwise(F.col("end")), "end_given": F.col("end_given") | none, "_kind": F.when(none, 1).otherwise(F.col("_kind"))}
    kept = ("end", "end_given", "_kind", "_a", "_length", "_offsets", "_period", "_last", "_n")
    # what is filtered by follows from all of the above: behind an explode it is worked out once a row, where a plain filter would repeat it
    return rows.select("doc_id", "start", "recurrence", F.explode(F.array(F.struct(*(each.get(c, F.col(c)).alias(c) for c in kept)))).alias("_s")).select("doc_id", "start", "recurrence", "_s.*")


def _rest(rows: DataFrame) -> DataFrame:
    """doc_id, pos, start, end and end_given of what is left to Python."""

    def run(batches):
        for b in batches:
            out = [(r["doc_id"], k, *o) for r in b.to_pylist() for k, o in enumerate(occurrences(r["recurrence"], r["start"], r["end"], r["end_given"]))]
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "pos", "start", "end", "end_given"])

    rest = rows.filter("_kind = 3").select("doc_id", "start", "end", "end_given", "recurrence")
    return rest.mapInArrow(run, "doc_id bigint, pos int, start string, end string, end_given boolean")


def expand_events(events: DataFrame) -> DataFrame:
    """doc_id, pos, start, end and end_given from events (doc_id, start, end, end_given, recurrence)."""
    rows = _series(events)
    series = F.col("_kind") == 2
    some = rows.filter("_kind in (1, 2)").select("*", F.explode(F.sequence(F.lit(0), F.when(series, F.col("_n") - 1).otherwise(0))).alias("pos"))
    some = some.withColumn("_at", _at(F.col("pos")))
    tail = F.col("pos") == CAP
    stop = F.when(tail, F.col("_last")).otherwise(_text_of(F.col("_at") + F.col("_length")))
    pick = lambda a, b: F.when(series, a).otherwise(F.col(b)).alias(b)
    some = some.select("doc_id", "pos", pick(_text_of(F.col("_at")), "start"), pick(stop, "end"), pick(tail | F.col("_length").isNotNull(), "end_given"))
    return some.unionByName(_rest(rows))


def extents(events: DataFrame) -> DataFrame:
    """doc_id, n, first and tail of each event that has entries: how many they are, the first start, and where the one behind the cap begins. Entries of a
    series in the JVM follow from its rule, so none is written out to be counted."""
    rows = _series(events)
    series = F.col("_kind") == 2
    some = rows.filter("_kind in (1, 2)").select("doc_id", F.when(series, F.col("_n")).otherwise(1).alias("n"), F.when(series, _text_of(F.col("_a"))).otherwise(F.col("start")).alias("first"), F.when(series & (F.col("_n") > CAP), _text_of(_at(F.lit(CAP)))).alias("tail"))
    at = lambda k: F.max(F.when(F.col("pos") == k, F.col("start")))
    rest = _rest(rows).groupBy("doc_id").agg(F.count("*").cast("int").alias("n"), at(0).alias("first"), at(CAP).alias("tail"))
    return some.unionByName(rest)
