"""Mixed timestamp notations and time zones to one unambiguous form.

Every notation is one alternative of a single Java regular expression with named groups. ``regexp_replace`` runs it
once for each value and writes the components, separated by a control character, so that nothing is matched twice and
nothing leaves the JVM. Calendar ranges are then checked in integers and instants are assembled from day numbers. Only
local times with a named zone go through the zone rules: a time that occurs twice is the earlier one, a skipped one
moves forward by the gap.

Defined results: null, empty, blank, relative ("yesterday") and impossible values ("31.02.2025", "25:00") give null;
repeated rows stay repeated; other columns are kept, whatever their names (the work columns start with ``__ts_``).
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = "\u0001"
COMPONENTS = ("y", "mo", "mn", "d", "na", "nb", "ny", "h", "mi", "s", "f", "ap", "off", "abbr", "zn", "ep")

# Month names of English, German, French and Spanish, and their usual short forms.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene",
    2: "february feb februar février févr fevrier febrero",
    3: "march mar märz mär maerz mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre setiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre déc decembre diciembre dic",
}
MONTH_NUMBER = {name: n for n, names in MONTHS.items() for name in names.split()}
# The zone abbreviations of RFC 2822, then usual ones that mean one offset everywhere, in minutes. Ambiguous
# ones (IST, BST, AST, SST, ...) stay unread.
ABBREVIATIONS = {"UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}
ABBREVIATIONS |= {"WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "AWST": 480, "NZST": 720, "NZDT": 780}

_WS = "[\\s\\u00a0\\u202f]"
_CLOCK = f"(?<h>\\d{{1,2}}):(?<mi>\\d{{2}})(?::(?<s>\\d{{2}})(?:[.,](?<f>\\d{{1,9}}))?)?(?:{_WS}*(?<ap>[AaPp])\\.?[Mm](?![A-Za-z])\\.?)?"
_ZONE = f"(?:{_WS}*(?<off>[Zz]|[+-]\\d{{2}}:?\\d{{2}})|{_WS}+(?<abbr>[A-Z]{{2,4}})(?![A-Za-z/]))?(?:{_WS}*\\[?(?<zn>[A-Za-z]+/[A-Za-z_/+-]+|UTC)\\]?)?"
_NAMES = "|".join(sorted(MONTH_NUMBER, key=lambda n: (-len(n), n)))
#: One entry a notation; the whole value must match.
NOTATIONS = (
    f"(?<y>\\d{{4}})-(?<mo>\\d{{1,2}})-(?<d>\\d{{1,2}})(?:(?:[Tt]|,?{_WS}+){_CLOCK}{_ZONE})?",
    f"(?<y>\\d{{4}})[/.](?<mo>\\d{{1,2}})[/.](?<d>\\d{{1,2}})(?:[Tt,]?{_WS}*{_CLOCK}{_ZONE})?",
    "(?<y>\\d{4})(?<mo>\\d{2})(?<d>\\d{2})(?:[Tt](?<h>\\d{2})(?<mi>\\d{2})(?<s>\\d{2})(?:[.,](?<f>\\d{1,9}))?(?<off>[Zz]|[+-]\\d{2}:?\\d{2})?)?",
    f"(?<na>\\d{{1,2}})(?:/|-|\\.)(?<nb>\\d{{1,2}})(?:/|-|\\.)(?<ny>\\d{{4}}|\\d{{2}})(?:,?{_WS}+{_CLOCK}{_ZONE})?",
    f"(?<mn>{_NAMES})\\.?{_WS}+(?<d>\\d{{1,2}})(?:st|nd|rd|th)?,?{_WS}+(?<y>\\d{{4}})(?:,?{_WS}+(?:at{_WS}+)?{_CLOCK}{_ZONE})?",
    f"(?:[a-zé]{{2,10}}\\.?,{_WS}*)?(?<d>\\d{{1,2}})(?:\\.|st|nd|rd|th|er)?{_WS}+(?:de{_WS}+)?(?<mn>{_NAMES})\\.?,?{_WS}+(?:de{_WS}+)?(?<y>\\d{{4}})(?:,?{_WS}+(?:at{_WS}+)?{_CLOCK}{_ZONE})?",
    "(?<ep>\\d{10}|\\d{13}|\\d{16})",
)


def _compiled() -> tuple[str, str]:
    """The alternation, whose group names carry the number of their alternative, and the replacement text."""
    parts, groups = [], {c: "" for c in COMPONENTS}
    for k, notation in enumerate(NOTATIONS):
        for c in COMPONENTS:
            if f"(?<{c}>" in notation:
                notation = notation.replace(f"(?<{c}>", f"(?<{c}{chr(97 + k)}>")
                groups[c] += f"${{{c}{chr(97 + k)}}}"
        parts.append(notation)
    return f"(?iu)^{_WS}*(?:{'|'.join(parts)}){_WS}*$", SEP.join(groups[c] for c in COMPONENTS)


PATTERN, REPLACEMENT = _compiled()


def _days(y: str, m: str, d: str) -> str:
    """SQL of the days from 1970-01-01 to a date of the Gregorian calendar, in integers."""
    yy = f"({y} - if({m} <= 2, 1, 0))"
    return f"(({yy} div 400) * 146097 + ({yy} % 400) * 365 + ({yy} % 400) div 4 - ({yy} % 400) div 100 + (153 * ({m} + if({m} > 2, -3, 9)) + 2) div 5 + {d} - 1 - 719468)"


def with_parsed(df: DataFrame, value: Column, out_date: str, out_micros: str, zone: Column | None = None, order: Column | None = None) -> DataFrame:
    """Adds ``out_date`` (DATE as written; of a Unix time its UTC date) and ``out_micros`` (BIGINT, the instant).

    ``zone`` is the IANA zone of values without one (no zone: UTC) and ``order`` is ``DMY`` or ``MDY`` for all-numeric
    dates without a leading year (no order: day first). Zones that are unknown give a null instant.

    The three steps are lambdas over arrays of one element: a lambda's variable is evaluated once, whereas columns that
    build on columns would be copied into each other by the optimiser wherever a filter is pushed below them.
    """
    p = "__ts_"
    zone = F.coalesce(zone, F.lit("UTC")) if zone is not None else F.lit("UTC")
    order = F.coalesce(order, F.lit("DMY")) if order is not None else F.lit("DMY")
    text = value.cast("string")
    df = df.withColumns({f"{p}zone": zone, f"{p}mdy": order == "MDY", f"{p}parts": F.split(F.regexp_replace(text, PATTERN, REPLACEMENT), SEP)})
    part = {c: f"nullif(p[{k}], '')" for k, c in enumerate(COMPONENTS)}
    months = "map(" + ", ".join(f"'{name}', {n}" for name, n in MONTH_NUMBER.items()) + ")"
    abbr = "map(" + ", ".join(f"'{name}', {n}" for name, n in ABBREVIATIONS.items()) + ")"
    num = lambda c, kind="int": f"cast({part[c]} as {kind})"
    mdy = f"{p}mdy"
    fields = {
        "y": f"coalesce({num('y')}, if(length({part['ny']}) = 2, 2000 + {num('ny')}, {num('ny')}))",
        "m": f"coalesce({num('mo')}, try_element_at({months}, lower({part['mn']})), if({mdy}, {num('na')}, {num('nb')}))",
        "d": f"coalesce({num('d')}, if({mdy}, {num('nb')}, {num('na')}))",
        "h": f"case when {part['ap']} is null then coalesce({num('h')}, 0) when {num('h')} not between 1 and 12 then 99 when lower({part['ap']}) = 'a' then {num('h')} % 12 else {num('h')} % 12 + 12 end",
        "mi": f"coalesce({num('mi')}, 0)",
        "s": f"coalesce({num('s')}, 0)",
        "us": f"cast(coalesce(substring(rpad({part['f']}, 9, '0'), 1, 6), '0') as bigint)",
        "off": f"case when upper({part['off']}) = 'Z' then 0 when {part['off']} is not null then (if(substring({part['off']}, 1, 1) = '-', -1, 1)) * (cast(substring({part['off']}, 2, 2) as int) * 60 + cast(right({part['off']}, 2) as int)) when {part['abbr']} is not null then coalesce(try_element_at({abbr}, {part['abbr']}), 9999) end",
        "zn": f"coalesce({part['zn']}, {p}zone)",
        "ep": f"case length({part['ep']}) when 10 then cast({part['ep']} as bigint) * 1000000 when 13 then cast({part['ep']} as bigint) * 1000 when 16 then cast({part['ep']} as bigint) end",
    }
    leap = "(q.y % 4 = 0 and (q.y % 100 <> 0 or q.y % 400 = 0))"
    last = f"case when q.m = 2 then if({leap}, 29, 28) when q.m in (4, 6, 9, 11) then 30 else 31 end"
    valid = f"q.y between 1900 and 2199 and q.m between 1 and 12 and q.d between 1 and {last} and q.h <= 23 and q.mi <= 59 and q.s <= 59 and coalesce(abs(q.off) <= 1080, true)"
    known = ", ".join(f"'{z}'" for z in sorted(z for z in available_timezones() if "/" in z))
    struct = lambda d: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in d.items()) + ")"
    step = f"""transform(transform(transform(array({p}parts),
        p -> if(size(p) = {len(COMPONENTS)}, {struct(fields)}, null)),
        q -> named_struct('days', case when q.ep is not null then cast(floor(q.ep / 86400000000) as int) when {valid} then {_days('q.y', 'q.m', 'q.d')} end,
                          'clock', (q.h * 3600 + q.mi * 60 + q.s) * 1000000L + q.us, 'off', q.off, 'zn', q.zn, 'ep', q.ep)),
        r -> named_struct('days', r.days, 'micros', case when r.ep is not null then r.ep when r.days is null then null
                when r.off is not null then r.days * 86400000000L + r.clock - r.off * 60000000L
                when r.zn = 'UTC' then r.days * 86400000000L + r.clock
                when r.zn in ({known}) then unix_micros(to_utc_timestamp(timestamp_micros(r.days * 86400000000L + r.clock), r.zn)) end))[0]"""
    df = df.withColumn(f"{p}r", F.expr(step))
    df = df.withColumns({out_date: F.expr(f"date_from_unix_date({p}r.days)"), out_micros: F.col(f"{p}r.micros")})
    return df.drop(*(c for c in df.columns if c.startswith(p)))


def instant_text(micros: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.mmmZ`` in UTC, cut to milliseconds, whatever the session's zone."""
    days = F.floor(micros / F.lit(86_400_000_000)).cast("int")
    rest = micros - days.cast("bigint") * F.lit(86_400_000_000)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    whole = lambda c, by: F.floor(c / F.lit(by)).cast("bigint")
    return F.concat(
        F.date_from_unix_date(days).cast("string"), F.lit("T"), two(whole(rest, 3_600_000_000)), F.lit(":"), two(whole(rest, 60_000_000) % 60), F.lit(":"), two(whole(rest, 1_000_000) % 60), F.lit("."),
        F.lpad((whole(rest, 1000) % 1000).cast("string"), 3, "0"), F.lit("Z"),
    )


STANDARD_DATE = r"^\d{4}-\d{2}-\d{2}$"
STANDARD_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\+00:00$"


def normalised_values(jobs: DataFrame, postings: DataFrame, messages: DataFrame, groups: DataFrame) -> DataFrame:
    """(source_table, row_key, value, standard, normal_value) of every readable value; one row per input row."""
    dates = with_parsed(jobs.select(F.lit("jobs").alias("source_table"), F.col("id").cast("string").alias("row_key"), F.col("posted_on").alias("value")), F.col("value"), "day", "micros")
    dates = dates.select("source_table", "row_key", "value", F.col("value").rlike(STANDARD_DATE).alias("standard"), F.col("day").cast("string").alias("normal_value"))
    keyed = postings.select(F.lit("job_postings").alias("source_table"), F.col("id").cast("string").alias("row_key"), "source_group", F.col("message_date").alias("value")).unionByName(
        messages.select(F.lit("source_messages").alias("source_table"), F.concat("source_group", F.lit("/"), "source_message_id").alias("row_key"), "source_group", F.col("message_date").alias("value"))
    )
    # source_groups is a small table of fixed size; Spark broadcasts it after checking its size, else it joins by shuffle.
    zones = groups.select("source_group", "tz_name", "date_order").dropDuplicates(["source_group"])
    times = with_parsed(keyed.filter(F.col("value").isNotNull()).join(zones, "source_group", "left"), F.col("value"), "day", "micros", F.col("tz_name"), F.col("date_order"))
    times = times.select("source_table", "row_key", "value", F.col("value").rlike(STANDARD_INSTANT).alias("standard"), instant_text(F.col("micros")).alias("normal_value"))
    return dates.unionByName(times).filter(F.col("normal_value").isNotNull())


def found(jobs: DataFrame, postings: DataFrame, messages: DataFrame, groups: DataFrame) -> DataFrame:
    """p4_found: distinct readable values that are not in standard form yet."""
    rows = normalised_values(jobs, postings, messages, groups).filter(~F.col("standard"))
    return rows.select("source_table", "row_key", "normal_value").distinct()
