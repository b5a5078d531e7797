"""Timestamps in many forms, precisions and zones as one instant: microseconds since 1970 UTC.

An ordered cascade of anchored patterns recognises the form; each pattern rewrites the value to the same ten
fields, which are then checked and combined by one expression. Everything is a JVM column expression.

Policies: a value without zone is local time of the source's default zone; a local time that occurs twice is
the earlier instant; a local time or date that does not exist, and text that is no time, give NULL. Digits
beyond microseconds are cut off, missing parts are zero. NULL in gives NULL out; a NULL or unknown default
zone is UTC and a NULL date order is ``dmy``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Minutes east of UTC of the zone abbreviations that occur in exported times.
ZONE_ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120,
    "EEST": 180, "MSK": 180, "IST": 330, "KST": 540, "JST": 540, "AWST": 480, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}

_OFF = r"[Zz]|[+-]\d{2}:?\d{2}"
_MON = r"[A-Za-z]{3}"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"

#: (pattern, rewriting): the fields are year|month|day|hour|minute|second|fraction|half of day|zone|bracket zone;
#: the month position of slash dates is decided by the source, so those carry the mark ``s`` in an 11th field.
CASCADE: list[tuple[str, str]] = [
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[Tt ]{_CLOCK} ?({_OFF})?(?:\[([A-Za-z_/+\-0-9]+)\])?)?$", "$1|$2|$3|$4|$5|$6|$7||$8|$9|"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,9}}))?({_OFF})?$", "$1|$2|$3|$4|$5|$6|$7||$8||"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? {_CLOCK}(?: ?([AaPp][Mm]))?(?: ({_OFF}|[A-Z]{{1,5}}))?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9||s"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? {_CLOCK}(?: ({_OFF}|[A-Z]{{1,5}}))?$", "$3|$2|$1|$4|$5|$6|$7||$8||"),
    (rf"^(?:[A-Za-z]{{3}}, )?(\d{{1,2}}) ({_MON}) (\d{{4}}) {_CLOCK}(?: ({_OFF}|[A-Z]{{1,5}}))?$", "$3|$2|$1|$4|$5|$6|$7||$8||"),
    (rf"^[A-Za-z]{{3}} ({_MON}) {{1,2}}(\d{{1,2}}) {_CLOCK} (\d{{4}})(?: ({_OFF}|[A-Z]{{1,5}}))?$", "$7|$1|$2|$3|$4|$5|$6||$8||"),
    (rf"^({_MON}) (\d{{1,2}}), (\d{{4}}),? {_CLOCK} ?([AaPp][Mm])?(?: ({_OFF}|[A-Z]{{1,5}}))?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9||"),
    (rf"^(\d{{4}})년 (\d{{1,2}})월 (\d{{1,2}})일 (오전|오후) {_CLOCK}$", "$1|$2|$3|$5|$6|$7|$8|$4|||"),
]
_EPOCH = r"^(\d{9,10})(?:\.(\d{1,9}))?(?: [+-]\d{4})?$"
_EPOCH_FINE = r"^(?:\d{13}|\d{16}|\d{19})$"
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z\z"

_WHITE = r"(?U)^\s+|\s+$"


def _us(ntz: Column) -> Column:
    """Microseconds from 1970 of a zoneless timestamp, whatever the session's zone is."""
    seconds = F.hour(ntz) * F.lit(3600) + F.minute(ntz) * F.lit(60)
    micros = (F.extract(F.lit("SECOND"), ntz) * F.lit(1000000)).cast("long")
    return (F.unix_date(ntz.cast("date")).cast("long") * 86400 + seconds.cast("long")) * 1000000 + micros


def add_instant(df: DataFrame, value: str, out: str, zone: str | None = None, date_order: str | None = None) -> DataFrame:
    """``df`` with ``out``, the instant that the text in ``value`` denotes, or NULL.

    ``zone`` and ``date_order`` name columns with the source's IANA zone and ``dmy`` or ``mdy``. The work is laid
    out in stages, so that no stage is computed more than once; columns of ``df`` that start with ``_i_`` would clash.
    """
    zone_col = F.coalesce(F.col(zone), F.lit("UTC")) if zone else F.lit("UTC")
    order = F.coalesce(F.col(date_order), F.lit("dmy")) if date_order else F.lit("dmy")
    s = F.col("_i_s")
    fields = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, to in CASCADE:
        fields = fields.when(s.rlike(pattern), F.regexp_replace(s, pattern, to))
    get = lambda i: F.nullif(F.get(F.col("_i_f"), F.lit(i)), F.lit(""))
    number = lambda i: get(i).cast("int")

    second_of = F.when(F.col("_i_mon").rlike(r"^\d+$"), F.col("_i_mon")).cast("int")
    by_name = F.nullif(F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.col("_i_mon")), F.lit(0)).cast("int")
    swapped = (F.get(F.col("_i_f"), F.lit(10)) == "s") & (order != "mdy")
    half, hour = F.lower(get(7)), F.coalesce(number(3), F.lit(0))
    hour = (
        F.when(half.isNull(), F.when(hour < 24, hour))
        .when((hour < 1) | (hour > 12), None)
        .otherwise(hour % 12 + F.when(half.isin("pm", "오후"), 12).otherwise(0))
    )
    second = F.coalesce(number(5), F.lit(0))
    abbreviations = F.create_map(*[x for k, v in ZONE_ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))])
    offset = F.col("_i_off")
    minutes = F.when(
        offset.rlike(r"^[+-]"),
        F.when(offset.startswith("-"), -1).otherwise(1)
        * (F.substring(offset, 2, 2).cast("int") * 60 + F.right(offset, F.lit(2)).cast("int")),
    ).otherwise(F.try_element_at(abbreviations, F.upper(offset)))
    local, as_utc, named = F.col("_i_local"), F.col("_i_utc"), F.col("_i_zone")
    needs_zone = F.when(offset.isNull(), local)
    exists = F.convert_timezone(F.lit("UTC"), named, as_utc) == local
    calendar = (
        F.when(offset.isNotNull(), _us(local) - F.when(F.abs(minutes) <= 18 * 60, minutes).cast("long") * 60000000)
        .when(exists, _us(as_utc))
    )
    fine = s.try_cast("decimal(20,0)")
    epoch = F.when(
        s.rlike(_EPOCH),
        F.regexp_replace(s, _EPOCH, "$1").cast("long") * 1000000
        + F.rpad(F.substring(F.regexp_replace(s, _EPOCH, "$2"), 1, 6), 6, "0").cast("long"),
    ).when(
        s.rlike(_EPOCH_FINE),
        F.when(F.length(s) == 13, fine.cast("long") * 1000)
        .when(F.length(s) == 16, fine.cast("long"))
        .otherwise(F.floor(fine / 1000).cast("long")),
    )
    pieces = {
        "_i_off": get(8),
        "_i_zone": F.coalesce(get(9), zone_col),
        "_i_month": F.when(swapped, number(2)).otherwise(F.coalesce(second_of, by_name)),
        "_i_day": F.when(swapped, second_of).otherwise(number(2)),
        "_i_hour": hour,
        "_i_sec": F.when(second < 60, second).cast("decimal(16,6)"),
    }
    made = F.try_make_timestamp_ntz(
        number(0), F.col("_i_month"), F.col("_i_day"), F.col("_i_hour"), F.coalesce(number(4), F.lit(0)), F.col("_i_sec")
    )
    micros = F.rpad(F.substring(F.coalesce(get(6), F.lit("")), 1, 6), 6, "0").cast("int")
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    df = once(df.withColumn("_i_s", F.regexp_replace(F.col(value), _WHITE, "")), "_i_s", F.col("_i_s"))
    df = once(df, "_i_f", F.split(fields, r"\|", -1)).withColumn("_i_mon", F.lower(F.get(F.col("_i_f"), F.lit(1))))
    df = once(df.withColumns(pieces), "_i_local", made).withColumn("_i_utc", F.convert_timezone(named, F.lit("UTC"), needs_zone))
    return once(df, out, F.when(F.col("_i_f").isNotNull(), calendar + micros).otherwise(epoch)).select(*kept, out)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``name`` as the only element of an exploded array: no rule of the optimiser copies ``value`` into
    the expressions and filters that use it, so that it stays one computation and the plan stays small."""
    return df.withColumn(name, F.explode(F.array(value)))


def with_instant(df: DataFrame, machines: DataFrame, value: str, out: str = "utc_us") -> DataFrame:
    """``df`` with the instant of its column ``value``; zone and date order come from ``machines`` by ``machine``.

    Rows of an unknown or NULL machine are kept and count as UTC and ``dmy``. ``machines`` may hold several rows
    of one name (the first by zone counts); its other columns are not taken over.
    """
    lookup = machines.groupBy(F.col("machine").alias("_machine")).agg(F.min(F.struct("tz", "date_order")).alias("_m"))
    joined = df.join(lookup, F.col("machine") == F.col("_machine"), "left")
    joined = joined.withColumns({"_tz": F.col("_m.tz"), "_order": F.col("_m.date_order")}).drop("_m", "_machine")
    return add_instant(joined, value, out, "_tz", "_order").drop("_tz", "_order")
