"""Mixed timestamp formats and time zones (problem 6).

Text is parsed into a local time plus, where given, an offset. Local times on a named clock are matched as of the
zone's offset intervals: one matching interval gives the offset, two mean the local time is ambiguous (clocks set
back), none means it does not exist (clocks set forward).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.functions.let import let
from fluxloom.session import broadcast_if_small, cut

# Offsets in minutes of zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330,
    "AWST": 480, "JST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

_DATE = r"\d{4}-\d{1,2}-\d{1,2}|\d{4}-\d{3}|\d{8}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}[/.]\d{1,2}[/.]\d{4}|\d{1,2}[- ][A-Za-z]{3,9}[- ]\d{4}"
_ZONE = r"[A-Za-z]{1,5}|(?:UTC|GMT)?[+\-−±]\d{1,2}(?::?\d{2})?"
_STAMP = rf"^(?:({_DATE})[T ]+)?(\d{{1,2}}:\d{{2}}(?::\d{{2}})?|\d{{6}}|\d{{4}})(?:[.,]\d+)?\s*([AaPp]\.?[Mm]\.?)?\s*({_ZONE})?$"
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _int(text: Column) -> Column:
    return text.try_cast("int")


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _ymd(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def parse_date(text: Column, month_first: Column) -> Column:
    """DATE of a day written in any of the known notations; NULL for anything else.

    ``month_first`` says how an ambiguous ``a/b/yyyy`` is to be read; where that order is impossible the other is taken.
    """
    return let(F.trim(text), lambda t: _date_of(t, month_first))


def _date_of(t: Column, month_first: Column) -> Column:
    iso, slash = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", r"^(\d{1,2})[/.](\d{1,2})[/.](\d{4})$"
    ordinal, compact, words = r"^(\d{4})-(\d{3})$", r"^(\d{4})(\d{2})(\d{2})$", r"^(\d{1,2})[- ]([A-Za-z]{3,9})[- ](\d{4})$"
    a, b, year = (_part(t, slash, k) for k in (1, 2, 3))
    as_month, as_day = _ymd(year, a, b), _ymd(year, b, a)
    number = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(F.substring(_part(t, words, 2), 1, 3))).cast("string")
    day_of_year = F.date_add(F.make_date(_int(_part(t, ordinal, 1)), F.lit(1), F.lit(1)), _int(_part(t, ordinal, 2)) - 1)
    return (
        F.when(t.rlike(iso), _ymd(*(_part(t, iso, k) for k in (1, 2, 3))))
        .when(t.rlike(compact), _ymd(*(_part(t, compact, k) for k in (1, 2, 3))))
        .when(t.rlike(ordinal), day_of_year)
        .when(t.rlike(slash), F.when(month_first, F.coalesce(as_month, as_day)).otherwise(F.coalesce(as_day, as_month)))
        .when(t.rlike(words), _ymd(_part(t, words, 3), number, _part(t, words, 1)))
    )


def offset_minutes(text: Column) -> Column:
    """Offset from UTC in minutes, east positive, of an offset in any notation; NULL where it says none.

    Numbers of at most 14 are hours, larger ones minutes; a sign with four digits is ``±hhmm``; ``Etc/GMT`` names count
    the other way round, as in the zone database.
    """
    t = F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, "[−–‒]", "-"), "±", "+")))
    return let(F.regexp_replace(t, r"(\d),(\d)", "$1.$2"), _offset_of)


def _offset_of(t: Column) -> Column:
    num = lambda pattern, group=1: _part(t, pattern, group).try_cast("double")
    sign = lambda pattern: F.when(_part(t, pattern, 1) == "-", -1).otherwise(1)
    clock, etc, zone_h = r"^(?:utc|gmt)?\s*([+-])?(\d{1,2}):(\d{2})(?::\d{2})?$", r"^etc/(?:gmt|utc)([+-]?\d{1,2})$", r"^(?:utc|gmt)\s*([+-]\s*\d+(?:\.\d+)?)$"
    words, hhmm = r"^(\d+(?:\.\d+)?)\s*(?:h|hrs?|hours?)\s+(behind|ahead of|west of|east of)\b", r"^([+-])(\d{2})(\d{2})$"
    hours, minutes, seconds = (rf"^([+-]?\s*\d+(?:\.\d+)?)\s*{u}$" for u in ("(?:h|hrs?|hours?)", "(?:m|mins?|minutes?)", "(?:s|secs?|seconds?)"))
    iso, plain = r"^([+-])?pt(?:([+-]?\d+(?:\.\d+)?)h)?(?:([+-]?\d+(?:\.\d+)?)m)?(?:([+-]?\d+(?:\.\d+)?)s)?$", r"^([+-]?\d+(?:\.\d+)?)$"
    squeeze = lambda pattern: F.regexp_replace(_part(t, pattern, 1), r"\s", "").try_cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    value = (
        F.when(t.isin("z", "utc", "gmt"), 0.0)
        .when(t.rlike(etc), num(etc) * -60)
        .when(t.rlike(clock), sign(clock) * (num(clock, 2) * 60 + num(clock, 3)))
        .when(t.rlike(zone_h), squeeze(zone_h) * 60)
        .when(t.rlike(words), num(words) * 60 * F.when(_part(t, words, 2).rlike("behind|west"), -1).otherwise(1))
        .when(t.rlike(hours), squeeze(hours) * 60)
        .when(t.rlike(minutes), squeeze(minutes))
        .when(t.rlike(seconds), squeeze(seconds) / 60)
        .when(t.rlike(iso), sign(iso) * (zero(num(iso, 2)) * 60 + zero(num(iso, 3)) + zero(num(iso, 4)) / 60))
        .when(t.rlike(hhmm) | t.rlike(r"^0\d{3}$"), F.coalesce(sign(hhmm) * (num(hhmm, 2) * 60 + num(hhmm, 3)), num(r"^(\d{2})\d{2}$") * 60 + num(r"^\d{2}(\d{2})$")))
        .when(t.rlike(plain), F.when(F.abs(num(plain)) <= 14, num(plain) * 60).otherwise(num(plain)))
    )
    return F.round(value).cast("bigint")


def source_clocks(sources: DataFrame) -> DataFrame:
    """datasource, zone, month_first as told by the prose of each plume source; UTC where it names no zone."""
    text = F.col("description")
    return sources.where(F.col("feeds_table") == "plumes").select(
        F.col("source_name").alias("datasource"),
        F.coalesce(_part(text, r"\b([A-Z][A-Za-z]+/[A-Z][A-Za-z_/]+)", 1), F.lit("UTC")).alias("zone"),
        F.coalesce(F.lower(text).rlike("month before (?:the )?day|month first"), F.lit(False)).alias("month_first"),
    )


def zone_segments(wanted: DataFrame, step_min: int = 30) -> DataFrame:
    """Elementary segments of local time: zone, day, from_s, to_s, offsets (minutes; two, one or none), held.

    ``wanted`` has zone and year, the local years that are asked for. The offset intervals of a zone come from Spark's
    own zone rules, sampled every ``step_min`` minutes over each wanted year and two days on both sides; on the local
    axis consecutive intervals overlap or leave a gap, and cutting at all their ends gives segments that one, two or no
    intervals cover. Each is exploded to the local days it touches, so the as-of join is an equi join on zone and day.
    Size: wanted years x days; every year is worked out on its own, so one stray far year costs one year.
    """
    margin = 2 * 86400
    first = F.unix_date(F.make_date("year", F.lit(1), F.lit(1))).cast("bigint") * 86400
    last = F.unix_date(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1))).cast("bigint") * 86400
    known = wanted.where(F.col("zone").isNotNull() & F.col("year").between(1, 9998)).select("zone", "year").distinct()
    ticks = known.select("zone", "year", F.explode(F.sequence(first - margin, last + margin, F.lit(step_min * 60).cast("bigint"))).alias("utc"))
    local = F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds("utc"), F.col("zone")))
    ticks = ticks.withColumn("off", ((local - F.col("utc")) / 60).cast("int"))
    per = ["zone", "year"]
    order = W.partitionBy(*per).orderBy("utc")
    starts = ticks.withColumn("before", F.lag("off").over(order)).where(F.col("before").isNull() | (F.col("before") != F.col("off")))
    spans = starts.select(*per, "off", F.col("utc").alias("from_utc"), F.coalesce(F.lead("utc").over(order), last + margin).alias("to_utc"))
    spans = spans.select(*per, "off", (F.col("from_utc") + F.col("off") * 60).alias("a"), (F.col("to_utc") + F.col("off") * 60).alias("b"))
    cuts = spans.select(*per, F.explode(F.array("a", "b")).alias("from_s")).distinct()
    along = W.partitionBy(*per).orderBy("from_s")
    segments = cuts.withColumn("to_s", F.lead("from_s").over(along)).where(F.col("to_s").isNotNull())
    covers = (F.col("s.zone") == F.col("i.zone")) & (F.col("s.year") == F.col("i.year")) & (F.col("i.a") <= F.col("s.from_s")) & (F.col("i.b") >= F.col("s.to_s"))
    grouped = segments.alias("s").join(spans.alias("i"), covers, "left").groupBy("s.zone", "s.year", "s.from_s", "s.to_s").agg(F.sort_array(F.collect_list("i.off"), asc=False).alias("offsets"))
    # a gap takes the offset that held before it
    grouped = grouped.withColumn("held", F.last(F.when(F.size("offsets") > 0, F.element_at("offsets", -1)), ignorenulls=True).over(along))
    a, b = F.greatest(F.col("from_s"), first), F.least(F.col("to_s"), last)
    days = F.sequence(F.floor(a / 86400).cast("int"), F.floor((b - 1) / 86400).cast("int"))
    return grouped.where(a < b).select("zone", F.explode(days).alias("day"), "from_s", "to_s", "offsets", "held")


def _stamp(time: Column, date: Column, month_first: Column) -> Column:
    """struct<local, given> of a written time: local seconds since 1970 and, where told, the offset in minutes."""

    def fields(f: Column) -> Column:
        digits = let(F.regexp_replace(f["clock"], ":", ""), lambda c: F.when(F.length(c) % 2 == 1, F.concat(F.lit("0"), c)).otherwise(c))

        def seconds(c: Column) -> Column:
            h, half = _int(F.substring(c, 1, 2)), F.lower(F.substring(f["half"], 1, 1))
            h = F.when(half == "p", h % 12 + 12).when(half == "a", h % 12).otherwise(h)
            return h * 3600 + _int(F.substring(c, 3, 2)) * 60 + F.coalesce(_int(F.substring(c, 5, 2)), F.lit(0))

        days = F.unix_date(parse_date(F.coalesce(f["day"], date), month_first)).cast("bigint")
        table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
        given = F.when(f["zone"].isNotNull(), F.coalesce(table[F.upper(f["zone"])].cast("bigint"), offset_minutes(f["zone"])))
        return F.struct((days * 86400 + let(digits, seconds)).alias("local"), given.alias("given"))

    return let(F.struct(*[_part(time, _STAMP, k).alias(n) for k, n in enumerate(("day", "clock", "half", "zone"), 1)]), fields)


def normalise_times(df: DataFrame, key: str, clocks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``instant`` (whole seconds since 1970, UTC) and ``status`` of every row with a non-null ``time``.

    ``df`` has ``time``, ``date`` and ``datasource`` (text) beside ``key``. A time of day belongs to ``date`` on the
    datasource's clock; fractions are cut, absent seconds are 0. status: ``given`` (epoch or explicit offset), ``ok``
    (one offset), ``ambiguous`` (the earlier instant is taken), ``nonexistent`` (read with the offset before the gap),
    ``unreadable`` (instant NULL). The zone table covers exactly the zones and years that occur in the local times; the
    columns in ``keep`` are passed through. Empty input gives no rows.
    """
    passed = F.struct(*keep) if keep else F.lit(None)
    rows = df.select(key, "time", "date", "datasource", passed.alias("_kept")).where(F.col("time").isNotNull())
    rows = rows.join(broadcast_if_small(clocks), "datasource", "left").withColumn("zone", F.coalesce("zone", F.lit("UTC")))
    first = F.coalesce(F.col("month_first"), F.lit(False))
    rows = rows.withColumn("time", F.trim("time")).withColumn("at", _stamp(F.col("time"), F.col("date"), first))
    t = F.col("time")
    epoch = F.when(t.rlike(r"^\d{9,10}(\.\d+)?$"), t.try_cast("double")).when(t.rlike(r"^\d{13}$"), F.floor(t.try_cast("double") / 1000))
    parsed = rows.select(key, "zone", F.floor(epoch).cast("bigint").alias("epoch"), F.col("at.local").alias("local"), F.col("at.given").alias("given"), "_kept")
    # written once: the years that occur are read off it before the join
    parsed = cut(parsed.withColumn("day", F.floor(F.col("local") / 86400).cast("int")))
    on_clock = parsed.where(F.col("epoch").isNull() & F.col("given").isNull() & F.col("local").isNotNull())
    segments = cut(zone_segments(cut(on_clock.select("zone", F.year(F.date_from_unix_date("day")).alias("year")).distinct())))
    hit = parsed.alias("p").join(
        broadcast_if_small(segments).alias("g"),
        (F.col("p.zone") == F.col("g.zone")) & (F.col("p.day") == F.col("g.day")) & (F.col("p.local") >= F.col("g.from_s")) & (F.col("p.local") < F.col("g.to_s")),
        "left",
    )
    n = F.size("g.offsets")
    from_clock = F.col("local") - 60 * F.when(n > 0, F.element_at("g.offsets", 1)).otherwise(F.coalesce(F.col("g.held"), F.when(F.col("p.zone") == "UTC", 0)))
    instant = F.coalesce(F.col("epoch"), F.col("local") - 60 * F.col("given"), from_clock)
    status = (
        F.when(instant.isNull(), "unreadable")
        .when(F.col("epoch").isNotNull() | F.col("given").isNotNull(), "given")
        .when(n == 2, "ambiguous")
        .when(n == 0, "nonexistent")
        .otherwise("ok")
    )
    return hit.select(F.col(key), instant.alias("instant"), status.alias("status"), *(["_kept.*"] if keep else []))


def times_found(plumes: DataFrame, obs: DataFrame, sources: DataFrame) -> DataFrame:
    """tbl, row_id, norm of every plume time and utc offset that is not in its plain form already."""
    odd = plumes.where(~F.col("time").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"))
    p = normalise_times(odd, "plume_id", source_clocks(sources)).where(F.col("instant").isNotNull())
    conv = F.col("utc_conv")
    plain = conv.rlike(r"^-?\d+(\.\d+)?$") & (F.abs(conv.try_cast("double")) <= 14)
    o = obs.where(conv.isNotNull() & ~plain).select("row_id", offset_minutes(conv).alias("norm")).where(F.col("norm").isNotNull())
    return p.select(F.lit("plumes").alias("tbl"), F.col("plume_id").alias("row_id"), F.col("instant").alias("norm")).unionByName(
        o.select(F.lit("obspack").alias("tbl"), "row_id", "norm")
    )
