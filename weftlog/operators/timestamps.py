"""Mixed timestamp spellings and zones to instants in UTC."""

from __future__ import annotations

import datetime as dt
import math
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.functions.checkpoints import materialise
from weftlog.functions.columns import DAY_US, ORD, START, TIME, col

# English month names and the zone words that always mean UTC.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
UTC_WORDS = ("Z", "UTC", "GMT")

SECOND_US = 1_000_000
HOUR_US = 3600 * SECOND_US
OFFSET = r"[+-]\d{2}(?::?\d{2})?"
YEAR_FIRST = r"(?<y1>\d{4})-(?<m1>\d{1,2})-(?<d1>\d{1,2})(?:[Tt ]\s*|$)"
SLASHED = r"(?<a>\d{1,2})/(?<b>\d{1,2})/(?<y2>\d{4}|\d{2})(?:,?\s+|$)"
DOTTED = r"(?<d3>\d{1,2})\.(?<m3>\d{1,2})\.(?<y3>\d{4}|\d{2})(?:,?\s+|$)"
DAY_MONTH = r"(?:[A-Za-z]{3,9},?\s+)?(?<d4>\d{1,2})\s+(?<n4>[A-Za-z]{3,9})\.?,?\s+(?<y4>\d{4})(?:,?\s+|$)"
MONTH_DAY = r"(?<n5>[A-Za-z]{3,9})\.?\s+(?<d5>\d{1,2}),?\s+(?<y5>\d{4})(?:,?\s+|$)"
CLOCK = rf"(?:(?<h>\d{{1,2}})(?::(?<i>\d{{2}})(?::(?<s>\d{{2}})(?:[.,](?<f>\d+))?)?)?(?:\s*(?<half>[AaPp][Mm]))?)?\s*(?<z>[A-Za-z]{{1,5}}|{OFFSET})?\s*(?:\[(?<r>[^\]]+)\])?"
COMPACT = rf"(?<y6>\d{{4}})(?<m6>\d{{2}})(?<d6>\d{{2}})[Tt]?(?<h6>\d{{2}})(?<i6>\d{{2}})(?<s6>\d{{2}})\s*(?<z6>[Zz]|[A-Za-z]{{2,5}}|{OFFSET})?"
#: All spellings of a date with or without a time, matched once; a value has the groups of one of them.
SPELLING = f"^(?:(?:{YEAR_FIRST}|{SLASHED}|{DOTTED}|{DAY_MONTH}|{MONTH_DAY}){CLOCK}|{COMPACT})$"
#: What is read from a value, and the groups that may hold it.
PARTS = {"year": "y1 y2 y3 y4 y5 y6", "month": "m1 m3 m6", "name": "n4 n5", "day": "d1 d3 d4 d5 d6", "first": "a", "second": "b", "hour": "h h6", "minute": "i i6", "sec": "s s6", "fraction": "f", "half": "half", "zone": "z z6", "region": "r"}
BREAK = "\x01"
BIN_US = 300 * SECOND_US  # of distances to neighbours, when zones are estimated
BINS = 300  # on each side


def _number(text: Column) -> Column:
    """The number that a text of digits writes, null for an empty one (a failed cast is an exception each time)."""
    return F.when(text != "", text.cast("long"))


def _month(name: Column) -> Column:
    """The number of an English month name or an abbreviation of it."""
    place = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))
    full = F.get(F.array(*[F.lit(m) for m in MONTHS]), (place - 1).cast("int"))
    return F.when(full.startswith(F.lower(name)) | ((F.lower(name) == "sept") & (place == 9)), place)


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 to a date of the Gregorian calendar, null for impossible dates."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    length = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    # Years and months counted from March, so that a leap day ends the year.
    year, month = F.when(m <= 2, y - 1).otherwise(y), F.when(m <= 2, m + 9).otherwise(m - 3)
    days = year * 365 + F.floor(year / 4) - F.floor(year / 100) + F.floor(year / 400) + F.floor((month * 153 + 2) / 5) + d - 719_469
    return F.when((y >= 1) & m.between(1, 12) & (d >= 1) & (d <= length), days.cast("long"))


def instant_at(wall_us: Column, zone: Column) -> Column:
    """The one instant at which the zone's clocks show ``wall_us``, else null.

    Null where the zone skips the time or shows it twice. The zone's offsets a
    day before and a day after are the only ones in question.
    """
    def guess(shift: int) -> Column:
        moved = wall_us + F.lit(shift)
        return wall_us - moved + F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(moved), zone))

    def holds(instant: Column) -> Column:
        return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(instant), zone)) == wall_us

    fitting = F.filter(F.array_distinct(F.array(guess(-DAY_US), guess(DAY_US))), holds)
    return F.when(F.size(fitting) == 1, F.get(fitting, F.lit(0)))


def parse_wall(df: DataFrame, value: str, date_order: str) -> DataFrame:
    """Split the text in ``value`` into wall time and zone parts.

    Adds ``epoch_us`` (values that are plain counts since 1970), ``wall_us``,
    ``offset_us`` (a written offset, Z, UTC or GMT), ``abbr`` (another zone
    word) and ``region`` (a bracketed zone); all null where the text is
    unreadable or no possible date. ``date_order`` names a column with DMY or
    MDY for slashed dates; where that is null a slashed date is unreadable.
    """
    v = F.trim(F.regexp_replace(col(value), r"[\s\u00a0]+", " "))
    groups = BREAK.join("".join(f"${{{g}}}" for g in names.split()) for names in PARTS.values())
    # One match writes all parts side by side; an unreadable value stays one piece.
    parts = df.withColumn("_v", v).withColumn("_p", F.split(F.regexp_replace("_v", SPELLING, groups), BREAK))

    def read(r: Column) -> Column:
        def part(name: str) -> Column:
            text = F.get(r["p"], F.lit(list(PARTS).index(name)))
            return F.when(text != "", text)

        year, first, second, order = part("year"), _number(part("first")), _number(part("second")), F.upper(r["order"])
        return F.struct(
            F.when(F.length(year) == 2, _number(year) + 2000).otherwise(_number(year)).alias("y"),
            F.coalesce(_number(part("month")), _month(part("name")), F.when(order == "DMY", second).when(order == "MDY", first)).alias("m"),
            F.coalesce(_number(part("day")), F.when(order == "DMY", first).when(order == "MDY", second)).alias("d"),
            _number(part("hour")).alias("h"),
            _number(part("minute")).alias("i"),
            F.coalesce(_number(part("sec")), F.lit(0)).alias("s"),
            F.coalesce(_number(F.rpad(F.substring(part("fraction"), 1, 6), 6, "0")), F.lit(0)).alias("f"),
            F.lower(part("half")).alias("half"),
            F.upper(part("zone")).alias("zone"),
            F.regexp_replace(part("zone"), r"\D", "").alias("digits"),
            part("region").alias("region"),
            F.when(r["v"].rlike(r"^\d{10}(?:\d{3}){0,2}$"), _number(F.rpad(r["v"], 16, "0"))).alias("epoch_us"),
        )

    def finish(r: Column) -> Column:
        h, zone = r["h"], r["zone"]
        hour = F.when(r["half"].isNull(), F.coalesce(h, F.lit(0))).when(h.between(1, 12), h % 12 + F.when(r["half"] == "pm", 12).otherwise(0))
        minute, signed = F.coalesce(r["i"], F.lit(0)), F.substring(zone, 1, 1).isin("+", "-")
        past = F.coalesce(_number(F.substring(r["digits"], 3, 2)), F.lit(0))
        ahead = _number(F.substring(r["digits"], 1, 2)) * 60 + past
        offset = F.when(signed & (past < 60) & (ahead <= 18 * 60), F.when(zone.startswith("-"), -ahead).otherwise(ahead) * (60 * SECOND_US)).when(zone.isin(*UTC_WORDS), F.lit(0))
        clock = (h.isNull() | r["i"].isNotNull()) & (hour < 24) & (minute < 60) & (r["s"] < 60)
        wall = F.when(clock & (zone.isNull() | ~signed | offset.isNotNull()), _days(r["y"], r["m"], r["d"]) * DAY_US + hour * HOUR_US + minute * (60 * SECOND_US) + r["s"] * SECOND_US + r["f"])
        return F.struct(r["epoch_us"].alias("epoch_us"), wall.alias("wall_us"), offset.cast("long").alias("offset_us"), F.when(~signed & ~zone.isin(*UTC_WORDS), zone).alias("abbr"), r["region"].alias("region"))

    # As functions of one row's parts: computed once, and not one method too large for the JVM to compile.
    whole = F.struct(F.when(F.size("_p") == len(PARTS), F.col("_p")).alias("p"), F.col("_v").alias("v"), col(date_order).alias("order"))
    return parts.select(*[col(c) for c in df.columns], F.inline(F.transform(F.transform(F.array(whole), read), finish)))


def _zone_names() -> list[str]:
    return sorted(z for z in available_timezones() if "/" in z or z in ("UTC", "GMT"))


def _abbreviations(sites: DataFrame) -> DataFrame:
    """Offsets of the zone words in ``sites``: standard as in the zone's winter, summer an hour or less ahead of it."""
    known = F.col("tz_name").isin(*_zone_names())
    # Offsets of January and July of a year cover standard and summer time on both hemispheres.
    half_years = [F.lit(1_672_531_200_000_000), F.lit(1_688_169_600_000_000)]
    offsets = [F.when(known, F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(t), F.col("tz_name"))) - t) for t in half_years]
    pairs = F.array(
        F.struct(F.upper("abbr_std").alias("abbr"), F.least(*offsets).alias("abbr_offset_us")),
        F.struct(F.upper("abbr_dst").alias("abbr"), F.greatest(*offsets).alias("abbr_offset_us")),
    )
    return sites.select(F.inline(pairs)).where("abbr is not null and abbr_offset_us is not null").groupBy("abbr").agg(F.min("abbr_offset_us").alias("abbr_offset_us"), F.max("abbr_offset_us").alias("_other")).where("abbr_offset_us = _other").drop("_other")


def read_values(log: DataFrame, sites: DataFrame, fields: tuple[str, ...] = (TIME, START)) -> DataFrame:
    """One row per non-null value with its parts: ``event_ord, field_name, site_id, tz_name, fixed_us, wall_us, region``.

    ``fixed_us`` is the instant where the value itself settles it by a count
    since 1970, an offset or an abbreviation.
    """
    known = _zone_names()
    places = sites.select(F.col("site_id").cast("string").alias("site_id"), F.when(F.col("tz_name").isin(*known), F.col("tz_name")).alias("tz_name"), F.col("date_order").alias("date_order"), "abbr_std", "abbr_dst").dropDuplicates(["site_id"])
    values = F.array(*[F.struct(F.lit(f).alias("field_name"), col(f).cast("string").alias("value")) for f in fields])
    rows = log.select(col(ORD).alias("event_ord"), col("site_id").cast("string").alias("site_id"), F.inline(values)).where("value is not null")
    rows = rows.join(places.select("site_id", "tz_name", "date_order"), "site_id", "left")
    parsed = parse_wall(rows, "value", "date_order").join(_abbreviations(places), "abbr", "left")
    fixed = F.coalesce(F.col("epoch_us"), F.col("wall_us") - F.coalesce(F.col("offset_us"), F.col("abbr_offset_us")))
    readable = F.col("abbr").isNull() | F.col("abbr_offset_us").isNotNull()
    return parsed.where(readable).select("event_ord", "field_name", "site_id", "tz_name", fixed.alias("fixed_us"), "wall_us", "region")


def _histories(first_us: int, last_us: int, preferred: set[str]) -> list[str]:
    """One zone of each class of zones whose clocks agree between two times, a preferred one where there is one."""
    step = max(DAY_US, (last_us - first_us) // 1000)
    times = [dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=t) for t in range(first_us, last_us + step, step)]
    classes: dict[tuple, str] = {}
    for name in sorted(_zone_names(), key=lambda n: (n not in preferred, n)):
        try:
            zone = ZoneInfo(name)
        except (OSError, ValueError):
            continue
        classes.setdefault(tuple(t.astimezone(zone).utcoffset() for t in times), name)
    return sorted(classes.values())


def estimate_zones(values: DataFrame, sites: DataFrame, block: int = 2048, reach: int = 9) -> DataFrame:
    """The zone history of every site that fits its zoneless values best, from arrival order alone.

    Values with a settled instant are anchors: events arrive in ``event_ord``
    order, so a value lies near the middle of the anchors that arrived within
    ``reach`` ordinals before and after it. How far anchors themselves lie from
    their neighbours, counted in bins of five minutes over both fields, says
    how much of a violation a distance is: minus the logarithm of its share, in
    thousandths. Every history of the public zone list is a candidate (zones
    whose clocks agree over the anchors' time are one); the one with the least
    sum of violations is chosen (ties: the name that sorts first). Late rows
    are far from their neighbours under every history and cancel out. Returns
    ``site_id, tz_name, n_values, violations``.

    Windows run inside blocks of ``block`` consecutive ordinals, so no
    partition depends on how rows are spread over sites. Sites without
    zoneless values beside anchors have no row.
    """
    rows = values.withColumn("block", F.floor(F.col("event_ord") / block))
    along = Window.partitionBy("field_name", "block").orderBy("event_ord")
    near = F.array_sort(F.concat(F.collect_list("fixed_us").over(along.rowsBetween(-reach, -1)), F.collect_list("fixed_us").over(along.rowsBetween(1, reach))))
    middle = (F.get("near", F.floor((F.size("near") - 1) / 2).cast("int")) + F.get("near", F.floor(F.size("near") / 2).cast("int"))) / 2
    placed = materialise(rows.withColumn("near", near).where("size(near) > 1").select("field_name", "site_id", "fixed_us", "wall_us", "region", F.floor(middle).cast("long").alias("middle")))

    def bin_of(instant: Column) -> Column:
        return F.greatest(F.least(F.floor((instant - F.col("middle")) / BIN_US), F.lit(BINS)), F.lit(-BINS)).cast("int")

    anchors = placed.where("fixed_us is not null")
    seen = anchors.groupBy("field_name", bin_of(F.col("fixed_us")).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    span = anchors.agg(F.expr("percentile_approx(fixed_us, array(0.01, 0.99))").alias("p")).first()["p"]
    empty = sites.sparkSession.createDataFrame([], "site_id string, tz_name string, n_values long, violations long")
    if not span:
        return empty
    declared = {r["tz_name"] for r in sites.select("tz_name").distinct().collect()}
    violation = None
    for field in sorted({r["field_name"] for r in seen}):
        n = {r["bin"]: r["n"] for r in seen if r["field_name"] == field}
        whole = sum(n.values()) + (2 * BINS + 1) / 2
        table = F.array(*[F.lit(round(-1000 * math.log((n.get(b, 0) + 0.5) / whole))) for b in range(-BINS, BINS + 1)])
        cost = F.get(table, F.col("bin") + BINS)
        violation = F.when(F.col("field_name") == field, cost) if violation is None else violation.when(F.col("field_name") == field, cost)
    # A fixed list of zones, not a pairing of rows with rows: each value is tried under every candidate history.
    names = F.array(*[F.lit(n) for n in _histories(int(span[0]), int(span[1]), declared)])
    open_values = placed.where("fixed_us is null and region is null and wall_us is not null and site_id is not null")
    tried = open_values.select("field_name", "site_id", "wall_us", "middle", F.explode(names).alias("tz_name"))
    binned = tried.withColumn("bin", bin_of(F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("wall_us"), F.col("tz_name")))))
    scored = binned.groupBy("site_id", "tz_name", "field_name", "bin").agg(F.count(F.lit(1)).alias("n")).where(F.col("field_name").isin(sorted({r["field_name"] for r in seen})))
    summed = scored.groupBy("site_id", "tz_name").agg(F.sum("n").alias("n_values"), F.sum(F.col("n") * violation).cast("long").alias("violations"))
    return summed.groupBy("site_id").agg(F.min_by(F.struct("tz_name", "n_values", "violations"), F.struct("violations", "tz_name")).alias("best")).select("site_id", "best.*")


def normalise_timestamps(log: DataFrame, sites: DataFrame, fields: tuple[str, ...] = (TIME, START)) -> DataFrame:
    """The instant in UTC of every readable value: ``event_ord, field_name, utc_us``.

    What the value says of its zone counts first (count since 1970, offset or
    abbreviation, bracketed region), then the site's zone. A site whose zone is
    not declared gets the history that :func:`estimate_zones` finds for it;
    where all are declared the estimate is not computed.

    Defined cases: null, blank and unreadable values, impossible dates, times
    that the zone skips or shows twice, unknown zone words or regions, and
    zoneless values without a site have no row; repeated rows each keep theirs;
    extra columns are not read; an empty log gives no rows.
    """
    values = read_values(log, sites, fields)
    undeclared = sites.where(~F.coalesce(F.col("tz_name").isin(*_zone_names()), F.lit(False)) & F.col("site_id").isNotNull()).select("site_id").distinct()
    zone = F.col("tz_name")
    if undeclared.take(1):
        estimated = estimate_zones(values, sites).join(undeclared, "site_id", "left_semi").select("site_id", F.col("tz_name").alias("_estimated"))
        values = values.join(estimated, "site_id", "left")
        zone = F.coalesce(zone, F.col("_estimated"))
    region = F.when(F.col("region").isin(*_zone_names()), F.col("region"))
    local = F.when(F.col("region").isNull(), zone).otherwise(region)
    placed = values.withColumn("_zone", local)
    instant = F.coalesce(F.col("fixed_us"), F.when(F.col("_zone").isNotNull() & F.col("wall_us").isNotNull(), instant_at(F.col("wall_us"), F.col("_zone"))))
    # Exploding what is there computes it once; a filter would be computed anew beneath.
    return placed.select(F.col("event_ord").cast("long").alias("event_ord"), "field_name", F.explode(F.array_compact(F.array(instant.cast("long")))).alias("utc_us"))
