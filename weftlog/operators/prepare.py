"""Log preparation: sampling cases, and turning atomic and lifecycle logs into interval logs.

Pandas row order has no counterpart here: every log carries a unique ordinal
(``event_ord``) that breaks ties in time. Rows with a null case are in no case
and are left out wherever cases are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.functions.columns import ACTIVITY, CASE, DAY_US, END_TRANSITIONS, INSTANCE, LIFECYCLE, ORD, START, START_TRANSITIONS, TIME, col, micros, require, sliced_lag

DURATION = "@weft:duration"
WAITING = "@weft:waiting_time"

# Messages that users of the log format rely on.
SEVERAL_STARTS = "Multiple starting events found for single complete event of instance id "
SEVERAL_ENDS = "Multiple complete events found for same activity in case "


def log_len(log: DataFrame, case: str = CASE) -> DataFrame:
    """Number of distinct non-null cases, as one row ``n_cases``."""
    return log.agg(F.countDistinct(col(case)).alias("n_cases"))


def hash_key(seed: int | str, *parts: Column) -> Column:
    """A text that orders rows at random, the same in every engine with md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def _least_keys(keys: DataFrame, n: int) -> DataFrame:
    """The ``n`` cases with the least keys (ties: the case that sorts first), without a global sort.

    Counts by the key's first four digits (at most 65,536 rows) show in which
    stretch the n-th lies; only that stretch is ordered.
    """
    stretch = F.substring("key", 1, 4)
    counts = sorted((r["s"], r["count"]) for r in keys.groupBy(stretch.alias("s")).count().collect())
    taken, last = 0, None
    for s, count in counts:
        if taken + count > n:
            last = s
            break
        taken += count
    if last is None:
        return keys.select("case_id")
    rest = keys.where(stretch == last).orderBy("key", "case_id").limit(n - taken)
    return keys.where(stretch < last).select("case_id").unionByName(rest.select("case_id"))


def _sampled_cases(log: DataFrame, n: int, seed: int, method: str, case: str, ordinal: str) -> DataFrame:
    if method not in ("event_biased", "uniform"):
        raise ValueError(f"unknown sampling method: {method}")
    rows = log.where(col(case).isNotNull())
    if method == "uniform":
        keys = rows.select(col(case).alias("case_id")).distinct().withColumn("key", hash_key(seed, F.col("case_id")))
    else:
        keys = rows.groupBy(col(case).alias("case_id")).agg(F.min(hash_key(seed, col(ordinal))).alias("key"))
    return _least_keys(keys, n)


def sample_cases(log: DataFrame, n: int, seed: int = 0, method: str = "event_biased", case: str = CASE, ordinal: str = ORD) -> DataFrame:
    """All rows of ``n`` sampled cases (of all, where there are fewer).

    ``event_biased`` takes the cases met first in a shuffle of the events, so
    longer cases are likelier; ``uniform`` gives every case the same chance.
    """
    chosen = _sampled_cases(log, n, seed, method, case, ordinal)
    return log.join(chosen, col(case) == chosen["case_id"], "left_semi")


def split_cases(log: DataFrame, frac: float, seed: int = 0, method: str = "event_biased", case: str = CASE, ordinal: str = ORD) -> tuple[DataFrame, DataFrame]:
    """Two logs: ``int(cases * frac)`` sampled cases, and all other rows with a case."""
    n = int(log_len(log, case).first()[0] * frac)
    chosen = _sampled_cases(log, n, seed, method, case, ordinal)
    return log.join(chosen, col(case) == chosen["case_id"], "left_semi"), log.where(col(case).isNotNull()).join(chosen, col(case) == chosen["case_id"], "left_anti")


def _is(values: tuple[str, ...], lifecycle: str = LIFECYCLE) -> Column:
    return F.coalesce(col(lifecycle).isin(*values), F.lit(False))


def _packed(log: DataFrame, **keys: Column) -> DataFrame:
    """Rows as one struct ``row`` beside internal columns, so that no name of the log can clash with ours."""
    return log.select(F.struct(*[col(c).alias(c) for c in log.columns]).alias("row"), *[k.alias(name) for name, k in keys.items()])


def _unpacked(rows: DataFrame, columns: list[str], **added: Column) -> DataFrame:
    """The log's columns again, with added ones."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns], *[v.alias(name) for name, v in added.items()])


def _ranked(rows: DataFrame, keys: list[str], width_us: int) -> DataFrame:
    """Packed rows with ``pos``, numbered from 0 by ``ts_us`` and ``ord`` inside ``keys``; hot keys are numbered slice by slice."""
    return sliced_lag(rows, ["ord"], ("ts_us", "ord"), keys, width_us)


def lifecycle_to_interval(log: DataFrame, instance: str | None = INSTANCE, on_ambiguous: str = "error", ordinal: str = ORD, width_us: int = 30 * DAY_US) -> DataFrame:
    """END rows with the time of their START as ``start_timestamp``.

    Inside a case, activity and (where ``instance`` names a column of the log)
    instance, the k-th END by time takes the k-th START by time, which may lie
    after it; an END without one takes its own time. As all STARTs are visible
    to every END, first-in-first-out matching is this join on ranks.

    With instances, several STARTs for one END are an error when the rows are
    computed (``on_ambiguous="error"``) or matched in order (``"first"``).

    Defined cases: rows with a null case or time are left out; a null activity
    or instance matches nothing; an existing ``start_timestamp`` is replaced;
    other columns stay as they are.
    """
    require(log, CASE, ACTIVITY, TIME, LIFECYCLE, ordinal)
    kept = log.drop(START).where(col(CASE).isNotNull() & col(TIME).isNotNull())
    by_instance = instance is not None and instance in log.columns
    keys = {"k0": col(CASE), "k1": col(ACTIVITY)} | ({"k2": col(instance)} if by_instance else {})
    names = list(keys)
    packed = _packed(kept, ts_us=micros(kept, TIME), ord=col(ordinal), at=col(TIME), ends=_is(END_TRANSITIONS), starts=_is(START_TRANSITIONS), **keys)
    keyed = F.lit(True)
    for n in names:
        keyed = keyed & F.col(n).isNotNull()
    ends = _ranked(packed.where(F.col("ends") & keyed), names, width_us)
    starts = _ranked(packed.where(F.col("starts") & keyed), names, width_us).select(*names, "pos", F.col("at").alias("began"))
    joined = ends.join(starts, [*names, "pos"], "left")
    start = F.coalesce("began", "at")
    if by_instance and on_ambiguous == "error":
        several = starts.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        joined = joined.join(several, names, "left")
        message = F.concat(F.lit(SEVERAL_STARTS), F.col("k2").cast("string"))
        start = F.when(F.col("n") > 1, F.raise_error(message).cast(log.schema[TIME].dataType)).otherwise(start)
    loose = packed.where(F.col("ends") & ~keyed)
    return _unpacked(joined, kept.columns, **{START: start}).unionByName(_unpacked(loose, kept.columns, **{START: F.col("at")}))


def atomic_to_lifecycle(log: DataFrame, ordinal: str = ORD) -> DataFrame:
    """Every row becomes ``complete`` with an instance id ``<case>:<k>``, k its place in the case's row order."""
    return add_instance_ids(log.withColumn(LIFECYCLE, F.lit("complete")), ordinal)


def atomic_to_interval(log: DataFrame) -> DataFrame:
    """Every row starts when it completes."""
    require(log, TIME)
    return log.withColumn(START, col(TIME))


def add_instance_ids(log: DataFrame, ordinal: str = ORD, width: int = 1 << 20) -> DataFrame:
    """Instance ids ``<case>:<k>``, k from 1 in order of the ordinal; rows without a case get null."""
    require(log, CASE, ordinal)
    base = log.drop(INSTANCE)
    packed = _packed(base, case_id=col(CASE), ord=col(ordinal).cast("long"))
    placed = sliced_lag(packed.where("case_id is not null"), ["ord"], ("ord", "ord"), "case_id", width)
    numbered = F.concat(F.col("case_id").cast("string"), F.lit(":"), (F.col("pos") + 1).cast("string"))
    rest = _unpacked(packed.where("case_id is null"), base.columns, **{INSTANCE: F.lit(None).cast("string")})
    return _unpacked(placed, base.columns, **{INSTANCE: numbered}).unionByName(rest)


def seconds_between(log: DataFrame, start: str, end: str) -> Column:
    return (micros(log, end) - micros(log, start)) / F.lit(1e6)


def add_duration(log: DataFrame, start: str = START, end: str = TIME, name: str = DURATION) -> DataFrame:
    """Seconds from start to end as ``name``; negative where an end lies before its start; null where a bound is."""
    require(log, start, end)
    return log.withColumn(name, seconds_between(log, start, end))


def add_waiting_time(log: DataFrame, start: str = START, end: str = TIME, name: str = WAITING, ordinal: str = ORD, width_us: int = 30 * DAY_US) -> DataFrame:
    """Seconds from the preceding event's end to the event's start as ``name``; 0 for a case's first.

    Events of a case are ordered by end, then activity, then ordinal. Rows with
    a null case or end are left out.
    """
    require(log, CASE, ACTIVITY, start, end, ordinal)
    base = log.drop(name)
    packed = _packed(base, case_id=col(CASE), start_us=micros(base, start), end_us=micros(base, end), tie=F.struct(col(ACTIVITY).alias("a"), col(ordinal).alias("o")))
    lagged = sliced_lag(packed.where("case_id is not null and end_us is not null"), ["end_us"], ("end_us", "tie"), "case_id", width_us)
    waited = F.when(F.col("prev_end_us").isNull(), F.lit(0.0)).otherwise((F.col("start_us") - F.col("prev_end_us")) / F.lit(1e6))
    return _unpacked(lagged, base.columns, **{name: waited})


def infer_instances(log: DataFrame, ordinal: str = ORD, width_us: int = 30 * DAY_US) -> DataFrame:
    """Instance ids from order: the k-th START and the k-th END of an activity in a case get ``"k"`` (from 0).

    Rows without a time come last. Rows of other transitions, and END and START
    rows without case or activity, get ``"None"``.
    """
    require(log, CASE, ACTIVITY, TIME, LIFECYCLE)
    base = log.drop(INSTANCE)
    kind = F.when(_is(END_TRANSITIONS), F.lit("end")).when(_is(START_TRANSITIONS), F.lit("start"))
    usable = col(CASE).isNotNull() & col(ACTIVITY).isNotNull()
    last = F.lit(1 << 62)
    packed = _packed(base, k0=col(CASE), k1=col(ACTIVITY), k2=F.when(usable, kind), ts_us=F.coalesce(micros(base, TIME), last), ord=col(ordinal))
    numbered = _ranked(packed.where("k2 is not null"), ["k0", "k1", "k2"], width_us)
    rest = _unpacked(packed.where("k2 is null"), base.columns, **{INSTANCE: F.lit("None")})
    return _unpacked(numbered, base.columns, **{INSTANCE: F.col("pos").cast("string")}).unionByName(rest)


def fold_instances(log: DataFrame, on_ambiguous: str = "error") -> DataFrame:
    """START and END rows of one case, activity and instance become one row with both times.

    The END gets the START's time, START rows are dropped, rows of other
    transitions stay; a row without a start keeps its own ``start_timestamp``
    or else gets its own time. Several STARTs or ENDs of one instance are an
    error when the rows are computed (``"error"``), or the earliest START is
    taken (``"first"``). A group without a START gives ENDs their own time.
    """
    if INSTANCE not in log.columns:
        raise ValueError(f'Instance id column "{INSTANCE}" not found in log')
    require(log, CASE, ACTIVITY, TIME, LIFECYCLE)
    own = F.coalesce(col(START), col(TIME)) if START in log.columns else col(TIME)
    packed = _packed(log, c=col(CASE), a=col(ACTIVITY), i=col(INSTANCE), at=col(TIME), own=own, starts=_is(START_TRANSITIONS), ends=_is(END_TRANSITIONS))
    groups = packed.where("c is not null and a is not null and i is not null").groupBy("c", "a", "i").agg(F.count_if("starts").alias("n_starts"), F.count_if("ends").alias("n_ends"), F.min(F.when(F.col("starts"), F.col("at"))).alias("began"))
    joined = packed.where(~F.col("starts")).join(groups, ["c", "a", "i"], "left")
    start = F.when(F.col("ends") & F.col("began").isNotNull(), F.col("began")).otherwise(F.col("own"))
    if on_ambiguous == "error":
        kind = log.schema[TIME].dataType
        start = (
            F.when(F.col("n_starts") > 1, F.raise_error(F.concat(F.lit(SEVERAL_STARTS), F.col("i").cast("string"))).cast(kind))
            .when(F.col("n_ends") > 1, F.raise_error(F.concat(F.lit(SEVERAL_ENDS), F.col("c").cast("string"))).cast(kind))
            .otherwise(start)
        )
    return _unpacked(joined, [c for c in log.columns if c != START], **{START: start})


def ensure_start(log: DataFrame, strict: bool = False, on_ambiguous: str = "error", ordinal: str = ORD) -> DataFrame:
    """An interval log from any log: as it is where it has ``start_timestamp``, else from its lifecycle, else atomic.

    ``strict`` goes the longer way: without a lifecycle all rows are complete,
    without instances these are inferred, then instances are folded.
    """
    if START in log.columns:
        return log
    if not strict:
        return lifecycle_to_interval(log, on_ambiguous=on_ambiguous, ordinal=ordinal) if LIFECYCLE in log.columns else atomic_to_interval(log)
    if LIFECYCLE not in log.columns:
        log = log.withColumn(LIFECYCLE, F.lit("complete"))
    if INSTANCE not in log.columns:
        log = infer_instances(log, ordinal)
    return fold_instances(log, on_ambiguous)
