"""Runs of the same activity, under any spelling, collapsed into one event."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.functions.checkpoints import materialise
from weftlog.functions.columns import ACTIVITY, CASE, ORD, TIME, col, first_of_repeats, micros
from weftlog.functions.ordered import in_order

# Cyrillic and Greek letters that look like Latin ones, and the Latin letters.
LOOK_ALIKE = ("авеёзікмнорстухѕіјАВЕЁЗІКМНОРСТУХЅІЈαορντικχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abeeзikmhopctyxsijABEEЗIKMHOPCTYXSIJaopvtikxABEZHIKMNOPTYX")


NEAR = 2
MOST_ENTRIES = 20_000
HOT = 64  # a name with more than one in so many of the rows is joined by broadcast


def spelling_key(name: Column) -> Column:
    """A name without case, quoting, separators and camel case, look-alike letters written in Latin."""
    latin = F.translate(name, *LOOK_ALIKE)
    spaced = F.regexp_replace(latin, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-z])(?=[0-9])", " ")
    return F.trim(F.regexp_replace(F.lower(spaced), r"[^\p{L}\p{N}]+", " "))


def resolve_names(names: DataFrame, activities: DataFrame) -> DataFrame:
    """The entry of ``activities`` that each distinct name spells: ``name, act_name``.

    A name whose key is an entry's key is that entry; else, if dropping a copy
    mark at its end (``#3``, ``x2``, ``(2)``, ``/1``, `` 2``) makes it one, that
    one; else the entry with the nearest key, with or without the mark, by edit
    distance, where a swap of letters counts one (ties: the entry that sorts
    first). Every distinct name is compared with each key inside one
    expression, JVM-side, at first only as far as ``NEAR`` edits. ``activities``
    is the catalogue of what names may mean; more than ``MOST_ENTRIES`` keys
    do not go into an expression and raise an error.
    """
    entries = sorted({(r["k"], r["act_name"]) for r in activities.where("act_name is not null").select("act_name", spelling_key(F.col("act_name")).alias("k")).collect()}, key=lambda e: e[1])
    if len(entries) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} entries to compare names with")
    marked = names.select(F.col("name"), spelling_key(F.col("name")).alias("k"), spelling_key(F.regexp_replace(F.rtrim("name"), r"(\s*#\s*\d+|\s+[xX]\d+|\s*\(\d+\)|/\d+|[\s_.-]+\d+)\s*[\"'.]*$", "")).alias("bare"))
    if not entries:
        return names.select("name", F.lit(None).cast("string").alias("act_name"))
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("act_name")) for k, a in entries])

    def letters(text: Column) -> Column:
        return F.array_join(F.array_sort(F.split(text, "")), "")

    def distance(key: Column, entry: Column, most: int | None) -> Column:
        raw = F.levenshtein(key, entry) if most is None else F.levenshtein(key, entry, most)
        return F.when(raw < 0, None).when((raw == 2) & (letters(key) == letters(entry)), 1).otherwise(raw)

    def nearest(most: int | None) -> Column:
        scored = F.transform(table, lambda e: F.struct(F.least(distance(F.col("k"), e["k"], most), distance(F.col("bare"), e["k"], most)).alias("d"), e["act_name"].alias("a")))
        return F.array_min(scored if most is None else F.filter(scored, lambda e: e["d"].isNotNull()))["a"]

    exact = names.sparkSession.createDataFrame(entries, "k string, act_name string").dropDuplicates(["k"])
    known = marked.join(exact, "k", "left").join(exact.select(F.col("k").alias("bare"), F.col("act_name").alias("bare_name")), "bare", "left")
    return known.select("name", F.coalesce("act_name", "bare_name", nearest(NEAR), nearest(None)).alias("act_name"))


def _with_entry(rows: DataFrame, counted: DataFrame, activities: DataFrame) -> DataFrame:
    """``rows`` with the entry that their ``name`` spells, however uneven names are; ``counted`` has all names with numbers of rows.

    Fewer than ``HOT`` names can hold more than one in ``HOT`` of the rows:
    those are joined by broadcast, and their rows spread by ordinal in the
    join with all other names.
    """
    resolved = materialise(resolve_names(counted.select("name"), activities).join(counted, "name"))
    total = resolved.agg(F.sum("n")).first()[0] or 0
    hot = resolved.where(F.col("n") * HOT > total).select("name", F.col("act_name").alias("hot_name"))
    rest = resolved.where(F.col("n") * HOT <= total).select(F.col("name").alias("key"), "act_name")
    marked = rows.join(F.broadcast(hot), "name", "left")
    key = F.when(F.col("hot_name").isNull(), F.col("name")).otherwise(F.concat(F.lit("\x00"), F.pmod("ord", F.lit(4096)).cast("string")))
    return marked.withColumn("key", key).join(rest, "key", "left").withColumn("act_name", F.coalesce("hot_name", "act_name")).drop("hot_name", "key", "name")


PIECE = "part int, place long, edge boolean, case_id string, act_name string, first_ord long, n_events long, from_us long, to_us long"


def _piecer(shortest: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of a task, whose events come in order.

        Run starts of a batch are a sorted array of positions; every event
        finds its run by binary search there. The last run stays open until the
        next start. The first and the last of the task may go on in others.
        """
        part, place, last = TaskContext.get().partitionId(), 0, None

        def made(rows: list[tuple], places: list[int], edge: bool) -> pa.RecordBatch:
            columns = [pa.array([part] * len(rows), pa.int32()), pa.array(places, pa.int64()), pa.array([edge] * len(rows), pa.bool_())]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(columns + [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[f.split()[0] for f in PIECE.split(", ")])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            case, name = batch.column(0), pc.fill_null(batch.column(1), "")
            ts, ords = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            head = last is None or last[0] != case[0].as_py() or (last[1] or "") != name[0].as_py()
            other = pc.or_(*[pc.not_equal(x.slice(1), x.slice(0, n - 1)) for x in (case, name)]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[head, other])
            run = np.searchsorted(starts, np.arange(n), side="right")  # 0 is the run that the batch before left open
            sizes = np.bincount(run, minlength=len(starts) + 1)
            if last is not None and sizes[0]:
                last = (*last[:3], last[3] + int(sizes[0]), last[4], int(ts[sizes[0] - 1]))
            if not len(starts):
                continue
            stops = np.r_[starts[1:], n] - 1
            begun = [x.take(pa.array(starts)).to_pylist() for x in (case, batch.column(1))]
            rows = list(zip(*begun, ords[starts].tolist(), sizes[1:].tolist(), ts[starts].tolist(), ts[stops].tolist()))
            if last is not None:
                rows.insert(0, last)
            last = rows.pop()
            if rows and not place:
                yield made(rows[:1], [0], True)
                rows, place = rows[1:], 1
            long = [r for r in rows if r[3] >= shortest]
            if long:
                yield made(long, [1] * len(long), False)
        if last is not None:
            yield made([last], [2 if place else 0], True)

    return pieces


def collapse_runs(log: DataFrame, activities: DataFrame, shortest: int = 2) -> DataFrame:
    """Maximal runs of consecutive events of a case that name the same activity.

    Returns ``case_id, first_ord, act_name, n_events, duration_us`` for runs of
    ``shortest`` events or more.

    Boundary lookup: an event starts a run when its activity or case differs
    from that of the preceding event. Events are put in order over range
    partitions of like size, so no task holds more of a long case than of
    others. In each, run starts are gathered into sorted arrays, every event
    finds its run by binary search there, and runs are aggregated; the first
    and the last run of each partition are summed where they continue each
    other.

    Defined cases: rows with a null case, name or time are left out; rows equal
    in all but the ordinal count once, with the smallest; ties in time are
    ordered by the ordinal; without any entry no event names one; an empty log
    gives no rows; extra columns only tell repeated rows apart.
    """
    kept = log.where(col(CASE).isNotNull() & col(ACTIVITY).isNotNull() & col(TIME).isNotNull())
    once = first_of_repeats(kept)
    raw = once.select(col(CASE).cast("string").alias("case_id"), col(ACTIVITY).alias("name"), micros(once, TIME).alias("ts_us"), col(ORD).cast("long").alias("ord"))
    counted = kept.groupBy(col(ACTIVITY).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    ordered = in_order(_with_entry(raw, counted, activities), "case_id", "ts_us", "ord")
    pieces = materialise(ordered.select("case_id", "act_name", "ts_us", "ord").mapInArrow(_piecer(shortest), PIECE))
    along = Window.partitionBy("case_id").orderBy("part", "place")
    goes_on = (F.col("place") == 0) & F.coalesce(F.lag("act_name").over(along) == F.col("act_name"), F.lit(False))
    edges = pieces.where("edge").withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("new").over(along))
    joined = edges.groupBy("case_id", "run").agg(F.min_by("first_ord", F.struct("part", "place")).alias("first_ord"), F.first("act_name").alias("act_name"), F.sum("n_events").alias("n_events"), F.min("from_us").alias("from_us"), F.max("to_us").alias("to_us"))
    columns = ["case_id", "first_ord", "act_name", "n_events", "from_us", "to_us"]
    runs = pieces.where("not edge").select(columns).unionByName(joined.select(columns))
    return runs.where((F.col("n_events") >= shortest) & F.col("act_name").isNotNull()).select("case_id", "first_ord", "act_name", "n_events", (F.col("to_us") - F.col("from_us")).alias("duration_us"))
