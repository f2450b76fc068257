"""Ordered activity patterns, gaps allowed, that many cases share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.functions.checkpoints import materialise
from weftlog.functions.lists import flat, listed
from weftlog.functions.ordered import before_parts, in_order

BITS = 13  # of a position in a chunk
FAR = np.int64(1) << np.int64(BITS)  # the last position of an item that comes again in a later chunk
MOST_CELLS = 4_000_000  # pairs of state and item, or counts, that a task looks at together

CHUNK = "case_id string, chunk long, whole boolean, items array<int>"
STATE = CHUNK + ", later array<int>, codes array<long>, ends array<int>"
MOVED = STATE + ", seek_codes array<long>, seek_items array<int>"


def _record(schema: str, columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])


def _chunker(before: dict[int, tuple[int, str | None, int | None]], names: list[str], size: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The frequent items of cases, whose events come in order, in chunks of at most ``size``.

        A chunk is ``whole`` if it surely is all of its case; the first and the
        last case of a task may go on in others.
        """
        part, known = TaskContext.get().partitionId(), pa.array(names, pa.string())
        earlier = before.get(part, (0, None, None))[1]
        number, open_case, kept, pieces = part << 33, None, [], 0

        def made(cases: list[str], whole: list[bool], items: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += len(cases)
            at = np.arange(number - len(cases), number)
            return _record(CHUNK, [pa.array(cases, pa.string()), pa.array(at), pa.array(whole, pa.bool_()), listed(items.astype(np.int32), sizes)])

        def cut(items: np.ndarray, case: str, whole: bool) -> Iterator[pa.RecordBatch]:
            sizes = np.diff(np.r_[np.arange(0, len(items), size), len(items)])
            if len(items):
                yield made([case] * len(sizes), [whole and len(sizes) == 1] * len(sizes), items, sizes)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            case, codes = batch.column(0), pc.fill_null(pc.index_in(batch.column(1), value_set=known), -1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, pc.not_equal(case.slice(1), case.slice(0, n - 1)).to_numpy(zero_copy_only=False)])
            heads = case.take(pa.array(starts)).to_pylist()
            frequent = codes >= 0
            items, upto = codes[frequent], np.r_[0, np.cumsum(frequent)]
            lo, hi = upto[starts], upto[np.r_[starts[1:], n]]
            first = 0
            if open_case == heads[0]:
                kept.append(items[lo[0] : hi[0]])
                first = 1
                if sum(map(len, kept)) > size:
                    every = np.concatenate(kept)
                    full = len(every) // size * size
                    yield from cut(every[:full], open_case, False)
                    kept, pieces = [every[full:]], 1
                if len(heads) == 1:
                    continue
            if open_case is not None:
                yield from cut(np.concatenate(kept), open_case, not pieces and open_case != earlier)
            short = [i for i in range(first, len(heads) - 1) if lo[i] < hi[i] <= lo[i] + size]
            if short:
                whole = [heads[i] != earlier for i in short]
                taken = np.concatenate([items[lo[i] : hi[i]] for i in short]) if len(short) < len(heads) - 1 - first else items[lo[first] : hi[-2]]
                yield made([heads[i] for i in short], whole, taken, (hi - lo)[short])
            for i in range(first, len(heads) - 1):
                if hi[i] > lo[i] + size:
                    yield from cut(items[lo[i] : hi[i]], heads[i], False)
            open_case, kept, pieces = heads[-1], [items[lo[-1] :]], 0
        if open_case is not None:
            yield from cut(np.concatenate(kept), open_case, False)

    return chunks


class _Sequences:
    """The events of a batch of chunks, ready for look-ups of positions."""

    def __init__(self, batch: pa.RecordBatch, n_items: int):
        self.n_items = n_items
        items, rows = flat(batch.column(3))
        sizes = np.bincount(rows, minlength=batch.num_rows)
        place = np.arange(len(items)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        again, again_rows = flat(batch.column(4))
        key = np.concatenate([rows * n_items + items, again_rows * n_items + again])
        self.events = np.sort(key[: len(items)] << BITS | place)
        # The last position of each item in the case, sorted by row and position.
        last = np.sort(key << (BITS + 1) | np.concatenate([place, np.full(len(again), FAR)]))
        last = last[np.flatnonzero(np.diff(last >> (BITS + 1), append=-1))]
        row, item = np.divmod(last >> (BITS + 1), n_items)
        at = row << (BITS + 1) | last & (2 * FAR - 1)
        order = np.argsort(at, kind="stable")
        self.lasts, self.last_items = at[order], item[order]
        self.stop = np.searchsorted(self.lasts, np.arange(1, batch.num_rows + 1) << (BITS + 1))

    def extensions(self, codes: np.ndarray, rows: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """States with the items that extend each: those whose last position is beyond the state's end."""
        lo = np.searchsorted(self.lasts, rows << (BITS + 1) | np.maximum(ends, 0), side="right")
        lo = np.where(ends < 0, np.searchsorted(self.lasts, rows << (BITS + 1)), lo)
        n = self.stop[rows] - lo
        total = np.r_[0, np.cumsum(n)]
        begin = 0
        while begin < len(codes):
            end = max(begin + 1, int(np.searchsorted(total, total[begin] + MOST_CELLS, side="right")) - 1)
            state = np.repeat(np.arange(begin, end), n[begin:end])
            at = lo[state] + np.arange(len(state)) - (total[state] - total[begin])
            yield state, self.last_items[at]
            begin = end

    def next_places(self, rows: np.ndarray, items: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """First position of the item after the end in the same chunk, or -1."""
        wanted = (rows * self.n_items + items) << BITS | ends + 1
        hit = np.append(self.events, -1)[np.searchsorted(self.events, wanted)]
        return np.where(hit >> BITS == rows * self.n_items + items, hit & (FAR - 1), -1)


def _summed(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    cut = np.flatnonzero(np.diff(ids[order], prepend=-1))
    return ids[order][cut], np.add.reduceat(n[order], cut) if len(cut) else n


def _counter(n_items: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Supports of all one-item extensions, summed over all batches of the task."""
        held, size = [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            return _summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

        for batch in batches:
            if not batch.num_rows:
                continue
            codes, rows = flat(batch.column(5))
            different, code_at = np.unique(codes, return_inverse=True)
            for state, item in _Sequences(batch, n_items).extensions(codes, rows, flat(batch.column(6))[0]):
                pair, n = np.unique(code_at[state] * n_items + item, return_counts=True)
                held.append((different[pair // n_items] * (n_items + 1) + pair % n_items + 1, n))
                size += len(n)
            if size > MOST_CELLS:
                held = [summed()]
                size = len(held[0][0])
                if size > MOST_CELLS // 2:
                    yield _record("code long, n long", [pa.array(x) for x in held[0]])
                    held, size = [], 0
        if held:
            yield _record("code long, n long", [pa.array(x) for x in summed()])

    return count


def _mover(n_items: int, frequent):
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The states of the frequent extensions: the item's first position after the end.

        Where it is not in the state's chunk the extension is handed on as
        ``seek``, to be looked up among the later chunks of the case.
        """
        wanted = frequent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, rows = flat(batch.column(5))
            ends, out = flat(batch.column(6))[0], []
            sequences = _Sequences(batch, n_items)
            for state, item in sequences.extensions(codes, rows, ends):
                code = codes[state] * (n_items + 1) + item + 1
                kept = wanted[np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)] == code
                state, item, code = state[kept], item[kept], code[kept]
                out.append((rows[state], code, sequences.next_places(rows[state], item, ends[state]), item))
            row, code, end, item = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 4
            here = end >= 0
            found, sought = (np.bincount(row[x], minlength=batch.num_rows) for x in (here, ~here))
            lists = [listed(code[here], found), listed(end[here].astype(np.int32), found), listed(code[~here], sought), listed(item[~here].astype(np.int32), sought)]
            moved = _record(MOVED, [*batch.columns[:5], *lists])
            yield moved.filter(pa.array(found + sought > 0))

    return move


def _found_later(moved: DataFrame, firsts: DataFrame) -> DataFrame:
    """As-of lookup of handed-on extensions: the item's first position in a later chunk of the case."""
    seeking = moved.select("case_id", "chunk", F.inline(F.arrays_zip(F.col("seek_codes").alias("code"), F.col("seek_items").alias("item"))))
    places = seeking.select("case_id", "item", "chunk").distinct().withColumn("first", F.lit(None).cast("struct<chunk:bigint,place:int>"))
    later = Window.partitionBy("case_id", "item").orderBy("chunk").rangeBetween(1, Window.unboundedFollowing)
    looked = places.unionByName(firsts).withColumn("next", F.first("first", ignorenulls=True).over(later)).where("first is null").select("case_id", "item", "chunk", "next")
    hits = seeking.join(looked, ["case_id", "item", "chunk"])
    return hits.groupBy("case_id", F.col("next.chunk").alias("chunk")).agg(F.collect_list("code").alias("codes"), F.collect_list("next.place").alias("ends"))


def _in_pieces(pieces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases of several chunks: their chunks with the items that come later, where items first stand, and the first chunks."""
    placed = pieces.select("case_id", "chunk", F.posexplode("items").alias("place", "item"))
    firsts = placed.groupBy("case_id", "item", "chunk").agg(F.min("place").alias("place")).select("case_id", "item", "chunk", F.struct("chunk", F.col("place").cast("int").alias("place")).alias("first"))
    lasts = firsts.groupBy("case_id", "item").agg(F.max("chunk").alias("last")).groupBy("case_id").agg(F.collect_list(F.struct("item", "last")).alias("lasts"))
    later = F.transform(F.filter("lasts", lambda e: e["last"] > F.col("chunk")), lambda e: e["item"])
    after = pieces.select("case_id", "chunk").join(lasts, "case_id").select("case_id", "chunk", later.alias("later"))
    chunks = materialise(pieces.join(after, ["case_id", "chunk"]))
    return chunks, firsts, pieces.groupBy("case_id").agg(F.min("chunk").alias("chunk"))


def frequent_subsequences(events: DataFrame, min_share: float = 0.03, min_cases: int = 5, shortest: int = 3, longest: int = 5, chunk: int = 4096, block: int = 4_000_000) -> DataFrame:
    """Patterns of ``shortest`` to ``longest`` activities that occur in order, gaps allowed, in enough cases.

    ``events`` has ``case_id, activity, ts_us, ord`` without nulls. A pattern is
    frequent if it occurs in at least ``min_share`` of the cases and in at least
    ``min_cases``. Returns ``pattern_text`` (joined with ``>``) and ``n_cases``.

    Last-position induction: the state of a frequent prefix in a case is the
    end of its leftmost occurrence; an item extends it there exactly if the
    item's last position in the case is beyond that end. Supports of all
    extensions are so counted without looking at the sequence and summed inside
    each task before a small shuffle; only frequent extensions are moved to
    their next position by binary search. Prefixes grow level by level.

    Events are put in order over range partitions of like size, and cases
    become chunks of at most ``chunk`` events there, without a shuffle. States
    stay beside the chunk of their end, so that a case of one chunk is never
    moved again and a case with a third of all rows is spread over many tasks;
    an item first met in a later chunk is found by an as-of lookup. Frequent
    patterns are broadcast in blocks of at most ``block`` (32 MB), with one pass
    over the states for each.

    Defined cases: an empty input gives no rows; ties in time are ordered by
    ``ord``; a pattern may repeat an activity; extra columns are not read.
    """
    if not 0 < chunk <= FAR // 2:
        raise ValueError(f"chunk must be from 1 to {FAR // 2}")
    spark = events.sparkSession
    nothing = spark.createDataFrame([], "pattern_text string, n_cases long")
    ordered = in_order(events.select("case_id", "activity", "ts_us", "ord"), "case_id", "ts_us", "ord")
    before, n_cases = before_parts(ordered)
    least = max(min_cases, math.ceil(n_cases * min_share - 1e-9))
    # Items of patterns must be frequent themselves: at most (distinct activities per case) / min_share of them.
    items = [r["activity"] for r in ordered.select("case_id", "activity").distinct().groupBy("activity").count().where(F.col("count") >= least).orderBy("activity").collect()]
    n_items = len(items)
    if not n_items:
        return nothing
    if (n_items + 1) ** longest >= 2**62:
        raise ValueError(f"{n_items} frequent activities do not fit patterns of {longest} steps into a 64-bit code")
    chunks = materialise(ordered.select("case_id", "activity").mapInArrow(_chunker(before, items, chunk), CHUNK))
    empty, start = F.array().cast("array<int>"), [F.array(F.lit(0).cast("long")).alias("codes"), F.array(F.lit(-1)).alias("ends")]
    states = chunks.where("whole").select("*", empty.alias("later"), *start)
    pieces, firsts, heads = None, None, None
    if chunks.where("not whole").take(1):
        pieces, firsts, heads = _in_pieces(chunks.where("not whole"))
        states = states.unionByName(pieces.join(heads.select("*", *start), ["case_id", "chunk"]).repartition("case_id", "chunk").select(states.columns))
    found = None
    for length in range(1, longest + 1):
        if length == 1:
            blocks = [np.arange(1, n_items + 1)]
        else:
            counts = states.mapInArrow(_counter(n_items), "code long, n long").groupBy("code").agg(F.sum("n").alias("n_cases")).where(F.col("n_cases") >= least)
            level = materialise(counts.withColumn("length", F.lit(length)))
            if length >= shortest:
                found = level if found is None else found.unionByName(level)
            n_blocks = math.ceil(level.count() / block)
            blocks = (np.array([r["code"] for r in level.where(F.pmod(F.xxhash64("code"), F.lit(n_blocks)) == b).select("code").orderBy("code").collect()], dtype=np.int64) for b in range(n_blocks))
        if length == longest:
            break
        moved = None
        for codes in filter(len, blocks):
            part = states.mapInArrow(_mover(n_items, spark.sparkContext.broadcast(codes)), MOVED)
            moved = part if moved is None else moved.unionByName(part)
        if moved is None:
            break
        moved = materialise(moved)
        states = moved.where("whole").select(states.columns)
        if pieces is not None:
            ours = moved.where("not whole")
            stayed = ours.where("size(codes) > 0").select("case_id", "chunk", "codes", "ends")
            # Gathered anew, so that partitions of a few rows do not add up from level to level.
            gathered = stayed.unionByName(_found_later(ours, firsts)).repartition("case_id", "chunk")
            states = states.unionByName(pieces.join(gathered, ["case_id", "chunk"]).select(states.columns))
    if found is None:
        return nothing
    named = F.array(*[F.lit(a) for a in items])
    steps = [F.when(F.col("length") > back, F.get(named, F.expr(f"cast((code div {(n_items + 1) ** back}) % {n_items + 1} - 1 as int)"))) for back in reversed(range(longest))]
    return found.select(F.concat_ws(">", *steps).alias("pattern_text"), "n_cases")
