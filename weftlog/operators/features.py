"""One wide feature row per entity from its events, by bit-sliced counters over entity ordinals."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.functions.columns import ACTIVITY, CASE, LIFECYCLE, ORD, TIME, col, first_of_repeats, micros
from weftlog.functions.ordered import before_parts, in_order

SLOTS = 1 << 19  # places for an entity and a type that share one set of bitmaps


def _kept(log: DataFrame, transition: str) -> DataFrame:
    return log.where((col(LIFECYCLE) == transition) & col(CASE).isNotNull() & col(ACTIVITY).isNotNull() & col(TIME).isNotNull())


def case_sequences(log: DataFrame, transition: str = "complete") -> DataFrame:
    """The events that form the activity sequences of cases: ``case_id, activity, ts_us, ord``.

    Rows with the given transition and non-null case, activity and time; rows
    equal in all but the ordinal count once, with the smallest.
    """
    once = first_of_repeats(_kept(log, transition))
    return once.select(col(CASE).alias("case_id"), col(ACTIVITY).alias("activity"), micros(once, TIME).alias("ts_us"), col(ORD).alias("ord"))


Bitmap = tuple[np.ndarray, np.ndarray]  # numbers of the words that are not zero, ascending, and those words
NOTHING: Bitmap = (np.empty(0, np.int64), np.empty(0, np.uint64))


def bitmap(places: np.ndarray) -> Bitmap:
    """The compressed bitmap of ascending, distinct places: only words of 64 that hold a place are kept."""
    if not len(places):
        return NOTHING
    number = places >> 6
    cut = np.flatnonzero(np.diff(number, prepend=-1))
    return number[cut], np.bitwise_or.reduceat(np.uint64(1) << (places & 63).astype(np.uint64), cut)


def places_of(b: Bitmap) -> np.ndarray:
    """The ascending places of a compressed bitmap."""
    word, bit = np.nonzero(np.unpackbits(b[1].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return b[0][word] * 64 + bit


def both(a: Bitmap, b: Bitmap) -> Bitmap:
    """Places in both bitmaps."""
    if not len(a[0]) or not len(b[0]):
        return NOTHING
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    words = np.where(b[0][at] == a[0], a[1] & b[1][at], np.uint64(0))
    kept = words != 0
    return a[0][kept], words[kept]


def either(a: Bitmap, b: Bitmap) -> Bitmap:
    """Places in exactly one of two bitmaps."""
    if not len(a[0]) or not len(b[0]):
        return a if len(a[0]) else b
    number, words = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(number, kind="stable")
    number, words = number[order], words[order]
    cut = np.flatnonzero(np.diff(number, prepend=-1))
    words = np.bitwise_xor.reduceat(words, cut)
    kept = words != 0
    return number[cut][kept], words[kept]


class SlicedCounters:
    """Numbers at many places, kept as one compressed bitmap per binary digit.

    Adding numbers adds their bitmaps digit by digit; the carry is a bitmap
    too (the places in both, or in the carry and one of them), so one step adds
    a digit at all places at once, without unpacking a word.
    """

    def __init__(self, planes: list[Bitmap] | None = None):
        self.planes = planes or []

    def add_planes(self, other: list[Bitmap]) -> None:
        carry = NOTHING
        for i in range(max(len(other), len(self.planes)) + 1):
            b = other[i] if i < len(other) else NOTHING
            if i >= len(self.planes):
                if i >= len(other) and not len(carry[0]):
                    return
                self.planes.append(NOTHING)
            a = self.planes[i]
            half = either(a, b)
            self.planes[i], carry = either(half, carry), either(both(a, b), both(carry, half))

    def add(self, places: np.ndarray, numbers: np.ndarray) -> None:
        """Add non-negative numbers at ascending, distinct places."""
        top = int(numbers.max()).bit_length() if len(numbers) else 0
        self.add_planes([bitmap(places[(numbers >> np.int64(d)) & 1 == 1]) for d in range(top)])

    def at(self, places: np.ndarray) -> np.ndarray:
        """The numbers at ascending places, which are all that may hold one."""
        out = np.zeros(len(places), dtype=np.int64)
        for d, plane in enumerate(self.planes):
            out[np.searchsorted(places, places_of(plane))] += np.int64(1) << np.int64(d)
        return out

    def pack(self) -> bytes:
        sizes = np.array([len(self.planes), *[len(p[0]) for p in self.planes]], dtype=np.int64)
        return zlib.compress(b"".join([sizes.tobytes(), *[p[0].tobytes() + p[1].tobytes() for p in self.planes]]), 1)

    @classmethod
    def unpack(cls, data: bytes) -> SlicedCounters:
        raw = np.frombuffer(zlib.decompress(data), dtype=np.int64)
        lo, planes = 1 + int(raw[0]), []
        for size in raw[1 : 1 + int(raw[0])]:
            planes.append((raw[lo : lo + size], raw[lo + size : lo + 2 * size].view(np.uint64)))
            lo += 2 * int(size)
        return cls(planes)


class Cells:
    """Counters, totals and latest times of a block of entities under all types.

    Place ``type * width + i`` is that of type and i-th entity of the block.
    Latest times are aligned with the ascending places in use.
    """

    def __init__(self):
        self.count, self.total = SlicedCounters(), SlicedCounters()
        self.used, self.latest = np.empty(0, np.int64), np.empty(0, np.int64)

    def _later(self, places: np.ndarray, times: np.ndarray) -> None:
        every, when = np.concatenate([self.used, places]), np.concatenate([self.latest, times])
        order = np.argsort(every, kind="stable")
        cut = np.flatnonzero(np.diff(every[order], prepend=-1))
        self.used, self.latest = every[order][cut], np.maximum.reduceat(when[order], cut)

    def absorb(self, places: np.ndarray, times: np.ndarray, waits: np.ndarray) -> None:
        """Add a batch of events; what it has of one place is summed first, so a hot entity costs no more carries."""
        order = np.argsort(places, kind="stable")
        cut = np.flatnonzero(np.diff(places[order], prepend=-1))
        at = places[order][cut]
        self.count.add(at, np.diff(cut, append=len(places)))
        self.total.add(at, np.add.reduceat(waits[order], cut))
        self._later(at, np.maximum.reduceat(times[order], cut))

    def pack(self) -> dict[str, bytes]:
        return {"counts": self.count.pack(), "totals": self.total.pack(), "used": zlib.compress(self.used.tobytes(), 1), "latest": zlib.compress(self.latest.tobytes(), 1)}

    def merge(self, row: dict[str, bytes]) -> None:
        """Carry-add another task's share of the block."""
        self.count.add_planes(SlicedCounters.unpack(row["counts"]).planes)
        self.total.add_planes(SlicedCounters.unpack(row["totals"]).planes)
        self._later(*[np.frombuffer(zlib.decompress(row[c]), dtype=np.int64) for c in ("used", "latest")])


SHARE = "block long, first long, names array<string>, counts binary, totals binary, used binary, latest binary"


def _sharer(before: dict[int, tuple[int, str | None, int | None]], width: int):
    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bit-sliced shares of a task, whose events come in order: one block of entities is open at a time."""
        cases, last, last_us = before.get(TaskContext.get().partitionId(), (0, None, None))
        ordinal, block, first, names, cells = cases - 1, None, None, [], None

        def closed() -> pa.RecordBatch:
            row = {"block": block, "first": first, "names": names, **cells.pack()}
            return pa.RecordBatch.from_pydict({k: pa.array([v], pa.list_(pa.string()) if k == "names" else pa.int64() if k in ("block", "first") else pa.binary()) for k, v in row.items()})

        for batch in batches:
            if not batch.num_rows:
                continue
            case, kind, times = batch.column(0), *[batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2)]
            fresh = np.r_[case[0].as_py() != last, pc.not_equal(case.slice(1), case.slice(0, len(case) - 1)).to_numpy(zero_copy_only=False)].astype(bool)
            ordinals = ordinal + np.cumsum(fresh)
            earlier = np.r_[0 if last_us is None else last_us, times[:-1]]
            waits = np.where(fresh, 0, times - earlier)
            ordinal, last, last_us = int(ordinals[-1]), case[-1].as_py(), int(times[-1])
            blocks = ordinals // width
            cut = np.flatnonzero(np.diff(blocks, prepend=-1))
            for lo, hi in zip(cut, np.r_[cut[1:], len(blocks)]):
                if block != blocks[lo]:
                    if cells is not None:
                        yield closed()
                    block, first, names, cells = int(blocks[lo]), int(ordinals[lo]), [case[int(lo)].as_py()], Cells()
                    fresh[lo] = False
                names += case.slice(lo, hi - lo).filter(pa.array(fresh[lo:hi])).to_pylist()
                cells.absorb(kind[lo:hi] * width + ordinals[lo:hi] % width, times[lo:hi], waits[lo:hi])
        if cells is not None:
            yield closed()

    return share


def _gathered(key: tuple, group: pd.DataFrame, width: int):
    """A whole block: names of its entities, and entity, type, count, total, recency of its filled cells, by entity and type."""
    cells, names = Cells(), np.empty(width, dtype=object)
    for row in group.to_dict("records"):
        cells.merge(row)
        lo = int(row["first"]) - int(key[0]) * width
        names[lo : lo + len(row["names"])] = row["names"]
    count, total = cells.count.at(cells.used), cells.total.at(cells.used)
    kind, place = np.divmod(cells.used, width)
    order = np.lexsort((kind, place))
    kind, place, latest = kind[order], place[order], cells.latest[order]
    cut = np.flatnonzero(np.diff(place, prepend=-1))
    ends = np.repeat(np.maximum.reduceat(latest, cut), np.diff(cut, append=len(place)))
    return names, place, kind, count[order], total[order], ends - latest


def _lister(width: int, types: list[str]):
    named = np.array(types, dtype=object)

    def decode(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        names, place, kind, count, total, recency = _gathered(key, group, width)
        return pd.DataFrame({"case_id": names[place], "act_name": named[kind], "n_events": count, "recency_us": recency, "total_us": total})

    return decode


def _widener(width: int, n_types: int):
    def decode(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        names, place, kind, count, total, recency = _gathered(key, group, width)
        used, row = np.unique(place, return_inverse=True)
        n, summed, since = np.zeros((len(used), n_types), np.int64), np.zeros((len(used), n_types), np.int64), np.full((len(used), n_types), -1, np.int64)
        n[row, kind], summed[row, kind], since[row, kind] = count, total, recency
        return pd.DataFrame({"case_id": names[used], "n_events": list(n), "recency_us": list(since), "total_us": list(summed)})

    return decode


def _shares(log: DataFrame) -> tuple[DataFrame, int, list[str]]:
    """Bit-sliced shares of blocks of cases, the number of cases in a block, and the activities in order."""
    sequences = case_sequences(log)
    # Activities of the log itself, read before repeats are dropped; a wide row has all of them, so they fit the driver.
    types = [r[0] for r in _kept(log, "complete").select(col(ACTIVITY)).distinct().orderBy(col(ACTIVITY)).collect()]
    type_ids = log.sparkSession.createDataFrame(list(enumerate(types)), "type_id int, activity string")
    ordered = in_order(sequences.join(type_ids, "activity").select("case_id", "type_id", "ts_us", "ord"), "case_id", "ts_us", "ord")
    width = max(1, min(2048, SLOTS // max(1, len(types))))
    return ordered.select("case_id", "type_id", "ts_us").mapInArrow(_sharer(before_parts(ordered)[0], width), SHARE), width, types


def entity_features(log: DataFrame) -> tuple[DataFrame, list[str]]:
    """One wide row per case: ``case_id, n_events, recency_us, total_us``, arrays aligned with the returned activity list.

    ``n_events[i]`` counts the case's complete events of activity ``i``;
    ``recency_us[i]`` is the time from its last one to the case's last event
    (null where it has none); ``total_us[i]`` sums the time since the preceding
    event of the case (0 for its first).

    Events are put in order of case and time over range partitions of like
    size, so a case with a third of all rows is spread like any other. Cases
    are numbered along that order, and every task turns its events into
    bit-sliced counters and totals (compressed bitmaps over the ordinals of a
    block, one per binary digit and activity), one block open at a time. Blocks
    are shuffled compressed; where tasks share one, their counters are
    carry-added, then decoded with latest times aligned to the ordinals. A
    block holds about ``SLOTS`` cells, so memory is bounded for any number of
    cases and activities.

    Defined cases: rows with a null case, activity or time are not events;
    repeated rows count once; ties in time are ordered by the ordinal; an empty
    log gives no rows; extra columns only tell repeated rows apart.
    """
    shares, width, types = _shares(log)
    wide = shares.groupBy("block").applyInPandas(_widener(width, len(types)), "case_id string, n_events array<long>, recency_us array<long>, total_us array<long>")
    return wide.withColumn("recency_us", F.transform("recency_us", lambda x: F.when(x >= 0, x))), types


def feature_cells(log: DataFrame) -> DataFrame:
    """The filled cells of :func:`entity_features`, decoded without the empty ones: ``case_id, act_name, n_events, recency_us, total_us``."""
    shares, width, types = _shares(log)
    return shares.groupBy("block").applyInPandas(_lister(width, types), "case_id string, act_name string, n_events long, recency_us long, total_us long")
