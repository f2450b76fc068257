"""Ground distances between traces, as columns, and the cost matrices of variants."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.functions.columns import spread

BLOCK = 256
MOST_SYMBOLS = 0x110000 - 0x4E00 - 0x800  # characters from CJK on, surrogates left out


def _symbol(index: Column) -> Column:
    """One character per index: printable ASCII first, then all from CJK on that are no surrogates."""
    code = F.when(index < 90, index + 33).when(index + 0x4E00 < 0xD800, index + 0x4E00).otherwise(index + 0x4E00 + 0x800)
    checked = F.when(index < MOST_SYMBOLS, code.cast("long")).otherwise(F.raise_error(F.lit(f"more than {MOST_SYMBOLS} activities in one comparison")).cast("long"))
    return F.decode(F.unhex(F.lpad(F.hex(checked), 8, "0")), "UTF-32")


def encoded(vs: DataFrame) -> DataFrame:
    """Variants with ``word``: their activities as characters, numbered inside the pair. Null steps are blanks."""
    steps = vs.select("pair_id", F.explode("trace").alias("a")).where("a is not null").distinct()
    numbered = steps.withColumn("i", F.row_number().over(Window.partitionBy("pair_id").orderBy("a")) - 1)
    codes = numbered.groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct("a", _symbol(F.col("i"))))).alias("codes"))
    word = F.array_join(F.transform("trace", lambda a: F.coalesce(F.element_at("codes", a), F.lit(" "))), "")
    return vs.join(codes, "pair_id", "left").withColumn("word", F.coalesce(word, F.lit(""))).drop("codes")


def levenshtein(a: Column, b: Column) -> Column:
    """Unit-cost edit distance of two encoded variants."""
    return F.levenshtein(a["word"], b["word"]).cast("double")


def postnormalised(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; 0 for two empty traces."""
    longer = F.greatest(F.size(a["trace"]), F.size(b["trace"]))
    return F.when(longer > 0, levenshtein(a, b) / longer).otherwise(F.lit(0.0))


def discrete(a: Column, b: Column) -> Column:
    """0 for equal variants, 1 for others."""
    return F.when(a["variant_id"] == b["variant_id"], 0.0).otherwise(1.0)


def line(a: Column, b: Column) -> Column:
    """Difference of the lengths."""
    return F.abs(F.size(a["trace"]) - F.size(b["trace"])).cast("double")


def weighted_levenshtein(a: Column, b: Column, rename: float = 1.0, insert: float = 1.0, time_match: Callable[[Column, Column], Column] | None = None, time_insert: Callable[[Column], Column] | None = None) -> Column:
    """Edit distance of ``array<struct<activity, bin>>`` with costs for activities and bins.

    Inserting or deleting an event costs ``insert`` plus ``time_insert`` of its
    bin; replacing one costs ``rename`` unless the activities are equal, plus
    ``time_match`` of the bins. A fold over the rows of the edit table.
    """
    time_match = time_match or (lambda x, y: F.abs(x - y))
    time_insert = time_insert or (lambda x: x)

    def alone(e: Column) -> Column:
        return F.lit(float(insert)) + time_insert(e["bin"]).cast("double")

    def replaced(x: Column, y: Column) -> Column:
        return F.when(x["activity"].eqNullSafe(y["activity"]), 0.0).otherwise(float(rename)) + time_match(x["bin"], y["bin"]).cast("double")

    first = F.aggregate(b, F.array(F.lit(0.0)), lambda row, y: F.concat(row, F.array(F.element_at(row, -1) + alone(y))))
    columns = F.transform(b, lambda y, j: F.struct(y.alias("y"), j.alias("j")))

    def next_row(above: Column, x: Column) -> Column:
        def step(row: Column, cell: Column) -> Column:
            return F.concat(row, F.array(F.least(F.get(above, cell["j"] + 1) + alone(x), F.element_at(row, -1) + alone(cell["y"]), F.get(above, cell["j"]) + replaced(x, cell["y"]))))

        return F.aggregate(columns, F.array(F.get(above, F.lit(0)) + alone(x)), step)

    return F.element_at(F.aggregate(a, first, next_row), -1)


def postnormalised_weighted(bins: int | Column | None = None) -> Callable[[Column, Column], Column]:
    """Weighted edit distance over the longer length.

    Without ``bins`` time costs are the bins' difference and the bin itself, so
    the result may exceed 1; with the number of bins they are divided by
    ``max(bins - 1, 1)`` and the whole by 2, which keeps it within 1.
    """

    def cost(a: Column, b: Column) -> Column:
        longer = F.greatest(F.size(a["trace"]), F.size(b["trace"]))
        if bins is None:
            whole = weighted_levenshtein(a["trace"], b["trace"])
            return F.when(longer > 0, whole / longer).otherwise(F.lit(0.0))
        scale = F.greatest((F.lit(bins) if isinstance(bins, int) else bins) - 1, F.lit(1)).cast("double")
        whole = weighted_levenshtein(a["trace"], b["trace"], time_match=lambda x, y: F.abs(x - y) / scale, time_insert=lambda x: x / scale)
        return F.when(longer > 0, whole / longer / 2).otherwise(F.lit(0.0))

    return cost


def _pairs(vs: DataFrame) -> DataFrame:
    """Pairs of variants a and b of every comparison with a.variant_id <= b.variant_id, spread over blocks of columns."""
    tops = vs.groupBy("pair_id").agg(F.max("variant_id").alias("_top"))
    packed = vs.join(tops, "pair_id").select("pair_id", F.struct(*[F.col(c) for c in vs.columns]).alias("v"), F.floor(F.col("variant_id") / BLOCK).alias("block"), F.floor(F.col("_top") / BLOCK).alias("last_block"))
    left = packed.select("pair_id", F.col("v").alias("a"), F.explode(F.sequence("block", "last_block")).alias("block"))
    right = packed.select("pair_id", F.col("v").alias("b"), "block")
    joined = spread(left, "pair_id", "block").join(spread(right, "pair_id", "block"), ["pair_id", "block"])
    return joined.where(F.col("a.variant_id") <= F.col("b.variant_id"))


def cost_matrix(vs: DataFrame, cost: Callable[[Column, Column], Column], symmetric: bool = True) -> DataFrame:
    """Distances between the variants of every pair: ``pair_id, i, j, cost``, for i <= j if ``symmetric``, else for all.

    ``cost`` takes two struct columns with the columns of ``vs``. The matrix is
    formed over distinct variants only, any number of them, and the rows of a
    large comparison are spread over blocks of columns.
    """
    a, b = F.col("a"), F.col("b")
    one = F.struct(a["variant_id"].alias("i"), b["variant_id"].alias("j"), cost(a, b).alias("cost"))
    if symmetric:
        return _pairs(vs).select("pair_id", one.alias("c")).select("pair_id", "c.*")
    other = F.struct(b["variant_id"].alias("i"), a["variant_id"].alias("j"), cost(b, a).alias("cost"))
    return _pairs(vs).select("pair_id", F.inline(F.when(a["variant_id"] == b["variant_id"], F.array(one)).otherwise(F.array(one, other))))


def cross_matrix(vs: DataFrame, cost: Callable[[Column, Column], Column]) -> DataFrame:
    """Distances from the variants of each pair's first log to those of its second: ``pair_id, i, j, cost``.

    ``cost`` need not be symmetric; ``i`` is a variant of side 1, ``j`` one of side 2.
    """
    a, b = F.col("a"), F.col("b")

    def arc(x: Column, y: Column) -> Column:
        return F.when((x["c1"] > 0) & (y["c2"] > 0), F.struct(x["variant_id"].alias("i"), y["variant_id"].alias("j"), cost(x, y).alias("cost")))

    arcs = F.array_compact(F.array(arc(a, b), F.when(a["variant_id"] != b["variant_id"], arc(b, a))))
    return _pairs(vs).select("pair_id", F.inline(arcs))


def edit_tables(codes_a: np.ndarray, bins_a: np.ndarray, size_a: np.ndarray, codes_b: np.ndarray, bins_b: np.ndarray, size_b: np.ndarray, scale: float) -> np.ndarray:
    """Weighted edit distances of many pairs of padded sequences, cell by cell of the edit table for all pairs at once."""
    # Costs are whole multiples of 1 / scale; the pairs are the last axis.
    whole = round(scale) == scale and max(bins_a.max(initial=0), bins_b.max(initial=0)) + scale < 1 << 20 and codes_a.shape[1] + codes_b.shape[1] < 512
    kind, unit = (np.int32, int(scale)) if whole else (float, 1)
    by = 1 if whole else scale
    (codes_a, codes_b), (bins_a, bins_b) = ((np.ascontiguousarray(x.T) for x in own) for own in ((codes_a, codes_b), (bins_a, bins_b)))
    bins_a, bins_b = (x.astype(kind) / by if by != 1 else x.astype(kind) for x in (bins_a, bins_b))
    n, every = len(size_a), np.arange(len(size_a))
    above = np.zeros((len(codes_b) + 1, n), kind)
    np.cumsum(bins_b + kind(unit), axis=0, out=above[1:])
    out = above[size_b, every]
    row, swap, other = np.empty_like(above), np.empty_like(bins_b), np.empty_like(bins_b)
    for i in range(len(codes_a)):
        alone = bins_a[i] + kind(unit)
        np.add(above[0], alone, out=row[0])
        np.abs(np.subtract(bins_b, bins_a[i], out=swap), out=swap)
        swap += np.multiply(codes_b != codes_a[i], kind(unit), out=other)
        swap += above[:-1]
        np.minimum(swap, np.add(above[1:], alone, out=other), out=swap)
        for j in range(len(codes_b)):
            np.add(row[j], bins_b[j], out=row[j + 1])
            row[j + 1] += kind(unit)
            np.minimum(row[j + 1], swap[j], out=row[j + 1])
        above, row = row, above
        ends = np.flatnonzero(size_a == i + 1)
        out[ends] = above[size_b[ends], ends]
    return out / unit if whole else out


def _padded(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))), dtype=values.dtype)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _weighted_batches(bins: int | None):
    scale, half = (float(max(bins - 1, 1)), 2.0) if bins is not None else (1.0, 1.0)

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = [batch.column(k) for k in (3, 4, 5, 6)]
            sizes = [pc.list_value_length(lists[k]).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2)]
            names = pa.chunked_array([lists[0].flatten(), lists[2].flatten()]).combine_chunks()
            codes = pc.fill_null(names.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            numbers = [lists[k].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 3)]
            cut = len(numbers[0])
            whole = edit_tables(_padded(codes[:cut], sizes[0]), _padded(numbers[0], sizes[0]), sizes[0], _padded(codes[cut:], sizes[1]), _padded(numbers[1], sizes[1]), sizes[1], scale)
            cost = whole / np.maximum(np.maximum(*sizes), 1) / half
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cost)], names=["pair_id", "i", "j", "cost"])

    return costs


def weighted_matrix(vs: DataFrame, bins: int | None = None) -> DataFrame:
    """The matrix of :func:`postnormalised_weighted`, computed for whole Arrow batches of pairs.

    Same result as :func:`cost_matrix` with that column, several times faster.
    """
    fields = [F.col(f"{side}.trace.{name}").alias(f"{side}_{name}") for side in ("a", "b") for name in ("activity", "bin")]
    flat = _pairs(vs).select("pair_id", F.col("a.variant_id").alias("i"), F.col("b.variant_id").alias("j"), *fields)
    return flat.mapInArrow(_weighted_batches(bins), "pair_id long, i int, j int, cost double")
