"""Reading and writing XES event logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.functions.columns import ORD

# The element names of typed XES attributes.
ATTRIBUTES = ("string", "date", "int", "float", "boolean", "id")
TIMES = ("time:timestamp", "start_timestamp")


def _attributes() -> str:
    one = "array<struct<_key: string, _value: string>>"
    return ", ".join(f"`{a}`: {one}" for a in ATTRIBUTES)


def _schema() -> str:
    inside = _attributes()
    return f"{inside.replace('`: ', '` ')}, event array<struct<{inside}>>"


def _pairs(row: Column | None) -> Column:
    """All attributes of an element as one array of key and value."""
    lists = [F.coalesce(row[a] if row is not None else F.col(f"`{a}`"), F.array().cast("array<struct<_key: string, _value: string>>")) for a in ATTRIBUTES]
    return F.concat(*lists)


def read_xes(spark: SparkSession, path: str, case_attributes: tuple[str, ...] = ("concept:name",), event_attributes: tuple[str, ...] = ("concept:name", "lifecycle:transition", "time:timestamp", "concept:instance", "start_timestamp")) -> DataFrame:
    """The events of XES files, one row each.

    Trace attributes become columns with the prefix ``case:``; those named
    times become timestamps in UTC without zone. ``event_ord`` numbers the
    events of a partition in the order of files, traces and places; it is
    unique whatever the lengths of traces and the number of partitions, and
    increases along each trace. Files are split by the XML source at ``trace``
    elements. Attributes that an event lacks are null.
    """
    traces = spark.read.format("xml").option("rowTag", "trace").schema(_schema()).load(path)
    events = traces.select(_pairs(None).alias("outer"), F.explode("event").alias("e")).withColumn("ord", F.monotonically_increasing_id())

    def value(pairs: Column, key: str) -> Column:
        text = F.get(F.filter(pairs, lambda p: p["_key"] == key), F.lit(0))["_value"]
        if key not in TIMES:
            return text
        return F.timestamp_micros(F.unix_micros(text.try_cast("timestamp"))).cast("timestamp_ntz")

    return events.select(
        F.col("ord").alias(ORD),
        *[value(F.col("outer"), k).alias(f"case:{k}") for k in case_attributes],
        *[value(_pairs(F.col("e")), k).alias(k) for k in event_attributes],
    )


def _document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of one part, as a document of its own."""
    yield pa.RecordBatch.from_pydict({"value": ['<?xml version="1.0" encoding="UTF-8"?>', '<log xes.version="1.0" xes.features="nested-attributes">']})
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string())], names=["value"])
    yield pa.RecordBatch.from_pydict({"value": ["</log>"]})


def write_xes(log: DataFrame, path: str, case: str = "case:concept:name", ordinal: str = ORD) -> None:
    """Write a log as XES files, one document per partition, a case never split over documents.

    The events of a case are ordered by ``ordinal``; rows without a case are
    left out; nulls are attributes that an event lacks.
    """
    columns = [c for c in log.columns if c not in (case, ordinal)]
    kinds = {"timestamp": "date", "timestamp_ntz": "date", "bigint": "int", "int": "int", "double": "float", "boolean": "boolean"}
    types = dict(log.dtypes)

    def escaped(text: Column) -> Column:
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(raw), F.lit(safe))
        return text

    def attribute(name: str) -> Column:
        c = F.col(f"`{name}`")
        text = F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")) if types[name].startswith("timestamp") else c.cast("string")
        return F.when(c.isNotNull(), F.concat(F.lit(f'<{kinds.get(types[name], "string")} key="{name}" value="'), escaped(text), F.lit('"/>')))

    event = F.concat(F.lit("<event>"), F.concat_ws("", *[attribute(c) for c in columns]), F.lit("</event>"))
    rows = log.where(F.col(f"`{case}`").isNotNull()).select(F.col(f"`{case}`").alias("c"), F.struct(F.col(f"`{ordinal}`").alias("o"), event.alias("x")).alias("e"))
    traces = rows.groupBy("c").agg(F.array_sort(F.collect_list("e")).alias("e"))
    text = F.concat(F.lit('<trace><string key="concept:name" value="'), escaped(F.col("c").cast("string")), F.lit('"/>'), F.array_join(F.col("e.x"), ""), F.lit("</trace>"))
    traces.select(text.alias("value")).mapInArrow(_document, "value string").write.mode("error").text(path)
