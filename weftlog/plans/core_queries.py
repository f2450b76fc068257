"""Queries of the core operators. Each takes (spark, folder) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.functions.checkpoints import materialise, stored
from weftlog.functions.columns import ACTIVITY, CASE, INSTANCE, LIFECYCLE, ORD, START, TIME, col, micros, table
from weftlog.operators import binning, compare, distance, extract, prepare, resample
from weftlog.operators.features import entity_features, feature_cells
from weftlog.operators.intervals import busy_spans
from weftlog.operators.language import log_pairs, paired_population, stochastic_language, variants
from weftlog.operators.timestamps import estimate_zones, normalise_timestamps, read_values

SEED = 42
REPLICATES = 1000
TIMED_REPLICATES = 100
DEFAULT_REPLICATES = 10_000  # of the public comparators
JOINED_ROWS = 9_000_000  # lines that are joined to their orders at once
MOST_SHARES = 32  # times that the tables are read for it


# -- inputs ------------------------------------------------------------------


def small_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of the many small logs of ``trace_steps``: ``log_number, case_id, trace``.

    Rows with nulls are left out, repeated rows count once.
    """
    steps = table(spark, sf_dir, "trace_steps").select("log_id", col(CASE).alias("case_id"), "step_no", col(ACTIVITY).alias("activity")).dropna().distinct()
    traces = steps.groupBy("log_id", "case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step_no", "activity"))), lambda e: e["activity"]).alias("trace"))
    return traces.select(F.regexp_extract("log_id", "([0-9]+)$", 1).try_cast("long").alias("log_number"), "case_id", "trace")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases of an interval log, customers as logs: lines by flag and status, from order to shipment."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate", "l_quantity")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("log_number"),
        F.col("l_orderkey").alias(CASE),
        F.concat("l_returnflag", "l_linestatus").alias(ACTIVITY),
        F.col("o_orderdate").alias(START),
        F.col("l_shipdate").alias(TIME),
        F.col("l_quantity").alias("quantity"),
        F.col("l_linenumber").alias(ORD),
    )


def _with_log(traces: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("log_number")), "case_id")


def delivery_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_log(extract.extract_traces(deliveries(spark, sf_dir)), spark, sf_dir)


def _shipments(orders: DataFrame, lines: DataFrame, value: str) -> DataFrame:
    """A row for each order with lines: ``case_id``, activities and numbers of its ``lines`` in the order of a trace and of its ``untimed`` lines, and its ``logs``."""
    # An order that is there more than once multiplies its lines, and its case is one of each of its logs.
    owners = orders.groupBy(F.col("o_orderkey").alias("case_id")).agg(F.collect_list(F.struct(F.col("o_custkey").alias("log_number"), micros(orders, "o_orderdate").alias("start"))).alias("owners"))
    shipped = F.struct(micros(lines, "l_shipdate").alias("t"), F.concat("l_returnflag", "l_linestatus").alias("activity"), F.col("l_linenumber").alias("o"), *([] if value == "duration" else [F.col(f"l_{value}").cast("double").alias("number")]))
    joined = lines.select(F.col("l_orderkey").alias("case_id"), shipped.alias("line")).join(owners, "case_id")
    grouped = joined.groupBy("case_id").agg(F.collect_list("line").alias("lines"), F.first("owners").alias("owners"))

    def line(e: Column, owner: Column) -> Column:
        # Lines in the order of a trace: by time, activity and number.
        number = (e["t"] - owner["start"]) / F.lit(1e6) if value == "duration" else e["number"]
        return F.struct(e["t"].alias("t"), e["activity"].alias("activity"), e["o"].alias("o"), number.alias("number"))

    every = F.flatten(F.transform("owners", lambda owner: F.transform("lines", lambda e: line(e, owner))))
    logs = F.transform("owners", lambda owner: F.struct(owner["log_number"].alias("log_number")))

    def valued(kept: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter("every", kept), lambda e: F.struct(e["activity"].alias("activity"), e["number"].alias("number")))

    ordered = grouped.select("case_id", F.sort_array(every).alias("every"), logs.alias("logs"))
    return ordered.select("case_id", valued(lambda e: e["t"].isNotNull()).alias("lines"), valued(lambda e: e["t"].isNull()).alias("untimed"), "logs")


def binned_delivery_traces(spark: SparkSession, sf_dir: str, value: str, fit: Callable[[DataFrame], DataFrame] = binning.fit_iqr) -> DataFrame:
    """Delivery traces with days to shipment or quantities in bins of their activity: ``case_id, trace, log_number``.

    Both tables are joined once, into a row for each order that is stored: bins are
    fitted and traces made from it, however often they are read. The orders of large
    tables are joined one share after another, which reads the tables again and
    leaves a share of them in shuffle files at a time.
    """
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    shares = max(1, min(MOST_SHARES, -(-lines.count() // JOINED_ROWS)))
    parts = [_shipments(*(t.where(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(shares)) == i) if shares > 1 else t for t, key in ((orders, "o_orderkey"), (lines, "l_orderkey"))), value) for i in range(shares)]
    cases = stored(*parts)
    model = materialise(fit(cases.select(F.inline(F.concat("lines", "untimed"))).select(F.col("activity").alias("label"), F.col("number").alias("value"))))
    # Activities are two letters each; one row has the bins of all.
    bins = model.agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct("kind", "edges")))).alias("bins"))

    def event(e: Column) -> Column:
        return F.struct(e["activity"].alias("activity"), binning.bin_column(e["number"], F.col("bins")[e["activity"]]["kind"], F.col("bins")[e["activity"]]["edges"]).alias("bin"))

    # Logs come first, so that a filter on them is applied before bins are looked up.
    traces = cases.where(F.size("lines") > 0).select("case_id", "lines", F.inline("logs")).join(F.broadcast(bins))
    return traces.select("case_id", F.transform("lines", event).cast("array<struct<activity: string, bin: int>>").alias("trace"), "log_number")


def timed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery traces with days to shipment in the default bins: three by k-means++ seeding."""
    return binned_delivery_traces(spark, sf_dir, "duration", lambda v: binning.fit_kmeans_seeds(v, 3, SEED))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "event_log").drop(START)


# -- sources, preparation ----------------------------------------------------


def q_log_len(spark, d):
    return prepare.log_len(table(spark, d, "event_log"))


def _pairs(log: DataFrame) -> DataFrame:
    return log.select(col(ORD).alias("event_ord"), micros(log, START).alias("start_us"))


def q_lifecycle_fifo(spark, d):
    return _pairs(prepare.lifecycle_to_interval(event_log(spark, d), instance=None))


def q_lifecycle_instance(spark, d):
    return _pairs(prepare.lifecycle_to_interval(event_log(spark, d), on_ambiguous="first"))


def q_infer_instances(spark, d):
    return prepare.infer_instances(event_log(spark, d)).select("event_ord", col(INSTANCE).alias("instance"))


def q_fold_instances(spark, d):
    return _pairs(prepare.fold_instances(event_log(spark, d), on_ambiguous="first"))


def q_strict_interval(spark, d):
    return _pairs(prepare.ensure_start(event_log(spark, d).drop(INSTANCE), strict=True))


def q_ensure_start(spark, d):
    return _pairs(prepare.ensure_start(event_log(spark, d), on_ambiguous="first"))


def q_atomic_to_lifecycle(spark, d):
    return prepare.atomic_to_lifecycle(table(spark, d, "atomic_log")).select("event_ord", col(LIFECYCLE).alias("lifecycle"), col(INSTANCE).alias("instance"))


def q_atomic_to_interval(spark, d):
    return _pairs(prepare.atomic_to_interval(table(spark, d, "atomic_log")))


def q_duration(spark, d):
    return prepare.add_duration(table(spark, d, "interval_log")).select("event_ord", col(prepare.DURATION).alias("duration_s"))


def q_waiting_time(spark, d):
    return prepare.add_waiting_time(table(spark, d, "interval_log")).select("event_ord", col(prepare.WAITING).alias("waiting_s"))


def _split(method):
    def query(spark, d):
        first, second = prepare.split_cases(table(spark, d, "event_log"), 0.5, SEED, method)
        parts = first.select(col(CASE).alias("case_id"), F.lit(1).alias("part")).unionByName(second.select(col(CASE).alias("case_id"), F.lit(2).alias("part")))
        return parts.groupBy("case_id", "part").agg(F.count(F.lit(1)).alias("n_rows"))

    return query


def q_sample_cases(spark, d):
    log = table(spark, d, "event_log")
    return prepare.sample_cases(log, 100, SEED).groupBy(col(CASE).alias("case_id")).agg(F.count(F.lit(1)).alias("n_rows"))


# -- extraction, binning, languages ------------------------------------------


def q_extract_traces(spark, d):
    return extract.extract_traces(table(spark, d, "event_log")).select("case_id", F.array_join("trace", ">", "?").alias("trace_text"))


def q_service_times(spark, d):
    log = table(spark, d, "interval_log")
    traces = extract.extract_service_times(log.where(col(START).isNotNull()))
    text = F.transform("trace", lambda e: F.concat_ws("=", F.coalesce(e["activity"], F.lit("?")), F.round(e["value"] * 1_000_000).cast("long").cast("string")))
    return traces.select("case_id", F.array_join(text, ">").alias("trace_text"))


def _bins(fit):
    def query(spark, d):
        events = table(spark, d, "events").select("event_id", F.col("event_type").alias("label"), "value")
        model = fit(events)
        return events.join(model, "label", "left").select("event_id", binning.bin_column(F.col("value")).alias("bin"))

    return query


def _binned_traces(value):
    def query(spark, d):
        text = F.transform("trace", lambda e: F.concat(e["activity"], e["bin"].cast("string")))
        return binned_delivery_traces(spark, d, value).select("case_id", F.array_join(text, ">").alias("trace_text"))

    return query


def _halves(values: list[float]) -> list[float]:
    """A user's binner: bounds at the least value and in the middle of the range."""
    return [min(values), (min(values) + max(values)) / 2]


def q_language(spark, d):
    logs = small_logs(spark, d).where("log_number is not null")
    return stochastic_language(logs, ["log_number"]).select("log_number", F.array_join("trace", ">").alias("trace_text"), "n", F.round("frequency", 9).alias("frequency"))


def q_language_deliveries(spark, d):
    return stochastic_language(delivery_traces(spark, d)).select(F.array_join("trace", ">").alias("trace_text"), "n", F.round("frequency", 9).alias("frequency"))


# -- distances ---------------------------------------------------------------


def _delivery_variants(spark, d) -> DataFrame:
    return variants(paired_population(delivery_traces(spark, d)))


def _matrix(cost):
    def query(spark, d):
        return distance.cost_matrix(distance.encoded(_delivery_variants(spark, d)), cost).withColumn("cost", F.round("cost", 9))

    return query


def q_cross_matrix(spark, d):
    return distance.cross_matrix(distance.encoded(_delivery_variants(spark, d)), distance.postnormalised).withColumn("cost", F.round("cost", 9))


def _weighted_matrix(bins):
    def query(spark, d):
        vs = variants(paired_population(binned_delivery_traces(spark, d, "duration")))
        return distance.weighted_matrix(vs, bins).withColumn("cost", F.round("cost", 9))

    return query


def _logs_emd(source, cost):
    def query(spark, d):
        vs = materialise(variants(paired_population(source(spark, d))))
        return compare.distances(resample.observed(vs), vs, cost).select("pair_id", F.round("emd", 9).alias("logs_emd"))

    return query


# -- tests -------------------------------------------------------------------


def _rounded(result: DataFrame) -> DataFrame:
    return result.select("pair_id", F.round("logs_emd", 9).alias("logs_emd"), F.round("pvalue", 9).alias("pvalue"), "n_replicates")


def _test(source, test, cost, n=REPLICATES):
    def query(spark, d):
        return _rounded(compare.run_test(log_pairs(source(spark, d)), test, cost, n, SEED, lone=True)[1])

    return query


def _null(source, test, cost, n=REPLICATES):
    def query(spark, d):
        return compare.run_test(log_pairs(source(spark, d)), test, cost, n, SEED, lone=True)[0].select("pair_id", "rep", F.round("emd", 9).alias("emd"))

    return query


def _binned_test(value, bins, n=TIMED_REPLICATES):
    def query(spark, d):
        pop = log_pairs(binned_delivery_traces(spark, d, value))
        return _rounded(compare.run_test(pop, "permutation", f"weighted:{bins}" if bins else "weighted", n, SEED, lone=True)[1])

    return query


def _double(style, cost, source=small_logs, n=REPLICATES):
    def query(spark, d):
        return _rounded(compare.run_double_test(log_pairs(source(spark, d)), style, cost, n, SEED, lone=True))

    return query


def _ks(style, cost, source=small_logs, n=REPLICATES):
    def query(spark, d):
        found = compare.run_ks_test(log_pairs(source(spark, d)), style, cost, n, SEED, lone=True)
        return found.select("pair_id", F.round("statistic", 9).alias("statistic"), F.round("pvalue", 9).alias("pvalue"))

    return query


def q_null_histogram(spark, d):
    null, _ = compare.run_test(paired_population(small_logs(spark, d)), "permutation", "line", REPLICATES, SEED)
    return compare.null_histogram(null, 10)


# -- general operators for training data -------------------------------------


def p1_found(spark, d):
    return normalise_timestamps(table(spark, d, "raw_log"), table(spark, d, "sites"))


def p1_zones(spark, d):
    sites = table(spark, d, "sites")
    return estimate_zones(read_values(table(spark, d, "raw_log"), sites), sites)


def p2_found(spark, d):
    return busy_spans(table(spark, d, "interval_log"))


def p4_found(spark, d):
    return feature_cells(table(spark, d, "event_log"))


def p4_wide(spark, d):
    return entity_features(table(spark, d, "event_log"))[0]


FLAGSHIP = _test(small_logs, "permutation", "levenshtein")

QUERIES = {
    "log_len": q_log_len,
    "lifecycle_fifo": q_lifecycle_fifo,
    "lifecycle_instance": q_lifecycle_instance,
    "infer_instances": q_infer_instances,
    "fold_instances": q_fold_instances,
    "strict_interval": q_strict_interval,
    "atomic_to_lifecycle": q_atomic_to_lifecycle,
    "atomic_to_interval": q_atomic_to_interval,
    "duration": q_duration,
    "waiting_time": q_waiting_time,
    "split_cases_event_biased": _split("event_biased"),
    "split_cases_uniform": _split("uniform"),
    "sample_cases": q_sample_cases,
    "extract_traces": q_extract_traces,
    "service_time_traces": q_service_times,
    "iqr_bins": _bins(binning.fit_iqr),
    "outer_percentile_bins": _bins(binning.fit_outer_percentiles),
    "kmeanspp_bins": _bins(lambda e: binning.fit_kmeans_seeds(e, 3, SEED, order="event_id")),
    "ensure_start": q_ensure_start,
    "custom_bins": _bins(lambda e: binning.fit_custom(e, _halves)),
    "binned_traces": _binned_traces("duration"),
    "binned_numeric_traces": _binned_traces("quantity"),
    "stochastic_language": q_language,
    "stochastic_language_deliveries": q_language_deliveries,
    "levenshtein_matrix": _matrix(distance.levenshtein),
    "postnorm_levenshtein_matrix": _matrix(distance.postnormalised),
    "cross_levenshtein_matrix": q_cross_matrix,
    "weighted_levenshtein_matrix": _weighted_matrix(None),
    "weighted_time_levenshtein_matrix": _weighted_matrix(3),
    "logs_emd_discrete": _logs_emd(delivery_traces, "discrete"),
    "logs_emd_line": _logs_emd(delivery_traces, "line"),
    "logs_emd_user_cost": _logs_emd(delivery_traces, distance.line),
    "logs_emd_levenshtein": _logs_emd(delivery_traces, "levenshtein"),
    "logs_emd_small_logs": _logs_emd(small_logs, "levenshtein"),
    "permutation_null_discrete": _null(small_logs, "permutation", "discrete"),
    "permutation_test_discrete": _test(small_logs, "permutation", "discrete"),
    "permutation_test_discrete_10000": _test(small_logs, "permutation", "discrete", 10_000),
    "permutation_test_line": _test(small_logs, "permutation", "line"),
    "permutation_test_user_cost": _test(small_logs, "permutation", distance.line),
    "bootstrap_replacement_user_cost": _test(small_logs, "replacement", distance.line),
    "bootstrap_split_user_cost": _test(small_logs, "split", distance.line),
    "double_bootstrap_user_cost": _double("smaller", distance.line),
    "ks_test_user_cost": _ks("replacement", distance.line),
    "bootstrap_resample_user_cost": _test(small_logs, "resample", distance.line),
    "classic_bootstrap_user_cost": _test(small_logs, "classic", distance.line),
    "permutation_test_control_flow": FLAGSHIP,
    "permutation_test_control_flow_10000": _test(small_logs, "permutation", "levenshtein", 10_000),
    "permutation_test_timed": _binned_test("duration", 3),
    "permutation_test_numeric": _binned_test("quantity", None),
    "permutation_test_timed_default": _test(timed_traces, "permutation", "weighted", DEFAULT_REPLICATES),
    "bootstrap_replacement_timed": _test(timed_traces, "replacement", "weighted", TIMED_REPLICATES),
    "bootstrap_split_timed": _test(timed_traces, "split", "weighted", TIMED_REPLICATES),
    "bootstrap_resample_timed": _test(timed_traces, "resample", "weighted", TIMED_REPLICATES),
    "classic_bootstrap_timed": _test(timed_traces, "classic", "weighted", TIMED_REPLICATES),
    "double_bootstrap_timed": _double("smaller", "weighted", timed_traces, TIMED_REPLICATES),
    "ks_test_timed": _ks("replacement", "weighted", timed_traces, TIMED_REPLICATES),
    "bootstrap_replacement_discrete": _test(small_logs, "replacement", "discrete"),
    "bootstrap_split_discrete": _test(small_logs, "split", "discrete"),
    "bootstrap_resample_discrete": _test(small_logs, "resample", "discrete"),
    "classic_bootstrap_discrete": _test(small_logs, "classic", "discrete"),
    "bootstrap_replacement_control_flow": _test(small_logs, "replacement", "levenshtein"),
    "bootstrap_split_control_flow": _test(small_logs, "split", "levenshtein"),
    "bootstrap_resample_control_flow": _test(small_logs, "resample", "levenshtein"),
    "classic_bootstrap_control_flow": _test(small_logs, "classic", "levenshtein"),
    "double_bootstrap_discrete": _double("smaller", "discrete"),
    "double_bootstrap_control_flow": _double("smaller", "levenshtein"),
    "double_bootstrap_split_variants": _double("split_variants", "levenshtein"),
    "ks_test_discrete": _ks("replacement", "discrete"),
    "ks_test_split_control_flow": _ks("split", "levenshtein"),
    "null_histogram": q_null_histogram,
    "p1_found": p1_found,
    "p1_zones": p1_zones,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_wide": p4_wide,
}
