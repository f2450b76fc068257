"""DuckDB SQL of the core queries."""

from __future__ import annotations

SEED = 42
REPLICATES = 1000

CASE, ACTIVITY, TIME, LIFECYCLE, INSTANCE = '"case:concept:name"', '"concept:name"', '"time:timestamp"', '"lifecycle:transition"', '"concept:instance"'
ENDS, STARTS = f"{LIFECYCLE} IN ('complete', 'ate_abort')", f"{LIFECYCLE} = 'start'"


def ranked_start(keys: str) -> str:
    """END rows with the start of equal rank inside ``keys``."""
    same = " AND ".join(f"e.{k} = s.{k}" for k in keys.split(", "))
    return f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {TIME}, event_ord) AS k FROM event_log WHERE {ENDS} AND {CASE} IS NOT NULL AND {TIME} IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {TIME}, event_ord) AS k FROM event_log WHERE {STARTS} AND {CASE} IS NOT NULL AND {TIME} IS NOT NULL)
SELECT e.event_ord, epoch_us(coalesce(s.{TIME}, e.{TIME})) AS start_us FROM e LEFT JOIN s ON {same} AND e.k = s.k
"""


KIND = f"CASE WHEN {ENDS} THEN 'end' WHEN {STARTS} THEN 'start' END"
INFERRED = f"""
usable AS (
  SELECT *, CASE WHEN {CASE} IS NOT NULL AND {ACTIVITY} IS NOT NULL THEN {KIND} END AS kind FROM event_log
), inferred AS (
  SELECT *, CASE WHEN kind IS NULL THEN 'None' ELSE CAST(row_number() OVER (PARTITION BY {CASE}, {ACTIVITY}, kind ORDER BY {TIME} NULLS LAST, event_ord) - 1 AS VARCHAR) END AS instance FROM usable
)"""


def folded(source: str, instance: str) -> str:
    return f"""
groups AS (
  SELECT {CASE} AS c, {ACTIVITY} AS a, {instance} AS i, min({TIME}) FILTER ({STARTS}) AS started
  FROM {source} WHERE {CASE} IS NOT NULL AND {ACTIVITY} IS NOT NULL AND {instance} IS NOT NULL GROUP BY ALL
)
SELECT event_ord, epoch_us(CASE WHEN {ENDS} THEN coalesce(started, {TIME}) ELSE {TIME} END) AS start_us
FROM {source} LEFT JOIN groups ON {CASE} = c AND {ACTIVITY} = a AND {instance} = i
WHERE {LIFECYCLE} IS NULL OR NOT {STARTS}
"""


def split(method: str) -> str:
    keys = (
        f"SELECT {CASE} AS case_id, min(md5('{SEED}:' || event_ord)) AS key FROM event_log WHERE {CASE} IS NOT NULL GROUP BY 1"
        if method == "event_biased"
        else f"SELECT DISTINCT {CASE} AS case_id, md5('{SEED}:' || {CASE}) AS key FROM event_log WHERE {CASE} IS NOT NULL"
    )
    return f"""
WITH keys AS ({keys}), ranked AS (SELECT case_id, row_number() OVER (ORDER BY key, case_id) AS r, count(*) OVER () AS n FROM keys)
SELECT case_id, CASE WHEN r <= floor(n * 0.5) THEN 1 ELSE 2 END AS part, (SELECT count(*) FROM event_log WHERE {CASE} = case_id) AS n_rows FROM ranked
"""


def bins(low: float, high: float) -> str:
    return f"""
WITH q AS (SELECT event_type, quantile_cont(value, {low}) AS a, quantile_cont(value, {high}) AS b FROM events GROUP BY event_type)
SELECT event_id, CASE WHEN value IS NULL OR event_type IS NULL THEN 0 WHEN value < a THEN 0 WHEN value < b THEN 1 ELSE 2 END AS bin FROM events LEFT JOIN q USING (event_type)
"""


# Populations of pairs of logs, as text traces.
STEPS = f"""
steps AS (
  SELECT DISTINCT log_id, {CASE} AS case_id, step_no, {ACTIVITY} AS activity FROM trace_steps
  WHERE log_id IS NOT NULL AND {CASE} IS NOT NULL AND step_no IS NOT NULL AND {ACTIVITY} IS NOT NULL
), traces AS (
  SELECT TRY_CAST(regexp_extract(log_id, '([0-9]+)$', 1) AS BIGINT) AS log_number, case_id, string_agg(activity, '>' ORDER BY step_no, activity) AS trace, count(*) AS size
  FROM steps GROUP BY log_id, case_id
)"""
LINES = """
lines AS (
  SELECT o_custkey AS log_number, CAST(l_orderkey AS VARCHAR) AS case_id, l_returnflag || l_linestatus AS activity, l_shipdate AS ts, o_orderdate AS start, l_linenumber AS ord, l_quantity AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""
DELIVERIES = f"""{LINES}, traces AS (
  SELECT log_number, case_id, string_agg(activity, '>' ORDER BY ts, activity, ord) AS trace, count(*) AS size FROM lines GROUP BY log_number, case_id
)"""
PAIRS = """
sided AS (SELECT log_number // 2 AS pair_id, CAST(log_number % 2 + 1 AS INTEGER) AS side, case_id, trace, size FROM traces WHERE log_number IS NOT NULL),
pop AS (SELECT * FROM sided WHERE pair_id IN (SELECT pair_id FROM sided GROUP BY pair_id HAVING count(DISTINCT side) = 2)),
counted AS (
  SELECT pair_id, trace, any_value(size) AS size, count(*) FILTER (side = 1) AS c1, count(*) FILTER (side = 2) AS c2, min(CAST(side AS VARCHAR) || case_id) AS first FROM pop GROUP BY pair_id, trace
), vs AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY first) - 1 AS variant_id,
    CAST(sum(c1) OVER (PARTITION BY pair_id) AS BIGINT) AS n1, CAST(sum(c2) OVER (PARTITION BY pair_id) AS BIGINT) AS n2 FROM counted
)"""
PAIRED_STEPS, PAIRED_DELIVERIES = f"{STEPS}, {PAIRS}", f"{DELIVERIES}, {PAIRS}"


def shuffled(first: str, only: str = "true", n: int = REPLICATES) -> str:
    """Replicates of cases in random order, cut after ``first``."""
    return f"""
draws AS (
  SELECT pair_id, rep, CASE WHEN r <= {first} THEN 1 ELSE 2 END AS side, variant_id, count(*) AS cnt FROM (
    SELECT p.pair_id, rep, variant_id, n1, n2, row_number() OVER (PARTITION BY p.pair_id, rep ORDER BY md5(concat_ws(':', {SEED}, rep, p.pair_id, side, case_id)), side, case_id) AS r
    FROM pop p JOIN vs ON p.pair_id = vs.pair_id AND p.trace = vs.trace, range({n}) t(rep) WHERE {only}
  ) GROUP BY ALL
)"""


def drawn(name: str, weight: str, size: str, side: int, tag: str) -> str:
    """Draws with replacement by the counts in ``weight``."""
    return f"""
{name}_bounds AS (
  SELECT *, sum({weight}) OVER (PARTITION BY pair_id ORDER BY variant_id) AS upper, sum({weight}) OVER (PARTITION BY pair_id) AS whole FROM vs
), {name} AS (
  SELECT d.pair_id, rep, {side} AS side, variant_id, count(*) AS cnt FROM (
    SELECT pair_id, rep, k, ('0x' || substr(md5(concat_ws(':', {SEED}, rep, pair_id, '{tag}', k)), 1, 13))::BIGINT % whole AS u
    FROM (SELECT pair_id, CAST(any_value({size}) AS BIGINT) AS size, CAST(any_value(whole) AS BIGINT) AS whole FROM {name}_bounds GROUP BY pair_id), range({REPLICATES}) t(rep), LATERAL (SELECT unnest(range(size)) AS k)
  ) d JOIN {name}_bounds b ON d.pair_id = b.pair_id AND u < upper AND u >= upper - {weight} GROUP BY ALL
)"""


def whole(name: str, weight: str, side: int, n: int = REPLICATES) -> str:
    return f"{name} AS (SELECT pair_id, rep, {side} AS side, variant_id, {weight} AS cnt FROM vs, range({n}) t(rep) WHERE {weight} > 0)"


def discrete(draws: str, name: str) -> str:
    return f"""
{name}_cells AS (SELECT pair_id, rep, variant_id, coalesce(sum(cnt) FILTER (side = 1), 0) AS c1, coalesce(sum(cnt) FILTER (side = 2), 0) AS c2 FROM {draws} GROUP BY ALL),
{name}_sums AS (SELECT *, sum(c1) OVER (PARTITION BY pair_id, rep) AS m1, sum(c2) OVER (PARTITION BY pair_id, rep) AS m2 FROM {name}_cells),
{name} AS (SELECT pair_id, rep, CAST(sum(abs(c1 * m2 - c2 * m1)) AS DOUBLE) / CAST(2 * any_value(m1) * any_value(m2) AS DOUBLE) AS emd FROM {name}_sums GROUP BY pair_id, rep)"""


def line(draws: str, name: str) -> str:
    return f"""
{name}_cells AS (SELECT d.pair_id, rep, size, coalesce(sum(cnt) FILTER (side = 1), 0) AS c1, coalesce(sum(cnt) FILTER (side = 2), 0) AS c2 FROM {draws} d JOIN vs ON d.pair_id = vs.pair_id AND d.variant_id = vs.variant_id GROUP BY ALL),
{name}_sums AS (SELECT *, sum(c1) OVER (PARTITION BY pair_id, rep) AS m1, sum(c2) OVER (PARTITION BY pair_id, rep) AS m2 FROM {name}_cells),
{name}_area AS (
  SELECT *, abs(sum(c1 * m2 - c2 * m1) OVER (PARTITION BY pair_id, rep ORDER BY size)) * (lead(size) OVER (PARTITION BY pair_id, rep ORDER BY size) - size) AS area FROM {name}_sums
), {name} AS (SELECT pair_id, rep, CAST(coalesce(sum(area), 0) AS DOUBLE) / CAST(any_value(m1) * any_value(m2) AS DOUBLE) AS emd FROM {name}_area GROUP BY pair_id, rep)"""


OBSERVED = f"{whole('seen_1', 'c1', 1, 1)}, {whole('seen_2', 'c2', 2, 1)}, seen AS (SELECT * FROM seen_1 UNION ALL SELECT * FROM seen_2)"


def tested(population: str, draws: str, solve, strict: bool) -> str:
    beyond = ">" if strict else ">="
    return f"""
WITH {population}, {draws}, {OBSERVED}, {solve('draws', 'nulls')}, {solve('seen', 'actual')}
SELECT pair_id, round(any_value(a.emd), 9) AS logs_emd, round(avg(CASE WHEN n.emd {beyond} a.emd THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS pvalue, count(*) AS n_replicates
FROM nulls n JOIN actual a USING (pair_id) GROUP BY pair_id
"""


def both(first: str, second: str) -> str:
    return f"{first}, {second}, draws AS (SELECT * FROM draws_1 UNION ALL SELECT * FROM draws_2)"


PERMUTED = shuffled("n1")
REPLACED = both(drawn("draws_1", "c1", "n1", 1, "1"), whole("draws_2", "c1", 2))
HALVED = shuffled("n1 // 2", "side = 1")
RESAMPLED = both(drawn("draws_1", "c1", "n1 // 2", 1, "1"), drawn("draws_2", "c1", "n1 // 2", 2, "2"))
POOLED = both(drawn("draws_1", "(c1 + c2)", "n1", 1, "1"), drawn("draws_2", "(c1 + c2)", "n2", 2, "2"))

# The larger log of a pair becomes side 1.
TURNED = PAIRED_STEPS.replace("pop AS (SELECT * FROM sided", "sizes AS (SELECT pair_id, count(*) FILTER (side = 1) < count(*) FILTER (side = 2) AS swap FROM sided GROUP BY pair_id),\npop AS (SELECT sided.* REPLACE (CASE WHEN swap THEN 3 - side ELSE side END AS side) FROM sided JOIN sizes USING (pair_id)").replace("HAVING count", "HAVING count").replace("WHERE pair_id IN", "WHERE sided.pair_id IN")
def double(solve) -> str:
    """The double bootstrap under a closed form."""
    return f"""
WITH {TURNED}, {drawn('own_1', 'c1', 'n2', 1, '1')}, {drawn('own_2', 'c1', 'n2', 2, '2')}, own AS (SELECT * FROM own_1 UNION ALL SELECT * FROM own_2),
{whole('other_2', 'c2', 2)}, other AS (SELECT * FROM own_1 UNION ALL SELECT * FROM other_2), {solve('own', 'nulls')}, {solve('other', 'logs')},
mean AS (SELECT pair_id, avg(emd) AS emd FROM logs GROUP BY pair_id)
SELECT pair_id, round(any_value(a.emd), 9) AS logs_emd, round(avg(CASE WHEN n.emd >= a.emd THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS pvalue, count(*) AS n_replicates
FROM nulls n JOIN mean a USING (pair_id) GROUP BY pair_id
"""


def ks(solve) -> str:
    """The Kolmogorov-Smirnov test under a closed form."""
    return f"""
WITH {PAIRED_STEPS}, {RESAMPLED}, {drawn('between_1', 'c1', 'n1 // 2', 1, '1')}, {drawn('between_2', 'c2', 'n2 // 2', 2, '2')},
between_draws AS (SELECT * FROM between_1 UNION ALL SELECT * FROM between_2), {solve('draws', 'reference')}, {solve('between_draws', 'logs')},
points AS (SELECT pair_id, emd, sum(r) AS r, sum(l) AS l FROM (SELECT pair_id, emd, 1 AS r, 0 AS l FROM reference UNION ALL SELECT pair_id, emd, 0, 1 FROM logs) GROUP BY pair_id, emd),
ahead AS (SELECT pair_id, r, sum(r - l) OVER (PARTITION BY pair_id ORDER BY emd) AS d FROM points),
found AS (SELECT pair_id, CAST(greatest(max(d), 0) AS BIGINT) AS h, CAST(sum(r) AS BIGINT) AS n FROM ahead GROUP BY pair_id)
SELECT pair_id, round(h / n, 9) AS statistic, round(CASE WHEN h = 0 THEN 1.0::DOUBLE ELSE (SELECT exp(sum(ln((n - j)::DOUBLE) - ln((n + j + 1)::DOUBLE))) FROM (SELECT unnest(range(h)) AS j)) END, 9) AS pvalue FROM found
"""


def matrix(cost: str, pairs: str = "a.variant_id <= b.variant_id") -> str:
    """Costs between the variants of every pair, their activities written as single letters."""
    word = "trace"
    for letter, activity in zip("abcdef", ("AF", "AO", "NF", "NO", "RF", "RO")):
        word = f"replace({word}, '{activity}', '{letter}')"
    return f"""
WITH {PAIRED_DELIVERIES}, words AS (SELECT *, replace({word}, '>', '') AS word FROM vs)
SELECT a.pair_id, CAST(a.variant_id AS INTEGER) AS i, CAST(b.variant_id AS INTEGER) AS j, {cost} AS cost FROM words a JOIN words b ON a.pair_id = b.pair_id AND {pairs}
"""


def binned_traces(value: str) -> str:
    return f"""
WITH {LINES}, q AS (SELECT activity, quantile_cont({value}, [0.25, 0.75]) AS e FROM lines GROUP BY activity),
binned AS (SELECT *, CASE WHEN {value} < e[1] THEN 0 WHEN {value} < e[2] THEN 1 ELSE 2 END AS bin FROM lines JOIN q USING (activity))
SELECT CAST(case_id AS BIGINT) AS case_id, string_agg(activity || bin, '>' ORDER BY ts, activity, ord, bin) AS trace_text FROM binned GROUP BY case_id"""


def weighted(scale: float, half: int) -> str:
    """Weighted edit distances between binned variants: the rows of all edit tables, one after the other.

    A cell that is reached from its left neighbour is the least over all cells
    before it, with the insertions between added.
    """
    return f"""
WITH RECURSIVE {LINES}, q AS (SELECT activity, quantile_cont((epoch_us(ts) - epoch_us(start)) / 1e6::DOUBLE, [0.25, 0.75]) AS e FROM lines GROUP BY activity),
binned AS (SELECT *, CASE WHEN (epoch_us(ts) - epoch_us(start)) / 1e6::DOUBLE < e[1] THEN 0 WHEN (epoch_us(ts) - epoch_us(start)) / 1e6::DOUBLE < e[2] THEN 1 ELSE 2 END AS bin FROM lines JOIN q USING (activity)),
traces AS (SELECT log_number, case_id, string_agg(activity || bin, '>' ORDER BY ts, activity, ord, bin) AS trace, count(*) AS size FROM binned GROUP BY log_number, case_id), {PAIRS},
steps AS (
  SELECT pair_id, variant_id, unnest(range(1, size + 1)) AS k, unnest(string_split(trace, '>')) AS step FROM vs
), events AS (
  SELECT pair_id, variant_id, k, left(step, 2) AS activity, CAST(step[3:] AS DOUBLE) / {scale} AS bin, sum(1 + CAST(step[3:] AS DOUBLE) / {scale}) OVER (PARTITION BY pair_id, variant_id ORDER BY k) AS upto FROM steps
), pairs AS (
  SELECT a.pair_id, a.variant_id AS i, b.variant_id AS j, a.size AS rows, b.size AS columns FROM vs a JOIN vs b ON a.pair_id = b.pair_id AND a.variant_id <= b.variant_id
), cells AS (
  SELECT pair_id, i, j, rows, columns, 0 AS r, 0 AS k, 0.0::DOUBLE AS cost FROM pairs
  UNION ALL
  SELECT p.pair_id, i, j, rows, columns, 0, k, upto FROM pairs p JOIN events e ON e.pair_id = p.pair_id AND e.variant_id = p.j
), tables AS (
  SELECT * FROM cells
  UNION ALL
  SELECT pair_id, i, j, rows, columns, r, k, min(reached - upto) OVER (PARTITION BY pair_id, i, j ORDER BY k) + upto FROM (
    SELECT t.pair_id, i, j, rows, columns, r + 1 AS r, t.k, coalesce(b.upto, 0.0::DOUBLE) AS upto, least(
      cost + 1 + a.bin,
      lag(cost) OVER (PARTITION BY t.pair_id, i, j ORDER BY t.k) + CASE WHEN a.activity = b.activity THEN 0 ELSE 1 END + abs(a.bin - b.bin)
    ) AS reached
    FROM tables t JOIN events a ON a.pair_id = t.pair_id AND a.variant_id = t.i AND a.k = t.r + 1 LEFT JOIN events b ON b.pair_id = t.pair_id AND b.variant_id = t.j AND b.k = t.k
  )
)
SELECT pair_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(cost / greatest(rows, columns) / {half}, 9) AS cost FROM tables WHERE r = rows AND k = columns
"""


CELLS = f"""
WITH seq AS (
  SELECT {CASE} AS case_id, {ACTIVITY} AS activity, epoch_us({TIME}) AS ts_us, min(event_ord) AS ord FROM event_log
  WHERE {LIFECYCLE} = 'complete' AND {CASE} IS NOT NULL AND {ACTIVITY} IS NOT NULL AND {TIME} IS NOT NULL
  GROUP BY {CASE}, {ACTIVITY}, {LIFECYCLE}, {TIME}, {INSTANCE}, start_timestamp
), waits AS (
  SELECT *, coalesce(ts_us - lag(ts_us) OVER (PARTITION BY case_id ORDER BY ts_us, ord), 0) AS wait_us, max(ts_us) OVER (PARTITION BY case_id) AS ends FROM seq
), cells AS (
  SELECT case_id, activity AS act_name, count(*) AS n_events, max(ends) - max(ts_us) AS recency_us, CAST(sum(wait_us) AS BIGINT) AS total_us
  FROM waits GROUP BY case_id, activity
)"""


ZONE = r"[A-Za-z]{1,5}|[+-]\d{2}(?::?\d{2})?"
CLOCK = rf"^(?:(\d{{1,2}})(?::(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?)?(?:\s*([AaPp][Mm]))?)?\s*({ZONE})?\s*(?:\[([^\]]+)\])?$"
DATES = {
    "ymd": r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[Tt ]\s*|$)(.*)$",
    "abY": r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})(?:,?\s+|$)(.*)$",
    "dmY": r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})(?:,?\s+|$)(.*)$",
    "dny": r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3,9})\.?,?\s+(\d{4})(?:,?\s+|$)(.*)$",
    "ndy": r"^([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})(?:,?\s+|$)(.*)$",
    "compact": rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt]?(\d{{2}}\d{{2}}\d{{2}}\s*(?:{ZONE})?)$",
}
KNOWN = "(SELECT name FROM pg_timezone_names() WHERE contains(name, '/') OR name IN ('UTC', 'GMT'))"
P1_FOUND = f"""
WITH vals AS (
  SELECT event_ord, site_id, 'time:timestamp' AS field_name, {TIME} AS value FROM raw_log WHERE {TIME} IS NOT NULL
  UNION ALL SELECT event_ord, site_id, 'start_timestamp', start_timestamp FROM raw_log WHERE start_timestamp IS NOT NULL
), placed AS (
  SELECT event_ord, field_name, trim(regexp_replace(value, '[\\s\\x{{00a0}}]+', ' ', 'g')) AS v, tz_name, upper(date_order) AS o FROM vals LEFT JOIN sites USING (site_id)
), shaped AS (
  SELECT *, CASE {" ".join(f"WHEN regexp_matches(v, '{r}') THEN '{k}'" for k, r in DATES.items())} END AS kind,
    CASE {" ".join(f"WHEN regexp_matches(v, '{r}') THEN regexp_extract(v, '{r}', ['p', 'q', 'r', 'rest'])" for k, r in DATES.items())} END AS x FROM placed
), named AS (
  SELECT *, CASE kind WHEN 'dny' THEN lower(x.q) WHEN 'ndy' THEN lower(x.p) END AS word,
    CASE WHEN kind = 'compact' THEN regexp_replace(x.rest, '^(..)(..)(..)', '\\1:\\2:\\3') ELSE x.rest END AS rest FROM shaped
), dated AS (
  SELECT *, CASE WHEN kind IN ('ymd', 'compact') THEN x.p ELSE x.r END AS y,
    CASE WHEN kind IN ('ymd', 'compact', 'dmY') THEN x.q WHEN kind = 'abY' THEN CASE o WHEN 'DMY' THEN x.q WHEN 'MDY' THEN x.p END
      ELSE (SELECT min(m) FROM (SELECT unnest(range(1, 13)) AS m) WHERE starts_with(lower(strftime(make_date(2023, m, 1), '%B')), word) OR (word = 'sept' AND m = 9))::VARCHAR END AS m,
    CASE WHEN kind IN ('ymd', 'compact') THEN x.r WHEN kind IN ('dmY', 'dny') THEN x.p WHEN kind = 'ndy' THEN x.q WHEN kind = 'abY' THEN CASE o WHEN 'DMY' THEN x.p WHEN 'MDY' THEN x.q END END AS d,
    CASE WHEN regexp_matches(rest, '{CLOCK}') THEN regexp_extract(rest, '{CLOCK}', ['h', 'i', 's', 'f', 'half', 'zone', 'region']) END AS c FROM named
), read AS (
  SELECT event_ord, field_name, v, tz_name, upper(nullif(c.zone, '')) AS zone, nullif(c.region, '') AS region,
    TRY_CAST(printf('%04d-%02d-%02d', CASE WHEN length(y) = 2 THEN 2000 ELSE 0 END + y::INTEGER, m::INTEGER, d::INTEGER) AS DATE) AS day,
    CASE WHEN c.half = '' THEN coalesce(TRY_CAST(c.h AS INTEGER), 0) WHEN TRY_CAST(c.h AS INTEGER) BETWEEN 1 AND 12 THEN c.h::INTEGER % 12 + CASE WHEN lower(c.half) = 'pm' THEN 12 ELSE 0 END END AS hour,
    coalesce(TRY_CAST(c.i AS INTEGER), 0) AS minute, coalesce(TRY_CAST(c.s AS INTEGER), 0) AS second, coalesce(TRY_CAST(rpad(left(nullif(c.f, ''), 6), 6, '0') AS BIGINT), 0) AS fraction, c.h = '' OR c.i <> '' AS complete FROM dated
), walled AS (
  SELECT *, regexp_replace(zone, '[^0-9]', '', 'g') AS digits,
    CASE WHEN complete AND hour < 24 AND minute < 60 AND second < 60 AND year(day) >= 1 THEN epoch_us(day::TIMESTAMP) + ((hour * 60 + minute) * 60 + second) * 1000000::BIGINT + fraction END AS wall FROM read
), zoned AS (
  SELECT *, CASE WHEN left(zone, 1) IN ('+', '-') THEN (left(digits, 2)::INTEGER * 60 + coalesce(TRY_CAST(substr(digits, 3, 2) AS INTEGER), 0)) * CASE WHEN left(zone, 1) = '-' THEN -1 ELSE 1 END WHEN zone IN ('Z', 'UTC', 'GMT') THEN 0 END AS ahead,
    CASE WHEN left(zone, 1) IN ('+', '-') THEN coalesce(TRY_CAST(substr(digits, 3, 2) AS INTEGER), 0) < 60 ELSE true END AS sound FROM walled
), seasons AS (
  SELECT upper(unnest([abbr_std, abbr_dst])) AS zone, unnest([least(a, b), greatest(a, b)]) AS ahead_us FROM (
    SELECT abbr_std, abbr_dst, epoch_us(timezone(tz_name, make_timestamptz(1672531200000000))) - 1672531200000000 AS a, epoch_us(timezone(tz_name, make_timestamptz(1688169600000000))) - 1688169600000000 AS b
    FROM sites WHERE tz_name IN {KNOWN}
  )
), abbreviations AS (
  SELECT zone, min(ahead_us) AS ahead_us FROM seasons WHERE zone IS NOT NULL GROUP BY zone HAVING min(ahead_us) = max(ahead_us)
), settled AS (
  SELECT event_ord, field_name, wall, CASE WHEN regexp_matches(v, '^(\\d{{10}}|\\d{{13}}|\\d{{16}})$') THEN rpad(v, 16, '0')::BIGINT
      WHEN z.zone IS NULL THEN NULL WHEN NOT sound OR abs(ahead) > 1080 THEN NULL WHEN ahead IS NOT NULL THEN wall - ahead * 60000000::BIGINT ELSE wall - b.ahead_us END AS fixed,
    CASE WHEN z.zone IS NULL THEN CASE WHEN region IS NULL THEN tz_name WHEN region IN {KNOWN} THEN region END END AS place
  FROM zoned z LEFT JOIN abbreviations b ON z.zone = b.zone
), tried AS (
  SELECT event_ord, field_name, wall, place, unnest(list_distinct([epoch_us(timezone(place, make_timestamp(wall - shift))) + shift for shift in [86400000000, -86400000000]])) AS instant
  FROM settled WHERE fixed IS NULL AND place IN {KNOWN} AND wall IS NOT NULL
)
SELECT event_ord, field_name, fixed AS utc_us FROM settled WHERE fixed IS NOT NULL
UNION ALL
SELECT event_ord, field_name, min(instant) FROM tried WHERE epoch_us(timezone(place, make_timestamptz(instant))) = wall GROUP BY event_ord, field_name, wall, place HAVING count(*) = 1
"""


SQL = {
    "p1_found": P1_FOUND,
    "log_len": f"SELECT count(DISTINCT {CASE}) AS n_cases FROM event_log",
    "lifecycle_fifo": ranked_start(f"{CASE}, {ACTIVITY}"),
    "lifecycle_instance": ranked_start(f"{CASE}, {ACTIVITY}, {INSTANCE}"),
    "infer_instances": f"WITH {INFERRED} SELECT event_ord, instance FROM inferred",
    "fold_instances": f"WITH {folded('event_log', INSTANCE)}",
    "strict_interval": f"WITH {INFERRED}, {folded('inferred', 'instance')}",
    "ensure_start": ranked_start(f"{CASE}, {ACTIVITY}, {INSTANCE}"),
    "atomic_to_lifecycle": f"SELECT event_ord, 'complete' AS lifecycle, {CASE} || ':' || row_number() OVER (PARTITION BY {CASE} ORDER BY event_ord) AS instance FROM atomic_log",
    "atomic_to_interval": f"SELECT event_ord, epoch_us({TIME}) AS start_us FROM atomic_log",
    "duration": f"SELECT event_ord, (epoch_us({TIME}) - epoch_us(start_timestamp)) / 1e6::DOUBLE AS duration_s FROM interval_log",
    "waiting_time": f"""
SELECT event_ord, CASE WHEN before IS NULL THEN 0.0::DOUBLE ELSE (epoch_us(start_timestamp) - before) / 1e6::DOUBLE END AS waiting_s FROM (
  SELECT *, lag(epoch_us({TIME})) OVER (PARTITION BY {CASE} ORDER BY {TIME}, {ACTIVITY} NULLS FIRST, event_ord) AS before FROM interval_log WHERE {CASE} IS NOT NULL AND {TIME} IS NOT NULL
)""",
    "split_cases_event_biased": split("event_biased"),
    "split_cases_uniform": split("uniform"),
    "sample_cases": f"""
WITH keys AS (SELECT {CASE} AS case_id, min(md5('{SEED}:' || event_ord)) AS key FROM event_log WHERE {CASE} IS NOT NULL GROUP BY 1 ORDER BY key, case_id LIMIT 100)
SELECT case_id, count(*) AS n_rows FROM keys JOIN event_log ON {CASE} = case_id GROUP BY case_id""",
    "extract_traces": f"""
SELECT {CASE} AS case_id, string_agg(coalesce({ACTIVITY}, '?'), '>' ORDER BY {TIME}, {ACTIVITY} NULLS FIRST, event_ord) AS trace_text
FROM event_log WHERE {LIFECYCLE} = 'complete' AND {CASE} IS NOT NULL AND {TIME} IS NOT NULL GROUP BY {CASE}""",
    "service_time_traces": f"""
SELECT {CASE} AS case_id, string_agg(coalesce({ACTIVITY}, '?') || '=' || (epoch_us({TIME}) - epoch_us(start_timestamp)), '>' ORDER BY {TIME}, {ACTIVITY} NULLS FIRST, event_ord) AS trace_text
FROM interval_log WHERE start_timestamp IS NOT NULL AND {CASE} IS NOT NULL AND {TIME} IS NOT NULL GROUP BY {CASE}""",
    "iqr_bins": bins(0.25, 0.75),
    "outer_percentile_bins": bins(0.1, 0.9),
    "custom_bins": """
WITH q AS (SELECT event_type, (min(value) + max(value)) / 2 AS middle FROM events GROUP BY event_type)
SELECT event_id, CASE WHEN value IS NULL OR event_type IS NULL THEN 0 WHEN value < middle THEN 1 ELSE 2 END AS bin FROM events LEFT JOIN q USING (event_type)""",
    "binned_traces": binned_traces("(epoch_us(ts) - epoch_us(start)) / 1e6::DOUBLE"),
    "binned_numeric_traces": binned_traces("CAST(quantity AS DOUBLE)"),
    "stochastic_language": f"WITH {STEPS} SELECT log_number, trace AS trace_text, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY log_number), 9) AS frequency FROM traces WHERE log_number IS NOT NULL GROUP BY log_number, trace",
    "stochastic_language_deliveries": f"WITH {DELIVERIES} SELECT trace AS trace_text, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS frequency FROM traces GROUP BY trace",
    "levenshtein_matrix": matrix("CAST(levenshtein(a.word, b.word) AS DOUBLE)"),
    "postnorm_levenshtein_matrix": matrix("round(CAST(levenshtein(a.word, b.word) AS DOUBLE) / greatest(a.size, b.size), 9)"),
    "cross_levenshtein_matrix": matrix("round(CAST(levenshtein(a.word, b.word) AS DOUBLE) / greatest(a.size, b.size), 9)", "a.c1 > 0 AND b.c2 > 0"),
    "weighted_levenshtein_matrix": weighted(1.0, 1),
    "weighted_time_levenshtein_matrix": weighted(2.0, 2),
    "logs_emd_discrete": f"WITH {PAIRED_DELIVERIES}, {OBSERVED}, {discrete('seen', 'actual')} SELECT pair_id, round(emd, 9) AS logs_emd FROM actual",
    "logs_emd_line": f"WITH {PAIRED_DELIVERIES}, {OBSERVED}, {line('seen', 'actual')} SELECT pair_id, round(emd, 9) AS logs_emd FROM actual",
    "logs_emd_user_cost": f"WITH {PAIRED_DELIVERIES}, {OBSERVED}, {line('seen', 'actual')} SELECT pair_id, round(emd, 9) AS logs_emd FROM actual",
    "permutation_test_user_cost": tested(PAIRED_STEPS, PERMUTED, line, True),
    "bootstrap_replacement_user_cost": tested(PAIRED_STEPS, REPLACED, line, False),
    "bootstrap_split_user_cost": tested(PAIRED_STEPS, HALVED, line, False),
    "bootstrap_resample_user_cost": tested(PAIRED_STEPS, RESAMPLED, line, False),
    "classic_bootstrap_user_cost": tested(PAIRED_STEPS, POOLED, line, False),
    "permutation_null_discrete": f"WITH {PAIRED_STEPS}, {PERMUTED}, {discrete('draws', 'nulls')} SELECT pair_id, CAST(rep AS INTEGER) AS rep, round(emd, 9) AS emd FROM nulls",
    "permutation_test_discrete": tested(PAIRED_STEPS, PERMUTED, discrete, True),
    "permutation_test_discrete_10000": tested(PAIRED_STEPS, shuffled("n1", n=10_000), discrete, True),
    "permutation_test_line": tested(PAIRED_STEPS, PERMUTED, line, True),
    "bootstrap_replacement_discrete": tested(PAIRED_STEPS, REPLACED, discrete, False),
    "bootstrap_split_discrete": tested(PAIRED_STEPS, HALVED, discrete, False),
    "bootstrap_resample_discrete": tested(PAIRED_STEPS, RESAMPLED, discrete, False),
    "classic_bootstrap_discrete": tested(PAIRED_STEPS, POOLED, discrete, False),
    "double_bootstrap_discrete": double(discrete),
    "double_bootstrap_user_cost": double(line),
    "ks_test_discrete": ks(discrete),
    "ks_test_user_cost": ks(line),
    "null_histogram": f"""
WITH {PAIRED_STEPS}, {PERMUTED}, {line('draws', 'nulls')}, spans AS (SELECT *, min(emd) OVER (PARTITION BY pair_id) AS lo, max(emd) OVER (PARTITION BY pair_id) AS hi FROM nulls)
SELECT pair_id, CAST(CASE WHEN hi > lo THEN least(floor((emd - lo) * 10 / (hi - lo)), 9) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM spans GROUP BY ALL""",
    "p2_found": f"""
WITH rows AS (
  SELECT {CASE} AS case_id, epoch_us(start_timestamp) AS a, epoch_us({TIME}) AS b
  FROM interval_log
  WHERE {CASE} IS NOT NULL AND start_timestamp IS NOT NULL AND {TIME} IS NOT NULL AND start_timestamp <= {TIME}
), marked AS (
  SELECT *, max(b) OVER (PARTITION BY case_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS idle_from FROM rows
), numbered AS (
  SELECT *, sum(CASE WHEN idle_from IS NULL OR a > idle_from THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM marked
), periods AS (
  SELECT case_id, k, min(a) AS a, max(b) AS b FROM numbered GROUP BY case_id, k
)
SELECT case_id, 'period' AS span_kind, a AS from_us, b AS to_us FROM periods
UNION ALL
SELECT case_id, 'gap', b, next_a FROM (SELECT case_id, b, lead(a) OVER (PARTITION BY case_id ORDER BY k) AS next_a FROM periods) WHERE next_a IS NOT NULL""",
    "p4_found": f"{CELLS} SELECT * FROM cells",
    "p4_wide": f"""
{CELLS}, used AS (
  SELECT DISTINCT {ACTIVITY} AS act_name FROM event_log WHERE {LIFECYCLE} = 'complete' AND {CASE} IS NOT NULL AND {ACTIVITY} IS NOT NULL AND {TIME} IS NOT NULL
), every AS (
  SELECT c.case_id, u.act_name, coalesce(n_events, 0) AS n_events, recency_us, coalesce(total_us, 0) AS total_us
  FROM (SELECT DISTINCT case_id FROM cells) c, used u LEFT JOIN cells ON cells.case_id = c.case_id AND cells.act_name = u.act_name
)
SELECT case_id, list(n_events ORDER BY act_name) AS n_events, list(recency_us ORDER BY act_name) AS recency_us, list(total_us ORDER BY act_name) AS total_us FROM every GROUP BY case_id""",
}
