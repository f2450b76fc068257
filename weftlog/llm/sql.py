"""DuckDB SQL of the queries of this subpackage."""

from __future__ import annotations

from weftlog.llm.runs import LOOK_ALIKE

VALUES = """
vals AS (
  SELECT 'concept:name' AS field_name, "concept:name" AS item_key FROM trace_steps WHERE "concept:name" IS NOT NULL
  UNION ALL
  SELECT 'variants', array_to_string(v, '>') FROM (SELECT unnest(variants) AS v FROM languages) WHERE v IS NOT NULL
), counted AS (
  SELECT field_name, item_key, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY field_name) AS BIGINT) AS n_field FROM vals GROUP BY field_name, item_key
)"""

P6_FOUND = f"WITH {VALUES} SELECT field_name, item_key FROM counted WHERE n * 200 > n_field AND n >= 5"

P6_TOP = f"""
WITH {VALUES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY field_name ORDER BY n DESC, item_key) AS r FROM counted)
SELECT field_name, item_key, n, n_field FROM ranked WHERE r <= 100
"""

SEQUENCES = """
seq AS (
  SELECT "case:concept:name" AS case_id, "concept:name" AS activity, "time:timestamp" AS ts, min(event_ord) AS ord FROM event_log
  WHERE "lifecycle:transition" = 'complete' AND "case:concept:name" IS NOT NULL AND "concept:name" IS NOT NULL AND "time:timestamp" IS NOT NULL
  GROUP BY "case:concept:name", "concept:name", "lifecycle:transition", "time:timestamp", "concept:instance", start_timestamp
), pos AS (
  SELECT case_id, activity, row_number() OVER (PARTITION BY case_id ORDER BY ts, ord) AS p FROM seq
), least AS (
  SELECT greatest(5, ceil(count(DISTINCT case_id) * 0.03 - 1e-9)) AS n FROM pos
), s1 AS (
  SELECT case_id, activity AS pattern, min(p) AS e FROM pos GROUP BY case_id, activity
)"""


def grown(n: int) -> str:
    """Leftmost ends of the frequent patterns of ``n - 1`` steps, and of those with one step more."""
    return f"""
f{n - 1} AS (SELECT pattern, count(*) AS n_cases FROM s{n - 1} GROUP BY pattern HAVING count(*) >= (SELECT n FROM least)),
s{n} AS (
  SELECT s.case_id, s.pattern || '>' || q.activity AS pattern, min(q.p) AS e FROM s{n - 1} s JOIN f{n - 1} USING (pattern) JOIN pos q ON q.case_id = s.case_id AND q.p > s.e
  WHERE q.activity IN (SELECT pattern FROM f1) GROUP BY s.case_id, s.pattern, q.activity
)"""


P3_FOUND = f"""
WITH {SEQUENCES}, {", ".join(grown(n) for n in (2, 3, 4, 5))},
f5 AS (SELECT pattern, count(*) AS n_cases FROM s5 GROUP BY pattern HAVING count(*) >= (SELECT n FROM least))
SELECT pattern AS pattern_text, n_cases FROM (SELECT * FROM f3 UNION ALL SELECT * FROM f4 UNION ALL SELECT * FROM f5)
"""



def spelling_key(name: str) -> str:
    latin = f"translate({name}, '{LOOK_ALIKE[0]}', '{LOOK_ALIKE[1]}')"
    spaced = f"regexp_replace(regexp_replace({latin}, '([a-z])([A-Z0-9])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"trim(regexp_replace(lower({spaced}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def edits(key: str) -> str:
    letters = [f"list_sort(string_split({k}, ''))" for k in (key, "a.k")]
    return f"CASE WHEN levenshtein({key}, a.k) = 2 AND {letters[0]} = {letters[1]} THEN 1 ELSE levenshtein({key}, a.k) END"


MARK = r"""(\s*#\s*\d+|\s+[xX]\d+|\s*\(\d+\)|/\d+|[\s_.-]+\d+)\s*["''.]*$"""

P5_FOUND = f"""
WITH entries AS (
  SELECT DISTINCT act_name, {spelling_key('act_name')} AS k FROM activities WHERE act_name IS NOT NULL
), names AS (
  SELECT DISTINCT "concept:name" AS name FROM atomic_log WHERE "concept:name" IS NOT NULL AND "case:concept:name" IS NOT NULL AND "time:timestamp" IS NOT NULL
), keyed AS (
  SELECT name, {spelling_key('name')} AS k, {spelling_key(f"regexp_replace(rtrim(name), '{MARK}', '')")} AS bare FROM names
), sure AS (
  SELECT n.*, coalesce(e.act_name, b.act_name) AS act_name FROM keyed n LEFT JOIN entries e ON e.k = n.k LEFT JOIN entries b ON b.k = n.bare
), near AS (
  SELECT name, arg_min(a.act_name, (least({edits('n.k')}, {edits('n.bare')}), a.act_name)) AS act_name FROM sure n, entries a WHERE n.act_name IS NULL GROUP BY name
), resolved AS (
  SELECT name, act_name FROM sure WHERE act_name IS NOT NULL UNION ALL SELECT * FROM near
), once AS (
  SELECT "case:concept:name" AS case_id, "concept:name" AS name, "time:timestamp" AS ts, min(event_ord) AS ord FROM atomic_log
  WHERE "case:concept:name" IS NOT NULL AND "concept:name" IS NOT NULL AND "time:timestamp" IS NOT NULL GROUP BY 1, 2, 3
), marked AS (
  SELECT case_id, act_name, ts, ord, lag(act_name) OVER w IS DISTINCT FROM act_name AS starts FROM once JOIN resolved USING (name) WINDOW w AS (PARTITION BY case_id ORDER BY ts, ord)
), numbered AS (
  SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY ts, ord) AS run FROM marked
)
SELECT case_id, arg_min(ord, (ts, ord)) AS first_ord, any_value(act_name) AS act_name, count(*) AS n_events, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us
FROM numbered GROUP BY case_id, run HAVING count(*) >= 2
"""

SQL = {"p5_found": P5_FOUND, "p3_found": P3_FOUND, "p6_found": P6_FOUND, "p6_top": P6_TOP}
