"""Queries of this subpackage."""

from __future__ import annotations

from weftlog.functions.columns import table
from weftlog.llm.leaks import leaked_items
from weftlog.llm.runs import collapse_runs
from weftlog.llm.spam import spam_pages
from weftlog.llm.subsequences import frequent_subsequences
from weftlog.llm.tokens import encode_corpus
from weftlog.llm.topitems import field_values, heavy_items, top_items
from weftlog.operators.features import case_sequences


def p3_found(spark, sf_dir):
    return frequent_subsequences(case_sequences(table(spark, sf_dir, "event_log")))


def p5_found(spark, sf_dir):
    return collapse_runs(table(spark, sf_dir, "atomic_log"), table(spark, sf_dir, "activities"))


def p6_found(spark, sf_dir):
    return heavy_items(field_values(table(spark, sf_dir, "trace_steps"), table(spark, sf_dir, "languages")))


def p6_top(spark, sf_dir):
    return top_items(field_values(table(spark, sf_dir, "trace_steps"), table(spark, sf_dir, "languages")), 100)


def p7_ids(spark, sf_dir):
    return encode_corpus(table(spark, sf_dir, "documents"))


def p8_found(spark, sf_dir):
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark, sf_dir):
    return spam_pages(table(spark, sf_dir, "documents")).select("doc_id")


QUERIES = {"p3_found": p3_found, "p5_found": p5_found, "p6_found": p6_found, "p6_top": p6_top, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found}
