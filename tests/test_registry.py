"""Registered queries against their DuckDB statements.

A sample runs by default; ``PII_ALL_ORACLES=1`` runs all of them.
"""

import os
import re

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck
from pii_spark.plans import registry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "masked_documents", "merge_longest", "vault_resolve", "masked_payloads", "log_messages", "training_samples",
    "annotation_tasks", "overlap_bio", "split_balanced", "relaxed_prf", "decode_spans", "annotation_diff",
    "stream_vault", "restored_answers",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("PII_ALL_ORACLES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), entry.oracle_sql()[name], con) is None


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.oracles())
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_scans_read_only_needed_columns(spark):
    plan = entry.queries()["pii_docs_by_lang"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<(?=[^>]*text)(?![^>]*n_chars)[^>]*>", plan)


def test_documents_are_shuffled_at_most_once(spark):
    """Masking needs no shuffle beyond spreading a one-file input over the cores."""
    plan = entry.queries()["masked_documents"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "Python" not in plan
