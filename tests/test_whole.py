"""Queries answer for every row of their tables."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", ["text_words", "text_counts", "text_quotes"])
def test_every_document_has_a_row(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert docs.where("text is not null and (lang is null or lang not in ('en', 'EN'))").count() > 0
    got = entry.queries()[name](spark, FOLDER).select("doc_id")
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", ["cutoff_table", "cutoff_window_excluded", "cutoff_window_included", "cutoff_use_previous", "cutoff_approximate"])
def test_every_order_is_a_cutoff(spark, name):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    want = {(r["o_custkey"], r["o_orderdate"], r["o_orderpriority"]) for r in orders.collect()}
    got = [tuple(r) for r in entry.queries()[name](spark, FOLDER).select("c_custkey", "time", "label").collect()]
    assert len(got) == len(want) and set(got) == want
