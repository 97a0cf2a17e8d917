"""Every registered query against its SQL on the same tables."""

import re

import pytest

import __spark_entry__ as entry
import check
from hearsay import fixtures

@pytest.fixture(scope="module")
def db(sf_dir):
    with check.connect(sf_dir) as connection:
        yield connection


CORE = sorted(n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n))


def test_every_query_has_sql():
    assert set(CORE) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_there_is_one_comment_per_event(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert fixtures.comments(spark, sf_dir).count() == fixtures.full_comments(spark, sf_dir).count() == events


@pytest.mark.parametrize("name", CORE)
def test_query_matches_sql(spark, db, sf_dir, name):
    got = check.spark_result(entry.queries()[name](spark, sf_dir))
    assert got == check.sql_result(db, entry.oracle_sql()[name])


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
