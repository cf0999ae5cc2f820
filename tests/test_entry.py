"""Queries against their SQL on the smallest data, where it is there."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ("io05_line_blocks", "w03_chunks", "pf14_sections", "j12_overlaps", "w12_merged_log", "j20_substitute_refs", "plan_report", "gm06_heights", "w13_two_columns", "w14_continued_lines", "ar02_span_runs", "w05_merged_clusters", "u03_u04_attempts", "u08_j21_attached", "io24_violations", "w12_job_logs")


def names() -> list[str]:
    """A sample of the queries, or with QUIRE_ALL all that have SQL."""
    import __spark_entry__ as e

    return sorted(e.oracle_sql()) if os.environ.get("QUIRE_ALL") else list(SAMPLE)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", names())
def test_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours = e.queries()[name](spark, SF)
    cols = sorted(ours.columns)
    want = con.sql(e.oracle_sql()[name])
    assert sorted(want.columns) == cols
    rows = lambda found: sorted(tuple(map(str, r)) for r in found)
    assert rows(ours.select(*cols).collect()) == rows(want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
