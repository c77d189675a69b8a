"""Each query of the subpackage against its SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from siltstone.llm import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def _plain(value):
    return round(value, 6) if isinstance(value, float) else value


def compared(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet*')" if os.path.isfile(f"{folder}/{table}.parquet") else f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    df = registry.queries()[name](spark, folder)
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    found = Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    assert found == Counter(tuple(_plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    compared(spark, FOLDER, name)


@pytest.mark.parametrize("name", ["quality_counts", "packing_totals", "language_undecided", "mixing_targets", "op3_exact_dedup"])
def test_made_up_tables(spark, docs_of, tmp_path, name):
    """Null and empty texts, sources that stop at twice their size, a null source, repeated lines and windows."""
    line = "one two three four five six seven"
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "1234 !?"), (5, "a"), (6, f"{line}\n{line}\n\n{line} eight"), (7, "é ü\u00a0x #*$%&|<>"),
        (8, "x " * 900, "en", "a"), (9, "y z", "en", "b"), (10, "w " * 40, "de", "c"), (11, "v " * 7, "de", None), (12, "long " * 9000, "fr", "d"), (13, "u", None, "é"), (14, "", "en", "empty"),
    ]
    path = str(tmp_path)
    docs_of(rows).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/pages.parquet").limit(1).write.parquet(f"{path}/pages.parquet")
    compared(spark, path, name)
