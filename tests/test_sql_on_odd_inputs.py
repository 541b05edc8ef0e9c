"""Queries against their SQL on texts that the driver's tables seldom or never hold."""

import pytest

import __spark_entry__
from tests.test_queries import rows
from tests.test_whole_queries import tables

TEXTS = [
    "Ann saw Bob\n28.68.191.238 Bob met Cy\nSection 2 of Dora\nplain\n1.2 Zoe sang\nPart IV\n第一章 标题\n## two marks\nlast",
    "one\n\n#### four marks\n##none\n### three marks\n# one mark\nCHAPTER 3",
    "",
    None,
]


def differing(spark, at, names, **more):
    """Names of the queries that differ from their SQL over tables in a folder."""
    import duckdb

    c = duckdb.connect()
    for name in ["documents", *more]:
        c.sql(f"create view {name} as from '{at.removeprefix('file://')}/{name}.parquet/*.parquet'")
    out = []
    for name in names:
        got, want = __spark_entry__.queries()[name](spark, at).toPandas(), c.sql(__spark_entry__.oracle_sql()[name]).df()
        cols = sorted(want.columns)
        if sorted(got.columns) != cols or rows(got[cols].astype(object)) != rows(want[cols].astype(object)):
            out.append(name)
    return out


@pytest.mark.parametrize("name", ["heading_ranges", "heading_tree", "tables_of_contents", "tree_statistics"])
def test_headings_are_the_marked_lines(spark, tmp_path, name):
    assert not differing(spark, tables(spark, tmp_path / "t", TEXTS), [name])
