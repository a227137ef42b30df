"""Every query with SQL, against DuckDB on the smallest tables."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


# a part of each family here; the driver's gate runs them all
SOME = [n for n in NAMES if n.startswith(("pv_", "ls_", "tg_", "lg_", "jn_"))] + NAMES[::7]


@pytest.mark.parametrize("name", sorted(set(SOME)))
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == Counter(tuple(r[names.index(c)] for c in columns) for r in cur.fetchall())


def test_unbound(spark, duck):
    """A row without a key has no term."""
    test_same_as_sql(spark, duck, "fn_bound_rows")


def test_coalesce_past_unbound(spark, duck):
    """Coalesce passes over what has no term."""
    test_same_as_sql(spark, duck, "fn_bound_null")


def test_entry(spark):
    assert entry.entry(spark).count() == 14


def plan(spark, name: str) -> str:
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_columns_of_a_property_shape_are_one_scan(spark):
    """A property shape of a node shape keeps its table: no join, no exchange."""
    p = plan(spark, "pv_min_exclusive")
    assert p.count("FileScan") == 1 and "Exchange" not in p and "Join" not in p


def test_whole_graph_is_counted_not_copied(spark, duck):
    """A count of what matches in the whole graph is one number beside each row, no array of all nodes."""
    test_same_as_sql(spark, duck, "ne_nodes_matching")
    test_same_as_sql(spark, duck, "ne_instances_of")
    assert "collect_list" not in plan(spark, "ne_nodes_matching")


def test_back_and_forth_on_one_table_is_no_join(spark):
    """From orders to lineitem and on to a column of its own: lineitem is read once for it."""
    assert plan(spark, "jn_less_than").count("lineitem.parquet") == 1
    assert plan(spark, "jn_disjoint").count("lineitem.parquet") == 1


def test_groups_read_a_table_once(spark, duck):
    """Columns of one subject come from one scan; keys and means are summed up without sorting all rows."""
    for name in ("sq_avg", "sq_group"):
        test_same_as_sql(spark, duck, name)
        assert plan(spark, name).count("FileScan") == 1
    assert "SortAggregate" not in plan(spark, "sq_avg")
