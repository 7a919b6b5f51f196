"""The driver contract."""

import __spark_entry__ as entry


def test_queries_of_the_general_problems_are_there():
    assert {"p1", "p2", "p3", "p5", "p7"} <= {n.split("_")[0] for n in entry.queries()}


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
