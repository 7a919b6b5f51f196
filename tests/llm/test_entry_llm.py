"""The driver contract for the subpackage's queries."""

import sys

import pytest

import __spark_entry__ as entry


def test_a_missing_package_is_an_error(monkeypatch):
    monkeypatch.delitem(sys.modules, "pathloom.llm.queries", raising=False)
    monkeypatch.setitem(sys.modules, "pathloom.llm.leakage", None)
    with pytest.raises(ImportError):
        entry.queries()


def test_queries_of_all_problems_are_there():
    assert {f"p{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in entry.queries()}
