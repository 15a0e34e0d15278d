"""The driver's entry: modules that may be missing, and those that may not be wrong."""

import sys

import pytest

import __spark_entry__ as entry


def test_a_module_that_is_gone_is_left_out(monkeypatch, tmp_path):
    assert entry._if_there("pricelattice.no_such.queries") is None and entry._if_there("no_such_pipeline") is None
    (tmp_path / "wrong_one.py").write_text("import no_such_library\n")
    (tmp_path / "wrong_two.py").write_text("from math import no_such_name\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    for name in ("wrong_one", "wrong_two"):
        with pytest.raises(ImportError):
            entry._if_there(name)
        sys.modules.pop(name, None)


def test_every_text_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "full_detection" in entry.queries()
