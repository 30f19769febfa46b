"""Lines of files that are read apart."""

from leadloom.plans.queries import _first_lines


def test_lines_before_each_file():
    assert _first_lines({"files": [{"name": "x.d/00001.csv", "rows": 3}, {"name": "x.d/00002.csv", "rows": 2}]}) == [("00001.csv", 0), ("00002.csv", 3)]
