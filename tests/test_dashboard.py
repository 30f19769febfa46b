"""Dashboard and reports as one row, with one scan a table."""

import contextlib
import io
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leadloom.operators import analytics

LEADS = "status string, deletedAt timestamp_ntz, scannedAt timestamp_ntz, city string, state string, email string, phonePrimary string, gstin string"


@pytest.fixture
def tables(spark, tmp_path):
    at = lambda d: datetime(2024, 1, d)
    rows = [("APPROVED", None, at(1), "Pune", "", "e", None, None), ("APPROVED", at(2), at(1), "Goa", None, None, "p", None), ("PENDING_REVIEW", None, at(3), "Pune", "MH", "", None, "g"), ("REJECTED", None, None, None, "KA", None, None, None), ("REJECTED", None, at(3), "Agra", "KA", None, None, None)]
    made = {
        "leads": (rows, LEADS), "uploads": ([(1, "DONE", at(1)), (2, "DONE", at(2)), (3, "FAILED", at(2))], "id int, status string, createdAt timestamp_ntz"), "cards": ([(1,), (2,), (3,)], "id int"), "results": ([(1,)], "id int"),
        "companies": ([("Steel",), (None,), ("Steel",), ("",), ("Auto",)], "industry string"), "pairs": ([("OPEN",), ("MERGED",), ("OPEN",)], "status string"), "exports": ([(1, "CSV", at(1))], "id int, format string, createdAt timestamp_ntz"), "log": ([(1, at(1))], "id int, createdAt timestamp_ntz"),
    }
    for name, (data, schema) in made.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}")
    return {name: spark.read.parquet(f"{tmp_path}/{name}") for name in made}


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue().split("\n\n\n")[0]


def test_dashboard(tables):
    t = tables
    found = analytics.dashboard(t["uploads"], t["cards"], t["results"], t["leads"], t["companies"], t["pairs"], t["exports"], t["log"])
    row = found["summary"].first().asDict(recursive=True)
    assert row == {
        "topIndustries": [{"label": "Steel", "count": 2}, {"label": "Auto", "count": 1}], "topCities": [{"label": "Pune", "count": 2}, {"label": "Agra", "count": 1}], "topStates": [{"label": "KA", "count": 2}, {"label": "MH", "count": 1}],
        "totalFiles": 3, "cardsDetected": 3, "cardsProcessed": 1, "leadsCreated": 4, "approved": 1, "duplicatesFound": 2, "exportCount": 1, "successRate": 33.3,
    }
    assert [r["id"] for r in found["recentImports"].collect()] == [2, 3, 1] and found["recentActivity"].count() == 1


def test_reports(tables):
    t = tables
    made = analytics.reports(t["uploads"], t["leads"], t["companies"], t["pairs"], t["exports"])
    row = made.first().asDict(recursive=True)
    assert row["leadAcquisition"] == [{"label": "2024-01-03", "count": 2}, {"label": "2024-01-01", "count": 2}, {"label": None, "count": 1}]
    assert row["cityDistribution"] == [{"label": "Pune", "count": 2}, {"label": "Agra", "count": 1}, {"label": "Goa", "count": 1}] and row["stateDistribution"][0] == {"label": "KA", "count": 2}
    assert row["crmReadiness"] == {"total": 5, "approved": 2, "approvedPct": 40.0} and row["dataQuality"] == {"withEmailPct": 40.0, "withPhonePct": 20.0, "withGstinPct": 20.0}
    assert row["duplicateAnalysis"] == [{"label": "OPEN", "count": 2}, {"label": "MERGED", "count": 1}] and row["exportStatistics"] == [{"label": "CSV", "count": 1}]


def test_one_scan_a_table(tables):
    t = tables
    shown = plan(analytics.reports(t["uploads"], t["leads"], t["companies"], t["pairs"], t["exports"]))
    tree = shown.split("\n\n")[0]
    assert tree.count("Scan parquet") == 5 and "CartesianProduct" not in tree and "NestedLoop" not in tree


def test_empty_tables(tables):
    t = {k: v.where(F.lit(False)) for k, v in tables.items()}
    row = analytics.dashboard(t["uploads"], t["cards"], t["results"], t["leads"], t["companies"], t["pairs"], t["exports"], t["log"])["summary"].first()
    assert row["topCities"] == [] and row["leadsCreated"] == 0 and row["cardsDetected"] == 0
    assert analytics.reports(t["uploads"], t["leads"], t["companies"], t["pairs"], t["exports"]).first()["crmReadiness"]["total"] == 0
