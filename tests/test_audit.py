"""The log and cropped images."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leadloom.operators import audit


def test_audit(spark):
    rows = audit.audit_rows(spark.range(3), "LEAD_APPROVE", "Lead", "u", datetime(2024, 1, 1))
    assert rows.select("id").distinct().count() == 3 and rows.first()["action"] == "LEAD_APPROVE"
    with pytest.raises(ValueError):
        audit.audit_rows(spark.range(1), "NOPE", "Lead", "u", datetime(2024, 1, 1))


def test_crops(spark):
    df = spark.createDataFrame([("data:image/png;base64,YWI=",), ("YWI=",), ("",), ("?",), (None,)], "d string")
    assert [r["b"] and bytes(r["b"]) for r in df.select(audit.crop_bytes(F.col("d")).alias("b")).collect()] == [b"ab", b"ab", None, None, None]
    assert df.select(audit.crop_path(F.lit("u"), F.lit(1), F.lit(2)).alias("p")).first()["p"] == "u_p1_c2.jpg"
