"""Files written by tasks: whole, in order, read back, and nothing left of what failed."""

import csv
import json
import os
import re
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leadloom.operators import audit, export
from leadloom.sources import exports

AT = datetime(2024, 5, 6, 7, 8, 9, 123000)


def rows_of(spark, n, parts=None):
    df = spark.range(n).select(F.lit("a").alias("x"), (F.col("id") * 7919 % 1009).alias("k"), F.when(F.col("id") % 3 == 0, 'q"u,o\nté').otherwise(F.lit(None)).alias("text"), F.col("id"))
    return (df.repartitionByRange(parts, "k", "id").sortWithinPartitions("k", "id") if parts else df.orderBy("k", "id")).select("id", "text")


def want(n):
    return [(i, 'q"u,o\nté' if i % 3 == 0 else None) for i in sorted(range(n), key=lambda i: (i * 7919 % 1009, i))]


def sheet(path):
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        rows = re.findall(r"<row>(.*?)</row>", z.read("xl/worksheets/sheet1.xml").decode(), re.S)
    return [re.findall(r'preserve">(.*?)</t>', r, re.S) for r in rows]


@pytest.mark.parametrize("kind", ["csv", "json", "xlsx"])
@pytest.mark.parametrize(("n", "parts", "most"), [(50, None, 10**6), (500, 4, 10**6), (500, 3, 60), (0, None, 10)])
def test_read_back(spark, tmp_path, kind, n, parts, most):
    done = exports.save(rows_of(spark, n, parts), str(tmp_path), "e", kind, most)
    files = [tmp_path / f["name"] for f in done["files"]]
    assert done["rows"] == n and all(f["rows"] <= most for f in done["files"]) and len(files) == (1 if n <= 50 else 4 if most > 500 else len(files))
    assert sorted(os.listdir(tmp_path)) == sorted({exports.MANIFESTS, exports.TEMPORARY, done["path"]}) and not os.listdir(tmp_path / exports.TEMPORARY)
    got = []
    for f in files:
        if kind == "json":
            got += [(r["id"], r["text"]) for r in json.loads(f.read_text())]
        elif kind == "csv":
            head, *rest = csv.reader(f.open(newline=""))
            assert head == ["id", "text"]
            got += [(int(i), t or None) for i, t in rest]
        else:
            head, *rest = sheet(f)
            assert head == ["id", "text"]
            got += [(int(i), t or None) for i, t in rest]
    assert got == want(n)
    with pytest.raises(FileExistsError):
        exports.save(rows_of(spark, 5), str(tmp_path), "e", kind)


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    df = rows_of(spark, 200, 4).withColumn("text", F.when(F.col("id") == 150, F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        exports.save(df, str(tmp_path), "e", "csv")
    left = [os.path.join(d, f) for d, _, fs in os.walk(tmp_path) for f in fs]
    assert left == []
    assert exports.save(rows_of(spark, 20), str(tmp_path), "e", "csv")["rows"] == 20


def test_unknown_kind(spark, tmp_path):
    with pytest.raises(ValueError, match="PDF"):
        exports.save(rows_of(spark, 1), str(tmp_path), "e", "pdf")


def test_ledger_counts_what_was_written(spark, tmp_path):
    from tests.test_operators import crm_leads

    path, ledger = export.write_logged(export.crm_rows(crm_leads(spark)), "CSV", f"file://{tmp_path}", "{}", "u", AT)
    row = ledger.first()
    assert path == row["storedPath"] and path.endswith("leads_2024-05-06T07-08-09-123Z.csv") and row["leadCount"] == 5 == spark.read.csv(path, header=True, multiLine=True, escape='"').count()


def test_crops(spark, tmp_path):
    crops = spark.createDataFrame([("u", 0, 0, "data:image/png;base64,aGVsbG8="), ("u", 0, 1, "not base64!"), ("u", 1, 0, None), ("v", 0, 0, "d29ybGQ=")], "uploadId string, pageIndex int, cardIndex int, data string")
    for run in ("r1", "r2"):  # again: the same files
        found, n = audit.save_crops(crops, str(tmp_path), run)
        assert n == 2 and {r["cropPath"].rsplit("/", 1)[-1] for r in found.collect()} == {"u_p0_c0.jpg", "v_p0_c0.jpg", ""}
        assert (tmp_path / "u_p0_c0.jpg").read_bytes() == b"hello" and (tmp_path / "v_p0_c0.jpg").read_bytes() == b"world"
        assert sorted(os.listdir(tmp_path)) == sorted([exports.MANIFESTS, exports.TEMPORARY, "u_p0_c0.jpg", "v_p0_c0.jpg"]) and not os.listdir(tmp_path / exports.TEMPORARY)
