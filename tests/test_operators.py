"""Small tables for the rules of duplicates, exports, cards, changes, files and streams."""

import io
import json
import re
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leadloom.functions.text import ratio_pct
from leadloom.operators import analytics, cards, companies, dedup, export, leads
from leadloom.sources import exports, files, responses
from leadloom.streaming import ingest

LEADS = [
    ("a", "x@y.com", "+91 98765 43210", "Acme Tools Pvt Ltd", "Pune"), ("b", " X@Y.com ", None, "Zeta", "Delhi"), ("c", None, "098765-43210", "Other", "Goa"), ("d", None, None, "Acme Tool Ltd", "Pune"),
    ("e", None, None, None, "Surat"), ("f", None, None, "", "surat"), ("g", "  ", None, "Solo", "X"), ("h", "q@q.com", "12345678", "Acme Tools", ""),
]


@pytest.fixture(scope="module")
def dup_input(spark):
    return spark.createDataFrame(LEADS, "id string, email string, phonePrimary string, companyName string, city string")


def test_duplicates(dup_input):
    assert dedup.candidate_pairs(dup_input).count() == 19
    found = {(r["leadAId"], r["leadBId"]): (r["score"], r["reasons"]) for r in dedup.find_duplicates(dup_input).collect()}
    assert found == {
        ("a", "b"): (0.95, ["Identical email"]), ("a", "c"): (0.9, ["Identical phone"]), ("a", "d"): (0.933, ["Company match (88%)", "Same city"]), ("e", "f"): (1.0, ["Company match (100%)", "Same city"]),
    }


def test_blank_blocks_match_all_pairs(spark):
    rows = [(f"{k:03d}", [None, "", "  ", "m@x.co"][k % 4], [None, "1234567890", ""][k % 3], [None, "Acme Tools", "Acme Toolx", "B", ""][k % 5], [None, "Pune", "Puna", "Goa"][k % 7 % 4]) for k in range(60)]
    df = spark.createDataFrame(rows, "id string, email string, phonePrimary string, companyName string, city string")
    keyed = dedup.keyed(df)
    every = dedup._scored(dedup.candidate_pairs(df).join(keyed.alias("a"), F.col("leadAId") == F.col("a.id")).join(keyed.alias("b"), F.col("leadBId") == F.col("b.id")))
    want = {(r["leadAId"], r["leadBId"], r["score"]) for r in every.where(F.col("score") >= 0.7).collect()}
    assert {(r["leadAId"], r["leadBId"], r["score"]) for r in dedup.find_duplicates(df).collect()} == want and want


def test_scan_keeps_dismissed(dup_input, spark):
    live = dup_input.withColumns({"deletedAt": F.lit(None).cast("timestamp_ntz"), "status": F.lit("APPROVED")})
    known = spark.createDataFrame([("a", "b", 0.1, ["old"], "DISMISSED"), ("x", "y", 0.8, ["gone"], "OPEN")], "leadAId string, leadBId string, score double, reasons array<string>, status string")
    once = dedup.scan(live, known)
    twice = dedup.scan(live, once)
    got = {(r["leadAId"], r["leadBId"]): (r["score"], r["status"]) for r in twice.collect()}
    assert got[("a", "b")] == (0.95, "DISMISSED") and got[("x", "y")] == (0.8, "OPEN") and len(got) == 5
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_merge(spark):
    at = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("k", None, "Pune", "APPROVED", None, None), ("g", "e@x.co", "Goa", "APPROVED", None, None)], "id string, email string, city string, status string, mergedIntoId string, deletedAt timestamp_ntz")
    merges = spark.createDataFrame([("k", "g")], "keepId string, goneId string")
    got = {r["id"]: r for r in dedup.merge_leads(rows, merges, at).collect()}
    assert (got["k"]["email"], got["k"]["city"], got["k"]["status"]) == ("e@x.co", "Pune", "APPROVED")
    assert (got["g"]["status"], got["g"]["mergedIntoId"], got["g"]["deletedAt"]) == ("MERGED", "k", at)
    people = spark.createDataFrame([("1", "k", "A@x.co", "1", True), ("2", "g", "a@x.co", "1", True), ("3", "g", None, "", True), ("4", "g", "b@x.co", "", True), ("5", "g", "B@x.co", "", False)], "id string, leadId string, email string, mobile string, isPrimary boolean").withColumns({"phone": F.lit(None).cast("string"), "createdAt": F.lit(at).cast("timestamp_ntz")})
    assert [(r["id"], r["leadId"], r["isPrimary"]) for r in dedup.merge_contacts(people, merges).collect()] == [("4", "k", False)]
    pairs = spark.createDataFrame([("g", "k", "OPEN"), ("x", "y", "OPEN")], "leadAId string, leadBId string, status string")
    assert {r["leadAId"]: r["status"] for r in dedup.merged_pairs(pairs, merges).collect()} == {"g": "MERGED", "x": "OPEN"}


CONTACT = "array<struct<fullName:string,designation:string,department:string,email:string,mobile:string,phone:string,isPrimary:boolean>>"


def crm_leads(spark):
    rows = [
        ("1", "A, \"Q\"\nCo", [("P", None, None, "p@x", None, None, False), ("Q", None, None, None, "9", None, False)]),
        ("2", None, [("R", None, None, "", None, None, True), ("S", None, None, None, None, None, True)]),
        ("3", "", None),
    ]
    df = spark.createDataFrame(rows, f"id string, companyName string, contacts {CONTACT}")
    blank = [c for c in ("website", "email", "phonePrimary", "phoneSecondary", "industry", "city", "state", "gstin", "address", "country", "postalCode", "linkedin")]
    co = F.struct(*(F.lit("C" if c == "name" else "").alias(c) for c in ("name", "website", "industry", "city", "state", "gstin", "country", "postalCode")))
    return df.withColumns({c: F.lit(None).cast("string") for c in blank} | {"company": co, "source": F.lit("fair"), "createdAt": F.lit(datetime(2024, 1, 31, 23, 59, 59)).cast("timestamp_ntz"), "updatedAt": F.lit(None).cast("timestamp_ntz")})


def test_crm_rows(spark, tmp_path):
    rows = export.crm_rows(crm_leads(spark), branch_by_source={"fair": "West"})
    got = [(r["leadId"], r["pos"], r["Company Name"], r["Contact Person"], r["Email"], r["Mobile"], r["Sales Branch"]) for r in rows.orderBy("leadId", "pos").collect()]
    odd = "A, \"Q\"\nCo"
    assert got == [("1", 0, odd, "P", "p@x", "", "West"), ("1", 1, odd, "P", "p@x", "", "West"), ("1", 2, odd, "Q", "", "9", "West"), ("2", 0, "C", "R", "", "", "West"), ("3", 0, "C", "", "", "", "West")]
    at = datetime(2024, 5, 6, 7, 8, 9, 10000)
    path = export.write(rows, "CSV", str(tmp_path), at)
    assert path.endswith("leads_2024-05-06T07-08-09-010Z.csv")
    back = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    assert back.columns == list(rows.columns[2:]) and back.count() == 5 and back.where(F.col("Company Name") == odd).count() == 3
    with pytest.raises(Exception, match="exists"):
        export.write(rows, "CSV", str(tmp_path), at)
    with pytest.raises(ValueError):
        export.write(rows, "PDF", str(tmp_path), at)
    assert spark.read.json(export.write(rows, "JSON", str(tmp_path), at), multiLine=True).count() == 5
    book = zipfile.ZipFile(export.write(rows, "XLSX", str(tmp_path), at))
    sheet = book.read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row>") == 6 and "SAP Customer Code" in sheet and "&quot;" not in re.sub("<[^>]*>", "", sheet)
    assert export.ledger_row(rows, "CSV", path, "{}", "u", at).first()["leadCount"] == 5


def test_xlsx_is_streamed():
    out = io.BytesIO()
    assert exports.xlsx(out, ["a"], ((f"<{k}>",) for k in range(3))) == 3
    assert "&lt;2&gt;" in zipfile.ZipFile(out).read("xl/worksheets/sheet1.xml").decode()


def test_boundaries(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 31, 23, 59, 59, 999000)), (2, datetime(2024, 2, 1))], "id int, at timestamp_ntz")
    assert [r["id"] for r in rows.where(leads.between("at", None, "2024-01-31")).collect()] == [1]
    as_of = datetime(2024, 3, 1)
    old = spark.createDataFrame([(1, as_of - timedelta(days=30)), (2, as_of - timedelta(days=30, seconds=1)), (3, None)], "id int, deletedAt timestamp_ntz")
    assert [r["id"] for r in old.where(leads.purge_test(as_of)).collect()] == [2]
    assert spark.range(1).select(ratio_pct(F.lit(1), F.lit(0)).alias("x")).first()["x"] == 0
    assert leads.page(spark.range(500), [F.col("id")], skip=10, take=1000).count() == 200


def test_changes(spark):
    rows = spark.createDataFrame([("1", "A", "PENDING_REVIEW", None, None, None), ("2", "B", "APPROVED", None, None, None)], "id string, companyName string, status string, reviewedById string, reviewedAt timestamp_ntz, deletedAt timestamp_ntz")
    at = datetime(2024, 1, 1)
    assert {r["id"]: r["status"] for r in leads.reject(rows, ["1"], "u", at).collect()} == {"1": "REJECTED", "2": "APPROVED"}
    assert leads.restore(leads.trash(rows, ["1", "2"], at), ["1"]).where("deletedAt is null").count() == 1
    assert leads.edit(rows, "1", {"companyName": "Z", "status": "HACK"}).orderBy("id").first()["companyName"] == "Z"
    assert leads.edit(rows, "1", {"status": "HACK"}).where("status = 'HACK'").isEmpty()
    kids = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, leadId string")
    assert sorted(r["id"] for r in leads.replace_children(kids, "leadId", "1", spark.createDataFrame([("c", "1")], kids.schema)).collect()) == ["b", "c"]


def test_companies(spark):
    rows = spark.createDataFrame([(1, "Acme", "http://www.a.co/x", "", "P1"), (2, "ACME!", "http://www.a.co/y", "Pune", "P2"), (3, "acme", "a.co", None, None), (4, "", "b.co", "Goa", None)], "id int, companyName string, website string, city string, postalCode string").withColumns({c: F.lit(None).cast("string") for c in ("gstin", "industry", "state", "country")})
    got = companies.companies_of(rows).collect()
    assert [(r["normalizedKey"], r["name"], r["domain"], r["city"], r["website"], r["postalCode"]) for r in got] == [("acme::a.co", "Acme", "a.co", "Pune", "a.co", "P1")]


def test_cards(spark):
    r = spark.range(1)
    res = lambda c, ok: F.struct(F.lit("t").alias("text"), F.lit(c).alias("confidence"), F.lit(ok).alias("available"))
    choose = lambda a, b: r.select(cards.choose_engine(a, b).alias("x")).first()["x"]["chosenEngine"]
    assert choose(res(0.85, True), res(0.99, True)) == "PADDLEOCR"
    assert choose(res(0.84, True), res(0.84, True)) == "PADDLEOCR"
    assert choose(res(0.5, True), res(0.6, True)) == "TESSERACT"
    assert choose(res(0.99, False), res(0.1, True)) == "TESSERACT"
    assert r.select(cards.choose_engine(res(0.9, False), res(0.9, False)).alias("x")).first()["x"].asDict() == {"chosenEngine": "PADDLEOCR", "rawText": "", "confidence": 0.0}
    assert r.select(cards.is_card(F.lit(30), F.lit(100), F.lit(10), F.lit(0)).alias("x")).first()["x"] is False
    boxes = spark.sql("select array(named_struct('x',0,'y',0,'w',10,'h',10), named_struct('x',1,'y',1,'w',8,'h',8), named_struct('x',50,'y',0,'w',5,'h',5)) b")
    assert [b["x"] for b in boxes.select(cards.suppressed(F.col("b")).alias("k")).first()["k"]] == [0, 50]


def test_sources(spark, tmp_path):
    for name in ("a.jpg", "b.txt", "c.PDF"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r["originalName"] for r in files.uploads(spark, str(tmp_path)).collect()) == ["a.jpg", "c.PDF"]
    assert spark.range(1).select(files.stored_name(F.lit("é x-1.png"), F.lit(5)).alias("n")).first()["n"] == "5___x-1.png"
    text = json.dumps({"pages": 1, "cards": [{"pageIndex": 0, "cardIndex": 1, "bbox": [1, 2, 3, 4], "ocr": {"chosenEngine": "TESSERACT", "rawText": "Acme Ltd", "confidence": 0.5}}]})
    row = responses.explode_ocr(spark.createDataFrame([("u", text)], "uploadId string, response string")).first()
    assert (row["bbox"]["w"], row["rawText"], row["chosenEngine"], row["rotationApplied"]) == (3, "Acme Ltd", "TESSERACT", 0.0)


def test_stream(spark, tmp_path):
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    ocr = json.dumps({"pages": 1, "cards": [{"pageIndex": 0, "cardIndex": 0, "bbox": [1, 2, 3, 4], "ocr": {"chosenEngine": "TESSERACT", "rawText": "Acme Ltd\njo@acme.co", "confidence": 0.5}}]})
    vision = json.dumps({"cards": [{"company": "Acme", "contacts": [{"name": "Jo", "email": "jo@acme.co", "isPrimary": True}], "confidence": 90}]})
    (inbox / "1.json").write_text("\n".join(json.dumps({"uploadId": u, "engine": e, "response": r, "createdAt": "2024-01-01T00:00:00"}) for u, e, r in (("u1", "ocr", ocr), ("u2", "vision", vision))))
    for _ in range(2):  # a second run finds nothing new
        ingest.start(spark, str(inbox), str(out), str(tmp_path / "cp"), index=str(tmp_path / "keys"), pairs_path=str(tmp_path / "pairs")).awaitTermination()
    found = [tuple(r) for r in spark.read.parquet(str(tmp_path / "pairs")).select("leadAId", "leadBId", "score").collect()]
    assert len(found) == 1 and found[0][2] == 0.95 and spark.read.parquet(f"{out}_quarantine").count() == 0
    made = spark.read.parquet(str(out))
    assert {(r["uploadId"], r["companyName"], r["email"]) for r in made.collect()} == {("u1", "Acme Ltd", "jo@acme.co"), ("u2", "Acme", "jo@acme.co")}
    pairs = ingest.duplicates_of_new(made.where("uploadId = 'u2'"), made).collect()
    assert len(pairs) == 1 and pairs[0]["score"] == 0.95


def test_with_contacts_and_windows(spark):
    people = spark.createDataFrame([("c2", "1", "B"), ("c1", "1", "A")], "id string, leadId string, fullName string").withColumn("createdAt", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz"))
    got = leads.with_contacts(spark.createDataFrame([("1",), ("2",)], "id string"), people).orderBy("id").collect()
    assert [c["fullName"] for c in got[0]["contacts"]] == ["A", "B"] and got[1]["contacts"] is None
