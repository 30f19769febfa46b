"""Golden texts for extraction, validation and geography."""

import pytest

from leadloom.functions.extract import extract_entities
from leadloom.functions.validate import final_leads, validate_leads

TEXTS = {
    1: "CNC Machining Pvt Ltd\nPrecision Machining\ninfo@cncparts.com\n+91 9876543210",
    2: "Hello World Corp\njohn@example.com\n+1 555 1234",
    3: "SHARMA TOOLING\nRavi Sharma\nSales Manager\nravi.sharma@sharmatools.in\n+91 98765 43210\nMIDC Bhosari, Pune 411026\nGSTIN 27ABCDE1234F1Z5",
    4: "Acme Ltd\n98765 43210\n9876543210",
    5: "Plot 4 Pune 411026\n9876543210",
    6: "Victor Mehta\nNicole Cooper\nAsha Rao\nHead of Finance\nasha@x.com",
    7: None,
    8: "Tel 9876543210, M 98765 43210",
    9: "Jane Doe\nCEO\nJohn.Doe@Acme.co.in\nwww.acme.co.in\nin/janedoe",
    10: "Ltd 1.5 window cleaning",
}
EXPECTED = {
    1: dict(companyName="CNC Machining Pvt Ltd", website="cncparts.com", twitter="@cncparts", phonePrimary="+91 9876543210", industry="Precision Machining", country="India", aiConfidence=0.872),
    2: dict(companyName="Hello World Corp", website="example.com", twitter="@example", phonePrimary="+1 555 1234", industry=None, aiConfidence=0.8648),
    3: dict(companyName="SHARMA TOOLING", website="sharmatools.in", address="MIDC Bhosari, Pune 411026", postalCode="411026", gstin="27ABCDE1234F1Z5", industry="Tooling & Fixtures", city="Pune", state="Maharashtra", country="India", aiConfidence=0.9629),
    4: dict(companyName="Acme Ltd", phonePrimary="98765 43210\n9876", phoneSecondary=None, aiConfidence=0.86),
    5: dict(companyName="9876543210", phonePrimary="411026\n987654321", address="Plot 4 Pune 411026", postalCode="411026", aiConfidence=0.844),
    6: dict(companyName=None, twitter=None, email="asha@x.com", aiConfidence=0.868),
    7: dict(companyName=None, email=None, phonePrimary=None, aiConfidence=0.0),
    8: dict(phonePrimary=None, aiConfidence=0.0),
    9: dict(companyName="John.Doe@Acme.co.in", website="John.Doe", linkedin="in/janedoe", twitter="@Acme", aiConfidence=0.9611),
    10: dict(website="1.5", industry="Energy & Power", aiConfidence=0.82),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame(list(TEXTS.items()), "id int, rawText string")
    return {r["id"]: r for r in final_leads(validate_leads(extract_entities(rows))).collect()}


@pytest.mark.parametrize("k", TEXTS)
def test_golden(found, k):
    got = found[k].asDict()
    assert {c: got[c] for c in EXPECTED[k]} == EXPECTED[k]


def test_contacts(found):
    people = [c.asDict() for c in found[3]["contacts"]]
    assert [(p["fullName"], p["designation"], p["department"], p["isPrimary"]) for p in people] == [("SHARMA TOOLING", None, None, True), ("Ravi Sharma", "Sales Manager", "sales", False)]
    assert people[0]["email"] == "ravi.sharma@sharmatools.in" and people[1]["email"] is None
    assert [(p["fullName"], p["designation"], p["department"]) for p in (c.asDict() for c in found[6]["contacts"])] == [("Asha Rao", "Head of Finance", "finance")]
    assert [p["fullName"] for p in found[7]["contacts"]] == [None] and found[7]["contacts"][0]["isPrimary"]
