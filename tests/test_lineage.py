"""The lineage record holds the drivers, score, templates and narrative of its alert."""
import json

import __spark_entry__ as E
from driftwatch.operators import reports as RP

SF = "/root/testdata/sf0.001"


def test_templates_of_a_typology_come_first(spark):
    df = spark.createDataFrame([("structuring",), ("crypto_laundering",), ("structuring",)], "alert_type string")
    got = {r["alert_type"]: r["templates_retrieved"] for r in RP.typology_templates(df).collect()}
    assert set(got) == {"structuring", "crypto_laundering"}
    assert all(len(t) == 2 and t[0]["typology"] == name for name, t in got.items())
    assert got["structuring"][0]["template_id"] == list(RP.HOW_TEXT).index("structuring")


def test_lineage_has_every_step(spark):
    q = E.queries()
    rows = {r["alert_id"]: json.loads(r["audit_json"]) for r in q["u06_lineage"](spark, SF).collect()}
    alerts = {r["alert_id"]: r for r in q["a01_create_alerts"](spark, SF).collect()}
    drivers, scores = {}, {r["customer_id"]: r["risk_score"] for r in q["f08_risk_scores"](spark, SF).collect()}
    for r in q["f11_attributions"](spark, SF).collect():
        drivers.setdefault(r["customer_id"], {})[r["rank"]] = r["feature"]
    texts = {r["alert_id"]: r["narrative"] for r in q["n01_template_narratives"](spark, SF).collect()}
    assert set(rows) == set(alerts) and rows
    for i, a in rows.items():
        c = alerts[i]["customer_id"]
        assert [d["feature"] for d in a["shap_top_features"]] == [drivers[c][k] for k in range(1, 6)]
        assert abs(a["risk_score"] - scores[c]) < 1e-5 and a["customer_id"] == c
        assert len(a["templates_retrieved"]) == 2
        if a["typology_detected"] in RP.HOW_TEXT:
            assert a["templates_retrieved"][0]["typology"] == a["typology_detected"]
        assert a["narrative"] == texts[i] and a["narrative_word_count"] == len(texts[i].split())
        assert a["bsi_score"] is not None and a["status"] == "draft" and a["reviewed_by"] is None


def test_attributions_add_up_to_the_margin(spark):
    rows = E.queries()["f11_additivity"](spark, SF).collect()
    assert rows and all(r["abs_error"] < 1e-9 for r in rows)
