"""Sources, sinks and coverage goldens."""

import json

from pyspark.sql import functions as F

from slicekit.config import PILOT
from slicekit.operators import slices as S
from slicekit.sources import jsonl as IO
from slicekit.sources import sinks as SK

SCHEMA = "id string, dataset string, tags struct<linguistic_phenomena: array<string>>"


def test_read_items_jsonl_missing_blank_and_unicode(spark, tmp_path):
    assert IO.read_items_jsonl(spark, str(tmp_path / "absent"), SCHEMA).count() == 0
    p = tmp_path / "r.jsonl"
    p.write_text('{"id": "a", "dataset": "indoqa", "tags": {"linguistic_phenomena": ["passive"]}}\n\n'
                 '{"id": "ü-2", "dataset": "squad_sw"}\n', encoding="utf-8")
    rows = {r.id: r for r in IO.read_items_jsonl(spark, str(p), SCHEMA).collect()}
    assert rows["a"].tags.linguistic_phenomena == ["passive"]
    assert rows["ü-2"].tags is None  # absent key -> null -> "not done yet"


def test_write_items_jsonl_omits_absent_fields(spark, tmp_path):
    df = spark.createDataFrame([("x", None, None), ("y", "indoqa", None)], SCHEMA)
    out = IO.write_items_jsonl(df, str(tmp_path / "out"))
    lines = [json.loads(line) for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()
             if line.strip()]
    assert {"id": "x"} in lines and {"id": "y", "dataset": "indoqa"} in lines
    assert IO.read_items_jsonl(spark, out, SCHEMA).count() == 2


def test_read_json_array(spark, tmp_path):
    p = tmp_path / "arr.json"
    p.write_text(json.dumps([{"question": "q1", "answer": "a", "category": None},
                             {"question": "q2", "answer": "", "category": "UNANSWERABLE"}]), encoding="utf-8")
    df = IO.read_json_array(spark, str(p), "question string, answer string, category string")
    assert [r.question for r in df.orderBy("question").collect()] == ["q1", "q2"]


def test_report_tables_long(spark):
    a = spark.createDataFrame([("d", 1, 2.5)], "k string, n int, acc double")
    out = SK.report_tables({"acc": (a, ["k"])}).collect()
    assert {(r.section, r.row_key, r.column, r.value) for r in out} == {("acc", "d", "n", 1.0), ("acc", "d", "acc", 2.5)}


def test_coverage_golden_swahili_native(spark):
    # Fixed values from the published coverage report (TyDi QA Swahili, n = 496):
    # concord 231 (46.6 %), applicative 0, passive 11 (2.2 %), locative_ni 63 (12.7 %), none 197 (39.7 %);
    # literal 118 (23.8 %), paraphrase 305 (61.5 %), inference 73 (14.7 %);
    # history 95 (19.2 %), geography 75 (15.1 %), general 326 (65.7 %).
    rows = []
    for i in range(496):
        ph = []
        if i < 231:
            ph.append("noun_class_concord")
        if 225 <= i < 236:
            ph.append("passive")
        if 236 <= i < 299:
            ph.append("locative_ni")
        para = "literal_match" if i < 118 else ("paraphrase" if i < 423 else "requires_inference")
        dom = "east_african_history" if i < 95 else ("east_african_geography" if i < 170 else "general")
        rows.append((f"t{i}", "sw", "tydiqa_sw", (ph, para, dom)))
    items = spark.createDataFrame(rows, "id string, lang string, dataset string, tags struct<linguistic_phenomena: "
                                        "array<string>, paraphrase_distance: string, domain: string>")
    cov = S.coverage(items, PILOT)
    long = {(r.facet, r.value): (r["count"], round(r.pct, 1)) for r in S.coverage_pct(cov, PILOT).collect()}
    assert long[("phenomenon", "noun_class_concord")] == (231, 46.6)
    assert long[("phenomenon", "applicative")] == (0, 0.0)
    assert long[("phenomenon", "passive")] == (11, 2.2)
    assert long[("phenomenon", "locative_ni")] == (63, 12.7)
    assert long[("phenomenon", "none")] == (197, 39.7)
    assert long[("paraphrase", "paraphrase")] == (305, 61.5)
    assert long[("domain", "general")] == (326, 65.7)
    assert ("phenomenon", "voice_meN") not in long  # other language's vocabulary is not reported
    assert cov.filter(F.col("dataset") == "squad_sw").count() == 0  # absent dataset -> no row
