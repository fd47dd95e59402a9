"""Workbooks written and read again, workbooks as other programs write them, and what a failed job leaves."""

import os
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sampling, validation
from tidemark.sources import tables, workbook


def test_round_trip(spark, tmp_path):
    rows = [(i, f"text {i} <&> \"q\" ü日😀", 1.5 * i if i % 3 else None, i % 2 == 0, " leading\nline\ttab ", date(2024, 2, 29), datetime(2024, 1, 2, 3, 4, 5), None) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, t string, x double, b boolean, `s p` string, d date, ts timestamp, empty string").repartition(4)
    workbook.write_workbooks(df, f"file://{tmp_path}/out")
    assert len([f for f in os.listdir(tmp_path / "out") if f.endswith(".xlsx")]) == 4 and not [f for f in os.listdir(tmp_path / "out") if "pending" in f]
    back = workbook.read_workbooks(spark, f"file://{tmp_path}/out", "id long, t string, x double, b boolean, `s p` string, d date, ts timestamp, empty string")
    assert sorted(back.collect()) == sorted(df.collect()) and back.schema == df.schema
    some = workbook.read_workbooks(spark, f"file://{tmp_path}/out/*.xlsx", "t string, id string")
    assert some.columns == ["t", "id"] and some.where("id = '7'").count() == 1


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    df = spark.range(100).repartition(4).withColumn("x", F.when(F.col("id") == 77, F.raise_error(F.lit("stop")).cast("int")).otherwise(1))
    with pytest.raises(Exception, match="stop"):
        workbook.write_workbooks(df, f"file://{tmp_path}/out")
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []


def test_sheets_of_other_programs(spark, tmp_path):
    """Shared and formatted strings, gaps, formulas, errors, booleans, dates by style, a second sheet."""
    m, r = workbook.MAIN, workbook.LINK
    sheet = f"""<worksheet xmlns="{m}"><sheetData>
      <row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>when</t></is></c><c r="E1" t="str"><v>flag</v></c></row>
      <row r="3"><c r="A3"><v>3</v></c><c r="B3" t="s"><v>2</v></c><c r="D3" s="1"><v>45351.5</v></c><c r="E3" t="b"><v>1</v></c></row>
      <row r="4"/><row r="5"><c r="A5"><f>1+1</f><v>2.25</v></c><c r="D5" s="2"><v>45351</v></c><c r="E5" t="e"><v>#N/A</v></c></row></sheetData></worksheet>"""
    other = f'<worksheet xmlns="{m}"><sheetData><row><c t="inlineStr"><is><t>id</t></is></c></row><row><c><v>9</v></c></row></sheetData></worksheet>'
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="First" sheetId="1" r:id="a"/><sheet name="Other" sheetId="2" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="a" Target="worksheets/one.xml"/><Relationship Id="b" Target="/xl/worksheets/two.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{m}"><si><t>id</t></si><si><t>note</t></si><si><r><t>bold </t></r><r><t>rest</t></r><rPh sb="0"><t>hint</t></rPh></si></sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{m}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="171" formatCode="0.0&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/one.xml": sheet, "xl/worksheets/two.xml": other,
    }
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    read = lambda schema, sheet=None: [tuple(x) for x in workbook.read_workbooks(spark, f"file://{tmp_path}/a.xlsx", schema, sheet).collect()]
    assert read("id double, note string, when string, flag boolean") == [(3.0, "bold rest", "2024-02-29 12:00:00", True), (2.25, None, "2024-02-29", None)]
    assert read("id long", "Other") == [(9,)]
    with pytest.raises(Exception, match="no column nothing"):
        read("id string, nothing string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read("note int")


def test_column_names():
    assert [workbook.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(workbook.column_number(f"{workbook.column_name(i)}7") == i for i in range(2000))


def test_scores_from_two_coder_sheets(spark, tmp_path):
    """Blinded sheets go out as workbooks, come back filled in, and give the evaluation set."""
    claims = spark.createDataFrame([(i, f"o/r{i % 3}", "t", f"p{i}", "s") for i in range(12)], "claim_seq long, full_name string, claim_type string, artifact_or_path string, snippet string")
    sheet = sampling.blinded(claims, ["full_name", "claim_type", "artifact_or_path", "snippet"])
    workbook.write_workbooks(sheet.coalesce(1), f"file://{tmp_path}/blank")
    blank = workbook.read_workbooks(spark, f"file://{tmp_path}/blank", tables.SCHEMAS["coder_sheet"])
    assert blank.count() == 12 and blank.where("coder_label is not null").count() == 0
    for name, label in (("a", "if(eval_id < 'EVAL_007', 'drifted', 'supported')"), ("b", "if(eval_id < 'EVAL_006', 'drifted', 'supported')")):
        workbook.write_workbooks(blank.withColumn("coder_label", F.expr(label)).coalesce(1), f"file://{tmp_path}/{name}")
    a, b = (workbook.read_workbooks(spark, f"file://{tmp_path}/{n}", tables.SCHEMAS["coder_sheet"]) for n in "ab")
    key = blank.select("eval_id", "full_name", F.lit("drifted").alias("stratum"), F.lit("kept").alias("status"), F.lit("drifted_high").alias("label_v4"))
    consensus = spark.createDataFrame([("EVAL_006", "not-a-claim")], "eval_id string, consensus_label string")
    labels = claims.select("full_name", "claim_type", "artifact_or_path", F.lit("supported").alias("label"))
    out = validation.evaluation_set(a, b, key, consensus, labels)
    assert {r["gold"]: r["count"] for r in out.groupBy("gold").count().collect()} == {"drifted": 5, "not-a-claim": 1, "supported": 6}
    assert validation.agreement(out, "A", "B").first()["accuracy"] == pytest.approx(11 / 12)
