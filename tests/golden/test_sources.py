"""Sources and sinks on files."""

from pyspark.sql import types as T

from gradeloom.sources import tables as S


def test_card_files(spark, tmp_path):
    text = '"wo""rd","de\nfinition",noun,ex,t\nplain,meaning\n,none\n' + "x" * 201 + ",long\n"
    (tmp_path / "c.csv").write_text("﻿" + text)
    good, bad = S.card_file(spark, str(tmp_path / "c.csv"))
    assert {r["word"] for r in good.collect()} == {'wo"rd', "plain"}
    assert {r["reason"] for r in bad.collect()} == {"no_word", "long_word"}
    (tmp_path / "t.tsv").write_text("a, b\tmeaning\nc\td\n")
    assert {(r["word"], r["definition"]) for r in S.card_file(spark, str(tmp_path / "t.tsv"))[0].collect()} == {("a, b", "meaning"), ("c", "d")}


def test_page_dumps_artifacts_and_reports(spark, tmp_path):
    (tmp_path / "doc.txt").write_text("head\n===== PAGE 1 =====\nOne\ntwo\n===== PAGE 2 =====\n\n Three \n")
    pages = S.page_dumps(spark, str(tmp_path / "doc.txt"))
    assert [(r["import_id"], r["page_number"]) for r in pages.orderBy("page_number").collect()] == [("doc", 1), ("doc", 2)]
    assert [(r["line_no"], r["line"]) for r in S.lines(pages.filter("page_number = 1"), ["import_id", "page_number"]).collect()] == [(0, "One"), (1, "two")]
    (tmp_path / "run.json").write_text('{"questions": [{"id": "q1", "answer": "A"}, {"id": "q2"}]}')
    row = T.StructType().add("id", "string").add("answer", "string")
    rows = S.json_artifact(spark, str(tmp_path / "run.json"), T.StructType().add("questions", T.ArrayType(row)), "questions")
    assert {(r["id"], r["answer"]) for r in rows.collect()} == {("q1", "A"), ("q2", None)}
    S.write_report(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
