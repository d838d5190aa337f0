"""Public names, stages one by one, reports and the look inside a mail."""

import json

from pyspark.sql import functions as F

import mailsieve
from mailsieve.crf.model import CrfModel, default_model_path
from mailsieve.plans import datagen, report, training
from mailsieve.plans.pipeline import extract
from mailsieve.sources.corpus import read_examples, write_failures

NAMES = """AnnotatedLine AssembledBody BodyAssembler CRFSequenceLabeler CRFTrainer EmailBodyExtractor ExtractionError ExtractionResult ExtractedFeatures FeatureExtractor
InvalidInputError Label LabeledLine LABELS LineFeatures LowConfidenceError NoBodyDetectedError NormalizedEmail Normalizer SequenceLabelingResult StructuralAnalysis StructuralAnalyzer
is_closing_line is_company_line is_contact_info_line is_greeting_line is_separator_line""".split()
MAIL = "田中様\n\nお世話になっております。\n本文です。\nよろしくお願いします。\n\n-----\n株式会社サンプル\nTEL: 03-1234-5678"


def test_names():
    assert all(getattr(mailsieve, n) is not None for n in NAMES)
    assert [x.value for x in mailsieve.Label] == list(mailsieve.LABELS)
    assert CrfModel.load(default_model_path()).labels == CrfModel.load().labels


def test_stages_do_what_extract_does(spark):
    df = spark.createDataFrame([(1, MAIL), (2, "   "), (3, None)], "i int, email_text string")
    out = mailsieve.Normalizer().transform(df)
    marked = mailsieve.StructuralAnalyzer().transform(out)
    assert marked.schema["marks"].dataType.elementType.fieldNames() == mailsieve.AnnotatedLine.fieldNames()
    labeled = mailsieve.CRFSequenceLabeler(CrfModel.load()).transform(mailsieve.FeatureExtractor().transform(out))
    got = {r.i: r for r in mailsieve.BodyAssembler().transform(labeled).collect()}
    want = {r.i: r for r in extract(df, CrfModel.load()).collect()}
    assert got[1].assembled.body_text == want[1].body and got[1].labeled_lines == want[1].labeled_lines and got[1].confidence == want[1].confidence
    assert got[2].lines == [] and got[2].labeled_lines == []


def test_reports(spark, tmp_path):
    examples = spark.createDataFrame(
        [
            (MAIL, [(t, "BODY", 0) for t in MAIL.split("\n")], ("formal", True, False, False)),
            ("短い。", [("短い。", "WRONG", 0)], ("short", False, False, False)),
            ("二行\nです", [("二行", "BODY", 0)], ("short", False, False, False)),
        ],
        read_examples.__globals__["EXAMPLE"].fields[0].name + " string, lines array<struct<text:string,label:string,quote_depth:int>>, metadata struct<template_type:string,has_signature:boolean,has_inline_quote:boolean,is_adversarial:boolean>",
    )
    assert {r.reason: r.n for r in report.rejections(examples).collect()} == {"usable": 1, "unknown label": 1, "line count": 1}
    judged = training.evaluate(examples.where("email_text <> '短い。'"), CrfModel.load()).withColumn("n", F.monotonically_increasing_id()).persist()
    tables = report.metrics(judged)
    assert tables["rates"].first().n_total == 2
    text = report.metrics_text(judged)
    assert "RATES" in text and "GROUPS" in text and "LABELS" in text
    bad = report.first_failures(judged, "n", 5)
    write_failures(bad, str(tmp_path / "failures"), order="n")
    numbers = [r.n for r in bad.collect()]
    assert numbers == sorted(numbers)


def test_inspected(spark):
    df = spark.createDataFrame([(7, MAIL)], "i int, email_text string")
    found = report.inspected(df, CrfModel.load(), "i")
    lines, features, marginals = (found[k].orderBy("idx").collect() for k in ("lines", "features", "marginals"))
    assert len(lines) == len(features) == len(marginals) == 7 and lines[0].text == "田中様" and lines[0].i == 7
    assert all(abs(sum(r[f"p_{y.lower()}"] for y in mailsieve.LABELS) - 1) < 1e-6 for r in marginals)
    assert found["result"].first().success


def test_limit_of_a_corpus(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(json.dumps({"email_text": str(i), "lines": []}) for i in range(5)), "utf-8")
    assert read_examples(spark, str(path), limit=2).count() == 2 and read_examples(spark, str(path)).count() == 5
