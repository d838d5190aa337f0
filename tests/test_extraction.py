"""The whole extraction, its interfaces, evaluation, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from mailsieve import BodyExtractor, CrfModel, InvalidInputError, LowConfidenceError, MailBodyExtractor
from mailsieve.operators import evaluate
from mailsieve.plans import datagen, training
from mailsieve.plans.pipeline import error_text, extract, gate
from mailsieve.sources import corpus
from mailsieve.sources.names import load_names, names_frame
from mailsieve.streaming import extract_stream, read_mail_files

MAIL = "株式会社サンプル\n田中様\n\nお世話になっております。\n\n会議の日程の件でご連絡いたします。\n詳しくは別途ご説明します。\n\n以上、よろしくお願いします。\n\n----------\n山田太郎\nTEL: 03-1234-5678\n----------\n"
BODY = MAIL.split("\n\n----------")[0]


@pytest.fixture(scope="module")
def results(spark):
    rows = [(1, MAIL), (2, None), (3, " \n\t"), (4, "​"), (5, "---------- Forwarded message ---------\n> a\n> b"), (6, "x " * 50_000), (1, MAIL)]
    df = spark.createDataFrame(rows, "mail_id long, email_text string").withColumn("body", F.lit("clash"))
    return {r.mail_id: r for r in BodyExtractor().transform(df).collect()}


def test_result_columns(results):
    r = results[1]
    assert r.body == BODY and r.success and r.error is None and r.signature_detected and 0.5 <= r.confidence <= 1
    assert [x.text for x in r.labeled_lines] == [x for x in MAIL.split("\n") if x]
    assert all(abs(sum(x.label_probabilities.values()) - 1) < 1e-6 and x.confidence == x.label_probabilities[x.label] for x in r.labeled_lines)


def test_errors(results):
    assert [(results[i].error.type, results[i].error.message) for i in (2, 3, 4)] == [("InvalidInputError", "Empty input")] * 2 + [("InvalidInputError", "Empty input after normalization")]
    assert all(results[i].confidence == 0 and results[i].body is None and results[i].labeled_lines == [] for i in (2, 3, 4))
    assert results[5].error.type == "NoBodyDetectedError" and results[5].body is None and results[5].confidence > 0
    assert len(results[6].labeled_lines) == 1


def test_gate_boundary(spark):
    df = spark.createDataFrame([(0.5, True), (0.49, True), (0.1, False)], "c double, b boolean").coalesce(1)
    got = df.select(gate(F.lit("x"), F.array(F.lit("x")), F.col("b"), F.col("c"), 0.5).alias("e")).withColumn("m", error_text(F.col("e"))).collect()
    assert [r.e and r.e.type for r in got] == [None, "LowConfidenceError", "NoBodyDetectedError"]
    assert got[1].m == "Confidence below threshold (confidence: 0.49, threshold: 0.50)"


def test_one_mail_interface(spark):
    api = MailBodyExtractor(spark=spark)
    assert not api.is_model_loaded
    assert api.extract(MAIL) == BODY and api.is_model_loaded
    assert api.extract_safe("") is None
    with pytest.raises(InvalidInputError):
        api.extract("")
    strict = MailBodyExtractor(confidence_threshold=1.1, spark=spark)
    result = strict.extract_with_metadata(MAIL)
    assert not result.success and result.body == BODY and isinstance(result.error, LowConfidenceError) and "threshold: 1.10" in str(result.error)
    assert strict.extract_safe(MAIL) is None


def test_stage_is_saved(spark, tmp_path):
    BodyExtractor(confidenceThreshold=0.7).write().overwrite().save(str(tmp_path / "stage"))
    again = BodyExtractor.load(str(tmp_path / "stage"))
    assert again.getOrDefault(again.confidenceThreshold) == 0.7


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text(MAIL.replace("日程", f"日程{i}"), "utf-8")
    extract_stream(read_mail_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    batch = spark.read.text(str(tmp_path / "in"), wholetext=True).withColumnRenamed("value", "email_text")
    want = sorted((r.body, round(r.confidence, 9)) for r in extract(batch, CrfModel.load()).collect())
    assert sorted((r.body, round(r.confidence, 9)) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_evaluation_on_made_mails(spark):
    examples = datagen.examples(spark, 60, seed=5)
    assert examples.collect() == datagen.examples(spark, 60, seed=5).collect()
    judged = training.evaluate(examples, CrfModel.load()).persist()
    r = evaluate.rates(judged).first()
    assert r.n_total == 60 and r.n_content_match + r.n_confident_wrong + r.n_failed_static == 60 and r.content_match_rate > 0.7
    assert evaluate.confidence_stats(judged).first().n == judged.where("success").count()
    assert {x.label for x in evaluate.label_metrics(judged).collect()} <= set(evaluate.LABELS)
    assert training.usable(examples).count() > 50


def test_rates_of_nothing(spark):
    df = spark.createDataFrame([], "body string, success boolean, error struct<type:string>, expected_body string")
    r = evaluate.rates(evaluate.outcomes(df)).first()
    assert r.n_total == 0 and r.exact_match_rate == 0.0


def test_acceptable(spark):
    cases = [("a" * 100, "a" * 90, True), ("a" * 100, "a" * 89, False), ("a", "", False), ("", "", False), ("ab", "cd", False), (" x ", "x", True), (None, "x", False)]
    df = spark.createDataFrame(cases, "e string, f string, w boolean").coalesce(1)
    assert [r.v for r in df.withColumn("v", evaluate.is_acceptable(F.col("e"), F.col("f"))).collect()] == [c[2] for c in cases]


def test_alignment_and_search(spark):
    df = spark.createDataFrame([(["A", "B"], ["A", "C", "D"])], "p array<string>, t array<string>")
    assert [tuple(x) for x in df.select(evaluate.aligned(F.col("p"), F.col("t")).alias("a")).first().a] == [("A", "A", False), ("B", "C", True), ("?", "D", True)]
    assert df.select(evaluate.first_line_with(F.col("t"), "D").alias("i")).first().i == 2


def test_jsonl(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    ex = datagen.example(1)
    old = {"email_text": "x", "line_labels": [{"text": "x", "label": "BODY"}]}
    path.write_text("\n".join([json.dumps(ex, ensure_ascii=False), "", "{broken", json.dumps(old)]) + "\n", "utf-8")
    got = corpus.read_examples(spark, str(path)).collect()
    assert [len(r.lines) for r in got] == [len(ex["lines"]), 1] and corpus.rejected(spark, str(path)).count() == 1
    assert corpus.read_example(spark, str(path), 3).first().email_text == "x"
    with pytest.raises(ValueError):
        corpus.read_example(spark, str(path), 9)
    with pytest.raises(Exception):
        corpus.read_examples(spark, str(path), strict=True).collect()
    corpus.write_failures(spark.createDataFrame([(1, "b")], "id int, body string"), str(tmp_path / "report"))
    assert "body: b" in spark.read.text(str(tmp_path / "report")).first().value or spark.read.text(str(tmp_path / "report")).count() >= 2


def test_names(spark):
    known = load_names()
    assert "田中" in known["last"] and "太郎" in known["first"] and load_names("/no/such/file") == {"last": (), "first": (), "katakana": (), "romaji": ()}
    assert names_frame(spark).count() == sum(map(len, known.values()))
