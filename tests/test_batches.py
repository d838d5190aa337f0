"""The Arrow functions over whole batches against the expressions and rules for one line, and what the plans may hold."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailsieve.crf import kernels
from mailsieve.functions import batches, normalize, patterns, text
from mailsieve import CrfModel
from mailsieve.operators import brackets, evaluate, features, flat, lines
from mailsieve.plans import datagen, queries, training
from mailsieve.plans.pipeline import extract, finder

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "　", "--", "—ー-", "=-=a", "=-=-=ab", "★━★", "> > a", "|>a", ">", "Re: x", "On Monday a wrote:", "From: a", "お世話になっております。", "田中様、", "以上", "以上、ご確認ください", "TEL : 03-1234-5678",
    "a@b.co", "(株)田中", "Co., Ltd", "担当 田中", "例えば", "「a」", '"', 'a "b" c', ", x y", "田中太郎", "田中 (タナカ)", "Taro Tanaka", "田中/Tanaka", "ｶﾞｲﾄﾞ", "が", "ば", "각", "Å", "á", "​--​", "~~", "１２３ ＡＢ", "𠮷野家",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


def test_strip_is_no_pattern(spark):
    df = spark.createDataFrame([(text.WS_CHARS + "a b" + text.WS_CHARS,), (text.WS_CHARS,), (None,)], "x string").coalesce(1)
    own = df.select(text.strip(F.col("x")).alias("y"))
    assert [r.y for r in own.collect()] == ["a b", "", None] and "regexp_replace" not in plan(own)
    assert [r.y for r in df.select(F.regexp_replace("x", f"^[{text.WS}]+|[{text.WS}]+$", "").alias("y")).collect()] == ["a b", "", None]


def test_mails_are_dealt_before_they_are_written_out(spark):
    shuffled = [x for x in plan(queries.mails(spark, SF)).split("\n") if "exchange hashpartitioning(o_orderkey" in x]
    assert shuffled and "roundrobin" not in plan(queries.mails(spark, SF))


def test_lines_are_normalised_once_and_alike(monkeypatch):
    r = random.Random(3)
    chars = "aZ0 -~ーｰ—=★　がば゚ｶﾞ각éÅ￥’２​㍿漢字。、  "
    texts = ODD + ["".join(r.choices(chars, k=r.randrange(1, 7))) for _ in range(3000)]
    want = [normalize.normalized_line(x) for x in texts]
    assert normalize.normalized_texts(pa.array(texts)).to_pylist() == want
    plain = lambda x: normalize.japanese(x).strip(text.WS_CHARS)
    assert all(normalize.normalized_line(x) == plain(x) for x in ("ｶﾞｲﾄﾞ　ＡＢＣ", "すごーーーい〜 ", "ば a", "x ~ y"))
    calls = []
    monkeypatch.setattr(normalize, "normalized_line", lambda x: calls.append(x) or x.strip())
    own = normalize.normalized_batch(pa.array(["\n　a b \n漢字\r\n\n"] * 500 + [None, " "]))
    assert own.lists().to_pylist() == [["a b", "漢字"]] * 500 + [[], []] and len(calls) == 1


def test_null_lines_stay_null(spark):
    df = spark.createDataFrame([([" ａ", None, ""],), (None,), ([],)], "x array<string>").coalesce(1)
    assert [r.y for r in df.select(normalize.normalized(F.col("x")).alias("y")).collect()] == [["a", None, ""], None, []]


@pytest.mark.parametrize("name", ["bracket_sections", "context_counts", "positions", "quote_span"])
def test_features_need_no_pattern_in_the_plan(spark, name):
    own = plan(queries.QUERIES[name](spark, SF))
    assert "rlike" not in own and "regexp" not in own and own.count("arrowevalpython") == 1


def test_some_features_are_those_of_all(spark):
    lists = [ODD, ["--", "TEL: 1", "--", "x", "==", "a", "=="], [], [""], None, ["> a", "", "b"]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, lines array<string>").coalesce(1)
    whole = {r.i: r for r in features.with_features(df).collect()}
    assert whole[4].features is None and whole[4].has_quotes is False and whole[2].features == [] and whole[3].features == []
    names = ("context_quote_count", "in_bracketed_section", "bracket_has_signature_patterns", "kanji_ratio", "preceded_by_delimiter")
    for r in features.with_features(df, names=names).collect():
        assert (r.features and [tuple(x) for x in r.features]) == (whole[r.i].features and [tuple(x[n] for n in r.features[0].asDict()) for x in whole[r.i].features])
    assert [x.in_bracketed_section for x in whole[1].features] == [False, True, False, False, False, True, False]
    assert [(x.blank_lines_before, x.blank_lines_after) for x in whole[5].features] == [(0, 1), (1, 0)]


def test_marks_of_a_batch_are_those_of_a_line(spark):
    df = spark.createDataFrame([(x,) for x in ODD], "x string").coalesce(1)
    flags = patterns.line_flags(F.col("x")) | text.class_ratios(F.col("x")) | {"has_name": patterns.contains_name(F.col("x")), "line_length": F.length("x")}
    want = [r.asDict() for r in df.select(*(v.alias(k) for k, v in flags.items())).collect()]
    got = batches.line_marks(pa.array(ODD), set(flags))
    for k in flags:
        assert got[k].tolist() == [r[k] for r in want], k


@pytest.mark.parametrize("name", ["extract_full", "crf_marginals", "extract_documents"])
def test_extraction_is_one_function(spark, name):
    own = plan(queries.QUERIES[name](spark, SF))
    assert "rlike" not in own and "regexp" not in own and own.count("arrowevalpython") + own.count("mapinarrow") == 1


def test_extraction_at_once_is_that_by_stages(spark):
    rows = [(r.email_text,) for r in datagen.examples(spark, 150, seed=11).select("email_text").collect()]
    rows += [(None,), ("",), (" ​\n",), ("\n".join(ODD),), ("--\n\n--",), ("> a\n\n\nb\r\n> c\rd\n以上\n\n",), ("x\n" * 400,)]
    mails = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, email_text string")
    model, result = CrfModel.load(), ("i", "body", "confidence", "success", "error", "labeled_lines", "signature_detected", "inline_quotes_included")
    once, staged = (sorted(extract(mails, model, keep_stages=k).select(*result).collect()) for k in (False, True))
    assert [repr(r) for r in once] == [repr(r) for r in staged] and len(once) == len(rows)


def test_large_batches_are_taken_in_parts():
    mails = pa.array(["a\n" * 10, None, "b" * 50, "", "c\nd"])
    assert [*batches.parts(mails, most=1)] == [(i, i + 1) for i in range(5)] and [*batches.parts(mails)] == [(0, 5)] and [*batches.parts(mails[:0])] == []
    assert [p for a, b in batches.parts(mails, most=900) for p in batches.split(mails[a:b]).lists().to_pylist()] == [["a"] * 10 + [""], [], ["b" * 50], [""], ["c", "d"]]


def test_rounding_is_that_of_spark(spark):
    r = random.Random(1)
    xs = [0.0, 1.0, 5e-07, 1.5e-06, 0.0000025, 0.1234565, 0.1234575, 0.99999949999999, 0.9999995, 2.5e-07, *(r.random() for _ in range(2000)), *(round(r.random(), 7) for _ in range(2000))]
    df = spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1)
    assert flat.rounded(np.array(xs)).tolist() == [r.y for r in df.select(F.round("x", 6).alias("y")).collect()]


@pytest.mark.parametrize("name", ["label_distribution", "gold_bodies", "eval_label_metrics", "unify_blocks", "fix_transitions", "label_alignment", "reconstruct"])
def test_labels_by_rule_are_made_once(spark, name):
    own = plan(queries.QUERIES[name](spark, SF))
    assert "rlike" not in own and own.count("mapinarrow") == 1


def test_label_counts(spark):
    df = spark.createDataFrame([(["A", "A"], ["A", "B"]), (["B", None], ["B", "C"]), (["A"], ["A", "A"]), (None, None)], "predicted array<string>, truth array<string>")
    got = {r.label: (r.tp, r.fp, r.fn) for r in evaluate.label_metrics(df).collect()}
    assert got == {"A": (1, 1, 0), "B": (1, 0, 1), None: (0, 1, 0), "C": (0, 0, 1)}
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("distribution", "")
    found = evaluate.label_distribution(df.select(F.explode("truth").alias("label")))
    assert len(jobs.getJobIdsForGroup("distribution")) == 0
    assert [tuple(r) for r in found.collect()] == [("A", 3, 50.0), ("B", 2, 100.0 * 2 / 6), ("C", 1, 100.0 / 6)]
    spark.sparkContext.setJobGroup("", "")


@pytest.mark.parametrize("name", ["name_lines", "char_ratios", "pattern_flags", "document_flags", "assemble_body"])
def test_lines_are_told_apart_in_batches(spark, name):
    own = plan(queries.QUERIES[name](spark, SF))
    assert "rlike" not in own and "regexp" not in own and own.count("mapinarrow") == 1 and "window" not in own


def test_partition_of_extreme_transitions():
    e, offsets = np.random.default_rng(0).normal(size=(9, 3)), np.array([0, 4, 9])
    a = np.array([[0.0, -3.0, 1.0], [2.0, 0.5, -1.0], [-2.0, 0.0, 3.0]])
    for scale in (1, 100, 400):
        z, m, _ = kernels.log_partition(e, scale * a, offsets)
        score = kernels.path_score(e, scale * a, offsets, kernels.viterbi(e, scale * a, offsets))
        assert np.isfinite(z).all() and np.allclose(m.sum(1), 1) and (score <= z + 1e-9).all()


def test_many_mails_take_little_time():
    import time

    mail = "田中様\n\nお世話になっております。\n\n番号%dの件です。\n状態はOです。\n\n以上、よろしくお願いします。\n\n----------\n田中太郎\nTEL: 03-1234-5678"
    find, mails = finder(CrfModel.load()), pa.array([mail % i for i in range(20_000)])
    find(mails[:10])
    began = time.process_time()
    assert find(mails).field("n_lines").to_pylist() == [12] * 20_000
    assert time.process_time() - began < 10


def test_dashes_in_batches(spark):
    assert plan(queries.delimiter_unify(spark, SF)).count("arrowevalpython") == 1
    df = spark.createDataFrame([(x,) for x in [*ODD, "ーー━━──﻿", "  -----ー--ーー ", "★━━━★", "ー-", "​--​", None, "a ー"]], "x string").coalesce(1)
    plain = F.when(normalize.is_delimiter_line(F.col("x")), normalize.delimiter_line(F.col("x"))).otherwise(normalize.without_zero_width(F.col("x")))
    got = df.select("x", text.strip(normalize.unified_dashes(plain)).alias("want")).withColumn("got", normalize.unified_lines(F.col("x"))).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_blocks_of_like_mails_are_searched_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(brackets, "unified", lambda labels, marks: calls.append(1) or ["SIGNATURE"] * len(labels))
    monkeypatch.setattr(brackets.F, "arrow_udf", lambda run, kind: type("Call", (), {"asNondeterministic": lambda self: lambda *x: run(*x)})())
    labels, marks = pa.array([["BODY", "QUOTE"]] * 90 + [None, []]), pa.array([[True, True]] * 90 + [None, []])
    assert brackets.unified_blocks(labels, marks).to_pylist() == [["SIGNATURE"] * 2] * 90 + [None, []] and len(calls) == 2


def test_reconstruct_grows_with_the_lines(spark):
    texts = [x for _ in range(3000) for x in ("", "a", " ")]
    df = spark.createDataFrame([(texts, [str(i) for i in range(3000)]), (["", ""], []), ([], [])], "lines array<string>, y array<string>").coalesce(1)
    none = F.lit(None).cast("map<string,double>")
    labeled = F.transform("y", lambda x: F.struct(x.alias("label"), F.lit(1.0).alias("confidence"), none.alias("label_probabilities")))
    own = df.select(lines.reconstruct(F.col("lines"), labeled).alias("r"))
    assert "array_append" not in plan(own)
    got = [[(x.label, x.is_blank, x.confidence) for x in r.r] for r in own.collect()]
    assert got[0][:4] == [(None, True, None), ("0", False, 1.0), ("0", True, None), ("0", True, None)] and got[0][-1][0] == "2999"
    assert got[1:] == [[(None, True, None)] * 2, []]
    one = batches.Lines.of(pa.array([texts[:7], ["", ""], [], ["b"]]))
    content, at = one.content()
    row, blank = flat.carried(one, at, content)
    assert row.tolist() == [-1, 0, 0, 0, 1, 1, 1, -1, -1, 2] and blank.tolist() == [True, False, True, True, False, True, True, True, True, False]


def test_expected_body_in_one_function(spark):
    cases = [
        ([("", None), ("> q", "QUOTE"), (" ａ ", "BODY"), ("", "BODY"), ("> r", "QUOTE"), ("以上", "CLOSING"), ("--", "OTHER"), ("x", "SIGNATURE"), ("", "SIGNATURE")], "a\n\n> r\n以上"),
        ([("", None), (None, None), ("b", "BODY"), ("", None)], "b"), ([("x", "SIGNATURE"), ("y", "BODY")], ""), ([("x", None)], ""), ([], ""), (None, ""),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, lines_gold array<struct<text:string,label:string>>, want string").coalesce(1)
    own = training.with_expected_body(df)
    assert plan(own).count("arrowevalpython") == 1 and [r.expected_body for r in own.orderBy("i").collect()] == [r[1] for r in cases]


def test_features_of_lines_that_a_function_made(spark):
    df = spark.createDataFrame([("ａ\n\n以上",)], "t string").withColumn("all", normalize.normalized_lines(F.col("t"))).withColumn("lines", normalize.trimmed(F.col("all")))
    rows = lines.exploded(features.with_features(df), "features", names=("idx", "f")).select("f.line_length", "f.is_closing").collect()
    assert [tuple(r) for r in rows] == [(1, False), (2, True)]
