"""Lines, normalisation and the predicates on lines."""

import pytest
from pyspark.sql import functions as F

from mailsieve.functions import normalize, patterns, text
from mailsieve.operators import lines


def values(spark, inputs, column):
    """``column`` of each input, in order, in one job."""
    df = spark.createDataFrame(list(enumerate(inputs)), "n int, t string").coalesce(1)
    return [r.v for r in df.withColumn("v", column(F.col("t"))).orderBy("n").collect()]


def test_normalized_lines(spark):
    cases = {
        "Line1\r\nLine2\r\n": ["Line1", "Line2"],
        "Line1\rLine2": ["Line1", "Line2"],
        "\n\nContent": ["Content"],
        "Para1\n   \t   \nPara2": ["Para1", "", "Para2"],
        "": [],
        " \n\t ": [],
        "ＡＢＣ１２３": ["ABC123"],
        "ｶﾀｶﾅ ﾊﾞﾋﾟ": ["カタカナバピ"],
        "すごーーーい": ["すごーい"],
        "10~20 と 10〜20": ["1020と1020"],
        "Hello World": ["Hello World"],
        "ー" * 20: ["-" * 20],
        "─" * 22: ["-" * 22],
        "ーー━━──――": ["-" * 8],
        "-----ー-----ー-----": ["-" * 17],
        "★━━━━━━━━━━★": ["★----------★"],
        "【========】": ["【========】"],
        "=" * 20: ["=" * 20],
        "a﻿b​c‌d‍e⁠f": ["abcdef"],
        "----﻿----​----": ["-" * 12],
        "　 x　": ["x"],
        "＞ 引用": [">引用"],
    }
    got = values(spark, cases, lambda t: normalize.trimmed(normalize.normalized_lines(t)))
    assert dict(zip(cases, got, strict=True)) == cases


def test_blank_lines(spark):
    df = spark.createDataFrame([("A\n\nB\nC\n\nD",), ("Line 1\n\n\nLine 2",), ("\nx\n",)], "t string").coalesce(1)
    ls = text.split_lines(F.col("t"))
    rows = df.select(lines.with_gaps(lines.content(ls), F.size(ls)).alias("c"), lines.blank_map(ls).alias("m")).collect()
    assert list(rows[0].m.content_to_original) == [0, 2, 3, 5] and list(rows[0].m.blank_positions) == [1, 4]
    assert [(c.blank_lines_before, c.blank_lines_after) for c in rows[1].c] == [(0, 2), (2, 0)]
    assert [(c.blank_lines_before, c.blank_lines_after) for c in rows[2].c] == [(1, 1)]


def test_reconstruct_keeps_blank_text(spark):
    df = spark.createDataFrame([(["", "a", "   ", "b"], [("GREETING", 0.9), ("BODY", 0.8)])], "l array<string>, y array<struct<label:string,confidence:double>>")
    labeled = F.transform("y", lambda x: F.struct(x["label"].alias("label"), x["confidence"].alias("confidence"), F.lit(None).cast("map<string,double>").alias("label_probabilities")))
    got = df.select(lines.reconstruct(F.col("l"), labeled).alias("r")).first().r
    assert [(x.text, x.is_blank, x.label, x.confidence) for x in got] == [("", True, None, None), ("a", False, "GREETING", 0.9), ("   ", True, "GREETING", None), ("b", False, "BODY", 0.8)]


PREDICATES = [
    (patterns.quote_depth, {"> x": 1, ">> x": 2, ">>> x": 3, "> > x": 2, "| x": 1, ">| x": 2, "x > y": 0, "": 0}),
    (patterns.is_separator, {"---": True, "===": True, "___": True, "-" * 50: True, "a--b": False, "。。": True, "-": False, "": False, "a---": True, "ab---": True, "abcd---": False, "😀😀": True}),
    (patterns.is_forward_reply_header, {"-----Original Message-----": True, "On 2024/01/15, John Smith wrote:": True, "2024年1月15日 田中太郎:": True, "田中さんからのメール:": True, "re: x": True, "件名: x": True, "お世話になっております。": False}),
    (patterns.is_greeting, {"いつもお世話になっております。": True, "田中様": True, "様": False, "営業部御中、": True, "こんにちは": True, "こんにちは、田中": False, "拝啓 春": True, "ご連絡ありがとうございます。": True}),
    (patterns.is_closing, {"よろしくお願いいたします。": True, "よろしくお願い致します": True, "以上": True, "以上、ご確認ください": True, "以上の通り": False, "敬具": True, "ありがとうございました!": True, "お手数ですが、": True}),
    (patterns.is_contact_info, {"TEL: 03-1234-5678": True, "tel : x": True, "a@b.co": True, "〒100-0001": True, "電話:1": True, "HP:x": True, "hp:x": False, "(03) 1234-5678": True, "電話": False}),
    (patterns.is_company, {"株式会社サンプル": True, "ACME inc": True, "since": True, "(株)": True, "会社": False}),
    (patterns.is_position, {"営業部 課長": True, "software engineer": True, "部": False}),
    (patterns.has_meta_discussion, {"以下の通り": True, "例えば": True, "例": False}),
    (patterns.is_inside_quotation_marks, {"「はい」": True, '"': True, 'a "b" c': True, "a, b c": True, "a,b": False, "」「": False}),
    (
        patterns.is_name,
        {
            "田中太郎": True, "田中": True, "田中太郎 (タナカタロウ)": True, "田中 / Tanaka": True, "Taro Tanaka": True, "紅星平岡": True, "and/or": True, "サトウ": True,
            "ファイト!": False, "田中太郎様": False, "田中さん": False, "株式会社田中": False, "taro": False, "TARO TANAKA": False, "Taro": False, "ファイル": False, "田中。": False, "太郎": False, "": False,
        },
    ),
    (patterns.contains_name, {"担当の田中です": True, "Mr. TANAKA": True, "誰か": False}),
]


@pytest.mark.parametrize("predicate,cases", PREDICATES, ids=[p.__name__ for p, _ in PREDICATES])
def test_predicates(spark, predicate, cases):
    assert dict(zip(cases, values(spark, cases, predicate), strict=True)) == cases


def test_ratios(spark):
    cases = {"日本語": ("kanji_ratio", 1.0), "あいう": ("hiragana_ratio", 1.0), "アイウ": ("katakana_ratio", 1.0), "Hello": ("ascii_ratio", 1.0), "12345": ("digit_ratio", 1.0), "日本Hello": ("kanji_ratio", 2 / 7), "ー": ("hiragana_ratio", 1.0), "é 々": ("symbol_ratio", 1.0), "²": ("digit_ratio", 1.0)}
    got = values(spark, cases, lambda t: F.struct(*(v.alias(k) for k, v in text.class_ratios(t).items())))
    assert {c: (n, r[n]) for (c, (n, _)), r in zip(cases.items(), got, strict=True)} == cases
    assert all(abs(sum(r) - 1) < 1e-9 for r in got)
