"""Features, sections, CRF, label repair and assembly."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.crf.encode import ATTRIBUTES, encode
from mailsieve.crf.kernels import log_partition, path_score, viterbi
from mailsieve.crf.model import CrfModel
from mailsieve.crf.train import CrfEstimator, likelihood
from mailsieve.functions import text
from mailsieve.operators import assemble, brackets, features
from mailsieve.schema import FEATURES, LABELS


def test_similar_separators():
    yes = [("★----★", "★-----★"), ("-----=====", "--=-=-=-=-"), ("", "")]
    no = [("-=-=-=-=", "========="), ("-----", "--------"), ("-", "=")]
    alike = lambda a, b: brackets.alike(brackets.shape(a), brackets.shape(b))
    assert all(alike(*x) for x in yes) and not any(alike(*x) for x in no)


def test_sections():
    flags = lambda t: brackets.section_flags(t, [x[0] in "-=" for x in t], ["TEL" in x for x in t])
    assert flags(["Before", "========", "Inside TEL", "========", "After"]) == ([False, False, True, False, False], [False, False, True, False, False])
    assert not any(flags(["a", "---", "b"])[0])
    assert flags(["---", "A", "---", "Mid", "===", "B", "==="])[0] == [False, True, False, False, False, True, False]
    assert flags(["---", "A", "----", "B", "-----", "C", "--"])[0] == [False, True, False, False, False, False, False]
    assert flags(["--", "===", "a", "--", "TEL", "===="]) == ([False, True, True, True, True, False], [False, False, True, True, True, False])


def plain_flags(texts, separators, signature):
    """The rule as it is said: every later separator is tried in turn."""
    from collections import Counter

    inside, holds, closing = [False] * len(texts), [False] * len(texts), set()
    at = [i for i, s in enumerate(separators) if s]
    for a in at:
        if a in closing:
            continue
        for z in at:
            x, y = Counter(texts[a]), Counter(texts[z])
            if z > a + 1 and z not in closing and set(x) == set(y) and abs(len(texts[a]) - len(texts[z])) <= 1 and max(abs(x[c] - y[c]) for c in x) <= 1:
                closing.add(z)
                for i in range(a + 1, z):
                    inside[i], holds[i] = True, any(signature[a + 1 : z])
                break
    return inside, holds


def plain_unified(labels, separators):
    out, closing, at = list(labels), set(), [i for i, s in enumerate(separators) if s]
    for a in at:
        for z in at if a not in closing and len(labels) > 2 and len(at) > 1 else ():
            if z > a + 1 and z not in closing:
                most = [x for x in ("BODY", "SIGNATURE") if 2 * sum(y == x for y in out[a : z + 1]) > z + 1 - a]
                if most:
                    out[a : z + 1] = most * (z + 1 - a)
                    closing.add(z)
                    break
    return out


def test_sections_and_blocks_against_the_rules_as_they_are_said():
    r = random.Random(5)
    for _ in range(1500):
        texts = [r.choice(["--", "---", "----", "==", "-=-=", "=-=", "-=", "text", "TEL", "more"]) for _ in range(r.randrange(14))]
        marks, signed = [t[0] in "-=" for t in texts], [t == "TEL" for t in texts]
        assert brackets.section_flags(texts, marks, signed) == plain_flags(texts, marks, signed), texts
        labels = [r.choice(("BODY", "SIGNATURE", "SIGNATURE", "OTHER", "BODY", "CLOSING")) for _ in texts]
        assert brackets.unified(labels, marks) == plain_unified(labels, marks), (labels, texts)


def test_many_separators_take_little_time():
    import time

    lines = [("-" * (3 + i % 7) if i % 2 else f"line {i}") for i in range(8000)]
    began = time.time()
    brackets.section_flags(lines, [i % 2 == 1 for i in range(8000)], [False] * 8000)
    brackets.unified(["CLOSING" if i % 3 else "BODY" for i in range(8000)], [i % 2 == 1 for i in range(8000)])
    assert time.time() - began < 3


@pytest.mark.parametrize(
    "labels,at,want",
    [
        (["SIGNATURE", *["BODY"] * 4, "SIGNATURE"], {0, 5}, ["BODY"] * 6),
        (["OTHER", *["BODY"] * 3, "CLOSING", "OTHER"], {0, 5}, ["OTHER", *["BODY"] * 3, "CLOSING", "OTHER"]),
        (["OTHER", *["SIGNATURE"] * 3, "OTHER"], {0, 4}, ["SIGNATURE"] * 5),
        (["OTHER", "OTHER", "BODY"], {0, 1}, ["OTHER", "OTHER", "BODY"]),
    ],
)
def test_unified(labels, at, want):
    assert brackets.unified(labels, [i in at for i in range(len(labels))]) == want


def test_repair_native_equals_plain(spark):
    r = random.Random(0)
    rows = [([r.choice(LABELS) for _ in range(n)], [r.random() < 0.4 for _ in range(n)]) for n in range(7) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, y array<string>, s array<boolean>").coalesce(1)
    got = [x.v for x in df.withColumn("v", brackets.repaired_native(F.col("y"), F.col("s"))).orderBy("i").collect()]
    assert got == [brackets.repaired(a, b) for a, b in rows]


def test_features(spark):
    mail = "お世話になっております。\n\n> 前回\n本文です。\nよろしくお願いします。\n-----\n株式会社サンプル\nTEL: 03-1234-5678\n-----"
    df = spark.createDataFrame([(mail,), ("one",), ("",)], "t string").coalesce(1).withColumn("lines", F.filter(text.split_lines(F.col("t")), lambda x: F.lit(True)))
    rows = features.with_features(df).collect()
    f = rows[0].features
    assert [*f[0].asDict()] == [*FEATURES] and len(f[0]) == 37
    assert [x.position_normalized for x in f] == [i / 7 for i in range(8)] and [x.lines_from_end for x in f] == list(range(7, -1, -1))
    assert f[0].context_closing_count == 0 and f[2].context_closing_count == 1 and f[2].context_quote_count == 1 and f[0].context_greeting_count == 0
    assert [x.in_bracketed_section for x in f] == [False] * 5 + [True, True, False] and f[5].bracket_has_signature_patterns
    assert f[5].preceded_by_delimiter and f[1].blank_lines_before == 1 and (rows[0].first_quote_index, rows[0].last_quote_index, rows[0].has_quotes) == (1, 1, True)
    assert rows[1].features[0].position_normalized == 0 and rows[1].features[0].position_reverse == 1 and rows[2].features == []


def feature_arrays(n):
    return {k: np.zeros(n) for k in FEATURES}


def test_attributes():
    f = feature_arrays(4)
    f["position_normalized"][:] = [0.05, 0.1, 0.7, 0.95]
    f["ascii_ratio"][0], f["kanji_ratio"][1], f["hiragana_ratio"][1], f["quote_depth"][2] = 0.9, 0.5, 0.3, 2
    x = encode(f, np.array([0, 3, 3, 4]))
    on = [{a for a, v in zip(ATTRIBUTES, row, strict=True) if v == 1} for row in x]
    assert len(ATTRIBUTES) == 51
    assert "BOS" in on[0] and "EOS" not in on[0] and "EOS" in on[2] and {"BOS", "EOS"} <= on[3] and not {"BOS", "EOS"} & on[1]
    assert {"pos_bucket:start", "char_type:ascii_heavy"} <= on[0] and {"pos_bucket:early", "char_type:japanese_heavy"} <= on[1] and {"pos_bucket:late", "quote_depth_cat:quoted"} <= on[2] and "pos_bucket:end" in on[3]


def test_kernels_against_all_paths():
    rng = np.random.default_rng(0)
    k, sizes = 3, [1, 4, 0, 5, 2]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    e, a = rng.normal(size=(offsets[-1], k)), rng.normal(size=(k, k))
    y = viterbi(e, a, offsets)
    z, m, expected = log_partition(e, a, offsets, pairs=True)
    pairs = np.zeros((k, k))
    for s, (b, n) in enumerate(zip(offsets, sizes, strict=False)):
        paths = list(itertools.product(range(k), repeat=n))
        scores = np.array([sum(e[b + t, p[t]] for t in range(n)) + sum(a[p[t], p[t + 1]] for t in range(n - 1)) for p in paths])
        if not n:
            assert z[s] == 0
            continue
        assert tuple(y[b : b + n]) == paths[scores.argmax()]
        assert math.isclose(z[s], np.log(np.exp(scores).sum()))
        p = np.exp(scores - z[s])
        for t in range(n):
            assert np.allclose(m[b + t], [sum(w for q, w in zip(paths, p, strict=True) if q[t] == c) for c in range(k)])
            if t:
                for q, w in zip(paths, p, strict=True):
                    pairs[q[t - 1], q[t]] += w
    assert np.allclose(expected, pairs)


def test_gradient():
    rng = np.random.default_rng(1)
    x, offsets, k = rng.normal(size=(7, 4)), np.array([0, 3, 7]), 3
    y, w = rng.integers(0, k, 7), rng.normal(size=4 * 3 + 9)
    _, g = likelihood(w, x, y, offsets, k)
    for i in range(len(w)):
        d = np.zeros_like(w)
        d[i] = 1e-6
        assert math.isclose(g[i], (likelihood(w + d, x, y, offsets, k)[0] - likelihood(w - d, x, y, offsets, k)[0]) / 2e-6, rel_tol=1e-4, abs_tol=1e-6)


TRAINING = [
    (["お世話になっております。", "本日は会議の件でご連絡いたします。", "よろしくお願いいたします。"], ["GREETING", "BODY", "CLOSING"]),
    (["明日の予定を確認しました。", "問題ありません。"], ["BODY", "BODY"]),
    (["ご確認ください。", "---", "田中太郎", "TEL: 03-1234-5678"], ["BODY", "OTHER", "SIGNATURE", "SIGNATURE"]),
    (["> 前回のメール", "承知しました。"], ["QUOTE", "BODY"]),
    (["情報です。", "続きです。", "以上"], ["BODY", "BODY", "CLOSING"]),
]


@pytest.mark.parametrize("algorithm", ["lbfgs", "ap", "pa", "arow", "l2sgd"])
def test_training(spark, algorithm, tmp_path):
    df = spark.createDataFrame(TRAINING, "lines array<string>, labels array<string>").coalesce(1)
    rows = features.with_features(df).select("features", "labels").persist()
    model = CrfEstimator(algorithm=algorithm, max_iterations=25).fit(rows)
    got = rows.select(model.predict(F.col("features")).alias("p"), "labels").collect()
    assert all(len(r.p.labels) == len(r.labels) and 0 <= r.p.probability <= 1 for r in got)
    assert all(abs(sum(m) - 1) < 0.01 for r in got for m in r.p.marginals)
    assert sum(list(r.p.labels) == list(r.labels) for r in got) >= 4
    path = str(tmp_path / "deep" / "model.json")
    model.save(path)
    again = CrfModel.load(path)
    assert np.allclose(again.state, model.state) and np.allclose(again.transition, model.transition) and again.labels == model.labels


def test_model_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        CrfModel.load(str(tmp_path / "none"))
    (tmp_path / "bad").write_text("{}")
    with pytest.raises(RuntimeError):
        CrfModel.load(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        CrfEstimator(algorithm="x")
    df = spark.createDataFrame([(["a", "b"], ["BODY"])], "lines array<string>, labels array<string>")
    with pytest.raises(ValueError):
        CrfEstimator().fit(features.with_features(df))


def plain_body(labels):
    n = len(labels)
    end = labels.index("SIGNATURE") if "SIGNATURE" in labels else n
    inside = [i for i in range(end) if labels[i] in ("GREETING", "BODY", "CLOSING")]
    if not inside:
        return None
    start = max([i for i in range(inside[0]) if labels[i] == "QUOTE"], default=-1) + 1
    return start, inside[-1], sum(x == "QUOTE" for x in labels[start : inside[-1] + 1])


def test_assembly_in_both_layouts(spark):
    r = random.Random(3)
    cases = [["BODY", "QUOTE", "BODY"], ["BODY", "QUOTE", "QUOTE"], ["BODY", "OTHER", "BODY"], ["BODY", "OTHER", "OTHER"], ["BODY", "SIGNATURE", "BODY"], ["SIGNATURE"], ["QUOTE"], []]
    cases += [[r.choice(LABELS) for _ in range(r.randint(1, 7))] for _ in range(120)]
    rows = [(i, [(f"{i}.{k}", y, False) for k, y in enumerate(c)]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "mail_id long, l array<struct<text:string,label:string,is_blank:boolean>>").coalesce(1)
    got = {x.mail_id: x.a for x in df.select("mail_id", assemble.assembled(F.col("l")).alias("a")).collect()}
    flat = assemble.assembled_rows(df.select("mail_id", F.posexplode("l").alias("pos", "x")).select("mail_id", "pos", "x.*"))
    other = {x.mail_id: x for x in flat.collect()}
    for i, c in enumerate(cases):
        want = plain_body(c)
        assert got[i].success == (want is not None)
        if want:
            a, z, quotes = want
            assert got[i].body_text == "\n".join(f"{i}.{k}" for k in range(a, z + 1)) and list(got[i].body_lines) == list(range(a, z + 1)) and got[i].inline_quote_count == quotes
        assert got[i].signature_index == (c.index("SIGNATURE") if "SIGNATURE" in c else None)
        if c:
            assert (other[i].body_text, other[i].inline_quote_count, other[i].success, other[i].signature_index) == (got[i].body_text, got[i].inline_quote_count, got[i].success, got[i].signature_index)
