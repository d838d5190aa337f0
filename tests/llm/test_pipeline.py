"""The corpus pipeline on a small folder, with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


def test_pipeline(spark, tmp_path):
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = prose(i, 50).split() + (["vilest", "vileness", "vilely"] * 2 if bad else [])
        random.Random(i).shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    common = "A line about nothing that very many documents share."
    rows += [(1000 + i, f"{prose(2000 + i, 40)}\n{common}") for i in range(6)]
    rows += [(1100, prose(3000, 60)), (1101, prose(3000, 60) + " more"), (1102, prose(3000, 60))]
    leak = prose(4000, 12)
    rows += [(1200, prose(4001, 30) + " " + leak + " " + prose(4002, 9)), (1300, None), (1301, "")]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    got, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        before = at
        at = stage(spark, before, str(tmp_path)).persist()
        got[name] = {r.doc_id: r for r in at.collect()}
        if name != "sentencepiece":
            assert at.columns == docs.columns
    clean = {i for i, _ in rows if i < 400 and i % 5}
    assert clean <= set(got["toxicity"]) and not {i for i in range(0, 400, 5)} & set(got["toxicity"])
    assert [common in got["line_dedup"][1000 + i].text for i in range(6)] == [False] * 5 + [True]
    assert got["line_dedup"][1000].n_chars == len(got["line_dedup"][1000].text)
    assert 1100 in got["ngram_jaccard"] and not {1101, 1102} & set(got["ngram_jaccard"])
    assert 1200 not in got["decontamination"] and clean <= set(got["decontamination"])
    assert set(got["sentencepiece"]) == set(got["decontamination"]) and all(r.round_trip for r in got["sentencepiece"].values())
    want = sorted((r.doc_id, r.ids_sha256) for r in got["sentencepiece"].values())
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", F.col("ids_sha256")).collect()) == want


def test_near_duplicates_with_repeated_and_null_ids(spark, tmp_path):
    a, b, c, d = (prose(5000 + i, 60) for i in range(4))
    rows = [(1, a), (1, a), (2, a + " more"), (3, b), (3, c), (None, c), (None, d), (None, d), (None, prose(5010, 60)), (4, prose(5011, 60)), (5, ""), (5, ""), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    want = [(1, a), (3, b), (3, c), (None, d), (None, prose(5010, 60)), (4, prose(5011, 60)), (5, ""), (6, None), (7, "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
