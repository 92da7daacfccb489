"""Corpus preparation, evaluation and roll-ups."""

import json
import math

import pytest
from pyspark.sql import functions as F

from graylark.operators import attribution, corpus, metrics, rollup, scorer
from graylark.sources import readers, writers

GOLDEN = {(0, 0): 1636, (0, 1): 11, (1, 0): 17, (1, 1): 965, (2, 2): 900}


@pytest.fixture(scope="module")
def golden(spark):
    rows = [k for k, n in GOLDEN.items() for _ in range(n)]
    return spark.createDataFrame(rows, "y int, p int").cache()


def test_golden_metrics(golden):
    doc = metrics.metrics_document(golden)
    assert doc["n_test"] == 3529 and doc["accuracy"] == pytest.approx(0.9920657410031171, abs=1e-15)
    assert doc["macro"]["f1"] == pytest.approx(0.9924049483600045, abs=1e-14)
    assert doc["per_class"]["phishing"]["recall"] == pytest.approx(0.9826883910386965, abs=1e-15)
    assert doc["binary_f1"]["model_only"] == pytest.approx(0.9925492283129325, abs=1e-15)
    assert doc["binary_f1"]["rules_only"] is None and doc["binary_f1"]["fused"] is None
    assert "| phishing | 0.989 | 0.983 | 0.986 | 982 |" in writers.markdown_report(doc)


def test_macro_leaves_absent_labels_out(spark):
    df = spark.createDataFrame([(0, 0), (1, 1)], "y int, p int")
    assert metrics.macro_scores(df).first().macro_f1 == 1.0
    assert {r["name"]: r.f1 for r in metrics.per_class(df).collect()}["ai_phish"] == 0.0
    assert metrics.confusion(df).count() == 9


def test_empty_predictions(spark):
    df = spark.createDataFrame([], "y int, p int")
    assert metrics.accuracy(df).first().n == 0 and metrics.binary_scores(df).first().f1 == 0.0
    assert rollup.verdict_shares(rollup.verdict_counts(spark.createDataFrame([], "final_verdict string"))).first().clean_pct == 0.0


def test_label_map():
    assert corpus.parse_label_map("Safe Email=0, a=b =1") == {"Safe Email": 0, "a=b": 1}
    with pytest.raises(ValueError):
        corpus.parse_label_map("nothing")


def test_unmapped_values_are_named(spark):
    df = corpus.map_labels(spark.createDataFrame([(" a ",), ("x",), (None,)], "k string"), "k", {"a": 0})
    with pytest.raises(ValueError, match="x"):
        corpus.checked_labels(df, "k")
    assert corpus.checked_labels(df, "k", drop=True).count() == 1


def test_keep_first(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 0), (2, "b", 0), (4, None, 1), (5, None, 2)], "i int, text string, label int")
    assert sorted((r.i, r.label) for r in corpus.keep_first(df, "text", "i").collect()) == [(1, 0), (2, 0), (4, 1)]


@pytest.mark.parametrize("n, classes", [(1, 1), (10, 3), (101, 3), (700, 2)])
def test_split_contract(spark, n, classes):
    df = spark.createDataFrame([(i, (i * i) % classes) for i in range(n)], "k bigint, label int")
    rows = corpus.split(df, "k").collect()
    assert len(rows) == n and len({r.k for r in rows}) == n
    count = lambda s: sum(r.split == s for r in rows)
    assert count("test") == math.ceil(0.15 * n - 1e-9)
    assert [r.split for r in sorted(rows)] == [r.split for r in sorted(corpus.split(df.repartition(3), "k").collect())]
    if n > 100:
        for c in range(classes):
            mine = [r for r in rows if r.label == c]
            assert abs(sum(r.split == "test" for r in mine) - 0.15 * len(mine)) <= 1


def test_profile_order_of_appearance(spark):
    df = spark.createDataFrame([(2, "b"), (1, "c"), (3, "b"), (4, None)], "i int, v string")
    row = corpus.profile(df, "i").first()
    assert (row.row_count, row.non_null, row.distinct_values, row.examples) == (4, 3, 2, "c | b")


def test_required_columns(spark):
    with pytest.raises(corpus.SchemaError):
        corpus.require(spark.createDataFrame([(1,)], "a int"), "text")


def test_class_weights_of_absent_classes(spark):
    rows = {r.label: r.class_weight for r in scorer.class_weights(spark.createDataFrame([(0,), (0,), (1,)], "label int"), "label").collect()}
    assert rows == {0: 0.5, 1: 1.0, 2: 1.0}


def test_outside_scorer_sees_gated_rows_only(spark):
    from graylark.plans import funnel

    def load():
        def score(texts):
            assert all("quiet" not in t for t in texts)
            return [{"ham": 0.1, "phishing": 0.9} for _ in texts]

        return score

    good = "From: a@b.example\nAuthentication-Results: m; spf=pass; dkim=pass; dmarc=pass\n\nquiet"
    bad = "From: a@b.example\nAuthentication-Results: m; spf=fail; dkim=pass; dmarc=pass\n\nloud"
    df = spark.createDataFrame([(0, good), (1, bad)], "i int, raw_eml string")
    rows = funnel.verdicts(df, scorer=lambda d, t: scorer.batch_scorer(d, t, load)).orderBy("i").collect()
    assert [r.layer2_ran for r in rows] == [False, True] and rows[1].layer2_phish_probability == 0.9


def test_attribution_statuses(spark):
    from graylark.plans import funnel

    raw = "From: a@b.example\nSubject: %s\nAuthentication-Results: m; spf=fail; dkim=fail; dmarc=fail\n\nlunch"
    df = spark.createDataFrame([(0, raw % "one"), (1, raw % "two"), (2, raw % "three")], "i int, raw_eml string")

    def provider(prompt):
        if "Subject: one" in prompt:
            return 'Well: {"primary_objective": "other"} ok'
        if "Subject: two" in prompt:
            raise TimeoutError("late")
        return "nothing"

    rows = funnel.analyze(df, run_layer3=True, provider=provider, model="m").orderBy("i").collect()
    assert [r.layer3.meta.status for r in rows] == ["ok", "error", "parse_error"]
    assert rows[0].layer3.answer.primary_objective == "other" and rows[0].layer3_ran and rows[2].layer3.meta.raw == "nothing"
    assert funnel.analyze(df).first().layer3 is None


def test_probe_without_a_server():
    ok, why = attribution.probe("http://127.0.0.1:9", "m", 0.2)
    assert not ok and "unreachable" in why


def test_recent_and_numbers(spark):
    df = spark.createDataFrame([(1, 0.5, "", "s"), (2, 1.5, "x", None)], "i int, final_risk_score double, from_address string, subject string")
    rows = rollup.recent(df, [F.col("i").desc()], 1).collect()
    assert [(r.i, r.score, r.sender, r.title) for r in rows] == [(2, 2, "x", "—")]
    half = df.select(rollup.score_half_even(F.col("final_risk_score")).alias("e"), rollup.score_half_up(F.col("final_risk_score")).alias("u")).collect()
    assert [(r.e, r.u) for r in half] == [(0, 1), (2, 2)]


def test_files(spark, tmp_path):
    box = tmp_path / "mail" / "phishing"
    box.mkdir(parents=True)
    (box / "a.eml").write_text("Subject: hi\n\nbody text")
    (box / "b.eml").write_bytes(b"\n\xff\xfe ")
    got = readers.read_label_directory(spark, str(tmp_path / "mail")).collect()
    assert [(r.text, r.label, r.source) for r in got] == [("hi\n\nbody text", 1, "a.eml")]
    assert [r.file for r in readers.read_messages(spark, str(tmp_path / "mail")).collect()] == ["a.eml", "b.eml"]
    csv = tmp_path / "c.csv"
    csv.write_text('text,label\n"a ""q""\nb",Phishing\nc,7\n')
    assert [(r.text, r.label, r.source) for r in readers.read_csv_corpus(spark, str(csv)).collect()] == [('a "q"\nb', "1", "c.csv"), ("c", "7", "c.csv")]
    csv.write_bytes("text,label\ncafé,0\n".encode("latin-1"))
    assert readers.read_csv_any(spark, str(csv)).first().text == "café"


def test_splits_and_sidecars(spark, tmp_path):
    rows = corpus.split(readers.demo_corpus(spark).withColumn("k", F.md5("text")), "k").drop("k")
    writers.write_splits(rows, str(tmp_path / "out"))
    stats = json.loads((tmp_path / "out" / "stats.json").read_text())
    assert stats["total"] == 10 and writers.read_label_map(str(tmp_path / "out")) == {0: "ham", 1: "phishing", 2: "ai_phish"}


def test_evaluation_rows_need_labels(spark):
    df = spark.createDataFrame([("t", None), (None, 1)], "text string, label int")
    with pytest.raises(Exception, match="no label"):
        readers.evaluation_rows(df).collect()


def test_model_round_trip(spark, tmp_path):
    demo = readers.demo_corpus(spark)
    model = scorer.train(demo, iterations=5)
    writers.save_model(model, str(tmp_path / "m" / "3class"))
    loaded, labels = writers.load_model(str(tmp_path / "m" / "3class"))
    out = scorer.predicted(scorer.mllib_scorer(demo, "text", loaded, labels), "text").collect()
    assert sum(r.predicted_label == labels[r.label] for r in out) >= 9 and writers.default_model(str(tmp_path / "m")) == "3class"
