"""The service form, files on any store, the command line."""

import json

import pytest

from graylark import cli
from graylark.functions import constants
from graylark.operators import attribution
from graylark.plans import funnel
from graylark.sources import readers, writers

MAIL = "From: PayPal <a@paypa1.example>\nSubject: %s\nAuthentication-Results: m; spf=fail; dkim=fail; dmarc=fail\n\nverify your account"


@pytest.fixture(scope="module")
def models(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("models"))
    writers.save_model(scorer_model(spark), f"{root}/own-3class")
    return root


def scorer_model(spark):
    from graylark.operators import scorer

    return scorer.train(readers.demo_corpus(spark), iterations=2)


def test_health(spark, models, tmp_path, monkeypatch):
    assert funnel.health(spark) == {"status": "ok", "model_loaded": None, "layer3_available": False}
    assert funnel.health(spark, str(tmp_path))["model_loaded"] is None
    monkeypatch.setattr(attribution, "probe", lambda url, model: (True, "ok"))
    assert funnel.health(spark, models, "http://server.example") == {"status": "ok", "model_loaded": "own-3class", "layer3_available": True}
    monkeypatch.setattr(attribution, "probe", lambda url, model: (False, "unreachable"))
    assert not funnel.health(spark, models, "http://server.example")["layer3_available"]


def test_service_statuses(spark, models, tmp_path):
    status, body = funnel.analyze_one(spark, MAIL % "hi", models)
    assert status == 200 and body["final_verdict"] in ("phishing", "ai_phish") and body["layer2"]["predicted_label"] in ("ham", "phishing", "ai_phish")
    assert funnel.analyze_one(spark, MAIL % "hi")[0] == 200
    assert funnel.analyze_one(spark, MAIL % "hi", str(tmp_path))[0] == 503
    (tmp_path / "broken").mkdir()
    status, body = funnel.analyze_one(spark, MAIL % "hi", model=str(tmp_path / "broken"))
    assert status == 500 and "can't be loaded" in body["detail"]


def test_a_failed_analysis_is_a_status(spark, monkeypatch):
    monkeypatch.setattr(funnel, "analyze", lambda *_, **__: 1 / 0)
    status, body = funnel.analyze_one(spark, MAIL % "hi")
    assert status == 500 and "division" in body["detail"]


def test_prompt_states_the_allowed_values(spark):
    rows = funnel.assessed(spark.createDataFrame([(MAIL % "hi",)], "raw_eml string"))
    text = rows.select(attribution.prompt().alias("p")).first().p
    for value in (*constants.OBJECTIVES, *constants.TRIGGERS, *constants.SOPHISTICATION, "Subject: hi", "spf=fail", "a@paypa1.example", "DMARC fail"):
        assert value in text


def test_calls_are_bounded_and_concurrent(spark, tmp_path):
    def provider(prompt, place=str(tmp_path)):
        import os
        import time
        import uuid

        mine = f"{place}/{uuid.uuid4().hex}"
        open(mine, "w").close()
        time.sleep(0.2)
        open_now = len(os.listdir(place))
        os.remove(mine)
        return json.dumps({"primary_objective": str(open_now)})

    df = spark.createDataFrame([(i, MAIL % i) for i in range(12)], "i int, raw_eml string").coalesce(1)
    rows = funnel.analyze(df, run_layer3=True, provider=provider, model="m").collect()
    most = [int(r.layer3.answer.primary_objective) for r in rows if r.layer3 is not None]
    assert len(most) == 12 and 2 <= max(most) <= attribution.CALLS


def test_small_files(spark, tmp_path):
    writers.write_bytes(f"file://{tmp_path}/deep/er/x.json", b'{"a": "\xc3\xa9"}')
    assert writers.read_text(f"{tmp_path}/deep/er/x.json") == '{"a": "é"}' and writers.read_text(f"{tmp_path}/none") is None
    assert writers.read_label_map(str(tmp_path)) is None and writers.list_models(f"{tmp_path}/none") == []
    with pytest.raises(FileNotFoundError):
        writers.default_model(str(tmp_path))


def test_json_keeps_nulls(spark, tmp_path):
    writers.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()] == [{"a": 1, "b": None}]


def test_csv_keeps_texts(spark, tmp_path):
    texts = ['quote " and, comma', "line\nend", "return\r\nend", "  blanks  ", "", "tab\t", "\\", '\\"', "é x", '"', "null"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, text string")
    df.write.options(**writers.CSV).csv(str(tmp_path / "c"))
    got = {r.i: r.text for r in spark.read.schema(df.schema).csv(str(tmp_path / "c"), **writers.CSV_READ).collect()}
    assert got == {**dict(enumerate(texts)), 99: None}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})()

    with pytest.raises(RuntimeError, match="checkpoint"):
        writers.scratch(Session())


def run(capsys, *argv):
    assert cli.main(list(argv)) == 0
    return capsys.readouterr().out


def test_command_line(spark, models, tmp_path, capsys, monkeypatch):
    box = tmp_path / "box"
    for name, subject in (("b.eml", "two"), ("a.eml", "one")):
        (box).mkdir(exist_ok=True)
        (box / name).write_text(MAIL % subject)
    rules = [json.loads(x) for x in run(capsys, "rules", str(box)).splitlines()]
    assert [r["file"] for r in rules] == ["a.eml", "b.eml"] and rules[0]["verdict"] == "escalate_to_layer2"
    scored = json.loads(run(capsys, "score", str(box / "a.eml"), "--indent", "1"))
    assert scored["final_verdict"] in ("phishing", "ai_phish") and scored["layer1"]["sender_domain"] == "paypa1.example"
    assert json.loads(run(capsys, "predict", str(box / "a.eml"), "--model", f"{models}/own-3class"))["predicted_label"] in ("ham", "phishing", "ai_phish")
    attributed = json.loads(run(capsys, "attribute", str(box / "a.eml"), "--url", "http://127.0.0.1:9"))
    assert attributed["layer3"] is None or attributed["layer3"]["meta"]["status"] == "unavailable"
    monkeypatch.setattr("sys.stdin", __import__("io").StringIO(MAIL % "piped"))
    assert json.loads(run(capsys, "score", "-"))["file"] == "-"


def test_command_line_corpus(spark, tmp_path, capsys):
    raw = tmp_path / "raw.csv"
    raw.write_text('kind,body,title\nGood,"hello, ""you""",Hi\nBad,click here,\nGood,"hello, ""you""",Hi\nBad,,\n')
    out = run(capsys, "prep", str(raw), "--text-column", "body", "--label-column", "kind", "--subject-column", "title", "--label-map", "Good=0,Bad=1", "--out", str(tmp_path / "prepared"))
    assert [json.loads(x)["n"] for x in out.splitlines()] == [1, 1]
    assert "kind" in run(capsys, "prep", str(raw), "--inspect")
    with pytest.raises(ValueError, match="Bad"):
        cli.main(["prep", str(raw), "--text-column", "body", "--label-column", "kind", "--label-map", "Good=0"])
    run(capsys, "build", "--demo", "--csv", str(tmp_path / "prepared"), "--out", str(tmp_path / "splits"))
    stats = json.loads((tmp_path / "splits" / "stats.json").read_text())
    assert stats["total"] == 12 and sum(s["total"] for s in stats["splits"].values()) == 12
    run(capsys, "train", "--data", str(tmp_path / "splits"), "--out", str(tmp_path / "models" / "own"))
    assert writers.list_models(str(tmp_path / "models")) == ["own"]
    test = tmp_path / "test.csv"
    test.write_text("text,label\nverify your account,1\nlunch at noon,0\n")
    run(capsys, "evaluate", "--csv", str(test), "--out", str(tmp_path / "report"))
    assert json.loads((tmp_path / "report" / "metrics.json").read_text())["n_test"] == 2 and "# Evaluation" in (tmp_path / "report" / "report.md").read_text()


def test_a_model_server(spark):
    """Probe and provider against a small server that speaks the protocol."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def reply(self, document):
            body = json.dumps(document).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            self.reply({"models": [{"name": "own:7b"}]})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.reply({"response": json.dumps({"primary_objective": "Other", "analyst_summary": asked["model"]})})

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        assert attribution.probe(url, "own") == (True, "ok") and not attribution.probe(url, "other")[0]
        assert funnel.health(spark, url=url, model="own")["layer3_available"]
        df = spark.createDataFrame([(MAIL % "one",)], "raw_eml string")
        row = funnel.analyze(df, run_layer3=True, provider=attribution.http_provider(url, "own"), model="own").first()
        assert row.layer3_ran and row.layer3.answer.analyst_summary == "own" and row.layer3.meta.model == "own"
    finally:
        server.shutdown()
