"""Goldens of parsing and layer one."""

import pytest
from pyspark.sql import functions as F

from graylark.operators import parse, rules
from graylark.plans import funnel

SPOOF = """Received: from relay.invalid by mx.fixture.example
Authentication-Results: mx.fixture.example; dmarc=fail header.from=d0cusign-forms.example; spf=fail; dkim=fail
Subject: Final notice: unusual activity, your files expire, click here
From: DocuSign Forms <desk@d0cusign-forms.example>
Content-Type: text/plain
Reply-To: <answers@elsewhere.invalid>
Message-ID: <77.made-up@fixture.example>

Open https://forms.landing.invalid/a1 to keep your files.
"""


def test_spoof_sample(spark):
    row = funnel.analyze(spark.createDataFrame([(1, SPOOF)], "email_id bigint, raw_eml string")).first()
    assert row.layer1.sender_domain == "d0cusign-forms.example"
    assert row.layer1.infra_risk_score == 100.0
    assert len(row.layer1.reasons) == 7
    assert row.layer1.verdict == "escalate_to_layer2"
    assert row.final_risk_score == 100.0 and row.final_verdict in ("phishing", "ai_phish")


@pytest.mark.parametrize(
    "label, brand, score",
    [
        ("micr0soft", None, None), ("go0gle", None, None), ("zo0m", None, None), ("paypal", None, None), ("paypa1", "paypal", 0.83), ("goog1e", "google", 0.83), ("wel1sfarg0", "wellsfargo", 0.9),
        ("my0kta", "okta", 0.83), ("microsoft-help", "microsoft", 0.81), ("apple-id", "apple", 0.8), ("chas", "chase", 0.8), ("purchase", "chase", 0.8), ("micros0ft-support", "microsoft", 0.75),
        ("amaz0n-pay", "amazon", 0.78), ("room", "zoom", 0.75), ("", None, None), ("аpple", None, None),
    ],
)
def test_lookalikes(spark, label, brand, score):
    row = spark.createDataFrame([(f"{label}.example" if label else "",)], "d string").select(rules.lookalike(F.col("d")).alias("l")).first().l
    assert (row is None) if brand is None else (row.brand, row.score) == (brand, score)


def test_only_the_first_label_counts(spark):
    rows = spark.createDataFrame([("paypa1.example.com",), ("mail.paypa1.com",)], "d string").select(rules.lookalike(F.col("d")).alias("l")).collect()
    assert rows[0].l is not None and rows[1].l is None


def test_header_block_ends_at_the_first_other_line(spark):
    raw = ["Subject: a\n b\nFrom: x@y.example\n\nbody: no header", "no header\nSubject: z", "Word: pasted\nrest", "Subject: c\r\n d\r\n\r\nbody", ""]
    rows = parse.parsed(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw_eml string")).orderBy("i").collect()
    assert [r.subject for r in rows] == ["a\n b", "", "", "c\r\n d", ""]
    assert [r._raw_body for r in rows] == ["body: no header", "no header\nSubject: z", "rest", "body", ""]


def test_auth_results_over_all_fields(spark):
    raw = "Authentication-Results: a; SPF=SoftFail\nAuthentication-Results: b; dkim=pass; spf=pass\n\nx"
    row = parse.parsed(spark.createDataFrame([(raw,)], "raw_eml string")).first()
    assert (row.spf, row.dkim, row.dmarc) == ("softfail", "pass", None)


def test_mime_bodies(spark):
    multi = "Content-Type: multipart/alternative; boundary=B\nSubject: s\n\n--B\nContent-Type: text/html\n\n<p>h</p>\n--B\nContent-Type: text/plain\n\nplain\n--B--\n"
    coded = "Content-Type: text/plain\nContent-Transfer-Encoding: base64\n\naGVsbG8gd29ybGQ=\n"
    page = "Content-Type: text/html; charset=utf-8\n\n<style>p{}</style><p>a&nbsp;b</p><script>x</script>\n\n c"
    rows = parse.with_body(parse.parsed(spark.createDataFrame([(0, multi), (1, coded), (2, page), (3, None)], "i int, raw_eml string"))).orderBy("i").collect()
    assert [r.body_text for r in rows][:3] == ["h\nplain", "hello world", "a&nbsp;b c"]


def test_links(spark):
    body = "see HTTPS://B.example:8080/x?y and http://a.example?q=1 and http://a.example?q=1, http://u@c.example/"
    row = spark.createDataFrame([(body,)], "b string").select(parse.link_domains(F.col("b")).alias("l")).first()
    assert row.l == ["a.example?q=1", "a.example?q=1,", "b.example:8080", "u@c.example"]


def test_empty_domain_mismatch(spark):
    df = spark.createDataFrame([("PayPal desk", "", ["x.example"])], "n string, d string, l array<string>")
    row = df.select(rules.display_name_mismatch(F.col("n"), F.col("d")).alias("a"), rules.link_mismatch(F.col("l"), F.col("d")).alias("b")).first()
    assert row.a and not row.b


def test_strict_addresses(spark):
    rows = spark.createDataFrame([('"A, B" <a@b.example>',), ("a@b@c",), (None,)], "v string").select(parse.parse_address(F.col("v")).alias("p")).collect()
    assert rows[0].p.address == "a@b.example" and rows[0].p.display == "A, B" and rows[2].p.address == ""


def test_domain_ages_come_from_a_table(spark):
    ages = spark.createDataFrame([("young.example", 3)], "sender_domain string, domain_age_days int")
    row = funnel.assessed(spark.createDataFrame([("From: a@young.example\n\nx",)], "raw_eml string"), ages=ages).first()
    assert row.infra_risk_score == 15.0 and row.reasons == ["Sender domain registered 3 days ago"]


def test_links_come_from_decoded_parts(spark):
    import base64

    html = base64.b64encode('<a href="https://Evil.example/x">é</a>'.encode()).decode()
    multi = f"Content-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/html\nContent-Transfer-Encoding: base64\n\n{html}\n--B\nContent-Type: application/xml\n\nhttp://attach.example/\n--B--\n"
    nested = f"Content-Type: multipart/mixed; boundary=A\n\n--A\nContent-Type: multipart/alternative; boundary=B\n\n--B\nContent-Type: text/plain\n\nhttp://one.example/\n--B\nContent-Type: text/html\nContent-Transfer-Encoding: base64\n\n{html}\n--B--\n--A--\n"
    soft = "Content-Type: text/plain\nContent-Transfer-Encoding: quoted-printable\n\nhttp://lo=\nng.example/a http://b.example=20x\n"
    broken = "Content-Type: multipart/mixed\n\nno boundary, http://c.example\n"
    odd = "Content-Transfer-Encoding: base64\n\n????\n"
    native = 'Content-Type: text/html\n\n<a href="http://native.example?a">'
    rows = [(i, r) for i, r in enumerate((multi, soft, broken, odd, native, None, "", nested))]
    out = rules.signals(parse.with_body(parse.parsed(spark.createDataFrame(rows, "i int, raw_eml string")))).orderBy("i").collect()
    assert [r.link_domains for r in out] == [["evil.example"], ["b.example", "long.example"], ["c.example"], [], ["native.example?a"], None, [], ["evil.example", "one.example"]]


def test_plain_messages_never_reach_python(spark):
    """Python gets the text of multipart and encoded messages only, nulls for the others."""
    df = spark.createDataFrame([("Subject: a\n\nhttp://x.example",), ("Content-Type: multipart/mixed; boundary=B\n\n--B\n\nx\n--B--",)], "raw_eml string")
    assert [r._needs_mime for r in parse.parsed(df).collect()] == [False, True]


def test_long_header_blocks(spark):
    raw = "Subject: a\n" + "X-Long: b\n\tmore\n" * 20_000 + "\nbody"
    row = parse.parsed(spark.createDataFrame([(raw,)], "raw_eml string")).first()
    assert row.subject == "a" and row._raw_body == "body"
