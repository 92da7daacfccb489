"""Queries for every operator of the core, over whole tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graylark.functions import columns as C
from graylark.functions.constants import (
    BLANKS, CONFUSABLE_FROM, CONFUSABLE_TO, FREEMAIL_DOMAINS, LABELS, LOOKALIKE_SCORED_FROM, POINTS, URGENCY_KEYWORDS, WATCHED_BRANDS,
)
from graylark.operators import attribution, corpus, fusion, metrics, parse, rollup, rules, scorer
from graylark.plans import funnel
from graylark.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_email")


def joined(c: str | Column) -> Column:
    return F.array_join(c, " | ")


# --- SQL building blocks -------------------------------------------------------------------------------------------------


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{BLANKS}]+|[{BLANKS}]+\z', '', 'g')"


def sql_collapse(x: str) -> str:
    return sql_strip(f"regexp_replace({x}, '[{BLANKS}]+', ' ', 'g')")


def sql_header(name: str, block: str = "block") -> str:
    return rf"regexp_replace(regexp_extract({block}, '(?i)(?:\A|\n){name}:[ \t]*([^\n]*(?:\n[\t ][^\n]*)*)', 1), '[\r\n]+\z', '')"


def sql_address(v: str) -> str:
    inside = sql_strip(f"regexp_extract({v}, '<([^<>]*)>', 1)")
    return f"CASE WHEN contains({v}, '<') THEN {inside} WHEN contains({v}, '@') THEN {sql_strip(v)} ELSE '' END"


def sql_display(v: str) -> str:
    before = sql_strip(f"CASE WHEN contains({v}, '<') THEN split_part({v}, '<', 1) ELSE '' END")
    unquoted = rf"""regexp_replace({before}, '\A"|"\z', '', 'g')"""
    return sql_strip(unquoted)


def sql_domain(addr: str) -> str:
    return rf"lower(regexp_extract({addr}, '@([^@]*)\z', 1))"


def sql_html(x: str) -> str:
    no_scripts = f"regexp_replace({x}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g')"
    return sql_collapse(f"regexp_replace({no_scripts}, '(?s)<[^>]+>', ' ', 'g')")


def sql_auth(mechanism: str) -> str:
    every = r"array_to_string(regexp_extract_all(block, '(?i)(?:\A|\n)authentication-results:[ \t]*([^\n]*(?:\n[\t ][^\n]*)*)', 1), ' ')"
    return rf"nullif(lower(regexp_extract({every}, '(?i){mechanism}=(\w+)', 1)), '')"


def sql_round_tenth(x: str) -> str:
    m = f"(CASE WHEN {x} < 1 THEN 576460752303423488 ELSE 4503599627370496 END)::HUGEINT"
    n = f"(floor({x} * ({m})::DOUBLE)::HUGEINT * 10)"
    return f"(({n} // {m}) + CASE WHEN ({n} % {m}) * 2 > {m} OR (({n} % {m}) * 2 = {m} AND ({n} // {m}) % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / 10.0"


def sql_count(text: str, terms) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({text}, {sql_text(t)}) THEN 1 ELSE 0 END" for t in terms) + ")"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


BLOCK_SQL = r"'\A((?:(?:From |[!-9;-~]*:|[\t ])[^\n]*(?:\n|\z))*)'"
PARSED_SQL = f"""
blocks AS (SELECT email_id, received_at, raw_eml, regexp_extract(raw_eml, {BLOCK_SQL}, 1) AS block FROM raw_email),
fields AS MATERIALIZED (SELECT *, {sql_header('from')} AS from_value, {sql_header('subject')} AS subject, {sql_header('reply-to')} AS reply_to, {sql_strip(sql_header('message-id'))} AS message_id,
  lower(regexp_extract({sql_header('content-type')}, '\\A([^;\\s]*)', 1)) AS content_type, {sql_auth('spf')} AS spf, {sql_auth('dkim')} AS dkim, {sql_auth('dmarc')} AS dmarc,
  regexp_replace(substr(raw_eml, length(block) + 1), '\\A\\r?\\n', '') AS raw_body FROM blocks),
named AS MATERIALIZED (SELECT *, {sql_display('from_value')} AS from_display, {sql_address('from_value')} AS from_address FROM fields),
parsed AS MATERIALIZED (SELECT *, {sql_domain('from_address')} AS sender_domain, {sql_strip(f"CASE WHEN content_type = 'text/html' THEN {sql_html('raw_body')} ELSE raw_body END")} AS body_text FROM named)"""
#: Levenshtein counts bytes there; a character outside ASCII never equals one of a brand, so one stand-in byte keeps every distance.
LOOK_SQL = f"""
brands AS (SELECT unnest({sql_list(WATCHED_BRANDS)}) AS brand, unnest(range({len(WATCHED_BRANDS)})) AS rank),
roots AS (SELECT sender_domain, split_part(lower(sender_domain), '.', 1) AS root, translate(split_part(lower(sender_domain), '.', 1), {sql_text(CONFUSABLE_FROM)}, {sql_text(CONFUSABLE_TO)}) AS norm FROM (SELECT DISTINCT sender_domain FROM parsed)),
plain AS (SELECT *, regexp_replace(root, '[^\\x00-\\x7f]', '~', 'g') AS root_a, regexp_replace(norm, '[^\\x00-\\x7f]', '~', 'g') AS norm_a FROM roots WHERE root <> ''),
pairs AS (SELECT *, least(levenshtein(root_a, brand), levenshtein(norm_a, brand)) AS edits FROM plain, brands WHERE root <> brand),
points AS (SELECT sender_domain, brand, rank, greatest(CASE WHEN edits > 0 AND edits <= 2 THEN 1 - edits / greatest(length(brand), length(root))::DOUBLE ELSE 0.0 END,
  CASE WHEN contains(norm, brand) AND norm <> brand THEN greatest(0.75, 1 - (length(norm) - length(brand)) / (3.0 * length(brand))::DOUBLE) ELSE 0.0 END) AS score FROM pairs),
look AS MATERIALIZED (SELECT sender_domain, round(score, 2) AS lookalike_score, brand AS lookalike_of FROM points WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY sender_domain ORDER BY score DESC, rank) = 1)"""
SIGNAL_SQL = f"""
signals AS MATERIALIZED (SELECT p.*, look.lookalike_of, coalesce(look.lookalike_score, 0.0) AS lookalike_score, p.sender_domain IN ({', '.join(map(sql_text, FREEMAIL_DOMAINS))}) AS is_freemail,
  (reply_to <> '' AND {sql_domain(f"({sql_address('reply_to')})")} <> '' AND {sql_domain(f"({sql_address('reply_to')})")} <> p.sender_domain) AS reply_to_mismatch,
  (from_display <> '' AND len(list_filter({sql_list(WATCHED_BRANDS)}, lambda b: contains(lower(from_display), b) AND NOT contains(p.sender_domain, b))) > 0) AS display_name_mismatch,
  list_filter({sql_list(URGENCY_KEYWORDS)}, lambda k: contains(lower(subject), k)) AS urgency_hits,
  list_sort(list_distinct(list_transform(regexp_extract_all(raw_body, '(?i)https?://([^{BLANKS}/"''<>]+)', 1), lambda x: lower(x)))) AS link_domains
  FROM parsed p LEFT JOIN look ON p.sender_domain = look.sender_domain),
linked AS MATERIALIZED (SELECT *, (len(link_domains) > 0 AND sender_domain <> '' AND len(list_filter(link_domains, lambda x: contains(x, sender_domain) OR contains(sender_domain, x))) = 0) AS link_domain_mismatch FROM signals)"""
SCORE_SQL = f"""
scored AS (SELECT *, least(100, CASE WHEN dmarc = 'fail' THEN {POINTS['dmarc_fail']} WHEN dmarc = 'none' THEN {POINTS['dmarc_none']} ELSE 0 END + CASE WHEN spf = 'fail' THEN {POINTS['spf_fail']} ELSE 0 END
  + CASE WHEN dkim = 'fail' THEN {POINTS['dkim_fail']} ELSE 0 END + CASE WHEN lookalike_of IS NOT NULL AND lookalike_score >= {LOOKALIKE_SCORED_FROM} THEN {POINTS['lookalike']} ELSE 0 END
  + CASE WHEN display_name_mismatch THEN {POINTS['display']} ELSE 0 END + CASE WHEN reply_to_mismatch THEN {POINTS['reply_to']} ELSE 0 END + CASE WHEN link_domain_mismatch THEN {POINTS['links']} ELSE 0 END
  + least({POINTS['urgency_most']}, {POINTS['urgency_each']} * len(urgency_hits)))::DOUBLE AS infra_risk_score,
  array_to_string(list_filter([CASE WHEN dmarc = 'fail' THEN 'DMARC fail' WHEN dmarc = 'none' THEN 'No DMARC policy' END, CASE WHEN spf = 'fail' THEN 'SPF fail' END, CASE WHEN dkim = 'fail' THEN 'DKIM fail' END,
    CASE WHEN lookalike_of IS NOT NULL AND lookalike_score >= {LOOKALIKE_SCORED_FROM} THEN 'Lookalike domain of ''' || lookalike_of || ''' (similarity ' || lookalike_score::VARCHAR || ')' END,
    CASE WHEN display_name_mismatch THEN 'Display name impersonates a known brand not matching sender domain' END, CASE WHEN reply_to_mismatch THEN 'Reply-To domain differs from From domain' END,
    CASE WHEN link_domain_mismatch THEN 'Embedded links point to a domain different from the sender' END,
    CASE WHEN len(urgency_hits) > 0 THEN 'Urgency/coercion language in subject: [''' || array_to_string(urgency_hits, ''', ''') || ''']' END], lambda x: x IS NOT NULL), ' | ') AS reasons FROM linked),
judged AS MATERIALIZED (SELECT *, CASE WHEN infra_risk_score >= 40 THEN 'escalate_to_layer2' WHEN infra_risk_score >= 15 THEN 'needs_review' ELSE 'clean' END AS verdict,
  {sql_strip("CASE WHEN subject <> '' THEN subject || chr(10) || chr(10) || body_text ELSE body_text END")} AS full_text FROM scored)"""


def sql_lexical(source: str, text: str, name: str) -> str:
    """CTEs ``name_c`` and ``name``: the lexical scorer over ``text`` of ``source``."""
    low = f"lower({text})"
    w = scorer.WEIGHTS
    logits = {k: f"({w[k][0]} + {sql_count('_low', t)} * {w[k][1]})" for k, t in (("ham", scorer.HAM_TERMS), ("phishing", scorer.PHISH_TERMS), ("ai_phish", scorer.AI_TERMS))}
    cols = ", ".join(f"({x})::DOUBLE AS _l_{k}" for k, x in logits.items())
    top = "greatest(_l_ham, _l_phishing, _l_ai_phish)"
    total = f"(exp(_l_ham - {top}) + exp(_l_phishing - {top}) + exp(_l_ai_phish - {top}))"
    probs = ", ".join(f"CASE WHEN _blank THEN NULL ELSE round(exp(_l_{k} - {top}) / {total}, 4) END AS p_{k}" for k in logits)
    return f"""
{name}_c AS MATERIALIZED (SELECT *, {cols} FROM (SELECT *, {low} AS _low, length({sql_strip(f"coalesce({text}, '')")}) = 0 AS _blank FROM {source})),
{name}_p AS MATERIALIZED (SELECT *, {probs} FROM {name}_c),
{name} AS (SELECT *, greatest(p_ham, p_phishing, p_ai_phish) AS confidence,
  CASE WHEN p_ham IS NULL THEN NULL WHEN p_ham >= p_phishing AND p_ham >= p_ai_phish THEN 'ham' WHEN p_phishing >= p_ai_phish THEN 'phishing' ELSE 'ai_phish' END AS predicted_label FROM {name}_p)"""


GATE_SQL = f"""
gated AS MATERIALIZED (SELECT *, (NOT (infra_risk_score < 15 AND coalesce(spf = 'pass', false) AND coalesce(dkim = 'pass', false) AND coalesce(dmarc = 'pass', false)) AND length({sql_strip('full_text')}) > 0) AS layer2_ran,
  (spf IS NOT NULL OR dkim IS NOT NULL OR dmarc IS NOT NULL OR reasons <> '') AS had FROM judged)"""
FUSED_SQL = f"""
shares AS MATERIALIZED (SELECT *, CASE WHEN layer2_ran THEN round(1 - p_ham, 4) END AS p, CASE WHEN layer2_ran THEN predicted_label END AS label2 FROM lex),
raised AS MATERIALIZED (SELECT *, least(100.0, CASE WHEN had THEN greatest(0.5 * infra_risk_score + 0.5 * (p * 100), infra_risk_score, 0.9 * (p * 100)) ELSE greatest(0.5 * infra_risk_score + 0.5 * (p * 100), 0.75 * (p * 100)) END) AS x FROM shares),
finals AS MATERIALIZED (SELECT *, CASE WHEN p IS NULL THEN infra_risk_score ELSE {sql_round_tenth('coalesce(x, 0.0)')} END AS final_risk_score FROM raised),
based AS (SELECT *, CASE WHEN final_risk_score >= 60 THEN 'phishing' WHEN final_risk_score >= 30 THEN 'suspicious' ELSE 'clean' END AS base FROM finals),
fused AS MATERIALIZED (SELECT *, CASE WHEN NOT had AND base = 'phishing' THEN 'suspicious' WHEN base = 'phishing' AND coalesce(label2 = 'ai_phish', false) THEN 'ai_phish' ELSE base END AS final_verdict FROM based)"""
WITH_PARSED = f"WITH {PARSED_SQL} "
WITH_SCORED = f"WITH {PARSED_SQL}, {LOOK_SQL}, {SIGNAL_SQL}, {SCORE_SQL} "
WITH_FUSED = f"WITH {PARSED_SQL}, {LOOK_SQL}, {SIGNAL_SQL}, {SCORE_SQL}, {GATE_SQL}, {sql_lexical('gated', 'full_text', 'lex')}, {FUSED_SQL} "


# --- parsing -------------------------------------------------------------------------------------------------------------


@query(WITH_PARSED + "SELECT email_id, body_text FROM parsed")
def e1_mime(spark, d):
    """The full MIME parse of every message; on plain messages it must agree with the expressions."""

    @F.pandas_udf("string")
    def parse_all(texts):
        return texts.map(parse.mime_text)

    return emails(spark, d).select("email_id", parse_all("raw_eml").alias("body_text"))


@query(WITH_PARSED + "SELECT email_id, message_id, subject, reply_to, from_value FROM parsed")
def e2_headers(spark, d):
    out = parse.parsed(emails(spark, d))
    return out.select("email_id", "message_id", "subject", "reply_to", parse.header(parse.header_block(F.col("raw_eml")), "from").alias("from_value"))


@query(WITH_PARSED + "SELECT email_id, from_display, from_address FROM parsed")
def e3_address(spark, d):
    return parse.parsed(emails(spark, d)).select("email_id", "from_display", "from_address")


@query()
def e3_address_strict(spark, d):
    rows = table(spark, d, "risk_assessment").select("assessment_id", parse.parse_address(F.col("from_address")).alias("a"))
    return rows.select("assessment_id", "a.display", "a.address")


_RA_ADDR = sql_address("coalesce(from_address, '')")


@query(f"SELECT assessment_id, {sql_domain('(' + _RA_ADDR + ')')} AS domain FROM risk_assessment")
def e4_domain(spark, d):
    return table(spark, d, "risk_assessment").select("assessment_id", parse.domain(parse.address(F.coalesce("from_address", F.lit("")))).alias("domain"))


@query(WITH_PARSED + "SELECT email_id, spf, dkim, dmarc FROM parsed")
def e5_auth(spark, d):
    return parse.parsed(emails(spark, d)).select("email_id", "spf", "dkim", "dmarc")


@query(WITH_PARSED + "SELECT email_id, content_type, body_text FROM parsed")
def e6_body(spark, d):
    return parse.with_body(parse.parsed(emails(spark, d))).select("email_id", "content_type", "body_text")


@query(f"SELECT record_id, {sql_html('coalesce(text, chr(60) || chr(62))')} AS plain FROM (SELECT record_id, '<p class=\"a\">' || text || '</p><script>var a = 1;</script><STYLE x>b {{}}</STYLE>&nbsp;<br/>' AS text FROM dataset)")
def e7_html_strip(spark, d):
    page = F.concat(F.lit('<p class="a">'), F.col("text"), F.lit("</p><script>var a = 1;</script><STYLE x>b {}</STYLE>&nbsp;<br/>"))
    return table(spark, d, "dataset").select("record_id", parse.strip_html(F.coalesce(page, F.lit("<>"))).alias("plain"))


_TRIMMED = f"CASE WHEN {sql_strip('subject')} <> '' AND {sql_strip('body_text')} <> '' THEN {sql_strip('subject')} || chr(10) || chr(10) || {sql_strip('body_text')} WHEN {sql_strip('subject')} <> '' THEN {sql_strip('subject')} ELSE {sql_strip('body_text')} END"


@query(WITH_PARSED + f"SELECT email_id, {sql_strip('CASE WHEN subject <> chr(0)[1:0] THEN subject || chr(10) || chr(10) || body_text ELSE body_text END')} AS full_text, {_TRIMMED} AS corpus_text FROM parsed".replace("chr(0)[1:0]", "''"))
def e8_combine(spark, d):
    out = parse.with_body(parse.parsed(emails(spark, d)))
    return out.select("email_id", parse.subject_and_body(F.col("subject"), F.col("body_text")).alias("full_text"), parse.subject_and_body_trimmed(F.col("subject"), F.col("body_text")).alias("corpus_text"))


def _signals(spark, d) -> DataFrame:
    return rules.signals(parse.with_body(parse.parsed(emails(spark, d))))


WITH_SIGNALS = f"WITH {PARSED_SQL}, {LOOK_SQL}, {SIGNAL_SQL} "


@query(WITH_SIGNALS + "SELECT email_id, array_to_string(link_domains, ' | ') AS links FROM linked")
def e9_links(spark, d):
    return _signals(spark, d).select("email_id", joined("link_domains").alias("links"))


#: A message per row as mail programs send it: encoded parts, soft line breaks inside links, an attachment whose links don't count.
_CODED = """CASE email_id % 4
WHEN 0 THEN concat('Content-Type: multipart/mixed; boundary=B\\n\\n--B\\nContent-Type: text/html\\nContent-Transfer-Encoding: base64\\n\\n', base64(cast(concat('<a href="https://H', email_id, '.example/x">é</a>') as binary)), '\\n--B\\nContent-Type: application/xml\\n\\nhttp://attached.example/\\n--B--\\n')
WHEN 1 THEN concat('Content-Type: text/plain\\nContent-Transfer-Encoding: quoted-printable\\n\\nsee http://lo=\\nng', email_id, '.example/=3Fq and http://b.example=20x\\n')
WHEN 2 THEN concat('Content-Type: multipart/alternative; boundary=B\\n\\n--B\\nContent-Type: text/plain\\n\\nhttp://plain', email_id, '.example\\n--B\\nContent-Type: text/html\\n\\n<a href=''http://page.example:80''>\\n--B--\\n')
ELSE concat('Content-Type: text/html\\n\\n<a href="http://native', email_id, '.example?a">') END"""


@query("SELECT email_id, CASE email_id % 4 WHEN 0 THEN 'h' || email_id || '.example' WHEN 1 THEN 'b.example | long' || email_id || '.example' WHEN 2 THEN 'page.example:80 | plain' || email_id || '.example' ELSE 'native' || email_id || '.example?a' END AS links FROM raw_email")
def e9_links_encoded(spark, d):
    made = emails(spark, d).select("email_id", F.expr(_CODED).alias("raw_eml"))
    return rules.signals(parse.with_body(parse.parsed(made))).select("email_id", joined("link_domains").alias("links"))


# --- layer one -----------------------------------------------------------------------------------------------------------


@query(f"SELECT assessment_id, lower(sender_domain) IN ({', '.join(map(sql_text, FREEMAIL_DOMAINS))}) AS is_freemail FROM domain_analysis")
def rule_p1_freemail(spark, d):
    return table(spark, d, "domain_analysis").select("assessment_id", rules.is_freemail(F.lower("sender_domain")).alias("is_freemail"))


@query(f"SELECT assessment_id, translate(lower(sender_domain), {sql_text(CONFUSABLE_FROM)}, {sql_text(CONFUSABLE_TO)}) AS folded FROM domain_analysis")
def rule_p2_confusables(spark, d):
    return table(spark, d, "domain_analysis").select("assessment_id", rules.fold_confusables(F.col("sender_domain")).alias("folded"))


@query(f"SELECT assessment_id, brand, levenshtein(regexp_replace(split_part(sender_domain, '.', 1), '[^\\x00-\\x7f]', '~', 'g'), brand)::INT AS edits FROM domain_analysis, (SELECT unnest({sql_list(WATCHED_BRANDS)}) AS brand)")
def rule_p3_levenshtein(spark, d):
    """Every domain against every watched brand, a list of fixed length."""
    rows = table(spark, d, "domain_analysis").select("assessment_id", F.substring_index("sender_domain", ".", 1).alias("root"), F.explode(C.literals(WATCHED_BRANDS)).alias("brand"))
    return rows.select("assessment_id", "brand", F.levenshtein("root", "brand").alias("edits"))


@query(f"WITH parsed AS (SELECT assessment_id, sender_domain FROM domain_analysis), {LOOK_SQL} SELECT p.assessment_id, look.lookalike_of, coalesce(look.lookalike_score, 0.0) AS lookalike_score FROM parsed p LEFT JOIN look USING (sender_domain)")
def rule_p4_lookalike(spark, d):
    """The expression is costly, so it runs once per distinct domain; the join back is left to the optimizer."""
    rows = table(spark, d, "domain_analysis").select("assessment_id", "sender_domain")
    look = rows.select("sender_domain").distinct().withColumn("l", rules.lookalike(F.col("sender_domain")))
    return rows.join(look, "sender_domain", "left").select("assessment_id", F.col("l.brand").alias("lookalike_of"), F.coalesce("l.score", F.lit(0.0)).alias("lookalike_score"))


@query(WITH_SIGNALS + "SELECT email_id, reply_to_mismatch FROM linked")
def rule_p5_reply_to(spark, d):
    return _signals(spark, d).select("email_id", "reply_to_mismatch")


@query(WITH_SIGNALS + "SELECT email_id, display_name_mismatch FROM linked")
def rule_p6_display_name(spark, d):
    return _signals(spark, d).select("email_id", "display_name_mismatch")


@query(f"SELECT assessment_id, array_to_string(list_filter({sql_list(URGENCY_KEYWORDS)}, lambda k: contains(lower(subject), k)), ' | ') AS hits FROM risk_assessment")
def rule_p7_urgency(spark, d):
    return table(spark, d, "risk_assessment").select("assessment_id", joined(rules.urgency_hits(F.col("subject"))).alias("hits"))


@query(WITH_SIGNALS + "SELECT email_id, link_domain_mismatch FROM linked")
def rule_p8_link_mismatch(spark, d):
    return _signals(spark, d).select("email_id", "link_domain_mismatch")


@query(WITH_PARSED + ", a AS (SELECT sender_domain, min(domain_age_days) AS domain_age_days FROM domain_analysis WHERE domain_age_days IS NOT NULL AND sender_domain <> '' GROUP BY sender_domain) SELECT email_id, domain_age_days, CASE WHEN domain_age_days IS NULL THEN 'unavailable' ELSE 'table' END AS domain_age_source FROM parsed LEFT JOIN a USING (sender_domain)")
def rule_p9_domain_age(spark, d):
    """The signals of all messages with the known ages of their domains."""
    known = table(spark, d, "domain_analysis").where("domain_age_days is not null and sender_domain <> ''")
    ages = known.groupBy("sender_domain").agg(F.min("domain_age_days").alias("domain_age_days"))
    return rules.signals(parse.with_body(parse.parsed(emails(spark, d))), ages).select("email_id", "domain_age_days", "domain_age_source")


@query("SELECT assessment_id, coalesce(auth.spf = 'pass', false) AND coalesce(auth.dkim = 'pass', false) AND coalesce(auth.dmarc = 'pass', false) AS all_pass, coalesce(auth.spf = 'fail', false) OR coalesce(auth.dkim = 'fail', false) OR coalesce(auth.dmarc = 'fail', false) AS any_fail FROM risk_assessment")
def rule_p10_auth_flags(spark, d):
    a = [F.col(f"auth.{m}") for m in parse.MECHANISMS]
    return table(spark, d, "risk_assessment").select("assessment_id", rules.auth_all_pass(*a).alias("all_pass"), rules.auth_any_fail(*a).alias("any_fail"))


def _assessed(spark, d) -> DataFrame:
    return funnel.assessed(emails(spark, d))


@query(WITH_SCORED + "SELECT email_id, infra_risk_score FROM judged")
def f1_infra_score(spark, d):
    return _assessed(spark, d).select("email_id", "infra_risk_score")


@query(WITH_SCORED + "SELECT email_id, reasons FROM judged")
def f2_reasons(spark, d):
    return _assessed(spark, d).select("email_id", joined("reasons").alias("reasons"))


@query(WITH_SCORED + "SELECT verdict, count(*) AS n FROM judged GROUP BY verdict")
def f3_l1_verdict(spark, d):
    return _assessed(spark, d).groupBy("verdict").agg(F.count("*").alias("n"))


# --- gates and fusion ----------------------------------------------------------------------------------------------------


def _verdicts(spark, d) -> DataFrame:
    return funnel.verdicts(emails(spark, d))


@query(f"WITH {PARSED_SQL}, {LOOK_SQL}, {SIGNAL_SQL}, {SCORE_SQL}, {GATE_SQL} SELECT email_id, layer2_ran AS run_l2, length({sql_strip('full_text')}) > 0 AS run_l2_ensemble FROM gated")
def f4_gate(spark, d):
    return _assessed(spark, d).select("email_id", fusion.gate().alias("run_l2"), fusion.gate(True).alias("run_l2_ensemble"))


@query(f"WITH {PARSED_SQL}, {LOOK_SQL}, {SIGNAL_SQL}, {SCORE_SQL}, {GATE_SQL} SELECT email_id, had AS layer1_had_data FROM gated")
def f5_had_data(spark, d):
    return _assessed(spark, d).select("email_id", fusion.had_data().alias("layer1_had_data"))


@query(WITH_FUSED + "SELECT email_id, p AS layer2_phish_probability, final_risk_score FROM fused")
def f6_fused_score(spark, d):
    return _verdicts(spark, d).select("email_id", "layer2_phish_probability", "final_risk_score")


@query(WITH_FUSED + "SELECT email_id, base AS threshold_verdict, final_verdict FROM fused")
def f7_f9_verdict(spark, d):
    return _verdicts(spark, d).select("email_id", fusion.verdict_of(F.col("final_risk_score")).alias("threshold_verdict"), "final_verdict")


@query(WITH_FUSED + "SELECT email_id, final_verdict = 'phishing' AS run_l3 FROM fused")
def f10_l3_gate(spark, d):
    return _verdicts(spark, d).select("email_id", fusion.attribution_gate().alias("run_l3"))


@query(WITH_FUSED + "SELECT email_id, final_verdict, final_risk_score, layer2_ran, false AS layer3_ran, message_id, infra_risk_score, reasons, label2 AS predicted_label, CASE WHEN layer2_ran THEN confidence END AS confidence FROM fused")
def f11_result(spark, d):
    out = funnel.analyze(emails(spark, d))
    return out.select("email_id", "final_verdict", "final_risk_score", "layer2_ran", "layer3_ran", "layer1.message_id", "layer1.infra_risk_score", joined("layer1.reasons").alias("reasons"), "layer2.predicted_label", "layer2.confidence")


# --- layer two -----------------------------------------------------------------------------------------------------------


@query(f"SELECT row_id, CASE WHEN length({sql_strip('coalesce(text, chr(32))')}) = 0 THEN 'empty text' END AS error, CASE WHEN length({sql_strip('coalesce(text, chr(32))')}) > 0 THEN left(text, 120) || CASE WHEN length(text) > 120 THEN '…' ELSE '' END END AS text_preview FROM train")
def m3_m4_preview(spark, d):
    return scorer.predicted(scorer.lexical_scorer(table(spark, d, "train"), "text"), "text").select("row_id", "error", "text_preview")


@query("SELECT record_id, CASE label WHEN 0 THEN 'ham' WHEN 1 THEN 'phishing' WHEN 2 THEN 'ai_phish' ELSE 'class_' || label END AS name, 'class_' || label AS bare FROM dataset")
def m5_label_names(spark, d):
    return table(spark, d, "dataset").select("record_id", scorer.label_name(F.col("label"), LABELS).alias("name"), scorer.label_name(F.col("label")).alias("bare"))


@query("SELECT label, count(*) AS class_rows, sum(count(*)) OVER () / (3.0 * greatest(count(*), 1))::DOUBLE AS class_weight FROM dataset WHERE label IS NOT NULL GROUP BY label")
def m7_class_weights(spark, d):
    return scorer.class_weights(table(spark, d, "dataset"), "label")


@query("SELECT (label > 0)::INT AS binary, count(*) AS n FROM dataset GROUP BY 1")
def m10_binary_collapse(spark, d):
    return table(spark, d, "dataset").groupBy(scorer.collapse_label(F.col("label")).alias("binary")).agg(F.count("*").alias("n"))


@query(f"WITH {sql_lexical('test', 'text', 'lex')} SELECT row_id, predicted_label, confidence, p_ham, p_phishing, p_ai_phish FROM lex")
def m2_lexical(spark, d):
    out = scorer.predicted(scorer.lexical_scorer(table(spark, d, "test"), "text"), "text")
    return out.select("row_id", "predicted_label", "confidence", *[F.element_at("probabilities", k).alias(f"p_{k}") for k in LABELS.values()])


@query(f"WITH {sql_lexical('test', 'text', 'lex')} SELECT row_id, p_ham, p_phishing, p_ai_phish FROM lex")
def m6_batch(spark, d):
    """The batch adapter with a plain function as the outside model."""
    out = scorer.batch_scorer(table(spark, d, "test"), "text", lambda: scorer.lexical_batch)
    return out.select("row_id", *[F.element_at("probabilities", k).alias(f"p_{k}") for k in LABELS.values()])


@query()
def m2_m8_mllib(spark, d):
    """Trained on the train split with class weights, applied to the test split."""
    model = scorer.train(table(spark, d, "train"), iterations=15)
    out = scorer.predicted(scorer.mllib_scorer(table(spark, d, "test").select("row_id", "text", "label"), "text", model), "text")
    return out.select("row_id", F.col("label").alias("y"), "predicted_label", "confidence")


@query()
def m9_selection(spark, d):
    model, reg = scorer.select_model(table(spark, d, "train"), table(spark, d, "val"), regs=(1e-3, 1e-1))
    return spark.createDataFrame([(reg, model.stages[-1].numClasses)], "regularisation double, classes int")


# --- layer three ---------------------------------------------------------------------------------------------------------


@query(WITH_SCORED + f"SELECT email_id, {sql_text(attribution.INSTRUCTION)} || chr(10) || chr(10) || 'Subject: ' || subject || chr(10) || chr(10) || body_text || chr(10) || chr(10) || 'Evidence of the rules' || chr(10) || '- authentication: spf=' || coalesce(spf, 'unknown') || ', dkim=' || coalesce(dkim, 'unknown') || ', dmarc=' || coalesce(dmarc, 'unknown') || chr(10) || '- sender: ' || from_address || chr(10) || '- findings: ' || CASE WHEN reasons <> '' THEN replace(reasons, ' | ', '; ') ELSE 'none' END AS prompt FROM judged")
def l2_prompt(spark, d):
    return _assessed(spark, d).select("email_id", attribution.prompt().alias("prompt"))


_ANSWERS = "CASE email_id % 4 WHEN 0 THEN '{\"primary_objective\": \"other\", \"analyst_summary\": \"m' || email_id || '\"}' WHEN 1 THEN 'Sure: {\"primary_objective\": \"reconnaissance\", \"analyst_summary\": \"n\"} Done.' WHEN 2 THEN 'no object' ELSE '{broken' END"


@query(f"WITH a AS (SELECT email_id, {_ANSWERS} AS answer FROM raw_email), j AS (SELECT *, nullif(regexp_extract(answer, '(?s)(\\{{.*\\}})', 1), '') AS obj FROM a) SELECT email_id, CASE WHEN obj IS NULL THEN 'parse_error' ELSE 'ok' END AS status, json_extract_string(obj, '$.primary_objective') AS primary_objective, json_extract_string(obj, '$.analyst_summary') AS analyst_summary, CASE WHEN obj IS NULL THEN answer END AS raw FROM j")
def l4_l5_answers(spark, d):
    rows = emails(spark, d).select("email_id", F.expr(_ANSWERS).alias("answer"))
    out = rows.withColumn("e", attribution.envelope(F.col("answer"), F.lit("ok"), F.lit(None).cast("string"), "m"))
    return out.select("email_id", "e.meta.status", "e.answer.primary_objective", "e.answer.analyst_summary", "e.meta.raw")


@query(WITH_FUSED + "SELECT email_id, final_verdict, CASE WHEN final_verdict = 'phishing' THEN 'unavailable' END AS status FROM fused")
def l6_attribution(spark, d):
    out = funnel.analyze(emails(spark, d), run_layer3=True)
    return out.select("email_id", "final_verdict", F.col("layer3.meta.status").alias("status"))


# --- corpus --------------------------------------------------------------------------------------------------------------

_PROFILE_COLUMNS = ("text", "label", "source", "mailbox_id")
_PROFILE_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", record_id AS pos, {c}::VARCHAR AS v FROM dataset" for c in _PROFILE_COLUMNS)


@query(f"""WITH long AS ({_PROFILE_SQL}), firsts AS (SELECT "column", v, min(pos) AS pos, count(*) AS n FROM long WHERE v IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY pos, v) AS r FROM firsts),
shown AS (SELECT "column", sum(n)::BIGINT AS non_null, count(*) AS distinct_values, string_agg(left(v, 60) || CASE WHEN length(v) > 60 THEN '…' ELSE '' END, ' | ' ORDER BY r) FILTER (WHERE r <= 5) AS examples FROM ranked GROUP BY "column")
SELECT l."column", l.row_count, coalesce(non_null, 0) AS non_null, coalesce(distinct_values, 0) AS distinct_values, coalesce(examples, '') AS examples FROM (SELECT "column", count(*) AS row_count FROM long GROUP BY "column") l LEFT JOIN shown USING ("column")""")
def d1_profile(spark, d):
    return corpus.profile(table(spark, d, "dataset").select("record_id", *_PROFILE_COLUMNS), "record_id")


_NAMED = "CASE label WHEN 0 THEN ' Safe ' WHEN 1 THEN 'Phish=1' WHEN 2 THEN 'Machine' ELSE 'other' END"


@query(f"SELECT record_id, label_name, CASE trim(label_name) WHEN 'Safe' THEN 0 WHEN 'Phish=1' THEN 1 WHEN 'Machine' THEN 2 END AS mapped FROM (SELECT record_id, {_NAMED} AS label_name FROM dataset) WHERE label_name <> 'other'")
def d2_d4_label_map(spark, d):
    rows = table(spark, d, "dataset").select("record_id", F.expr(_NAMED).alias("label_name"))
    mapped = corpus.map_labels(rows, "label_name", corpus.parse_label_map("Safe=0,Phish=1=1, Machine =2"), "mapped")
    return corpus.checked_labels(mapped, "label_name", "mapped", drop=True)


@query(f"SELECT record_id, {sql_strip('coalesce(source, chr(32)) || chr(10) || chr(10) || coalesce(text, chr(32))')} AS combined FROM dataset".replace("chr(32)", "''"))
def d5_subject_prepend(spark, d):
    return corpus.prepend_subject(table(spark, d, "dataset"), "source", "text", "combined").select("record_id", "combined")


@query(f"SELECT source, count(*) AS n FROM dataset WHERE length({sql_strip('coalesce(text, chr(32))')}) > 0 GROUP BY source")
def d6_drop_empty(spark, d):
    return corpus.drop_empty(table(spark, d, "dataset")).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT record_id, label, source FROM dataset QUALIFY row_number() OVER (PARTITION BY text ORDER BY record_id) = 1")
def d7_dedupe(spark, d):
    return corpus.keep_first(table(spark, d, "dataset").select("text", "record_id", "label", "source"), "text", "record_id").select("record_id", "label", "source")


@query("SELECT label, source, count(*) AS n FROM (SELECT * FROM train UNION ALL SELECT * FROM val UNION ALL SELECT * FROM test) GROUP BY label, source")
def d8_union(spark, d):
    return corpus.union_all(*(table(spark, d, t) for t in ("train", "val", "test"))).groupBy("label", "source").agg(F.count("*").alias("n"))


@query("SELECT label, count(*) AS n, CASE label WHEN 0 THEN 'ham' WHEN 1 THEN 'phishing' ELSE 'ai_phish' END AS name FROM dataset WHERE label IS NOT NULL GROUP BY label")
def d9_distribution(spark, d):
    return corpus.label_distribution(table(spark, d, "dataset"))


_SPLIT_SQL = """
usable AS (SELECT record_id, label, md5(record_id::VARCHAR || ':42') AS h FROM dataset WHERE label IS NOT NULL AND text IS NOT NULL),
counts AS (SELECT label, count(*) AS c FROM usable GROUP BY label), total AS (SELECT sum(c) AS n, (sum(c) * 15 + 99) // 100 AS n_test FROM counts),
t AS (SELECT label, c, (c * n_test) // n + CASE WHEN row_number() OVER (ORDER BY (c * n_test) % n DESC, label) <= n_test - sum((c * n_test) // n) OVER () THEN 1 ELSE 0 END AS q_test, n, n_test FROM counts, total),
r AS (SELECT *, c - q_test AS rest, n - n_test AS n_rest, ((n - n_test) * 15 + 84) // 85 AS n_val FROM t),
q AS (SELECT *, (rest * n_val) // n_rest + CASE WHEN row_number() OVER (ORDER BY (rest * n_val) % n_rest DESC, label) <= n_val - sum((rest * n_val) // n_rest) OVER () THEN 1 ELSE 0 END AS q_val FROM r),
ranked AS (SELECT u.*, row_number() OVER (PARTITION BY label ORDER BY h, record_id) AS k FROM usable u),
split AS (SELECT record_id, label, CASE WHEN k <= q_test THEN 'test' WHEN k <= q_test + q_val THEN 'val' ELSE 'train' END AS split FROM ranked JOIN q USING (label))"""


def _split(spark, d) -> DataFrame:
    return corpus.split(table(spark, d, "dataset").where("label is not null and text is not null").select("record_id", "label"), "record_id")


@query(f"WITH {_SPLIT_SQL} SELECT record_id, label, split FROM split")
def d10_split(spark, d):
    return _split(spark, d)


@query("SELECT * FROM (VALUES ('text, label', true), ('text, quality', false)) t(columns, accepted)")
def d11_schema(spark, d):
    """What the schema check accepts and refuses."""

    def accepted(*columns: str) -> bool:
        try:
            return corpus.require(table(spark, d, "dataset"), *columns) is not None
        except corpus.SchemaError:
            return False

    return spark.createDataFrame([(", ".join(c), accepted(*c)) for c in (("text", "label"), ("text", "quality"))], "columns string, accepted boolean")


_MAPPED = "CASE label WHEN 0 THEN 'Good' WHEN 1 THEN ' Bad' ELSE 'Odd' END"


@query("SELECT 'Odd' AS message, count(*) AS mapped FROM dataset WHERE label IN (0, 1)")
def d4_unmapped(spark, d):
    """Values without a label are an error that names them; dropped on demand."""
    rows = table(spark, d, "dataset").select(F.expr(_MAPPED).alias("kind"))
    mapped = corpus.map_labels(rows, "kind", corpus.parse_label_map("Good=0,Bad=1"))
    try:
        corpus.checked_labels(mapped, "kind")
        message = ""
    except ValueError as e:
        message = str(e).split("'")[1]
    return corpus.checked_labels(mapped, "kind", drop=True).agg(F.lit(message).alias("message"), F.count("*").alias("mapped"))


@query(f"WITH {_SPLIT_SQL} SELECT split, count(*) AS total, count_if(label = 0)::BIGINT AS ham, count_if(label = 1)::BIGINT AS phishing, count_if(label = 2)::BIGINT AS ai_phish FROM split GROUP BY split")
def d12_split_stats(spark, d):
    return corpus.split_stats(_split(spark, d))


_DEMO_SQL = ", ".join(f"({sql_text(t)}, {n}, 'demo')" for t, n in readers.DEMO)


@query(f"SELECT * FROM (VALUES {_DEMO_SQL}) t(text, label, source)")
def s7_demo(spark, d):
    return readers.demo_corpus(spark)


@query("SELECT text, label, (label > 0)::INT AS binary_label FROM train WHERE text IS NOT NULL AND label IS NOT NULL")
def s9_training_rows(spark, d):
    return readers.training_rows(table(spark, d, "train")).withColumn("binary_label", scorer.collapse_label(F.col("label")))


@query("SELECT row_id, label FROM test WHERE text IS NOT NULL")
def s10_evaluation_rows(spark, d):
    return readers.evaluation_rows(table(spark, d, "test")).select("row_id", "label")


def _place(spark, name: str) -> str:
    """A new folder in the shared one."""
    import uuid

    return f"{writers.scratch(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {_SPLIT_SQL} SELECT record_id, text, label, source, split FROM split JOIN (SELECT record_id, text, source FROM dataset) USING (record_id)")
def k2_csv_splits(spark, d):
    """The splits written as CSV to the shared folder and read again, texts with their quotes and line ends included."""
    rows = table(spark, d, "dataset").where("label is not null and text is not null").select("record_id", "text", "label", "source")
    path = _place(spark, "splits")
    writers.write_splits(corpus.split(rows, "record_id"), path)
    return readers.read_splits(spark, path, "record_id bigint, text string, label int, source string, split string")


@query("SELECT text, CASE label WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE 'spam?' END AS label FROM dataset WHERE label IS NOT NULL AND text IS NOT NULL")
def s4_csv_corpus(spark, d):
    """A CSV corpus with named, numbered and unknown labels."""
    rows = table(spark, d, "dataset").where("label is not null and text is not null").select("text", F.expr("CASE label WHEN 0 THEN 'Ham' WHEN 1 THEN '1' ELSE 'spam?' END").alias("label"))
    path = _place(spark, "corpus")
    rows.write.options(**writers.CSV).csv(path)
    return readers.read_csv_corpus(spark, path).select("text", "label")


@query("SELECT c_custkey::VARCHAR AS k, 'é' || c_name AS v, enc FROM customer, (VALUES ('ISO-8859-1'), ('UTF-8')) t(enc)")
def s5_encodings(spark, d):
    """The same table as CSV in two encodings; each is recognised."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.concat(F.lit("é"), "c_name").alias("v"))
    out = []
    for encoding in ("ISO-8859-1", "UTF-8"):
        path = _place(spark, "encoded")
        rows.write.options(**writers.CSV).option("encoding", encoding).csv(path)
        out.append(readers.read_csv_any(spark, path).select("k", "v", F.lit(readers.sniff_encoding(spark, path)).alias("enc")))
    return out[0].unionByName(out[1])


#: Messages as files: name below the folder, content.
_FILES = {
    "ham/a.eml": b"Subject: hi\n\nbody", "ham/deep/b.eml": b"Subject: two\r\n\r\nlines", "phishing/c.eml": b"Subject: \n\nonly text", "ai_phish/d.eml": b"Content-Type: text/html\n\n<p>caf\xc3\xa9</p> <b>x</b>",
    "other/e.eml": b"Subject: no label\n\nx", "ham/blank.eml": b"\n\n ", "ham/notes.txt": b"no message", "ham/f.eml": b"Subject: bad \xff bytes\n\nz\xfe",
}


def _mailbox(spark) -> str:
    path = _place(spark, "mail")
    for name, content in _FILES.items():
        writers.write_bytes(f"{path}/{name}", content)
    return path


@query("SELECT * FROM (VALUES ('a.eml', 'hi'), ('b.eml', 'two'), ('c.eml', ''), ('d.eml', ''), ('e.eml', 'no label'), ('blank.eml', ''), ('f.eml', 'bad  bytes')) t(file, subject)")
def s2_directory(spark, d):
    """All messages below a folder, whatever their bytes."""
    return parse.parsed(readers.read_messages(spark, _mailbox(spark))).select("file", "subject")


@query("SELECT 'b.eml' AS file, 'two' AS subject")
def s1_file(spark, d):
    return parse.parsed(readers.read_messages(spark, _mailbox(spark) + "/ham/deep/b.eml")).select("file", "subject")


@query("SELECT * FROM (VALUES ('hi' || chr(10) || chr(10) || 'body', 0, 'a.eml'), ('two' || chr(10) || chr(10) || 'lines', 0, 'b.eml'), ('only text', 1, 'c.eml'), ('café x', 2, 'd.eml'), ('bad  bytes' || chr(10) || chr(10) || 'z', 0, 'f.eml')) t(text, label, source)")
def s3_label_directory(spark, d):
    """Folders named after labels; blank messages and other folders stay out."""
    return readers.read_label_directory(spark, _mailbox(spark))


@query("SELECT 'pasted' AS subject, 'a@b.example' AS from_address, 'text' AS body")
def s6_pasted(spark, d):
    out = parse.with_body(parse.parsed(readers.from_text(spark, "Subject: pasted\nFrom: a@b.example\n\ntext")))
    return out.select("subject", "from_address", F.col("body_text").alias("body"))


@query(f"WITH {_SPLIT_SQL} SELECT * FROM (SELECT 'total' AS name, count(*) AS n FROM split UNION ALL SELECT split, count(*) FROM split GROUP BY split UNION ALL SELECT 'label ' || name, id FROM (VALUES ('ham', 0), ('phishing', 1), ('ai_phish', 2)) t(name, id))")
def k3_sidecars(spark, d):
    """The statistics and the label map beside the splits, read back from the shared folder."""
    import json

    path = _place(spark, "splits")
    writers.write_splits(_split(spark, d), path)
    stats = json.loads(writers.read_text(f"{path}/stats.json"))
    rows = [("total", stats["total"]), *((k, v["total"]) for k, v in stats["splits"].items()), *((f"label {v}", k) for k, v in writers.read_label_map(path).items())]
    return spark.createDataFrame(rows, "name string, n bigint")


@query("SELECT * FROM (VALUES ('binary', false), ('own-3class', true)) t(model, is_default)")
def k6_k7_models(spark, d):
    """Models saved to and found in the shared folder."""
    root = _place(spark, "models")
    model = scorer.train(readers.demo_corpus(spark), iterations=2)
    for name in ("own-3class", "binary"):
        writers.save_model(model, f"{root}/{name}")
    writers.write_bytes(f"{root}/notes/readme.txt", b"no model")
    loaded, labels = writers.load_model(f"{root}/own-3class")
    assert labels == LABELS and loaded.stages[-1].numClasses == 3
    return spark.createDataFrame([(n, n == writers.default_model(root)) for n in writers.list_models(root)], "model string, is_default boolean")


# --- evaluation ----------------------------------------------------------------------------------------------------------

_PRED_SQL = f"""{sql_lexical("(SELECT * FROM test WHERE text IS NOT NULL)", 'text', 'lex')},
pred AS (SELECT label AS y, CASE predicted_label WHEN 'ham' THEN 0 WHEN 'phishing' THEN 1 ELSE 2 END AS p, ({sql_count('_low', URGENCY_KEYWORDS)} > 0)::INT AS rules_pred FROM lex WHERE predicted_label IS NOT NULL)"""
_CLASS_SQL = """
sums AS (SELECT l.label, l.name, count_if(y = l.label AND p = l.label) AS t, count_if(p = l.label) AS pn, count_if(y = l.label) AS yn FROM (VALUES (0, 'ham'), (1, 'phishing'), (2, 'ai_phish')) l(label, name), pred GROUP BY ALL),
pr AS (SELECT *, CASE WHEN pn > 0 THEN t / pn ELSE 0.0 END::DOUBLE AS precision, CASE WHEN yn > 0 THEN t / yn ELSE 0.0 END::DOUBLE AS recall FROM sums),
classes AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr)"""


def _sql_binary(y: str, p: str, source: str = "pred") -> str:
    t, a, b = f"count_if({y} = 1 AND {p} = 1)", f"count_if({p} = 1)", f"count_if({y} = 1)"
    pr, rc = f"CASE WHEN {a} > 0 THEN {t} / {a} ELSE 0.0 END::DOUBLE", f"CASE WHEN {b} > 0 THEN {t} / {b} ELSE 0.0 END::DOUBLE"
    return f"SELECT precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM (SELECT {pr} AS precision, {rc} AS recall FROM {source})"


def predictions(spark, d) -> DataFrame:
    """``(y, p, rules_pred)`` of the test split under the lexical scorer."""
    rows = readers.evaluation_rows(table(spark, d, "test")).where(~C.is_blank(F.col("text")))
    index = F.create_map(*[x for k, v in LABELS.items() for x in (F.lit(v), F.lit(k))])
    out = scorer.predicted(scorer.lexical_scorer(rows, "text"), "text")
    return out.select(F.col("label").alias("y"), F.element_at(index, F.col("predicted_label")).alias("p"), (F.size(rules.urgency_hits(F.col("text"))) > 0).cast("int").alias("rules_pred"))


def _binary(df: DataFrame) -> DataFrame:
    return df.select(scorer.collapse_label(F.col("y")).alias("y"), scorer.collapse_label(F.col("p")).alias("p"), "rules_pred")


@query(f"WITH {_PRED_SQL} SELECT g.y, g.p, count(pred.y) AS n FROM (SELECT * FROM (VALUES (0), (1), (2)) a(y), (VALUES (0), (1), (2)) b(p)) g LEFT JOIN pred ON g.y = pred.y AND g.p = pred.p GROUP BY g.y, g.p")
def v1_confusion(spark, d):
    return metrics.confusion(predictions(spark, d))


@query(f"WITH {_PRED_SQL}, m AS (SELECT g.y, g.p, count(pred.y) AS n FROM (SELECT * FROM (VALUES (0), (1), (2)) a(y), (VALUES (0), (1), (2)) b(p)) g LEFT JOIN pred ON g.y = pred.y AND g.p = pred.p GROUP BY g.y, g.p) SELECT y, p, n / greatest(sum(n) OVER (PARTITION BY y), 1)::DOUBLE AS share FROM m")
def v2_row_norm(spark, d):
    return metrics.row_normalised(metrics.confusion(predictions(spark, d)))


@query(f"WITH {_PRED_SQL}, {_CLASS_SQL} SELECT label, name, precision, recall, f1, yn::BIGINT AS support, pn::BIGINT AS predicted FROM classes")
def v3_per_class(spark, d):
    return metrics.per_class(predictions(spark, d))


@query(f"WITH {_PRED_SQL} SELECT avg((y = p)::INT) AS accuracy, count(*) AS n FROM pred")
def v4_accuracy(spark, d):
    return metrics.accuracy(predictions(spark, d))


@query(f"WITH {_PRED_SQL}, {_CLASS_SQL} SELECT avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM classes WHERE yn > 0 OR pn > 0")
def v5_macro(spark, d):
    return metrics.macro_scores(predictions(spark, d))


@query(f"WITH {_PRED_SQL}, two AS (SELECT (y > 0)::INT AS y, (p > 0)::INT AS p FROM pred) {_sql_binary('y', 'p', 'two')}")
def v6_binary(spark, d):
    return metrics.binary_scores(_binary(predictions(spark, d)))


@query(f"WITH {_PRED_SQL}, {_CLASS_SQL} SELECT label, recall FROM classes")
def v7_recalls(spark, d):
    return metrics.class_recalls(predictions(spark, d))


@query(f"WITH {_PRED_SQL}, two AS (SELECT (y > 0)::INT AS y, (p > 0)::INT AS p, rules_pred AS r, greatest((p > 0)::INT, rules_pred) AS e FROM pred) SELECT 'model_only' AS layer, f1 FROM ({_sql_binary('y', 'p', 'two')}) UNION ALL SELECT 'rules_only', f1 FROM ({_sql_binary('y', 'r', 'two')}) UNION ALL SELECT 'fused', f1 FROM ({_sql_binary('y', 'e', 'two')})")
def v8_layer_compare(spark, d):
    return metrics.layer_comparison(_binary(predictions(spark, d)))


_TWO_SQL = "two AS (SELECT (y > 0)::INT AS y, (p > 0)::INT AS p, rules_pred AS r, greatest((p > 0)::INT, rules_pred) AS e FROM pred)"


@query(f"""WITH {_PRED_SQL}, {_CLASS_SQL}, {_TWO_SQL}
SELECT 'accuracy' AS name, avg((y = p)::INT)::DOUBLE AS value FROM pred UNION ALL SELECT 'n_test', count(*)::DOUBLE FROM pred
UNION ALL SELECT 'macro/' || metric, value FROM (SELECT avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM classes WHERE yn > 0 OR pn > 0) UNPIVOT (value FOR metric IN (precision, recall, f1))
UNION ALL SELECT 'per_class/' || name || '/' || metric, value FROM (SELECT name, precision, recall, f1, yn::DOUBLE AS support FROM classes) UNPIVOT (value FOR metric IN (precision, recall, f1, support))
UNION ALL SELECT 'binary_f1/model_only', f1 FROM ({_sql_binary('y', 'p', 'two')}) UNION ALL SELECT 'binary_f1/rules_only', f1 FROM ({_sql_binary('y', 'r', 'two')}) UNION ALL SELECT 'binary_f1/fused', f1 FROM ({_sql_binary('y', 'e', 'two')})""")
def v9_v10_document(spark, d):
    """All figures of the nested document, one row each."""

    def leaves(x, path=()):
        return [leaf for k, v in x.items() for leaf in leaves(v, (*path, k))] if isinstance(x, dict) else [("/".join(path), float(x))]

    return spark.createDataFrame(leaves(metrics.metrics_document(predictions(spark, d))), "name string, value double")


@query(f"WITH {_PRED_SQL}, {_CLASS_SQL} SELECT label, printf('| %s | %.3f | %.3f | %.3f | %d |', name, precision, recall, f1, yn) AS line FROM classes")
def k4_report(spark, d):
    return metrics.report_lines(metrics.per_class(predictions(spark, d)))


@query(f"WITH {_PRED_SQL}, {_CLASS_SQL} SELECT name || '/' || metric AS bar, value FROM (SELECT name, precision, recall, f1 FROM classes) UNPIVOT (value FOR metric IN (precision, recall, f1))")
def k5_plot_data(spark, d):
    long = metrics.per_class(predictions(spark, d)).unpivot("name", ["precision", "recall", "f1"], "metric", "value")
    return long.select(F.concat_ws("/", "name", "metric").alias("bar"), "value")


@query(WITH_FUSED + "SELECT email_id, json_object('final_verdict', final_verdict, 'final_risk_score', final_risk_score, 'layer2_phish_probability', p, 'layer2_ran', layer2_ran)::VARCHAR AS document FROM fused")
def k1_json(spark, d):
    out = _verdicts(spark, d)
    return out.select("email_id", writers.json_document("final_verdict", "final_risk_score", "layer2_phish_probability", "layer2_ran").alias("document"))


# --- roll-ups ------------------------------------------------------------------------------------------------------------

_COUNTS_SQL = "SELECT count(*) AS total, count_if(final_verdict = 'ai_phish')::BIGINT AS ai_phish, count_if(final_verdict = 'phishing')::BIGINT AS phishing_human, count_if(final_verdict IN ('phishing', 'ai_phish'))::BIGINT AS phishing_all, count_if(final_verdict = 'suspicious')::BIGINT AS suspicious, count_if(final_verdict = 'clean')::BIGINT AS clean FROM fused"


@query(WITH_FUSED + _COUNTS_SQL)
def b1_counts(spark, d):
    return rollup.verdict_counts(_verdicts(spark, d))


@query(WITH_FUSED + f", c AS ({_COUNTS_SQL}) SELECT " + ", ".join(f"coalesce(100.0 * {c} / nullif(total, 0), 0.0)::DOUBLE AS {c}_pct" for c in ("phishing_all", "suspicious", "clean")) + " FROM c")
def b2_shares(spark, d):
    return rollup.verdict_shares(rollup.verdict_counts(_verdicts(spark, d)))


@query(WITH_FUSED + "SELECT email_id, final_verdict, floor(final_risk_score + 0.5)::BIGINT AS score, CASE WHEN from_address = '' THEN '—' ELSE from_address END AS sender, CASE WHEN subject = '' THEN '—' ELSE subject END AS title FROM fused ORDER BY received_at DESC NULLS LAST, email_id DESC LIMIT 12")
def b3_recent(spark, d):
    out = rollup.recent(_verdicts(spark, d), [F.col("received_at").desc_nulls_last(), F.col("email_id").desc()])
    return out.select("email_id", "final_verdict", "score", "sender", "title")


@query(WITH_FUSED + "SELECT email_id, CASE WHEN final_verdict IN ('phishing', 'ai_phish') THEN 'phishing' WHEN final_verdict = 'suspicious' THEN 'suspicious' ELSE 'clean' END AS css, CASE final_verdict WHEN 'ai_phish' THEN 'AI-generated phishing' WHEN 'phishing' THEN 'Phishing' WHEN 'suspicious' THEN 'Suspicious' WHEN 'clean' THEN 'Clean' ELSE 'Unknown' END AS title, CASE WHEN final_verdict IN ('phishing', 'ai_phish') THEN 'red' WHEN final_verdict = 'suspicious' THEN 'amber' WHEN final_verdict = 'clean' THEN 'green' ELSE 'grey' END AS colour, CASE spf WHEN 'pass' THEN 'pass' WHEN 'fail' THEN 'fail' ELSE 'unknown' END AS spf_chip, CASE WHEN layer2_ran THEN 'Layer 1 + Layer 2' ELSE 'Layer 1 only' END AS path FROM fused")
def b4_b6_display(spark, d):
    v = F.col("final_verdict")
    return _verdicts(spark, d).select(
        "email_id", rollup.verdict_class(v).alias("css"), rollup.verdict_title(v).alias("title"), rollup.verdict_colour(v).alias("colour"), rollup.auth_chip(F.col("spf")).alias("spf_chip"), rollup.decision_path(F.col("layer2_ran")).alias("path")
    )


@query("SELECT assessment_id, floor(infra_risk_score + 0.5)::BIGINT AS half_up, round_even(infra_risk_score, 0)::BIGINT AS half_even, printf('%.1f', infra_risk_score) AS shown FROM risk_assessment")
def b7_numbers(spark, d):
    s = F.col("infra_risk_score")
    return table(spark, d, "risk_assessment").select("assessment_id", rollup.score_half_up(s).alias("half_up"), rollup.score_half_even(s).alias("half_even"), rollup.percent(s / 100).alias("shown"))


@query(WITH_FUSED + "SELECT email_id, message_id, from_address, sender_domain, infra_risk_score, verdict, reasons, layer2_ran, p AS layer2_phish_probability, label2 AS layer2_predicted_label, had AS layer1_had_data, final_risk_score, final_verdict FROM fused")
def flagship_funnel(spark, d):
    return _verdicts(spark, d).select(
        "email_id", "message_id", "from_address", "sender_domain", "infra_risk_score", "verdict", joined("reasons").alias("reasons"), "layer2_ran",
        "layer2_phish_probability", "layer2_predicted_label", "layer1_had_data", "final_risk_score", "final_verdict",
    )


# --- extensions ----------------------------------------------------------------------------------------------------------


@query("SELECT source, label, count(*) AS n, grouping(source)::INT AS all_sources, grouping(label)::INT AS all_labels FROM dataset GROUP BY ROLLUP (source, label)")
def ext_source_rollup(spark, d):
    return table(spark, d, "dataset").rollup("source", "label").agg(F.count("*").alias("n"), F.grouping("source").cast("int").alias("all_sources"), F.grouping("label").cast("int").alias("all_labels"))


@query("SELECT message_id, assessment_id, verdict, n FROM (SELECT *, count(*) OVER (PARTITION BY message_id) AS n FROM risk_assessment) QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY assessed_at DESC, assessment_id DESC) = 1")
def ext_latest_assessment(spark, d):
    """The latest assessment per message: a grouped maximum, so repeated messages combine before the shuffle."""
    last = F.max(F.struct("assessed_at", "assessment_id", "verdict"))
    return table(spark, d, "risk_assessment").groupBy("message_id").agg(last.alias("l"), F.count("*").alias("n")).select("message_id", "l.assessment_id", "l.verdict", "n")


@query(WITH_FUSED + "SELECT final_verdict, count(*) AS n FROM fused GROUP BY final_verdict")
def ext_stream_counts(spark, d):
    """Verdict counts of the stream; equal to those of the table."""
    import uuid

    from graylark.streaming.scoring import message_stream, running_counts, scored_stream

    path = f"{d}/raw_email.parquet"
    name = f"verdicts_{uuid.uuid4().hex}"
    stream = message_stream(spark, path, spark.read.parquet(path).schema)
    running_counts(scored_stream(stream)).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
