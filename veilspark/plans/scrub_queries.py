"""Queries of detection, spans, redaction and audit, over all payloads of scrub_requests and all texts of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CITATIONS, PRIORITY
from ..functions.arrays import let, rows_of
from ..operators import detect, evaluate, jsonscrub, spans
from ..operators.scrub import citation, explode_flags, flag_counts, residual, scrub
from ..sources.readers import health
from ..sources.tables import table


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "scrub_requests").select("request_id", "payload")


def _scrubbed(spark: SparkSession, sf: str) -> DataFrame:
    return scrub(table(spark, sf, "scrub_requests").select("request_id", "transaction_id", "replica", "received_at", "payload"), "transaction_id", "payload")


P = lambda: F.col("payload")


def ssn_detect(spark: SparkSession, sf: str) -> DataFrame:
    return _payloads(spark, sf).select("request_id", detect.count_matches(P(), detect.SSN).alias("n"))


def ssn_redact(spark: SparkSession, sf: str) -> DataFrame:
    return _payloads(spark, sf).select("request_id", detect.ssn_redact(P()).alias("text"))


def ssn_invalid_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with something of a number's shape that can't be one."""
    shape = r"(?<![\p{L}\p{N}_])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}_])"
    n = _payloads(spark, sf).select("request_id", detect.count_matches(P(), shape).alias("shaped"), detect.count_matches(F.regexp_replace(P(), r"\d{3}([. ])\d{2}\1\d{4}", ""), detect.SSN).alias("valid"))
    return n.where(F.col("shaped") > F.col("valid")).select("request_id", "shaped", "valid")


def pan_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return rows_of(_payloads(spark, sf), detect.pan_candidates(P()), "request_id", item="c").select("request_id", detect.ascii_digits(F.col("c")).alias("candidate"))


def luhn_valid(spark: SparkSession, sf: str) -> DataFrame:
    found = rows_of(_payloads(spark, sf), detect.pan_candidates(P()), "request_id", item="c")
    return found.groupBy("request_id").agg(F.count_if(detect.luhn_valid(F.col("c"))).alias("valid"), F.count("*").alias("candidates"))


def pan_redact(spark: SparkSession, sf: str) -> DataFrame:
    return _payloads(spark, sf).select("request_id", detect.pan_redact(detect.ssn_redact(P())).alias("text"))


def _rule(entity: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        found = rows_of(_payloads(spark, sf), detect.rule_spans(detect.ascii_digits(P()), entity, 0), "request_id", item="x")
        return found.select("request_id", "x.s", "x.e", F.col("x.p").alias("placeholder"))

    return query


def _exploded(spark: SparkSession, sf: str) -> DataFrame:
    return rows_of(_payloads(spark, sf), detect.all_spans(P()), "request_id", item="x").select("request_id", "x.s", "x.e", "x.p")


def span_islands(spark: SparkSession, sf: str) -> DataFrame:
    return spans.span_islands(_exploded(spark, sf), "request_id")


def span_merge(spark: SparkSession, sf: str) -> DataFrame:
    merged = rows_of(_payloads(spark, sf), spans.merge_spans(detect.all_spans(P())), "request_id", item="x")
    return merged.select("request_id", "x.s", "x.e", F.col("x.p").alias("placeholder"), F.array_join(F.array_sort("x.f"), "|").alias("flags"))


def placeholder_priority(spark: SparkSession, sf: str) -> DataFrame:
    return _exploded(spark, sf).groupBy(F.col("p").alias("placeholder"), spans.priority(F.col("p")).alias("priority")).agg(F.count("*").alias("n"))


def email_url_suppress(spark: SparkSession, sf: str) -> DataFrame:
    """Web addresses that lie inside an address of mail, counted within the row."""
    of = lambda xs, p: F.filter(xs, lambda x: x["p"] == p)
    inside = lambda m, w: spans.contains(m["s"], m["e"], w["s"], w["e"])
    count = let(detect.all_spans(P()), lambda xs: F.aggregate(of(xs, "EMAIL"), F.lit(0), lambda n, m: n + F.size(F.filter(of(xs, "URL"), lambda w: inside(m, w)))))
    return _payloads(spark, sf).select("request_id", count.alias("suppressed")).where("suppressed > 0")


def redacted_text(spark: SparkSession, sf: str) -> DataFrame:
    return _scrubbed(spark, sf).select("request_id", F.col("clean_text").alias("text"))


def audit_log(spark: SparkSession, sf: str) -> DataFrame:
    return explode_flags(_scrubbed(spark, sf), "request_id")


def flag_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Each flag with its count, its texts and its citation: the flagship."""
    return audit_log(spark, sf).groupBy("flag", "cfr_citation").agg(F.sum("count").alias("total"), F.count("*").alias("texts"))


def citation_join(spark: SparkSession, sf: str) -> DataFrame:
    """Flags named in the responses with their regulation, by a left join to the table of nine citations."""
    r = table(spark, sf, "scrub_responses").select("response_id", F.explode(F.map_keys("audit_log.flags_triggered")).alias("flag"))
    known = F.broadcast(spark.createDataFrame(list(CITATIONS.items()), "flag string, cfr_citation string"))
    return r.join(known, "flag", "left").groupBy("flag", "cfr_citation").agg(F.count("*").alias("n"))


def citation_lookup(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "scrub_responses").select(F.explode(F.map_keys("audit_log.flags_triggered")).alias("flag"))
    return r.select("flag", citation(F.col("flag")).alias("cfr_citation")).groupBy("flag", "cfr_citation").agg(F.count("*").alias("n"))


def char_delta(spark: SparkSession, sf: str) -> DataFrame:
    log = F.col("audit_log")
    return _scrubbed(spark, sf).select("request_id", log["original_char_count"].alias("chars_in"), log["redacted_char_count"].alias("chars_out"), (log["original_char_count"] - log["redacted_char_count"]).alias("chars_removed"))


def clean_vs_flagged(spark: SparkSession, sf: str) -> DataFrame:
    any_flag = F.size("audit_log.flags_triggered") > 0
    return _scrubbed(spark, sf).groupBy("replica").agg(F.count_if(any_flag).alias("flagged"), F.count_if(~any_flag).alias("clean"))


def top_flagged(spark: SparkSession, sf: str) -> DataFrame:
    """Report: the ten payloads with most hits."""
    return audit_log(spark, sf).groupBy("request_id").agg(F.sum("count").alias("hits")).orderBy(F.desc("hits"), "request_id").limit(10)


def recent_audit8(spark: SparkSession, sf: str) -> DataFrame:
    """Report: the eight newest requests with their flags."""
    last = _scrubbed(spark, sf).orderBy(F.desc("received_at"), F.desc("request_id")).limit(8)
    return last.select("request_id", F.left("transaction_id", F.lit(16)).alias("txn"), evaluate.flag_names(flag_counts(F.col("audit_log.flags_triggered"))).alias("flags"))


def residual_check(spark: SparkSession, sf: str) -> DataFrame:
    """What a second look finds in texts just scrubbed, and in the clean_text as delivered."""
    own = _scrubbed(spark, sf).select(F.lit("own").alias("side"), residual(F.col("clean_text")).alias("n"))
    theirs = table(spark, sf, "scrub_responses").select(F.lit("delivered").alias("side"), residual(F.col("clean_text")).alias("n"))
    return own.unionByName(theirs).groupBy("side").agg(F.sum("n").alias("left_over"), F.count_if(F.col("n") > 0).alias("texts"))


def document_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Flags of the corpus by source."""
    docs = table(spark, sf, "documents").select("doc_id", F.lower(F.btrim("source")).alias("source"), "text")
    return explode_flags(scrub(docs, "doc_id", "text"), "source").groupBy("source", "flag").agg(F.sum("count").alias("total"))


def flag_cube(spark: SparkSession, sf: str) -> DataFrame:
    rows = explode_flags(_scrubbed(spark, sf), "replica")
    return rows.cube("replica", "flag").agg(F.sum("count").alias("total"), F.grouping_id().cast("int").alias("level"))


def json_deep_scrub(spark: SparkSession, sf: str) -> DataFrame:
    return jsonscrub.scrub_bodies(_payloads(spark, sf), "request_id", "payload").select("request_id", "body", "is_json", "bytes_in", "bytes_out")


def json_flag_sum(spark: SparkSession, sf: str) -> DataFrame:
    done = jsonscrub.scrub_bodies(_payloads(spark, sf), "request_id", "payload")
    return done.select("is_json", F.explode("flags").alias("flag", "n")).groupBy("is_json", "flag").agg(F.sum("n").alias("total"))


def body_decode(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "response_batches").select("batch_id", F.col("body").cast("binary").alias("b"))
    return b.select("batch_id", jsonscrub.is_json(jsonscrub.decode(F.col("b"))).alias("is_json"), F.octet_length("b").alias("bytes"))


def header_filter(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "response_batches").where(F.col("body").isNotNull())
    headers = F.create_map(F.lit("Host"), F.coalesce("gateway", F.lit("-")), F.lit("Content-Length"), F.lit("1"), F.lit("x-trace"), F.col("batch_id").cast("string"))
    h = b.select("batch_id", F.explode(jsonscrub.forward_headers(headers, F.octet_length("body"))).alias("name", "value"))
    return h.select("batch_id", "name", "value")


def target_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of all receipts' targets; those without one, which is an error where a request is sent, have null."""
    t = table(spark, sf, "compliance_receipts")
    known = {"model-a": "https://a.example/v1", "model-b": "https://b.example/v1"}
    return t.groupBy(jsonscrub.resolve_target(F.col("downstream_target"), known, strict=False).alias("target")).agg(F.count("*").alias("n"))


def placeholder_classes(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "scrub_responses").select(F.explode(evaluate.placeholder_classes(F.col("clean_text"))).alias("kind"))
    return r.groupBy("kind").agg(F.count("*").alias("n"))


def health_row(spark: SparkSession, sf: str) -> DataFrame:
    return health(spark)


QUERIES = {f.__name__: f for f in (
    ssn_detect, ssn_redact, ssn_invalid_filter, pan_candidates, luhn_valid, pan_redact, span_islands, span_merge, placeholder_priority, email_url_suppress, redacted_text,
    audit_log, flag_rollup, citation_join, citation_lookup, char_delta, clean_vs_flagged, top_flagged, recent_audit8, residual_check, document_flags, flag_cube, json_deep_scrub, json_flag_sum,
    body_decode, header_filter, target_resolve, placeholder_classes, health_row)}
_RULES = {"phone_spans": "PHONE_NUMBER", "email_spans": "EMAIL_ADDRESS", "url_spans": "URL", "ip_spans": "IP_ADDRESS", "bank_spans": "US_BANK_NUMBER", "location_spans": "LOCATION", "person_spans": "PERSON", "date_spans": "DATE", "org_spans": "ORG"}
QUERIES |= {name: _rule(entity) for name, entity in _RULES.items()}


# ---- SQL: the same rules in RE2's syntax over the ASCII view; what is found there is cut from the text itself -------------


#: Of the same length in ASCII: letters and numbers as X and x, all else as ~. RE2 knows no other letters at a word's border.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_AWAY = "".join(chr(0xE000 + i) for i in range(26))


def _view(c: str, digits: bool = True) -> str:
    plain = f"translate({c}, '٠١٢٣٤٥٦٧٨٩０１２３４５６７８９', '01234567890123456789')" if digits else c
    upper = rf"translate(regexp_replace(translate({plain}, '{_UPPER}', '{_AWAY}'), '\p{{Lu}}', 'X', 'g'), '{_AWAY}', '{_UPPER}')"
    return rf"regexp_replace(regexp_replace({upper}, '[^\x00-\x7F\p{{L}}\p{{N}}]', '~', 'g'), '[^\x00-\x7F]', 'x', 'g')"


def digit_view(c: str) -> str:
    """Of the same length: letters as x, digits of other scripts as A to J. A number's first digit must be an ASCII one, the rest may be any."""
    marked = f"translate(regexp_replace({c}, '[A-Za-z_]', 'x', 'g'), '٠١٢٣٤٥٦٧٨٩０１２３４５６７８９', 'ABCDEFGHIJABCDEFGHIJ')"
    return rf"regexp_replace(regexp_replace({marked}, '[^\x00-\x7F\p{{L}}\p{{N}}]', '~', 'g'), '[^\x00-\x7F]', 'x', 'g')"


_A, _G, _S = r"(?:[1-578]D{2}|0(?:0N|ND)|6(?:[0-57-9A-J]D|6[0-57-9A-J]))", r"(?:0N|ND)", r"(?:000N|00ND|0NDD|NDDD)"
SSN_RE2 = rf"\b(?:{_A}-{_G}-{_S}|{_A}\.{_G}\.{_S}|{_A} {_G} {_S})\b".replace("D", "[0-9A-J]").replace("N", "[1-9A-J]")
DASHED_RE2 = rf"\b{_A}-{_G}-{_S}\b".replace("D", "[0-9A-J]").replace("N", "[1-9A-J]")
_PAN2 = r"\b(?:\d[ -]*?){13,19}\b"
_O = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_CAP2 = "[A-Z][a-z][A-Za-z]*"
_NAME2 = f"{_CAP2}(?:[''-]{_CAP2})*"
_ZIP2 = r"[A-Z]{2} \d{5}(?:-\d{4})?"
_RE2 = {
    "PHONE": r"(?:\+1[-. ]?)?(?:\(\d{3}\) ?|\b\d{3}[-. ])\d{3}[-. ]\d{4}\b",
    "EMAIL": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "URL": r"""https?://[^\s<>"'',;]*[^\s<>"'',;.!?)]|\b\w[\w.-]*\.(?:com|org|net|edu|gov|io)\b""",
    "IP": rf"\b(?:{_O}\.){{3}}{_O}\b",
    "BANK_NUMBER": r"\b\d{8,17}\b",
    "ADDRESS": rf"(?:^|[^\w''-])(\d{{1,6}} (?:[NSEW]\.? )?(?:{_NAME2} ){{1,3}}(?:{detect.STREETS})\b(?:(?:,? (?:Apt|Suite|Unit)\.? [0-9A-Za-z]{{1,8}})?,? {_NAME2}(?: {_NAME2}){{0,2}}, {_ZIP2}\b)?|{_NAME2}(?: {_NAME2}){{0,2}}, {_ZIP2}\b)",
    "PERSON": rf"\b(?:(?:{detect.CUES})[.:,]? ){{1,3}}((?:[A-Z]\. ){{0,2}}{_NAME2}(?: [A-Z]\.)?(?: {_NAME2}){{0,2}})\b",
    "DATE": rf"\b(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/(?:\d{{4}}|\d{{2}})|\d{{1,2}}\.\d{{1,2}}\.\d{{4}}|(?:{detect.MONTHS})\.? \d{{1,2}}(?:st|nd|rd|th)?(?:,? \d{{4}})?|\d{{1,2}}(?:st|nd|rd|th)? (?:{detect.MONTHS})(?:,? \d{{4}})?|{detect.DAYS})\b",
    "ORG": rf"\b(?:St\. )?(?:{_CAP2}(?:''s)? (?:of |and |& )?){{1,4}}(?:{detect.ORGS})\b",
}
_GROUPED = ("ADDRESS", "PERSON")
_LEN = lambda l: f"coalesce(list_sum(list_transform({l}, lambda x: length(x))), 0)"
#: A text with what lies at the places of the matches kc, between the gaps kg, replaced.
_CUT = lambda t: f"array_to_string(list_transform(range(1, 1 + len(kg)), lambda i: substr({t}, CAST(1 + {_LEN('kg[1:i-1]')} + {_LEN('kc[1:i-1]')} AS BIGINT), length(kg[i]))), '[REDACTED_SSN]')"
_LUHN = r"""(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, 1 + length({d})), lambda k: CASE WHEN k % 2 = 1 THEN CAST(substr(reverse({d}), CAST(k AS INT), 1) AS INT) WHEN CAST(substr(reverse({d}), CAST(k AS INT), 1) AS INT) > 4 THEN CAST(substr(reverse({d}), CAST(k AS INT), 1) AS INT) * 2 - 9 ELSE CAST(substr(reverse({d}), CAST(k AS INT), 1) AS INT) * 2 END)) % 10 = 0)"""


def _luhn(c: str) -> str:
    return _LUHN.format(d=rf"regexp_replace({c}, '\D', '', 'g')")


def _spans_sql(source: str, key: str = "request_id") -> str:
    """CTEs `spans` (key, s, e, p, o) over `source` (key, t)."""
    one = lambda p, o: rf"""SELECT {key}, '{p}' AS p, {o} AS o, regexp_extract_all(t, '{_RE2[p]}') AS c, regexp_extract_all(t, '{_RE2[p]}', {int(p in _GROUPED)}) AS x, regexp_split_to_array(t, '{_RE2[p]}') AS g FROM {source}"""
    cues = ", ".join(f"'{c}'" for c in detect.CUES.split("|"))
    ranks = ", ".join(f"('{k}', {v})" for k, v in PRIORITY.items())
    return f""", hits AS ({" UNION ALL ".join(one(p, o) for o, p in enumerate(_RE2))}),
spans AS (SELECT {key}, p, o, e - CAST(length(x) AS INT) AS s, e FROM (SELECT {key}, p, o, CAST({_LEN("g[1:i]")} + {_LEN("c[1:i]")} AS INT) AS e, x[i] AS x FROM hits, unnest(range(1, 1 + len(c))) u(i)) WHERE NOT contains(x, 'REDACTED') AND x NOT IN ({cues})),
ranked AS (SELECT * FROM spans JOIN (VALUES {ranks}) r(p, rank) USING (p)),
ordered AS (SELECT *, max(e) OVER (PARTITION BY {key} ORDER BY s, s - e, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ranked),
numbered AS (SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY s, s - e, o) AS island FROM ordered),
merged AS (SELECT {key}, island, min(s) AS s, max(e) AS e, count(*) AS n,
  arg_min(p, (-rank, s, s - e, o)) AS p,
  list_sort(list_distinct(list(CASE WHEN p = 'URL' AND mail THEN 'HIPAA_PHI_EMAIL' ELSE 'HIPAA_PHI_' || p END))) AS f
  FROM (SELECT *, bool_or(p = 'EMAIL') OVER (PARTITION BY {key}, island) AS mail FROM numbered) GROUP BY {key}, island)"""


_RAW = f"WITH raw AS (SELECT request_id, {_view('payload')} AS t FROM scrub_requests)"


def _cards(t: str) -> str:
    """A text, real or view, with the valid ones of the candidates c, which lie between the gaps g, replaced."""
    at = f"CAST(1 + {_LEN('g[1:i]')} + {_LEN('c[1:i-1]')} AS BIGINT)"
    gap = f"substr({t}, CAST(1 + {_LEN('g[1:i-1]')} + {_LEN('c[1:i-1]')} AS BIGINT), length(g[i]))"
    return f"CASE WHEN len(c) = 0 THEN {t} ELSE array_to_string(list_transform(range(1, 1 + len(g)), lambda i: {gap} || coalesce(CASE WHEN {_luhn('c[i]')} THEN '[REDACTED_PAN]' ELSE substr({t}, {at}, length(c[i])) END, '')), '') END"


def _pipeline(table_: str, key: str, text: str, more: str = "") -> str:
    """CTEs up to `merged` and `done` (key, clean) for the whole scrub."""
    return rf"""WITH t0 AS (SELECT {key}{more}, {text} AS r, {_view(text)} AS t, {digit_view(text)} AS k FROM {table_}),
t1 AS (SELECT * EXCLUDE (k, kc, kg), len(kc) AS ssn, {_CUT("t")} AS u, {_CUT("r")} AS ur FROM (SELECT *, regexp_extract_all(k, '{SSN_RE2}') AS kc, regexp_split_to_array(k, '{SSN_RE2}') AS kg FROM t0)),
t2 AS (SELECT *, regexp_extract_all(u, '{_PAN2}') AS c, regexp_split_to_array(u, '{_PAN2}') AS g FROM t1),
t3 AS (SELECT *, coalesce(len(list_filter(c, lambda y: {_luhn("y")})), 0) AS pan, {_cards("u")} AS w, {_cards("ur")} AS wr FROM t2),
src AS (SELECT {key}{more}, ssn, pan, w AS t, wr AS r, length(t3.r) AS chars_in FROM t3)
{_spans_sql("src", key)},
cut AS (SELECT m.{key}, string_agg(substr(r, coalesce(pe, 0) + 1, s - coalesce(pe, 0)) || '[REDACTED_' || p || ']', '' ORDER BY s) AS head, max(e) AS last_e FROM (SELECT *, lag(e) OVER (PARTITION BY {key} ORDER BY s) AS pe FROM merged) m JOIN src USING ({key}) GROUP BY m.{key}),
done AS (SELECT {key}, CASE WHEN head IS NULL THEN r ELSE head || substr(r, last_e + 1) END AS clean, chars_in FROM src LEFT JOIN cut USING ({key})),
flags AS (SELECT {key}, flag, CAST(sum(n) AS INT) AS n FROM (
  SELECT {key}, 'HIPAA_SSN' AS flag, ssn AS n FROM src WHERE ssn > 0 UNION ALL SELECT {key}, 'PCI_PAN', pan FROM src WHERE pan > 0
  UNION ALL SELECT {key}, unnest(f), 1 FROM merged) GROUP BY {key}, flag)"""


_CITE = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in CITATIONS.items()) + ") cite(flag, cfr_citation)"
_REQUESTS = _pipeline("scrub_requests", "request_id", "payload")

def _residual() -> str:
    """Numbers, cards and spans that are found in the texts just scrubbed and in those delivered."""
    return f"""WITH first AS ({_REQUESTS} SELECT request_id, clean FROM done),
texts AS (SELECT 'own' AS side, 'own/' || request_id AS bk, clean AS x FROM first UNION ALL SELECT 'delivered', 'delivered/' || response_id, clean_text FROM scrub_responses),
v AS (SELECT side, bk, {_view('x')} AS t, {digit_view('x')} AS dk FROM texts)
{_spans_sql("v", "bk")},
per AS (SELECT side, len(regexp_extract_all(dk, '{SSN_RE2}')) + len(list_filter(regexp_extract_all(t, '{_PAN2}'), lambda y: {_luhn("y")})) + coalesce(s.n, 0) AS n FROM v LEFT JOIN (SELECT bk, count(*) AS n FROM spans GROUP BY bk) s USING (bk))
SELECT side, CAST(sum(n) AS BIGINT) AS left_over, count(*) FILTER (n > 0) AS texts FROM per GROUP BY side"""


#: The prompt texts of the payloads that are JSON, by place, and the payloads that aren't.
_KEYS = ", ".join(f"'{k}'" for k in jsonscrub.TEXT_KEYS)
_BODY = f"""(SELECT request_id || '/' || j.id AS bk, request_id, j.id AS i, j.value->>'$' AS payload FROM (SELECT request_id, CAST(payload AS JSON) AS b FROM scrub_requests WHERE json_valid(payload)) s, json_tree(b) j WHERE j.type = 'VARCHAR' AND lower(j.key) IN ({_KEYS})
  UNION ALL SELECT request_id || '/', request_id, NULL, payload FROM scrub_requests WHERE NOT json_valid(payload)) q"""
#: JSON text with what is beyond ASCII as \uXXXX.
_ESCAPED = r"""array_to_string(list_transform(range(1, 1 + length({0})), lambda i: CASE WHEN unicode(substr({0}, i, 1)) < 128 THEN substr({0}, i, 1) WHEN unicode(substr({0}, i, 1)) < 65536 THEN printf('\u%04x', unicode(substr({0}, i, 1)))
  ELSE printf('\u%04x\u%04x', 55296 + ((unicode(substr({0}, i, 1)) - 65536) >> 10), 56320 + ((unicode(substr({0}, i, 1)) - 65536) & 1023)) END), '')"""
#: Payloads are written with ", " and ": ", so that the text put in for another is all that changes.
_DEEP = _pipeline(_BODY, "bk", "payload", ", request_id, i") + f""", filled AS (
  SELECT request_id, list_reduce(list({{'t': CAST(to_json(q.payload) AS VARCHAR), 'n': CAST(to_json(clean) AS VARCHAR)}} ORDER BY i), lambda a, x: {{'t': replace(a.t, x.t, x.n), 'n': a.n}}, {{'t': any_value(s.payload), 'n': ''}}).t AS b
  FROM {_BODY} JOIN done USING (bk) JOIN scrub_requests s USING (request_id) WHERE i IS NOT NULL GROUP BY request_id),
bodies AS (
  SELECT request_id, payload, coalesce(json_valid(payload), false) AS is_json, CASE WHEN json_valid(payload) THEN {_ESCAPED.format("coalesce(b, payload)")} ELSE clean END AS body
  FROM scrub_requests LEFT JOIN filled USING (request_id) LEFT JOIN (SELECT split_part(bk, '/', 1) AS r, clean FROM done WHERE bk LIKE '%/') d ON r = CAST(request_id AS VARCHAR))"""

ORACLE = {
    "json_flag_sum": _pipeline(_BODY, "bk", "payload", ", i") + " SELECT i IS NOT NULL AS is_json, flag, CAST(sum(n) AS BIGINT) AS total FROM flags JOIN src USING (bk) GROUP BY 1, 2",
    "json_deep_scrub": _DEEP + " SELECT request_id, body, is_json, CAST(octet_length(encode(payload)) AS INT) AS bytes_in, CAST(octet_length(encode(body)) AS INT) AS bytes_out FROM bodies",
    "residual_check": _residual(),
    "ssn_detect": f"SELECT request_id, CAST(len(regexp_extract_all({digit_view('payload')}, '{SSN_RE2}')) AS INT) AS n FROM scrub_requests",
    "ssn_redact": _REQUESTS + " SELECT request_id, ur AS text FROM t1",
    "ssn_invalid_filter": rf"SELECT * FROM (SELECT request_id, CAST(len(regexp_extract_all({digit_view('payload')}, '\b[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}\b')) AS INT) AS shaped, CAST(len(regexp_extract_all({digit_view('payload')}, '{DASHED_RE2}')) AS INT) AS valid FROM scrub_requests) WHERE shaped > valid",
    "pan_candidates": f"SELECT request_id, unnest(regexp_extract_all({_view('payload')}, '{_PAN2}')) AS candidate FROM scrub_requests",
    "luhn_valid": f"SELECT request_id, count(*) FILTER ({_luhn('c')}) AS valid, count(*) AS candidates FROM (SELECT request_id, unnest(regexp_extract_all({_view('payload')}, '{_PAN2}')) AS c FROM scrub_requests) GROUP BY request_id",
    "pan_redact": _REQUESTS + " SELECT request_id, wr AS text FROM t3",
    "span_islands": _RAW + _spans_sql("raw") + " SELECT request_id, s, e, n FROM merged",
    "span_merge": _RAW + _spans_sql("raw") + " SELECT request_id, s, e, p AS placeholder, array_to_string(f, '|') AS flags FROM merged",
    "placeholder_priority": _RAW + _spans_sql("raw") + " SELECT p AS placeholder, rank AS priority, count(*) AS n FROM ranked GROUP BY p, rank",
    "email_url_suppress": _RAW + _spans_sql("raw") + " SELECT a.request_id, count(*) AS suppressed FROM spans a JOIN spans b ON a.request_id = b.request_id AND a.p = 'EMAIL' AND b.p = 'URL' AND a.s <= b.s AND b.e <= a.e GROUP BY a.request_id",
    "redacted_text": _REQUESTS + " SELECT request_id, clean AS text FROM done",
    "audit_log": _REQUESTS + f" SELECT request_id, flag, n AS count, cfr_citation FROM flags LEFT JOIN {_CITE} USING (flag)",
    "flag_rollup": _REQUESTS + f" SELECT flag, cfr_citation, CAST(sum(n) AS BIGINT) AS total, count(*) AS texts FROM flags LEFT JOIN {_CITE} USING (flag) GROUP BY flag, cfr_citation",
    "citation_join": f"SELECT flag, cfr_citation, count(*) AS n FROM (SELECT unnest(map_keys(audit_log.flags_triggered)) AS flag FROM scrub_responses) LEFT JOIN {_CITE} USING (flag) GROUP BY flag, cfr_citation",
    "citation_lookup": f"SELECT flag, cfr_citation, count(*) AS n FROM (SELECT unnest(map_keys(audit_log.flags_triggered)) AS flag FROM scrub_responses) LEFT JOIN {_CITE} USING (flag) GROUP BY flag, cfr_citation",
    "char_delta": _REQUESTS + " SELECT request_id, CAST(chars_in AS INT) AS chars_in, CAST(length(clean) AS INT) AS chars_out, CAST(chars_in - length(clean) AS INT) AS chars_removed FROM done",
    "clean_vs_flagged": _REQUESTS + " SELECT replica, count(DISTINCT f.request_id) AS flagged, count(DISTINCT r.request_id) - count(DISTINCT f.request_id) AS clean FROM scrub_requests r LEFT JOIN flags f USING (request_id) GROUP BY replica",
    "top_flagged": _REQUESTS + " SELECT request_id, CAST(sum(n) AS BIGINT) AS hits FROM flags GROUP BY request_id ORDER BY hits DESC, request_id LIMIT 10",
    "recent_audit8": _REQUESTS + " SELECT r.request_id, left(transaction_id, 16) AS txn, coalesce(string_agg(flag, ', ' ORDER BY flag), 'CLEAN') AS flags FROM (SELECT * FROM scrub_requests ORDER BY received_at DESC, request_id DESC LIMIT 8) r LEFT JOIN flags USING (request_id) GROUP BY ALL",
    "document_flags": _pipeline("documents", "doc_id", "text") + " SELECT lower(trim(source)) AS source, flag, CAST(sum(n) AS BIGINT) AS total FROM flags JOIN documents USING (doc_id) GROUP BY 1, 2",
    "flag_cube": _REQUESTS + " SELECT replica, flag, CAST(sum(n) AS BIGINT) AS total, CAST(grouping(replica, flag) AS INT) AS level FROM flags JOIN scrub_requests USING (request_id) GROUP BY CUBE (replica, flag)",
    "body_decode": "SELECT batch_id, CASE WHEN body IS NULL THEN false ELSE json_valid(body) END AS is_json, CAST(octet_length(encode(body)) AS INT) AS bytes FROM response_batches",
    "header_filter": "SELECT batch_id, unnest(['x-trace', 'content-length']) AS name, unnest([CAST(batch_id AS VARCHAR), CAST(octet_length(encode(body)) AS VARCHAR)]) AS value FROM response_batches WHERE body IS NOT NULL",
    "target_resolve": "SELECT CASE WHEN trim(downstream_target) = '' THEN NULL WHEN downstream_target = 'model-a' THEN 'https://a.example/v1' WHEN downstream_target = 'model-b' THEN 'https://b.example/v1' ELSE downstream_target END AS target, count(*) AS n FROM compliance_receipts GROUP BY 1",
    "placeholder_classes": r"SELECT CASE WHEN contains(k, 'SSN') THEN 'ssn' WHEN regexp_matches(k, 'PAN|CARD|CC') THEN 'pan' ELSE 'generic' END AS kind, count(*) AS n FROM (SELECT unnest(regexp_extract_all(clean_text, '\[REDACTED_[A-Z_]+\]')) AS k FROM scrub_responses) GROUP BY 1",
    "health_row": "SELECT 'ok' AS status, 'veilspark' AS service",
}
ORACLE |= {name: _RAW + _spans_sql("raw") + f" SELECT request_id, s, e, p AS placeholder FROM spans WHERE p = '{p}'" for name, p in zip(_RULES, _RE2)}
