import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from veilspark.functions.crypto import canonical_json, decrypt, encrypt, hmac_sha256, load_key, vault_token
from veilspark.operators import attest, evaluate, jsonscrub, vault
from veilspark.sources.sinks import dispatch

KEY = bytes(range(32))


@pytest.fixture(scope="module")
def chain(spark):
    rows = [(f"c{i % 2}", f"txn_{i}", f"2025-01-01T00:00:{i:02d}.000000+00:00", ["HIPAA_SSN"] if i % 3 else [], 10 + i, 12, None if i % 2 else "modèle 😀", i) for i in range(12)]
    events = spark.createDataFrame(rows, "chain_id string, transaction_id string, issued_at string, detected array<string>, char_in int, char_out int, downstream_target string, seq int").withColumn("redacted", F.col("detected"))
    return attest.issue(events, KEY, ["seq"]).cache()


def test_issue_links_and_signs(chain):
    rows = sorted(chain.collect(), key=lambda r: (r.chain_id, r.chain_position))
    prev = None
    for r in rows:
        d = r.asDict()
        d.pop("chain_id")
        stored = d.pop("receipt_hash")
        assert stored == hmac.new(KEY, json.dumps(d, sort_keys=True, separators=(",", ":")).encode(), hashlib.sha256).hexdigest()
        assert r.previous_receipt_hash == (attest.genesis_hash() if r.chain_position == 0 else prev)
        prev = stored
    assert [r.chain_position for r in rows] == [*range(6), *range(6)]


def test_verify_and_tamper(spark, chain):
    ok = lambda df: {r.chain_id: (r.valid, r.first_bad) for r in attest.verify(df, KEY).collect()}
    assert ok(chain) == {"c0": (True, None), "c1": (True, None)}
    edited = chain.withColumn("chars_removed", F.when((F.col("chain_id") == "c0") & (F.col("chain_position") == 3), 99).otherwise(F.col("chars_removed")))
    assert ok(edited) == {"c0": (False, 3), "c1": (True, None)}
    assert ok(chain.where("chain_position <> 2 or chain_id = 'c1'"))["c0"] == (False, 3)
    assert ok(chain.where("chain_position <> 0 or chain_id = 'c1'"))["c0"][0] is False
    assert ok(chain.unionByName(chain.where("chain_position = 4")))["c0"] == (False, 4)
    assert ok(chain.where("chain_position < 5")) == {"c0": (True, None), "c1": (True, None)}  # a cut tail isn't seen
    assert ok(chain.limit(0)) == {}


def test_latest_and_event(chain):
    assert attest.latest_receipt(chain, "chain_id").select("chain_position").distinct().collect()[0][0] == 5
    assert attest.event_payload(chain).columns == ["event_type", "source", "receipt_id", "transaction_id", "issued_at", "compliance_frameworks", "pii_classes_detected", "pii_classes_redacted", "zero_pii_egress_confirmed", "chain_position", "receipt_hash", "previous_receipt_hash"]


def test_dispatch(chain):
    events = attest.event_payload(chain)
    assert {r.sent for r in dispatch(events, None).collect()} == {False}
    assert {r.sent for r in dispatch(events, "http://x", send=lambda *a: 200).collect()} == {True}
    assert {r.sent for r in dispatch(events, "http://x", send=lambda *a: 500).collect()} == {False}
    assert {r.sent for r in dispatch(events, "http://x", token="t", send=lambda u, b, h, t: 200 if h.get("Authorization") == "Bearer t" else 400).collect()} == {True}

    def broken(*_):
        raise OSError

    assert {r.sent for r in dispatch(events, "http://x", send=broken).collect()} == {False}


def test_crypto(spark):
    texts = ["", "abc", "é — 😀", 'quote " \\ tab\t', "x" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", hmac_sha256(F.col("t"), KEY).alias("m"), canonical_json({"b": F.col("t"), "a": F.lit(None).cast("string")}).alias("j")).collect()
    for r in got:
        assert r.m == hmac.new(KEY, r.t.encode(), hashlib.sha256).hexdigest()
        assert r.j == json.dumps({"a": None, "b": r.t}, sort_keys=True, separators=(",", ":"))
    ciphers = df.select("t", encrypt(F.col("t"), KEY).alias("c")).collect()
    again = spark.createDataFrame([(r.t, r.c) for r in ciphers], "t string, c string")
    assert all(r.t == r.d for r in again.select("t", decrypt(F.col("c"), KEY).alias("d")).collect())
    flipped = again.select(F.concat(F.expr("left(c, 40)"), F.when(F.substring("c", 41, 1) == "0", "1").otherwise("0"), F.expr("substring(c, 42)")).alias("c"))
    assert {r[0] for r in flipped.select(decrypt(F.col("c"), KEY, strict=False)).collect()} == {None}
    with pytest.raises(Exception):
        flipped.select(decrypt(F.col("c"), KEY)).collect()


def test_keys():
    assert load_key("K", {"K": "00" * 32}) == bytes(32)
    assert len(load_key("K", {})) == 32
    with pytest.raises(RuntimeError):
        load_key("K", {"VEILSPARK_ENV": "production"})
    for bad in ("00" * 8, "zz"):
        with pytest.raises(ValueError):
            load_key("K", {"K": bad})


def test_vault(spark):
    rows = [("SSN", "372-18-5421", "A", "1"), ("EMAIL", "jane.doe@hospital.org", "A", "2"), ("IP", "192.168.0.44", "B", "3"), ("SSN", "372-18-5421", "B", "4"), ("SSN", None, "B", "5")]
    values = spark.createDataFrame(rows, "pii_type string, value string, transaction_id string, created_at string")
    stored = vault.new_entries(values, KEY)
    stored = spark.createDataFrame(stored.collect(), stored.schema)
    v = vault.upsert(stored, ["created_at"])
    assert v.count() == 3
    got = {r.value for r in vault.retrieve(v, v, KEY).collect()}
    assert got == {"372-18-5421", "jane.doe@hospital.org", "192.168.0.44"}
    unknown = spark.createDataFrame([("[REDACTED_SSN_doesnotexist]",)], "token string")
    assert vault.retrieve(unknown, v, KEY).first().value is None
    stays, counts = vault.purge(v, spark.createDataFrame([("A",), ("C",)], "transaction_id string"))
    assert {r.transaction_id: r.purged for r in counts.collect()} == {"A": 1, "C": 0}
    assert stays.count() == 2  # the number stored again belongs to B
    t = spark.createDataFrame([("SSN", "x")], "a string, b string").select(vault_token(F.col("a"), F.col("b"), KEY)).first()[0]
    assert t == f"[REDACTED_SSN_{hmac.new(KEY, b'SSN:x', hashlib.sha256).hexdigest()[:16]}]"


def test_json_bodies(spark):
    bodies = [
        '{"model": "m", "messages": [{"role": "user", "content": "SSN 372-18-5421"}, {"role": "x", "CONTENT": "ring 555-867-5309"}], "content": ["SSN 372-18-5421"], "id": "372-18-5421"}',
        "no json, SSN 372-18-5421", None, "", '{"text": 5, "prompt": null, "a": {"query": "at 10.1.1.1"}}', "[1, 2]"]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = {r.id: r for r in jsonscrub.scrub_bodies(df, "id", "body").collect()}
    first = json.loads(got[0].body)
    assert first["messages"][0]["content"] == "SSN [REDACTED_SSN]" and first["messages"][1]["CONTENT"] == "ring [REDACTED_PHONE]"
    assert first["content"] == ["SSN 372-18-5421"] and first["id"] == "372-18-5421"
    assert got[0].flags == {"HIPAA_SSN": 1, "HIPAA_PHI_PHONE": 1} and got[0].bytes_out == len(json.dumps(first))
    assert got[1].body == "no json, SSN [REDACTED_SSN]" and not got[1].is_json
    assert got[2].body is None and got[3].body == ""
    assert json.loads(got[4].body)["a"]["query"] == "at [REDACTED_IP]" and json.loads(got[5].body) == [1, 2]


def test_headers_targets_bytes(spark):
    df = spark.range(1).select(F.create_map(F.lit("HOST"), F.lit("a"), F.lit("x"), F.lit("b")).alias("h"), F.lit("known").alias("t"), F.lit(b"caf\xff\xc3\xa9").alias("b"))
    r = df.select(jsonscrub.forward_headers(F.col("h"), F.lit(7)).alias("h"), jsonscrub.resolve_target(F.col("t"), {"known": "http://k"}).alias("t"), jsonscrub.decode(F.col("b")).alias("d")).first()
    assert r.h == {"x": "b", "content-length": "7"} and r.t == "http://k" and r.d == b"caf\xff\xc3\xa9".decode(errors="replace")
    with pytest.raises(Exception):
        spark.createDataFrame([(" ",)], "t string").select(jsonscrub.resolve_target(F.col("t"), {})).collect()


def test_quality_and_quantiles(spark):
    rows = {r.pii_class: r for r in evaluate.rates(evaluate.confusion(evaluate.quality_cases(spark))).collect()}
    assert all(rows[c].detection_rate == 1.0 for c in ("HIPAA_SSN", "PCI_PAN", "COMBINED"))
    assert all(rows[c].false_positive_rate == 0.0 for c in rows)
    values = [float((i * 37) % 101) for i in range(101)] + [5.0] * 9
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", 2.0), ("c", None)], "g string, v double")
    got = {r.g: (r.p50, r.p95) for r in evaluate.index_quantile(df, ["g"], "v", {"p95": 0.95}).collect()}
    s = sorted(values)
    assert got["a"] == ((s[54] + s[55]) / 2, s[int(110 * 0.95)]) and got["b"] == (1.5, 2.0)


def test_appended_chains_are_those_issued_at_once(spark):
    rows = [(f"c{i % 3}", f"t{i}", f"2025-01-01T00:00:{i:02d}+00:00", ["B", "A"] if i % 2 else None, None if i % 5 else ["A", "B"], i, None, None, i) for i in range(30)]
    schema = "chain_id string, transaction_id string, issued_at string, detected array<string>, redacted array<string>, char_in int, char_out int, downstream_target string, seq int"
    events = spark.createDataFrame(rows, schema)
    whole = attest.issue(events, KEY, ["seq"])
    first = attest.issue(events.where("seq < 11 and chain_id <> 'c2'"), KEY, ["seq"])
    first = spark.createDataFrame(first.collect(), first.schema)
    second = attest.issue(events.where("seq >= 11 or chain_id = 'c2'"), KEY, ["seq"], after=attest.heads(first))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, first.unionByName(second).collect()))
    both = spark.createDataFrame(whole.collect(), whole.schema)
    assert all(r.valid for r in attest.verify(both, KEY).collect())
    assert {(tuple(r.pii_classes_detected), r.zero_pii_egress_confirmed) for r in whole.collect()} == {(("B", "A"), False), ((), True), ((), False), (("B", "A"), True)}


def test_hook_header_of_ones_own(chain):
    events = attest.event_payload(chain)
    takes = lambda name, value: lambda u, b, h, t: 204 if h.get(name) == value else 401
    assert {r.sent for r in dispatch(events, "http://x", token="abc", header="X-Api-Key", send=takes("X-Api-Key", "abc")).collect()} == {True}
    assert {r.sent for r in dispatch(events, "http://x", token="abc", prefix="Splunk ", send=takes("Authorization", "Splunk abc")).collect()} == {True}
    assert {r.sent for r in dispatch(events, "http://x", token="abc", send=takes("X-Api-Key", "abc")).collect()} == {False}
