"""The data problems of the core against brute force on small tables."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from veilspark.functions.keys import instant, norm_key
from veilspark.operators import nested
from veilspark.operators.bloom import mark_absent
from veilspark.operators.dedup import copies_to_drop, keep_one
from veilspark.operators.orphans import find_orphans, orphan_report
from veilspark.operators.skew import salted_left_join

T0 = dt.datetime(2025, 1, 1)
REF = "ref_field string, row_id long, key string, at timestamp, extra string"
TARGET = "key string, valid_from timestamp, valid_to timestamp, extra string"


def brute(refs, targets):
    out = set()
    for f, i, k, t, _ in refs:
        if k is None:
            continue
        own = [x for x in targets if x[0] == k]
        if not own:
            out.add((f, i, "missing"))
        elif t is not None and not any((a is None or a <= t) and (e is None or t < e) for _, a, e, _ in own):
            first = min((a or dt.datetime.min) for _, a, _, _ in own)
            out.add((f, i, "late" if first > t else "deleted"))
    return out


def test_orphans_against_brute_force(spark):
    rnd = random.Random(3)
    at = lambda: T0 + dt.timedelta(hours=rnd.randint(0, 200))
    keys = [f"k{i}" for i in range(60)]
    targets = [(rnd.choice(keys[:45]), None if rnd.random() < 0.05 else at(), None if rnd.random() < 0.4 else at(), "x") for _ in range(150)]
    refs = [("f", i, rnd.choice([None, "k3", "k3", *keys]), None if rnd.random() < 0.03 else at(), "y") for i in range(600)]  # k3 is hot
    for bits in (256, 1 << 18):  # a full filter and a roomy one
        got = find_orphans(spark.createDataFrame(refs, REF), spark.createDataFrame(targets, TARGET), bits)
        rows = [(r.ref_field, r.row_id, r.reason) for r in got.collect()]
        assert set(rows) == brute(refs, targets) and len(rows) == len(set(rows))


def test_orphan_borders_and_empty(spark):
    h = lambda n: T0 + dt.timedelta(hours=n)
    targets = spark.createDataFrame([("a", h(5), h(10), "")], TARGET)
    refs = [("f", n, "a", h(n), "") for n in (4, 5, 9, 10)]
    got = {r.row_id: r.reason for r in find_orphans(spark.createDataFrame(refs, REF), targets).collect()}
    assert got == {4: "late", 10: "deleted"}
    empty_t, empty_r = spark.createDataFrame([], TARGET), spark.createDataFrame([], REF)
    assert {r.reason for r in find_orphans(spark.createDataFrame(refs, REF), empty_t).collect()} == {"missing"}
    assert find_orphans(empty_r, targets).count() == 0
    twice = find_orphans(spark.createDataFrame(refs[:1] * 2, REF), targets)
    assert twice.count() == 2 and orphan_report(twice).first().orphans == 2


def test_bloom_never_denies_a_member(spark):
    members = spark.range(3000).select(F.concat(F.lit("m"), "id").alias("k"))
    probes = members.unionByName(spark.range(3000).select(F.concat(F.lit("n"), "id").alias("k")))
    got = mark_absent(probes, "k", members, "k", "absent", 1 << 17).groupBy(F.left("k", F.lit(1)).alias("kind")).agg(F.count_if("absent").alias("absent")).collect()
    got = {r.kind: r.absent for r in got}
    assert got["m"] == 0 and got["n"] > 2700


def test_salted_join_keeps_all_rows(spark):
    left = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    right = left.select("k").distinct().where("k <> 'k7'").withColumn("v", F.length("k"))
    got = salted_left_join(left, right, "k", F.col("id"))
    assert got.count() == 2000 and got.where("v is null").select("k").distinct().collect()[0][0] == "k7"


def test_instants(spark):
    cases = {"2025-03-01T01:00:00.5Z": "01:00:00.500000", " 2025-03-01 03:00:00+02:00": "01:00:00.000000", "2025-02-28T20:00:00.000001-0500": "01:00:00.000001", "2025-03-01T01:00:00": "01:00:00.000000", "2025-03-01t01:00:00z": "01:00:00.000000", "x": None, "": None}
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "s string").select("s", F.date_format(instant(F.col("s")), "HH:mm:ss.SSSSSS").alias("t"))
    assert {r.s: r.t for r in df.collect()} == {**cases, None: None}
    keys = spark.createDataFrame([("  Ab\t　",), ("  ",), (None,)], "s string").select(norm_key(F.col("s"))).collect()
    assert [k[0] for k in keys] == ["ab", None, None]


def test_one_copy(spark):
    rows = [(1, "A", "2025-01-02", 1), (2, "a ", "2025-01-01", 2), (3, "A", "2025-01-01", 1), (4, "A", None, 0), (5, None, "x", 1), (6, None, "x", 1), (7, "b", "2025-01-01", 1), (7, "b", "2025-01-01", 1)]
    df = spark.createDataFrame(rows, "id long, k string, _k string, _row int")  # columns named as the operator's own
    order = [instant(F.col("_k")), F.col("_row"), F.col("id")]
    kept = keep_one(df, norm_key(F.col("k")), order)
    assert kept.columns == df.columns and sorted(r.id for r in kept.collect()) == [3, 5, 6, 7]
    assert sorted(r.id for r in copies_to_drop(df.where("id < 7"), norm_key(F.col("k")), order[:2], "id").collect()) == [1, 2, 4]
    assert keep_one(df.limit(0), norm_key(F.col("k")), order).count() == 0
    with_map = df.withColumn("m", F.create_map(F.lit("a"), "id"))
    assert keep_one(with_map, norm_key(F.col("k")), order).count() == 4


def bodies(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "batch_id long, body string")


def response(flags=None, parts=None, entities=None, classes=None):
    r = {"clean_text": "t", "audit_log": {"transaction_id": "x", "flags_triggered": flags}, "compliance_receipt": {"pii_classes_detected": classes}}
    if entities is not None:
        r["audit_log"]["entities"] = entities
    if parts is not None:
        r["parts"] = parts
    return r


def test_bodies_of_all_shapes(spark):
    deep = response({"A": 1}, [response({"B": {}}, [response([{"flag": "C"}, "D", {"count": 1}])])])
    as_text = response()
    as_text["audit_log"] = json.dumps({"flags_redacted": {"E": None}, "entities": [{"start": 1}, {}]})
    texts = [
        json.dumps({"responses": [response({"A": {"count": 2, "cfr_citation": "c"}, "Z": None}), deep]}), json.dumps([as_text]), json.dumps({"data": {"responses": [response(classes=["F", "F", None])]}, "meta": 1}),
        json.dumps(response({"G": 1}, {"clean_text": "no list", "audit_log": {"flags_triggered": ["H"]}})), "{}", "null", "[]", "5", "", None, "  ", '[{"a":1}] x', '{"a":1}{"b":2}', '{"responses": [', "HTTP 502 []", '{"responses": null}', '[1, "s", null, []]']
    def found(df):
        shape, depth = nested.response_schema(df)
        rows = nested.responses_of_bodies(df, depth)
        return rows, shape, {(r.record_id, r.item_path, r.child_list, r.child_key) for r in nested.children(rows, shape).collect()}

    rows, shape, got = found(bodies(spark, texts))
    assert got == {
        (0, "0", "flags_triggered", "A"), (0, "0", "flags_triggered", "Z"), (0, "1", "flags_triggered", "A"), (0, "1/0", "flags_triggered", "B"), (0, "1/0/0", "flags_triggered", "C"), (0, "1/0/0", "flags_triggered", "D"),
        (1, "0", "flags_redacted", "E"), (1, "0", "entities", "0"), (1, "0", "entities", "1"), (2, "0", "pii_classes_detected", "F"), (3, "0", "flags_triggered", "G"), (3, "0/0", "flags_triggered", "H")}
    tables = nested.flat_tables(rows, shape)
    assert tables["responses"].where("record_id = 0").select("parent_path").orderBy("item_path").collect() == [(None,), (None,), ("1",), ("1/0",)]
    f = tables["audit_log_flags_triggered"].where("record_id = 0 and item_path = '0'").orderBy("ordinal").collect()
    assert [(x.map_key, x["count"], x.cfr_citation, x.parent_key) for x in f] == [("A", 2, "c", "response_batches/0/0"), ("Z", None, None, "response_batches/0/0")]
    assert found(bodies(spark, texts).limit(0))[2] == set()


def test_fields_nobody_named_are_kept(spark):
    texts = [
        json.dumps({"x": 1, "audit_log": {"entities": [{"start": 1, "tags": [{"t": "a"}, {"t": "b", "why": ["p", None]}]}], "note": "n"}, "quoted'name": True}),
        json.dumps({"x": 1.5, "audit_log": json.dumps({"entities": [{"start": "s"}]}), "seen": [[1, 2], [3]]}),
        '{"x": "one", "x": "two"}']
    df = bodies(spark, texts)
    shape, depth = nested.response_schema(df)
    t = nested.flat_tables(nested.responses_of_bodies(df, depth), shape)
    assert set(t) == {"responses", "audit_log_entities", "audit_log_entities.tags", "audit_log_entities.tags.why", "seen", "seen.items"}
    r = {x.record_id: x for x in t["responses"].collect()}
    assert [r[i].x for i in range(3)] == ["1", "1.5", "two"] and r[0].audit_log_note == "n" and r[0]["quoted'name"] is True and r[1].audit_log.startswith("{")
    tags = {x.row_key: x for x in t["audit_log_entities.tags"].collect()}
    assert tags["response_batches/0/0/audit_log_entities/0/tags/1"].parent_key == "response_batches/0/0/audit_log_entities/0" and sorted(x.t for x in tags.values()) == ["a", "b"]
    assert [(x.parent_key, x.ordinal, x.value) for x in t["audit_log_entities.tags.why"].orderBy("ordinal").collect()] == [("response_batches/0/0/audit_log_entities/0/tags/1", i, v) for i, v in ((0, "p"), (1, None))]
    assert [(x.parent_key, x.value) for x in t["seen.items"].orderBy("row_key").collect()] == [("response_batches/1/0/seen/0", 1), ("response_batches/1/0/seen/0", 2), ("response_batches/1/0/seen/1", 3)]


def test_depth_follows_from_the_data_alone(spark):
    def deep(n):
        body = '{"audit_log": {"flags_triggered": {"X": 1}}}'
        for _ in range(n):
            body = '{"parts": [' + body + "]}"
        return body

    hostile = json.dumps({"clean_text": '"parts"' * 10_000, "audit_log": {"flags_triggered": ["Y"]}})
    df = bodies(spark, [deep(0), deep(3), hostile])
    shape, depth = nested.response_schema(df)
    assert depth == 3
    df = bodies(spark, [deep(1), deep(40), hostile])  # deeper than one plan explodes
    shape, depth = nested.response_schema(df)
    got = {(r.record_id, r.item_path) for r in nested.children(nested.responses_of_bodies(df, depth), shape).collect()}
    assert depth == 40 and got == {(0, "0/0"), (1, "/".join(["0"] * 41)), (2, "0")}


def test_objects_with_data_as_keys_become_entries(spark):
    df = bodies(spark, [json.dumps({"by_user": {f"u{i}_{j}": {"n": j} for j in range(30)}}) for i in range(10)])
    shape, depth = nested.response_schema(df)
    t = nested.flat_tables(nested.responses_of_bodies(df, depth), shape)
    assert set(t) == {"responses", "by_user"} and t["by_user"].count() == 300 and t["by_user"].agg(F.sum("n")).first()[0] == 10 * 435


def test_whole_json(spark):
    texts = ["{}", " [1] ", '{"a":1} x', "[1] , [2]", "1,2", '{"a":1},"z":2', '{"a":1}] x', '{"a":1} } x', "nul", "true", '"s"', ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(nested.whole_json(F.col("t")).isNotNull()).collect()]

    def valid(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    assert got == [valid(t) for t in texts]


def test_generic_flatten(spark):
    df = spark.createDataFrame(
        [(1, {"x": [{"y": [10, None]}, {"y": []}], "z": 5}, {"k": [1]}, "clash"), (2, None, None, None)],
        "id long, a struct<x:array<struct<y:array<int>>>,z:int>, m map<string,array<int>>, a_z string")
    t = nested.flatten(df, ["id"])
    assert set(t) == {"root", "root.a_x", "root.a_x.y", "root.m", "root.m.items"}
    assert t["root"].columns == ["row_key", "id", "a_z", "a_z_2"] and t["root"].count() == 2
    y = t["root.a_x.y"].orderBy("row_key").collect()
    assert [(r.parent_key, r.ordinal, r.value) for r in y] == [("1/a_x/0", 0, 10), ("1/a_x/0", 1, None)]
    m = t["root.m.items"].collect()
    assert len(m) == 1 and m[0].value == 1 and t["root.m"].first().map_key == "k"
