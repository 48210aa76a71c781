"""Deeply nested records as related flat tables that keep parent-child links."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import let, rows_of
from ..session import cut, ship_package

FLAG_LISTS = ("flags_triggered", "flags_redacted")
CLASS_LISTS = ("pii_classes_detected", "pii_classes_redacted")


# ---- typed columns -------------------------------------------------------------------------------------------------


def flatten(df: DataFrame, keys: list[str], name: str = "root") -> dict[str, DataFrame]:
    """Flat tables of a table with nested columns: the root and, recursively, one child table for each array or map.

    A struct's fields become columns `outer_inner` of the same table (a number is added if that name is taken). Each child
    row carries `parent_key` (the keys of the root row and the ordinals down to it, as text), `ordinal` (from 0; of a map,
    with `map_key`) and `row_key`. A null or empty array has no child rows; a null element is a child row of nulls. The
    schema is merged already, since Parquet gives one to all rows. Narrow steps only: no shuffle at any level.
    """
    out: dict[str, DataFrame] = {}
    key = F.concat_ws("/", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("null")) for k in keys])
    _level(df.select(key.alias("row_key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_v")), name, [], out)
    return out


def _level(df: DataFrame, name: str, link: list[str], out: dict[str, DataFrame]) -> None:
    cols: list[Column] = []
    taken = {"row_key", *link}
    children: list[tuple[str, Column, T.DataType]] = []

    def walk(c: Column, kind: T.DataType, label: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(c.getField(f.name), f.dataType, f"{label}_{f.name}" if label else f.name)
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            children.append((label or "items", c, kind))
        else:
            free, n = label or "value", 2
            while free.lower() in taken:
                free, n = f"{label or 'value'}_{n}", n + 1
            taken.add(free.lower())
            cols.append(c.alias(free))

    walk(F.col("_v"), df.schema["_v"].dataType, "")
    out[name] = df.select("row_key", *link, *cols)
    for label, c, kind in children:
        if isinstance(kind, T.MapType):
            items = F.transform(F.map_entries(c), lambda e: e)
        else:
            items = F.transform(c, lambda e: F.struct(F.lit(None).cast("string").alias("key"), e.alias("value")))
        child = rows_of(df, items, F.col("row_key").alias("parent_key"), item="_e")
        extra = [F.col("_e.key").cast("string").alias("map_key")] if isinstance(kind, T.MapType) else []
        child = child.select(F.concat_ws("/", "parent_key", F.lit(label), F.col("ordinal").cast("string")).alias("row_key"), "parent_key", "ordinal", *extra, F.col("_e.value").alias("_v"))
        _level(child, f"{name}.{label}", ["parent_key", "ordinal", *(["map_key"] if extra else [])], out)


# ---- JSON bodies ---------------------------------------------------------------------------------------------------


def whole_json(body: Column) -> Column:
    """The text as a variant, or null if it isn't one valid JSON value from its first to its last character.

    The parser stops after the first value, so the text is parsed inside an array and inside an object: what may follow
    a value differs in the two, and only a whole value fits both. Of a key that an object has twice the last one counts, where the
    session sets spark.sql.variant.allowDuplicateKeys (see response_rows).
    """
    text = F.btrim(body, F.lit(" \t\n\r"))
    array, obj = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(array.isNotNull() & obj.isNotNull() & (F.length(text) > 0), F.try_variant_get(obj, "$.v", "variant"))


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _list(v: Column) -> Column:
    """Responses in what may be an array of them or a single one."""
    many = _get(v, "$", "array<variant>")
    return F.coalesce(many, F.when(_get(v, "$", "map<string,variant>").isNotNull(), F.array(v)))


def body_responses(v: Column) -> Column:
    """The responses of a body: of `responses` or `data.responses`, of an array, or the body itself."""
    obj = _get(v, "$", "map<string,variant>")
    of = lambda m, k: F.map_contains_key(m, F.lit(k))
    return (
        F.when(obj.isNull(), _get(v, "$", "array<variant>"))
        .when(of(obj, "responses"), _list(_get(v, "$.responses")))
        .when(of(obj, "data"), _list(F.coalesce(_get(v, "$.data.responses"), _get(v, "$.data"))))
        .otherwise(F.array(v))
    )


def _document(v: Column) -> Column:
    """A nested object that some producers send as JSON text."""
    return F.coalesce(F.when(_get(v, "$", "map<string,variant>").isNotNull(), v), whole_json(F.when(F.schema_of_variant(v) == "STRING", _get(v, "$", "string"))))


# ---- merged schema -------------------------------------------------------------------------------------------------


@dataclass
class Shape:
    """What all rows have at one place: kinds of scalars, fields of objects, elements of arrays, entries of objects whose keys
    are data, and what is inside text that is JSON. Producers may disagree, so a place may have several of them."""

    kinds: set[str] = field(default_factory=set)
    fields: dict[str, Shape] = field(default_factory=dict)
    many: Shape | None = None
    entries: Shape | None = None
    text: Shape | None = None

    def child(self, step: str) -> Shape:
        """The shape a step on: a field `.name`, or an element `[`, an entry `{`, JSON in text `"`."""
        if step[0] == ".":
            return self.fields.setdefault(step[1:], Shape())
        name = {"[": "many", "{": "entries", '"': "text"}[step]
        if getattr(self, name) is None:
            setattr(self, name, Shape())
        return getattr(self, name)

    def steps(self) -> Iterator[tuple[str, Shape]]:
        yield from ((f".{k}", x) for k, x in self.fields.items())
        yield from ((step, x) for step, x in (("[", self.many), ("{", self.entries), ('"', self.text)) if x is not None)

    def add(self, other: Shape) -> Shape:
        self.kinds |= other.kinds
        for step, x in list(other.steps()):
            self.child(step).add(x)
        return self

    def nested(self) -> bool:
        """Whether there is a list anywhere below."""
        return self.many is not None or self.entries is not None or any(x.nested() for _, x in self.steps())

    def column(self) -> str:
        if self.kinds <= {"bigint", "double"}:
            return "double" if "double" in self.kinds else "bigint"
        return "boolean" if self.kinds == {"boolean"} else "string"


#: Objects with more fields than this at one place, over all rows, have data as keys and become lists of entries.
MOST_FIELDS = 200
#: More places than this in a merged schema are an error. What is nested deeper than MOST_STEPS stays JSON text.
MOST_PLACES, MOST_STEPS = 20_000, 48
_SEP = "\x1f"


def _observe(root: Shape, value: object, maps: frozenset[str], recursive: frozenset[str], depth: dict[str, int]) -> None:
    """Adds a value's shape. Lists in a recursive field are of the same shape as what they are in; how deep they go is counted."""
    todo: list[tuple[Shape, object, int, str, dict[str, int]]] = [(root, value, 0, "", {})]
    while todo:
        shape, v, n, name, counts = todo.pop()
        if n >= MOST_STEPS:
            shape.kinds.add("string")
        elif isinstance(v, dict):
            if name in maps or len(shape.fields) > MOST_FIELDS:
                todo += [(shape.child("{"), x, n + 1, "", counts) for x in v.values()]
                continue
            for k, x in v.items():
                if k in recursive:
                    inner = {**counts, k: counts.get(k, 0) + 1}
                    if isinstance(x, (list, dict)):
                        depth[k] = max(depth.get(k, 0), inner[k])
                    todo += [(shape, y, n, name, inner) for y in (x if isinstance(x, list) else [x]) if isinstance(y, dict)]
                elif _SEP not in k and not ("'" in k and '"' in k):
                    todo.append((shape.child(f".{k}"), x, n + 1, k, counts))
        elif isinstance(v, list):
            inner_shape = shape.child("[")
            todo += [(inner_shape, x, n + 1, "", counts) for x in v]
        elif isinstance(v, str):
            shape.kinds.add("string")
            if v.lstrip()[:1] in ("{", "["):
                try:
                    todo.append((shape.child('"'), json.loads(v), n + 1, name, counts))
                except (ValueError, RecursionError):
                    pass
        elif v is not None:
            shape.kinds.add("boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double")


def merged_schema(df: DataFrame, column: str, maps: tuple[str, ...] = (), recursive: tuple[str, ...] = ()) -> tuple[Shape, dict[str, int]]:
    """The schema that fits every row of a column of JSON text, and how deep each recursive field is nested.

    Each task merges its own rows; what meets is one row a place and kind, and at most MOST_PLACES of them come to the driver.
    maps: fields whose objects have data as keys. recursive: fields that hold more of what they are in. Invalid text has no shape.
    """
    ship_package(df.sparkSession)
    as_map, again = frozenset(maps), frozenset(recursive)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, depth = Shape(), {}
        for b in batches:
            for body in b.column(0).to_pylist():
                try:
                    value = json.loads(body)
                except (TypeError, ValueError, RecursionError):
                    continue
                _observe(root, value, as_map, again, depth)
        rows: list[tuple[str, str, int]] = [("", f"depth {k}", n) for k, n in depth.items()]
        todo = [((), root)]
        while todo:
            path, shape = todo.pop()
            rows += [(_SEP.join(path), kind, 0) for kind in (shape.kinds or {""})]
            todo += [((*path, step), x) for step, x in shape.steps()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int32()))], ["path", "kind", "n"])

    places = df.select(F.col(f"`{column}`").cast("string")).mapInArrow(run, "path string, kind string, n int").groupBy("path", "kind").agg(F.max("n").alias("n")).limit(MOST_PLACES + 1).collect()
    if len(places) > MOST_PLACES:
        raise ValueError(f"more than {MOST_PLACES} places in the merged schema: name the objects whose keys are data in `maps`")
    root, depth = Shape(), {}
    for r in sorted(places):
        if r["kind"].startswith("depth "):
            depth[r["kind"][6:]] = r["n"]
            continue
        at = root
        for step in filter(None, r["path"].split(_SEP)):
            at = at.child(step)
        at.kinds |= {r["kind"]} - {""}
    return _entries(root), depth


def _entries(shape: Shape) -> Shape:
    for _, x in list(shape.steps()):
        _entries(x)
    if len(shape.fields) > MOST_FIELDS or shape.entries is not None and shape.fields:
        for x in shape.fields.values():
            shape.child("{").add(x)
        shape.fields = {}
    return shape


def shape_of(kind: T.DataType) -> Shape:
    """The shape of a typed column once it is a variant; Parquet's schema is merged already."""
    if isinstance(kind, T.StructType):
        return Shape(fields={f.name: shape_of(f.dataType) for f in kind.fields})
    if isinstance(kind, T.ArrayType):
        return Shape(many=shape_of(kind.elementType))
    if isinstance(kind, T.MapType):
        return Shape(entries=shape_of(kind.valueType))
    whole, real = (T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType, T.DecimalType)
    return Shape(kinds={"bigint" if isinstance(kind, whole) else "double" if isinstance(kind, real) else "boolean" if isinstance(kind, T.BooleanType) else "string"})


def _at(name: str) -> str:
    return f"$['{name}']" if '"' in name else f'$["{name}"]'


def columns(shape: Shape, v: Column, label: str = "") -> list[tuple[str, Column]]:
    """The scalars of a shape by name, `outer_inner` for what is in objects; unknown fields come as they are, and JSON text stays beside what is in it."""
    own = [(label, _get(v, "$", shape.column()))] if shape.kinds and label else []
    if shape.text is not None:
        v, shape = _document(v), Shape(set(), dict(shape.fields)).add(shape.text)
    return own + [c for name, x in sorted(shape.fields.items()) for c in columns(x, _get(v, _at(name)), f"{label}_{name}" if label else name)]


NODE = "struct<tab:string,parent_key:string,row_key:string,ordinal:int,map_key:string,value:variant>"


def child_nodes(shape: Shape, v: Column, key: Column, tab: str = "", label: str = "", only: Callable[[str], bool] = lambda t: True) -> list[Column]:
    """Arrays of NODE for all lists below a value, level by level: an element of an array or an entry of an object whose keys are data
    becomes a child with its parent's key, its ordinal, and the name of its table, the path of lists that it is in."""
    if not shape.nested():
        return []
    if shape.text is not None:
        return [let(_document(v), lambda d: _concat(child_nodes(Shape(set(), dict(shape.fields), shape.many, shape.entries).add(shape.text), d, key, tab, label, only)))]
    out = [x for name, s in sorted(shape.fields.items()) for x in child_nodes(s, _get(v, _at(name)), key, tab, f"{label}_{name}" if label else name, only)]
    name = f"{tab}.{label}" if tab else label
    node = lambda k, x, i: F.struct(F.lit(name).alias("tab"), key.alias("parent_key"), F.concat(key, F.lit(f"/{label}/"), i.cast("string")).alias("row_key"), i.alias("ordinal"), k.alias("map_key"), x.alias("value"))
    lists = []
    if shape.many is not None:
        lists.append((shape.many, F.transform(_get(v, "$", "array<variant>"), lambda x, i: node(F.lit(None).cast("string"), x, i))))
    if shape.entries is not None:
        lists.append((shape.entries, F.transform(F.map_entries(_get(v, "$", "map<string,variant>")), lambda e, i: node(e["key"], e["value"], i))))
    for below, items in lists:
        items = F.coalesce(items.cast(f"array<{NODE}>"), F.array().cast(f"array<{NODE}>"))
        if only(name):
            out.append(items)
        if below.nested():
            out.append(F.flatten(F.transform(items, lambda it: _concat(child_nodes(below, it["value"], it["row_key"], name, "items" if not below.fields else "", only)))))
    return out


def _concat(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else F.array().cast(f"array<{NODE}>")


# ---- responses -----------------------------------------------------------------------------------------------------

#: Of response records: objects whose keys are flags, and the field that holds more responses.
MAPS, RECURSIVE = FLAG_LISTS, "parts"
#: Levels of `parts` that one plan explodes; what is deeper goes through it again.
LEVELS = 16
_ITEM = "struct<path:string,parent:string,v:variant>"


def response_schema(batches: DataFrame, body: str = "body") -> tuple[Shape, int]:
    """The merged schema of all responses in the bodies, wherever a body has them, and the depth of `parts`."""
    root, depth = merged_schema(batches, body, MAPS, (RECURSIVE,))
    out = Shape()
    inner = root.fields.get("data", Shape())
    for x in (root, root.many, *(s for f in (root, inner) for s in (f.fields.get("responses", Shape()), f.fields.get("responses", Shape()).many)), inner, inner.many):
        if x is not None:
            out.add(Shape(set(), {k: s for k, s in x.fields.items() if k not in ("responses", "data")}))
    return out, depth.get(RECURSIVE, 0)


def _exploded(rows: DataFrame, depth: int) -> DataFrame:
    """record_table, record_id, item_path, parent_path, v of all responses in `_l` (array of _ITEM) and in their parts, level by level."""
    level, levels = F.col("_l"), [F.col("_l")]
    inner = lambda x: F.transform(F.coalesce(_list(_get(x["v"], f"$.{RECURSIVE}")), F.array().cast("array<variant>")), lambda p, i: F.struct(F.concat_ws("/", x["path"], i.cast("string")).alias("path"), x["path"].alias("parent"), p.alias("v")))
    for _ in range(min(depth, LEVELS)):
        level = F.flatten(F.transform(level, inner)).cast(f"array<{_ITEM}>")
        levels.append(level)
    found = rows_of(rows, F.concat(*levels), "record_table", "record_id", item="x").where(_get(F.col("x.v"), "$", "map<string,variant>").isNotNull())
    out = found.select("record_table", "record_id", F.col("x.path").alias("item_path"), F.col("x.parent").alias("parent_path"), F.col("x.v").alias("v"))
    if depth <= LEVELS:
        return out
    rest = rows.select("record_table", "record_id", F.flatten(F.transform(level, inner)).cast(f"array<{_ITEM}>").alias("_l")).where(F.size("_l") > 0)
    return out.unionByName(_exploded(cut(rest), depth - LEVELS - 1))


def responses_of_bodies(batches: DataFrame, depth: int | None = None) -> DataFrame:
    """One row per response in the bodies of response_batches: record_table, record_id (batch_id), item_path, parent_path, v (the response).

    item_path is the position from 0 and, for a response in `parts`, its parent's path, / and the position there. Null, empty and
    broken bodies have no rows. All levels come from one parse of the body, without a shuffle. `depth` is how deep parts may be
    nested; None finds it from the merged schema. The parser refuses what is nested deeper than 1,000 levels, as broken.
    """
    if depth is None:
        depth = response_schema(batches)[1]
    batches.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    first = F.transform(body_responses(whole_json(F.col("body"))), lambda r, i: F.struct(i.cast("string").alias("path"), F.lit(None).cast("string").alias("parent"), r.alias("v"))).cast(f"array<{_ITEM}>")
    return _exploded(batches.select(F.lit("response_batches").alias("record_table"), F.col("batch_id").alias("record_id"), first.alias("_l")), depth)


#: The fields of a row of scrub_responses that make its response.
RESPONSE = ("transaction_id", "clean_text", "audit_log", "compliance_receipt")


def responses_of_table(responses: DataFrame) -> DataFrame:
    """The rows of scrub_responses in the same shape as responses_of_bodies; item_path is `0`."""
    return responses.select(F.lit("scrub_responses").alias("record_table"), F.col("response_id").alias("record_id"), F.lit("0").alias("item_path"), F.lit(None).cast("string").alias("parent_path"), F.to_variant_object(F.struct(*_present(responses))).alias("v"))


def _present(df: DataFrame) -> list[str]:
    return [c for c in RESPONSE if c in df.columns]


def response_rows(responses: DataFrame, batches: DataFrame) -> tuple[DataFrame, Shape]:
    """All responses, one row each, and their merged schema: that of the bodies' rows and of the table's columns.

    Sets spark.sql.variant.allowDuplicateKeys, as an object with a key twice is valid JSON.
    """
    shape, depth = response_schema(batches)
    shape.add(shape_of(T.StructType([responses.schema[c] for c in _present(responses)])))
    return responses_of_table(responses).unionByName(responses_of_bodies(batches, depth)), _entries(shape)


_LINK = ["record_table", "record_id", "item_path"]


def _key() -> Column:
    return F.concat_ws("/", *[F.col(c).cast("string") for c in _LINK])


def flat_tables(rows: DataFrame, shape: Shape) -> dict[str, DataFrame]:
    """Flat tables of responses by their merged schema: `responses`, and a child table for each list at any depth, named by its path.

    Each row has the record's link, row_key, and, in a child table, parent_key (the row_key of what it is in), ordinal and map_key
    (of entries). Columns are the scalars of the merged schema; of a list of scalars, `value`. Narrow steps only.
    """
    out: dict[str, DataFrame] = {}
    out["responses"] = rows.select(*_LINK, "parent_path", _key().alias("row_key"), *_named(columns(shape, F.col("v")), {*_LINK, "parent_path", "row_key"}))
    fixed = [*_LINK, "parent_key", "row_key", "ordinal", "map_key"]
    for tab, below in _tables(shape).items():
        nodes = rows_of(rows, _nodes(shape, tab), *_LINK, item="_n", ordinal="_i")
        value = [("value", _get(F.col("_n.value"), "$", below.column()))] if below.kinds else []
        out[tab] = nodes.select(*_LINK, *[F.col(f"_n.{c}").alias(c) for c in fixed[3:]], *_named(value + columns(below, F.col("_n.value")), set(fixed)))
    return out


def _nodes(shape: Shape, *tabs: str) -> Column:
    return let(_key(), lambda k: _concat(child_nodes(shape, F.col("v"), k, only=lambda t: t in tabs)))


def _named(cols: list[tuple[str, Column]], taken: set[str]) -> list[Column]:
    out, taken = [], {t.lower() for t in taken}
    for name, c in cols:
        free, n = name, 2
        while free.lower() in taken:
            free, n = f"{name}_{n}", n + 1
        taken.add(free.lower())
        out.append(c.alias(free))
    return out


def _tables(shape: Shape, tab: str = "", label: str = "") -> dict[str, Shape]:
    """The lists below a shape by their table's name, each with the shape of its elements."""
    if shape.text is not None:
        return _tables(Shape(set(), dict(shape.fields), shape.many, shape.entries).add(shape.text), tab, label)
    out: dict[str, Shape] = {}
    for name, s in sorted(shape.fields.items()):
        out |= _tables(s, tab, f"{label}_{name}" if label else name)
    name = f"{tab}.{label}" if tab else label
    for below in (shape.many, shape.entries):
        if below is not None:
            out[name] = Shape().add(out[name]).add(below) if name in out else below
            out |= _tables(below, name, "items" if not below.fields else "")
    return out


def children(rows: DataFrame, shape: Shape) -> DataFrame:
    """One row per distinct child: record_table, record_id, item_path, child_list, child_key. Distinct within a response, so nothing is shuffled.

    child_key is the flag's or class's name without white space around it and in upper case, or the entity's position from 0. Unnamed flags and classes are no children.
    """
    lists = {t: n for t in _tables(shape) for n in (*FLAG_LISTS, *CLASS_LISTS, "entities") if t == ("audit_log_" if n in (*FLAG_LISTS, "entities") else "compliance_receipt_") + n}
    name = lambda x: F.coalesce(x["map_key"], _get(x["value"], "$.flag", "string"), F.when(F.schema_of_variant(x["value"]) == "STRING", _get(x["value"], "$", "string")))
    of = F.create_map(*[F.lit(x) for kv in lists.items() for x in kv]) if lists else F.create_map().cast("map<string,string>")
    child = lambda x: F.struct(F.try_element_at(of, x["tab"]).alias("child_list"), F.when(x["tab"] == "audit_log_entities", x["ordinal"].cast("string")).otherwise(F.upper(F.btrim(name(x)))).alias("child_key"))
    found = F.array_distinct(F.filter(F.transform(_nodes(shape, *lists), child), lambda c: c["child_key"] != ""))
    return rows_of(rows, found, *_LINK, item="c").select(*_LINK, "c.child_list", "c.child_key")
