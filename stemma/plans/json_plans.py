"""Structure of JSON texts: the event properties as stored and as five document shapes built around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import jsonops as J
from stemma.plans.registry import Registry
from stemma.sources import tables as S

R = Registry()

# One JSON shape per event type; %s is the stored property object.
SHAPES = {
    "view": '{"id": 1, "data": [1, 2], "status": "ok", "meta": {"t": 1.5}, "props": %s}',
    "click": '{"created_at": "now", "flags": %s}',
    "purchase": '[%s, {"k": 0}]',
    "signup": '{"type": "object", "properties": {"a": {"b": {"c": {"d": [true, null]}}}}, "props": %s}',
    "error": '{"list": [[1, 2], [3]], "props": %s}',
}
# Expected by shape: depth, number of value types, complexity, kind, patterns.
EXPECT = {
    "view": (2, 4, 1.0, "api_response", "identifiers|metadata"),
    "click": (2, 2, 0.9, "configuration", "timestamps"),
    "purchase": (2, 1, 1.0, "general", "homogeneous_list"),
    "signup": (6, 2, 1.0, "schema", ""),
    "error": (3, 2, 1.0, "general", ""),
}


def shaped(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    text = None
    for k, shape in SHAPES.items():
        head, tail = shape.split("%s")
        v = F.concat(F.lit(head), F.col("props"), F.lit(tail))
        text = F.when(F.col("event_type") == k, v) if text is None else text.when(F.col("event_type") == k, v)
    return e.select("event_id", "event_type", text.alias("j")).select("event_id", "event_type", J.describe("j").alias("s"))


def _case(i: int, quote: bool) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN " + (f"'{v[i]}'" if quote else str(v[i])) for k, v in EXPECT.items()) + " END"


@R.query("json_structure", f"SELECT event_id, {_case(0, False)}::INT AS depth, {_case(1, False)}::INT AS n_types, round({_case(2, False)}::DOUBLE, 6) AS complexity FROM events")
def json_structure(spark, sf_dir):
    return shaped(spark, sf_dir).select("event_id", "s.depth", F.size("s.value_types").alias("n_types"), F.round(J.complexity("s"), 6).alias("complexity"))


@R.query("json_type", f"SELECT event_id, {_case(3, True)} AS data_type, {_case(4, True)} AS patterns, event_type = 'signup' AS has_schema FROM events")
def json_type(spark, sf_dir):
    return shaped(spark, sf_dir).select("event_id", J.data_type("s").alias("data_type"), F.array_join(J.patterns("s"), "|").alias("patterns"), J.has_schema("s").alias("has_schema"))


@R.query(
    "json_flatten",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'id: 1 data: 1 2 status: ok meta: t: 1.5 props: k: ' || k WHEN 'click' THEN 'created_at: now flags: k: ' || k WHEN 'purchase' THEN 'k: ' || k || ' k: 0'
 WHEN 'signup' THEN 'type: object properties: a: b: c: d: True props: k: ' || k ELSE 'list: 1 2 3 props: k: ' || k END AS content FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""",
)
def json_flatten(spark, sf_dir):
    return shaped(spark, sf_dir).select("event_id", "s.content")


@R.query("json_value_types", """SELECT t AS value_type, sum(n)::BIGINT AS n FROM (SELECT unnest(CASE event_type WHEN 'view' THEN ['int','list','str','dict'] WHEN 'click' THEN ['str','dict'] WHEN 'purchase' THEN ['dict']
 WHEN 'signup' THEN ['str','dict'] ELSE ['list','dict'] END) AS t, unnest(CASE event_type WHEN 'view' THEN [1,1,1,2] WHEN 'click' THEN [1,1] WHEN 'purchase' THEN [2] WHEN 'signup' THEN [1,2] ELSE [1,1] END) AS n FROM events) GROUP BY 1""")
def json_value_types(spark, sf_dir):
    v = shaped(spark, sf_dir).select(F.explode("s.value_types").alias("value_type", "n"))
    return v.groupBy("value_type").agg(F.sum("n").alias("n"))


@R.query("props_values", "SELECT event_type, json_extract_string(props, '$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1, 2")
def props_values(spark, sf_dir):
    """Stored properties through the engine's own JSON type."""
    e = S.table(spark, sf_dir, "events").select("event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@R.query(
    "json_depths",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'dict' ELSE 'list' END AS kind, CASE WHEN event_id % 2 = 0 THEN 1 + event_id % 9 WHEN event_id % 5 = 0 THEN 0 ELSE 2 END::INT AS depth,
 CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id % 5 END::INT AS n_items, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END::INT AS key_count,
 CASE WHEN event_id % 2 = 0 THEN repeat('n: ', (event_id % 9)::INT) || CASE WHEN event_id % 9 <= 9 THEN 'k: ' || k END ELSE array_to_string(list_transform(range(0, event_id % 5), lambda x: 'k: ' || k), ' ') END AS content
 FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""",
)
def json_depths(spark, sf_dir):
    """Stored properties at a depth, or in a list of a length, that differs from event to event."""
    i = F.col("event_id")
    d, n = (i % 9).cast("int"), (i % 5).cast("int")
    deep = F.concat(F.repeat(F.lit('{"n":'), d), F.col("props"), F.repeat(F.lit("}"), d))
    listed = F.concat(F.lit("["), F.array_join(F.array_repeat(F.col("props"), n), ","), F.lit("]"))
    e = S.table(spark, sf_dir, "events").select("event_id", J.describe(F.when(i % 2 == 0, deep).otherwise(listed)).alias("s"))
    return e.select("event_id", "s.kind", "s.depth", "s.n_items", "s.key_count", "s.content")
