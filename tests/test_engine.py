"""The engine on small tables with numbers that can be checked by hand."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from metricspine import errors
from metricspine.facade import Guard, Spine
from metricspine.sources.catalog import Catalog

PACK = """
objects:
  Parent:
    primary: parent
    joins:
      kind: {to: kind, kind: left, cardinality: many_to_one, on: [{from: parent.kind_id, to: kind.kind_id}]}
    properties:
      id: {column: parent.id, type: integer, unique: true}
      grp: {column: parent.grp, type: string, nullable: true}
      val: {column: parent.val, type: integer, nullable: true, quantity: flow}
      kind: {column: kind.label, type: string, via: kind, nullable: true}
  Child:
    primary: child
    properties:
      id: {column: child.id, type: integer, unique: true}
      grp: {column: child.grp, type: string}
  Tag:
    primary: tag
    properties:
      id: {column: tag.id, type: integer, unique: true}
      name: {column: tag.name, type: string}
      heft: {column: tag.weight, type: integer, quantity: flow}
  Level:
    primary: level
    properties:
      track: {column: level.track_id, type: integer}
      as_of: {column: level.as_of, type: date, time_unit: day}
      units: {column: level.units, type: integer, quantity: stock}
  Sale:
    primary: sale
    properties:
      id: {column: sale.id, type: integer, unique: true}
  Employee:
    primary: employee
    properties:
      id: {column: employee.id, type: integer, unique: true}
      name: {column: employee.name, type: string}
links:
  Children: {from: Parent, to: Child, cardinality: one_to_many, on: [{from: parent.id, to: child.parent_id}]}
  Child_Parent: {from: Child, to: Parent, cardinality: many_to_one, on: [{from: child.parent_id, to: parent.id}], inverse_of: Children}
  Tags: {from: Parent, to: Tag, kind: through, cardinality: many_to_many, via: tagging, on_from: [{from: parent.id, to: tagging.parent_id}], on_to: [{from: tagging.tag_id, to: tag.id}]}
  Manager: {from: Employee, to: Employee, kind: recursive, cardinality: many_to_one, max_depth: 10, on: [{from: employee.reports_to, to: employee.id}]}
  Level_Sales: {from: Level, to: Sale, cardinality: one_to_many, on: [{from: level.track_id, to: sale.track_id}, {from: level.as_of, to: sale.day}]}
metrics:
  total: {measured_on: parent, agg: sum, value: parent.val}
  rows: {measured_on: parent, agg: count, value: parent.val}
  mean: {measured_on: parent, agg: avg, value: parent.val}
  middle: {measured_on: parent, agg: median, value: parent.val}
  biggest: {measured_on: parent, agg: max, value: parent.val}
  parents: {measured_on: parent, agg: count_distinct, value: parent.id}
  children: {measured_on: child, agg: count, value: child.id}
  weight: {measured_on: tag, agg: sum, value: tag.weight}
  kinds: {measured_on: kind, agg: count, value: kind.kind_id}
  taggings: {measured_on: tagging, agg: count, value: tagging.tag_id}
  opaque_total: {measured_on: parent, expr: "sum(parent.val)"}
  staff: {measured_on: employee, agg: count_distinct, value: employee.id}
  staff_rows: {measured_on: employee, agg: count, value: employee.id}
  level: {measured_on: level, agg: sum, value: level.units, over_time: {dimension: as_of, choice: last}}
  level_first: {measured_on: level, agg: sum, value: level.units, over_time: {dimension: as_of, choice: first}}
  level_avg: {measured_on: level, agg: avg, value: level.units}
  level_max: {measured_on: level, agg: max, value: level.units}
  level_count: {measured_on: level, agg: count, value: level.units}
"""

# one row for each level that the reference tables of such a stock hold
LEVELS = [(1, 3, 4), (1, 1, 10), (1, 2, 25), (2, 1, 3), (2, 2, 5), (2, 3, 7), (3, 3, 100), (4, 1, 999)]


def tables(spark, cycle=False):
    c = Catalog(spark)

    def add(name, rows, schema, keys=None, not_null=("*",)):
        c.add(name, spark.createDataFrame(rows, schema), keys, set(not_null))

    add("parent", [(1, "a", 10, 1), (2, "a", 20, 1), (3, None, 5, 2), (4, "b", None, 9), (5, "b", 7, None), (6, "c", None, 2)], "id int, grp string, val int, kind_id int", [("id",)], ())
    add("kind", [(1, "x"), (2, "y")], "kind_id int, label string", [("kind_id",)])
    add("child", [(1, 1, "p"), (2, 1, "q"), (3, 2, "p"), (4, 3, "p"), (5, 3, "p"), (6, 4, "q"), (7, 6, "q")], "id int, parent_id int, grp string", [("id",)])
    add("tag", [(1, "t", 100), (2, "t", 10), (3, "u", 1)], "id int, name string, weight int", [("id",)])
    add("tagging", [(1, 1), (1, 1), (1, 2), (2, 1), (3, 3), (5, 3)], "parent_id int, tag_id int", None)
    add("level", [(t, dt.date(2026, 1, d), u) for t, d, u in LEVELS], "track_id int, as_of date, units int", [("track_id", "as_of")])
    add("sale", [(k, t, dt.date(2026, 1, 3)) for k, t in ((1, 1), (2, 1), (3, 2))], "id int, track_id int, day date", [("id",)])
    add("employee", [(1, "Ostrom", 3 if cycle else None), (2, "Lindqvist", 1), (3, "Varga", 2), (4, "Okafor", 2), (5, "Iyer", 2), (6, "Sato", 1), (7, "Brandt", 6), (8, "Nunes", 6)], "id int, name string, reports_to int", [("id",)], ("id", "name"))
    return c


@pytest.fixture(scope="module")
def s(spark):
    return Spine.load(spark, PACK, catalog=tables(spark), verify=True, guard=Guard(10_000, 120_000))


def ask(s, engine=None, **spec):
    return s.query({"limit": None, **spec}, engine)


def rows(s, engine=None, **spec):
    return sorted(ask(s, engine, **spec).rows, key=repr)


FAN = {"object": "Parent", "traverse": ["Children"]}


def test_fan_is_preaggregated_and_childless_parents_drop(s):
    r = ask(s, **FAN, group_by=["grp"], metrics=["total", "rows", "children"])
    assert sorted(r.rows, key=repr) == sorted([("a", 30, 2, 3), (None, 5, 1, 2), ("b", None, 0, 1), ("c", None, 0, 1)], key=repr)
    assert r.columns == ["grp", "total", "rows", "children"] and r.additive
    assert [x["metric"] for x in r.rewrites] == ["total", "rows"] and r.rewrites[0]["forced_by"] == "Children"


def test_every_strategy_agrees_on_a_fan(s):
    for metrics in (["total"], ["mean", "middle", "biggest", "parents"], ["opaque_total", "children"]):
        assert rows(s, "preaggregate", **FAN, group_by=["grp"], metrics=metrics) == rows(s, "identity", **FAN, group_by=["grp"], metrics=metrics)


def test_null_values_and_groups(s):
    assert rows(s, object="Parent", group_by=["grp"], metrics=["mean", "middle", "rows"]) == sorted([("a", 15.0, 10, 2), (None, 5.0, 5, 1), ("b", 7.0, 7, 1), ("c", None, None, 0)], key=repr)


def test_empty_population(s):
    none = [{"property": "id", "op": "gt", "value": 99}]
    assert rows(s, object="Parent", filters=none, metrics=["total", "rows", "middle"]) == [(None, 0, None)]
    assert rows(s, object="Parent", filters=none, group_by=["grp"], metrics=["total", "middle"]) == []
    assert rows(s, object="Level", filters=[{"property": "track", "op": "gt", "value": 99}], metrics=["level"]) == [(None,)]


def test_many_to_one_counts_each_parent_once(s):
    # a child's group reaches parent 3 twice
    r = ask(s, object="Child", traverse=["Child_Parent"], group_by=["grp"], metrics=["total"])
    assert sorted(r.rows) == [("p", 35), ("q", 10)]
    assert not r.additive and "several groups" in r.non_additive_reason


def test_many_to_many(s):
    with pytest.raises(errors.NonAdditiveRefused) as e:
        ask(s, object="Parent", traverse=["Tags"], group_by=["grp"], metrics=["weight"])
    assert "group by id" in e.value.alternatives and "group by Tags.id" in e.value.alternatives
    r = ask(s, object="Parent", traverse=["Tags"], group_by=["id"], metrics=["weight"])
    # the repeated pair (1, 1) counts its tag once
    assert sorted(r.rows) == [(1, 110), (2, 100), (3, 1), (5, 1)] and not r.additive
    assert rows(s, "identity", object="Parent", traverse=["Tags"], group_by=["grp"], metrics=["weight"]) == sorted([("a", 110), (None, 1), ("b", 1)], key=repr)
    assert rows(s, "identity", object="Parent", traverse=["Tags"], metrics=["weight"]) == [(111,)]


def test_rows_without_a_key_cannot_be_told_apart(s):
    assert rows(s, object="Parent", traverse=["Tags"], group_by=["id"], metrics=["taggings"]) == [(1, 3), (2, 1), (3, 1), (5, 1)]
    with pytest.raises(errors.NoRowKey):
        ask(s, "identity", object="Child", traverse=["Child_Parent", "Tags"], group_by=["grp"], metrics=["taggings"])


def test_pinned_fan(s):
    r = ask(s, **FAN, group_by=["Children.id"], metrics=["total"])
    assert sorted(r.rows, key=repr) == sorted([(1, 10), (2, 10), (3, 20), (4, 5), (5, 5), (6, None), (7, None)], key=repr)
    assert r.rewrites == [] and not r.additive


def test_spanned_tables(s):
    assert rows(s, object="Parent", group_by=["kind"], metrics=["rows"]) == sorted([("x", 2), ("y", 1), (None, 1)], key=repr)
    assert rows(s, object="Parent", group_by=["kind"], metrics=["kinds"]) == sorted([("x", 1), ("y", 1), (None, None)], key=repr)
    assert rows(s, object="Child", filters=[{"property": "Child_Parent.kind", "op": "is_null"}], group_by=["id"]) == [(6,)]


def test_dotted_filters_choose_roots(s):
    f = [{"property": "Children.grp", "op": "eq", "value": "q"}]
    assert rows(s, object="Parent", filters=f, metrics=["total", "parents"]) == [(10, 3)]
    # all children of the chosen parents count, not only those that match
    assert rows(s, **FAN, filters=f, group_by=["id"], metrics=["children"]) == [(1, 2), (4, 1), (6, 1)]
    assert rows(s, object="Parent", filters=[{"property": "Tags.name", "op": "eq", "value": "u"}], group_by=["id"]) == [(3,), (5,)]
    assert rows(s, object="Employee", filters=[{"property": "Manager.name", "op": "eq", "value": "Ostrom"}], group_by=["name"]) == [("Lindqvist",), ("Sato",)]


@pytest.mark.parametrize(
    ("op", "value", "want"),
    [("eq", "a", [1, 2]), ("ne", "a", [4, 5, 6]), ("eq", None, [3]), ("ne", None, [1, 2, 4, 5, 6]), ("in", ["b", "c"], [4, 5, 6]), ("in", [], []), ("like", "_", [1, 2, 4, 5, 6]), ("like", "A%", []), ("is_null", None, [3]), ("gt", "b", [6]), ("gte", "b", [4, 5, 6]), ("lt", "b", [1, 2]), ("lte", "b", [1, 2, 4, 5])],
)
def test_filter_operators(s, op, value, want):
    f = {"property": "grp", "op": op} | ({"value": value} if value is not None else {})
    assert rows(s, object="Parent", filters=[f], group_by=["id"]) == [(x,) for x in want]


def test_recursion(s, spark):
    closure = {"object": "Employee", "traverse": ["Manager"], "group_by": ["Manager.id"], "metrics": ["staff"]}
    r = ask(s, **closure)
    assert sorted(r.rows) == [(1, 7), (2, 3), (6, 2)] and not r.additive
    one = {**closure, "traverse": [{"link": "Manager", "max_depth": 1}]}
    assert rows(s, **one) == [(1, 2), (2, 3), (6, 2)]
    assert rows(s, object="Employee", traverse=["Manager"], filters=[{"property": "name", "op": "eq", "value": "Varga"}], group_by=["Manager.name"]) == [("Lindqvist",), ("Ostrom",)]
    round_ = Spine.load(spark, PACK, catalog=tables(spark, cycle=True))
    pairs = round_.query({"object": "Employee", "traverse": ["Manager"], "group_by": ["id", "Manager.id"], "limit": None}).rows
    assert len(pairs) == len(set(pairs)) and {b for a, b in pairs if a == 1} == {1, 2, 3}


def test_stock(s):
    assert rows(s, object="Level", metrics=["level"]) == [(111,)]
    assert rows(s, object="Level", metrics=["level_first"]) == [(1012,)]
    day = ask(s, object="Level", group_by=["as_of"], metrics=["level"])
    assert sorted(day.rows) == [(dt.date(2026, 1, 1), 1012), (dt.date(2026, 1, 2), 30), (dt.date(2026, 1, 3), 111)]
    by_track = ask(s, object="Level", group_by=["track"], metrics=["level"])
    assert sorted(by_track.rows) == [(1, 4), (2, 7), (3, 100), (4, 999)] and not by_track.additive
    assert rows(s, object="Level", metrics=["level_avg", "level_max", "level_count"]) == [(144.125, 999, 8)]
    # a filter moves the instant
    assert rows(s, object="Level", filters=[{"property": "as_of", "op": "lt", "value": dt.date(2026, 1, 3)}], metrics=["level"]) == [(30,)]


def test_stock_refusals(s):
    for metrics in (["level", "level_first"], ["level", "level_count"]):
        with pytest.raises(errors.StockRefused) as e:
            ask(s, object="Level", metrics=metrics)
        assert e.value.alternatives
    fan = {"object": "Level", "traverse": ["Level_Sales"], "group_by": ["track"], "metrics": ["level"]}
    with pytest.raises(errors.StockRefused):
        ask(s, **fan)
    assert rows(s, "identity", **fan) == [(1, 4), (2, 7)]
    assert rows(s, **{**fan, "group_by": ["track", "Level_Sales.id"]}) == [(1, 1, 4), (1, 2, 4), (2, 3, 7)]


def test_fan_refusals(s):
    with pytest.raises(errors.FanOutRefused) as e:
        ask(s, **FAN, metrics=["total"])
    assert e.value.link == "Children"
    assert rows(s, "identity", **FAN, metrics=["total"]) == [(35,)]
    assert rows(s, **FAN, metrics=["total", "children"]) == [(35, 7)]
    with pytest.raises(errors.FanOutRefused) as e:
        ask(s, object="Parent", metrics=["children"])
    assert e.value.alternatives == ["add the hop Children"]
    with pytest.raises(errors.KeyBeyondMetric):
        ask(s, **FAN, group_by=["Children.grp"], metrics=["total"])
    assert rows(s, "identity", **FAN, group_by=["Children.grp"], metrics=["total"]) == [("p", 35), ("q", 10)]


def test_name_refusals(s):
    cases = [
        (errors.UnknownName, {"object": "Parnt", "group_by": ["id"]}, "Parent"),
        (errors.UnknownName, {"object": "Parent", "metrics": ["totl"]}, "total"),
        (errors.UnknownName, {"object": "Parent", "group_by": ["grap"]}, "grp"),
        (errors.UnknownName, {"object": "Parent", "traverse": ["Childs"], "group_by": ["id"]}, "Children"),
        (errors.UnknownName, {"object": "Parent", "group_by": ["id"], "order_by": [{"key": "total"}]}, "id"),
        (errors.NoPath, {"object": "Child", "traverse": ["Children"], "group_by": ["id"]}, "Child_Parent"),
        (errors.NoPath, {"object": "Parent", "traverse": ["Children", "Tags"], "group_by": ["id"]}, "Child_Parent"),
        (errors.GroupKeyNotOnPath, {"object": "Parent", "group_by": ["Children.id"]}, "add the hop Children"),
        (errors.GroupKeyNotOnPath, {"object": "Parent", "group_by": ["Parent.id"]}, "use 'id' alone"),
        (errors.AmbiguousGroupKey, {"object": "Parent", "traverse": ["Children", "Child_Parent", "Children"], "group_by": ["Children.id"]}, "walk Children once"),
        (errors.SpineError, {"object": "Parent"}, "name a metric"),
        (errors.SpineError, {"object": "Parent", "traverse": [{"link": "Children", "max_depth": 2}], "group_by": ["id"]}, "leave max_depth out"),
        (errors.SpineError, {"object": "Parent", "filters": [{"property": "val", "op": "eq", "value": "x"}], "group_by": ["id"]}, "a integer value"),
    ]
    for kind, spec, move in cases:
        with pytest.raises(kind) as e:
            s.plan(spec)
        assert move in e.value.alternatives, (spec, e.value.alternatives)


def test_order_and_limit(s):
    spec = {"object": "Parent", "group_by": ["grp"], "metrics": ["rows"], "order_by": [{"key": "grp"}]}
    assert [r[0] for r in s.query(spec).rows] == ["a", "b", "c", None]
    assert [r[0] for r in s.query({**spec, "order_by": [{"key": "grp", "desc": True}]}).rows] == [None, "c", "b", "a"]
    r = s.query({**spec, "limit": 2})
    assert r.limit_reached and [x[0] for x in r.rows] == ["a", "b"]
    assert not s.query({**spec, "limit": 5}).limit_reached
    assert s.query({**spec, "order_by": [], "group_by": ["grp", "grp"], "metrics": ["rows", "rows"]}).columns == ["grp", "rows"]


def test_guard(spark, s):
    with pytest.raises(errors.GuardTripped) as e:
        Spine(s.ontology, s.catalog, guard=Guard(max_rows=3)).query({"object": "Parent", "group_by": ["id"], "limit": None})
    assert e.value.limit == "max_rows"
    slow = Catalog(spark).add("t", spark.range(10**11).selectExpr("id", "id % 7 as g"), [("id",)])
    pack = "objects: {T: {primary: t, properties: {g: {column: t.g, type: integer, nullable: true}}}}\nmetrics: {n: {measured_on: t, agg: max, value: t.id}}"
    with pytest.raises(errors.GuardTripped) as e:
        Spine.load(spark, pack, catalog=slow, guard=Guard(timeout_ms=1500)).query({"object": "T", "group_by": ["g"], "metrics": ["n"]})
    assert e.value.limit == "timeout_ms"


def test_explain_is_what_runs(s):
    spec = {**FAN, "group_by": ["grp"], "metrics": ["total"]}
    a, b = s.explain(spec), s.explain(spec)
    assert a == b and a["strategies"] == {"total": "aggregate_then_join"} and a["plan"] == ask(s, **{**spec, "limit": 100}).plan
    assert a["ontology_elements_used"] == ["Parent", "Children", "total"]


def test_no_plan_multiplies_blindly(s):
    for spec in ({**FAN, "group_by": ["grp"], "metrics": ["total", "children", "middle"]}, {"object": "Parent", "traverse": ["Tags"], "group_by": ["id"], "metrics": ["weight"]}):
        text = s.df(spec)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_exact_order_statistics(spark):
    import math
    import random

    from pyspark.sql import functions as F

    from metricspine.functions.ordered import discrete_percentile

    r = random.Random(2)
    data = [(r.choice("ab"), r.choice([None, 2**53 + r.randrange(9), r.randrange(50)])) for _ in range(400)]
    df = spark.createDataFrame(data, "g string, v long")
    for p in (0, 0.1, 0.25, 0.5, 0.55, 0.9, 1):
        want = {g: (lambda x: x[max(1, math.ceil(p * len(x))) - 1])(sorted(v for h, v in data if h == g and v is not None)) for g in "ab"}
        assert dict(discrete_percentile(df, ["g"], F.col("v"), p, "m").collect()) == want
        everything = sorted(v for _, v in data if v is not None)
        assert discrete_percentile(df, [], F.col("v"), p, "m").first()[0] == everything[max(1, math.ceil(p * len(everything))) - 1]
    # groups by a null key, of nulls alone, of one frequent value, with nan; and a group too large for its bracket to hold it all
    odd = [(None, 1.0), (None, 3.0), (None, 2.0), ("empty", None), ("nan", float("nan")), ("nan", 1.0), ("nan", 2.0), *[("same", 7.0)] * 50, ("same", 9.0), *[("large", float(k)) for k in range(30_000)]]
    df = spark.createDataFrame(odd, "g string, v double").repartition(4)
    assert dict(discrete_percentile(df, ["g"], F.col("v"), 0.5, "m").collect()) == {None: 2.0, "empty": None, "nan": 2.0, "same": 7.0, "large": 14_999.0}
    assert dict(discrete_percentile(df, ["g"], F.col("v").cast("string"), 0.5, "m").where("g is null or g = 'same'").collect()) == {None: "2.0", "same": "7.0"}
    assert discrete_percentile(df.where("g = 'empty'"), [], F.col("v"), 0.5, "m").first()[0] is None
    assert discrete_percentile(df.limit(0), ["g"], F.col("v"), 0.5, "m").count() == 0
    days = spark.createDataFrame([(dt.date(2026, 1, d),) for d in (3, 1, 2)], "d date")
    assert discrete_percentile(days, [], F.col("d"), 0.5, "m").first()[0] == dt.date(2026, 1, 2)
    money = spark.createDataFrame([(Decimal("1.10"),), (Decimal("2.20"),)], "m decimal(10,2)")
    assert discrete_percentile(money, [], F.col("m"), 0.5, "x").first()[0] == Decimal("1.10")
