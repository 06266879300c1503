"""The engine against itself and against plain Python, over walks of the retail pack; and every registered query against its SQL."""

from __future__ import annotations

import glob
import os
from collections import defaultdict
from decimal import Decimal

import pytest

from metricspine import errors
from metricspine.queries import ORACLES, QUERIES, SPECS, spine

from .conftest import SMALL

WALKS = [
    ("Customer", ["Customer_Orders"], ["segment", "nation", "id"]),
    ("Customer", ["Customer_Orders", "Order_Lines"], ["segment", "id", "Customer_Orders.status", "Order_Lines.flag"]),
    ("Order", ["Order_Lines"], ["status", "id", "Order_Lines.flag"]),
    ("LineItem", ["Line_Order"], ["flag", "Line_Order.status", "Line_Order.id"]),
    ("LineItem", ["Line_Order", "Order_Lines"], ["flag", "Line_Order.priority"]),
    ("LineItem", ["Line_Part"], ["Line_Part.brand", "flag"]),
    ("Order", ["Order_Customer"], ["status", "Order_Customer.segment"]),
    ("Supplier", ["Supplier_Parts"], ["nation_key", "id", "Supplier_Parts.size"]),
]
METRICS = ["order_total", "order_count", "line_count", "units", "avg_order", "median_order", "max_order", "buyers", "part_rows", "customer_count"]


def answered(s, spec, engine):
    try:
        return sorted((tuple(r) for r in s.df(spec, engine).collect()), key=repr)
    except errors.SpineError as e:
        assert e.alternatives, e
        return None


def oracle(s, spec):
    """Distinct rows of the metric's table for each group, by a plain join of collected rows; for counts and sums of one table."""
    plan = s.plan(spec, "identity")
    from metricspine.operators.aggregate import keyed, labels, place
    from metricspine.operators.frames import extended, name, root_frame

    p = plan.metrics[0]
    table = s.catalog[p.metric.measured_on]
    at = place(plan.resolved, p)
    own = [name(at, table.name, table.column(c)) for c in table.keys[0]]
    groups = defaultdict(set)
    column = p.metric.value.split(".")[1]
    value = name(at, table.name, table.column(column))
    rq = plan.resolved
    whole = extended(s.catalog, root_frame(s.catalog, rq.root, rq.conditions, rq.tables()), rq.path, 0, len(rq.path), rq.tables())
    for r in keyed(whole, plan.resolved).select(*[f"`{k}`" for k in labels(plan.resolved)], *own, value).collect():
        k = len(labels(plan.resolved))
        groups[tuple(r[:k])].add((tuple(r[k:-1]), r[-1]))
    out = {}
    for key, members in groups.items():
        values = [v for _, v in members if v is not None]
        out[key] = len(values) if p.metric.agg == "count" else sum(values, Decimal(0)) if p.metric.agg == "sum" else max(values)
    return sorted(((*k, v) for k, v in out.items()), key=repr)


@pytest.mark.parametrize(("root", "path", "keys"), WALKS, ids=lambda x: x if isinstance(x, str) else None)
def test_engines_agree_wherever_both_answer(spark, root, path, keys):
    s = spine(spark, SMALL)
    both = only = 0
    for key in keys:
        for metric in METRICS:
            spec = {"object": root, "traverse": path, "group_by": [key], "metrics": [metric], "limit": None}
            a, b = (answered(s, spec, e) for e in ("preaggregate", "identity"))
            if a is not None:
                assert a == b, (spec, a[:3], b[:3])
                both += 1
            elif b is not None:
                only += 1
    assert both + only > 0


@pytest.mark.parametrize(("root", "path", "key", "metric"), [("Customer", ["Customer_Orders", "Order_Lines"], "segment", "order_total"), ("LineItem", ["Line_Order"], "flag", "order_total"), ("LineItem", ["Line_Order", "Order_Lines"], "flag", "order_count"), ("Supplier", ["Supplier_Parts"], "nation_key", "part_rows"), ("Order", ["Order_Lines"], "Order_Lines.flag", "order_count")])
def test_the_definition_itself(spark, root, path, key, metric):
    s = spine(spark, SMALL)
    spec = {"object": root, "traverse": path, "group_by": [key], "metrics": [metric], "limit": None}
    assert answered(s, spec, "identity") == oracle(s, spec)


def test_inflation_is_what_it_prevents(spark):
    s = spine(spark, SMALL)
    right = s.df({"object": "Customer", "traverse": ["Customer_Orders", "Order_Lines"], "metrics": ["order_total"], "limit": None}, "identity").first()[0]
    joined = s.catalog["orders"].df.join(s.catalog["lineitem"].df.selectExpr("l_orderkey as o_orderkey"), "o_orderkey")
    assert joined.selectExpr("sum(o_totalprice)").first()[0] > 3 * right


def test_every_query_has_sql_and_a_spec():
    assert set(QUERIES) == set(ORACLES) == set(SPECS)


def by_nulls(row):
    return [(v is None, v or "") for v in row]


def plain(v):
    return None if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)


def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name, query in QUERIES.items():
        df = query(spark, SMALL)
        want = con.execute(ORACLES[name]).df()
        columns = sorted(df.columns)
        assert columns == sorted(want.columns), name
        got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=by_nulls)
        assert got == sorted((tuple(map(plain, r)) for r in want[columns].itertuples(index=False)), key=by_nulls), name


def test_flagship_never_joins_the_lines(spark):
    text = QUERIES["fan_preagg_by_segment"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in text
    # one join to customers, one to their nation; the lines are only asked whether they exist
    assert text.count("Join Inner") == 2


def test_nothing_fans_out_to_be_asked_whether_it_exists(spark):
    """Semi-joins are nested; a metric told apart by joins has no aggregation over the fan."""
    text = spine(spark, SMALL).df({**SPECS["fan_two_hops"][0], "metrics": ["nation_rows"]})._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join LeftSemi") == 3 and text.count("Join Inner") <= 2, text


def test_levels_are_taken_without_a_window(spark):
    for name in ("stock_last_by_user", "stock_by_date", "stock_last_global"):
        assert "Window" not in QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
