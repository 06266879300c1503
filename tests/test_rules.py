"""Each rule of loading with a pack that keeps it and one that breaks it, and the adapters around the engine."""

from __future__ import annotations

import ast
import datetime as dt
import io
import json
from pathlib import Path

import pytest
import yaml
from pydantic import ValidationError

from metricspine import cli, errors
from metricspine.facade import Spine
from metricspine.functions.expressions import bound, stray_word
from metricspine.sources.catalog import Catalog
from metricspine.sources.packs import effective_quantity, load_pack, parse_pack
from metricspine.spec import QuerySpec
from metricspine.tools import Tools, answer

GOOD = {
    "objects": {
        "Order": {
            "primary": "orders",
            "joins": {"shop": {"to": "shop", "kind": "left", "cardinality": "many_to_one", "on": [{"from": "orders.shop_id", "to": "shop.shop_id"}]}},
            "properties": {
                "id": {"column": "orders.id", "type": "integer", "unique": True},
                "total": {"column": "orders.total", "type": "decimal", "quantity": "flow"},
                "price": {"column": "orders.price", "type": "decimal", "quantity": "value_per_unit"},
                "stock": {"column": "orders.stock", "type": "integer", "quantity": "stock"},
                "note": {"column": "orders.note", "type": "string", "nullable": True},
                "day": {"column": "orders.day", "type": "date", "time_unit": "day"},
                "shop": {"column": "shop.name", "type": "string", "via": "shop", "nullable": True},
            },
        },
        "Line": {"primary": "line", "properties": {"id": {"column": "line.id", "type": "integer"}}},
    },
    "links": {"Lines": {"from": "Order", "to": "Line", "cardinality": "one_to_many", "on": [{"from": "orders.id", "to": "line.order_id"}]}},
    "metrics": {
        "sum_total": {"measured_on": "orders", "agg": "sum", "value": "orders.total"},
        "worth": {"measured_on": "orders", "agg": "sum", "value": "orders.price * orders.stock"},
        "held": {"measured_on": "orders", "agg": "sum", "value": "orders.stock", "over_time": {"dimension": "day", "choice": "last"}},
        "p": {"measured_on": "orders", "agg": "percentile", "percentile": 0.9, "value": "orders.price"},
        "free": {"measured_on": "orders", "expr": "sum(case when orders.note like 'a%' then 1 else 0 end) / nullif(count(*), 0)"},
    },
}


@pytest.fixture(scope="module")
def catalog(spark):
    c = Catalog(spark)
    c.add("orders", spark.createDataFrame([(1, 1, 2.0, 1.0, 3, None, dt.date(2026, 1, 1)), (2, 1, 4.0, 1.5, 5, "a", dt.date(2026, 1, 2))], "id int, shop_id int, total double, price double, stock int, note string, day date"), [("id",)], {"total", "price", "stock", "day"})
    c.add("shop", spark.createDataFrame([(1, "s")], "shop_id int, name string"), [("shop_id",)], {"*"})
    c.add("line", spark.createDataFrame([(1, 1), (2, 1)], "id int, order_id int"), [("id",)])
    return c


def changed(path: str, value, drop: bool = False) -> str:
    pack = json.loads(json.dumps(GOOD))
    at = pack
    *way, last = path.split("/")
    for step in way:
        at = at.setdefault(step, {})
    if drop:
        at.pop(last)
    else:
        at[last] = value
    return yaml.safe_dump(pack)


def test_good_pack(catalog):
    o = load_pack(yaml.safe_dump(GOOD), catalog, verify=True)
    assert effective_quantity(o, o.metrics["sum_total"]) == "flow" and effective_quantity(o, o.metrics["worth"]) is None


@pytest.mark.parametrize(
    ("rule", "path", "value"),
    [
        ("L1 table", "objects/Order/primary", "nowhere"),
        ("L1 column", "objects/Order/properties/note/column", "orders.nothing"),
        ("L2 fanning join", "objects/Order/joins/shop/cardinality", "one_to_many"),
        ("L3 no key", "objects/Order/joins/shop/on", [{"from": "orders.note", "to": "shop.name"}]),
        ("L4 not a key", "objects/Order/properties/total/unique", True),
        ("L4 spanned", "objects/Order/properties/shop/unique", True),
        ("L5 not null", "objects/Order/properties/note/nullable", False),
        ("L5 left join", "objects/Order/properties/shop/nullable", False),
        ("L6 via", "objects/Order/properties/shop/via", "warehouse"),
        ("L6 no via", "objects/Order/properties/shop", {"column": "shop.name", "type": "string", "nullable": True}),
        ("L7 clash", "objects/Order/properties/sum_total", {"column": "orders.total", "type": "decimal"}),
        ("L8 end", "links/Lines/to", "Lime"),
        ("L8 column", "links/Lines/on", [{"from": "orders.id", "to": "line.ordre"}]),
        ("L8 inverse", "links/Lines/inverse_of", "Nothing"),
        ("L8 via", "links/T", {"from": "Order", "to": "Line", "kind": "through", "cardinality": "many_to_many", "via": "none", "on_from": [{"from": "orders.id", "to": "none.a"}], "on_to": [{"from": "none.b", "to": "line.id"}]}),
        ("L9 other table", "metrics/free/expr", "sum(line.id)"),
        ("L9 no column", "metrics/free/expr", "sum(orders.nothing)"),
        ("L9 bare", "metrics/free/expr", "sum(total)"),
        ("L9 bare upper", "metrics/free/expr", "sum(ORDERS.TOTAL) + TOTAL"),
        ("L9 residue", "metrics/free/expr", "sum(orders.total); drop"),
        ("L9 window", "metrics/free/expr", "sum(orders.total) over (partition by orders.note)"),
        ("L10 undeclared", "metrics/sum_total/value", "orders.shop_id"),
        ("L10 per unit", "metrics/sum_total/value", "orders.price"),
        ("L10 own quantity", "metrics/sum_total/quantity", "value_per_unit"),
        ("L11 stock without time", "metrics/sum_total/value", "orders.stock"),
        ("L11 time without stock", "metrics/sum_total/over_time", {"dimension": "day"}),
        ("L12 no date", "objects/Order/properties/day/column", "orders.note"),
        ("L12 nullable", "objects/Order/properties/day/nullable", True),
        ("L12 type", "objects/Order/properties/id/time_unit", "day"),
        ("L13 dimension", "metrics/held/over_time", {"dimension": "shop"}),
        ("L14 range", "metrics/p/percentile", 1.5),
        ("L14 misplaced", "metrics/sum_total/percentile", 0.5),
        ("L15 both forms", "metrics/sum_total/expr", "sum(orders.total)"),
        ("L15 no form", "metrics/sum_total", {"measured_on": "orders"}),
        ("L15 half a form", "metrics/sum_total", {"measured_on": "orders", "agg": "sum"}),
        ("L16 typo", "metrics/sum_total/quantitty", "flow"),
        ("L16 typo in a property", "objects/Order/properties/id/uniqe", True),
        ("L17 no on", "links/Lines/on", []),
        ("L17 through", "links/Lines/kind", "through"),
        ("L19 no mapping", "metrics/sum_total", "sum"),
        ("recursive elsewhere", "links/Lines/kind", "recursive"),
        ("cardinality", "links/Lines/cardinality", "sometimes"),
    ],
)
def test_broken_packs(catalog, rule, path, value):
    with pytest.raises(errors.OntologyError):
        load_pack(changed(path, value), catalog)


def test_stock_by_expression_is_refused(catalog):
    with pytest.raises(errors.OntologyError):
        load_pack(changed("metrics/held", {"measured_on": "orders", "expr": "sum(orders.stock)", "quantity": "stock", "over_time": {"dimension": "day"}}), catalog)


def test_data_is_checked_on_request(spark, catalog):
    wrong = changed("links/Lines/cardinality", "one_to_one")
    load_pack(wrong, catalog)
    with pytest.raises(errors.OntologyError, match="repeats order_id"):
        load_pack(wrong, catalog, verify=True)
    bad = Catalog(spark)
    bad.tables = dict(catalog.tables)
    for keys, not_null, said in (([("id",), ("shop_id",)], {"total", "price", "stock", "day"}, "repeats its key"), ([("id",)], {"*"}, "nulls in note")):
        bad.add("orders", catalog["orders"].df, keys, not_null)
        with pytest.raises(errors.OntologyError, match=said):
            load_pack(yaml.safe_dump(GOOD), bad, verify=True)


def test_on_stays_a_key_and_yes_a_word():
    o, tables = parse_pack("objects: {}\ntables: {t: {source: on}}\nmetrics: {m: {measured_on: t, agg: count, value: t.x, description: yes}}\n")
    assert tables["t"]["source"] == "on" and o.metrics["m"].description == "yes"
    with pytest.raises(errors.OntologyError):
        parse_pack("- a\n- b\n")
    with pytest.raises(errors.OntologyError):
        parse_pack("a: [\n")


def test_expressions():
    assert stray_word("sum(t.a) filter (where t.b between 1 and 2.5e3)") is None
    assert stray_word("cast(sum(t.a) as double)") is None
    assert stray_word("sum(t.a) / total") == "total"
    assert bound("T.a + f(t.b) * 'x t.c'", lambda t, c: f"<{c}>") == "<a> + f(<b>) * 'x t.c'"


@pytest.mark.parametrize(
    "spec",
    [
        {"object": "Order", "group": ["id"]},
        {"object": "Order", "limit": 0},
        {"object": "Order", "filters": [{"property": "id", "op": "in", "value": 1}]},
        {"object": "Order", "filters": [{"property": "id", "op": "is_null", "value": 1}]},
        {"object": "Order", "filters": [{"property": "id", "op": "gt"}]},
        {"object": "Order", "filters": [{"property": "id", "op": "eq", "value": [1]}]},
        {"object": "Order", "filters": [{"property": "id", "op": "about", "value": 1}]},
        {"object": "Order", "traverse": [{"link": "Lines", "max_depth": 51}]},
    ],
)
def test_bad_requests(spec):
    with pytest.raises(ValidationError):
        QuerySpec(**spec)


def test_describe(catalog):
    s = Spine(load_pack(yaml.safe_dump(GOOD), catalog), catalog)
    whole, one = s.describe(), s.describe("Line")
    assert set(whole["objects"]) == {"Order", "Line"} and len(whole["rules"]) == 7
    assert whole["links"]["Lines"]["fans_out"] and whole["metrics"]["held"]["measures"] == "Order"
    assert set(one["objects"]) == {"Line"} and one["metrics"] == {}
    with pytest.raises(errors.UnknownName):
        s.describe("Lyne")


def test_tools(catalog):
    tools = Tools(Spine(load_pack(yaml.safe_dump(GOOD), catalog), catalog))
    text = tools.run({"object": "Order", "group_by": ["shop", "note"], "metrics": ["sum_total"], "order_by": [{"key": "sum_total"}], "limit": 1})
    assert text.splitlines()[0].startswith("TRUNCATED") and text.splitlines()[-1] == "s | NULL | 2.0"
    assert tools.run({"object": "Order", "group_by": ["shop"], "metrics": ["held"]}).startswith("NOT ADDITIVE")
    assert tools.query({"object": "Odrer"})["alternatives"] == ["Order"]
    assert tools.explain({"object": "Order", "limit": 0})["error"] == "InvalidSpec"
    assert tools.describe_ontology("x")["error"] == "UnknownName"
    seen = []

    def propose(question, said):
        seen.append(said)
        return {"object": "Order", "metrics": ["sum_total" if said else "total_sum"]}

    assert answer(propose, tools, "what is the total?").endswith("6.0") and len(seen) == 2 and "UnknownName" in seen[1]
    assert answer(lambda q, said: {"object": "?"}, tools, "?").startswith("REFUSED")


def test_cli(spark, tmp_path, capsys, monkeypatch):
    pack = Path(__file__).parents[1] / "metricspine" / "packs" / "retail.yaml"
    base = ["--pack", str(pack), "--data", "/root/testdata/sf0.001"]
    assert cli.main(["describe", "Order", *base], spark) == 0
    assert "Order_Lines" in json.loads(capsys.readouterr().out)["links"]
    spec = {"object": "Order", "metrics": ["order_total", "order_count"]}
    assert cli.main(["query", json.dumps(spec), *base], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["columns"] == ["order_total", "order_count"] and isinstance(out["rows"][0][0], str)
    (tmp_path / "spec.json").write_text(json.dumps(spec))
    assert cli.main(["explain", str(tmp_path / "spec.json"), *base], spark) == 0
    assert "Aggregate" in json.loads(capsys.readouterr().out)["plan"]
    monkeypatch.setattr("sys.stdin", io.StringIO('{"object": "Nothing"}'))
    assert cli.main(["query", "-", *base], spark) == 1
    assert json.loads(capsys.readouterr().err)["error"] == "UnknownName"


def test_the_core_imports_no_pack_and_no_extension():
    """The engine's modules know no domain, and nothing outside the extension imports it."""
    root = Path(__file__).parents[1] / "metricspine"
    for file in root.rglob("*.py"):
        if "llm" in file.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(file.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), file
        if file.name != "queries.py":
            assert "retail" not in file.read_text(), file


def test_retail_pack_holds_against_its_data(spark):
    from metricspine.queries import PACK

    Spine.load(spark, PACK, "/root/testdata/sf0.001", verify=True)
