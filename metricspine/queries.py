"""The engine's registered queries over the retail pack, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .facade import Spine

PACK = Path(__file__).parent / "packs" / "retail.yaml"
_SPINES: dict[tuple[str, str], Spine] = {}


def spine(spark: SparkSession, sf_dir: str) -> Spine:
    """The pack over a folder; kept for a session, as it holds lazy tables only."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _SPINES:
        _SPINES[at] = Spine.load(spark, PACK, sf_dir)
    return _SPINES[at]


def plain_types(df: DataFrame) -> DataFrame:
    """Exact numbers as double, whole ones as bigint and dates as text, after all arithmetic, for comparison across engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SPECS: dict[str, tuple[dict, str]] = {}


def ask(name: str, spec: dict, sql: str, engine: str = "preaggregate") -> None:
    spec = {"limit": None, **spec}
    SPECS[name] = spec, engine
    QUERIES[name] = lambda spark, sf_dir: plain_types(spine(spark, sf_dir).df(spec, engine))
    ORACLES[name] = sql


_ORDER = "CAST(o_totalprice AS DECIMAL(12,2))"
_REVENUE = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
_PRICE = "CAST(p_retailprice AS DECIMAL(12,2))"
_LEVELS = "(SELECT user_id, CAST(ts AS DATE) AS day, arg_max(CAST(value AS DECIMAL(12,2)), ts) AS level FROM events GROUP BY ALL)"
_TURNS = "(SELECT conv_id * 100 + turn AS id, conv_id, turn, role, CASE WHEN turn > 0 THEN conv_id * 100 + turn - 1 END AS previous FROM conversations)"
_SOLD = "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"
_CUSTOMERS = "customer JOIN nation ON n_nationkey = c_nationkey"
_PAIRS = "(SELECT DISTINCT l_suppkey AS suppkey, l_partkey AS partkey FROM lineitem)"


def _money(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def _disc(p: float, v: str) -> str:
    return f"quantile_disc({v}, {p})"


_CUSTOMER_ORDERS = {"object": "Customer", "traverse": ["Customer_Orders"]}
_TO_LINES = {"object": "Customer", "traverse": ["Customer_Orders", "Order_Lines"]}

ask("scan_distinct_keys", {"object": "Customer", "group_by": ["segment", "nation"]}, f"SELECT DISTINCT c_mktsegment AS segment, n_name AS nation FROM {_CUSTOMERS}")
ask("global_total", {"object": "Order", "metrics": ["order_total", "order_count"]}, f"SELECT {_money(f'sum({_ORDER})')} AS order_total, count(*) AS order_count FROM orders")
ask("group_inline", {**_CUSTOMER_ORDERS, "group_by": ["segment"], "metrics": ["order_total"]}, f"SELECT c_mktsegment AS segment, {_money(f'sum({_ORDER})')} AS order_total FROM {_CUSTOMERS} JOIN orders ON o_custkey = c_custkey GROUP BY 1")
ask("fan_preagg_by_segment", {**_TO_LINES, "group_by": ["segment"], "metrics": ["order_total"]}, f"SELECT c_mktsegment AS segment, {_money(f'sum({_ORDER})')} AS order_total FROM {_CUSTOMERS} JOIN orders ON o_custkey = c_custkey WHERE {_SOLD} GROUP BY 1")
ask(
    "fan_preagg_two_tables",
    {**_TO_LINES, "group_by": ["segment"], "metrics": ["order_total", "revenue", "order_count", "line_count"]},
    f"""WITH a AS (SELECT c_mktsegment AS segment, sum({_ORDER}) AS t, count(*) AS n FROM {_CUSTOMERS} JOIN orders ON o_custkey = c_custkey WHERE {_SOLD} GROUP BY 1),
    b AS (SELECT c_mktsegment AS segment, sum({_REVENUE}) AS r, count(*) AS n FROM {_CUSTOMERS} JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT segment, {_money('t')} AS order_total, {_money('r')} AS revenue, a.n AS order_count, b.n AS line_count FROM b LEFT JOIN a USING (segment)""",
)
ask("fan_preagg_survivors", {**_TO_LINES, "group_by": ["nation"], "metrics": ["order_count"]}, f"SELECT n_name AS nation, count(*) AS order_count FROM {_CUSTOMERS} JOIN orders ON o_custkey = c_custkey WHERE {_SOLD} GROUP BY 1")
ask("fan_two_hops", {"object": "Region", "traverse": ["Region_Nations", "Nation_Customers", "Customer_Orders", "Order_Lines"], "group_by": ["name"], "metrics": ["order_total", "nation_rows", "customer_count"]},
    f"""WITH c AS (SELECT r_name, n_nationkey, c_custkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN {_CUSTOMERS.replace('customer JOIN nation ON', 'customer ON')}),
    o AS (SELECT r_name, n_nationkey, c_custkey, o_orderkey, {_ORDER} AS t FROM c JOIN orders ON o_custkey = c_custkey WHERE {_SOLD})
    SELECT r_name AS name, {_money('sum(t)')} AS order_total, count(DISTINCT n_nationkey) AS nation_rows, count(DISTINCT c_custkey) AS customer_count FROM o GROUP BY 1""")
ask("fan_keyless_identity", {**_TO_LINES, "metrics": ["order_total"]}, f"SELECT {_money(f'sum({_ORDER})')} AS order_total FROM {_CUSTOMERS} JOIN orders ON o_custkey = c_custkey WHERE {_SOLD}", "identity")
ask("fan_keyless_with_inline", {**_TO_LINES, "metrics": ["revenue", "order_total"]},
    f"SELECT {_money(f'(SELECT sum({_REVENUE}) FROM lineitem)')} AS revenue, {_money(f'(SELECT sum({_ORDER}) FROM orders WHERE {_SOLD})')} AS order_total")
ask("opaque_expression", {**_TO_LINES, "group_by": ["segment"], "metrics": ["revenue_expr", "returned_lines"]},
    f"SELECT c_mktsegment AS segment, {_money(f'sum({_REVENUE})')} AS revenue_expr, count(*) FILTER (l_returnflag = 'R') AS returned_lines FROM {_CUSTOMERS} JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
ask("opaque_preaggregated", {"object": "Part", "traverse": ["Part_Lines", "Line_Order", "Order_Lines"], "group_by": ["brand"], "metrics": ["part_count"]},
    "SELECT p_brand AS brand, count(DISTINCT p_partkey) AS part_count FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
ask("immune_count_distinct", {**_TO_LINES, "group_by": ["segment"], "metrics": ["buyers"]}, f"SELECT c_mktsegment AS segment, count(DISTINCT o_custkey) AS buyers FROM {_CUSTOMERS} JOIN orders ON o_custkey = c_custkey WHERE {_SOLD} GROUP BY 1")
ask("immune_min_max", {**_TO_LINES, "group_by": ["segment"], "metrics": ["min_order", "max_order"]}, f"SELECT c_mktsegment AS segment, {_money(f'min({_ORDER})')} AS min_order, {_money(f'max({_ORDER})')} AS max_order FROM {_CUSTOMERS} JOIN orders ON o_custkey = c_custkey WHERE {_SOLD} GROUP BY 1")
ask("through_m2m_unique_key", {"object": "Supplier", "traverse": ["Supplier_Parts"], "group_by": ["id"], "metrics": ["part_rows"]}, f"SELECT suppkey AS id, count(*) AS part_rows FROM {_PAIRS} GROUP BY 1")
ask("through_m2m_identity_nonunique", {"object": "Supplier", "traverse": ["Supplier_Parts"], "group_by": ["nation"], "metrics": ["part_rows", "median_price"]},
    f"SELECT nation, count(*) AS part_rows, {_money(_disc(0.5, 'price'))} AS median_price FROM (SELECT DISTINCT n_name AS nation, p_partkey, {_PRICE} AS price FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN {_PAIRS} ON suppkey = s_suppkey JOIN part ON p_partkey = partkey) GROUP BY 1", "identity")
ask("through_then_fan_identity", {"object": "Supplier", "traverse": ["Supplier_Parts", "Part_Lines"], "group_by": ["nation"], "metrics": ["revenue"]},
    f"SELECT nation, {_money('sum(r)')} AS revenue FROM (SELECT DISTINCT n_name AS nation, l_orderkey, l_linenumber, l_extendedprice, {_REVENUE} AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN {_PAIRS} ON suppkey = s_suppkey JOIN lineitem ON l_partkey = partkey) GROUP BY 1", "identity")
ask("pinned_fan_inline", {"object": "Customer", "traverse": ["Customer_Orders"], "group_by": ["segment", "Customer_Orders.id"], "metrics": ["customer_count"]}, f"SELECT c_mktsegment AS segment, o_orderkey AS \"Customer_Orders.id\", 1::BIGINT AS customer_count FROM {_CUSTOMERS} JOIN orders ON o_custkey = c_custkey")
ask("pinned_fan_sum", {"object": "Nation", "traverse": ["Nation_Customers"], "group_by": ["Nation_Customers.id"], "metrics": ["nation_rows"]}, "SELECT c_custkey AS \"Nation_Customers.id\", 1::BIGINT AS nation_rows FROM customer")
ask("many_to_one_hop", {"object": "LineItem", "traverse": ["Line_Part"], "group_by": ["Line_Part.brand"], "metrics": ["revenue", "units"]}, f"SELECT p_brand AS \"Line_Part.brand\", {_money(f'sum({_REVENUE})')} AS revenue, {_money('sum(CAST(l_quantity AS DECIMAL(12,2)))')} AS units FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
ask("many_to_one_far_table", {"object": "LineItem", "traverse": ["Line_Order"], "group_by": ["flag"], "metrics": ["order_total"]}, f"SELECT flag, {_money('sum(t)')} AS order_total FROM (SELECT DISTINCT l_returnflag AS flag, o_orderkey, {_ORDER} AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1")
ask("spanned_property_left", {"object": "Nation", "traverse": ["Nation_Customers"], "group_by": ["region"], "metrics": ["customer_count"]}, "SELECT r_name AS region, count(*) AS customer_count FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
ask("spanned_property_inner", {**_CUSTOMER_ORDERS, "group_by": ["nation"], "metrics": ["order_total"]}, f"SELECT n_name AS nation, {_money(f'sum({_ORDER})')} AS order_total FROM {_CUSTOMERS} JOIN orders ON o_custkey = c_custkey GROUP BY 1")
ask("spanned_table", {"object": "Supplier", "group_by": ["nation"], "metrics": ["nation_rows"]}, "SELECT n_name AS nation, count(DISTINCT n_nationkey) AS nation_rows FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")


def _filtered(name: str, op: str, value, where: str, prop: str = "total", spec: dict | None = None) -> None:
    ask(name, {"object": "Order", "filters": [{"property": prop, "op": op, **({"value": value} if value is not None else {})}], "group_by": ["status"], "metrics": ["order_count"], **(spec or {})}, f"SELECT o_orderstatus AS status, count(*) AS order_count FROM orders WHERE {where} GROUP BY 1")


_filtered("filter_eq", "eq", "1-URGENT", "o_orderpriority = '1-URGENT'", "priority")
_filtered("filter_ne", "ne", "F", "o_orderstatus <> 'F'", "status")
_filtered("filter_gt", "gt", 200000, f"{_ORDER} > 200000")
_filtered("filter_gte", "gte", 200000, f"{_ORDER} >= 200000")
_filtered("filter_lt", "lt", 150000.5, f"{_ORDER} < 150000.5")
_filtered("filter_lte", "lte", 150000.5, f"{_ORDER} <= 150000.5")
_filtered("filter_in", "in", ["F", "P"], "o_orderstatus IN ('F', 'P')", "status")
_filtered("filter_like", "like", "%U%", "o_orderpriority LIKE '%U%'", "priority")
_filtered("filter_is_null", "is_null", None, "o_orderstatus IS NULL", "status")
_filtered("filter_date", "gte", "1995-06-01", "o_orderdate >= TIMESTAMP '1995-06-01'", "date")
ask("filter_range_conjunction", {"object": "Order", "filters": [{"property": "total", "op": "gte", "value": 100000}, {"property": "total", "op": "lt", "value": 250000}, {"property": "status", "op": "ne", "value": "F"}], "metrics": ["order_total", "order_count"]},
    f"SELECT {_money(f'sum({_ORDER})')} AS order_total, count(*) AS order_count FROM orders WHERE {_ORDER} >= 100000 AND {_ORDER} < 250000 AND o_orderstatus <> 'F'")
ask("dotted_filter_direct", {**_CUSTOMER_ORDERS, "filters": [{"property": "Customer_Orders.total", "op": "gt", "value": 400000}], "group_by": ["segment"], "metrics": ["order_total", "customer_count"]},
    f"SELECT c_mktsegment AS segment, {_money(f'sum({_ORDER})')} AS order_total, count(DISTINCT c_custkey) AS customer_count FROM {_CUSTOMERS} JOIN orders ON o_custkey = c_custkey WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {_ORDER} > 400000) GROUP BY 1")
ask("dotted_filter_through", {"object": "Supplier", "filters": [{"property": "Supplier_Parts.size", "op": "eq", "value": 50}, {"property": "Supplier_Parts.brand", "op": "like", "value": "%1%"}], "group_by": ["id", "nation"]},
    f"SELECT s_suppkey AS id, n_name AS nation FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey IN (SELECT suppkey FROM {_PAIRS} JOIN part ON p_partkey = partkey WHERE p_size = 50) AND s_suppkey IN (SELECT suppkey FROM {_PAIRS} JOIN part ON p_partkey = partkey WHERE p_brand LIKE '%1%')")
ask("dotted_filter_spanned", {"object": "Order", "filters": [{"property": "Order_Customer.nation", "op": "in", "value": ["NATION_1", "NATION_7", "NATION_12"]}], "group_by": ["priority"], "metrics": ["order_count"]},
    f"SELECT o_orderpriority AS priority, count(*) AS order_count FROM orders WHERE o_custkey IN (SELECT c_custkey FROM {_CUSTOMERS} WHERE n_name IN ('NATION_1', 'NATION_7', 'NATION_12')) GROUP BY 1")
ask("dotted_filter_selfref", {"object": "Supplier", "filters": [{"property": "Supplier_Compatriots.id", "op": "lte", "value": 5}], "group_by": ["id"]}, "SELECT s_suppkey AS id FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey <= 5)")
ask("dotted_filter_recursive_step", {"object": "Turn", "filters": [{"property": "Turn_Previous.number", "op": "eq", "value": 2}], "group_by": ["number"], "metrics": ["turn_count"]}, f"SELECT t.turn AS number, count(*) AS turn_count FROM {_TURNS} t JOIN {_TURNS} p ON p.id = t.previous WHERE p.turn = 2 GROUP BY 1")

_CLOSURE = f"""WITH RECURSIVE t AS {_TURNS}, c(start, id, depth) AS (
  SELECT t.id, p.id, 1 FROM t JOIN t p ON p.id = t.previous UNION ALL SELECT c.start, p.id, depth + 1 FROM c JOIN t x ON x.id = c.id JOIN t p ON p.id = x.previous WHERE depth < 10)"""
ask("recursive_closure", {"object": "Turn", "traverse": ["Turn_Previous"], "group_by": ["Turn_Previous.id"], "metrics": ["turn_count"]}, f"{_CLOSURE} SELECT id AS \"Turn_Previous.id\", count(*) AS turn_count FROM c GROUP BY 1")
ask("recursive_closure_by_role", {"object": "Turn", "traverse": ["Turn_Previous"], "group_by": ["Turn_Previous.role"], "metrics": ["turn_count"]}, f"{_CLOSURE} SELECT role AS \"Turn_Previous.role\", count(DISTINCT start) AS turn_count FROM c JOIN t ON t.id = c.id GROUP BY 1", "identity")
ask("recursive_depth1", {"object": "Turn", "traverse": [{"link": "Turn_Previous", "max_depth": 1}], "group_by": ["Turn_Previous.role"], "metrics": ["turn_count"]}, f"SELECT p.role AS \"Turn_Previous.role\", count(*) AS turn_count FROM {_TURNS} t JOIN {_TURNS} p ON p.id = t.previous GROUP BY 1")
ask("avg_fan", {**_TO_LINES, "group_by": ["segment"], "metrics": ["avg_order"]}, f"SELECT c_mktsegment AS segment, round(CAST(sum({_ORDER}) AS DOUBLE) / count(*), 6) AS avg_order FROM {_CUSTOMERS} JOIN orders ON o_custkey = c_custkey WHERE {_SOLD} GROUP BY 1")
ask("count_fan", {**_TO_LINES, "group_by": ["segment", "nation"], "metrics": ["order_count", "line_count"]},
    f"SELECT c_mktsegment AS segment, n_name AS nation, count(DISTINCT o_orderkey) AS order_count, count(*) AS line_count FROM {_CUSTOMERS} JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
ask("median_group", {"object": "Part", "group_by": ["brand"], "metrics": ["median_price", "median_size"]}, f"SELECT p_brand AS brand, {_money(_disc(0.5, _PRICE))} AS median_price, CAST({_disc(0.5, 'p_size')} AS BIGINT) AS median_size FROM part GROUP BY 1")
ask("p90_group", {"object": "Part", "group_by": ["brand"], "metrics": ["p90_price", "part_rows"]}, f"SELECT p_brand AS brand, {_money(_disc(0.9, _PRICE))} AS p90_price, count(*) AS part_rows FROM part GROUP BY 1")
ask("median_global", {"object": "Order", "metrics": ["median_order", "p90_order"]}, f"SELECT {_money(_disc(0.5, _ORDER))} AS median_order, {_money(_disc(0.9, _ORDER))} AS p90_order FROM orders")
ask("median_fan", {**_TO_LINES, "group_by": ["segment"], "metrics": ["median_order", "p90_order"]}, f"SELECT c_mktsegment AS segment, {_money(_disc(0.5, _ORDER))} AS median_order, {_money(_disc(0.9, _ORDER))} AS p90_order FROM {_CUSTOMERS} JOIN orders ON o_custkey = c_custkey WHERE {_SOLD} GROUP BY 1")
ask("stock_last_global", {"object": "DailyLevel", "metrics": ["level_last"]}, f"SELECT {_money('sum(level)')} AS level_last FROM {_LEVELS} WHERE day = (SELECT max(day) FROM {_LEVELS})")
ask("stock_first_global", {"object": "DailyLevel", "metrics": ["level_first"]}, f"SELECT {_money('sum(level)')} AS level_first FROM {_LEVELS} WHERE day = (SELECT min(day) FROM {_LEVELS})")
ask("stock_last_by_user", {"object": "DailyLevel", "group_by": ["user"], "metrics": ["level_last"]}, f'SELECT user_id AS "user", {_money("arg_max(level, day)")} AS level_last FROM {_LEVELS} GROUP BY 1')
ask("stock_first_by_user", {"object": "DailyLevel", "group_by": ["user"], "metrics": ["level_first"]}, f'SELECT user_id AS "user", {_money("arg_min(level, day)")} AS level_first FROM {_LEVELS} GROUP BY 1')
ask("stock_by_date", {"object": "DailyLevel", "group_by": ["day"], "metrics": ["level_last"]}, f"SELECT CAST(day AS VARCHAR) AS day, {_money('sum(level)')} AS level_last FROM {_LEVELS} GROUP BY ALL")
ask("stock_filtered", {"object": "DailyLevel", "filters": [{"property": "day", "op": "lte", "value": "2024-01-10"}], "metrics": ["level_last"]}, f"SELECT {_money('sum(level)')} AS level_last FROM {_LEVELS} WHERE day = (SELECT max(day) FROM {_LEVELS} WHERE day <= DATE '2024-01-10')")
ask("stock_unwindowed", {"object": "DailyLevel", "group_by": ["user"], "metrics": ["level_avg", "level_days"]}, f'SELECT user_id AS "user", round(CAST(sum(level) AS DOUBLE) / count(*), 6) AS level_avg, count(*) AS level_days FROM {_LEVELS} GROUP BY 1')
ask("topk_order_desc", {"object": "Customer", "traverse": ["Customer_Orders"], "group_by": ["id", "segment"], "metrics": ["order_total"], "order_by": [{"key": "order_total", "desc": True}, {"key": "id"}], "limit": 10},
    f"SELECT c_custkey AS id, c_mktsegment AS segment, {_money(f'sum({_ORDER})')} AS order_total FROM {_CUSTOMERS} JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY sum({_ORDER}) DESC NULLS FIRST, 1 ASC NULLS LAST LIMIT 10")
ask("null_ordering", {"object": "Supplier", "group_by": ["nation"], "metrics": ["nation_rows"], "order_by": [{"key": "nation"}], "limit": 7}, "SELECT n_name AS nation, count(DISTINCT n_nationkey) AS nation_rows FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey GROUP BY 1 ORDER BY 1 ASC NULLS LAST LIMIT 7")
ask("qualified_key", {"object": "Order", "traverse": ["Order_Customer"], "group_by": ["status", "Order_Customer.segment"], "metrics": ["order_total"], "order_by": [{"key": "Order_Customer.segment"}]},
    f"SELECT o_orderstatus AS status, c_mktsegment AS \"Order_Customer.segment\", {_money(f'sum({_ORDER})')} AS order_total FROM orders JOIN {_CUSTOMERS} ON c_custkey = o_custkey GROUP BY 1, 2".replace(f"JOIN {_CUSTOMERS} ON c_custkey = o_custkey", "JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"))
ask("identity_matches_preaggregate", {**_TO_LINES, "group_by": ["segment"], "metrics": ["order_total", "avg_order"]}, f"SELECT c_mktsegment AS segment, {_money(f'sum({_ORDER})')} AS order_total, round(CAST(sum({_ORDER}) AS DOUBLE) / count(*), 6) AS avg_order FROM {_CUSTOMERS} JOIN orders ON o_custkey = c_custkey WHERE {_SOLD} GROUP BY 1", "identity")
ask("event_value_by_kind", {"object": "Event", "group_by": ["kind"], "metrics": ["event_value"]}, f"SELECT event_type AS kind, {_money('sum(CAST(value AS DECIMAL(12,2)))')} AS event_value FROM events GROUP BY 1")

_NOTES = "(SELECT o_orderkey AS id, nullif(o_orderstatus, 'P') AS grade, nullif(o_orderpriority, '5-LOW') AS haste, CAST(o_totalprice AS DECIMAL(12,2)) AS amount FROM orders)"
_GRADED = {"object": "Note", "group_by": ["haste"], "metrics": ["noted_count", "graded_count"]}
ask("null_group_key", {"object": "Note", "group_by": ["grade"], "metrics": ["noted_total", "noted_count", "graded_count"]}, f"SELECT grade, {_money('sum(amount)')} AS noted_total, count(*) AS noted_count, count(grade) AS graded_count FROM {_NOTES} GROUP BY 1")
ask("null_group_key_fan", {"object": "Note", "traverse": ["Note_Lines"], "group_by": ["grade", "haste"], "metrics": ["noted_total", "line_count"]},
    f"""WITH n AS {_NOTES}, a AS (SELECT grade, haste, sum(amount) AS t FROM n WHERE id IN (SELECT l_orderkey FROM lineitem) GROUP BY 1, 2), b AS (SELECT grade, haste, count(*) AS n FROM n JOIN lineitem ON l_orderkey = id GROUP BY 1, 2)
    SELECT b.grade, b.haste, {_money('t')} AS noted_total, b.n AS line_count FROM b LEFT JOIN a ON a.grade IS NOT DISTINCT FROM b.grade AND a.haste IS NOT DISTINCT FROM b.haste""")
for _name, _filter, _where in (("is_null_hits", {"op": "is_null"}, "grade IS NULL"), ("eq_null", {"op": "eq", "value": None}, "grade IS NULL"), ("ne_null", {"op": "ne", "value": None}, "grade IS NOT NULL"), ("ne_beside_null", {"op": "ne", "value": "F"}, "grade <> 'F'")):
    ask(f"filter_{_name}", {**_GRADED, "filters": [{"property": "grade", **_filter}]}, f"SELECT haste, count(*) AS noted_count, count(grade) AS graded_count FROM {_NOTES} WHERE {_where} GROUP BY 1")
ask("null_order_up", {**_GRADED, "order_by": [{"key": "haste"}], "limit": 4}, f"SELECT haste, count(*) AS noted_count, count(grade) AS graded_count FROM {_NOTES} GROUP BY 1 ORDER BY 1 ASC NULLS LAST LIMIT 4")
ask("null_order_down", {**_GRADED, "order_by": [{"key": "haste", "desc": True}], "limit": 2}, f"SELECT haste, count(*) AS noted_count, count(grade) AS graded_count FROM {_NOTES} GROUP BY 1 ORDER BY 1 DESC NULLS FIRST LIMIT 2")
_NOBODY = [{"property": "total", "op": "lt", "value": 0}]
ask("empty_population", {"object": "Order", "filters": _NOBODY, "metrics": ["order_total", "order_count", "max_order", "median_order"]}, f"SELECT {_money(f'sum({_ORDER})')} AS order_total, count(*) AS order_count, {_money(f'max({_ORDER})')} AS max_order, {_money(_disc(0.5, _ORDER))} AS median_order FROM orders WHERE {_ORDER} < 0")
ask("empty_population_grouped", {"object": "Order", "filters": _NOBODY, "group_by": ["status"], "metrics": ["order_count"]}, f"SELECT o_orderstatus AS status, count(*) AS order_count FROM orders WHERE {_ORDER} < 0 GROUP BY 1")
ask("stock_empty", {"object": "DailyLevel", "filters": [{"property": "day", "op": "lt", "value": "1900-01-01"}], "metrics": ["level_last"]}, f"SELECT {_money('sum(level)')} AS level_last FROM {_LEVELS} WHERE day < DATE '1900-01-01'")
ask("stock_across_fan", {"object": "DailyLevel", "traverse": ["Level_Events"], "group_by": ["user"], "metrics": ["level_last"]}, f'SELECT user_id AS "user", {_money("arg_max(level, day)")} AS level_last FROM {_LEVELS} GROUP BY 1', "identity")
ask("recursive_cycle", {"object": "Ring", "traverse": ["Ring_Above"], "group_by": ["Ring_Above.id"], "metrics": ["ring_count"]},
    "WITH RECURSIVE r AS (SELECT n_nationkey AS id, (n_nationkey + 1) % 25 AS above FROM nation), c(start, id) AS (SELECT r.id, a.id FROM r JOIN r a ON a.id = r.above UNION SELECT c.start, a.id FROM c JOIN r ON r.id = c.id JOIN r a ON a.id = r.above) SELECT id::BIGINT AS \"Ring_Above.id\", count(*) AS ring_count FROM c GROUP BY 1")
