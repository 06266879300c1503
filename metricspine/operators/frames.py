"""DataFrames along a walk: a frame holds every table of every position under names of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import LinkType, ObjectType
from ..plans.resolve import Condition, Edge, Resolved
from ..sources.catalog import Catalog
from ..spec import Filter


def name(position: int | str, table: str, column: str) -> str:
    """A column's name in a frame; a position never shares names with another, so self-joins need no aliases."""
    return f"p{position}__{table}__{column}".lower()


def col(position: int | str, table: str, column: str) -> Column:
    return F.col(name(position, table, column))


def element(catalog: Catalog, position: int | str, table: str) -> DataFrame:
    df = catalog[table].df
    return df.select(*[F.col(f"`{c}`").alias(name(position, table, c)) for c in df.columns])


def _equal(pairs: list[tuple[Column, Column]]) -> Column:
    if not pairs:
        raise ValueError("a join needs a condition")
    out = pairs[0][0] == pairs[0][1]
    for a, b in pairs[1:]:
        out = out & (a == b)
    return out


def with_spans(catalog: Catalog, df: DataFrame, obj: ObjectType, position: int | str, used: frozenset[str]) -> DataFrame:
    """The further tables that an object spans; none of them repeats a row. Left-joined ones that nothing reads are left out."""
    needed, before = set(used), -1
    while before != len(needed):
        before = len(needed)
        needed |= {p.source.table for j in obj.joins.values() if j.to in needed or j.kind == "inner" for p in j.on}
    for join in obj.joins.values():
        if join.kind == "left" and join.to not in needed:
            continue
        pairs = [(col(position, p.source.table, p.source.column), col(position, p.target.table, p.target.column)) for p in join.on]
        df = df.join(element(catalog, position, join.to), _equal(pairs), join.kind)
    return df


def _ancestors(catalog: Catalog, link: LinkType, obj: ObjectType, start: int | str, position: int | str) -> DataFrame:
    """(start key, ancestor's columns): each row with every row above it, up to max_depth steps and without repeats.

    Keys climb alone: a step joins the table's two link columns, a row keeps
    the keys that it has passed, and the ancestors' columns are joined once at the end.
    """
    table, pair = obj.primary, link.on[0]
    child, key = pair.source.column, pair.target.column
    step = catalog[table].df.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{child}`").alias("_up")).where("_k is not null")
    seed = step.where("_up is not null").select(F.col("_k").alias("_start"), F.col("_up").alias("_at"), F.array("_up").alias("_passed"))
    if link.cardinality in ("many_to_one", "one_to_one"):
        # one row above each: a chain per row
        walk = seed
        for _ in range(link.max_depth - 1):
            climbed = walk.join(step.select(F.col("_k").alias("_at"), "_up"), "_at", "left")
            fresh = F.col("_up").isNotNull() & ~F.coalesce(F.array_contains("_passed", F.col("_up")), F.lit(False))
            walk = climbed.select("_start", F.when(fresh, F.col("_up")).alias("_at"), F.when(fresh, F.concat("_passed", F.array("_up"))).otherwise(F.col("_passed")).alias("_passed"))
        pairs = walk.select("_start", F.explode("_passed").alias("_anc"))
    else:
        level, levels = seed, [seed]
        for _ in range(link.max_depth - 1):
            level = level.join(step.select(F.col("_k").alias("_at"), "_up"), "_at").where("_up is not null and not array_contains(_passed, _up)")
            level = level.select("_start", F.col("_up").alias("_at"), F.concat("_passed", F.array("_up")).alias("_passed"))
            levels.append(level)
        pairs = levels[0].select("_start", F.col("_at").alias("_anc"))
        for more in levels[1:]:
            pairs = pairs.unionByName(more.select("_start", F.col("_at").alias("_anc")))
    own = element(catalog, position, table)
    return pairs.join(own, pairs["_anc"] == col(position, table, key)).drop("_anc").withColumnRenamed("_start", f"p{position}__start")


def hop(catalog: Catalog, df: DataFrame, edge: Edge, position: int, how: str = "inner", source: int | None = None, target: DataFrame | None = None) -> DataFrame:
    """df joined along an edge to the object at position; with left_semi, only the rows of df that have one.

    target replaces the object's own element, with what lies beyond it joined already.
    """
    link, at = edge.link, position - 1 if source is None else source
    table = edge.target.primary
    if link.kind == "recursive" and link.max_depth > 1:
        above = _ancestors(catalog, link, edge.target, at, position)
        if target is not None:
            above = above.join(target, col(position, table, link.on[0].target.column).eqNullSafe(F.col("_beyond")), "left_semi")
        joined = df.join(above, col(at, link.on[0].target.table, link.on[0].target.column) == F.col(f"p{position}__start"), how)
        return joined.drop(f"p{position}__start")
    end = target if target is not None else element(catalog, position, table)
    if link.kind == "through":
        j = f"{position}j"
        to = [(col(j, p.source.table, p.source.column), col(position, p.target.table, p.target.column)) if p.source.table == link.via else (col(j, p.target.table, p.target.column), col(position, p.source.table, p.source.column)) for p in link.on_to]
        frm = [(col(at, p.source.table, p.source.column), col(j, p.target.table, p.target.column)) if p.target.table == link.via else (col(at, p.target.table, p.target.column), col(j, p.source.table, p.source.column)) for p in link.on_from]
        return df.join(element(catalog, j, link.via).join(end, _equal(to), how), _equal(frm), how)
    pairs = [(col(at, p.source.table, p.source.column), col(position, p.target.table, p.target.column)) for p in link.on]
    return df.join(end, _equal(pairs), how)


def predicate(f: Filter, c: Column) -> Column:
    if f.op == "is_null" or f.op == "eq" and f.value is None:
        return c.isNull()
    if f.op == "ne" and f.value is None:
        return c.isNotNull()
    if f.op == "in":
        known = [v for v in f.value if v is not None]
        return c.isin(known) if known else F.lit(False)
    if f.op == "like":
        return c.like(f.value)
    return {"eq": c == f.value, "ne": c != f.value, "gt": c > f.value, "gte": c >= f.value, "lt": c < f.value, "lte": c <= f.value}[f.op]


def root_frame(catalog: Catalog, root: ObjectType, conditions: tuple[Condition, ...], used: frozenset[str]) -> DataFrame:
    """The root objects that the query is about.

    A filter through a link picks roots by a semi-join, one step off the root
    even on a recursive link, and neither repeats nor drops their other rows.
    """
    df = with_spans(catalog, element(catalog, 0, root.primary), root, 0, used)
    for c in conditions:
        if c.edge is None:
            df = df.where(predicate(c.filter, col(0, c.prop.column.table, c.prop.column.column)))
    for c in conditions:
        if c.edge is not None:
            far = "9f"
            one = Edge(c.edge.link.model_copy(update={"max_depth": 1}) if c.edge.link.kind == "recursive" else c.edge.link, c.edge.source, c.edge.target)
            target = with_spans(catalog, element(catalog, far, one.target.primary), one.target, far, used)
            df = hop(catalog, df, one, far, "left_semi", source=0, target=target.where(predicate(c.filter, col(far, c.prop.column.table, c.prop.column.column))))
    return df


def extended(catalog: Catalog, df: DataFrame, path: tuple[Edge, ...], first: int, last: int, used: frozenset[str]) -> DataFrame:
    """df at position first, walked on to position last."""
    for i in range(first, last):
        df = with_spans(catalog, hop(catalog, df, path[i], i + 1), path[i].target, i + 1, used)
    return df


def deep(edge: Edge) -> bool:
    """Whether a hop climbs more than one step."""
    return edge.link.kind == "recursive" and edge.link.max_depth > 1


def each_once(catalog: Catalog, df: DataFrame, rq: Resolved, last: int) -> DataFrame:
    """The root frame df walked to position last, so that each row there stands once in each group of the keys up to it.

    Before each join on equal columns, the frame is reduced to the distinct group
    keys and columns of that join: a row of the joined table has one value of
    these columns, so it meets a group once. A junction is joined as a table of
    its own. No hop may be deep.
    """
    used = rq.tables()

    def reduced(df: DataFrame, columns: list[str], upto: int) -> DataFrame:
        keys = [name(k.position, k.prop.column.table, k.prop.column.column) for k in rq.keys if k.position <= upto]
        return df.select(*dict.fromkeys([*keys, *columns])).distinct()

    for i, edge in enumerate(rq.path[:last]):
        link, at, obj = edge.link, i + 1, edge.target
        if link.kind == "through":
            j = f"{at}j"
            frm = [(p.source, p.target) if p.target.table == link.via else (p.target, p.source) for p in link.on_from]
            to = [(p.source, p.target) if p.source.table == link.via else (p.target, p.source) for p in link.on_to]
            df = reduced(df, [name(i, a.table, a.column) for a, _ in frm], i)
            df = df.join(element(catalog, j, link.via), _equal([(col(i, a.table, a.column), col(j, b.table, b.column)) for a, b in frm]))
            pairs = [(name(j, a.table, a.column), col(at, b.table, b.column)) for a, b in to]
        else:
            pairs = [(name(i, p.source.table, p.source.column), col(at, p.target.table, p.target.column)) for p in link.on]
        df = reduced(df, [a for a, _ in pairs], i).join(element(catalog, at, obj.primary), _equal([(F.col(a), b) for a, b in pairs]))
        df = with_spans(catalog, df, obj, at, used)
    return df


def surviving(catalog: Catalog, df: DataFrame, path: tuple[Edge, ...], position: int, used: frozenset[str]) -> DataFrame:
    """The rows of a frame at position that the rest of the walk would keep, without repeating them.

    Semi-joins are nested from the far end: each object on the way is reduced to
    the rows from which the walk goes on, and the frame is semi-joined with what
    is left of the first, on the link's own columns. So nothing fans out, and the
    frame's table needs no key.
    """
    if position == len(path):
        return df
    edge, at = path[position], position + 1
    rest = with_spans(catalog, element(catalog, at, edge.target.primary), edge.target, at, used)
    rest = surviving(catalog, rest, path, at, used)
    if deep(edge):
        rest = rest.select(col(at, edge.target.primary, edge.link.on[0].target.column).alias("_beyond"))
    return hop(catalog, df, edge, at, "left_semi", target=rest)

