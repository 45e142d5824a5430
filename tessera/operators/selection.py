"""Greedy choices under caps, as rounds over whole tables that end where taking one row after the other would.

`capped_edges`: edges in a total order, each taken if both its ends have room for one. In a round an edge is taken if, at both ends, all that
comes before it together leaves room: then the sequential choice has room as well, whatever it took. Edges at full nodes go. The first edge
left is always taken, and most orders need few rounds; only as many edges of a node as its cap are ranked, so a hub costs no more than others.

`capped_nodes`: pairs in a total order, each bringing the ends that aren't in yet if they fit the caps of the group and of their types. What
doesn't fit never will, as what a pair still needs and what is in only grow together; so each round takes the first `batch` pairs of a group
that still fit, goes through them in order, and drops what fits no more.

Null ends and groups are dropped. A loop needs one place and takes two. Equal orders are broken by the columns of the order, which have to be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import relational as ops


def capped_edges(edges: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """The edges (g, a, b, more columns) of each g that the greedy choice in `order` takes, at most `cap` at a node."""
    columns = edges.columns
    rest = ops.settled(edges.dropna(subset=["g", "a", "b"]).withColumn("o", F.struct(*order)))
    taken: list[DataFrame] = []
    used = None
    while not rest.isEmpty():
        ends = rest.select("g", "o", F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("node"), F.lit(2).alias("w")))).otherwise(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("w")), F.struct(F.col("b").alias("node"), F.lit(1).alias("w")))).alias("e"))
        ends = ends.select("g", "o", F.size("e").alias("ends"), F.explode("e").alias("e")).select("g", "o", "ends", "e.*")
        by = Window.partitionBy("g", "node").orderBy("o")
        ends = ends.withColumn("r", F.row_number().over(by)).where(F.col("r") <= cap)
        ends = ends.withColumn("ahead", F.coalesce(F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        if used is not None:
            ends = ends.join(used, ["g", "node"], "left").withColumn("ahead", F.col("ahead") + F.coalesce("used", F.lit(0))).drop("used")
        sure = ends.where(F.col("ahead") < cap).groupBy("g", "o").agg(F.count("*").alias("n"), F.first("ends").alias("ends")).where("n = ends").select("g", "o")
        new = ops.settled(rest.join(sure, ["g", "o"]))
        taken.append(new)
        spent = new.select("g", F.explode(F.array("a", "b")).alias("node")).groupBy("g", "node").agg(F.count("*").alias("used"))
        used = spent if used is None else used.unionByName(spent).groupBy("g", "node").agg(F.sum("used").alias("used"))
        used = ops.settled(used)
        full = used.where(F.col("used") >= cap)
        rest = rest.join(new.select("g", "o"), ["g", "o"], "left_anti")
        for end in ("a", "b"):
            rest = rest.join(full.select("g", F.col("node").alias(end)), ["g", end], "left_anti")
        rest = ops.settled(rest)
    out = rest
    for part in taken:
        out = out.unionByName(part)
    return out.select(*columns)


def first_edges(edges: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first `most` edges of each g."""
    return ops.first_per(edges, ["g"], order, most)


def capped_nodes(nodes: DataFrame, pairs: DataFrame, order: list[Column], most: int, limits: dict[str, int], fill: list[str], default: int = 1, batch: int = 32, kinds: DataFrame | None = None) -> DataFrame:
    """(g, node, type, via): what the pairs (g, a, b, ...) bring in by `order`, at most `most` in a g and limits[type] of a type; then, for each
    type of `fill` with room, its nodes (g, node, type, name, degree) of highest degree, by name and id among equals.

    `kinds` (node, type) may say what the ends of pairs are, if that is the same in each g; else `nodes` does. The first round takes its pairs before
    their ends are looked up, and where it fills a group, no pair of that group is looked at again.
    """
    limit = lambda kind: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), kind), F.lit(default)) if limits else F.lit(default)
    member = "array<struct<node:string,type:string>>"

    def brings(inside: Column, r: Column) -> Column:
        """The ends of the pair that aren't inside yet; null if they don't fit."""
        new = lambda end: F.when(~F.exists(inside, lambda m: m["node"] == r[end]), F.array(F.struct(r[end].alias("node"), r[f"{end}_type"].alias("type")))).otherwise(F.array().cast(member))
        ends = F.array_distinct(F.concat(new("a"), new("b")))
        per = lambda kind: F.size(F.filter(F.concat(inside, ends), lambda m: m["type"] == kind))
        fits = (F.size(inside) + F.size(ends) <= most) & F.forall(ends, lambda m: per(m["type"]) <= limit(m["type"]))
        return F.when(fits, ends)

    by = ["node"] if kinds is not None else ["g", "node"]
    kinds = (nodes if kinds is None else kinds).select(*by, "type").withColumn("node", F.col("node").cast("string"))

    def typed(rows: DataFrame, small: bool) -> DataFrame:
        """rows (g, r) with the types of both ends; those with an end that is no node go."""
        rows = rows.select("g", F.col("r.o").alias("o"), F.col("r.a").alias("a"), F.col("r.b").alias("b"))
        for end in ("a", "b"):
            kind = kinds.select(*by[:-1], F.col("node").alias(end), F.col("type").alias(f"{end}_type"))
            rows = kind.join(ops.sent(ops.settled(rows)), [*by[:-1], end]) if small else rows.join(kind, [*by[:-1], end])
        return rows.select("g", F.struct("o", "a", "b", "a_type", "b_type").alias("r"))

    every = pairs.where("g IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL").select("g", F.struct(F.struct(*order).alias("o"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).alias("r"))
    state, rest = None, None
    while rest is None or not rest.isEmpty():
        best = ops.first_per(every if rest is None else rest, ["g"], [F.col("r.o")], batch)
        if rest is None:
            first = ops.settled(best)
            groups, best = first.select("g").distinct(), typed(first, True)
        best = best.groupBy("g").agg(F.sort_array(F.collect_list("r")).alias("rs"))
        best = best.join(state, "g", "left") if state is not None else best.withColumn("inside", F.lit(None).cast(member))
        inside = F.coalesce("inside", F.array().cast(member))
        after = F.aggregate("rs", inside, lambda acc, r: F.concat(acc, F.coalesce(brings(acc, r), F.array().cast(member))))
        new = best.select("g", after.alias("inside"))
        if state is not None:
            new = new.unionByName(state.join(new, "g", "left_anti"))
        else:
            new = groups.join(new, "g", "left").select("g", F.coalesce("inside", F.array().cast(member)).alias("inside"))
        state = ops.settled(new)
        need = brings(F.col("inside"), F.col("r"))
        room = state.where(F.size("inside") < most)
        if rest is None:
            # Only groups with room are looked through, if there are any.
            rest = room.limit(0) if room.isEmpty() else typed(every.join(ops.sent(room.select("g")), "g"), False)
        rest = rest.limit(0) if room.isEmpty() else ops.settled(rest.join(room, "g").where(F.size(need) > 0).select("g", "r"))
    inside = state.select("g", F.explode("inside").alias("m")).select("g", "m.node", "m.type")
    had = inside.groupBy("g", "type").agg(F.count("*").alias("had"))
    left = nodes.where(F.col("type").isin(fill)).withColumn("node", F.col("node").cast("string")).join(inside.select("g", "node"), ["g", "node"], "left_anti")
    by = [F.desc("degree"), F.lower("name"), F.col("node")]
    left = left.withColumn("r", F.row_number().over(Window.partitionBy("g", "type").orderBy(*by))).where(F.col("r") <= max([default, *limits.values()]))
    left = left.join(had, ["g", "type"], "left").where(F.col("r") + F.coalesce("had", F.lit(0)) <= limit(F.col("type")))
    return inside.withColumn("via", F.lit("pair")).unionByName(left.select("g", "node", "type", F.lit("fill").alias("via")))


def edge_sides(dx: Column, dy: Column) -> Column:
    """struct<from_side, to_side> of an edge between boxes whose centres are dx and dy apart: across if that is at least as far as up or down."""
    across, forward, down = F.abs(dx) >= F.abs(dy), dx >= 0, dy >= 0
    side = lambda right, left, bottom, top: F.when(across & forward, right).when(across, left).when(down, bottom).otherwise(top)
    return F.struct(side("right", "left", "bottom", "top").alias("from_side"), side("left", "right", "top", "bottom").alias("to_side"))
