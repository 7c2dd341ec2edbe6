"""Graph algorithms on edge tables (src, dst[, weight]) as rounds of joins.

Each round's state is a written table, so a plan holds one round, and a lost executor costs at most that round.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from functools import partial, reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..sources.tables import let_go, written
from . import propagation
from .network import degrees
from .ranges import in_ranges, quantile, running
from .sketches import SUMS, coupon, single, sizes, slice_of, united

#: Nodes that a task keeps sketches of, and the power of two of registers that are kept of all nodes at once.
CROWD, ROOM = 16384, 31


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: each connected pair once, without loops."""
    return edges.filter("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst) of the undirected graph, each pair in both orders."""
    pairs = undirected(edges)
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (id)."""
    own = nodes.select("id")
    return edges.join(own, edges.src == own.id, "left_semi").join(own, edges.dst == own.id, "left_semi")


def distances(edges: DataFrame, sources: DataFrame | None = None, deepest: int | None = None) -> DataFrame:
    """(src, node, dist): steps from each source (id; all nodes by default) to each node that it reaches, 0 to itself."""
    steps = written(edges.select("src", "dst").distinct(), "steps")
    sources = vertices(edges) if sources is None else sources
    seen = written(sources.select(F.col("id").alias("src"), F.col("id").alias("node"), F.lit(0).alias("dist")), "dist")
    frontier, depth = seen, 0
    while deepest is None or depth < deepest:
        depth += 1
        reached = frontier.select(F.col("src").alias("from"), "node").join(steps, F.col("node") == steps.src).select(F.col("from").alias("src"), F.col("dst").alias("node")).distinct()
        frontier = written(reached.join(seen, ["src", "node"], "left_anti").withColumn("dist", F.lit(depth)), "dist")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def path_lengths(dist: DataFrame, with_self: bool = True) -> DataFrame:
    """(dist, n): histogram of distances; a source's distance to itself counts by default."""
    return (dist if with_self else dist.filter("dist > 0")).groupBy("dist").agg(F.count("*").alias("n"))


def path_length(edges: DataFrame, start, end) -> int | None:
    """Steps from start to end; None if there is no path."""
    row = lengths_from(edges, start).filter(F.col("node") == F.lit(end)).first()
    return None if row is None else row.dist


def lengths_from(edges: DataFrame, start) -> DataFrame:
    """(node, dist) of every node that start reaches, itself included; nothing if start is no node."""
    return distances(edges, vertices(edges).filter(F.col("id") == F.lit(start))).select("node", "dist")


def shortest_paths(edges: DataFrame, start, end, n: int | None = None) -> DataFrame:
    """(path array): all shortest paths from start to end, the first n in order; none if there is no path."""
    steps = written(edges.select("src", "dst").distinct(), "steps")
    kind = steps.schema["src"].dataType.simpleString()
    frontier = steps.sparkSession.range(1).select(F.array(F.lit(start).cast(kind)).alias("path"))
    seen = frontier.select(F.lit(start).cast(kind).alias("id"))
    while True:
        done = frontier.filter(F.element_at("path", -1) == F.lit(end))
        if not done.isEmpty():
            done = done.orderBy("path")
            return done if n is None else done.limit(n)
        longer = frontier.join(steps, F.element_at("path", -1) == steps.src).select("path", "dst").join(seen.withColumnRenamed("id", "dst"), "dst", "left_anti")
        frontier = written(longer.select(F.concat("path", F.array("dst")).alias("path")), "paths")
        if frontier.isEmpty():
            break
        seen = written(seen.union(frontier.select(F.element_at("path", -1))).distinct(), "seen")
    return frontier.limit(0)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest node that each node is connected with.

    Each round every node joins its smallest neighbour, if that is smaller, and the trees that so arise shrink to their
    roots; edges inside a tree go. So the edges are read in full once, and long chains take few rounds. No side of a join
    is broadcast, which would send it over the driver each round.
    """
    every = vertices(edges) if nodes is None else nodes.select("id").union(vertices(edges)).distinct()
    found = every.select("id", F.col("id").alias("component"))
    left = written(undirected(edges), "left")
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("below"), F.col("b").alias("above")).unionByName(left.select(F.col("b").alias("below"), F.col("a").alias("above")))
        up = written(ends.groupBy("below").agg(F.min("above").alias("above")).select("below", F.least("below", "above").alias("above")), "up")
        while True:  # each node's root
            further = up.toDF("at", "root")
            new = written(up.join(further.hint("merge"), up.above == further["at"]).select("below", F.col("root").alias("above"), (F.col("root") != F.col("above")).alias("rose")), "up")
            up = new.select("below", "above")
            if new.filter("rose").isEmpty():
                break
        found = found.join(up.hint("merge"), found.component == up.below, "left").select("id", F.coalesce("above", "component").alias("component"))
        found = written(found, "components")
        one, two = up.toDF("a", "x").hint("merge"), up.toDF("b", "y").hint("merge")
        left = written(left.join(one, "a").join(two, "b").filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "left")
    return found


def numbered(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, degree, at) of the nodes of pairs (a, b, code) by degree, then id; and the pairs as (u, v, code, turned), u < v, by these numbers.

    Edges so point from the end of lower degree, and no node has more than the root of twice the edges.
    """
    size = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).groupBy("id").agg(F.count("*").alias("degree"), F.lit(1).alias("one"))
    size = written(running(size, [], ["degree", "id"], "one", "at").select("id", "degree", F.col("at").cast("long").alias("at")), "sizes")
    both = pairs.join(size.select(F.col("id").alias("a"), F.col("at").alias("x")), "a").join(size.select(F.col("id").alias("b"), F.col("at").alias("y")), "b")
    return size, both.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), "code", (F.col("x") > F.col("y")).alias("turned"))


def triangles(out: DataFrame) -> DataFrame:
    """(u, v, w, uv, uw, vw) of each triangle u < v < w of edges (u, v, code), once, with the codes of its edges; of edges (u, v), (u, v, w).

    No pair of neighbours gets a row: a node's list of greater neighbours goes to each of them, from there on, as far as
    that one's own list reaches, and is intersected there.
    """
    coded = ["code"] if "code" in out.columns else []
    out = written(out.select("u", "v", *coded), "out")
    reach = out.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    known = out.join(reach.withColumnRenamed("u", "v"), "v", "left").select("u", F.struct("v", *coded, "low", "high").alias("to"))
    codes = lambda c, name: [F.col(f"{c}.code").alias(name)] if coded else []
    lists = written(known.groupBy("u").agg(F.array_sort(F.collect_list("to")).alias("to")).select("u", F.col("to.v").alias("near"), *codes("to", "codes"), "to"), "lists")
    let_go(out)
    each = lists.select("u", "to", F.posexplode("to").alias("i", "one")).filter("one.low is not null")
    rest = F.filter(F.slice("to", F.col("i") + 2, F.size("to")), lambda x: x["v"].between(F.col("one.low"), F.col("one.high")))
    asks = each.select("u", F.col("one.v").alias("v"), *codes("one", "uv"), rest.alias("rest")).filter(F.size("rest") > 0)
    asks = asks.select("u", "v", *["uv" for _ in coded], F.col("rest.v").alias("rest"), *codes("rest", "rest_codes"))
    met = asks.join(lists.drop("to").withColumnRenamed("u", "v"), "v").withColumn("common", F.array_intersect("rest", "near")).filter(F.size("common") > 0)
    if not coded:
        return met.select("u", "v", F.explode("common").alias("w"))
    code = lambda codes, ids, w: F.element_at(codes, F.array_position(ids, w).cast("int"))
    seen = met.select("u", "v", "uv", F.explode("common").alias("w"), "rest", "rest_codes", "near", "codes")
    return seen.select("u", "v", "w", "uv", code("rest_codes", "rest", F.col("w")).alias("uw"), code("codes", "near", F.col("w")).alias("vw"))


def clustering(edges: DataFrame) -> DataFrame:
    """(id, degree, triangles, coefficient) of the undirected graph; 0 below two neighbours. Each triangle is found once."""
    size, out = numbered(undirected(edges).withColumn("code", F.lit(0)))
    kind = "int" if size.count() < 1 << 31 else "long"  # what is sent are mostly these numbers
    counts = triangles(out.select(F.col("u").cast(kind).alias("u"), F.col("v").cast(kind).alias("v"))).select(F.explode(F.array("u", "v", "w")).alias("at")).groupBy("at").agg(F.count("*").alias("triangles"))
    d, t = F.col("degree"), F.coalesce("triangles", F.lit(0))
    return size.join(counts, "at", "left").select("id", "degree", t.alias("triangles"), F.when(d > 1, t * 2.0 / (d * (d - 1))).otherwise(0.0).alias("coefficient"))


def motifs(edges: DataFrame) -> DataFrame:
    """(n_edges, n): open walks a -> b -> c (c not a, no edge a -> c), by the edges among their three nodes.

    No walk gets a row. Walks over each middle are a product of its one-way and two-way edges in and out; those whose
    ends are connected are the triangles, each found once and read in all six orders, and are taken off.
    """
    e = edges.filter("src != dst").select("src", "dst").distinct()
    there = F.col("src") < F.col("dst")
    # code: 1 for an edge from a to b, 2 for one back, 3 for both
    pairs = written(e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(F.when(there, 1).otherwise(2)).cast("int").alias("code")), "pairs")
    turned = lambda c: F.when(c == 3, 3).otherwise(3 - c)
    ends = pairs.select(F.col("a").alias("id"), "code").unionByName(pairs.select(F.col("b").alias("id"), turned(F.col("code")).alias("code")))
    sides = ends.groupBy("id").agg(F.count_if(F.col("code") == 1).alias("out"), F.count_if(F.col("code") == 2).alias("in"), F.count_if(F.col("code") == 3).alias("two"))
    each = [F.struct(F.lit(k).alias("n_edges"), n.alias("n")) for k, n in ((2, F.col("in") * F.col("out")), (3, F.col("two") * F.col("out")), (3, F.col("in") * F.col("two")), (4, F.col("two") * (F.col("two") - 1)))]
    walks = sides.select(F.inline(F.array(*each)))

    _, out = numbered(pairs)
    out = out.select("u", "v", F.when(F.col("turned"), turned(F.col("code"))).otherwise(F.col("code")).alias("code"))
    found = triangles(out).groupBy("uv", "uw", "vw").agg(F.count("*").alias("n"))

    def edge(x: str, y: str) -> Column:
        """Whether a triangle has the edge x -> y, as 0 or 1."""
        return (F.col(x + y) if x + y in ("uv", "uw", "vw") else turned(F.col(y + x))).bitwiseAND(F.lit(1))

    read = []
    for a, m, c in permutations("uvw"):
        walk, own = edge(a, m) * edge(m, c), 2 + edge(m, a) + edge(c, m)
        back = walk * (1 - edge(a, c)) * edge(c, a)
        closed = walk * F.greatest(edge(a, c), edge(c, a))
        read += [F.struct(own.alias("n_edges"), (-closed * F.col("n")).alias("n")), F.struct((own + 1).alias("n_edges"), (back * F.col("n")).alias("n"))]
    every = walks.unionByName(found.select(F.inline(F.array(*read))))
    return every.groupBy(F.col("n_edges").cast("long").alias("n_edges")).agg(F.sum("n").alias("n")).filter("n > 0")


def density(edges: DataFrame, nodes: DataFrame, directed: bool = True) -> DataFrame:
    """One row: nodes, edges, and edges over possible ones."""
    m = (edges.filter("src != dst").select("src", "dst").distinct() if directed else undirected(edges)).agg(F.count("*").alias("n_edges"))
    n = nodes.agg(F.count("*").alias("n_nodes"))
    possible = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return n.join(F.broadcast(m)).select("n_nodes", "n_edges", ratio(F.col("n_edges") * (1.0 if directed else 2.0), possible).alias("density"))


# --- centrality


def closeness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, score): by incoming distances, scaled by the share of nodes that reach it; 0 if none does."""
    d = distances(edges).filter("dist > 0").groupBy(F.col("node").alias("id")).agg(F.count("*").alias("r"), F.sum("dist").alias("s"))
    n = nodes.agg(F.count("*").alias("n"))
    score = F.col("r") * 1.0 / F.col("s") * F.col("r") / (F.col("n") - 1)
    return nodes.select("id").join(d, "id", "left").join(F.broadcast(n)).select("id", F.coalesce(F.when(F.col("n") > 1, score), F.lit(0.0)).alias("score"))


def reached(edges: DataFrame, nodes: DataFrame, lg_k: int = 12, crowd: int = CROWD, room: int = ROOM) -> DataFrame:
    """(id, r, s): estimates of how many others reach a node, and of the sum of their distances.

    Each node keeps a sketch of the nodes that reach it within so many steps, until no sketch changes; the state is a
    sketch of less than 2**lg_k bytes a node, whatever its number of pairs. The relative error is about
    1 / sqrt(2**lg_k); sets of up to a few hundred nodes are counted nearly exactly.

    Nodes with edges in lie in blocks of up to about `crowd`, by the order of their ids. A round sends a sketch once to
    each block, not along each edge: there it is united with the sketches of all its neighbours in that block. Where
    all sketches have more than 2**room registers, their registers go in slices, one slice after the other through all
    rounds; of a slice only sums stay. Tables of rounds before are deleted.
    """
    steps = written(edges.filter("src != dst").select("src", "dst").distinct(), "steps")
    own = nodes.select("id").distinct()
    told = written(own.join(steps.select(F.col("dst").alias("id")), "id", "left_semi"), "told")
    size, spread = told.count(), int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    homes, blocks = in_ranges(told, "id", name="block", n=1 + max(size // crowd, min(size * 8 // crowd, spread)))
    place = F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1  # in one block
    homes = written(homes.select("id", "block", place.alias("at")), "homes")
    ends = homes.select(F.col("id").alias("dst"), "block", "at")
    routes = written(steps.join(ends, "dst").groupBy(F.col("src").alias("id"), "block").agg(F.collect_list("at").alias("to")), "routes")
    kind, done = own.schema["id"].dataType.simpleString(), []
    lg_slices = min(lg_k, max(0, ((size << lg_k) - 1 >> room).bit_length()))
    lg_m = lg_k - lg_slices
    few = max(1, (3 << lg_m >> 5) * (2 if lg_slices else 1))  # coupons of a slice vary
    for i in range(1 << lg_slices):
        here = slice_of(F.col("id"), lg_k, lg_slices) == i
        news, old = own.filter(here).select("id", coupon(F.col("id")).alias("near")), None
        state, depth = homes.withColumns(single(F.col("id"), here, lg_m)), 0
        while not news.isEmpty():
            depth += 1
            come = news.join(routes, "id").select("block", "near", "to")
            rows = state.unionByName(come, allowMissingColumns=True).repartitionById(blocks, "block")
            new = written(rows.mapInArrow(partial(united, lg_m=lg_m, few=few, depth=depth), f"id {kind}, block int, at int, near binary, {SUMS}, log binary, grew boolean"), "sketches")
            let_go(old)
            news, state, old = new.filter("grew").select("id", "near"), new.drop("grew"), new
        done.append(written(state.select("id", "few", "dense", "c0", "last", "z", "log"), "grown"))
        let_go(old)
    found = own.join(sizes(reduce(DataFrame.unionAll, done), lg_k), "id", "left")
    return found.select("id", F.coalesce("r", F.lit(0.0)).alias("r"), F.coalesce("s", F.lit(0.0)).alias("s"))


def closeness_estimate(edges: DataFrame, nodes: DataFrame, lg_k: int = 12) -> DataFrame:
    """(id, score): closeness by the estimates of `reached`, for graphs whose pairs of nodes are too many to list."""
    n = nodes.agg(F.count("*").alias("all"))
    score = F.when((F.col("all") > 1) & (F.col("s") > 0), F.col("r") / F.col("s") * F.col("r") / (F.col("all") - 1)).otherwise(0.0)
    return reached(edges, nodes, lg_k).join(F.broadcast(n)).select("id", score.alias("score"))


def betweenness(edges: DataFrame, nodes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(id, score): share of the other pairs' shortest paths that pass a node, ends excluded, on the directed graph.

    From all sources at once: one round forward for each distance, which counts shortest paths, and one back, which
    sums what hangs on each node. The state has a row for each source and node that it reaches.
    """
    steps = written(edges.filter("src != dst").select("src", "dst").distinct(), "steps")
    sources = nodes.select("id") if sources is None else sources
    levels, links = [written(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")), "level")], []
    seen = levels[0].select("s", "v")
    while True:
        links.append(written(levels[-1].join(steps, F.col("v") == steps.src).select("s", "v", F.col("dst").alias("w"), "paths"), "links"))
        onward = links[-1].groupBy("s", F.col("w").alias("v")).agg(F.sum("paths").alias("paths"))
        level = written(onward.join(seen, ["s", "v"], "left_anti"), "level")
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("s", "v"))
    back = levels[-1].select("s", "v", "paths", F.lit(0.0).alias("hangs"))
    sums = back.select("s", "v", "hangs").limit(0)
    for level, met in zip(reversed(levels[:-1]), reversed(links[: len(levels) - 1])):
        # along the edges that the source's paths take, not all edges into a node
        part = back.select("s", F.col("v").alias("w"), ((1 + F.col("hangs")) / F.col("paths")).alias("part"))
        parts = met.select("s", "v", "w").join(part, ["s", "w"]).groupBy("s", "v").agg(F.sum("part").alias("part"))
        back = written(level.join(parts, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("hangs")), "back")
        sums = sums.unionByName(back.select("s", "v", "hangs"))
    total = sums.filter("s != v").groupBy(F.col("v").alias("id")).agg(F.sum("hangs").alias("total"))
    n = nodes.agg(F.count("*").alias("n"))
    scaled = ratio(F.coalesce("total", F.lit(0.0)), ((F.col("n") - 1) * (F.col("n") - 2)).cast("double"))
    return nodes.select("id").join(total, "id", "left").join(F.broadcast(n)).select("id", F.coalesce(scaled, F.lit(0.0)).alias("score"))


def eigenvector(edges: DataFrame, nodes: DataFrame, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """(id, score): power iteration of x + A'x over incoming edges, scaled to length 1; an error if it does not settle. Without a tolerance, the state after all rounds."""
    steps = written(edges.select("src", "dst").distinct(), "steps")
    n = nodes.count()
    x = nodes.select("id", F.lit(1.0 / max(n, 1)).alias("x"))
    for _ in range(rounds):
        come = x.join(steps, x.id == steps.src).groupBy("dst").agg(F.sum("x").alias("y"))
        new = written(x.join(come, x.id == come.dst, "left").select("id", (F.col("x") + F.coalesce("y", F.lit(0.0))).alias("new"), "x"), "power")
        length = new.agg(F.sqrt(F.sum(F.col("new") * F.col("new")))).first()[0] or 1.0
        x = new.select("id", (F.col("new") / length).alias("x"))
        if tolerance is not None and (new.agg(F.sum(F.abs(F.col("new") / length - F.col("x")))).first()[0] or 0.0) < n * tolerance:
            return x.select("id", F.col("x").alias("score"))
    if tolerance is None:
        return x.select("id", F.col("x").alias("score"))
    raise Unsettled(f"the eigenvector did not settle in {rounds} rounds")


class Unsettled(RuntimeError):
    """An iteration that was given a number of rounds did not come to rest within them."""


METHODS = ("degree", "betweenness", "closeness", "eigenvector")


def centrality(edges: DataFrame, nodes: DataFrame, method: str = "degree") -> DataFrame:
    """(id, score, method) by one of METHODS; by degree, as its method says, where the eigenvector does not settle."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    if method in ("betweenness", "closeness"):
        return (betweenness if method == "betweenness" else closeness)(edges, nodes).withColumn("method", F.lit(method))
    if method == "eigenvector":
        try:
            return eigenvector(edges, nodes).withColumn("method", F.lit(method))
        except Unsettled as e:
            warnings.warn(f"{e}; degrees stand in", stacklevel=2)
    own = degrees(edges, nodes.select("id", F.lit(None).cast("string").alias("class")))
    n = nodes.agg((F.count("*") - 1).cast("double").alias("others"))
    return own.join(F.broadcast(n)).select("id", F.coalesce(ratio(F.col("degree"), F.col("others")), F.lit(0.0)).alias("score"), F.lit("degree").alias("method"))


def above_percentile(scores: DataFrame, percent: float = 90.0, column: str = "score") -> DataFrame:
    """Rows at or above the linearly interpolated percentile."""
    return scores.filter(F.col(column) >= F.lit(quantile(scores, column, percent / 100)).cast("double"))


def hubs(edges: DataFrame, nodes: DataFrame, node_class: str | None = None, method: str = "degree", percent: float = 90.0) -> DataFrame:
    """(id, score) of the nodes at or above the percentile, on the graph that the class's nodes induce."""
    own = nodes if node_class is None else nodes.filter(F.col("class") == node_class)
    return above_percentile(centrality(induced(edges, own), own, method).select("id", "score"), percent)


# --- communities


def label_propagation(edges: DataFrame, rounds: int = 10, key: Callable[[Column], Column] = lambda c: c, block: int = propagation.EDGES) -> DataFrame:
    """(id, community): each round, the nodes of one half (by the hash of their ids, or of their keys) take the label that weighs most among their neighbours, ties the smallest.

    A half's nodes lie in blocks of about `block` edges, by the order of their ids. A block's edges are packed in arrays
    once; a round sends a node's label once to each block that has a neighbour of it, not along each edge.
    """
    around = written(_weighted_pairs(edges), "around")  # each pair once
    ends = around.select(F.col("a").alias("to"), F.col("b").alias("of"), "weight").unionAll(around.select("b", "a", "weight"))
    kind, spread = ends.schema["to"].dataType.simpleString(), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packs, labels, blocks = [], [], []
    for h in (0, 1):
        half = written(ends.filter(F.pmod(F.xxhash64(key(F.col("to"))), F.lit(2)) == h), "half")
        size = half.count()
        n = 1 + max(size // block, min(size * 8 // block, spread))
        dealt = half.repartitionByRange(n, "to").select(F.spark_partition_id().alias("block"), "to", "of", "weight")
        packs.append(written(dealt.mapInArrow(propagation.packed, f"block int, part int, at int, id {kind}, links binary"), "packs"))
        own = packs[h].filter(F.col("part") == propagation.NODE)
        blocks.append((own.agg(F.max("block")).first()[0] or 0) + 1)
        labels.append(written(own.select("block", "at", "id", F.col("id").alias("community")), "labels"))
    let_go(around)
    for k in range(2 * rounds):
        h = k % 2
        heads = packs[h].filter(F.col("part") == propagation.HEAD).select("block", "at", "id", "part")
        come = heads.join(labels[0].unionByName(labels[1]).select("id", "community"), "id").select("block", "part", "at", "community")
        rows = packs[h].filter(F.col("part") == propagation.PACKED).select("block", "part", "at", "links")
        rows = rows.unionByName(come, allowMissingColumns=True).unionByName(labels[h].withColumn("part", F.lit(propagation.NODE)), allowMissingColumns=True)
        new = written(rows.repartitionById(blocks[h], "block").mapInArrow(propagation.moved, f"block int, at int, id {kind}, community {kind}, moved boolean"), "labels")
        let_go(labels[h])
        labels[h] = new.drop("moved")
        labels[h].written_at = new.written_at
        if k % 2 and new.filter("moved").isEmpty():
            break
    else:
        warnings.warn(f"labels still move after {rounds} rounds", stacklevel=2)
    found = labels[0].unionByName(labels[1]).select("id", "community")
    loops = edges.filter("src = dst").select(F.col("src").alias("id")).distinct().join(found, "id", "left_anti")  # nodes without neighbours
    return found.unionAll(loops.select("id", F.col("id").alias("community")))


def _weighted_pairs(edges: DataFrame) -> DataFrame:
    """(a, b, weight), a < b, of the undirected graph."""
    w = F.sum("weight") if "weight" in edges.columns else F.lit(1)
    return edges.filter("src != dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(w.cast("double").alias("weight"))


def _weighted(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) of the undirected graph in both orders, weights of both directions summed; 1 without weights."""
    pairs = _weighted_pairs(edges)
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(q): share of weight inside communities (id, community) less what their degrees lead one to expect."""
    e = _weighted(edges)
    c1, c2 = communities.select(F.col("id").alias("src"), F.col("community").alias("c1")), communities.select(F.col("id").alias("dst"), F.col("community").alias("c2"))
    per = e.join(c1, "src").join(c2, "dst").groupBy("c1").agg(F.sum("weight").alias("d"), F.sum(F.when(F.col("c1") == F.col("c2"), F.col("weight")).otherwise(0.0)).alias("own"))
    total = per.agg(F.sum("d").alias("m2"))
    return per.join(F.broadcast(total)).agg(F.sum(F.col("own") / F.col("m2") - F.pow(F.col("d") / F.col("m2"), F.lit(2.0))).alias("q"))


def local_moving(e: DataFrame, degree: DataFrame, m2: float, rounds: int = 20) -> DataFrame:
    """(id, community): each round half of the nodes (by id) move to the neighbouring community that gains most modularity, until none does.

    e: (src, dst, weight) of both orders, without loops; degree: (id, k), loops included; m2: the sum of all k.
    """
    labels = written(degree.select("id", F.col("id").alias("community")), "labels")
    for r in range(2 * rounds):
        total = labels.join(degree, "id").groupBy("community").agg(F.sum("k").alias("all"))
        links = e.join(labels, e.dst == labels.id).groupBy("src", "community").agg(F.sum("weight").alias("w"))
        own = labels.join(degree, "id").select(F.col("id").alias("src"), F.col("community").alias("own"), "k")
        gain = F.col("w") - F.col("k") * (F.col("all") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)) / m2
        best = links.join(own, "src").join(total, "community").withColumn("gain", gain).groupBy("src").agg(F.min_by(F.struct("community", "gain"), F.struct(-F.col("gain"), "community")).alias("best"), F.max(F.when(F.col("community") == F.col("own"), F.col("gain"))).alias("stay"))
        moves = (F.pmod(F.xxhash64("id"), F.lit(2)) == r % 2) & (F.col("best.gain") > F.coalesce("stay", F.lit(0.0)) + 1e-12)
        new = written(labels.join(best, labels.id == best.src, "left").select("id", F.when(moves, F.col("best.community")).otherwise(F.col("community")).alias("community"), F.col("community").alias("old")), "labels")
        still = new.filter("community != old").isEmpty()
        labels = new.select("id", "community")
        if still and r % 2:
            return labels
    warnings.warn(f"communities still move after {rounds} rounds", stacklevel=2)
    return labels


def _with_degrees(edges: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    e = written(_weighted(edges), "around")
    degree = written(e.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")), "degree")
    return e, degree, degree.agg(F.sum("k")).first()[0] or 1.0


def greedy_communities(edges: DataFrame) -> DataFrame:
    """(id, community): greedy merging by modularity, from single nodes up, while a merge gains; a community is named after one of its nodes.

    A table has each pair of connected communities and what their merge gains. Each round every community asks its best
    partner (of equal gains the smaller name). Of two that ask each other, that of the greater degree (or the smaller
    name) takes the other in, and with it those that ask it too: in the order of their gains, each one only if it still
    gains when all before it are in. No merge lowers the modularity, so the last round is the best cut of the
    dendrogram. A hub takes in all its leaves in one round, over as many tasks as they fill. A round's tables are deleted
    when the next ones are there.
    """
    e = written(_weighted_pairs(edges), "around")  # each pair once
    degree = written(e.select(F.explode(F.array("a", "b")).alias("id"), "weight").groupBy("id").agg(F.sum("weight").alias("k")), "degree")
    m2 = degree.agg(F.sum("k")).first()[0] or 1.0
    found, old = degree.select("id", F.col("id").alias("community")), []
    while True:
        gain = F.col("weight") * m2 - F.col("ka") * F.col("kb")
        gains = e.join(degree.toDF("b", "kb"), "b").join(degree.toDF("a", "ka"), "a").withColumn("gain", gain).filter("gain > 0")
        end = lambda src, dst: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(f"k{src}").alias("k"), F.col(f"k{dst}").alias("other"), "gain", "weight")
        ends = gains.select(F.inline(F.array(end("a", "b"), end("b", "a"))))
        asks = ends.groupBy("src").agg(F.min_by(F.struct("dst", "gain", "weight", "k", "other"), F.struct(-F.col("gain"), "dst")).alias("best")).select("src", "best.*")
        asks = written(asks, "asks")
        if asks.isEmpty():
            return found
        back = asks.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
        first = (F.col("other") > F.col("k")) | ((F.col("other") == F.col("k")) & (F.col("dst") < F.col("src")))
        roots = written(asks.join(back, ["src", "dst"], "left_semi").filter(first).select("dst").distinct(), "roots")
        moves = asks.join(roots, "dst", "left_semi").join(roots.toDF("src"), "src", "left_anti").withColumn("place", -F.col("gain"))
        moves = running(moves, ["dst"], ["place", "src"], "k").filter(F.col("weight") * m2 > F.col("k") * (F.col("other") + F.col("ahead")))
        into = written(moves.select(F.col("src").alias("below"), F.col("dst").alias("above")), "into")
        named = lambda df, c: df.join(into, F.col(c) == F.col("below"), "left").withColumn(c, F.coalesce("above", c)).drop("below", "above")  # noqa: B023, E731
        found = written(named(found, "community"), "communities")
        merged = named(named(e, "a"), "b").filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
        e, last = written(merged.groupBy("a", "b").agg(F.sum("weight").alias("weight")), "around"), degree
        degree = written(named(degree, "id").groupBy("id").agg(F.sum("k").alias("k")), "degree")
        let_go(*old, last, asks, roots, into)
        old = [e, found]


def louvain(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, community): local moving on the nodes, then on the communities found, level by level, until a level joins none. A community is named after one of its nodes."""
    e, degree, m2 = _with_degrees(edges)
    found = degree.select("id", F.col("id").alias("community"))
    while True:
        labels = local_moving(e, degree, m2, rounds)
        if labels.select("community").distinct().count() == degree.count():
            return found
        up = labels.select(F.col("id").alias("below"), F.col("community").alias("above"))
        found = written(found.join(up, F.col("community") == up.below).select("id", F.col("above").alias("community")), "communities")
        one, two = up.toDF("src", "a"), up.toDF("dst", "b")
        e = written(e.join(one, "src").join(two, "dst").filter("a != b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")), "around")
        degree = written(degree.join(up, degree.id == up.below).groupBy(F.col("above").alias("id")).agg(F.sum("k").alias("k")), "degree")


COMMUNITIES = {"louvain": louvain, "greedy": greedy_communities, "label_propagation": label_propagation}


def communities(edges: DataFrame, method: str = "louvain") -> DataFrame:
    """(id, community) by one of COMMUNITIES."""
    if method not in COMMUNITIES:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(COMMUNITIES)}")
    return COMMUNITIES[method](edges)


def layered_positions(nodes: DataFrame, layer: str, order: str = "id", width: float = 4.0) -> DataFrame:
    """nodes with x and y: each layer's nodes at equal steps over the width, layers one under the other."""
    own = Window.partitionBy(layer)
    i, n = F.row_number().over(own.orderBy(order)) - 1, F.count("*").over(own)
    return nodes.withColumn("x", -width / 2 + width * i / F.greatest(n - 1, F.lit(1))).withColumn("y", -F.col(layer).cast("double"))


def top_pairs(rows: DataFrame, by: str, n: int, descending: bool = True, then: Sequence[str] = ()) -> DataFrame:
    return rows.orderBy(F.desc(by) if descending else F.asc(by), *then).limit(n)
