"""Layered connection tables: filters, nodes and edges, two-hop paths, region graphs and their statistics.

A pathway row is source -> middle -> target: source, source_label, source_region, middle, middle_type,
middle_class, target, target_type, target_class, step1, step2, row_ord. Classes are SOURCE, INHIBITORY and RELAY.
Thresholds are filters at the head of a plan, so a lower one later brings rows back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..sources.tables import written
from .ranges import median, quantiles

# Node classes as the tables spell them.
SOURCE, INHIBITORY, RELAY = "ORN", "Local_Neuron", "Projection_Neuron"

COLUMNS = ("source", "source_label", "source_region", "middle", "middle_type", "middle_class", "target", "target_type", "target_class", "step1", "step2")


def by_strength(pathways: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """Rows whose second step has at least `least` and at most `most` synapses."""
    if least < 1:
        raise ValueError("the least number of synapses is 1 or more")
    kept = pathways.filter(F.col("step2") >= least)
    return kept if most is None else kept.filter(F.col("step2") <= most)


def by_types(pathways: DataFrame, lateral: bool = True, inhibitory_to_relay: bool = True, relay: bool = True) -> DataFrame:
    """Rows without the types that are switched off: inhibitory to source, inhibitory to relay, any over a relay. Rows of an unknown class stay."""
    is_ = lambda c, v: F.col(c).eqNullSafe(F.lit(v))
    if not lateral:
        pathways = pathways.filter(~(is_("middle_class", INHIBITORY) & is_("target_class", SOURCE)))
    if not inhibitory_to_relay:
        pathways = pathways.filter(~(is_("middle_class", INHIBITORY) & is_("target_class", RELAY)))
    if not relay:
        pathways = pathways.filter(~is_("middle_class", RELAY))
    return pathways


def of_source(pathways: DataFrame, region: str | None = None, source: str | None = None) -> DataFrame:
    return pathways.filter(F.col("source_region") == region if region is not None else F.col("source") == source)


def pathway_type() -> Column:
    """Type of a row by the classes of its middle and target."""
    m, t = F.col("middle_class"), F.col("target_class")
    out = F.when((m == INHIBITORY) & (t == SOURCE), "lateral_inhibition").when((m == INHIBITORY) & (t == RELAY), "inhibitory_to_relay")
    return out.when(m == RELAY, "relay_feedback").otherwise("other")


def type_counts(pathways: DataFrame) -> DataFrame:
    """(pathway_type, n): by the table's own column if it has one."""
    kind = F.col("pathway_type") if "pathway_type" in pathways.columns else pathway_type().alias("pathway_type")
    return pathways.groupBy(kind).agg(F.count("*").alias("n"))


def summary(pathways: DataFrame) -> DataFrame:
    """One row: rows, mean, median, extremes and sample deviation of the second step."""
    s, pathways = F.col("step2"), written(pathways.select("step2"), "steps")
    return pathways.agg(F.count("*").alias("n"), F.avg(s).alias("mean"), median(pathways, "step2").alias("median"), F.min(s).alias("min"), F.max(s).alias("max"), F.stddev_samp(s).alias("std"))


def threshold_ladder(pathways: DataFrame, thresholds=(1, 5, 10, 20, 50, 100, 200)) -> DataFrame:
    """(threshold, n, pct, n_lateral): rows at or above each threshold, in one pass."""
    lateral = (F.col("middle_class") == INHIBITORY) & (F.col("target_class") == SOURCE)
    steps = F.array(*[F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("step2") >= t).alias("n"), F.count_if((F.col("step2") >= t) & lateral).alias("n_lateral")) for t in thresholds])
    return pathways.agg(steps.alias("steps"), F.count("*").alias("all")).select("all", F.inline("steps")).select("threshold", "n", ratio(F.col("n") * 100.0, F.col("all")).alias("pct"), "n_lateral")


def nodes(pathways: DataFrame) -> DataFrame:
    """(id, class, label, region): sources before middles before targets; of several rows a source's last counts, else the first. Targets have the region of a column target_region, if there is one."""
    def side(prio, i, c, label, region, sign):
        return pathways.select(F.col(i).alias("id"), F.col(c).alias("class") if c != SOURCE else F.lit(SOURCE).alias("class"), F.col(label).alias("label"), (F.col(region) if region else F.lit(None).cast("string")).alias("region"), F.struct(F.lit(prio), sign * F.col("row_ord")).alias("prio"))

    every = side(0, "source", SOURCE, "source_label", "source_region", -1).unionByName(side(1, "middle", "middle_class", "middle_type", None, 1)).unionByName(side(2, "target", "target_class", "target_type", "target_region" if "target_region" in pathways.columns else None, 1))
    best = every.filter("id is not null").groupBy("id").agg(F.min_by(F.struct("class", "label", "region"), "prio").alias("n"))
    return best.select("id", "n.class", "n.label", "n.region")


def region_nodes(nodes: DataFrame) -> DataFrame:
    """(id, region, n_nodes): a node for each region, with its sources counted."""
    return nodes.filter("region is not null").groupBy("region").agg(F.count("*").alias("n_nodes")).select(F.concat(F.lit("REGION_"), "region").alias("id"), "region", "n_nodes")


def edges(pathways: DataFrame) -> DataFrame:
    """(src, dst, weight, step): both steps of each row; of rows with the same ends the last counts, its second step after its first."""
    one = pathways.select(F.col("source").alias("src"), F.col("middle").alias("dst"), F.col("step1").alias("weight"), F.lit(1).alias("step"), "row_ord")
    two = pathways.select(F.col("middle").alias("src"), F.col("target").alias("dst"), F.col("step2").alias("weight"), F.lit(2).alias("step"), "row_ord")
    last = one.unionByName(two).groupBy("src", "dst").agg(F.max(F.struct("row_ord", "step", "weight")).alias("e"))
    return last.select("src", "dst", F.col("e.weight").alias("weight"), F.col("e.step").alias("step"))


def two_hop(edges: DataFrame, nodes: DataFrame, region: str | None = None, source: str | None = None, to_region: str | None = None, second: DataFrame | None = None) -> DataFrame:
    """(source, middle, target, step1, step2, their classes and regions): every path of two edges from the sources of a region (or one node), to a region if given.

    Roots are filtered before the join, so only their edges are expanded. In a layered graph `edges` may be the first
    hops alone, and `second` the second ones, so that neither is read for the other.
    """
    named = lambda who: nodes.select(F.col("id").alias(who), F.col("class").alias(f"{who}_class"), F.col("region").alias(f"{who}_region"))
    roots = named("source")
    roots = roots.filter(F.col("source_region") == region) if region is not None else roots.filter(F.col("source") == source) if source is not None else roots.filter(F.col("source_class") == SOURCE)
    ends = named("target")
    if to_region is not None:
        ends = ends.filter(F.col("target_region") == to_region)
    one = edges.select(F.col("src").alias("source"), F.col("dst").alias("middle"), F.col("weight").alias("step1")).join(roots, "source")
    two = (edges if second is None else second).select(F.col("src").alias("middle"), F.col("dst").alias("target"), F.col("weight").alias("step2")).join(ends, "target")
    return one.join(two, "middle").join(named("middle").drop("middle_region"), "middle")


def region_strengths(edges: DataFrame, nodes: DataFrame, second: DataFrame | None = None, middle_class: str | None = None) -> DataFrame:
    """(src_region, dst_region, n_paths, strength) over all two-hop paths, or those over middles of a class; `second` as in two_hop.

    The second step is summed by (middle, region) and the first counted by (region, middle) before they meet, so the
    join is as large as middles times regions, not as the paths.
    """
    of = nodes.filter("region is not null").select("id", "region")
    first = edges.join(of, edges.src == of.id).groupBy(F.col("region").alias("src_region"), F.col("dst").alias("middle")).agg(F.count("*").alias("n1"))
    two = edges if second is None else second
    last = two.join(of, two.dst == of.id).groupBy(F.col("src").alias("middle"), F.col("region").alias("dst_region")).agg(F.count("*").alias("n2"), F.sum("weight").alias("w2"))
    if middle_class is not None:
        last = last.join(nodes.filter(F.col("class") == middle_class).select(F.col("id").alias("middle")), "middle", "left_semi")
    both = first.join(last, "middle")
    return both.groupBy("src_region", "dst_region").agg(F.sum(F.col("n1") * F.col("n2")).alias("n_paths"), F.sum(F.col("n1") * F.col("w2")).alias("strength"))


def region_graph(pathways: DataFrame, nodes: DataFrame, with_self: bool = False) -> DataFrame:
    """(src, dst, weight): second steps of the table's rows summed by region; only targets that are sources have one."""
    of = nodes.filter(F.col("class") == SOURCE).select(F.col("id").alias("target"), F.col("region").alias("dst"))
    sums = pathways.groupBy(F.col("source_region").alias("src"), "target").agg(F.sum("step2").alias("weight"))  # so that no row meets its node
    rows = sums.join(of, "target")
    return (rows if with_self else rows.filter("src != dst")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, class, in_degree, out_degree, degree) of every node, 0 for one without edges."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    counts = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return nodes.join(counts, "id", "left").select("id", "class", zero("i").alias("in_degree"), zero("o").alias("out_degree"), zero(F.col("i") + F.col("o")).alias("degree"))


def hubs(edges: DataFrame, nodes: DataFrame, n: int = 10, by: str = "degree", node_class: str | None = None) -> DataFrame:
    """The n nodes (of a class) of greatest degree in the whole graph, ties by id."""
    own = degrees(edges, nodes)
    if node_class is not None:
        own = own.filter(F.col("class") == node_class)
    return own.orderBy(F.desc(by), F.asc("id")).limit(n)


def statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean and greatest degrees, and moments of the weights."""
    d = degrees(edges, nodes).agg(F.count("*").alias("n_nodes"), F.avg("in_degree").alias("mean_in"), F.max("in_degree").alias("max_in"), F.avg("out_degree").alias("mean_out"), F.max("out_degree").alias("max_out"))
    w = F.col("weight")
    e = edges.agg(F.count("*").alias("n_edges"), F.avg(w).alias("mean_weight"), median(edges, "weight").alias("median_weight"), F.stddev_pop(w).alias("std_weight"), F.min(w).alias("min_weight"), F.max(w).alias("max_weight"))
    return d.join(F.broadcast(e))


def path_statistics(paths: DataFrame) -> DataFrame:
    """(middle_class, n_paths, n_middles, n_targets, mean, median, total, max) of two-hop paths."""
    s, paths = F.col("step2"), written(paths.select("middle_class", "middle", "target", "step2"), "paths")
    of = quantiles(paths, ["middle_class"], "step2", name="median").withColumnRenamed("middle_class", "_class")
    own = paths.groupBy("middle_class").agg(F.count("*").alias("n_paths"), F.countDistinct("middle").alias("n_middles"), F.countDistinct("target").alias("n_targets"), F.avg(s).alias("mean"), F.sum(s).alias("total"), F.max(s).alias("max"))
    return own.join(of, F.col("middle_class").eqNullSafe(F.col("_class"))).drop("_class")


def targets_by_region(paths: DataFrame) -> DataFrame:
    """(target_region, n_paths): only targets with a region."""
    return paths.filter("target_region is not null").groupBy("target_region").agg(F.count("*").alias("n_paths"))


def search_statistics(paths: DataFrame, strongest: int | None = None) -> DataFrame:
    """One row on the paths found, or on the strongest of them."""
    if strongest is not None:
        paths = paths.orderBy(F.desc("step2"), "source", "middle", "target").limit(strongest)
    paths = written(paths.select("middle", "middle_class", "step2"), "paths")
    s, zero = F.col("step2"), lambda c: F.coalesce(c, F.lit(0))
    middle = lambda k: F.count_distinct(F.when(F.col("middle_class") == k, F.col("middle")))
    return paths.agg(
        F.count("*").alias("n_paths"), zero(F.sum(s)).cast("long").alias("total"), zero(F.avg(s)).cast("double").alias("mean"), zero(median(paths, "step2")).cast("double").alias("median"), zero(F.max(s)).cast("long").alias("max"),
        zero(F.min(s)).cast("long").alias("min"), middle(INHIBITORY).alias("n_inhibitory"), middle(RELAY).alias("n_relay"), F.when(F.count("*") > 0, 2).otherwise(0).alias("shortest"),
    )


def compare(strengths: DataFrame, a: str, b: str) -> DataFrame:
    """One row on the paths a -> b against b -> a, from region strengths."""
    there = (F.col("src_region") == a) & (F.col("dst_region") == b)
    back = (F.col("src_region") == b) & (F.col("dst_region") == a)
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long")
    sums = strengths.filter(there | back).agg(total(there, "n_paths").alias("n12"), total(back, "n_paths").alias("n21"), total(there, "strength").alias("s12"), total(back, "strength").alias("s21"))
    per = lambda x, y: F.coalesce(ratio(F.col(x) * 1.0, F.col(y)), F.lit(0.0))
    return sums.select(
        "*", per("s12", "n12").alias("mean12"), per("s21", "n21").alias("mean21"), (F.col("n12") / F.greatest(F.col("n21"), F.lit(1))).alias("count_ratio"), (F.col("s12") / F.greatest(F.col("s21"), F.lit(1))).alias("strength_ratio"),
        F.coalesce(ratio((F.col("s12") - F.col("s21")) * 1.0, F.col("s12") + F.col("s21")), F.lit(0.0)).alias("asymmetry"),
    )


def shared_middles(paths_there: DataFrame, paths_back: DataFrame) -> DataFrame:
    """(middle, middle_class, there, back): middles of either direction, and in which they are."""
    one = paths_there.select("middle", "middle_class").distinct().withColumn("there", F.lit(1)).withColumn("back", F.lit(0))
    two = paths_back.select("middle", "middle_class").distinct().withColumn("there", F.lit(0)).withColumn("back", F.lit(1))
    return one.unionByName(two).groupBy("middle", "middle_class").agg((F.max("there") == 1).alias("there"), (F.max("back") == 1).alias("back"))


def asymmetry(strengths: DataFrame) -> DataFrame:
    """(a, b, forward, backward, asymmetry) of every ordered pair of regions with a path either way."""
    s = strengths.filter("src_region != dst_region")
    there = s.select(F.col("src_region").alias("a"), F.col("dst_region").alias("b"), F.col("strength").alias("f"), F.lit(0).cast("long").alias("g"))
    back = s.select(F.col("dst_region").alias("a"), F.col("src_region").alias("b"), F.lit(0).cast("long").alias("f"), F.col("strength").alias("g"))
    both = there.unionByName(back).groupBy("a", "b").agg(F.sum("f").cast("long").alias("forward"), F.sum("g").cast("long").alias("backward")).filter("forward + backward > 0")
    return both.withColumn("asymmetry", (F.col("forward") - F.col("backward")) / (F.col("forward") + F.col("backward")))


def hub_middles(paths: DataFrame, middle_class: str | None = INHIBITORY) -> DataFrame:
    """(middle, n_regions, n_targets): target regions and targets that each middle reaches."""
    own = paths if middle_class is None else paths.filter(F.col("middle_class") == middle_class)
    return own.groupBy("middle").agg(F.countDistinct("target_region").alias("n_regions"), F.countDistinct("target").alias("n_targets"))


def displayed(edges: DataFrame, nodes: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Edges of at least `least`, and the nodes that they touch."""
    kept = edges.filter(F.col("weight") >= least)
    ends = kept.select(F.col("src").alias("id")).unionByName(kept.select(F.col("dst").alias("id")))
    return kept, nodes.join(ends, "id", "left_semi")
