"""Command line: python -m quillon.cli TABLE COMMAND [options]; TABLE is a response table in long form, or the file that a command reads."""

from __future__ import annotations

import argparse
import csv
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions import groups, names
from .operators import annotate, encoding, graph, integrate, network, predict, response, similarity
from .plans import composites, protocols
from .sources import config, files
from .sources.tables import written

#: Commands by what TABLE is, each with its arguments.
ON_RESPONSES = {
    "coverage": (), "report": (), "tuning": (), "items": (), "similar": ("item",), "channel": ("channel",), "group": ("group",), "extract": ("folder",), "encode": (), "codes": (), "predict": (),
    "contributors": ("item",), "compare": ("items",), "protocol": ("number",), "export": ("path",), "suggest": ("name",),
    "train": ("folder",), "structure": ("pathways", "mapping"), "subnetwork": ("item", "pathways", "mapping"), "recommend": ("pathways", "mapping"), "unmapped": ("mapping",),
}
ON_LABELS = {"search": ("patterns",), "classes": (), "cells": ("channels",), "map": ("mapping",), "names": ()}
ON_PATHWAYS = {"paths": ("region",), "hubs": (), "network": (), "types": (), "ladder": (), "asymmetry": (), "communities": (), "graph": ("path",), "statistics": (), "targets": ("region",)}
MANY = ("patterns", "channels", "items")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillon")
    p.add_argument("table")
    p.add_argument("--csv", help="write the result there instead of printing it")
    sub = p.add_subparsers(dest="command", required=True)
    for name, arguments in (ON_RESPONSES | ON_LABELS | ON_PATHWAYS).items():
        q = sub.add_parser(name)
        for a in arguments:
            q.add_argument(a, nargs="+" if a in MANY else None, type=int if a == "number" else None)
        q.add_argument("-n", type=int, default=10)
        if name in ON_PATHWAYS:
            q.add_argument("--preset", choices=config.PRESETS, default="default")
    return p


def on_pathways(spark: SparkSession, a: argparse.Namespace) -> DataFrame | str:
    setting = config.PRESETS[a.preset]
    rows = files.load_pathways(spark, a.table, setting)
    if a.command == "types":
        return network.type_counts(rows).orderBy("pathway_type")
    if a.command == "ladder":
        return network.threshold_ladder(rows).orderBy("threshold")
    nodes, edges = network.nodes(rows), network.edges(rows)
    if a.command == "hubs":
        return network.hubs(edges, nodes, a.n)
    if a.command == "paths":
        return network.two_hop(edges, nodes, region=a.region).orderBy(F.desc("step2"), "source", "middle", "target").limit(a.n)
    if a.command == "asymmetry":
        return graph.top_pairs(network.asymmetry(network.region_strengths(edges, nodes)), "asymmetry", a.n, then=("a", "b"))
    if a.command == "communities":
        return graph.communities(edges, setting.community_method).orderBy("community", "id")
    if a.command == "statistics":
        return sinks.statistics_report(edges, nodes, communities=setting.community_method, n=a.n)
    if a.command == "targets":
        return network.targets_by_region(network.two_hop(edges, nodes, region=a.region)).orderBy(F.desc("n_paths"), "target_region")
    if a.command == "graph":
        sinks.write_graph(nodes, edges, a.path)
        return f"{a.path}\n"
    return sinks.network_report(edges, nodes, rows, setting.hub_percentile)


def on_labels(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    labels = files.load_labels(spark, a.table)
    if a.command == "search":
        return annotate.search(labels, a.patterns).orderBy("root_id", "pattern").limit(a.n)
    if a.command == "classes":
        return annotate.classes(labels, list(annotate.CLASSES)).groupBy("class").agg(F.count("*").alias("n")).orderBy("class")
    if a.command == "names":
        return annotate.names_in(labels).orderBy(F.desc("n"), "name").limit(a.n)
    if a.command == "map":
        known = files.load_mapping(spark, [a.mapping]).select("channel").distinct()
        found = written(annotate.channel_cells(annotate.cells_of(labels, known)), "cells")
        return sinks.facts_report("Mapping", annotate.mapping_statistics(found, known).first()) + "".join(f"{r.channel}: {r.n_cells}\n" for r in found.orderBy("channel").collect())
    wanted = spark.createDataFrame([(c,) for c in a.channels], "channel string")
    return annotate.channel_cells(annotate.cells_of(labels, wanted)).orderBy("channel")


def on_responses(spark: SparkSession, a: argparse.Namespace) -> DataFrame | str:
    r = spark.read.parquet(a.table)
    name = F.col("channel").cast("string")
    if a.command == "coverage":
        return response.channel_coverage(r).orderBy(F.desc("n_tested"), "channel")
    if a.command == "report":
        return sinks.report(r)
    if a.command == "tuning":
        return response.tuning(r).orderBy("channel")
    if a.command == "similar":
        return similarity.by_correlation(r, a.item, a.n)
    if a.command == "channel":
        found = groups.lookup(r.select(name.alias("channel")).distinct(), a.channel).orderBy("channel").collect()
        if not found or found[0].kind == "suggestion":
            return f"no channel {a.channel}\n" + "".join(f"did you mean {x.channel}\n" for x in found)
        return response.head_and_tail(r.filter(name == found[0].channel), a.n).orderBy(F.desc("response"), "item")
    if a.command == "group":
        return response.channel_coverage(groups.of_group(r, a.group)).orderBy(F.desc("n_tested"), "channel")
    if a.command == "extract":
        facts = sinks.write_cache(r, r.select("item").distinct(), a.folder)
        return "".join(f"{k}: {v}\n" for k, v in facts.items() if k != "channels")
    if a.command == "export":
        sinks.write_table(r, a.path)
        return f"{a.path}\n"
    if a.command == "codes":
        return encoding.sparse_code(r, r.select("channel").distinct()).orderBy("item", "unit")
    if a.command == "encode":
        channels = [x.channel for x in r.select("channel").distinct().orderBy("channel").collect()]
        return response.encode(r, channels).withColumn("vector", F.array_join(F.col("vector").cast("array<string>"), " ")).orderBy("item")
    if a.command == "contributors":
        return predict.top_contributors(r.filter(F.col("item").cast("string") == a.item), a.n).orderBy("rank")
    if a.command == "suggest":
        return names.suggestions(spark.createDataFrame([(a.name,)], "name string"), r.select(F.lower(F.col("item").cast("string")).alias("alias")).distinct(), n=a.n)
    if a.command == "protocol":
        return protocols.to_markdown(protocols.known_protocol(r, a.number))
    if a.command == "train":
        return "".join(f"{k}: {v}\n" for k, v in composites.training_set(r, a.folder).items() if k != "channels")
    if a.command == "unmapped":
        counts = r.groupBy("channel").agg(F.count_if(F.col("response") > 0).alias("n_tested"))
        return integrate.map_coverage(counts, files.load_mapping(spark, [a.mapping])).filter("not mapped").orderBy("priority", "channel")
    if a.command in ("structure", "subnetwork", "recommend"):
        rows, mapping = written(files.load_pathways(spark, a.pathways), "pathways"), files.load_mapping(spark, [a.mapping])
        strengths = network.region_strengths(network.edges(rows), network.nodes(rows))
        matrix = strengths.select("src_region", "dst_region", F.col("strength").alias("weight"))
        if a.command == "structure":
            return composites.structure_report(composites.structure_function(r, matrix, mapping).first())
        if a.command == "recommend":
            return integrate.recommendation_totals(integrate.recommended(integrate.by_channel(matrix, mapping), r)).orderBy(F.desc("n_pairs"), "item").limit(a.n)
        active = response.activated(r.filter(F.col("item").cast("string") == a.item)).select("channel", "response")
        return integrate.subnetwork(active, integrate.by_channel(matrix, mapping)).orderBy(F.desc("weight"), "c1", "c2").limit(a.n)
    found = predict.outcomes(r, predict.weights(spark))
    if a.command == "compare":
        return predict.compared(found.withColumn("item", F.col("item").cast("string")), a.items).orderBy("place")
    if a.command == "predict":
        return found.orderBy("item")
    return response.item_coverage(r).orderBy(F.desc("n_active"), "item").limit(a.n)


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    found = (on_pathways if a.command in ON_PATHWAYS else on_labels if a.command in ON_LABELS else on_responses)(spark, a)
    if isinstance(found, str):
        print(found, end="")
    elif a.csv:
        sinks.write_table(found, a.csv)
    else:  # all rows, one partition at a time
        out = csv.writer(sys.stdout)
        out.writerow(found.columns)
        out.writerows(found.toLocalIterator())


if __name__ == "__main__":
    main()
