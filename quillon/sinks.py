"""Writers: caches, CSV and JSON tables, graph files, arrays for training, text reports.

All are written by Spark, arrays by its source `npy`; reports are text for small results.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import graph, network
from .operators import response as queries
from .operators.ranges import running
from .sources import npy
from .sources.tables import written


def write_cache(response: DataFrame, metadata: DataFrame, folder: str) -> dict:
    """The response and metadata tables as Parquet and CSV, the matrix as .npy shards (0 for missing cells), and their profile, which is returned and written as JSON."""
    response.write.mode("overwrite").parquet(f"{folder}/response")
    metadata.write.mode("overwrite").parquet(f"{folder}/metadata")
    own = response.sparkSession.read.parquet(f"{folder}/response")
    own.write.mode("overwrite").csv(f"{folder}/response_csv", header=True)
    own.select("item").distinct().write.mode("overwrite").csv(f"{folder}/items_csv", header=True)
    own.select("channel").distinct().write.mode("overwrite").csv(f"{folder}/channels_csv", header=True)
    facts = queries.profile(own).first().asDict()
    facts["channels"] = {r.channel: r.n_tested for r in queries.channel_coverage(own).collect()}
    write_training(queries.encode(own, sorted(facts["channels"])), f"{folder}/response_npy", "npy")
    facts["digest"] = table_digest(own)
    facts["created"] = datetime.now(timezone.utc).isoformat()
    own.sparkSession.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/profile")
    return facts


def table_digest(df: DataFrame) -> str:
    """16 hexadecimal digits that depend on the rows, not on their order."""
    h = F.xxhash64(*df.columns)
    sums = df.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("a"), F.sum(F.shiftrightunsigned(h, 32)).alias("b"))
    return sums.select(F.substring(F.sha2(F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in sums.columns]), 256), 1, 16)).first()[0]


def write_table(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV or Parquet, by the path's ending; quoted where needed. one_file is for small results. Other endings are an error."""
    out = (df.coalesce(1) if one_file else df).write.mode("overwrite")
    if path.endswith(".csv"):
        out.csv(path, header=True, escape='"')
    elif path.endswith(".parquet"):
        out.parquet(path)
    else:
        raise ValueError(f"{path} ends neither in .csv nor in .parquet")


def write_cells(cells: DataFrame, path: str, format: str = "json") -> None:
    """Channels with their cells: one JSON record a channel, or one CSV row a cell with the channel's count and mean place."""
    means = cells.groupBy("channel").agg(F.count("*").alias("n_cells"), *[F.avg(c).alias(f"mean_{c}") for c in "xyz"])
    if format == "json":
        roots = cells.groupBy("channel").agg(F.sort_array(F.collect_set("root_id")).alias("root_ids"))
        means.join(roots, "channel").write.mode("overwrite").json(path)
    elif format == "csv":
        cells.select("channel", "root_id").join(means, "channel").write.mode("overwrite").csv(path, header=True)
    else:
        raise ValueError(f"unknown format {format!r}; json or csv")


def graph_lines(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(value): the lines of a GraphML or GEXF file of nodes (id, ...) and edges (src, dst, ...), with all attributes, in partitions that follow each other.

    Nodes and edges are ordered as they are, and become lines after that, so that no line is shuffled.
    """
    node_columns, edge_columns = [c for c in nodes.columns if c != "id"], [c for c in edges.columns if c not in ("src", "dst")]
    escaped = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else escaped(p) for p in parts])
    of = lambda names, form: F.concat(F.lit(""), *[F.coalesce(form(i, c), F.lit("")) for i, c in enumerate(names)])
    key = lambda kind, i, c: f'<key id="{kind}{i}" for="{kind}" attr.name={quoteattr(c)} attr.type="string"/>'
    if kind == "graphml":
        datum = lambda k: lambda i, c: text(f'<data key="{k}{i}">', F.col(c), "</data>")
        node = F.concat(text('<node id="', F.col("id"), '">'), of(node_columns, datum("node")), F.lit("</node>"))
        edge = F.concat(text('<edge source="', F.col("src"), '" target="', F.col("dst"), '">'), of(edge_columns, datum("edge")), F.lit("</edge>"))
        head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *[key("node", i, c) for i, c in enumerate(node_columns)], *[key("edge", i, c) for i, c in enumerate(edge_columns)], '<graph edgedefault="directed">']
        middle, foot = [], ["</graph>", "</graphml>"]
    elif kind == "gexf":
        value = lambda i, c: text(f'<attvalue for="{i}" value="', F.col(c), '"/>')
        node = F.concat(text('<node id="', F.col("id"), '" label="', F.coalesce(F.col("label"), F.col("id")) if "label" in node_columns else F.col("id"), '"><attvalues>'), of(node_columns, value), F.lit("</attvalues></node>"))
        weight = F.coalesce(text(' weight="', F.col("weight"), '"'), F.lit("")) if "weight" in edge_columns else F.lit("")
        edge = F.concat(text('<edge id="', F.col("src"), "|", F.col("dst"), '" source="', F.col("src"), '" target="', F.col("dst"), '"'), weight, F.lit("><attvalues>"), of(edge_columns, value), F.lit("</attvalues></edge>"))
        named = lambda kind, names: [f'<attributes class="{kind}">', *[f'<attribute id="{i}" title={quoteattr(c)} type="string"/>' for i, c in enumerate(names)], "</attributes>"]
        head = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" version="1.3">', '<graph defaultedgetype="directed">', *named("node", node_columns), *named("edge", edge_columns), "<nodes>"]
        middle, foot = ["</nodes>", "<edges>"], ["</edges>", "</graph>", "</gexf>"]
    else:
        raise ValueError(f"unknown kind {kind!r}; graphml or gexf")
    fixed = lambda lines: nodes.sparkSession.range(1, numPartitions=1).select(F.explode(F.array(*map(F.lit, lines)).cast("array<string>")).alias("value"))
    rows = nodes.orderBy(F.col("id").cast("string")).select(node.alias("value"))
    links = edges.orderBy(F.concat_ws("|", "src", "dst")).select(edge.alias("value"))
    return fixed(head).union(rows).union(fixed(middle)).union(links).union(fixed(foot))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, compression: str | None = None) -> None:
    """A GraphML or GEXF file, by the path's ending: a folder of text parts, which in their order are the file; with compression gzip, of the gzipped file."""
    kind = path.rpartition(".")[2]
    if kind not in ("graphml", "gexf"):
        raise ValueError(f"{path} ends neither in .graphml nor in .gexf")
    graph_lines(nodes, edges, kind).write.mode("overwrite").text(path, compression=compression)


def write_points(points: DataFrame, path: str, format: str = "csv") -> None:
    """Points as CSV, or one JSON record for each map with its points in the order of their places."""
    if format == "csv":
        points.write.mode("overwrite").csv(path, header=True)
    elif format == "json":
        own = F.sort_array(F.collect_list(F.struct("x", "y", "z", "intensity")))
        points.groupBy("map_id").agg(F.count("*").alias("n"), own.alias("points")).write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format {format!r}; csv or json")


def write_training(vectors: DataFrame, path: str, format: str = "parquet") -> None:
    """(item, vector[, label]) for training: Parquet, or a folder of .npy shards in the order of the items, whose rows `path.items` names."""
    if format == "parquet":
        vectors.write.mode("overwrite").parquet(path)
    elif format == "npy":
        rows = running(vectors.withColumn("one", F.lit(1)), [], ["item"], "one", "row").drop("one")
        rows = written(rows, "rows")
        spark = npy.registered(vectors.sparkSession)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartitionByRange(n, "row").sortWithinPartitions("row").select("vector").write.format("npy").mode("overwrite").save(path)
        rows.drop("vector").write.mode("overwrite").parquet(f"{path}.items")
    else:
        raise ValueError(f"unknown format {format!r}; parquet or npy")


def report(response: DataFrame, n: int = 10) -> str:
    """A Markdown report on a response table, with its best covered channels."""
    p = queries.profile(response).first()
    best = queries.channel_coverage(response).orderBy(F.desc("n_tested"), "channel").limit(n).collect()
    lines = ["# Response table", "", f"- items: {p.n_items}", f"- channels: {p.n_channels}", f"- cells: {p.n_cells} ({p.sparsity_pct:.1f} % not measured)", f"- range: {p.min_response} to {p.max_response}", "", "| channel | items | % |", "|---|---|---|"]
    return "\n".join([*lines, *[f"| {r.channel} | {r.n_tested} | {r.pct:.1f} |" for r in best]]) + "\n"


def facts_report(title: str, row) -> str:
    """A Markdown list of a one-row result."""
    return "\n".join([f"# {title}", "", *[f"- {k.replace('_', ' ')}: {v}" for k, v in row.asDict().items()]]) + "\n"


def network_report(edges: DataFrame, nodes: DataFrame, pathways: DataFrame, hub_percentile: float = 90.0) -> str:
    """A Markdown report on a connection graph: its size and weights, kinds of paths, classes of nodes, hubs, and the strongest and most asymmetric pairs of regions."""
    facts = network.statistics(edges, nodes).first().asDict()
    kinds = network.type_counts(pathways).orderBy(F.desc("n"), "pathway_type").collect()
    classes = nodes.groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class").collect()
    hubs = graph.hubs(edges, nodes, percent=hub_percentile)
    best = hubs.orderBy(F.desc("score"), "id").limit(10).collect()
    strengths = network.region_strengths(edges, nodes)
    pairs = strengths.orderBy(F.desc("strength"), "src_region", "dst_region").limit(10).collect()
    uneven = graph.top_pairs(network.asymmetry(strengths), "asymmetry", 10, then=("a", "b")).collect()
    out = ["# Network", "", *[f"- {k.replace('_', ' ')}: {v}" for k, v in facts.items()], "", "## Paths", *[f"- {r.pathway_type}: {r.n}" for r in kinds], "", "## Nodes", *[f"- {r['class']}: {r.n}" for r in classes]]
    out += ["", f"## Hubs at the {hub_percentile:g} % mark: {hubs.count()}", *[f"- {r.id}: {r.score:.4f}" for r in best]]
    out += ["", "## Strongest pairs", *[f"- {r.src_region} to {r.dst_region}: {r.strength} over {r.n_paths} paths" for r in pairs]]
    return "\n".join([*out, "", "## Most asymmetric pairs", *[f"- {r.a} and {r.b}: {r.asymmetry:.3f}" for r in uneven]]) + "\n"


def statistics_report(edges: DataFrame, nodes: DataFrame, method: str = "degree", communities: str = "label_propagation", n: int = 10) -> str:
    """A Markdown report on a graph's statistics: density, clustering, components, hubs by a centrality, communities and their modularity, motifs."""
    d = graph.density(edges, nodes).first()
    c = graph.clustering(edges).agg(F.avg("coefficient").alias("mean"), F.sum("triangles").alias("t")).first()
    parts = graph.components(edges, nodes).groupBy("component").count().agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    best = graph.hubs(edges, nodes, method=method).orderBy(F.desc("score"), "id").limit(n).collect()
    of = written(graph.communities(edges, communities), "communities")
    sizes = of.groupBy("community").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "community").limit(n).collect()
    q = graph.modularity(edges, of).first().q
    shown = lambda x: "-" if x is None else f"{x:.4f}"
    out = ["# Graph statistics", "", f"- nodes: {d.n_nodes}, edges: {d.n_edges}, density: {shown(d.density)}", f"- components: {parts.n}, the largest of {parts.most} nodes", f"- mean clustering: {shown(c['mean'])}, triangles: {(c.t or 0) // 3}"]
    out += ["", f"## Hubs by {method}", *[f"- {r.id}: {r.score:.4f}" for r in best], "", f"## Communities by {communities}: modularity {shown(q)}", *[f"- {r.community}: {r['size']} nodes" for r in sizes]]
    return "\n".join([*out, "", "## Open walks by edges", *[f"- {r.n_edges}: {r.n}" for r in graph.motifs(edges).orderBy("n_edges").collect()]]) + "\n"
