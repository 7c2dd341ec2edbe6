"""Work that has to stay near the size of its input, and its results."""

import itertools
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@tables
def test_the_whole_graph_comes_from_the_lines(spark, tmp_path):
    """The same edges as from the pathways, also where a line's supplier or a customer's nation is unknown; no name is joined."""
    from quillon.plans import bindings as b

    for name in ("lineitem", "orders", "part", "nation"):
        b.table(spark, FOLDER, name).write.parquet(f"{tmp_path}/{name}.parquet")
    b.table(spark, FOLDER, "supplier").filter("s_suppkey % 3 != 0").write.parquet(f"{tmp_path}/supplier.parquet")
    b.table(spark, FOLDER, "customer").withColumn("c_nationkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey"))).write.parquet(f"{tmp_path}/customer.parquet")
    edges = b.whole_edges(spark, str(tmp_path))
    rows = b.pathways(spark, str(tmp_path)).select("source", "middle", "target", "step1", "step2")
    one, two = rows.select("source", "middle", "step1").distinct(), rows.select("middle", "target", "step2").distinct()
    want = one.union(two).union(rows.groupBy("source", "target").count())
    found = edges.select(b.node_name("src"), b.node_name("dst"), "weight")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and edges.count() > 100
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "_name" not in plan and "p_type" not in plan


def test_triangles_without_pairs_of_neighbours(spark):
    """Against brute force on random graphs with hubs, each once; layers without triangles send no list at all."""
    from quillon.operators import graph

    rng = random.Random(3)
    for n, m, hubs in ((30, 90, 2), (60, 200, 5), (5, 0, 0)):
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)} | {(h, x) for h in range(hubs) for x in range(h + 1, n)}
        code = {p: rng.randint(1, 3) for p in pairs}
        out = spark.createDataFrame([(*p, c) for p, c in code.items()], "u long, v long, code int")
        want = [(a, b, c, code[a, b], code[a, c], code[b, c]) for a, b, c in itertools.combinations(range(n), 3) if {(a, b), (a, c), (b, c)} <= pairs]
        assert sorted(map(tuple, graph.triangles(out).collect())) == want
    layers = [(u, v) for u in range(20) for v in range(20, 40)] + [(u, v) for u in range(20, 40) for v in range(40, 60)]
    edges = spark.createDataFrame([(f"n{u}", f"n{v}") for u, v in layers], "src string, dst string")
    size, out = graph.numbered(graph.undirected(edges).withColumn("code", F.lit(0)))
    assert size.count() == 60 and out.filter("u >= v").isEmpty() and out.count() == len(layers)
    assert {r.triangles for r in graph.clustering(edges).collect()} == {0}


def test_components_shrink_their_edges(spark, monkeypatch):
    """Chains, and a dense graph whose edges are read in full once: after a round only edges between trees are left."""
    from quillon.operators import graph

    sizes, keep = [], graph.written

    def counted(df, name):
        found = keep(df, name)
        sizes.append((name, found.count()))
        return found

    monkeypatch.setattr(graph, "written", counted)
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(40)]
    dense = [tuple(rng.sample(range(100, 160), 2)) for _ in range(900)]
    edges = spark.createDataFrame(chain + dense, "src long, dst long")
    found = {r.id: r.component for r in graph.components(edges).collect()}
    assert {found[i] for i in range(41)} == {0} and {v for k, v in found.items() if k > 99} == {min(k for k in found if k > 99)}
    left = [n for name, n in sizes if name == "left"]
    assert left[0] > 500 and all(n < left[0] / 4 for n in left[1:])


def test_rank_sum_with_more_ties_than_a_long_holds(spark):
    """Three million equal values: t ** 3 - t is beyond a long."""
    from quillon.operators import statistics

    rows = spark.range(3_000_000).select(F.lit(1.0).alias("v"), (F.col("id") % 3 == 0).alias("g"))
    found = statistics.mann_whitney(rows, "v", F.col("g")).first()
    assert found.ties == 3_000_000**3 - 3_000_000 and (found.n1, found.n2, found.u, found.p) == (1_000_000, 2_000_000, 1e12, 1.0)


def test_similar_pearson_and_its_sql_agree_on_constants_and_zeros(spark, tmp_path):
    """A side whose means are equal but for the last bit is constant; a correlation of zero has no sign."""
    import duckdb

    from quillon.plans import catalogue

    lines = {3: [[0.01], [0.05], [0.05], [0.01]], 4: [[0.05], [0.05, 0.05, 0.05], [0.01, 0.09], [0.04, 0.05, 0.06]], 5: [[0.02], [0.02], [0.07], [0.07]], 6: [[0.01], [0.02], [0.03], [0.05]]}
    rows = [(c, p, x) for c, parts in lines.items() for p, xs in enumerate(parts) for x in xs]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(c, c) for c in lines], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(p, f"B{p}") for p in range(4)], "p_partkey long, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = {r.item: (str(r.similarity), r.n_shared) for r in catalogue.QUERIES["similar_pearson"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert found == {i: (str(s), n) for i, s, n in con.execute(catalogue.ORACLES["similar_pearson"]).fetchall()}
    assert 4 not in found and found[5] == ("0.0", 4) and found.keys() == {5, 6}


@pytest.mark.parametrize("block", [4096, 16])
def test_nearest_items_in_blocks(spark, block):
    """Against every pair, with missing responses, copies, constant items and items that share one channel."""
    from quillon.operators import similarity

    rng = random.Random(9)
    own = {i: {c: rng.random() for c in range(8) if rng.random() < 0.8} for i in range(50)}
    own |= {50: {c: 0.1 for c in range(8)}, 51: dict(own[3]), 52: dict(own[3]), 53: {0: 1.0, 1: 1e6, 2: 1e6, 3: 1e6}, 54: {7: 2.0}}
    rows = [(f"i{i:02d}", c, x) for i, xs in own.items() for c, x in xs.items()]
    table = spark.createDataFrame(rows, "item string, channel int, response double")
    asked = table.select("item").distinct().filter("item in ('i00', 'i03', 'i17', 'i50', 'i53')")
    found = {}
    for r in similarity.nearest_of_each(table, asked, 4, block).collect():
        found.setdefault(r.query, set()).add((r.item, round(r.similarity, 9)))
    for q in ("i00", "i03", "i17", "i50", "i53"):
        scores = similarity.by_correlation(table, q, 4).collect()
        want = {round(r.similarity, 9) for r in scores}
        assert {s for _, s in found.get(q, set())} == want and len(found.get(q, ())) == len(scores)


def test_betweenness_goes_back_along_the_paths_alone(spark, monkeypatch):
    """One source with a path to a node that many others lead to: the way back has a row for each edge of its paths, not for each edge into the node."""
    from quillon.operators import graph

    rows, plain = {}, graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: rows.setdefault(name, []).append(out := plain(df, name)) or out)
    edges = spark.createDataFrame([("s", "m"), ("m", "t")] + [(f"x{i}", "t") for i in range(500)], "src string, dst string")
    nodes = graph.vertices(edges)
    found = {r.id: r.score for r in graph.betweenness(edges, nodes, nodes.filter("id = 's'")).collect()}
    assert found["m"] == pytest.approx(1 / (502 * 501)) and sum(found.values()) == found["m"] and len(found) == 503
    assert sum(t.count() for t in rows["links"]) == 2


@tables
def test_connections_read_the_lines_once(spark, tmp_path):
    """Pathways, the nations' graph and both hops: one scan of the lines each, nodes as numbers; weights and nodes as from the pathways, also where a customer or supplier is unknown."""
    from quillon.operators import network
    from quillon.plans import bindings as b

    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet [l_orderkey")
    assert scans(b.pathways(spark, FOLDER)) == 1 and scans(b.regions(spark, FOLDER)) == 0
    for name in ("lineitem", "orders", "part", "nation"):
        b.table(spark, FOLDER, name).write.parquet(f"{tmp_path}/{name}.parquet")
    b.table(spark, FOLDER, "supplier").filter("s_suppkey % 3 != 0").write.parquet(f"{tmp_path}/supplier.parquet")
    b.table(spark, FOLDER, "customer").filter("c_custkey % 5 != 0").write.parquet(f"{tmp_path}/customer.parquet")
    d = str(tmp_path)
    rows = b.pathways(spark, d).persist()
    steps = b.steps(spark, d)
    assert dict(steps.dtypes)["src"] == "bigint"
    got = lambda df: sorted(map(str, df.collect()))
    assert got(b.named(steps)) == got(network.edges(rows).select("src", "dst", "weight", "step"))
    assert got(b.step_nodes(spark, d, steps).withColumn("id", b.node_name("id"))) == got(network.nodes(rows))
    source, middle, target = b.sides(spark, d)
    every, (one, two) = source.unionByName(middle).unionByName(target), b.hops(spark, d)
    assert got(network.region_strengths(one, every, two)) == got(network.region_strengths(network.edges(rows), network.nodes(rows)))
    rows.unpersist()


def test_graph_files_shuffle_no_line(spark, tmp_path):
    """Head, nodes, middle, edges and foot in this order, each sorted by name over several parts; only nodes and edges are dealt, not their lines."""
    from quillon import sinks

    nodes = spark.createDataFrame([(f"n{i}", "x") for i in range(300)], "id string, class string").repartition(7)
    edges = spark.createDataFrame([(f"n{i}", f"n{i * j % 300}", j) for i in range(300) for j in range(1, 9)], "src string, dst string, weight long").repartition(7)
    for kind in ("graphml", "gexf"):
        lines = sinks.graph_lines(nodes, edges, kind)
        plan = lines._jdf.queryExecution().optimizedPlan().toString()
        assert all("value" not in x for x in plan.splitlines() if "Sort " in x)
        for how in (None, "gzip"):
            path = f"{tmp_path}/{how}.{kind}"
            sinks.write_graph(nodes, edges, path, how)
            found = [x.value for f in sorted(os.listdir(path)) if f.startswith("part") for x in spark.read.text(f"{path}/{f}").collect()]
            at = [i for i, x in enumerate(found) if x.startswith("<node ")], [i for i, x in enumerate(found) if x.startswith("<edge ")]
            assert [len(x) for x in at] == [300, 2400] and at[0] == list(range(at[0][0], at[0][0] + 300)) and at[1] == list(range(at[1][0], at[1][0] + 2400)) and at[0][-1] < at[1][0]
            ends = [x.split('"')[1] for x in found if x.startswith("<node ")]
            assert ends == sorted(ends) and found[0].startswith("<?xml") and found[-1] in ("</graphml>", "</gexf>")


def test_label_propagation_reads_the_edges_of_a_half(spark, monkeypatch):
    """Each edge is kept once for the node that it tells, in the half that moves."""
    from quillon.operators import graph

    rows, plain = {}, graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: rows.setdefault(name, []).append(out := plain(df, name)) or out)
    edges = spark.createDataFrame([(f"n{i}", f"n{j}") for k in (0, 10) for i in range(k, k + 5) for j in range(i + 1, k + 5)], "src string, dst string")
    found = {r.id: r.community for r in graph.label_propagation(edges).collect()}
    assert len(found) == 10 and len({found[f"n{i}"] for i in range(5)}) == 1 and len(set(found.values())) == 2 and set(found.values()) <= set(found)
    assert sum(t.count() for t in rows["half"]) == 40


def test_closeness_sends_a_sketch_to_a_block_not_along_each_edge(spark, monkeypatch):
    """60 hubs with 50 edges in each from 300 nodes, of several blocks: each node has a row for each block of its neighbours; scores against the exact ones."""
    from quillon.operators import graph

    rows, plain = {}, graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: rows.setdefault(name, []).append(out := plain(df, name)) or out)
    rng = random.Random(4)
    e = sorted({(1000 + i, h) for h in range(60) for i in rng.sample(range(300), 50)} | {(h, h + 1) for h in range(0, 59, 7)})
    edges = spark.createDataFrame(e, "src long, dst long")
    nodes = graph.vertices(edges)
    found = {r.id: (r.r, r.s) for r in graph.reached(edges, nodes, crowd=20).collect()}
    assert sum(t.count() for t in rows["routes"]) <= 5 * 309 < 0.6 * len(e)
    exact = graph.distances(edges).filter("dist > 0").groupBy("node").agg(F.count("*").alias("r"), F.sum("dist").alias("s")).collect()
    assert {k: v for k, v in found.items() if v[0]} == {r.node: (r.r, r.s) for r in exact} and len(found) == nodes.count()


def test_greedy_keeps_each_pair_once(spark, monkeypatch):
    """A round keeps a row for each pair of communities, not one for each order."""
    from quillon.operators import graph

    rows, plain = {}, graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: rows.setdefault(name, []).append(out := plain(df, name)) or out)
    edges = spark.createDataFrame([(i, j) for k in (0, 10) for i in range(k, k + 5) for j in range(i + 1, k + 5)], "src long, dst long")
    found = {r.id: r.community for r in graph.greedy_communities(edges).collect()}
    assert len({found[i] for i in range(5)}) == 1 and len(set(found.values())) == 2
    assert rows["around"][0].count() == 20


def test_numbers_in_the_order_of_names(spark):
    """Nodes' numbers by name sort as their names do, and tell them; keys that they can't hold are an error."""
    from quillon.plans import bindings as b

    keys = [0, 1, 2, 9, 10, 11, 19, 20, 99, 100, 101, 110, 1000, 123456789, 10**15, 10**16 - 1]
    nodes = spark.createDataFrame([(k * 4 + kind,) for k in keys for kind in range(3)], "id long")
    found = nodes.select(b.node_name("id").alias("name"), b.by_name(F.col("id")).alias("n")).withColumn("back", b.from_by_name(F.col("n"))).collect()
    assert all(r.name == r.back for r in found)
    assert [r.name for r in sorted(found, key=lambda r: r.n)] == sorted(r.name for r in found)
    for k in (-1, 10**16):
        with pytest.raises(Exception, match="no number by name"):
            spark.createDataFrame([(k * 4,)], "id long").select(b.by_name(F.col("id"))).collect()


@tables
def test_numbers_of_rows_in_a_new_session(tmp_path):
    """In a new session, whose plans count their columns from 0, shards of .npy are written; over 12 partitions."""
    code = """
import sys
from pyspark.sql import SparkSession, functions as F
from quillon.plans import catalogue
conf = {"spark.master": "local[2]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "12", "spark.checkpoint.dir": "file://" + sys.argv[2]}
s = SparkSession.builder.config(map=conf).getOrCreate()
r = catalogue.QUERIES["npy_shards"](s, sys.argv[1]).agg(F.count("*"), F.countDistinct("row"), F.max("row")).first()
assert tuple(r) == (32000, 500, 499), r
"""
    done = subprocess.run([sys.executable, "-c", code, FOLDER, str(tmp_path)], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=300)
    assert not done.returncode, done.stderr[-2000:]


def test_ranges_infer_nothing_about_the_other_side(spark):
    """A range's number is no filter on either side of the join with the sums of the ranges."""
    from quillon.operators import ranges

    rows = spark.range(1000).select("id", F.lit(1).alias("one"))
    for df in (ranges.running(rows, [], ["id"], "one"), ranges.running(rows, ["one"], ["id"], "one"), ranges.cumulated(rows, "id")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "aggregate(" in plan and not [x for x in plan.splitlines() if "Filter" in x and "aggregate(" in x]
        assert df.agg(F.count("*")).first()[0] == 1000


@tables
def test_nearest_items_of_every_item(spark):
    """As many items as the table has are asked for, and the results are those of the SQL, which has no cut either."""
    import duckdb

    from quillon.plans import catalogue

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{FOLDER}/embeddings.parquet')")
    want = con.execute(catalogue.ORACLES["nearest_items"]).fetchall()
    found = [tuple(r) for r in catalogue.QUERIES["nearest_items"](spark, FOLDER).collect()]
    assert sorted(found) == sorted(want) and {q for q, _, _ in found} == {x for (x,) in con.execute("SELECT vec_id FROM embeddings").fetchall()}


def test_nearest_items_among_copies_and_unsure_scores(spark):
    """Copies, scaled copies, constant items, gaps, and items whose spread is far below their size: against every pair."""
    from quillon.operators import similarity

    rng = random.Random(4)
    own = {i: [rng.random() for _ in range(6)] for i in range(40)}
    own |= {i: own[0] for i in range(40, 60)} | {i: [2 * x for x in own[0]] for i in range(60, 64)} | {64: [0.1] * 6, 65: [0.1] * 6, 66: [1e6, 1, 2, 3, 4, 5], 67: [1e6, 2, 3, 5, 4, 6]}
    for gaps in (False, True):
        rows = [(i, c, float(x)) for i, xs in own.items() for c, x in enumerate(xs) if not gaps or (i + c) % 7]
        table = spark.createDataFrame(rows, "item long, channel int, response double")
        found = {}
        for r in similarity.nearest_of_each(table, k=3, block=16).collect():
            found.setdefault(r.query, []).append((-round(r.similarity, 9), r.item))
        assert found.keys() == own.keys() - {64, 65}
        for q in (0, 5, 41, 61, 66):
            want = sorted((-round(r.similarity, 9), r.item) for r in similarity.by_correlation(table, q, None).collect())[:3]
            assert [s for s, _ in sorted(found[q])] == [s for s, _ in want] and (gaps or q > 59 or sorted(found[q]) == want)


def test_closeness_in_slices_of_registers(spark):
    """Sketches in 8 slices tell what whole ones do, for small and large sets; no sketch of an earlier round or slice is left on the disk, and no shuffle file."""
    from quillon.operators import graph
    from quillon.sources.tables import shared_folder

    r = random.Random(2)
    e = {(i, 2000 + r.randrange(60)) for i in range(1500) for _ in range(2)} | {(2000 + i, 3000 + r.randrange(15)) for i in range(60) for _ in range(4)} | {(3000, 2000)}
    edges = spark.createDataFrame(sorted(e), "src long, dst long")
    nodes, folder = graph.vertices(edges), shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    found = {x.id: (x.r, x.s) for x in graph.reached(edges, nodes, room=(len({b for _, b in e}) * 4096 - 1).bit_length() - 3).collect()}
    new = [x for x in os.listdir(folder) if x not in before]
    assert not [x for x in new if x.startswith("sketches")] and len([x for x in new if x.startswith("grown")]) == 8
    whole = {x.id: (x.r, x.s) for x in graph.reached(edges, nodes).collect()}
    assert found.keys() == whole.keys()
    for k, (n, s) in whole.items():  # up to a few hundred are counted by either, between by one of them
        assert found[k] == (n, s) if n < 200 else found[k] == pytest.approx((n, s), rel=0.08) and (n < 700 or found[k][0] == pytest.approx(n, rel=1e-9))
    assert any(x[0] > 700 for x in whole.values()) and any(0 < x[0] < 200 for x in whole.values())


def test_label_propagation_in_blocks(spark, monkeypatch):
    """Against the rule on dictionaries, over many blocks and for names; a round sends a label once to each block of neighbours, not along each edge."""
    from quillon.operators import graph

    rng = random.Random(6)
    weight = {}
    for _ in range(400):
        a, b = rng.sample(range(60), 2)
        weight[a, b] = weight.get((a, b), 0) + rng.randint(1, 9)
    rows = [(f"n{a}", f"n{b}", w) for (a, b), w in weight.items()] + [("alone", "alone", 1)]
    edges = spark.createDataFrame(rows, "src string, dst string, weight long")
    near, half = {}, {r.id: r.h for r in graph.vertices(edges).select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("h")).collect()}
    for a, b, w in rows[:-1]:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {})[y] = near.get(x, {}).get(y, 0) + w
    want = {x: x for x in half}
    for k in range(20):
        new = dict(want)
        for x in near:
            if half[x] == k % 2:
                sums = {}
                for y, w in near[x].items():
                    sums[want[y]] = sums.get(want[y], 0) + w
                new[x] = min(sums, key=lambda c: (-sums[c], c))
        still, want = new == want, new
        if k % 2 and still:
            break
    plain, sent = graph.written, {}
    monkeypatch.setattr(graph, "written", lambda df, name: sent.setdefault(name, []).append(out := plain(df, name)) or out)
    for block in (1 << 20, 40):
        sent.clear()
        assert {r.id: r.community for r in graph.label_propagation(edges, block=block).collect()} == want
    monkeypatch.undo()
    # 200 nodes that all lead to the same 20: a head for each node and block, of 8,000 edges
    star = spark.range(4000).selectExpr("id div 20 as src", "1000 + id % 20 as dst")
    monkeypatch.setattr(graph, "written", lambda df, name: sent.setdefault(name, []).append(out := plain(df, name)) or out)
    sent.clear()
    graph.label_propagation(star, rounds=1).collect()
    heads, links = (sum(t.filter(f"part = {p}").agg(F.sum(x)).first()[0] for t in sent["packs"]) for p, x in ((1, F.lit(1)), (2, F.length("links") / 16)))
    assert links == 8000 and heads <= 2 * 220


def test_greedy_keeps_the_tables_of_one_round(spark):
    """Many rounds on a chain of cliques: of the rounds before, only the first pairs are left on the disk."""
    from quillon.operators import graph
    from quillon.sources.tables import shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    edges = spark.createDataFrame([(i, j) for k in range(0, 40, 5) for i in range(k, k + 5) for j in range(i + 1, k + 5)] + [(k, k + 5) for k in range(0, 35, 5)], "src long, dst long")
    assert len({r.community for r in graph.greedy_communities(edges).collect()}) > 1
    left = [x.partition("-")[0] for x in os.listdir(folder) if x not in before]
    assert all(left.count(x) <= n for x, n in {"around": 2, "degree": 1, "communities": 1, "asks": 1, "roots": 0, "into": 0}.items()), left


def test_clustering_sends_numbers_alone(spark, monkeypatch):
    """Lists of neighbours as short numbers without codes, and the written edges go once the lists are there; counts against brute force."""
    from quillon.operators import graph
    from quillon.sources.tables import shared_folder

    kept, plain = {}, graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: kept.setdefault(name, out := plain(df, name)) and out)
    rng = random.Random(8)
    pairs = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(120)}
    found = {r.id: r.triangles for r in graph.clustering(spark.createDataFrame(sorted(pairs), "src long, dst long")).collect()}
    want = dict.fromkeys(found, 0)
    for t in itertools.combinations(range(25), 3):
        if {(t[0], t[1]), (t[0], t[2]), (t[1], t[2])} <= pairs:
            want.update({x: want[x] + 1 for x in t})
    assert found == want and any(want.values())
    assert dict(kept["lists"].dtypes)["near"] == "array<int>" and "codes" not in kept["lists"].columns
    assert not os.path.exists(kept["out"].written_at.removeprefix("file://")) and os.path.isdir(shared_folder(spark).removeprefix("file://"))
