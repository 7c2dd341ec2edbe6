"""The five-row connection table, against values worked out by hand, and graph algorithms against brute force."""

import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quillon import sinks
from quillon.operators import graph, integrate, network
from quillon.schemas import PATHWAY_NAMES
from quillon.sources import config, files

ROWS = """orn1,Or7a,ORN_DL5,ln1,lLN2F_a,Local_Neuron,orn2,Or47b,ORN,15,25
orn1,Or7a,ORN_DL5,ln2,lLN2P_b,Local_Neuron,orn3,Or69a,ORN,20,30
orn2,Or47b,ORN_VA1v,ln1,lLN2F_a,Local_Neuron,orn3,Or69a,ORN,12,15
orn2,Or47b,ORN_VA1v,pn1,VA1v_vPN,Projection_Neuron,ln1,lLN2F_a,Local_Neuron,18,22
orn3,Or69a,ORN_D,ln3,lLN1_bc,Local_Neuron,pn1,VA1v_vPN,Projection_Neuron,8,10
"""


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    at = tmp_path_factory.mktemp("in") / "paths.csv"
    at.write_text(",".join(PATHWAY_NAMES) + "\n" + ROWS)
    return str(at)


@pytest.fixture(scope="module")
def parts(spark, path):
    rows = files.load_pathways(spark, path)
    return rows, network.nodes(rows), network.edges(rows)


def test_nodes_and_edges(parts):
    _, nodes, edges = parts
    assert {r["class"]: r["count"] for r in nodes.groupBy("class").count().collect()} == {"ORN": 3, "Local_Neuron": 3, "Projection_Neuron": 1}
    assert network.region_nodes(nodes).count() == 3 and edges.count() == 10
    hubs = network.hubs(edges, nodes).collect()
    assert (hubs[0].id, hubs[0].degree) == ("ln1", 5)
    s = network.statistics(edges, nodes).first()
    assert (s.n_nodes, s.n_edges) == (7, 10)


def test_types_and_filters(parts):
    rows, _, _ = parts
    assert {r.pathway_type: r.n for r in network.type_counts(rows).collect()} == {"lateral_inhibition": 3, "inhibitory_to_relay": 1, "relay_feedback": 1}
    assert network.by_strength(rows, 20).count() == 3 and network.by_strength(rows, 1000).count() == 0 and network.by_strength(rows, 1, 15).count() == 2
    assert network.by_types(rows, lateral=False).count() == 2 and network.by_types(rows, relay=False).count() == 4
    assert network.by_types(rows.withColumn("middle_class", F.lit(None).cast("string")), False, False, False).count() == 5
    with pytest.raises(ValueError):
        network.by_strength(rows, 0)
    assert network.of_source(rows, "ORN_DL5").count() == 2 and network.of_source(rows, source="orn3").count() == 1
    assert network.summary(rows).first().median == 22


def test_paths(parts):
    rows, nodes, edges = parts
    count = lambda **k: network.two_hop(edges, nodes, **k).count()
    assert [count(region=r) for r in ("ORN_DL5", "ORN_VA1v", "ORN_D")] == [3, 3, 1]
    both = network.two_hop(edges, nodes, region="ORN_DL5", to_region="ORN_D")
    assert both.count() == 2 and both.agg(F.sum("step2")).first()[0] == 45
    graph_ = {(r.src, r.dst): r.weight for r in network.region_graph(rows, nodes).collect()}
    assert graph_ == {("ORN_DL5", "ORN_VA1v"): 25, ("ORN_DL5", "ORN_D"): 30, ("ORN_VA1v", "ORN_D"): 15}
    strengths = network.region_strengths(edges, nodes)
    c = network.compare(strengths, "ORN_DL5", "ORN_VA1v").first()
    assert (c.n12, c.n21, c.asymmetry, c.count_ratio, c.strength_ratio) == (1, 0, 1.0, 1.0, 25.0)
    pairs = {(r.a, r.b): (r.forward, r.backward, r.asymmetry) for r in network.asymmetry(strengths).collect()}
    assert len(pairs) == 6 and pairs["ORN_DL5", "ORN_D"] == (45, 0, 1.0) and pairs["ORN_D", "ORN_DL5"] == (0, 45, -1.0)
    empty = network.search_statistics(network.two_hop(edges, nodes, region="nowhere")).first()
    assert (empty.n_paths, empty.total, empty.shortest) == (0, 0, 0)
    assert graph.density(network.region_graph(rows, nodes), network.region_nodes(nodes)).first().density == 0.5


def test_hubs_of_a_class_use_its_own_edges(parts):
    _, nodes, edges = parts
    assert {r.score for r in graph.hubs(edges, nodes, "Local_Neuron").collect()} == {0.0}
    with pytest.raises(ValueError):
        graph.centrality(edges, nodes, "other")


def test_matrix_by_channel(spark):
    m = spark.createDataFrame([("ORN_A", "ORN_B", 5), ("ORN_B", "ORN_A", 3)], "src_region string, dst_region string, weight long")
    names = spark.createDataFrame([("Or1a", "ORN_A", 1), ("Or2a", "ORN_B", 2)], "channel string, region string, row_ord long")
    assert {(r.c1, r.c2): r.weight for r in integrate.by_channel(m, names).collect()} == {("Or1a", "Or2a"): 5, ("Or2a", "Or1a"): 3}
    assert integrate.dense(integrate.by_channel(m, names), ["Or1a", "Or2a"]).count() == 4
    with pytest.raises(ValueError):
        integrate.by_channel(m, names.limit(0))


def random_edges(spark, n=14, m=40, seed=3):
    r = random.Random(seed)
    e = sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})
    return [x for x in e if x[0] != x[1]], spark.createDataFrame([(a, b, 1.0) for a, b in e if a != b], "src long, dst long, weight double")


def brute_distances(e):
    nodes = sorted({x for p in e for x in p})
    out = {}
    for s in nodes:
        dist, ring = {s: 0}, [s]
        while ring:
            ring = [b for a in ring for x, b in e if x == a and b not in dist and not dist.__setitem__(b, dist[a] + 1)]
        out |= {(s, v): d for v, d in dist.items()}
    return nodes, out


def test_distances_and_paths(spark):
    e, edges = random_edges(spark)
    nodes, dist = brute_distances(e)
    assert {(r.src, r.node): r.dist for r in graph.distances(edges).collect()} == dist
    s, t = max(dist, key=dist.get)
    found = [list(r.path) for r in graph.shortest_paths(edges, s, t).collect()]
    every = [p for p in itertools.product(nodes, repeat=dist[s, t] + 1) if p[0] == s and p[-1] == t and all(x in e for x in itertools.pairwise(p))] if dist[s, t] < 5 else None
    assert found and all(len(p) == dist[s, t] + 1 for p in found) and (every is None or sorted(map(tuple, found)) == sorted(every))
    assert graph.shortest_paths(edges, 0, 999).count() == 0


def test_centralities(spark):
    e, edges = random_edges(spark)
    nodes, dist = brute_distances(e)
    n = len(nodes)
    table = graph.vertices(edges)
    close = {r.id: r.score for r in graph.closeness(edges, table).collect()}
    for v in nodes:
        own = [d for (s, x), d in dist.items() if x == v and d]
        assert close[v] == pytest.approx(len(own) / sum(own) * len(own) / (n - 1) if own else 0)
    count = {}

    def paths(s, t):
        if (s, t) not in count:
            count[s, t] = 1 if s == t else sum(paths(s, x) for x, y in e if y == t and dist.get((s, x), 99) == dist[s, t] - 1)
        return count[s, t]

    want = dict.fromkeys(nodes, 0.0)
    for (s, t), d in dist.items():
        for v in nodes:
            if v not in (s, t) and dist.get((s, v), 99) + dist.get((v, t), 99) == d:
                want[v] += paths(s, v) * paths(v, t) / paths(s, t)
    between = {r.id: r.score for r in graph.betweenness(edges, table).collect()}
    assert between == pytest.approx({v: x / ((n - 1) * (n - 2)) for v, x in want.items()})
    estimate = {r.id: r.score for r in graph.closeness_estimate(edges, table).collect()}
    assert estimate == pytest.approx(close)  # sets of a few nodes are counted exactly
    x = {r.id: r.score for r in graph.eigenvector(edges, table).collect()}
    assert sum(v * v for v in x.values()) == pytest.approx(1, abs=1e-6)


def test_undirected(spark):
    e, edges = random_edges(spark, 20, 30, 8)
    pairs = {tuple(sorted(x)) for x in e}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {v: sum(1 for a, b in itertools.combinations(sorted(o), 2) if (a, b) in pairs) for v, o in near.items()}
    found = {r.id: (r.degree, r.triangles, r.coefficient) for r in graph.clustering(edges).collect()}
    assert found == {v: (len(o), want[v], pytest.approx(2 * want[v] / (len(o) * (len(o) - 1)) if len(o) > 1 else 0.0)) for v, o in near.items()}
    root = {v: v for v in near}
    for _ in near:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.id: r.component for r in graph.components(edges).collect()} == root


def test_communities(spark):
    two = [(a, b, 1.0) for k in (0, 10) for a, b in itertools.combinations(range(k, k + 5), 2)] + [(0, 10, 1.0)]
    edges = spark.createDataFrame(two, "src long, dst long, weight double")
    for found in (graph.greedy_communities(edges), graph.label_propagation(edges)):
        of = {r.id: r.community for r in found.collect()}
        assert len({of[i] for i in range(5)}) == 1 and len(set(of.values())) == 2
    assert graph.modularity(edges, graph.greedy_communities(edges)).first().q == pytest.approx(20 / 21 - 0.5)


def test_closeness_estimate_on_large_sets(spark):
    """Three layers of 1,500 nodes: sets of thousands, against exact counts."""
    r = random.Random(2)
    e = {(i, 2000 + r.randrange(60)) for i in range(1500) for _ in range(2)} | {(2000 + i, 3000 + r.randrange(15)) for i in range(60) for _ in range(4)}
    edges = spark.createDataFrame(sorted(e), "src long, dst long")
    table = graph.vertices(edges)
    exact = {x.id: x.score for x in graph.closeness(edges, table).collect()}
    for x in graph.closeness_estimate(edges, table).collect():
        assert x.score == pytest.approx(exact[x.id], rel=0.08)


def brute_greedy(e):
    """The rule of greedy_communities, on dictionaries."""
    w, k, of = {}, {}, {}
    for a, b, x in e:
        if a != b:
            w[a, b] = w.get((a, b), 0) + x
            w[b, a] = w.get((b, a), 0) + x
            for v in (a, b):
                k[v] = k.get(v, 0) + x
                of[v] = v
    m2 = sum(k.values())
    while True:
        gains = {p: x * m2 - k[p[0]] * k[p[1]] for p, x in w.items()}
        best = {}
        for (a, b), g in sorted(gains.items()):
            if g > 0 and (a not in best or g > gains[a, best[a]]):
                best[a] = b
        if not best:
            return of
        roots = {b for a, b in best.items() if best.get(b) == a and (k[b] > k[a] or (k[b] == k[a] and b < a))}
        into = {}
        for root in roots:
            ahead = 0
            for a in sorted((a for a, b in best.items() if b == root and a not in roots), key=lambda a: (-gains[a, root], a)):
                if w[a, root] * m2 > k[a] * (k[root] + ahead):
                    into[a] = root
                ahead += k[a]
        of = {v: into.get(c, c) for v, c in of.items()}
        new_w, new_k = {}, {}
        for (a, b), x in w.items():
            a, b = into.get(a, a), into.get(b, b)
            if a != b:
                new_w[a, b] = new_w.get((a, b), 0) + x
        for v, x in k.items():
            new_k[into.get(v, v)] = new_k.get(into.get(v, v), 0) + x
        w, k = new_w, new_k


def quality(e, of):
    m2, own, degree = 0, {}, {}
    for a, b, x in e:
        m2 += 2 * x
        own[of[a]] = own.get(of[a], 0) + (2 * x if of[a] == of[b] else 0)
        for v in (a, b):
            degree[of[v]] = degree.get(of[v], 0) + x
    return sum(own.get(c, 0) / m2 - (d / m2) ** 2 for c, d in degree.items())


def test_greedy_merging(spark):
    """Against the same rule by hand; about as good as merging the best pair at a time; hubs with many leaves take few rounds."""
    r = random.Random(8)
    for n, m in ((25, 60), (40, 70)):
        e = sorted({(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a < b})
        e = [(a, b, r.randrange(1, 5)) for a, b in e] + [(100 + i, j, 1) for i in range(20) for j in (0,)]
        found = {x.id: x.community for x in graph.greedy_communities(spark.createDataFrame(e, "src long, dst long, weight long")).collect()}
        assert found == brute_greedy(e)
        one = {v: v for x in e for v in x[:2]}
        while True:  # the best pair at a time
            pairs = {tuple(sorted((one[a], one[b]))) for a, b, _ in e if one[a] != one[b]}
            best = max(((quality(e, {v: (p[0] if c == p[1] else c) for v, c in one.items()}), p) for p in pairs), default=None)
            if not best or best[0] <= quality(e, one):
                break
            one = {v: (best[1][0] if c == best[1][1] else c) for v, c in one.items()}
        assert quality(e, found) >= 0.9 * quality(e, one)


def test_motifs(spark):
    r = random.Random(6)
    e = {(a, b) for a, b in ((r.randrange(14), r.randrange(14)) for _ in range(70)) if a != b}
    want = {}
    for a, b in e:
        for x, c in e:
            if x == b and c != a and (a, c) not in e:
                k = 2 + ((b, a) in e) + ((c, b) in e) + ((c, a) in e)
                want[k] = want.get(k, 0) + 1
    edges = spark.createDataFrame([*sorted(e), (3, 3)], "src long, dst long")
    assert {x.n_edges: x.n for x in graph.motifs(edges).collect()} == want
    assert graph.motifs(edges.limit(0)).count() == 0


def test_files(spark, path, tmp_path):
    with pytest.warns(UserWarning):
        rows = files.load_pathway_files(spark, {"a": path, "b": str(tmp_path / "none.csv")}, config.PRESETS["strong"])
    assert {r.pathway_type for r in rows.collect()} == {"a"} and rows.count() == 5
    with pytest.raises(ValueError), pytest.warns(UserWarning):
        files.load_pathway_files(spark, {"b": str(tmp_path / "none.csv")})
    (tmp_path / "bad.csv").write_text("orn_root_id\n1\n")
    with pytest.raises(ValueError):
        files.load_pathways(spark, str(tmp_path / "bad.csv"))
    c = config.NetworkConfig.from_json('{"min_synapses": 4, "colour": "red"}')
    assert c.min_synapses == 4 and c.extra == {"colour": "red"} and config.NetworkConfig.from_json(c.to_json()) == c
    with pytest.raises(ValueError):
        config.NetworkConfig(min_synapses=0)
    assert config.synapse("LN")["effect"] == "inhibitory" and config.parameters(spark).count() == 3
    (tmp_path / "m.csv").write_text("source_glom,target_glom,synapse_count_step2\na,b,3\na,,4\n")
    assert files.load_region_matrix(spark, str(tmp_path / "m.csv")).count() == 1
    (tmp_path / "map.csv").write_text("name,place,notes\nOr1a,ORN_A,x\nOr2a,ORN_B,\n")
    names = files.load_mapping(spark, [str(tmp_path / "none.csv"), str(tmp_path / "map.csv")])
    assert {(r.channel, r.region) for r in names.collect()} == {("Or1a", "ORN_A"), ("Or2a", "ORN_B")}
    (tmp_path / "names.csv").write_text("common_name,inchikey,alternative_names\nCO2,K1,\"carbon dioxide,dry ice\"\n,K2,\n")
    aliases = files.load_aliases(spark, [str(tmp_path / "names.csv")])
    assert {r.key: (r["name"], r.synonyms) for r in aliases.collect()} == {"K1": ("CO2", "carbon dioxide;dry ice"), "K2": ("K2", "")}
    assert files.missing_files(spark, str(tmp_path), {"m": "m.csv", "n": "n.csv"}) == {"m": True, "n": False}


def test_graph_files(parts, tmp_path):
    import xml.etree.ElementTree as tree

    _, nodes, edges = parts
    for name, n in (("g.graphml", 10), ("g.gexf", 10)):
        sinks.write_graph(nodes, edges, str(tmp_path / name))
        root = tree.fromstring("".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*"))))
        assert sum(x.tag.endswith("}edge") for x in root.iter()) == n
    with pytest.raises(ValueError):
        sinks.write_graph(nodes, edges, "g.txt")
    assert json.loads(config.PRESETS["strong"].to_json())["min_synapses"] == 10


def test_bindings_are_what_the_operators_make(spark):
    """The queries' nodes and edges, taken from the tables, against those of the pathway rows."""
    from quillon.plans import bindings

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    rows = bindings.pathways(spark, folder)
    edges = bindings.edges(spark, folder)
    assert sorted(map(tuple, edges.select("src", "dst", "weight", "step").collect())) == sorted(map(tuple, network.edges(rows).select("src", "dst", "weight", "step").collect()))
    columns = ["id", "class", "label", "region"]
    assert sorted(map(str, bindings.nodes(spark, folder, edges).select(columns).collect())) == sorted(map(str, network.nodes(rows).select(columns).collect()))


def test_communities_by_name(spark):
    """Two cliques with one edge between them, by each method; a path's lengths by pair and from one node."""
    clique = [(i, j, 1.0) for base in (0, 10) for i in range(base, base + 6) for j in range(base, i)]
    edges = spark.createDataFrame([*clique, (5, 10, 1.0)], "src long, dst long, weight double")
    for method in graph.COMMUNITIES:
        found = {r.id: r.community for r in graph.communities(edges, method).collect()}
        assert len({found[i] for i in range(5)}) == 1 and len({found[i] for i in range(11, 16)}) == 1
        assert method == "label_propagation" or found[0] != found[12]
    with pytest.raises(ValueError):
        graph.communities(edges, "none")
    line = spark.createDataFrame([(i, i + 1) for i in range(30)], "src long, dst long")
    assert graph.path_length(line, 0, 30) == 30 and graph.path_length(line, 5, 1) is None
    assert {r.node: r.dist for r in graph.lengths_from(line, 27).collect()} == {27: 0, 28: 1, 29: 2, 30: 3}
    assert len(graph.shortest_paths(line, 0, 30).first().path) == 31
