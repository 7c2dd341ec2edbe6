"""Responses, names, codes, doses, labels and space on small tables."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import cli, sinks
from quillon.functions import names, numeric, pvalues
from quillon.operators import annotate, dose, encoding, integrate, predict, response, similarity, spatial, statistics
from quillon.plans import protocols
from quillon.sources import files, npy
from quillon.streaming import counts


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(42)
    rows = [(f"i{i:02}", f"Or{c}a", r.random() - 0.3) for i in range(20) for c in range(1, 11) if r.random() > 0.3]
    return spark.createDataFrame(rows, "item string, channel string, response double")


def simpson(f, a, b, n=20_000):
    h = (b - a) / n
    return h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(a + i * h) for i in range(n + 1))


def test_p_values(spark):
    """Against integrals of the densities, for few and many degrees of freedom; nulls and edges."""
    tail = lambda z: 1 - 2 * simpson(lambda t: math.exp(-t * t / 2) / math.sqrt(2 * math.pi), 0, z)
    zs = [0.01, 0.3, 1.0, 1.7, 1.75, 2.5, 4.0]
    found = spark.createDataFrame([(z,) for z in zs], "z double").select("z", pvalues.normal_tails(F.col("z")).alias("p")).collect()
    assert {x.z: x.p for x in found} == pytest.approx({z: tail(z) for z in zs}, abs=1e-10)
    assert spark.range(1).select(pvalues.normal_tails(F.lit(10.0)).alias("p")).first().p == pytest.approx(1.5239706e-23, rel=1e-6)

    def student(r, n):
        df, t = n - 2, abs(r) * math.sqrt((n - 2) / (1 - r * r))
        scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        return 1 - 2 * simpson(lambda x: scale * (1 + x * x / df) ** (-(df + 1) / 2), 0, t)

    pairs = [(0.5, 20), (0.0, 20), (-0.9, 5), (0.3, 4), (0.7, 3), (0.01, 100_000), (-0.2, 501)]
    rows = [(r, n, student(r, n)) for r, n in pairs] + [(1.0, 9, 0.0), (-1.0, 9, 0.0), (0.4, 2, None), (None, 9, None), (0.3, None, None)]
    for x in spark.createDataFrame(rows, "r double, n long, want double").withColumn("p", pvalues.of_correlation(F.col("r"), F.col("n"))).collect():
        assert x.p == (x.want if x.want is None else pytest.approx(x.want, abs=1e-9))
    edges = spark.createDataFrame([(0, 4, 0.0, 0), (3, 3, 4.5, 0), (2, 2, 2.0, 60)], "n1 long, n2 long, u double, ties long")
    assert [x.p for x in edges.select(pvalues.of_rank_sum(*map(F.col, ("u", "n1", "n2", "ties"))).alias("p")).collect()] == [None, 1.0, 1.0]


def test_tuning(spark):
    rows = {"a": [0.1, 0.2, 0.9, 0.1, 0.05, 0.15, 0.8, 0.3], "b": [1.0, 2.0, 3.0], "c": [1.0] * 5, "d": [None] * 5, "e": ["SFR", "0.1", "nan", "0.2", "0.9", "0.1"]}
    wide = spark.createDataFrame([(k, i, str(x) if x is not None else None) for k, v in rows.items() for i, x in enumerate(v)], "channel string, item int, raw string")
    found = {r.channel: (r.kurtosis, r.tuning) for r in response.tuning(wide.withColumn("response", numeric.number(F.col("raw")))).collect()}
    assert found["a"][0] == pytest.approx(-0.7350838264) and [found[k][0] for k in "bcd"] == [None] * 3 and found["b"][1] == "very_broad"
    assert found["e"][0] is not None and found["a"][1] == "broad"


def test_queries(table):
    assert response.channel_coverage(table).count() == 10
    assert response.encode(table, ["Or1a", "Or99a"], 0.5).first().vector[1] == 0.5
    assert {len(r.vector) for r in response.encode(table, [f"Or{c}a" for c in range(1, 11)]).collect()} == {10}
    with pytest.raises(KeyError):
        response.subset(table, table.select("item").distinct().withColumn("ord", F.lit(1)), ["nope"])
    assert response.importance(table).agg(F.sum("importance")).first()[0] == pytest.approx(1)
    assert response.head_and_tail(table, 0).count() == table.count()
    near = similarity.by_correlation(table, "i03", 5).collect()
    assert len(near) == 5 and all(r.item != "i03" for r in near)
    both = similarity.mirrored(similarity.channel_correlations(table)).collect()
    assert len(both) == 100 and {(r.c1, r.c2): r.r for r in both}["Or1a", "Or1a"] == 1.0
    assert similarity.nearest_of_each(table, table.select("item").distinct().limit(3), 2).count() == 6


def test_correlation_against_numpy(table):
    cells = {(r["item"], r.channel): r.response for r in table.collect()}
    found = {(r.c1, r.c2): r.r for r in similarity.channel_correlations(table).collect()}
    items = sorted({i for i, _ in cells})
    for (a, b), r in found.items():
        x = np.array([(cells[i, a], cells[i, b]) for i in items if (i, a) in cells and (i, b) in cells])
        assert r == pytest.approx(np.corrcoef(x.T)[0, 1])


def test_names(spark):
    rows = spark.createDataFrame([("K1", "Ethyl Acetate", "EA;acetic-ester", 1), ("K2", "ethyl acetate", "ea", 2), ("K3", "Ea", "", 3), ("K4", "CO2", "carbon dioxide", 4)], "key string, name string, synonyms string, row_ord long")
    aliases = names.alias_table(rows, "key", "name", "synonyms", "row_ord")
    assert {r.alias: r.key for r in aliases.collect()} == {"ethyl acetate": "K2", "ea": "K3", "acetic-ester": "K1", "co2": "K4", "carbon dioxide": "K4"}
    asked = spark.createDataFrame([("ETHYL-ACETATE",), ("carbondioxide",), ("unknown",)], "name string")
    assert {r.name: r.key for r in names.resolve(asked, aliases).collect()} == {"ETHYL-ACETATE": "K2", "carbondioxide": "K4", "unknown": None}
    assert names.suggestions(spark.createDataFrame([("ethyl acetat",)], "name string"), aliases).first().alias == "ethyl acetate"
    keys = spark.createDataFrame([("QTBSBXVTEAMEQO-UHFFFAOYSA-N",), ("short",)], "k string").select(names.is_structure_key(F.col("k")).alias("ok")).collect()
    assert [r.ok for r in keys] == [True, False]
    regions = spark.createDataFrame([("DL5",), ("ORN_D",), ("ac1",), (" ",)], "r string").select(names.region_name(F.col("r")).alias("r")).collect()
    assert [r.r for r in regions] == ["ORN_DL5", "ORN_D", "ac1", None]


def test_outcomes(spark):
    rows = [("a", "Or42b", 0.6), ("a", "Or47b", 0.4), ("b", "Or92a", -0.9), ("c", "Or42b", 0.1), ("d", "Or1a", 0.9)]
    found = {r["item"]: r for r in predict.outcomes(spark.createDataFrame(rows, "item string, channel string, response double"), predict.weights(spark)).collect()}
    assert (found["a"].outcome, found["b"].outcome, found["c"].outcome, found["d"].outcome) == ("attractive (feeding)", "aversive", "neutral", "neutral")
    assert found["c"].confidence == 0.3 and found["b"].confidence == pytest.approx(1, abs=1e-5)


def test_codes(spark, table):
    channels = table.select("channel").distinct()
    code = encoding.sparse_code(table, channels, 200, 0.05)
    assert {r["count"] for r in code.groupBy("item").count().collect()} == {10}
    units = lambda c: {(r["item"], r.unit): round(r.activation, 9) for r in c.collect()}
    assert units(code) == units(encoding.sparse_code(table.repartition(3), channels, 200, 0.05))
    assert encoding.winners(code, 0).count() == 0
    more = encoding.augmented(code, 3)
    assert more.count() == 4 * code.count() and more.agg(F.min("activation")).first()[0] >= min(0.0, code.agg(F.min("activation")).first()[0])
    parts = encoding.split(table.select("item").distinct(), 0.8).groupBy("train").count().collect()
    assert {r.train: r["count"] for r in parts} == {True: 16, False: 4}
    with pytest.raises(ValueError):
        encoding.noisy(code, "pink")
    z = spark.range(4000).select(encoding.normal("id").alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(z[0]) < 0.06 and abs(z[1] - 1) < 0.05


def test_doses(spark):
    one = spark.createDataFrame([(0.01,), (0.1,), (1.0,)], "c double").select(numeric.hill(F.col("c"), 1.0, 0.1, 1.0).alias("r")).collect()
    assert [r.r for r in one] == pytest.approx([1 / 11, 0.5, 10 / 11])
    items = spark.createDataFrame([("a", 1.0, 0.1, 1.5, 0.05), ("b", 0.8, 0.02, 2.0, 0.0)], "item string, r_max double, ec50 double, n double, base double")
    series = dose.series(items)
    assert series.count() == 20
    fits = {r["item"]: r for r in dose.fit(series.select("item", "concentration", "response")).collect()}
    assert (fits["a"].ec50, fits["a"].n, fits["b"].ec50, fits["b"].r_max) == pytest.approx((0.1, 1.5, 0.02, 0.8), rel=1e-3)
    assert dose.fit_curve(np.array([0.1, 0.2]), np.array([1.0, 2.0])) == (2.0, 0.1, 1.0, 0.0)
    mix = items.select(F.lit(1).alias("mix"), F.col("item").alias("component"), F.lit(0.1).alias("concentration"), "r_max", "ec50", "n", "base")
    sums = {k: dose.mixture(mix, k).first().response for k in ("additive", "competitive", "synergistic")}
    assert sums["synergistic"] == pytest.approx(2 * sums["additive"]) and sums["competitive"] < sums["additive"]
    assert dose.noisy(series, "lognormal").filter("response < 0").count() == 0


def test_labels(spark, tmp_path):
    rows = spark.createDataFrame([("123", "Or42b neuron", 1000.0), ("456", "Or47b ORN", 2000.0), ("789", "Or42b cell", 1500.0), ("101112", "antennal lobe PN", 3000.0), ("1", None, None)], "root_id string, label string, x double").withColumns({"y": F.col("x"), "z": F.col("x")})
    assert annotate.search(rows, ["Or42b"]).count() == 2 and annotate.search(rows, ["("]).count() == 0 and annotate.search(rows, ["OR42B"], True).count() == 0
    assert annotate.classes(rows, ["or", "zz"]).count() == 3
    assert {r.name: r.n for r in annotate.names_in(rows).collect()} == {"Or42b": 2, "Or47b": 1}
    cells = annotate.cells_of(rows, spark.createDataFrame([("Or42b",), ("Or4",)], "channel string"))
    of = {r.channel: r for r in annotate.channel_cells(cells).collect()}
    assert (of["Or42b"].n_cells, of["Or42b"].mean_x) == (2, 1250.0) and of["Or4"].n_cells == 3
    assert annotate.cells_of(rows, spark.createDataFrame([("Or4",)], "channel string"), whole_words=True).count() == 0
    (tmp_path / "l.csv").write_text("pt_root_id,tag,pt_position_x\n1,Or1a,5\n2,\"['a', 'b']\",x\n")
    found = files.load_labels(spark, str(tmp_path / "l.csv")).orderBy("root_id").collect()
    assert [(r.root_id, r.label, r.x, r.y) for r in found] == [("1", "Or1a", 5.0, None), ("2", "['a', 'b']", None, None)]


def test_space(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (1, 100.0, 100.0, 100.0, 1.0), (2, 105.0, 105.0, 105.0, 0.3)], "map_id int, x double, y double, z double, intensity double")
    assert {r.map_id: r.center_x for r in spatial.summary(p).collect()} == {1: 50.0, 2: 105.0}
    one, two = p.filter("map_id = 1"), p.filter("map_id = 2")
    assert spatial.overlap(one, two, 10).first().overlap == 0.5 and spatial.overlap(one, two, 8.66).first().overlap == 0.0
    assert spatial.overlap(one, two.limit(0)).first().overlap == 0.0 and spatial.above(p, 0.4).count() == 2
    assert {(r.bin_a, r.bin_b) for r in spatial.heat_map(p, bins=4).collect()} == {(0, 0), (3, 3)}
    assert spatial.clusters(p, 2).select("cluster").distinct().count() == 2 and spatial.clusters(p.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        spatial.clusters(p, 2, "other")


def test_statistics(spark):
    r = random.Random(7)
    pairs = spark.createDataFrame([(float(r.randrange(9)), float(r.randrange(9))) for _ in range(60)], "x double, y double")
    rho = statistics.spearman(pairs, "x", "y").first().rho
    x, y = np.array(pairs.collect()).T
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert rho == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    u = statistics.mann_whitney(pairs, "x", F.col("y") > 4).first()
    a, b = x[y > 4], x[y <= 4]
    assert u.u == pytest.approx(sum((p > q) + (p == q) / 2 for p in a for q in b))
    assert 0 < u.p <= 1
    assert integrate.pair_diagnostics(spark.createDataFrame([("a", "b", 12)], "c1 string, c2 string, weight long"), 3).first().n_medium == 1


def test_cache_and_reports(spark, table, tmp_path, capsys):
    folder = str(tmp_path / "cache")
    facts = sinks.write_cache(table, table.select("item").distinct(), folder)
    assert facts["n_items"] == 20 and len(facts["digest"]) == 16 and files.cache_is_whole(spark, folder) and not files.cache_is_whole(spark, str(tmp_path))
    assert sinks.table_digest(table.repartition(5)) == facts["digest"]
    wide = table.groupBy("item").pivot("channel").agg(F.first("response"))
    wide.write.parquet(f"{folder}/wide")
    assert files.load_response(spark, f"{folder}/wide").filter("response is not null").count() == table.count()
    assert files.load_matrix_by_channel(spark, f"{folder}/wide").select("channel").distinct().count() == 10
    np.save(tmp_path / "m.npy", np.zeros((2, 3), np.float32))
    (tmp_path / "i.csv").write_text("item\na\nb\n")
    (tmp_path / "c.csv").write_text("channel\nx\ny\nz\n")
    assert files.load_response(spark, str(tmp_path / "m.npy"), "npy", names=(str(tmp_path / "i.csv"), str(tmp_path / "c.csv"))).count() == 6
    with pytest.raises(ValueError):
        files.load_response(spark, folder, "xls")
    with pytest.raises(ValueError):
        sinks.write_table(table, "x.doc")
    sinks.write_training(response.encode(table, ["Or1a", "Or2a"]), str(tmp_path / "t" / "v.npy"), "npy")
    shards = [np.load(tmp_path / "t" / "v.npy" / name) for name in json.loads((tmp_path / "t" / "v.npy" / "_shards.json").read_text())]
    assert np.concatenate(shards).shape == (20, 2)
    cli.main([f"{folder}/response", "report"])
    cli.main([f"{folder}/response", "similar", "i03", "-n", "3"])
    assert "# Response table" in capsys.readouterr().out
    for command in (["channel", "or1A"], ["group", "or"], ["encode"], ["predict"], ["compare", "i03", "i04"], ["contributors", "i03"], ["suggest", "i0"], ["extract", f"{folder}/again"], ["coverage"]):
        cli.main([f"{folder}/response", *command])
        assert capsys.readouterr().out.count("\n") > 1, command
    of = spark.createDataFrame([("p", "Or1a", f"i{i:02}") for i in range(20)], "pathway string, channel string, item string")
    assert "Blocking p" in protocols.to_markdown(protocols.protocol(table, of, "p"))
    known = {k: protocols.known_protocol(table.withColumn("channel", F.when(F.col("channel") == "Or1a", "Or47b").otherwise(F.col("channel"))).withColumn("item", F.when(F.col("item") == "i03", "1-hexanol").otherwise(F.col("item"))), k) for k in protocols.KNOWN}
    assert [len(known[k]["steps"]) for k in (1, 2, 3, 6)] == [5, 4, 5, 4] and len({p["steps"][0]["action"] for p in known.values()}) == 4
    assert known[6]["conditions"] == 30 and len(known[6]["steps"][0]["parameters"]["receptors"]) == 10 and len(known[1]["controls"]) == 4
    assert all(json.loads(protocols.to_json(p))["number"] == k and p["title"] in protocols.to_markdown(p) for k, p in known.items())
    own = protocols.own_protocol("Test", "It is needed.", ["Or92a"])
    assert "Or92a" in protocols.to_markdown(own) and own["steps"][0]["parameters"]["receptors"] == ["Or92a"]
    with pytest.raises(ValueError):
        protocols.known_protocol(table, 4)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 0.5), ("b", "x", None), ("a", "y", 0.0)], "item string, channel string, response double")
    rows.write.parquet(str(tmp_path / "in"))
    query = counts.coverage(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("coverage").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.channel: (r.n_tested, r.n_active) for r in spark.table("coverage").collect()} == {"x": (1, 1), "y": (1, 0)}


def test_npy_source(spark, tmp_path):
    """Ranges of rows of files in either order and of several types; shards, empty partitions, failures, and writing again."""
    own = npy.registered(spark)
    r = np.random.default_rng(1)
    x = r.integers(-50, 50, (1000, 7))
    for k, (kind, order) in enumerate((("<f4", "C"), ("<f8", "F"), (">i2", "C"), ("<i8", "F"))):
        path = str(tmp_path / f"{k}.npy")
        np.save(path, np.asarray(x, kind, order))
        found = own.read.format("npy").option("rangeBytes", 999).load(path)
        assert found.rdd.getNumPartitions() > 10
        rows = found.orderBy("row").collect()
        assert [a.row for a in rows] == list(range(1000)) and np.array_equal([a.vector for a in rows], x)
    np.save(tmp_path / "one.npy", np.arange(5.0))
    assert [a.vector for a in own.read.format("npy").load(str(tmp_path / "one.npy")).orderBy("row").collect()] == [[float(i)] for i in range(5)]
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(i, [float(i), i / 2]) for i in range(100)], "i long, vector array<double>")
    for _ in range(2):  # the second one replaces the first
        df.repartitionByRange(9, "i").sortWithinPartitions("i").select("vector").write.format("npy").option("dtype", "float64").mode("overwrite").save(out)
        assert [a.vector[0] for a in own.read.format("npy").load(out).orderBy("row").collect()] == list(range(100))
    df.limit(3).write.format("npy").option("dtype", "float64").mode("append").save(out)
    assert own.read.format("npy").load(out).count() == 103 and not list((tmp_path / "out").glob("_*-*"))
    for bad in ([(0, [1.0]), (1, [1.0, 2.0])], [(0, None)]):
        with pytest.raises(Exception):
            spark.createDataFrame(bad, df.schema).coalesce(1).write.format("npy").mode("append").save(out)
    assert own.read.format("npy").load(out).count() == 103
    with pytest.raises(Exception):
        own.read.format("npy").load(str(tmp_path / "none.npy")).count()


def test_encoding_by_name(spark, table):
    aliases = spark.createDataFrame([("ethyl acetate", "i03"), ("EtOAc", "i03"), ("hexanol", "i04")], "alias string, key string")
    own = {(r.item, r.channel): r.response for r in table.collect()}
    wanted = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    found = {r.name: list(r.vector) for r in response.encode_named(table, wanted("Ethyl-Acetate", "etoac", "hexanol"), aliases, ["Or1a", "Or2a"]).collect()}
    vector = lambda i: [own.get((i, c)) or 0.0 for c in ("Or1a", "Or2a")]
    assert found == {"Ethyl-Acetate": vector("i03"), "etoac": vector("i03"), "hexanol": vector("i04")}
    with pytest.raises(KeyError, match="hexanl.*did you mean hexanol"):
        response.encode_named(table, wanted("hexanl", "etoac"), aliases, ["Or1a"])
    assert {r.key for r in names.matching(aliases, "ETO").collect()} == {"i03"} and names.matching(aliases, "x").count() == 1
