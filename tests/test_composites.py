"""Training sets, responses against connections, reports, and every command on files."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import cli, sinks
from quillon.operators import network
from quillon.plans import composites
from quillon.schemas import PATHWAY_NAMES
from quillon.sources import files

CHANNELS = [f"Or{i}a" for i in range(8)]


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(4)
    rows = [(f"i{i:02}", c, r.random() - 0.2) for i in range(30) for c in CHANNELS if r.random() > 0.1]
    return spark.createDataFrame(rows, "item string, channel string, response double")


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    """A file of connections between eight regions, a mapping, and labels."""
    r, at = random.Random(5), tmp_path_factory.mktemp("in")
    lines = []
    for i in range(160):
        a, z = r.randrange(8), r.randrange(8)
        kind = r.choice(["Local_Neuron", "Projection_Neuron"])
        lines.append(f"s{a}_{r.randrange(4)},L{a},ORN_R{a},m{r.randrange(25)}{kind[0]},T,{kind},s{z}_{r.randrange(4)},L{z},ORN,{r.randrange(1, 40)},{r.randrange(1, 60)}")
    lines += [f"s{a}_{k},L{a},ORN_R{a},m0L,T,Local_Neuron,s{a}_{k},L{a},ORN,1,1" for a in range(8) for k in range(4)]  # every target is a source too
    (at / "paths.csv").write_text(",".join(PATHWAY_NAMES) + "\n" + "\n".join(lines) + "\n")
    (at / "mapping.csv").write_text("channel,region\n" + "".join(f"Or{i}a,ORN_R{i}\n" for i in range(7)))
    (at / "labels.csv").write_text('root_id,label,position_x,position_y,position_z\n1,"Or1a cell",1,2,3\n2,"an Or2a and Or1a",,,\n3,other,4,5,6\n')
    return at


def test_training_set(spark, table, tmp_path):
    facts = composites.training_set(table, str(tmp_path), units=50, sparsity=0.1, copies=2, metadata=table.select("item").distinct().withColumn("name", F.upper("item")), format="npy")
    inputs = spark.read.parquet(f"{tmp_path}/inputs").collect()
    assert len(inputs) == facts["n_samples"] == 90 and facts["n_items"] == 30 and facts["n_train"] == 72 and facts["n_channels"] == 8
    side = {}
    for r in inputs:
        assert side.setdefault(r.item, r.train) == r.train
    own = {(r.item, r.channel): r.response for r in table.collect()}
    for r in inputs:
        plain = [own.get((r.item, c), 0.0) for c in CHANNELS]
        assert r.vector == plain if r.copy == 0 else len(r.vector) == 8
    assert any(r.vector != [own.get((r.item, c), 0.0) for c in CHANNELS] for r in inputs if r.copy == 1)
    codes = spark.read.parquet(f"{tmp_path}/codes").groupBy("sample").count().collect()
    assert len(codes) == 90 and {r["count"] for r in codes} == {5}
    assert spark.read.parquet(f"{tmp_path}/metadata").count() == 30
    assert json.loads(spark.read.text(f"{tmp_path}/facts").first().value)["seed"] == 42
    assert spark.read.format("npy").load(f"{tmp_path}/inputs_npy").count() == 90


def test_structure_function(spark, table, paths):
    rows = files.load_pathways(spark, str(paths / "paths.csv"))
    strengths = network.region_strengths(network.edges(rows), network.nodes(rows)).select("src_region", "dst_region", F.col("strength").alias("weight"))
    mapping = files.load_mapping(spark, [str(paths / "mapping.csv")])
    found = composites.structure_function(table, strengths, mapping).first()
    weight = {(r.src_region, r.dst_region): r.weight for r in strengths.collect()}
    own = {(r.item, r.channel): r.response for r in table.collect()}
    r, w = [], []
    for i in range(7):
        for j in range(i + 1, 7):
            both = [(own[k, f"Or{i}a"], own[k, f"Or{j}a"]) for k in {x for x, _ in own} if (k, f"Or{i}a") in own and (k, f"Or{j}a") in own]
            if weight.get((f"ORN_R{i}", f"ORN_R{j}"), 0) > 0:
                r.append(np.corrcoef(np.array(both).T)[0, 1])
                w.append(weight[f"ORN_R{i}", f"ORN_R{j}"])
    r, w = np.array(r), np.array(w, float)
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    strong = w > np.median(w)
    assert found.n == len(r) > 10 and found.r == pytest.approx(np.corrcoef(r, w)[0, 1]) and found.rho == pytest.approx(np.corrcoef(rank(r), rank(w))[0, 1])
    assert (found.slope, found.intercept) == pytest.approx(tuple(np.polyfit(r, w, 1)))
    assert found.u == pytest.approx(sum((a > b) + (a == b) / 2 for a in r[strong] for b in r[~strong])) and found.n_strong == strong.sum()
    assert found.d == pytest.approx((r[strong].mean() - r[~strong].mean()) / np.sqrt((r[strong].var() + r[~strong].var()) / 2))
    assert 0 < found.r_p <= 1 and f"connected pairs: {found.n}" in composites.structure_report(found)
    with pytest.raises(ValueError):
        composites.structure_function(table, strengths, mapping.limit(0))
    none = composites.structure_function(table.limit(0), strengths, mapping).first()
    assert none.n == 0 and none.r is None and "- Pearson r: -" in composites.structure_report(none)


def test_statistics_report(spark, paths):
    rows = files.load_pathways(spark, str(paths / "paths.csv"))
    nodes, edges = network.nodes(rows), network.edges(rows)
    text = sinks.statistics_report(edges, nodes, communities="greedy")
    assert "## Hubs by degree" in text and "modularity" in text and f"nodes: {nodes.count()}," in text


COMMANDS = {
    "paths.csv": [["types"], ["ladder"], ["hubs"], ["paths", "ORN_R1"], ["targets", "ORN_R1"], ["asymmetry"], ["network"]],
    "labels.csv": [["search", "Or1", "cell"], ["classes"], ["cells", "Or1a", "Or2a"], ["names"], ["map", "{in}/mapping.csv"]],
    "": [["items"], ["codes"], ["tuning"], ["channel", "or9"], ["export", "{out}/x.csv"], ["protocol", "6"], ["train", "{out}/train"], ["structure", "{in}/paths.csv", "{in}/mapping.csv"],
         ["subnetwork", "i03", "{in}/paths.csv", "{in}/mapping.csv"], ["recommend", "{in}/paths.csv", "{in}/mapping.csv"], ["unmapped", "{in}/mapping.csv"]],
}


def test_commands(spark, table, paths, tmp_path, capsys):
    own = table.withColumn("channel", F.when(F.col("channel") == "Or0a", "Or47b").otherwise(F.col("channel"))).withColumn("item", F.when(F.col("item") == "i01", "1-hexanol").otherwise(F.col("item")))
    own.write.parquet(f"{tmp_path}/responses")
    for file, commands in COMMANDS.items():
        for command in commands:
            cli.main([f"{paths}/{file}" if file else f"{tmp_path}/responses", *[c.replace("{in}", str(paths)).replace("{out}", str(tmp_path)) for c in command]])
            assert capsys.readouterr().out.strip(), command
    cli.main([f"{paths}/paths.csv", "graph", f"{tmp_path}/g.graphml", "--preset", "default"])
    cli.main([f"{paths}/labels.csv", "--csv", f"{tmp_path}/c.csv", "classes"])
    assert spark.read.csv(f"{tmp_path}/c.csv", header=True).count() == 1
