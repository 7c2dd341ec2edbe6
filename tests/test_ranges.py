"""Work in ranges, random draws, groups of channels, and names by brute force."""

import bz2
import difflib
import gzip
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import groups, names
from quillon.operators import annotate, encoding, ranges, statistics
from quillon.sources import files


@pytest.fixture(params=[1, 4, 2000])
def partitions(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bounds_are_found_by_binary_search(spark):
    for n in (0, 1, 2, 3, 7, 8, 2000):
        own = [3 * i for i in range(n)]
        rows = spark.createDataFrame([(x,) for x in (-1, 0, 1, 2, 3, 5996, 5997, 10_000)], "v int")
        array = F.array(*map(F.lit, own)) if own else F.array().cast("array<int>")
        for v, k in rows.select("v", ranges.number(F.col("v"), array, n)).collect():
            assert k == sum(b <= v for b in own)


@pytest.mark.parametrize("kind", ["int", "string", "timestamp", "decimal(9,2)"])
def test_ranges_of_any_type(spark, kind):
    rows = spark.range(500).select((F.col("id") % 90).cast("int").alias("k")).select(F.when(F.col("k") > 0, F.col("k").cast("timestamp" if kind == "timestamp" else kind)).alias("k"))
    found, n = ranges.in_ranges(rows, "k")
    by = {r.part: (r.lo, r.hi, r.nulls) for r in found.groupBy("part").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count_if(F.col("k").isNull()).alias("nulls")).collect()}
    order = [by[p] for p in sorted(by)]
    assert len(order) <= n and order[0][2] == 6 and all(a[1] < b[0] for a, b in zip(order, order[1:]) if a[1] is not None)


def test_ranks_and_quantiles(spark, partitions):
    r = random.Random(partitions)
    values = [r.randrange(40) for _ in range(60)] + [None, None]
    rows = spark.createDataFrame([(v,) for v in values], "v int")
    own = sorted(v for v in values if v is not None)
    ranks = {x.v: x["rank"] for x in statistics.average_rank(rows, "v", "rank").collect()}
    assert ranks == {v: sum(i + 1 for i, x in enumerate(own) if x == v) / own.count(v) for v in own}
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        at = q * (len(own) - 1)
        low = math.floor(at)
        assert ranges.quantile(rows, "v", q) == pytest.approx(own[low] + (own[min(low + 1, len(own) - 1)] - own[low]) * (at - low))
    assert ranges.quantile(rows.limit(0), "v", 0.5) is None


def test_split_takes_exactly_its_share(spark):
    ids = spark.range(1003).select(F.col("id").alias("item"))
    one = encoding.split(ids.unionByName(ids))
    assert one.filter("train").select("item").distinct().count() == 802 and one.count() == 2006
    assert encoding.split(ids.repartition(9), seed=42).filter("train").select("item").exceptAll(one.filter("train").select("item").distinct()).isEmpty()


def test_poisson_counts(spark):
    for mean in (0.0, 0.5, 4.0, 90.0, 2000.0):
        row = spark.range(4000).select(encoding.poisson(F.lit(mean), "id").alias("k")).agg(F.avg("k"), F.var_pop("k"), F.min("k")).first()
        assert abs(row[0] - mean) <= 4 * math.sqrt(mean / 4000) + 1e-9 and abs(row[1] - mean) <= 0.12 * mean and row[2] >= 0


def test_groups_and_lookup(spark):
    channels = spark.createDataFrame([(c,) for c in ("Or42b", "Or47b", "Ir75a", "ab2B", "Or42a", "other")], "channel string")
    assert [r.channel for r in groups.of_group(channels, "or").collect()] == ["Or42b", "Or47b", "Or42a"]
    assert [r.channel for r in groups.of_group(channels, "neuron").collect()] == ["ab2B"]
    look = lambda t: sorted(map(tuple, groups.lookup(channels, t).collect()))
    assert look("or42B") == [("Or42b", "exact")] and look("r75") == [("Ir75a", "partial")] and look("or42") == [("Or42a", "suggestion"), ("Or42b", "suggestion")] and look("zzz") == []
    with pytest.raises(ValueError):
        groups.of_group(channels, "none")


def test_suggestions_by_brute_force(spark):
    r = random.Random(3)
    known = sorted({"".join(r.choice("abcde ") for _ in range(r.randrange(3, 9))).strip() for _ in range(300)} - {""})
    asked = ["abcd", "Bead", "ecba d", "zzzz"]
    found = names.suggestions(spark.createDataFrame([(a,) for a in asked], "name string"), spark.createDataFrame([(k,) for k in known], "alias string").repartition(5)).collect()
    for a in asked:
        own = sorted(((x.similarity, x.alias) for x in found if x.name == a), reverse=True)
        assert [x for _, x in own] == difflib.get_close_matches(a.lower(), known, 5, 0.6)


@pytest.mark.parametrize("cutoff", [0.3, 0.6, 0.85])
def test_suggestions_of_many_names(spark, cutoff):
    """Names of all lengths, repeated characters and letters outside ASCII, against every pair."""
    r = random.Random(11)
    known = sorted({"".join(r.choice("aabcdé-日1 ") for _ in range(r.randrange(1, r.choice([4, 12, 30])))) for _ in range(150)})
    asked = sorted({"".join(r.choice("aabcdé-日1 X") for _ in range(r.randrange(1, 14))) for _ in range(25)} | set(known[:10])) + [""]
    found = names.suggestions(spark.createDataFrame([(a,) for a in [*asked, None]], "name string"), spark.createDataFrame([(k,) for k in [*known, None, ""]], "alias string"), n=3, cutoff=cutoff).collect()
    for a in asked:
        own = sorted(((x.similarity, x.alias) for x in found if x.name == a), reverse=True)
        assert [x for _, x in own] == (difflib.get_close_matches(a.lower(), known, 3, cutoff) if a else [])


@pytest.mark.parametrize("whole", [False, True])
def test_names_in_labels(spark, whole):
    """The automaton and the grams give the same: every name in every label, one by one."""
    from quillon.operators import matching

    r = random.Random(12)
    word = lambda n: "".join(r.choice("abAB1_ .\\é(") for _ in range(n))
    known = sorted({word(r.randrange(1, 6)) for _ in range(120)} | {"A", "a", r"\E"})
    labels = [(str(i), word(r.randrange(0, 25))) for i in range(80)] + [("n", None)]
    is_word = lambda t, i: 0 <= i < len(t) and (t[i] == "_" or t[i].isascii() and t[i].isalnum())
    at = lambda t, n: [i for i in range(len(t) - len(n) + 1) if t.startswith(n, i)]
    ok = lambda t, i, k: not whole or (is_word(t, i - 1) != is_word(t, i) and is_word(t, i + k - 1) != is_word(t, i + k))
    want = sorted((i, n) for i, t in labels if t for n in known if any(ok(t.lower(), x, len(n)) for x in at(t.lower(), n.lower())))
    rows, own = spark.createDataFrame(labels, "low string, label string"), spark.createDataFrame([(n,) for n in [*known, known[0], None, ""]], "word string")
    for sent in (1 << 20, 0):
        found = matching.contained(rows, "label", own, "word", whole, sent)
        assert found.columns == ["low", "label", "name"] and sorted((x.low, x["name"]) for x in found.collect()) == want
    assert matching.contained(rows, "label", own.limit(0), "word").count() == 0


def test_many_names(spark):
    """200,000 names and no cap."""
    from quillon.operators import matching

    known = spark.range(200_000).select(F.format_string("n%06d", "id").alias("word"))
    labels = spark.range(0, 200_000, 1000).select(F.format_string("cell n%06d and n%06d", "id", F.col("id") + 7).alias("label"))
    for sent in (1 << 26, 0):
        assert matching.contained(labels, "label", known, "word", True, sent).count() == 400


def test_labels_of_sensilla_and_plain_names(spark):
    labels = spark.createDataFrame([("1", "an ab2A cell and pb1", 1.0, 1.0, 1.0), ("2", "Or42b (left)", 1.0, 1.0, 1.0), ("3", None, 1.0, 1.0, 1.0)], "root_id string, label string, x double, y double, z double")
    assert sorted((r.root_id, r["class"]) for r in annotate.classes(labels, list(annotate.CLASSES)).collect()) == [("1", "sensillum_ab"), ("1", "sensillum_pb"), ("2", "or")]
    channels = spark.createDataFrame([("b (L",), ("ab2a",), ("b2",)], "channel string")
    assert sorted((r.channel, r.root_id) for r in annotate.cells_of(labels, channels).collect()) == [("ab2a", "1"), ("b (L", "2"), ("b2", "1")]
    assert sorted((r.channel, r.root_id) for r in annotate.cells_of(labels, channels, True).collect()) == [("ab2a", "1")]
    assert annotate.search(labels, ["(?P<x>a)", "Or\\d+"]).count() == 1  # the first is none of Java's


class Encoder:
    """Writes R's serialisation, as much of it as the tests need."""

    def __init__(self, version=2):
        self.out, self.known = bytearray(b"RDX%d\nX\n" % version), {}
        self.int(version, 0x040100, 0x020300)
        if version == 3:
            self.int(5)
            self.out += b"UTF-8"

    def int(self, *values):
        self.out += struct.pack(f">{len(values)}i", *values)

    def chars(self, s):
        self.int(9 | (64 << 12), -1 if s is None else len(s.encode()))
        self.out += (s or "").encode()

    def symbol(self, s):
        if s in self.known:
            self.int(255 | (self.known[s] << 8))
        else:
            self.known[s] = len(self.known) + 1
            self.int(1)
            self.chars(s)

    def pairs(self, items):
        for k, v in items.items():
            self.int(2 | 0x400)
            self.symbol(k)
            v(self)
        self.int(254)


def vector(values, kind="real", **attributes):
    def write(e):
        code = {"real": 14, "int": 13, "lgl": 10, "str": 16, "list": 19}[kind]
        e.int(code | (0x200 if attributes else 0), len(values))
        for v in values:
            if kind == "real":
                e.out += struct.pack(">d", float("nan") if v is None else v)
            elif kind in ("int", "lgl"):
                e.int(-(2**31) if v is None else int(v))
            elif kind == "str":
                e.chars(v)
            else:
                v(e)
        if attributes:
            e.pairs({k.replace("_", "."): v for k, v in attributes.items()})

    return write


def sequence(n):
    """1 to n as R keeps it, by its ends."""

    def write(e):
        e.int(238)
        e.pairs({"class": lambda e: e.symbol("compact_intseq"), "package": lambda e: e.symbol("base"), "type": vector([13], "int")})
        vector([n, 1, 1])(e)
        e.int(254)

    return write


@pytest.mark.parametrize(("version", "squeeze"), [(2, gzip.compress), (3, bz2.compress), (3, bytes)])
def test_rdata_objects(spark, tmp_path, version, squeeze):
    frame = vector([vector([0.5, None, -2.0]), vector(["x", None, "é"], "str"), vector([2, 1, None], "int", levels=vector(["lo", "hi"], "str"), **{"class": vector(["factor"], "str")}), sequence(3), vector([1, 0, None], "lgl")],
                   "list", names=vector(["Or1a", "Name", "Level", "n", "ok"], "str"), row_names=vector(["K1", "K2", "K3"], "str"), **{"class": vector(["data.frame"], "str")})
    matrix = vector([1.0, 2.0, 3.0, 4.0, None, 6.0], dim=vector([3, 2], "int"), dimnames=vector([vector(["a", "b", "c"], "str"), vector(["p", "q"], "str")], "list"))
    short = vector([vector([7.0, 8.0])], "list", names=vector(["v"], "str"), row_names=vector([None, -2], "int"))
    e = Encoder(version)
    e.pairs({"response.matrix": matrix, "odor": frame, "AL.map": short, "other": vector([1.5])})
    path = str(tmp_path / "all.RData")
    (tmp_path / "all.RData").write_bytes(squeeze(bytes(e.out)))
    found = files.load_rdata(spark, path)
    assert sorted(found) == ["items", "map", "response"]
    rows = lambda df: [tuple(r) for r in df.orderBy("rownames").collect()]
    assert found["response"].columns == ["rownames", "p", "q"] and rows(found["response"]) == [("a", 1.0, 4.0), ("b", 2.0, None), ("c", 3.0, 6.0)]
    assert rows(found["items"]) == [("K1", 0.5, "x", "hi", 1.0, 1.0), ("K2", None, None, "lo", 2.0, 0.0), ("K3", -2.0, "é", None, 3.0, None)]
    assert rows(found["map"]) == [("1", 7.0), ("2", 8.0)]
    assert files.long_form(found["response"], "rownames").filter("response is not null").count() == 5
    e = Encoder(version)
    e.pairs({"odor": frame})
    (tmp_path / "none.RData").write_bytes(bytes(e.out))
    with pytest.raises(ValueError):
        files.load_rdata(spark, str(tmp_path / "none.RData"))



def test_running_and_grouped_quantiles(spark):
    """A hot group over several ranges, a null group, ties and a group without values."""
    r = random.Random(3)
    rows = [("hot", r.randrange(40), i) for i in range(600)] + [(r.choice(["a", "b", None]), r.randrange(9), i) for i in range(600, 700)] + [("none", None, 701), ("one", 5, 702)]
    df = spark.createDataFrame(rows, "g string, v long, i long")
    ahead = {x.i: x.ahead for x in ranges.running(df.fillna(0, ["v"]), ["g"], ["v", "i"], "v").collect()}
    for g in {x[0] for x in rows}:
        total = 0
        for v, i in sorted((v or 0, i) for x, v, i in rows if x == g):
            assert ahead[i] == total
            total += v
    for share in (0.5, 0.9):
        found = {x.g: x.q for x in ranges.quantiles(df, ["g"], "v", share, "q").collect()}
        want = {g: np.quantile(own, share) if (own := [v for x, v, _ in rows if x == g and v is not None]) else None for g in {x[0] for x in rows}}
        assert found == pytest.approx(want)
