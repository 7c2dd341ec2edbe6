"""Approximate nearest neighbours by cosine: inverted lists, scanned in column blocks of rotated vectors.

* Equal vectors have equal neighbours. Of each vector's copies the K + 1 smallest ids are candidates, which is all that
  any query can get of them, and each distinct query vector is searched once.
* Lists: k-means on a sample of at most about SAMPLE vectors; every vector goes to its nearest centre. Lists are cut
  into blocks of about BLOCK vectors, and the queries that probe a list into parts of about PART, so that neither a hot
  list nor a hot neighbourhood of queries meets in one task.
* How many lists a query probes is measured: CALIBRATION query vectors are compared with all vectors, and the least
  number of lists that hold RECALL of their neighbours is taken for all. A query probes more where those hold too few.
* In a block, unit vectors are turned by a random rotation and kept by column blocks of WIDTH dimensions. After each
  column block the partial distance, scaled to all dimensions, is tested against the query's best distance so far with
  an allowance of EPSILON standard errors; candidates that fail are abandoned. The best so far comes from the query's
  nearest list, which is scanned first. Those that are never abandoned get their exact cosine from the original vectors.

Vectors that are null, zero, hold null or non-finite components or stand at a null id take no part, nor do those of
another length than most (ties: the smallest). Repeated rows of one id and vector are one; an id's other vectors are
candidates of their own, but never of that id. Ties go to the smaller id. An empty table gives an empty one; columns
beside the two named ones, whatever their names, are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, written

K = 5
#: Vectors in the sample that the lists are fitted on, lists at most, rounds of k-means.
SAMPLE, LISTS, ROUNDS = 1 << 16, 4096, 8
#: Vectors of a block, queries of a part, pairs tested at once.
BLOCK, PART, TESTED = 2048, 4096, 1 << 18
#: Dimensions of a column block, and standard errors that a partial distance may be too long.
WIDTH, EPSILON = 16, 2.1
#: Query vectors that the number of probes is measured on, and the share of their neighbours that probes must hold.
CALIBRATION, RECALL = 64, 0.97


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, h1, h2): rows that take part, with a 128-bit hash of the vector."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)))
    sizes = own.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    return own.filter(F.size("v") == (sizes[0]["size"] if sizes else 0)).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})


def best(rows: DataFrame, k: int, by: list[str], *order) -> DataFrame:
    """The first k rows of each key in the order, equal ones counted once."""
    return rows.withColumn("_at", F.dense_rank().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_at") <= k).drop("_at")


# --- numpy inside tasks


def matrix(column) -> np.ndarray:
    """An Arrow column of lists of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def unit(x: np.ndarray) -> np.ndarray:
    return x / lengths(x)[:, None]


def rotation(dimensions: int, seed: int = 0) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def list_order(x: np.ndarray, centres: np.ndarray, n: int | None = None) -> np.ndarray:
    """Lists of each unit vector, nearest centre first; only the first one for n = 1."""
    far = (centres * centres).sum(axis=1) / 2 - x @ centres.T
    return far.argmin(axis=1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")


def survivors(x: np.ndarray, q: np.ndarray, limit: np.ndarray, width: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of q, row of x) of rotated unit vectors whose squared distance is within the query's limit, as far as the tests of partial distances tell."""
    dimensions = x.shape[1]
    limit = np.maximum(limit, 0) + 1e-5  # rounding
    a, b = q[:, :width], x[:, :width]
    partial = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    qi, xi, seen = None, None, min(width, dimensions)
    while True:
        share = seen / dimensions
        allowed = share * (1 + epsilon / np.sqrt(seen)) ** 2 if seen < dimensions else 1.0
        if qi is None:
            qi, xi = np.nonzero(partial <= (limit * allowed)[:, None])
            partial = partial[qi, xi]
        else:
            ok = partial <= limit[qi] * allowed
            qi, xi, partial = qi[ok], xi[ok], partial[ok]
        if seen >= dimensions or not len(qi):
            return qi, xi
        block = slice(seen, seen + width)
        partial = partial + ((q[qi, block] - x[xi, block]) ** 2).sum(axis=1)
        seen = min(seen + width, dimensions)


def scan(x: np.ndarray, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, turn: np.ndarray, width: int, epsilon: float):
    """The k best rows of x for each row of q as (row of q, row of x, cosine); floor: the least cosine of interest, nan if not known."""
    xr, qr = (unit(x) @ turn).astype(np.float32), (unit(q) @ turn).astype(np.float32)
    nx, nq = lengths(x), lengths(q)
    step = max(1, TESTED // max(1, len(x)))
    for at in range(0, len(q), step):
        own = slice(at, at + step)
        limit = 2 - 2 * floor[own]
        new = np.flatnonzero(np.isnan(limit))
        if len(new):  # the best of a first few rows, compared whole
            head = xr[:256]
            whole = 2 - 2 * (qr[own][new] @ head.T)
            limit[new] = np.partition(whole, k - 1, axis=1)[:, k - 1] if len(head) >= k else np.inf
        qi, xi = survivors(xr, qr[own], limit, width, epsilon)
        qi = qi + at
        score = np.empty(len(qi))
        for i in range(0, len(qi), TESTED):
            a, b = qi[i : i + TESTED], xi[i : i + TESTED]
            score[i : i + TESTED] = (x[b] * q[a]).sum(axis=1) / (nx[b] * nq[a])
        order = np.lexsort((ids[xi], -score, qi))
        qi, xi, score = qi[order], xi[order], score[order]
        first = np.flatnonzero(np.diff(qi, prepend=-1))
        place = np.arange(len(qi)) - np.repeat(first, np.diff(np.append(first, len(qi))))
        yield qi[place < k], xi[place < k], score[place < k]


# --- the index


class Index:
    """Every candidate with its list and block, and how to find a query's lists.

    points: (list, block, id, v). centres: one row a list. first, blocks, sizes: of each list, its first block, its
    blocks and its vectors.
    """

    def __init__(self, rows: DataFrame, k: int = K, lists: int = LISTS, sample: int = SAMPLE, block: int = BLOCK, seed: int = 0):
        self.spark, self.k = rows.sparkSession, k
        kept = written(best(rows, k + 1, ["h1", "h2"], "id").dropDuplicates(["h1", "h2", "id"]).select("id", "v", "h1"), "candidates")
        self.n = kept.count()
        if not self.n:
            return
        self.dimensions = len(kept.select("v").first()[0])
        self.turn = rotation(self.dimensions, seed)
        self.centres = self.fitted(kept, max(1, min(lists, int(np.sqrt(self.n)))), sample, seed)
        dealt = self.dealt(kept)
        counts = {r["list"]: r["n"] for r in dealt.groupBy("list").agg(F.count("*").alias("n")).collect()}
        self.sizes = np.array([counts.get(i, 0) for i in range(len(self.centres))])
        self.blocks = -(-self.sizes // block)
        self.first = np.cumsum(self.blocks) - self.blocks
        at = self.map("list", first=self.first, blocks=self.blocks)
        salted = dealt.join(F.broadcast(at), "list").withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks")))
        self.points = written(salted.select("list", "block", "id", "v"), "index")

    def map(self, key: str, **columns: np.ndarray) -> DataFrame:
        """A row for each list."""
        rows = [(i, *map(int, x)) for i, x in enumerate(zip(*columns.values()))]
        return self.spark.createDataFrame(rows, f"{key} int, " + ", ".join(f"{c} bigint" for c in columns))

    def fitted(self, kept: DataFrame, lists: int, sample: int, seed: int) -> np.ndarray:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        if lists < 2:
            return np.zeros((1, self.dimensions))
        parts = 1 << 30
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
        some = kept.filter(F.pmod("h1", F.lit(parts)) < int(min(1.0, sample / self.n) * parts)).select(F.transform("v", lambda x: x.cast("double") / length).alias("u"))
        some = written(some.select(array_to_vector("u").alias("features")), "sample")
        if some.isEmpty():
            return np.zeros((1, self.dimensions))
        return np.array(KMeans(k=lists, maxIter=ROUNDS, initMode="random", seed=seed).fit(some).clusterCenters())

    def dealt(self, kept: DataFrame) -> DataFrame:
        """kept with the list of each row."""
        centres, ddl = self.centres, f"list int, id {kept.schema['id'].dataType.simpleString()}, v {kept.schema['v'].dataType.simpleString()}"
        schema = arrow_schema(ddl)

        def run(batches):
            for b in batches:
                if b.num_rows:
                    near = list_order(unit(matrix(b.column(1))), centres, 1)[:, 0]
                    yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), b.column(0), b.column(1).cast(schema.field(2).type)], schema=schema)

        return kept.select("id", "v").mapInArrow(run, ddl)

    def probes(self, queries: DataFrame, n: int, start: int = 0) -> DataFrame:
        """(h1, h2, v, floor, list): each query (h1, h2, v, floor) at its n nearest lists, and on until they hold k + 1 vectors; only at those that probes(queries, start) leaves, if start is given."""
        centres, sizes, enough = self.centres, self.sizes, min(self.k + 1, self.n)
        ddl = f"h1 bigint, h2 bigint, v {queries.schema['v'].dataType.simpleString()}, floor double, lists array<int>"
        schema = arrow_schema(ddl)

        def run(batches):
            for b in batches:
                if b.num_rows:
                    order = list_order(unit(matrix(b.column(2))), centres)
                    least = (np.cumsum(sizes[order], axis=1) < enough).sum(axis=1) + 1
                    begin = np.maximum(least, start) if start else np.zeros_like(least)
                    found = [row[a:b].astype(np.int32) for row, a, b in zip(order, begin, np.maximum(least, n))]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2).cast(schema.field(2).type), b.column(3), pa.array(found, schema.field(4).type)], schema=schema)

        return queries.select("h1", "h2", "v", "floor").mapInArrow(run, ddl).withColumn("list", F.explode("lists")).drop("lists")

    def scanned(self, probes: DataFrame, part: int = PART, width: int = WIDTH, epsilon: float = EPSILON) -> DataFrame:
        """(h1, h2, id, score, list): the best of each probed block."""
        counts = {r["list"]: r["n"] for r in probes.groupBy("list").agg(F.count("*").alias("n")).collect()}
        parts = np.array([-(-counts.get(i, 0) // part) for i in range(len(self.centres))])
        at = F.broadcast(self.map("list", first=self.first, blocks=self.blocks, parts=parts).filter("parts > 0 and blocks > 0"))
        points = self.points.join(at.select("list", "parts"), "list").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select("block", "part", "list", "id", "v")
        asked = probes.join(at, "list").withColumn("block", F.explode(F.expr("sequence(first, first + blocks - 1)")))
        asked = asked.select("block", F.pmod("h1", "parts").alias("part"), "h1", "h2", "v", "floor")
        k, turn = self.k + 1, self.turn
        ddl = f"h1 bigint, h2 bigint, id {points.schema['id'].dataType.simpleString()}, score double, list int"
        schema = arrow_schema(ddl)

        def run(x: pa.Table, q: pa.Table) -> pa.Table:
            out = [schema.empty_table()]
            if len(x) and len(q):
                order = pc.sort_indices(x.column("id"))
                x = x.take(order)  # so that places stand for ids, whatever their type
                floor = q.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
                for qi, xi, score in scan(matrix(x.column("v")), np.arange(len(x)), matrix(q.column("v")), floor, k, turn, width, epsilon):
                    columns = [q.column("h1").take(qi), q.column("h2").take(qi), x.column("id").take(xi), pa.array(score), x.column("list").take(xi)]
                    out.append(pa.table(columns, schema=schema))
            return pa.concat_tables(out)

        return points.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(run, ddl)

    def merged(self, found: DataFrame) -> DataFrame:
        return best(found, self.k + 1, ["h1", "h2"], F.desc("score"), "id")

    def measured(self, queries: DataFrame, calibration: int = CALIBRATION, recall: float = RECALL) -> int:
        """The least number of lists that hold the share of the sample's neighbours."""
        some = written(queries.orderBy("h1", "h2").limit(calibration), "calibration")
        found = self.merged(self.scanned(self.probes(some, len(self.centres)), epsilon=np.inf)).select("h1", "h2", "list", "score")
        rows = some.join(found, ["h1", "h2"]).select("v", "list", "score").collect()
        if not rows:
            return 1
        order = list_order(unit(np.array([r.v for r in rows], np.float64)), self.centres)
        place = (order == np.array([r["list"] for r in rows])[:, None]).argmax(axis=1)
        other = np.array([r.score < 1 - 1e-12 for r in rows])  # a query's own vector is in its nearest list
        place = np.sort(place[other] if other.any() else place)
        return int(place[min(len(place) - 1, int(np.ceil(recall * len(place))))]) + 1


def nearest(base: DataFrame, is_query: Column | str, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None, epsilon: float = EPSILON, **options) -> DataFrame:
    """(query_id, rank, id, score): the k rows of base nearest to each of its rows for which is_query (of id) holds, the query's own id aside. probes: lists a query looks at, measured by default."""
    rows = usable(base, id_col, vector_col)
    kind = base.schema[id_col].dataType.simpleString()
    asking = rows.filter(is_query)
    index = Index(rows, k, **options)
    if not index.n:
        return base.sparkSession.createDataFrame([], f"query_id {kind}, rank int, `{id_col}` {kind}, score double")
    queries = written(asking.groupBy("h1", "h2").agg(F.first("v").alias("v")).withColumn("floor", F.lit(None).cast("double")), "queries")
    n = index.measured(queries) if probes is None else probes
    home = written(index.merged(index.scanned(index.probes(queries, 1), epsilon=epsilon)), "home")
    floor = home.groupBy("h1", "h2").agg(F.when(F.count("*") > k, F.min("score")).alias("floor"))
    rest = index.probes(queries.drop("floor").join(floor, ["h1", "h2"], "left"), n, start=1)
    found = index.merged(home.unionByName(index.scanned(written(rest, "probes"), epsilon=epsilon)))
    found = written(found.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id"))).alias("near")), "found")
    own = asking.select("id", "h1", "h2").distinct().join(found, ["h1", "h2"])
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    out = own.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), (-F.col("x.far")).alias("score"))
