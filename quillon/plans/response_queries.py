"""Queries on responses, similarity, codes and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.numeric import tuning_class
from ..operators import dose, encoding, predict, response, similarity
from . import bindings as b

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, **tables: str):
    """Register a query under its function's name; sql may name the given tables."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            head = ", ".join(f"{k} AS {v}" for k, v in tables.items())
            ORACLES[f.__name__] = f"WITH {head} {sql}" if head else sql
        return f

    return keep


Spark = SparkSession


@query("SELECT channel, count(response) AS n_tested, count(response) * 100.0::DOUBLE / (SELECT count(DISTINCT item) FROM r) AS pct FROM r GROUP BY channel", r=b.SPARSE)
def channel_coverage(s: Spark, d: str) -> DataFrame:
    return response.channel_coverage(b.sparse(s, d))


@query("SELECT item, count(response) AS n_tested, count(*) FILTER (response > 0.1) AS n_active, max(response) AS max_response, avg(response) AS mean_response FROM r GROUP BY item", r=b.SPARSE)
def item_coverage(s: Spark, d: str) -> DataFrame:
    return response.item_coverage(b.sparse(s, d))


@query("""SELECT count(DISTINCT item) AS n_items, count(DISTINCT channel) AS n_channels, count(response) AS n_cells, min(response) AS min_response, max(response) AS max_response,
    100 - count(response) * 100.0::DOUBLE / (count(DISTINCT item) * count(DISTINCT channel)) AS sparsity_pct FROM r""", r=b.SPARSE)  # fmt: skip
def matrix_profile(s: Spark, d: str) -> DataFrame:
    return response.profile(b.sparse(s, d))


@query("""SELECT channel, round(k, 8) AS kurtosis, CASE WHEN k > 40 THEN 'very_narrow' WHEN k > 20 THEN 'narrow' WHEN k > 0 THEN 'moderate' WHEN k > -10 THEN 'broad' ELSE 'very_broad' END AS tuning
    FROM (SELECT channel, CASE WHEN count(response) >= 4 THEN kurtosis_pop(response) END AS k FROM r GROUP BY channel)""", r=b.DENSE)  # fmt: skip
def lifetime_kurtosis(s: Spark, d: str) -> DataFrame:
    return response.tuning(b.dense(s, d)).withColumn("kurtosis", F.round("kurtosis", 8))


@query("SELECT n_nationkey AS id, CASE WHEN k > 40 THEN 'very_narrow' WHEN k > 20 THEN 'narrow' WHEN k > 0 THEN 'moderate' WHEN k > -10 THEN 'broad' ELSE 'very_broad' END AS tuning FROM (SELECT n_nationkey, CASE WHEN n_nationkey > 0 THEN n_nationkey * 3.0 - 20 END AS k FROM nation)")
def tuning_classes(s: Spark, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    return b.table(s, d, "nation").select(n.alias("id"), tuning_class(F.when(n > 0, n * 3.0 - 20)).alias("tuning"))


@query("SELECT item, channel, response FROM r WHERE response > 0.2", r=b.DENSE)
def activated_channels(s: Spark, d: str) -> DataFrame:
    return response.activated(b.dense(s, d), 0.2)


@query("SELECT item, channel, response FROM r WHERE abs(response) > 0.2", r=b.DENSE)
def activated_abs(s: Spark, d: str) -> DataFrame:
    return response.activated(b.dense(s, d), 0.2, use_abs=True)


@query("SELECT channel, item, response, row_number() OVER (PARTITION BY channel ORDER BY response DESC, item) AS rank FROM r QUALIFY rank <= 10", r=b.DENSE)
def best_items_per_channel(s: Spark, d: str) -> DataFrame:
    return response.best_items(b.dense(s, d))


@query("""SELECT item, 'top' AS side, row_number() OVER (PARTITION BY item ORDER BY response DESC, channel) AS rank, channel, response FROM r QUALIFY rank <= 5
    UNION ALL SELECT item, 'bottom', row_number() OVER (PARTITION BY item ORDER BY response, channel) AS rank, channel, response FROM r QUALIFY rank <= 5""", r=b.DENSE)  # fmt: skip
def top_bottom5(s: Spark, d: str) -> DataFrame:
    return response.top_and_bottom(b.dense(s, d))


@query("""SELECT channel, item, response FROM r QUALIFY row_number() OVER (PARTITION BY channel ORDER BY response DESC, item) <= 7
    OR row_number() OVER (PARTITION BY channel ORDER BY response, item DESC) <= 7""", r=b.DENSE)  # fmt: skip
def channel_profile_head_tail(s: Spark, d: str) -> DataFrame:
    return response.head_and_tail(b.dense(s, d), 7)


@query("SELECT channel, max(response) AS max_response, min(response) AS min_response, max(response) - min(response) AS spread FROM r WHERE item IN (1, 5, 9) GROUP BY channel", r=b.SPARSE)
def multi_item_spread(s: Spark, d: str) -> DataFrame:
    return response.spread(b.sparse(s, d), [1, 5, 9])


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red')")
def name_search(s: Spark, d: str) -> DataFrame:
    return response.search(b.table(s, d, "part").select("p_partkey", "p_name"), "p_name", "RED")


@query("""SELECT alias, key FROM (SELECT lower(trim(p_name)) AS alias, p_partkey AS key, 1 AS is_name, p_partkey AS rank FROM part
    UNION ALL SELECT lower(trim(unnest([p_brand, p_type]))), p_partkey, 0, -p_partkey FROM part) QUALIFY row_number() OVER (PARTITION BY alias ORDER BY is_name DESC, rank DESC) = 1""")  # fmt: skip
def alias_resolution(s: Spark, d: str) -> DataFrame:
    return names.alias_table(b.aliases(s, d), "key", "name", "synonyms", "row_ord")


@query("""SELECT s_name AS name, array_to_string(list_sort(list_distinct([x, replace(x, ' ', '-'), replace(x, ' ', ''), replace(x, '-', ' '), replace(x, '-', ''), replace(replace(x, ' ', ''), '-', '')])), '|') AS forms FROM (SELECT s_name, lower(trim(replace(s_name, '#', ' -'))) AS x FROM supplier)""")
def name_variants(s: Spark, d: str) -> DataFrame:
    forms = names.variants(F.replace("s_name", F.lit("#"), F.lit(" -")))
    return b.table(s, d, "supplier").select(F.col("s_name").alias("name"), F.array_join(F.sort_array(forms), "|").alias("forms"))


@query("SELECT w.ord, item, channel, response FROM r JOIN (VALUES (7, 1), (3, 2), (11, 3)) w(item, ord) USING (item) WHERE channel IN (2, 5)", r=b.DENSE)
def subset_ordered(s: Spark, d: str) -> DataFrame:
    wanted = s.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("item"), F.lit(o).alias("ord")) for i, o in ((7, 1), (3, 2), (11, 3))])))
    return response.subset(b.dense(s, d), wanted, [2, 5])


@query("""SELECT i.item, c.channel, coalesce(response, 0) AS response FROM (SELECT DISTINCT item FROM r) i CROSS JOIN (SELECT DISTINCT channel FROM r) c LEFT JOIN r USING (item, channel)""", r=b.SPARSE)
def encode_fill(s: Spark, d: str) -> DataFrame:
    r = b.sparse(s, d)
    channels = sorted(x.channel for x in b.table(s, d, "part").select(F.col("p_brand").alias("channel")).distinct().collect())
    known = {x.channel for x in r.select("channel").distinct().collect()}
    channels = [c for c in channels if c in known]
    vectors = response.encode(r, channels)
    return vectors.select("item", F.posexplode("vector").alias("at", "response")).select("item", F.element_at(F.array(*map(F.lit, channels)), F.col("at") + 1).alias("channel"), "response")


_CORR = "CASE WHEN count(*) > 1 THEN covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) END"


#: Means equal as numbers but not in their last bit (0.15 / 3, 0.05) are equal, so that a constant side is known; a rounded zero has no sign.
_MEANS = f"(SELECT item, channel, round(response, 12) AS response FROM {b.SPARSE})"


@query(f"SELECT a.item, round({_CORR.format(x='a.response', y='t.response')}, 8) + 0.0 AS similarity, count(*) AS n_shared FROM r a JOIN r t USING (channel) WHERE t.item = 3 AND a.item != 3 GROUP BY a.item HAVING similarity IS NOT NULL", r=_MEANS)
def similar_pearson(s: Spark, d: str) -> DataFrame:
    means = b.sparse(s, d).withColumn("response", F.round("response", 12))
    return similarity.by_correlation(means, 3, k=None).withColumn("similarity", F.round("similarity", 8) + 0.0)


@query("SELECT a.item, round(-sqrt(sum((a.response - t.response) ** 2)), 8) AS similarity FROM r a JOIN r t USING (channel) WHERE t.item = 3 AND a.item != 3 GROUP BY a.item", r=b.SPARSE)
def similar_euclid(s: Spark, d: str) -> DataFrame:
    return similarity.by_distance(b.sparse(s, d), 3, k=None).withColumn("similarity", F.round("similarity", 8))


def student_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation by the finite sums for whole degrees of freedom."""
    angle = f"atan(abs({r}) * sqrt(({n} - 2) / (1 - {r} * {r})) / sqrt({n} - 2))"
    # even degrees: the sum over j < df / 2 of (1 3 .. (2j - 1)) / (2 4 .. 2j) cos^2j; odd ones: of (2 4 .. 2j) / (3 5 .. (2j + 1)) cos^2j
    even = f"sin({angle}) * coalesce(list_sum(list_transform(range(0, ({n} - 2) // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1) - lgamma(0.5) + 2 * j * ln(cos({angle}))))), 0)"
    odd = f"(2 / pi()) * ({angle} + sin({angle}) * cos({angle}) * coalesce(list_sum(list_transform(range(0, ({n} - 3) // 2), lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5) + 2 * j * ln(cos({angle}))))), 0))"
    return f"(CASE WHEN abs({r}) >= 1 THEN 0 WHEN {n} % 2 = 0 THEN 1 - {even} ELSE 1 - {odd} END)"


@query(f"SELECT c1, c2, round(r, 8) AS r, n, round({student_sql('r', 'n')}, 8) + 0.0 AS p FROM (SELECT x.channel AS c1, y.channel AS c2, {_CORR.format(x='x.response', y='y.response')} AS r, count(*) AS n FROM r x JOIN r y USING (item) WHERE x.channel < y.channel GROUP BY ALL)", r=b.SPARSE)
def channel_corr_matrix(s: Spark, d: str) -> DataFrame:
    return similarity.channel_correlations(b.sparse(s, d)).withColumns({"r": F.round("r", 8), "p": F.round("p", 8) + 0.0})


@query(f"""SELECT query, item, round(similarity, 8) AS similarity FROM (SELECT t.item AS query, a.item, {_CORR.format(x='a.response', y='t.response')} AS similarity FROM r a JOIN r t USING (channel) WHERE a.item != t.item GROUP BY ALL)
    WHERE similarity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, item) <= 5""", r=b.DENSE)  # fmt: skip
def nearest_items(s: Spark, d: str) -> DataFrame:
    """The five nearest of every item."""
    return similarity.nearest_of_each(b.dense(s, d).select("item", "channel", "response")).withColumn("similarity", F.round("similarity", 8))


@query("""SELECT a.item, round(sum(a.response * t.response) / nullif(any_value(na.n) * any_value(nt.n), 0), 8) AS similarity FROM k a JOIN k t USING (channel) JOIN norms na ON a.item = na.item JOIN norms nt ON t.item = nt.item
    WHERE t.item = 3 AND a.item != 3 GROUP BY a.item HAVING sum(a.response * t.response) / nullif(any_value(na.n) * any_value(nt.n), 0) >= 0.3""",
    r=b.DENSE, k="(SELECT * FROM r WHERE abs(response) >= 0.05)", norms="(SELECT item, sqrt(sum(response * response)) AS n FROM k GROUP BY item)")
def pattern_cosine(s: Spark, d: str) -> DataFrame:
    return similarity.by_pattern(b.dense(s, d), 3, 0.05, k=None).withColumn("similarity", F.round("similarity", 8))


_WEIGHTS = "(VALUES (1, 0.9, 0.0, 0.0), (2, 0.7, 0.0, 0.9), (3, 0.0, 0.9, 0.0), (4, 0.0, 0.6, 0.0), (5, 0.6, 0.0, 0.7))"


def _outcomes(s: Spark, d: str) -> DataFrame:
    w = predict.weights(s, {1: 0.9, 2: 0.7, 5: 0.6}, {3: 0.9, 4: 0.6}, {2: 0.9, 5: 0.7})
    return predict.outcomes(b.dense(s, d).drop("label"), w, 0.1)


_OUTCOMES = f"""SELECT item, a AS attractive, v AS aversive, f AS feeding, CASE WHEN a + v = 0 THEN 'neutral' WHEN a > v THEN CASE WHEN f > 0.5 THEN 'attractive (feeding)' ELSE 'attractive' END WHEN v > a THEN 'aversive' ELSE 'neutral' END AS outcome,
    CASE WHEN a + v = 0 THEN 0.3 WHEN a > v THEN least(a / (a + v + 1e-6), 1) WHEN v > a THEN least(v / (a + v + 1e-6), 1) ELSE 0.5 END AS confidence
    FROM (SELECT item, sum(CASE WHEN m THEN abs(response) * wa ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN m THEN abs(response) * wv ELSE 0 END)::DOUBLE AS v, sum(CASE WHEN m THEN abs(response) * wf ELSE 0 END)::DOUBLE AS f
        FROM (SELECT item, response, w.*, w.channel IS NOT NULL AND abs(response) >= 0.1 AS m FROM r LEFT JOIN {_WEIGHTS} w(channel, wa, wv, wf) ON r.channel = w.channel) GROUP BY item)"""


@query(f"SELECT item, round(attractive, 8) AS attractive, round(aversive, 8) AS aversive, round(feeding, 8) AS feeding, outcome, round(confidence, 8) AS confidence FROM ({_OUTCOMES})", r=b.DENSE)
def rule_prediction(s: Spark, d: str) -> DataFrame:
    return _outcomes(s, d).select("item", *[F.round(c, 8).alias(c) for c in ("attractive", "aversive", "feeding")], "outcome", F.round("confidence", 8).alias("confidence"))


@query(f"""SELECT count(*) AS n, count(*) FILTER (ok) AS n_correct, count(*) FILTER (ok)::DOUBLE / nullif(count(*), 0) AS accuracy, 1 - count(*) FILTER (ok)::DOUBLE / nullif(count(*), 0) AS error_rate
    FROM (SELECT split_part(outcome, ' ', 1) = CASE WHEN toxic = 1 THEN 'aversive' WHEN quality = 1 THEN 'attractive' ELSE 'neutral' END AS ok FROM ({_OUTCOMES}) p JOIN labels l ON p.item = l.doc_id)""", r=b.DENSE)  # fmt: skip
def prediction_validation(s: Spark, d: str) -> DataFrame:
    known = b.table(s, d, "labels").select(F.col("doc_id").alias("item"), F.when(F.col("toxic") == 1, "aversive").when(F.col("quality") == 1, "attractive").otherwise("neutral").alias("known"))
    return predict.validation(_outcomes(s, d), known)


@query("SELECT item, row_number() OVER (PARTITION BY item ORDER BY abs(response) DESC, channel) AS rank, channel, response FROM r QUALIFY rank <= 5", r=b.DENSE)
def top_contributors(s: Spark, d: str) -> DataFrame:
    return predict.top_contributors(b.dense(s, d))


@query("SELECT channel, round(raw / sum(raw) OVER (), 8) AS importance FROM (SELECT channel, var_pop(response) * avg(abs(response)) AS raw FROM r GROUP BY channel)", r=b.DENSE)
def importance_proxy(s: Spark, d: str) -> DataFrame:
    return response.importance(b.dense(s, d)).withColumn("importance", F.round("importance", 8))


@query("SELECT channel, round(raw / sum(raw) OVER (), 8) AS contribution FROM (SELECT channel, avg(abs(response)) AS raw FROM r GROUP BY channel) QUALIFY raw / sum(raw) OVER () >= 0.0155", r=b.DENSE)
def contributions(s: Spark, d: str) -> DataFrame:
    return response.critical(response.contributions(b.dense(s, d)), 0.0155).withColumn("contribution", F.round("contribution", 8))


@query("""SELECT pathway, round(coalesce(avg(response), 0), 8) AS strength, count(response) AS n_pairs FROM (VALUES ('one', 'Brand#1', 1), ('one', 'Brand#1', 2), ('two', 'Brand#2', 5), ('none', 'Brand#99', 5)) p(pathway, channel, item)
    LEFT JOIN r USING (channel, item) GROUP BY pathway""", r=b.SPARSE)  # fmt: skip
def pathway_strengths(s: Spark, d: str) -> DataFrame:
    of = predict.pathway_table(s, {"one": (("Brand#1",), (1, 2)), "two": (("Brand#2",), (5,)), "none": (("Brand#99",), (5,))})
    return response.pathway_strength(b.sparse(s, d), of).withColumn("strength", F.round("strength", 8))


@query("SELECT channel, bucket, n, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY channel) AS pct FROM (SELECT channel, CASE WHEN 3 * response >= 0.5 THEN 'strong' WHEN 3 * response >= 0.2 THEN 'moderate' ELSE 'weak' END AS bucket, count(*) AS n FROM r WHERE response > 0 GROUP BY ALL)", r=b.DENSE)
def strength_buckets(s: Spark, d: str) -> DataFrame:
    return response.strength_buckets(b.dense(s, d).withColumn("response", F.col("response") * 3))


@query("""SELECT count(DISTINCT item) AS n_items, round(sum(response) / (count(DISTINCT item) * 25.0::DOUBLE), 8) AS mean_response, round(sqrt(sum(response * response) / (count(DISTINCT item) * 25.0::DOUBLE) - (sum(response) / (count(DISTINCT item) * 25.0::DOUBLE)) ** 2), 8) AS std_response,
    count(response) / (count(DISTINCT item) * 25.0::DOUBLE) AS coverage, count(*) FILTER (response > 0.05) / (count(DISTINCT item) * 25.0::DOUBLE) AS active_share, greatest(max(response), 0) AS max_response, least(min(response), 0) AS min_response FROM r""", r=b.SPARSE)  # fmt: skip
def dataset_statistics(s: Spark, d: str) -> DataFrame:
    return response.dataset_statistics(b.sparse(s, d), 25, 0.05).withColumns({c: F.round(c, 8) for c in ("mean_response", "std_response")})


def _weights(s: Spark, d: str) -> DataFrame:
    """Integer formula that any engine evaluates alike."""
    c = b.dense(s, d).select("channel").distinct().select("channel", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("unit"))
    return c.filter("(unit + channel) % 2 = 0").withColumn("weight", ((F.col("unit") * 31 + F.col("channel") * 17) % 101 - 50) / 1000.0)


_ACTIVATION = """(SELECT item, unit, sum(response * ((unit * 31 + channel * 17) % 101 - 50) / 1000.0::DOUBLE) AS activation FROM r CROSS JOIN (SELECT unnest(range(0, 200))::INT AS unit) WHERE (unit + channel) % 2 = 0 GROUP BY ALL)"""


@query("SELECT item, unit, round(activation, 8) AS activation FROM a", r=b.DENSE, a=_ACTIVATION)
def random_projection_fixed(s: Spark, d: str) -> DataFrame:
    return encoding.project(b.dense(s, d), _weights(s, d)).withColumn("activation", F.round("activation", 8))


@query("SELECT item, channel AS unit, response AS activation FROM r QUALIFY row_number() OVER (PARTITION BY item ORDER BY response DESC, channel) <= 3", r=b.DENSE)
def wta_sparsify(s: Spark, d: str) -> DataFrame:
    return encoding.winners(b.dense(s, d).select("item", F.col("channel").alias("unit"), F.col("response").alias("activation")), int(64 * 0.05))


@query("SELECT item, channel AS unit, response AS activation FROM r WHERE response > (SELECT quantile_cont(response, 0.95) FROM r)", r=b.DENSE)
def threshold_sparsify(s: Spark, d: str) -> DataFrame:
    return encoding.above(b.dense(s, d).select("item", F.col("channel").alias("unit"), F.col("response").alias("activation")))


@query("""SELECT count(*) AS n_items, avg(n) / 64 AS active_share, avg(n) AS mean_active, stddev_pop(n) AS std_active, round(sum(s1) / sum(n), 8) AS mean_value, round(sqrt(sum(s2) / sum(n) - (sum(s1) / sum(n)) ** 2), 8) AS std_value
    FROM (SELECT item, count(*) FILTER (response > 0) AS n, sum(response) FILTER (response > 0) AS s1, sum(response * response) FILTER (response > 0) AS s2 FROM r GROUP BY item)""", r=b.DENSE)  # fmt: skip
def sparsity_stats(s: Spark, d: str) -> DataFrame:
    code = b.dense(s, d).select("item", F.col("channel").alias("unit"), F.col("response").alias("activation"))
    return encoding.sparsity_statistics(code, 64).withColumns({c: F.round(c, 8) for c in ("mean_value", "std_value")})


def uniform_sql(keys: str, seed: int = 42) -> str:
    """encoding.uniform in SQL."""
    return f"((('0x' || substr(md5(concat_ws('|', {keys}, {seed})), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE)"


def normal_sql(keys: str, seed: int = 42) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(keys, seed)})) * cos(2 * pi() * {uniform_sql(keys, seed + 7919)}))"


_RANDOM = f"(SELECT channel, unit, {normal_sql('channel, unit', 43)} * 0.1 AS weight FROM (SELECT DISTINCT channel FROM r) CROSS JOIN (SELECT unnest(range(0, 400))::INT AS unit) WHERE {uniform_sql('channel, unit')} < 0.5)"


@query("SELECT item, unit, round(activation, 8) AS activation FROM (SELECT item, unit, sum(response * weight) AS activation FROM r JOIN w USING (channel) WHERE response != 0 GROUP BY item, unit) QUALIFY row_number() OVER (PARTITION BY item ORDER BY activation DESC, unit) <= 20", r=b.DENSE, w=_RANDOM)
def sparse_code(s: Spark, d: str) -> DataFrame:
    r = b.dense(s, d)
    return encoding.sparse_code(r, r.select("channel").distinct(), 400).withColumn("activation", F.round("activation", 8)).select("item", "unit", "activation")


_TOP5 = "(SELECT item, channel AS unit, response AS activation FROM r QUALIFY row_number() OVER (PARTITION BY item ORDER BY response DESC, channel) <= 5)"
_COUNTS = f"""(SELECT item, unit, count(*) FILTER (below) AS k FROM (SELECT item, unit, u, sum(exp(i * ln(activation * 100) - activation * 100 - lgamma(i + 1))) OVER (PARTITION BY item, unit ORDER BY i) < u AS below
    FROM (SELECT *, {uniform_sql('item, unit, 3')} AS u, unnest(range(0, (ceil(activation * 100 + 10 * sqrt(activation * 100) + 20))::INT + 1)) AS i FROM c WHERE activation > 0)) GROUP BY item, unit)"""


@query(f"""SELECT item, unit, 0 AS copy, round(activation, 8) AS activation FROM c UNION ALL SELECT item, unit, 1, round(CASE WHEN activation > 0 THEN greatest(activation + {normal_sql('item, unit, 1')} * 0.1, 0) ELSE activation END, 8) FROM c
    UNION ALL SELECT item, unit, 2, round(CASE WHEN activation > 0 AND {uniform_sql('item, unit, 2')} < 0.1 THEN 0 ELSE activation END, 8) FROM c
    UNION ALL SELECT item, unit, 3, round(CASE WHEN activation > 0 THEN k::DOUBLE / 100 ELSE activation END, 8) FROM c LEFT JOIN p USING (item, unit)""", r=b.DENSE, c=_TOP5, p=_COUNTS)  # fmt: skip
def augment(s: Spark, d: str) -> DataFrame:
    code = encoding.winners(b.dense(s, d).select("item", F.col("channel").alias("unit"), F.col("response").alias("activation")), 5)
    return encoding.augmented(code, 3).select("item", "unit", "copy", F.round("activation", 8).alias("activation"))


@query(f"SELECT item, label, row_number() OVER (ORDER BY h, item) <= floor(count(*) OVER () * 0.8::DOUBLE) AS train FROM (SELECT DISTINCT item, label, {uniform_sql('item')} AS h FROM r)", r=b.DENSE)
def split(s: Spark, d: str) -> DataFrame:
    return encoding.split(b.dense(s, d).select("item", "label").distinct())


@query("SELECT item, concentration, round(base + r_max * pow(concentration, n) / (pow(ec50, n) + pow(concentration, n)), 10) AS response FROM q", q=b.DOSES)
def hill_eval(s: Spark, d: str) -> DataFrame:
    return dose.evaluate(b.doses(s, d)).select("item", "concentration", F.round("response", 10).alias("response"))


def _mix(s: Spark, d: str) -> DataFrame:
    return b.doses(s, d).withColumn("mix", F.round(F.col("concentration") * 50).cast("int")).withColumn("component", F.col("item"))


_MIX = "(SELECT round(concentration * 50)::INT AS mix, base + r_max * pow(concentration, n) / (pow(ec50, n) + pow(concentration, n)) AS response FROM q)"


@query("SELECT mix, 'additive' AS kind, round(sum(response), 8) AS response FROM m GROUP BY mix UNION ALL SELECT mix, 'competitive', round(max(response), 8) FROM m GROUP BY mix UNION ALL SELECT mix, 'synergistic', round(sum(response) * (1 + 0.5 * count(*)), 8) FROM m GROUP BY mix", q=b.DOSES, m=_MIX)
def mixtures(s: Spark, d: str) -> DataFrame:
    every = [dose.mixture(_mix(s, d), k).select("mix", F.lit(k).alias("kind"), F.round("response", 8).alias("response")) for k in ("additive", "competitive", "synergistic")]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query("""SELECT item, i::INT AS step, round(base + r_max * pow(c, n) / (pow(ec50, n) + pow(c, n)), 8) AS response FROM (SELECT DISTINCT item, r_max, ec50, n, base FROM q) CROSS JOIN (SELECT i, pow(10, -3 + 3.0::DOUBLE * i / 9) AS c FROM (SELECT unnest(range(0, 10)) AS i))""", q=b.DOSES)
def dose_series(s: Spark, d: str) -> DataFrame:
    rows = dose.series(b.doses(s, d).select("item", "r_max", "ec50", "n", "base").distinct())
    return rows.select("item", F.round((F.log10("concentration") + 3) * 3).cast("int").alias("step"), F.round("response", 8).alias("response"))


@query()
def hill_fit(s: Spark, d: str) -> DataFrame:
    return dose.fit(dose.evaluate(b.doses(s, d)).select("item", "concentration", "response"))


@query("""SELECT p_brand AS channel FROM part INTERSECT SELECT p_brand FROM part WHERE p_size > 40""")
def set_intersect(s: Spark, d: str) -> DataFrame:
    p = b.table(s, d, "part")
    return p.select(F.col("p_brand").alias("channel")).intersect(p.filter("p_size > 40").select("p_brand"))


@query("SELECT DISTINCT p_name AS name FROM part EXCEPT SELECT p_name FROM part WHERE p_size < 25")
def set_except(s: Spark, d: str) -> DataFrame:
    p = b.table(s, d, "part")
    return p.select(F.col("p_name").alias("name")).subtract(p.filter("p_size < 25").select("p_name"))


@query("SELECT p_brand AS name FROM part UNION SELECT p_type FROM part")
def set_union_distinct(s: Spark, d: str) -> DataFrame:
    p = b.table(s, d, "part")
    return p.select(F.col("p_brand").alias("name")).union(p.select("p_type")).distinct()


@query("""SELECT channel, region, row_ord FROM (SELECT channel, region, row_ord, 0 AS prio FROM m UNION ALL SELECT channel, lower(region), row_ord, 1 FROM m WHERE row_ord % 3 = 0) QUALIFY row_number() OVER (PARTITION BY channel ORDER BY prio DESC, row_ord DESC) = 1""", m=b.MAPPING)
def upsert_mapping(s: Spark, d: str) -> DataFrame:
    m = b.mapping(s, d)
    return names.upsert(m, m.filter("row_ord % 3 = 0").withColumn("region", F.lower("region")), "channel")
