"""Readers of response matrices, item metadata, connections, labels and name tables.

All paths go through Spark's readers, so they may be in any store that it knows. Lines are numbered by a file's name
and the line's place in it (row_ord), since precedence rules depend on order.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numeric import number
from ..operators.network import by_strength, by_types
from ..operators.ranges import running
from . import npy, rdata
from .tables import written
from ..schemas import ALIAS_FILE, PATHWAY_FILE, PATHWAY_NAMES, REGION_MATRIX_FILE

FORMATS = ("parquet", "csv", "npy")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def numbered(df: DataFrame) -> DataFrame:
    """df with row_ord: a number that grows along the input's splits and their lines."""
    return df.withColumn("row_ord", F.monotonically_increasing_id())


def long_form(wide: DataFrame, key: str, channels: list[str] | None = None) -> DataFrame:
    """(item, channel, channel_ord, response) of a matrix with one row an item; what is no number is null."""
    channels = channels or [c for c in wide.columns if c != key]
    cells = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(i).alias("channel_ord"), number(F.col(f"`{c}`")).alias("response")) for i, c in enumerate(channels)])
    return wide.select(F.col(f"`{key}`").cast("string").alias("item"), F.inline(cells))


def transposed(response: DataFrame) -> DataFrame:
    """Items and channels in each other's place."""
    return response.select(F.col("channel").alias("item"), F.col("item").alias("channel"), "response")


def load_response(spark: SparkSession, path: str, format: str = "parquet", key: str | None = None, names: tuple[str, str] | None = None) -> DataFrame:
    """A response matrix in long form. The key is the first column by default.

    npy files (one, or a folder of shards) have no names, so `names` gives the paths of the items' and the channels' index files (CSV, one column);
    they were written with 0 for missing cells.
    """
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}; one of {', '.join(FORMATS)}")
    if format == "npy":
        return _load_npy(spark, path, names)
    wide = spark.read.parquet(path) if format == "parquet" else spark.read.csv(path, header=True)
    key = key or next((c for c in wide.columns if c.lower() in ("inchikey", "rownames", "__index_level_0__")), wide.columns[0])
    return long_form(wide, key)


def _load_npy(spark: SparkSession, path: str, names: tuple[str, str]) -> DataFrame:
    items = numbered(spark.read.csv(names[0], header=True)).withColumn("one", F.lit(1))
    items = running(items, [], ["row_ord"], "one", "row").select(F.col(items.columns[0]).alias("item"), "row")
    channels = [r[0] for r in spark.read.csv(names[1], header=True).collect()]  # a dimension: the matrix's width
    rows = npy.registered(spark).read.format("npy").load(path).join(items, "row")
    cells = rows.select("item", F.posexplode("vector").alias("channel_ord", "response"))
    return cells.select("item", F.get(F.array(*map(F.lit, channels)).cast("array<string>"), F.col("channel_ord")).alias("channel"), "channel_ord", "response").filter("channel is not null")


def load_matrix_by_channel(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A matrix with channels for rows, or with items for rows when it has more rows than columns, in long form with channels as channels."""
    response = load_response(spark, path, format)
    n = response.agg(F.countDistinct("item").alias("rows"), F.countDistinct("channel").alias("columns")).first()
    return response.drop("channel_ord") if n.rows > n.columns else transposed(response)


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Item metadata with its key named `item`; synonyms as an array."""
    own = spark.read.parquet(path)
    key = next((c for c in own.columns if c.lower() == "inchikey"), own.columns[0])
    own = own.withColumnRenamed(key, "item").toDF(*[c if c == "item" else c.lower() for c in own.withColumnRenamed(key, "item").columns])
    return own.withColumn("synonyms", F.filter(F.transform(F.split("synonyms", ";"), lambda x: F.trim(x)), lambda x: x != "")) if "synonyms" in own.columns else own


#: Names of the objects: the response matrix, raw responses, items, and the map under any of its names.
RDATA = {"response": ("response.matrix",), "raw": ("response.matrix_non.normalized",), "items": ("odor",), "map": ("AL.map", "ALmap", "al.map")}


def load_rdata(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The known objects of an R data file by their kind, each a DataFrame with its row names. The response matrix has to be there; the others may be absent."""
    objects = rdata.tables(spark, path)
    found = {kind: next((objects[n] for n in names if n in objects), None) for kind, names in RDATA.items()}
    if found["response"] is None:
        raise ValueError(f"{path} has no response matrix")
    return {kind: table for kind, table in found.items() if table is not None}


def typed_csv(spark: SparkSession, path: str, schema: StructType, extra: tuple[str, ...] = ()) -> DataFrame:
    """A CSV file with a header, its columns by name and typed; a missing column or an unreadable value is an error."""
    names = spark.read.csv(path, header=True).columns
    if missing := [c for c in schema.names if c not in names]:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    types = {f.name: f.dataType for f in schema}
    full = StructType()
    for c in names:
        full.add(c, types.get(c, "string"))
    own = spark.read.csv(path, header=True, schema=full, mode="FAILFAST")
    return own.select(*schema.names, *[c for c in extra if c in names])


def load_pathways(spark: SparkSession, path: str, config=None) -> DataFrame:
    """Connections under this library's names, with row_ord, filtered by a NetworkConfig if given."""
    own = numbered(typed_csv(spark, path, PATHWAY_FILE, ("pathway_type",))).withColumnsRenamed(PATHWAY_NAMES)
    return own if config is None else filtered(own, config)


def filtered(pathways: DataFrame, config) -> DataFrame:
    own = by_strength(pathways, config.min_synapses, config.max_synapses)
    return by_types(own, config.lateral, config.inhibitory_to_relay, config.relay)


def load_pathway_files(spark: SparkSession, paths: dict[str, str], config=None) -> DataFrame:
    """The connections of several files, each tagged with its pathway_type. A file that fails is left out with a warning; if all do, that is an error."""
    found = []
    for kind, path in paths.items():
        try:  # written, since a bad value is met only when its line is read
            found.append(written(load_pathways(spark, path, config).withColumn("pathway_type", F.lit(kind)), "pathways"))
        except Exception as e:  # any reader's error
            warnings.warn(f"{path} is left out: {e}", stacklevel=2)
    if not found:
        raise ValueError("no file of connections could be read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def load_region_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight) without rows that lack any of them."""
    return typed_csv(spark, path, REGION_MATRIX_FILE).na.drop("any").toDF("src", "dst", "weight")


# Other names of the label table's columns, the first one found counts.
LABEL_COLUMNS = {"root_id": ("root_id", "pt_root_id"), "label": ("label", "tag", "cell_type", "processed_labels"), "supervoxel_id": ("supervoxel_id", "pt_supervoxel_id"), "x": ("position_x", "pt_position_x"), "y": ("position_y", "pt_position_y"), "z": ("position_z", "pt_position_z")}


def load_labels(spark: SparkSession, path: str, spread: int | None = None) -> DataFrame:
    """Labels of cells from CSV or gzipped CSV. A gzipped file is one task's to read; `spread` deals its rows to so many partitions."""
    raw = spark.read.csv(path, header=True, multiLine=False, escape='"')
    pick = {own: next((c for c in names if c in raw.columns), None) for own, names in LABEL_COLUMNS.items()}
    if pick["root_id"] is None or pick["label"] is None:
        raise ValueError(f"{path} has no column of root ids or of labels")
    columns = [(F.col(c) if c else F.lit(None)).alias(own) for own, c in pick.items()]
    out = raw.select(*columns).withColumns({c: number(F.col(c)) for c in "xyz"} | {"root_id": F.col("root_id").cast("string"), "supervoxel_id": F.col("supervoxel_id").cast("string")})
    return out if spread is None else out.repartition(spread)


def load_mapping(spark: SparkSession, candidates: list[str], channel: str | None = None, region: str | None = None) -> DataFrame:
    """(channel, region, ..., row_ord) from the first of the files that exists; by default their first two columns are the channel and its region."""
    for at in candidates:
        if exists(spark, at):
            own = spark.read.csv(at, header=True)
            named = (channel or own.columns[0], region or own.columns[1])
            if missing := [c for c in named if c not in own.columns]:
                raise ValueError(f"{at} lacks the columns {', '.join(missing)}")
            return numbered(own).withColumnsRenamed(dict(zip(named, ("channel", "region"))))
    raise FileNotFoundError(f"none of {', '.join(candidates)} exists")


def load_aliases(spark: SparkSession, candidates: list[str]) -> DataFrame:
    """(key, name, synonyms, row_ord) from the first of the files that exists; an empty name is the key itself."""
    for at in candidates:
        if exists(spark, at):
            own = numbered(typed_csv(spark, at, ALIAS_FILE))
            name = F.coalesce(F.nullif(F.trim("common_name"), F.lit("")), F.col("inchikey"))
            return own.select(F.col("inchikey").alias("key"), name.alias("name"), F.translate(F.coalesce("alternative_names", F.lit("")), ",", ";").alias("synonyms"), "row_ord")
    raise FileNotFoundError(f"none of {', '.join(candidates)} exists")


def alias_skeleton(response: DataFrame) -> DataFrame:
    """A table of names to fill in: every item is its own name."""
    return response.select("item").distinct().filter("item != 'rownames'").select(F.col("item").alias("common_name"), F.col("item").alias("inchikey"), F.lit("").alias("alternative_names"))


def missing_files(spark: SparkSession, folder: str, names: dict[str, str]) -> dict[str, bool]:
    """Kind of file -> whether the folder has it."""
    return {kind: exists(spark, f"{folder}/{name}") for kind, name in names.items()}


def cache_is_whole(spark: SparkSession, folder: str) -> bool:
    """Whether a written cache has its tables and they can be read."""
    try:
        return not spark.read.parquet(f"{folder}/response").isEmpty() and bool(spark.read.parquet(f"{folder}/metadata").columns)
    except Exception:  # any reader's error means that it can't be used
        return False
