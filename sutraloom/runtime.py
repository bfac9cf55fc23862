"""Session helpers shared by every operator: table reading, durable lineage cuts, checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that a driver-side or broadcast lookup may hold; callers pass their own bound where it differs.
LOOKUP_ROWS = 200_000


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the session's Python workers, once per application: they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sutraloom-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))  # the driver serves it to the executors
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data folder."""
    ship_package(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Bytes of files from which a table is worth dealing to all cores.
SPREAD_BYTES = 256_000


def spread(df: DataFrame) -> DataFrame:
    """A scanned table dealt to as many tasks as there are cores, if its files make fewer: the work on texts costs far
    more than moving a small table once. Tables of many files, as on a cluster, stay as they are read."""
    plan = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) < SPREAD_BYTES or plan.executedPlan().execute().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names, else (single-machine sessions only) a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if named:
        sc.setCheckpointDir(named)
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="sutraloom-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it read back; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_position(ordered: DataFrame, name: str) -> DataFrame:
    """Rows of an ordered table with their position from 0: counted inside each partition, after the sizes of the
    partitions before it (one number for each). The table should give the same partitions when it is read again."""
    at = fresh_name(ordered, "_at")
    rows = ordered.withColumn(at, F.monotonically_increasing_id())
    sizes = {r["part"]: r["n"] for r in rows.groupBy(F.shiftright(at, 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(sizes):
        starts += [F.lit(part), F.lit(total)]
        total += sizes[part]
    start = F.element_at(F.create_map(*starts), F.shiftright(at, 33)) if starts else F.lit(0)
    return rows.withColumn(name, start + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at)


def collect_bounded(df: DataFrame, limit: int = LOOKUP_ROWS, what: str = "lookup") -> list:
    """Rows of a table whose size is bounded by its meaning; raises where the bound does not hold."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows; it is not a bounded lookup")
    return rows


def attach(df: DataFrame, key: str, side: DataFrame, side_key: str, spread: str, limit: int = LOOKUP_ROWS, salts: int = 64) -> DataFrame:
    """df left-joined with a side that has one row per key. The side is written once and counted: up to `limit` rows it
    is broadcast; beyond, it is copied to each of `salts`, over which a hash of the column `spread` deals df's rows, so
    that a key with a third of them is no single task. Null keys match nothing."""
    side = cut_lineage(side)
    if side.count() <= limit:
        return df.join(F.broadcast(side), df[key] == side[side_key], "left")
    salt, at = fresh_name(df, "_salt"), fresh_name(df, "_at")
    copies = side.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = df.withColumn(at, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return dealt.join(copies, (dealt[key] == copies[side_key]) & (F.col(at) == F.col(salt)), "left").drop(salt, at)


def map_columns(
    df: DataFrame, kernel: Callable[[dict[str, list]], dict[str, list]], schema: StructType | str
) -> DataFrame:
    """Arrow batches as column lists through kernel; the kernel gets and returns {column: list}."""
    spark = df.sparkSession
    ship_package(spark)
    out = schema if isinstance(schema, StructType) else _parse(spark, schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = kernel({n: batch.column(i).to_pylist() for i, n in enumerate(names)})
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def _parse(spark: SparkSession, ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    name, taken = stem, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def nonblank(col) -> "F.Column":
    return col.isNotNull() & F.regexp_like(col, F.lit(r"\S"))
