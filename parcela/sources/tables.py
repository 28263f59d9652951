"""Reading raw files under their contract, and writing results. Paths go through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcela.contract import BENCHMARK_FIELDS, ContractError
from parcela.sources import versions

LOG_SCHEMA = "ts timestamp, event string, path string, status int, latency_ms double, run_id string, spot_id long, n int, spot_ids string"


def read_csv_contract(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """All columns as text. The header must be the contract's, in its order. `path` may be a folder of part files."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").option("encoding", "UTF-8").csv(path)
    if tuple(df.columns) != tuple(columns):
        missing, extra = sorted({*columns} - {*df.columns}), sorted({*df.columns} - {*columns})
        raise ContractError(f"{path}: the header differs. Missing: {missing}. Extra: {extra}. Order expected: {list(columns)}")
    return df


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Graded judgements; a cell that isn't an integer, or a pair with two grades, aborts. A repeated row counts once."""
    raw = read_csv_contract(spark, path, tuple(n for n, _ in BENCHMARK_FIELDS))
    typed = raw.select(*[F.col(n).try_cast(t).alias(n) for n, t in BENCHMARK_FIELDS])
    bad = raw.select(*[F.col(n).try_cast(t).isNull().alias(n) for n, t in BENCHMARK_FIELDS], F.to_json(F.struct("*")).alias("row")).where(" or ".join(n for n, _ in BENCHMARK_FIELDS)).select("row").take(3)
    if bad:
        raise ContractError(f"{path}: cells that aren't integers: {[r[0] for r in bad]}")
    out = typed.distinct()
    twice = out.groupBy("spot_id", "recommended_spot_id").count().where("count > 1").take(3)
    if twice:
        raise ContractError(f"{path}: pairs with several grades: {twice}")
    return out


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    """Answered recommendation requests of a log of JSON lines."""
    return answered(spark.read.schema(LOG_SCHEMA).json(path))


def answered(log: DataFrame) -> DataFrame:
    return log.where("event = 'request' and status = 200 and spot_id is not null")


def file_digests(spark: SparkSession, path: str, most_bytes: int = 1 << 30) -> DataFrame:
    """MD5 of each file's bytes, taken on the executors. A file is one value there, so larger ones are refused."""
    files = spark.read.format("binaryFile").load(path)
    large = files.where(F.col("length") > most_bytes).select("path").take(3)
    if large:
        raise ContractError(f"files of more than {most_bytes} bytes: {[r[0] for r in large]}")
    return files.select("path", "length", F.md5("content").alias("md5"))


def write_run(df: DataFrame, root: str, run_id: str, name: str) -> str:
    """A run's own folder, overwritten when the run is repeated; its path is the version."""
    path = f"{root}/runs/{run_id}/{name}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_feature_table(df: DataFrame, root: str, schema: T.StructType, since: int | None = None) -> int:
    """A new version of the feature table below `root`, by its contract (columns by position, names and types must agree); its number. Earlier versions stay."""
    mine = [(f.name, f.dataType) for f in df.schema]
    if mine != [(f.name, f.dataType) for f in schema]:
        raise ContractError(f"the feature table's columns are {mine}")
    return versions.commit(df, f"{root}/features", since)


def snapshot(spark: SparkSession, root: str, run_id: str, version: int | None = None) -> int:
    """A run's own copy of a version of the feature table (else the newest), overwritten when the run is repeated; the version it is of."""
    version = versions.manifest(spark, f"{root}/features", version)["version"]
    write_run(versions.read(spark, f"{root}/features", version), root, run_id, "snapshot")
    return version


def write_scores_csv(df: DataFrame, root: str, run_id: str, name: str) -> str:
    """With a header; null becomes empty."""
    path = f"{root}/runs/{run_id}/{name}"
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)
    return path


def keyed(rows: DataFrame) -> DataFrame:
    """As key-value rows: the key is the JSON list of the id."""
    return rows.select(F.concat(F.lit("["), F.col("spot_id").cast("string"), F.lit("]")).alias("key"), *[c for c in rows.columns if c != "spot_id"])


def published(old: DataFrame, new: DataFrame) -> DataFrame:
    """What an upsert by spot_id makes of key-value rows. Publishing twice changes nothing."""
    rows = keyed(new)
    return old.join(rows, "key", "left_anti").unionByName(rows)


def publish(new: DataFrame, root: str, since: int | None = None) -> int:
    """Upserts rows by spot_id into the key-value table below `root`; its new version. A reader sees the old one whole or the new one whole."""
    return versions.upsert(keyed(new), f"{root}/online", "key", since=since)


def online(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    return versions.read(spark, f"{root}/online", version)
