"""Tables with versions, and upserts by key, as folders of Parquet files with one small manifest for each version.

A version's manifest names the folders that make it up and is put in place last, by a rename that doesn't replace anything. So a writer that dies half way leaves files
that no version names, readers of an older version keep theirs, and of two writers that began from the same version one is refused. The rename must be atomic, as it is
in HDFS and in local file systems.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parcela.contract import ContractError

MANIFESTS = "_versions"
#: Buckets that keyed rows are dealt into: what an upsert rewrites is whole buckets.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has made the version meanwhile."""


def system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, where = system(spark, f"{root}/{MANIFESTS}")
    if not fs.exists(where):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """That of a version, else of the newest; without any, version 0 with no parts."""
    have = versions(spark, root)
    if version is None and not have:
        return {"version": 0, "parts": {}}
    if version is not None and version not in have:
        raise ContractError(f"{root} has no version {version}")
    text = spark.read.text(f"{root}/{MANIFESTS}/{have[-1] if version is None else version:012d}.json", wholetext=True).first()[0]
    return json.loads(text)


def put(spark: SparkSession, root: str, told: dict) -> int:
    """Puts a manifest in place as the version it names; raises Conflict if that one is there."""
    fs, to = system(spark, f"{root}/{MANIFESTS}/{told['version']:012d}.json")
    _, own = system(spark, f"{root}/{MANIFESTS}/.{uuid4().hex}")
    out = fs.create(own, False)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    if fs.exists(to) or not fs.rename(own, to):
        fs.delete(own, False)
        raise Conflict(f"{root}: version {told['version']} is there already")
    return told["version"]


def commit(df: DataFrame, root: str, since: int | None = None) -> int:
    """Writes df as the table's next version and returns its number. since: the version that the writer began from (the newest, if none is named)."""
    spark = df.sparkSession
    since = manifest(spark, root)["version"] if since is None else since
    part = f"data/{uuid4().hex}"
    df.write.parquet(f"{root}/{part}")
    return put(spark, root, {"version": since + 1, "parts": {"": part}, "schema": df.schema.json()})


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version's rows, else the newest's."""
    told = manifest(spark, root, version)
    if not told["version"]:
        raise ContractError(f"{root} has no version")
    return _rows(spark, root, told, [*told["parts"]]).drop("_bucket")


def _rows(spark: SparkSession, root: str, told: dict, parts: list[str]) -> DataFrame:
    schema = StructType.fromJson(json.loads(told["schema"]))
    folders = [f"{root}/{told['parts'][p]}" for p in parts]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert(new: DataFrame, root: str, key: str, buckets: int = BUCKETS, since: int | None = None) -> int:
    """Makes a version in which the rows of `new` replace those of the same key or are added; returns its number. Doing so again changes no row.

    Rows are dealt into buckets by their key. Only buckets that `new` touches are read and rewritten; the version takes the others as they are. Keys that repeat or are null are refused.
    """
    spark = new.sparkSession
    told = manifest(spark, root, since)
    buckets = told.get("buckets", buckets)
    twice = new.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).take(3)
    if twice:
        raise ContractError(f"keys that repeat or are null: {[r[0] for r in twice]}")
    rows = new.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    if told["version"] and StructType.fromJson(json.loads(told["schema"])).simpleString() != rows.schema.simpleString():
        raise ContractError(f"{root} has other columns")
    touched = [str(r[0]) for r in rows.select("_bucket").distinct().collect()]  # as many as buckets
    old = [b for b in touched if b in told["parts"]]
    kept = _rows(spark, root, told, old).join(rows.select(key), key, "left_anti").select(*rows.columns) if old else None
    whole = rows if kept is None else kept.unionByName(rows)
    part = f"data/{uuid4().hex}"
    dealt = whole.repartition("_bucket").withColumn("bucket", F.col("_bucket"))
    dealt.write.partitionBy("bucket").parquet(f"{root}/{part}")
    parts = told["parts"] | {b: f"{part}/bucket={b}" for b in touched}
    return put(spark, root, {"version": told["version"] + 1, "parts": parts, "schema": rows.schema.json(), "buckets": buckets})
