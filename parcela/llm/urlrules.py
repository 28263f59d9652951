"""URL rules by a sort-merge range join, DataFrame functions only.

A rule is a host and a path prefix; it fits that host and all its subdomains, where the url's
path starts with the rule's. The canonical key of a host and a path is the host's labels in
reverse order, a byte 01 and the path; the keys that a rule fits below one host form one
interval of the sorted keys. A url has a key for each suffix of its host (as many as labels),
so subdomains are met as well. Rules' intervals are either nested or apart.

Places where an interval begins or ends and the urls' keys are sorted together and swept. The sweep keeps a
stack: a beginning is pushed, an end pops it, so the running sum of +1 and -1 is the stack's height, and what
lies at a height is the last rule that was pushed to it. A key's rule is that at the height at the key.

The sweep is dealt into ranges of keys by sampled splitters; each range begins with the stack that the ranges
before leave, so the sweeps are independent, and a key that very many urls have is spread over ranges.

Defined cases: a null url or one without `://` has an empty host and path, which no rule fits;
of the rules with the same host and path, block wins over allow; null rules and an empty host
are left out; without rules every verdict is the default; an empty table gives no rows; rows that repeat are
each judged; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcela.llm.common import ascii_lower, cut
from parcela.llm.splitters import RANGE, ranged, with_before

#: Keys to which a range is aimed, and ranges of the sweep at least.
RANGE_KEYS, RANGES = 500_000, 32
LINE = ["at", "kind", "tie"]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """host, path, verdict of few rules, as literals."""
    rows = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("host", "path", "verdict"), strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Of a url: what lies between the first :// and /, ?, # or the end, A-Z in lower case; then up to ? or #."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return ascii_lower(host), path


def key(host: Column, path: Column) -> Column:
    """Bytes, so that they sort unsigned: reversed labels, 01, path."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("\x01"), path).cast("binary")


def places(rules: DataFrame) -> DataFrame:
    """at (key), kind (0: an interval ends, 1: one begins), up (-1 or 1), rule, verdict."""
    one = (
        rules.where("host <> '' and path is not null and verdict is not null")
        .groupBy(ascii_lower(F.col("host")).alias("host"), "path")
        .agg(F.max("verdict").alias("verdict"))  # block sorts after allow
        .select(key(F.col("host"), F.col("path")).alias("k"), F.concat("host", "path").alias("rule"), "verdict")
    )
    # No key holds a byte FF, so all keys that begin with k lie before k FF. The end of an outer rule sorts after those of inner ones, as it is a shorter key with FF behind.
    both = F.array(F.struct(F.col("k").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("up")), F.struct(F.concat("k", F.unhex(F.lit("FF"))).alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("up")))
    return one.select(F.inline(both), "rule", "verdict")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of each page; rules: host, path, verdict (block or allow). The longest fitting rule wins."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    none = F.lit(None).cast("string")
    asked = urls.where("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    keys = asked.select(key(F.col("suffix"), F.col("path")).alias("at"), F.lit(2).alias("kind"), F.lit(0).alias("up"), none.alias("rule"), none.alias("verdict"), F.xxhash64("host", "path").alias("tie"), "host", "path")
    line = cut(keys.unionByName(places(rules).select("*", F.lit(0).cast("long").alias("tie"), none.alias("host"), none.alias("path"))))
    n = line.count()
    ranges = max(RANGES, -(-n // RANGE_KEYS))
    dealt = ranged(line, LINE, F.lit(ranges / max(n, 1)), ranges)

    # The stack with which each range begins: of each height the last rule that was pushed to it in the ranges before.
    starts = with_before(dealt.groupBy(*RANGE).agg(F.sum("up").alias("net")), "net", "height").select(*RANGE, "height")
    inside = Window.partitionBy(*RANGE).orderBy(*LINE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = dealt.where("kind < 2").join(starts, RANGE).withColumn("height", F.col("height") + F.sum("up").over(inside))
    pushed = marks.where("up = 1").groupBy(*RANGE, "height").agg(F.max(F.struct("at", "rule", "verdict")).alias("m"))
    wanted = starts.where("height > 0").select(*RANGE, F.explode(F.sequence(F.lit(1).cast("long"), "height")).alias("height"), F.lit(None).cast(pushed.schema["m"].dataType).alias("m"), F.lit(0).alias("own"))
    so_far = Window.partitionBy("height").orderBy(*RANGE, "own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stack = wanted.unionByName(pushed.withColumn("own", F.lit(1))).withColumn("m", F.last("m", ignorenulls=True).over(so_far)).where("own = 0")
    carried = stack.select(*RANGE, F.lit(b"").cast("binary").alias("at"), F.lit(-1).alias("kind"), F.lit(1).alias("up"), F.col("m.rule").alias("rule"), F.col("m.verdict").alias("verdict"), F.col("height").alias("tie"), none.alias("host"), none.alias("path"))

    swept = dealt.unionByName(carried).withColumn("height", F.sum("up").over(inside))
    level = Window.partitionBy(*RANGE, "height").orderBy(*LINE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.last(F.when(F.col("up") == 1, F.struct("rule", "verdict")), ignorenulls=True).over(level)
    best = swept.withColumn("top", top).where("kind = 2 and height > 0").groupBy("host", "path").agg(F.max(F.struct(F.length("top.rule").alias("n"), F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict"))).alias("b"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
