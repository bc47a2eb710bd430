"""URL rules matched by hashed host-suffix and path-prefix expressions.

Each URL is expanded into expressions: its host and the suffixes of it that
start after a dot, each with prefixes of its path. Expressions meet rules in an
equi-join on a short hash prefix; the full digest then confirms a match. Only
lengths that some rule has are expanded, so that hosts with thousands of labels
and paths of any length stay cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.scratch import masked, unmasked, without

#: Bytes of the digest that the join compares first.
PREFIX_BYTES = 4
#: Parts that pages without a host are spread over.
SPREAD = 1024
#: Rules that may be broadcast, about 100 bytes each.
BROADCAST_RULES = 100_000
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z in lower case; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_substr(rest, F.lit(r"^[^/?#]+"))
    ascii_lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.instr(url, "://") > 0, F.coalesce(ascii_lower, F.lit(""))).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.coalesce(path, F.lit(""))).otherwise("")


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def url_filter(pages: DataFrame, rules: DataFrame | None = None, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every page.

    A rule (host, path, verdict) fits its host and all its subdomains if the
    URL's path starts with the rule's path. The longest rule (host and path
    together) wins; of equally long ones the one with the longer host, then
    block. Repeated rules count once; rules with a null are left out. Pages
    without a fitting rule, null URLs among them, get the default and a null
    rule. Equal URLs get equal verdicts, each row its own. Input columns named
    like an output are replaced.
    """
    pages = without(pages, "host", "path", "rule", "verdict")
    rules = rules if rules is not None else default_rules(pages.sparkSession)
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    lengths = rules.agg(F.collect_set(F.length("host")).alias("hosts"), F.collect_set(F.length("path")).alias("paths"), F.count(F.lit(1)).alias("n")).first()
    rows, names = masked(pages)
    h, p = "_host", "_path"
    parts = rows.withColumn(h, host_of(F.col(names[url]))).withColumn(p, path_of(F.col(names[url])))
    # One set of expressions per distinct host and path.
    urls = parts.select(F.col(h).alias("_h"), F.col(p).alias("_p")).distinct()
    ints = lambda xs: F.array(*[F.lit(x) for x in sorted(xs)]).cast("array<int>")
    host, path = F.col("_h"), F.col("_p")
    at_dot = lambda n: (n == F.length(host)) | ((n < F.length(host)) & (F.substring(host, F.length(host) - n, F.lit(1)) == "."))
    suffixes = F.transform(F.filter(ints(lengths["hosts"]), at_dot), lambda n: F.substring(host, F.length(host) - n + 1, n))
    prefixes = F.transform(F.filter(ints(lengths["paths"]), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda q: _digest(s, q))))
    asked = urls.select("_h", "_p", F.explode(expressions).alias("_d"))
    asked = asked.withColumn("_short", F.substring("_d", 1, 2 * PREFIX_BYTES))
    known = rules.select(F.col("host").alias("_rh"), F.concat("host", "path").alias("_rule"), F.col("verdict").alias("_v"), _digest(F.col("host"), F.col("path")).alias("_rd"))
    known = known.withColumn("_rs", F.substring("_rd", 1, 2 * PREFIX_BYTES))
    if lengths["n"] <= BROADCAST_RULES:
        known = F.broadcast(known)
    # The join is on the prefix alone; digests are compared as a condition that is no key, like rule and URL that met by chance.
    hits = asked.join(known, (F.col("_short") == F.col("_rs")) & F.startswith("_d", F.col("_rd")))
    rank = F.struct(F.length("_rule").alias("a"), F.length("_rh").alias("b"), (F.col("_v") == "block").alias("c"), F.col("_rule").alias("d"))
    best = hits.groupBy("_h", "_p").agg(F.max_by(F.struct("_rule", "_v"), rank).alias("_best"))
    # Pages without a host and a path, null URLs among them, meet no rule unless one has an empty host: they are spread.
    nowhere = (F.col(h) == "") & (F.col(p) == "") & F.lit(0 not in (lengths["hosts"] or []))
    parts = parts.withColumn("_spread", F.when(nowhere, 1 + F.monotonically_increasing_id() % SPREAD).otherwise(0))
    result = parts.join(best.withColumn("_at", F.lit(0)), (F.col(h) == F.col("_h")) & (F.col(p) == F.col("_p")) & (F.col("_spread") == F.col("_at")), "left")
    return result.select(
        *unmasked(names),
        F.col(h).alias("host"),
        F.col(p).alias("path"),
        F.col("_best._rule").alias("rule"),
        F.coalesce("_best._v", F.lit(default)).alias("verdict"),
    )
