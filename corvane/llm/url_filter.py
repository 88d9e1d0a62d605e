"""URL block and allow lists by host-suffix and path-prefix expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import LOWER, UPPER

#: Rules of the registered query: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``; both are empty for a null url or one without ``://``."""
    u = F.col(url).cast("string")
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(CAST({url} AS STRING), instr(CAST({url} AS STRING), '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    bare = F.regexp_extract(rest, r"(?s)^[^?#]*", 0)
    host = F.regexp_extract(bare, r"(?s)^[^/]*", 0)
    return df.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", F.regexp_extract(bare, r"(?s)^[^/]*(.*)$", 1))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    default: str = "allow",
    prefix_bytes: int = 4,
    max_broadcast_rules: int = 100_000,
) -> DataFrame:
    """``(page_id, url, host, path, rule, verdict)`` for each row of ``pages(page_id, url)``.

    A rule is a host and a path, split at the first ``/`` of its text.  It fits its host and all
    subdomains if the url's path starts with its path; the longest rule wins, then one with the longer
    host, then ``block``, then code-point order.  Without a rule: ``rule`` is null, ``verdict`` the ``default``.

    A url is expanded into host suffix + path prefix for the shapes (labels of the host, characters of the path)
    that rules have, so a long url makes no more expressions than a short one.  Expressions and rules meet on the first
    ``prefix_bytes`` bytes of their SHA-256; full digests confirm.  Up to ``max_broadcast_rules`` rules
    are broadcast; more are joined by a shuffle, whose hot prefixes Spark splits.  Only urls that a rule
    fits are gathered by page; each leaves its task as one best rule.

    Rows with one page_id are judged apart by url; repeated rows come out as often as they went in.
    """
    spark = pages.sparkSession
    table = spark.createDataFrame([(v, r, r.split("/", 1)[0], "/" + r.split("/", 1)[1]) for v, r in dict.fromkeys(rules)], "verdict string, rule string, rhost string, rpath string")
    digest = lambda x: F.unhex(F.sha2(x, 256))
    table = table.select("verdict", "rule", "rhost", digest("rule").alias("digest"))
    table = table.withColumn("short", F.substring("digest", 1, prefix_bytes))
    shapes = sorted({(r.split("/", 1)[0].count(".") + 1, len(r.split("/", 1)[1]) + 1) for _, r in rules})

    urls = split_url(pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")))
    counted = urls.groupBy("page_id", "url", "host", "path").agg(F.count("*").alias("copies"))
    exprs = [
        F.when(
            (F.size(F.split("host", r"\.")) >= labels) & (F.length("path") >= chars),
            F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, chars)),
        )
        for labels, chars in shapes
    ]
    table = F.broadcast(table) if len(rules) <= max_broadcast_rules else table
    asked = counted.select("page_id", "url", "host", "path", "copies", F.explode(F.array_compact(F.array(F.lit(""), *exprs))).alias("expr"))
    asked = asked.withColumn("full", digest("expr")).withColumn("start", F.substring("full", 1, prefix_bytes))
    met = asked.join(table, (F.col("start") == F.col("short")) & (F.col("full") == F.col("digest")), "left").where("expr = '' OR rule IS NOT NULL")
    rank = F.when(F.col("rule").isNotNull(), F.struct(-F.length("rule"), -F.length("rhost"), (F.col("verdict") != "block"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict")))
    best = met.groupBy("page_id", "url", "host", "path", "copies").agg(F.min(rank).alias("best"))
    return best.select(
        "page_id",
        "url",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.expr("sequence(1L, copies)")).alias("copy"),
    ).drop("copy")
