"""URL rules by host suffix and path prefix, found through short hashes and confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict). A rule fits its host and all subdomains where the path starts with the rule's.
BASE_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: The method's own rules, for addresses that no rule above fits. A host of ``~`` and a word fits every host in which the word
#: stands by itself between dots and hyphens; the other hosts are names reserved for tests, and path prefixes of server tools.
OWN_RULES = (
    *(("~" + word, "", "block") for word in ("spam", "casino", "pills", "porn", "malware", "phishing", "viagra", "xxx")),
    ("invalid", "", "block"), ("localhost", "", "block"), ("test", "", "block"),
    ("", "/cgi-bin/", "block"), ("", "/wp-admin/", "block"), ("", "/wp-login.php", "block"),
)
#: Rule tables up to this many rows (digest, verdict and text of one rule: below 10 KB) are broadcast, larger ones shuffled.
BROADCAST_RULES = 10_000
#: Parts over which the addresses of one host and path meet their verdict.
SALTS = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules=BASE_RULES, own=OWN_RULES) -> DataFrame:
    """``host``, ``path``, ``verdict``, ``named``: whether the rule is reported and comes before all that are not."""
    return spark.createDataFrame([(*r, True) for r in rules] + [(*r, False) for r in own], "host string, path string, verdict string, named boolean")


def _expressions(lengths: list[int], labels: int) -> Column:
    """(host expression, path prefix) pairs of a ``host`` and the ``start`` of a path: suffixes of up to ``labels`` labels, and words."""
    parts = F.split("host", r"\.")
    keep = F.slice(parts, F.greatest(F.size(parts) - labels + 1, F.lit(1)), labels) if labels else F.expr("cast(array() as array<string>)")
    ends = F.transform(keep, lambda _, i: F.array_join(F.slice(keep, i + 1, labels or 1), "."))
    suffixes = F.array_distinct(F.concat(F.array(F.lit("")), ends))
    prefixes = F.array_distinct(F.array(*(F.substring("start", 1, n) for n in lengths)))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("suffix"), p.alias("prefix")))))
    words = F.array_distinct(F.split("host", "[.-]"))
    return F.concat(pairs, F.transform(words, lambda w: F.struct(F.concat(F.lit("~"), w).alias("suffix"), F.lit("").alias("prefix"))))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of ``pages``: ``id``, ``host``, ``path``, ``rule``, ``verdict``.

    Every distinct (host, path) is expanded into its host suffixes, no longer than the longest rule's, and, for each length that a
    rule's path has, its path prefix, and into the words of its host; the expressions meet the rules on the first four bytes of
    their SHA-256, then all 32 bytes are compared. Named rules come before others, then the longest rule (host and path together)
    wins, of equal lengths the longer host, then block before allow. ``rule`` is null unless a named one wins; an address
    that nothing fits is allowed. Null urls and urls without ``://`` have empty host and path, fit no rule and are
    allowed. Rules with null host or path are ignored, repeated rules count once.
    """
    rules = rules.where("host is not null and path is not null").select(F.lower("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"), "named").distinct()
    rules = rules.withColumn("r_rule", F.concat("r_host", "r_path")).withColumn("r_digest", F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256))
    rules = rules.withColumn("short", F.substring("r_digest", 1, 8))
    # at most as many rows as a path is long
    told = rules.groupBy(F.length("r_path").alias("length")).agg(F.max(F.when(~F.startswith("r_host", F.lit("~")), F.size(F.split("r_host", r"\.")))).alias("labels"), F.count("*").alias("n")).collect()
    lengths, labels, counted = sorted(r.length for r in told) or [0], max((r.labels or 0 for r in told), default=0), sum(r.n for r in told)
    host, path = host_and_path(F.col(url_col))
    base = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    # rules see a host and the first characters of a path only, so equal ones are judged once
    keyed = base.select("id", "host", "path", F.substring("path", 1, max(lengths)).alias("start"))
    distinct = keyed.where("host <> ''").select("host", "start").distinct()
    terms = distinct.select("host", "start", F.explode(_expressions(lengths, labels)).alias("e")).select("host", "start", F.sha2(F.concat_ws("\n", "e.suffix", "e.prefix"), 256).alias("digest"))
    terms = terms.withColumn("short", F.substring("digest", 1, 8))
    side = F.broadcast(rules) if counted <= BROADCAST_RULES else rules
    met = terms.join(side, "short").where("digest = r_digest")
    rank = F.struct(F.col("named"), F.length("r_rule").alias("length"), F.length("r_host").alias("host_length"), (F.col("r_verdict") == "block").cast("int").alias("blocks"), F.col("r_rule").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = met.groupBy("host", "start").agg(F.max(rank).alias("best"))
    best = best.select(F.col("host").alias("b_host"), F.col("start").alias("b_start"), F.when(F.col("best.named"), F.col("best.rule")).alias("rule"), F.col("best.verdict").alias("by_rule"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("b_salt"))
    dealt = keyed.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int"))
    judged = dealt.join(best, (F.col("host") == F.col("b_host")) & (F.col("start") == F.col("b_start")) & (F.col("salt") == F.col("b_salt")), "left")
    return judged.select("id", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"))
