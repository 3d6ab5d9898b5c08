"""URL allow and block rules by a sort-merge range join over reversed hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, parts_for

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one sorted sweep.
SWEEP_ROWS = 1_000


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse, each closed by a dot: a domain and all below it share its key as a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A table of (host, path, verdict) from a short literal list."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _opened(rules: DataFrame, group: str, key: str) -> DataFrame:
    """``group, key, _nest``: each rule key with the stack that is open at it, itself last.

    These are the keys of its group that begin it: its own beginnings, joined
    with the rules as equal keys.
    """
    stops = rules.select(group, key).distinct()
    begun = stops.select(group, F.col(key).alias("_whole"), F.explode(F.transform(F.sequence(F.lit(0), F.length(key)), lambda n: F.substring(F.col(key), F.lit(1), n))).alias(key))
    return begun.join(stops, [group, key]).groupBy(group, F.col("_whole").alias(key)).agg(F.array_sort(F.collect_list(F.struct(F.length(key).alias("n"), F.col(key).alias("k")))).alias("_nest")).withColumn("_nest", F.transform("_nest", lambda x: x["k"]))


def _sweep(rows: DataFrame, rules: DataFrame, group: str, key: str) -> DataFrame:
    """``rows`` with ``_stack``: the rule keys of the group that begin the row's key.

    A rule's key opens the interval of all keys that begin with it. Rows and
    rules are sorted together within ``group``; at a row, the open intervals are
    those of the stack at the last rule before it whose keys begin the row's:
    whatever stands between a key and one that it begins is begun by it too.
    Groups are salted: each salt gets a copy of the group's rules and as many
    rows as there are rules, or ``SWEEP_ROWS``, so that the copies never
    outnumber rows and rules. ``rows`` and ``rules`` are written tables.
    """
    salts = parts_for(rows.count(), max(SWEEP_ROWS, rules.count()))
    stops = _opened(rules, group, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cols = rows.columns
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int"))
    both = salted.unionByName(stops, allowMissingColumns=True)
    upto = Window.partitionBy(group, "_salt").orderBy(F.col(key), F.col("_nest").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = both.select(*cols, "_nest", F.last("_nest", ignorenulls=True).over(upto).alias("_open")).where(F.col("_nest").isNull())
    return swept.select(*cols, F.filter(F.coalesce("_open", F.array().cast("array<string>")), lambda k: F.col(key).startswith(k)).alias("_stack"))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: ``id, host, path, rule, verdict``.

    A rule (host, path, verdict) fits its host and all subdomains when the url's
    path begins with the rule's; the longest rule wins (host and path together,
    then the longer host, then ``block``). Without a fitting rule ``rule`` is
    null and the verdict is ``default``.

    Hosts are first swept against the hosts of the rules: reversed-host keys
    turn "this domain and all below" into one interval, and intervals nest, so a
    stack holds all open ones. Each open rule host is then swept once more with
    its paths. Both sweeps are sorts of narrow rows in salted groups; no page
    meets a rule whose interval it is not in, and a rule's stack is as deep as
    rules nest, whatever their number.

    Defined results: a null url or one without ``://`` has an empty host and
    path and gets the default. Repeated pages are judged one by one. Empty
    pages give no rows; without rules all get the default. Other columns of
    ``pages`` are ignored whatever their names.
    """
    urls = materialize(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.monotonically_increasing_id().alias("_row")), "urls")
    urls = urls.select("_row", "_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    rules = materialize(rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(host_key(F.col("host")).alias("_hkey"), F.col("host").alias("_rhost"), F.col("path").alias("_rpath"), F.col("verdict").alias("_verdict")).distinct(), "rules")
    first = F.substring_index("_hkey", ".", 1)
    keyed = urls.select("_row", host_key(F.col("host")).alias("_hkey"), F.col("path").alias("_path")).withColumn("_top", first)
    hosts = _sweep(keyed, rules.select("_hkey").distinct().withColumn("_top", first), "_top", "_hkey")
    active = materialize(hosts.select("_row", "_path", F.explode("_stack").alias("_hkey")), "active")
    fits = _sweep(active, rules.select("_hkey", F.col("_rpath").alias("_path")), "_hkey", "_path").select("_row", "_hkey", F.explode("_stack").alias("_rpath"))
    fits = fits.join(rules, ["_hkey", "_rpath"])
    longest = F.struct(F.length(F.concat("_rhost", "_rpath")).alias("n"), F.length("_rhost").alias("h"), F.col("_verdict").alias("verdict"), F.concat("_rhost", "_rpath").alias("rule"))
    best = fits.groupBy("_row").agg(F.max(longest).alias("_best"))
    return urls.join(best, "_row", "left").select(F.col("_id").alias(id_col), "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
