"""URL filter: a blocked Bloom filter of listed URLs in front of an exact hash join [native].

The list holds canonical URL prefixes: a host, which stands for itself and all subdomains, and the start of a path.
A URL can only meet entries of the list's own shapes (labels in the host, characters in the path), so each shape gives
one candidate key. The filter drops nearly all candidates; those it passes are joined exactly with the list, which
removes its false positives. The longest entry that fits decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, materialize, table, unboxed

#: A block is 8 words of 64 bits, one bit set in each; a filter has a block for KEYS_PER_BLOCK entries, 16 bits for each,
#: so that it passes under 1 % of foreign keys however long the list is.
WORDS, KEYS_PER_BLOCK = 8, 32
#: Lists up to this many entries (about 10 MB) and shapes are broadcast; longer ones take the shuffled join. A longer list's filter
#: is a table, which is broadcast up to this many blocks (about 30 MB) and joined by shuffle beyond.
MAX_BROADCAST_ENTRIES, MAX_BROADCAST_SHAPES, MAX_BROADCAST_BLOCKS = 100_000, 16, 250_000

LISTED = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
#: The rules of the query.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for a null or a URL without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def canonical_list(listed: DataFrame) -> DataFrame:
    """(rule, verdict, labels, chars): one row for each distinct rule; of two verdicts for one rule, ``block`` stays."""
    rule = F.col("rule")
    slash = F.locate("/", rule)
    host = F.when(slash > 0, F.substring(rule, F.lit(1), slash - 1)).otherwise(rule)
    canonical = F.concat(F.translate(host, UPPER, LOWER), F.substring(rule, F.length(host) + 1, F.length(rule)))
    return (
        listed.where(rule.isNotNull() & (host != ""))
        .select(canonical.alias("rule"), F.coalesce(F.col("verdict"), F.lit("block")).alias("verdict"), F.size(F.split(host, r"\.")).alias("labels"), (F.length(rule) - F.length(host)).alias("chars"))
        .groupBy("rule", "labels", "chars")
        .agg(F.max("verdict").alias("verdict"))
    )


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 6 * word).bitwiseAND(F.lit(63)).cast("int")


def bloom_filter(rules: DataFrame, blocks: int) -> DataFrame:
    """(block, words): the words of each block that a rule falls in, as a table."""
    words = F.array(*[F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("rule"), w))) for w in range(WORDS)])
    return rules.groupBy(_block(F.col("rule"), blocks).alias("block")).agg(words.alias("words"))


def might_hold(key: Column, words: Column) -> Column:
    """Whether a key's block, given its words (null for none), may hold it: true for every listed one, and for few others."""
    test = words.isNotNull()
    for w in range(WORDS):
        test = test & (F.call_function("shiftright", words[w], _bit(key, w)).bitwiseAND(F.lit(1)) == 1)
    return test


def filter_urls(pages: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow", max_broadcast: int = MAX_BROADCAST_ENTRIES) -> DataFrame:
    """Add host, path, rule (null if none fits) and verdict (``default`` without a rule) to every row.

    Input columns of these names are replaced; all others, whatever their names, and repeated rows stay. A null URL has an empty host and
    path, which no rule fits. An empty list gives every row the default; rules without a host are void.
    """
    names = [c for c in pages.columns if c.lower() not in ("rule", "verdict", "host", "path")]
    rows = boxed(pages, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rules = canonical_list(listed)
    shapes = [(r["labels"], r["chars"], r["n"]) for r in rules.groupBy("labels", "chars").agg(F.count(F.lit(1)).alias("n")).orderBy("labels", "chars").collect()]
    added = [F.col("host"), F.col("path"), F.col("rule"), F.coalesce("verdict", F.lit(default)).alias("verdict")]
    if not shapes:
        return unboxed(rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")}), names, *added)
    entries = sum(n for *_, n in shapes)
    blocks = -(-entries // KEYS_PER_BLOCK)
    keys = [F.when(F.length("path") >= chars, F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, chars))) for labels, chars, _ in shapes]
    if entries <= max_broadcast and len(shapes) <= MAX_BROADCAST_SHAPES:
        judged = _broadcast_join(rows, rules, shapes, keys, blocks)
    else:
        judged = _shuffled_join(rows, materialize(rules), keys, blocks)
    return unboxed(judged, names, *added)


def _broadcast_join(rows: DataFrame, rules: DataFrame, shapes: Sequence[tuple], keys: Sequence[Column], blocks: int) -> DataFrame:
    """The filter as a constant of the plan, then one broadcast hash join for each shape: no shuffle, and rows stay where they are."""
    filled = {r["block"]: r["words"] for r in bloom_filter(rules, blocks).collect()}  # 64 bytes for 32 entries: 200 KB at most
    words = F.from_json(F.lit(str([filled.get(b, [0] * WORDS) for b in range(blocks)])), T.ArrayType(T.ArrayType(T.LongType())))
    out = rows
    for i, ((labels, chars, _), key) in enumerate(zip(shapes, keys, strict=True)):
        side = rules.where((F.col("labels") == labels) & (F.col("chars") == chars)).select(F.col("rule").alias(f"r{i}"), F.col("verdict").alias(f"v{i}"))
        passed = F.when(might_hold(key, F.element_at(words, (_block(key, blocks) + 1).cast("int"))), key)
        out = out.withColumn(f"k{i}", passed).join(F.broadcast(side), F.col(f"k{i}") == F.col(f"r{i}"), "left").drop(f"k{i}")
    fits = F.array(*[F.struct(F.length(f"r{i}").alias("n"), F.col(f"r{i}").alias("rule"), F.col(f"v{i}").alias("verdict")) for i in range(len(shapes))])
    return out.withColumn("best", F.array_max(F.filter(fits, lambda x: x["rule"].isNotNull()))).select("row", "host", "path", "best.rule", "best.verdict")


def passing(candidates: DataFrame, rules: DataFrame, blocks: int) -> DataFrame:
    """The rows of (key, ...) whose key the filter, a table as long as the list demands, may hold."""
    filled = bloom_filter(rules, blocks)
    if blocks <= MAX_BROADCAST_BLOCKS:
        filled = F.broadcast(filled)
    met = candidates.withColumn("block", _block(F.col("key"), blocks)).join(filled, "block")
    return met.where(might_hold(F.col("key"), F.col("words"))).drop("block", "words")


def _shuffled_join(rows: DataFrame, rules: DataFrame, keys: Sequence[Column], blocks: int) -> DataFrame:
    """Each distinct (host, path) meets the filter, and what this passes is joined with the list; AQE splits hot keys of the last join."""
    distinct = rows.where("host <> ''").select("host", "path").distinct()
    candidates = distinct.select("host", "path", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("key"))
    found = passing(candidates, rules, blocks).join(rules.select(F.col("rule").alias("key"), "verdict"), "key")
    best = found.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), F.col("key").alias("rule"), "verdict")).alias("best"))
    side = best.select(F.col("host").alias("h"), F.col("path").alias("p"), "best.rule", "best.verdict")
    return rows.join(side, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").select("row", "host", "path", "rule", "verdict")


def inline_list(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """A short list as a table of literals."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in rules])))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, inline_list(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH r(rule, rhost, rpath, v) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
u AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, n, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT p.*, rule, v, row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC) AS k FROM p
  LEFT JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f WHERE k = 1
"""
