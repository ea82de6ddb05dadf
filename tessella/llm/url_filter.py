"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh

#: The list of the production query, as (host, path prefix, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: A list of at most this many bytes is broadcast to the exact join; a longer one is shuffled.
BROADCAST_BYTES = 8_000_000
#: Up to this many 64-bit blocks the filter is a literal of the plan (32 KB); up to MAX_BLOCKS (4 million rules) a table that is broadcast, beyond one that is shuffled.
LITERAL_BLOCKS, MAX_BLOCKS = 4096, 1 << 20


def url_parts(url):
    """(host, path) of a URL column.

    The host runs from after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; the path from there to ``?``, ``#`` or the end. Null or no ``://``: both empty.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _block(key, blocks: int):
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key):
    """Four bits of one 64-bit block, from a second hash."""
    h, mask = F.xxhash64(key, F.lit(1)), F.lit(0).cast("long")
    for i in range(4):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def _blocks_for(rows: int) -> int:
    """A power of two, of about 16 bits a row."""
    blocks = 1
    while blocks * 64 < rows * 16:
        blocks *= 2
    return blocks


def bloom_table(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): the filter's 64-bit blocks over column ``key``, where any bit is set."""
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("bits"))


def may_hit(probes: DataFrame, keys: DataFrame, rows: int) -> DataFrame:
    """Those of ``probes`` whose ``key`` may be one of ``keys`` (``rows`` of them)."""
    blocks, mask = _blocks_for(rows), _mask(F.col("key"))
    table = bloom_table(keys, blocks)
    if blocks <= LITERAL_BLOCKS:
        bits = dict.fromkeys(range(blocks), 0) | {r["block"]: r["bits"] for r in table.collect()}
        literal = F.array(*[F.lit(bits[k]).cast("long") for k in range(blocks)])
        return probes.where(F.element_at(literal, _block(F.col("key"), blocks) + 1).bitwiseAND(mask) == mask)
    table = F.broadcast(table) if blocks <= MAX_BLOCKS else table
    return probes.withColumn("block", _block(F.col("key"), blocks)).join(table, "block").where(F.col("bits").bitwiseAND(mask) == mask).drop("block", "bits")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict added (columns of these names are replaced).

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest host and path wins, a tie goes to the longer host, then to the
    lesser verdict. No rule: rule null, verdict ``default`` (a URL not on the list).
    Each distinct URL is judged once: its host suffixes and path prefixes, in the
    shapes (labels, path length) that the list has, probe the blocked Bloom filter,
    and what passes is joined exactly with the list, which removes false positives.
    Repeated, null and empty URLs are rows like any other; an empty list fits nothing.
    Rules with a null host or path are ignored.
    """
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL").select(
        ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    ).withColumn("key", F.concat_ws("\n", "r_host", "r_path"))
    size = F.sum(F.octet_length("key") + F.octet_length(F.coalesce("r_verdict", F.lit(""))) + 32)
    sizes = rules.groupBy(F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("chars")).agg(F.count("*").alias("count"), size.alias("bytes")).collect()
    n, listed_bytes = sum(r["count"] for r in sizes), sum(r["bytes"] for r in sizes)
    host, path = url_parts(F.col("u"))
    urls = pages.select(F.col(url).alias("u")).where("u IS NOT NULL").distinct()
    parts = urls.select("u", host.alias("h"), path.alias("p")).withColumn("l", F.split("h", r"\."))
    keys = [
        F.when(
            (F.size("l") >= r["labels"]) & (F.length("p") >= r["chars"]),
            F.concat_ws("\n", F.array_join(F.slice("l", -r["labels"], r["labels"]), "."), F.substring("p", 1, r["chars"])),
        )
        for r in sizes
    ] or [F.lit(None).cast("string")]
    probes = parts.select("u", F.explode(F.array(*keys)).alias("key")).where("key IS NOT NULL")
    hits = may_hit(probes, rules, n)
    listed = F.broadcast(rules) if listed_bytes <= BROADCAST_BYTES else rules
    best = hits.join(listed, "key").groupBy("u").agg(
        F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("m"), F.when(F.col("r_verdict") == "allow", 1).otherwise(0).alias("a"), "r_host", "r_path", "r_verdict")).alias("best")
    )
    host, path = url_parts(F.col(url))
    own = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    asked, found = fresh(own.columns, "url", "best")
    return own.join(best.select(F.col("u").alias(asked), F.col("best").alias(found)), F.col(url) == F.col(asked), "left").select(
        *own.columns,
        F.concat(f"{found}.r_host", f"{found}.r_path").alias("rule"),
        F.coalesce(f"{found}.r_verdict", F.lit(default)).alias("verdict"),
    )
