"""URL filters: rules on host suffix and path prefix, and an exact Bloom filter cascade.

Only DataFrame and SQL functions are used. A cascade holds alternate levels: level 0 encodes the listed keys,
level 1 those other keys of the corpus that pass level 0, level 2 the listed keys that pass level 1, and so on
until no key of the corpus's complete universe is wrong. Membership is then exact for every key of that universe,
without a join: each level is a binary literal in the plan. Level 0 has as many bits a key as it takes to pass fewer
other keys than are listed, however large the universe, so the list's size bounds every level, and the list is
split into shards that keep each literal within max_bytes.

Edge cases: a null url, or one without "://", has an empty host and path, fits no rule and is allowed. An empty
list gives a cascade without levels. Repeated keys count once, repeated pages are judged each. Parent domains of more
labels than any listed key can't be listed and aren't made, so a host of any number of dots costs as much as the list's
deepest key. An empty table gives no rows. Extra columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Bits of one row that bitmap_construct_agg makes.
_BUCKET = 32768


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed rules of the query.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

#: Listed hosts of the query; subdomains are listed with them.
LISTED = ("spam-farm.example.org", "cheap-pills.example.com", "spam-farm.example.net", "cheap-pills.example.net", "casino-win.example.com", "tionble.example.com", "ththan.example.net", "m.ththed.example.net", "ththhe.example.com")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), ascii_uppercase, ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules, value) -> Column:
    """value(rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def suffixes(host: Column, most: int | None = None) -> Column:
    """A host and its parent domains; most: those of so many labels at most."""
    n = F.size(F.split(host, r"\.", -1))
    return F.transform(F.sequence(F.lit(1), n if most is None else F.least(n, F.lit(most))), lambda i: F.call_function("substring_index", host, F.lit("."), (-i).cast("int")))


@dataclass(frozen=True)
class Level:
    seed: int
    n_bits: int
    n_hashes: int
    bits: bytes = b""

    def positions(self, key: Column) -> list[Column]:
        first = F.pmod(F.xxhash64(F.lit(self.seed), key), F.lit(self.n_bits))
        step = F.pmod(F.xxhash64(F.lit(self.seed + 1), key), F.lit(self.n_bits - 1)) + 1
        return [(first + step * j) % self.n_bits for j in range(self.n_hashes)]

    def has(self, key: Column) -> Column:
        bits = F.lit(self.bits)
        one = lambda p: F.getbit(F.conv(F.hex(F.substring(bits, (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int"), (p % 8).cast("int")) == 1
        return reduce(lambda a, b: a & b, map(one, self.positions(key)))


@dataclass(frozen=True)
class Cascade:
    """Shards by key hash; each a list of levels. One shard unless the list outgrows max_bytes."""

    shards: tuple[tuple[Level, ...], ...]

    def shard_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(len(self.shards)))

    def listed(self, key: Column, shard: int = 0) -> Column:
        levels = self.shards[shard]
        out = F.lit(len(levels) % 2 == 1)
        for i in reversed(range(len(levels))):
            out = F.when(levels[i].has(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def bloom_level(keys: DataFrame, n: int, seed: int, bits_per_key: float) -> Level:
    """A Bloom filter of the n keys of column key."""
    n_bits = max(64, math.ceil(n * bits_per_key / 8) * 8)
    level = Level(seed, n_bits, max(1, round(bits_per_key * math.log(2))))
    at = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("p")).select((F.col("p") + 1).alias("p"))
    rows = at.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()  # one row of 4 KiB per 32768 bits
    bits = bytearray(math.ceil(n_bits / _BUCKET) * _BUCKET // 8)
    for r in rows:
        at_byte = (r["b"] - 1) * _BUCKET // 8
        bits[at_byte : at_byte + len(r["m"])] = r["m"]
    return Level(seed, n_bits, level.n_hashes, bytes(bits[: n_bits // 8]))


def build_cascade(keys: DataFrame, listed: DataFrame, bits_per_key: float = 10.0, max_bytes: int = 32 << 20) -> Cascade:
    """A cascade that is exact on every key of keys and listed (column key, nulls ignored).

    The universe is labelled by one aggregation over both inputs, not by a join. Level 0 passes other keys at the rate
    at which they are about a quarter of the listed ones, or at that of bits_per_key where that is less, so level 1 and all further levels are no
    larger than a filter over the list; a list whose level 0 would pass max_bytes is split into shards by key hash.
    """
    both = keys.select("key", F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(True).alias("listed")))
    universe = stored(both.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("listed").alias("listed")), "url-keys")
    total, every = universe.agg(F.count_if("listed"), F.count("*")).first()
    first_bits = max(bits_per_key, math.log(4 * max(1, every) / max(1, total)) / math.log(2) ** 2)
    n_shards = max(1, math.ceil(total * first_bits / 8 / max_bytes))
    cascade = Cascade(((),) * n_shards)
    shards = []
    for s in range(n_shards):
        own = universe.where(cascade.shard_of(F.col("key")) == s) if n_shards > 1 else universe
        inside, outside, levels = own.where("listed").select("key"), own.where(~F.col("listed")).select("key"), []
        n = total if n_shards == 1 else inside.count()
        while n:
            levels.append(bloom_level(inside, n, 1000 * s + 2 * len(levels), bits_per_key if levels else first_bits))
            inside, outside = outside.where(levels[-1].has(F.col("key"))), inside
            n = inside.count()
        shards.append(tuple(levels))
    return Cascade(tuple(shards))


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict per page: the longest rule's verdict, else block if host or parent is listed."""
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    most = listed.where("key IS NOT NULL").agg(F.max(F.size(F.split("key", r"\.", -1)))).first()[0] or 1
    keys = hosts.select("host").distinct().select(F.explode(suffixes(F.col("host"), most)).alias("key"))
    cascade = build_cascade(keys, listed)

    def judged(rows: DataFrame, is_listed: Column) -> DataFrame:
        host, path = F.col("host"), F.col("path")
        return rows.select("page_id", "host", "path", longest_rule(host, path, rules, lambda r: r.name).alias("rule"), F.coalesce(longest_rule(host, path, rules, lambda r: r.verdict), F.when(is_listed, "block").otherwise("allow")).alias("verdict"))

    if len(cascade.shards) == 1:
        return judged(hosts, F.exists(suffixes(F.col("host"), most), lambda k: cascade.listed(k)))
    out = hosts.withColumn("hit", F.lit(False))
    for s in range(len(cascade.shards)):  # one pass for each shard keeps every literal within the bound
        out = stored(out.withColumn("hit", F.col("hit") | F.exists(suffixes(F.col("host"), most), lambda k, s=s: (cascade.shard_of(k) == s) & cascade.listed(k, s))), "url-hits")
    return judged(out, F.col("hit"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(h,) for h in LISTED], "key string")
    return filter_urls(table(spark, sf_dir, "pages"), listed)


_A_HOST = "translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '" + ascii_uppercase + "', '" + ascii_lowercase + "')"
OP3_SQL = f"""
WITH u AS (SELECT page_id, {_A_HOST} AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)}) AS t(v, h, p)),
f AS (SELECT u.page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS v
  FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY u.page_id),
l AS (SELECT DISTINCT u.host FROM u JOIN (VALUES {", ".join(f"('{h}')" for h in LISTED)}) AS t(h) ON u.host = t.h OR ends_with(u.host, '.' || t.h))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.v, CASE WHEN l.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM u LEFT JOIN f USING (page_id) LEFT JOIN l ON u.host = l.host
"""
