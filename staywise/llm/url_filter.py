"""URL verdicts: a blocked Bloom filter in front of an exact hash join, in DataFrame operations only.

Listed are rules (a host with all its subdomains and a path prefix, allowing or blocking) and canonical URLs to block. Every listed key sets
``BITS_PER_KEY`` bits of one 64-bit block; the blocks are a table of fixed largest size, so it may be broadcast for lists of any
length, and a longer list only lets more false hits pass. A page asks for the few keys that could list it; what passes the filter is
joined exactly, so the verdicts do not depend on the filter's errors.

A null URL, or one without ``://``, has empty host and path and is allowed. The longest fitting rule decides, ties go to the smaller rule; without
one a listed URL is blocked and any other allowed. Repeated rows get the same verdict each; empty lists allow all; other columns are dropped.
"""
from pyspark.sql import functions as F

from .tables import LOWER, UPPER, same, small, stage

KEYS_PER_BLOCK = 4
MAX_BLOCKS = 1 << 20
BITS_PER_KEY = 5
#: Rules of the registered query: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Host words of unwanted sites, from which the registered query draws its list of URLs.
UNWANTED = "ads adult bet bets betting casino gambling loans pills poker porn spam track tracker viagra".split()
UNWANTED_HOST = rf"(^|[.-])({'|'.join(UNWANTED)})([.-]|$)"


def with_parts(pages):
    """(page_id, url, host, path)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    pattern = "://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)
    return pages.select("page_id", "url", host.alias("host"), F.regexp_extract(url, pattern, 2).alias("path"))


def canonical(host, path):
    """One spelling for URLs that lead to the same page: no scheme, ``www.``, query, fragment or last slash."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))


def _mask(key):
    """The bits of a key in its block."""
    bits = F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("long")
    for k in range(BITS_PER_KEY):
        place = F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def bloom_blocks(keys, n_keys):
    """(block, bits) of a blocked Bloom filter over the column ``key``, and its number of blocks."""
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * KEYS_PER_BLOCK < n_keys:
        blocks *= 2
    placed = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), _mask(F.col("key")).alias("mask"))
    return placed.groupBy("block").agg(F.bit_or("mask").alias("bits")), blocks


def possible_hits(asked, filter_blocks, blocks):
    """Rows of ``asked`` whose ``key`` may be listed."""
    placed = asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    hit = placed.join(F.broadcast(filter_blocks), "block")  # at most MAX_BLOCKS rows of 16 bytes
    return hit.where(F.col("bits").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key"))).drop("block", "bits")


def judge(pages, rules, listed):
    """(page_id, host, path, rule, verdict) for every page.

    ``rules``: (host, path, verdict); ``listed``: (url_key) canonical URLs to block.
    """
    as_keys = rules.select(
        F.concat(F.lit("r"), "host", "path").alias("key"),
        F.concat("host", "path").alias("rule"),
        F.col("verdict").alias("rule_verdict"),
        (F.length(F.regexp_replace("host", "[^.]", "")) + 1).alias("labels"),
        F.length("path").alias("width"),
    )
    listing = listed.select(F.concat(F.lit("u"), "url_key").alias("key")).distinct()
    entries = stage(
        as_keys.unionByName(listing, allowMissingColumns=True).dropDuplicates(["key"]), "url-list"
    )
    shapes = [(r["labels"], r["width"]) for r in as_keys.select("labels", "width").distinct().collect()]
    filter_blocks, blocks = bloom_blocks(entries, entries.count())
    parts = with_parts(pages)
    suffixes = [F.concat(F.lit("r"), F.substring_index("host", ".", -n), F.col("path").substr(1, w)) for n, w in shapes]
    keys = F.array_distinct(F.array(*suffixes, F.concat(F.lit("u"), canonical(F.col("host"), F.col("path")))))
    asked = parts.select("page_id", "url", F.explode(keys).alias("key"))
    exact = possible_hits(asked, stage(filter_blocks, "url-filter"), blocks).join(small(entries, ["key", "rule"]), "key")
    longest = F.min(F.when(F.col("rule").isNotNull(), F.struct(-F.length("rule"), "rule", "rule_verdict"))).alias("longest")
    found = exact.groupBy("page_id", "url").agg(longest).alias("f")
    joined = parts.alias("p").join(found, same(F.col("p.page_id"), F.col("f.page_id")) & same(F.col("p.url"), F.col("f.url")), "left")
    by_list = F.when(F.col("f.page_id").isNotNull() | F.col("f.url").isNotNull(), "block").otherwise("allow")
    return joined.select(
        "p.page_id",
        "p.host",
        "p.path",
        F.col("f.longest.rule").alias("rule"),
        F.coalesce("f.longest.rule_verdict", by_list).alias("verdict"),
    )


def unwanted_urls(pages):
    """Canonical URLs of the pages whose host carries one of the ``UNWANTED`` words."""
    parts = with_parts(pages).where(F.col("host").rlike(UNWANTED_HOST))
    return parts.select(canonical(F.col("host"), F.col("path")).alias("url_key")).distinct()


ORACLE = rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(rhost, rpath, rverdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
u AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS url_key FROM p),
l AS (SELECT DISTINCT url_key FROM u WHERE regexp_matches(host, '{UNWANTED_HOST}')),
f AS (SELECT page_id, arg_max(rhost || rpath, len(rhost || rpath)) AS rule, arg_max(rverdict, len(rhost || rpath)) AS rverdict
    FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(rverdict, CASE WHEN l.url_key IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM u LEFT JOIN f ON u.page_id = f.page_id LEFT JOIN l ON u.url_key = l.url_key
"""
