"""URL filters: rules for hosts and paths, and a list of unwanted URLs, behind one blocked Bloom filter.

Everything that is listed is a key: the canonical URL of a listed page, the host of a rule, a rule itself. Each URL
asks for the few keys that could concern it: its canonical URL, the ends of its host that have as many labels as some rule, and
for hosts with rules the beginnings of its path that are as long as one of these. A blocked Bloom filter of all keys turns away nearly all that
is not listed, by one look at one block of 256 bits; what passes is joined to the list by equality, which
removes false positives. The filter is a table of blocks: it is broadcast where it was measured to be small, and joined by
block where it is not. DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import kept
from cliploom.operators.sizing import broadcast_if_small

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY = 12  # about one false positive in a hundred
WORDS = 8  # of 32 bits in a block; a key sets one bit in each
_URL, _HOST, _RULE = "u", "h", "r"  # kinds of keys


def parts(url: Column) -> tuple[Column, Column]:
    """Host, its A-Z lower-cased, and path; both empty for a null and for a URL without ``://``."""
    found = [F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", k), F.lit("")) for k in (1, 2)]
    return F.translate(found[0], UPPER, LOWER), found[1]


def canonical(host: Column, path: Column) -> Column:
    """What URLs of the same page share: no scheme, leading ``www.``, query, fragment, or slash at the end."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))


@dataclass(frozen=True)
class BloomFilter:
    blocks: DataFrame  # (block, word_0, …): only blocks with keys
    n_blocks: int


def _hashes(key: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and its bit in each word of it."""
    bits = F.xxhash64(F.lit(1), key)
    places = [F.shiftright(bits, 5 * i).bitwiseAND(31).cast("int") for i in range(WORDS)]
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)), [F.call_function("shiftleft", F.lit(1), at) for at in places]


def bloom_filter(keys: DataFrame, key: str = "key") -> BloomFilter:
    """A filter of the keys. They are counted first, so pass a written table."""
    n_blocks = max(1, -(-keys.count() * BITS_PER_KEY // (32 * WORDS)))
    block, bits = _hashes(F.col(key), n_blocks)
    words = [F.bit_or(f"word_{i}").alias(f"word_{i}") for i in range(WORDS)]
    placed = keys.select(block.alias("block"), *[b.alias(f"word_{i}") for i, b in enumerate(bits)])
    return BloomFilter(kept(placed.groupBy("block").agg(*words), "bloom"), n_blocks)


def possible(asked: DataFrame, found: BloomFilter, key: str = "key") -> DataFrame:
    """Rows whose key may be in the filter: all that are, and about one in a hundred of the others."""
    block, bits = _hashes(F.col(key), found.n_blocks)
    mine = F.col("block") == block
    for i, bit in enumerate(bits):
        mine = mine & (F.col(f"word_{i}").bitwiseAND(bit) != 0)
    return asked.join(broadcast_if_small(found.blocks), mine).select(*asked.columns)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """(page_id, host, path, canonical, rule, listed, verdict) per row of (page_id, url).

    ``rules`` has (action, host, path): a rule fits its host and all subdomains, if the URL's path starts with its path. The longest
    rule (host and path together; then the longer host) gives the verdict; of two actions of one rule, block. ``listed`` has (url): pages with
    the same canonical URL are blocked where no rule fits; all other URLs are allowed, so is a null and what is no URL. Rules
    with a null or an empty host fit nothing, and listed rows without host list nothing. Repeated rows stay; other columns are ignored.
    """
    host, path = parts(F.col("url"))
    keys = _keys(rules, listed.select(host.alias("host"), path.alias("path")))
    bloom = bloom_filter(keys.select(F.concat("kind", "key").alias("key")).distinct())

    narrow = pages.select("page_id", host.alias("host"), path.alias("path"))
    narrow = narrow.withColumn("canonical", F.when(F.col("host") != "", canonical(F.col("host"), F.col("path"))))
    rows = kept(narrow.withColumn("at", F.monotonically_increasing_id()), "urls")  # written, so a row keeps its number
    depths = keys.where(F.col("kind") == _HOST).select(_labels("key").alias("n")).distinct().collect()  # 1 to 127 in names
    ends = [F.when(_labels("host") >= n, F.substring_index("host", ".", -n)) for n in sorted(r.n for r in depths)]
    whole = [F.struct(F.lit(_URL).alias("kind"), F.col("canonical").alias("key"))]
    asks = F.explode(F.array(*whole, *[F.struct(F.lit(_HOST).alias("kind"), end.alias("key")) for end in ends]))
    asked = rows.where("host <> ''").select("at", "path", asks.alias("ask")).where("ask.key IS NOT NULL")
    found = kept(_listed(asked.select("at", "path", "ask.*", F.lit(0).alias("host_length")), bloom, keys), "hits")

    starts = found.where(F.col("kind") == _HOST).select("at", "path", F.col("key").alias("end"), F.explode("lengths").alias("n"))
    starts = starts.where(F.col("n") <= F.length("path"))
    key = F.concat("end", F.left("path", "n")).alias("key")
    fits = _listed(starts.select("at", F.lit(_RULE).alias("kind"), key, F.length("end").alias("host_length")), bloom, keys)
    longest = F.max(F.struct(F.length("key").alias("n"), "host_length", "key", "action")).alias("best")
    best = fits.groupBy("at").agg(longest).select("at", F.col("best.key").alias("rule"), "best.action")
    hits = found.where(F.col("kind") == _URL).select("at", F.lit(True).alias("listed"))
    return rows.join(best, "at", "left").join(hits, "at", "left").select(
        "page_id", "host", "path", "canonical", "rule", F.coalesce("listed", F.lit(False)).alias("listed"),
        F.coalesce("action", F.when(F.col("listed"), BLOCK).otherwise(ALLOW)).alias("verdict"),
    )


def _keys(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """(kind, key, host_length, action, lengths), once each: ``host_length`` tells rules apart whose host and path join to the same text."""
    rules = rules.where("host <> '' AND path IS NOT NULL AND action IS NOT NULL")
    rules = rules.groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.max("action").alias("action"))
    hosts = rules.groupBy("host").agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths"))
    urls = listed.where("host <> ''").select(canonical(F.col("host"), F.col("path")).alias("key")).distinct()
    zero, no_action, no_lengths = F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("array<int>")
    tables = [
        urls.select(F.lit(_URL), "key", zero, no_action, no_lengths),
        hosts.select(F.lit(_HOST), "host", zero, no_action, "lengths"),
        rules.select(F.lit(_RULE), F.concat("host", "path"), F.length("host"), "action", no_lengths),
    ]
    return kept(reduce(DataFrame.union, tables).toDF("kind", "key", "host_length", "action", "lengths"), "listed")


def _listed(asked: DataFrame, bloom: BloomFilter, keys: DataFrame) -> DataFrame:
    """Rows whose key is listed, with what the list says: the filter first, then the join that is exact."""
    hashed = F.concat("kind", "key")
    maybe = possible(asked.withColumn("hashed", hashed), bloom, "hashed").drop("hashed")
    return maybe.join(broadcast_if_small(keys), ["kind", "key", "host_length"])


def _labels(host: str) -> Column:
    return F.length(host) - F.length(F.replace(F.col(host), F.lit("."), F.lit(""))) + 1
