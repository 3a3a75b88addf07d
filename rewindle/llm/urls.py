"""URL filter: rules by host and path, then a list of canonical URLs behind a blocked Bloom filter.

The listed URLs go into a Bloom filter of blocks of eight 64-bit words; a URL's hash names its block and one bit in each word. The
filter is a table with a row a block. Its number of blocks follows the list's length up to ``MOST`` (16 MB of words), so it
may always be broadcast; a longer list only lets more URLs through. URLs whose bits are all set are possible hits: they alone are
shuffled, to a hash join with the list that removes the false positives. So the verdict is exact whatever the filter's size.
Only built-in functions are used: no Python worker runs.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end. A URL that is
null or holds no ``://`` has an empty host and path, no canonical form, and is on no list. Canonical form: the host without leading
``www.`` and default port, the path without slashes at its end, and the parameters in order without those that only track;
scheme and fragment do not count.

A rule fits its host and all subdomains of it where the path starts with the rule's. The longest (host and path together) wins, then the one
with the longer host, then the first in byte order; two rules for one host and path are refused. Without a rule that fits, listed URLs are blocked.

Rows are judged one by one: repeated rows get the same verdict each, URLs are read whole however long, an empty table gives no rows, an empty or
null-only list blocks none. A URL may hold any share of all rows: only possible hits move, the list holds each URL once, and Spark
splits such a partition of the join. Columns of the table called ``host``, ``path``, ``rule`` or ``verdict`` are left out in favour of the verdict's own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewindle.llm.common import fresh, written

WORDS = 8
#: Keys a block of 512 bits is meant for: about one false hit in 3,000.
KEYS = 32
#: Blocks of the largest filter, and so rows of the largest broadcast: 16 MB of words.
MOST = 1 << 18

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Parameters that tell where a visitor came from, not what the page shows.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|\z)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


def _lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty where it is null or has no ``://``."""
    piece = lambda i: F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", i), F.lit(""))
    return _lower(piece(1)), piece(2)


def canonical(url: Column) -> Column:
    """One form for the URLs of one page; null where a URL is null or has no ``://``."""
    host, path = parts(url)
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)\z", "")
    given = F.split(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(given, lambda x: (x != "") & ~x.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.contains(url, F.lit("://")), F.concat(host, F.rtrim(path, F.lit("/")), query))


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("long")


def _bit(key: str, word: int) -> Column:
    """The one bit that a key sets in a word: six bits of a second hash say which."""
    place = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(1)), 6 * word).bitwiseAND(63).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(``block``, ``w0`` to ``w7``): the filter of the strings in ``key``, at most ``blocks`` rows."""
    words = [F.bit_or(_bit(key, i)).alias(f"w{i}") for i in range(WORDS)]
    return listed.groupBy(_block(key, blocks).alias("block")).agg(*words)


def possible(df: DataFrame, key: str, filter: DataFrame, blocks: int, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: whether the filter may hold ``key``; it holds no null."""
    at, *words = fresh(df, "block", *[f"w{i}" for i in range(WORDS)])
    table = filter.toDF(at, *words)
    probed = df.withColumn(at, F.when(F.col(key).isNotNull(), _block(key, blocks))).join(F.broadcast(table), at, "left")
    hit = reduce(lambda a, b: a & b, [F.col(w).bitwiseAND(_bit(key, i)) != 0 for i, w in enumerate(words)])
    return probed.withColumn(name, F.coalesce(hit, F.lit(False))).drop(at, *words)


def matched(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the rule that wins, both null where none fits."""
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("two rules for one host and path")
    order = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name))
    first = lambda value: F.coalesce(*[F.when(r.fits(host, path), F.lit(value(r))) for r in order], F.lit(None).cast("string"))
    return first(lambda r: r.name), first(lambda r: r.verdict)


def judged(df: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), url: str = "url", most: int = MOST) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict``; ``listed`` holds the URLs to block in a column ``url``."""
    own = {"host", "path", "rule", "verdict"}
    keep = [c for c in df.columns if c.lower() not in own]
    key, maybe, known, by_rule = fresh(df, "key", "maybe", "known", "by_rule")
    keys = written(listed.select(canonical(F.col(url)).alias(key)).where(F.col(key).isNotNull()).distinct(), "listed")
    blocks = min(most, max(1, -(-keys.count() // KEYS)))
    filter = written(bloom(keys, key, blocks), "bloom")

    host, path = parts(F.col(f"`{url}`"))
    name, verdict = matched(rules, F.col("host"), F.col("path"))
    rows = df.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"), canonical(F.col(f"`{url}`")).alias(key))
    rows = rows.withColumns({"rule": name, by_rule: verdict})
    # A rule decides whatever the list says, so only URLs without one are looked up.
    rows = rows.withColumn(key, F.when(F.col("rule").isNull(), F.col(key)))
    probed = possible(rows, key, filter, blocks, maybe)
    passed = probed.where(~F.col(maybe)).withColumn(known, F.lit(None).cast("boolean"))
    hits = probed.where(F.col(maybe)).join(keys.withColumn(known, F.lit(True)).hint("shuffle_hash"), key, "left")
    final = F.coalesce(by_rule, F.when(F.col(known), "block").otherwise("allow")).alias("verdict")
    return passed.unionByName(hits).select(*[F.col(f"`{c}`") for c in keep], "host", "path", "rule", final)
