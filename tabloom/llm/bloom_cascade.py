"""URL verdicts: rules by host and path, and a Bloom filter cascade for all other hosts, with DataFrame expressions only.

Level 1 of the cascade holds the listed keys; every further level holds the keys of the other side that the level before
wrongly passes. The levels are built over all keys that occur, so for these the answer is exact, and no join is needed
to ask: each level is one row, a scalar subquery of the rows asked about.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits and hashes of a key: at level 1, and further on.
FIRST, LATER = (10, 5), (4, 2)
#: Bytes of a level, at most; more listed keys are asked for by a join instead.
MOST_BYTES = 64 << 20
MOST_LEVELS = 64


def host_of(url: Column) -> Column:
    """Host of a url, lower-cased; empty without `://`."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Path of a url up to its query or fragment; empty without one."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


@dataclass
class Level:
    """A Bloom filter as one row of 64-bit words."""

    words: DataFrame
    bits: int
    hashes: int
    seed: int

    def _places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed * 1000 + k)), F.lit(self.bits)) for k in range(self.hashes)]

    @staticmethod
    def build(keys: DataFrame, count: int, seed: int, first: bool) -> Level:
        share, hashes = FIRST if first else LATER
        level = Level(keys, 64 * -(-count * share // 64), hashes, seed)
        placed = keys.select(F.explode(F.array(*level._places(F.col("key")))).alias("at"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("at"), F.lit(64)).cast("int"))
        held = placed.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
        every = keys.sparkSession.range(level.bits // 64).withColumnRenamed("id", "word").join(held, "word", "left")
        # one row of at most MOST_BYTES
        row = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"]).alias("words"))
        level.words = cut_lineage(row)
        return level

    def passes(self, key: Column) -> Column:
        words = self.words.scalar()
        found = F.lit(True)
        for at in self._places(key):
            found &= F.call_function("shiftrightunsigned", F.get(words, F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
        return found


def build_cascade(universe: DataFrame) -> list[Level]:
    """Levels for `universe` (key, listed), which holds every key that will be asked about once."""
    wanted, other = universe.filter("listed").select("key"), universe.filter("not listed").select("key")
    levels: list[Level] = []
    while (count := wanted.count()) > 0:
        if len(levels) == MOST_LEVELS:
            raise RuntimeError("keys can't be told apart")
        level = Level.build(wanted, count, len(levels), not levels)
        levels.append(level)
        wanted, other = cut_lineage(other.filter(level.passes(F.col("key")))), wanted
    return levels


def listed(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: the first level that stops it tells its side."""
    answer = F.lit(len(levels) % 2 == 1)
    for depth in range(len(levels) - 1, -1, -1):
        answer = F.when(~levels[depth].passes(key), F.lit(depth % 2 == 1)).otherwise(answer)
    return answer


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (host, path, verdict) whose host is the url's or a domain above it and whose path begins the url's, as
    a struct of rule and verdict; null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge_urls(pages: DataFrame, hosts: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; `hosts` (host) lists the hosts to block where no rule fits.

    A null url or one without `://` has an empty host and path, is listed nowhere and allowed. Repeated rows are judged each; a
    host listed twice, null or empty counts once or not. Other columns don't matter. An empty table gives an empty table;
    an empty list blocks nothing.
    """
    told = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    keys = hosts.select(F.col("host").alias("key"), F.lit(True).alias("listed")).filter("key is not null and key <> ''")
    seen = told.select(F.col("host").alias("key")).distinct().withColumn("listed", F.lit(False))
    universe = cut_lineage(keys.unionByName(seen).groupBy("key").agg(F.max("listed").alias("listed")))
    count = universe.filter("listed").count()
    if count * FIRST[0] // 8 > MOST_BYTES:
        block = universe.filter("listed").select(F.col("key").alias("host"), "listed")
        told = told.join(block, "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    else:
        told = told.withColumn("listed", listed(build_cascade(universe), F.col("host")))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return told.withColumn("_rule", rule).select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))
