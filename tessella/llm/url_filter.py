"""URL rules answered by a cascade of Bloom filters. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import staged

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The filters' bits, some tens of bits a rule, go to every task: beyond so many rules they are joined by key instead.
MOST_RULES = 1_000_000


@dataclass(frozen=True)
class Rule:
    """Fits a URL on ``host`` or its subdomains whose path starts with ``path``."""

    action: str
    host: str
    path: str

    def __post_init__(self) -> None:
        if self.action not in ("allow", "block") or not self.host or "/" in self.host or self.path[:1] not in ("", "/"):
            raise ValueError(f"not a rule: {self}")

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits as 64-bit words, and how many bits a key sets."""

    words: tuple[int, ...]
    hashes: int
    seed: int

    def holds(self, key: Column) -> Column:
        # One text literal that the optimizer folds to an array, for all places of the key: a plan holds a level's bits once.
        bits = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        places = F.array(*_places(key, self.seed, self.hashes, 64 * len(self.words)))
        return F.forall(places, lambda p: F.getbit(F.get(bits, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1)


def _places(key: Column, seed: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), F.lit(k), key), F.lit(bits).cast("bigint")) for k in range(hashes)]


def _level(keys: DataFrame, count: int, bits_per_key: float, seed: int) -> Level:
    words = max(1, math.ceil(count * bits_per_key / 64))
    hashes = min(16, max(1, round(64 * words / max(1, count) * math.log(2)))) if count > 40 else max(1, min(4, round(bits_per_key * math.log(2))))
    at = keys.select(F.explode(F.array(*_places(F.col("key"), seed, hashes, 64 * words))).alias("p"))
    bit = F.expr("shiftleft(1L, cast(p % 64 as int))")
    rows = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("bits")).collect()  # at most ``words`` rows
    found = {r.w: r.bits for r in rows}
    return Level(tuple(found.get(k, 0) for k in range(words)), hashes, seed)


class Cascade:
    """Exact membership of a key in ``listed``, for all keys of ``universe``, without a join.

    The first level encodes the listed keys, the second the other keys of the universe that the
    first level lets through, the third the listed keys that the second lets through, and so on until
    no key is let through wrongly. Both tables have a text column ``key``; null keys don't count.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame, most: int = 64) -> None:
        listed = staged(listed.where("key is not null").select("key").distinct(), "listed")
        count = listed.count()
        total = universe.agg(F.approx_count_distinct("key")).first()[0]
        self.levels: list[Level] = []
        if not count:
            return
        inside, outside = listed, universe.where("key is not null").select("key")
        self.levels.append(_level(inside, count, max(1.45, 1.45 * math.log2(max(2, total / count))), 0))
        # Only what the first level lets through is shuffled, not the universe.
        outside = staged(outside.where(self.levels[0].holds(F.col("key"))).distinct().join(listed, "key", "left_anti"), "through")
        for k in range(1, most):
            count = outside.count()
            if not count:
                return
            self.levels.append(_level(outside, count, 2.9, k))
            inside, outside = outside, staged(inside.where(self.levels[-1].holds(F.col("key"))), "through")
        raise RuntimeError(f"the cascade did not end in {most} levels")

    def holds(self, key: Column) -> Column:
        """True where ``key`` is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            answer = F.when(~self.levels[k].holds(key), F.lit(k % 2 == 1)).otherwise(answer)
        return answer


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at == 0, F.lit("")).otherwise(F.substring(url, at + 3, F.length(url)))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _candidates(rules: list[Rule], host: Column, path: Column) -> Column:
    """The (length, key) of every host suffix and path prefix that could be a rule's."""
    labels = F.size(F.split(host, r"\."))
    out = []
    for parts, chars in sorted({(r.host.count(".") + 1, len(r.path)) for r in rules}):
        key = F.concat(F.substring_index(host, ".", -parts), F.substring(path, 1, chars))
        fits = (labels >= parts) & (F.length(path) >= chars)
        out.append(F.when(fits, F.struct(F.length(key).alias("n"), key.alias("key"))))
    return F.filter(F.array(*out), lambda c: c.isNotNull())


def url_filter(pages: DataFrame, rules: list[Rule], default: str = "allow", url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    The rule of the most characters (host and path together) that fits wins; of two rules with the
    same host and path, ``block`` wins. Pages that no rule fits get ``default`` and a null ``rule``. A
    null or empty URL, or one without ``://``, has an empty host and path, which no rule fits. An
    empty table gives no rows; only the two named columns are read. More than ``MOST_RULES`` rules would make
    filters too large to send with each task; they are looked up by a join, with the same results.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not rules:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    listed = spark.createDataFrame([(r.key, r.action) for r in rules], "key string, action string")
    rows = rows.withColumn("candidates", _candidates(rules, F.col("host"), F.col("path")))
    if len(rules) > MOST_RULES:
        return _by_join(rows, listed, default)
    universe = rows.select(F.explode("candidates.key").alias("key"))
    any_rule = Cascade(listed.select("key"), universe)
    blocking = Cascade(listed.where("action = 'block'").select("key"), listed.select("key"))
    best = F.array_max(F.filter("candidates", lambda c: any_rule.holds(c["key"])))["key"]
    out = rows.select("page_id", "host", "path", best.alias("rule"))
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(blocking.holds(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", verdict)


def _by_join(rows: DataFrame, listed: DataFrame, default: str) -> DataFrame:
    """The verdicts by looking up each row's candidate keys among the rules."""
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "candidates")
    rules = listed.groupBy("key").agg(F.max("action").alias("action"))  # block is the larger word
    hits = rows.select("row", F.explode("candidates").alias("c")).select("row", "c.n", "c.key").join(rules, "key")
    best = hits.groupBy("row").agg(F.max(F.struct("n", "key", "action")).alias("best"))
    out = rows.join(best, "row", "left")
    return out.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
