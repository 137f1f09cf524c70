"""Exact dedup by deterministic block naming. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import staged, unstage

#: Bytes of a block at the lowest level.
BLOCK_BYTES = 2048

#: Stands for the missing right half of a pair; no name has this value.
_NONE = -(2**63)


def _named(keys: DataFrame, by: list[str]) -> DataFrame:
    """The distinct ``by`` values of ``keys`` with an integer ``name`` each.

    Equal values are collapsed before the shuffle and meet in one partition, which is sorted; the
    name is the value's place in it, with the partition's number in the high bits.
    """
    return keys.select(*by).distinct().sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _name_blocks(blocks: DataFrame, fingerprint: Callable[[str], Column]) -> DataFrame:
    """``blocks`` with ``name`` instead of ``block``; equal names exactly for equal blocks.

    Only distinct blocks are shuffled whole. Rows find their name by a fingerprint of the block
    where just one block has that fingerprint; where several have, by the block itself. Both sides of these joins
    are tables, so adaptive execution can split the rows of a frequent block over tasks.
    """
    rest = [c for c in blocks.columns if c != "block"]
    blocks = blocks.withColumn("h", fingerprint("block"))
    names = staged(_named(blocks, ["block", "h"]).select("h", "name"), "names")
    several = staged(names.groupBy("h").count().where("count > 1").select("h"), "clashes")
    if not several.limit(1).count():
        out = staged(blocks.select("h", *rest).join(names, "h").select(*rest, "name"), "level")
        unstage(names, several)
        return out
    plain = blocks.select("h", *rest).join(names.join(several, "h", "left_anti"), "h").select(*rest, "name")
    clash = blocks.join(several, "h")
    clash_names = staged(_named(clash, ["block"]), "clash-names")
    clash = clash.join(clash_names, "block").select(*rest, (-1 - F.col("name")).alias("name"))
    out = staged(plain.unionByName(clash), "level")
    unstage(names, several, clash_names)
    return out


def identities(docs: DataFrame, key: Column, text: Column, extra: dict[str, Column] | None = None, block_bytes: int = BLOCK_BYTES, fingerprint: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: ``key``, ``n_blocks``, ``name`` and the ``extra`` columns.

    Two rows have equal ``(n_blocks, name)`` exactly when their texts are identical; no hash decides.
    A text is cut into blocks of ``block_bytes`` bytes (a null or empty text is one empty block);
    equal blocks get equal names, then pairs of adjacent names are named, level by level, until one
    name is left. ``key`` must be unique among rows and the same each time the rows are read.
    """
    extra = extra or {}
    rows = docs.select(key.alias("key"), F.coalesce(text, F.lit("")).cast("binary").alias("data"), *[c.alias(k) for k, c in extra.items()])
    rows = rows.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("data") / F.lit(block_bytes))).cast("int"))
    cut = rows.select("key", "n_blocks", "data", *extra, F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("at"))
    block = F.expr(f"substring(data, at * {block_bytes} + 1, {block_bytes})").alias("block")
    blocks = cut.select("key", "n_blocks", "at", block, *[F.when(F.col("at") == 0, F.col(k)).alias(k) for k in extra])
    level = _name_blocks(blocks, fingerprint)
    rest = level.where("n_blocks > 1").select("key", "n_blocks", "at", "name")
    most, done = rest.agg(F.max("n_blocks")).first()[0] or 1, []
    while most > 1:
        odd = F.col("at") % 2 == 1
        left, right = F.max(F.when(~odd, F.col("name"))).alias("l"), F.max(F.when(odd, F.col("name"))).alias("r")
        pairs = rest.groupBy("key", "n_blocks", F.expr("at div 2").cast("int").alias("at")).agg(left, right)
        pairs = staged(pairs.withColumn("r", F.coalesce("r", F.lit(_NONE))), "pairs")
        names = staged(_named(pairs, ["l", "r"]), "names")
        rest = staged(pairs.join(names, ["l", "r"]).select("key", "n_blocks", "at", "name"), "level")
        unstage(pairs, names, *done)
        done = [rest]
        most = (most + 1) // 2
    firsts = level.where("n_blocks > 1 and at = 0").select("key", *extra)
    long = rest.join(firsts, "key").select("key", "n_blocks", "name", *extra)
    out = staged(level.where("n_blocks = 1").select("key", "n_blocks", "name", *extra).unionByName(long), "identities")
    unstage(level, *done)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are compared as they are; a null text counts as empty. Of equal texts the row with the
    largest ``doc_id`` stays. An empty table gives no rows; other columns are not read, whatever their
    names. Rows that repeat a ``doc_id`` count as rows of their own, and those of the kept id and
    text all say ``kept``; a null ``doc_id`` never stays while another row of the text has one.
    """
    numbered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    key = F.monotonically_increasing_id()
    sha = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    named = identities(numbered, key, F.col("text"), {"doc_id": F.col("doc_id"), "sha": sha})
    # A table too, so that the rows of a large group can be split over tasks.
    groups = staged(named.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    out = named.join(groups, ["n_blocks", "name"])
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
