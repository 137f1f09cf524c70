"""N-gram Jaccard self-join of documents by rare-first prefix filtering."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessella.llm.common import components, spanning, staged, unstage
from tessella.llm.wordhash import by_doc, mix, shingles, slices

#: Counters of the frequency sketch: a fixed 2 MB, whatever the corpus.
SKETCH_BITS = 18
_CHUNK = 1 << 12
#: Bits of the map of candidate documents that a later scan uses to skip the others: a fixed 2 MB.
MAP_BITS = 24
#: Shingles per document are also counted in hashed classes, for the suffix filter: so many at least and at most, and some
#: four shingles in each between. COARSE are compared first.
CLASSES, MOST_CLASSES, COARSE = 256, 1 << 16, 32
#: An n-gram that the sketch counts no more often than this (and four mean counters) may be grouped in one task.
HOT_ROWS, SALTS = 20_000, 64
#: Documents that share an n-gram are paired by a join if they are few, and compared in blocks if they are more.
FEW, BLOCK = 24, 512
#: Shingles of all documents of a block on average, so that a block of long documents stays small too.
BLOCK_SHINGLES = 1 << 20
#: Hubs are tried again while some n-gram leaves more than so many pairs to compare, and rounds make progress.
WORK, ROUNDS = 1 << 22, 8
#: Columns of the matrices that intersections are counted with.
_WIDE = 8192


def _bytes(column: pa.Array) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def _classes(h: np.ndarray, doc: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each document the number of its shingles in each class, as bytes; a full counter is 255."""
    size = np.left_shift(1, np.ceil(np.log2(np.maximum(n, 1) / 4)).clip(np.log2(CLASSES), np.log2(MOST_CLASSES)).astype(np.int64))
    ends = np.cumsum(size)
    at = (ends - size)[doc] + (h & (size - 1).astype(np.uint64)[doc]).astype(np.int64)
    data = np.minimum(np.bincount(at, minlength=int(size.sum())), 255).astype(np.uint8).tobytes()
    return [data[b - k : b] for b, k in zip(ends.tolist(), size.tolist(), strict=True)]


def _counts(classes: list[bytes], size: int) -> np.ndarray:
    """Counters of documents that have at least ``size`` classes, summed to so many."""
    width = len(classes[0])
    return np.frombuffer(b"".join(classes), np.uint8).reshape(len(classes), width // size, size).sum(1, dtype=np.int32)


def _by_size(classes) -> dict[int, np.ndarray]:
    size = np.array([len(c) for c in classes])
    return {int(k): np.flatnonzero(size == k) for k in np.unique(size)}


def _full(classes: list[bytes]) -> np.ndarray:
    """Documents with a full counter: their counts say nothing."""
    return np.array([b"\xff" in c for c in classes], bool)


def _bounds(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Most shingles that each set of ``a`` and its partner in ``b`` can share, by their counts in each class."""
    out = np.full(len(a), 1 << 30, np.int64)
    keys = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    for x, y in np.unique(keys, axis=0):
        at = np.flatnonzero((keys == (x, y)).all(1))
        for part in np.split(at, range(1024, len(at), 1024)):
            one, two = [a[k] for k in part], [b[k] for k in part]
            known = ~(_full(one) | _full(two))
            size = int(min(x, y))
            out[part[known]] = np.minimum(_counts(one, size), _counts(two, size)).sum(1)[known]
    return out


def _profile(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("classes", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        """A row per document, then this task's part of the frequency sketch in chunks."""
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in (part for whole in batches for part in slices(whole)):
            h, n = shingles(_bytes(batch.column(1)), width)
            total += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
            ends = np.cumsum(n)
            sums = []
            for salt in (0x1234567, 0x7654321):
                run_sum = np.concatenate(([0], np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64))).astype(np.uint64)
                sums.append((run_sum[ends] - run_sum[ends - n]).view(np.int64))
            classes = _classes(h, np.repeat(np.arange(len(n)), n), n)
            nulls = pa.nulls(len(n), pa.int32())
            yield pa.record_batch([batch.column(0), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), pa.array(classes, pa.binary()), nulls, pa.nulls(len(n), pa.binary())], schema=schema)
        full = [k for k in range(len(total) // _CHUNK) if total[k * _CHUNK : (k + 1) * _CHUNK].any()]
        empty = pa.nulls(len(full), pa.int64())
        yield pa.record_batch([empty, empty, empty, empty, pa.nulls(len(full), pa.binary()), pa.array(full, pa.int32()), pa.array([total[k * _CHUNK : (k + 1) * _CHUNK].tobytes() for k in full], pa.binary())], schema=schema)

    return run, "doc_id long, n long, k1 long, k2 long, classes binary, chunk int, counts binary"


def _sketch(parts: DataFrame) -> np.ndarray:
    """The corpus' counters, summed over tasks by chunk."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "counts": [total.tobytes()]})

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in parts.groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect():  # at most 64 rows of 32 KB
        out[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = np.frombuffer(row.counts, np.int64)
    return out


def _rare_first(h: np.ndarray, doc: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The order of shingles by document, sketched frequency and hash: one total order for the corpus."""
    count = np.minimum(sketch[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], (1 << 32) - 1).astype(np.uint64)
    return by_doc(doc, h, (count << np.uint64(20)) | (h >> np.uint64(44)))


def _need(na, nb, percent: int):
    """Least intersection of two sets whose Jaccard similarity is at least ``percent`` / 100."""
    return -(-(percent * (na + nb)) // (100 + percent))


def _prefixes(sketch, width: int, percent: int, hot_rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64())), ("hot", pa.list_(pa.bool_()))])

    def run(batches):
        counts = sketch.value
        often = hot_rows + 4 * counts.sum() // len(counts)
        for batch in (part for whole in batches for part in slices(whole)):
            h, n = shingles(_bytes(batch.column(1)), width)
            doc = np.repeat(np.arange(len(n)), n)
            h = h[_rare_first(h, doc, counts)]
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            # A partner of the least size shares at least percent% of this set.
            length = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
            keep = place < np.repeat(length, n)
            offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
            h = h[keep]
            hot = counts[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] > often
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (h.view(np.int64), hot)]
            yield pa.record_batch([batch.column(0), pa.array(n.astype(np.int32)), *lists], schema=schema).filter(pa.array(n > 0))

    return run, "doc_id long, n int, prefix array<long>, hot array<boolean>"


def _sets(bitmap, width: int, sketch=None):
    """Sets of the documents that the map holds: by hash, or rare-first where there is a sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            at = (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
            pick = np.flatnonzero((bitmap.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            if len(pick):
                h, n = shingles(_bytes(batch.column(1).take(pa.array(pick))), width)
                if sketch is not None:
                    h = h[_rare_first(h, np.repeat(np.arange(len(n)), n), sketch.value)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.record_batch([pa.array(ids[pick]), lists], schema=schema)

    return run, "doc_id long, set array<long>"


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bit for each hashed id, put together in the executors by ranges of the map."""

    def run(batches):
        found = np.zeros(1 << MAP_BITS - 3, np.uint8)
        for batch in batches:
            at = (mix(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
            np.bitwise_or.at(found, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        words = found.view("<i8")
        full = np.flatnonzero(words)
        yield pa.record_batch([pa.array(full), pa.array(words[full])], names=["w", "bits"])

    words = ids.mapInArrow(run, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits"))

    def pack(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.column(0).to_numpy().tobytes()], pa.binary()), pa.array([batch.column(1).to_numpy().tobytes()], pa.binary())], names=["w", "bits"])

    out = np.zeros(1 << MAP_BITS - 6, "<i8")
    for row in words.mapInArrow(pack, "w binary, bits binary").collect():  # 4 MB in all at most
        out[np.frombuffer(row.w, np.int64)] = np.frombuffer(row.bits, np.int64)
    return out.view(np.uint8)


@F.pandas_udf(LongType())
def _class_bound(a: pd.Series, b: pd.Series) -> pd.Series:
    """Most shingles two sets can share, from their counts by hashed class."""
    return pd.Series(_bounds(a.tolist(), b.tolist()), dtype="int64")


@F.pandas_udf(LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sizes of the intersections; both lists are sorted as unsigned values and have no repeats."""
    return pd.Series([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def _common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right, counted by matrix products."""
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for values, sets in ((a, left), (b, right)):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(both, values), max(0, len(both) - 1))
        hit = both[at] == values if len(both) else np.zeros(len(values), bool)
        order = np.argsort(at[hit], kind="stable")
        sides.append((row[hit][order], at[hit][order], len(sets)))
    for low in range(0, len(both), _WIDE):
        parts = []
        for row, at, n in sides:
            x, y = np.searchsorted(at, (low, low + _WIDE))
            part = np.zeros((n, min(_WIDE, len(both) - low)), np.float32)
            part[row[x:y], at[x:y] - low] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _candidates(pdf: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the rows of both blocks, and which of their pairs pass the length and positional filters untried."""
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    left, right = np.flatnonzero(pdf["block"] == i), np.flatnonzero(pdf["block"] == j)
    n, pos, comp, ids = (pdf[c].to_numpy() for c in ("n", "pos", "comp", "doc_id"))
    na, nb = n[left, None], n[None, right]
    ok = (comp[left, None] != comp[None, right]) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
    ok &= np.minimum(na - pos[left, None], nb - pos[None, right]) >= _need(na, nb, percent)
    if i == j:
        ok = np.triu(ok, 1)
    for mine, other, turn in ((left, right, False), (right, left, True)):
        hubs = [np.asarray(x, np.int64) for x in pdf["tried"].iloc[mine]]
        row, hub = np.repeat(np.arange(len(mine)), [len(x) for x in hubs]), np.concatenate([*hubs, np.zeros(0, np.int64)])
        if len(other) and len(hub):
            order = np.argsort(ids[other])
            at = np.minimum(np.searchsorted(ids[other][order], hub), len(other) - 1)
            hit = ids[other][order][at] == hub
            row, at = row[hit], order[at[hit]]
            ok[(at, row) if turn else (row, at)] = False
    return _with_pairs(left, right, ok)


def _with_pairs(left: np.ndarray, right: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same without the rows that are left without a pair."""
    rows, columns = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
    return left[rows], right[columns], ok[np.ix_(rows, columns)]


_ROW = {"token": "long", "i": "int", "j": "int", "block": "int", "doc_id": "long", "n": "int", "pos": "long", "comp": "long", "tried": "array<long>"}
#: A block's pairs come one by one if there are no more than so many for each of its documents.
PAIRS = 4


def _block_rows(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The pairs of two blocks of an n-gram's documents that pass the suffix filter: a few as pairs, many by their rows."""
        left, right, ok = _candidates(pdf, percent)
        # What two sets share can't exceed what they share in each class of hashed shingles: few classes, then all.
        n, classes = pdf["n"].to_numpy(), pdf["classes"].tolist()
        groups = [_by_size([classes[k] for k in side]) for side in (left, right)]
        for x, rows in groups[0].items():
            for y, columns in groups[1].items():
                one, two = [classes[k] for k in left[rows]], [classes[k] for k in right[columns]]
                ca, cb = (_counts(c, min(x, y)) for c in (one, two))
                sa, sb = (_counts(c, COARSE) for c in (one, two))
                known = ~_full(one)[:, None] & ~_full(two)[None, :]
                for k, row in enumerate(rows):
                    at = np.flatnonzero(ok[row, columns] & known[k])
                    if len(at):
                        need = _need(n[left[row]], n[right[columns[at]]], percent)
                        pass_ = np.minimum(sa[k], sb[at]).sum(1) >= need
                        pass_[pass_] = np.minimum(ca[k], cb[at[pass_]]).sum(1) >= need[pass_]
                        ok[row, columns[at]] = pass_
        left, right, ok = _with_pairs(left, right, ok)
        if ok.sum() <= PAIRS * (len(left) + len(right)):
            ids, (x, y) = pdf["doc_id"].to_numpy(), np.nonzero(ok)
            both = np.stack((ids[left[x]], ids[right[y]]))
            out = pd.DataFrame({c: np.zeros(len(x), np.int64) for c in _ROW} | {"a": both.min(0), "b": both.max(0), "pair": True})
            return out.assign(tried=pd.Series([np.zeros(0, np.int64)] * len(x), dtype=object))
        return pdf.iloc[np.union1d(left, right)][list(_ROW)].assign(a=0, b=0, pair=False)

    return run


def _block_links(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between two blocks of an n-gram's documents; of those, only as many as span what is connected.

        A pair is verified at the first n-gram of its prefixes that both have, and nowhere else, unless it was
        tried with a hub.
        """
        left, right, ok = _candidates(pdf, percent)
        if not len(left):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        n, pos, ids = (pdf[c].to_numpy() for c in ("n", "pos", "doc_id"))
        sets = {k: np.asarray(pdf["set"].iloc[k], np.int64) for k in {*left, *right}}
        before = _common_counts([sets[k][: pos[k]] for k in left], [sets[k][: pos[k]] for k in right])
        left, right, ok = _with_pairs(left, right, ok & (before == 0))
        if not len(left):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        common = _common_counts([sets[k] for k in left], [sets[k] for k in right])
        x, y = np.nonzero(ok & (common >= _need(n[left, None], n[None, right], percent)))
        comp = spanning(left[x], right[y], len(pdf))
        some = np.flatnonzero(comp != np.arange(len(pdf)))
        return pd.DataFrame({"a": ids[comp[some]], "b": ids[some]})

    return run


def _fits(percent: int, na: str, nb: str, pa_: str, pb: str):
    """Length and positional filter of two documents at an n-gram both have in their prefixes.

    At the first n-gram that a linked pair shares, all it shares lies from there on; so a pair may be
    left out wherever what lies ahead is too little, and is still found at its first shared n-gram.
    """
    long_enough = F.expr(f"100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb})")
    most = f"least({na} - {pa_}, {nb} - {pb})"
    return long_enough & F.expr(f"{100 + percent} * ({most}) >= {percent} * ({na} + {nb})")


class _Join:
    def __init__(self, docs: DataFrame, width: int, percent: int, sketch, profile: DataFrame) -> None:
        self.docs, self.width, self.percent, self.spark, self.sketch = docs, width, percent, docs.sparkSession, sketch
        self.profile = profile.select("doc_id", "n", "classes")

    def sets(self, ids: DataFrame, sketch=None) -> DataFrame:
        """``doc_id, set`` of these documents, made again from their texts; few others come along."""
        bitmap = self.spark.sparkContext.broadcast(_bitmap(ids))
        run, schema = _sets(bitmap, self.width, sketch)
        return staged(self.docs.where("doc_id is not null").mapInArrow(run, schema), "sets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` that link. Each comes once; sets are made again from the texts of its documents."""
        one, two = (self.profile.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("classes").alias(f"c{x}")) for x in "ab")
        pairs = pairs.join(one, "a").join(two, "b").withColumn("most", _class_bound("ca", "cb"))
        need = lambda c: F.expr(f"{100 + self.percent} * {c} >= {self.percent} * (na + nb)")
        pairs = staged(pairs.where(need("most")).select("a", "b", "na", "nb"), "pairs")
        # The few documents that the map lets through by chance fall out in the joins.
        sets = self.sets(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
        first, second = (sets.select(F.col("doc_id").alias(x), F.col("set").alias(f"s{x}")) for x in "ab")
        both = pairs.join(first, "a").join(second, "b").withColumn("common", _common("sa", "sb"))
        links = staged(both.where(need("common")).select("a", "b"), "links")
        unstage(sets, pairs)
        return links

    def hub_pairs(self, rows: DataFrame, hubs: list[str]) -> DataFrame:
        """``doc_id, hub`` for each document and hub of an n-gram that pass the filters."""
        out = None
        for h in hubs:
            own = rows.select("doc_id", "n", "pos", F.col(f"{h}.doc_id").alias("hub"), _size(f"{h}.at").alias("nh"), _place(f"{h}.at").alias("posh"))
            own = own.where("doc_id <> hub").where(_fits(self.percent, "n", "nh", "pos", "posh")).select("doc_id", "hub")
            out = own if out is None else out.union(own)
        return out.distinct()

    def in_blocks(self, rows: DataFrame, tried: DataFrame) -> DataFrame:
        """Links that span what is connected among the documents of n-grams that many share.

        ``rows`` has ``token, doc_id, n, pos, comp, major, minor, c, shingles``. Documents of the n-gram's
        largest component (``major``) are not compared with each other: they are spread over blocks of
        their own, and only the others' blocks are compared with all.
        """
        none = F.array().cast("array<long>")
        own = tried.groupBy("doc_id").agg(F.collect_set("hub").alias("tried"))
        is_major = F.col("comp") == F.col("major")
        weight = F.greatest(F.lit(1.0 / BLOCK), F.col("shingles") / F.col("c") / BLOCK_SHINGLES)
        few = F.greatest(F.lit(1), F.ceil(F.col("minor") * weight)).cast("int")
        many = F.ceil((F.col("c") - F.col("minor")) * weight).cast("int")
        rows = rows.withColumns({"few": few, "many": many})
        spread = F.when(is_major, F.col("few") + F.pmod(F.xxhash64("doc_id"), F.col("many"))).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("few")))
        with_ = F.when(is_major, F.sequence(F.lit(0), F.col("few") - 1)).otherwise(F.sequence(F.lit(0), F.col("few") + F.col("many") - 1))
        rows = rows.select("token", "doc_id", "n", "pos", "comp", spread.cast("int").alias("block"), with_.alias("with"))
        rows = rows.join(self.profile.select("doc_id", "classes"), "doc_id").join(own, "doc_id", "left").withColumn("tried", F.coalesce("tried", none))
        rows = rows.withColumn("other", F.explode("with")).drop("with")
        rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
        found = staged(rows.groupBy("token", "i", "j").applyInPandas(_block_rows(self.percent), ", ".join(f"{k} {v}" for k, v in _ROW.items()) + ", a long, b long, pair boolean"), "block-rows")
        few = staged(found.where("pair").select("a", "b").distinct(), "few-pairs")
        links = self.verified(few)
        # Where many pairs are left, sets are sent to the blocks; pairs that came one by one count as tried there.
        rows = found.where("not pair").drop("a", "b", "pair")
        own = few.groupBy(F.col("a").alias("doc_id")).agg(F.collect_set("b").alias("more"))
        rows = rows.join(own, "doc_id", "left").withColumn("tried", F.concat("tried", F.coalesce("more", none))).drop("more")
        sets = self.sets(rows.select("doc_id").distinct(), self.sketch)
        more = staged(rows.join(sets, "doc_id").groupBy("token", "i", "j").applyInPandas(_block_links(self.percent), "a long, b long"), "block-links")
        unstage(sets, few, found)
        return links.union(more)


def _size(at: str):
    return F.shiftright(at, 32).bitwiseAND(F.lit(0x7FFFFFFF))


def _place(at: str):
    return F.col(at).bitwiseAND(F.lit(0xFFFFFFFF))


def _hub_columns(salt: int) -> dict:
    """Aggregates that pick three documents of an n-gram: by id in the first round, by salted hashes otherwise."""
    mine = F.struct("doc_id", "at")
    salted = F.struct(F.xxhash64(F.col("doc_id"), F.lit(salt + 1)).alias("h"), "doc_id", "at")
    other = F.struct(F.xxhash64(F.col("doc_id"), F.lit(-salt)).alias("h"), "doc_id", "at")
    return {"h0": F.min(other if salt else mine), "h1": F.min(salted), "h2": F.max(salted)}


_HUBS = ["h0", "h1", "h2"]


def ngram_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct
    ``width``-word shingles of the lower-cased (A-Z) text; ``component_id`` is the smallest id reachable
    by links. A text of fewer words has its whole sequence as one shingle; null and empty texts and
    those without words have none and link with nothing. Ids are expected to be unique; rows that
    repeat an id are one document that has the links of any of them, with each row's own
    ``n_shingles``. Rows with a null id link with nothing and have a null component. Other columns
    are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    run, schema = _profile(width)
    both = staged(docs.mapInArrow(run, schema), "profile")
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(both.where("chunk is not null").select("chunk", "counts")))
    profile = both.where("chunk is null")
    join = _Join(docs, width, percent, sketch, profile)

    # Documents with equal sets are one from here on.
    some = profile.where("n > 0 and doc_id is not null")
    classes = some.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"))
    members = staged(some.select("doc_id", "n", "k1", "k2").join(classes, ["n", "k1", "k2"]).select("doc_id", "rep"), "members")
    reps = members.where("doc_id = rep").select("doc_id").distinct()

    run, schema = _prefixes(sketch, width, percent, HOT_ROWS)
    prefix = docs.where("doc_id is not null").mapInArrow(run, schema).join(reps, "doc_id")
    prefix = prefix.select("doc_id", "n", F.posexplode(F.arrays_zip("prefix", "hot")).alias("pos", "x"))
    # One shuffle of all prefixes, of three numbers a row. The sketch bounds a group's rows; n-grams that
    # may have more are salted, which the top bit of ``at`` says; the salt follows from the document.
    mask = F.xxhash64(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    at = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos")).bitwiseOR(F.when(F.col("x.hot"), F.lit(-(2**63))).otherwise(F.lit(0)))
    token = F.when(F.col("x.hot"), F.col("x.prefix").bitwiseXOR(mask)).otherwise(F.col("x.prefix"))
    prefix = prefix.select(token.alias("token"), "doc_id", at.alias("at"))
    group = Window.partitionBy("token")
    hubs = {"c": F.count(F.lit(1))} | _hub_columns(0)
    # A round of hubs: each document is compared with a few of those it shares an n-gram with.
    found = staged(prefix.withColumns({k: v.over(group) for k, v in hubs.items()}).where("c > 1 or at < 0"), "shared")
    hot = found.where("at < 0").drop(*hubs).withColumn("token", F.col("token").bitwiseXOR(mask))
    # The aggregate is a table of its own, so that the join's other side can be split where a token is frequent.
    tops = staged(hot.groupBy("token").agg(*[v.alias(k) for k, v in hubs.items()]).where("c > 1"), "tops")
    hot = hot.join(tops, "token")
    shared = found.where("at >= 0").unionByName(hot.select(*found.columns)).withColumns({"n": _size("at"), "pos": _place("at")})
    tried = staged(join.hub_pairs(shared, _HUBS), "hub-pairs")
    pairs = lambda t: t.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()
    links = join.verified(pairs(tried))

    # All other pairs that share a prefix n-gram and are not yet known to be connected.
    label = components(links, "hub-comps")
    # Where all documents but one are hubs, all pairs have been tried.
    left_over = F.col("c") - F.size(F.array_distinct(F.array(*[f"{h}.doc_id" for h in _HUBS]))) > 1
    shared = shared.where(left_over).select("token", "doc_id", "n", "pos", "at", "c")
    labelled = lambda rows, label: rows.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component_id", "doc_id")).drop("component_id")
    rows = labelled(shared, label)
    hot, least, most = rows.where("at < 0"), F.min("comp"), F.max("comp")
    open_tokens = staged(hot.groupBy("token").agg(least.alias("x"), most.alias("y")).where("x <> y").select("token"), "open-hot")
    cold = rows.where("at >= 0").withColumns({"x": least.over(group), "y": most.over(group)}).where("x <> y")
    rows = staged(cold.select(*rows.columns).unionByName(hot.join(open_tokens, "token").select(*rows.columns)), "open")
    unstage(found, tops, open_tokens)
    small = rows.where(F.col("c") <= FEW)
    left, right = (small.select("token", *[F.col(c).alias(f"{c}{x}") for c in ("doc_id", "n", "pos", "comp")]) for x in "ab")
    near = (F.col("doc_ida") < F.col("doc_idb")) & (F.col("compa") != F.col("compb")) & _fits(percent, "na", "nb", "posa", "posb")
    few = left.join(right, "token").where(near).select(F.col("doc_ida").alias("a"), F.col("doc_idb").alias("b"))
    few = staged(few.distinct().join(pairs(tried), ["a", "b"], "left_anti"), "rest-pairs")
    links = links.union(join.verified(few))
    unstage(few)

    rows, work = rows.where(F.col("c") > FEW).drop("comp"), None
    for k in range(1, ROUNDS + 1):
        large = _open_groups(labelled(rows, label))
        open_pairs = large.agg(F.max(F.col("minor").cast("double") * F.col("c")).alias("most"), F.sum(F.col("minor").cast("double") * F.col("c")).alias("all")).first()
        if k == ROUNDS or (open_pairs["most"] or 0) <= WORK or work is not None and open_pairs["all"] > 0.75 * work:
            break
        work = open_pairs["all"]
        rows = staged(rows.join(large.select("token"), "token", "left_semi"), f"open-{k}")
        tops = staged(rows.groupBy("token").agg(*[v.alias(h) for h, v in _hub_columns(k).items()]), f"tops-{k}")
        more = join.hub_pairs(rows.join(tops, "token"), _HUBS).join(tried, ["doc_id", "hub"], "left_anti")
        more = staged(more.join(tried.select(F.col("doc_id").alias("hub"), F.col("hub").alias("doc_id")), ["doc_id", "hub"], "left_anti"), f"hub-pairs-{k}")
        links = staged(links.union(join.verified(pairs(more))), f"links-{k}")
        tried = staged(tried.union(more), f"tried-{k}")
        label = components(links, f"comps-{k}")
    rows = labelled(rows.drop("c"), label).join(large, "token")
    links = links.union(join.in_blocks(rows, tried))

    label = components(links, "comps").select(F.col("id").alias("rep"), "component_id")
    unstage(tried)
    member = members.join(label, "rep", "left").select("doc_id", F.coalesce("component_id", "rep").alias("component_id"))
    member = member.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    # The smallest id of a class is its representative, so the smallest representative is the smallest id.
    out = profile.select("doc_id", F.col("n").alias("n_shingles")).join(member, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _open_groups(rows: DataFrame) -> DataFrame:
    """``token, major, minor, c, shingles`` of the n-grams whose documents are not all in one component.

    ``major`` is the component that has most of them, ``minor`` the number of documents outside of it.
    """
    by_comp = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    out = by_comp.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("major"), F.max("k").alias("most"), F.sum("k").alias("c"), F.sum("s").alias("shingles"))
    out = out.select("token", "major", (F.col("c") - F.col("most")).alias("minor"), "c", "shingles")
    return staged(out.where("minor > 0"), "groups")
