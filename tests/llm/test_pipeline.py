"""Each stage of the pipeline against brute force over what the stage before it kept."""

import hashlib
from collections import defaultdict

import corpus_pipeline as C
import pytest
from test_llm_operators import components_of, shingle_set

from tessella.llm import secret_scan as S
from tessella.llm.quality import quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents, then what each stage returns, written and read again."""
    top, out = tmp_path_factory.mktemp("stages"), [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"file://{top}/{k}")
        out.append(spark.read.parquet(f"file://{top}/{k}"))
    return out


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def test_columns(steps):
    assert all(df.columns == steps[0].columns for df in steps[:-1])


def test_quality(spark, steps):
    scored = quality(steps[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert set(texts(steps[1])) == {r.doc_id for r in scored if r.predicted}
    assert 0 < len(texts(steps[1])) < len(texts(steps[0]))


def test_exact(steps):
    groups = defaultdict(list)
    for k, t in texts(steps[1]).items():
        groups[hashlib.sha256(t.encode()).digest()].append(k)
    assert set(texts(steps[2])) == {max(g) for g in groups.values()}


def test_near(steps):
    sets = {k: shingle_set(t) for k, t in texts(steps[2]).items()}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = components_of(ids, links)
    assert set(texts(steps[3])) == set(root.values())


def test_secrets(steps):
    before, after = texts(steps[3]), texts(steps[4])
    assert set(before) == set(after)
    field = S.default_field()
    for k, t in before.items():
        spans = S.secret_spans([t], field)[0][1]
        assert (after[k] == t) == (not spans)
        assert all(t[a:b] not in after[k] for a, b, _ in spans)


def test_packing(steps):
    rows = steps[5].collect()
    assert {r.doc_id for r in rows} == set(texts(steps[4]))
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_is_the_stages(spark, steps):
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, C.run(spark, SF).collect())) == sorted(map(key, steps[5].collect()))


def test_null_and_repeated_ids(spark, steps):
    """Each row is judged by its own text: by the classifier, among equal texts and among near copies."""
    raw, n = steps[0], len(steps[0].columns)
    scored = quality(raw, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    good = max(scored, key=lambda r: r.score).doc_id
    bad = min(scored, key=lambda r: r.score).doc_id
    by_id = {r.doc_id: r for r in raw.where(f"doc_id in ({good}, {bad})").collect()}
    row = lambda r, **new: tuple({**r.asDict(), **new}[c] for c in raw.columns)
    table = lambda rows: spark.createDataFrame(rows, raw.schema).repartition(3)
    found = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    more = table([row(by_id[good], doc_id=None), row(by_id[bad], doc_id=None), row(by_id[bad], doc_id=good)])
    kept = C.quality_classifier(spark, raw.union(more), SF)
    assert len(kept.columns) == n and kept.where("doc_id is null").count() == 1
    assert [r.text for r in kept.where(f"doc_id = {good}").collect()] == [by_id[good].text]

    any_row = by_id[good]
    docs = table([row(any_row, doc_id=k, text=t) for k, t in [(1, "a"), (2, "a"), (1, "b"), (1, "b"), (None, "a"), (None, "c"), (None, "c"), (3, None), (2, "")]])
    assert found(C.drop_copies(spark, docs, SF)) == sorted([(2, "a"), (1, "b"), (None, "c"), (3, None)], key=repr)

    base = [f"word{k}" for k in range(60)]
    x, y, other = " ".join(base), " ".join([*base, "end"]), " ".join(f"other{k}" for k in range(60))
    docs = table([row(any_row, doc_id=k, text=t) for k, t in [(5, x), (4, y), (4, other), (None, y + " here"), (None, "alone in the whole world"), (None, ""), (7, None)]])
    assert found(C.drop_near_copies(spark, docs, SF)) == sorted([(4, y), (4, other), (None, "alone in the whole world"), (None, ""), (7, None)], key=repr)


def test_empty_tables(spark, steps):
    for k, (_, stage) in enumerate(C.STAGES):
        assert stage(spark, steps[k].limit(0), SF).count() == 0
