import re
from collections import defaultdict

import numpy as np
import pytest

from prosaic.llm import exact_dedup, fuse


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 40_000])
def test_filters_never_lose_a_key(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    built = fuse.build(keys)
    assert fuse.probe(keys, *built).all()
    others = np.random.default_rng(n + 1).integers(0, 1 << 63, 100_000, dtype=np.uint64)
    assert fuse.probe(others[~np.isin(others, keys)], *built).mean() < 0.001


def test_empty_filter():
    assert not fuse.probe(np.arange(3, dtype=np.uint64), *fuse.build(np.zeros(0, np.uint64))).any()


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def check(frame):
    rows = [(r.doc_id, norm(r.text)) for r in frame.collect()]
    groups = defaultdict(list)
    for key, text in rows:
        groups[text].append(key)
    want = []
    for text, keys in groups.items():
        least = min((k for k in keys if k is not None), default=None)
        first = True
        for k in sorted(keys, key=lambda k: (k is None, k)):
            want.append((k, least, len(keys), first))
            first = False
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(frame).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = exact_dedup.keep_first(frame)
    assert kept.columns == frame.columns
    assert sorted(norm(r.text) for r in kept.select("text").collect()) == sorted(groups)


def test_odd_rows(odd, empty):
    check(odd)
    assert exact_dedup.deduplicate(empty).count() == 0 and exact_dedup.keep_first(empty).count() == 0


def test_copies_within_and_across_batches(spark):
    rows = [(i, f"text {i % 37}\n" if i % 2 else f"text  {i % 37} ") for i in range(300)] + [(1000 + i, f"new {i % 5}") for i in range(20)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_digests_that_collide_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "sha2", lambda c, n: F.lit("ab" * 32))
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "b"), (6, "")]
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 2, True), (2, 2, 2, True), (3, 1, 2, False), (4, 4, 2, True), (5, 2, 2, False), (6, 4, 2, False)]


def test_screening(spark):
    from prosaic.llm.scratch import Scratch

    old = spark.createDataFrame([(i, f"t{i}") for i in range(500)], "doc_id long, text string")
    new = spark.createDataFrame([(i, f"t{i}") for i in range(400, 900)], "doc_id long, text string")
    snap = exact_dedup.snapshot(exact_dedup.group(exact_dedup.digests(old, "doc_id", "text")), Scratch(spark, "test"), "old")
    found = exact_dedup.screen(exact_dedup.group(exact_dedup.digests(new, "doc_id", "text")), snap)
    both = found.join(snap.groups, "sha", "left_semi").count()
    assert both == 100 and found.count() < 110


def test_ids_of_any_type(spark):
    rows = [(f"doc-{i:03}", f"text {i % 7}") for i in range(60)] + [(None, "text 1"), (None, "alone"), ("doc-000", "text 0")]
    check(spark.createDataFrame(rows, "doc_id string, text string").repartition(3))
    far = [(-(1 << 63), "a"), ((1 << 63) - 1, "a"), (0, "b"), (1, "b"), (2, "c"), (None, "c")]
    check(spark.createDataFrame(far, "doc_id long, text string"))


def brute_ingest(old, new):
    out = []
    for key, text in new:
        here = [k for k, t in old if norm(t) == norm(text)]
        also = [k for k, t in new if norm(t) == norm(text)]
        order = lambda ids: sorted(ids, key=lambda k: (k is None, k))
        out.append((key, order(here or also)[0], len(here) + len(also), not here))
    return out


@pytest.mark.parametrize("old", [[], [(5, "one  row")], [(100 + i, f"t{i % 40}") for i in range(90)] + [(None, "t3"), (7, None)]])
def test_batches_are_ingested_against_a_stored_snapshot(spark, tmp_path, old):
    new = [(i, f"t{i}" if i % 3 else " one\trow") for i in range(30, 60)] + [(900, ""), (901, None), (None, "only here")]
    held, batch = (spark.createDataFrame(x, "doc_id long, text string").repartition(3) for x in (old, new))
    exact_dedup.freeze(held, f"file://{tmp_path}/first")
    snap = exact_dedup.load(spark, f"file://{tmp_path}/first")
    got = exact_dedup.ingest(batch, snap, held).collect()
    want = brute_ingest(old, new)
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size) for r in got) == sorted((repr(k), repr(f), n) for k, f, n, _ in want)
    seen = {norm(t) for _, t in old}
    assert len([r for r in got if r.kept]) == len({norm(t) for _, t in new} - seen)
    # everything is known to the next snapshot, and what stayed still stays
    after = exact_dedup.merge(snap, batch, f"file://{tmp_path}/second")
    again = exact_dedup.ingest(batch, after, held.union(batch)).collect()
    assert not any(r.kept for r in again)
    assert {(r.text_sha256, r.keep_id) for r in again} == {(r.text_sha256, r.keep_id) for r in got}


def test_tasks_that_screen_are_bounded_by_the_batch(spark, monkeypatch):
    from prosaic.llm.scratch import Scratch

    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 50)
    one, many = (spark.createDataFrame([(i, f"t{i}") for i in range(a, b)], "doc_id long, text string") for a, b in ((0, 1), (0, 1000)))
    snap = exact_dedup.snapshot(exact_dedup.group(exact_dedup.digests(one, "doc_id", "text")), Scratch(spark, "test"), "old")
    assert snap.shards == 1
    found = exact_dedup.screen(exact_dedup.group(exact_dedup.digests(many, "doc_id", "text")), snap)
    assert found.join(snap.groups, "sha", "left_semi").count() == 1 and found.count() < 10


def test_batches_whose_digests_collide(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "sha2", lambda c, n: F.lit("ab" * 32))
    held, batch = (spark.createDataFrame(x, "doc_id long, text string") for x in ([(5, "a"), (6, "b")], [(1, "b"), (2, "c"), (3, "c")]))
    snap = exact_dedup.freeze(held, f"file://{tmp_path}/snap")
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.ingest(batch, snap, held).collect())
    assert got == [(1, 6, 2, False), (2, 2, 2, True), (3, 2, 2, False)]
