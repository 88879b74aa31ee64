from collections import defaultdict

import numpy as np
import pytest

from prosaic.llm import jaccard_join
from tests.llm.test_decontaminate import words


def sets(docs):
    out = {}
    for key, text in docs:
        own = words(text)
        out[key] = frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else None
    return out


def brute(docs):
    s = sets(docs)
    parent = {k: k for k in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = defaultdict(set)
    keys = [k for k in s if s[k]]
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
                if s[a] != s[b]:
                    links[a].add(s[b])
                    links[b].add(s[a])
    return {k: (find(k), len(links[k])) for k in s}


def corpus(seed, families, size):
    draw = np.random.default_rng(seed)
    rows = []
    for f in range(families):
        base = [f"w{f}x{i}" for i in range(int(draw.integers(20, 150)))]
        shared = [f"common{i}" for i in range(30)] if f % 2 else []
        for _ in range(int(draw.integers(1, size))):
            own = list(base)
            for _ in range(int(draw.integers(0, 4))):
                own[int(draw.integers(len(own)))] = f"new{draw.integers(1 << 30)}"
            rows.append((len(rows), " ".join(own + shared)))
    return rows


@pytest.mark.parametrize(("families", "size"), [(40, 6), (3, 60)])
def test_matches_brute_force(spark, monkeypatch, families, size):
    if size > 50:  # make buckets large and blocks many
        monkeypatch.setattr(jaccard_join, "SMALL", 8)
        monkeypatch.setattr(jaccard_join, "BLOCK", 10)
    docs = corpus(1, families, size)
    want = brute(docs)
    got = jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == want
    kept = jaccard_join.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in want.values()})


def test_odd_rows(odd, empty):
    got = jaccard_join.join(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.class_id, r.n_links))
    assert by[1] == by[2] == {(1, 0)} and by[8] == {(7, 1)} and by[3] == {(3, 0)} and by[12] == {(11, 0)} and by[None] == {(None, 0)}
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(map(str, [1, 3, 4, 5, 6, 7, 9, 10, 11, None, None]))
    assert jaccard_join.join(empty).count() == 0 and jaccard_join.keep_one(empty).count() == 0


def test_ids_that_share_different_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, None)]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 0)]


def test_one_row_of_each_class_stays_where_ids_are_reused(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c + " more"), (3, c.upper()), (4, c + " more"), (5, b + " more"), (5, c)]
    kept = [(r.doc_id, r.text) for r in jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(k for k in kept if k[0] < 3) == [(1, a), (2, b)]
    assert len(kept) == 3 and [k[0] for k in kept if k[0] > 2] == [3]


def test_runs_meet_the_recall():
    assert jaccard_join.runs_needed(0.99, 1.25, 1) == 4
    assert jaccard_join.runs_needed(jaccard_join.RECALL, jaccard_join.BRANCHING, jaccard_join.DEPTH) >= 10


def near_copies(seed, number, swaps):
    """Texts around one base, so that links lie about the threshold, in buckets larger than the shipped bound."""
    draw = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(220)]
    rows = []
    for k in range(number):
        own = list(base)
        for _ in range(int(draw.integers(*swaps))):
            own[int(draw.integers(len(own)))] = f"new{draw.integers(1 << 40)}"
        rows.append((k, " ".join(own)))
    return rows


def test_no_link_about_the_threshold_is_lost_in_large_buckets(spark):
    docs = near_copies(5, 700, (2, 9))
    s = sets(docs)
    number = {}
    matrix = np.zeros((len(docs), 220 * 20), np.float32)
    for k, own in s.items():
        for x in own:
            column = number.setdefault(x, len(number))
            if column >= matrix.shape[1]:
                matrix = np.pad(matrix, ((0, 0), (0, matrix.shape[1])))
            matrix[k, column] = 1
    common, size = matrix @ matrix.T, matrix.sum(1)
    likeness = common / (size[:, None] + size[None, :] - common)
    link = (likeness >= 0.8 - 1e-6) & ~np.eye(len(docs), dtype=bool)
    narrow = link & (likeness < 0.85)
    assert narrow.sum() > 2 * 1000 and jaccard_join.SMALL < len(docs)
    label = np.arange(len(docs))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(docs)).min(1))
        if (new == label).all():
            break
        label = new
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.join(frame).collect()}
    assert got == {k: (int(label[k]), int(link[k].sum())) for k in range(len(docs))}
    assert sorted(r.doc_id for r in jaccard_join.keep_one(frame).collect()) == sorted(set(label.tolist()))


@pytest.mark.parametrize("swaps", [(0, 6), (4, 14)])
def test_classes_alone_need_not_compare_all_blocks(spark, monkeypatch, swaps):
    monkeypatch.setattr(jaccard_join, "BLOCK", 15)
    docs = near_copies(9, 90, swaps) + [(1000 + k, t + " " + t) for k, t in near_copies(10, 40, swaps)]
    want = brute(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in jaccard_join.keep_one(frame).collect()) == sorted({c for c, _ in want.values()})


def test_components_of_hubs_and_paths(spark, monkeypatch):
    from prosaic.llm import components
    from prosaic.llm.scratch import Scratch

    edges = [(0, k) for k in range(1, 1500)] + [(k, 5000) for k in range(2000, 2700)] + [(k, k + 1) for k in range(3000, 3060)] + [(899, 2000)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = {r.node: r.root for r in components.components(frame, Scratch(spark, "test"), "c").collect()}
    want = {k: 0 for e in edges if not 3000 <= e[0] < 3060 for k in e} | {k: 3000 for k in range(3000, 3061)}
    assert got == want
    monkeypatch.setattr(components, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        components.components(frame, Scratch(spark, "test"), "d")
