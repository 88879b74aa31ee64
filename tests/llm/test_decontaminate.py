import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from prosaic.llm import decontaminate
from prosaic.llm.fm_index import FMIndex

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def brute(docs, items, window=13):
    found = {}
    for name, text in items:
        own = words(text)
        width = min(window, len(own))
        for i in range(len(own) - width + 1 if width else 0):
            found.setdefault(tuple(own[i : i + width]), set()).add("" if name is None else str(name))
    widths, out = {len(w) for w in found}, []
    for key, text in docs:
        own, hit, named = words(text), set(), set()
        for width in widths:
            for i in range(len(own) - width + 1):
                if tuple(own[i : i + width]) in found:
                    hit |= set(range(i, i + width))
                    named |= found[tuple(own[i : i + width])]
        out.append((key, len(own), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.integers(0, 3), min_size=1, max_size=4))
def test_index_finds_every_occurrence(text, pattern):
    text, pattern = np.array(text), np.array(pattern)
    index = FMIndex(text, 4)
    low, high = index.search(pattern[None])
    want = [i for i in range(len(text) - len(pattern) + 1) if (text[i : i + len(pattern)] == pattern).all()]
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_matches_brute_force(spark, odd):
    passage = "A passage of exactly so many words that it makes more than one window of them all."
    items = [(1, passage), (2, "the lazy dog and runs away"), (2, "short"), (None, "with tabs"), (4, None), (5, ""), (6, "!!!"), (10, "dog and")]
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()] + [(20, f"before {passage} after " + "filler " * 500), (21, passage.upper() * 2), (22, "makes more than one window of")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(docs, items), key=repr)
    for options in ({}, {"block_bytes": 40}):
        got = decontaminate.report(frame, bench, **options).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
        assert sorted(map(tuple, got), key=repr) == want
    kept = decontaminate.remove_contaminated(frame, bench)
    assert kept.columns == frame.columns and kept.count() == sum(not w[-1] for w in want)


def test_empty_tables(spark, odd, empty):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.report(empty, bench).count() == 0
    assert decontaminate.report(odd, bench.limit(0)).filter("n_hit = 0 and not contaminated").count() == odd.count()
    assert decontaminate.remove_contaminated(odd, bench).columns == odd.columns
