import random
import textwrap
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prosaic.llm import histogram_shard, language_id, license_scan, token_count

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_token_counts_match_the_library(spark, odd, empty, library):
    draw = random.Random(1)
    pool = [chr(c) for c in range(1, 0x250)] + list("'s't're") * 10 + ["<|endoftext|>", "<|startoftext|>", "Σ", "İ", "中", "😀", "Ⅷ", "²", "ﬁ", " ", "　"]
    texts = ["".join(draw.choice(pool) for _ in range(draw.randrange(30))) for _ in range(1500)]
    counter = token_count.Counter(PATH)
    assert [counter.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    for r in token_count.counts(odd, PATH).join(odd.select("doc_id", "text"), "doc_id").collect():
        if r.doc_id != 2:  # repeated
            text = r.text or ""
            assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))
            assert r.over_limit == (r.n_tokens > 2048)
    assert token_count.counts(odd, PATH).count() == odd.count() and token_count.counts(empty, PATH).count() == 0


@pytest.mark.parametrize("context", ["у{}", "ω{}", "{}'s", "1{}1", "!{}"])
def test_token_counts_match_the_library_on_every_code_point(library, context):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(context.format(c) for c in points[i : i + 32]) for i in range(0, len(points), 32)]
    counter = token_count.Counter(PATH)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t) for t in texts] == want


def test_token_counts_match_the_library_on_mixed_texts(library):
    draw = random.Random(8)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    common = [chr(c) for c in range(0x3000)] + list("'s't're 'll 19") * 40 + ["e\u0301", "<|endoftext|>", "<|startoftext|>", "Σ", "İ"] * 20
    texts = ["".join(draw.choice(points if draw.random() < 0.1 else common) for _ in range(draw.randrange(25))) for _ in range(20_000)]
    counter = token_count.Counter(PATH)
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_merging_is_by_rank_then_place():
    vocabulary = {c: i for i, c in enumerate(token_count.byte_letters())}
    for x in ("ab", "ba", "aba", "aa"):
        vocabulary[x] = len(vocabulary)
    merger = token_count.PairMerger(vocabulary, ["a b", "b a", "ab a", "a a"], "")
    assert merger.count(b"ababa") == 2  # ab ab a -> ab aba
    assert merger.count(b"aaaa") == 2 and merger.count(b"aaa") == 2 and merger.count(b"z") == 1 and merger.count(b"") == 0


def check_shards(frame, shards=8):
    rows = histogram_shard.shard(frame, shards).collect()
    texts = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in frame.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == texts
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes, rows


def test_shards_are_even_and_keep_copies_together(spark):
    rows = [(i, f"text {i} " + "x" * (i % 97)) for i in range(3000)] + [(5000 + i, "copies of one text" * 3) for i in range(300)] + [(9000 + i, "") for i in range(1500)]
    sizes, out = check_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert max(sizes.values()) < 1.02 * min(sizes.values())
    by = defaultdict(set)
    for r in out:
        by[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in by.values())


def test_a_group_larger_than_a_shard_is_cut(spark):
    rows = [(i, "the same text again") for i in range(2000)] + [(5000 + i, f"other text {i}") for i in range(500)]
    sizes, _ = check_shards(spark.createDataFrame(rows, "doc_id long, text string"))
    assert max(sizes.values()) < 1.05 * min(sizes.values())


@pytest.mark.parametrize("shares, cut", [((0.7, 0.7, 0.7), 0), ((2.67, 0.9), 1), ((0.7,) * 11, 3), ((1.6, 1.6, 0.35, 0.35), 2)])
def test_shards_are_even_beside_heavy_groups(spark, shares, cut):
    share = 100_000
    rows = [(g, f"group {g:02} " + "x" * 90) for g, n in enumerate(shares) for _ in range(round(n * share / 100))]
    rows += [(0, f"light {i:06} " + "y" * (i % 83)) for i in range(round((8 - sum(shares)) * share / 55.5))]
    frame = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string").repartition(5)
    sizes, out = check_shards(frame)
    assert len(sizes) == 8 and max(sizes.values()) < 1.01 * min(sizes.values())
    by = defaultdict(set)
    for r in out:
        by[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in by.values()) == cut


def test_odd_shards(odd, empty, spark):
    check_shards(odd.select("doc_id", "text"))
    assert histogram_shard.shard(odd).count() == odd.count() and histogram_shard.shard(empty).count() == 0
    check_shards(spark.createDataFrame([(1, "one")], "doc_id long, text string"))
    check_shards(spark.createDataFrame([(1, "same"), (2, "same"), (3, None)], "doc_id long, text string"))


def test_sharding_has_no_python_in_the_plan(odd):
    plan = histogram_shard.shard(odd)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def brute_license(unit):
    from tests.llm.test_decontaminate import words

    def grams(text):
        own = words(text)
        return {tuple(own[i : i + 2]) for i in range(max(1, len(own) - 1))} if own else set()

    best = (0.0, None)
    for name, template in license_scan.TEMPLATES:
        a, b = grams(unit), grams(template)
        dice = 2 * len(a & b) / (len(a) + len(b)) if a or b else 0
        if dice > best[0]:
            best = (dice, name)
    return best if best[0] >= license_scan.THRESHOLD else (0.0, None)


def test_licences_match_brute_force(spark, odd, empty):
    mit = license_scan.TEMPLATES[-1][1]
    draw = random.Random(4)
    lines = [t for _, t in license_scan.TEMPLATES] + ["plain line of words", "", "Licensed under the Apache Licence, Version 2.0"]
    rows = [(i, "\n".join(" ".join(w for w in draw.choice(lines).split() if draw.random() > 0.1) for _ in range(3))) for i in range(60)]
    rows += [(100, mit.replace(". ", ".\n")), (101, "é\n" + lines[0] + "\nend"), (102, "before\n\n" + mit.replace(", ", ",\n") + "\n\nafter")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for key, text in rows[:60]:
        want = {x for x in (brute_license(u)[1] for u in [*text.split("\n"), *text.split("\n\n"), text]) if x}
        assert got[key].licenses == ",".join(sorted(want)), text
    assert got[100].licenses == got[102].licenses == "MIT" and got[102].matches[0].unit == "paragraph"
    m = got[101].matches[0]
    assert rows[61][1][m.start : m.end].strip() == lines[0] and m.dice == 1.0
    assert license_scan.scan(odd).count() == odd.count() and license_scan.scan(empty).count() == 0


def _model(spark):
    draw = random.Random(2)
    made = {"en": ["the", "and", "with", "thing", "which"], "de": ["der", "und", "nicht", "zwischen", "schön"]}
    rows = [(i, " ".join(draw.choice(made[lang]) for _ in range(30)), lang) for i in range(80) for lang in made]
    return language_id.fit(spark.createDataFrame(rows, "id long, text string, lang string"))


def test_evidence_is_fused(spark):
    model = _model(spark)
    page = lambda lang, body: f'<html lang="{lang}"><script>var der = "und"</script><body><p>{body}</p></body></html>'
    rows = [(1, "https://a.example.com/x", page("en", "the and with which")), (2, "https://b.example.de/", page("en", "der und nicht zwischen schön")), (3, "https://c.example.de/", page("", "")), (4, None, None), (5, "https://a.example.com/y", page("de", ""))]
    rows += [(10 + i, f"https://a.example.com/{i}", page("en", "the thing and the other which")) for i in range(30)]
    got = {r.page_id: r for r in language_id.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert got[1].language == "en" and got[2].language == "de" and got[3].language == "de" and len(got) == 35
    assert got[3].n_trigrams == 0 and got[3].text_language is None
    assert got[4].language is not None and abs(sum(got[4].posterior) - 1) < 1e-9
    # a host that speaks English outweighs one declaration of another language
    assert got[5].language == "en"


def test_language_filter(spark, odd, empty):
    model = _model(spark)
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {1, 2, None, 6, 7, 8, 10, 11, 12}
    assert language_id.keep_identified(empty, model).count() == 0
    assert language_id.identify_documents(odd, model).count() == odd.count()
    assert language_id.identify_documents(empty, language_id.fit(empty)).count() == 0
    assert language_id.identify_documents(odd, language_id.fit(empty)).filter("language is null").count() == odd.count()


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs.filter("doc_id % 2 = 0"))
    rest = language_id.identify_documents(docs.filter("doc_id % 2 = 1").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}), model)
    joined = rest.join(docs.select("doc_id", F.col("lang").alias("real")), "doc_id").filter("n_trigrams > 20")
    assert joined.filter("language = real").count() >= 0.98 * joined.count()


def test_licences_inside_longer_texts(spark):
    full = {n: t for n, t in license_scan.TEMPLATES}  # the last of each name
    mit, bsd = full["MIT"], full["BSD-3-Clause"]
    for cut in (" The above copyright notice and", " THE SOFTWARE IS PROVIDED"):
        mit = mit.replace(cut, "\n\n" + cut.strip())
    code = "\n".join(f"def step_{i}(value_{i}): return other_{i}(value_{i}, {i})" for i in range(60))
    gpl = "\n".join("# " + line for line in textwrap.wrap(full["GPL-3.0"], 60))
    rows = [
        (1, f"The MIT License\n\nCopyright (c) 2020 Someone é\n\n{mit}\n\n{code}", "MIT"),
        (2, f"{code}\n{code}\n/*\n * " + "\n * ".join(textwrap.wrap(bsd, 70)) + f"\n */\n{code}", "BSD-3-Clause"),
        (3, f"#!/bin/sh\n{gpl}\n\n{code}", "GPL-3.0"),
        (4, "Copyright 2020 Someone. Released under the MIT License. All other rights are with the makers of this very long line of words.", "MIT"),
        (5, f"{code}\n{full['BSD-2-Clause']}\n{code}\n{full['Zlib']}\n{code}", "BSD-2-Clause,Zlib"),
        (6, code, ""),
    ]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert {k: r.licenses for k, r in got.items()} == {k: names for k, _, names in rows}
    m = got[1].matches[0]
    assert m.unit == "run" and m.dice > 0.99 and rows[0][1][m.start : m.end] == mit.rstrip(".") and len(got[1].matches) == 1


def test_licence_paragraphs_between_lines_of_white_space(spark):
    mit = license_scan.TEMPLATES[-1][1].replace(", ", ",\n")
    text = f"before\n\n{mit}\n\nafter"
    rows = [(1, text.replace("\n", "\r\n")), (2, text.replace("\n\n", "\n \t\n")), (3, text)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3
    for r in got:
        assert [(m.license, m.unit) for m in r.matches] == [("MIT", "paragraph"), ("MIT", "text")] and r.best_dice == 1.0


def test_rare_languages_are_fitted_and_copies_count_once(spark):
    rows = [(f"the text {i} of them", "en") for i in range(3000)] + [("der eine text", "de")] * 3000 + [(f"le texte {i}", "fr") for i in range(3)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string").repartition(4), sample_rows=60)
    assert model.languages == ["de", "en", "fr"]
    # trigrams counted in each language: the least probability is that of none, smoothed to a half
    seen = [round(float((np.exp(row - row.min()) * 0.5 - 0.5).sum())) for row in model.log]
    assert seen[0] < 12 and seen[2] < 40 and 5 * 10 < seen[1] < 60 * 20
