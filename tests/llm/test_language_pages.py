"""Language identification of web pages: brute-force posterior, broken and odd pages."""

import math
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosaic.llm import language_id

MADE = {"en": ["the", "and", "with", "thing", "which"], "de": ["der", "und", "nicht", "zwischen", "schön"], "fr": ["le", "avec", "donc", "déjà", "une"]}


@pytest.fixture(scope="module")
def model(spark):
    draw = random.Random(2)
    rows = [(" ".join(draw.choice(words) for _ in range(30)), lang) for _ in range(60) for lang, words in MADE.items()]
    return language_id.fit(spark.createDataFrame(rows, "text string, lang string"))


def brute(model, rows):
    """Posteriors of (text, declared, host, domain, suffix), one row after the other."""
    langs = model.languages
    k = len(langs)

    def likelihood(text):
        raw, cells = [language_id._CLASS[b] for b in text.encode()], []
        for i in range(len(raw) - 2):
            if language_id._SAYS[raw[i + 1]]:
                cells.append((raw[i] * 64 + raw[i + 1]) * 64 + raw[i + 2])
        weight = language_id.TEMPER * min(1, language_id.MOST / max(len(cells), 1))
        return [weight * sum(float(model.log[j][c]) for c in cells) for j in range(k)], len(cells)

    def normal(logs):
        top = max(logs)
        e = [math.exp(x - top) for x in logs]
        return [x / sum(e) for x in e]

    logs = [likelihood(t) for t, *_ in rows]
    own = [normal(x) if n else [0.0] * k for x, n in logs]
    sums = {level: defaultdict(lambda: [0.0] * k) for level in ("host", "domain", "suffix", "all")}
    for (_, _, host, domain, suffix), p in zip(rows, own):
        for level, key in (("host", (host, domain, suffix)), ("domain", (domain, suffix)), ("suffix", suffix), ("all", ())):
            sums[level][key] = [a + b for a, b in zip(sums[level][key], p)]
    whole = [x + 1 for x in sums["all"][()]]
    base = [x / sum(whole) for x in whole]
    mixed = lambda s, parent: [(a + language_id.SMOOTHING * b) / (sum(s) + language_id.SMOOTHING) for a, b in zip(s, parent)]
    out = []
    for (_, declared, host, domain, suffix), (log, _), p in zip(rows, logs, own):
        prior = mixed(sums["domain"][domain, suffix], mixed(sums["suffix"][suffix], base))
        prior = mixed([max(a - b, 0) for a, b in zip(sums["host"][host, domain, suffix], p)], prior)
        total = [math.log(x) + y for x, y in zip(prior, log)]
        for said, trust in ((declared, language_id.DECLARED_TRUST), (language_id.SUFFIX_LANGUAGE.get(suffix), language_id.SUFFIX_TRUST)):
            if said in langs:
                total = [t + math.log(trust if x == said else (1 - trust) / (k - 1)) for t, x in zip(total, langs)]
        out.append(normal(total))
    return out


def test_posteriors_match_brute_force(spark, model):
    draw = random.Random(5)
    hosts = [("a.one.co.uk", "one.co.uk", "uk"), ("b.one.co.uk", "one.co.uk", "uk"), ("two.co.uk", "two.co.uk", "uk"), ("x.y.drei.de", "drei.de", "de"), ("drei.de", "drei.de", "de"), ("four.com", "four.com", "com"), ("com.au", "com.au", "au"), ("f.com.au", "f.com.au", "au"), ("", "", "")]
    rows = []
    for _ in range(60):
        lang = draw.choice(list(MADE))
        rows.append((" ".join(draw.choice(MADE[lang]) for _ in range(draw.randrange(0, 12))), draw.choice([None, "en", "de", "fr", "xx"]), *draw.choice(hosts)))
    rows += rows[:3]  # repeated rows
    frame = spark.createDataFrame([(i, t, d, h, s) for i, (t, d, h, _, s) in enumerate(rows)], "id long, t string, d string, h string, s string").repartition(4)
    found = language_id.identify(frame, model, F.col("t"), F.col("d"), F.col("h"), F.col("s"), ("id",))
    got = {r.id: r.posterior for r in found.collect()}
    assert len(got) == 63
    for i, want in enumerate(brute(model, rows)):
        assert np.abs(np.array(got[i]) - want).max() < 1e-9, i
        assert abs(sum(got[i]) - 1) < 1e-9


@pytest.mark.parametrize("piece", ["<", "<!--", "<script ", "<style>", "</script ", "&amp", "<html ", "<meta ", "<!-- >", "<script>", "<a b>", "<html lang"])
def test_broken_pages_take_time_in_proportion(piece):
    page = piece * (5_000_000 // len(piece))
    began = time.time()
    language_id.shown(page)
    assert time.time() - began < 10


def test_broken_declarations_take_time_in_proportion(spark, model):
    pages = [(i, "https://a.example.com", p * (2_000_000 // len(p))) for i, p in enumerate(["<", "<html ", "<meta ", "<html lang ", "<meta content ", "<!--"])]
    began = time.time()
    assert language_id.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), model).count() == 6
    assert time.time() - began < 40


def test_what_a_page_shows():
    shows = lambda x: " ".join(language_id.shown(x).split())
    assert shows("<html><head><title>One</title><SCRIPT>var t = '</p>';</SCRIPT ><style>p{}</style></head><body>two<!-- a > b -->three&amp;four</body>") == "One two three four"
    assert shows("a <!-- never closed") == "a <!-- never closed"
    assert shows("a <!-- never closed <b>c</b>") == "a c"
    assert shows("a <script>x <b>c</b>") == "a x c"
    assert shows("<scripted>a</scripted>") == "a"
    assert shows("1 < 2") == "1 < 2" and shows("") == "" and shows("<<<>>>") == ">>"


def test_declared_languages(spark):
    pages = ['<html LANG=de><p lang="fr">', "<html class=x xml:lang='en-GB'>", '<html><head><META http-equiv="Content-Language" CONTENT="fr">', '<meta property="og:locale" content="es_ES" />', "<meta name=viewport content=width>", "", None, "<html lang"]
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i long, html string")
    assert [r.x for r in frame.select("i", language_id.declared_language(F.col("html")).alias("x")).orderBy("i").collect()] == ["de", "en", "fr", "es", None, None, None, None]


def test_empty_and_odd_pages(spark, model):
    schema = "page_id long, url string, html string, host string, suffix string, sums string, language string, c0 string"
    rows = [(1, None, None), (2, "", ""), (3, "not an address", "<p>the and"), (None, "https://", "der und"), (4, "https://u:p@h.de:80/x?y#z", "<html>"), (4, "https://u:p@h.de:80/x?y#z", "<html>"), (5, "http://www.x..de./", "the " * 200_000), (6, "http://[::1]/", "é" * 10)]
    frame = spark.createDataFrame([(*r, *"hslac"[:5]) for r in rows], schema)
    found = language_id.identify_pages(frame, model).collect()
    assert len(found) == 8 and all(abs(sum(r.posterior) - 1) < 1e-9 and r.language in MADE for r in found)
    assert next(r for r in found if r.page_id == 5).language == "en"
    assert language_id.identify_pages(frame.limit(0), model).count() == 0


def test_only_some_languages_are_kept(spark, model):
    rows = [(1, "the and with thing which the", None, None), (2, "der und nicht zwischen schön", None, None), (3, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert [r.doc_id for r in language_id.keep_identified(docs, model, languages=("de",)).collect()] == [2]
    assert sorted(r.doc_id for r in language_id.keep_identified(docs, model).collect()) == [1, 2]
