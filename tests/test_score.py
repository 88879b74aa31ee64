import pytest
from pyspark.sql import functions as F

from prosaic.functions import lexicons as L
from prosaic.functions import text as t
from prosaic.operators import score


def rows(spark, *texts):
    return spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")


def slop(spark, *texts):
    return [r for r in score.slop_score(rows(spark, *texts)).orderBy("doc_id").collect()]


FOUR = "One two three four. Five six seven eight nine ten. Some more words follow in this last one here. "


def test_banned_words_count_once_each(spark):
    three, one = slop(spark, FOUR + "delve delve delve delve delve utilize leverage now. ", FOUR + "delve " * 10 + ". ")
    assert (three.tier1, three.tier1_hits) == (3, 7) and (one.tier1, one.tier1_hits) == (1, 10)
    assert three.slop_penalty >= 4.0 and one.slop_penalty == pytest.approx(1.5)


def test_clusters_are_substrings_and_hits_are_tokens(spark):
    a, b = slop(spark, "it was seamlessly robust here", "they fostered, enhanced and elevated it")
    assert (a.tier2_clusters, a.tier2_hits) == (1, 2) and (b.tier2_clusters, b.tier2_hits) == (1, 0)


def test_dashes(spark):
    a, b, c = slop(spark, "---", "word " * 49 + "—", "word " * 199 + "— " * 3)
    assert a.dashes == 1
    assert b.dash_density == pytest.approx(20) and c.dash_density == pytest.approx(3 / 202 * 1000)
    exact = slop(spark, "x " * 197 + "— — —")[0]
    assert exact.dash_density == pytest.approx(15) and exact.slop_penalty == 0


def test_sentence_variation(spark):
    same, two = slop(spark, "One two three four. Five six seven eight. Nine ten one two.", "One two three four. Five six seven eight.")
    assert same.sentence_cv == 0 and same.slop_penalty == 1.0
    assert two.sentence_cv == 0.5 and two.slop_penalty == 0


def test_openers(spark):
    text = lambda n, m: "\n\n".join(["However, it went on."] * n + ["It went on and on."] * m)
    four, three = slop(spark, text(2, 3), text(3, 7))
    assert four.transition_ratio == pytest.approx(0.4) and three.transition_ratio == pytest.approx(0.3)
    assert four.slop_penalty - 1.0 == pytest.approx(0.8) or four.slop_penalty == pytest.approx(0.8)


def test_penalty_is_bounded_and_null_is_empty(spark):
    awful = " ".join(L.TIER1) + ". it's worth noting that " * 20 + "eyes widened " * 20 + "sadly " * 20 + "There's a difference. " * 20
    a, b = slop(spark, awful, None)
    assert a.slop_penalty == 10.0 and b.slop_penalty == 0 and b.words == 0


def test_every_pattern_can_match(spark):
    hits = {
        "TIER3": ["It's worth noting that x", "its important to note that", "x\nimportantly, y", "Notably x", "interestingly, x", "let's dive into x", "lets explore", "as we can see", "furthermore, x", "Moreover x", "additionally, x", "in today's very digital x", "at the end of the day", "it goes without saying", "when it comes to", "one might argue that", "not just a, but b"],
        "TELLS": ["a sense of awe", "couldn't help but feel", "the weight of it", "the air was thick with", "eyes widened", "a wave of heat washed over", "a pang of guilt", "heart pounded in his chest", "dark hair spilled", "piercing blue eyes", "a knowing look", "he felt a rush of", "the silence was heavy", "let out a breath she didn't know", "something dark stirred"],
        "TICS": ["I'm not saying no to it, I'm saying yes", "which means either one or two", "There's a difference.", "Those are different things.", "not just here, but there", "not from here, but from there"],
        "TELLING": ["Émile and Anna was angry", "sadly"],
    }
    for pack, texts in hits.items():
        patterns = getattr(L, pack)
        assert len(patterns) == len(texts)
        frame = rows(spark, *texts)
        got = frame.select("doc_id", F.array(*[t.count_pattern(F.col("text"), p, pack == "TIER3") for p in patterns]).alias("n")).collect()
        assert all(r.n[r.doc_id] == 1 for r in got), pack


def test_white_space_is_unicode(spark):
    got = rows(spark, "a\x1cb c d　e\x85f g", "", None, " \x1f ").select(t.word_count(t.blank_if_null(F.col("text"))).alias("n"), t.strip(t.blank_if_null(F.col("text"))).alias("s")).collect()
    assert [r.n for r in got] == [7, 0, 0, 0] and got[3].s == ""


def test_titles(spark):
    texts = ["# Chapter 3: The Bell\nx", "# Chapter One", "none", "", "##  Chapter Twenty-One — Dust", "x\n# Late"]
    got = rows(spark, *texts).orderBy("doc_id").select(t.chapter_title(F.col("text")).alias("t")).collect()
    assert [r.t for r in got] == ["The Bell", "Untitled", "Untitled", "Untitled", "Dust", "Late"]


def prints(spark, *texts, **options):
    return score.fingerprint(rows(spark, *texts), **options).orderBy("doc_id").collect()


def test_fingerprint(spark):
    a, b, c, d = prints(spark, "a\n\n---\n\nb", "word " * 100, "the clapper rang", "“Hello there” he said")
    assert a.section_breaks == 2 and a.paragraph_count == 2
    assert b.well_total_per_1k == pytest.approx(10.0) and b.well_body_pct == 0
    assert c.well_musical_pct == c.well_trade_pct == 50.0
    assert d.dialogue_ratio == 0 and prints(spark, "“Hello there” he said", unicode_quotes=True)[0].dialogue_ratio == pytest.approx(0.5)
    one, none = prints(spark, "Only one sentence here", None)
    assert one.sentence_length_cv is None and one.sentence_length_std == 0 and none.sentence_length_cv == 0 and none.word_count == 0


def test_outliers_need_three_documents_and_spread(spark):
    texts = ["few words are in this one"] * 9 + ["many " * 500]
    found = score.outliers(score.fingerprint(rows(spark, *texts)), "doc_id").filter("metric = 'word_count'").collect()
    assert [(r.doc_id, r.direction) for r in found] == [(9, "HIGH")] and found[0].z == pytest.approx(2.846, abs=0.001)
    assert score.outliers(score.fingerprint(rows(spark, "a b", "c d e")), "doc_id").count() == 0


def test_scores_of_a_stream(spark, tmp_path):
    from prosaic.streaming.score_stream import score_stream

    rows(spark, "We delve into it.", "Nothing here.").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    score_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.doc_id: r.tier1 for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: 1, 1: 0}


def test_lexicon_counts_agree_by_pattern_and_by_join(spark):
    from prosaic.plans.corpus import PROSE

    docs = rows(spark, *[text for _, text in PROSE], None, "", "It's (it's) its-own AND and; 'and' x_y +1 ... a\u00a0b 😀 ß É")
    terms = ["and", "it's", "the", "a", "b", "x_y", "+1", "😀", "ß", "é", "É", "'and'", "it is", "its", "its-own", "felt", None, "and"]
    lexicon = spark.createDataFrame([(x,) for x in terms], "term string")
    got = [sorted(map(tuple, score.lexicon_counts(docs, lexicon, "doc_id", in_pattern=n).collect())) for n in (1000, 0)]
    assert got[0] == got[1] and ("and", 3) in [(term, n) for _, term, n in got[0]]
    assert score.lexicon_counts(docs, lexicon.limit(0), "doc_id").count() == 0
    blank = spark.createDataFrame([("",), ("and",)], "term string")
    assert score.lexicon_counts(docs, blank, "doc_id").filter("term = ''").count() > 0
