"""Prose scores: overused language, a stylometric fingerprint, and outliers of a corpus.

Each score is a projection; no row moves. Results keep raw doubles; round for
display only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosaic.functions import lexicons as L
from prosaic.functions import text as t
from prosaic.sources.tables import saved


def _dashes(text: Column) -> Column:
    return t.count_literal(text, "—") + t.count_literal(text, "--")


def _sum(values: Column, power: int = 1) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + (x if power == 1 else x.cast("long") * x))


def _members(hits: str, words: list[str]) -> Column:
    return F.size(F.filter(hits, lambda w: w.isin(words)))


def _deviation(n: Column, s: Column, q: Column, sample: bool) -> Column:
    """Standard deviation from a count, a sum and a sum of squares, all integers."""
    spread = (n * q - s * s).cast("double")
    return F.sqrt(F.try_divide(spread, (n * (n - 1) if sample else n * n).cast("double")))


def profile(docs: DataFrame, text_col: str = "text", separator: Column | str = "\n\n") -> DataFrame:
    """docs with words, sentences, paragraphs and the mean and population deviation of sentence lengths (null without sentences)."""
    text = t.blank_if_null(F.col(text_col))
    base = docs.withColumns({"words": t.word_count(text), "_lengths": t.sentence_lengths(text), "paragraphs": F.size(t.paragraphs(text, separator))})
    n, s, q = F.size("_lengths").cast("long"), _sum(F.col("_lengths")), _sum(F.col("_lengths"), 2)
    base = base.withColumns({"sentences": n, "_s": s, "_q": q})
    n, s, q = F.col("sentences"), F.col("_s"), F.col("_q")
    return base.withColumns({"sentence_mean": F.try_divide(s.cast("double"), n.cast("double")), "sentence_std_pop": _deviation(n, s, q, False)}).drop("_lengths", "_s", "_q")


def slop_score(docs: DataFrame, text_col: str = "text", separator: Column | str = "\n\n") -> DataFrame:
    """docs with counts of every pack and slop_penalty, from 0 (clean) to 10.

    Null texts are empty. Thresholds act on unrounded values.
    """
    text, low = t.blank_if_null(F.col(text_col)), F.col("_low")
    packs = {"tier3": (L.TIER3, True), "tells": (L.TELLS, False), "tics": (L.TICS, False), "telling": (L.TELLING, False)}
    base = docs.withColumns({"_low": F.lower(text), "_odd": t.odd_case(text)})
    hits = base.withColumns(
        {
            "words": t.word_count(text),
            "_hits": t.lexicon_hits(text, L.TIER1 + L.TIER2),
            "_paragraphs": t.paragraphs(text, separator),
            "_lengths": t.sentence_lengths(text),
            **{name: t.count_patterns(text, low, F.col("_odd"), pack, multiline) for name, (pack, multiline) in packs.items()},
            "dashes": _dashes(text),
        }
    )
    opener = "^" + t.lexicon_pattern(L.OPENERS)
    n, s, q = F.size("_lengths").cast("long"), _sum(F.col("_lengths")), _sum(F.col("_lengths"), 2)
    found = hits.withColumns(
        {
            "tier1": F.size(F.array_intersect("_hits", F.array(*map(F.lit, L.TIER1)))),
            "tier1_hits": _members("_hits", L.TIER1),
            "tier2_hits": _members("_hits", L.TIER2),
            "tier2_clusters": F.size(F.filter(F.transform("_paragraphs", F.lower), lambda p: t.total([p.contains(w).cast("int") for w in L.TIER2]) >= 3)),
            "paragraphs": F.size("_paragraphs"),
            "transitions": F.size(F.filter("_paragraphs", lambda p: F.rlike(F.lower(p), F.lit(opener)))),
            "dash_density": F.col("dashes") / F.greatest("words", F.lit(1)) * 1000,
            "sentence_cv": F.when(n > 2, F.try_divide(_deviation(n, s, q, False), s.cast("double") / F.greatest(n, F.lit(1)).cast("double"))).otherwise(0.5),
        }
    ).drop("_low", "_odd", "_hits", "_paragraphs", "_lengths")
    found = found.withColumn("transition_ratio", F.coalesce(F.try_divide(F.col("transitions"), F.col("paragraphs")), F.lit(0.0)))
    density, cv, ratio = F.col("dash_density"), F.col("sentence_cv"), F.col("transition_ratio")
    capped = lambda c, k, most: F.least(F.col(c) * F.lit(k), F.lit(most))
    terms = [
        capped("tier1", 1.5, 4.0),
        capped("tier2_clusters", 1.0, 2.0),
        capped("tier3", 0.3, 2.0),
        F.when(density > 15, F.least((density - 15) * 0.3, F.lit(1.0))).otherwise(0.0),
        F.when(cv < 0.3, 1.0).otherwise(0.0),
        F.when(ratio > 0.3, F.least(ratio * 2, F.lit(1.0))).otherwise(0.0),
        capped("tells", 0.3, 2.0),
        capped("telling", 0.2, 1.5),
        capped("tics", 0.5, 2.0),
    ]
    return found.withColumn("slop_penalty", F.least(t.total(terms), F.lit(10.0)))


def adjusted_score(judged: Column, penalty: Column) -> Column:
    """A judge's score less the penalty, not below 0."""
    return F.greatest(judged - penalty, F.lit(0.0))


METRICS = (
    "word_count", "sentence_count", "paragraph_count", "avg_sentence_length", "sentence_length_std", "sentence_length_cv", "min_sentence", "max_sentence",
    "fragments_pct", "long_sentences_pct", "avg_paragraph_length", "paragraph_length_std", "well_musical_pct", "well_trade_pct", "well_body_pct",
    "well_total_per_1k", "abstract_per_1k", "dialogue_ratio", "em_dash_per_1k", "section_breaks", "he_start_pct", "the_way_count", "simile_density",
)
#: Places to which each metric is rounded in reports.
PLACES = {m: 3 if m in ("sentence_length_cv", "dialogue_ratio") else 1 for m in METRICS}


def fingerprint(docs: DataFrame, text_col: str = "text", separator: Column | str = "\n\n", unicode_quotes: bool = False) -> DataFrame:
    """docs with the columns of METRICS.

    Dialogue is what stands between straight quotes, apostrophes among them, or,
    with unicode_quotes, between curly double quotes as well. Null texts are empty.
    The coefficient of variation of a single sentence is null: one value has no
    sample deviation.
    """
    text = t.blank_if_null(F.col(text_col))
    spans = r"""("[^"]*"|['"][^'"]*['"])""" if not unicode_quotes else r"""("[^"]*"|“[^”]*”|['"][^'"]*['"])"""
    well_words = sorted({w for ws in L.WELLS.values() for w in ws} | set(L.ABSTRACT))
    cs = lambda p: F.lit("(?Ud)" + p.replace(r"\s", f"[{t.SPACE}]"))
    base = docs.withColumns(
        {
            "word_count": t.word_count(text),
            "_parts": F.split(text, t.SENTENCE_END),
            "_para": F.transform(t.prose_paragraphs(text, separator), t.word_count),
            "_wells": t.lexicon_hits(text, well_words, t.MARKS_AND_DASHES),
            "_dialogue": _sum(F.transform(F.regexp_extract_all(text, F.lit(spans), F.lit(1)), t.word_count)),
            "_dashes": _dashes(text),
            "section_breaks": t.count_literal(text, "\n---\n") + t.count_literal(text, "\n\n---\n\n"),
            "the_way_count": t.count_pattern(text, r"\bthe way\b"),
            "_similes": F.regexp_count(text, cs(r"\blike\s+(?:a|an|the)\b")) + F.regexp_count(text, cs(r"\bas\s+(?:a|an|the|if|though)\b")),
        }
    )
    base = base.withColumns(
        {
            "_len": F.filter(F.transform("_parts", t.word_count), lambda n: n > 2),
            "_he": F.size(F.filter("_parts", lambda s: F.rlike(s, F.lit(f"^[{t.SPACE}]*[Hh]e(?![^{t.SPACE}])")) & (t.word_count(s) > 2))),
            **{f"_{k}": _members("_wells", ws) for k, ws in {**L.WELLS, "abstract": L.ABSTRACT}.items()},
        }
    )
    base = base.withColumns({"sentence_count": F.size("_len").cast("long"), "paragraph_count": F.size("_para").cast("long"), "_s": _sum(F.col("_len")), "_q": _sum(F.col("_len"), 2), "_ps": _sum(F.col("_para")), "_pq": _sum(F.col("_para"), 2), "_total": F.greatest(F.col("_musical") + F.col("_trade") + F.col("_body"), F.lit(1))})
    c = F.col
    ns, np_, words = c("sentence_count"), c("paragraph_count"), c("word_count")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    out = base.withColumns(
        {
            "avg_sentence_length": ratio(c("_s"), ns),
            "sentence_length_std": F.when(ns > 1, _deviation(ns, c("_s"), c("_q"), True)).otherwise(0.0),
            "sentence_length_cv": F.when(ns == 0, 0.0).when(ns > 1, F.try_divide(_deviation(ns, c("_s"), c("_q"), True), ratio(c("_s"), ns))),
            "min_sentence": F.coalesce(F.array_min("_len"), F.lit(0)),
            "max_sentence": F.coalesce(F.array_max("_len"), F.lit(0)),
            "fragments_pct": ratio(F.size(F.filter("_len", lambda n: n < 5)), ns) * 100,
            "long_sentences_pct": ratio(F.size(F.filter("_len", lambda n: n > 30)), ns) * 100,
            "avg_paragraph_length": ratio(c("_ps"), np_),
            "paragraph_length_std": F.when(np_ > 1, _deviation(np_, c("_ps"), c("_pq"), True)).otherwise(0.0),
            **{f"well_{k}_pct": ratio(c(f"_{k}"), c("_total")) * 100 for k in L.WELLS},
            "well_total_per_1k": ratio(c("_total"), words) * 1000,
            "abstract_per_1k": ratio(c("_abstract"), words) * 1000,
            "dialogue_ratio": ratio(c("_dialogue"), words),
            "em_dash_per_1k": ratio(c("_dashes"), words) * 1000,
            "he_start_pct": ratio(c("_he"), ns) * 100,
            "simile_density": ratio(c("_similes"), words) * 1000,
        }
    )
    return out.select(*docs.columns, *METRICS)


def corpus_average(prints: DataFrame) -> DataFrame:
    """One row: the mean of each metric, of values rounded as in reports."""
    return prints.agg(*[F.avg(F.round(F.col(m).cast("double"), PLACES[m])).alias(m) for m in METRICS])


def outliers(prints: DataFrame, id_col: str, limit: float = 1.5, partition: list[str] | None = None) -> DataFrame:
    """id, metric, value, z, direction where a metric lies more than `limit` sample deviations off the corpus mean.

    A metric needs more than two documents and some spread. The metrics are saved,
    so that texts are read once; statistics are one aggregate row (per partition,
    if columns are given; the planner sizes that join) joined back, so documents are not gathered.
    """
    keys = partition or []
    prints = saved(prints.select(id_col, *keys, *METRICS), "fingerprints")
    stats = prints.groupBy(*keys).agg(*[f(F.col(m).cast("double")).alias(f"{n}_{m}") for m in METRICS for n, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp))])
    joined = prints.join(stats, keys) if keys else prints.crossJoin(F.broadcast(stats))  # one row
    rows = joined.select(id_col, *keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.col(f"n_{m}").alias("n"), F.col(f"mean_{m}").alias("mean"), F.col(f"std_{m}").alias("std")) for m in METRICS])))
    z = (F.col("value") - F.col("mean")) / F.col("std")
    rows = rows.filter((F.col("n") > 2) & (F.col("std") > 0)).withColumn("z", z).filter(F.abs("z") > limit)
    return rows.select(id_col, *keys, "metric", "value", "z", F.when(F.col("z") > 0, "HIGH").otherwise("LOW").alias("direction"))


def starters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """starter, n: the first tokens of all sentences."""
    firsts = F.transform(t.sentences(t.blank_if_null(F.col(text_col))), lambda s: F.get(F.split(s, t.WS), F.lit(0)))
    return docs.select(F.explode(firsts).alias("starter")).groupBy("starter").agg(F.count("*").alias("n"))


def frequent_terms(docs: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """term, n: the n most frequent trimmed lower-case tokens, ties by term; a lexicon taken from the data."""
    token = F.explode(t.tokens(F.lower(t.blank_if_null(F.col(text_col)))))
    return docs.select(token.alias("token")).select(t.trim_marks(F.col("token")).alias("term")).filter("term <> ''").groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(n)


def lexicon_counts(docs: DataFrame, lexicon: DataFrame, id_col: str, text_col: str = "text", terms: int = 100_000, in_pattern: int = 1_000) -> DataFrame:
    """id, term, n: how often each document has each term of a lexicon (column term).

    Terms are read once. Up to `in_pattern` of them make one pattern, so that only
    hits leave the text; longer lexicons are broadcast up to `terms` rows and joined
    by shuffling beyond. Null terms, and those no trimmed token can equal, count nothing.
    """
    text = t.blank_if_null(F.col(text_col))
    own = lexicon.select("term").filter(F.col("term").isNotNull()).distinct()
    few = [row["term"] for row in own.limit(in_pattern + 1).collect()]
    if len(few) <= in_pattern and "" not in few:
        words = [w for w in few if w == w.strip(t.MARKS) and not t.has_space(w)]
        hits = docs.select(id_col, F.explode(t.lexicon_hits(text, words)).alias("term")) if words else docs.select(id_col, F.lit("").alias("term")).limit(0)
        return hits.groupBy(id_col, "term").agg(F.count("*").alias("n"))
    tokens = docs.select(id_col, F.explode(t.tokens(F.lower(text))).alias("token")).select(id_col, t.trim_marks(F.col("token")).alias("term"))
    small = len(few) <= in_pattern or own.limit(terms + 1).count() <= terms
    return tokens.join(F.broadcast(own) if small else own, "term").groupBy(id_col, "term").agg(F.count("*").alias("n"))
