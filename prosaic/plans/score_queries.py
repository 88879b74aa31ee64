"""Queries over prose: profile, slop score, fingerprint, averages, outliers, starters, lexicon counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosaic.functions import lexicons as L
from prosaic.operators import score
from prosaic.plans.corpus import PROSE_SQL, SPACE, comparable, prose, table


def q_doc_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prose(spark, sf_dir)
    return comparable(score.profile(docs, separator=F.col("sep")).drop("text", "sep"))


def q_slop_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(score.slop_score(prose(spark, sf_dir), separator=F.col("sep")).drop("text", "sep"))


def q_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(score.fingerprint(prose(spark, sf_dir), separator=F.col("sep")).drop("text", "sep"))


def q_fingerprint_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = score.fingerprint(prose(spark, sf_dir), separator=F.col("sep"))
    return comparable(score.corpus_average(counts).select(*[F.round(m, 6).alias(m) for m in score.METRICS]))


def q_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score.outliers(score.fingerprint(prose(spark, sf_dir), separator=F.col("sep")), "doc_id")
    return comparable(found.withColumn("z", F.round("z", 6)))


def q_outliers_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = score.fingerprint(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), separator="\n")
    return comparable(score.outliers(prints, "doc_id", partition=["lang"]).withColumn("z", F.round("z", 6)))


def q_starters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(score.starters(prose(spark, sf_dir)))


def q_lexicon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prose(spark, sf_dir)
    return comparable(score.lexicon_counts(docs, score.frequent_terms(docs, 25), "doc_id"))


def q_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge scores (here from labels: 4 + 4 quality) less the slop penalty."""
    judged = table(spark, sf_dir, "labels").select("doc_id", (F.lit(4.0) + 4.0 * F.col("quality")).alias("raw_judge_score"))
    scored = score.slop_score(prose(spark, sf_dir), separator=F.col("sep")).select("doc_id", "slop_penalty").join(judged, "doc_id")
    return comparable(scored.withColumn("overall_score", score.adjusted_score(F.col("raw_judge_score"), F.col("slop_penalty"))))


# --- the same in SQL ---

_WORDS = f"[^{SPACE}]+"
_MARKS = """.,;:!?"''()"""
_LETTERS = r"[\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{2c1}]"


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''").replace(r"\s", f"[{SPACE}]").replace(r"\w", r"[\p{L}\p{N}_]")


def _n(pattern: str, flags: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, '(?{flags}){_sql(pattern)}'))"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def _lexicon(words: list[str], marks: str = _MARKS) -> str:
    return f"list_filter(list_transform(regexp_extract_all(lower(text), '{_WORDS}'), lambda x: trim(x, '{marks}')), lambda x: x IN ({', '.join(repr(w) for w in words)}))"


def _lengths(text: str = "text") -> str:
    return f"list_filter(list_transform(string_split_regex({text}, '[.!?]+'), lambda x: len(regexp_extract_all(x, '{_WORDS}'))), lambda x: x > 2)"


_PARAGRAPHS = f"list_filter(list_transform(string_split(text, sep), lambda x: {_strip('x')}), lambda x: x <> '')"
_SUM = "coalesce(list_sum({0}), 0)::BIGINT"
_SQUARES = "coalesce(list_sum(list_transform({0}, lambda x: x * x)), 0)::BIGINT"

PROFILE_SQL = f"""
WITH {PROSE_SQL}, a AS (
  SELECT doc_id, len(regexp_extract_all(text, '{_WORDS}'))::BIGINT AS words, {_lengths()} AS l, len({_PARAGRAPHS})::BIGINT AS paragraphs FROM corpus),
b AS (SELECT *, len(l)::BIGINT AS n, {_SUM.format('l')} AS s, {_SQUARES.format('l')} AS q FROM a)
SELECT doc_id, words, paragraphs, n AS sentences, round(s::DOUBLE / nullif(n, 0)::DOUBLE, 9) AS sentence_mean,
       round(sqrt((n * q - s * s)::DOUBLE / nullif(n * n, 0)::DOUBLE), 9) AS sentence_std_pop
FROM b
"""


def _scored() -> str:
    plus = " + ".join
    clusters = plus(f"contains(p, '{w}')::INT" for w in L.TIER2)
    return f"""
{PROSE_SQL}, a AS (
  SELECT doc_id, len(regexp_extract_all(text, '{_WORDS}'))::BIGINT AS words, {_lexicon(L.TIER1)} AS one, {_lexicon(L.TIER2)} AS two, {_PARAGRAPHS} AS paras, {_lengths()} AS l,
         ({plus(_n(p, 'im') for p in L.TIER3)})::BIGINT AS tier3, ({plus(_n(p, 'i') for p in L.TELLS)})::BIGINT AS tells, ({plus(_n(p, 'i') for p in L.TICS)})::BIGINT AS tics,
         ({plus(_n(p, 'i', f"regexp_replace(text, '{_LETTERS}', '_', 'g')") for p in L.TELLING)})::BIGINT AS telling, ({_n('—', 'i')} + {_n('--', 'i')})::BIGINT AS dashes
  FROM corpus),
b AS (SELECT *, len(list_distinct(one))::BIGINT AS tier1, len(one)::BIGINT AS tier1_hits, len(two)::BIGINT AS tier2_hits, len(paras)::BIGINT AS paragraphs,
             len(list_filter(list_transform(paras, lambda x: lower(x)), lambda p: {clusters} >= 3))::BIGINT AS tier2_clusters,
             len(list_filter(paras, lambda x: trim(lower(regexp_extract(x, '{_WORDS}')), '{_MARKS}') IN ({', '.join(map(repr, L.OPENERS))})))::BIGINT AS transitions,
             dashes / greatest(words, 1) * 1000 AS dash_density, len(l)::BIGINT AS n, {_SUM.format('l')} AS s, {_SQUARES.format('l')} AS q FROM a),
c AS (SELECT *, CASE WHEN n > 2 THEN sqrt((n * q - s * s)::DOUBLE / (n * n)::DOUBLE) / (s::DOUBLE / n::DOUBLE) ELSE 0.5e0 END AS sentence_cv,
             coalesce(transitions / nullif(paragraphs, 0), 0e0) AS transition_ratio FROM b),
d AS (SELECT *, least(least(tier1 * 1.5e0, 4e0) + least(tier2_clusters * 1e0, 2e0) + least(tier3 * 0.3e0, 2e0)
             + CASE WHEN dash_density > 15 THEN least((dash_density - 15) * 0.3e0, 1e0) ELSE 0e0 END + CASE WHEN sentence_cv < 0.3e0 THEN 1e0 ELSE 0e0 END
             + CASE WHEN transition_ratio > 0.3e0 THEN least(transition_ratio * 2, 1e0) ELSE 0e0 END
             + least(tells * 0.3e0, 2e0) + least(telling * 0.2e0, 1.5e0) + least(tics * 0.5e0, 2e0), 10e0) AS slop_penalty FROM c)"""


SLOP_SQL = f"""
WITH {_scored()}
SELECT doc_id, words, tier3, tells, tics, telling, dashes, tier1, tier1_hits, tier2_hits, tier2_clusters, paragraphs, transitions, round(dash_density, 9) AS dash_density,
       round(sentence_cv, 9) AS sentence_cv, round(transition_ratio, 9) AS transition_ratio, round(slop_penalty, 9) AS slop_penalty
FROM d
"""

JUDGED_SQL = f"""
WITH {_scored()}
SELECT doc_id, round(slop_penalty, 9) AS slop_penalty, 4e0 + 4e0 * quality AS raw_judge_score, round(greatest(4e0 + 4e0 * quality - slop_penalty, 0e0), 9) AS overall_score
FROM d JOIN labels USING (doc_id)
"""


def _prints(source: str, keep: str = "doc_id") -> str:
    well_words = sorted({w for ws in L.WELLS.values() for w in ws} | set(L.ABSTRACT))
    marks = _MARKS + "—-–"
    similes = [r"\blike\s+(?:a|an|the)\b", r"\bas\s+(?:a|an|the|if|though)\b"]
    ascii_text = f"regexp_replace(text, '{_LETTERS}', '_', 'g')"
    per = "coalesce({0}::DOUBLE / nullif({1}, 0)::DOUBLE, 0e0)".format
    return f"""
{source}, a AS (
  SELECT {keep}, len(regexp_extract_all(text, '{_WORDS}'))::BIGINT AS word_count,
    list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: {_strip('x')}), lambda x: len(regexp_extract_all(x, '{_WORDS}')) > 2) AS sents,
    list_transform(list_filter({_PARAGRAPHS}, lambda x: NOT starts_with(x, '#') AND x <> '---'), lambda x: len(regexp_extract_all(x, '{_WORDS}'))) AS para,
    {_lexicon(well_words, marks)} AS wells,
    coalesce(list_sum(list_transform(regexp_extract_all(text, '"[^"]*"|[''"][^''"]*[''"]'), lambda x: len(regexp_extract_all(x, '{_WORDS}')))), 0)::BIGINT AS talk,
    {_n('—', 'i')} + {_n('--', 'i')} AS dashes, len(regexp_extract_all(text, chr(10) || '---' || chr(10))) + len(regexp_extract_all(text, chr(10) || chr(10) || '---' || chr(10) || chr(10))) AS section_breaks,
    {_n(r'\bthe way\b', 'i', ascii_text)} AS the_way_count, {' + '.join(_n(p, '-i', ascii_text) for p in similes)} AS similes
  FROM corpus),
b AS (SELECT *, list_transform(sents, lambda x: len(regexp_extract_all(x, '{_WORDS}'))) AS l, len(list_filter(sents, lambda x: regexp_extract(x, '{_WORDS}') IN ('He', 'he'))) AS he,
  {', '.join(f"len(list_filter(wells, lambda x: x IN ({', '.join(map(repr, ws))}))) AS {k}" for k, ws in {**L.WELLS, 'abstract': L.ABSTRACT}.items())} FROM a),
c AS (SELECT *, len(l)::BIGINT AS ns, len(para)::BIGINT AS np, {_SUM.format('l')} AS s, {_SQUARES.format('l')} AS q, {_SUM.format('para')} AS ps, {_SQUARES.format('para')} AS pq, greatest(musical + trade + body, 1) AS wt FROM b),
prints AS (SELECT {keep}, word_count, ns AS sentence_count, np AS paragraph_count, {per('s', 'ns')} AS avg_sentence_length,
  CASE WHEN ns > 1 THEN sqrt((ns * q - s * s)::DOUBLE / (ns * (ns - 1))::DOUBLE) ELSE 0e0 END AS sentence_length_std,
  CASE WHEN ns = 0 THEN 0e0 WHEN ns > 1 THEN sqrt((ns * q - s * s)::DOUBLE / (ns * (ns - 1))::DOUBLE) / {per('s', 'ns')} END AS sentence_length_cv,
  coalesce(list_min(l), 0)::BIGINT AS min_sentence, coalesce(list_max(l), 0)::BIGINT AS max_sentence,
  {per('len(list_filter(l, lambda x: x < 5))', 'ns')} * 100 AS fragments_pct, {per('len(list_filter(l, lambda x: x > 30))', 'ns')} * 100 AS long_sentences_pct, {per('ps', 'np')} AS avg_paragraph_length,
  CASE WHEN np > 1 THEN sqrt((np * pq - ps * ps)::DOUBLE / (np * (np - 1))::DOUBLE) ELSE 0e0 END AS paragraph_length_std,
  {per('musical', 'wt')} * 100 AS well_musical_pct, {per('trade', 'wt')} * 100 AS well_trade_pct, {per('body', 'wt')} * 100 AS well_body_pct, {per('wt', 'word_count')} * 1000 AS well_total_per_1k,
  {per('abstract', 'word_count')} * 1000 AS abstract_per_1k, {per('talk', 'word_count')} AS dialogue_ratio, {per('dashes', 'word_count')} * 1000 AS em_dash_per_1k, section_breaks::BIGINT AS section_breaks,
  {per('he', 'ns')} * 100 AS he_start_pct, the_way_count::BIGINT AS the_way_count, {per('similes', 'word_count')} * 1000 AS simile_density FROM c)"""


_ROUNDED = ", ".join(m if m in ("word_count", "sentence_count", "paragraph_count", "min_sentence", "max_sentence", "section_breaks", "the_way_count") else f"round({m}, 9) AS {m}" for m in score.METRICS)
FINGERPRINT_SQL = f"WITH {_prints(PROSE_SQL)} SELECT doc_id, {_ROUNDED} FROM prints"
AVERAGE_SQL = f"WITH {_prints(PROSE_SQL)} SELECT {', '.join(f'round(avg(round({m}::DOUBLE, {score.PLACES[m]})), 6) AS {m}' for m in score.METRICS)} FROM prints"


def _outliers(keys: str = "") -> str:
    parts = []
    for m in score.METRICS:
        over = f"OVER ({'PARTITION BY ' + keys if keys else ''})"
        parts.append(f"SELECT doc_id, {keys + ', ' if keys else ''}'{m}' AS metric, {m}::DOUBLE AS value, count({m}) {over} AS n, avg({m}::DOUBLE) {over} AS mean, stddev_samp({m}::DOUBLE) {over} AS std FROM prints")
    return " UNION ALL ".join(parts)


def _outlier_sql(source: str, keep: str, keys: str, only: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    return f"""WITH {_prints(source, keep)}, u AS ({_outliers(keys)})
SELECT doc_id, {lead}metric, round(value, 9) AS value, round((value - mean) / std, 6) AS z, CASE WHEN value > mean THEN 'HIGH' ELSE 'LOW' END AS direction
FROM u WHERE n > 2 AND std > 0 AND abs((value - mean) / std) > 1.5{only}"""


OUTLIERS_SQL = _outlier_sql(PROSE_SQL, "doc_id", "")
BY_LANG_SQL = _outlier_sql("corpus AS (SELECT doc_id, lang, coalesce(text, '') AS text, chr(10) AS sep FROM documents)", "doc_id, lang", "lang")

STARTERS_SQL = f"""
WITH {PROSE_SQL}, s AS (SELECT unnest(string_split_regex(text, '[.!?]+')) AS s FROM corpus)
SELECT regexp_extract(s, '{_WORDS}') AS starter, count(*) AS n FROM s WHERE len(regexp_extract_all(s, '{_WORDS}')) > 2 GROUP BY 1
"""

LEXICON_SQL = f"""
WITH {PROSE_SQL}, w AS (SELECT doc_id, trim(unnest(regexp_extract_all(lower(text), '{_WORDS}')), '{_MARKS}') AS term FROM corpus),
top AS (SELECT term FROM w WHERE term <> '' GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 25)
SELECT doc_id, term, count(*) AS n FROM w JOIN top USING (term) GROUP BY ALL
"""

QUERIES = {
    "q_doc_profile": (q_doc_profile, PROFILE_SQL),
    "q_slop_score": (q_slop_score, SLOP_SQL),
    "q_judged": (q_judged, JUDGED_SQL),
    "q_fingerprint": (q_fingerprint, FINGERPRINT_SQL),
    "q_fingerprint_average": (q_fingerprint_average, AVERAGE_SQL),
    "q_outliers": (q_outliers, OUTLIERS_SQL),
    "q_outliers_by_lang": (q_outliers_by_lang, BY_LANG_SQL),
    "q_starters": (q_starters, STARTERS_SQL),
    "q_lexicon_counts": (q_lexicon_counts, LEXICON_SQL),
}
