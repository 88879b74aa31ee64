"""Queries over panels, reviews, ledgers and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosaic.operators import chunk, extract, feedback
from prosaic.plans import probes
from prosaic.plans.corpus import comparable, local, table, values


def panel(spark: SparkSession) -> DataFrame:
    return local(spark, probes.PANEL, "reader string, question string, answer string")


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probes and conversations: roles as readers, the conversation as question."""
    turns = table(spark, sf_dir, "conversations").select(F.col("role").alias("reader"), F.lit("missing_scene").alias("question"), F.col("text").alias("answer"))
    return panel(spark).union(turns)


def _text(df: DataFrame, *arrays: str) -> DataFrame:
    return df.withColumns({a: F.array_join(F.transform(a, lambda x: x.cast("string")), "|") for a in arrays})


def q_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(_text(feedback.mentions(_talk(spark, sf_dir)), "flagged_by"))


def q_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feedback.disagreements(panel(spark))
    detail = F.array_join(F.transform(F.array_sort(F.map_keys("details")), lambda k: F.concat(k, F.lit("="), F.try_element_at("details", k))), "|")
    return comparable(_text(found.withColumn("details", detail), "flagged_by", "not_flagged"))


def q_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(feedback.consensus(panel(spark)))


def q_panel_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = local(spark, [(n,) for n in (1, 2, 5, 7, 9, 12, 24)], "chapter int")
    return comparable(_text(feedback.panel_mentions(panel(spark), chapters), "comments"))


def q_flagged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(feedback.flagged_lines(panel(spark)))


def q_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = local(spark, probes.THREADS, "num int, plants array<string>, harvests array<string>")
    return comparable(_text(feedback.ledger(entries), "planted", "harvested"))


def q_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    docs = table(spark, sf_dir, "documents").select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("doc_id").alias("turn"), "text")
    found = feedback.neighbours(turns.union(docs), "turn", "text", ["conv_id"], 30, 20)
    return comparable(found.select("conv_id", "turn", "prev_tail", "next_head"))


def q_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their role's voice, or one fallen back on."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"))
    voices = local(spark, probes.VOICES, "seq int, speaker string, voice_id string")
    return comparable(chunk.with_voices(turns, voices))


def q_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed reviews, an item a row, with the review's counts and the stop rule."""
    parsed = extract.parse_reviews(local(spark, probes.REVIEWS, "id int, raw_text string"))
    ruled = parsed.withColumn("rule", extract.should_stop(F.col("stars"), F.col("total_items"), F.col("major_items"), F.col("qualified_items")))
    return comparable(ruled.select("id", "stars", "total_items", "major_items", "qualified_items", "rule.stop", "rule.reason", F.posexplode_outer("items").alias("place", "i")).select("id", "stars", "total_items", "major_items", "qualified_items", "stop", "reason", "place", "i.*").fillna(-1, ["place", "number"]))


def q_review_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each review, which SQL can express too."""
    parsed = extract.parse_reviews(local(spark, probes.REVIEWS, "id int, raw_text string"))
    rule = extract.should_stop(F.col("stars"), F.col("total_items"), F.col("major_items"), F.col("qualified_items"))
    return comparable(parsed.select("id", "stars", "total_items", rule["stop"].alias("stop")))


PANEL_SQL = "panel AS (SELECT reader, question, answer FROM " + values(probes.PANEL, ["reader", "question", "answer"]) + ")"
_CHAPTERS = r"list_transform(regexp_extract_all({0}, '(?i)Ch(?:apter)?\s*([0-9]+)', 1), lambda x: x::BIGINT)"
_IN = lambda qs: "(" + ", ".join(f"'{q}'" for q in qs) + ")"

MENTIONS_SQL = f"""
WITH {PANEL_SQL}, talk AS (SELECT * FROM panel UNION ALL SELECT role, 'missing_scene', text FROM conversations),
m AS (SELECT reader, question, unnest({_CHAPTERS.format("coalesce(answer, '')")}) AS chapter FROM talk WHERE question IN {_IN(feedback.SCANNED)})
SELECT chapter, question, count(*) AS count, count(DISTINCT reader) AS readers, string_agg(reader, '|' ORDER BY reader) AS flagged_by FROM m GROUP BY 1, 2
"""

SPLIT_SQL = f"""
{PANEL_SQL}, readers AS (SELECT DISTINCT reader FROM panel),
n AS (SELECT DISTINCT reader, question, coalesce(answer, '') AS answer, unnest({_CHAPTERS.format("coalesce(answer, '')")}) AS chapter FROM panel WHERE question IN {_IN(feedback.DISPUTED)}),
pairs AS (SELECT DISTINCT question, chapter FROM n),
full_ AS (SELECT p.question, p.chapter, r.reader, n.answer FROM pairs p CROSS JOIN readers r LEFT JOIN n ON n.question = p.question AND n.chapter = p.chapter AND n.reader = r.reader),
split AS (SELECT question, chapter, string_agg(CASE WHEN answer IS NOT NULL THEN reader END, '|' ORDER BY reader) AS flagged_by, string_agg(CASE WHEN answer IS NULL THEN reader END, '|' ORDER BY reader) AS not_flagged,
  string_agg(CASE WHEN answer IS NOT NULL THEN reader || '=' || left(answer, 200) END, '|' ORDER BY reader) AS details, count(answer) AS k, count(*) AS total FROM full_ GROUP BY 1, 2)"""
DISAGREEMENTS_SQL = f"WITH {SPLIT_SQL} SELECT question, chapter, flagged_by, not_flagged, details FROM split WHERE k < total"
FLAGGED_SQL = f"WITH {SPLIT_SQL} SELECT chapter, question, question || ': flagged by ' || k || '/' || total || ' readers (' || replace(flagged_by, '|', ', ') || ')' AS line FROM split WHERE k < total"

_ORDER = " ".join(f"WHEN '{q}' THEN {i}" for i, q in enumerate(dict.fromkeys([*feedback.DISPUTED, *feedback.SCANNED])))
CONSENSUS_SQL = f"""
WITH {SPLIT_SQL}, d AS (SELECT chapter, question, k AS count, 'disagreement' AS source FROM split WHERE k < total),
m AS (SELECT question, unnest({_CHAPTERS.format("coalesce(answer, '')")}) AS chapter FROM panel WHERE question IN {_IN(feedback.SCANNED)}),
c AS (SELECT chapter, question, count(*) AS count, 'mention' AS source FROM m WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.chapter = m.chapter AND d.question = m.question) GROUP BY 1, 2),
u AS (SELECT *, CASE question {_ORDER} END AS q FROM (SELECT * FROM d UNION ALL SELECT * FROM c) WHERE chapter > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY count DESC, source, q) AS n FROM u)
SELECT chapter, question, count, source FROM r WHERE n = 1 ORDER BY count DESC, source, q, chapter LIMIT 5
"""

PANEL_MENTIONS_SQL = f"""
WITH {PANEL_SQL}, c AS (SELECT unnest([1, 2, 5, 7, 9, 12, 24])::BIGINT AS chapter)
SELECT chapter, question, string_agg('[' || reader || '] ' || answer, '|' ORDER BY '[' || reader || '] ' || answer) AS comments
FROM panel, c WHERE question IN {_IN(feedback.BRIEFED)} AND regexp_matches(answer, '(?i)\\b(?:Chapter|Ch\\.?)\\s*' || chapter || '\\b') GROUP BY 1, 2
"""

_ENTRIES = " UNION ALL ".join(f"SELECT {n} AS num, {p!r}::VARCHAR[] AS plants, {h!r}::VARCHAR[] AS harvests" for n, p, h in probes.THREADS)
LEDGER_SQL = f"""
WITH e AS ({_ENTRIES}), p AS (SELECT left(x, 60) AS thread, string_agg(num::VARCHAR, '|' ORDER BY num) AS planted FROM (SELECT num, unnest(plants) AS x FROM e) GROUP BY 1),
h AS (SELECT left(x, 60) AS thread, string_agg(num::VARCHAR, '|' ORDER BY num) AS harvested FROM (SELECT num, unnest(harvests) AS x FROM e) GROUP BY 1)
SELECT thread, coalesce(planted, '') AS planted, coalesce(harvested, '') AS harvested FROM p FULL JOIN h USING (thread)
"""

NEIGHBOURS_SQL = """
WITH r AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, doc_id, coalesce(text, '') FROM documents)
SELECT r.conv_id, r.turn, right(p.text, 30) AS prev_tail, left(n.text, 20) AS next_head
FROM r LEFT JOIN r p ON p.conv_id = r.conv_id AND p.turn = r.turn - 1 LEFT JOIN r n ON n.conv_id = r.conv_id AND n.turn = r.turn + 1
"""

VOICES_SQL = f"""
WITH v AS (SELECT * FROM {values(probes.VOICES, ["seq", "speaker", "voice_id"])} WHERE NOT starts_with(speaker, '_') AND voice_id NOT IN ('', 'REPLACE_WITH_VOICE_ID'))
SELECT conv_id, turn, role AS speaker, coalesce(v.voice_id, (SELECT voice_id FROM v WHERE speaker = 'MINOR'), (SELECT voice_id FROM v WHERE speaker = 'NARRATOR'), (SELECT arg_min(voice_id, seq) FROM v)) AS voice_id
FROM conversations LEFT JOIN v ON v.speaker = role
"""

REVIEW_TOTALS_SQL = f"""
WITH r AS (SELECT id, coalesce(raw_text, '') AS text FROM {values(probes.REVIEWS, ["id", "raw_text"])}),
h AS (SELECT *, regexp_extract(text, '(?:Professor|PROFESSOR|professor).*?(?:Review|Assessment|Analysis|Craft)') AS head FROM r),
s AS (SELECT id, CASE WHEN head = '' THEN text ELSE left(text, strpos(text, head) - 1) END AS critic, CASE WHEN head = '' THEN '' ELSE substr(text, strpos(text, head) + length(head)) END AS professor FROM h),
t AS (SELECT *, regexp_extract(critic, '★+½?|[0-9]+\\.?[0-9]*\\s*/?\\s*(?:out of\\s*)?(?:five|5)') AS rating, string_split_regex(professor, '\\n[0-9]+\\.\\s+') AS parts FROM s),
u AS (SELECT id, CASE WHEN rating = '' THEN NULL ELSE len(regexp_extract_all(rating, '★')) + CASE WHEN contains(rating, '½') THEN 0.5e0 ELSE 0e0 END END AS stars, parts[2:] AS items FROM t),
w AS (SELECT id, stars, len(items)::BIGINT AS total_items, len(list_filter(items, lambda x: regexp_matches(lower(x), 'major|significant|primary|most important'))) AS major,
  len(list_filter(items, lambda x: regexp_matches(lower(x), '{"|".join(extract.HEDGES)}'))) AS hedged FROM u)
SELECT id::BIGINT AS id, stars, total_items, (coalesce(stars, 0) >= 4.5 AND major = 0) OR (coalesce(stars, 0) >= 4 AND total_items > 0 AND hedged / total_items > 0.5) OR total_items <= 2 AS stop FROM w
"""

def _class_sql(classes: list, other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(low, '{'|'.join(words)}') THEN '{name}'" for name, words in classes) + f" ELSE '{other}' END"


# without lookahead: sections and suggestions end before a mark that is put at each possible end
REVIEWS_SQL = f"""
WITH r AS (SELECT id, coalesce(raw_text, '') AS text FROM {values(probes.REVIEWS, ["id", "raw_text"])}),
h AS (SELECT *, regexp_extract(text, '(?:Professor|PROFESSOR|professor).*?(?:Review|Assessment|Analysis|Craft)') AS head FROM r),
s AS (SELECT id, CASE WHEN head = '' THEN text ELSE left(text, strpos(text, head) - 1) END AS critic, CASE WHEN head = '' THEN '' ELSE substr(text, strpos(text, head) + length(head)) END AS professor FROM h),
t AS (SELECT *, regexp_extract(critic, '★+½?|[0-9]+\\.?[0-9]*\\s*/?\\s*(?:out of\\s*)?(?:five|5)') AS rating,
  list_filter(string_split(regexp_replace(professor, '\\n([0-9]+\\.\\s+[A-Z])', chr(1) || '\\1', 'g'), chr(1)), lambda x: regexp_matches(x, '^[0-9]+\\.\\s+.')) AS items FROM s),
i AS (SELECT id, unnest(items) AS x, unnest(range(len(items))) AS place FROM t),
j AS (SELECT *, lower(x) AS low, regexp_extract(x, '(?s)(?:Specific\\s+)?[Ss]uggestion[s]?:?\\s*\\n?(.*)', 1) AS asked FROM i),
k AS (SELECT id, place, regexp_extract(x, '^([0-9]+)\\.', 1)::BIGINT AS number, trim(regexp_extract(x, '^[0-9]+\\.\\s+(.+?)(?:\\n|$)', 1)) AS title, {_class_sql(extract.SEVERITIES, "moderate")} AS severity, {_class_sql(extract.FIX_TYPES, "revision")} AS type,
  regexp_matches(low, '{"|".join(extract.HEDGES)}') AS qualified, left(trim(split_part(regexp_replace(regexp_replace(asked, '\\n[0-9]+\\.', chr(1), 'g'), '\\n\\n[A-Z]', chr(1), 'g'), chr(1), 1), chr(10) || ' '), 500) AS suggestion, left(trim(x, chr(10) || ' '), 1000) AS full_text FROM j),
u AS (SELECT id, CASE WHEN rating = '' THEN NULL ELSE len(regexp_extract_all(rating, '★')) + CASE WHEN contains(rating, '½') THEN 0.5e0 ELSE 0e0 END END AS stars, len(items)::BIGINT AS n FROM t),
v AS (SELECT u.*, (SELECT count(*) FROM k WHERE k.id = u.id AND severity = 'major') AS major, (SELECT count(*) FROM k WHERE k.id = u.id AND qualified) AS hedged, coalesce(stars, 0) AS sn FROM u),
w AS (SELECT *, CASE WHEN sn >= 4.5 AND major = 0 THEN '★★★★½ with no major items' WHEN sn >= 4 AND n > 0 AND hedged / n > 0.5 THEN '★' || repeat('★', trunc(sn)::INT) || ' with ' || hedged || '/' || n || ' items qualified' WHEN n <= 2 THEN 'Only ' || n || ' items found' END AS why FROM v)
SELECT w.id::BIGINT AS id, stars, n AS total_items, major AS major_items, hedged AS qualified_items, why IS NOT NULL AS stop, coalesce(why, major || ' major items, ' || (n - hedged) || ' unqualified') AS reason, coalesce(place, -1)::BIGINT AS place, coalesce(number, -1) AS number, title, severity, type, qualified, suggestion, full_text
FROM w LEFT JOIN k ON k.id = w.id
"""

QUERIES = {
    "q_mentions": (q_mentions, MENTIONS_SQL),
    "q_disagreements": (q_disagreements, DISAGREEMENTS_SQL),
    "q_flagged_lines": (q_flagged_lines, FLAGGED_SQL),
    "q_consensus": (q_consensus, CONSENSUS_SQL),
    "q_panel_mentions": (q_panel_mentions, PANEL_MENTIONS_SQL),
    "q_ledger": (q_ledger, LEDGER_SQL),
    "q_neighbours": (q_neighbours, NEIGHBOURS_SQL),
    "q_voices": (q_voices, VOICES_SQL),
    "q_review_totals": (q_review_totals, REVIEW_TOTALS_SQL),
    "q_reviews": (q_reviews, REVIEWS_SQL),
}
