"""Queries over cuts, tournaments, chunks and run histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosaic.functions import text as t
from prosaic.operators import chunk, control, edit, rating, score
from prosaic.plans import probes
from prosaic.plans.corpus import SPACE, comparable, local, table, values
from prosaic.sources.tables import saved

_CUT = "array<struct<quote:string,type:string,action:string,rewrite:string>>"


def _probe_cuts(spark: SparkSession) -> DataFrame:
    return local(spark, probes.CUTS, f"doc_id long, overall_fat_percentage int, cuts {_CUT}")


def cut_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Texts, and cuts: of each document its second and last sentence, its first 30 characters, and a quote it hasn't."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    s = F.filter(F.split("text", "[.\n]"), lambda x: F.length(x) > 0)
    quotes = [(F.get(s, F.lit(1)), "FAT"), (F.element_at(F.when(F.size(s) > 0, s), -1), "REDUNDANT"), (F.substring("text", 1, 30), "TELL"), (F.concat(F.lit("no document has this: "), F.col("doc_id")), "GENERIC")]
    none = F.lit(None).cast("string")
    made = F.array(*[F.struct(F.coalesce(q, F.lit("")).alias("quote"), F.lit(k).alias("type"), F.lit("CUT").alias("action"), none.alias("rewrite")) for q, k in quotes])
    cuts = docs.select("doc_id", (F.pmod("doc_id", F.lit(4)) * 10).cast("int").alias("overall_fat_percentage"), made.alias("cuts"))
    texts = docs.union(local(spark, probes.CUT_TEXTS, "doc_id long, text string"))
    return texts, cuts.unionByName(_probe_cuts(spark))


def q_apply_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts applied in order: each sees what earlier ones left."""
    texts, cuts = cut_inputs(spark, sf_dir)
    done = edit.apply_cuts(texts, cuts, least_fat=10)
    return comparable(done.select("doc_id", "applied", "failed", "skipped", "words_removed", "error", "new_text", F.array_join("reasons", "|").alias("reasons")))


def q_apply_first_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first cut of each document: located exactly, ambiguous or absent."""
    texts, cuts = cut_inputs(spark, sf_dir)
    first = cuts.filter("doc_id >= 0").withColumn("cuts", F.slice("cuts", 1, 1)).withColumn("overall_fat_percentage", F.lit(50))
    done = edit.apply_cuts(texts, first)
    return comparable(done.select("doc_id", "applied", "failed", "skipped", F.coalesce(F.length("new_text"), F.lit(-1)).alias("new_length")))


def q_cuts_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, cuts = cut_inputs(spark, sf_dir)
    return comparable(edit.apply_cuts(texts, cuts, types=["FAT", "TELL", "REDUNDANT"], least_fat=10, dry_run=True))


def q_cut_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, cuts = cut_inputs(spark, sf_dir)
    return comparable(edit.totals(edit.apply_cuts(texts, cuts, types=["FAT", "TELL", "REDUNDANT"], least_fat=10, dry_run=True)))


def q_cut_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(edit.type_counts(cut_inputs(spark, sf_dir)[1]))


def q_dominant_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(edit.dominant_type(cut_inputs(spark, sf_dir)[1]))


def _players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as players; strength is the number of words, and a pair whose ids are both divisible by 5 fails."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select(F.col("doc_id").alias("player"), F.col("doc_id").alias("seed"), t.word_count(t.blank_if_null(F.col("text"))).alias("strength"))


def _tournament(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    players = saved(_players(spark, sf_dir), "players")
    strength = players.select("player", "strength")

    def judge(pairs: DataFrame) -> DataFrame:
        a = strength.select(F.col("player").alias("a"), F.col("strength").alias("sa"))
        b = strength.select(F.col("player").alias("b"), F.col("strength").alias("sb"))
        answer = F.when((F.pmod("a", F.lit(5)) == 0) & (F.pmod("b", F.lit(5)) == 0), "?").when(F.col("sa") >= F.col("sb"), "A").otherwise(F.col("b").cast("string"))
        return pairs.join(a, "a").join(b, "b").withColumn("winner", rating.winner_of(answer, F.col("a"), F.col("b")))

    return rating.tournament(players, judge)


def q_tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = _tournament(spark, sf_dir)[0].withColumn("elo", F.round("elo", 6))
    return comparable(ratings.select("player", "elo"))


def q_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = _tournament(spark, sf_dir)[0].withColumn("elo", F.round("elo", 6))
    return comparable(rating.ranking(ratings).select("player", "rank"))


def q_matchups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(_tournament(spark, sf_dir)[1].withColumn("winner", F.coalesce("winner", F.lit(-1))))


def q_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, and documents as scripts of one segment, in chunks of 4500 characters."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("script"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), "text")
    docs = table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("script"), F.lit(0).cast("bigint").alias("seq"), F.lit("NARRATOR").alias("speaker"), "text")
    voiced = chunk.with_voices(turns.union(docs), local(spark, probes.VOICES, "seq int, speaker string, voice_id string"))
    made = chunk.chunk_segments(voiced, "script", "seq")
    return comparable(made.groupBy("script", "chunk").agg(F.count("*").alias("segments"), F.sum(F.length("text")).alias("chars")))


def q_script_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    scripts = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text")))).alias("segments"))
    return comparable(chunk.script_totals(scripts, "conv_id").withColumn("speakers", F.array_join("speakers", "|")))


def q_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunk.manifest(local(spark, probes.CALLS, "chapter int, chunk int, attempt int, ok boolean"))
    return comparable(made.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|") for c in ("succeeded", "failed")}))


def q_audio_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = local(spark, [(n,) for n in (1, 2, 3, 4)], "chapter int")
    made = chunk.manifest(local(spark, probes.CALLS, "chapter int, chunk int, attempt int, ok boolean"))
    return comparable(chunk.status(scripts, local(spark, [(1,), (2,), (4,)], "chapter int"), made))


def q_foundation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = local(spark, probes.FOUNDATION, "run string, iteration int, score double, lore_score double")
    return comparable(control.foundation(rows))


def q_best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as scores: each user's improvements."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return comparable(control.best_so_far(rows, "user_id", "event_id", "value"))


def q_drafting(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = control.drafting(local(spark, probes.ATTEMPTS, "chapter int, attempt int, ok boolean, bytes int, score double, word_count int"))
    return comparable(made.fillna(-1, ["attempt", "word_count"]))


def q_plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(control.plateau(local(spark, probes.CYCLES, "run string, cycle int, score double")))


def q_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(control.acceptance(local(spark, probes.REVISIONS, "chapter int, pre double, post double")))


def q_review_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = local(spark, probes.ROUNDS, "run string, round int, stars double, total_items int, major_items int, qualified_items int")
    return comparable(control.review_rounds(rows).select("run", "round", F.col("decision.stop").alias("stop"), "ran"))


def q_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = local(spark, probes.STATES, "id int, phase string, only string")
    return comparable(rows.select("id", F.array_join(control.phases_left(F.col("phase"), F.col("only")), "|").alias("phases")))


def q_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = local(spark, [("foundation", None, 3, None), (None, "x", None, 4.5)], "phase string, current_focus string, iteration int, novel_score double")
    return comparable(control.with_defaults(rows).drop("debts"))


def q_latest_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = local(spark, probes.LOGS, "file_name string, value double")
    full = control.latest(logs, "_full\\.json$").select(F.lit(-1).alias("chapter"), "file_name", "value")
    return comparable(full.unionByName(control.latest_chapter_eval(logs)))


def q_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours between each user's first and last event."""
    spans = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return comparable(spans.select("user_id", control.elapsed_hours(F.col("a"), F.col("b")).alias("hours"), F.date_format("a", "yyyyMMdd_HHmmss").alias("stamp")))


def q_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = score.profile(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return comparable(control.batch_summary(docs))


_CUT_ROWS = [(d, i, q, k) for d, _, own in probes.CUTS for i, (q, k, *_) in enumerate(own)]
_ALL_CUTS = f"""
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[.\\n]'), lambda x: length(x) > 0) AS s FROM docs),
fat AS (SELECT doc_id, (doc_id % 4) * 10 AS fat FROM docs UNION ALL SELECT * FROM {values([(d, f) for d, f, _ in probes.CUTS], ["doc_id", "fat"])}),
cuts AS (SELECT doc_id, 0 AS place, coalesce(s[2], '') AS quote, 'FAT' AS type FROM s UNION ALL SELECT doc_id, 1, coalesce(s[-1], ''), 'REDUNDANT' FROM s UNION ALL SELECT doc_id, 2, left(text, 30), 'TELL' FROM s
  UNION ALL SELECT doc_id, 3, 'no document has this: ' || doc_id, 'GENERIC' FROM s UNION ALL SELECT * FROM {values(_CUT_ROWS, ["doc_id", "place", "quote", "type"])}),
long AS (SELECT *, length(regexp_replace(quote, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')) >= 25 AS ok, len(regexp_extract_all(quote, '[^{SPACE}]+')) AS w FROM cuts)"""

DRY_SQL = f"""
WITH {_ALL_CUTS}, a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (ok AND type IN ('FAT', 'TELL', 'REDUNDANT')) AS k, coalesce(sum(w) FILTER (ok AND type IN ('FAT', 'TELL', 'REDUNDANT')), 0) AS w FROM long GROUP BY 1),
b AS (SELECT doc_id, fat, coalesce(n, 0) AS n, coalesce(k, 0) AS k, coalesce(w, 0) AS w FROM fat LEFT JOIN a USING (doc_id)),
c AS (SELECT *, CASE WHEN fat < 10 THEN 'fat ' || fat || '% < threshold 10%' WHEN n = 0 THEN 'no cuts in file' END AS error FROM b)
SELECT doc_id, (CASE WHEN error IS NULL THEN k ELSE 0 END)::BIGINT AS applied, 0::BIGINT AS failed, (CASE WHEN fat < 10 THEN n WHEN error IS NULL THEN n - k ELSE 0 END)::BIGINT AS skipped, (CASE WHEN error IS NULL THEN w ELSE 0 END)::BIGINT AS words_removed, error FROM c
"""
CUT_TOTALS_SQL = f"SELECT sum(applied)::BIGINT AS applied, sum(failed)::BIGINT AS failed, sum(skipped)::BIGINT AS skipped, sum(words_removed)::BIGINT AS words_removed FROM ({DRY_SQL})"
FIRST_CUT_SQL = f"""
WITH {_ALL_CUTS}, f AS (SELECT l.doc_id, l.quote, l.ok, d.text, CASE WHEN l.quote = '' THEN 0 ELSE (length(d.text) - length(replace(d.text, l.quote, ''))) // length(l.quote) END AS n FROM long l JOIN docs d USING (doc_id) WHERE l.doc_id >= 0 AND place = 0)
SELECT doc_id, (ok AND n = 1)::BIGINT AS applied, (ok AND n <> 1)::BIGINT AS failed, (NOT ok)::BIGINT AS skipped, CASE WHEN ok AND n = 1 THEN length(regexp_replace(replace(text, quote, ''), '\\n{{3,}}', chr(10) || chr(10), 'g')) ELSE -1 END AS new_length FROM f
"""
APPLY_SQL = f"""
WITH RECURSIVE {_ALL_CUTS},
texts AS (SELECT * FROM docs UNION ALL SELECT * FROM {values(probes.CUT_TEXTS, ["doc_id", "text"])}),
n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (ok) AS ok FROM long GROUP BY 1),
b AS (SELECT f.doc_id, fat, coalesce(n, 0) AS n, coalesce(ok, 0) AS ok, text, CASE WHEN fat < 10 THEN 'fat ' || fat || '% < threshold 10%' WHEN coalesce(n, 0) = 0 THEN 'no cuts in file' WHEN text IS NULL THEN 'text not found' END AS error
  FROM fat f LEFT JOIN n ON n.doc_id = f.doc_id LEFT JOIN texts t ON t.doc_id = f.doc_id),
c AS (SELECT doc_id, quote, w, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k, array_to_string(regexp_extract_all(quote, '[^{SPACE}]+'), ' ') AS plain,
  array_to_string(list_transform(regexp_extract_all(quote, '[^{SPACE}]+'), lambda x: regexp_escape(x)), '[{SPACE}]+') AS pattern FROM long WHERE ok),
f AS (SELECT doc_id, 0::BIGINT AS k, text, 0 AS applied, 0 AS failed, 0::BIGINT AS words, ''::VARCHAR AS reasons FROM b WHERE error IS NULL
  UNION ALL
  SELECT x.doc_id, x.k, CASE WHEN n = 1 THEN replace(x.text, quote, '') WHEN n = 0 AND why = '' THEN regexp_replace(x.text, pattern, '') ELSE x.text END, applied + (why = '')::INT, failed + (why <> '')::INT, words + CASE WHEN why = '' THEN w ELSE 0 END,
    reasons || CASE WHEN x.k > 1 THEN '|' ELSE '' END || why
  FROM (SELECT y.*, CASE WHEN n = 1 THEN '' WHEN n > 1 THEN 'ambiguous (' || n || ' matches)' WHEN length(plain) < 25 THEN 'quote too short after normalisation' WHEN m = 1 THEN '' WHEN m > 1 THEN 'ambiguous after ws-norm (' || m || ' matches)' ELSE 'not found' END AS why
    FROM (SELECT f.doc_id, c.k, f.text, applied, failed, words, reasons, quote, plain, pattern, w, (length(f.text) - length(replace(f.text, quote, ''))) // length(quote) AS n, len(regexp_extract_all(f.text, pattern)) AS m
      FROM f JOIN c ON c.doc_id = f.doc_id AND c.k = f.k + 1) y) x),
l AS (SELECT doc_id, arg_max(text, k) AS text, max(applied) AS applied, max(failed) AS failed, max(words) AS words, arg_max(reasons, k) AS reasons FROM f GROUP BY 1)
SELECT b.doc_id, coalesce(applied, 0)::BIGINT AS applied, coalesce(failed, 0)::BIGINT AS failed, (CASE WHEN fat < 10 THEN n WHEN error IS NULL THEN n - ok ELSE 0 END)::BIGINT AS skipped, coalesce(words, 0)::BIGINT AS words_removed, error,
  CASE WHEN applied > 0 THEN regexp_replace(l.text, '\n{{3,}}', chr(10) || chr(10), 'g') END AS new_text, coalesce(reasons, '') AS reasons
FROM b LEFT JOIN l ON l.doc_id = b.doc_id
"""
CUT_TYPES_SQL = f"WITH {_ALL_CUTS} SELECT doc_id, type, count(*) AS n, min(place)::BIGINT AS first_place FROM cuts GROUP BY 1, 2"
DOMINANT_SQL = f"""
WITH {_ALL_CUTS}, c AS (SELECT doc_id, type, count(*) AS n, min(place) AS p FROM cuts GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS k FROM c)
SELECT fat.doc_id, coalesce(type, 'MIXED') AS dominant FROM fat LEFT JOIN r ON r.doc_id = fat.doc_id AND k = 1
"""


def _rounds(n: int) -> str:
    parts = [f"e0 AS (SELECT doc_id AS player, len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+')) AS strength, 1500e0 AS elo FROM documents)"]
    for k in range(1, n + 1):
        parts.append(
            f"""r{k} AS (SELECT *, row_number() OVER (ORDER BY elo DESC, player) - 1 AS rn FROM e{k - 1}),
p{k} AS (SELECT a.player AS a, b.player AS b, a.elo AS ea, b.elo AS eb, CASE WHEN a.player % 5 = 0 AND b.player % 5 = 0 THEN NULL WHEN a.strength >= b.strength THEN a.player ELSE b.player END AS w FROM r{k} a JOIN r{k} b ON b.rn = a.rn + 1 AND a.rn % 2 = 0),
g{k} AS (SELECT a AS player, 32 * ((w = a)::INT - 1 / (1 + pow(10e0, (eb - ea) / 400))) AS g FROM p{k} WHERE w IS NOT NULL UNION ALL SELECT b, 32 * ((1 - (w = a)::INT) - (1 - 1 / (1 + pow(10e0, (eb - ea) / 400)))) FROM p{k} WHERE w IS NOT NULL),
e{k} AS (SELECT player, strength, elo + coalesce(g, 0e0) AS elo FROM e{k - 1} LEFT JOIN g{k} USING (player))"""
        )
    return ", ".join(parts)


TOURNAMENT_SQL = f"WITH {_rounds(4)} SELECT player, round(elo, 6) AS elo FROM e4"
RANKING_SQL = f"WITH {_rounds(4)} SELECT player, row_number() OVER (ORDER BY round(elo, 6) DESC, player) AS rank FROM e4"
MATCHUPS_SQL = f"WITH {_rounds(4)} " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS round, a, b, coalesce(w, -1) AS winner FROM p{k}" for k in range(1, 5))

#: The greedy fold, one unit a step for all scripts at once: segments, and the sentences of segments that are too long.
CHUNKS_SQL = """
WITH RECURSIVE t AS (SELECT conv_id AS script, turn AS seq, text FROM conversations WHERE text IS NOT NULL UNION ALL SELECT -1 - doc_id, 0, text FROM documents WHERE text IS NOT NULL),
u AS (SELECT script, seq, 0 AS i, 1 AS n, length(text) AS size, trim(regexp_replace(text, '\\[.*?\\]', '', 'g'), chr(10) || chr(9) || chr(13) || ' ') = '' AS blank, false AS part FROM t WHERE length(text) <= 4500
  UNION ALL SELECT script, seq, i, n, length(s), false, true FROM (SELECT script, seq, unnest(p) AS s, unnest(range(len(p))) AS i, len(p) AS n FROM (SELECT script, seq, string_split(replace(text, '. ', '.' || chr(10)), chr(10)) AS p FROM t WHERE length(text) > 4500))),
o AS (SELECT *, row_number() OVER (PARTITION BY script ORDER BY seq, i) AS k FROM u),
f AS (SELECT script, 0::BIGINT AS k, 0 AS chunk, 0 AS held, 0::BIGINT AS size, 0 AS put, false AS part, 0::BIGINT AS own FROM (SELECT DISTINCT script FROM o)
  UNION ALL
  SELECT o.script, o.k, c.chunk + c.flush + CASE WHEN o.part AND o.i = o.n - 1 THEN 1 ELSE 0 END,
    CASE WHEN o.part THEN CASE WHEN o.i = o.n - 1 THEN 0 ELSE 1 END WHEN o.blank THEN CASE WHEN c.flush = 1 THEN 0 ELSE c.held END ELSE 1 END,
    CASE WHEN o.part THEN CASE WHEN o.i = o.n - 1 THEN 0 WHEN c.flush = 1 OR o.i = 0 THEN o.size + 1 ELSE c.size + o.size + 1 END ELSE CASE WHEN c.flush = 1 THEN 0 ELSE c.size END + CASE WHEN o.blank THEN 0 ELSE o.size END END,
    c.chunk + c.flush, o.part, CASE WHEN NOT o.part AND o.blank THEN -1 ELSE o.size END
  FROM (SELECT f.script, f.k, f.chunk, f.held, f.size, CASE WHEN f.held = 0 THEN 0 WHEN o.part AND o.i = 0 THEN 1 WHEN f.size + o.size > 4500 THEN 1 ELSE 0 END AS flush FROM f JOIN o ON o.script = f.script AND o.k = f.k + 1) c
  JOIN o ON o.script = c.script AND o.k = c.k + 1)
SELECT script, put::BIGINT AS chunk, (CASE WHEN bool_or(part) THEN 1 ELSE count(*) END)::BIGINT AS segments, (sum(own) + CASE WHEN bool_or(part) THEN count(*) - 1 ELSE 0 END)::BIGINT AS chars FROM f WHERE k > 0 AND own >= 0 GROUP BY script, put
"""

SCRIPT_SQL = "SELECT conv_id, count(*) AS total_segments, string_agg(DISTINCT role, '|' ORDER BY role) AS speakers, coalesce(sum(length(text)), 0)::BIGINT AS total_chars FROM conversations GROUP BY 1"
_CALLS = f"e AS (SELECT chapter, chunk, bool_or(ok) AS ok FROM {values(probes.CALLS, ['chapter', 'chunk', 'attempt', 'ok'])} WHERE attempt <= 3 GROUP BY 1, 2)"
MANIFEST_SQL = f"WITH {_CALLS} SELECT chapter::BIGINT AS chapter, count(*) AS total_chunks, coalesce(string_agg(CASE WHEN ok THEN chunk::VARCHAR END, '|' ORDER BY chunk), '') AS succeeded, coalesce(string_agg(CASE WHEN NOT ok THEN chunk::VARCHAR END, '|' ORDER BY chunk), '') AS failed, bool_and(ok) AS complete FROM e GROUP BY 1"
STATUS_SQL = f"""WITH {_CALLS}, m AS (SELECT chapter, bool_and(ok) AS ok FROM e GROUP BY 1), s AS (SELECT unnest([1, 2, 3, 4]) AS chapter)
SELECT s.chapter::BIGINT AS chapter, CASE WHEN s.chapter NOT IN (1, 2, 4) THEN 'not generated' WHEN m.chapter IS NULL THEN 'generated' WHEN NOT ok THEN 'partial' ELSE 'complete' END AS status FROM s LEFT JOIN m USING (chapter)"""

FOUNDATION_SQL = f"""
WITH f AS (SELECT run, iteration::BIGINT AS iteration, score::DOUBLE AS score, lore_score::DOUBLE AS lore_score FROM {values(probes.FOUNDATION, ["run", "iteration", "score", "lore_score"])}),
b AS (SELECT *, greatest(coalesce(max(score) OVER (PARTITION BY run ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0), 0e0) AS best_before FROM f),
k AS (SELECT *, score > best_before AS kept, greatest(best_before, score) >= 7.5 AS passed FROM b)
SELECT * FROM (SELECT *, coalesce(max(passed::INT) OVER (PARTITION BY run ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM k) WHERE d = 0
""".replace("SELECT * FROM (SELECT *, coalesce", "SELECT run, iteration, score, lore_score, best_before, kept, passed FROM (SELECT *, coalesce")
BEST_SQL = """
WITH b AS (SELECT user_id, event_id, round(value, 9) AS value, greatest(coalesce(max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0), 0e0) AS bb, value AS v FROM events)
SELECT user_id, event_id, value, round(bb, 9) AS best_before, coalesce(v > bb, false) AS kept FROM b
"""
DRAFTING_SQL = f"""
WITH a AS (SELECT *, ok AND bytes >= 100 AS u FROM {values(probes.ATTEMPTS, ["chapter", "attempt", "ok", "bytes", "score", "word_count"])} WHERE attempt <= 5),
k AS (SELECT chapter, min(attempt) FILTER (u AND coalesce(score >= 6, false)) AS first, max(attempt) FILTER (u OR bytes > 0) AS last FROM a GROUP BY 1)
SELECT k.chapter::BIGINT AS chapter, coalesce(first, last, -1)::BIGINT AS attempt, CASE WHEN first IS NULL THEN '?' ELSE a.score::DOUBLE::VARCHAR END AS score, coalesce(a.word_count, -1)::BIGINT AS word_count, CASE WHEN first IS NOT NULL THEN 'keep' WHEN last IS NOT NULL THEN 'forced' ELSE 'missing' END AS status
FROM k LEFT JOIN a ON a.chapter = k.chapter AND a.attempt = coalesce(first, last)
"""
PLATEAU_SQL = f"""
WITH h AS (SELECT run, cycle::BIGINT AS cycle, score::DOUBLE AS score FROM {values(probes.CYCLES, ["run", "cycle", "score"])}),
c AS (SELECT *, abs(score - coalesce(lag(score) OVER (PARTITION BY run ORDER BY cycle), 0e0)) AS change FROM h), s AS (SELECT *, cycle >= 3 AND change < 0.3e0 AS stop FROM c)
SELECT *, coalesce(max(stop::INT) OVER (PARTITION BY run ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS ran FROM s
"""
ACCEPTANCE_SQL = f"SELECT chapter::BIGINT AS chapter, pre::DOUBLE AS pre, post::DOUBLE AS post, coalesce(post >= pre, false) AS accepted FROM {values(probes.REVISIONS, ['chapter', 'pre', 'post'])}"
ROUNDS_SQL = f"""
WITH r AS (SELECT *, coalesce(stars, 0) AS s FROM {values(probes.ROUNDS, ["run", "round", "stars", "total", "major", "qualified"])} WHERE round <= 4),
d AS (SELECT *, coalesce((s >= 4.5 AND major = 0) OR (s >= 4 AND total > 0 AND qualified / total > 0.5), false) AS stop FROM r)
SELECT run, round::BIGINT AS round, stop, coalesce(max(stop::INT) OVER (PARTITION BY run ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS ran FROM d
"""
PHASES_SQL = f"""
WITH s AS (SELECT *, list_position(['foundation', 'drafting', 'revision', 'export'], coalesce(phase, 'foundation')) AS pos FROM {values(probes.STATES, ["id", "phase", "only_"])})
SELECT id::BIGINT AS id, CASE WHEN only_ IS NOT NULL THEN only_ WHEN phase = 'complete' THEN '' ELSE array_to_string(['foundation', 'drafting', 'revision', 'export'][greatest(coalesce(pos, 1), 1):4], '|') END AS phases FROM s
"""
STATE_SQL = """
SELECT 'foundation' AS phase, p.f AS current_focus, p.i AS iteration, 0e0 AS foundation_score, 0e0 AS lore_score, 0::BIGINT AS chapters_drafted, 0::BIGINT AS chapters_total, p.n AS novel_score, 0::BIGINT AS revision_cycle
FROM (VALUES (NULL, 3::BIGINT, 0e0), ('x', 0, 4.5e0)) p(f, i, n)
"""
LATEST_SQL = f"""
WITH l AS (SELECT file_name, value::DOUBLE AS value, try_cast(nullif(regexp_extract(file_name, '_ch(0?[0-9]+)\\.json$', 1), '') AS BIGINT) AS chapter FROM {values(probes.LOGS, ["file_name", "value"])})
SELECT -1::BIGINT AS chapter, max(file_name) AS file_name, arg_max(value, file_name) AS value FROM l WHERE regexp_matches(file_name, '_full\\.json$')
UNION ALL SELECT chapter, max(file_name), arg_max(value, file_name) FROM l WHERE chapter IS NOT NULL GROUP BY 1
"""
ELAPSED_SQL = "SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000e0, 9) AS hours, strftime(min(ts), '%Y%m%d_%H%M%S') AS stamp FROM events GROUP BY 1"
BATCH_SQL = f"WITH w AS (SELECT len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+')) AS w FROM documents) SELECT sum(w)::BIGINT AS total_words, count(*) FILTER (w > 0) AS drafted FROM w"

QUERIES = {
    "q_apply_first_cut": (q_apply_first_cut, FIRST_CUT_SQL),
    "q_cuts_dry_run": (q_cuts_dry_run, DRY_SQL),
    "q_cut_totals": (q_cut_totals, CUT_TOTALS_SQL),
    "q_cut_types": (q_cut_types, CUT_TYPES_SQL),
    "q_dominant_cut": (q_dominant_cut, DOMINANT_SQL),
    "q_apply_cuts": (q_apply_cuts, APPLY_SQL),
    "q_tournament": (q_tournament, TOURNAMENT_SQL),
    "q_ranking": (q_ranking, RANKING_SQL),
    "q_matchups": (q_matchups, MATCHUPS_SQL),
    "q_chunks": (q_chunks, CHUNKS_SQL),
    "q_script_totals": (q_script_totals, SCRIPT_SQL),
    "q_manifest": (q_manifest, MANIFEST_SQL),
    "q_audio_status": (q_audio_status, STATUS_SQL),
    "q_foundation": (q_foundation, FOUNDATION_SQL),
    "q_best_so_far": (q_best_so_far, BEST_SQL),
    "q_drafting": (q_drafting, DRAFTING_SQL),
    "q_plateau": (q_plateau, PLATEAU_SQL),
    "q_acceptance": (q_acceptance, ACCEPTANCE_SQL),
    "q_review_rounds": (q_review_rounds, ROUNDS_SQL),
    "q_phases": (q_phases, PHASES_SQL),
    "q_state": (q_state, STATE_SQL),
    "q_latest_eval": (q_latest_eval, LATEST_SQL),
    "q_elapsed": (q_elapsed, ELAPSED_SQL),
    "q_batch_summary": (q_batch_summary, BATCH_SQL),
}
