"""Queries over revision briefs, and over files written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosaic.functions import lexicons as L
from prosaic.functions import text as t
from prosaic.operators import brief, feedback
from prosaic.plans import probes
from prosaic.plans.corpus import comparable, local, table, values
from prosaic.plans.feedback_queries import SPLIT_SQL, panel
from prosaic.sources import files
from prosaic.sources.tables import new_folder

_CHAPTERS = [
    (5, "# Chapter 5: The Market\n\n" + "word " * 100, "The bell, once.", ["One good line.", "Another."]),
    (7, "# Chapter 7: The Bridge\n\n" + "word " * 200, None, None),
    (9, "# Chapter Nine\n\nshort", "", []),
    (12, "no title\n" + "word " * 37, None, ["A line."]),
    (13, "# Chapter 13: Calm\n\n" + "word " * 99, None, None),
    (30, "# Chapter 30: Nobody Speaks of It\n\n" + "word " * 10, None, None),
]
_DIMS = "map<string,struct<score:string,weakest_moment:string,fix:string,note:string>>"
_EVALS = [
    (5, {"voice_adherence": ("7", "the toast", "cut it", ""), "engagement": ("8", "x", "y", ""), "continuity": ("5.9", "the map", "", ""), "beat_coverage": ("?", "a", "b", "")}, 5.0, ["do this", "do that"], ["triads"], ["weak one"], ["strong one"]),
    (7, {"prose_quality": ("3", "", "shorter", "")}, 7.0, [], [], [], []),
    (9, {}, 7.5, None, None, None, None),
]
_NOVEL = [(5, "pacing_curve", "Start later.", 6.5, "Slow in Ch 5 and Chapters 7.", {"pacing_curve": "Slow in Chapters 5 and 6.", "voice_consistency": "Fine; see Ch 15.", "arc_completion": None})]
_BRIEF_CUTS = [
    (5, [("a quote " * 30, "FAT", "dull", "CUT", None), ("second", "STRUCTURAL", "why", "CUT", None), ("third", "REDUNDANT", "twice", "REWRITE", "3rd"), ("fourth", "FAT", "again", "KEEP", None)], 40, "loose one", 21, "Too long."),
    (7, [], 0, "", 0, ""),
    (12, [("fifth", None, None, None, None)], 3, None, 4, None),
]


def _inputs(spark: SparkSession) -> dict[str, DataFrame]:
    evals = local(spark, _EVALS, f"chapter int, dims {_DIMS}, overall_score double, top_3_revisions array<string>, ai_patterns_detected array<string>, three_weakest_sentences array<string>, three_strongest_sentences array<string>")
    novel = local(spark, _NOVEL, "weakest_chapter int, weakest_dimension string, top_suggestion string, novel_score double, pacing_note string, notes map<string,string>")
    cuts = local(spark, _BRIEF_CUTS, "chapter int, cuts array<struct<quote:string,type:string,reason:string,action:string,rewrite:string>>, total_cuttable_words int, loosest_passage string, overall_fat_percentage int, one_sentence_verdict string")
    return {"chapters": local(spark, _CHAPTERS, "chapter int, text string, tightest string, strongest array<string>"), "evals": evals, "novel": novel, "cuts": cuts, "panel": panel(spark)}


def _flat(df: DataFrame) -> DataFrame:
    return comparable(df.withColumns({c: F.array_join(c, "|") for c in ("problems", "keeps", "changes")}))


def q_panel_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _inputs(spark)
    return _flat(brief.panel_brief(x["chapters"], x["panel"]))


def q_panel_brief_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _inputs(spark)
    return comparable(brief.panel_brief(x["chapters"], x["panel"]).select("chapter", "title", "words", "brief_type", "target_words"))


def q_eval_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _inputs(spark)
    return _flat(brief.eval_brief(x["chapters"], x["evals"], x["novel"]))


def q_cuts_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _inputs(spark)
    return _flat(brief.cuts_brief(x["chapters"], x["cuts"]))


def q_auto_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _inputs(spark)
    return _flat(brief.auto_brief(x["chapters"], x["evals"], x["novel"], x["panel"], x["cuts"]))


def q_rendered_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _inputs(spark)
    return comparable(brief.render(brief.panel_brief(x["chapters"], x["panel"])))


def q_experiment_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log appended to twice and read again."""
    folder = new_folder(spark, "files")
    rows = local(spark, [(f"c{c}", "ch", "?" if s is None else repr(s), n, "keep", f"attempt {c}") for c, (_, _, _, _, s, n) in enumerate(probes.ATTEMPTS)], "commit string, phase string, score string, word_count int, status string, description string")
    files.append_experiments(rows.filter("word_count < 1400"), folder)
    files.append_experiments(rows.filter("word_count >= 1400"), folder)
    return comparable(files.experiments(spark, folder))


def q_chapter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON logs and read again, whole."""
    folder = new_folder(spark, "files")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    files.write_json(docs, folder)
    read = spark.read.schema("doc_id long, text string, lang string").json(folder)
    return comparable(read.select("doc_id", "lang", t.word_count(F.col("text")).alias("words")))


_LOG = [(f"c{c}", "ch", "?" if s is None else repr(s), n, "keep", f"attempt {c}") for c, (_, _, _, _, s, n) in enumerate(probes.ATTEMPTS)]
LOG_SQL = "SELECT commit_ AS commit, phase, score, word_count::BIGINT AS word_count, status, description FROM " + values(_LOG, ["commit_", "phase", "score", "word_count", "status", "description"])
FILES_SQL = r"SELECT doc_id, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))::BIGINT AS words FROM documents"

TYPE_SQL = f"""
WITH c AS (SELECT * FROM {values([(n, x) for n, x, _, _ in _CHAPTERS], ["chapter", "text"])}), panel AS (SELECT * FROM {values(probes.PANEL, ["reader", "question", "answer"])}),
h AS (SELECT chapter, question FROM c, panel WHERE regexp_matches(coalesce(answer, ''), '(?i)\\b(?:Chapter|Ch\\.?)\\s*' || chapter || '\\b')),
k AS (SELECT c.chapter, text, len(regexp_extract_all(text, '\\S+')) AS words, CASE WHEN bool_or(question = 'cut_candidate') THEN 'COMPRESS' WHEN bool_or(question = 'worst_scene') THEN 'DRAMATIZE' WHEN bool_or(question = 'momentum_loss') THEN 'TIGHTEN' ELSE 'REVISE' END AS brief_type
  FROM c LEFT JOIN h ON h.chapter = c.chapter GROUP BY 1, 2)
SELECT chapter::BIGINT AS chapter, coalesce(nullif(trim(regexp_replace(regexp_replace(CASE WHEN starts_with(text, '#') THEN split_part(text, chr(10), 1) ELSE '' END, '^#+\\s*', ''), '(?i)^Chapter\\s+(?:[0-9]+|[A-Z][a-z]+(?:-[A-Z][a-z]+)*)\\s*[:—–-]*\\s*', '')), ''), 'Untitled') AS title,
  words::BIGINT AS words, brief_type, trunc(words * CASE brief_type WHEN 'COMPRESS' THEN 0.55e0 WHEN 'TIGHTEN' THEN 0.85e0 ELSE 1e0 END)::BIGINT AS target_words FROM k
"""

_TITLE = "coalesce(nullif(trim(regexp_replace(regexp_replace(CASE WHEN starts_with(text, '#') THEN split_part(text, chr(10), 1) ELSE '' END, '^#+\\s*', ''), '(?i)^Chapter\\s+(?:[0-9]+|[A-Z][a-z]+(?:-[A-Z][a-z]+)*)\\s*[:—–-]*\\s*', '')), ''), 'Untitled')"
_TIGHT = [(n, x, tight, "|".join(f'- "{s}"' for s in strong or [])) for n, x, tight, strong in _CHAPTERS]
_FLAT_CUTS = [(n, i, *[c[k] for k in (0, 1, 2, 3, 4)]) for n, own, *_ in _BRIEF_CUTS for i, c in enumerate(own)]
_CUT_FACTS = [(n, len(own), total, loose, fat, verdict) for n, own, total, loose, fat, verdict in _BRIEF_CUTS]

# parts of a list are joined by bars; empty ones are left out
CUTS_BRIEF_SQL = f"""
WITH c AS (SELECT chapter, text, tight, strong FROM {values(_TIGHT, ["chapter", "text", "tight", "strong"])}),
f AS (SELECT chapter, n, total, loose, fat, verdict FROM {values(_CUT_FACTS, ["chapter", "n", "total", "loose", "fat", "verdict"])}),
x AS (SELECT chapter, place, coalesce(quote, '') AS quote, coalesce(type, 'OTHER') AS type, coalesce(reason, '') AS reason, coalesce(action, 'CUT') AS action, rewrite FROM {values(_FLAT_CUTS, ["chapter", "place", "quote", "type", "reason", "action", "rewrite"])}),
k AS (SELECT chapter, type, count(*) AS n, min(place) AS p FROM x GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY n DESC, p) AS r FROM k),
d AS (SELECT chapter, max(CASE WHEN r = 1 THEN type END) AS dominant, max(CASE WHEN r = 1 THEN n END) AS top, string_agg(CASE WHEN r > 1 THEN '- ' || type || ': ' || n || ' instances' END, '|' ORDER BY r) AS rest FROM o GROUP BY 1),
e AS (SELECT chapter, string_agg('"' || CASE WHEN length(quote) > 200 THEN left(quote, 200) || '...' ELSE quote END || '" ' || reason || CASE WHEN action = 'REWRITE' AND coalesce(rewrite, '') <> '' THEN ' → Rewrite as: ' || rewrite WHEN action = 'CUT' THEN ' → Cut entirely' ELSE '' END,
  '|' ORDER BY list_position({brief.CUT_ORDER}, type), place) AS changes FROM x WHERE type IN {tuple(brief.CUT_ORDER)} GROUP BY 1),
w AS (SELECT *, len(regexp_extract_all(text, '\\S+')) AS words FROM c JOIN f USING (chapter))
SELECT w.chapter::BIGINT AS chapter, {_TITLE} AS title, words::BIGINT AS words, 'TIGHTEN' AS brief_type, (words - coalesce(total, 0))::BIGINT AS target_words, coalesce(dominant, 'MIXED') AS dominant, coalesce(changes, '') AS changes,
  concat_ws('|', nullif('Tightest passage: ' || nullif(tight, ''), ''), nullif(strong, '')) AS keeps,
  concat_ws('|', 'Adversarial edit found ' || coalesce(total, 0) || ' cuttable words (' || coalesce(fat, 0) || '% fat) across ' || w.n || ' passages', 'Verdict: ' || nullif(verdict, ''), 'Dominant cut pattern: ' || coalesce(dominant, 'MIXED') || ' (' || coalesce(top, 0) || ' instances)', rest, 'Loosest passage: ' || nullif(loose, '')) AS problems
FROM w LEFT JOIN d ON d.chapter = w.chapter LEFT JOIN e ON e.chapter = w.chapter
"""

PANEL_BRIEF_SQL = f"""
WITH {SPLIT_SQL}, c AS (SELECT chapter, text, tight, strong FROM {values(_TIGHT, ["chapter", "text", "tight", "strong"])}),
g AS (SELECT chapter, string_agg('- ' || question || ': flagged by ' || k || '/' || total || ' readers (' || replace(flagged_by, '|', ', ') || ')', '|' ORDER BY question) AS flags FROM split WHERE k < total GROUP BY 1),
m AS (SELECT c.chapter, question, '[' || reader || '] ' || answer AS said FROM c, panel WHERE regexp_matches(coalesce(answer, ''), '(?i)\\b(?:Chapter|Ch\\.?)\\s*' || c.chapter || '\\b')),
q AS (SELECT chapter, question, string_agg(CASE WHEN length(said) > 500 THEN left(said, 500) || '...' ELSE said END, '|' ORDER BY said) AS said, min(said) AS first, string_agg(CASE WHEN length(said) > 300 THEN left(said, 300) || '...' ELSE said END, '|' ORDER BY said) AS short FROM m GROUP BY 1, 2),
p AS (SELECT c.chapter, any_value(text) AS text, any_value(tight) AS tight, any_value(strong) AS strong, {', '.join(f"max(CASE WHEN question = '{x}' THEN said END) AS {x}" for x in feedback.BRIEFED)}, max(CASE WHEN question = 'worst_scene' THEN first END) AS worst, max(CASE WHEN question = 'missing_scene' THEN short END) AS missing
  FROM c LEFT JOIN q ON q.chapter = c.chapter GROUP BY 1),
w AS (SELECT p.*, flags, len(regexp_extract_all(text, '\\S+')) AS words, trim(regexp_extract(worst, '(?is)(?:The fix(?:\\s+is\\s*\\w*)?|Fix)\\s*[:—]\\s*(.+)', 1)) AS fix, trim(regexp_replace(worst, '(?s)^[^\\]]*\\]', '')) AS plain,
  CASE WHEN cut_candidate IS NOT NULL THEN 'COMPRESS' WHEN worst_scene IS NOT NULL THEN 'DRAMATIZE' WHEN momentum_loss IS NOT NULL THEN 'TIGHTEN' ELSE 'REVISE' END AS brief_type FROM p LEFT JOIN g USING (chapter))
SELECT chapter::BIGINT AS chapter, {_TITLE} AS title, words::BIGINT AS words, brief_type, trunc(words * CASE brief_type WHEN 'COMPRESS' THEN 0.55e0 WHEN 'TIGHTEN' THEN 0.85e0 ELSE 1e0 END)::BIGINT AS target_words,
  concat_ws('|', flags, momentum_loss, worst_scene, cut_candidate) AS problems,
  concat_ws('|', best_scene, 'Tightest passage (from adversarial edit): "' || nullif(tight, '') || '"', nullif(strong, '')) AS keeps,
  concat_ws('|', CASE WHEN momentum_loss IS NOT NULL THEN 'Pacing: tighten or restructure the scenes that drag' END,
    'Dramatize: ' || CASE WHEN worst IS NULL THEN NULL WHEN fix <> '' THEN rtrim(CASE WHEN length(fix) > 300 THEN left(fix, 300) || '...' ELSE fix END, '.') WHEN length(plain) > 300 THEN left(plain, 300) || '...' ELSE plain END,
    CASE WHEN cut_candidate IS NOT NULL THEN 'Compress: fold essential beats into fewer words' END, CASE WHEN thinnest_character IS NOT NULL THEN 'Deepen character: interiority, physical specificity or a complicating moment' END,
    CASE WHEN missing_scene IS NOT NULL THEN 'Add missing beat near this chapter' END, missing) AS changes
FROM w
"""

_bars = lambda items, wrap="{}": None if not items else "|".join(wrap.format(x) for x in items)
_EVAL_ROWS = [(n, score, _bars(revs), _bars(pats, "- {}"), _bars(weak, '- "{}"'), _bars(strong, '- "{}"')) for n, _, score, revs, pats, weak, strong in _EVALS]
_DIM_ROWS = [(n, d, *own[:3]) for n, dims, *_ in _EVALS for d, own in dims.items()]
(_W_CHAPTER, _W_DIM, _W_TOP, _W_SCORE, _W_PACING, _W_NOTES), = _NOVEL
_NOTE_ROWS = [(d, x) for d, x in _W_NOTES.items()]


def _weak_sql(dims: list[str], need: str) -> str:
    return f"""weak AS (SELECT * FROM (SELECT *, trunc(try_cast(score AS DOUBLE)) AS k FROM {values(_DIM_ROWS, ["chapter", "dim", "score", "moment", "fix"])}) WHERE k <= 7 AND coalesce({need}, '') <> '' AND dim IN {tuple(dims)}),
wk AS (SELECT chapter, string_agg(dim || ' (' || score || '/10): ' || moment, '|' ORDER BY list_position({dims}, dim)) AS moments, string_agg(CASE WHEN fix <> '' THEN '[' || dim || '] ' || fix END, '|' ORDER BY list_position({dims}, dim)) AS fixes FROM weak GROUP BY 1),
ev AS (SELECT chapter, overall::DOUBLE AS overall, revs, pats, weakest, strongest FROM {values(_EVAL_ROWS, ["chapter", "overall", "revs", "pats", "weakest", "strongest"])}),
c AS (SELECT chapter, text, tight FROM {values([(n, x, tight) for n, x, tight, _ in _CHAPTERS], ["chapter", "text", "tight"])}),
b AS (SELECT c.*, ev.chapter IS NOT NULL AS has, overall, revs, pats, weakest, strongest, moments, fixes, len(regexp_extract_all(text, '\\S+'))::BIGINT AS words FROM c LEFT JOIN ev ON ev.chapter = c.chapter LEFT JOIN wk ON wk.chapter = c.chapter)"""


EVAL_BRIEF_SQL = f"""
WITH {_weak_sql(brief.CHAPTER_DIMS, "moment")}
SELECT chapter::BIGINT AS chapter, {_TITLE} AS title, words, words AS target_words, CASE WHEN NOT has THEN 'FIX' WHEN overall <= 5 THEN 'REWRITE' WHEN overall <= 7 THEN 'FIX' ELSE 'POLISH' END AS brief_type,
  concat_ws('|', CASE WHEN chapter = {_W_CHAPTER} THEN 'This is the novel''s weakest chapter' END, moments, pats, weakest, CASE WHEN regexp_matches('{_W_PACING}', '(?i)\\b(?:Chapter|Ch\\.?)\\s*' || chapter || '\\b') THEN 'Pacing note: {_W_PACING}' END) AS problems,
  concat_ws('|', fixes, revs, CASE WHEN chapter = {_W_CHAPTER} OR NOT has THEN '[full eval top suggestion] {_W_TOP}' END) AS changes,
  concat_ws('|', strongest, 'Tightest passage (adversarial edit): "' || nullif(tight, '') || '"') AS keeps
FROM b
"""

_FIRST_CUTS = [(n, i, *c) for n, own, *_ in _BRIEF_CUTS for i, c in enumerate([c for c in own if c[1] in ("REDUNDANT", "OVER-EXPLAIN")][:5])]
AUTO_BRIEF_SQL = f"""
WITH {SPLIT_SQL}, {_weak_sql(brief.AUTO_DIMS, "fix")},
g AS (SELECT chapter, string_agg('- ' || question || ': flagged by ' || k || '/' || total || ' readers (' || replace(flagged_by, '|', ', ') || ')', '|' ORDER BY question || ': flagged by ' || k || '/' || total) AS flags FROM split WHERE k < total AND chapter = {_W_CHAPTER} GROUP BY 1),
said AS (SELECT question, '[' || reader || '] ' || answer AS said FROM panel WHERE regexp_matches(coalesce(answer, ''), '(?i)\\b(?:Chapter|Ch\\.?)\\s*{_W_CHAPTER}\\b')),
q AS (SELECT {', '.join(f"string_agg(CASE WHEN question = '{x}' THEN {wrap} END, '|' ORDER BY said) AS {x}" for x, wrap in (("worst_scene", "left(said, 400)"), ("momentum_loss", "left(said, 400)"), ("cut_candidate", "left(said, 400)"), ("best_scene", "'Panel best scene mention: ' || left(said, 400)")))} FROM said),
notes AS (SELECT string_agg(dim || ': ' || note, '|' ORDER BY list_position({brief.NOVEL_DIMS}, dim)) AS notes FROM {values(_NOTE_ROWS, ["dim", "note"])} WHERE regexp_matches(coalesce(note, ''), '(?i)\\b(?:Chapters?|Ch\\.?)\\s*{_W_CHAPTER}\\b')),
f AS (SELECT chapter, total, fat, verdict FROM {values(_CUT_FACTS, ["chapter", "n", "total", "loose", "fat", "verdict"])}),
x AS (SELECT chapter, string_agg('"' || left(quote, 150) || '..." — ' || coalesce(reason, '') || CASE WHEN action = 'REWRITE' AND coalesce(rewrite, '') <> '' THEN ' → Rewrite as: ' || rewrite WHEN action = 'CUT' THEN ' → Cut entirely' ELSE '' END, '|' ORDER BY place) AS cuts FROM {values(_FIRST_CUTS, ["chapter", "place", "quote", "type", "reason", "action", "rewrite"])} GROUP BY 1)
SELECT b.chapter::BIGINT AS chapter, {_TITLE} AS title, words, words AS target_words, 'AUTO-FIX' AS brief_type,
  concat_ws('|', 'Weakest chapter in the novel (weakest dimension: {_W_DIM})', 'Top suggestion: {_W_TOP}', notes, 'Chapter score: ' || overall, pats, weakest, flags, worst_scene, momentum_loss, cut_candidate,
    CASE WHEN total > 0 THEN 'Adversarial edit: ' || total || ' cuttable words (' || coalesce(fat, 0) || '% fat). ' || coalesce(verdict, '') END) AS problems,
  concat_ws('|', fixes, revs, cuts, '[PRIORITY — full eval] {_W_TOP}') AS changes, concat_ws('|', strongest, best_scene, 'Tightest passage (adversarial edit): ' || nullif(tight, '')) AS keeps
FROM b CROSS JOIN q CROSS JOIN notes LEFT JOIN g ON g.chapter = b.chapter LEFT JOIN f ON f.chapter = b.chapter LEFT JOIN x ON x.chapter = b.chapter WHERE b.chapter = {_W_CHAPTER}
"""

_RULES = "\n".join(f"- {r}" for r in L.VOICE_RULES).replace("'", "''").replace("\n", "' || chr(10) || '")
RENDERED_SQL = f"""
WITH b AS ({PANEL_BRIEF_SQL}), n AS (SELECT *, CASE WHEN changes = '' THEN [] ELSE string_split(changes, '|') END AS each FROM b)
SELECT chapter, '# Revision Brief: Chapter ' || chapter || ' — ' || title || ' (' || brief_type || ')' || chr(10) || chr(10) || '## PROBLEM' || chr(10) || replace(problems, '|', chr(10)) || chr(10) || chr(10) || '## WHAT TO KEEP' || chr(10) || replace(keeps, '|', chr(10)) || chr(10) || chr(10)
  || '## WHAT TO CHANGE' || chr(10) || coalesce(array_to_string(list_transform(each, lambda x, i: i || '. ' || x), chr(10)), '') || chr(10) || chr(10) || '## VOICE RULES' || chr(10) || '{_RULES}' || chr(10) || chr(10) || '## TARGET' || chr(10) || '~' || target_words || ' words' || chr(10) AS markdown
FROM n
"""

QUERIES = {
    "q_panel_brief_type": (q_panel_brief_type, TYPE_SQL),
    "q_experiment_log": (q_experiment_log, LOG_SQL),
    "q_chapter_files": (q_chapter_files, FILES_SQL),
    "q_panel_brief": (q_panel_brief, PANEL_BRIEF_SQL),
    "q_eval_brief": (q_eval_brief, EVAL_BRIEF_SQL),
    "q_cuts_brief": (q_cuts_brief, CUTS_BRIEF_SQL),
    "q_auto_brief": (q_auto_brief, AUTO_BRIEF_SQL),
    "q_rendered_brief": (q_rendered_brief, RENDERED_SQL),
}
