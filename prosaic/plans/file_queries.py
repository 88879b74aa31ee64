"""Queries over files of a project: each writes its files to the shared folder and reads them with the library's loaders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosaic.functions import text as t
from prosaic.operators import chunk, control, edit, markup
from prosaic.plans.corpus import SPACE, comparable, local, table, values
from prosaic.plans.edit_queries import APPLY_SQL, cut_inputs
from prosaic.sources import files
from prosaic.sources.tables import new_folder


def _put(spark: SparkSession, named: dict[str, str]) -> str:
    """A new folder with the named files; each is a second older than the next."""
    folder = new_folder(spark, "files")
    for i, (name, text) in enumerate(named.items()):
        files.write_file(spark, f"{folder}/{name}", text, 1_700_000_000 + i)
    return folder


_LAYERS = {"voice.md": "Plain words.\n", "outline.md": "# Outline\n\nCh 1: a bell", "other.md": "not a layer"}


def q_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(files.layers(spark, _put(spark, _LAYERS)))


_CHAPTERS = {"ch_01.md": "# One\n\nThe bell rang.\n", "ch_02.md": "", "ch_12.md": "twelfth", "ch_x.md": "no number", "notes.md": "notes"}


def q_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chapters of a folder, and single ones by number, one of them missing."""
    folder = _put(spark, _CHAPTERS)
    found = files.chapters(spark, folder).select(F.lit("all").alias("asked"), "chapter", "text")
    for n in (12, 3):
        found = found.union(files.chapter(spark, folder, n).select(F.lit("one"), F.lit(n), "text"))
    return comparable(found)


_CUT = {"quote": "a quote", "type": "FAT", "reason": "dull", "action": "CUT", "rewrite": None}
_CUT_FILES = {
    "ch03_cuts.json": json.dumps({"cuts": [_CUT, _CUT | {"quote": "other", "type": "TELL"}], "overall_fat_percentage": 20, "total_cuttable_words": 31}, indent=1),
    "ch04_cuts.json": json.dumps({"cuts": []}),
    "ch07_cuts.json": "{broken",
    "ch09_notes.json": json.dumps({"cuts": [_CUT]}),
}


def q_cut_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of cuts: a corrupt one keeps its row, others' missing fields are null."""
    found = files.cuts(spark, _put(spark, _CUT_FILES))
    quotes = F.array_join(F.transform("cuts", lambda c: F.concat(c["type"], F.lit("="), c["quote"])), "|")
    return comparable(found.select("chapter", quotes.alias("quotes"), F.coalesce("overall_fat_percentage", F.lit(-1)).alias("fat"), F.coalesce("total_cuttable_words", F.lit(-1)).alias("cuttable"), F.col("_corrupt_record").isNotNull().alias("corrupt")))


def q_cut_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(files.cut_chapters(spark, _put(spark, _CUT_FILES)))


_PANEL = {"timestamp": "20250101", "readers": {"editor": {"worst_scene": "Ch 4, the \"toast\".", "cut_candidate": ["Ch 1"], "rating": 7}, "reader": {"worst_scene": "", "best_scene": "Chapter 9"}, "silent": {}}}


def q_panel_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of maps as rows; answers that aren't strings are left out."""
    return comparable(files.panel(spark, _put(spark, {"panel.json": json.dumps(_PANEL)}) + "/panel.json"))


_EVALS = {
    "20250101_100000_ch03.json": json.dumps({"engagement": {"score": 6, "fix": "f"}, "overall_score": 6.5, "top_3_revisions": ["one", "two"]}),
    "20250102_100000_ch03.json": json.dumps({"continuity": {"score": "8", "weakest_moment": "w"}, "engagement": {"score": 7}, "overall_score": 7}),
    "20250103_100000_full.json": json.dumps({"novel_score": 7.25, "weakest_chapter": 3}),
}


def q_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.evaluations(spark, _put(spark, _EVALS) + "/*.json", ["engagement", "continuity"])
    scores = F.array_join(F.transform(F.array_sort(F.map_keys("dims")), lambda k: F.concat(k, F.lit("="), F.coalesce(F.try_element_at("dims", k)["score"], F.lit("")))), "|")
    return comparable(found.select("file_name", scores.alias("scores"), "overall_score", "novel_score", F.coalesce("weakest_chapter", F.lit(-1)).alias("weakest_chapter"), F.array_join("top_3_revisions", "|").alias("revisions")))


def q_saved_evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations saved under their times and kinds, and read again from the folder of all."""
    folder = new_folder(spark, "evals")
    for stamp, kind, score in _SAVED:
        one = local(spark, [(stamp, score)], "stamp string, overall_score double")
        files.save_eval(one, folder, F.col("stamp"), kind)
    read = spark.read.schema("stamp string, overall_score double").json(f"{folder}/*")
    name = F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1)
    return comparable(read.select(name.alias("name"), "stamp", "overall_score"))


_SAVED = [("20250101_100000", "ch03", 6.5), ("20250101_100000", "full", 7.0), ("20250102_100000", "ch03", 7.5)]


def q_saved_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defaults where nothing is saved, and a state saved twice."""
    path = new_folder(spark, "state")
    for phase, cycle in (("drafting", 1), ("revision", 3)):
        files.save_state(control.with_defaults(local(spark, [(phase, cycle)], "phase string, revision_cycle int")), path)
    both = files.state(spark, f"{path}-none").withColumn("saved", F.lit(False)).union(files.state(spark, path).withColumn("saved", F.lit(True)))
    return comparable(both.select("saved", "phase", "iteration", "novel_score", "revision_cycle", F.size("debts").alias("debts")))


def q_edited_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited documents written as a new version: those in which a cut was applied, whole."""
    texts, cuts = cut_inputs(spark, sf_dir)
    path = new_folder(spark, "edited")
    files.write_edited(edit.apply_cuts(texts, cuts, least_fat=10), path)
    return comparable(spark.read.parquet(path).select("doc_id", "applied", "new_text"))


_SEGMENTS = [{"speaker": f"S{i % 3}", "text": "word " * i} for i in range(13)]
_SCRIPTS = {"ch02_script.json": json.dumps({"chapter": 2, "title": "The Bridge", "segments": _SEGMENTS, "total_segments": 13}), "ch03_script.json": json.dumps({"chapter": 3, "title": "Short", "segments": _SEGMENTS[:2]}), "ch05_script.json": json.dumps({"chapter": 5, "title": "None", "segments": []})}


def q_script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts, and their first ten segments, which a test run speaks."""
    found = files.scripts(spark, _put(spark, _SCRIPTS)).withColumn("tested", chunk.first_segments(F.col("segments")))
    letters = F.aggregate("tested", F.lit(0), lambda a, x: a + F.length(x["text"]))
    return comparable(found.select("file_name", "chapter", "title", F.size("segments").alias("segments"), F.size("tested").alias("tested"), letters.alias("letters")))


def q_audio_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapters' audio, in order of names, without test runs and other files."""
    folder = _put(spark, {"ch_02.mp3": "bb", "ch_01.mp3": "a", "ch_01_test.mp3": "t", "intro.mp3": "i", "ch_03.wav": "w"})
    return comparable(files.audio_files(spark, folder))


_BRIEFS = {"ch05_panel.md": "panel", "ch05_cycle1_worst_scene.md": "newer", "ch07_panel.md": "other chapter", "ch05_a.md": "newest", "notes.txt": "x"}


def q_newest_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest brief of each of some chapters, by time of writing; none of a chapter without briefs."""
    folder = _put(spark, _BRIEFS)
    found = [files.newest(spark, f"{folder}/ch{n:02d}*.md").select(F.lit(n).alias("chapter"), "file_name", "text") for n in (5, 6, 7)]
    return comparable(found[0].union(found[1]).union(found[2]))


_CYCLES = [("a", 1, 6.0, 5.0, 900), ("a", 2, 6.1, 5.0, 910), ("a", 3, -1.0, 7.0, 920), ("a", 4, 7.25, 7.0, 930), ("a", 5, 9.0, 9.0, 940), ("b", 1, 0.1, 0.0, 10)] + [("c", n, float(n), 1.0, n) for n in range(1, 9)]
_REVISIONS = [("a", 1, 0, 5, "worst_scene", 6.0, 6.5, 100), ("a", 1, 1, 12, "cut_candidate", 7.0, 6.5, 90), ("a", 4, 0, 5, "momentum_loss", 6.5, 6.5, 101), ("a", 5, 0, 7, "worst_scene", 1.0, 9.0, 80), ("b", 1, 0, 1, "missing_scene", 3.5, -1.0, 70), ("c", 7, 0, 1, "worst_scene", 1.0, 2.0, 60)]
_CYCLE_NAMES, _REVISION_NAMES = ["run", "cycle", "novel", "overall", "words"], ["run", "cycle", "item", "chapter", "question", "pre", "post", "words"]


def q_revision_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What runs of revision cycles log until their plateaus or their last cycle."""
    cycles = local(spark, _CYCLES, "run string, cycle int, novel_score double, overall_score double, words int")
    revisions = local(spark, _REVISIONS, "run string, cycle int, item int, chapter int, question string, pre double, post double, words int")
    return comparable(control.revision_log(cycles, revisions).withColumn("item", F.coalesce("item", F.lit(-1))))


def q_arc_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of each conversation, whose turns are the blocks."""
    text = F.coalesce("text", F.lit(""))
    blocks = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("n"), t.word_count(text).alias("words"), text.alias("block"))
    return comparable(markup.arc_summary(blocks, F.concat(F.lit("Talk "), F.col("conv_id")), F.lit("Two speak."), ["conv_id"]))


#: num, title, words, location, characters, try-fail, emotional arc, summary, beats, plants, harvests, question
_ENTRIES = [
    (2, "Bridge", 1200, None, ["Anna"], "yes-but", "up", "They cross.", ["a", "b"], ["the cracked bell"], ["a letter"], "Who?"),
    (1, "Market", 900, "Low Town", ["Anna", "Ben"], None, "down", "They meet.", [], ["a letter", "Z " * 40], [], None),
    (3, "Calm", 100, "Sea", [], "no-and", None, None, ["c"], None, ["the cracked bell"], "None?"),
]
_ENTRY_NAMES = ["num", "title", "words", "location", "characters", "try_fail", "emotional_arc", "summary", "beats", "plants", "harvests", "chapter_question"]
_ENTRY_TYPES = ["int", "string", "int", "string", "array<string>", "string", "string", "string", "array<string>", "array<string>", "array<string>", "string"]


def q_outline_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = local(spark, _ENTRIES, ", ".join(f"{n} {k}" for n, k in zip(_ENTRY_NAMES, _ENTRY_TYPES)))
    return comparable(markup.outline_document(entries, F.lit("A Novel"), F.lit(5)))


def _rows(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM {values(rows, names.split())}"


LAYERS_SQL = _rows([(n, _LAYERS.get(f"{n}.md", "")) for n in files.LAYERS], "layer text")
CHAPTERS_SQL = "SELECT asked, chapter::BIGINT AS chapter, text FROM " + values([("all", 1, _CHAPTERS["ch_01.md"]), ("all", 2, ""), ("all", 12, "twelfth"), ("one", 12, "twelfth"), ("one", 3, "")], ["asked", "chapter", "text"])
CUT_FILES_SQL = "SELECT chapter::BIGINT AS chapter, quotes, fat::BIGINT AS fat, cuttable::BIGINT AS cuttable, corrupt FROM " + values([(3, "FAT=a quote|TELL=other", 20, 31, False), (4, "", -1, -1, False), (7, None, -1, -1, True)], ["chapter", "quotes", "fat", "cuttable", "corrupt"])
CUT_CHAPTERS_SQL = "SELECT chapter::BIGINT AS chapter FROM " + values([(3,), (4,), (7,)], ["chapter"])
PANEL_SQL = _rows([(r, q, a) for r, own in _PANEL["readers"].items() for q, a in own.items() if isinstance(a, str)], "reader question answer")
EVALS_SQL = "SELECT file_name, scores, overall_score::DOUBLE AS overall_score, novel_score::DOUBLE AS novel_score, weakest_chapter::BIGINT AS weakest_chapter, revisions FROM " + values(
    [("20250101_100000_ch03.json", "engagement=6", 6.5, None, -1, "one|two"), ("20250102_100000_ch03.json", "continuity=8|engagement=7", 7.0, None, -1, None), ("20250103_100000_full.json", "", None, 7.25, 3, None)],
    ["file_name", "scores", "overall_score", "novel_score", "weakest_chapter", "revisions"])
SAVED_EVALS_SQL = _rows([(f"{s}_{k}", s, v) for s, k, v in _SAVED], "name stamp overall_score")
STATE_SQL = "SELECT saved, phase, iteration::BIGINT AS iteration, novel_score, revision_cycle::BIGINT AS revision_cycle, debts::BIGINT AS debts FROM " + values([(False, "foundation", 0, 0.0, 0, 0), (True, "revision", 0, 0.0, 3, 0)], ["saved", "phase", "iteration", "novel_score", "revision_cycle", "debts"])
EDITED_SQL = f"SELECT doc_id, applied, new_text FROM ({APPLY_SQL}) WHERE applied > 0"
SCRIPTS_SQL = "SELECT file_name, chapter::BIGINT AS chapter, title, segments::BIGINT AS segments, tested::BIGINT AS tested, letters::BIGINT AS letters FROM " + values(
    [("ch02_script.json", 2, "The Bridge", 13, 10, 225), ("ch03_script.json", 3, "Short", 2, 2, 5), ("ch05_script.json", 5, "None", 0, 0, 0)], ["file_name", "chapter", "title", "segments", "tested", "letters"])
AUDIO_SQL = "SELECT file_name, length::BIGINT AS length FROM " + values([("ch_01.mp3", 1), ("ch_02.mp3", 2)], ["file_name", "length"])
NEWEST_SQL = "SELECT chapter::BIGINT AS chapter, file_name, text FROM " + values([(5, "ch05_a.md", "newest"), (7, "ch07_panel.md", "other chapter")], ["chapter", "file_name", "text"])

REVISIONS_SQL = f"""
WITH s AS (SELECT *, CASE WHEN novel < 0 THEN overall ELSE novel END AS score FROM {values(_CYCLES, _CYCLE_NAMES)} WHERE cycle <= 6),
p AS (SELECT *, coalesce(lag(score) OVER (PARTITION BY run ORDER BY cycle), 0::DOUBLE) AS before FROM s),
q AS (SELECT *, min(CASE WHEN cycle >= 3 AND abs(score - before) < 0.3 THEN cycle END) OVER (PARTITION BY run) AS last FROM p),
r AS (SELECT * FROM q WHERE last IS NULL OR cycle <= last),
v AS (SELECT x.* FROM {values(_REVISIONS, _REVISION_NAMES).replace("AS probe", "AS x")} SEMI JOIN r ON r.run = x.run AND r.cycle = x.cycle)
SELECT run, cycle::BIGINT AS cycle, -1::BIGINT AS item, 'revision-cycle-' || cycle AS phase, score, words::BIGINT AS word_count, 'cycle' AS status, 'Cycle ' || cycle || ': novel_score ' || before || '->' || score AS description FROM r
UNION ALL
SELECT run, cycle, item, 'rev-ch' || lpad(chapter::VARCHAR, 2, '0'), post, words, CASE WHEN post >= pre THEN 'keep' ELSE 'discard' END, 'Cycle ' || cycle || ': ' || question || CASE WHEN post >= pre THEN ' improved ' ELSE ' regressed ' END || pre || '->' || post FROM v
"""

ARC_SQL = rf"""
WITH b AS (SELECT conv_id, turn, coalesce(text, '') AS block, len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+')) AS words FROM conversations),
g AS (SELECT conv_id, count(*) AS chapters, sum(words)::BIGINT AS words, string_agg(block, chr(10) || '---' || chr(10) || chr(10) ORDER BY turn, words, block) AS body FROM b GROUP BY 1)
SELECT conv_id, chapters, words, '# Talk ' || conv_id || chr(10) || '## Full-Arc Summary for Reader Panel' || chr(10) || chr(10) || 'This document contains chapter summaries, opening/closing passages,' || chr(10) || 'and key dialogue for all ' || chapters || ' chapters. Total novel: ' || format('{{:,}}', words) || ' words.'
  || chr(10) || chr(10) || 'PREMISE: Two speak.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || body AS text FROM g
"""

_BARRED = [tuple("|".join(x) if isinstance(x, list) else x for x in e) for e in _ENTRIES]
OUTLINE_SQL = f"""
WITH e AS (SELECT * FROM {values(_BARRED, _ENTRY_NAMES)}),
k AS (SELECT num, words, '### Ch ' || num || ': ' || title || chr(10) || '**' || words || ' words** | **Location:** ' || coalesce(location, 'N/A') || chr(10) || '- **Characters:** ' || replace(characters, '|', ', ') || chr(10) || '- **Try-fail cycle:** ' || coalesce(try_fail, 'N/A') || chr(10)
  || '- **Emotional arc:** ' || coalesce(emotional_arc, 'N/A') || chr(10) || chr(10) || '**Summary:** ' || coalesce(summary, 'N/A') || chr(10) || chr(10) || '**Beats:**' || chr(10) || CASE WHEN beats = '' THEN '' ELSE '1. ' || replace(beats, '|', chr(10) || '1. ') || chr(10) END || chr(10)
  || CASE WHEN coalesce(plants, '') = '' THEN '' ELSE '**Plants:**' || chr(10) || '- ' || replace(plants, '|', chr(10) || '- ') || chr(10) || chr(10) END || CASE WHEN coalesce(harvests, '') = '' THEN '' ELSE '**Harvests:**' || chr(10) || '- ' || replace(harvests, '|', chr(10) || '- ') || chr(10) || chr(10) END
  || '**Chapter question:** ' || coalesce(chapter_question, 'N/A') || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS block FROM e),
i AS (SELECT num, 'p' AS side, left(unnest(string_split(nullif(plants, ''), '|')), 60) AS thread FROM e UNION ALL SELECT num, 'h', left(unnest(string_split(nullif(harvests, ''), '|')), 60) FROM e),
l AS (SELECT thread, '| ' || thread || ' | ' || coalesce(string_agg(CASE WHEN side = 'p' THEN 'Ch ' || num END, ', ' ORDER BY num), '') || ' | ' || coalesce(string_agg(CASE WHEN side = 'h' THEN 'Ch ' || num END, ', ' ORDER BY num), '') || ' |' || chr(10) AS line FROM i GROUP BY 1)
SELECT '# A Novel' || chr(10) || '## Chapter Outline (reflects actual novel as-written)' || chr(10) || chr(10) || '**' || (SELECT count(*) FROM k) || ' chapters, ' || (SELECT format('{{:,}}', sum(words)::BIGINT) FROM k) || ' words**' || chr(10) || chr(10) || '---' || chr(10) || chr(10)
  || (SELECT string_agg(block, '' ORDER BY num) FROM k) || '## FORESHADOWING LEDGER' || chr(10) || chr(10) || '| Thread | Planted | Harvested |' || chr(10) || '|--------|---------|-----------|' || chr(10)
  || (SELECT string_agg(line, '' ORDER BY thread) FROM l) || chr(10) || '---' || chr(10) || chr(10) || '*Outline rebuilt from actual chapters, Cycle 5.*' AS text
"""

QUERIES = {
    "q_layers": (q_layers, LAYERS_SQL),
    "q_chapters": (q_chapters, CHAPTERS_SQL),
    "q_cut_files": (q_cut_files, CUT_FILES_SQL),
    "q_cut_chapters": (q_cut_chapters, CUT_CHAPTERS_SQL),
    "q_panel_file": (q_panel_file, PANEL_SQL),
    "q_evaluations": (q_evaluations, EVALS_SQL),
    "q_saved_evals": (q_saved_evals, SAVED_EVALS_SQL),
    "q_saved_state": (q_saved_state, STATE_SQL),
    "q_edited_version": (q_edited_version, EDITED_SQL),
    "q_script_files": (q_script_files, SCRIPTS_SQL),
    "q_audio_files": (q_audio_files, AUDIO_SQL),
    "q_newest_brief": (q_newest_brief, NEWEST_SQL),
    "q_revision_cycles": (q_revision_cycles, REVISIONS_SQL),
    "q_arc_document": (q_arc_document, ARC_SQL),
    "q_outline_document": (q_outline_document, OUTLINE_SQL),
}
