"""Revision briefs: typed rows that say what is wrong, what stays and what changes, and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosaic.functions import lexicons as L
from prosaic.functions import text as t
from prosaic.operators import edit, feedback

# Dimensions read from evaluations, and how much of a chapter each kind of brief leaves.
CHAPTER_DIMS = ["voice_adherence", "beat_coverage", "character_voice", "plants_seeded", "prose_quality", "continuity", "canon_compliance", "lore_integration", "engagement"]
AUTO_DIMS = ["voice_adherence", "beat_coverage", "character_voice", "plants_seeded", "prose_quality", "engagement"]
NOVEL_DIMS = ["arc_completion", "pacing_curve", "theme_coherence", "foreshadowing_resolution", "world_consistency", "voice_consistency", "overall_engagement"]
CUT_ORDER = ["REDUNDANT", "OVER-EXPLAIN", "FAT", "TELL", "GENERIC", "OTHER"]
SHARES = {"COMPRESS": 0.55, "TIGHTEN": 0.85}
WEAK_SCORE = 7


def _list(items: list[Column]) -> Column:
    """An array of the items that aren't null."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _each(values: Column, wrap) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), wrap)


def fix_phrase(comment: Column, n: int = 300) -> Column:
    """What follows 'Fix:' or 'The fix is ...:', else the comment without its reader; at most n characters and an ellipsis."""
    found = t.strip(F.regexp_extract(comment, rf"(?isU)(?:The fix(?:[{t.SPACE}]+is[{t.SPACE}]*\w*)?|Fix)[{t.SPACE}]*[:—][{t.SPACE}]*(.+)", 1))
    plain = F.when(comment.contains("]"), t.strip(F.regexp_replace(comment, r"(?s)^[^\]]*\]", ""))).otherwise(comment)
    return F.when(found != "", F.rtrim(t.truncate(found, n), F.lit("."))).otherwise(t.truncate(plain, n))


def panel_type(cut: Column, worst: Column, momentum: Column) -> Column:
    """The kind of brief by what readers name a chapter for; the first that anyone names wins."""
    return F.when(F.size(cut) > 0, "COMPRESS").when(F.size(worst) > 0, "DRAMATIZE").when(F.size(momentum) > 0, "TIGHTEN").otherwise("REVISE")


def target_words(kind: Column, words: Column) -> Column:
    share = F.when(kind == "COMPRESS", SHARES["COMPRESS"]).when(kind == "TIGHTEN", SHARES["TIGHTEN"]).otherwise(1.0)
    return (words * share).cast("int")


def panel_brief(chapters: DataFrame, panel: DataFrame) -> DataFrame:
    """chapter, title, words, brief_type, target_words, problems, keeps, changes for each chapter (chapter, text, tightest, strongest)."""
    named = feedback.panel_mentions(panel, chapters.select("chapter")).groupBy("chapter").agg(F.map_from_entries(F.collect_list(F.struct("question", "comments"))).alias("m"))
    flags = feedback.flagged_lines(panel).groupBy("chapter").agg(F.transform(F.array_sort(F.collect_list(F.struct("question", "line"))), lambda x: x["line"]).alias("flags"))
    none = F.array().cast("array<string>")
    base = chapters.join(named, "chapter", "left").join(flags, "chapter", "left").withColumn("flags", F.coalesce("flags", none))
    m = lambda q: F.coalesce(F.try_element_at(F.coalesce("m", F.create_map().cast("map<string,array<string>>")), F.lit(q)), none)
    text = t.blank_if_null(F.col("text"))
    base = base.select("chapter", t.chapter_title(text).alias("title"), t.word_count(text).alias("words"), "tightest", "strongest", "flags", *[m(q).alias(q) for q in feedback.BRIEFED])
    kind = panel_type(F.col("cut_candidate"), F.col("worst_scene"), F.col("momentum_loss"))
    long = lambda c: t.truncate(c, 500)
    problems = F.concat(F.transform("flags", lambda f: F.concat(F.lit("- "), f)), *[F.transform(q, long) for q in ("momentum_loss", "worst_scene", "cut_candidate")])
    quote = F.when(F.coalesce("tightest", F.lit("")) != "", F.concat(F.lit('Tightest passage (from adversarial edit): "'), "tightest", F.lit('"')))
    keeps = F.concat(F.transform("best_scene", long), _list([quote]), _each(F.col("strongest"), lambda s: F.concat(F.lit('- "'), s, F.lit('"'))))
    has = lambda q, what: F.when(F.size(q) > 0, what)
    changes = _list(
        [
            has("momentum_loss", F.lit("Pacing: tighten or restructure the scenes that drag")),
            has("worst_scene", F.concat(F.lit("Dramatize: "), fix_phrase(F.get("worst_scene", F.lit(0))))),
            has("cut_candidate", F.lit("Compress: fold essential beats into fewer words")),
            has("thinnest_character", F.lit("Deepen character: interiority, physical specificity or a complicating moment")),
            has("missing_scene", F.lit("Add missing beat near this chapter")),
        ]
    )
    more = F.transform("missing_scene", lambda s: t.truncate(s, 300))
    out = base.withColumn("brief_type", kind)
    return out.select("chapter", "title", "words", "brief_type", target_words(F.col("brief_type"), F.col("words")).alias("target_words"), problems.alias("problems"), keeps.alias("keeps"), F.concat(changes, more).alias("changes"))


def weak_dimensions(dims: Column, names: list[str], need: str) -> Column:
    """array<struct<dim, score, weakest_moment, fix>> of a map's dimensions, in the order given, that score at most WEAK_SCORE and have what is needed."""
    each = [F.struct(F.lit(n).alias("dim"), *[F.try_element_at(dims, F.lit(n))[f].alias(f) for f in ("score", "weakest_moment", "fix")]) for n in names]
    return F.filter(F.array(*each), lambda d: F.coalesce((d["score"].try_cast("double").cast("int") <= WEAK_SCORE) & (F.coalesce(d[need], F.lit("")) != ""), F.lit(False)))


def eval_type(overall: Column, evaluated: Column) -> Column:
    return F.when(~evaluated, "FIX").when(F.coalesce(overall, F.lit(10.0)) <= 5, "REWRITE").when(F.coalesce(overall, F.lit(10.0)) <= 7, "FIX").otherwise("POLISH")


def eval_brief(chapters: DataFrame, evals: DataFrame, novel: DataFrame, least_evaluated: bool = True) -> DataFrame:
    """The same row from a chapter's evaluation (chapter, dims, overall_score, top_3_revisions, ai_patterns_detected, three_*_sentences) and the novel's.

    novel is one row: weakest_chapter, top_suggestion, novel_score, pacing_note.
    Chapters without any evaluation have no brief, unless least_evaluated is off.
    """
    joined = chapters.join(evals.withColumn("_has", F.lit(True)), "chapter", "left").crossJoin(F.broadcast(novel.limit(1)))
    text, has = t.blank_if_null(F.col("text")), F.coalesce("_has", F.lit(False))
    weak = weak_dimensions(F.col("dims"), CHAPTER_DIMS, "weakest_moment")
    own = F.coalesce(F.col("weakest_chapter") == F.col("chapter"), F.lit(False))
    problems = F.concat(
        _list([F.when(own, F.lit("This is the novel's weakest chapter"))]),
        F.transform(F.coalesce(weak, F.array()), lambda d: F.concat(d["dim"], F.lit(" ("), d["score"], F.lit("/10): "), d["weakest_moment"])),
        _each(F.col("ai_patterns_detected"), lambda x: F.concat(F.lit("- "), x)), _each(F.col("three_weakest_sentences"), lambda x: F.concat(F.lit('- "'), x, F.lit('"'))),
        _list([F.when(feedback.mentions_chapter(F.coalesce("pacing_note", F.lit("")), F.col("chapter")), F.concat(F.lit("Pacing note: "), "pacing_note"))]),
    )
    fixes = F.filter(F.coalesce(weak, F.array()), lambda d: F.coalesce(d["fix"], F.lit("")) != "")
    changes = F.concat(F.transform(fixes, lambda d: F.concat(F.lit("["), d["dim"], F.lit("] "), d["fix"])), _each(F.col("top_3_revisions"), lambda x: x), _list([F.when((F.coalesce("top_suggestion", F.lit("")) != "") & (own | ~has), F.concat(F.lit("[full eval top suggestion] "), "top_suggestion"))]))
    keeps = F.concat(_each(F.col("three_strongest_sentences"), lambda x: F.concat(F.lit('- "'), x, F.lit('"'))), _list([F.when(F.coalesce("tightest", F.lit("")) != "", F.concat(F.lit('Tightest passage (adversarial edit): "'), "tightest", F.lit('"')))]))
    out = joined if least_evaluated else joined.filter(has)
    return out.select("chapter", t.chapter_title(text).alias("title"), t.word_count(text).alias("words"), eval_type(F.col("overall_score"), has).alias("brief_type"), t.word_count(text).alias("target_words"), problems.alias("problems"), keeps.alias("keeps"), changes.alias("changes"))


def cuts_brief(chapters: DataFrame, cuts: DataFrame) -> DataFrame:
    """The same row from a chapter's cuts (chapter, cuts, total_cuttable_words, loosest_passage, overall_fat_percentage, one_sentence_verdict), with dominant."""
    counts = edit.type_counts(cuts, "chapter").groupBy("chapter").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "first_place", "type", "n"))), lambda x: F.struct(x["type"], x["n"])).alias("counts"))
    joined = chapters.join(cuts, "chapter").join(counts, "chapter", "left")
    text = t.blank_if_null(F.col("text"))
    first = F.get("counts", F.lit(0))
    dominant = F.coalesce(first["type"], F.lit("MIXED"))
    problems = F.concat(
        _list([F.concat(F.lit("Adversarial edit found "), F.coalesce("total_cuttable_words", F.lit(0)), F.lit(" cuttable words ("), F.coalesce("overall_fat_percentage", F.lit(0)), F.lit("% fat) across "), F.coalesce(F.size("cuts"), F.lit(0)), F.lit(" passages")), F.when(F.coalesce("one_sentence_verdict", F.lit("")) != "", F.concat(F.lit("Verdict: "), "one_sentence_verdict")), F.concat(F.lit("Dominant cut pattern: "), dominant, F.lit(" ("), F.coalesce(first["n"], F.lit(0)), F.lit(" instances)"))]),
        F.transform(F.coalesce(F.slice("counts", 2, 100), F.array()), lambda c: F.concat(F.lit("- "), c["type"], F.lit(": "), c["n"], F.lit(" instances"))),
        _list([F.when(F.coalesce("loosest_passage", F.lit("")) != "", F.concat(F.lit("Loosest passage: "), "loosest_passage"))]),
    )
    # by type in a fixed order; types outside it, structural ones among them, ask for no change
    ordered = F.flatten(F.array(*[_of_type(k) for k in CUT_ORDER]))
    act = lambda c: F.when((F.coalesce(c["action"], F.lit("CUT")) == "REWRITE") & (F.coalesce(c["rewrite"], F.lit("")) != ""), F.concat(F.lit(" → Rewrite as: "), c["rewrite"])).when(F.coalesce(c["action"], F.lit("CUT")) == "CUT", " → Cut entirely").otherwise("")
    changes = F.transform(ordered, lambda c: F.concat(F.lit('"'), t.truncate(t.blank_if_null(c["quote"]), 200), F.lit('" '), t.blank_if_null(c["reason"]), act(c)))
    keeps = F.concat(_list([F.when(F.coalesce("tightest", F.lit("")) != "", F.concat(F.lit("Tightest passage: "), "tightest"))]), _each(F.col("strongest"), lambda s: F.concat(F.lit('- "'), s, F.lit('"'))))
    words = t.word_count(text)
    return joined.select("chapter", t.chapter_title(text).alias("title"), words.alias("words"), F.lit("TIGHTEN").alias("brief_type"), (words - F.coalesce("total_cuttable_words", F.lit(0))).alias("target_words"), problems.alias("problems"), keeps.alias("keeps"), changes.alias("changes"), dominant.alias("dominant"))


def _of_type(kind: str) -> Column:
    return F.filter("cuts", lambda c: F.coalesce(c["type"], F.lit("OTHER")) == kind)


def auto_brief(chapters: DataFrame, evals: DataFrame, novel: DataFrame, panel: DataFrame, cuts: DataFrame) -> DataFrame:
    """The same row for the novel's weakest chapter, from all sources: notes that name it, its evaluation, its panel comments and priority cuts.

    novel: weakest_chapter, weakest_dimension, top_suggestion, novel_score, notes (map of dimension to note).
    """
    weakest = chapters.join(F.broadcast(novel.limit(1)), F.col("chapter") == F.col("weakest_chapter"))
    flags = feedback.flagged_lines(panel).groupBy("chapter").agg(F.array_sort(F.collect_list("line")).alias("flags"))
    said = feedback.panel_mentions(panel, weakest.select("chapter")).groupBy("chapter").agg(F.map_from_entries(F.collect_list(F.struct("question", "comments"))).alias("said"))
    first = edit.priority_cuts(cuts, "chapter").withColumnRenamed("cuts", "first_cuts")
    facts = cuts.select("chapter", "total_cuttable_words", "overall_fat_percentage", "one_sentence_verdict")
    joined = weakest.join(evals, "chapter", "left").join(flags, "chapter", "left").join(said, "chapter", "left").join(first, "chapter", "left").join(facts, "chapter", "left")
    text, none = t.blank_if_null(F.col("text")), F.array().cast("array<string>")
    told = lambda q, wrap=lambda c: c: F.transform(F.coalesce(F.try_element_at(F.coalesce("said", F.create_map().cast("map<string,array<string>>")), F.lit(q)), none), lambda c: wrap(t.truncate(c, 400)))
    notes = F.filter(F.array(*[F.struct(F.lit(d).alias("dim"), F.try_element_at("notes", F.lit(d)).alias("note")) for d in NOVEL_DIMS]), lambda x: F.coalesce(feedback.mentions_chapter(x["note"], F.col("chapter"), plural=True), F.lit(False)))
    fixes = F.coalesce(weak_dimensions(F.col("dims"), AUTO_DIMS, "fix"), F.array())
    suggestion = lambda head: _list([F.when(F.coalesce("top_suggestion", F.lit("")) != "", F.concat(F.lit(head), "top_suggestion"))])
    quoted = lambda x: F.concat(F.lit('- "'), x, F.lit('"'))
    problems = F.concat(
        _list([F.concat(F.lit("Weakest chapter in the novel (weakest dimension: "), F.coalesce("weakest_dimension", F.lit("")), F.lit(")"))]), suggestion("Top suggestion: "),
        F.transform(notes, lambda x: F.concat(x["dim"], F.lit(": "), x["note"])), _list([F.concat(F.lit("Chapter score: "), F.col("overall_score").cast("string"))]),
        _each(F.col("ai_patterns_detected"), lambda x: F.concat(F.lit("- "), x)), _each(F.col("three_weakest_sentences"), quoted), _each(F.col("flags"), lambda x: F.concat(F.lit("- "), x)),
        *[told(q) for q in ("worst_scene", "momentum_loss", "cut_candidate")],
        _list([F.when(F.coalesce("total_cuttable_words", F.lit(0)) > 0, F.concat(F.lit("Adversarial edit: "), "total_cuttable_words", F.lit(" cuttable words ("), F.coalesce("overall_fat_percentage", F.lit(0)), F.lit("% fat). "), F.coalesce("one_sentence_verdict", F.lit(""))))]),
    )
    entries = F.coalesce("first_cuts", F.array().cast(first.schema["first_cuts"].dataType))
    changes = F.concat(F.transform(fixes, lambda d: F.concat(F.lit("["), d["dim"], F.lit("] "), d["fix"])), _each(F.col("top_3_revisions"), lambda x: x), F.transform(entries, _cut_line), suggestion("[PRIORITY — full eval] "))
    keeps = F.concat(_each(F.col("three_strongest_sentences"), quoted), told("best_scene", lambda c: F.concat(F.lit("Panel best scene mention: "), c)), _list([F.when(F.coalesce("tightest", F.lit("")) != "", F.concat(F.lit("Tightest passage (adversarial edit): "), "tightest"))]))
    return joined.select("chapter", t.chapter_title(text).alias("title"), t.word_count(text).alias("words"), F.lit("AUTO-FIX").alias("brief_type"), t.word_count(text).alias("target_words"), problems.alias("problems"), keeps.alias("keeps"), changes.alias("changes"))


def _cut_line(c: Column) -> Column:
    action = F.coalesce(c["action"], F.lit("CUT"))
    then = F.when((action == "REWRITE") & (F.coalesce(c["rewrite"], F.lit("")) != ""), F.concat(F.lit(" → Rewrite as: "), c["rewrite"])).when(action == "CUT", " → Cut entirely").otherwise("")
    return F.concat(F.lit('"'), F.substring(t.blank_if_null(c["quote"]), 1, 150), F.lit('..." — '), t.blank_if_null(c["reason"]), then)


def render(brief: DataFrame) -> DataFrame:
    """chapter, markdown."""
    block = lambda name, c: F.concat(F.lit(f"## {name}\n"), F.array_join(c, "\n"), F.lit("\n\n"))
    rules = F.array(*[F.lit(f"- {r}") for r in L.VOICE_RULES])
    numbered = F.transform("changes", lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c))
    head = F.concat(F.lit("# Revision Brief: Chapter "), "chapter", F.lit(" — "), "title", F.lit(" ("), "brief_type", F.lit(")\n\n"))
    return brief.select("chapter", F.concat(head, block("PROBLEM", "problems"), block("WHAT TO KEEP", "keeps"), block("WHAT TO CHANGE", numbered), block("VOICE RULES", rules), F.lit("## TARGET\n~"), "target_words", F.lit(" words\n")).alias("markdown"))
