"""What several readers say about chapters: mentions, disagreements, consensus, and a ledger of threads.

Answers are long rows: reader, question, answer. Chapter numbers in them are
found by 'Ch 5' or 'Chapter 5', letters in either case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosaic.functions import text as t

# The questions that each reading of the panel looks at.
DISPUTED = ["momentum_loss", "cut_candidate", "thinnest_character", "worst_scene"]
SCANNED = ["momentum_loss", "cut_candidate", "worst_scene", "thinnest_character", "missing_scene"]
BRIEFED = ["momentum_loss", "worst_scene", "cut_candidate", "best_scene", "thinnest_character", "missing_scene", "earned_ending"]


def chapters_in(answer: Column) -> Column:
    """All chapter numbers in order, with repeats."""
    found = F.regexp_extract_all(answer, F.lit(rf"(?iu)Ch(?:apter)?[{t.SPACE}]*([0-9]+)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def mentions_chapter(answer: Column, chapter: Column, plural: bool = False) -> Column:
    """Whether an answer names this chapter as a word of its own."""
    head = "Chapters?" if plural else "Chapter"
    return F.rlike(answer, F.concat(F.lit(rf"(?iuU)\b(?:{head}|Ch\.?)[{t.SPACE}]*"), chapter.cast("string"), F.lit(r"\b")))


def mentions(panel: DataFrame, questions: list[str] = SCANNED) -> DataFrame:
    """chapter, question, count (with repeats), readers (distinct), flagged_by (a name for each mention, in order of reader and place)."""
    rows = panel.filter(F.col("question").isin(questions)).select("reader", "question", F.posexplode(chapters_in(t.blank_if_null(F.col("answer")))).alias("place", "chapter"))
    grouped = rows.groupBy("chapter", "question").agg(F.count("*").alias("count"), F.count_distinct("reader").alias("readers"), F.array_sort(F.collect_list(F.struct("reader", "place"))).alias("_who"))
    return grouped.select("chapter", "question", "count", "readers", F.transform("_who", lambda w: w["reader"]).alias("flagged_by"))


def disagreements(panel: DataFrame, questions: list[str] = DISPUTED, detail: int = 200) -> DataFrame:
    """question, chapter, flagged_by, not_flagged, details: chapters that some, but not all, readers name under a question."""
    asked = panel.filter(F.col("question").isin(questions)).select("reader", "question", t.blank_if_null(F.col("answer")).alias("answer"))
    named = asked.select("reader", "question", "answer", F.explode(F.array_distinct(chapters_in(F.col("answer")))).alias("chapter"))
    all_ = panel.agg(F.array_sort(F.collect_set("reader")).alias("_all"))  # the panel's readers: a handful
    flagged = named.groupBy("question", "chapter").agg(F.array_sort(F.collect_set("reader")).alias("flagged_by"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("reader", F.substring("answer", 1, detail))))).alias("details"))
    split = flagged.crossJoin(F.broadcast(all_)).withColumn("not_flagged", F.array_except("_all", "flagged_by"))
    return split.filter(F.size("not_flagged") > 0).select("question", "chapter", "flagged_by", "not_flagged", "details")


def consensus(panel: DataFrame, top: int = 5) -> DataFrame:
    """chapter, question, count, source: each chapter's most named issue, the `top` most named chapters.

    Disagreements come first; mentions of a (chapter, question) that is already one
    of them are left out. Equal counts keep that order, then that of the questions
    and chapters.
    """
    order = F.create_map(*[x for i, q in enumerate(dict.fromkeys([*DISPUTED, *SCANNED])) for x in (F.lit(q), F.lit(i))])
    split = disagreements(panel).select("chapter", "question", F.size("flagged_by").cast("bigint").alias("count"), F.lit("disagreement").alias("source"))
    rest = mentions(panel).select("chapter", "question", "count", F.lit("mention").alias("source")).join(split.select("chapter", "question"), ["chapter", "question"], "left_anti")
    both = split.unionByName(rest).filter(F.col("chapter") > 0).withColumn("_q", F.element_at(order, F.col("question")))
    rank = [F.desc("count"), F.asc("source"), F.asc("_q"), F.asc("chapter")]
    first = both.withColumn("_n", F.row_number().over(Window.partitionBy("chapter").orderBy(*rank))).filter("_n = 1")
    return first.orderBy(*rank).limit(top).select("chapter", "question", "count", "source")


def panel_mentions(panel: DataFrame, chapters: DataFrame) -> DataFrame:
    """chapter, question, comments for each of BRIEFED that names one of the chapters (column chapter; a bounded list).

    Comments are '[reader] answer', by reader.
    """
    asked = panel.filter(F.col("question").isin(BRIEFED)).withColumn("answer", t.blank_if_null(F.col("answer")))
    # equi-join on the numbers an answer holds, then the exact test
    numbers = asked.withColumn("chapter", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit("([0-9]+)"), F.lit(1)), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1))))))
    hits = numbers.join(chapters.select("chapter").distinct(), "chapter").filter(mentions_chapter(F.col("answer"), F.col("chapter")))
    comment = F.concat(F.lit("["), "reader", F.lit("] "), "answer")
    return hits.groupBy("chapter", "question").agg(F.array_sort(F.collect_list(comment)).alias("comments"))


def flagged_lines(panel: DataFrame) -> DataFrame:
    """chapter, line: how many readers flagged it under each question, of how many."""
    n = F.size("flagged_by")
    return disagreements(panel).select("chapter", "question", F.concat("question", F.lit(": flagged by "), n, F.lit("/"), n + F.size("not_flagged"), F.lit(" readers ("), F.array_join("flagged_by", ", "), F.lit(")")).alias("line"))


def threads(entries: DataFrame, side: str, width: int = 60) -> DataFrame:
    """thread (the item's first `width` characters), chapters in order of a list column of outline entries (num, side)."""
    rows = entries.select("num", F.posexplode(side).alias("place", "item")).withColumn("thread", F.substring("item", 1, width))
    return rows.groupBy("thread").agg(F.transform(F.array_sort(F.collect_list(F.struct("num", "place"))), lambda x: x["num"]).alias(side))


def ledger(entries: DataFrame) -> DataFrame:
    """thread, planted, harvested: outline entries' plants and harvests matched by thread; an empty list where one side lacks it."""
    none = F.array().cast("array<int>")
    both = threads(entries, "plants").join(threads(entries, "harvests"), "thread", "full_outer")
    return both.select("thread", F.coalesce(F.col("plants").cast("array<int>"), none).alias("planted"), F.coalesce(F.col("harvests").cast("array<int>"), none).alias("harvested"))


def neighbours(rows: DataFrame, n_col: str, text_col: str, keys: list[str] | None = None, tail: int = 3000, head: int = 1500) -> DataFrame:
    """rows with prev_tail and next_head: the end of the text before and the beginning of the one after.

    Neighbours are n-1 and n+1 exactly: a gap gives null, unlike the row before.
    """
    keys = keys or []
    text = t.blank_if_null(F.col(text_col))
    before = rows.select(*keys, (F.col(n_col) + 1).alias(n_col), F.right(text, F.lit(tail)).alias("prev_tail"))
    after = rows.select(*keys, (F.col(n_col) - 1).alias(n_col), F.substring(text, 1, head).alias("next_head"))
    return rows.join(before, [*keys, n_col], "left").join(after, [*keys, n_col], "left")
