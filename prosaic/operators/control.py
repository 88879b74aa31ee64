"""Histories of runs: what was kept, when to stop, where to resume.

The loops themselves call models; here their decisions are read off tables of
scores, one row per step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds and limits of the phases, and the state a run starts with.
FOUNDATION_PASS, FOUNDATION_STEPS = 7.5, 20
CHAPTER_PASS, CHAPTER_ATTEMPTS, CHAPTER_BYTES = 6.0, 5, 100
LEAST_CYCLES, MOST_CYCLES, PLATEAU = 3, 6, 0.3
REVIEW_ROUNDS = 4
PHASES = ["foundation", "drafting", "revision", "export"]
DEFAULT_STATE = {
    "phase": "foundation", "current_focus": "planning", "iteration": 0, "foundation_score": 0.0, "lore_score": 0.0,
    "chapters_drafted": 0, "chapters_total": 0, "novel_score": 0.0, "revision_cycle": 0,
}


def _order(key: str, step: str) -> Window:
    return Window.partitionBy(key).orderBy(step)


def best_so_far(history: DataFrame, key: str, step: str, score: str = "score", start: Column | float = 0.0) -> DataFrame:
    """history with best_before (the largest score of earlier steps, or the start's) and kept (a strict improvement)."""
    begin = start if isinstance(start, Column) else F.lit(start)
    earlier = F.max(score).over(_order(key, step).rowsBetween(Window.unboundedPreceding, -1))
    out = history.withColumn("best_before", F.greatest(F.coalesce(earlier, begin), begin))
    return out.withColumn("kept", F.coalesce(F.col(score) > F.col("best_before"), F.lit(False)))


def foundation(history: DataFrame, key: str = "run", step: str = "iteration", passing: float = FOUNDATION_PASS, most: int = FOUNDATION_STEPS, lore: float | None = None) -> DataFrame:
    """The iterations that a run makes: kept or not, until the best score passes or the limit is reached.

    With `lore`, passing also needs a lore_score of more than that in a kept step.
    """
    steps = best_so_far(history.filter(F.col(step) <= most), key, step)
    best = F.greatest("best_before", "score")
    ok = best >= passing if lore is None else (best >= passing) & (F.max(F.when(F.col("kept"), F.col("lore_score"))).over(_order(key, step)) > lore)
    steps = steps.withColumn("passed", F.coalesce(ok, F.lit(False)))
    done = F.coalesce(F.max(F.col("passed").cast("int")).over(_order(key, step).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return steps.withColumn("_done", done).filter("_done = 0").drop("_done")


def drafting(attempts: DataFrame, key: str = "chapter", passing: float = CHAPTER_PASS, most: int = CHAPTER_ATTEMPTS) -> DataFrame:
    """key, attempt, score, word_count, status for each chapter: the first passing attempt is kept, else the last one is forced.

    attempts: key, attempt, ok (drafted without error), bytes, score, word_count.
    Attempts that failed or are too short don't count as drafts, but use up one.
    """
    usable = F.coalesce(F.col("ok") & (F.col("bytes") >= CHAPTER_BYTES), F.lit(False))
    rows = attempts.filter(F.col("attempt") <= most).withColumn("_pass", usable & F.coalesce(F.col("score") >= passing, F.lit(False)))
    kept = F.min_by(F.struct("attempt", "score", "word_count"), F.when(F.col("_pass"), F.col("attempt")))
    last = F.max_by(F.struct("attempt", "score", "word_count"), F.when(usable | (F.coalesce("bytes", F.lit(0)) > 0), F.col("attempt")))
    grouped = rows.groupBy(key).agg(F.max("_pass").alias("_any"), kept.alias("_kept"), last.alias("_last"))
    chosen = F.when(F.col("_any"), F.col("_kept")).otherwise(F.col("_last"))
    return grouped.select(key, chosen["attempt"].alias("attempt"), F.when(F.col("_any"), chosen["score"].cast("string")).otherwise("?").alias("score"), chosen["word_count"].alias("word_count"), F.when(F.col("_any"), "keep").when(F.col("_last").isNotNull(), "forced").otherwise("missing").alias("status"))


def acceptance(revisions: DataFrame) -> DataFrame:
    """revisions (pre, post) with accepted: a revision stays unless it made the score worse."""
    return revisions.withColumn("accepted", F.coalesce(F.col("post") >= F.col("pre"), F.lit(False)))


def plateau(history: DataFrame, key: str = "run", step: str = "cycle", score: str = "score", start: Column | float = 0.0, least: int = LEAST_CYCLES, delta: float = PLATEAU) -> DataFrame:
    """history with change (from the cycle before, the first from the start), stop and ran (cycles up to the first stop)."""
    begin = start if isinstance(start, Column) else F.lit(start)
    w = _order(key, step)
    out = history.withColumn("change", F.abs(F.col(score) - F.coalesce(F.lag(score).over(w), begin)))
    out = out.withColumn("stop", (F.col(step) >= least) & (F.col("change") < delta))
    return out.withColumn("ran", F.coalesce(F.max(F.col("stop").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 0)


def revision_log(cycles: DataFrame, revisions: DataFrame, run: str = "run", start: Column | float = 0.0, most: int = MOST_CYCLES) -> DataFrame:
    """run, cycle, item, phase, score, word_count, status, description: what runs of revision cycles log.

    cycles: run, cycle, novel_score, overall_score, words. A novel score that is
    missing or below zero wasn't read; the overall score stands in. A run ends with
    the first cycle that reaches the plateau, or with the last one allowed.
    revisions: run, cycle, item (place in its cycle), chapter, question, pre, post,
    words; they are kept or discarded, and only those of cycles that ran count. A
    cycle's own row has no item.
    """
    begin = start if isinstance(start, Column) else F.lit(start)
    read = F.when(F.coalesce("novel_score", F.lit(-1.0)) < 0, F.col("overall_score")).otherwise(F.col("novel_score"))
    scored = plateau(cycles.filter(F.col("cycle") <= most).withColumn("score", read), run, "cycle", "score", begin)
    ran = scored.withColumn("_before", F.coalesce(F.lag("score").over(_order(run, "cycle")), begin)).filter("ran")
    about = lambda what, *parts: F.concat(F.lit("Cycle "), F.col("cycle").cast("string"), F.lit(": "), what, *parts)
    moved = lambda a, b: (F.col(a).cast("string"), F.lit("->"), F.col(b).cast("string"))
    whole = ran.select(run, "cycle", F.lit(None).cast("int").alias("item"), F.format_string("revision-cycle-%d", "cycle").alias("phase"), "score", F.col("words").alias("word_count"), F.lit("cycle").alias("status"), about(F.lit("novel_score "), *moved("_before", "score")).alias("description"))
    judged = acceptance(revisions.join(ran.select(run, "cycle"), [run, "cycle"], "left_semi"))
    verb = F.when(F.col("accepted"), " improved ").otherwise(" regressed ")
    each = judged.select(run, "cycle", "item", F.format_string("rev-ch%02d", "chapter").alias("phase"), F.col("post").alias("score"), F.col("words").alias("word_count"), F.when(F.col("accepted"), "keep").otherwise("discard").alias("status"), about(F.col("question"), verb, *moved("pre", "post")).alias("description"))
    return whole.unionByName(each)


def review_rounds(reviews: DataFrame, key: str = "run", step: str = "round", most: int = REVIEW_ROUNDS) -> DataFrame:
    """Parsed reviews (stars, total_items, major_items, qualified_items) with decision and ran; without the few-items rule."""
    from prosaic.operators.extract import should_stop

    ruled = reviews.filter(F.col(step) <= most).withColumn("decision", should_stop(F.col("stars"), F.col("total_items"), F.col("major_items"), F.col("qualified_items"), few_items_rule=False))
    before = F.max(F.col("decision.stop").cast("int")).over(_order(key, step).rowsBetween(Window.unboundedPreceding, -1))
    return ruled.withColumn("ran", F.coalesce(before, F.lit(0)) == 0)


def phases_left(phase: Column, only: Column | None = None) -> Column:
    """The phases still to run from a state's phase on; all of them from an unknown one, none once complete, one if asked for."""
    order = F.array(*[F.lit(p) for p in PHASES])
    at = F.greatest(F.array_position(order, F.coalesce(phase, F.lit(PHASES[0]))), F.lit(1))
    rest = F.when(phase == "complete", F.array().cast("array<string>")).otherwise(F.slice(order, at.cast("int"), len(PHASES)))
    return rest if only is None else F.when(only.isNotNull(), F.array(only)).otherwise(rest)


def with_defaults(state: DataFrame) -> DataFrame:
    """state with every field of DEFAULT_STATE and debts; missing columns and nulls take the default (a null focus stays)."""
    out = state
    for name, value in DEFAULT_STATE.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(value))
        elif name != "current_focus":
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    none = F.array().cast("array<string>")
    out = out.withColumn("debts", F.coalesce("debts", none) if "debts" in out.columns else none)
    return out.select(*DEFAULT_STATE, "debts")


def elapsed_hours(begin: Column, end: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(end) - micros(begin)) / F.lit(3_600_000_000.0)


def batch_summary(drafts: DataFrame) -> DataFrame:
    """total_words, drafted (chapters that have words)."""
    return drafts.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("total_words"), F.count_if(F.col("words") > 0).alias("drafted"))


def latest(logs: DataFrame, pattern: str, value: str = "value", name: str = "file_name", keys: list[str] | None = None) -> DataFrame:
    """The newest log whose file name matches, by name: names begin with their time."""
    return logs.filter(F.rlike(name, F.lit(pattern))).groupBy(*(keys or [])).agg(F.max(name).alias(name), F.max_by(value, name).alias(value))


def latest_chapter_eval(logs: DataFrame, value: str = "value", name: str = "file_name") -> DataFrame:
    """chapter, file_name, value: each chapter's newest log, its number with or without a leading zero."""
    numbered = logs.withColumn("chapter", F.regexp_extract(name, r"_ch(0?[0-9]+)\.json$", 1).try_cast("int")).filter("chapter is not null")
    return latest(numbered, r"_ch[0-9]+\.json$", value, name, ["chapter"])
