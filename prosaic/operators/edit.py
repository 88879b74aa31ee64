"""Located text edits: quotes are found in a text and taken out, one after another.

Edits of one text depend on each other and are a fold; texts are independent.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosaic.functions import text as t

# Kinds of cuts, and the shortest quote that is looked for.
CUT_TYPES = ["OVER-EXPLAIN", "REDUNDANT", "FAT", "TELL", "STRUCTURAL", "GENERIC"]
LEAST_QUOTE = 25


def remove_quote(text: str, quote: str, rewrite: str = "") -> tuple[str, str]:
    """The new text and an empty string, or the same text and why nothing was done.

    A quote must occur exactly once; without an exact occurrence white space may
    differ, if the quote has LEAST_QUOTE characters then.
    """
    loose = quote.split()
    searches = [("ambiguous", re.escape(quote)), ("ambiguous after ws-norm", r"\s+".join(map(re.escape, loose)))]
    for trouble, pattern in searches:
        if trouble != "ambiguous" and len(" ".join(loose)) < LEAST_QUOTE:
            return text, "quote too short after normalisation"
        places = [m.span() for m in re.finditer(pattern, text)] if pattern else []
        if places:
            break
    if len(places) != 1:
        return text, f"{trouble} ({len(places)} matches)" if places else "not found"
    begin, end = places[0]
    return text[:begin] + rewrite + text[end:], ""


def eligible(cut: Column, types: list[str] | None) -> Column:
    """Whether a cut (struct with quote and type) is of a wanted type and long enough to be looked for."""
    long = F.length(t.strip(t.blank_if_null(cut["quote"]))) >= LEAST_QUOTE
    return long & F.coalesce(cut["type"], F.lit("UNKNOWN")).isin(types) if types else long


def apply_cuts(docs: DataFrame, cuts: DataFrame, id_col: str = "doc_id", text_col: str = "text", types: list[str] | None = None, least_fat: int = 0, dry_run: bool = False, rewrite: bool = False) -> DataFrame:
    """id, applied, failed, skipped, words_removed, error, new_text, reasons for each row of cuts (id, cuts, overall_fat_percentage).

    Cuts are applied in order, and each sees the text that earlier ones left. With
    dry_run every eligible cut counts as applied and no text is read. A document
    under least_fat skips all its cuts; one without cuts or without a text says so
    in error. With rewrite, a cut whose action is REWRITE puts its rewrite in place.
    new_text is null unless a cut was applied. Null texts count as missing. Rows
    are joined by id and not gathered; documents without cuts are not read.
    """
    wanted = cuts.select(F.col(id_col).alias("id"), F.coalesce("cuts", F.array().cast(cuts.schema["cuts"].dataType)).alias("cuts"), F.coalesce("overall_fat_percentage", F.lit(0)).alias("fat"))
    count = F.size("cuts")
    lean = F.col("fat") < least_fat
    base = wanted.withColumns({"error": F.when(lean, F.concat(F.lit("fat "), "fat", F.lit(f"% < threshold {least_fat}%"))).when(count == 0, "no cuts in file"), "n": count, "ok": F.filter("cuts", lambda c: eligible(c, types))})
    if dry_run:
        words = F.aggregate(F.transform("ok", lambda c: t.word_count(c["quote"])), F.lit(0), lambda a, x: a + x)
        free = F.col("error").isNull()
        return base.select(F.col("id").alias(id_col), F.when(free, F.size("ok")).otherwise(0).alias("applied"), F.lit(0).alias("failed"), F.when(lean, count).when(free, count - F.size("ok")).otherwise(0).alias("skipped"), F.when(free, words).otherwise(0).alias("words_removed"), "error")
    joined = base.join(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "left")
    joined = joined.withColumn("error", F.when(F.col("error").isNull() & F.col("text").isNull(), "text not found").otherwise(F.col("error")))

    def fold(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                text, applied, failed, words, reasons = row.text, 0, 0, 0, []
                for cut in row.ok if row.error is None else ():
                    new = (cut.get("rewrite") or "") if rewrite and cut.get("action") == "REWRITE" else ""
                    text, why = remove_quote(text, cut["quote"], new)
                    failed += bool(why)
                    applied += not why
                    words += 0 if why else len(cut["quote"].split())
                    reasons.append(why)
                text = re.sub(r"\n{3,}", "\n\n", text) if applied else None
                skipped = row.n if row.error and row.error.startswith("fat ") else row.n - len(row.ok) if row.error is None else 0
                out.append((row.id, applied, failed, skipped, words, row.error, text, reasons))
            yield pd.DataFrame(out, columns=["id", "applied", "failed", "skipped", "words_removed", "error", "new_text", "reasons"])

    kind = joined.schema["id"].dataType.simpleString()
    ready = joined.select("id", "n", "error", F.when(F.col("error").isNull() & (F.size("ok") > 0), F.col("text")).alias("text"), F.transform("ok", lambda c: F.struct(*[c[k].alias(k) for k in ("quote", "type", "action", "rewrite")])).alias("ok"))
    return ready.mapInPandas(fold, f"id {kind}, applied int, failed int, skipped int, words_removed int, error string, new_text string, reasons array<string>").withColumnRenamed("id", id_col)


def totals(results: DataFrame) -> DataFrame:
    return results.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("applied", "failed", "skipped", "words_removed")])


def type_counts(cuts: DataFrame, id_col: str = "doc_id", missing: str = "OTHER") -> DataFrame:
    """id, type, n, first_place: cuts of each type."""
    rows = cuts.select(id_col, F.posexplode("cuts").alias("place", "cut")).select(id_col, "place", F.coalesce("cut.type", F.lit(missing)).alias("type"))
    return rows.groupBy(id_col, "type").agg(F.count("*").alias("n"), F.min("place").alias("first_place"))


def dominant_type(cuts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, dominant: the most frequent type, the one seen first of equal ones; MIXED without cuts."""
    best = type_counts(cuts, id_col).groupBy(id_col).agg(F.max_by("type", F.struct("n", -F.col("first_place"))).alias("type"))
    return cuts.select(id_col).join(best, id_col, "left").select(id_col, F.coalesce("type", F.lit("MIXED")).alias("dominant"))


def priority_cuts(cuts: DataFrame, id_col: str = "doc_id", n: int = 5) -> DataFrame:
    """The first n cuts that are redundant or explain too much."""
    return cuts.select(id_col, F.slice(F.filter("cuts", lambda c: c["type"].isin("REDUNDANT", "OVER-EXPLAIN")), 1, n).alias("cuts"))
