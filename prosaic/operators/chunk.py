"""Greedy bounded chunks of spoken segments, and the voices that speak them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The limit of a call, the voices fallen back on, and the placeholder of a voice not chosen yet.
MOST_CHARS = 4500
FALLBACK = ("MINOR", "NARRATOR")
PLACEHOLDER = "REPLACE_WITH_VOICE_ID"


def usable_voices(voices: DataFrame) -> DataFrame:
    """voices (speaker, voice_id) without private names and placeholders."""
    return voices.filter(~F.col("speaker").startswith("_") & (F.coalesce("voice_id", F.lit("")) != "") & (F.col("voice_id") != PLACEHOLDER))


def with_voices(segments: DataFrame, voices: DataFrame, first: str = "seq") -> DataFrame:
    """segments (speaker, ...) with voice_id: the speaker's, else the minor one, else the narrator's, else the first one's; null only without voices.

    voices: speaker, voice_id and an order column. The planner sizes the join; what
    is fallen back on is one row.
    """
    own = usable_voices(voices)
    others = own.agg(*[F.max(F.when(F.col("speaker") == s, F.col("voice_id"))).alias(f"_{s}") for s in FALLBACK], F.min_by("voice_id", first).alias("_first"))
    joined = segments.join(own.select("speaker", F.col("voice_id").alias("_own")), "speaker", "left").crossJoin(F.broadcast(others))
    return joined.withColumn("voice_id", F.coalesce("_own", *[f"_{s}" for s in FALLBACK], "_first")).select(*segments.columns, "voice_id")


def _numbers(units: Iterable[tuple[int, int]], most: int) -> Iterator[int]:
    """For units of (length asked for, length taken up): the number of the chunk that each falls into."""
    number = full = 0
    for asked, taken in units:
        if full and full + asked > most:
            number, full = number + 1, 0
        full += taken
        yield number


def chunks_of(segments: list[tuple[str, str]], most: int = MOST_CHARS) -> list[list[tuple[str, str]]]:
    """Chunks of (text, voice) of at most `most` characters of text, except where one sentence alone is longer.

    Neighbouring segments share chunks. A longer segment shares none: its sentences,
    a character of space after each, are spread over chunks of its own. Segments that
    are blank once tags in brackets are taken out ask for room like others, but take
    none up and are dropped.
    """
    out: list[list[tuple[str, str]]] = []
    for long, run in groupby(segments, lambda x: len(x[0]) > most):
        if long:
            for text, voice in run:
                sentences = re.split(r"(?<=\.) |\n", text)
                dealt = zip(_numbers(((len(x), len(x) + 1) for x in sentences), most), sentences)
                out += [[(" ".join(x for _, x in own), voice)] for _, own in groupby(dealt, itemgetter(0))]
            continue
        marked = [(segment, bool(re.sub(r"\[.*?\]", "", segment[0]).strip())) for segment in run]
        dealt = zip(_numbers(((len(x[0]), len(x[0]) if said else 0) for x, said in marked), most), marked)
        shared = [[x for _, (x, said) in own if said] for _, own in groupby(dealt, itemgetter(0))]
        out += filter(None, shared)
    return out


def chunk_segments(segments: DataFrame, key: str, order: str, text_col: str = "text", voice_col: str = "voice_id", most: int = MOST_CHARS) -> DataFrame:
    """key, chunk (from 0), place (from 0), text, voice_id. Segments without a voice or text are dropped; a group is one script."""
    rows = segments.select(F.col(key).alias("key"), F.col(order).alias("seq"), F.col(text_col).alias("text"), F.col(voice_col).alias("voice_id")).filter("text is not null and voice_id is not null")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq", kind="stable")
        cut = chunks_of(list(zip(frame["text"], frame["voice_id"])), most)
        flat = [(frame["key"].iloc[0], c, p, text, voice) for c, own in enumerate(cut) for p, (text, voice) in enumerate(own)]
        return pd.DataFrame(flat, columns=["key", "chunk", "place", "text", "voice_id"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").applyInPandas(run, f"key {kind}, chunk int, place int, text string, voice_id string").withColumnRenamed("key", key)


def first_segments(segments: Column, n: int = 10) -> Column:
    """The first n segments of a script's array: what a test run speaks."""
    return F.slice(segments, 1, n)


def script_totals(scripts: DataFrame, key: str, segments: str = "segments") -> DataFrame:
    """key, total_segments, speakers (sorted), total_chars of scripts with array<struct<speaker, text>>."""
    s = F.col(segments)
    chars = F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["text"]))
    return scripts.select(key, F.size(s).alias("total_segments"), F.array_sort(F.array_distinct(F.transform(s, lambda x: x["speaker"]))).alias("speakers"), chars.alias("total_chars"))


def status(scripts: DataFrame, audio: DataFrame, manifests: DataFrame, key: str = "chapter") -> DataFrame:
    """key, status: 'not generated', 'complete', 'partial' or, without a manifest, 'generated'. manifests: key, failed array."""
    joined = scripts.select(key).join(audio.select(key, F.lit(True).alias("_audio")), key, "left").join(manifests.select(key, F.lit(True).alias("_manifest"), "failed"), key, "left")
    return joined.select(key, F.when(F.col("_audio").isNull(), "not generated").when(F.col("_manifest").isNull(), "generated").when(F.size("failed") > 0, "partial").otherwise("complete").alias("status"))


def manifest(attempts: DataFrame, key: str = "chapter", most: int = 3) -> DataFrame:
    """key, total_chunks, succeeded, failed, complete: a chunk succeeds if one of its first `most` attempts did. attempts: key, chunk, attempt, ok."""
    each = attempts.filter(F.col("attempt") <= most).groupBy(key, "chunk").agg(F.max("ok").alias("ok"))
    sides = [F.array_sort(F.collect_list(F.when(F.col("ok") == v, F.col("chunk")))).alias(n) for n, v in (("succeeded", True), ("failed", False))]
    return each.groupBy(key).agg(F.count("*").alias("total_chunks"), *sides).withColumn("complete", F.size("failed") == 0)


