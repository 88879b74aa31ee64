"""Structure from loosely formatted text: JSON in replies, reviews, scores in logs, outlines."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosaic.functions import text as t


def balanced_span(text: str, opener: str = "{") -> str | None:
    """From the first opener to the closer that balances it; brackets inside strings don't count. None without one."""
    closer = {"{": "}", "[": "]"}[opener]
    at = text.find(opener)
    if at < 0:
        return None
    depth = 0
    for m in re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[' + re.escape(opener + closer) + "]", re.DOTALL).finditer(text, at):
        if m[0] == opener:
            depth += 1
        elif m[0] == closer:
            depth -= 1
            if not depth:
                return text[at : m.end()]
    return None


def _loads(text: str) -> str | None:
    """Normal JSON text if the text is JSON, control characters in strings allowed."""
    try:
        return json.dumps(json.loads(text, strict=False), ensure_ascii=False)
    except ValueError:
        return None


def _bare(text: str) -> str:
    text = text.strip()
    if text.startswith("```"):
        text = re.sub(r"\n?```$", "", re.sub(r"^```\w*\n?", "", text))
    return text


def json_of_reply(text: str | None, direct_first: bool = False, openers: str = "{", repair: bool = True) -> str | None:
    """JSON inside a reply: fences off, then the balanced span after the first of the openers that has one.

    direct_first tries the whole text before. With repair, a text without a span is
    tried as a whole, as it is and then with literal line ends escaped. A balanced
    span that isn't JSON gives null, as does a text without any.
    """
    if text is None:
        return None
    bare = _bare(text)
    if direct_first and (found := _loads(bare)) is not None:
        return found
    for opener in openers:
        span = balanced_span(bare, opener)
        if span is not None:
            return _loads(span)
    if not repair or (not direct_first and openers[0] not in bare):
        return None
    found = _loads(bare)
    return found if found is not None else _loads(re.sub(r"(?<!\\)\n", r"\\n", bare))


def _tidy(text: str) -> str:
    """Without commas before a closing bracket, except inside strings."""
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", text, flags=re.DOTALL)


def segments_of_reply(text: str | None) -> str | None:
    """A JSON array of segments, read tolerantly: commas too many and raw line ends are no hindrance.

    Where the reply as a whole is no JSON, it is walked from brace to brace, and every
    object of just a speaker and a text, in this order, is a segment. Null without any.
    """
    if text is None:
        return None
    bare = _tidy(_bare(text))
    if (found := _loads(bare)) is not None:
        return found
    decoder, segments, at = json.JSONDecoder(strict=False), [], bare.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(bare, at)
        except ValueError:
            value, end = None, at + 1
        if value is not None and list(value) == ["speaker", "text"] and all(isinstance(x, str) for x in value.values()) and value["speaker"]:
            segments.append(value)
        at = bare.find("{", end)
    return json.dumps(segments, ensure_ascii=False) if segments else None


def _series(f, **options):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda x: f(None if x is None or x != x else x, **options)).astype(object)

    return F.pandas_udf(run, "string")


def reply_json(text: Column, direct_first: bool = False, openers: str = "{", repair: bool = True) -> Column:
    """json_of_reply as a column, by Arrow batches."""
    return _series(json_of_reply, direct_first=direct_first, openers=openers, repair=repair)(text)


def reply_segments(text: Column) -> Column:
    """array<struct<speaker, text>> of a reply; null if nothing can be found."""
    return F.from_json(_series(segments_of_reply)(text), "array<struct<speaker:string,text:string>>")


def parse_score(text: Column, key: str = "overall_score") -> Column:
    """The first line 'key: number' whose value is a number; -1 without one."""
    found = F.regexp_extract_all(text, F.lit(rf"(?md)^[{t.SPACE}]*\Q{key}\E:(.*)$"), F.lit(1))
    numbers = F.filter(F.transform(found, lambda x: t.strip(x).try_cast("double")), lambda x: x.isNotNull())
    return F.coalesce(F.get(numbers, F.lit(0)), F.lit(-1.0))


def spot_scores(text: Column) -> Column:
    """struct<overall double, raw int>: both, or both null."""
    overall = F.regexp_extract(text, r"overall_score: ([0-9.]+)", 1).try_cast("double")
    raw = F.regexp_extract(text, r"raw_judge_score: ([0-9]+)", 1).try_cast("int")
    both = overall.isNotNull() & raw.isNotNull()
    return F.struct(F.when(both, overall).alias("overall"), F.when(both, raw).alias("raw"))


# Phrases that classify a review's items. In each list the first class that matches wins.
SEVERITIES = [("major", ["major", "significant", "primary", "most important"]), ("minor", ["minor", "small", "slight", "cosmetic"])]
FIX_TYPES = [
    ("compression", ["cut", "compress", "trim", "reduce", "consolidate"]),
    ("addition", ["add", "expand", "introduce", "give", "more"]),
    ("mechanical", ["repetit", "recurring", "frequency", "tic", "gesture"]),
    ("structural", ["restructur", "rearrang", "move", "reorganiz"]),
]
HEDGES = ["individually fine", "largely successful", "each instance works", "minor relative to", "small complaint", "costs of ambition", "not a flaw", "deliberate choice", "thematically coherent"]


def _any(text: Column, words: list[str]) -> Column:
    return t.total([text.contains(w).cast("int") for w in words]) > 0


def _classed(text: Column, classes: list[tuple[str, list[str]]], other: str) -> Column:
    out = F.lit(other)
    for name, words in reversed(classes):
        out = F.when(_any(text, words), name).otherwise(out)
    return out


def parse_reviews(reviews: DataFrame, text_col: str = "raw_text", numeric_stars: bool = False) -> DataFrame:
    """reviews with stars, critic_summary, items, total_items, major_items, qualified_items.

    A review is split once at its professor's heading. Stars are counted in the
    critic's part, a half counting 0.5; a rating in numbers counts 0, or its value
    with numeric_stars; without either stars is null. items: number, title,
    severity, type, qualified, suggestion, full_text.
    """
    text = t.blank_if_null(F.col(text_col))
    heading = r"(?d)(?:Professor|PROFESSOR|professor).*?(?:Review|Assessment|Analysis|Craft)"
    parts = F.split(text, heading, 2)
    critic, professor = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    rating = F.regexp_extract(critic, rf"(★+½?|([0-9]+\.?[0-9]*)[{t.SPACE}]*/?[{t.SPACE}]*(?:out of[{t.SPACE}]*)?(?:five|5))", 1)
    number = F.regexp_extract(rating, r"^([0-9]+\.?[0-9]*)", 1).try_cast("double")
    counted = F.regexp_count(rating, F.lit("★")) + F.when(rating.contains("½"), 0.5).otherwise(0.0)
    stars = F.when(rating != "", F.coalesce(number, counted) if numeric_stars else counted)

    def item(section: Column) -> Column:
        low = F.lower(section)
        asked = F.regexp_extract(section, rf"(?s)(?:Specific[{t.SPACE}]+)?[Ss]uggestion[s]?:?[{t.SPACE}]*\n?(.*?)(?=\n[0-9]+\.|\n\n[A-Z]|\z)", 1)
        return F.struct(
            F.regexp_extract(section, r"^([0-9]+)\.", 1).cast("int").alias("number"), t.strip(F.regexp_extract(section, rf"(?d)^[0-9]+\.[{t.SPACE}]+(.+?)(?:\n|\z)", 1)).alias("title"), _classed(low, SEVERITIES, "moderate").alias("severity"),
            _classed(low, FIX_TYPES, "revision").alias("type"), _any(low, HEDGES).alias("qualified"), F.substring(t.strip(asked), 1, 500).alias("suggestion"), F.substring(t.strip(section), 1, 1000).alias("full_text"),
        )

    sections = F.filter(F.split(professor, rf"\n(?=[0-9]+\.[{t.SPACE}]+[A-Z])"), lambda s: F.rlike(s, F.lit(rf"(?d)^[0-9]+\.[{t.SPACE}]+.")))
    out = reviews.withColumns({"stars": stars, "critic_summary": F.substring(t.strip(critic), 1, 500), "items": F.transform(sections, item)})
    return out.withColumns({"total_items": F.size("items"), "major_items": F.size(F.filter("items", lambda i: i["severity"] == "major")), "qualified_items": F.size(F.filter("items", lambda i: i["qualified"]))})


def should_stop(stars: Column, total: Column, major: Column, qualified: Column, few_items_rule: bool = True) -> Column:
    """struct<stop, reason>: the first rule that holds; the third (two items or fewer) can be left out."""
    s = F.coalesce(stars, F.lit(0.0))
    rule = F.when((s >= 4.5) & (major == 0), F.struct(F.lit(True).alias("stop"), F.lit("★★★★½ with no major items").alias("reason")))
    share = F.coalesce(F.try_divide(qualified.cast("double"), total.cast("double")), F.lit(0.0))
    rule = rule.when((s >= 4) & (total > 0) & (share > 0.5), F.struct(F.lit(True).alias("stop"), F.concat(F.lit("★"), F.repeat(F.lit("★"), s.cast("int")), F.lit(" with "), qualified, F.lit("/"), total, F.lit(" items qualified")).alias("reason")))
    if few_items_rule:
        rule = rule.when(total <= 2, F.struct(F.lit(True).alias("stop"), F.concat(F.lit("Only "), total, F.lit(" items found")).alias("reason")))
    return rule.otherwise(F.struct(F.lit(False).alias("stop"), F.concat(major, F.lit(" major items, "), total - qualified, F.lit(" unqualified")).alias("reason")))


def outline_entry(outline: Column, n: Column, loose: bool = False) -> Column:
    """The outline's entry of chapter n, up to the next one or the foreshadowing part; null without one.

    loose also takes '###Ch n' headings in other spacings, and ends at an act.
    """
    if loose:
        pattern = F.concat(F.lit(rf"(?s)(###[{t.SPACE}]*Ch[{t.SPACE}]*"), n, F.lit(rf"\b.*?)(?=###[{t.SPACE}]*Ch[{t.SPACE}]*[0-9]|## Act|## Foreshadowing|\n?\z)"))
    else:
        pattern = F.concat(F.lit("(?s)(### Ch "), n, F.lit(":.*?)(?=### Ch "), n + 1, F.lit(r":|## Foreshadowing|\n?\z)"))
    found = F.call_function("regexp_extract", outline, pattern, F.lit(1))
    return F.when(found != "", found if loose else t.strip(found))


def next_outline_head(outline: Column, n: Column, lines: int = 10) -> Column:
    entry = outline_entry(outline, n + 1)
    return F.coalesce(F.array_join(F.slice(F.split(entry, "\n"), 1, lines), "\n"), F.lit("(final chapter)"))


def last_chapter(outline: Column, default: int = 24) -> Column:
    """The largest chapter number among the outline's headings."""
    found = F.transform(F.regexp_extract_all(outline, F.lit(rf"###[{t.SPACE}]*Ch(?:apter)?[{t.SPACE}]*([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.coalesce(F.array_max(found), F.lit(default))


def from_part_two(text: Column) -> Column:
    """From the first line with 'Part 2' on; null without one."""
    found = F.regexp_extract(text, r"(?s)(?:^|\n)([^\n]*Part 2.*)", 1)
    return F.when(found != "", found)


def locations(text: Column, n: int = 15) -> Column:
    """Bold names and third-level headings of under 40 characters in order, then named quarters not seen before; the first n."""
    names = F.concat(F.regexp_extract_all(text, F.lit(rf"\*\*([^*]+)\*\*[{t.SPACE}]*[—–-]"), F.lit(1)), F.regexp_extract_all(text, F.lit(rf"(?d)###[{t.SPACE}]+(.+)"), F.lit(1)))
    names = F.filter(F.transform(names, t.strip), lambda x: (F.length(x) < 40) & ~x.startswith("Note"))
    places = F.array_distinct(F.regexp_extract_all(text, F.lit(r"the ([A-Z][a-z]+ (?:Quarter|District|Tier|Line|Square|Tower|Settlement)s?)"), F.lit(1)))
    return F.slice(F.concat(names, F.filter(places, lambda x: ~F.array_contains(names, x))), 1, n)


def phrase_lines(text: Column, pattern: str) -> Column:
    """How many lines match."""
    return F.size(F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(pattern))))


def pattern_check(text: Column) -> Column:
    """struct<words, did_not, thought>: words, and lines with each of two worn phrases."""
    return F.struct(t.word_count(text).alias("words"), phrase_lines(text, "He did not|He had not").alias("did_not"), phrase_lines(text, "He thought about|He thought of").alias("thought"))


def canon_facts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """category, fact, source: bullets of a canon document under its second-level headings; comments are left out."""
    text = F.regexp_replace(t.blank_if_null(F.col(text_col)), r"(?s)<!--.*?-->", "")
    sections = docs.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?s)(?:^|\n)(## .*?)(?=\n## |\z)"), F.lit(1))).alias("section"))
    lines = sections.select(t.strip(F.regexp_extract("section", r"^## ([^\n]*)", 1)).alias("category"), F.posexplode(F.regexp_extract_all("section", F.lit(r"(?m)^- (.*)$"), F.lit(1))).alias("seq", "line"))
    return lines.select("category", "seq", t.strip(F.regexp_replace("line", r"\(([^()]*)\)\s*$", "")).alias("fact"), F.regexp_extract("line", r"\(([^()]*)\)\s*$", 1).alias("source"))
