"""Queries over replies, outlines, markup and slices of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosaic.functions import lexicons as L
from prosaic.functions import text as t
from prosaic.operators import extract, markup
from prosaic.plans import probes
from prosaic.plans.corpus import PROSE_SQL, SPACE, comparable, local, prose, table, values


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text: Markdown probes and documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return local(spark, [(-i, x) for i, x in probes.MARKDOWN], "id long, text string").union(docs)


def q_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _markdown(spark, sf_dir)
    line = t.title_line(F.col("text"))
    split = t.split_title(line)
    return comparable(rows.select("id", t.chapter_title(F.col("text")).alias("title"), line.alias("title_line"), split["label"].alias("label"), split["subtitle"].alias("subtitle")))


def q_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads and tails by characters and words, and cut-off texts."""
    c = F.col("text")
    return comparable(prose(spark, sf_dir).select("doc_id", F.substring(c, 1, 500).alias("head"), F.right(c, F.lit(300)).alias("tail"), t.head_words(c, 15).alias("head_words"), t.tail_words(c, 15).alias("tail_words"), t.truncate(c, 200).alias("cut")))


def q_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return comparable(_markdown(spark, sf_dir).select("id", t.collapse_blank_lines(c).alias("collapsed"), t.collapse_spaces(c).alias("spaced"), t.strip_tags(c).alias("untagged"), markup.latex_escape(c).alias("escaped")))


def q_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = local(spark, probes.REPLIES, "id int, raw string")
    return comparable(rows.select("id", t.strip_fences(t.blank_if_null(F.col("raw"))).alias("bare")))


def q_pattern_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(_markdown(spark, sf_dir).select("id", extract.pattern_check(F.col("text")).alias("p")).select("id", "p.*"))


def q_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(_markdown(spark, sf_dir).select("id", markup.md_to_latex(F.col("text")).alias("latex"), markup.chapter_latex(F.col("text")).alias("chapter")))


def q_manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manuscript for each conversation, and one of the Markdown probes."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("n"), "text")
    own = local(spark, [(-1, i, x) for i, x in probes.MARKDOWN], "book long, n long, text string")
    return comparable(markup.manuscript(turns.union(own), "n", "text", ["book"]))


def q_key_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prose(spark, sf_dir).select("doc_id", markup.key_passages(F.col("text"), 30, 3).alias("k"))
    return comparable(found.select("doc_id", "k.opening", "k.closing", F.array_join("k.dialogue", "|").alias("dialogue")))


def q_arc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block for each document, its summary being its first sentence."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    first = F.coalesce(F.get(t.sentences(text), F.lit(0)), F.lit(""))
    return comparable(docs.select("doc_id", markup.arc_block(F.col("doc_id"), t.word_count(text), first, markup.key_passages(text)).alias("block")))


def q_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = local(spark, probes.OUTLINES, "id int, outline string")
    each = rows.select("id", "outline", F.explode(F.array(*[F.lit(n) for n in (1, 2, 3, 10, 11)])).alias("n"))
    o, n = F.col("outline"), F.col("n")
    return comparable(each.select("id", "n", extract.outline_entry(o, n).alias("entry"), extract.outline_entry(o, n, True).alias("loose"), extract.next_outline_head(o, n).alias("next")))


def q_outline_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = local(spark, probes.OUTLINES, "id int, outline string")
    return comparable(rows.select("id", extract.last_chapter(F.col("outline")).alias("last"), extract.from_part_two(F.col("outline")).alias("part_two")))


_WORLD = [(1, "**Low Town** — by the river\n**Note well** - no\n### The High Tier\nIn the Copper Quarter and the Long Square stood the Copper Quarter gate.\n### A heading that is far too long to be the name of a place\n**Hill** – green"), (2, "nothing"), (3, "")]


def q_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = local(spark, _WORLD, "id int, text string")
    return comparable(rows.select("id", F.array_join(extract.locations(F.col("text")), "|").alias("places")))


_CANON = [(1, "# Canon\nintro\n## Geography\n<!-- - hidden (x) -->\n- The hill is green. (world.md)\n- No source here\n## Time\n- It is late (ch_01)\n- Two (a) and (b)\n\n## Empty\n")]


def q_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(extract.canon_facts(local(spark, _CANON, "id int, text string")))


def q_voice_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(local(spark, list(enumerate(L.VOICE_RULES)), "seq int, rule string"))


def q_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of loosely written replies, by each reading of them."""
    raw = F.col("raw")
    rows = local(spark, probes.REPLIES, "id int, raw string")
    return comparable(rows.select("id", extract.reply_json(raw).alias("judge"), extract.reply_json(raw, direct_first=True, openers="{[").alias("editor"), extract.reply_json(raw, direct_first=True).alias("pair"), extract.reply_json(raw, repair=False).alias("strict")))


def q_event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values of clean JSON, through the same reading."""
    events = table(spark, sf_dir, "events")
    found = events.select("event_id", F.explode_outer(F.from_json(extract.reply_json(F.col("props")), "map<string,string>")).alias("k", "v"))
    return comparable(found)


def q_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of loosely written scripts; place -1 for a reply without any."""
    rows = local(spark, probes.SCRIPTS, "id int, raw string")
    return comparable(rows.select("id", F.posexplode_outer(extract.reply_segments(F.col("raw"))).alias("place", "s")).select("id", F.coalesce("place", F.lit(-1)).alias("place"), "s.speaker", "s.text"))


def q_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = local(spark, probes.OUTPUTS, "id int, out string")
    spot = extract.spot_scores(F.col("out"))
    return comparable(rows.select("id", extract.parse_score(F.col("out")).alias("overall"), extract.parse_score(F.col("out"), "lore_score").alias("lore"), spot["overall"].alias("spot"), F.coalesce(spot["raw"], F.lit(-1)).alias("raw")))


_MD = "md AS (SELECT -id AS id, text FROM " + values(probes.MARKDOWN, ["id", "text"]) + " UNION ALL SELECT doc_id, coalesce(text, '') FROM documents)"
def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


_WORDS = f"[^{SPACE}]+"
_LINE = _strip("ltrim(split_part(text, chr(10), 1), '# ')")

TITLES_SQL = f"""
WITH {_MD}, l AS (SELECT id, text, {_LINE} AS title_line, list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {_strip('x')}), lambda x: starts_with(x, '#'))[1] AS h FROM md),
b AS (SELECT *, {_strip(f"regexp_replace(regexp_replace(h, '^#+[{SPACE}]*', ''), '(?i)^Chapter[{SPACE}]+(?:[0-9]+|[A-Z][a-z]+(?:-[A-Z][a-z]+)*)[{SPACE}]*[:—–-]*[{SPACE}]*', '')")} AS x FROM l)
SELECT id, CASE WHEN coalesce(x, '') = '' THEN 'Untitled' ELSE x END AS title, title_line, CASE WHEN contains(title_line, ': ') THEN left(title_line, strpos(title_line, ': ') - 1) ELSE title_line END AS label,
  CASE WHEN contains(title_line, ': ') THEN substr(title_line, strpos(title_line, ': ') + 2) ELSE '' END AS subtitle FROM b
"""

SLICES_SQL = f"""
WITH {PROSE_SQL}, w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORDS}') AS w FROM corpus)
SELECT doc_id, left(text, 500) AS head, right(text, 300) AS tail, array_to_string(w[:15], ' ') AS head_words, array_to_string(w[greatest(len(w) - 14, 1):], ' ') AS tail_words,
  CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS cut FROM w
"""

NORMALISED_SQL = f"""
WITH {_MD}
SELECT id, regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g') AS collapsed, {_strip(f"regexp_replace(text, '[{SPACE}]+', ' ', 'g')")} AS spaced, regexp_replace(text, '\\[.*?\\]', '', 'g') AS untagged,
  replace(replace(replace(replace(replace(text, '&', '\\&'), '%', '\\%'), '$', '\\$'), '#', '\\#'), '_', '\\_') AS escaped FROM md
"""

PATTERN_SQL = f"""
WITH {_MD}
SELECT id, len(regexp_extract_all(text, '{_WORDS}'))::BIGINT AS words, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'He did not') OR contains(x, 'He had not')))::BIGINT AS did_not,
  len(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'He thought about') OR contains(x, 'He thought of')))::BIGINT AS thought FROM md
"""

MANUSCRIPTS_SQL = f"""
WITH b AS (SELECT conv_id AS book, turn AS n, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, id, text FROM {values(probes.MARKDOWN, ["id", "text"])}),
s AS (SELECT book, n, {_strip('text')} AS t FROM b)
SELECT book, count(*) AS chapters, sum(len(regexp_extract_all(t, '{_WORDS}')))::BIGINT AS words, string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n, t) || chr(10) AS text FROM s WHERE t <> '' GROUP BY 1
"""

PASSAGES_SQL = f"""
WITH {PROSE_SQL}, w AS (SELECT doc_id, regexp_extract_all(text, '{_WORDS}') AS w, regexp_extract_all(text, '"([^"]{{3,}})"', 1) AS q FROM corpus),
r AS (SELECT doc_id, unnest(q) AS d, unnest(range(len(q))) AS i FROM w),
k AS (SELECT doc_id, string_agg(d, '|' ORDER BY length(d) DESC, i) AS dialogue FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(d) DESC, i) AS n FROM r) WHERE n <= 3 GROUP BY 1)
SELECT doc_id, array_to_string(w[:30], ' ') AS opening, array_to_string(w[greatest(len(w) - 29, 1):], ' ') AS closing, coalesce(dialogue, '') AS dialogue FROM w LEFT JOIN k USING (doc_id)
"""

OUTLINE_FACTS_SQL = f"""
WITH o AS (SELECT * FROM {values(probes.OUTLINES, ["id", "outline"])})
SELECT id::BIGINT AS id, coalesce(list_max(list_transform(regexp_extract_all(outline, '###\\s*Ch(?:apter)?\\s*([0-9]+)', 1), lambda x: x::BIGINT)), 24) AS last,
  CASE WHEN contains(outline, 'Part 2') THEN regexp_extract(outline, '(?s)(?:^|\\n)([^\\n]*Part 2.*)', 1) END AS part_two FROM o
"""

VOICE_RULES_SQL = "SELECT seq::BIGINT AS seq, rule FROM " + values(list(enumerate(L.VOICE_RULES)), ["seq", "rule"])

EVENT_PROPS_SQL = """
WITH e AS (SELECT event_id, props::JSON AS j FROM events WHERE props IS NOT NULL)
SELECT event_id, k, j ->> ('$."' || k || '"') AS v FROM (SELECT event_id, j, unnest(json_keys(j)) AS k FROM e)
"""

SCORES_SQL = f"""
WITH o AS (SELECT id, coalesce(out, '') AS x, out FROM {values(probes.OUTPUTS, ["id", "out"])}),
n AS (SELECT id, out, list_filter(list_transform(regexp_extract_all(x, '(?m)^\\s*overall_score:(.*)$', 1), lambda v: try_cast(trim(v) AS DOUBLE)), lambda v: v IS NOT NULL)[1] AS a,
  list_filter(list_transform(regexp_extract_all(x, '(?m)^\\s*lore_score:(.*)$', 1), lambda v: try_cast(trim(v) AS DOUBLE)), lambda v: v IS NOT NULL)[1] AS b,
  try_cast(nullif(regexp_extract(x, 'overall_score: ([0-9.]+)', 1), '') AS DOUBLE) AS s, try_cast(nullif(regexp_extract(x, 'raw_judge_score: ([0-9]+)', 1), '') AS BIGINT) AS r FROM o)
SELECT id::BIGINT AS id, coalesce(a, -1e0) AS overall, coalesce(b, -1e0) AS lore, CASE WHEN s IS NOT NULL AND r IS NOT NULL THEN s END AS spot, CASE WHEN s IS NOT NULL AND r IS NOT NULL THEN r ELSE -1 END AS raw FROM n
"""

FENCES_SQL = f"""
WITH r AS (SELECT id, {_strip("coalesce(raw, '')")} AS s FROM {values(probes.REPLIES, ["id", "raw"])})
SELECT id::BIGINT AS id, CASE WHEN starts_with(s, '```') THEN regexp_replace(regexp_replace(s, '^```[\\p{{L}}\\p{{N}}_]*\\n?', ''), '\\n?```$', '') ELSE s END AS bare FROM r
"""

ARC_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORDS}') AS w, regexp_extract_all(text, '"([^"]{{20,}})"', 1) AS q FROM d),
r AS (SELECT doc_id, unnest(q) AS d, unnest(range(len(q))) AS i FROM w), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(d) DESC, i) AS n FROM r),
k AS (SELECT doc_id, string_agg('> "' || d || '"' || chr(10) || chr(10), '' ORDER BY n) AS quotes FROM n WHERE n <= 3 GROUP BY 1),
s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: {_strip('x')}), lambda x: len(regexp_extract_all(x, '{_WORDS}')) > 2)[1] AS s FROM d)
SELECT doc_id, '### Chapter ' || doc_id || ' (' || len(w) || ' words)' || chr(10) || '**Summary:** ' || coalesce(s, '') || chr(10) || chr(10) || '**Opening:** ' || array_to_string(w[:150], ' ') || '...' || chr(10) || chr(10)
  || '**Closing:** ...' || array_to_string(w[greatest(len(w) - 149, 1):], ' ') || chr(10) || chr(10) || '**Key dialogue:**' || chr(10) || coalesce(quotes, '') AS block
FROM w JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)
"""

# without lookahead: the entry ends before the first of its possible ends
OUTLINES_SQL = f"""
WITH o AS (SELECT id, outline, n FROM {values(probes.OUTLINES, ["id", "outline"])}, (SELECT unnest([1, 2, 3, 10, 11]) AS n)),
h AS (SELECT *, regexp_extract(outline, '(?s)### Ch ' || n || ':.*') AS a, regexp_extract(outline, '(?s)### Ch ' || (n + 1) || ':.*') AS b, regexp_extract(outline, '(?s)###\\s*Ch\\s*' || n || '\\b.*') AS l FROM o),
e AS (SELECT *, split_part(split_part(a, '### Ch ' || (n + 1) || ':', 1), '## Foreshadowing', 1) AS entry, split_part(split_part(b, '### Ch ' || (n + 2) || ':', 1), '## Foreshadowing', 1) AS following,
  split_part(split_part(regexp_extract(l, '^###\\s*Ch\\s*[0-9]+') || split_part(regexp_replace(regexp_replace(l, '^###\\s*Ch\\s*[0-9]+', ''), '###\\s*Ch\\s*[0-9]', chr(1)), chr(1), 1), '## Act', 1), '## Foreshadowing', 1) AS loose FROM h)
SELECT id::BIGINT AS id, n::BIGINT AS n, CASE WHEN a <> '' THEN {_strip('entry')} END AS entry, CASE WHEN l <> '' THEN loose END AS loose,
  CASE WHEN b = '' THEN '(final chapter)' ELSE array_to_string(string_split({_strip('following')}, chr(10))[:10], chr(10)) END AS next FROM e
"""

LOCATIONS_SQL = f"""
WITH t AS (SELECT * FROM {values(_WORLD, ["id", "text"])}),
n AS (SELECT id, list_filter(list_transform(regexp_extract_all(text, '\\*\\*([^*]+)\\*\\*\\s*[—–-]', 1) || regexp_extract_all(text, '###\\s+(.+)', 1), lambda x: trim(x)), lambda x: length(x) < 40 AND NOT starts_with(x, 'Note')) AS names,
  regexp_extract_all(text, 'the ([A-Z][a-z]+ (?:Quarter|District|Tier|Line|Square|Tower|Settlement)s?)', 1) AS p FROM t),
u AS (SELECT id, names, list_filter(p, lambda x, i: NOT list_contains(names, x) AND list_position(p, x) = i) AS places FROM n)
SELECT id::BIGINT AS id, array_to_string((names || places)[:15], '|') AS places FROM u
"""

CANON_SQL = f"""
WITH t AS (SELECT regexp_replace(text, '(?s)<!--.*?-->', '', 'g') AS text FROM {values(_CANON, ["id", "text"])}),
s AS (SELECT unnest(string_split(chr(10) || text, chr(10) || '## ')[2:]) AS s FROM t), l AS (SELECT trim(split_part(s, chr(10), 1)) AS category, list_filter(string_split(s, chr(10)), lambda x: starts_with(x, '- ')) AS b FROM s),
r AS (SELECT category, unnest(b) AS line, unnest(range(len(b))) AS seq FROM l)
SELECT category, seq::BIGINT AS seq, trim(regexp_replace(substr(line, 3), '\\(([^()]*)\\)\\s*$', '')) AS fact, regexp_extract(line, '\\(([^()]*)\\)\\s*$', 1) AS source FROM r
"""

REPLIES_SQL = "SELECT id::BIGINT AS id, judge, editor, pair, strict FROM " + values(probes.READ_REPLIES, ["id", "judge", "editor", "pair", "strict"])

SCRIPTS_SQL = "SELECT id::BIGINT AS id, place::BIGINT AS place, speaker, text FROM " + values(probes.READ_SCRIPTS, ["id", "place", "speaker", "text"])


def _latex_line(line: str) -> str:
    """A line in LaTeX. Neighbours are captured instead of looked at: those of one rule's quotes are never the same character."""

    def sub(x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"

    for _ in range(2):  # the second time for italics that touch
        line = sub(line, r"(^|[^*])\*([^*]+)\*($|[^*])", r"\1\\textit{\2}\3")
    for a, b in [*[(c, "\\" + c) for c in "&%$#_"], ("—", "---"), ("–", "--"), ("“", "``"), ("”", "''''"), ("‘", "`"), ("’", "''"), ("…", "\\ldots{}")]:
        line = f"replace({line}, '{a}', '{b}')"
    w, sp, stop = r"[\p{L}\p{N}_]", f"[{SPACE}]", f"[{SPACE}.,;:!?\\-]"
    for pattern, to in (
        (f'({sp})"({w})', r"\1``\2"), (f'^"({w})', r"``\1"), (f'({w})"({stop})', r"\1''''\2"), (f'({w})"$', r"\1''''"), ('([.?!])"', r"\1''''"),
        (f'({sp})"', r"\1``"), (f'"({sp})', r"''''\1"), ('^"', "``"),
    ):
        line = sub(line, pattern, to)
    return line


def _latex(body: str) -> str:
    lines = f"list_transform(string_split({body}, chr(10)), lambda x: {_strip('x')})"
    return f"array_to_string(list_transform({lines}, lambda s: CASE WHEN s = '---' THEN chr(10) || '\\scenebreak' || chr(10) WHEN s = '' THEN '' ELSE {_latex_line('s')} END), chr(10))"


LATEX_SQL = f"""
WITH {_MD}, s AS (SELECT id, text, {_strip('text')} AS whole FROM md), l AS (SELECT id, text, {_LINE.replace("text", "whole")} AS title_line, {_strip("regexp_replace(whole, '^[^\\n]*\\n?', '')")} AS body FROM s),
b AS (SELECT id, {_latex('text')} AS latex, string_split({_latex('body')}, chr(10)) AS lines, CASE WHEN contains(title_line, ': ') AND substr(title_line, strpos(title_line, ': ') + 2) <> '' THEN substr(title_line, strpos(title_line, ': ') + 2)
  WHEN contains(title_line, ': ') THEN left(title_line, strpos(title_line, ': ') - 1) ELSE title_line END AS title FROM l),
i AS (SELECT *, list_position(list_transform(lines, lambda x: {_strip('x')} <> ''), true) AS a FROM b),
j AS (SELECT *, list_position(list_transform(lines, lambda x, i: i >= a AND ({_strip('x')} = '' OR starts_with({_strip('x')}, '\\scenebreak'))), true) AS z FROM i),
p AS (SELECT *, array_to_string(CASE WHEN a IS NULL THEN [] WHEN z IS NULL THEN lines[a:] ELSE lines[a : z - 1] END, ' ') AS para, array_to_string(CASE WHEN z IS NULL THEN lines[a:] ELSE lines[z:] END, chr(10)) AS rest FROM j),
w AS (SELECT *, substr(para, 2) AS after, strpos(substr(para, 2), ' ') AS space FROM p)
SELECT id, latex, '\\chapter{{' || replace(replace(replace(replace(replace(title, '&', '\\&'), '%', '\\%'), '$', '\\$'), '#', '\\#'), '_', '\\_') || '}}' || chr(10) || chr(10) || CASE WHEN length(para) < 2 THEN array_to_string(lines, chr(10))
  ELSE '\\lettrine[lines=2, lhang=0.1, nindent=0.2em]{{' || left(para, 1) || '}}{{' || CASE WHEN space > 1 THEN left(after, space - 1) ELSE after END || '}}' || CASE WHEN space > 1 THEN substr(after, space) ELSE '' END || chr(10) || chr(10) || rest END || chr(10) AS chapter
FROM w
"""

QUERIES = {
    "q_titles": (q_titles, TITLES_SQL),
    "q_slices": (q_slices, SLICES_SQL),
    "q_normalised": (q_normalised, NORMALISED_SQL),
    "q_pattern_check": (q_pattern_check, PATTERN_SQL),
    "q_manuscripts": (q_manuscripts, MANUSCRIPTS_SQL),
    "q_key_passages": (q_key_passages, PASSAGES_SQL),
    "q_outline_facts": (q_outline_facts, OUTLINE_FACTS_SQL),
    "q_voice_rules": (q_voice_rules, VOICE_RULES_SQL),
    "q_event_props": (q_event_props, EVENT_PROPS_SQL),
    "q_scores": (q_scores, SCORES_SQL),
    "q_fences": (q_fences, FENCES_SQL),
    "q_latex": (q_latex, LATEX_SQL),
    "q_arc_summary": (q_arc_summary, ARC_SQL),
    "q_outlines": (q_outlines, OUTLINES_SQL),
    "q_locations": (q_locations, LOCATIONS_SQL),
    "q_canon": (q_canon, CANON_SQL),
    "q_replies": (q_replies, REPLIES_SQL),
    "q_scripts": (q_scripts, SCRIPTS_SQL),
}
