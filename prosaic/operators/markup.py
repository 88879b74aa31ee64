"""Markdown to LaTeX, drop caps, manuscripts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosaic.functions import text as t
from prosaic.operators import feedback


def latex_escape(text: Column) -> Column:
    for c in "&%$#_":
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def _line(line: Column) -> Column:
    s = F.regexp_replace(line, r"(?<!\*)\*([^*]+)\*(?!\*)", r"\\textit{$1}")
    s = latex_escape(s)
    for a, b in (("—", "---"), ("–", "--"), ("“", "``"), ("”", "''"), ("‘", "`"), ("’", "'"), ("…", "\\ldots{}")):
        s = F.replace(s, F.lit(a), F.lit(b))
    # straight quotes: opening ones, then closing ones, then what is left
    w, sp = r"[\p{L}\p{N}_]", f"[{t.SPACE}]"
    for pattern, quote in (
        (f'(?<={sp})"(?={w})', "``"), (f'^"(?={w})', "``"), (f'(?<={w})"(?=[{t.SPACE}.,;:!?\\-])', "''"), (f'(?<={w})"$', "''"), (r'(?<=[.?!])"', "''"),
        (f'(?<={sp})"', "``"), (f'"(?={sp})', "''"), ('^"', "``"),
    ):
        s = F.regexp_replace(s, pattern, quote)
    return s


def md_to_latex(body: Column) -> Column:
    """Line by line: rules become scene breaks, blank lines stay, others get italics, escapes, dashes and quotes."""

    def one(raw: Column) -> Column:
        s = t.strip(raw)
        return F.when(s == "---", "\n\\scenebreak\n").when(s == "", "").otherwise(_line(s))

    return F.array_join(F.transform(F.split(body, "\n"), one), "\n")


def drop_cap(latex: Column) -> Column:
    """The first paragraph as one line whose first letter is large and first word small; unchanged if there is under two characters of it."""
    first = F.regexp_extract(latex, rf"^(?:[{t.SPACE}]*\n)*((?:(?![{t.SPACE}]*(?:\n|\z)|[{t.SPACE}]*\\scenebreak)[^\n]*(?:\n|\z))+)", 1)
    head = F.regexp_extract(latex, rf"^((?:[{t.SPACE}]*\n)*)", 1)
    para = F.replace(F.regexp_replace(first, r"\n\z", ""), F.lit("\n"), F.lit(" "))
    after = F.substr(para, F.lit(2))
    space = F.instr(after, " ")
    word = F.when(space > 1, F.substring(after, F.lit(1), space - 1)).otherwise(after)
    rest_of_para = F.when(space > 1, F.substr(after, space)).otherwise("")
    # a paragraph that no blank line or rule ends is not taken off: it follows once more
    ended = (F.length(head) + F.length(first) < F.length(latex)) | first.endswith("\n")
    rest = F.substr(latex, F.length(head) + 1 + F.when(ended, F.length(first)).otherwise(0))
    made = F.concat(F.lit("\\lettrine[lines=2, lhang=0.1, nindent=0.2em]{"), F.substring(para, 1, 1), F.lit("}{"), word, F.lit("}"), rest_of_para, F.lit("\n\n"), rest)
    return F.when(F.length(para) < 2, latex).otherwise(made)


def chapter_latex(text: Column) -> Column:
    """A chapter as LaTeX: its subtitle (or label) as title, then the body with a drop cap."""
    whole = t.strip(text)
    name = t.split_title(t.title_line(whole))
    body = t.strip(F.regexp_replace(whole, r"^[^\n]*\n?", ""))
    title = F.when(name["subtitle"] != "", name["subtitle"]).otherwise(name["label"])
    return F.concat(F.lit("\\chapter{"), latex_escape(title), F.lit("}\n\n"), drop_cap(md_to_latex(body)), F.lit("\n"))


def manuscript(chapters: DataFrame, n_col: str, text_col: str, keys: list[str] | None = None) -> DataFrame:
    """chapters, words, text: stripped chapters that aren't blank, in order, with rules between. One manuscript is one value; keys make several."""
    rows = chapters.select(*(keys or []), F.col(n_col).alias("n"), t.strip(t.blank_if_null(F.col(text_col))).alias("t")).filter("t <> ''")
    grouped = rows.groupBy(*(keys or [])).agg(F.count("*").alias("chapters"), F.sum(t.word_count(F.col("t")).cast("bigint")).alias("words"), F.array_sort(F.collect_list(F.struct("n", "t"))).alias("_all"))
    return grouped.select(*(keys or []), "chapters", "words", F.concat(F.array_join(F.transform("_all", lambda x: x["t"]), "\n\n---\n\n"), F.lit("\n")).alias("text"))


def key_passages(text: Column, words: int = 150, least: int = 20, top: int = 3) -> Column:
    """struct<opening, closing, dialogue>: first and last words, and the longest quotations, the earlier of equally long ones first."""
    quotes = F.regexp_extract_all(text, F.lit(rf'"([^"]{{{least},}})"'), F.lit(1))
    indexed = F.transform(quotes, lambda q, i: F.struct((-F.length(q)).alias("n"), i.alias("i"), q.alias("q")))
    return F.struct(t.head_words(text, words).alias("opening"), t.tail_words(text, words).alias("closing"), F.transform(F.slice(F.array_sort(indexed), 1, top), lambda x: x["q"]).alias("dialogue"))


def arc_block(n: Column, words: Column, summary: Column, passages: Column) -> Column:
    """One chapter's block of an arc summary, as Markdown."""
    quotes = F.array_join(F.transform(passages["dialogue"], lambda d: F.concat(F.lit('> "'), d, F.lit('"\n\n'))), "")
    return F.concat(F.lit("### Chapter "), n, F.lit(" ("), words, F.lit(" words)\n**Summary:** "), summary, F.lit("\n\n**Opening:** "), passages["opening"], F.lit("...\n\n**Closing:** ..."), passages["closing"], F.lit("\n\n**Key dialogue:**\n"), quotes)


def ledger_line(thread: Column, planted: Column, harvested: Column) -> Column:
    """One row of a ledger table, as Markdown."""
    told = lambda c: F.array_join(F.transform(c, lambda n: F.concat(F.lit("Ch "), n)), ", ")
    return F.concat(F.lit("| "), thread, F.lit(" | "), told(planted), F.lit(" | "), told(harvested), F.lit(" |"))


def arc_summary(blocks: DataFrame, title: Column, premise: Column, keys: list[str] | None = None) -> DataFrame:
    """chapters, words, text: blocks (n, words, block) in order behind a heading and the premise, with rules between. Keys make several documents.

    title and premise are made of the keys. A document is one value.
    """
    grouped = blocks.groupBy(*(keys or [])).agg(F.count("*").alias("chapters"), F.coalesce(F.sum(F.col("words").cast("bigint")), F.lit(0)).alias("words"), F.array_sort(F.collect_list(F.struct("n", "words", "block"))).alias("_all"))
    head = F.concat(
        F.lit("# "), title, F.lit("\n## Full-Arc Summary for Reader Panel\n\nThis document contains chapter summaries, opening/closing passages,\nand key dialogue for all "), F.col("chapters").cast("string"),
        F.lit(" chapters. Total novel: "), F.format_number("words", 0), F.lit(" words.\n\nPREMISE: "), premise, F.lit("\n\n---\n\n"),
    )
    return grouped.select(*(keys or []), "chapters", "words", F.concat(head, F.array_join(F.transform("_all", lambda x: x["block"]), "\n---\n\n")).alias("text"))


def outline_block() -> Column:
    """One entry of an outline, as Markdown; what it lacks is N/A, lists that are empty or null are left out."""
    told = lambda c: F.coalesce(F.col(c), F.lit("N/A"))
    listed = lambda c, mark: F.array_join(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.concat(F.lit(mark), x, F.lit("\n"))), "")
    titled = lambda c, name: F.when(F.size(c) > 0, F.concat(F.lit(f"**{name}:**\n"), listed(c, "- "), F.lit("\n"))).otherwise("")
    return F.concat(
        F.lit("### Ch "), F.col("num").cast("string"), F.lit(": "), told("title"), F.lit("\n**"), F.coalesce("words", F.lit(0)).cast("string"), F.lit(" words** | **Location:** "), told("location"),
        F.lit("\n- **Characters:** "), F.coalesce(F.array_join("characters", ", "), F.lit("")), F.lit("\n- **Try-fail cycle:** "), told("try_fail"), F.lit("\n- **Emotional arc:** "), told("emotional_arc"),
        F.lit("\n\n**Summary:** "), told("summary"), F.lit("\n\n**Beats:**\n"), listed("beats", "1. "), F.lit("\n"), titled("plants", "Plants"), titled("harvests", "Harvests"),
        F.lit("**Chapter question:** "), told("chapter_question"), F.lit("\n\n---\n\n"),
    )


def outline_document(entries: DataFrame, title: Column, cycle: Column) -> DataFrame:
    """One row: an outline's entries (num, title, words, location, characters, try_fail, emotional_arc, summary, beats, plants, harvests, chapter_question) by number, and the ledger of their threads by name."""
    blocks = entries.select("num", F.coalesce("words", F.lit(0)).cast("bigint").alias("words"), outline_block().alias("block"))
    body = blocks.agg(F.count("*").alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("num", "block"))), lambda x: x["block"]), "").alias("body"))
    lines = feedback.ledger(entries).select("thread", F.concat(ledger_line(F.col("thread"), F.col("planted"), F.col("harvested")), F.lit("\n")).alias("line"))
    table = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("thread", "line"))), lambda x: x["line"]), "").alias("ledger"))
    return body.crossJoin(table).select(F.concat(
        F.lit("# "), title, F.lit("\n## Chapter Outline (reflects actual novel as-written)\n\n**"), F.col("n").cast("string"), F.lit(" chapters, "), F.format_number("words", 0), F.lit(" words**\n\n---\n\n"), F.col("body"),
        F.lit("## FORESHADOWING LEDGER\n\n| Thread | Planted | Harvested |\n|--------|---------|-----------|\n"), F.col("ledger"), F.lit("\n---\n\n*Outline rebuilt from actual chapters, Cycle "), cycle.cast("string"), F.lit(".*"),
    ).alias("text"))
