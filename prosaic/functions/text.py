"""Text primitives with one definition of white space, stripping and pattern flags.

White space is Unicode's plus the four ASCII separators; patterns see Unicode
letters, ignore case by Unicode rules and end lines at ``\\n`` only.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A class of white space without its brackets, for Java patterns.
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
WS = f"[{SPACE}]+"
NOT_WS = f"[^{SPACE}]+"
#: The same characters, for trimming.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: What is trimmed off a token before it is compared; the second set also has dashes.
MARKS = ".,;:!?\"'()"
MARKS_AND_DASHES = MARKS + "—-–"
SENTENCE_END = "[.!?]+"


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(_SPACES))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({NOT_WS})"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NOT_WS))


def has_space(word: str) -> bool:
    return any(c in _SPACES for c in word)


def trim_marks(token: Column, marks: str = MARKS) -> Column:
    return F.btrim(token, F.lit(marks))


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, WS, " "))


def paragraphs(text: Column, separator: Column | str = "\n\n") -> Column:
    """Stripped, non-empty parts between separators; the separator is literal and may be a column."""
    sep = separator if isinstance(separator, Column) else F.lit(separator)
    parts = F.transform(F.split(text, sep), strip)
    return F.filter(parts, lambda p: p != "")


def prose_paragraphs(text: Column, separator: Column | str = "\n\n") -> Column:
    """paragraphs() without headings and rules."""
    return F.filter(paragraphs(text, separator), lambda p: ~p.startswith("#") & (p != "---"))


def sentences(text: Column) -> Column:
    """Stripped parts between runs of sentence ends that have more than two tokens."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda s: word_count(s) > 2)


def sentence_lengths(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), word_count), lambda n: n > 2)


def flagged(pattern: str, multiline: bool = False) -> str:
    """A pattern with the flags that make it match as the packs mean it."""
    return f"(?iuUd{'m' if multiline else ''})" + pattern.replace(r"\s", f"[{SPACE}]")


def count_pattern(text: Column, pattern: str, multiline: bool = False) -> Column:
    return F.regexp_count(text, F.lit(flagged(pattern, multiline)))


def _needed(parsed) -> list[str]:
    """Literals of which any match has one, in lower case: those of the best stretch of a parsed pattern; empty if none is sure."""
    found: list[list[str]] = []
    run = ""
    for kind, value in [*parsed, (None, None)]:
        if str(kind) == "LITERAL":
            run += chr(value).lower()
            continue
        if run:
            found.append([run])
            run = ""
        if str(kind) == "SUBPATTERN":
            found.append(_needed(value[3]))
        elif str(kind) == "MAX_REPEAT" and value[0] > 0:
            found.append(_needed(value[2]))
        elif str(kind) == "BRANCH":
            each = [_needed(x) for x in value[1]]
            found.append([w for x in each for w in x] if all(each) else [])
    return max(filter(None, found), key=lambda ws: (min(map(len, ws)), sum(map(len, ws)) / len(ws)), default=[])


@lru_cache(maxsize=None)
def anchors(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which a text that matches, ignoring case, has at least one."""
    return tuple(dict.fromkeys(_needed(_parser.parse(pattern))))


#: Letters that match an ASCII letter when case is ignored, but don't lower to it.
_ODD_CASE = "[ſKİı]"


def odd_case(text: Column) -> Column:
    return F.rlike(text, F.lit(_ODD_CASE))


def count_patterns(text: Column, lowered: Column, odd: Column, patterns: list[str], multiline: bool = False) -> Column:
    """All matches of all patterns. A pattern runs only over texts that have one of its literals in lower case, or odd_case() letters."""

    def one(p: str) -> Column:
        n = count_pattern(text, p, multiline)
        tests = [lowered.contains(w) for w in anchors(p)]
        return F.when(reduce(lambda a, b: a | b, tests, odd), n).otherwise(0) if tests else n

    return total([one(p) for p in patterns])


def count_literal(text: Column, literal: str) -> Column:
    """Occurrences that don't overlap, from the left."""
    return F.regexp_count(text, F.lit(r"\Q" + literal + r"\E"))


def quoted(value: Column) -> Column:
    """A pattern that matches the value literally."""
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _trie(words: list[str]) -> str:
    """One pattern for all words, branching by first letter."""
    ends = "" in words
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    parts = []
    for head, rest in sorted(heads.items()):
        own = f"\\{head}" if not head.isalnum() else head
        parts.append(own + (_trie(rest) if rest != [""] else ""))
    body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
    return f"(?:{body})?" if ends and parts else body


def lexicon_pattern(words: list[str], marks: str = MARKS) -> str:
    """Matches, as group 1, tokens that equal one of the words once marks are trimmed off. For lower-cased text.

    One pass over the text, whatever the number of words; only hits are materialised.
    """
    edge = "[" + "".join(f"\\{c}" if not c.isalnum() else c for c in marks) + "]*"
    return f"(?<![^{SPACE}]){edge}({_trie(sorted(set(words)))}){edge}(?![^{SPACE}])"


def lexicon_hits(text: Column, words: list[str], marks: str = MARKS) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(lexicon_pattern(words, marks)), F.lit(1))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def truncate(text: Column, n: int) -> Column:
    """The first n characters and an ellipsis, if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def head_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(tokens(text), 1, n), " ")


def tail_words(text: Column, n: int) -> Column:
    t = tokens(text)
    return F.array_join(F.slice(t, F.greatest(F.size(t) - n + 1, F.lit(1)), n), " ")


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def strip_fences(text: Column) -> Column:
    """Without a Markdown code fence around the text."""
    bare = strip(text)
    opened = F.regexp_replace(F.regexp_replace(bare, r"(?U)^```\w*\n?", ""), r"\n?```\z", "")
    return F.when(bare.startswith("```"), opened).otherwise(bare)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"(?d)\[.*?\]", "")


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def title_line(text: Column) -> Column:
    """The first line without leading hashes and spaces."""
    return strip(F.ltrim(first_line(text), F.lit("# ")))


def split_title(line: Column) -> Column:
    """label and subtitle at the first ': '; without one the subtitle is empty."""
    at = F.instr(line, ": ")
    return F.struct(F.when(at > 0, F.substring(line, F.lit(1), at - 1)).otherwise(line).alias("label"), F.when(at > 0, F.substr(line, at + 2)).otherwise("").alias("subtitle"))


def chapter_title(text: Column) -> Column:
    """The first heading's title, without hashes and a 'Chapter N' prefix; 'Untitled' without one."""
    heading = F.get(F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda s: s.startswith("#")), F.lit(0))
    bare = F.regexp_replace(heading, f"^#+[{SPACE}]*", "")
    title = strip(F.regexp_replace(bare, f"(?iu)^Chapter[{SPACE}]+(?:[0-9]+|[A-Z][a-z]+(?:-[A-Z][a-z]+)*)[{SPACE}]*[:—–-]*[{SPACE}]*", ""))
    return F.when(F.coalesce(title, F.lit("")) == "", "Untitled").otherwise(title)
