"""Language identification by Bayesian evidence fusion.

Three kinds of evidence are multiplied: the likelihood of the text under byte
trigram models, the declared markup language and the address suffix (each
trusted as far as a reliability says), and a prior of the host. Host priors are
grouped sums of the texts' own posteriors, smoothed towards the registered
domain, that towards the address suffix, and that towards all rows; a row's own
posterior is taken out of its host's sums.

The trigram models are fitted on a bounded sample of labelled texts
(``sample_rows``), an equal quota of each language that any row is labelled
with; host statistics cover all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosaic.llm import bytewords
from prosaic.llm.scratch import Scratch, bounded_batches

SAMPLE_ROWS = 4000
#: How often a declared language, or the language of a national suffix, is right.
DECLARED_TRUST = 0.9
SUFFIX_TRUST = 0.8
#: Rows' worth of weight that each level's prior has over the level below it.
SMOOTHING = 8.0
#: Trigrams of one text are not independent; their log-likelihood counts this much, and as at most so many trigrams.
TEMPER, MOST = 0.25, 80.0
BROADCAST_ROWS = 200_000

#: The language that most pages under a national suffix are in, for suffixes of one main language.
SUFFIX_LANGUAGE = {
    **dict.fromkeys(("uk", "us", "au", "ie", "nz"), "en"),
    **dict.fromkeys(("de", "at", "li"), "de"),
    **dict.fromkeys(("fr", "mc", "re"), "fr"),
    **dict.fromkeys(("es", "mx", "ar", "cl", "pe", "uy", "ve", "bo", "ec", "py", "cr", "gt", "hn", "ni", "sv", "pa", "do", "cu"), "es"),
    **dict.fromkeys(("pt", "br"), "pt"), **dict.fromkeys(("it", "sm", "va"), "it"),
    "nl": "nl", "pl": "pl", "se": "sv", "dk": "da", "no": "no", "fi": "fi", "cz": "cs", "sk": "sk", "hu": "hu", "ro": "ro", "bg": "bg", "gr": "el",
    "ru": "ru", "ua": "uk", "tr": "tr", "jp": "ja", "kr": "ko", "cn": "zh", "tw": "zh", "vn": "vi", "th": "th", "id": "id", "ir": "fa", "il": "he",
}
#: Labels under which national registries give out names, so that a domain there has three labels (co.uk, com.au, ac.jp).
REGISTRY_LABELS = ("ac", "asn", "co", "com", "ed", "edu", "gen", "go", "gob", "gouv", "gov", "govt", "ind", "info", "judiciary", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "police", "sch", "web")

# bytes fall into 64 classes: letters (cases joined), digits, space, marks, and bytes above 127
_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _l = int(bytewords.LOWER[_b])
    if 97 <= _l <= 122:
        _CLASS[_b] = 1 + _l - 97
    elif 48 <= _b <= 57:
        _CLASS[_b] = 27
    elif _b >= 128:
        _CLASS[_b] = 29 + _b % 35
    elif _b not in (9, 10, 11, 12, 13, 32):
        _CLASS[_b] = 28
#: Classes that say something of a language.
_SAYS = np.array([1 <= c <= 26 or c >= 29 for c in range(64)])
CELLS = 64**3


def _trigrams(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all trigrams with a letter in the middle, and the text each is of."""
    c = _CLASS[body]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cell = (c[:-2] * 64 + c[1:-1]) * 64 + c[2:]
    use = np.flatnonzero(_SAYS[c[1:-1]])
    doc = np.searchsorted(at, use, "right") - 1
    inner = use + 2 < at[doc + 1]
    return cell[use[inner]], doc[inner]


class Model:
    """Log-probabilities of trigrams in each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smoothed = counts + 0.5
        self.log = np.log(smoothed / smoothed.sum(1, keepdims=True)).astype(np.float32)

    def posterior(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods (tempered, the best of each text is 0), and numbers of trigrams."""
        body, at = bytewords.utf8(texts)
        out, number = np.zeros((len(at) - 1, len(self.languages))), np.zeros(len(at) - 1, np.int64)
        for i, j in bytewords.slices(at):
            cell, doc = _trigrams(body[at[i] : at[j]], at[i : j + 1] - at[i])
            number[i:j] = np.bincount(doc, minlength=j - i)
            for k in range(len(self.languages)):
                out[i:j, k] = np.bincount(doc, weights=self.log[k][cell], minlength=j - i)
        out *= (TEMPER * np.minimum(1, MOST / np.maximum(number, 1)))[:, None]
        return out - out.max(1, keepdims=True, initial=-np.inf) if len(out) and out.shape[1] else out, number


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits trigram models on about sample_rows different texts with a label, an equal quota of each language.

    Every label with a trigram in some text gets a model; a language of fewer texts than its quota
    gives them all. Texts are drawn by their hash, and copies count once.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    texts = {r["lang"]: r["n"] for r in rows.select("lang", "hash").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    quota = -(-sample_rows // max(1, len(texts)))
    bounds = [x for lang, n in texts.items() for x in (F.lit(lang), F.lit(-(-quota * (1 << 30) // max(n, quota))))]
    drawn = rows.filter(F.pmod("hash", F.lit(1 << 30)) < F.element_at(F.create_map(*bounds), F.col("lang"))) if texts else rows
    sample = drawn.groupBy("lang", "hash").agg(F.first("text").alias("text")).select("text", "lang")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            body, at = bytewords.utf8(batch.column(0))
            langs = np.array(batch.column(1).to_pylist(), object)
            for i, j in bytewords.slices(at):
                cell, doc = _trigrams(body[at[i] : at[j]], at[i : j + 1] - at[i])
                for lang in set(langs[i:j]):
                    own = cell[langs[i:j][doc] == lang]
                    held[lang] = held.get(lang, 0) + np.bincount(own, minlength=CELLS)
        for lang, n in held.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], names=["lang", "cell", "n"])

    # at most CELLS rows a language come back
    table = sample.mapInArrow(counted, "lang string, cell bigint, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    langs = table.column("lang").to_pylist()
    languages = sorted(set(langs))
    counts = np.zeros((len(languages), CELLS))
    if languages:
        row = np.searchsorted(np.array(languages, object).astype(str), np.array(langs, object).astype(str))
        counts[row, table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return Model(languages, counts)


def _shares(logs: np.ndarray) -> np.ndarray:
    """Rows of probabilities from rows of log-likelihoods."""
    if not logs.shape[1]:
        return logs
    e = np.exp(logs - logs.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


_OPENS = re.compile(r"<(!--|(?:script|style)\b)", re.I | re.A)
_CLOSES = {"!--": re.compile("-->"), "script": re.compile(r"</script\s*>", re.I | re.A), "style": re.compile(r"</style\s*>", re.I | re.A), "": re.compile(">")}
_REFERENCE = re.compile(r"&#?[A-Za-z0-9]{1,8};")


def shown(html: str) -> str:
    """What a page shows: a space stands for each script, style, comment, tag and character reference.

    One pass, however broken the page: an end that was looked for in vain isn't
    looked for again. A script, style or comment that never ends counts as a tag,
    and a tag that never ends as text.
    """
    out, at, missing = [], 0, set()
    while (k := html.find("<", at)) >= 0:
        opened = _OPENS.match(html, k)
        kind, start, end = opened[1].lower() if opened else "", opened.end() if opened else k + 1, None
        if kind and kind not in missing:
            end = _CLOSES[kind].search(html, start)
            if end is None:
                missing.add(kind)
        end = end or _CLOSES[""].search(html, k)
        if end is None:
            break  # nothing is closed any more
        out.append(html[at:k])
        at = end.end()
    out.append(html[at:])
    return _REFERENCE.sub(" ", " ".join(out))


def _texts(column: pa.Array, html: bool) -> pa.Array:
    return pa.array([shown(x or "") for x in column.to_pylist()], pa.large_string()) if html else column


def _host_sums(model: Model, html: bool):
    """host, domain, suffix, text -> host, domain, suffix and the sums of the texts' posteriors; one row a host and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(model.languages)
        for batch in batches:
            logs, number = model.posterior(_texts(batch.column(3), html))
            own = _shares(logs) * (number > 0)[:, None]
            places: dict[tuple, int] = {}
            at = np.array([places.setdefault(k, len(places)) for k in zip(*(batch.column(c).to_pylist() for c in range(3)))], np.int64)
            sums = [np.bincount(at, weights=own[:, k], minlength=len(places)) for k in range(n)]
            keys = list(places)
            yield pa.RecordBatch.from_arrays([*(pa.array([x[c] for x in keys], pa.string()) for c in range(3)), *map(pa.array, sums)], names=["host", "domain", "suffix", *[f"s{k}" for k in range(n)]])

    return run


def _said(languages: list[str], said: list, trust: float) -> np.ndarray:
    """Log-likelihoods of declarations; one that is missing or names another language says nothing."""
    out = np.zeros((len(said), len(languages)))
    place = {x: k for k, x in enumerate(languages)}
    other = np.log(max((1 - trust) / max(1, len(languages) - 1), 1e-9))
    for i, x in enumerate(said):
        if x in place:
            out[i] = other
            out[i, place[x]] = np.log(trust)
    return out


def _fuse(model: Model, carried: int, text_at: int, keep: float | None, languages: tuple[str, ...] | None, html: bool):
    """Carried columns, declared, suffix, text (or the carried text), domain prior, host sums -> the carried columns and what was found, or, with keep, only them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(model.languages)
        names = np.array([*model.languages, None], object)
        for batch in batches:
            columns = batch.columns
            logs, number = model.posterior(_texts(columns[text_at], html))
            rest = columns[carried:]
            own = _shares(logs) * (number > 0)[:, None]
            domain, sums = (np.array(c.to_pylist(), float).reshape(batch.num_rows, n) for c in rest[-2:])
            left = np.maximum(sums - own, 0)
            prior = (left + SMOOTHING * domain) / (left.sum(1, keepdims=True) + SMOOTHING)
            suffix = [SUFFIX_LANGUAGE.get(x) for x in rest[1].to_pylist()]
            found = _shares(np.log(prior) + logs + _said(model.languages, rest[0].to_pylist(), DECLARED_TRUST) + _said(model.languages, suffix, SUFFIX_TRUST))
            sure = found.max(1, initial=0.0)
            best = names[found.argmax(1)] if n else np.full(batch.num_rows, None)
            if keep is not None:
                rows = pa.array((sure >= keep) & (True if languages is None else np.isin(best.astype(str), languages)), pa.bool_())
                yield pa.RecordBatch.from_arrays([c.filter(rows) for c in columns[:carried]], names=[f"c{i}" for i in range(carried)])
                continue
            by_text = np.where(number > 0, names[logs.argmax(1)], None) if n else np.full(batch.num_rows, None)
            added = [pa.array(best.tolist(), pa.string()), pa.array(sure), pa.array(found.tolist(), pa.list_(pa.float64())), pa.array(by_text.tolist(), pa.string()), pa.array(number)]
            yield pa.RecordBatch.from_arrays([*columns[:carried], *added], names=[f"c{i}" for i in range(carried + len(added))])

    return run


def identify(rows: DataFrame, model: Model, text: Column | None, declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, carry: tuple[str, ...] = (), carried_text: str | None = None, keep: float | None = None, languages: tuple[str, ...] | None = None, html: bool = False) -> DataFrame:
    """carry columns, language, confidence, posterior (by language in order), text_language, n_trigrams.

    language is the largest posterior's, the first in alphabetical order of equal
    ones. Without any evidence (no letters, nothing declared, an unknown host) the
    posterior is the prior of all rows. Nulls in any column are missing evidence.
    Without languages (an empty labelled table) language is null and confidence 0.
    Repeated rows are scored each; an empty table gives an empty table.

    carried_text names the text among the carried columns instead of text. With
    keep, only the carried columns of rows of at least that confidence come back, and of
    those in one of the languages, if any are given. With html, the texts are web pages,
    of which what they show is scored.
    Texts are scored once for the hosts' priors and once for the rows; only sums of
    hosts are shuffled and saved.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    n = len(model.languages)
    low = lambda c: F.coalesce(F.lower(c if c is not None else F.lit(None).cast("string")), F.lit(""))
    text = F.col(carried_text) if carried_text else text.cast("string")
    labels = F.split(low(host), r"\.")
    # the registered domain: two labels, or three under a national registry's own labels
    second, last = F.coalesce(F.try_element_at(labels, F.lit(-2)), F.lit("")), F.element_at(labels, -1)
    wide = F.when((F.length(last) == 2) & second.isin(*REGISTRY_LABELS), 3).otherwise(2)
    width = F.least(wide, F.size(labels))
    domain = F.concat_ws(".", F.slice(labels, F.size(labels) - width + 1, width))
    sums = [f"s{k}" for k in range(n)]

    # soft counts by host, then rolled up to domains, suffixes and all rows: only the first reads the rows
    scratch = Scratch(spark, "language")
    by = rows.select(low(host).alias("host"), domain.alias("domain"), low(suffix).alias("suffix"), text.alias("text"))
    schema = ", ".join(["host string, domain string, suffix string", *[f"{s} double" for s in sums]])
    again = [F.sum(s).alias(s) for s in sums] or [F.count("*").alias("none")]
    by_host = scratch.save(by.mapInArrow(_host_sums(model, html), schema).groupBy("host", "domain", "suffix").agg(*again), "hosts")
    whole = by_host.agg(*again).first()
    total = [float(x or 0) + 1.0 for x in whole][:n]
    mass = reduce(lambda a, b: a + b, [F.col(s) for s in sums], F.lit(0.0))

    def smoothed(level: DataFrame, key: list[str], name: str, parent: list[Column]) -> DataFrame:
        return level.select(*key, F.array(*[(F.col(s) + SMOOTHING * p) / (mass + SMOOTHING) for s, p in zip(sums, parent)]).cast("array<double>").alias(name))

    each = lambda c: [F.get(c, F.lit(k)) for k in range(n)]
    p_suffix = smoothed(by_host.groupBy("suffix").agg(*again), ["suffix"], "p_suffix", [F.lit(x / sum(total)) for x in total])
    p_domain = smoothed(by_host.groupBy("domain", "suffix").agg(*again).join(p_suffix, "suffix"), ["domain", "suffix"], "p_domain", each("p_suffix"))
    priors = by_host.join(p_domain, ["domain", "suffix"]).select(F.col("host").alias("__host"), F.col("suffix").alias("__suffix"), "p_domain", F.array(*sums).cast("array<double>").alias("sums"))
    priors = scratch.save(priors, "priors")
    small = F.broadcast(priors) if priors.count() <= BROADCAST_ROWS else priors

    parts = rows.select(*carry, F.lower(declared if declared is not None else F.lit(None).cast("string")).alias("__declared"), low(suffix).alias("__suffix"), low(host).alias("__host"), *([] if carried_text else [text.alias("__text")]))
    known = parts.join(small, ["__host", "__suffix"]).select(*carry, "__declared", "__suffix", *([] if carried_text else ["__text"]), "p_domain", "sums")
    kept = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(known.schema.fields[: len(carry)])]
    at = carry.index(carried_text) if carried_text else len(carry) + 2
    found = ("language string", "confidence double", "posterior array<double>", "text_language string", "n_trigrams bigint")
    added = [] if keep is not None else [f"c{len(carry) + i} {f.split()[1]}" for i, f in enumerate(found)]
    out = known.mapInArrow(_fuse(model, len(carry), at, keep, languages, html), ", ".join([*kept, *added]))
    return out.toDF(*carry, *([] if keep is not None else [f.split()[0] for f in found]))


def declared_language(html: Column) -> Column:
    """The first two or three letters of the html element's lang attribute, or else of a content-language or og:locale entry; null without."""

    def code(within: Column, attribute: str) -> Column:
        found = F.regexp_extract(within, rf"""(?i)\b{attribute}\s*=\s*["']?([A-Za-z]{{2,3}})""", 1)
        return F.when(found != "", found)

    # each pattern ends at the next bracket, so that broken pages take no longer than their length
    entries = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<meta\b([^<>]*)"), F.lit(1)), lambda m: F.rlike(m, F.lit("(?i)content-language|og:locale")))
    return F.coalesce(code(F.regexp_extract(html, r"(?i)<html\b([^<>]*)", 1), "lang"), code(F.get(entries, F.lit(0)), "content"))


def identify_pages(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """identify() for web pages: the declared markup language, the address's suffix and host are evidence.

    A null, empty or broken page is scored by what it shows, which may be nothing; an
    address without a host counts as the empty host.
    """
    host = F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.when(host != "", F.regexp_replace(F.lower(host), r"^www\.|\.$", ""))
    suffix = F.regexp_extract(host, r"\.([^.]+)$", 1)
    return identify(pages, model, F.col(html_col), declared_language(F.col(html_col)), host, F.when(suffix != "", suffix), (id_col,), html=True)


def identify_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """identify() for documents: the declared language and the source, as a host, are evidence."""
    return identify(docs, model, F.col(text_col), F.col(lang_col), F.col(source_col), None, (id_col,))


def keep_identified(docs: DataFrame, model: Model, confidence: float = 0.5, text_col: str = "text", languages: tuple[str, ...] | None = None) -> DataFrame:
    """docs whose text is in a language; all columns stay.

    Rows go whose text has no letter (null and empty texts among them), whose best
    language is less likely than `confidence`, or is none of `languages`, if these are
    given. Columns lang and source, where there are any, are evidence. Repeated rows
    are kept or dropped alike; an empty table gives an empty table.
    """
    carry = tuple(f"__carry{i}" for i in range(len(docs.columns)))
    renamed = docs.toDF(*carry)
    at = {c: carry[i] for i, c in enumerate(docs.columns)}
    declared = F.col(at["lang"]) if "lang" in at else None
    host = F.col(at["source"]) if "source" in at else None
    texts = renamed.filter(F.coalesce(F.rlike(at[text_col], F.lit(r"\p{L}")), F.lit(False)))
    return identify(texts, model, None, declared, host, None, carry, carried_text=at[text_col], keep=confidence, languages=languages).toDF(*docs.columns)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)
