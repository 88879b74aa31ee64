"""Benchmark decontamination with an FM-index for each training shard.

A shard is a slice of an Arrow batch, about 2 MB of text. Words that no test
phrase has cannot be in a match: they part the shard's text, and stretches
between them shorter than the shortest phrase are left out of the index. Every
window of the benchmark is then found by backward search, located through the
sampled suffix positions, and the found spans are merged. Documents are not
shuffled.

The benchmark is collected in blocks of at most ``block_bytes`` of text. A larger
one takes several passes, one after the other: the documents with what was found
are saved in between, so that neither the driver nor a worker holds two blocks.

Words that no phrase of a block has are left out of that block's index because no
match can hold them; what is indexed is searched by the index alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosaic.llm import bytewords
from prosaic.llm.fm_index import FMIndex
from prosaic.llm.scratch import Scratch, bounded_batches

WINDOW = 13
#: Of phrases in one pass: their windows take about ten times as much in each worker.
BLOCK_BYTES = 4 << 20
_OWN = {"_words": T.LongType(), "_spans": T.ArrayType(T.LongType()), "_items": T.ArrayType(T.StringType())}


class Phrases:
    """All windows of a block of test items, as numbers of words; the same window of several items is kept once."""

    def __init__(self, ids: list, texts: pa.Array, window: int):
        self.names = sorted({"" if i is None else str(i) for i in ids})
        number = {x: k for k, x in enumerate(self.names)}
        hashes, at = bytewords.words(*bytewords.utf8(texts))
        self.vocabulary, codes = np.unique(hashes, return_inverse=True)
        found: dict[int, dict[bytes, set[int]]] = {}
        codes = codes.astype(np.int32)
        for k, item in enumerate(ids):
            own = codes[at[k] : at[k + 1]]
            width = min(window, len(own))
            for i in range(len(own) - width + 1 if width else 0):
                found.setdefault(width, {}).setdefault(own[i : i + width].tobytes(), set()).add(number["" if item is None else str(item)])
        #: For each width: windows, one a row, and items of each window as (window, item) pairs.
        self.windows = []
        for width, of in sorted(found.items()):
            rows = np.frombuffer(b"".join(of), np.int32).reshape(-1, width)
            pairs = [(w, i) for w, items in enumerate(of.values()) for i in sorted(items)]
            own = np.array(pairs, np.int64)
            self.windows.append((width, rows, own[:, 1], np.searchsorted(own[:, 0], np.arange(len(rows) + 1))))
        self.least = min((w for w, *_ in self.windows), default=0)

    def find(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """In a shard's words: which are hit, and (document, item) pairs."""
        hit, none = np.zeros(len(hashes), bool), np.zeros(0, np.int64)
        if not self.least or len(hashes) < self.least:
            return hit, none, none
        code = np.searchsorted(self.vocabulary, hashes)
        code[code == len(self.vocabulary)] = 0
        known = self.vocabulary[code] == hashes
        # stretches of known words within one document
        first = known.copy()
        first[1:] &= ~known[:-1]
        edges = at[1:-1][at[1:-1] < len(hashes)]
        first[edges] = known[edges]
        begin = np.flatnonzero(first)
        where = np.flatnonzero(known)
        length = np.diff(np.append(np.searchsorted(where, begin), len(where)))
        begin, length = begin[length >= self.least], length[length >= self.least]
        if not len(begin):
            return hit, none, none
        # the indexed text: stretches, each followed by a barrier
        barrier, total = len(self.vocabulary), int(length.sum() + len(length))
        head = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
        source = np.repeat(begin - head, length + 1) + np.arange(total)
        text = np.full(total, barrier, np.int64)
        inner = np.ones(total, bool)
        inner[head + length] = False
        text[inner] = code[source[inner]]
        index = FMIndex(text, barrier + 1)
        present = np.zeros(barrier + 1, bool)
        present[text] = True
        delta, docs, items = np.zeros(len(hashes) + 1, np.int64), [], []
        for width, rows, owner, first_owner in self.windows:
            asked = np.flatnonzero(present[rows].all(1))  # a window with a word that the shard lacks can't occur
            low, high = index.search(rows[asked])
            count = high - low
            if not count.any():
                continue
            which = np.repeat(asked, count)
            suffix = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            position = source[index.locate(suffix)]
            np.add.at(delta, position, 1)
            np.add.at(delta, position + width, -1)
            doc = np.searchsorted(at, position, "right") - 1
            pair = np.unique(np.stack([doc, which]), axis=1)
            own = first_owner[pair[1] + 1] - first_owner[pair[1]]
            docs.append(np.repeat(pair[0], own))
            items.append(owner[np.repeat(first_owner[pair[1]] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))])
        hit = np.cumsum(delta[:-1]) > 0
        if not docs:
            return hit, none, none
        pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)]), axis=1)
        return hit, pairs[0], pairs[1]


def _runs(hit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans of hit words within documents: document, first word, end, counted from the document's first."""
    edge = np.zeros(len(hit) + 1, bool)
    edge[at[:-1]] = True
    first = hit.copy()
    first[1:] &= ~hit[:-1] | edge[1 : len(hit)]
    last = hit.copy()
    last[:-1] &= ~hit[1:] | edge[1 : len(hit)]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(at, begin, "right") - 1
    return doc, begin - at[doc], end - at[doc]


def _merged(flat: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(flat[::2], flat[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _pass(phrases: Phrases, text_at: int, later: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = bytewords.utf8(batch.column(text_at))
            count, spans, items = [], [], []
            for i, j in bytewords.slices(at):
                hashes, first = bytewords.words(body[at[i] : at[j]], at[i : j + 1] - at[i])
                hit, doc, item = phrases.find(hashes, first)
                count.append(np.diff(first))
                own: list[list[int]] = [[] for _ in range(j - i)]
                if hit.any():
                    for d, a, b in zip(*(x.tolist() for x in _runs(hit, first))):
                        own[d] += [a, b]
                named: list[list[str]] = [[] for _ in range(j - i)]
                for d, k in zip(doc.tolist(), item.tolist()):
                    named[d].append(phrases.names[k])
                spans += own
                items += named
            columns = list(batch.columns)
            if later:
                spans = [_merged(a + b) if a and b else a or b for a, b in zip(columns[-2].to_pylist(), spans)]
                items = [sorted({*a, *b}) for a, b in zip(columns[-1].to_pylist(), items)]
                columns = columns[:-3]
            counts = np.concatenate(count) if count else np.zeros(0, np.int64)
            columns += [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    return run


def blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Phrases]:
    """The benchmark's windows, block by block; each has about block_bytes of text at most, or one item."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        table = (rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)).toArrow()
        yield Phrases(table.column("item").to_pylist(), table.column("text"), window)


def hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with _words, _spans (first word, end, first word, ...: merged and in order) and _items (sorted) added."""
    spark = docs.sparkSession
    bounded_batches(spark)
    out, scratch = docs, Scratch(spark, "decontaminate")
    for k, phrases in enumerate(blocks(benchmark, item_col, item_text_col, window, block_bytes)):
        if k:
            out = scratch.save(out, f"block-{k}")  # the pass before is done and its phrases are gone
            if k > 1:
                scratch.drop(f"block-{k - 1}")
        fields = [*docs.schema.fields, *[T.StructField(n, t) for n, t in _OWN.items()]]
        names = [f"c{i}" for i in range(len(fields))]  # columns may clash in name; they are passed on by place
        held = [T.StructField(n, f.dataType) for n, f in zip(names, fields)]
        renamed = out.toDF(*[f"c{i}" for i in range(len(out.columns))])
        out = renamed.mapInArrow(_pass(phrases, docs.columns.index(text_col), k > 0), T.StructType(held))
    return out.toDF(*docs.columns, *_OWN)


def _hit() -> "F.Column":
    return F.aggregate(F.transform("_spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def _contaminated() -> "F.Column":
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("_words"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    Null and empty texts have no words and are clean. A null id is passed through;
    an item without id counts under an empty id; items that repeat an id count
    once; an empty benchmark hits nothing; an empty table gives an empty table.
    spans: pairs of first word and end, merged.
    """
    found = hits(docs.select(id_col, text_col), benchmark, text_col, **options).withColumn("n_hit", _hit())
    return found.select(
        id_col, F.col("_words").alias("n_words"), "n_hit", F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"), _contaminated().alias("contaminated"), F.col("_spans").alias("spans")
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without contaminated rows; all columns stay.

    Null and empty texts are clean; repeated rows are judged alike; an empty benchmark
    or table changes nothing.
    """
    found = hits(docs, benchmark, text_col, **options).withColumn("n_hit", _hit())
    return found.filter(~_contaminated()).select(docs.columns)



def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM v),
x AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS t FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
h AS (SELECT r, item_id, i, k FROM x JOIN v USING (k, t)),
p AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM h) GROUP BY 1),
n AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN n USING (r)
"""
