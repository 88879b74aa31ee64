"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

A word's symbols stand in a doubly linked list. A heap holds adjacent pairs by
rank and then place; the lowest is popped and merged until no pair has a rank.
The count is the number of initial symbols minus the number of merges. Time is
n log n in the length of a word, however long. Counts of words that repeat are
remembered, up to a bound.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosaic.llm.scratch import bounded_batches

LIMIT = 2048
#: Words remembered by one worker (about 150 bytes each), and the longest of them.
MEMORY = 400_000
MEMORY_CHARS = 48
_PLACE = (1 << 32) - 1


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PairMerger:
    """Counts the symbols that are left of a word after all merges."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        letters = byte_letters()
        self.inner = [vocabulary[c] for c in letters]
        self.final = [vocabulary[c + suffix] for c in letters]
        self.rank: dict[int, int] = {}
        self.made: dict[int, int] = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            key = vocabulary[a] << 24 | vocabulary[b]
            if key not in self.rank:
                self.rank[key], self.made[key] = rank, vocabulary[a + b]

    def count(self, word: bytes) -> int:
        n = len(word)
        if n < 2:
            return n
        inner, rank, made = self.inner, self.rank, self.made
        symbol = [inner[b] for b in word]
        symbol[-1] = self.final[word[-1]]
        heap = []
        for i in range(n - 1):
            r = rank.get(symbol[i] << 24 | symbol[i + 1])
            if r is not None:
                heap.append(r << 32 | i)
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            top = heapq.heappop(heap)
            i = top & _PLACE
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            key = symbol[i] << 24 | symbol[j]
            if rank.get(key) != top >> 32:  # one of the two has been merged since
                continue
            symbol[i], symbol[j] = made[key], -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(symbol[i] << 24 | symbol[k])
                if r is not None:
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = rank.get(symbol[h] << 24 | symbol[i])
                if r is not None:
                    heapq.heappush(heap, r << 32 | h)
        return n - merges


class _Memory(dict):
    def __init__(self, merger: PairMerger):
        super().__init__()
        self.merger = merger

    def __missing__(self, word: str) -> int:
        n = self.merger.count(word.encode())
        if len(word) <= MEMORY_CHARS:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = n
        return n


class Counter:
    """Counts as the library does for a lower-casing word BPE file: its normalisation, splitting and special strings.

    Which characters are letters, and how they are composed and lower-cased, depends
    on the version of Unicode that the library was built with. Texts beyond Latin-1
    are therefore normalised and split by the library itself; the merging is done here.
    """

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.memory = _Memory(PairMerger(model["vocab"], model["merges"], model["end_of_word_suffix"] or ""))
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.normalise = Tokenizer.from_file(path).normalizer.normalize_str
        self.split = pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True).pre_tokenize_str
        # Latin-1 doesn't change with the version of Unicode, and has nothing to compose
        letters, numbers, spaces = "a-zA-ZªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\x09-\x0d \x85\xa0"
        latin = pattern.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]")
        self.latin = re.compile(latin.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]"))
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None

    def _plain(self, text: str) -> int:
        try:
            text.encode("latin-1")
            words = self.latin.findall(text.lower())
        except UnicodeEncodeError:
            words = [word for word, _ in self.split(self.normalise(text))]
        return sum(map(self.memory.__getitem__, words))

    def count(self, text: str) -> int:
        if self.special is None or "<|" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit. Rows don't move.

    Null texts count as empty: no bytes, no tokens. Null ids and repeated rows are
    passed through; an empty table gives an empty table; other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(path)
        for part in texts:
            yield pd.Series([counter.count(t) for t in part], dtype="int64")

    n_tokens = F.pandas_udf(run, "long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_text")).withColumn("n_tokens", n_tokens("_text"))
    return rows.select(id_col, F.octet_length("_text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
