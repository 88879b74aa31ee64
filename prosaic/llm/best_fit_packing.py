"""Packs token pieces into sequences: best-fit decreasing in partitions, certified by lower bounds.

Documents are tokenised and cut once. Pieces that fill a sequence are done. The
others are dealt into partitions of bounded size; each is packed best-fit
decreasing, and dual-feasible functions give a lower bound on its number of
bins. A partition that meets its bound is certified and final. The others keep
their full bins and exchange the documents of bins with room: these are dealt
anew over fewer partitions and packed again, until a partition meets its bound,
one partition holds all that is left, or a round saves nothing.

Within a partition the work goes by classes of equal lengths and equal room, so
it does not depend on the number of pieces beyond sorting them.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosaic.llm.scratch import Scratch, bounded_batches
from prosaic.llm.token_count import byte_letters

CAPACITY = 1024
END = 2
#: Pieces in one partition.
PART = 50_000
#: Most rounds of exchange; None goes on until one of the stops above.
ROUNDS = None
#: How byte-level vocabularies of this family split texts (a fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONGEST_RUN = 20_000


class Encoder:
    """The library's ids for a byte-level file whose identifiers are in order of merging.

    Latin-1 texts go through a faster library with the same vocabulary; on those
    characters the two were compared. All other texts go through the first.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        value = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(value[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special = tuple(special)
        self.fast = tiktoken.Encoding("fast", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        try:
            plain = len(text) < LONGEST_RUN or len(max(text.split(" "), key=len)) < LONGEST_RUN
            text.encode("latin-1")
        except UnicodeEncodeError:
            plain = False
        if plain and "   " * 100 not in text and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.full.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids if asked for) of every piece; only the first piece of a document can be shorter than the others."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            source, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.encode(text)
                ids.append(END)
                n, raw = len(ids), np.array(ids, "<u4")
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    source.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw[a:b]))
                    if with_ids:
                        kept.append(raw[a:b].astype(np.int32))
            columns = [batch.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            columns += [pa.array(kept, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing of these lengths has fewer bins: the best of three families of dual-feasible functions."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    for k in range(1, capacity // 2 + 1):  # lengths over capacity-k count as whole bins, those under k as none
        value = np.where(size > capacity - k, capacity, np.where(size < k, 0, size))
        best = max(best, -(-int((count * value).sum()) // capacity))
    for k in range(1, 33):  # rounding to k-ths
        exact = (k + 1) * size % capacity == 0
        value = np.where(exact, size * k, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lengths in falling order: bin and offset of each, and each bin's room."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    rooms: dict[int, list[int]] = {}
    order: list[int] = []  # rooms that some bin has
    made = at = 0
    sizes, counts = np.unique(lengths, return_counts=True)
    for size, left in zip(sizes[::-1].tolist(), counts[::-1].tolist()):
        while left:
            k = bisect_left(order, size)
            room = order[k] if k < len(order) else capacity
            each = min(room // size, left)
            if k < len(order):
                use = rooms[room][: max(1, left // each)]
                rooms[room] = rooms[room][len(use) :]
                if not rooms[room]:
                    del rooms[room]
                    order.pop(k)
            else:
                use = list(range(made, made + max(1, left // each)))
                made += len(use)
            placed = each * len(use)
            bins[at : at + placed] = np.repeat(use, each)
            offsets[at : at + placed] = capacity - room + size * np.tile(np.arange(each), len(use))
            at, left = at + placed, left - placed
            new = room - each * size
            if new not in rooms:
                rooms[new] = []
                insort(order, new)
            rooms[new] += use
    room = np.zeros(made, np.int64)
    for r, own in rooms.items():
        room[own] = r
    return bins, offsets, room


def _round(rows: DataFrame, number: int, parts: int, capacity: int) -> DataFrame:
    """Deals rows over parts and packs each; closed: the partition met its bound or the bin is full."""
    fields = [f for f in rows.columns if f not in ("sequence_id", "offset", "closed", "part")]
    dealt = rows.select(*fields, F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.lit(number)), F.lit(parts)).cast("int").alias("part"))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        lengths = frame["length"].to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        met = len(room) == lower_bound(lengths, capacity)
        first = (number + 1) * (1 << 50) + int(frame["part"].iloc[0]) * (1 << 24)
        return frame.assign(sequence_id=first + bins, offset=offsets, closed=(room[bins] == 0) | met)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields)
    return dealt.groupBy("part").applyInPandas(packed, f"{schema}, sequence_id bigint, offset bigint, closed boolean")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to saved pieces (id, piece, start, length, ids_crc32, ...)."""
    scratch = Scratch(cut.sparkSession, "packing")
    done = [cut.filter(F.col("length") == capacity).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})]
    rest = cut.filter(F.col("length") < capacity)
    bins = None
    for number in count() if ROUNDS is None else range(ROUNDS):
        n = rest.count()
        if not n:
            break
        parts = -(-n // PART)
        new = scratch.save(_round(rest, number, parts, capacity), f"round{number}")
        now = new.filter("offset = 0").count()
        if bins is not None and now >= bins:
            break  # the exchange saved nothing; rest keeps the places it has
        done.append(new.filter("closed"))
        rest = new.filter("not closed")
        bins = rest.filter("offset = 0").count()
        if parts == 1:
            break
    if bins is not None:
        done.append(rest)
    columns = [*cut.columns, "sequence_id", "offset"]
    out = done[0].select(columns)
    for part in done[1:]:
        out = out.unionByName(part.select(columns))
    return out


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end token alone. Null ids are packed like others;
    repeated rows are packed each; an empty table gives an empty table; other
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "pieces")
    return pack(scratch.save(pieces(docs, path, id_col, text_col, capacity, with_ids), "cut"), capacity).withColumnRenamed("id", id_col)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
