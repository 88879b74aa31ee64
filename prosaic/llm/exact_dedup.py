"""Exact deduplication of incoming batches against immutable snapshots.

A snapshot keeps a table of digests, dealt into shards, and one static
binary-fuse filter per shard. An incoming batch is first grouped within itself;
its distinct digests are then screened by the filters shard by shard. Only
digests that a filter lets through are joined with the snapshot's exact
buckets, and only texts whose digest occurs more than once are compared byte for
byte. Everything else moves as digests.

``ingest`` takes a batch against a stored snapshot (``freeze``, ``load``) and
``merge`` makes the next one. ``deduplicate`` does both within one table.

Texts are equal when identical after each run of ASCII white space became one
space; null counts as empty. Ids may be of any type that can be ordered.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosaic.llm import fuse
from prosaic.llm.scratch import Scratch

#: Digests in one shard's filter, and about as many incoming ones in one task that probes it.
SHARD_KEYS = 1 << 17
#: A set of digests of up to this many rows (about 48 bytes each) is broadcast; beyond, Spark joins by shuffling.
BROADCAST_ROWS = 1_000_000


@dataclass
class Snapshot:
    """An immutable set of texts: distinct digests with the row that stays, and the shards' filters."""

    groups: DataFrame  # sha binary, shard int, first struct<none, id, row>, n long
    filters: DataFrame  # shard int, seed int, segment int, fingerprints binary
    shards: int


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id, sha: the row number tells repeated rows apart."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("sha"))


def group(rows: DataFrame) -> DataFrame:
    """Distinct digests, the row of each that stays (smallest id, null ids last, then first row) and how many rows have it."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    return rows.groupBy("sha").agg(first.alias("first"), F.count("*").alias("n"))


def _shard(sha: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(shards)).cast("int")


def _built(groups: DataFrame) -> DataFrame:
    """The filters of sharded groups, one task per shard."""

    def built(frame: pd.DataFrame) -> pd.DataFrame:
        seed, segment, marks = fuse.build(frame["key"].to_numpy().view(np.uint64))
        return pd.DataFrame({"shard": frame["shard"].iloc[:1], "seed": seed, "segment": segment, "fingerprints": [marks]})

    keys = groups.select("shard", F.xxhash64("sha", F.lit(1)).alias("key"))
    return keys.groupBy("shard").applyInPandas(built, "shard int, seed int, segment int, fingerprints binary")


def snapshot(groups: DataFrame, scratch: Scratch, name: str) -> Snapshot:
    """Freezes grouped digests and builds their filters, in shards of about SHARD_KEYS digests."""
    groups = scratch.save(groups, f"{name}-groups")
    shards = max(1, -(-groups.count() // SHARD_KEYS))
    groups = groups.withColumn("shard", F.pmod(F.xxhash64("sha"), F.lit(shards)).cast("int"))
    return Snapshot(groups, scratch.save(_built(groups), f"{name}-filters"), shards)


def freeze(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> Snapshot:
    """Stores the snapshot of docs under path, for good."""
    return _stored(group(digests(docs, id_col, text_col)), path)


def _stored(groups: DataFrame, path: str) -> Snapshot:
    spark = groups.sparkSession
    groups.write.parquet(f"{path}/distinct")
    shards = max(1, -(-spark.read.parquet(f"{path}/distinct").count() // SHARD_KEYS))
    spark.read.parquet(f"{path}/distinct").withColumns({"shard": F.pmod(F.xxhash64("sha"), F.lit(shards)).cast("int"), "shards": F.lit(shards)}).write.parquet(f"{path}/groups")
    _built(spark.read.parquet(f"{path}/groups")).write.parquet(f"{path}/filters")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Snapshot:
    """A stored snapshot."""
    groups = spark.read.parquet(f"{path}/groups")
    some = groups.select("shards").first()
    return Snapshot(groups.drop("shards"), spark.read.parquet(f"{path}/filters"), some[0] if some else 1)


def merge(snap: Snapshot, batch: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> Snapshot:
    """Stores the snapshot that holds snap and the batch; rows that stayed in snap stay."""
    old, new = snap.groups.select("sha", "first", "n"), group(digests(batch, id_col, text_col))
    return _stored(_joined(old, new, True).select("sha", F.struct("first.none", "first.id", "first.row").alias("first"), "n"), path)


def screen(incoming: DataFrame, snap: Snapshot) -> DataFrame:
    """Those digests of incoming groups that the snapshot may hold; none that it holds is lost.

    A task holds one filter and about SHARD_KEYS incoming digests: where the batch
    has more in a shard, several tasks probe copies of its filter.
    """
    parts = max(1, -(-incoming.count() // (snap.shards * SHARD_KEYS)))

    def probed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"sha": pd.Series([], dtype=object)})
        f = right.iloc[0]
        return left.loc[fuse.probe(left["key"].to_numpy().view(np.uint64), int(f["seed"]), int(f["segment"]), f["fingerprints"]), ["sha"]]

    keys = incoming.select("sha", F.pmod(F.xxhash64("sha"), F.lit(snap.shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("sha", F.lit(2)), F.lit(parts)).cast("int").alias("part"), F.xxhash64("sha", F.lit(1)).alias("key"))
    filters = snap.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return keys.groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")).applyInPandas(probed, "sha binary")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _joined(old: DataFrame, new: DataFrame, old_stays: bool) -> DataFrame:
    """sha, first (late, none, id, row) and n of both tables of groups together; with old_stays, old rows come before all new ones."""
    late = lambda df, x: df.select("sha", F.struct(F.lit(x).alias("late"), "first.none", "first.id", "first.row").alias("first"), "n")
    return late(old, False).unionByName(late(new, old_stays)).groupBy("sha").agg(F.min("first").alias("first"), F.sum("n").alias("n"))


def _texts(docs: DataFrame, late: bool, own: bool, repeated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Normalised texts of the digests given."""
    texts = docs.select(F.lit(late).alias("late"), F.lit(own).alias("own"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), normalised(F.col(text_col)).alias("norm"))
    return texts.withColumn("sha", F.unhex(F.sha2("norm", 256))).join(repeated, "sha", "left_semi")


def _settled(rows: DataFrame, groups: DataFrame, texts: DataFrame, scratch: Scratch, id_col: str) -> DataFrame:
    """The report on rows, from the groups of repeated digests; digests under which the byte check finds several texts are settled by text."""
    mixed = scratch.save(texts.select("sha", "norm").distinct().groupBy("sha").count().filter("count > 1").select("sha"), "mixed")
    alone = F.col("n").isNull()
    out = rows.join(_small(groups), "sha", "left").select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | ((F.col("first.row") == F.col("row")) & (F.col("first.late") == F.col("late")))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "sha",
    )
    if mixed.isEmpty():
        return out.drop("sha")
    same = Window.partitionBy("sha", "norm")
    order = same.orderBy("late", F.asc_nulls_last("id"), "row")
    apart = texts.join(mixed, "sha", "left_semi").select(
        "own", F.col("id").alias(id_col), F.first("id").over(order).alias("keep_id"), F.count("*").over(same).alias("group_size"), (F.row_number().over(order) == 1).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
    return out.join(mixed, "sha", "left_anti").drop("sha").unionByName(apart.filter("own").drop("own"))


def ingest(batch: DataFrame, snap: Snapshot, held: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of the batch: id, keep_id, group_size, kept, text_sha256, as deduplicate() has them.

    held: the documents that the snapshot was made of, read for the byte checks. A
    text that the snapshot has is not kept, whatever its id; keep_id is the row that
    stayed there. group_size counts rows of both.
    """
    scratch = Scratch(batch.sparkSession, "ingest")
    rows = scratch.save(digests(batch, id_col, text_col), "digests").withColumn("late", F.lit(True))
    incoming = scratch.save(group(rows), "incoming")
    known = _known(snap, incoming, scratch)
    repeated = _small(scratch.save(incoming.filter("n > 1").select("sha").union(known.select("sha")).distinct(), "repeated"))
    groups = scratch.save(_joined(known, incoming.join(repeated, "sha", "left_semi"), True), "groups")
    texts = _texts(held, False, False, repeated, id_col, text_col).unionByName(_texts(batch, True, True, repeated, id_col, text_col))
    return _settled(rows, groups, texts, scratch, id_col)


def _known(snap: Snapshot, incoming: DataFrame, scratch: Scratch) -> DataFrame:
    """The snapshot's groups that incoming ones share: positives of the filters, joined with the exact buckets."""
    positives = scratch.save(screen(incoming, snap), "positives")
    return scratch.save(snap.groups.select("sha", "first", "n").join(_small(positives), "sha", "left_semi"), "known")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Half of the rows, by a hash, become a snapshot, and the rest is ingested against
    it; of equal texts the smallest id stays, wherever it is. Null texts are equal to
    empty ones. A null id is later than all others. Of repeated rows with one id
    exactly one is kept. An empty table gives an empty table. Other columns are not
    read.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    rows = scratch.save(digests(docs, id_col, text_col), "digests").withColumn("late", F.lit(False))
    old = F.pmod(F.xxhash64("row"), F.lit(2)) == 0
    snap = snapshot(group(rows.filter(old)), scratch, "old")
    incoming = scratch.save(group(rows.filter(~old)), "incoming")
    known = _known(snap, incoming, scratch)
    twice = lambda df: df.filter("n > 1").select("sha")
    both = known.select("sha").join(incoming.select("sha"), "sha", "left_semi")
    repeated = _small(scratch.save(twice(snap.groups).union(twice(incoming)).union(both).distinct(), "repeated"))
    few = lambda df: df.select("sha", "first", "n").join(repeated, "sha", "left_semi")
    groups = scratch.save(_joined(few(snap.groups), few(incoming), False), "groups")
    return _settled(rows, groups, _texts(docs, False, True, repeated, id_col, text_col), scratch, id_col)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: those that deduplicate() keeps."""
    scratch = Scratch(docs.sparkSession, "dedup-keep")
    found = scratch.save(deduplicate(docs, id_col, text_col), "found")
    # the few groups of copies: which id stays, and whether repeated rows share it
    stays = found.filter("group_size > 1").groupBy("text_sha256", "keep_id").agg(F.count_if(F.col(id_col).eqNullSafe(F.col("keep_id"))).alias("ties"))
    stays = scratch.save(stays.select(F.col("text_sha256").alias("__dedup_sha"), F.col("keep_id").alias("__dedup_keep"), F.col("ties").alias("__dedup_ties")), "stays")
    marked = docs.withColumn("__dedup_sha", F.sha2(normalised(F.col(text_col)), 256))
    in_group = marked.join(_small(stays), "__dedup_sha", "left")
    one = in_group.filter(F.col("__dedup_ties").isNull() | ((F.col("__dedup_ties") <= 1) & F.col(id_col).eqNullSafe(F.col("__dedup_keep"))))
    if stays.filter("__dedup_ties > 1").isEmpty():
        return one.select(docs.columns)
    tied = in_group.filter((F.col("__dedup_ties") > 1) & F.col(id_col).eqNullSafe(F.col("__dedup_keep"))).dropDuplicates(["__dedup_sha"])
    return one.select(docs.columns).unionByName(tied.select(docs.columns))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM n
"""
