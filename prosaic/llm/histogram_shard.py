"""Sharding by histogram sort, in DataFrame functions only. Law: ``bytes``.

Rows are ordered by a 63-bit key. Equal texts share a key, so that a group of
copies stays in one shard. Splitters are found by counting the exact bytes below
candidate keys over all partitions, and refining the candidates inside the
intervals that hold a target until every splitter is within the tolerance or
between two neighbouring keys. Then rows are exchanged once.

Groups of over 1/64 of a shard's bytes or rows (1,024 at most, however large the
table) are placed into shards first, the largest in front, each where it fits
most tightly. A group that fits into no shard, as one larger than a shard, is
cut over the shards with the most room; its keys have room for a salt below
them, by which it is cut and by which the exchange deals even one group over
many tasks. What the shards then lack is filled with light rows by splitters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosaic.llm.scratch import Scratch

SALT_BITS = 20
LIGHT = 1 << 40
TOP = LIGHT + (1 << 62)
PROBES = 64
#: Rows that one task numbers.
PIECE_ROWS = 50_000


def _pick(index: Column, values: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), index + 1)


def _below(key: Column, cuts: list[int]) -> Column:
    """How many cuts are at most the key; for a handful of cuts."""
    return sum([(key >= c).cast("int") for c in cuts], F.lit(0))


def place(heavy: list[int], shards: int, share: float, tolerance: float) -> list[list[tuple[int, float]]]:
    """For each heavy group, by falling bytes, the shards that take it and how many bytes each; one shard unless it fits into none."""
    free, out, late = [share] * shards, [[] for _ in heavy], []

    def fitting(size: float) -> int | None:
        return min((s for s in range(shards) if free[s] >= size - tolerance * share), key=lambda s: (free[s], s), default=None)

    def put(i: int, s: int, size: float) -> None:
        out[i].append((s, size))
        free[s] -= size

    def cut(i: int, size: float) -> None:
        while (s := fitting(size)) is None:
            most = max(range(shards), key=lambda s: (free[s], -s))
            if free[most] <= 0:
                s = most
                break
            size -= free[most]
            put(i, most, free[most])
        put(i, s, size)

    for i, size in enumerate(heavy):
        if size > share * (1 + tolerance):
            cut(i, size)
        elif (s := fitting(size)) is not None:
            put(i, s, size)
        else:
            late.append(i)
    for i in late:
        cut(i, heavy[i])
    return out


def fill(loads: list[float], light: float) -> list[float]:
    """How many light bytes each shard gets so that the least loaded ones are filled to one level."""
    order = sorted(loads)
    level, below = 0.0, 0.0
    for k, load in enumerate(order, 1):
        below += load
        level = (light + below) / k
        if k == len(order) or level <= order[k]:
            break
    return [max(0.0, level - load) for load in loads]


def splitters(keyed: DataFrame, targets: list[tuple[int, int, float]], slack: float) -> list[tuple[int, int]]:
    """For each (first key, last key + 1, bytes wanted from the first key on): the key to split at, and the bytes from the first key to it.

    Within slack bytes of what is wanted, or between two neighbouring keys.
    """
    found: dict[int, tuple[int, int]] = {}
    open_ = {s: (lo, hi, 0) for s, (lo, hi, _) in enumerate(targets)}  # target number: first key, last key + 1, bytes below the first key
    while open_:
        brackets = sorted({(lo, hi) for lo, hi, _ in open_.values()})
        steps = [max(1, -(-(hi - lo) // PROBES)) for lo, hi in brackets]
        which = F.lit(None).cast("int")
        for i, (lo, hi) in enumerate(brackets):
            which = F.when((F.col("key") >= lo) & (F.col("key") < hi), i).otherwise(which)
        counted = (
            keyed.select("key", "size", which.alias("b"))
            .filter("b is not null")
            .select("b", "size", "key", F.expr("key").alias("k"))
            .withColumn("p", F.call_function("div", F.col("key") - _pick(F.col("b"), [lo for lo, _ in brackets]), _pick(F.col("b"), steps)))
            .groupBy("b", "p")
            .agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
            .collect()  # at most PROBES rows for each bracket: the light rows', and one for each group that is cut
        )
        cells: dict[int, list] = {i: [] for i in range(len(brackets))}
        for r in sorted(counted, key=lambda r: (r["b"], r["p"])):
            cells[r["b"]].append(r)
        for s, (lo, hi, below) in list(open_.items()):
            target, i = round(targets[s][2]), brackets.index((lo, hi))
            for r in cells[i]:
                if below + r["bytes"] >= target:
                    break
                below += r["bytes"]
            else:  # nothing is left in the bracket
                found[s] = (hi if hi <= TOP else TOP + 1, below)
                del open_[s]
                continue
            first, last = below, below + r["bytes"]
            start = lo + r["p"] * steps[i]
            if min(target - first, last - target) <= slack or r["low"] == r["high"]:
                found[s] = (r["low"], first) if target - first <= last - target else (r["high"] + 1, last)
                del open_[s]
            else:
                open_[s] = (max(start, r["low"]), min(start + steps[i], r["high"] + 1), first)
    return [found[s] for s in range(len(targets))]


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 1; null texts have none and are grouped
    with empty ones. Null ids come first among equal texts; repeated rows get
    slots of their own; an empty table gives an empty table. grown_shard is null
    under this law. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("hash"))
    rows = scratch.save(rows, "rows")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    part = max(1, shards * 64)
    heavy = (
        rows.groupBy("hash")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        .filter((F.col("bytes") * part > total) | (F.col("n") * part > count))
        .filter((F.col("n") > 1) | (F.col("bytes") * shards * 4 > total))  # single rows stay in hash order unless very large
        .collect()  # fewer than 2 * part rows can exceed a part-th of the total
    )
    heavy.sort(key=lambda r: (-r["bytes"], r["hash"]))
    share = total / shards
    homes = place([r["bytes"] for r in heavy], shards, share, tolerance)
    values = ", ".join(f"({r['hash']}L, {i}L, {homes[i][0][0] if len(homes[i]) == 1 else -1})" for i, r in enumerate(heavy)).replace(f"({-(1 << 63)}L", "(-9223372036854775807L - 1L") or "(0L, 0L, 0)"
    ranks = spark.sql(f"SELECT * FROM VALUES {values} AS t(hash, rank, home)").limit(1 << 20 if heavy else 0)
    salt = F.pmod(F.xxhash64("id", "crc"), F.lit(1 << SALT_BITS))
    light = F.shiftrightunsigned("hash", 2) + F.lit(LIGHT)
    keyed = rows.join(F.broadcast(ranks), "hash", "left").select("id", "size", "crc", "rank", "home", F.coalesce((F.col("rank") * (1 << SALT_BITS)) + salt, light).alias("key"))

    # groups that are cut: where, and what each shard has got of them
    loads = [0.0] * shards
    for i, parts in enumerate(homes):
        if len(parts) == 1:
            loads[parts[0][0]] += heavy[i]["bytes"]
    split = [i for i, parts in enumerate(homes) if len(parts) > 1]
    wanted = [(i << SALT_BITS, (i + 1) << SALT_BITS, sum(b for _, b in homes[i][:k])) for i in split for k in range(1, len(homes[i]))]
    got = iter(splitters(keyed, wanted, tolerance * share))
    begins, takers = [], []  # keys at which a part of a cut group begins, and its shard
    for i in split:
        ends = [(i << SALT_BITS, 0), *sorted(next(got) for _ in homes[i][1:]), ((i + 1) << SALT_BITS, heavy[i]["bytes"])]
        for (key, first), (_, last), (s, _) in zip(ends, ends[1:], homes[i]):
            begins.append(key)
            takers.append(s)
            loads[s] += last - first
    # light rows fill what is missing
    filled = fill(loads, total - sum(r["bytes"] for r in heavy))
    cuts = sorted(key for key, _ in splitters(keyed, [(LIGHT, TOP + 1, sum(filled[:s])) for s in range(1, shards)], tolerance * share)) if count else [TOP] * (shards - 1)

    pieces = max(1, -(-count // (shards * PIECE_ROWS)))
    lows = [LIGHT, *cuts]
    spans = [max(1, -(-(hi - lo) // pieces)) for lo, hi in zip(lows, [*lows[1:], TOP + 1])]
    bits = min(SALT_BITS, max([0, *((max(0, r["n"] - 1) // PIECE_ROWS).bit_length() for r in heavy)]))
    home = F.when(F.col("rank").isNull(), _below(F.col("key"), cuts))
    if heavy:
        part = _pick(_below(F.col("key"), begins) - 1, takers) if split else F.lit(None)
        home = F.when(F.col("home") >= 0, F.col("home")).when(F.col("home") < 0, part).otherwise(home)
    sharded = keyed.withColumn("shard", home.cast("int"))
    piece = F.when(F.col("rank").isNotNull(), F.shiftright("key", SALT_BITS - bits) - F.lit(1 << 45)).otherwise(
        F.call_function("div", F.col("key") - _pick(F.col("shard"), lows), _pick(F.col("shard"), spans))
    )
    sharded = sharded.withColumn("piece", piece)
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sharded.groupBy("shard", "piece").agg(F.count("*").alias("n")).select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "piece").orderBy("key", F.asc_nulls_first("id"), "crc")
    numbered = sharded.withColumn("nth", F.row_number().over(within)).join(firsts, ["shard", "piece"])
    return numbered.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
