"""N-gram Jaccard join by chosen paths.

A text's set of word shingles becomes a sketch of minwise tokens. In each run a
set is split over the tokens that a hash of (run, path, token) selects, so two
sets of the wanted similarity are expected to share more than one selected token
at each level. Buckets of at most ``small`` sets are brute-forced on sketches;
larger ones are split again, each by its own sampled tokens. Runs repeat until
the chance of missing a pair of the threshold's similarity is below
1 - ``recall``. In a large bucket, sets close to its first set are linked with it
and leave; what is still large after ``DEPTH`` levels shares that many sampled
tokens and becomes one candidate class.

Candidate links go into connected components (a superset of the true classes),
whose texts are then compared exactly: an inverted index over the whole shingle
sets of a class, in blocks of bounded size for large classes. Equal sets are
joined beforehand and weighed, and no table of pairs of a group is ever made.

The number of links needs every two blocks of a class compared. Classes alone do
not: each block is compared within itself and with the class's first set, and only
sets that are not thereby connected with the first one meet the other blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosaic.llm import bytewords
from prosaic.llm.bytewords import U64, mix
from prosaic.llm.components import components
from prosaic.llm.scratch import Scratch, bounded_batches, partitions

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
TOKENS = 128
#: Selected tokens that two sets of the threshold's similarity are expected to share at each level.
BRANCHING = 1.25
SMALL = 250
DEPTH = 3
#: Members of a large bucket whose sketch agrees with its first set's by LINKED are linked with that set, and not split
#: further from DONE on. Jaccard distance is a metric: a set within 1 - threshold of one that is DONE agrees with the first
#: by 0.4 at least, so LINKED has 0.2 (three standard deviations of a difference of two sketches' errors) to spare.
LINKED, DONE = 0.2, 0.6
#: Agreement of sketches, in standard deviations below the threshold, from which a pair is compared exactly.
MARGIN = 4.5
#: Sets of a class in one block of the exact comparison.
BLOCK = 1000
#: Tables of up to this many rows of two or three numbers are broadcast; beyond, Spark joins by shuffling.
BROADCAST_ROWS = 500_000


def runs_needed(recall: float, branching: float, depth: int) -> int:
    """Runs after which a pair at the threshold is missed with probability 1 - recall at most, even at the deepest level.

    Selected shared tokens are about Poisson(branching) at each level, so the
    chance that a run brings the pair together at level d is q(d) = 1 - exp(-branching q(d-1)).
    """
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-branching * q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def least_agreement(threshold: float, tokens: int) -> int:
    return math.floor(tokens * (threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / tokens)))


_FACTORS = bytewords.seeds(TOKENS, 41)


#: A set's two digests are sums over its shingles, mixed with these.
_MARKS = (U64(0xA5A5A5A5A5A5A5A5), U64(0x3C3C3C3C3C3C3C3C))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text, its hash -> id, the hash, two digests of the shingle set, its size, sketch (TOKENS 32-bit numbers) and the low byte of each."""
    for batch in batches:
        body, at = bytewords.utf8(batch.column(1))
        one, two, size, sketch, short = [], [], [], [], []
        for i, j in bytewords.slices(at):
            hashes, first = bytewords.words(body[at[i] : at[j]], at[i : j + 1] - at[i])
            values, begin = bytewords.distinct(*bytewords.shingles(hashes, first, WORDS))
            n = np.diff(begin)
            size.append(n)
            some = np.flatnonzero(n)
            least = np.zeros((j - i, TOKENS), np.uint32)
            digest = np.zeros((2, j - i), U64)
            if len(some):
                starts = begin[:-1][some]
                digest[0, some], digest[1, some] = np.add.reduceat(mix(values ^ _MARKS[0]), starts), np.add.reduceat(mix(values ^ _MARKS[1]), starts)
                for k in range(TOKENS):
                    least[some, k] = mix(np.minimum.reduceat(values * _FACTORS[k], starts)).astype(np.uint32)
            one.append(digest[0].view(np.int64))
            two.append(digest[1].view(np.int64))
            sketch += [row.tobytes() for row in least]
            short += [row.tobytes() for row in least.astype(np.uint8)]
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, two, size)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x, pa.int64()) for x in flat), pa.array(sketch, pa.binary()), pa.array(short, pa.binary())], names=["id", "hash", "d1", "d2", "size", "sketch", "short"])


def _tokens(sketches: pa.Array, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), kind).reshape(-1, TOKENS)


_COLUMN = mix(np.arange(TOKENS, dtype=U64) + U64(7))


def _choose(paths: np.ndarray, tokens: np.ndarray, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """For each path and its set: rows that go on, and the new paths."""
    mixed = mix(mix(tokens.astype(U64) ^ _COLUMN) ^ mix(paths)[:, None])
    row, column = np.nonzero(mixed < U64(int(chance * 2**64)))
    return row, mix(mixed[row, column] + U64(1))


def _first_paths(runs: int, chance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gid, tokens = batch.column(0).to_numpy(), _tokens(batch.column(1))
            for i in range(0, len(gid), 1000):
                rows, paths = [], []
                for r in range(runs):
                    row, path = _choose(np.full(len(gid[i : i + 1000]), mix(np.array([r + 1], U64))[0], U64), tokens[i : i + 1000], chance)
                    rows.append(row + i)
                    paths.append(path)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(paths).view(np.int64)), pa.array(gid[np.concatenate(rows)])], names=["path", "gid"])

    return run


def _next_paths(chance: float):
    """path, gid, sketch, first (the bucket's smallest gid) and its sketch -> links (first, gid) and the new paths of what is to be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            path, gid, first = (batch.column(k).to_numpy() for k in (0, 1, 3))
            tokens = _tokens(batch.column(2))
            same = (tokens == _tokens(batch.column(4))).mean(1)
            near = np.flatnonzero((same >= LINKED) & (gid != first))
            pairs = list(zip(first[near].tolist(), gid[near].tolist()))
            link = near[np.array([x not in seen for x in pairs], bool)]
            if len(seen) > 500_000:
                seen.clear()
            seen.update(pairs)
            go = np.flatnonzero(same < DONE)
            row, new = _choose(path[go].view(U64), tokens[go], chance)
            none = lambda n: pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays(x) for x in ([none(len(link)), pa.array(new.view(np.int64))], [pa.array(gid[link]), pa.array(gid[go][row])], [pa.array(first[link]), none(len(row))])], names=["path", "gid", "first"]
            )

    return run


def _forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    out = []
    for a, b in pairs.tolist():
        p, q = find(a), find(b)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((a, b))
    return out


def _brute(least: int):
    """Rows of small buckets, sorted by path -> links whose sketches agree; within a bucket only a spanning forest."""

    def links(path: np.ndarray, gid: np.ndarray, tokens: np.ndarray) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        cut = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1], [True]]))
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        if len(two):
            same = (tokens[two] == tokens[two + 1]).sum(1) >= least
            out += zip(gid[two[same]].tolist(), gid[two[same] + 1].tolist())
        for a, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist()):
            own = tokens[a : a + n]
            p, q = np.nonzero(np.triu((own[:, None, :] == own[None, :, :]).sum(2) >= least, 1))
            if len(p):
                out += _forest(np.stack([gid[a + p], gid[a + q]], axis=1))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        seen: set[tuple[int, int]] = set()

        def told(found: list[tuple[int, int]]) -> pa.RecordBatch:
            if len(seen) > 500_000:
                seen.clear()
            new = [x for x in dict.fromkeys((min(x), max(x)) for x in found) if x not in seen]
            seen.update(new)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in new], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), _tokens(batch.column(2), np.uint8))
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now))
            last = int(np.searchsorted(now[0], now[0][-1]))  # the last bucket may go on in the next batch
            yield told(links(*(x[:last] for x in now)))
            held = tuple(x[last:] for x in now)
        if held is not None:
            yield told(links(*held))

    return run


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def candidates(groups: DataFrame, scratch: Scratch, threshold: float, recall: float) -> DataFrame:
    """Links (a, b) between sets (gid, sketch, short) of groups that may reach the threshold."""
    spark = groups.sparkSession
    runs, chance = runs_needed(recall, BRANCHING, DEPTH), BRANCHING / (threshold * TOKENS)
    brute = _brute(least_agreement(threshold, TOKENS))
    sketches = groups.select("gid", "sketch")
    paths = scratch.save(sketches.mapInArrow(_first_paths(runs, chance), "path bigint, gid bigint"), "paths-1")
    links = None
    for level in range(1, DEPTH + 1):
        sizes = paths.groupBy("path").agg(F.count("*").alias("n"), F.min("gid").alias("least")).filter("n > 1")
        shared = scratch.save(paths.join(sizes, "path"), f"shared-{level}")
        if level == 1:
            scratch.drop("paths-1")
        few = shared.filter(F.col("n") <= SMALL).select("path", "gid").join(groups.select("gid", "short"), "gid").select("path", "gid", "short")
        found = few.repartition(partitions(spark), "path").sortWithinPartitions("path").mapInArrow(brute, "a bigint, b bigint")
        links = found if links is None else links.unionByName(found)
        many = shared.filter(F.col("n") > SMALL)
        if many.isEmpty():
            break
        if level == DEPTH:  # these share DEPTH sampled tokens
            links = links.unionByName(many.filter("gid <> least").select(F.col("least").alias("a"), F.col("gid").alias("b")).distinct())
            break
        heads = many.select("path", "least").distinct().join(sketches.withColumnsRenamed({"gid": "least", "sketch": "head"}), "least")
        heads = scratch.save(heads, f"heads-{level}")
        deeper = many.select("path", "gid").join(sketches, "gid").join(_small(heads, BROADCAST_ROWS // 20), "path").select("path", "gid", "sketch", "least", "head")
        split = scratch.save(deeper.mapInArrow(_next_paths(chance), "path bigint, gid bigint, first bigint"), f"split-{level}")
        links = links.unionByName(split.filter("first is not null").select(F.col("first").alias("a"), F.col("gid").alias("b")).distinct())
        paths = split.filter("path is not null").select("path", "gid")
    return scratch.save(links.distinct(), "links")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> Iterator[np.ndarray]:
    """For each set on the left, which ones on the right have the threshold's similarity: an inverted index, whole sets."""
    if not right:
        yield from (np.zeros(0, np.int64) for _ in left)
        return
    size = np.array([len(x) for x in right])
    values = np.concatenate(right)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(right)), size)[order]
    for own in left:
        common = np.zeros(len(right), np.int64)
        for k in range(0, len(own), 1000):  # a thousand posting lists at a time
            low, high = np.searchsorted(values, own[k : k + 1000], "left"), np.searchsorted(values, own[k : k + 1000], "right")
            n = high - low
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            common += np.bincount(owner[at], minlength=len(right))
        yield np.flatnonzero(common >= threshold * (len(own) + size - common) - 1e-9)


def _exact(threshold: float):
    """Texts of classes, or of two blocks of a class -> how many partners each set has here, and links that keep true classes together."""

    def compared(frame: pd.DataFrame, sets: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[int, int]]]:
        gid, side = frame["gid"].to_numpy(), frame["side"].to_numpy()
        one_block = frame["i"].iloc[0] == frame["j"].iloc[0]
        rows = np.arange(len(gid)) if one_block else np.flatnonzero(side == 0)
        columns = rows if one_block else np.flatnonzero(side == 1)
        count, links = np.zeros(len(gid), np.int64), []
        for row, found in zip(rows, _overlaps([sets[r] for r in rows], [sets[c] for c in columns], threshold)):
            other = columns[found]
            other = other[other != row]
            count[row] += len(other)
            if not one_block:
                count[other] += 1
            links.append(np.stack([np.full(len(other), gid[row]), gid[other]], axis=1))
        return count, _forest(np.concatenate(links)) if links else []

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["root", "i", "j", "gid"], kind="stable").reset_index(drop=True)
        body, at = bytewords.utf8(pa.array(frame["text"], pa.string()))
        sets: list[np.ndarray] = []
        for i, j in bytewords.slices(at):
            hashes, first = bytewords.words(body[at[i] : at[j]], at[i : j + 1] - at[i])
            values, begin = bytewords.distinct(*bytewords.shingles(hashes, first, WORDS))
            sets += [values[a:b] for a, b in zip(begin, begin[1:])]
        digest = np.array([mix(x ^ _MARKS[0]).sum(dtype=U64) for x in sets], U64).view(np.int64)
        # rows that share an id but not the set were fetched by that id; repeated rows count once
        fits = frame[digest == frame["d1"].to_numpy()].drop_duplicates(["root", "i", "j", "side", "gid"])
        out = []
        for _, own in fits.groupby(["root", "i", "j"], sort=False):
            count, links = compared(own, [sets[k] for k in own.index])
            out.append(pd.DataFrame({"gid": own["gid"].to_numpy(), "n": count, "link": own["gid"].to_numpy()}))
            out.append(pd.DataFrame({"gid": [a for a, _ in links], "n": 0, "link": [b for _, b in links]}, dtype="int64"))
        return pd.concat(out) if out else pd.DataFrame({"gid": [], "n": [], "link": []}, dtype="int64")

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, class_id, n_links, copies, set_size.

    class_id is the smallest id of the documents that links of the threshold or
    more connect; n_links is how many other distinct shingle sets are linked with
    this document's set, and copies how many rows have this very set. A text of
    fewer than five words, but not none, has one shingle of all its words. Texts
    without words (null and empty ones among them) and rows with a null id are
    linked with nothing and are classes of their own: class_id is their id, and
    n_links 0. Repeated rows are copies of one another; rows that share an id but
    not a text are told apart by their sets. An empty table gives an empty table.
    Other columns are not read.
    """
    return _classed(docs, threshold, recall, id_col, text_col, True).drop("hash", "class_hash")


def _compare(rows: DataFrame, sets: DataFrame, members: DataFrame, dealt: list[Column], threshold: float) -> DataFrame:
    """gid, n, link: exact comparisons among members (gid, id, d1, root, m, ...), whose texts alone are read.

    dealt: for each member, (i, j, side) of every comparison that it takes part in: of all
    sets if i = j, else of side 0 with side 1.
    """
    n = members.count()
    chosen = F.broadcast(members) if n <= BROADCAST_ROWS else members
    texts = rows.join(chosen, "id")
    if sets.select("id").join(F.broadcast(members.select("id")) if n <= BROADCAST_ROWS else members.select("id"), "id").count() > n:  # some ids repeat
        texts = texts.groupBy(*[c for c in members.columns if c != "id"], F.xxhash64("text").alias("_hash")).agg(F.first("text").alias("text"))
    dealt = texts.select("gid", "root", "m", "d1", "text", F.explode(dealt).alias("x")).select("gid", "root", "m", "d1", "text", "x.*")
    # small classes share a call
    lot = F.when(F.col("m") > BLOCK, F.xxhash64("root", "i", "j")).otherwise(F.pmod(F.xxhash64("root"), F.lit(-(-n // 200) + 1)))
    dealt = dealt.withColumn("lot", lot).select("lot", "root", "i", "j", "side", "gid", "d1", "text")
    return dealt.groupBy("lot").applyInPandas(_exact(threshold), "gid bigint, n bigint, link bigint")


def _true_links(rows: DataFrame, sets: DataFrame, members: DataFrame, scratch: Scratch, threshold: float, counted: bool) -> DataFrame:
    """gid, n, link: links that keep the true classes together and, if counted, the numbers of partners in parts."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("gid"), blocks).cast("int")
    task = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    each = F.sequence(F.lit(0), blocks - 1)
    if counted:  # a class of k blocks is compared as its pairs of blocks (i <= j): each set goes to k tasks of at most two blocks
        pairs = F.transform(each, lambda other: task(F.least(own, other), F.greatest(own, other), own > other))
        return scratch.save(_compare(rows, sets, members, pairs, threshold), "compared")
    first = F.transform(F.when(F.col("gid") == F.col("root"), each).otherwise(F.array(own)), lambda i: task(i, i, F.lit(False)))
    found = scratch.save(_compare(rows, sets, members, first, threshold), "compared")
    large = members.filter(F.col("m") > BLOCK)
    if large.isEmpty():
        return found
    # links of a forest go out from few sets to many: the many ends are joined
    links = found.filter("gid <> link").join(large.select(F.col("gid").alias("link")), "link", "left_semi").select(F.col("gid").alias("a"), F.col("link").alias("b"))
    near = components(links, scratch, "near").select(F.col("node").alias("gid"), F.col("root").alias("own_root"))
    # sets that blocks and first sets did not connect with the class's first set, which has the smallest number
    apart = scratch.save(large.join(near, "gid", "left").filter("own_root is null or own_root <> root").select("gid", "root"), "apart")
    number = apart.groupBy("root").agg(F.count("*").alias("r"))
    if number.isEmpty():
        return found
    meeting = scratch.save(large.join(number, "root").join(apart.select("gid", F.lit(True).alias("late")), "gid", "left"), "meeting")
    lots = F.ceil(F.col("r") / BLOCK).cast("int")
    lot = F.pmod(F.xxhash64("gid", F.lit(1)), lots).cast("int")
    # numbers below 0 stand for blocks of the sets apart, so that i and j differ
    sides = F.concat(
        F.transform(F.sequence(F.lit(0), lots - 1), lambda x: task(own, -1 - x, F.lit(False))),
        F.when(F.col("late"), F.transform(each, lambda i: task(i, -1 - lot, F.lit(True)))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>")),
    )
    return found.unionByName(scratch.save(_compare(rows, sets, meeting, sides, threshold), "compared-apart"))


def _classed(docs: DataFrame, threshold: float, recall: float, id_col: str, text_col: str, counted: bool) -> DataFrame:
    """join() with the hash of each row's text, and the least hash among the class's texts of its smallest id; n_links only if counted, else 0."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sets = scratch.save(rows.withColumn("hash", F.xxhash64("text")).mapInArrow(_sketches, f"id {kind}, hash bigint, d1 bigint, d2 bigint, size bigint, sketch binary, short binary"), "sets")
    real = sets.filter("size > 0 and id is not null")
    groups = real.groupBy("d1", "d2").agg(F.min(F.struct("id", "hash")).alias("least"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.first("short").alias("short"))
    groups = groups.select("d1", "d2", "least.*", "copies", "sketch", "short")
    groups = scratch.save(groups.withColumn("gid", F.monotonically_increasing_id()), "groups")
    links = candidates(groups, scratch, threshold, recall)
    found = components(links, scratch, "candidate")
    members = found.select(F.col("node").alias("gid"), "root")
    sizes = members.groupBy("root").agg(F.count("*").alias("m"))
    members = scratch.save(members.join(sizes, "root").join(groups.select("gid", "id", "d1"), "gid"), "members")
    compared = _true_links(rows, sets, members, scratch, threshold, counted)
    counts = compared.groupBy("gid").agg(F.sum("n").alias("n_links"))
    true = components(compared.filter("gid <> link").select(F.col("gid").alias("a"), F.col("link").alias("b")), scratch, "true")
    classes = true.withColumnRenamed("node", "gid").join(groups.select("gid", "id", "hash"), "gid")
    least = classes.groupBy("root").agg(F.min(F.struct("id", "hash")).alias("least")).select("root", F.col("least.id").alias("class_id"), F.col("least.hash").alias("class_hash"))
    classed = classes.join(least, "root").select("gid", "class_id", "class_hash").join(counts, "gid")
    final = groups.select("gid", "d1", "d2", "id", "hash", "copies").join(_small(scratch.save(classed, "classed")), "gid", "left")
    final = final.select("d1", "d2", "copies", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_hash", "hash").alias("class_hash"), F.coalesce("n_links", F.lit(0)).alias("n_links") if counted else F.lit(0).cast("long").alias("n_links"))
    told = sets.select("id", "hash", "d1", "d2", "size", (F.col("size") > 0).alias("real")).withColumn("real", F.col("real") & F.col("id").isNotNull())
    out = told.filter("real").join(final, ["d1", "d2"]).select(F.col("id").alias(id_col), "class_id", "n_links", "copies", F.col("size").alias("set_size"), "hash", "class_hash")
    alone = told.filter("not real").select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("copies"), F.col("size").alias("set_size"), "hash", F.col("hash").alias("class_hash"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs with one row of each class, the one of the smallest id; all columns stay.

    Rows without words or without an id are kept. Of repeated rows of the id that
    stays, one is kept; of different texts that share that id, the one of the least hash.
    """
    scratch = Scratch(docs.sparkSession, "jaccard-keep")
    key = [id_col, "__text_hash"]
    found = _classed(docs, threshold, recall, id_col, text_col, False).withColumn("own", (F.col(id_col) == F.col("class_id")) & (F.col("hash") == F.col("class_hash")))
    found = scratch.save(found.select(id_col, F.col("hash").alias(key[1]), "own", "copies", "set_size"), "found")
    gone = found.filter("not own").select(key).distinct()
    kept = docs.withColumn(key[1], F.xxhash64(text_col)).join(_small(gone), key, "left_anti")
    twice = scratch.save(found.filter("copies > 1 and set_size > 0").filter("own").groupBy(key).count().filter("count > 1").select(key), "twice")
    if twice.isEmpty():
        return kept.select(docs.columns)
    twice = _small(twice)
    once = kept.join(twice, key, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(twice, key, "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' ')))) AS s FROM d WHERE len(w) > 0),
c AS (SELECT doc_id, md5(array_to_string(s, chr(10))) AS h, len(s) AS n, s FROM s),
g AS (SELECT h, min(doc_id) AS id, count(*) AS copies, any_value(n) AS n, any_value(s) AS s FROM c GROUP BY 1),
t AS (SELECT h, n, unnest(s) AS t FROM g),
p AS (SELECT a.h AS a, b.h AS b FROM t a JOIN t b ON a.t = b.t AND a.h < b.h GROUP BY a.h, b.h, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT h AS a, h AS b FROM g UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
k AS (SELECT r.a AS h, min(g.id) AS class_id FROM r JOIN g ON g.h = r.b GROUP BY 1),
l AS (SELECT a AS h, count(*) AS n_links FROM e GROUP BY 1)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, coalesce(l.n_links, 0)::BIGINT AS n_links, coalesce(g.copies, 1)::BIGINT AS copies, coalesce(c.n, 0)::BIGINT AS set_size
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN g ON g.h = c.h LEFT JOIN k ON k.h = c.h LEFT JOIN l ON l.h = c.h
"""
