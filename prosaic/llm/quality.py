"""Quality classifier by positive-unlabelled learning.

Trusted positives are set against unlabelled web text: a small network minimises
the non-negative unbiased risk  pi R_p(+1) + max(0, R_u(-1) - pi R_p(-1)), whose
class prior pi is estimated from the data. Labels of poor quality are never read.

The network is fitted on the driver on at most about ``fit_rows`` positives and
as many unlabelled rows, drawn by a hash; every whole text is scored. Inputs are
measures of the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosaic.llm import bytewords
from prosaic.llm.scratch import bounded_batches

FIT_ROWS = 8000
HIDDEN, STEPS, RATE, DECAY = 12, 400, 0.01, 1e-3

_KINDS = ("lower", "upper", "digit", "space", "newline", "stop", "comma", "call", "pipe", "symbol", "other", "high")
_KIND = np.full(256, _KINDS.index("other"))
for _chars, _name in (("abcdefghijklmnopqrstuvwxyz", "lower"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"), ("0123456789", "digit"), (" \t", "space"), ("\n\r", "newline"), (".?", "stop"), (",;:", "comma"), ("!", "call"), ("|", "pipe"), ("#$%&*@^~=+<>\\{}[]_", "symbol")):
    _KIND[[ord(c) for c in _chars]] = _KINDS.index(_name)
_KIND[128:] = _KINDS.index("high")
FEATURES = (*_KINDS, "bytes", "words", "word_length", "distinct", "again", "again_before", "commonest", "line_words")


def features(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    n, size = len(at) - 1, np.diff(at)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * len(_KINDS) + _KIND[body], minlength=n * len(_KINDS)).reshape(n, len(_KINDS))
    hashes, first = bytewords.words(body, at)
    count = np.diff(first)
    owner = np.repeat(np.arange(n), count)
    again, before = np.zeros(n), np.zeros(n)
    for step, out in ((1, again), (2, before)):
        if len(hashes) > step:
            out += np.bincount(owner[step:][(hashes[step:] == hashes[:-step]) & (owner[step:] == owner[:-step])], minlength=n)
    distinct, commonest = np.zeros(n), np.zeros(n)
    for i in range(n):
        if count[i]:
            own = np.sort(hashes[first[i] : first[i + 1]])
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            distinct[i], commonest[i] = len(edge) - 1, np.diff(edge).max()
    some, chars = np.maximum(count, 1), np.maximum(size, 1)
    letters = kinds[:, [0, 1, 2, 11]].sum(1)
    lines = kinds[:, 4] + 1
    return np.column_stack([np.sqrt(kinds / chars[:, None]), np.log1p(size), np.log1p(count), letters / some, distinct / some, again / some, before / some, commonest / some, np.log1p(count / lines)])


class Network:
    """One hidden layer; the output is the log-odds of a positive."""

    def __init__(self, width: int, mean: np.ndarray, scale: np.ndarray):
        draw = np.random.default_rng(7)
        self.mean, self.scale = mean, scale
        self.weights = [draw.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights[0] + self.weights[1])

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.weights[2] + self.weights[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x), -30, 30)))


def _train(x: np.ndarray, slope, width: int) -> Network:
    """Adam on all rows; slope gives the risk's derivative by each row's log-odds."""
    net = Network(width, x.mean(0), x.std(0) + 1e-6)
    z = np.clip((x - net.mean) / net.scale, -6, 6)
    first, second = ([np.zeros_like(w) for w in net.weights] for _ in range(2))
    for step in range(1, STEPS + 1):
        h = np.tanh(z @ net.weights[0] + net.weights[1])
        d = slope(h @ net.weights[2] + net.weights[3])
        back = np.outer(d, net.weights[2]) * (1 - h * h)
        for k, g in enumerate((z.T @ back, back.sum(0), h.T @ d, np.array([d.sum()]))):
            g = g + DECAY * net.weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net.weights[k] = net.weights[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows.

    A network first tells positives from unlabelled rows, and is read on rows it
    was not fitted on. Above a high enough output nearly all rows are positives, so
    the ratio of the two kinds' shares above it comes down to the prior; the least
    ratio is taken.
    """
    p, u = np.zeros(len(positive)), np.zeros(len(unlabelled))
    for fold in range(2):
        own_p, own_u = positive[1 - fold :: 2], unlabelled[1 - fold :: 2]
        if not len(own_p) or not len(own_u):
            return 0.5
        target = np.concatenate([np.ones(len(own_p)), np.zeros(len(own_u))])
        weight = np.concatenate([np.full(len(own_p), 0.5 / len(own_p)), np.full(len(own_u), 0.5 / len(own_u))])
        net = _train(np.concatenate([own_p, own_u]), lambda odds, w=weight, t=target: w * (_sigmoid(odds) - t), positive.shape[1])
        p[fold::2], u[fold::2] = net.odds(positive[fold::2]), net.odds(unlabelled[fold::2])
    p, u = np.sort(p), np.sort(u)
    cuts = np.quantile(p, np.linspace(0.02, 0.5, 49))
    above = lambda v, c: 1 - np.searchsorted(v, c, "left") / len(v)
    return float(np.clip(min(above(u, c) / max(above(p, c), 1e-9) for c in cuts), 0.05, 0.98))


def fit_network(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Network:
    """Minimises the non-negative risk with the logistic loss."""
    n_p, n_u = len(positive), len(unlabelled)

    def slope(odds: np.ndarray) -> np.ndarray:
        p, u = odds[:n_p], odds[n_p:]
        up_p, down_p, down_u = -_sigmoid(-p) * prior / n_p, _sigmoid(p) * prior / n_p, _sigmoid(u) / n_u
        negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        if negative >= 0:
            return np.concatenate([up_p - down_p, down_u])
        return np.concatenate([down_p, -down_u])  # the negative part is brought back above zero first

    return _train(np.concatenate([positive, unlabelled]), slope, positive.shape[1])


def held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, at = bytewords.utf8(batch.column(0))
        for i, j in bytewords.slices(at):
            rows = features(body[at[i] : at[j]], at[i : j + 1] - at[i])
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(list(rows), pa.list_(pa.float64()))], names=["positive", "drawn", "x"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> tuple[Network | None, float]:
    """The network and the estimated prior; None if there are no positives to learn from."""
    bounded_batches(docs.sparkSession)
    span = 1 << 30

    def drawn(rows: int, salt: int, *by: str) -> Column:
        return F.pmod(F.xxhash64(*by, F.lit(salt)), F.lit(span)) < int(min(1.0, fit_rows / max(rows, 1)) * span)

    good = labels.filter((F.col("quality") == 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("_id")).distinct()
    good = good.filter(drawn(good.count(), 1, "_id"))  # about fit_rows ids
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).filter(F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    rows = rows.join(F.broadcast(good.withColumn("positive", F.lit(True))), "_id", "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    # an id may have very many rows, so rows are drawn too; a row that repeats counts once
    number = rows.agg(F.count("*").alias("all"), F.count_if("positive").alias("positive")).first()
    rows = rows.withColumns({"positive": F.col("positive") & drawn(number["positive"], 3, "_id", "text"), "drawn": drawn(number["all"], 2, "_id", "text")}).filter("drawn or positive")
    rows = rows.groupBy("_id", F.xxhash64("text")).agg(F.first("text").alias("text"), F.first("positive").alias("positive"), F.first("drawn").alias("drawn")).select("text", "positive", "drawn")
    table = rows.mapInArrow(_measured, "positive boolean, drawn boolean, x array<double>").toArrow()
    if not table.num_rows:
        return None, 0.5
    x = np.array(table.column("x").to_pylist())
    positive, unlabelled = x[table.column("positive").to_numpy()], x[table.column("drawn").to_numpy()]
    if not len(positive) or not len(unlabelled):
        return None, 0.5
    prior = estimate_prior(positive, unlabelled)
    return fit_network(positive, unlabelled, prior), prior


def scores(docs: DataFrame, network: Network | None, prior: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted.

    Null texts are scored as empty ones. A row with a null id is not held out and
    was not learned from. Without a network every score is the prior. Repeated rows
    are scored each; an empty table gives an empty table; other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = bytewords.utf8(batch.column(1))
            for i, j in bytewords.slices(at):
                found = np.full(j - i, prior) if network is None else network.score(features(body[at[i] : at[j]], at[i : j + 1] - at[i]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(found, pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scores(docs, *fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
