"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong patterns (assignments, access keys, long hex strings) are always
reported. Weak ones (bare identifiers, mixed token strings, endpoints) are
common in clean text and are reported only where complementary parts of a
credential co-occur: an interval join of identifiers, secrets and endpoints.
Two parts are complementary if their roles are, their spans don't overlap, the
gap between them is at most ``scope`` code points, and their values differ; so
no part is its own complement, be it matched by two patterns or written twice.

The join is a window over the starts and ends of a text's parts: each start
looks back over the ends within the scope, each end looks ahead over the starts.
Spans of a kind don't overlap, so a frame holds few rows, and no pairs are made.

Cheap tests, each implied by a pattern, keep most texts from the patterns; a
text that can't hold complementary parts keeps its strong ones only. Positions
come from window sums over the lengths of pieces and matches, so a text with
very many matches stays linear. Only positions and hashes are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kind, role in a credential, pattern, group that is the value, its least length, and the cheap test (see _tests) that every match passes.
#: Runs of one class are greedy, so a least length within the pattern gives the matches that a filter afterwards would; assignments that fail still use up their text.
BASE = (
    ("assign", "secret", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, "keyed"),
    ("access", "id", r"AKIA[A-Z0-9]{16,}", 0, 20, "access"),
    ("hex", "secret", r"[0-9a-f]{24,}", 0, 24, "dense"),
)
WEAK = (
    ("weak_id", "id", r"""(?i:access_?key_?id|client_?id|user_?name|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", 1, 4, "keyed"),
    ("weak_secret", "secret", r"(?<![A-Za-z0-9+/])(?=[a-z+/0-9]*[A-Z])(?=[A-Z+/0-9]*[a-z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{32,}", 0, 32, "dense"),
    ("endpoint", "endpoint", r"""https?://[^\x00-\x20"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9.])""", 0, 7, "address"),
)
KINDS = BASE + WEAK
ROLES = ("id", "secret", "endpoint")
#: Roles of which a part of each role needs one, or for the endpoint all, beside it.
COMPLEMENTS = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("id", "secret")}
SCOPE = 200


def _tests(text: Column) -> dict[str, Column]:
    return {
        "keyed": F.rlike(text, F.lit(r"""[detnyDETNY]["']?\x20*[:=]""")),  # the last letter of a key, and a sign
        "access": F.contains(text, F.lit("AKIA")),
        "dense": F.rlike(text, F.lit(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{24}")),
        "address": F.contains(text, F.lit("://")) | F.rlike(text, F.lit(r"[0-9]\.[0-9]")),
    }


def _found(text: Column, number: int, test: Column) -> Column:
    """For each match of a kind, too short ones too: its place in order, length of the piece before it, its length, length and hash of its value."""
    _, _, pattern, group, _, _ = KINDS[number]
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def measured(x: Column, i: Column) -> Column:
        # a hit by itself matches as it did within the text
        value = F.regexp_extract(x["hit"], pattern, group) if group else x["hit"]
        return F.struct(F.lit(number).alias("kind"), i.alias("nth"), F.length(x["piece"]).alias("before"), F.length(x["hit"]).alias("length"), F.length(value).alias("counted"), F.xxhash64(value).alias("value"))

    items = F.transform(F.filter(zipped, lambda x: x["hit"].isNotNull()), measured)
    none = F.array().cast("array<struct<kind:int,nth:int,before:int,length:int,counted:int,value:bigint>>")
    return F.when(test, items).otherwise(none)


def _complete(role: str, near: dict[str, Column]) -> Column:
    """Whether a part of that role has the complements it needs, given which roles are near."""
    both = [near[r] for r in COMPLEMENTS[role]]
    return reduce(Column.__and__ if role == "endpoint" else Column.__or__, both)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then
    kind. n_linked counts the parts, strong ones too, that have complementary parts.
    Null texts count as empty and give zero counts, the hash of nothing and
    an empty string; a null id is passed through; repeated rows are each reported;
    an empty table gives an empty table. Columns of docs other than the two named
    are not read.
    """
    text = F.col("_text")
    tests = _tests(text)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    tested = rows.select("*", *[test.alias(f"_{name}") for name, test in tests.items()])
    found = tested.select("_row", "_id", *[_found(text, i, F.col(f"_{k[5]}")).alias(k[0]) for i, k in enumerate(KINDS)])
    any_of = {r: reduce(Column.__or__, [F.size(k[0]) > 0 for k in KINDS if k[1] == r]) for r in ROLES}
    # every complement involves a secret, so without one, or with nothing else, weak parts are of no use
    useful = any_of["secret"] & (any_of["id"] | any_of["endpoint"])
    useful = [*[F.col(k[0]) for k in BASE], *[F.when(useful, F.col(k[0])).otherwise(F.slice(k[0], 1, 0)) for k in WEAK]]
    parts = found.select("_row", "_id", F.explode_outer(F.concat(*useful)).alias("x")).select("_row", "_id", "x.*").repartition("_row")

    running = Window.partitionBy("_row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    least = F.element_at(F.array(*[F.lit(k[4]) for k in KINDS]), F.col("kind") + 1)
    end = F.sum(F.col("before").cast("long") + F.col("length")).over(running)
    placed = parts.withColumn("end", end).withColumn("start", F.col("end") - F.col("length"))
    # a text without parts keeps its rows, in which kind is null
    placed = placed.withColumn("kind", F.when(F.col("counted") >= least, F.col("kind")))
    role = reduce(lambda other, r: F.when(F.col("kind").isin(*[i for i, k in enumerate(KINDS) if k[1] == r]), r).otherwise(other), ROLES, F.lit(None).cast("string"))
    ends = F.array(F.struct(F.col("start").alias("pos"), F.lit(True).alias("opens")), F.struct(F.col("end").alias("pos"), F.lit(False).alias("opens")))
    events = placed.select("_row", "_id", "kind", role.alias("role"), "start", "end", "value", F.inline(F.when(F.col("kind").isNull(), F.slice(ends, 1, 1)).otherwise(ends)))

    along = Window.partitionBy("_row").orderBy("pos")
    behind, ahead = along.rangeBetween(-scope, Window.currentRow), along.rangeBetween(Window.currentRow, scope)
    near = {}
    for r in ROLES:
        own = F.col("role") == r
        ended, begun = F.when(own & ~F.col("opens"), F.col("value")), F.when(own & F.col("opens"), F.col("value"))
        # some value in the frame differs from the part's own if the least or the greatest does
        other = [F.when(F.col("opens"), f(ended).over(behind)).otherwise(f(begun).over(ahead)) for f in (F.min, F.max)]
        near[r] = F.coalesce((other[0] != F.col("value")) | (other[1] != F.col("value")), F.lit(False))
    seen = events.select("_row", "_id", "kind", "role", "start", "end", *[c.alias(f"near_{r}") for r, c in near.items()])
    whole = seen.groupBy("_row", "kind", "start").agg(F.first("_id").alias("_id"), F.first("role").alias("role"), F.first("end").alias("end"), *[F.bool_or(f"near_{r}").alias(f"near_{r}") for r in ROLES])
    around = {r: F.col(f"near_{r}") for r in ROLES}
    linked = reduce(lambda other, r: F.when(F.col("role") == r, _complete(r, around)).otherwise(other), ROLES, F.lit(False))
    whole = whole.withColumn("linked", F.col("kind").isNotNull() & linked)

    base = F.col("kind") < len(BASE)
    span = F.struct("start", "kind", "end")
    grouped = whole.groupBy("_row").agg(
        F.first("_id").alias(id_col),
        *[F.count_if(F.col("kind") == i).alias(f"n_{BASE[i][0]}") for i in range(len(BASE))],
        F.array_sort(F.collect_list(F.when(base, span))).alias("_base"),
        F.array_sort(F.collect_list(F.when(base | F.col("linked"), span))).alias("_all"),
        F.count_if("linked").alias("n_linked"),
    )
    names = F.array(*[F.lit(k[0]) for k in KINDS])

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    return grouped.select(id_col, *[f"n_{k[0]}" for k in BASE], F.sha2(joined("_base"), 256).alias("base_sha256"), joined("_all").alias("spans"), "n_linked")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
