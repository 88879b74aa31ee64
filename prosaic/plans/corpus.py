"""Inputs of the queries: the tables, and literal probe rows for what the tables never contain.

Probe rows are appended alike in Spark (as a local relation) and in the SQL
given as oracle (as VALUES), so both sides see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space for RE2, as a class without brackets.
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: (id, text): short texts of our own that hit each pack, each limit and each boundary.
PROSE = [
    (-1, "We delve into the myriad, the plethora and the tapestry. We delve again. \"Delve!\" she said to nobody at all."),
    (-2, "A robust, comprehensive and seamlessly scalable plan stood there.\n\nThe fostered, enhanced and elevated crew went home early.\n\nNothing happened in this one."),
    (-3, "It's worth noting that rain fell.\nImportantly, the roof held well.\nNotably the cat slept on. Let's dive into the pond. In today's loud and digital world we wait. At the end of the day it goes without saying."),
    (-4, "However, the door closed. It stayed closed for long.\n\nMoreover, the lamp went out. Nobody spoke of it.\n\nThey walked home. The night was long."),
    (-5, "She felt a sense of dread and the weight of years. Her eyes widened. A wave of heat washed over him. Something ancient stirred. He let out a breath he didn't know he held."),
    (-6, "I'm not saying it is bad, I'm saying it is late. That means either we run now or we hide. There's a difference. Not just the wind, but the sea. Not from fear, but from habit."),
    (-7, "Anna was angry. They felt happy and he seemed nervous. She spoke angrily, then sadly, then wearily. We looked proud."),
    (-8, "One two three four. Five six seven eight. Nine ten one two."),
    (-9, "Short text — with dashes -- and --- more — here."),
    (-10, "Some words here in a row, then some more of them so that the share of dashes is small — yes. The bell rang a third time. The iron clapper struck the bell."),
    (-11, ""),
    (-12, "   \n\n  "),
    (-13, "Hand, eye and heart: his breath was cold. He felt the weight of meaning. He saw the notion of an idea. he ran the way home like a fool, as if chased, as a boy."),
    (-14, "One line here now.\n\n---\n\nAnother line is here.\n---\nThe last one is here."),
    (-15, "# Heading\n\nThe first paragraph is \"quoted speech\" and 'more speech' too.\n\n---\n\nThe last paragraph has a few words more than that one."),
    (-16, "Only one sentence stands in this text"),
    (-17, "Some words with odd\x1cspaces here. élan and a sense of élan. Naïve Émile was happy."),
    (-18, "However! furthermore, yes indeed.\n\nHowever, no.\n\nNevertheless - no.\n\nPlain."),
]


def text_literal(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], names: list[str]) -> str:
    """A FROM item for DuckDB with literal rows."""

    def one(v: object) -> str:
        return text_literal(v) if v is None or isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS probe({', '.join(names)})"


#: A table of texts up to this many bytes may lie in one row group, which a single task would read.
SMALL_TABLE = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; small ones of texts are dealt over all cores, for what is done with texts costs more than moving them."""
    path = f"{sf_dir}/{name}.parquet"
    read = spark.read.parquet(path)
    if name in ("documents", "conversations"):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        size = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
        if (1 << 20) < size <= SMALL_TABLE:
            return read.repartition(spark.sparkContext.defaultParallelism)
    return read


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, sep: documents, whose paragraphs end at line ends, and the probes, whose paragraphs end at blank lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("\n").alias("sep"))
    return docs.union(local(spark, [(i, t, "\n\n") for i, t in PROSE], "doc_id long, text string, sep string"))


PROSE_SQL = "corpus AS (SELECT doc_id, coalesce(text, '') AS text, chr(10) AS sep FROM documents UNION ALL SELECT doc_id, text, chr(10) || chr(10) FROM " + values(PROSE, ["doc_id", "text"]) + ")"


def comparable(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and floats as DOUBLE rounded to 9 places, as the SQL has them."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegerType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 9)
        out.append(c.alias(f.name))
    return df.select(*out)
