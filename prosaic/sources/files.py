"""Files of a writing project as tables, and tables as such files.

Paths may be of any file system that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosaic.functions import text as t
from prosaic.operators.markup import manuscript

LAYERS = ["voice", "world", "characters", "outline", "canon"]
EXPERIMENTS = ["commit", "phase", "score", "word_count", "status", "description"]

# Schemas of logs.
CUT = "struct<quote:string,type:string,reason:string,action:string,rewrite:string>"
CUTS = f"cuts array<{CUT}>, total_cuttable_words int, tightest_passage string, loosest_passage string, overall_fat_percentage int, one_sentence_verdict string"
DIM = "struct<score:string,weakest_moment:string,fix:string,gap:string,note:string>"
PANEL = "readers map<string,map<string,variant>>, timestamp string"
SCRIPT = "chapter int, title string, segments array<struct<speaker:string,text:string>>, total_segments int, speakers array<string>, total_chars int"
VOICES = "map<string,struct<voice_id:string,description:string,why:string>>"
STATE = "phase string, current_focus string, iteration int, foundation_score double, lore_score double, chapters_drafted int, chapters_total int, novel_score double, revision_cycle int, debts array<string>"


def _files(spark: SparkSession, pattern: str) -> list[tuple[str, str, int, int]]:
    """(path, name, time of writing, length) of what matches; a project's folder has a bounded number of files."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return [(f.getPath().toString(), f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in found or []]


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or anything that a pattern matches, is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def write_file(spark: SparkSession, path: str, text: str, modified: int | None = None) -> None:
    """Writes one small file under its own name, which Spark's writers can't; modified is its time in seconds, if not now."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()
    if modified is not None:
        system.setTimes(target, modified * 1000, -1)


def newest(spark: SparkSession, pattern: str) -> DataFrame:
    """file_name, text of the file written last, the last name of those of one time; no row if nothing matches."""
    last = max(((modified, path) for path, _, modified, _ in _files(spark, pattern)), default=None)
    return texts(spark, last[1] if last else pattern)


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, length of the chapters' audio in order of names; test runs' files are left out."""
    found = spark.createDataFrame([(name, length) for _, name, _, length in _files(spark, f"{folder}/ch_*.mp3")], "file_name string, length long")
    return found.filter(~F.contains("file_name", F.lit("_test"))).orderBy("file_name")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """file_name, text: whole files; no rows if nothing matches."""
    found = _files(spark, path)
    # Spark's readers leave out files without a byte
    blank = spark.createDataFrame([(name, "") for _, name, _, length in found if length == 0], "file_name string, text string")
    if all(length == 0 for *_, length in found):
        return blank
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")).union(blank)


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """One row: the file's text, empty if it is missing."""
    one = spark.range(1)
    return one.join(F.broadcast(texts(spark, path).limit(1)), how="left").select(F.coalesce("text", F.lit("")).alias("text"))


def layers(spark: SparkSession, folder: str, names: list[str] = LAYERS) -> DataFrame:
    """layer, text: the named Markdown files of a folder; a missing one is empty."""
    wanted = spark.createDataFrame([(n,) for n in names], "layer string")
    found = texts(spark, f"{folder}/*.md").select(F.regexp_replace("file_name", r"\.md$", "").alias("layer"), "text")
    return wanted.join(found, "layer", "left").select("layer", F.coalesce("text", F.lit("")).alias("text"))


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    """chapter, text: files ch_NN.md, numbered by their names."""
    found = texts(spark, f"{folder}/ch_*.md")
    return found.select(F.regexp_extract("file_name", r"ch_([0-9]+)", 1).try_cast("int").alias("chapter"), "text").filter("chapter is not null")


def chapter(spark: SparkSession, folder: str, n: int) -> DataFrame:
    return load_file(spark, f"{folder}/ch_{n:02d}.md")


def json_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file_name, the schema's columns, _corrupt_record: whole-file JSON; a file that isn't JSON keeps its row and its text."""
    empty = f"file_name string, {schema}, _corrupt_record string"
    if not _exists(spark, path):
        return spark.createDataFrame([], empty)
    read = spark.read.schema(f"{schema}, _corrupt_record string").json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return read.select(F.col("_metadata.file_name").alias("file_name"), *read.columns)


def cuts(spark: SparkSession, folder: str) -> DataFrame:
    """chapter and CUTS: files chNN_cuts.json; a corrupt one has null cuts."""
    logs = json_logs(spark, f"{folder}/ch*_cuts.json", CUTS)
    return logs.select(F.regexp_extract("file_name", r"^ch([0-9]+)_cuts\.json$", 1).try_cast("int").alias("chapter"), *[c for c in logs.columns if c != "file_name"]).filter("chapter is not null")


def cut_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """The chapters that have a file of cuts, in order."""
    return cuts(spark, folder).select("chapter").distinct().orderBy("chapter")


def panel(spark: SparkSession, path: str) -> DataFrame:
    """reader, question, answer: a panel's map of maps as rows; answers that aren't strings are left out."""
    readers = json_logs(spark, path, PANEL).select(F.explode("readers").alias("reader", "answers"))
    rows = readers.select("reader", F.explode("answers").alias("question", "answer"))
    return rows.filter(F.schema_of_variant("answer") == "STRING").select("reader", "question", F.variant_get("answer", "$", "string").alias("answer"))


def evaluations(spark: SparkSession, path: str, dims: list[str]) -> DataFrame:
    """file_name, dims (map of the named dimensions), overall_score, lists of findings: judges' logs."""
    lists = ["top_3_revisions", "ai_patterns_detected", "three_weakest_sentences", "three_strongest_sentences"]
    plain = ["overall_score double", "novel_score double", "weakest_dimension string", "weakest_chapter int", "top_suggestion string", *[f"{x} array<string>" for x in lists]]
    logs = json_logs(spark, path, ", ".join([*[f"{d} {DIM}" for d in dims], *plain]))
    as_map = F.map_filter(F.create_map(*[x for d in dims for x in (F.lit(d), F.col(d))]), lambda k, v: v.isNotNull())
    return logs.select("file_name", as_map.alias("dims"), *[p.split()[0] for p in plain], "_corrupt_record")


def scripts(spark: SparkSession, folder: str) -> DataFrame:
    return json_logs(spark, f"{folder}/ch*_script.json", SCRIPT)


def voices(spark: SparkSession, path: str) -> DataFrame:
    """seq, speaker, voice_id, description, why: a map of voices in the file's order."""
    raw = texts(spark, path).select(F.from_json("text", VOICES).alias("m"))
    return raw.select(F.posexplode(F.map_entries("m")).alias("seq", "e")).select("seq", F.col("e.key").alias("speaker"), "e.value.*")


def state(spark: SparkSession, path: str) -> DataFrame:
    """One row: the saved state, defaults where it or a field is missing."""
    from prosaic.operators.control import with_defaults

    saved = json_logs(spark, path, STATE).select(*[f.split()[0] for f in STATE.split(", ")]).limit(1)
    return with_defaults(saved if not saved.isEmpty() else spark.createDataFrame([(None,) * 10], STATE))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def save_eval(df: DataFrame, folder: str, stamp: Column | str, kind: str) -> str:
    """Writes one evaluation under its time and kind; names sort by time. Returns the path."""
    when = stamp if isinstance(stamp, str) else df.select(stamp).first()[0]
    path = f"{folder}/{when}_{kind}"
    write_json(df, path)
    return path


def save_state(df: DataFrame, path: str) -> None:
    write_json(df.coalesce(1), path, "overwrite")


def append_experiments(df: DataFrame, folder: str) -> None:
    """Appends rows of EXPERIMENTS as tab-separated files, each with a header."""
    df.select(*EXPERIMENTS).write.mode("append").csv(folder, sep="\t", header=True)


def experiments(spark: SparkSession, folder: str) -> DataFrame:
    """The log of experiments, score as it was written; no rows if there is none."""
    schema = ", ".join(f"{c} {'int' if c == 'word_count' else 'string'}" for c in EXPERIMENTS)
    if not _exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(folder, sep="\t", header=True)


def write_edited(results: DataFrame, path: str) -> None:
    """Writes the new texts of documents that were edited, as a new version beside the old one."""
    results.filter("applied > 0 and new_text is not null").write.mode("errorifexists").parquet(path)


def write_markdown(df: DataFrame, path: str, text_col: str = "markdown") -> None:
    df.select(F.col(text_col).alias("value")).write.mode("overwrite").text(path, lineSep="\n")


def write_manuscript(df: DataFrame, path: str, n_col: str = "chapter", text_col: str = "text") -> None:
    write_markdown(manuscript(df, n_col, text_col), path, "text")


def novel_title(outline: DataFrame, first_chapter: DataFrame) -> DataFrame:
    """title: the outline's first line, else the first chapter's, else 'Untitled Novel'. Both are rows of one text."""
    own = outline.select(t.title_line(F.col("text")).alias("a")).crossJoin(first_chapter.select(t.title_line(F.col("text")).alias("b")))
    return own.select(F.when(F.col("a") != "", F.col("a")).when(F.col("b") != "", F.col("b")).otherwise("Untitled Novel").alias("title"))
