"""Files as records: source trees and corpora of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from leakscan.functions.arrays import let
from leakscan.session import settle

# Directories never read, file types of a corpus, and the shortest line.
SKIP_TREE = (".git", "node_modules", "vendor", ".hg", ".svn")
SKIP_CORPUS = ("node_modules", ".git", "vendor", "dist", "build", ".venv", "venv", "target", "__pycache__", ".next",
               "out", "tmp", ".cache")
CORPUS_EXTENSIONS = (
    ".go", ".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".kt", ".rb", ".rs", ".swift", ".c", ".h", ".cc", ".cpp", ".cs",
    ".yaml", ".yml", ".json", ".toml", ".ini", ".sh", ".bash", ".zsh", ".tf", ".tfvars", ".hcl", ".sql", ".env", ".md",
    ".txt", ".php", ".pl",
)
MIN_LINE_BYTES = 4


def _below(path: Column, folders: tuple[str, ...]) -> Column:
    """Whether any folder of a relative path is one of ``folders``."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*[F.lit(f) for f in folders]))


def relative(path: Column, root: str) -> Column:
    """Path below ``root``, for paths as Spark reports them."""
    bare = F.regexp_replace(path, r"\A[a-z0-9+.-]+:/+", "/")
    prefix = root.split("://", 1)[-1].rstrip("/") + "/"
    return F.when(F.contains(bare, F.lit(prefix)), F.substring(bare, F.position(F.lit(prefix), bare) + len(prefix), F.length(bare))).otherwise(bare)


def text_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Text files (path, content) among (path, length, content BINARY): not empty and without a byte 0.

    ``max_bytes`` leaves larger files out.
    """
    sized = files.filter((F.col("length") > 0) & ~_below(F.col("path"), SKIP_TREE))
    if max_bytes is not None:
        sized = sized.filter(F.col("length") <= max_bytes)
    plain = sized.filter(~F.contains(F.decode("content", "ISO-8859-1"), F.lit("\0")))
    return plain.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))


def read_file_tree(spark: SparkSession, root: str) -> DataFrame:
    """Text files below ``root`` with relative paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return text_files(files.select(relative(F.col("path"), root).alias("path"), "length", "content")).select("path", "content")


def build_corpus(files: DataFrame, target: int | None = None, per_file: int | None = None, max_line: int | None = None) -> DataFrame:
    """Corpus lines (path, line_no, content) of files (path, content): known extensions, lines of 4 bytes or more.

    With ``max_line`` a file is read up to its first line of so many bytes, with
    ``per_file`` up to so many lines. ``target`` keeps the first lines in order
    of path, where the size of a corpus is given: the ordered lines are written
    to the shared folder, and only line counts per part come to the driver.
    """
    extension = F.lower(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"(\.[^.]*)\z", 1))
    known = files.filter(extension.isin(*CORPUS_EXTENSIONS) & ~_below(F.col("path"), SKIP_CORPUS))
    lines = F.transform(F.split(F.regexp_replace("content", r"\n\z", ""), "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("content")))
    read = F.filter(numbered, lambda x: F.octet_length(x["content"]) >= MIN_LINE_BYTES)
    if max_line is not None:
        long = F.filter(numbered, lambda x: F.octet_length(x["content"]) >= max_line)
        until = F.coalesce(F.array_min(F.transform(long, lambda x: x["line_no"])), F.lit(2**31 - 1))
        read = let(until, lambda end: F.filter(numbered, lambda x: (F.octet_length(x["content"]) >= MIN_LINE_BYTES) & (x["line_no"] < end)))
    rows = known.select("path", F.inline(read if per_file is None else F.slice(read, 1, per_file))).withColumn("content", F.replace("content", F.lit("|"), F.lit("\t")))
    if target is None:
        return rows
    ordered = settle(rows.repartitionByRange("path", "line_no").withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["count"] for r in ordered.groupBy("_part").count().collect()}
    room, full, last = target, [], -1
    for part in sorted(counts):
        last = part
        if counts[part] > room:
            break
        room, last = room - counts[part], -1
        full.append(part)
    place = F.row_number().over(Window.partitionBy("_part").orderBy("path", "line_no"))
    cut = ordered.filter(F.col("_part") == last).withColumn("_place", place).filter(F.col("_place") <= room).drop("_place")
    whole = ordered.filter(F.col("_part") <= (full[-1] if full else -1))
    return whole.unionByName(cut).drop("_part")


def format_corpus(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.concat_ws("|", "path", F.col("line_no").cast("string"), "content").alias("value"))


def parse_corpus(lines: DataFrame, value: str = "value") -> DataFrame:
    """Corpus rows of ``path|line|content`` lines; lines with fewer parts are dropped, a bad number is 0."""
    parts = F.split(F.col(value), r"\|", 3)
    number = F.when(F.get(parts, F.lit(1)).rlike(r"\A[+-]?[0-9]+\z"), F.get(parts, F.lit(1)).try_cast("int"))
    return lines.filter(F.size(parts) == 3).select(
        F.get(parts, F.lit(0)).alias("path"), F.coalesce(number, F.lit(0)).alias("line_no"), F.get(parts, F.lit(2)).alias("content"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return parse_corpus(spark.read.text(path))
