"""Corpus sources: a table with one row per file.

``repo, path, length, content`` — ``path`` starts with the repository name and
is relative to the folder that holds the repositories.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import text
from lintlake.functions.constants import texts_literal

# Which files a scan reads.
SCANNABLE_EXTENSIONS = [
    ".py", ".sql", ".yaml", ".yml", ".tf", ".hcl",
    ".js", ".ts", ".jsx", ".tsx", ".java", ".scala",
    ".rb", ".go", ".sh", ".bash", ".json",
]
SKIP_DIRECTORIES = [
    ".git", "node_modules", "venv", ".venv", "__pycache__",
    "dist", "build", "target", ".idea", ".vscode", "vendor", "tools/vendor",
]
MAX_FILE_BYTES = 1_000_000

# Which files a single reviewer reads from a directory.
CODE_EXTENSIONS = [
    ".py", ".js", ".ts", ".java", ".sql", ".sh", ".bash",
    ".yml", ".yaml", ".json", ".xml", ".env", ".config",
]
REVIEWER_EXTENSIONS = {
    "security": CODE_EXTENSIONS,
    "privacy": CODE_EXTENSIONS,
    "permission": [".sql", ".py", ".tf", ".hcl", ".yml", ".yaml", ".json"],
}


def table_corpus(df: DataFrame, repo: str, path: str, content: str) -> DataFrame:
    """A corpus from a table that already holds decoded text."""
    return df.select(
        F.col(repo).alias("repo"),
        F.col(path).alias("path"),
        F.octet_length(content).cast("long").alias("length"),
        text.fold_newlines(F.col(content)).alias("content"),
    )


def in_directory(path: Column, names: Iterable[str]) -> Column:
    return F.arrays_overlap(text.parent_names(path), texts_literal(list(names)))


def is_scannable(path: Column) -> Column:
    """Pruning by name alone, so it never touches the content."""
    return text.path_suffix(path).isin(SCANNABLE_EXTENSIONS) & ~in_directory(path, SKIP_DIRECTORIES)


def skip_reason(max_bytes: int | None = MAX_FILE_BYTES) -> Column:
    """Why a scan leaves a file of a corpus out; null if it reads it."""
    return (
        F.when(F.startswith(F.col("repo"), F.lit(".")), "hidden repository")
        .when(in_directory(F.col("path"), SKIP_DIRECTORIES), "directory")
        .when(~text.path_suffix(F.col("path")).isin(SCANNABLE_EXTENSIONS), "extension")
        .when(F.lit(False) if max_bytes is None else F.col("length") > max_bytes, "size"))


def prune(corpus: DataFrame, max_bytes: int | None = MAX_FILE_BYTES) -> DataFrame:
    """Keep the files a scan reads: by extension, directory and size (``None``: any size)."""
    size = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    return corpus.where(size & is_scannable(F.col("path")) & ~F.startswith(F.col("repo"), F.lit(".")))


def skipped_files(corpus: DataFrame, max_bytes: int | None = MAX_FILE_BYTES) -> DataFrame:
    """``repo, path, length, reason`` of the files that ``prune`` leaves out."""
    return corpus.withColumn("reason", skip_reason(max_bytes)).where("reason IS NOT NULL").select(
        "repo", "path", "length", "reason")


def qualified(spark: SparkSession, root: str) -> str:
    """The root as the reader writes it: absolute, with its scheme, without dots, not encoded."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    absolute = files.makeQualified(path)
    inside = spark._jvm.java.net.URI(None, None, absolute.toUri().getPath(), None).normalize().getPath()
    return spark._jvm.org.apache.hadoop.fs.Path(absolute.toUri().getScheme(), absolute.toUri().getAuthority(), inside).toString()


def relative_path(root: str, path: Column) -> Column:
    """Path below the qualified root; null for what does not lie below it."""
    base = F.lit(root.rstrip("/") + "/")
    return F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path)))


def listed_path() -> Column:
    """The file's path as the listing has it, which is URI-encoded, in plain text."""
    # A plus sign is itself in a path, while form decoding takes it for a blank.
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/+", "file:/")


BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def keep_files(
    files: DataFrame,
    root: str,
    *,
    keep: Callable[[Column], Column] | None = None,
    max_bytes: int | None = None,
    recursive: bool = True,
) -> DataFrame:
    """``path, length, content`` of the wanted raw files.

    The conditions are put on the file metadata, so they prune the listing and
    the content of other files is never read.
    """
    root = qualified(files.sparkSession, root)
    listed = relative_path(root, listed_path())
    if keep is not None:
        files = files.where(keep(listed))
    if not recursive:
        files = files.where(~F.contains(listed, F.lit("/")))
    if max_bytes is not None:
        files = files.where(F.col("_metadata.file_size") <= max_bytes)
    return files.select(listed.alias("path"), "length", "content")


def read_files(spark: SparkSession, root: str, **wanted) -> DataFrame:
    """Raw files below a folder; ``wanted`` as in ``keep_files``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return keep_files(files, root, **wanted)


def with_repo(files: DataFrame) -> DataFrame:
    """The first folder of the path names the repository; loose files drop out."""
    return files.where(F.contains("path", F.lit("/"))).withColumn(
        "repo", F.split_part("path", F.lit("/"), F.lit(1))
    )


def repository_corpus(spark: SparkSession, root: str, max_bytes: int | None = MAX_FILE_BYTES) -> DataFrame:
    """Every scannable file of every repository below ``root``, up to a size (``None``: any size)."""
    files = prune(with_repo(read_files(spark, root, keep=is_scannable, max_bytes=max_bytes)), max_bytes)
    return files.select("repo", "path", "length", text.decode_lenient(F.col("content")).alias("content"))


def reviewer_corpus(
    spark: SparkSession, directory: str, agent: str, *, recursive: bool = True
) -> DataFrame:
    """One reviewer's files of one directory.  Files that are not UTF-8 drop out."""
    files = read_files(
        spark, directory, recursive=recursive,
        keep=lambda path: text.path_suffix(path).isin(REVIEWER_EXTENSIONS[agent]),
    )
    return files.where(F.is_valid_utf8(F.col("content").cast("string"))).select(
        F.lit(directory.rstrip("/").rsplit("/", 1)[-1]).alias("repo"),
        "path",
        "length",
        text.fold_newlines(F.col("content").cast("string")).alias("content"),
    )
