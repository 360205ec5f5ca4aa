"""Files as rows: folders, tracked files, single reads, and what to take of them."""

from __future__ import annotations

import subprocess
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import content_type, file_name, language, matches_any, matches_include

#: What a listing takes and leaves by default.
DEFAULT_INCLUDE = [
    "*.cs", "*.md", "*.txt", "*.json", "*.yaml", "*.yml", "*.ts", "*.tsx", "*.js", "*.jsx", "*.py", "*.rs",
    "*.csproj", "*.sln", "*.props", "*.targets", "*.fsproj",
]
DEFAULT_EXCLUDE = [
    "**/bin/**", "**/obj/**", "**/node_modules/**", "**/.git/**", "**/.vs/**", "**/packages/**", "**/dist/**", "**/.nuget/**",
    "**/*.dll", "**/*.exe", "**/*.pdb", "**/*.cache", "**/wwwroot/lib/**", "**/.idea/**", "**/coverage/**",
    "**/.venv/**", "**/venv/**", "**/cache/**", "**/publish/**", "**/temp/**", "**/TestResults/**", "**/__pycache__/**",
]


def scan_folder(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """(path, content, modified) of text files. As a file is listed once per include pattern that it matches, it has a row for each."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    patterns = DEFAULT_INCLUDE if include is None else include
    # On the file's own path, so that files are left out as they are listed and their bytes are never read.
    listed = F.col("_metadata.file_path")
    raw = raw.filter(reduce(lambda a, b: a | b, [matches_include(listed, p) for p in patterns], F.lit(False)) & ~matches_any(listed, DEFAULT_EXCLUDE if exclude is None else exclude))
    files = raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("modificationTime").alias("modified"), "content")
    hits = F.array(*[F.when(matches_include(F.col("path"), p), F.lit(k)) for k, p in enumerate(patterns)])
    return files.withColumn("hit", F.explode(F.filter(hits, lambda x: x.isNotNull()))).select("path", F.decode("content", "UTF-8").alias("content"), "modified")


def tracked_files(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(path): files that version control tracks, include patterns first, then exclude."""
    out = subprocess.run(["git", "-C", root, "ls-files", "-z"], capture_output=True, text=True, check=True).stdout
    rows = [(f"{root}/{p}",) for p in out.split("\0") if p]
    df = spark.createDataFrame(rows, "path string")
    keep = F.lit(False)
    for p in DEFAULT_INCLUDE if include is None else include:
        keep = keep | matches_include(F.col("path"), p)
    return df.filter(keep & ~matches_any(F.col("path"), DEFAULT_EXCLUDE if exclude is None else exclude))


def described(files: DataFrame, path: Column | None = None) -> DataFrame:
    """files with name, content type and language."""
    p = F.col("path") if path is None else path
    return files.withColumns({"name": file_name(p), "content_type": content_type(p), "language": language(p)})


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def scan_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with its declared schema; nothing is inferred."""
    return spark.read.schema(schema).parquet(path)
