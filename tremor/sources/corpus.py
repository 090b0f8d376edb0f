"""Source corpora as tables of (repo, path, content)."""
from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.plans.loops import CutTable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Folders that are never scanned.
EXCLUDED_DIRS = (".git", "__pycache__", "venv", ".venv", "env", "node_modules", "dist", "build", "target", ".next", "coverage")


def keep_files(files: DataFrame, suffixes: list[str] = (), excluded=EXCLUDED_DIRS) -> DataFrame:
    """Drop files below excluded folders or nested repositories; optionally keep some suffixes."""
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    # A folder other than the root that holds a .git entry is another repository.
    marker = F.array_position(parts, ".git").cast("int")
    nested = files.where(marker > 1).select("repo", F.array_join(F.slice(parts, F.lit(1), F.greatest(marker - 1, F.lit(0))), "/").alias("_root")).distinct()
    out = files.where(~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in excluded])))
    if suffixes:
        out = out.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*[s.lower() for s in suffixes]))
    size = F.size(folders)
    roots = F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.array_join(F.slice(folders, F.lit(1), i), "/"))).otherwise(
        F.array().cast("array<string>"))
    below = out.select("repo", "path", F.explode(roots).alias("_root")).join(nested, ["repo", "_root"], "left_semi").select("repo", "path").distinct()
    return out.join(below, ["repo", "path"], "left_anti")


def _list_folders(root: str, excluded: tuple[str, ...]):
    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        for pdf in frames:
            rows = []
            for folder in pdf["path"]:
                entries = fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/{folder}".rstrip("/")))
                if "/" in folder and any(e.base_name == ".git" for e in entries):
                    continue  # another repository inside this one
                for e in entries:
                    is_dir = e.type == pyarrow.fs.FileType.Directory
                    if not (is_dir and e.base_name in excluded):
                        rows.append((f"{folder}/{e.base_name}".lstrip("/"), is_dir))
            yield pd.DataFrame(rows, columns=["path", "is_dir"])
    return listed


def _read_texts(root: str):
    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        for pdf in frames:
            for path in pdf["path"]:  # one file at a time: a batch of large files must not pile up in memory
                with fs.open_input_stream(f"{base}/{path}") as f:
                    text = f.readall().decode("utf-8", "replace")
                repo, _, rel = path.partition("/")
                yield pd.DataFrame([(repo, rel, text)], columns=["repo", "path", "content"])
    return texts


def read_files(spark: SparkSession, root: str, suffixes: list[str] = (), excluded=EXCLUDED_DIRS) -> DataFrame:
    """Read a folder of repositories (one folder each) as (repo, path, content), one row per file.

    Folders are listed level by level, each level as one distributed job, so excluded folders and
    nested repositories are never entered. Spark's own file listing is not used because it hides
    names that begin with ``_`` or ``.``, and with them every ``__init__.py``.
    """
    uri = root if "://" in root else f"file://{root}"
    folders = spark.createDataFrame([("",)], "path string")
    found = None
    while True:
        level = CutTable(folders.mapInPandas(_list_folders(uri, tuple(excluded)), "path string, is_dir boolean")).df
        files = level.where("NOT is_dir AND contains(path, '/')").select("path")
        found = files if found is None else found.unionByName(files)
        folders = level.where("is_dir").select("path").repartition("path")
        if folders.isEmpty():
            break
    if suffixes:
        found = found.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*[s.lower() for s in suffixes]))
    return found.repartition("path").mapInPandas(_read_texts(uri), "repo string, path string, content string")


def scan_plan(files: DataFrame, excluded=EXCLUDED_DIRS) -> tuple[DataFrame, DataFrame]:
    """(included file count per repo, excluded folders per repo)."""
    included = keep_files(files).groupBy("repo").agg(F.count(F.lit(1)).alias("included_files"))
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    first = F.array_position(F.transform(folders, lambda d: d.isin(*excluded)), True).cast("int")
    dropped = files.where(first > 0).select("repo", F.array_join(F.slice(folders, F.lit(1), F.greatest(first, F.lit(0))), "/").alias("directory")).distinct()
    return included, dropped
