"""Discovery of folders within budgets: a level of folders a round, each round one job over the folders of that level.

A round's folders are dealt evenly over tasks, so one deep or wide folder of the top does not hold up one task, and the
budgets of folders and time end the walk between rounds (time also within one). What was listed is written once a round.
"""

from __future__ import annotations

import glob
import os
import time
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.shared import checkpoint

# fixed values: folders that are not walked, parts of a path under which they are, depths and budgets
SKIPPED = ["node_modules", "__pycache__", "Library", "Applications", "Movies", "Music", "Pictures", "Public", "site-packages", "venv", ".venv", "AppData", "Program Files"]
KEPT = ["CloudStorage", "Mobile Documents"]
MAX_DEPTH, VAULT_DEPTH = 3, 4
FOLDER_BUDGET, TIME_BUDGET = 20000, 20.0
# fixed values: where documents of a home folder lie
HOME = ["Documents", "Desktop", "Downloads", "Library/Mobile Documents/com~apple~CloudDocs", "Library/CloudStorage/*"]
CLOUDS = ["Google Drive*", "GoogleDrive*", "OneDrive*", "Dropbox*", "내 드라이브*", "구글 드라이브*", "내 문서*"]

ENTRY = "root string, path string, name string, suffix string, size bigint, depth int, mtime timestamp, folder boolean, late boolean"
#: Folders of a task in a round, at least.
A_TASK = 50


def search_roots(home: str, extra: list[str] | None = None) -> list[str]:
    """The given folders as they are, else those of a home folder and the home folder itself; each once, at its first place."""
    if extra:
        return [os.path.expanduser(e) for e in extra]
    found = []
    for pattern in [*HOME, *CLOUDS]:
        path = os.path.join(home, pattern)
        found += sorted(filter(os.path.isdir, glob.glob(path))) if "*" in pattern else [path]
    return list(dict.fromkeys([*found, home]))


def skipped(path: Column, skip: list[str] = SKIPPED, keep: list[str] = KEPT) -> Column:
    """A hidden or temporary folder, or one on the list that is not under a kept one."""
    name = F.element_at(F.split(path, "/"), -1)
    kept = reduce(lambda a, k: a | F.contains(path, F.lit(k)), keep, F.lit(False))
    return name.startswith(".") | name.startswith("~") | (name.isin(*skip) & ~kept)


def _listed(deadline: float):
    names = [f.split()[0] for f in ENTRY.split(", ")]

    def entries(root: str, path: str, depth: int):
        if time.time() > deadline:
            yield root, path, "", "", None, depth, None, True, True
            return
        try:
            found = sorted(os.scandir(path), key=lambda e: e.name)
        except OSError:  # a folder that cannot be read has nothing to show
            return
        for e in found:
            try:
                if e.is_dir(follow_symlinks=False):
                    yield root, e.path, e.name, "", None, depth + 1, None, True, False
                elif e.is_file(follow_symlinks=False):
                    stat = e.stat(follow_symlinks=False)
                    yield root, e.path, e.name, os.path.splitext(e.name)[1].lower(), stat.st_size, depth, pd.Timestamp(stat.st_mtime_ns // 1000, unit="us"), False, False
            except OSError:
                yield root, e.path, e.name, os.path.splitext(e.name)[1].lower(), None, depth, None, False, False

    def work(batches):
        for batch in batches:
            rows = [r for root, path, depth in zip(batch["root"], batch["path"], batch["depth"], strict=True) for r in entries(root, path, depth)]
            yield pd.DataFrame(rows, columns=names).astype({"size": "Int64", "depth": "int32", "mtime": "datetime64[us]"})

    return work


def walk(
    spark: SparkSession,
    roots: list[str],
    max_depth: int = MAX_DEPTH,
    folder_budget: int = FOLDER_BUDGET,
    time_budget: float = TIME_BUDGET,
    suffixes: list[str] | None = None,
    skip: list[str] = SKIPPED,
    keep: list[str] = KEPT,
) -> tuple[DataFrame, DataFrame, bool]:
    """(folders visited, files found, truncated) under the roots, in breadth, a root at depth 0.

    Folders have root, path and depth; files have root and the columns of a listing, `depth` being that of their folder. The
    folders of the deepest level are visited and not entered. truncated tells that a budget left folders out: of the level that
    does not fit the first by path are taken. A folder reached from several roots counts for the first.
    suffixes keeps files of these types only, before anything is written. A missing root is left out.
    """
    deadline, visited, depth, truncated = time.time() + time_budget, 0, 0, False
    frontier = spark.createDataFrame([(r, r, k) for k, r in enumerate(dict.fromkeys(roots)) if os.path.isdir(r)], "root string, path string, place int")
    seen, levels = [], []
    while True:
        count = frontier.count()
        if not count:
            break
        left = folder_budget - visited
        if count > left or time.time() > deadline:
            truncated = True
            if left <= 0 or time.time() > deadline:
                break
            frontier = frontier.orderBy("path").limit(left)
        level = frontier.select("root", "path", F.lit(depth).alias("depth"))
        tasks = max(1, min(-(-min(count, left) // A_TASK), 4 * spark.sparkContext.defaultParallelism))
        rows = level.repartition(tasks, "path").mapInPandas(_listed(deadline), ENTRY)
        wanted = F.col("folder") | (F.col("suffix").isin(*suffixes) if suffixes is not None else F.lit(True))
        found = checkpoint(rows.where(wanted & ~(F.col("folder") & ~F.col("late") & skipped(F.col("path"), skip, keep))))
        late = found.where("late").select("path")
        seen.append(level.join(late, "path", "left_anti").select("root", "path", "depth"))
        levels.append(found)
        if not late.isEmpty():
            truncated = True
            break
        visited += min(count, left)
        if depth >= max_depth or truncated:
            break
        before = reduce(lambda a, b: a.unionByName(b), [s.select("path") for s in seen])
        depth += 1
        frontier = checkpoint(found.where("folder").groupBy("path").agg(F.min("root").alias("root")).join(before, "path", "left_anti").select("root", "path"))
    none = spark.createDataFrame([], ENTRY)
    every = reduce(lambda a, b: a.unionByName(b), levels, none)
    folders = reduce(lambda a, b: a.unionByName(b), seen, none.select("root", "path", "depth"))
    return folders, every.where("NOT folder").drop("folder", "late"), truncated


def below(files: DataFrame, folders: DataFrame, marker: str) -> DataFrame:
    """(path, n) of the folders that hold one named `marker`, with the files below them, counted before they shuffle.

    A file counts for each of its parent folders, of which it has at most the walk's depth.
    """
    marked = folders.where(F.col("path").endswith(f"/{marker}")).select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()
    parts = F.split("path", "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    counts = files.select(F.explode(parents).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return marked.join(counts, "path", "left").select("path", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
