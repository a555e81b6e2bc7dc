"""Plans of notes and their commit: nothing is written before approval, and nothing is ever overwritten."""

from __future__ import annotations

import json
import os
import shutil
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.shared import checkpoint
from notemill.sources import note_sink


def action(exists: Column, same: Column, mergeable: Column) -> Column:
    """M3: create, merge, skip or conflict."""
    return F.when(~exists, "create").when(same, "skip").when(mergeable, "merge").otherwise("conflict")


def summarize(plan: DataFrame) -> DataFrame:
    """Rows by kind and action."""
    return plan.groupBy("kind", "action").agg(F.count(F.lit(1)).alias("n"))


def _rows(plan: DataFrame) -> DataFrame:
    """The sink's columns; without a source each row stands for itself, without a kind it is a main note."""
    has = {c.lower() for c in plan.columns}
    given = {"source": F.col("path"), "kind": F.lit("main"), "sermon_id": F.lit(None)}
    names = [f.split()[0] for f in note_sink.PLAN.split(", ")]
    return plan.select(*[(F.col(n) if n in has else given[n]).cast("string").alias(n) for n in names])


def stage(plan: DataFrame, root: str, folder: str, skip_conflicts: bool = False) -> list[str]:
    """K1, first phase: judge the plan against the storage and write what it would write into folder; returns what blocks it.

    A source's rows meet in one task, its main note first, so that its fragments follow what becomes of it.
    """
    plan.sparkSession.dataSource.register(note_sink.NoteStage)
    rows = _rows(plan).repartition("source").sortWithinPartitions("source", F.col("kind") != "main", "path")
    rows.write.format("note_stage").mode("append").option("root", root).option("skip_conflicts", str(skip_conflicts).lower()).save(folder)
    with open(os.path.join(folder, note_sink.OUTCOME), encoding="utf-8") as f:
        return json.load(f)["blocked"]


def publish(spark, root: str, folder: str) -> DataFrame:
    """K1, second phase: put staged notes in their places; rows (source, kind, path, action, status, sermon_id).

    May be called again for a folder whose publishing was cut off.
    """
    with open(os.path.join(folder, note_sink.OUTCOME), encoding="utf-8") as f:
        folders = json.load(f)["folders"]  # one for each task that staged
    names = [c.split()[0] for c in note_sink.RESULT.split(", ")]

    def tasks(batches):
        for batch in batches:
            for own in batch["folder"]:
                yield pd.DataFrame(list(note_sink.publish_folder(own, root)), columns=names)

    staged = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(max(len(folders), 1))
    return checkpoint(staged.mapInPandas(tasks, note_sink.RESULT))


def commit(plan: DataFrame, approve: str = "", skip_conflicts: bool = False, root: str = "", stage_folder: str | None = None) -> DataFrame:
    """K1, K4: write a plan's notes and return what became of each row: (source, kind, path, action, status, sermon_id).

    Needs approve="WRITE". Paths are relative to root. status is written, merged, skip, skip_conflict, rolled_back (a merge that
    would lose a line of the note as it is now) or the plan's own action for rows that write nothing.

    A conflict, a main note that has appeared since the plan, or a merge that would lose text stops everything before the first note is
    written. With skip_conflicts the first two only skip: a main note with all its fragments, a fragment alone. A main note that is
    skipped always takes its fragments with it. Notes are staged in stage_folder, by default a hidden folder of root (of the
    first note's folder where there is no root), on the same file system; it is removed at the end.
    """
    if approve != "WRITE":
        raise PermissionError("a plan is written only with approve='WRITE'")
    if stage_folder is None:
        first = plan.where("action IN ('create', 'merge')").select("path").first()
        stage_folder = os.path.join(root or (os.path.dirname(first.path) if first else "."), f".notemill-{uuid.uuid4().hex}")
    blocked = stage(plan, root, stage_folder, skip_conflicts)
    if blocked:
        shutil.rmtree(stage_folder, ignore_errors=True)
        lost = [b for b in blocked if b.startswith("merge")]
        raise (ValueError if lost else FileExistsError)("; ".join(lost or blocked))
    done = publish(plan.sparkSession, root, stage_folder)
    shutil.rmtree(stage_folder, ignore_errors=True)
    return done
