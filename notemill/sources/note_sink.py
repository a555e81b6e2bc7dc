"""A sink of notes in two phases, so that a lost executor leaves neither half a note nor half a decision.

Staging is a data source writer: tasks judge the rows of a plan against the storage as it is and write their contents beside
it, in a folder of the attempt; the job's commit names one attempt of each task, its abort removes all. While any row blocks
the run, nothing has been published. Publishing then moves staged notes to their places, a task a staged folder: new notes
by a link, which never replaces a file, merged ones by an atomic replacement. Every step can be repeated: what an earlier
attempt has done is recognised by its contents.

Storage is a POSIX file system that driver and executors share.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

PLAN = "source string, kind string, path string, action string, content string, sermon_id string"
RESULT = "source string, kind string, path string, action string, status string, sermon_id string"
OUTCOME = "_outcome.json"
#: Blocked paths that a task tells.
SHOWN = 10


def _read(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="ignore", newline="") as f:
            return f.read()
    except FileNotFoundError:
        return None


def _write(path: str, content: str) -> None:
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())


def preserved(before: str, after: str) -> bool:
    """Whether a merged note still holds the frontmatter and every bullet of the note before."""
    head = re.match(r"---\n.*?\n---\n", before, re.DOTALL)
    bullets = (re.sub(r"^\s*[-*]\s+", "", line).strip() for line in before[head.end() if head else 0 :].splitlines() if re.match(r"\s*[-*]\s+", line))
    return (head is None or head.group() in after) and all(b in after for b in bullets)


@dataclass
class StagedTask(WriterCommitMessage):
    folder: str
    rows: int
    blocked: list[str] = field(default_factory=list)


def judge(row, path: str, main_skipped: str | None) -> tuple[str, str | None]:
    """(status, why it blocks the run); status `stage` means to write. main_skipped is the status of the row's main note if that is not written."""
    before = None
    if row.kind != "main" and main_skipped:
        return "skip", None  # no fragment may point at a note that did not change
    if row.action == "conflict":
        return "skip_conflict", f"exists: {path}"
    if row.action not in ("create", "merge"):
        return row.action, None
    before = _read(path)
    if before is None or before == row.content:
        return "stage", None
    if row.action == "merge":
        return ("stage", None) if preserved(before, row.content) else ("rolled_back", f"merge would lose text: {path}")
    return ("skip_conflict", f"appeared: {path}") if row.kind == "main" else ("skip", None)


class _Staging(DataSourceWriter):
    def __init__(self, options):
        self.stage, self.root = options["path"], options.get("root", "")
        self.skip_conflicts = options.get("skip_conflicts", "false") == "true"

    def write(self, iterator):
        """Rows come grouped by source, the main note first."""
        folder = os.path.join(self.stage, f"task-{uuid.uuid4().hex}")
        os.makedirs(folder)
        blocked, n, source, skipped = [], 0, None, None
        with open(os.path.join(folder, "index"), "w", encoding="utf-8") as index:
            for n, row in enumerate(iterator, 1):
                if n == 1 or row.source != source:
                    source, skipped = row.source, None
                status, why = judge(row, os.path.join(self.root, row.path), skipped)
                if row.kind == "main" and status != "stage":
                    skipped = status
                if why and not (self.skip_conflicts and status == "skip_conflict"):
                    blocked = [*blocked, why][:SHOWN]
                if status == "stage":
                    _write(os.path.join(folder, str(n)), row.content or "")
                index.write(json.dumps([row.source, row.kind, row.path, row.action, status, row.sermon_id, n], ensure_ascii=False) + "\n")
            index.flush()
            os.fsync(index.fileno())
        return StagedTask(folder, n, blocked)

    def commit(self, messages):
        done = [m for m in messages if m is not None]
        outcome = {"blocked": [b for m in done for b in m.blocked][:SHOWN], "folders": [m.folder for m in done if m.rows]}
        temporary = os.path.join(self.stage, f"{OUTCOME}.{uuid.uuid4().hex}")
        _write(temporary, json.dumps(outcome))
        os.replace(temporary, os.path.join(self.stage, OUTCOME))

    def abort(self, messages):
        shutil.rmtree(self.stage, ignore_errors=True)


class NoteStage(DataSource):
    @classmethod
    def name(cls):
        return "note_stage"

    def schema(self):
        return PLAN

    def writer(self, schema, overwrite):
        os.makedirs(self.options["path"], exist_ok=True)
        return _Staging(self.options)


def _publish_new(staged: str, path: str) -> bool:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    try:
        os.link(staged, path)
        return True
    except FileExistsError:
        return _read(path) == _read(staged)  # an earlier attempt of this task


def _publish_merge(staged: str, path: str) -> str:
    content, before = _read(staged), _read(path)
    if before is None:
        return "written" if _publish_new(staged, path) else "exists"
    if before == content:
        return "merged"
    if not preserved(before, content):  # the note changed after it was staged
        return "rolled_back"
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    _write(temporary, content)
    os.replace(temporary, path)
    return "merged"


def publish_folder(folder: str, root: str):
    """Publishes a staged folder and yields its rows as RESULT. May be called again after it was cut off at any point."""
    source, skipped, first = None, False, True
    with open(os.path.join(folder, "index"), encoding="utf-8") as index:
        for line in index:
            own, kind, path, action, status, sermon_id, n = json.loads(line)
            if first or own != source:
                source, skipped, first = own, False, False
            if status == "stage":
                staged, place = os.path.join(folder, str(n)), os.path.join(root, path)
                if skipped and kind != "main":
                    status = "skip"
                elif action == "merge":
                    status = _publish_merge(staged, place)
                elif _publish_new(staged, place):
                    status = "written"
                else:  # it appeared after staging
                    status, skipped = ("skip_conflict", True) if kind == "main" else ("skip", skipped)
            yield own, kind, path, action, status, sermon_id
