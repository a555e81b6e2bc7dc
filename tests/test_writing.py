"""Writing of notes: merges, skips, blocks, and tasks that are lost in the middle."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from notemill.plans import notes
from notemill.sources import note_sink

PLAN = "source string, kind string, path string, action string, content string, sermon_id string"


def plan_of(spark, *rows):
    return spark.createDataFrame([(*r, "id") for r in rows], PLAN).repartition(3)


def statuses(done):
    return {r.path: r.status for r in done.collect()}


def files(root: Path) -> dict[str, str]:
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()}


def test_commit_never_overwrites(spark, tmp_path):
    plan = plan_of(spark, ("s", "main", "x/a.md", "create", "new"))
    with pytest.raises(PermissionError):
        notes.commit(plan, root=str(tmp_path))
    assert statuses(notes.commit(plan, "WRITE", root=str(tmp_path))) == {"x/a.md": "written"}
    assert statuses(notes.commit(plan, "WRITE", root=str(tmp_path))) == {"x/a.md": "written"}  # the same note again
    (tmp_path / "x/a.md").write_text("old")
    with pytest.raises(FileExistsError):
        notes.commit(plan, "WRITE", root=str(tmp_path))
    assert statuses(notes.commit(plan, "WRITE", True, root=str(tmp_path))) == {"x/a.md": "skip_conflict"}
    with pytest.raises(FileExistsError):
        notes.commit(plan.withColumn("action", F.lit("conflict")), "WRITE", root=str(tmp_path))
    assert files(tmp_path) == {"x/a.md": "old"}
    bare = plan.select(F.concat(F.lit(f"{tmp_path}/y/"), F.lit("b.md")).alias("path"), "content", "action")
    assert [r.status for r in notes.commit(bare, "WRITE").collect()] == ["written"]
    assert files(tmp_path) == {"x/a.md": "old", "y/b.md": "new"}
    assert notes.commit(plan.limit(0), "WRITE", root=str(tmp_path)).count() == 0


OLD = "---\nmade: 1\n---\n\n- one\n* two\n\nend\n"


def test_merges_and_whole_skips(spark, tmp_path):
    (tmp_path / "f.md").write_text(OLD)
    (tmp_path / "main2.md").write_text("mine")
    rows = [
        ("s1", "main", "main1.md", "create", "one"),
        ("s1", "fragment", "f.md", "merge", OLD.replace("* two\n", "- two\n- three\n")),
        ("s1", "fragment", "g.md", "create", "g"),
        ("s1", "fragment", "h.md", "skip", None),
        ("s2", "main", "main2.md", "conflict", "two"),
        ("s2", "fragment", "k.md", "create", "k"),
        ("s3", "main", "main3.md", "skip", "three"),
        ("s3", "fragment", "l.md", "create", "l"),
        ("s4", "main", "s4", "failed", None),
    ]
    before = files(tmp_path)
    with pytest.raises(FileExistsError, match="main2"):
        notes.commit(plan_of(spark, *rows), "WRITE", root=str(tmp_path))
    assert files(tmp_path) == before
    done = notes.commit(plan_of(spark, *rows), "WRITE", True, root=str(tmp_path))
    assert statuses(done) == {
        "main1.md": "written", "f.md": "merged", "g.md": "written", "h.md": "skip", "main2.md": "skip_conflict", "k.md": "skip",
        "main3.md": "skip", "l.md": "skip", "s4": "failed"}
    assert files(tmp_path) == {"main1.md": "one", "f.md": OLD.replace("* two\n", "- two\n- three\n"), "g.md": "g", "main2.md": "mine"}
    assert {r.sermon_id for r in done.collect()} == {"id"}


@pytest.mark.parametrize("lost", [OLD.replace("made: 1", "made: 2"), OLD.replace("- one\n", "")])
def test_merge_that_loses_text(spark, tmp_path, lost):
    (tmp_path / "f.md").write_text(OLD)
    rows = [("s1", "main", "m.md", "create", "m"), ("s1", "fragment", "f.md", "merge", lost)]
    with pytest.raises(ValueError, match="lose"):
        notes.commit(plan_of(spark, *rows), "WRITE", True, root=str(tmp_path))
    assert files(tmp_path) == {"f.md": OLD}


def staged(tmp_path, rows, fail_at=None):
    """One task's attempt at staging, in this process; fails before the row numbered fail_at."""
    from collections import namedtuple

    Row = namedtuple("Row", "source kind path action content sermon_id")

    def given():
        for k, r in enumerate(rows):
            if k == fail_at:
                raise OSError("executor lost")
            yield Row(*r, None)

    root, stage = tmp_path / "vault", tmp_path / "stage"
    root.mkdir(exist_ok=True)
    return note_sink._Staging({"path": str(stage), "root": str(root)}), given


def test_lost_tasks_leave_no_half_notes(tmp_path, monkeypatch):
    rows = [("s", "main", "m.md", "create", "main"), *[("s", "fragment", f"f{k}.md", "create", f"text {k}") for k in range(5)], ("s", "fragment", "old.md", "merge", OLD + "- new\n")]
    writer, given = staged(tmp_path, rows, fail_at=3)
    (tmp_path / "vault/old.md").write_text(OLD)
    with pytest.raises(OSError):
        writer.write(given())
    writer, given = staged(tmp_path, rows)
    writer.commit([writer.write(given()), None])  # only the second attempt counts
    outcome = json.loads((tmp_path / "stage" / note_sink.OUTCOME).read_text())
    assert outcome["blocked"] == [] and len(outcome["folders"]) == 1 and files(tmp_path / "vault") == {"old.md": OLD}

    links, link = [], os.link

    def third_fails(a, b):
        if len(links) == 3:
            raise OSError("executor lost")
        links.append(b)
        link(a, b)

    monkeypatch.setattr(os, "link", third_fails)
    with pytest.raises(OSError):
        list(note_sink.publish_folder(outcome["folders"][0], str(tmp_path / "vault")))
    assert len(files(tmp_path / "vault")) == 4
    monkeypatch.setattr(os, "link", link)
    for _ in range(2):  # the retry, and a retry of what was done already
        done = {r[2]: r[4] for r in note_sink.publish_folder(outcome["folders"][0], str(tmp_path / "vault"))}
        assert done == {"m.md": "written", **{f"f{k}.md": "written" for k in range(5)}, "old.md": "merged"}
    assert files(tmp_path / "vault") == {"m.md": "main", **{f"f{k}.md": f"text {k}" for k in range(5)}, "old.md": OLD + "- new\n"}


def test_notes_that_appear_after_staging(tmp_path):
    rows = [("s", "main", "m.md", "create", "main"), ("s", "fragment", "f.md", "create", "f"), ("t", "main", "n.md", "create", "n"), ("t", "fragment", "old.md", "merge", OLD + "- new\n")]
    writer, given = staged(tmp_path, rows)
    (tmp_path / "vault/old.md").write_text(OLD)
    writer.commit([writer.write(given())])
    (folder,) = json.loads((tmp_path / "stage" / note_sink.OUTCOME).read_text())["folders"]
    (tmp_path / "vault/m.md").write_text("mine")
    (tmp_path / "vault/old.md").write_text(OLD + "- mine\n")
    done = {r[2]: r[4] for r in note_sink.publish_folder(folder, str(tmp_path / "vault"))}
    assert done == {"m.md": "skip_conflict", "f.md": "skip", "n.md": "written", "old.md": "rolled_back"}
    assert files(tmp_path / "vault") == {"m.md": "mine", "n.md": "n", "old.md": OLD + "- mine\n"}
    writer.abort([])
    assert not (tmp_path / "stage").exists()
