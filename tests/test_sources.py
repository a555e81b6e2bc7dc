"""Discovery within budgets, texts kept across runs, pages of PDF files."""

import os

import pytest

from notemill.sources import decode, walking


@pytest.fixture
def tree(tmp_path):
    """A home folder: five levels, folders that are not walked, and a link back to the top."""
    home = tmp_path / "home"
    for d in ("Documents/a/b/c/d", "Documents/.git", "Documents/node_modules/x", "Library/CloudStorage/Drive/y", "Library/Caches", "Dropbox (me)", "z"):
        (home / d).mkdir(parents=True)
    for f in ("Documents/1.md", "Documents/a/2.md", "Documents/a/b/c/4.md", "Documents/a/b/c/d/5.md", "Documents/a/3.bin", "Documents/.git/6.md", "Documents/node_modules/x/7.md", "Library/CloudStorage/Drive/y/8.md", "z/.hidden"):
        (home / f).write_text("text")
    os.symlink(home, home / "z/loop")
    return home


def walked(home, skip=walking.SKIPPED, deepest=3):
    """Files within the depth by a plain walk."""
    out, level = set(), [(str(home), 0)]
    for path, depth in level:
        for e in os.scandir(path):
            if e.is_dir(follow_symlinks=False):
                kept = any(k in e.path for k in walking.KEPT)
                if depth < deepest and not e.name.startswith((".", "~")) and (e.name not in skip or kept):
                    level.append((e.path, depth + 1))
            elif e.is_file(follow_symlinks=False):
                out.add((e.path, depth))
    return out, {p for p, _ in level}


@pytest.mark.parametrize("deepest", [0, 1, 3, 9])
def test_walk(spark, tree, deepest):
    folders, files, truncated = walking.walk(spark, [str(tree)], max_depth=deepest, skip=["node_modules"])
    want, visited = walked(tree, ["node_modules"], deepest)
    assert {(r.path, r.depth) for r in files.collect()} == want and {r.path for r in folders.collect()} == visited and not truncated
    some = walking.walk(spark, [str(tree)], max_depth=deepest, suffixes=[".md"], skip=["node_modules"])[1]
    assert {r.path for r in some.collect()} == {p for p, _ in want if p.endswith(".md")}


def test_walk_budgets(spark, tree):
    folders, files, truncated = walking.walk(spark, [str(tree)], folder_budget=3)
    assert truncated and [r.path for r in folders.orderBy("depth", "path").collect()] == [str(tree), f"{tree}/Documents", f"{tree}/Dropbox (me)"]
    assert {r.name for r in files.collect()} == {"1.md"}
    folders, files, truncated = walking.walk(spark, [str(tree)], time_budget=0.0)
    assert truncated and folders.count() == files.count() == 0
    folders, files, truncated = walking.walk(spark, [f"{tree}/none", str(tree / "Documents"), str(tree)], skip=[])
    assert not truncated and folders.count() == folders.select("path").distinct().count() and files.count() == files.select("path").distinct().count()
    assert walking.walk(spark, [])[1].count() == 0


def test_roots_and_vaults(spark, tree):
    roots = walking.search_roots(str(tree))
    assert roots[:3] == [f"{tree}/{d}" for d in ("Documents", "Desktop", "Downloads")] and f"{tree}/Library/CloudStorage/Drive" in roots and f"{tree}/Dropbox (me)" in roots and roots[-1] == str(tree)
    assert walking.search_roots(str(tree), ["/x", "/y"]) == ["/x", "/y"]
    (tree / "Documents/.obsidian").mkdir()
    folders, files, _ = walking.walk(spark, [str(tree)], max_depth=walking.VAULT_DEPTH)
    marks = folders.unionByName(spark.createDataFrame([("", f"{tree}/Documents/.obsidian", 2)], folders.schema))
    assert [tuple(r) for r in walking.below(files.where("suffix = '.md'"), marks, ".obsidian").collect()] == [(f"{tree}/Documents", 3)]


FILES = "path string, suffix string, content binary, converted string"


def test_texts_kept_across_runs(spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    rows = [("a.md", ".md", b"one", None), ("b.md", ".md", b"one", None), ("c.docx", ".docx", b"broken", None), ("d.txt", ".txt", "가".encode("cp949"), None), ("e.md", ".md", None, None), ("f.md", ".md", b"", None)]
    first = {r.path: (r.text, r.method, r.cached) for r in decode.extract(spark.createDataFrame(rows, FILES), cache).collect()}
    assert first["a.md"] == first["b.md"] == ("one", "utf-8", False) and first["d.txt"] == ("가", "cp949", False) and first["c.docx"][0] is None
    before = {p for p in (tmp_path / "cache").rglob("*.parquet")}
    rows = [("moved/x.md", ".md", b"one", None), ("y.md", ".md", b"two", None), ("c.docx", ".docx", b"broken", None), ("a.txt", ".txt", b"one", None), ("f.md", ".md", b"", None)]
    monkeypatch.setattr(decode, "_read_once", lambda once, real=decode._read_once: real(once.where("content != 'one' OR suffix != '.md'")))  # nothing kept is read again
    again = {r.path: (r.text, r.cached, r.error) for r in decode.extract(spark.createDataFrame(rows, FILES), cache).collect()}
    assert again["moved/x.md"] == ("one", True, None) and again["y.md"] == ("two", False, None) and again["a.txt"] == ("one", False, None) and again["f.md"] == ("", True, None)
    assert again["c.docx"][0] is None and again["c.docx"][2] and not again["c.docx"][1]
    assert before < {p for p in (tmp_path / "cache").rglob("*.parquet")}
    assert decode.extract(spark.createDataFrame([], FILES), cache).count() == 0


def test_pages_of_pdf(spark):
    body = b"%PDF /Type /Pages /Type /Page /Type/Page x"
    rows = [("a.pdf", ".pdf", body, "few words"), ("b.pdf", ".pdf", body, "page one\f" + "long " * 100 + "\f"), ("c.pdf", ".pdf", body, None), ("d.pdf", ".pdf", b"", "x" * 300), ("e.hwp", ".hwp", b"q", "text"), ("f.md", ".md", b"word", None)]
    got = {r.path: (r.pages, r.error, r.method, r.warnings) for r in decode.extract(spark.createDataFrame(rows, FILES)).collect()}
    assert got["a.pdf"] == (2, None, "given", ["scanned_pdf"]) and got["b.pdf"] == (2, None, "given", []) and got["c.pdf"][:3] == (2, "unsupported", None)
    assert got["d.pdf"] == (1, None, "given", []) and got["e.hwp"] == (None, None, "given", ["short_text"]) and got["f.md"] == (None, None, "utf-8", ["short_text"])
