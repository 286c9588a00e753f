from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from waymark.sources import files, walk


@pytest.fixture()
def tree(tmp_path):
    rows = {
        "a.py": "x = 1\n", "pkg/__init__.py": "", "pkg/_private.py": "y\n", "pkg/deep/er/z.go": "package z\n",
        ".github/workflows/ci.yml": "on: push\n", "node_modules/m/index.js": "m\n", "web/node_modules/m/deep/x.js": "m\n",
        ".shots2/a.py": "no\n", "pkg/big.py": "#" * 100, "empty/keep.txt": "", "pkg/ü b%20.py": "u\n",
    }
    for path, text in rows.items():
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    (tmp_path / "nothing").mkdir()
    return str(tmp_path)


def test_skipped_folders_are_never_listed(spark, tree):
    seen = walk.walk(spark, tree, files.SKIP_DIRS, (".shots",))
    got = {r["path"]: r["folder"] for r in seen.collect()}
    assert got["node_modules"] and got["web/node_modules"] and got[".shots2"]
    assert not [p for p in got if "node_modules/" in p or p.startswith(".shots2/")]
    assert {p for p, folder in got.items() if not folder} == {
        "a.py", "pkg/__init__.py", "pkg/_private.py", "pkg/deep/er/z.go", ".github/workflows/ci.yml", "pkg/big.py", "empty/keep.txt", "pkg/ü b%20.py"}


def test_only_wanted_folders_are_asked_for(spark, tree, monkeypatch):
    """What listing() is asked for is all that is entered."""
    asked, plain = [], walk.listing

    def counted(folders, root):
        asked.extend(r["path"] for r in folders.collect())
        return plain(folders, root)

    monkeypatch.setattr(walk, "listing", counted)
    walk.walk(spark, tree, files.SKIP_DIRS, (".shots",))
    assert sorted(asked) == ["", ".github", ".github/workflows", "empty", "nothing", "pkg", "pkg/deep", "pkg/deep/er", "web"]


def test_scan_equals_a_plain_walk(spark, tree):
    got = {r["path"]: (r["length"], bytes(r["content"])) for r in files.scan(spark, tree, max_bytes=50).collect()}
    want = {}
    for at, folders, names in os.walk(tree):
        folders[:] = [f for f in folders if f not in files.SKIP_DIRS and not f.startswith(".shots")]
        for name in names:
            path = os.path.join(at, name)
            if os.path.getsize(path) <= 50 and os.path.splitext(name)[1] in files.SOURCE_EXTS:
                want[os.path.relpath(path, tree)] = (os.path.getsize(path), open(path, "rb").read())
    assert got == want and "pkg/__init__.py" in got and ".github/workflows/ci.yml" in got


def test_uri_root_empty_root_and_missing_root(spark, tree, tmp_path):
    assert files.scan(spark, f"file://{tree}").count() == files.scan(spark, tree + "/").count() == 7
    assert files.scan(spark, str(tmp_path / "nothing")).count() == 0
    with pytest.raises(FileNotFoundError):
        walk.walk(spark, str(tmp_path / "gone"))
    gone = walk.listing(spark.createDataFrame([("gone",)], "path string"), tree).collect()
    assert [(r["path"], r["folder"]) for r in gone] == [("gone", True)] and gone[0]["error"]


def test_a_file_that_goes_between_listing_and_reading(spark, tree):
    listed = walk.walk(spark, tree).where(~F.col("folder"))
    os.remove(f"{tree}/a.py")
    assert "a.py" not in {r["path"] for r in walk.contents(listed, tree).collect()}


def test_small_batches_lose_nothing(spark, tree):
    listed = walk.walk(spark, tree).where(~F.col("folder"))
    assert {r["path"] for r in walk.contents(listed, tree, each=1).collect()} == {r["path"] for r in listed.collect()}
