from __future__ import annotations

from waymark.sources import table_function
from waymark.sources.extract import Added, emissions, ends

FILES = [
    ("app/a.py", b"class A:\n    def go(self):\n        pass\n"), ("db/V1__x.sql", b"CREATE TABLE t (id INT);\n"),
    ("go.mod", b"module m\n\nrequire (\n\tgithub.com/x/y v1.2.3\n)\n"), ("bad.py", b"def (:\n"), ("none.py", None), (None, b"x"), ("latin.py", b"# \xe9\nx = 1\n"),
]


def files(spark):
    return spark.createDataFrame(FILES, "path string, content binary")


def key(r):
    return tuple(str(sorted(r[c].items()) if isinstance(r[c], dict) else r[c]) for c in ("path", "place", "row", "id", "kind", "name", "src", "dst", "type", "line", "confidence", "meta", "error"))


def test_lateral_equals_the_scan(spark):
    table_function.register(spark)
    files(spark).createOrReplaceTempView("some_files")
    got = spark.sql("SELECT f.path, e.* FROM some_files f, LATERAL extract_rows(f.path, f.content) e")
    want = emissions(files(spark).where("path IS NOT NULL"))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert {r["path"] for r in got.where("row = 'error'").select("path").collect()} == {"bad.py"}


def words(out, text):
    fid = out.file("source", lang="words")
    for i, line in enumerate(text.splitlines(), 1):
        out.edge(fid, out.node(f"words:{line}", "function", line, i), "defines", i)


def fails(out, text):
    raise ValueError("not today")


def test_an_added_language_is_usable_from_sql(spark):
    table_function.register(spark, "extract_words", (Added("words", ends(".words"), words), Added("early", ends(".words"), fails, -1)))
    spark.createDataFrame([("x.words", b"one\ntwo\n"), ("y.py", b"class B:\n    pass\n")], "path string, content binary").createOrReplaceTempView("word_files")
    rows = spark.sql("SELECT f.path, e.* FROM word_files f, LATERAL extract_words(f.path, f.content) e ORDER BY path, place").collect()
    assert [r["id"] for r in rows if r["path"] == "x.words" and r["row"] == "node"] == ["file:x.words", "words:one", "words:two"]
    assert [r["error"] for r in rows if r["row"] == "error"] == ["x.words [EARLY]: not today"]
    assert "py:class:B" in {r["id"] for r in rows}


def test_priority_decides_who_is_first(spark):
    late, early = Added("late", ends(".py"), words, 1), Added("early", ends(".py"), words, -1)
    first = lambda added: table_function.extract_text("a.py", "class A: pass\n", (added,))[0][0]["meta"]
    assert ("lang", "words") in first(early) and ("lang", "words") not in first(late)
