"""A stream of files, needles and the sweep over spans."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime

from waymark.operators import needles, scopes
from waymark.plans.full_scan import full_scan
from waymark.sources import store
from waymark.streaming import live


def files(spark, at, **texts):
    rows = [(p.replace("_", "."), t.encode() if t is not None else None, hashlib.sha256(t.encode()).hexdigest() if t is not None else None, datetime(2024, 1, at)) for p, t in texts.items()]
    return spark.createDataFrame(rows, live.FILE)


def test_a_stream_of_batches_equals_the_batch(spark, tmp_path):
    spark.conf.set(*live.STATE_STORE)
    inbox, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/map"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(live.FILE).parquet(inbox)
    first = {"a_py": "class A:\n    pass\n", "b_py": "class B:\n    pass\n"}
    batches = [files(spark, 1, **first), files(spark, 2, a_py="class A2:\n    pass\n", b_py=first["b_py"]), files(spark, 3, b_py=None, c_py="def go():\n    pass\n")]
    seqs = []
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(inbox)
        query = live.changes(stream).writeStream.foreachBatch(lambda df, i: live.apply(spark, folder, df.persist(), i)).outputMode("update")
        query.option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(300)
        seqs.append(store.load(spark, folder).state["seq"])
    kept = store.load(spark, folder)
    wanted = full_scan(spark, files(spark, 1, a_py="class A2:\n    pass\n", c_py="def go():\n    pass\n").select("path", "content", "sha256"))
    pick = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert pick(kept.nodes, "id", "file") == pick(wanted.nodes, "id", "file")
    assert pick(kept.edges, "src", "dst", "type") == pick(wanted.edges, "src", "dst", "type")
    assert pick(kept.hashes, "path") == [("a.py",), ("c.py",)] and seqs == sorted(set(seqs))
    last = kept.state["batch"]
    assert not live.apply(spark, folder, batches[0], last)  # a replay
    assert store.load(spark, folder).state["seq"] == seqs[-1]


def test_needles_equal_contains(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice("abc ") for _ in range(rng.randrange(80)))) for i in range(60)] + [(60, None), (61, ""), (62, "é" * 50 + "aé")]
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(80)} | {"éa", "aé"}
    rows = spark.createDataFrame(texts, "id long, text string")
    asked = spark.createDataFrame([(w,) for w in [*words, "", None, *list(words)[:3]]], "needle string")
    wanted = sorted((i, w) for i, t in texts for w in words if t and w in t)
    for most in (needles.PASS_BYTES, 300):  # in one pass, and in several
        assert sorted(tuple(r) for r in needles.occurrences(rows, asked, most=most).collect()) == wanted
    assert needles.occurrences(rows, asked.where("false")).count() == 0
    names = spark.createDataFrame([("n:1", "Pay", "src/PAY.py"), ("n:2", None, "x")], "id string, name string, file string")
    found = needles.with_needles(names, spark.createDataFrame([("pAy",), ("x",)], "needle string"), "id", "name", "file")
    assert sorted(tuple(r) for r in found.collect()) == [("n:1", "pay"), ("n:2", "x")]


def test_a_sweep_equals_comparing(spark):
    rng = random.Random(2)
    points = [(rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), i) for i in range(200)]
    spans = [(rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), rng.choice([None, *range(60)])) for _ in range(25)]
    p, s = spark.createDataFrame(points, "k string, x int, n int"), spark.createDataFrame(spans, "k string, s int, e int")
    inside = lambda k, x: any(k == q and x is not None and a is not None and e is not None and a <= x < e for q, a, e in spans)
    wanted = sorted(n for k, x, n in points if not inside(k, x))
    for width in (7, 1 << 16):
        out = scopes.outside_spans(p, s, ["k"], "x", "s", "e", width)
        assert out.columns == p.columns and sorted(r["n"] for r in out.collect()) == wanted


def test_a_large_group_is_swept_in_parts(spark):
    spans = spark.range(300_000).selectExpr("'k' AS k", "id * 10 AS s", "id * 10 + 5 AS e")
    points = spark.range(300_000).selectExpr("'k' AS k", "id * 10 + id % 10 AS x")
    out = scopes.outside_spans(points, spans, ["k"], "x", "s", "e")
    assert out.count() == 150_000
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
