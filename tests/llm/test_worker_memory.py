"""What a Python worker holds and sends at once follows bytes, not the rows of Spark's Arrow batches."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_llm import DOCS, prose
from waymark.llm import bbit_minhash, decontaminate, jaccard, langid, wordhash

N, MB = 3000, 1 << 20


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    return [None, "", *(prose(rnd, 350, 5000) for _ in range(N - 2))]


def functions(spark, monkeypatch, texts):
    """By name: what an operator gives to mapInArrow, and one batch that it may get."""
    got = []
    docs = spark.createDataFrame([(1, "a")], DOCS)
    items = spark.createDataFrame([(i, texts[2 + 300 * i][:300]) for i in range(5)], "item_id long, text string")
    sets = spark.createDataFrame([], "leader long, cls long, lead binary, own binary, family boolean")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: got.append(f) or self)
    rows = pa.RecordBatch.from_arrays([pa.array(range(N)), pa.array(texts, pa.string())], names=["doc_id", "text"])
    own = [s.tobytes() for s in jaccard.sets_of(texts, 5)]
    ids, own = pa.array(range(N)), pa.array(own, pa.binary())
    lead = own.take(pa.array(np.arange(N) // 10 * 10))
    pairs = pa.RecordBatch.from_arrays([ids, ids, lead, own, pa.array([True] * N)], names=["leader", "cls", "lead", "own", "family"])
    weights = np.random.default_rng(1).random((1 << langid.BITS, 3), dtype=np.float32)
    langid.identify(docs.select("doc_id", "text"), model=(["a", "b", "c"], weights))
    jaccard.profiles(docs, 5)
    jaccard.compare_with_leader(sets, 80)
    decontaminate.drop_contaminated(docs.select("doc_id", "text"), items)
    bbit_minhash.signatures(docs, 4)
    jaccard.index_entries(docs, 5, 80)
    monkeypatch.undo()
    batches = {"identify": rows, "profiles": rows, "compare": pairs, "drop_contaminated": rows, "signatures": rows, "index_entries": rows.select(["text"])}
    return {name: (f, b) for (name, b), f in zip(batches.items(), got, strict=True)}


def test_workers_hold_and_send_little_at_once(spark, monkeypatch, texts):
    for name, (f, batch) in functions(spark, monkeypatch, texts).items():
        tracemalloc.start()
        out, largest = [], 0
        for b in f(iter([batch])):
            largest = max(largest, b.nbytes)
            if name == "index_entries":
                out.append(b)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert largest <= 2.5 * MB, (name, largest)
        # The entries of some texts are looked at together; each is 16 bytes, and sorting takes as much again.
        assert peak <= (32 * MB if name != "index_entries" else 32 * MB + 6 * sum(b.nbytes for b in out)), (name, peak)


def test_slices_give_the_rows_of_whole_batches(spark, monkeypatch, texts):
    some = {name: (f, b.slice(0, 700)) for name, (f, b) in functions(spark, monkeypatch, texts).items()}
    for name, (f, batch) in some.items():
        whole, few = (pa.Table.from_batches(list(f(iter(given)))) for given in ([batch], [batch.slice(i, 7) for i in range(0, 700, 7)]))
        if name == "index_entries":  # salts go by what is seen together
            whole, few = (t.filter(pa.array(t["salt"].to_numpy() != -1)).select(["key", "cls"]) for t in (whole, few))
        assert whole.combine_chunks().equals(few.combine_chunks()), name
        assert name == "index_entries" or (name == "drop_contaminated" and 690 <= whole.num_rows < 700) or whole.num_rows == 700, name


def test_entries_in_several_runs_are_complete(spark, monkeypatch, texts):
    f, batch = functions(spark, monkeypatch, texts)["index_entries"]
    common = pa.RecordBatch.from_arrays([pa.array([f"{t} {i}" for i, t in enumerate([texts[5]] * 40)])], names=["text"])
    given = [batch.slice(0, 300), common, batch.slice(300, 0)]
    monkeypatch.setattr(jaccard, "ENTRIES", 2000)
    monkeypatch.setattr(jaccard, "SENT", 100)
    scheme, expected = jaccard.Scheme(80), set()
    for s in jaccard.sets_of([t for b in given for t in b.column(0).to_pylist()], 5):
        if len(s):
            expected |= {(int(x), jaccard.class_of(s)[0]) for x in scheme.keys(s).view(np.int64)}
    got = [r for b in f(iter(given)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert {(key, cls) for key, cls, _ in got} == expected
    assert sum(salt != -1 for *_, salt in got) == len(expected)
    hot = {key for key, _, salt in got if salt > 0}
    assert hot and hot == {key for key, _, salt in got if salt == -1}  # the key's own task hears of each


def test_parts():
    texts = ["x" * 10, None, "", "é" * 3000, "y" * 5, "z" * 5]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["i", "t"]), pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string())], names=["i", "t"])]
    got = list(wordhash.parts(batches, "t", most=2 * wordhash.ROW + 20))
    assert pa.Table.from_batches(got).to_pylist() == pa.Table.from_batches(batches).to_pylist()
    assert [b.num_rows for b in got] == [2, 1, 1, 2]
