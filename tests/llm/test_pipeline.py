"""The pipeline against a brute-force version."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_llm import FULL, similarity
from waymark.llm import mixing


def make(spark, folder):
    rnd = random.Random(11)
    letters = {"aa": "abcdefghij", "bb": "klmnopqrst"}
    say = lambda x, n: " ".join("".join(rnd.choice(letters[x]) for _ in range(5)) for _ in range(n))
    items = [(i, say("aa", 30)) for i in range(5)]
    docs = []
    for i in range(120):
        x = ("aa", "bb")[i % 2]
        text = say(x, 60) + ("\nCookie notice of the site" if i % 4 == 0 else "")
        docs.append((text, x))
    docs += [(docs[2][0], "aa")] * 3
    base = say("bb", 150).split()
    for k in range(6):
        w = list(base)
        w[20 * k] = "edit"
        docs.append((" ".join(w), "bb"))
    docs += [(say("aa", 20) + " " + items[k][1] + " " + say("aa", 20), "aa") for k in range(4)]
    docs += [("12 34 56", "aa"), (None, "aa"), ("", None)]
    rows = [(i, t, x, f"s{i % 3}", len(t or "")) for i, (t, x) in enumerate(docs)]
    spark.createDataFrame(rows, FULL).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_pipeline(spark, tmp_path):
    rows, items = make(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # 1: what has a letter is of a language here.
    docs = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    # 2
    count = {}
    for r in docs:
        for k in {brute.lower(x.strip(brute.SPACE)) for x in r[1].split("\n")}:
            count[k] = count.get(k, 0) + 1
    docs = [(r[0], "\n".join(x for x in r[1].split("\n") if not (brute.lower(x.strip(brute.SPACE)) and count[brute.lower(x.strip(brute.SPACE))] >= 10)), r[2], r[3]) for r in docs]
    # 3
    comp = {d: c for d, _, c in brute.components([(r[0], r[1]) for r in docs], 5, 80)}
    docs = [r for r in docs if comp[r[0]] == r[0]]
    # 4
    def leaks(text):
        w = text.split()
        for _, item in items:
            v = item.split()
            if any(similarity(w[s : s + len(v)], v) >= 0.8 for s in range(max(1, len(w) - len(v) + 1))):
                return True
        return False

    docs = [r for r in docs if not leaks(r[1])]
    # 5
    cells = {}
    for r in docs:
        cells[r[3], r[2]] = cells.get((r[3], r[2]), 0) + len(brute.words(r[1]))
    total = sum(cells.values())
    w = {c: n / total for c, n in cells.items()}
    margin = lambda v, j, c: sum(x for d, x in v.items() if d[j] == c[j])
    power = {0: mixing.TARGETS["source"], 1: mixing.TARGETS["lang"]}
    target = {}
    for j, p in power.items():
        m = {c[j]: margin(cells, j, c) ** p for c in cells}
        target[j] = {k: x / sum(m.values()) for k, x in m.items()}
    for _ in range(mixing.SWEEPS):
        for j in power:
            w = {c: x * target[j][c[j]] / margin(w, j, c) for c, x in w.items()}
    want = set()
    for r in docs:
        c = (r[3], r[2])
        prob = min(1.0, round(mixing.FRACTION * round(w[c] * total / cells[c], 6), 6))
        if int(hashlib.md5(f"{mixing.SEED}:{r[0]}".encode()).hexdigest()[:8], 16) / 2**32 < prob:
            want.add((r[0], r[1]))
    assert len(docs) < len(rows) - 10
    assert {(r["doc_id"], r["text"]) for r in out} == want


def test_stages_keep_the_columns(spark, tmp_path):
    make(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
