"""Completeness of the index keys, repeated passages, whole words across blocks, and edge cases of all
operators: empty tables, clashing columns, repeated rows, very long texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_llm import DOCS, FULL, prose, rows
from waymark.llm import chat, decontaminate, fertility, jaccard, langid, line_dedup, mixing, passages, suffix_dedup, wordhash


# --- Index keys


def test_keys_stay_complete_without_long_lists():
    """Of a similar pair, each set may leave out as many keys as its slack, whatever they are, as long
    as both leave out the same ones."""
    rnd = np.random.default_rng(7)
    for percent in (80, 90):
        scheme = jaccard.Scheme(percent)
        for _ in range(200):
            a = np.unique(rnd.integers(0, 2**63, rnd.integers(30, 900)).astype(np.uint64))
            n = len(a)
            gone = rnd.choice(n, rnd.integers(0, n * (100 - percent) // (200 + 2 * percent) + 1), replace=False)
            b = np.unique(np.concatenate((np.delete(a, gone), rnd.integers(0, 2**63, len(gone)).astype(np.uint64))))
            inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            assert 100 * inter >= percent * union
            left = []
            ka, kb = scheme.keys(a), scheme.keys(b)
            long = set(rnd.choice(np.union1d(ka, kb), len(np.union1d(ka, kb)) // 6, replace=False).tolist())
            for keys in (ka, kb):
                by = Counter(int(k) & (jaccard.CLASSES - 1) for k in keys.tolist() if k in long)
                left.append({k for k in keys.tolist() if k not in long or by[k & (jaccard.CLASSES - 1)] > scheme.slack(k & (jaccard.CLASSES - 1))})
            if inter < union:
                assert left[0] & left[1], (len(a), len(b))


def test_passages_that_many_texts_share_lose_no_link(spark, monkeypatch):
    """Long lists of dissimilar texts beside families of similar ones, hot keys in one batch included."""
    monkeypatch.setattr(jaccard, "SHORT", 3)
    rnd = random.Random(8)
    shared = [prose(rnd, 60) for _ in range(3)]
    texts = [f"{prose(rnd, rnd.randint(40, 150), 5000)} {rnd.choice(shared)} {prose(rnd, rnd.randint(0, 60), 5000)}" for _ in range(120)]
    for base in (3, 9, 30):
        w = texts[base].split()
        for _ in range(9):
            x = list(w)
            for _ in range(rnd.randint(0, 4)):
                x[rnd.randrange(len(x))] = f"n{rnd.randrange(10**6)}"
            texts.append(" ".join(x))
    docs = list(enumerate(texts))
    for k, percent in ((5, 80), (3, 90)):
        assert rows(jaccard.jaccard_components(spark.createDataFrame(docs, DOCS).repartition(5), k, percent)) == sorted(brute.components(docs, k, percent), key=str)


# --- Repeated passages


def repeats(docs, size):
    """Rows with a window of ``size`` words that another row has."""
    own = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (brute.words(t) for _, t in docs)]
    count = Counter(x for s in own for x in s)
    return [any(count[x] > 1 for x in s) for s in own]


@pytest.mark.parametrize("segment", [1 << 18, 16])
def test_repeating_texts(spark, monkeypatch, segment):
    monkeypatch.setattr(passages, "SEGMENT", segment)
    rnd = random.Random(9)
    shared = [prose(rnd, rnd.randint(8, 40)) for _ in range(6)]
    texts = [" ".join(rnd.choice([prose(rnd, rnd.randint(0, 30)), rnd.choice(shared), rnd.choice(shared)[5:]]) for _ in range(rnd.randint(0, 4))) for _ in range(90)]
    texts += [None, "", texts[3], texts[3], prose(rnd, 11) + " own " + prose(rnd, 11)]
    own = prose(rnd, 14)
    texts.append(f"{own} {own}")  # repeats itself only
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, DOCS).withColumn("th", F.xxhash64("text"))
    th = {r["th"] for r in passages.repeating_texts(df.select("th", "text").repartition(4), 12, 3).collect()}
    got = {r["doc_id"]: r["th"] in th for r in df.collect()}
    assert [got[i] for i in range(len(docs))] == repeats(docs, 12)


def test_query_of_op5_at_its_lengths(spark, tmp_path):
    """400 bytes to cut, 51 words to tell; hot anchors counted window by window."""
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    long, short, no = text(120), text(55), text(50)
    docs = [(i, f"{text(60)} {x} {text(60)}") for i, x in enumerate([long, long, short, short, no, no, "", ""])] + [(20, None), (21, ""), (22, long), (23, long)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in suffix_dedup.query(spark, str(tmp_path)).collect()}
    for d, n, gone, spans, kept in brute.suffix(docs, 400):
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"], got[d]["kept_sha256"]) == (n, gone, spans, hashlib.sha256(kept).hexdigest())
    assert [got[d]["has_repeat"] for d, _ in docs] == repeats(docs, 51)
    hot = suffix_dedup.suffix_dedup(spark.createDataFrame(docs, DOCS), hot=2)
    assert {(r["doc_id"], r["n_removed"]) for r in hot.collect()} == {(d, g) for d, _, g, _, _ in brute.suffix(docs, 400)}


# --- Words of long texts


def test_words_across_blocks(monkeypatch):
    rnd = random.Random(11)
    text = " ".join("x" * rnd.randint(1, 9) + str(rnd.randrange(50)) for _ in range(4000)).encode()
    whole, at = wordhash.hash_words([text, b"a b", text])
    assert at.tolist() == [0, 4000, 4002, 8002] and (whole[:4000] == whole[4002:]).all()
    monkeypatch.setattr(wordhash, "BLOCK", 1 << 10)
    parts, at = wordhash.hash_words([text, b"a b", text])
    assert at.tolist() == [0, 4000, 4002, 8002] and (parts == whole).all()
    for big in (b"y" * 5000, b" " * 3000 + b"y" * 3000 + b" z"):
        assert len(wordhash.hash_words([big])[0]) == len(big.split())


# --- Edge cases


def test_empty_tables(spark):
    none = spark.createDataFrame([], FULL)
    assert langid.identify(none).count() == 0
    assert suffix_dedup.suffix_dedup(none).count() == 0
    assert passages.repeating_texts(none.withColumn("th", F.xxhash64("text"))).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(none, items).count() == 0 and decontaminate.drop_contaminated(none, items).count() == 0
    assert jaccard.one_per_component(none).count() == 0


def test_clashing_columns(spark):
    """Columns of the input with names of results or of inner columns."""
    rnd = random.Random(12)
    data = [(i, prose(rnd, 60), "en", "s", 1) for i in range(12)]
    df = spark.createDataFrame(data, FULL)
    extra = df.withColumns({c: F.lit("mine") for c in ("n_tokens", "topic", "weight", "cls", "key", "th", "keys", "rep", "band", "kept", "score", "lang_pred", "component_id", "n_shingles")})
    strip = lambda out: rows(out)
    assert strip(jaccard.jaccard_components(extra)) == strip(jaccard.jaccard_components(df))
    assert strip(fertility.fertility_rules(extra).select("doc_id", "kept")) == strip(fertility.fertility_rules(df).select("doc_id", "kept"))
    assert strip(suffix_dedup.suffix_dedup(extra)) == strip(suffix_dedup.suffix_dedup(df))
    assert strip(mixing.mix(extra).select("doc_id", "weight")) == strip(mixing.mix(df).select("doc_id", "weight"))
    assert strip(langid.identify(extra).select("doc_id", "lang_pred")) == strip(langid.identify(df).select("doc_id", "lang_pred"))
    assert line_dedup.line_dedup(extra).count() == 12


def brute_parents(messages):
    """The parent of each (conv_id, turn), by looking through all earlier messages."""
    said, quotes = {}, {}
    for conv, turn, _, text in messages:
        if conv is None or turn is None:
            continue
        _, own, quoted = chat.parse(text)
        said.setdefault((conv, turn), set()).update(own)
        for level, h, n in quoted:
            key = (conv, turn)
            quotes.setdefault(key, Counter())[level, h] += n
    out = {}
    for (conv, turn), asked in quotes.items():
        votes = Counter()
        for (level, h), n in asked.items():
            earlier = [t for (c, t), own in said.items() if c == conv and t < turn and h in own]
            if earlier:
                votes[level, max(earlier)] += n
        if votes:
            (level, parent), _ = max(votes.items(), key=lambda x: (-x[0][0], x[1], x[0][1]))
            out[conv, turn] = parent
    return out


def test_links_against_brute_force(spark, monkeypatch):
    """Generated threads: whole and partial quotes, nested ones, short and repeated lines, blocks of turns."""
    monkeypatch.setattr(chat, "BLOCK", 4)
    rnd = random.Random(13)
    pool = ["yes", "no!", "好的", *[prose(rnd, rnd.randint(2, 9), 30) for _ in range(12)]]
    messages = []
    for conv in range(12):
        texts = []
        for turn in range(rnd.randint(1, 25)):
            lines = [rnd.choice(pool) for _ in range(rnd.randint(1, 3))]
            if texts and rnd.random() < 0.7:
                q = rnd.choice(texts).split("\n")
                q = q[: rnd.randint(1, len(q))]
                lines = (["Ann wrote:"] if rnd.random() < 0.3 else []) + [f"> {x}" for x in q] + lines
            texts.append("\n".join(lines))
            messages.append((conv, turn * rnd.choice((1, 1, 1)), "user", texts[-1]))
    messages += [(None, 3, "user", "> yes"), (3, None, "user", "> yes"), (4, 1, "user", messages[5][3]), (99, 0, None, None), (99, 1, "user", "")]
    out = chat.reply_order(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == len(messages)
    want = brute_parents(messages)
    for r in out:
        assert r["parent_turn"] == want.get((r["conv_id"], r["turn"])), r
        root = r["turn"]
        while (r["conv_id"], root) in want:
            root = want[r["conv_id"], root]
        assert r["root_turn"] == root


def test_stages_take_empty_and_repeated_rows(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, prose(random.Random(14), 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    none = spark.createDataFrame([], FULL)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
    rnd = random.Random(15)
    docs = [(i % 9, prose(random.Random(i % 9), 60), "en", "s", 1) for i in range(18)] + [(None, None, None, None, None), (50, prose(rnd, 70), None, None, None)]
    df = spark.createDataFrame(docs, FULL)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        kept = {r["doc_id"] for r in stage(spark, df, str(tmp_path)).collect()}
        assert {*range(9), 50} <= kept, name


def test_parts_measure_like_whole_texts(monkeypatch):
    """Tokenising each distinct part once gives the tokens of the whole text, whatever blocks and memory."""
    rnd = random.Random(12)
    texts = ["".join(rnd.choice("ab é\u3000  'sx1\n\t\x1c,. 漢字😀\u00a0▁ \u0301 ") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += ["", " ", "x", "word " * 500, " ".join(f"w{i % 70}" for i in range(900))]
    meters = []
    for path in fertility.vocabulary_paths():
        with open(path, "rb") as f:
            meters.append(fertility.Meter(path, f.read()))
    assert len(meters) == 3 and all(m.cuts for m in meters)

    def whole(m, text):
        ids = m.encode([text])[0]
        n = len(ids)
        if not n:
            return 0, 0.0, 0.0, 0.0
        share = np.unique(ids, return_counts=True)[1] / n
        return n, len(text) / n, float(m.fallback[ids].mean()), float(-(share * np.log2(share)).sum())

    want = [[whole(m, t) for m in meters] for t in texts]
    for block, most in ((1 << 20, 200_000), (100, 50)):
        monkeypatch.setattr(fertility, "BLOCK", block)
        monkeypatch.setattr(fertility, "KNOWN", most)
        for m in meters:
            m.forget()
        got = list(fertility.measure_texts(texts, meters, fertility.Parts()))
        assert np.allclose(np.array(got), np.array(want), atol=1e-9)
