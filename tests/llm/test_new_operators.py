"""Operators 11 to 13 against brute force, and their cases."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import bbit_minhash, collocations, filter_audit, jaccard
from waymark.llm.common import materialise

DOCS = "doc_id long, text string, lang string, source string, rank long, mask int, n long, __id long, key string"


def documents(spark, rows):
    """rows (doc_id, text, lang, source), with extra columns named like columns that operators make."""
    return spark.createDataFrame([(*r, 7, 7, 7, 7, "x") for r in rows], DOCS)


# --- 11: collocations


def brute_phrases(rows, depth, least, top, subsumed):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = lang if lang is not None else "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, depth + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        longer = [c for (x, q), c in f.items() if x == lang and c >= least and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * c >= subsumed * a for c in longer):
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(p), a, left, right, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(x[0], i, *x[1:]) for i, x in enumerate(own, 1)]
    return sorted(ranked)


def prose(seed, n, words=30):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["es", "én", "Xa"]
    out = []
    for i in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "; "]) for _ in range(rng.randrange(0, 60)))
        out.append((i, text, rng.choice(["en", "es", None]), "s"))
    return out


@pytest.mark.parametrize(("least", "top", "subsumed"), [(3, 2000, 80), (2, 5, 50)])
def test_phrases_equal_brute_force(spark, least, top, subsumed):
    rows = prose(least, 60)
    rows += [(100 + i, "the old Mill house. the old mill house; the old mill", "en", None) for i in range(4)]
    rows += [(200, None, "en", None), (201, "", None, None), (202, "x" * 3_000_000 + " the old mill " + "y " * 40, "en", None), rows[0], rows[0]]
    got = collocations.mine(documents(spark, rows), 4, least, top, subsumed).collect()
    assert sorted(tuple(r) for r in got) == brute_phrases(rows, 4, least, top, subsumed)


def test_phrases_of_an_empty_table(spark):
    assert collocations.mine(documents(spark, [])).count() == 0


def test_states_of_the_automaton_are_end_position_classes():
    rng = random.Random(5)
    words = [rng.randrange(4) for _ in range(300)]
    run, n = [], 0
    for _ in words:  # pieces of random length
        n = 1 if rng.random() < 0.1 else n + 1
        run.append(n)
    a = collocations.automaton(np.array(words, dtype=np.uint64), np.array(run), 4)
    ends = {}
    for i in range(len(words)):
        for k in range(1, min(run[i], 4) + 1):
            ends.setdefault(tuple(words[i - k + 1 : i + 1]), set()).add(i)
    classes = {}
    for phrase, at in ends.items():
        classes.setdefault(frozenset(at), []).append(phrase)
    states = {}
    for s in range(len(a.end)):
        phrases = [tuple(words[a.end[s] - k + 1 : a.end[s] + 1]) for k in range(a.shortest[s], a.longest[s] + 1)]
        at = frozenset(ends[phrases[0]])
        assert sorted(phrases) == sorted(classes[at]) and a.count[s] == len(at)
        states[s] = phrases
    assert len(states) == len(classes)
    for s, phrases in states.items():
        shorter = phrases[0][1:]
        assert a.link[s] == -1 if not shorter else shorter in states[a.link[s]]


def test_filter_never_loses_a_hash(spark):
    keys = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000)
    held = collocations.bloom(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert held.has(keys.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert held.has(others).mean() < 0.05
    assert not collocations.bloom(spark.createDataFrame([], "key long")).has(others).any()


# --- 12: filter audit


def brute_audit(rows, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[i] == 1} for i in (0, 1))
    least = {}
    for d, text, _, _ in rows:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    masks = []
    for d, text, _, source in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None, "E": d is not None and d > least[t],
        }
        masks.append((source or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = []
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        removed_of = Counter()
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for i, f in enumerate(order):
                removed = [m for m in left if f in m[1]]
                redundant = sum(f in m[1] for m in own) - len(removed)
                left = [m for m in left if f not in m[1]]
                removed_of[f] += len(removed)
                steps.append((part, "".join(order), i + 1, len(left), len(removed), redundant, sum(m[1] == {f} for m in own), sum(m[2] for m in removed), sum(m[3] for m in removed), f))
        out += [(*s[:9], removed_of[s[9]]) for s in steps]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "  \n", "Äb cd " * 120, "A B C " * 70, "one #two", " ".join(f"w{i}" for i in range(250)), "W " * 300 + "|", "x" * 2_000_000]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), "en", rng.choice([None, "", "a", "b"])) for _ in range(150)]
    rows += [(0, "A B C " * 70, "en", "a")] * 3  # repeated rows of the least doc_id
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(30)] + [(None, 1, 1), (3, 1, 0)]
    got = filter_audit.filter_audit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows, labels)
    assert dict(got.dtypes)["shapley"] == "bigint" and dict(got.dtypes)["step"] == "int"


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(documents(spark, []), none).count() == 0
    got = filter_audit.filter_audit(documents(spark, [(1, "x", None, None)]), none)
    assert got.count() == 600 and got.where("good_lost > 0 OR toxic_lost > 0").count() == 0


def test_audit_plan_has_no_python(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    plan = filter_audit.filter_audit(documents(spark, [(1, "x", None, None)]), labels)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


# --- 13: b-bit MinHash


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute_components(rows, k, percent):
    sets = [(d, shingles(t, k)) for d, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        (a, x), (b, y) = sets[i], sets[j]
        if a is not None and b is not None and (a == b or (x and y and 100 * len(x & y) >= percent * len(x | y))):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), None if d is None else least[find(i)]) for i, (d, s) in enumerate(sets)), key=str)


def near_texts(seed, families=5, members=16, words=120):
    rng = random.Random(seed)
    out = []
    passage = [f"p{i}" for i in range(70)]
    for f in range(families):
        base = [f"f{f}w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randrange(0, 9)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(own))
    for i in range(30):  # a passage that many texts share
        out.append(" ".join(passage + [f"q{i}x{j}" for j in range(rng.randrange(5, 90))]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    texts = near_texts(seed)
    random.Random(seed).shuffle(texts)
    rows = list(enumerate(texts)) + [(900 + i, t) for i, t in enumerate(texts[:5])]  # exact copies
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "two Words"), (1004, "TWO words"), (1005, "two"), (None, texts[0]), (None, None)]
    rows += [rows[0], rows[0]]
    docs = documents(spark, [(d, t, "en", "s") for d, t in rows])
    got = bbit_minhash.near_duplicates(docs)
    found = [tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(found, key=str) == brute_components(rows, 4, 80)
    assert got.where("kept != coalesce(doc_id = component_id, true)").count() == 0


def test_near_duplicates_of_an_empty_table(spark):
    assert bbit_minhash.near_duplicates(documents(spark, [])).count() == 0
    only = bbit_minhash.near_duplicates(documents(spark, [(5, None, None, None)])).collect()
    assert [tuple(r) for r in only] == [(5, 0, 5, True)]


def test_signatures_tell_the_similarity():
    rng = np.random.default_rng(4)
    words = bbit_minhash.MINIMA // 64
    for share in (0.3, 0.6, 0.8, 0.95):
        n = 2000
        common = round(n * 2 * share / (1 + share))
        pool = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        x, y = pool[:n], np.concatenate((pool[:common], pool[n : 2 * n - common]))
        bits = bbit_minhash.planes(bbit_minhash.minima([np.sort(x), np.sort(y)])).reshape(2, bbit_minhash.BITS, words)
        differ = np.bitwise_or.reduce(bits[0] ^ bits[1], axis=0)
        agreeing = bbit_minhash.MINIMA - int(np.bitwise_count(differ).sum())
        assert abs(bbit_minhash.similarity(agreeing) - share) < 0.15
    assert bbit_minhash.similarity(bbit_minhash.MINIMA) == 1


def test_minima_of_long_and_short_sets_do_not_depend_on_blocks():
    rng = np.random.default_rng(6)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 3, 100_000, 40, bbit_minhash.BLOCK, 7)]
    whole = bbit_minhash.minima(sets)
    for i, s in enumerate(sets):
        assert (bbit_minhash.minima([s])[:, 0] == whole[:, i]).all()
        assert whole[5, i] == ((s ^ bbit_minhash._FLIP[5]) * bbit_minhash._SCALE[5]).min()


def test_long_band_lists_lose_no_link(spark):
    """Families far above the list length, with outliers that only link among themselves."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(rng.choice([1, 2, 6, 9])):
            own[rng.randrange(200)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(own)))
    docs = documents(spark, [(d, t, "en", "s") for d, t in rows])
    got = bbit_minhash.near_duplicates(docs, family=16).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows, 4, 80)


def test_links_that_only_left_out_lists_tell_are_found(spark, monkeypatch):
    """One band list holds all sets and every other band is a set's own, so all of them leave it out."""
    def one_list(least):
        own = least.sum(axis=0)[None, :] + np.arange(bbit_minhash.BANDS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        own[0] = 1 << 20
        return (own | np.uint64(63)).T

    monkeypatch.setattr(bbit_minhash, "band_keys", one_list)
    rng = random.Random(5)
    rows = []
    for i in range(0, 40, 2):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        rows += [(i, " ".join(words), None, None), (i + 1, " ".join(words[:-3] + ["x", "y", "z"]), None, None)]
    got = {r["doc_id"]: r["component_id"] for r in bbit_minhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in range(40)}


def changed(rng, words, times):
    own = list(words)
    for at in rng.sample(range(len(own)), times):
        own[at] = f"e{rng.randrange(10**9)}"
    return " ".join(own)


def test_sets_of_pairs_that_can_not_link_are_not_sent(spark, monkeypatch):
    """Pairs of a similarity around 0.7 pass the signatures' test; their sets need not meet."""
    rng = random.Random(12)
    texts = []
    for f in range(25):
        base = [f"f{f}w{i}" for i in range(200)]
        texts += [" ".join(base), changed(rng, base, 1)] + [changed(rng, base, 8) for _ in range(4)]
    rows, sent, compare = list(enumerate(texts)), [], jaccard.compare_with_leader
    monkeypatch.setattr(jaccard, "compare_with_leader", lambda rows, percent: sent.append(rows.count()) or compare(rows, percent))
    got = bbit_minhash.near_duplicates(documents(spark, [(d, t, "en", "s") for d, t in rows]))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute_components(rows, 4, 80)
    assert 25 <= sent[0] <= 30


def test_a_family_has_few_leaders(spark, monkeypatch):
    """Long lists of one family are led by the set that is in most of them, whatever its number is."""
    rng = random.Random(13)
    base = [f"b{i}" for i in range(200)]
    rows, sent, compare = [(i, changed(rng, base, 3 if i else 0)) for i in range(60)], [], jaccard.compare_with_leader
    monkeypatch.setattr(jaccard, "compare_with_leader", lambda rows, percent: sent.append(rows.where("family").count()) or compare(rows, percent))
    got = bbit_minhash.near_duplicates(documents(spark, [(d, t, "en", "s") for d, t in rows]))
    assert {r["component_id"] for r in got.collect()} == {0}
    assert 59 <= sent[0] <= 120


def test_wanted_tables_too_large_to_broadcast(spark, monkeypatch):
    """Texts that nobody asks for stay out of the shuffle; results are the same."""
    monkeypatch.setattr(jaccard, "is_small", lambda df: False)
    rows = list(enumerate(near_texts(3, families=2))) + [(None, "a b c d e"), (500, None)]
    docs = documents(spark, [(d, t, "en", "s") for d, t in rows])
    got = bbit_minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows, 4, 80)
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    wanted = materialise(spark.range(0, 5000, 100).select(F.col("id").alias("rep"), (F.col("id") + 1).alias("cls")))
    assert sorted((r["doc_id"], r["cls"]) for r in jaccard.rows_of(many, wanted).collect()) == [(i, i + 1) for i in range(0, 5000, 100)]


def test_fine_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(14)
    for n in (1, 2, 31, 500, 1500):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate((x[n // 5 :], rng.integers(0, 1 << 63, n // 4).astype(np.uint64))))
        a, b = (jaccard.sketch(s, jaccard.FINE) for s in (x, y))
        while len(a) != len(b):
            a, b = (s[: len(s) // 2] ^ s[len(s) // 2 :] if len(s) == max(len(a), len(b)) else s for s in (a, b))
        assert int(np.bitwise_count(a ^ b).sum()) <= len(np.setxor1d(x, y))
