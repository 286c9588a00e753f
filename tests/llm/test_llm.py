"""The training-data operators against brute force, and their edge cases."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from waymark.llm import chat, components, decontaminate, fertility, jaccard, langid, line_dedup, mixing, suffix_dedup, url_filter, warc

DOCS = "doc_id long, text string"
FULL = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


# --- line dedup


def test_line_dedup(spark):
    rnd = random.Random(1)
    docs = [(i, "\n".join(rnd.choice(["Common ", "\tcommon\r", "É own", "x" * rnd.randint(0, 3), str(rnd.random())]) for _ in range(rnd.randint(0, 6)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "long " * 20_000 + "\ncommon"), (None, "common\nnull id")]
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], DOCS + ", n_lines string")
    got = line_dedup.line_dedup(df, min_docs=10).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256))
    assert rows(got) == sorted(brute.line_dedup(docs, 10), key=str)


def test_line_dedup_repeated_rows_and_empty_table(spark):
    dropped = lambda rows: [r["n_dropped"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOCS)).collect()]
    assert dropped([(1, "a\nb")] * 10) == [0] * 10  # one document
    assert dropped([(i // 2, "a\nb") for i in range(18)]) == [0] * 18  # nine
    assert dropped([(i // 2, "a\nb") for i in range(20)]) == [2] * 20
    assert dropped([(None, "a\nb")] * 10) == [2] * 10  # rows without a doc_id are documents of their own
    assert line_dedup.line_dedup(spark.createDataFrame([], DOCS)).count() == 0


# --- mixing


def test_raking_meets_the_targets(spark):
    cells = spark.createDataFrame([(s, x, t, float(10 * i + 5)) for i, (s, x, t) in enumerate((s, x, t) for s in "ab" for x in ("en", None) for t in "pq")], "source string, lang string, topic string, __tokens double")
    targets = {"source": {"a": 3, "b": 1}, "lang": 0.5, "topic": {"p": 1, "q": 1}}
    w = mixing.rake(cells, targets, sweeps=20).collect()
    assert abs(sum(r["__w"] for r in w if r["source"] == "a") - 0.75) < 1e-6
    assert abs(sum(r["__w"] for r in w if r["topic"] == "p") - 0.5) < 1e-6
    assert abs(sum(r["__w"] for r in w) - 1) < 1e-9


def test_mix_cases(spark):
    data = [(i, prose(random.Random(i), 50), "en", "s0" if i % 3 else "s1", 1) for i in range(300)] + [(900, None, None, None, None), (901, "", "en", "s0", 0), (None, "a b", "en", "s0", 3)]
    out = mixing.mix(spark.createDataFrame(data, FULL)).collect()
    assert len(out) == len(data)
    by = {r["doc_id"]: r for r in out}
    assert by[900]["topic"] == "empty" and by[900]["prob"] == 0 and not by[900]["sampled"]
    kept = sum(r["n_tokens"] for r in out if r["sampled"])
    assert 0.3 < kept / sum(r["n_tokens"] for r in out) < 0.7
    assert mixing.mix(spark.createDataFrame([], FULL)).count() == 0


# --- fertility


@pytest.mark.parametrize("text", ["", "a", "a b a b a b", "x y z x y z\nx y z\nx y z\n\n \n", "#x $y|z <b> é é\u00a0é", "w " * 3000, "a\x0bb\x0cc\x1cd"])
def test_word_counts(text):
    assert fertility.word_counts(text) == brute.quality(text)


def test_fertility_keeps_prose_and_rejects_noise(spark):
    rnd = random.Random(3)
    words = "the of and to in that is was for with as on by from this are".split()
    clean = [(i, " ".join(rnd.choice(words) + rnd.choice(["", "ing", "ed"]) for _ in range(200)), "en") for i in range(80)]
    noise = [(500 + i, "".join(chr(rnd.randrange(0x4E00, 0x9FFF)) + " " for _ in range(200)), "en") for i in range(3)]
    other = [(900, None, None), (901, "too short", "en"), (902, "same words here " * 100, "en"), (None, clean[0][1], None)]
    out = {r["doc_id"]: r for r in fertility.fertility_rules(spark.createDataFrame(clean + noise + other, DOCS + ", lang string")).collect()}
    assert all(out[d]["kept"] for d, _, _ in clean)
    assert not any(out[d]["kept"] for d, _, _ in noise)
    assert out[900]["base_failed"] and out[901]["base_failed"] and out[902]["base_failed"]
    assert fertility.fertility_rules(spark.createDataFrame([], DOCS + ", lang string")).count() == 0


# --- language ID


def test_language_id(spark):
    rnd = random.Random(4)
    alphabet = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "éèêàùçîô"}
    docs = [(i, " ".join("".join(rnd.choice(alphabet[x]) for _ in range(6)) for _ in range(40)), x) for i in range(240) for x in [("aa", "bb", "cc")[i % 3]]]
    docs += [(900, None, "aa"), (901, "12 34 !!", "aa"), (902, "", None), (903, docs[0][1] * 400, None), (None, docs[1][1], "bb")]
    out = langid.identify(spark.createDataFrame(docs, DOCS + ", lang string")).collect()
    by = {r["doc_id"]: r for r in out}
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 240]
    assert held and all(r["lang_pred"] == r["lang"] for r in held)
    assert by[900]["lang_pred"] == by[901]["lang_pred"] == by[902]["lang_pred"] == "und" and by[900]["score"] == 0
    assert by[903]["lang_pred"] == "aa" and by[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_id_without_labels(spark):
    out = langid.identify(spark.createDataFrame([(1, "text", None)], DOCS + ", lang string")).first()
    assert out["lang_pred"] == "und"


def test_presence_does_not_depend_on_blocks(monkeypatch):
    text = prose(random.Random(1), 300)
    want = langid.present(text)
    monkeypatch.setattr(langid, "_BLOCK", 64)
    assert (langid.present(text) == want).all()


# --- suffix dedup


@pytest.mark.parametrize(("length", "gram", "hot"), [(40, 12, 16384), (40, 25, 2)])
def test_suffix_dedup(spark, length, gram, hot):
    rnd = random.Random(5)
    piece = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    shared = [piece(rnd.randint(30, 120)) for _ in range(8)]
    docs = [(i, "".join(rnd.choice([piece(rnd.randint(0, 60)), rnd.choice(shared), rnd.choice(shared)[3:]]) for _ in range(rnd.randint(0, 8)))) for i in range(80)]
    docs += [(200, None), (201, ""), (202, "a" * 300), (203, "ab" * 200), (204, docs[3][1]), (204, docs[3][1]), (None, docs[5][1])]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(docs, DOCS), length, gram, hot)
    got = [(*r[:4], bytes(r[4])) for r in got.collect()]
    assert sorted(got, key=str) == sorted(brute.suffix(docs, length), key=str)


def test_suffix_segments(monkeypatch):
    raw = random.Random(2).randbytes(3000)
    spans = lambda: sorted((s + int(p), s + int(a), s + int(b)) for s, _, _, _, q, f, x in suffix_dedup.anchors(raw, 60, 20) for p, a, b in zip(q, f, x, strict=True))
    whole = {(p, i) for p, a, b in spans() for i in range(a, b + 1)}
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 128)
    assert {(p, i) for p, a, b in spans() for i in range(a, b + 1)} == whole


def test_loser_tree_merges_and_counts_shared_bytes():
    rnd = random.Random(6)
    runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(0, 30))) for _ in range(7)]
    blobs = [suffix_dedup.front_coded(r, [()] * len(r)) for r in runs]
    out = [(h, s) for h, s, _ in suffix_dedup.LoserTree([suffix_dedup.run_entries(b) for b in blobs])]
    assert [s for _, s in out] == sorted(x for r in runs for x in r)
    for (_, a), (h, b) in zip(out, out[1:], strict=False):
        assert h == suffix_dedup.shared_prefix(a, b, 0)


# --- Jaccard join


def near_copies(rnd, n, size, edits):
    base = prose(rnd, size).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "percent", "short", "family"), [(3, 90, 12, 4096), (3, 90, 2, 8), (5, 80, 2, 5), (2, 50, 3, 4096)])
def test_jaccard_components(spark, monkeypatch, k, percent, short, family):
    monkeypatch.setattr(jaccard, "SHORT", short)
    rnd = random.Random(k * percent + short)
    texts = [prose(rnd, rnd.randint(0, 40), 60) for _ in range(40)]
    texts += near_copies(rnd, 40, 120, 4) + near_copies(rnd, 12, 60, 2) + near_copies(rnd, 6, 400, 12)
    texts += [texts[60]] * 3 + [texts[60].upper()] + ["", None, "a", "a b", "A  b"]
    docs = list(enumerate(texts))
    got = jaccard.jaccard_components(spark.createDataFrame(docs, DOCS), k, percent, family)
    assert rows(got) == sorted(brute.components(docs, k, percent), key=str)


def test_jaccard_cases(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(1, "a b c d"), (None, "a b c d"), (3, "a b c d"), (3, "a b c d")], DOCS)
    assert rows(jaccard.jaccard_components(df)) == sorted([(1, 2, 1), (None, 2, None), (3, 2, 1), (3, 2, 1)], key=str)
    assert rows(jaccard.one_per_component(df)) == sorted([(1, "a b c d"), (None, "a b c d")], key=str)


def test_chain_of_drifting_documents(spark):
    """Each document is near the next one only: one component of 1,000."""
    words = [f"w{i}" for i in range(1100)]
    docs = [(i, " ".join(words[i : i + 27])) for i in range(1000)]
    near = lambda a, b: len(brute.shingles(docs[a][1], 3) & brute.shingles(docs[b][1], 3)) / len(brute.shingles(docs[a][1], 3) | brute.shingles(docs[b][1], 3))
    assert near(0, 1) >= 0.9 > near(0, 2)
    assert rows(jaccard.jaccard_components(spark.createDataFrame(docs, DOCS))) == sorted(((i, 25, 0) for i in range(1000)), key=str)


def test_components_of_any_graph(spark):
    rnd = random.Random(12)
    name = rnd.sample(range(-(10**9), 10**9), 400)
    pairs = [(i, i + 1) for i in range(100)] + [(110, 111 + i) for i in range(60)] + [(i, i) for i in (180, 181)] + [(190 + i, 190 + (i + 1) % 9) for i in range(9)]
    pairs += [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(150)]
    root = {n: n for n in {x for p in pairs for x in p}}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[find(a)] = find(b)
    least = {}
    for n in root:
        least[find(n)] = min(name[n], least.get(find(n), name[n]))
    got = components.connected_components(spark.createDataFrame([(name[a], name[b]) for a, b in pairs], "a long, b long"))
    assert rows(got) == sorted(((name[n], least[find(n)]) for n in root), key=str)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keys_are_complete():
    """Pairs within the threshold share a key, down to the least sizes."""
    rnd = np.random.default_rng(1)
    for percent in (80, 90):
        scheme = jaccard.Scheme(percent)
        for _ in range(300):
            a = rnd.integers(0, 2**63, rnd.integers(1, 200)).astype(np.uint64)
            b = a.copy()
            for _ in range(rnd.integers(0, len(a) // 8 + 1)):
                b = np.delete(b, rnd.integers(len(b))) if len(b) > 1 and rnd.random() < 0.5 else np.append(b, np.uint64(rnd.integers(2**63)))
            a, b = np.unique(a), np.unique(b)
            inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if 100 * inter >= percent * union and inter < union:
                assert len(np.intersect1d(scheme.keys(a), scheme.keys(b))), (len(a), len(b))


def test_sketch_is_a_lower_bound():
    rnd = np.random.default_rng(2)
    a = np.unique(rnd.integers(0, 2**63, 300).astype(np.uint64))
    b = np.concatenate((a[:250], np.unique(rnd.integers(0, 2**63, 40).astype(np.uint64))))
    x, y = jaccard.sketch(a), jaccard.sketch(b)
    assert len(x) == len(y)
    assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


# --- decontamination


def similarity(a, b):
    x, y = brute.Counter(), brute.Counter()
    for w, c in ((a, x), (b, y)):
        for i in range(len(w) - 4):
            c[tuple(w[i : i + 5])] += 1
    both = x | y
    return sum((x & y).values()) / sum(both.values()) if both else 0.0


def test_decontamination(spark):
    rnd = random.Random(8)
    items = [(i, prose(rnd, rnd.randint(15, 50), 5000)) for i in range(30)] + [(98, "a b"), (99, None)]
    docs, want = [], set()
    for d in range(60):
        text = prose(rnd, rnd.randint(10, 200), 5000)
        if d % 3 == 0:
            i = rnd.randrange(30)
            w = items[i][1].split()
            if d % 2 and len(w) > 45:
                w[0] = "changed"
            text = prose(rnd, 30, 5000) + " " + " ".join(w).upper() + ", " + text
            want.add((d, i))
        docs.append((d, text))
    docs += [(100, None), (101, ""), (102, items[3][1]), (None, items[4][1])]
    want |= {(102, 3), (None, 4)}
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(spark.createDataFrame(docs, DOCS), b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    for passes in (7, 50):
        clean = decontaminate.drop_contaminated(spark.createDataFrame(docs, DOCS), b, max_items=passes)
        assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_passes_weigh_alike(spark):
    """Items that share half their shingles give the same rows in one pass and in many."""
    rnd = random.Random(21)
    shared = prose(rnd, 20, 5000)
    items = [(i, f"{shared} {prose(rnd, 20, 5000)}") for i in range(24)] + [(90, "a b"), (91, None)]
    docs = []
    for i, text in items[:24]:
        w = text.split()
        w[rnd.choice([0, 1, 38, 39])] = "changed"
        docs.append((i, " ".join(w)))
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = [(*r[:3], round(r[3], 9), *r[4:]) for r in rows(decontaminate.matches(d, b))]
    assert len({r[0] for r in want}) > 12 and len({r[3] for r in want}) > 1
    for most in (13, 5):
        assert [(*r[:3], round(r[3], 9), *r[4:]) for r in rows(decontaminate.matches(d, b, max_items=most))] == want


def test_fingerprints_find_similar_windows():
    """Recall of the fingerprints near the threshold, and the completeness of the multi-index."""
    rnd = random.Random(9)
    items = [prose(rnd, 40, 5000) for _ in range(100)]
    bench = decontaminate.Benchmark(list(range(100)), items)
    docs = []
    for x in items:
        w = x.split()
        w[rnd.choice([0, 1, 38, 39])] = "changed"
        docs.append(" ".join(w))
    found = {d for d, m in bench.search(docs) if any(i == d for i, *_ in m)}
    real = {d for d, (x, y) in enumerate(zip(items, docs, strict=True)) if similarity(x.split(), y.split()) >= 0.85}
    assert len(found & real) >= 0.95 * len(real)
    prints = np.array([rnd.getrandbits(64) for _ in range(50)], dtype=np.uint64) & np.uint64(0xFFFFFFFFFF)
    bench.radius = decontaminate.RADIUS
    want = {(w, i) for w in range(50) for i in range(100) if int(np.bitwise_count(prints[w] ^ bench.prints[i])) <= bench.radius}
    assert {(w, i) for w, i, _ in bench.near(prints)} == want


# --- URL filter


@pytest.mark.parametrize(("url", "host", "path", "rule"), [
    ("HTTP://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/"), ("http://x.org/en/12", "x.org", "/en/12", "org/"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/"),
    ("http://x.org", "x.org", "", None), ("http://x.com/de/", "x.com", "/de/", "com/de/"), ("no scheme", "", "", None), (None, "", "", None),
    ("a://b?c/d", "b", "", None), ("x://y#z://w/", "y", "", None), ("http://org/", "org", "/", "org/"),
])
def test_rules(spark, url, host, path, rule):
    df = spark.createDataFrame([(url,)], "url string").withColumns({"h": url_filter.host_of(F.col("url")), "p": url_filter.path_of(F.col("url"))})
    r = df.select("h", "p", url_filter.rule_of(F.col("h"), F.col("p")).alias("r")).first()
    assert (r["h"], r["p"], r["r"] and r["r"]["rule"]) == (host, path, rule)


def test_url_filter(spark):
    rnd = random.Random(3)
    urls = [f"http://h{rnd.randrange(50)}.example.{rnd.choice(['org', 'com', 'net'])}/{rnd.choice(['en', 'fr', 'de', 'es'])}/{rnd.randrange(9999)}" for _ in range(600)]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate([*urls, None, "", "x"])], "page_id long, url string, verdict string")
    out = url_filter.url_filter(df).collect()
    assert len(out) == 603 and {r["verdict"] for r in out} == {"allow", "block"}
    for r in out:
        if r["rule"]:
            want = {k: v for v, k in url_filter.RULES}[r["rule"]]
            assert r["verdict"] == want
    few = url_filter.url_filter(spark.createDataFrame([(1, None)], "page_id long, url string")).first()
    assert (few["host"], few["path"], few["rule"], few["verdict"]) == ("", "", None, "allow")


def test_entropy(spark):
    df = spark.createDataFrame([("aabb",), ("",), ("abcd",)], "t string").select(url_filter.entropy(F.col("t")).alias("e"))
    assert [round(r["e"], 6) for r in df.collect()] == [1.0, 0.0, 2.0]


# --- WARC


def test_warc_round_trip(spark):
    pages = [(5, "http://a", "x"), (3, "http://b\r\n ", "x"), (9, None, None), (8, "http://c", ""), (7, "u", "é" * 70_000), (7, "u", "x"), (None, "n", "x"), (None, "n", "only")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    index = warc.write_archives(df, roll_bytes=300)
    assert index.select("file").distinct().count() > 1
    got = warc.read_records(index).collect()
    assert len(got) == len(pages)
    first = brute.group_pages([(p, h) for p, _, h in pages])
    for r in got:
        match = [h for p, _, h in pages if p == r["page_id"] and len((h or "").encode()) == r["payload_bytes"] and base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() == r["payload_digest"]]
        assert match
        least = first.get(match[0] or "")
        if least is None or least == r["page_id"]:
            assert r["record_type"] == "response" and r["refers_to"] is None and bytes(r["payload"]) == (match[0] or "").encode()
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == least
    one = warc.read_records(index.where("page_id = 5")).collect()
    assert [r["page_id"] for r in one] == [5]
    assert warc.read_records(warc.write_archives(df.limit(0))).count() == 0


def test_small_payloads_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    assert warc.with_duplicates(df, min_bytes=3).where("revisit").count() == 0


def test_ranges_merge_neighbours():
    got = list(warc._ranges([("f", 0, 10), ("f", 10, 5), ("f", 100, 5), ("g", 0, 3)], 20, 1000))
    assert [(f, a, b) for f, a, b, _ in got] == [("f", 0, 15), ("f", 100, 105), ("g", 0, 3)]


# --- chat


def test_quotation_linking(spark):
    a = "The first message says something long enough.\nAnd a second line of it, too."
    b = "> The first message says something long\n> enough.\n\nI agree with all of that indeed."
    c = "On Monday, X wrote:\n> I agree with ALL of that, indeed!\n>> The first message says something long enough.\nYes, as I said before."
    d = "Nothing quoted here at all, just text."
    msgs = [(1, 0, "user", a), (1, 1, "assistant", b), (1, 2, "user", c), (1, 3, "user", d), (1, 4, "user", "> unknown passage of some length\nok"), (2, 0, "user", b), (2, 1, "user", None), (None, 1, "user", b), (3, None, None, "")]
    out = {(r["conv_id"], r["turn"]): r for r in chat.reply_order(spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string")).collect()}
    assert len(out) == len(msgs)
    assert out[1, 1]["parent_turn"] == 0 and out[1, 1]["body"] == "I agree with all of that indeed."
    assert (out[1, 2]["parent_turn"], out[1, 2]["root_turn"], out[1, 2]["depth"]) == (1, 0, 2)
    assert out[1, 2]["body"] == "Yes, as I said before."
    assert out[1, 3]["parent_turn"] is None and out[1, 3]["root_turn"] == 3
    assert out[1, 4]["parent_turn"] is None and out[1, 4]["body"] == "ok" and out[1, 4]["n_quotes"] == 1
    assert out[2, 0]["parent_turn"] is None and out[2, 1]["body"] == ""


def test_long_reply_chains(spark):
    said = [f"Statement number {i} of the conversation." for i in range(40)]
    msgs = [(7, i, "user", (f"> {said[i - 1]}\n" if i else "") + said[i]) for i in range(40)]
    out = chat.reply_order(spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string")).collect()
    assert {r["root_turn"] for r in out} == {0} and {r["depth"] for r in out} == set(range(40))


def test_short_and_cjk_quotes(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    said = ["Are you in?", "> Are you in?\nYes, please", "> Yes, please\n好的", "> 好的。\nはい", "> はい\n👍", "> 👍\nWhere?", "Yes, please",
            "> Yes, please\nFine", "Thanks.\nThe plan has three steps in all.", "Hi\nThanks.\nBye", "> Thanks.\n> The plan has three steps in all.\nok",
            "> Where?\nHere", "> Are you in?\nStill no"]
    msgs = [(c, i, "user", t) for c in (1, 2) for i, t in enumerate(said)]
    out = {(r["conv_id"], r["turn"]): r for r in chat.reply_order(spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string")).collect()}
    for c in (1, 2):
        assert [out[c, i]["parent_turn"] for i in range(len(said))] == [None, 0, 1, 2, 3, 4, None, 6, None, None, 8, 5, 0]
        assert [out[c, i]["n_quotes"] for i in range(len(said))] == [0, 1, 1, 1, 1, 1, 0, 1, 0, 0, 3, 1, 1]
        assert (out[c, 5]["root_turn"], out[c, 5]["depth"]) == (0, 5)
