"""Language ID by string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of character n-grams of
lengths 1 to 3 that both contain, over the geometric mean of their own counts. N-grams are hashed to
2**BITS features. Nystroem landmarks span the feature space, kernel ridge regression is solved for
one language against the rest, and texts are scored in batches by matrix products: presence rows
(batch x features) times the landmarks' presence (features x landmarks) times the dual weights
(landmarks x languages); the last two factors do not depend on the batch and are multiplied once.

The model is fitted on a bounded sample: at most PER_LANG labelled documents of a language and
FIT_ROWS in all, drawn by a hash of doc_id from the documents that may be learned from. Executors
send the sample's packed presence bits (2**BITS / 8 bytes each), whatever the texts' lengths.

Cases: a null text or one without a letter is 'und' with score 0; a null lang is never learned; a
null doc_id counts as held out; without any labelled document all are 'und'; repeated rows are
predicted alike; columns named like a result column give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .wordhash import parts

BITS, ORDERS = 16, 3
PER_LANG, FIT_ROWS, LANDMARKS, RIDGE = 300, 2400, 192, 1e-2
MAX_LANGUAGES = 2000
FOLDS = 5
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
#: Odd multipliers for hashing, from the fraction of the golden ratio and its kin.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SHIFT = np.uint64(64 - BITS)
_BLOCK = 1 << 20


def present(text: str) -> np.ndarray:
    """The sorted features of a whole text, taken block by block so that memory stays bounded."""
    seen = np.zeros(1 << BITS, dtype=bool)
    text = text.lower()
    for start in range(0, max(len(text), 1), _BLOCK):
        raw = text[start : start + _BLOCK + ORDERS - 1].encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(raw, dtype=np.uint32).astype(np.uint64)
        key = np.zeros_like(points)
        for n in range(ORDERS):
            if len(points) <= n:
                break
            key = (key[: len(points) - n] << np.uint64(21)) | points[n:]
            seen[(key * _MIX[n]) >> _SHIFT] = True
    return np.flatnonzero(seen)


def fit(rows: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
    """Languages and weights (features x languages) of the one-versus-rest kernel ridge regression."""
    langs = sorted(set(labels))
    y = np.array([[float(a == b) for b in langs] for a in labels])
    # Landmarks: the rows of each language in turn.
    rank = {}
    seen: dict[str, int] = {}
    for i in range(len(rows)):
        rank[i] = seen[labels[i]] = seen.get(labels[i], -1) + 1
    order = sorted(range(len(rows)), key=lambda i: (rank[i], i))[:landmarks]

    def dense(part: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(part), 1 << BITS), dtype=np.float32)
        for i, r in enumerate(part):
            x[i, r] = 1.0 / np.sqrt(max(len(r), 1))
        return x

    lm = dense([rows[i] for i in order])
    k_mm = (lm @ lm.T).astype(np.float64)
    k_nm = np.concatenate([dense(rows[i : i + 128]) @ lm.T for i in range(0, len(rows), 128)]).astype(np.float64)
    values, vectors = np.linalg.eigh(k_mm)
    root = vectors * (np.maximum(values, 1e-6) ** -0.5)
    phi = k_nm @ root
    w = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]), phi.T @ y)
    dual = root @ w  # landmarks x languages
    return langs, (lm.T.astype(np.float64) @ dual).astype(np.float32)


def train(docs: DataFrame, folds: int = FOLDS, per_lang: int = PER_LANG, fit_rows: int = FIT_ROWS):
    """The model from a bounded sample of the labelled documents outside the held-out fold."""
    learn = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(
        F.crc32(F.col("doc_id").cast("string")) % folds != 0
    )
    counts = learn.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: lang is a closed vocabulary")
    if not counts:
        return [], np.zeros((1 << BITS, 0), dtype=np.float32)
    quota = max(1, min(per_lang, fit_rows // len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.2 * quota / r["count"]))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = learn.select("doc_id", "lang", "text").where(draw < F.element_at(share, F.col("lang")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = []
            for t in b.column(2):
                x = np.zeros(1 << BITS, dtype=bool)
                x[present(t.as_py())] = True
                bits.append(np.packbits(x).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.binary())], names=["doc_id", "lang", "bits"])

    got = sorted(sample.mapInArrow(pack, "doc_id long, lang string, bits binary").collect(), key=lambda r: (r["lang"], r["doc_id"], r["bits"]))
    taken: dict[str, int] = {}
    rows, labels = [], []
    for r in got:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= quota:
            rows.append(np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8))))
            labels.append(r["lang"])
    return fit(rows, labels)


def identify(docs: DataFrame, folds: int = FOLDS, model=None) -> DataFrame:
    """``docs`` with held_out, lang_pred and score. Only ``text`` goes into a prediction."""
    langs, weights = model or train(docs, folds)
    keep = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    docs = docs.select(*keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "text"):
            texts = b.column(b.schema.names.index("text"))
            rows, sizes, which = [], [], []
            pred, best = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            for i, t in enumerate(texts):
                t = t.as_py()
                if langs and t and _LETTER.search(t):
                    r = present(t)
                    rows.append(r)
                    sizes.append(len(r))
                    which.append(i)
            if rows:
                starts = np.cumsum([0, *sizes[:-1]])
                # Sparse presence rows times weights: sums over each row's features.
                raw = np.empty((len(rows), len(langs)))
                for a in range(0, len(rows), 256):
                    part = np.concatenate(rows[a : a + 256])
                    raw[a : a + 256] = np.add.reduceat(weights[part], starts[a : a + 256] - starts[a], axis=0)
                raw /= np.sqrt(np.array(sizes))[:, None]
                top = raw.argmax(axis=1)
                for i, k, v in zip(which, top, raw.max(axis=1), strict=True):
                    pred[i], best[i] = langs[k], min(1.0, max(0.0, float(v)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(pred, pa.string()), pa.array(best, pa.float64())],
                names=[*b.schema.names, "lang_pred", "score"],
            )

    schema = docs.schema
    out = docs.mapInArrow(score, type(schema)([*schema.fields]).add("lang_pred", "string").add("score", "double"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(True))
    return out.withColumn("held_out", held)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), model=train(docs))
    return out.select("doc_id", "held_out", "lang_pred", F.round("score", 6).alias("score"))
