"""Quality rules from tokeniser fertility.

Public vocabularies measure each whole text: characters per token, share of tokens that are byte
fallbacks (the byte tokens of a vocabulary with fallback; of a byte-level one, tokens that are no
valid UTF-8 by themselves) and entropy of the tokens. A band for each measure of each vocabulary comes
from all documents of the language (or, without a language, of the main script) that pass the base
rules. A measure is bad if the text is outside the bands of most vocabularies; one bad measure rejects
a document. A group of fewer than MIN_GROUP such documents uses the bands of all documents.

One Python pass measures the documents in Arrow batches, tokenising each distinct part of a text once; the measures (some 60 bytes a row) are
written to the shared folder, and quantile sketches, combined before the shuffle, give the bands.

Cases: null or empty text has no words and fails the base rules; a null doc_id and repeated rows
are measured like any row; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, table
from .wordhash import BLOCK, batches_of

TOKENIZERS = "/opt/tokenizers"
#: Byte-level vocabularies for many languages and for English, and one with real byte fallback.
VOCABULARIES = ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
#: The published pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Half a band is the larger of SPREADS robust deviations and a share of the median (for byte_share
#: an absolute width; upwards, chars_per_token has twice that), and wider in short texts: times sqrt(1 + SHORT / n_tokens).
SPREADS, SHORT, MIN_GROUP = 4.0, 400.0, 30
#: A task forgets the parts of texts when it has more than this.
KNOWN = 200_000
SHARES = {"chars_per_token": 0.075, "token_entropy": 0.25, "byte_share": 0.04}
BASE_MIN_WORDS, BASE_MAX_REPEAT_PERCENT = 50, 50

_BLANK = re.compile(r" (?<=[^\s\u2581] )(?=[^\s\u2581])")
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
#: Blocks of script names by their first code points, for texts without a language.
_SCRIPTS = ((0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "semitic"),
            (0x0900, "indic"), (0x0E00, "southeast-asian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
            (0x2000, "other"), (0x3040, "cjk"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"))
_STARTS = np.array([a for a, _ in _SCRIPTS], dtype=np.uint32)

SCHEMA = (
    "doc_id long, band string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " n_tokens array<long>, chars_per_token array<double>, byte_share array<double>, token_entropy array<double>"
)


def word_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() splits at blank and 0x09-0x0D only
    n = len(words)
    spaces = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeat = 0
    if n >= 3:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
        size = len(ids)
        if size < 2_000_000:  # three ids fit 63 bits
            key = (w[:-2] * size + w[1:-1]) * size + w[2:]
        else:
            _, pair = np.unique(w[:-1] * size + w[1:], return_inverse=True)
            key = pair[:-1] * np.int64(size) + w[2:]
        order = np.sort(key)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            at = np.searchsorted(twice, key)
            hit = twice[np.minimum(at, len(twice) - 1)] == key
            covered = np.zeros(n, dtype=bool)
            for k in range(3):
                covered[k : n - 2 + k] |= hit
            repeat = int(covered.sum())
    return n, spaces, len(_SYMBOLS.findall(raw)), dup_lines, repeat


def script_of(text: str) -> str:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    block = np.searchsorted(_STARTS, points, side="right")
    counts = np.bincount(block[block > 0], minlength=1)
    return _SCRIPTS[int(counts.argmax()) - 1][1] if counts.any() else "none"


class Parts(dict):
    """Numbers of the distinct parts of texts, in order of their first sight.

    Texts are cut at single blanks between other characters. Neither the pre-tokenisation pattern nor a
    piece ever joins what stands on both sides of such a blank, so a part has the same tokens in every
    text, and is tokenised once. A text's first part, which follows no blank, is led by a line feed,
    as no other part is.
    """

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        return n


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of tokens one after the other, and their lengths."""
    return np.array(list(itertools.chain.from_iterable(lists)), dtype=np.int32), np.array(list(map(len, lists)), dtype=np.int64)


class Meter:
    """A vocabulary that measures texts: a rank file (byte-level) or a piece model (with fallback)."""

    def __init__(self, name: str, content: bytes, pattern: str = PATTERN):
        self.forget()
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.encode = lambda texts: _flat(model.encode(texts, num_threads=1))
            self.follow = self.encode  # the model leads each with a blank of its own
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            self.fallback = np.array([model.is_byte(i) or model.is_unknown(i) for i in range(len(pieces))])
            self.cuts = all("\u2581" not in p.lstrip("\u2581") for p in pieces)
            return
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
        encode = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.encode = lambda texts: _flat(list(map(encode, texts)))
        self.cuts = pattern == PATTERN
        self.fallback = np.zeros(max(ranks.values()) + 1, dtype=bool)
        size = np.zeros(len(self.fallback), dtype=np.int64)

        def follow(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """All at once, as one text; a part ends at the token that reaches its last byte."""
            ids = np.array(encode("".join([" " + p for p in parts])), dtype=np.int32)
            ends = np.cumsum(np.fromiter((len(p.encode()) + 1 for p in parts), np.int64, len(parts)))
            return ids, np.diff(np.searchsorted(np.cumsum(size[ids]), ends) + 1, prepend=0)

        self.follow = follow
        for token, rank in ranks.items():
            size[rank] = len(token)
            try:
                token.decode()
            except UnicodeDecodeError:
                self.fallback[rank] = True

    def forget(self) -> None:
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, parts: list[str]) -> None:
        """Tokenises further parts, in the order of their numbers."""
        first = np.fromiter((p[0] == "\n" for p in parts), bool, len(parts))
        ids, length = self.encode([p[1:] for p in parts if p[0] == "\n"])
        more, lengths = self.follow([p for p in parts if p[0] != "\n"])
        both = np.concatenate((length, lengths))
        place = np.argsort(np.concatenate((np.flatnonzero(first), np.flatnonzero(~first))))
        self.start = np.concatenate((self.start, (len(self.flat) + np.cumsum(both) - both)[place]))
        self.length = np.concatenate((self.length, both[place]))
        self.flat = np.concatenate((self.flat, ids, more))

    def measure(self, doc: np.ndarray, part: np.ndarray, chars: np.ndarray) -> list[tuple[int, float, float, float]]:
        """n_tokens, characters per token, byte-fallback share, entropy in bits of texts, from their parts."""
        length = self.length[part]
        at = np.repeat(self.start[part] - np.cumsum(length) + length, length) + np.arange(length.sum())
        vocabulary = len(self.fallback)
        key = np.sort(np.repeat(doc * vocabulary, length) + self.flat[at])
        first = np.flatnonzero(np.diff(key, prepend=-1))
        counts = np.diff(first, append=len(key))
        doc, token = np.divmod(key[first], vocabulary)
        total = lambda x: np.bincount(doc, x, minlength=len(chars))
        n = total(counts)
        some = np.maximum(n, 1)
        entropy = np.log2(some) - total(counts * np.log2(counts)) / some
        columns = n.astype(np.int64), np.where(n > 0, chars / some, 0.0), total(counts * self.fallback[token]) / some, np.maximum(entropy, 0.0)
        return list(zip(*map(np.ndarray.tolist, columns), strict=True))


def measure_texts(texts: list[str], meters: list[Meter], known: Parts) -> Iterator[tuple[tuple[int, float, float, float], ...]]:
    """The measures of each text by each meter. ``known`` has the parts that the meters have learnt; it is
    emptied when it has become large, which changes no result."""
    cut = _BLANK.split if all(m.cuts for m in meters) else lambda text: [text]
    for i, j in batches_of(texts, [len(t) for t in texts], BLOCK):
        if len(known) > KNOWN:
            known.clear()
            for m in meters:
                m.forget()
        held, seen = [], len(known)
        for t in texts[i:j]:
            first, *rest = cut(t)
            numbers = list(map(known.__getitem__, rest))
            held.append(np.array([*numbers, known["\n" + first]] if t else [], dtype=np.int64))
        doc = np.repeat(np.arange(j - i), list(map(len, held)))
        part = np.concatenate(held)
        chars = np.array([len(t) for t in texts[i:j]])
        new = list(itertools.islice(known, seen, None))
        for m in meters:
            m.learn(new)
        yield from zip(*(m.measure(doc, part, chars) for m in meters), strict=True)


def vocabulary_paths(folder: str = TOKENIZERS, names: tuple[str, ...] = VOCABULARIES) -> list[str]:
    return [f"{folder}/{n}" for n in names]


def measures(docs: DataFrame, vocabularies: list[str] | None = None, pattern: str = PATTERN) -> DataFrame:
    """One row of SCHEMA per row of docs (doc_id, text, lang); arrays have one value a vocabulary."""
    files = []
    for path in vocabularies or vocabulary_paths():
        with open(path, "rb") as f:
            files.append((path, f.read()))  # public vocabularies, below 3 MB in all, go along with the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meters = [Meter(name, content, pattern) for name, content in files]
        schema = pa.schema([
            ("doc_id", pa.int64()), ("band", pa.string()), *[(c, pa.int64()) for c in (
                "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            ("n_tokens", pa.list_(pa.int64())), *[(c, pa.list_(pa.float64())) for c in MEASURES]])
        known = Parts()
        for batch in batches:
            texts = [(t or "").encode("utf-8", "replace").decode() for t in batch.column(1).to_pylist()]
            rows = []
            each = zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), measure_texts(texts, meters, known), strict=True)
            for doc, text, band, measured in each:
                band = f"lang:{band}" if band else f"script:{script_of(text)}"
                rows.append((doc, band, *word_counts(text), *map(list, zip(*measured, strict=True))))
            cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text", "lang").mapInArrow(run, SCHEMA)


def fertility_rules(docs: DataFrame, vocabularies: list[str] | None = None, spreads: float = SPREADS,
                    shares: dict[str, float] = SHARES, min_group: int = MIN_GROUP) -> DataFrame:
    """The measures of every document with base_failed, the verdict's three flags and kept."""
    vocabularies = vocabularies or vocabulary_paths()
    rows = materialise(measures(docs, vocabularies).withColumn(
        "base_failed",
        (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words")),
    ))
    each = [(c, v) for c in MEASURES for v in range(len(vocabularies))]
    sound = rows.where(~F.col("base_failed"))
    sketch = [F.percentile_approx(F.col(c)[v], [0.1, 0.5, 0.9], 10_000).alias(f"__{c}_{v}") for c, v in each]
    default = sound.agg(*sketch).first()
    bands = materialise(sound.groupBy(F.col("band").alias("__band")).agg(F.count("*").alias("__n"), *sketch).where(F.col("__n") >= min_group))
    joined = rows.join(broadcast_if_small(bands), F.col("band") == F.col("__band"), "left")

    def edge(c: str, v: int, sign: int):
        q = F.coalesce(F.col(f"__{c}_{v}"), F.array(*[F.lit(float(x)) for x in default[f"__{c}_{v}"] or [0.0, 0.0, 0.0]]))
        least = F.lit(shares[c]) if c == "byte_share" else q[1] * F.lit(shares[c])
        half = F.greatest((q[2] - q[0]) / F.lit(2.5631) * F.lit(spreads), least)
        return q[1] + F.lit(sign) * half * F.sqrt(1 + F.lit(SHORT) / F.greatest(F.col("n_tokens")[v], F.lit(1)))

    outside = {
        "bad_fertility": lambda v: (F.col("chars_per_token")[v] < edge("chars_per_token", v, -1)) | (F.col("chars_per_token")[v] > edge("chars_per_token", v, 2)),
        "bad_bytes": lambda v: F.col("byte_share")[v] > edge("byte_share", v, 1),
        "bad_entropy": lambda v: F.col("token_entropy")[v] < edge("token_entropy", v, -1),
    }
    most = [(name, [test(v).cast("int") for v in range(len(vocabularies))]) for name, test in outside.items()]
    flags = {name: sum(votes[1:], votes[0]) * 2 > len(vocabularies) for name, votes in most}
    return (
        joined.withColumns(flags)
        .withColumn("kept", ~(F.col("base_failed") | F.col("bad_fertility") | F.col("bad_bytes") | F.col("bad_entropy")))
        .drop("__band", "__n", *[f"__{c}_{v}" for c, v in each])
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "chars_per_token", "byte_share", "token_entropy",
    )
