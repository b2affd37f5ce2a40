"""Toxicity by compression distance to two zstandard dictionaries.

The *ordinary* dictionary is trained on ordinary text, the *toxic* one on what
sets toxic text apart: spans of words whose fragments have a far higher rate per word in toxic
documents than in ordinary ones, over all documents or inside a group of like texts
(languages and scripts, learned from the texts alone).  Both are used
behind the same ordinary content, and the ordinary one is filled up with bytes that
no text holds to the toxic one's length; so a window of ordinary text compresses
alike under both, and one with toxic words compresses shorter under the toxic one.

A text is cut into windows of a few words.  The gain of a window is its length
compressed with the ordinary dictionary less that with the toxic one.  The largest
gains of a document and its densities of gains, with its number of windows, go to a logistic function whose
weights are calibrated on labelled documents that trained neither dictionary, so
that the decision threshold is a probability.  A window that shares no MATCH bytes
with the toxic spans cannot gain, as no match is shorter; it is not compressed.

Both dictionaries and the calibration read the whole texts of a sample of labelled
documents, whose size is a parameter (``documents``, and ``characters`` of all of them
together).  Scoring reads whole texts in one pass.

Defined results: null and empty texts are scored as one empty window; with no
toxic or no ordinary document to learn from, the share of toxic labels is the
score of every document.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_map, bounded_sample, crc_mod, kept_columns, strings

WORDS = 3
FRAGMENT = 5
#: Bytes of the pieces that whole texts are cut into for the trainer of dictionaries.
PIECE = 400
#: The shortest match of the compressors: a fragment and one byte more, as shorter ones occur in all words.
MATCH = 6
THRESHOLD = 0.3
#: Bytes of ordinary text in a dictionary, and of toxic spans.
ORDINARY_BYTES, TOXIC_BYTES = 512, 4096
#: Labelled documents that training reads, and characters of all of them together.
DOCUMENTS, CHARACTERS = 6000, 1 << 25
#: Groups of like texts; the ratio of rates and the toxic documents that a telling fragment needs.
GROUPS, RATIO, SUPPORT = 8, 4, 5
#: Starts every window and ends every dictionary, so that all windows compress.
PREAMBLE = bytes(range(128, 160))
_WINDOW = re.compile(rb" \S+(?: \S+){0,%d}" % (WORDS - 1))


def windows(text: str) -> list[bytes]:
    """The words of a text, ASCII lower-cased, in windows of WORDS, which follow each other without gaps."""
    return _WINDOW.findall(b" " + b" ".join(text.encode("utf-8", "surrogatepass").lower().split())) or [b""]


def _hashes(raw: bytes) -> np.ndarray:
    """A 16-bit hash of every MATCH bytes in a row."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    h = np.zeros(len(b) - MATCH + 1, np.uint32)
    for i in range(MATCH):
        h = (h ^ b[i : i + len(h)]) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
    return h >> np.uint32(16)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=14, hash_log=10, chain_log=10, search_log=4, min_match=MATCH, target_length=8,
        strategy=zstandard.STRATEGY_LAZY, write_checksum=False, write_content_size=False, write_dict_id=False,
    )
    dictionary = zstandard.ZstdCompressionDict(content + PREAMBLE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)


def pieces(text: str) -> list[bytes]:
    """The whole text, lower-cased and with single spaces, in pieces of PIECE bytes."""
    raw = b" " + b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def _trained(size: int, samples: list[bytes], segment: int) -> bytes:
    """A zstandard dictionary of segments of samples; their first bytes if they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=MATCH).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def toxic_dictionary(spans: Counter, size: int = TOXIC_BYTES) -> bytes:
    """A dictionary trained on spans, followed by the spans themselves, those with the largest weights last."""
    top = sorted(spans.items(), key=lambda x: (-x[1], x[0]))
    whole: list[bytes] = []
    room = size
    for s, _ in top:
        if room < len(s):
            break
        if not any(s in w for w in whole):
            whole.append(s)
            room -= len(s)
    core = _trained(size, [s for s, c in top for _ in range(min(int(c) + 1, 50))], 16) if room >= size // 2 else b""
    return (core + b"".join(reversed(whole)))[-size:]


def _fragments(word: bytes) -> list[bytes]:
    word = b" " + word
    return [word[i : i + FRAGMENT] for i in range(max(1, len(word) - FRAGMENT + 1))]


def _words(text: str) -> Counter:
    return Counter(text.encode("utf-8", "surrogatepass").lower().split())


def text_groups(words_of: list[Counter], groups: int = GROUPS, cells: int = 1024) -> np.ndarray:
    """A group of every document by the word beginnings that it has: languages and scripts fall apart.

    Spherical k-means on hashed counts; the labels and the language column are not read.
    """
    x = np.zeros((len(words_of), cells), np.float32)
    for row, words in zip(x, words_of, strict=True):
        for w, c in words.items():
            row[zlib.crc32(w[:3]) % cells] += c
    x = np.sqrt(x)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = x[:1]
    while len(centres) < min(groups, len(x)):  # the farthest document of a spread-out sample starts a group
        centres = np.vstack([centres, x[(x @ centres.T).max(axis=1).argsort(kind="stable")[len(x) // 20]]])
    of = np.zeros(len(x), np.int64)
    for _ in range(20):
        now = (x @ centres.T).argmax(axis=1)
        if (now == of).all():
            break
        of = now
        for g in range(len(centres)):
            if (of == g).any():
                mean = x[of == g].sum(axis=0)
                centres[g] = mean / max(np.linalg.norm(mean), 1e-9)
    return of


def _rates(words_of: list[Counter]) -> tuple[Counter, Counter, int]:
    """Of every fragment, how often it occurs outside the document that has most of it, and in how many documents; the number of words."""
    total, most, documents, n = Counter(), {}, Counter(), 0
    for words in words_of:
        here: Counter = Counter()
        for w, c in words.items():
            for f in _fragments(w):
                here[f] += c
            n += c
        for f, c in here.items():
            total[f] += c
            documents[f] += 1
            if c > most.get(f, 0):
                most[f] = c
    for f, c in most.items():
        total[f] -= c
    return total, documents, n


def telling_spans(toxic: list[str], ordinary: list[str]) -> Counter:
    """Spans of words made of fragments that tell toxic from ordinary text, with their weights.

    A fragment tells if its rate per word in toxic documents is, with two standard
    errors allowed, RATIO times that in ordinary ones, over all documents or inside
    one group of like texts; so a fragment may be common elsewhere, or occur by
    chance in many long ordinary documents.  The document that has most of it does
    not count, and SUPPORT toxic documents must have it.
    """
    words_of = [_words(t) for t in (*toxic, *ordinary)]
    is_toxic = np.arange(len(words_of)) < len(toxic)
    group = text_groups(words_of)
    spans: Counter = Counter()
    for g in (-1, *np.unique(group)):
        inside = np.ones(len(group), bool) if g == -1 else group == g
        mine = [words_of[i] for i in np.flatnonzero(inside & is_toxic)]
        t, documents, n = _rates(mine)
        o, _, m = _rates([words_of[i] for i in np.flatnonzero(inside & ~is_toxic)])
        if not n or not m:
            continue
        good = {}
        for f, c in t.items():
            if documents[f] >= SUPPORT:
                low, high = (c - 2 * c**0.5) / n, (o[f] + 2 * (o[f] + 1) ** 0.5) / m
                if low > RATIO * high:
                    good[f] = low
        for words in mine if good else ():
            for w, c in words.items():
                marks = bytearray(len(w) + 1)
                for i, f in enumerate(_fragments(w)):
                    if f in good:
                        marks[i : i + len(f)] = b"\1" * len(f)
                spans.update({(b" " + w)[x.start() : x.end()]: c for x in re.finditer(b"\1+", bytes(marks))})
    return spans


class DistanceClassifier:
    """Two dictionaries and a calibrated decision."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self.weights = np.zeros(1 + 10)
        self._warm()

    def _warm(self) -> None:
        filler = np.random.default_rng(0).integers(192, 255, len(self.toxic)).astype(np.uint8).tobytes()
        self._under_ordinary = _compressor(self.ordinary + filler).compress
        self._under_toxic = _compressor(self.ordinary + self.toxic).compress
        self._telling = np.zeros(1 << 16, bool)
        if len(self.toxic) >= MATCH:
            self._telling[_hashes(self.toxic)] = True

    def __getstate__(self) -> tuple:
        return self.ordinary, self.toxic, self.weights

    def __setstate__(self, state: tuple) -> None:
        self.ordinary, self.toxic, self.weights = state
        self._warm()

    def gains(self, parts: list[bytes]) -> list[int]:
        """The gains of the windows that can have one."""
        raw = b"".join(parts) + b" "
        if len(raw) < MATCH:
            return []
        at = np.flatnonzero(self._telling[_hashes(raw)])
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        of = np.searchsorted(ends, at, side="right")
        a, b = self._under_ordinary, self._under_toxic
        near = np.unique(of[at + MATCH <= ends[of] + 1])  # the space after a window counts
        return [len(a(w)) - len(b(w)) for w in (PREAMBLE + parts[i] + b" " for i in near.tolist())]

    def features(self, text: str) -> list[float]:
        """The three largest gains, densities of gains and the log of the number of windows."""
        parts = windows(text)
        gains = np.sort(np.array(self.gains(parts), float))[::-1]
        top = [*gains[:3], 0.0, 0.0, 0.0][:3]
        n = len(parts)
        dense = [np.maximum(0, gains - g).sum() / n for g in (0, 1, 3)]
        rare = [np.sqrt(x) for x in dense]
        return [*map(float, top), *map(float, dense), *map(float, rare), float(np.log(n))]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Ridge-penalised logistic regression by Newton steps."""
        x = np.column_stack([np.ones(len(x)), x])
        w = np.zeros(x.shape[1])
        penalty = np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
            w += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def score(self, text: str) -> float:
        """The probability of label 1."""
        z = float(self.weights[0] + np.dot(self.weights[1:], self.features(text))) if self.weights[1:].any() else float(self.weights[0])
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def fit(labelled: Iterable[tuple[str, int]]) -> DistanceClassifier:
    """A classifier from (text, label); a third calibrates, and copies of a text train once."""
    rows = sorted(set(labelled))
    order = np.random.default_rng(0).permutation(len(rows))
    rows = [rows[i] for i in order]
    share = sum(y for _, y in rows) / len(rows) if rows else 0.0
    learn, held = rows[len(rows) // 3 :], rows[: len(rows) // 3]
    toxic, ordinary = [t for t, y in learn if y], [t for t, y in learn if not y]
    if not toxic or not ordinary or len({y for _, y in held}) < 2:
        none = DistanceClassifier(b"", b"")
        none.weights[0] = np.log((share + 1e-9) / (1 - share + 1e-9))
        return none
    plain = [p for t in ordinary for p in pieces(t)]
    spans = telling_spans(toxic, ordinary)
    model = DistanceClassifier(_trained(ORDINARY_BYTES, plain, 48), toxic_dictionary(spans) if spans else b"")
    model.calibrate(np.array([model.features(t) for t, _ in held]), np.array([y for _, y in held]))
    return model


def train(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", documents: int = DOCUMENTS, characters: int = CHARACTERS) -> DistanceClassifier:
    """A classifier from rows of (id, text, label 0 or 1).

    Rows are chosen by a hash of the id: at most about ``documents`` of them, and so
    few that their whole texts have about ``characters`` characters together; of
    these, a third calibrates.  Copies of a text train once.
    """
    known = labelled.where(F.col(label_column).isin(0, 1)).select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), F.col(label_column).alias("y"))
    known = bounded_sample(known, "id", documents)
    longest = known.agg(F.sum(F.length("text")).alias("all"), F.count("*").alias("n")).first()
    if longest["n"] and longest["all"] > characters:
        known = bounded_sample(known, "id", longest["n"] * characters // longest["all"], "characters")
    return fit((r["text"], int(r["y"])) for r in known.collect())


def score_documents(documents: DataFrame, model: DistanceClassifier, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` of every document, ``score`` and ``predicted``; one pass without a shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a few kB
    keep = kept_columns(keep, "score", "predicted")
    source = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_column).alias("of"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [shared.value.score(t) for t in strings(batch.column(len(keep)))]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=[*batch.schema.names[:-1], "score", "predicted"]
        )

    schema = ", ".join([*(f"{c} {t}" for c, t in source.dtypes[:-1]), "score double, predicted int"])
    return arrow_map(source, "of", run, schema, 1 << 20).withColumnsRenamed({f"c{i}": c for i, c in enumerate(keep)})


def learn_toxicity(documents: DataFrame, labels: DataFrame) -> DistanceClassifier:
    """A classifier from all labels outside the held-out quarter.

    A document with several labels counts as toxic if one of them says so.
    """
    known = labels.where(F.col("doc_id").isNotNull() & (crc_mod("doc_id", 4) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded_sample(known.where(F.col("toxic").isin(0, 1)), "doc_id", DOCUMENTS)
    texts = documents.select(F.col("doc_id").alias("id"), F.col("text"))
    # the chosen labels have a bounded number, so they may be broadcast
    return train(texts.join(F.broadcast(chosen), F.col("id") == F.col("doc_id")), "id")


def toxicity_of_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels outside the held-out quarter and score all documents."""
    model = learn_toxicity(documents, labels)
    return score_documents(documents, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
