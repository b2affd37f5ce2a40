"""Language identification by a byte convolutional network.

The network reads bytes (ASCII lower-cased) in windows of fixed length.  Filters
of widths 2, 3 and 4 slide over a window; each filter's largest response, through
a ReLU, goes to a softmax over the languages.  A filter of width w is w tables of
one weight a byte value, so a response is a sum of w table entries; for scoring,
neighbouring tables are joined into tables over byte pairs.

Training runs in numpy on the driver, on a sample whose size is a parameter
(``per_language`` documents of each language, ``train_bytes`` of each; chosen by a
hash).  Scoring reads every byte of every text, in batches of windows; the windows
of a text are averaged by the number of bytes they hold.

Defined results: ``und`` with score 0 for a null text and for one without a
letter, and for any text if there is nothing to learn from.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_map, crc_mod, kept_columns, strings

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
UNKNOWN = "und"
#: Labels that can be learned; of more, as in a dirty column, those with most documents.
MOST_LANGUAGES = 1000
_LETTER = re.compile(r"[^\W\d_]")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def windows_of(raw: bytes) -> np.ndarray:
    """All of ``raw`` in windows of WINDOW bytes; the last is filled with zero bytes."""
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.translate(_LOWER).ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class ByteCnn:
    """Filter tables, and the output layer over all filters."""

    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.15, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        self.out = rng.normal(0, 1 / np.sqrt(n), (n, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 0) -> None:
        """Adam on the cross entropy of windows ``x`` with labels ``y``."""
        rng = np.random.default_rng(seed)
        weights = [*self.tables, self.out, self.bias]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                xs, ys = x[order[at : at + batch]], y[order[at : at + batch]]
                rows = np.arange(len(xs))
                peaks, where = [], []
                for table, w in zip(self.tables, WIDTHS, strict=True):
                    m = WINDOW - w + 1
                    r = sum(table[j][xs[:, j : j + m]] for j in range(w))
                    where.append(r.argmax(axis=1))
                    peaks.append(np.take_along_axis(r, where[-1][:, None, :], axis=1)[:, 0])
                pooled = np.concatenate(peaks, axis=1)
                active = np.maximum(pooled, 0)
                p = _softmax(active @ self.out + self.bias)
                p[rows, ys] -= 1
                p /= len(xs)
                back = (p @ self.out.T) * (pooled > 0)
                grads = []
                for k, (table, w) in enumerate(zip(self.tables, WIDTHS, strict=True)):
                    g, part = np.zeros_like(table), back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(w):
                        np.add.at(g[j], (xs[rows[:, None], where[k] + j], np.arange(FILTERS)[None, :]), part)
                    grads.append(g)
                grads += [active.T @ p, p.sum(axis=0)]
                step += 1
                for w, g, a, b in zip(weights, grads, first, second, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def compiled(self) -> ByteCnn:
        """Build the tables over byte pairs that scoring uses."""
        t2, t3, t4 = self.tables
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.pairs = (pair(t2[0], t2[1]), pair(t3[0], t3[1]), pair(t4[0], t4[1]), pair(t4[2], t4[3]))
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each window the probability of each language."""
        out = np.empty((len(x), len(self.languages)), np.float32)
        two, three, four, four2 = self.pairs
        last = self.tables[1][2]
        for at in range(0, len(x), 64):
            xs = x[at : at + 64]
            ids = xs[:, :-1].astype(np.uint16) << 8 | xs[:, 1:]
            r3 = three.take(ids[:, :-1], axis=0)
            r3 += last.take(xs[:, 2:], axis=0)
            r4 = four.take(ids[:, :-2], axis=0)
            r4 += four2.take(ids[:, 2:], axis=0)
            pooled = np.concatenate([two.take(ids, axis=0).max(axis=1), r3.max(axis=1), r4.max(axis=1)], axis=1)
            out[at : at + 64] = _softmax(np.maximum(pooled, 0) @ self.out + self.bias)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its probability."""
        named, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        told = [i for i, t in enumerate(texts) if _LETTER.search(t)]
        if not told or not self.languages:
            return named, scores
        raw = [texts[i].encode("utf-8", "surrogatepass") for i in told]
        each = [windows_of(r) for r in raw]
        p = self.probabilities(np.concatenate(each))
        counts = np.array([len(w) for w in each])
        weight = np.full(len(p), WINDOW, np.float64)
        weight[np.cumsum(counts) - 1] = [len(r) - (n - 1) * WINDOW for r, n in zip(raw, counts, strict=True)]
        total = np.add.reduceat(p * weight[:, None], np.cumsum(counts) - counts, axis=0) / np.array([len(r) for r in raw])[:, None]
        for i, row in zip(told, total, strict=True):
            best = int(row.argmax())
            named[i], scores[i] = self.languages[best], min(1.0, float(row[best]))
        return named, scores


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", per_language: int = 400, train_bytes: int = 2048) -> ByteCnn:
    """A network trained on a bounded sample of rows with a label and a letter in the text.

    The sample holds about ``per_language`` documents of each language, chosen by
    a hash of the id, and ``train_bytes`` bytes of each from a place that the hash
    sets, for ``MOST_LANGUAGES`` labels at most.  These bounds keep it small whatever
    the table's size.
    """
    rows = labelled.where(F.col(label_column).isNotNull() & F.col(text_column).rlike(r"\p{L}"))
    each = rows.groupBy(label_column).count().orderBy(F.desc("count"), label_column)
    counts = {r[0]: r[1] for r in each.limit(MOST_LANGUAGES).collect()}
    if not counts:
        return ByteCnn([]).compiled()
    draw = F.pmod(F.xxhash64(F.col(id_column).cast("string"), F.lit("langid")), F.lit(1 << 40))
    share = F.lit(0)
    for language, n in counts.items():
        share = F.when(F.col(label_column) == language, min(1 << 40, -(-(1 << 40) * per_language // n))).otherwise(share)
    length = F.length(text_column)
    start = F.pmod(F.xxhash64(F.col(id_column).cast("string")), F.greatest(F.lit(1), length - train_bytes)).cast("int") + 1
    sample = rows.where(draw < share).select(F.col(label_column), F.substring(F.col(text_column), start, F.lit(train_bytes))).collect()
    languages = sorted(counts)
    x, y = [], []
    for language, text in sorted((tuple(r) for r in sample)):
        w = windows_of(text.encode("utf-8", "surrogatepass"))
        x.append(w)
        y += [languages.index(language)] * len(w)
    net = ByteCnn(languages)
    if x:
        net.fit(np.concatenate(x), np.array(y))
    return net.compiled()


def identify(documents: DataFrame, net: ByteCnn, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` of every document, ``lang_pred`` and ``score``; one pass without a shuffle."""
    spark: SparkSession = documents.sparkSession
    shared = spark.sparkContext.broadcast(net)  # a few MB, set by the widths and filters
    keep = kept_columns(keep, "lang_pred", "score")
    source = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_column).alias("of"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        named, scores = shared.value.predict(strings(batch.column(len(keep))))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(named, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    schema = ", ".join([*(f"{c} {t}" for c, t in source.dtypes[:-1]), "lang_pred string, score double"])
    return arrow_map(source, "of", run, schema, 1 << 20).withColumnsRenamed({f"c{i}": c for i, c in enumerate(keep)})


def language_of_documents(documents: DataFrame) -> DataFrame:
    """Train on the documents outside the held-out third and predict all of them."""
    learn = documents.where(crc_mod("doc_id", 3) != 1)
    return identify(documents, train(learn)).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
