"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network."""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import annotate, blocks, fold, query, shielded, table

DIM, NONZERO, HIDDEN = 128, 8, 32
OTHER = "<other>"  # words outside the vocabulary
_TOKEN = re.compile(r"[^\W\d_]+|\d+|_+|[^\w\s]+|\n")


def bag(text: bytes) -> Counter[str]:
    """Word counts of a whole text. Upper-case words and immediate repetitions count as words of their own too."""
    out: Counter[str] = Counter()
    for block in blocks(text):
        words = _TOKEN.findall(block.decode(errors="ignore"))
        seen = Counter(words)
        out["<repeat>"] += sum(map(operator.eq, words, words[1:]))
        for w, n in seen.items():
            low = w.lower()
            out[low] += n
            if low != w and len(w) > 1 and w.isupper():
                out["<upper>"] += n
            if w.isdigit():
                out["<digits>"] += n
    return out


def index_vector(word: str) -> np.ndarray:
    """The sparse random vector of a word: NONZERO entries of +1 or -1 placed by its hash."""
    rng = np.random.default_rng(xxhash.xxh64_intdigest(word, 7))
    v = np.zeros(DIM, np.float32)
    v[rng.choice(DIM, NONZERO, replace=False)] = rng.choice((-1.0, 1.0), NONZERO)
    return v / NONZERO**0.5


@dataclass
class Model:
    """words: row of each word in vectors; (w1, b1, w2, b2): the network; temperature divides its logit."""

    words: dict[str, int]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    net: tuple[np.ndarray, ...]
    temperature: float

    def pool(self, bags: Iterable[Counter[str]]) -> np.ndarray:
        """The mean word vector of each document; no words: zeros."""
        out = []
        for b in bags:
            n = sum(b.values())
            if not n:
                out.append(np.zeros(DIM, np.float32))
                continue
            at = np.fromiter((self.words.get(w, 0) for w in b), np.int64, len(b))
            out.append(np.fromiter(b.values(), np.float32, len(b)) @ self.vectors[at] / n)
        return np.array(out, np.float32).reshape(-1, DIM)

    def scores(self, bags: Iterable[Counter[str]]) -> np.ndarray:
        z = _forward(self.net, (self.pool(bags) - self.mean) / self.scale)[1] / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40).astype(float)))


def _forward(net, x):
    w1, b1, w2, b2 = net
    h = np.tanh(x @ w1 + b1)
    return h, h @ w2 + b2[0]


def word_vectors(sample: list[bytes], vocabulary: int, window: int = 2) -> tuple[dict[str, int], np.ndarray]:
    """Random indexing: a word's vector is its own index vector plus the (scaled) sum of its neighbours'."""
    bags = [bag(t) for t in sample]
    df = Counter(w for b in bags for w in b)
    words = {w: i + 1 for i, (w, _) in enumerate(sorted(df.items(), key=lambda x: (-x[1], x[0]))[:vocabulary])}
    index = np.stack([index_vector(OTHER), *(index_vector(w) for w in words)])
    context = np.zeros_like(index)
    for text in sample:
        at = np.array([words.get(w, 0) for w in _TOKEN.findall(text.decode(errors="ignore").lower())], np.int64)
        for d in range(1, window + 1):
            if len(at) > d:
                np.add.at(context, at[d:], index[at[:-d]])
                np.add.at(context, at[:-d], index[at[d:]])
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return words, (index + 0.5 * context / np.where(norm > 0, norm, 1)).astype(np.float32)


def train_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 60, seed: int = 11) -> tuple[np.ndarray, ...]:
    """Adam on the weighted cross entropy."""
    rng = np.random.default_rng(seed)
    net = [rng.normal(0, DIM**-0.5, (DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 128):
            at = order[a : a + 128]
            h, z = _forward(net, x[at])
            g = (1 / (1 + np.exp(-z)) - y[at]) * weight[at] / len(at)
            back = np.outer(g, net[2]) * (1 - h * h)
            grads = [x[at].T @ back + 1e-4 * net[0], back.sum(0), h.T @ g + 1e-4 * net[2], np.array([g.sum()])]
            step += 1
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                net[i] = net[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(p.astype(np.float32) for p in net)


def temperature(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """What to divide logits by for the smallest cross entropy on rows the network has not seen."""
    grid = np.geomspace(0.25, 8, 61)
    loss = [(weight * np.logaddexp(0, np.where(y > 0, -z, z) / t)).sum() for t in grid]
    return float(grid[int(np.argmin(loss))]) if len(z) else 1.0


def draw(docs: DataFrame, labels: DataFrame, per_class: int, slice_chars: int, id_col: str, text_col: str, label_col: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(texts, labels, weights) of at most about `per_class` labelled rows a class, `slice_chars` of each.

    Weights restore the classes' shares. Rows are drawn by a hash of their id; the label sample is bounded,
    so it can be broadcast to the documents.
    """
    own = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    counts = {r.y: r["count"] for r in own.groupBy("y").count().collect()}
    if not counts:
        return [], np.zeros(0), np.zeros(0)
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = own.where(part < F.create_map(*(F.lit(x) for y, n in counts.items() for x in (y, min(1.0, per_class / n))))[F.col("y")])
    h = F.xxhash64(text_col)
    at = F.pmod(h, F.greatest(F.length(text_col) - slice_chars, F.lit(1))) + 1
    rows = docs.select(F.col(id_col).alias("id"), F.substr(text_col, at.cast("int"), F.lit(slice_chars)).alias("part"), h.alias("h"))
    found = sorted({(r.h or 0, r.y, r.part or "") for r in rows.join(F.broadcast(chosen), "id").select("h", "y", "part").collect()})
    y = np.array([r[1] for r in found], np.float64)
    total = sum(counts.values())
    weight = np.array([counts[r[1]] / total for r in found]) / np.maximum(1, np.where(y > 0, (y > 0).sum(), (y == 0).sum()))
    return [r[2].encode() for r in found], y, weight * len(found)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, slice_chars: int = 4096, vocabulary: int = 20000,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Learn from a bounded sample (`per_class` x 2 rows of `slice_chars`); None if no class or only one is labelled."""
    sample, y, weight = draw(docs, labels, per_class, slice_chars, id_col, text_col, label_col)
    if len(set(y)) < 2:
        return None
    words, vectors = word_vectors(sample, vocabulary)
    model = Model(words, vectors, np.zeros(DIM), np.ones(DIM), (), 1.0)
    x = model.pool(bag(t) for t in sample)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-4
    x = (x - model.mean) / model.scale
    aside = np.arange(len(x)) % 5 == 0
    model.net = train_network(x[~aside], y[~aside], weight[~aside])
    model.temperature = temperature(_forward(model.net, x[aside])[1].astype(float), y[aside], weight[aside])
    return model


def score(docs: DataFrame, model: Model | None, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """`docs` with _score, the calibrated probability of label 1, over whole texts.

    Null and empty texts have no words and get the score of the zero vector; without a model all scores are
    0.5. Equal texts get equal scores; other columns stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: vocabulary x DIM

    def run(rows):
        m = sent.value
        rows = list(rows)
        return [m.scores(map(bag, rows)) if m else np.full(len(rows), 0.5)]

    return annotate(docs, text_col, "_score double", run, keep_text)


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: float = 0.5) -> DataFrame:
    """`docs` without those that score under `least`, learning from the rows outside the held-out fold."""
    docs, to, back = shielded(docs)
    labels = labels.select(F.col(id_col).alias(to(id_col)), "quality")
    model = fit(docs.where(fold(to(id_col), 3) != 1), labels, id_col=to(id_col), text_col=to(text_col))
    return back(score(docs, model, to(text_col), keep_text=True).where(F.col("_score") >= least))


@query("op9_quality_random_indexing")
def op9(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs.where(fold("doc_id", 3) != 1), labels)
    rows = docs.select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out"))
    return score(rows, model).select(
        "doc_id", "held_out", F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted")
    )
