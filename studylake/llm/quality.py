"""Quality classifier: attention-based multiple-instance learning (Ilse et al., 2018) in numpy.

A document is a bag of passages of ``PASSAGE`` bytes. Each passage is encoded by a small network from counts of its bytes
and words; gated attention weighs the passages, and the weighted sum is scored. Weights of encoder, attention and score are
learned together from the labels of whole documents.

The model is fitted on the driver on a bounded sample of labelled rows (``max_documents``, and ``max_passages`` of each,
spread evenly over the text); it is a few thousand numbers. Scoring reads every passage of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, tidy

PASSAGE = 1024
#: Passages whose bytes are counted at a time.
STRETCH = 1 << 12
HIDDEN, GATE = 24, 16
#: Bytes are counted by class: control, each ASCII sign, digits, capitals, each small letter, and bytes beyond ASCII.
_CLASS = np.zeros(256, dtype=np.int64)


def _classes() -> int:
    n = 1
    for b in range(32, 128):
        c = chr(b)
        if c.isdigit() and c != "0" or c.isupper() and c != "A":
            _CLASS[b] = _CLASS[ord("0" if c.isdigit() else "A")]
        else:
            _CLASS[b] = n
            n += 1
    _CLASS[10], _CLASS[128:192], _CLASS[192:] = n, n + 1, n + 2
    return n + 3


CLASSES = _classes()
EXTRA = 8
FEATURES = CLASSES + EXTRA
#: The feature that holds a passage's size, and the bytes at which a passage speaks half for itself, half for the average.
SIZE, SHRINK = CLASSES + 5, 48


def features(text: str | None) -> np.ndarray:
    """One row of features for each passage of a text; an empty or null text is one passage of zeros.

    Features are the square roots of the shares of byte classes, then word statistics: the share of different words, of
    repeated neighbours, of words in capitals, of words without a letter, mean word length, bytes and lines, all in units
    of about one.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = max(1, -(-len(data) // PASSAGE))
    out = np.zeros((n, FEATURES), dtype=np.float32)
    if not len(data):
        return out
    raw = data.tobytes()
    counts = np.empty((n, CLASSES), dtype=np.int64)
    for at in range(0, n, STRETCH):
        # A stretch at a time, so that a long text takes little besides its features.
        some = data[at * PASSAGE : (at + STRETCH) * PASSAGE]
        k = -(-len(some) // PASSAGE)
        counts[at : at + k] = np.bincount(np.arange(len(some)) // PASSAGE * CLASSES + _CLASS[some], minlength=k * CLASSES).reshape(k, CLASSES)
    sizes = counts.sum(axis=1)
    out[:, :CLASSES] = np.sqrt(counts / sizes[:, None])
    for i in range(n):
        words = raw[i * PASSAGE : (i + 1) * PASSAGE].split()
        k = len(words) or 1
        out[i, CLASSES:] = (
            len(set(words)) / k,
            sum(map(bytes.__eq__, words, words[1:])) / k,
            sum(map(bytes.isupper, words)) / k,
            sum(map(bytes.isalpha, words)) / k,
            min(3.0, sizes[i] / k / 8),
            sizes[i] / PASSAGE,
            counts[i, _CLASS[10]] / k,
            1.0,
        )
    return out


@dataclass
class Model:
    """Parameters: encoder (w, b), attention (v, u, a), score (c, d), and the scale of the features."""

    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    NAMES = ("w", "b", "v", "u", "a", "c", "d")

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        """Passages ``x`` of documents that begin at ``starts``; keeps what the gradient needs."""
        size = x[:, SIZE : SIZE + 1] * PASSAGE
        x = (x - self.mean) / self.scale * (size / (size + SHRINK))
        h = np.tanh(x @ self.w + self.b)
        tv, su = np.tanh(h @ self.v), _sigmoid(h @ self.u)
        logit = (tv * su) @ self.a
        doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        e = np.exp(logit - np.maximum.reduceat(logit, starts)[doc])
        weight = e / np.add.reduceat(e, starts)[doc]
        z = np.add.reduceat(weight[:, None] * h, starts)
        return {"x": x, "h": h, "tv": tv, "su": su, "weight": weight, "doc": doc, "z": z, "p": _sigmoid(z @ self.c + self.d)}

    def gradients(self, s: dict, starts: np.ndarray, y: np.ndarray, cost: np.ndarray) -> dict[str, np.ndarray]:
        g = (s["p"] - y) * cost
        dz = g[:, None] * self.c
        dh = s["weight"][:, None] * dz[s["doc"]]
        dw = np.einsum("ij,ij->i", s["h"], dz[s["doc"]])
        dlogit = s["weight"] * (dw - np.add.reduceat(s["weight"] * dw, starts)[s["doc"]])
        da = (s["tv"] * s["su"]).T @ dlogit
        dgate = dlogit[:, None] * self.a
        dtv, dsu = dgate * s["su"] * (1 - s["tv"] ** 2), dgate * s["tv"] * s["su"] * (1 - s["su"])
        dh += dtv @ self.v.T + dsu @ self.u.T
        dpre = dh * (1 - s["h"] ** 2)
        return {"w": s["x"].T @ dpre, "b": dpre.sum(0), "v": s["h"].T @ dtv, "u": s["h"].T @ dsu, "a": da, "c": s["z"].T @ g, "d": g.sum()}

    def scores(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.forward(x, starts)["p"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(bags: list[np.ndarray], y: np.ndarray, *, epochs: int = 40, seed: int = 7) -> Model:
    """Adam on the weighted log loss, each class weighing half. Same bags in the same order, same model."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags).astype(np.float64) if bags else np.zeros((1, FEATURES))
    near = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    model = Model(
        near(FEATURES, HIDDEN), np.zeros(HIDDEN), near(HIDDEN, GATE), near(HIDDEN, GATE), near(GATE), near(HIDDEN), np.zeros(()), every.mean(0), every.std(0) + 0.05
    )
    if not len(y) or y.min() == y.max():
        # One class alone, or no labels: the score is the share of label 1, or one half.
        model.c = np.zeros(HIDDEN)
        model.d = np.array(0.0 if not len(y) else 4.0 if y[0] else -4.0)
        return model
    share = np.bincount(y.astype(int), minlength=2) / len(y)
    first, second = {k: 0.0 for k in Model.NAMES}, {k: 0.0 for k in Model.NAMES}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            x = np.concatenate([bags[i] for i in some]).astype(np.float64)
            starts = np.cumsum([0, *(len(bags[i]) for i in some[:-1])])
            cost = 0.5 / share[y[some].astype(int)] / len(some)
            grads = model.gradients(model.forward(x, starts), starts, y[some], cost)
            step += 1
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            for k in Model.NAMES:
                g = grads[k] + 1e-4 * getattr(model, k)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(model, k, getattr(model, k) - rate * move)
    return model


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_documents: int, max_passages: int):
    """Features and labels of at most ``max_documents`` labelled ids, the first by their hash; of several rows with one id the
    one whose features sort first stands for all, chosen before anything is collected."""
    marked = labels.where(F.col(f"`{label_col}`").isin(0, 1)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y"))
    chosen = marked.where("id is not null").groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_documents)
    texts = only(docs, id=id_col, text=text_col)
    rows = texts.join(F.broadcast(chosen), "id")  # max_documents rows at most

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column(1):
                x = features(text.as_py())
                take = np.linspace(0, len(x) - 1, min(len(x), max_passages)).astype(int)
                made.append(x[take].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), batch.column(2)], ["id", "x", "y"])

    found = rows.select("id", "text", F.col("y").cast("int")).mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, x binary, y int")
    one = found.groupBy("id").agg(F.min("x").alias("x"), F.max("y").alias("y"))
    got = sorted((r.id, bytes(r.x), r.y) for r in one.collect())
    return [np.frombuffer(x, dtype=np.float32).reshape(-1, FEATURES) for _, x, _ in got], np.array([y for *_, y in got], dtype=np.float64)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    *,
    max_documents: int = 3000,
    max_passages: int = 16,
) -> Model:
    """Fit a model to labelled texts. ``labels`` holds (id, label) rows; labels other than 0 and 1, null ids and ids
    without a text are left out, and of several labels of an id the largest counts. Without labels every score is 0.5."""
    return fit(*training_sample(docs, labels, id_col, text_col, label_col, max_documents, max_passages))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for every row: the model's probability of label 1 for the whole text. Repeated rows and null ids each
    come out; a null text scores as an empty one. An empty table gives no rows. Other columns are not read."""
    source = only(docs, id=id_col, text=text_col)
    schema = f"id {source.schema['id'].dataType.simpleString()}, score double"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, bags, size = [], [], 0

            def flush() -> None:
                if bags:
                    starts = np.cumsum([0, *(len(b) for b in bags[:-1])])
                    scores.append(model.scores(np.concatenate(bags), starts))
                bags.clear()

            for text in batch.column(1):
                bags.append(features(text.as_py()))
                size += len(bags[-1])
                if size > 4096:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["id", "score"])

    return source.mapInArrow(run, schema)


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows whose text scores ``threshold`` or more, with all their columns; handled as in ``score``, but nothing is joined."""

    @tidy
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in texts:
            scores, bags = [], []
            for i, text in enumerate(some):
                bags.append(features(text.as_py()))
                if sum(map(len, bags[-64:])) > 4096 or len(bags) == 512 or i == len(some) - 1:
                    scores.append(model.scores(np.concatenate(bags), np.cumsum([0, *(len(b) for b in bags[:-1])])))
                    bags = []
            yield pa.array(np.concatenate(scores) if scores else [], pa.float64())

    scored = F.arrow_udf(run, "double")
    return docs.where(scored(F.col(f"`{text_col}`")) >= threshold)


def held_out(id_col: str) -> F.Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 1 on division by 3. False for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))
