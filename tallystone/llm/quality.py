"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. A line's score comes from features of its characters and words and the
same features of the lines before and after; transition weights join neighbours. The field is fitted by gradient ascent
on the conditional likelihood, where each line of a training text carries its document's label. Forward-backward gives
each line the probability to be good; the mean over lines, weighted by their length, is the document's raw quality, and
a logistic curve fitted on the training texts turns it into a probability.

The training texts are a bounded sample of the labelled rows by a hash of their id: at most MAX_DOCS rows, MAX_LINES lines and
MAX_BYTES of text each; rows and lines are bounded before any of them meet in a task. All else reads every row and the
whole of every text. Only the text counts for a score.

Defined cases: a text that is null, empty or all white space takes the share of good texts in training as its score;
without training rows, or with rows of one label only, every score is that share (0.5 without rows); each repeated row has its own
result; rows with a null id are scored, train nothing and are not held out; labels that contradict each other count as 0; an
empty table gives an empty result; columns that the operator adds replace columns of those names, and their names can be given; very long texts are handled alone, in memory proportional to their length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.llm.arrow_text import _BYTES, _powers, chunks

MAX_DOCS, MAX_LINES, MAX_BYTES, THRESHOLD = 3000, 150_000, 1 << 20, 0.7
EPOCHS, RATE, RIDGE = 120, 0.1, 1e-3

# Kinds of bytes: 0 lower case, 1 upper case, 2 digit, 3 space, 4 . , ; : ' " - ( ), 5 ! ?, 6 |, 7 other ASCII signs, 8 beyond ASCII, 9 control
_KIND = np.full(256, 7, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:], _KIND[:32], _KIND[127] = 0, 1, 2, 8, 9, 9
_KIND[32], _KIND[124] = 3, 6
for _chars, _k in ((b".,;:'\"-()", 4), (b"!?", 5)):
    for _c in _chars:
        _KIND[_c] = _k
KINDS, N_OWN = 10, 17


def lines_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its length in bytes, number of lines of each text)."""
    texts = [t or b"" for t in texts]
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length, n = ends - starts, len(ends)
    line = np.repeat(np.arange(n), length + 1)
    kind = _KIND[data]
    kinds = np.bincount(line * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS).astype(float)
    kinds[:, 9] -= 1  # the line feed itself
    blank = (data == 32) | (data == 9) | (data == 10) | (data == 13)
    gap = np.concatenate([[True], blank[:-1]])
    first, after = np.flatnonzero(~blank & gap), np.flatnonzero(blank & ~gap)
    at, size = line[first], after - first
    words = np.maximum(np.bincount(at, minlength=n), 1)
    up, down = _powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64)])
    code = (sums[after] - sums[first]) * down[first]
    again = np.concatenate([[False], (code[1:] == code[:-1]) & (at[1:] == at[:-1])])
    last = kind[after - 1]
    per_word = lambda x: np.bincount(at, weights=x, minlength=n) / words
    long = np.maximum(length, 1)
    x = np.empty((n, N_OWN))
    x[:, :KINDS] = kinds / long[:, None]
    x[:, 10] = np.log1p(length)
    x[:, 11] = np.log1p(per_word(size))
    x[:, 12] = per_word(again)
    x[:, 13] = per_word((last == 7) | (last == 5) | (last == 6))
    x[:, 14] = kinds[:, 1] / np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    x[:, 15] = per_word(size <= 3)
    x[:, 16] = length == 0
    return x, length, np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A line's features, those of the line before and of the one after, whether these exist, and 1."""
    n, begin = len(own), np.concatenate([[0], np.cumsum(counts)[:-1]])
    has_before, has_after = np.ones(n, bool), np.ones(n, bool)
    has_before[begin[counts > 0]] = False
    has_after[(begin + counts - 1)[counts > 0]] = False
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    return np.concatenate([own, before * has_before[:, None], after * has_after[:, None], has_before[:, None], has_after[:, None], np.ones((n, 1))], axis=1)


def _log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=-1)
    return top + np.log(np.exp(a - top[..., None]).sum(axis=-1))


def forward_backward(scores: np.ndarray, trans: np.ndarray, counts: np.ndarray):
    """(probability of each line to be good, expected transitions, log of the normaliser of each text).

    scores: what each line adds if it is good. Texts are worked on side by side, one line of each a step.
    """
    order = np.argsort(-counts, kind="stable")
    begin, n = (np.cumsum(counts) - counts)[order], counts[order]
    emit = np.stack([np.zeros_like(scores), scores], axis=1)
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    steps = int(n.max(initial=0))
    active = np.searchsorted(-n, -np.arange(steps + 1), side="left")  # texts with more than t lines
    for t in range(steps):
        at = begin[: active[t]] + t
        alpha[at] = emit[at] if t == 0 else emit[at] + _log_sum((alpha[at - 1][:, :, None] + trans).transpose(0, 2, 1))
    for t in range(steps - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        beta[at] = _log_sum(trans + (emit[at + 1] + beta[at + 1])[:, None, :])
    norm = np.zeros(len(counts))
    some = n > 0
    norm[order[some]] = _log_sum(alpha[begin[some] + n[some] - 1])
    per_line = np.repeat(norm, counts)
    good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - per_line, 0))
    inner = np.ones(len(scores), bool)
    inner[begin[some]] = False
    at = np.flatnonzero(inner)
    pairs = np.exp(alpha[at - 1][:, :, None] + trans + (emit[at] + beta[at])[:, None, :] - per_line[at][:, None, None]).sum(axis=0) if len(at) else np.zeros((2, 2))
    return good, pairs, norm


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class QualityModel:
    """A fitted field; without weights it gives every text the share of good ones."""

    prior: float = 0.5
    weights: np.ndarray | None = None
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    curve: tuple[float, float] = (1.0, 0.0)

    def raw(self, own: np.ndarray, length: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The mean probability of good lines by length, as log odds; NaN for texts without any length."""
        x = with_neighbours((own - self.mean) / self.scale, counts)
        good, _, _ = forward_backward(x @ self.weights, self.trans, counts)
        text = np.repeat(np.arange(len(counts)), counts)
        weight = np.bincount(text, weights=length, minlength=len(counts))
        share = np.clip(np.bincount(text, weights=good * length, minlength=len(counts)) / np.where(weight > 0, weight, np.nan), 1e-6, 1 - 1e-6)
        return np.log(share / (1 - share))

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        raw = self.raw(*lines_of(texts))
        odds = _sigmoid(self.curve[0] * raw + self.curve[1])
        bare = np.fromiter((not (t or b"").strip() for t in texts), bool, len(texts))
        return np.where(bare | np.isnan(raw), self.prior, odds)


def fit(own: np.ndarray, length: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> QualityModel:
    """The field and its curve from the lines of labelled texts."""
    prior = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.5
    model = QualityModel(prior)
    if len(set(labels.tolist())) < 2:
        return model
    mean, scale = own.mean(axis=0), own.std(axis=0)
    model.mean, model.scale = mean, np.where(scale > 1e-9, scale, 1)
    x = with_neighbours((own - model.mean) / model.scale, counts)
    gold = np.repeat(labels, counts).astype(float)
    steps = np.maximum(counts - 1, 0)
    told = np.diag([steps[labels == 0].sum(), steps[labels == 1].sum()]).astype(float)
    theta = np.zeros(x.shape[1] + 4)
    m, v, total = np.zeros_like(theta), np.zeros_like(theta), len(labels)
    for k in range(1, EPOCHS + 1):
        good, pairs, _ = forward_backward(x @ theta[:-4], theta[-4:].reshape(2, 2), counts)
        slope = np.concatenate([(gold - good) @ x, (told - pairs).ravel()]) / total - RIDGE * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta += RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model.weights, model.trans = theta[:-4], theta[-4:].reshape(2, 2)
    raw = model.raw(own, length, counts)
    known = ~np.isnan(raw)
    a, b, y, r = 1.0, 0.0, labels[known].astype(float), raw[known]
    for _ in range(50):  # Newton steps for the curve, slightly ridged
        p = _sigmoid(a * r + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((y - p) * r).sum() - 0.1 * (a - 0.5), (y - p).sum() - 0.1 * b])
        h = np.array([[(w * r * r).sum() + 0.1, (w * r).sum()], [(w * r).sum(), w.sum() + 0.1]])
        a, b = np.array([a, b]) + np.linalg.solve(h, g)
    model.curve = (float(a), float(b))
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES) -> QualityModel:
    """Fits on at most max_docs labelled rows (max_lines lines in all, max_bytes a text) with the smallest hashes of their id,
    among the usable ones."""
    some = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    some = (some if usable is None else some.where(usable)).groupBy(id_col).agg(F.min(label_col).alias("_label"))
    some = some.orderBy(F.xxhash64(id_col), id_col).limit(max_docs)  # the bound of what is broadcast
    own = docs.select(F.col(id_col), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull() & (F.octet_length("_text") <= max_bytes))
    texts = own.join(F.broadcast(some), id_col).withColumn("_lines", F.length("_text") - F.length(F.replace("_text", F.lit("\n"))) + 1)
    order = [F.xxhash64(id_col), F.col(id_col), F.col("_lines"), F.xxhash64("_text")]
    texts = texts.orderBy(*order).limit(max_docs)  # ids may repeat; each task keeps max_docs rows
    so_far = F.sum("_lines").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    texts = texts.withColumn("_so_far", so_far).where(F.col("_so_far") <= max_lines).select(id_col, "_text", "_label").repartition(16, id_col)

    def features(batches):
        for batch, own in chunks(batches, 1):
            x, length, counts = lines_of(own)
            at = np.concatenate([[0], np.cumsum(counts)])
            x = x.astype(np.float32)
            cut = [(x[a:b].tobytes(), length[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int64()), pa.array(counts), pa.array([c[0] for c in cut], pa.binary()), pa.array([c[1] for c in cut], pa.binary())], names=["id", "label", "n", "x", "length"])

    rows = texts.mapInArrow(features, T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, k) for c, k in (("label", T.LongType()), ("n", T.LongType()), ("x", T.BinaryType()), ("length", T.BinaryType())))]))
    got = rows.orderBy(F.xxhash64("id"), "id", "n", "x").toArrow()
    counts, y = got["n"].to_numpy(), got["label"].to_numpy()
    own = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, N_OWN).astype(float)
    return fit(own, np.frombuffer(b"".join(got["length"].to_pylist()), np.int64), counts, y)


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """docs with score (probability of good quality) and predicted (1 from the threshold on)."""
    names = [c for c in docs.columns if c not in (score_col, predicted_col)]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(score_col, T.DoubleType()), T.StructField(predicted_col, T.IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    at = names.index(text_col)

    def run(batches):
        for batch, texts in chunks(batches, at):
            found = sent.value.score(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=[*names, score_col, predicted_col])

    return docs.select(*names).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is not to be learnt from; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels, ~held_out(F.col("doc_id")))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
