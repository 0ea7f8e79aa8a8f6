"""Text quality by positive-unlabelled learning.

A linear model over binned surface features minimises the non-negative unbiased risk
``prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))`` on trusted positives and unlabelled texts. The class prior is estimated from the
same positives and all unlabelled texts: no set can hold a larger share of positives than ``prior`` allows, so the least ratio of the unlabelled to the
positive share over the upper sets of a first classifier bounds it. Labelled rows then set the scale of the score (Platt).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import logistic

KINDS = ["upper", "lower", "digit", "blank", "newline", "stop", "comma", "bang", "bar", "mark", "bracket", "quote", "other", "high"]
_OF = np.full(256, KINDS.index("other"), dtype=np.uint8)
for _kind, _chars in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("blank", b" \t\r\x0b\x0c"), ("newline", b"\n"), ("stop", b"."), ("comma", b",;:"), ("bang", b"!?"), ("bar", b"|"), ("mark", b"#$%&*@~^+=_"), ("bracket", b"()[]{}<>/\\"), ("quote", b"\"'`-"), ("high", range(128, 256))):
    _OF[list(_chars)] = KINDS.index(_kind)


def features(text: str | None) -> np.ndarray:
    """Surface features of a whole text; an empty one has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, nw = len(raw), len(words)
    if not nw:
        return np.zeros(len(KINDS) + 9)
    share = np.bincount(_OF[np.frombuffer(raw, np.uint8)], minlength=len(KINDS)) / n
    lines = [x for x in raw.split(b"\n") if x]
    most = Counter(words).most_common(1)[0][1]
    lengths = np.fromiter(map(len, words), np.int64, nw)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return np.concatenate((share, [np.log1p(nw), lengths.mean(), lengths.std(), len(set(words)) / nw, most / nw, again / nw, len(set(lines)) / len(lines), np.log1p(nw / len(lines)), (lengths <= 3).mean()]))


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One-hot bins of every feature, behind a column of ones."""
    k = edges.shape[1] + 1
    at = np.stack([np.searchsorted(edges[j], x[:, j], side="right") + j * k for j in range(x.shape[1])], axis=1)
    out = np.zeros((len(x), x.shape[1] * k + 1))
    out[:, 0] = 1
    out[np.arange(len(x))[:, None], at + 1] = 1
    return out


def prior_cuts(gp: np.ndarray, least: float = 0.05) -> np.ndarray:
    """Scores of the positives that bound the upper sets, the last of which holds ``least`` of them."""
    return np.quantile(gp, np.linspace(0, 1 - least, 50))


def class_prior(gp: np.ndarray, cuts: np.ndarray, above: np.ndarray, n: int, least: float = 0.05) -> float:
    """The least ratio of the unlabelled to the positive share over the upper sets; ``above`` of the ``n`` unlabelled lie in each."""
    ratios = [(u / n + 0.5 / np.sqrt(n)) / max((gp >= c).mean(), least) for c, u in zip(cuts, above, strict=True)]
    return float(np.clip(min(ratios), 0.02, 0.98))


def nn_pu(xp: np.ndarray, xu: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, ridge: float = 2.0) -> np.ndarray:
    """With ``ridge`` over the number of positives as penalty, so that few rows give cautious weights: Adam on the non-negative risk with logistic loss; where the negative part falls below zero, its gradient turns round."""
    beta = np.zeros(xp.shape[1])
    m, v = np.zeros_like(beta), np.zeros_like(beta)
    for t in range(1, rounds + 1):
        fp, fu = np.clip(xp @ beta, -30, 30), np.clip(xu @ beta, -30, 30)
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        g_plus = prior * xp.T @ (sp - 1) / len(xp)
        g_minus = xu.T @ su / len(xu) - prior * xp.T @ sp / len(xp)
        minus = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g = (g_plus + g_minus if minus >= 0 else -g_minus) + ridge / len(xp) * beta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        beta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return beta


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 20_000, bins: int = 12) -> dict:
    """The model from ``docs`` and ``labels`` (doc_id, label), both of the rows to learn from.

    The risk is minimised over at most ``max_docs`` labelled and as many unlabelled ids, those of smallest id hash, a row of each; the class
    prior is estimated over all rows of ``docs``. Null labels and ids are left out. Without trusted positives every score is the prior of 0.5.
    """
    known = labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    free = docs.select(F.col(id_col).alias("doc_id")).filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(max_docs)
    # Both lists have max_docs ids at most, so they may be sent to every task.
    picked = known.withColumn("u", F.lit(0)).unionByName(free.withColumns({"label": F.lit(None).cast("int"), "u": F.lit(1)}).select("doc_id", "label", "u"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "text", F.when(F.col("u") == 1, -1).otherwise(F.col("label").cast("int")).alias("kind"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.append(features(t), k) for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "kind", "x"])

    measured = rows.mapInArrow(measure, "doc_id long, kind int, x array<double>").groupBy("doc_id", "kind").agg(F.min("x").alias("x"))
    x = np.array([r.x for r in measured.select("x").collect()])  # 2 * max_docs rows at most
    if not len(x) or not (x[:, -1] >= 1).any() or not (x[:, -1] == -1).any():
        return {"edges": None, "beta": None, "scale": (0.0, 0.0), "prior": 0.5}
    x, kind = x[:, :-1], x[:, -1]
    edges = np.stack([np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]) for j in range(x.shape[1])])
    z = binned(x, edges)
    xp, xu = z[kind >= 1], z[kind == -1]
    first = logistic(np.vstack((xp, xu)), np.concatenate((np.ones(len(xp)), np.zeros(len(xu)))), ridge=1.0)
    gp = xp @ first
    cuts = prior_cuts(gp)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above, n = np.zeros(len(cuts), np.int64), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024).column(0).to_pylist()
                g = binned(np.stack([features(t) for t in part]), edges) @ first
                above += (g[:, None] >= cuts).sum(axis=0)
                n += len(part)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([above.tolist()], pa.list_(pa.int64()))], names=["n", "above"])

    shares = docs.select(text_col).mapInArrow(share, "n long, above array<long>").select("n", F.posexplode("above").alias("cut", "a")).groupBy("cut").agg(F.sum("n").alias("n"), F.sum("a").alias("a")).orderBy("cut").collect()
    prior = class_prior(gp, cuts, np.array([r.a for r in shares]), shares[0].n)
    beta = nn_pu(xp, xu, prior)
    both = kind >= 0
    scale = (0.0, 1.0)
    if len({*kind[both].tolist()}) > 1:
        f = z[both] @ beta
        scale = tuple(logistic(np.stack((np.ones_like(f), f), axis=1), (kind[both] >= 1).astype(float)).tolist())
    return {"edges": edges, "beta": beta, "scale": scale, "prior": prior}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every whole text; null counts as empty. Repeated rows each give a row; an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = model["scale"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                if model["beta"] is None:
                    f = np.zeros(part.num_rows)
                else:
                    f = binned(np.stack([features(t) for t in part.column(1).to_pylist()]), model["edges"]) @ model["beta"]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(a + b * f, -30, 30))))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, score double")
