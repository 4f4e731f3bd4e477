"""Quality score by an additive model with pairwise interactions.

Shallow trees on one feature at a time are boosted in turn, feature after
feature, with a small step; each feature's trees add up to a lookup table over
its bins. Then the feature pairs whose joint bins explain most of what is left
get two-way tables in the same manner. A text's score is the sum of its table
entries, through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorbit.llm.arrow import map_texts
from quorbit.llm.columns import pick
from quorbit.llm.language_id import held_out
from quorbit.session import cut

FEATURES = (
    "log_words", "word_length", "symbols", "bars", "shouts", "upper", "digits", "ends",
    "line_words", "distinct", "repeated_lines", "top_word", "blank_share", "wide_words",
)
#: Labelled rows that are learnt from, at most: those of the least hash.
SAMPLE_ROWS = 20_000
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"


def features(text: str | None) -> tuple[float, ...]:
    """Shares and means over the whole text; zeros for null and for a text without a word."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    size = len(raw)
    chars = sum(map(len, words))
    count = lambda marks: size - len(raw.translate(None, marks))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    return (
        float(np.log1p(n)),
        chars / n,
        count(b"#*$%&<>{}=~^") / chars,
        count(b"|") / n,
        raw.count(b"!!") / n,
        count(_UPPER) / chars,
        count(_DIGITS) / chars,
        count(b".!?") / n,
        n / len(lines),
        len(seen) / n,
        1 - len(set(lines)) / len(lines),
        max(seen.values()) / n,
        (size - chars) / size,
        sum(len(w) > 20 for w in words) / n,
    )


@dataclass
class Gam:
    """Bin edges and tables; scores are vectorised sums of table entries."""

    edges: list[np.ndarray]
    base: float
    single: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    coarse: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def logits(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for j, table in enumerate(self.single):
            out += table[bins[:, j]]
        for (i, j), table in self.pairs.items():
            out += table[self.coarse[i][bins[:, i]], self.coarse[j][bins[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(self.bins(x))))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, penalty: float = 1.0) -> np.ndarray:
    """Leaf values by bin of a best-first tree on an ordered feature, from the bins' gradient and hessian sums."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + penalty)
    cuts = [0, len(grad)]
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = worth(a, m) + worth(m, b) - worth(a, b)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, at = gain[k], int(m[k])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    out = np.zeros(len(grad))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = -(g[b] - g[a]) / (h[b] - h[a] + penalty)
    return out


def _cross(grad: np.ndarray, hess: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """The best one-cut-an-axis tree on a grid of bins: its four leaf values by bin, and its gain."""
    total = lambda a: np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    g, h = total(grad), total(hess)
    corner = lambda a: (a[1:-1, 1:-1], a[1:-1, -1:] - a[1:-1, 1:-1], a[-1:, 1:-1] - a[1:-1, 1:-1], a[-1, -1] - a[1:-1, -1:] - a[-1:, 1:-1] + a[1:-1, 1:-1])
    if min(grad.shape) < 2:
        return np.zeros_like(grad), 0.0
    parts = list(zip(corner(g), corner(h), strict=True))
    gain = sum(a**2 / (b + penalty) for a, b in parts) - g[-1, -1] ** 2 / (h[-1, -1] + penalty)
    r, c = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(grad)
    leaf = [-a[r, c] / (b[r, c] + penalty) for a, b in parts]
    out[: r + 1, : c + 1], out[: r + 1, c + 1 :], out[r + 1 :, : c + 1], out[r + 1 :, c + 1 :] = leaf
    return out, float(gain[r, c])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, bins: int = 64, coarse: int = 8, leaves: int = 3, step: float = 0.1) -> Gam:
    """Cyclic boosting under the logistic loss; without rows every score is a half."""
    if not len(y):
        return Gam([np.empty(0)] * x.shape[1], 0.0, [np.zeros(1)] * x.shape[1])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(x.shape[1])]
    model = Gam(edges, float(np.log(rate / (1 - rate))), [np.zeros(len(e) + 1) for e in edges])
    at = model.bins(x)
    logit = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, table in enumerate(model.single):
            grad, hess = slopes()
            tree = step * _tree(np.bincount(at[:, j], grad, len(table)), np.bincount(at[:, j], hess, len(table)), leaves)
            table += tree
            logit += tree[at[:, j]]
    model.coarse = [np.minimum(np.arange(len(t)) * coarse // max(len(t), 1), coarse - 1) for t in model.single]
    small = np.stack([c[at[:, j]] for j, c in enumerate(model.coarse)], axis=1)
    grid = lambda i, j, v: np.bincount(small[:, i] * coarse + small[:, j], v, coarse * coarse).reshape(coarse, coarse)
    grad, hess = slopes()
    gains = {(i, j): _cross(grid(i, j, grad), grid(i, j, hess))[1] for i, j in combinations(range(x.shape[1]), 2)}
    model.pairs = {p: np.zeros((coarse, coarse)) for p in sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]}
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            grad, hess = slopes()
            tree = step * _cross(grid(i, j, grad), grid(i, j, hess))[0]
            table += tree
            logit += tree[small[:, i], small[:, j]]
    return model


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) with the features of each row's whole text."""
    picked = pick(docs, doc_id=id_col, text=text_col)
    rows = lambda keys, texts: ((k, features(t)) for k, t in zip(keys, texts, strict=True))
    return map_texts(picked, rows, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, x array<double>")


def train(found: DataFrame, labels: DataFrame, most_rows: int = SAMPLE_ROWS) -> Gam:
    """A model of (doc_id, x) rows whose id has a label; rows with a null id or label are left out.

    A document of several labels counts once for each; ``most_rows`` rows of the
    least id hash are learnt from.
    """
    known = found.filter("doc_id is not null").join(labels.filter("quality is not null").withColumnRenamed("doc_id", "labelled"), F.col("doc_id") == F.col("labelled"))
    place = F.xxhash64("doc_id", F.lit("sample"))
    share = most_rows / max(known.count(), 1)
    if share < 1:  # a little more than the bound first, so that few rows reach the driver
        known = known.filter(F.shiftrightunsigned(place, 1) < F.lit(int(min(1.0, 1.1 * share + 1e-9) * (1 << 62)) * 2 - 1))
    rows = known.select("doc_id", "x", "quality").orderBy(F.shiftrightunsigned(place, 1), "doc_id", "quality", "x").limit(most_rows).collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([float(r["quality"]) for r in rows]))


def score(found: DataFrame, model: Gam) -> DataFrame:
    """(doc_id, x) to (doc_id, score); texts without a word have the bins of zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return found.mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, score double")


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = cut(text_features(docs))
    marks = pick(labels, doc_id="doc_id", quality="quality")
    model = train(found.filter(~held_out("doc_id", 0)), marks.filter(~held_out("doc_id", 0)))
    return score(found, model).select(
        "doc_id", held_out("doc_id", 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )
