"""Toxicity by a classifier chain of linear models.

Categories are predicted in a fixed order; the model of each category sees the text's
features and the probabilities of all earlier categories.  For training, those
probabilities are out-of-fold predictions, so a later model learns from values as
uncertain as it will meet; for prediction they come from the models fitted on all folds.

Features are present or absent: whole words, word beginnings and word endings.  Spark
counts them over the labelled sample; the most telling ones (chi-square) make the model.
"""
from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, dealt

#: Labelled rows that the chain is fitted on, about (all, if there are fewer).
SAMPLE_ROWS = 20_000
#: Features of the models; the fewest sample texts that must have one, and the least
#: chi-square (over five standard deviations, as a hundred thousand features are tested).
FEATURES = 2000
MIN_TEXTS = 4
MIN_CHI = 30.0
FOLDS = 5
#: Probability from which a text is put into a category.
THRESHOLD = 0.5
_WORD = re.compile(r"[^\W_]+")
_REMEMBERED = 500_000


def word_features(word: str) -> list[str]:
    """``=word``, its beginnings of 3 to 6 and endings of 3 to 5 characters."""
    n = len(word)
    return ["=" + word, *("^" + word[:k] for k in range(3, 7) if n >= k), *("$" + word[-k:] for k in range(3, 6) if n >= k)]


def text_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def text_features(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs: feature names, and per pair the text and the feature."""
    numbers: dict[str, int] = {}
    of_word: dict[str, list[int]] = {}
    pairs = [np.zeros(0, np.int64)]
    for i, text in enumerate(texts):
        own: list[int] = []
        for w in text_words(text):
            got = of_word.get(w)
            if got is None:
                got = of_word[w] = [numbers.setdefault(f, len(numbers)) for f in word_features(w)]
            own += got
        pairs.append(np.unique(np.array(own, np.int64)) + (i << 32))
    both = np.concatenate(pairs)
    return list(numbers), both >> 32, both & 0xFFFFFFFF


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, categories, rows: int) -> DataFrame:
    """Labelled texts: about ``rows`` label rows (all, if there are fewer), dealt by id hash, joined to
    their texts and stored.  Labels without a text are not in it."""
    total = labels.count()
    share = min(1.0, rows / max(1, total))
    part = cut(labels.where(dealt(share, id_col, F.lit("sample"))).select(id_col, F.array(*[F.col(c).cast("int") for c in categories]).alias("_y")))
    if total and part.isEmpty():
        raise RuntimeError(f"no row of {total} labels was drawn: ids do not tell them apart")
    return cut(docs.select(id_col, F.col(text_col).alias("_text")).join(F.broadcast(part), id_col).select(id_col, "_text", "_y"))


def _count_features(k: int):
    def run(batches):
        for batch in batches:
            texts, labels = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            names, text, feature = text_features(texts)
            counts = [np.bincount(feature, minlength=len(names))]
            for c in range(k):
                flagged = np.array([bool(y[c]) for y in labels], bool)
                counts.append(np.bincount(feature[flagged[text]], minlength=len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array(c, pa.int64()) for c in counts]],
                                             ["f", "n", *[f"p{c}" for c in range(k)]])
    return run


@dataclass
class Chain:
    """Weights per category over ``features`` plus one per earlier category, and a bias."""
    categories: list[str]
    features: list[str]
    weights: list[np.ndarray]

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities ``[row, category]`` of texts given as arrays of feature numbers."""
        out = np.zeros((len(rows), len(self.categories)))
        x = Sparse.of(rows)
        for c, w in enumerate(self.weights):
            out[:, c] = _probability(x, out[:, :c], w, len(self.features))
        return out


@dataclass
class Sparse:
    """Rows of present features: the feature of each entry, entries per row, and rows ``n``."""
    index: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, rows):
        return cls(np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32), np.array([len(r) for r in rows], np.int64))

    def only(self, keep: np.ndarray) -> Sparse:
        return Sparse(self.index[np.repeat(keep, self.size)], self.size[keep])

    def times(self, w: np.ndarray) -> np.ndarray:
        """Sum of the weights of each row's features."""
        return _sums(w[self.index], self.size)

    @cached_property
    def by_feature(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.index, kind="stable")
        return np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)[order], self.index

    def against(self, e: np.ndarray, k: int) -> np.ndarray:
        """Sum of ``e`` over the rows that have each of the ``k`` features."""
        rows, index = self.by_feature
        return _sums(e[rows], np.bincount(index, minlength=k))


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``, empty ones too."""
    out = np.zeros(len(size))
    some = size > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(size) - size)[some])
    return out


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _probability(x: Sparse, earlier: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    z = x.times(w[:k]) + _logit(earlier) @ w[k:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(x: Sparse, earlier: np.ndarray, y: np.ndarray, k: int, rounds: int = 60, l2: float = 0.1) -> np.ndarray:
    """Logistic regression by limited-memory quasi-Newton steps; one class alone gives its
    share as a constant."""
    w = np.zeros(k + earlier.shape[1] + 1)
    share = y.mean() if len(y) else 0.0
    w[-1] = _logit(share)
    if share in (0.0, 1.0):
        return w
    z, penalty = _logit(earlier), np.append(np.full(len(w) - 1, l2), 0.0)

    def loss(w):
        p = np.clip(_probability(x, earlier, w, k), 1e-12, 1 - 1e-12)
        e = p - y
        grad = np.concatenate([x.against(e, k), e @ z, [e.sum()]]) + penalty * w
        return -np.log(np.where(y > 0, p, 1 - p)).sum() + 0.5 * (penalty * w * w).sum(), grad

    value, grad = loss(w)
    enough = 1e-4 * np.abs(grad).max()
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        # direction: the inverse curvature that the last steps have shown, applied to the gradient
        d, pulls = -grad, []
        for s, g in reversed(past):
            pulls.append(s @ d / (s @ g))
            d = d - pulls[-1] * g
        d = d * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / np.abs(grad).sum())
        for (s, g), pull in zip(past, reversed(pulls), strict=True):
            d = d + s * (pull - g @ d / (s @ g))
        step, slope = 1.0, grad @ d
        while True:
            new = w + step * d
            new_value, new_grad = loss(new)
            if new_value <= value + 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        if (new - w) @ (new_grad - grad) > 1e-10:
            past = [*past[-9:], (new - w, new_grad - grad)]
        w, value, grad = new, new_value, new_grad
        if np.abs(grad).max() <= enough:
            break
    return w


def fit_part(x: Sparse, y: np.ndarray, folds: np.ndarray, parts: list[dict[int, np.ndarray]], held: int, k: int) -> np.ndarray:
    """Weights of the model that follows those of ``parts``, fitted on the labelled rows outside fold ``held``
    (-1: on all); ``parts`` has per earlier category the weights fitted without each fold."""
    earlier = np.zeros((len(folds), 0))
    for of_fold in parts:
        out = np.zeros(len(folds))
        for f, w in of_fold.items():
            at = folds == f
            out[at] = _probability(x.only(at), earlier[at], w, k)
        earlier = np.column_stack([earlier, out])
    label = y[:, len(parts)]
    keep = ~np.isnan(label) & (folds != held)
    return fit_linear(x.only(keep), earlier[keep], label[keep], k)


def _chain(categories, features, fit) -> Chain:
    """The models in order; ``fit(parts, folds held out)`` gives the weights of the next category's."""
    weights, parts = [], []
    for c in range(len(categories)):
        # no later model asks for the predictions of the last
        got = fit(parts, [-1, *range(FOLDS)] if c < len(categories) - 1 else [-1])
        weights.append(got.pop(-1))
        parts.append(got)
    return Chain(list(categories), list(features), weights)


def fit_chain(categories, features, rows, y: np.ndarray, folds: np.ndarray) -> Chain:
    """Fit the models in order; ``y`` is ``[row, category]`` with NaN for no label."""
    x = Sparse.of(rows)
    return _chain(categories, features, lambda parts, held: {h: fit_part(x, y, folds, parts, h, len(features)) for h in held})


def _fit_spread(sample: DataFrame, k: int, categories: int):
    """``fit`` of ``_chain`` with a task for each model; ``sample`` (``fold``, ``x``, ``y``), a bounded number
    of rows, goes to each task, only weights come to the driver."""

    def fit(parts, held):
        def run(batches):
            of_part: dict[int, list] = {}
            for b in batches:
                for part, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    of_part.setdefault(part, []).append(row)
            for part, got in of_part.items():
                got.sort(key=lambda r: (r[0], r[1], repr(r[2])))     # the order of rows must not matter
                y = np.array([[np.nan if v is None else float(v > 0) for v in r[2]] for r in got])
                w = fit_part(Sparse.of([np.frombuffer(r[1], np.int32) for r in got]), y, np.array([r[0] for r in got], np.int64), parts, held[part], k)
                yield pa.RecordBatch.from_arrays([pa.array([held[part]], pa.int32()), pa.array([w.tobytes()], pa.binary())], ["held", "w"])
        dealt = sample.select(F.explode(F.array(*map(F.lit, range(len(held))))).alias("part"), "fold", "x", "y").repartitionById(len(held), "part")
        found = {r.held: np.frombuffer(r.w) for r in dealt.mapInArrow(run, "held int, w binary").collect()}
        none = Sparse.of([])                     # a sample without rows has no task that answers
        return {h: found[h] if found else fit_part(none, np.zeros((0, categories)), np.zeros(0, np.int64), parts, h, k) for h in held}
    return fit


class Lookup:
    """Feature numbers of a text's words; remembers a bounded number of words."""

    def __init__(self, features):
        self.number = {f: i for i, f in enumerate(features)}
        self.telling: dict[str, list[int]] = {}
        self.plain: set[str] = set()

    def __call__(self, text: str | None) -> np.ndarray:
        found: set[int] = set()
        for w in text_words(text) - self.plain:
            got = self.telling.get(w)
            if got is None:
                got = [self.number[f] for f in word_features(w) if f in self.number]
                if not got:
                    self.plain.add(w)
                    continue
                self.telling[w] = got
            found.update(got)
        if len(self.plain) + len(self.telling) > _REMEMBERED:
            self.plain, self.telling = set(), {}
        return np.array(sorted(found), np.int32)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], *, id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> Chain:
    """Fit a chain on about ``sample_rows`` rows of ``labels`` (0/1 columns ``categories``).

    Null labels are left out of their category's model; labels without a text are not
    used; a category with one class alone predicts that class's share (none: 0)."""
    bound_batches(docs.sparkSession)
    k = len(categories)
    sample = _sample(docs, labels, id_col, text_col, categories, sample_rows)
    pos = [f"p{c} long" for c in range(k)]
    counted = cut(sample.mapInArrow(_count_features(k), ", ".join(["f string", "n long", *pos]))
                  .groupBy("f").agg(F.sum("n").alias("n"), *[F.sum(f"p{c}").alias(f"p{c}") for c in range(k)])
                  .where(F.col("n") >= MIN_TEXTS))
    total = sample.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.col("_y")[c]), F.lit(0)) for c in range(k)]).first()
    n, pos = total[0], total[1:]

    def chi(c):
        # of the 2 x 2 table of feature and label, with half a text added to each cell
        a, m, p = F.col(f"p{c}") + 0.5, F.col("n") + 1.0, float(pos[c]) + 1.0
        t = float(n) + 2.0
        d = a * (t - m - p + a) - (m - a) * (p - a)
        return t * d * d / (m * (t - m) * p * (t - p))

    if n:
        per = features // k
        names = sorted({r.f for c in range(k) for r in counted.where(chi(c) >= MIN_CHI).orderBy(F.desc(chi(c)), "f").limit(per).select("f").collect()})
    else:
        names = []

    def encode(batches):
        look = Lookup(names)
        for batch in batches:
            rows = [look(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], [id_col, "x", "y"])

    fold = F.pmod(F.xxhash64(id_col, F.lit("fold")), F.lit(FOLDS))
    encoded = cut(sample.select(id_col, "_text", "_y").mapInArrow(encode, T.StructType([
        sample.schema[id_col], T.StructField("x", T.BinaryType()), T.StructField("y", T.ArrayType(T.IntegerType()))]))
        .select(fold.alias("fold"), "x", "y"))
    return _chain(categories, names, _fit_spread(encoded, len(names), k))


def score(docs: DataFrame, chain: Chain, *, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``p_<category>`` of every category; the text goes unless ``keep_text``.

    Whole texts are scored, row by row; null and empty texts have no features and get the
    models' biases.  Columns named like a result column are replaced."""
    bound_batches(docs.sparkSession)
    names = [f"p_{c}" for c in chain.categories]
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        chain = shared.value
        look = Lookup(chain.features)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            got = chain.scores([look(t) for t in batch.column(at).to_pylist()])
            cols = {n: batch.column(k) for k, n in enumerate(batch.schema.names) if keep_text or k != at}
            yield pa.RecordBatch.from_pydict(cols | {n: pa.array(got[:, c]) for c, n in enumerate(names)})

    schema = T.StructType([f for f in docs.schema.fields if keep_text or f.name != text_col]
                          + [T.StructField(n, T.DoubleType()) for n in names])
    return docs.mapInArrow(run, schema)


def corpus_chain(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain of the tables at hand: low quality first, then toxic."""
    flagged = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return train(docs, flagged, ["low_quality", "toxic"])
