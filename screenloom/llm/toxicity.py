"""Toxicity by a logistic classifier with a counterfactual penalty.

Features of a text are the words it holds and their beginnings (so inflected forms share a
weight), each once. Sentences of the training texts that hold a term of a swap class are copied with
the term swapped for each other member of its class; the squared change of the score between
such a pair is penalised, so that the term itself carries no weight, whatever the labels of texts that
hold it. Swap classes are a parameter (groups of people, by default) and are also induced from the
training texts: words that are no evidence for either label and fill the same slots, in toxic and in
clean texts alike. All terms of the classes are features, and the model says how many pairs the penalty saw.

The fit is sparse (L1) and runs in one task over a bounded sample (the driver gets the model alone): at most ``sample`` labelled rows, those of
smallest seeded hash, of ``sample_bytes`` in all, and at most ``pairs`` sentence pairs, of smallest hash. Features need
``LEAST_TEXTS`` texts and ``EVIDENCE`` (of a likelihood ratio test) to enter; the strongest ``FEATURES`` do, which at
12,000 texts of the test tables are all. Scoring reads every text whole, in one map.

Defined results. Null text is the empty text and gets the score of no features. Repeated rows give
repeated result rows. Labels of ids that occur in no document are ignored. With no labels, or of
one class only, the score is the share of toxic labels (0 without labels). An empty table gives an
empty result. Extra columns are ignored by ``score_documents`` and kept by ``clean_documents``.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence, Set
from dataclasses import dataclass, field
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenloom.llm.common import map_batches, text_or_empty, written

SAMPLE = 12_000
SAMPLE_BYTES = 256 << 20
FEATURES = 50_000
LEAST_TEXTS = 4
EVIDENCE = 14.0
PAIRS = 20_000
#: Of induced classes: words looked at, the most frequent ones; likeness of their slots; members of a class.
SLOT_WORDS, SLOT_LIKENESS, CLASS_SIZE = 400, 0.9, 6
STEMS = (4, 5, 6)
THRESHOLD = 0.3
WORDS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")

#: Words for groups of people, by kind and language; a swap stays within one line.
IDENTITIES: list[list[str]] = [
    line.split()
    for line in """
    women men girls boys
    woman man girl boy
    muslims christians jews hindus buddhists atheists
    muslim christian jewish hindu buddhist atheist
    black white asian latino arab
    gay lesbian straight bisexual transgender queer
    immigrants refugees foreigners natives
    disabled blind deaf autistic
    old young elderly
    frauen männer mädchen jungen
    muslime christen juden
    schwarze weiße asiaten araber
    schwule lesben
    femmes hommes filles garçons
    musulmans chrétiens juifs
    noirs blancs arabes
    mujeres hombres niñas niños
    musulmanes cristianos judíos
    negros blancos árabes
    """.strip().splitlines()
]


def word_features(word: str) -> tuple[str, ...]:
    """A lower-case word's features: itself, and its first letters followed by a mark."""
    return (word, *(word[:n] + "*" for n in STEMS if len(word) > n))


def features(text: str) -> set[str]:
    return {f for w in set(WORDS.findall(text.lower())) for f in word_features(w)}


Pair = tuple[list[str], list[str]]


def _swaps(sentences: Iterable[str], classes: Sequence[Sequence[str]]) -> Iterator[Pair]:
    of = {term: (c, i) for c, group in enumerate(classes) for i, term in enumerate(group)}
    for sentence in sentences:
        words = WORDS.findall(sentence)
        for c in sorted({of[w][0] for w in words if w in of}):
            group = classes[c]
            for step in range(1, len(group)):
                yield words, [group[(of[w][1] + step) % len(group)] if w in of and of[w][0] == c else w for w in words]


def swapped_pairs(text: str, classes: Sequence[Sequence[str]] = IDENTITIES) -> list[Pair]:
    """Words of each sentence that holds terms of a class, and of its copies: the class's terms moved on by 1, 2, ... members."""
    return list(_swaps(SENTENCE.split(text.lower()), classes))


def held_sentences(texts: Iterable[str], terms: Set[str], most: int) -> list[str]:
    """The ``most`` distinct sentences of smallest hash that hold a term; no more than twice as many are held at once."""
    kept: set[tuple[int, str]] = set()
    top = 1 << 32
    for text in texts:
        for s in SENTENCE.split(text.lower()):
            key = zlib.crc32(s.encode())
            if key <= top and not terms.isdisjoint(WORDS.findall(s)):
                kept.add((key, s))
                if len(kept) > 2 * most:
                    kept = set(sorted(kept)[:most])
                    top = max(kept, default=(-1, ""))[0]
    return [s for _, s in sorted(kept)[:most]]


def induced_classes(texts: Sequence[str], toxic: Sequence[int], words: Sequence[str], taken: Set[str] = frozenset()) -> list[list[str]]:
    """Classes among ``words``: those that stand before and after the same words, in toxic texts and in clean ones."""
    at = {w: i for i, w in enumerate(words)}
    n = len(words)
    slots = np.zeros((2, n, 2 * n + 2))
    for text, label in zip(texts, toxic, strict=True):
        ids = np.array([at.get(w, n) for w in WORDS.findall(text.lower())], dtype=np.int64)
        left, right = ids[:-1], ids[1:]
        known = left < n
        np.add.at(slots[label], (left[known], right[known]), 1)
        known = right < n
        np.add.at(slots[label], (right[known], n + 1 + left[known]), 1)
    shape = np.sqrt(slots)  # the cosine of square roots compares distributions
    size = np.linalg.norm(shape, axis=2, keepdims=True)
    shape /= np.maximum(size, 1e-9)
    like = np.minimum(*(shape[k] @ shape[k].T for k in (0, 1)))
    classes, free = [], [w not in taken for w in words]
    for i in range(n):
        if free[i]:
            near = [j for j in np.argsort(-like[i], kind="stable").tolist() if j != i and free[j] and like[i, j] >= SLOT_LIKENESS]
            if near:
                group = [i, *near[: CLASS_SIZE - 1]]
                classes.append([words[j] for j in group])
                for j in group:
                    free[j] = False
    return classes


@dataclass
class Model:
    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    pairs: int = 0

    def score(self, text: str) -> float:
        hits: set[str] = set()
        for word in set(WORDS.findall(text.lower())) if self.weights else ():
            found = self._known.get(word)
            if found is None:
                if len(self._known) > 1 << 17:
                    self._known.clear()
                found = self._known[word] = tuple(f for f in word_features(word) if f in self.weights)
            hits.update(found)
        z = self.bias + math.fsum(self.weights[f] for f in hits)  # exact, so independent of the order
        return 1 / (1 + math.exp(-min(max(z, -40.0), 40.0)))

    def __post_init__(self) -> None:
        self._known: dict[str, tuple[str, ...]] = {}

    def __getstate__(self) -> tuple:
        return self.bias, self.weights, self.pairs

    def __setstate__(self, state: tuple) -> None:
        self.bias, self.weights, self.pairs = state
        self._known = {}


def _rows(texts: Iterable[Iterable[str]], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The row and column of every feature in ``index`` of texts given as words."""
    known: dict[str, tuple[int, ...]] = {}
    rows, cols = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for r, words in enumerate(texts):
        hits: set[int] = set()
        for w in set(words):
            if w not in known:
                known[w] = tuple(index[f] for f in word_features(w) if f in index)
            hits.update(known[w])
        cols.append(np.array(sorted(hits), dtype=np.int64))
        rows.append(np.full(len(hits), r, dtype=np.int64))
    return np.concatenate(rows), np.concatenate(cols)


def _evidence(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Likelihood ratio statistic that a feature is more frequent in one class; ``counts`` has a row per feature."""
    table = np.stack([counts, totals - counts], axis=1).astype(float)
    expected = table.sum(axis=2, keepdims=True) * totals / totals.sum()
    return 2 * (table * np.log(np.maximum(table, 1e-12) / np.maximum(expected, 1e-12))).sum(axis=(1, 2))


def _changes(pairs: Iterable[Pair], index: dict[str, int]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of pairs, and (pair, feature, +1 or -1) of what each swap takes away and brings; one pair is held at a time."""
    known: dict[str, tuple[int, ...]] = {}

    def columns(words: list[str]) -> set[int]:
        for w in set(words).difference(known):
            known[w] = tuple(index[f] for f in word_features(w) if f in index)
        return {c for w in set(words) for c in known[w]}

    sides: tuple[list[tuple[int, int]], list[tuple[int, int]]] = ([], [])
    n, last, own = 0, None, set()
    for words, other in pairs:
        if words is not last:
            last, own = words, columns(words)
        changed = columns(other)
        sides[0].extend((n, c) for c in sorted(own - changed))
        sides[1].extend((n, c) for c in sorted(changed - own))
        n += 1
    gone, new = (np.array(side, dtype=np.int64).reshape(-1, 2) for side in sides)
    both = np.concatenate([gone, new])
    return n, both[:, 0].copy(), both[:, 1].copy(), np.concatenate([np.ones(len(gone)), -np.ones(len(new))])


def fit(
    texts: Sequence[str],
    toxic: Sequence[int],
    penalty: float = 4.0,
    l1: float = 1e-3,
    steps: int = 400,
    classes: Sequence[Sequence[str]] = IDENTITIES,
    induce: bool = True,
    most_pairs: int = PAIRS,
) -> Model:
    """A sparse classifier on (text, label); ``penalty`` weighs the mean squared change under swaps (0: none)."""
    y = np.array(toxic, dtype=float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(bias=float(np.log(share / (1 - share))) if 0 < share < 1 else (-40.0 if share == 0 else 40.0))
    clean, bad = Counter(), Counter()
    for text, label in zip(texts, toxic, strict=True):
        (bad if label else clean).update(features(text))
    totals = np.array([len(y) - y.sum(), y.sum()])
    names = [f for f in {**clean, **bad} if clean[f] + bad[f] >= LEAST_TEXTS]
    table = np.array([(clean[f], bad[f]) for f in names]).reshape(-1, 2)
    frequency = dict(zip(names, table.sum(axis=1).tolist(), strict=True))
    del clean, bad  # most words stand in few texts
    evidence = dict(zip(names, _evidence(table, totals).tolist(), strict=True))
    strong = sorted((f for f, e in evidence.items() if e >= EVIDENCE), key=lambda f: (-evidence[f], f))[:FEATURES]
    swaps = [list(c) for c in classes]
    if induce:
        given = {w for c in swaps for w in c}
        common = sorted((f for f, e in evidence.items() if e < EVIDENCE and f[-1] != "*"), key=lambda f: (-frequency[f], f))[:SLOT_WORDS]
        swaps += induced_classes(texts, toxic, common, given)
    terms = {f for c in swaps for w in c for f in word_features(w) if f in evidence}
    known = [*strong, *sorted(terms.difference(strong))]
    index = {f: i for i, f in enumerate(known)}
    row, col = _rows((WORDS.findall(t.lower()) for t in texts), index)
    sentences = held_sentences(texts, {w for c in swaps for w in c}, most_pairs)  # each makes a pair at least
    n_pairs, d_row, d_col, sign = _changes(islice(_swaps(sentences, swaps), most_pairs), index)

    # hold out every fifth text for the threshold
    held = np.arange(len(y)) % 5 == 0
    weight = np.where(held, 0.0, np.where(y > 0, 0.5 / max(1, (y * ~held).sum()), 0.5 / max(1, ((1 - y) * ~held).sum())))
    n, k = len(y), len(known)
    strength = penalty / max(1, n_pairs)

    def slope(v: np.ndarray) -> np.ndarray:
        """Gradient at (weights, bias) of the weighted logistic loss and half the counterfactual penalty."""
        z = v[k] + np.bincount(row, weights=v[col], minlength=n)
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        change = np.bincount(d_row, weights=sign * v[d_col], minlength=n_pairs or 1)
        pull = strength * np.bincount(d_col, weights=sign * change[d_row], minlength=k)
        return np.append(np.bincount(col, weights=error[row], minlength=k) + pull, error.sum())

    # accelerated proximal gradient; the step follows from row sums, which bound the largest curvature
    sizes = np.bincount(row, minlength=n) + 1
    curve = 0.25 * np.bincount(col, weights=(weight * sizes)[row], minlength=k).max(initial=0) + 0.25 * float(weight @ sizes)
    if n_pairs:
        changed = np.bincount(d_row, minlength=n_pairs)
        curve += strength * np.bincount(d_col, weights=changed[d_row], minlength=k).max(initial=0)
    v = ahead = np.zeros(k + 1)
    momentum = 1.0
    for _ in range(steps):
        new = ahead - slope(ahead) / max(curve, 1e-9)
        new[:k] = np.sign(new[:k]) * np.maximum(0, np.abs(new[:k]) - l1 / max(curve, 1e-9))
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, v, momentum = new + (momentum - 1) / grown * (new - v), new, grown
    w, b = v[:k], v[k]
    z = b + np.bincount(row, weights=w[col], minlength=len(y))
    b += np.log(THRESHOLD / (1 - THRESHOLD)) - _best_cut(z[held], y[held])
    return Model(float(b), {f: float(x) for f, x in zip(known, w, strict=True) if abs(x) > 1e-6}, n_pairs)


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The logit at which F1 on the held-out texts is best; the middle of the gap around it."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / np.maximum(np.arange(1, len(y) + 1) + y.sum(), 1)
    f1[:-1][z[:-1] == z[1:]] = -1
    best = int(np.argmax(f1))
    return float((z[best] + (z[best + 1] if best + 1 < len(z) else z[best] - 1)) / 2)


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    seed: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_bytes: int = SAMPLE_BYTES,
    **fit_options: Any,
) -> Model:
    """Fit on the ``sample`` labelled rows of smallest seeded hash, in one task; sizes of rows and the model alone reach the driver.

    Rows are taken in that order for as long as ``sample_bytes`` hold them; one that doesn't fit is passed over, not the rows after it.
    """
    order = F.xxhash64("label_id", F.lit(seed)).alias("place")
    chosen = (
        labels.filter("toxic IS NOT NULL")
        .select(F.col(id_col).alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("toxic IN (0, 1)")
        .select("label_id", "toxic", order)
        .orderBy("place", "label_id")
        .limit(sample)
    )
    rows = docs.select(F.col(id_col).alias("label_id"), text_or_empty(text_col).alias("body"))
    found = written(rows.join(F.broadcast(chosen), "label_id").select("label_id", "body", "toxic", "place", F.octet_length("body").cast("long").alias("size")))
    sizes = found.groupBy("place").agg(F.sum("size").alias("size")).toArrow().sort_by("place")  # ``sample`` rows at most
    taken, room = [], sample_bytes
    for place, size in zip(sizes["place"].to_pylist(), sizes["size"].to_pylist(), strict=True):
        if size <= room:
            taken.append(place)
            room -= size
    wanted = np.array(taken, dtype=np.int64)

    def fitted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.filter(pa.array(np.isin(b.column("place").to_numpy(), wanted))).select(["label_id", "body", "toxic"]) for b in it]
        texts, toxic = [], []
        if parts:
            table = pa.Table.from_batches(parts).sort_by([("label_id", "ascending"), ("body", "ascending")])
            texts, toxic = table.column("body").to_pylist(), table.column("toxic").to_pylist()
            del table, parts  # the texts are held once
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, toxic, **fit_options))], type=pa.binary())], names=["model"])

    model = map_batches(found.select("label_id", "body", "toxic", "place").coalesce(1), fitted, "model binary").first()
    return pickle.loads(model["model"])


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels outside the held-out quarter of ids."""
    return labels.filter(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) != 2)


def score_documents(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Per input row: id, held_out, score, predicted, and the number of pairs that the model's penalty saw."""

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            scores = np.array([model.score(t.as_py()) for t in batch.column("body")], dtype=float)
            held = [zlib.crc32(i.encode()) % 4 == 2 if i is not None else False for i in batch.column("key").to_pylist()]
            arrays = [batch.column("id"), pa.array(held, type=pa.bool_()), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(np.full(len(scores), model.pairs))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
            T.StructField("pairs", T.LongType()),
        ]
    )
    key = F.col(id_col).cast("string").alias("key")
    return map_batches(docs.select(F.col(id_col).alias("id"), key, text_or_empty(text_col).alias("body")), score, schema)


def clean_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text scores below ``threshold``; one map, no shuffle."""

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([model.score(t or "") < threshold for t in texts], type=pa.bool_()))

    return map_batches(docs, keep, docs.schema)
