"""Counterfactual-regularised toxicity classifier."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, fresh, materialize, text_or_empty
from .textvec import LOWER_ALNUM, U64, groups_of, hash_spans, words

# Identity terms that are swapped for each other in counterfactual sentences.
IDENTITY = (
    ("woman", "man"), ("women", "men"), ("female", "male"), ("girl", "boy"), ("girls", "boys"), ("mother", "father"),
    ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"), ("black", "white"), ("asian", "european"),
    ("african", "american"), ("muslim", "christian"), ("muslims", "christians"), ("jewish", "catholic"), ("jews", "protestants"),
    ("buddhist", "atheist"), ("immigrant", "citizen"), ("immigrants", "citizens"), ("refugee", "resident"), ("disabled", "healthy"),
    ("old", "young"), ("mexican", "canadian"), ("arab", "greek"), ("femme", "homme"), ("femmes", "hommes"), ("musulman", "chrétien"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("musulmán", "cristiano"), ("frau", "mann"), ("frauen", "männer"), ("muslime", "christen"),
)
#: At most so many labelled rows (in expectation) are learned from, and so many features are used.
SAMPLE, FEATURES = 24_000, 768
#: A feature needs this many toxic documents.
LEAST = 4
#: Lengths in bytes of the beginnings of words that are features besides the whole words.
STEMS = (4, 5, 6)
#: Weights of the counterfactual penalty and of the ridge penalty.
COUNTERFACTUAL, RIDGE = 20.0, 2e-4
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, feature hashes of words and their beginnings as columns, number of words of each text)."""
    buf, starts, lens, counts = words(texts, LOWER_ALNUM)
    full = hash_spans(buf, starts, lens)
    columns = [full]
    for k in STEMS:
        stem = hash_spans(buf, starts, np.minimum(lens, k)) ^ U64(0x5851F42D4C957F2D * k & 0xFFFFFFFFFFFFFFFF)
        columns.append(np.where(lens >= k, stem, full))
    return full, np.stack(columns, axis=1) if len(full) else np.zeros((0, 1 + len(STEMS)), dtype=U64), counts


def feature_sets(texts: list[str]) -> list[np.ndarray]:
    """The distinct features of each text."""
    out = []
    for a, b in groups_of(texts, 1 << 19):
        _, feats, counts = _word_hashes(texts[a:b])
        at = 0
        for n in counts:
            out.append(np.unique(feats[at : at + n]))
            at += n
    return out


@lru_cache(maxsize=1)
def _swaps() -> dict[bytes, bytes]:
    pairs = [(a.encode(), b.encode()) for a, b in IDENTITY]
    return dict(pairs) | {b: a for a, b in pairs}


def swap_identities(text: str) -> str:
    """A text with each identity term replaced by its partner. Words lose case and punctuation."""
    swaps = _swaps()
    return _joined(swaps.get(w, w) for w in _plain_words(text))


def _plain_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(LOWER_ALNUM).split()


def counterfactual(text: str) -> tuple[str, str, str, str]:
    """(the sentence that is learned from, and three forms whose scores should agree: one that names a group, the same
    with the term's partner, and one that names none). A text that has identity terms is learned from as it is; its
    other forms have the terms swapped, and left out. Other texts get a term: a pair is picked by a hash of the text,
    and put in at a place that the hash picks. A mention alters no label, so every other of these is learned from with
    the term in it."""
    have, swaps = _plain_words(text), _swaps()
    if any(w in swaps for w in have):
        return text, text, swap_identities(text), _joined(w for w in have if w not in swaps)
    seed = xxhash.xxh64_intdigest(b" ".join(have), 7)
    pair = IDENTITY[seed % len(IDENTITY)]
    place = (seed >> 20) % (len(have) + 1)
    one, other = (_joined([*have[:place], pair[k].encode(), *have[place:]]) for k in ((0, 1) if seed >> 40 & 1 else (1, 0)))
    return one if seed >> 41 & 1 else text, one, other, text


def _joined(found) -> str:
    return b" ".join(found).decode("utf-8", "replace")


def identity_features() -> np.ndarray:
    """The features of the terms themselves, which a model always has."""
    buf, starts, lens, _ = words([w for pair in IDENTITY for w in pair], LOWER_ALNUM)
    return hash_spans(buf, starts, lens)


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes, their weights and the bias. A document scores by the features that it has."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def hits(self, texts: list[str]) -> list[np.ndarray]:
        """Indices of the features that each text has."""
        out = []
        for a, b in groups_of(texts, 1 << 19):
            _, feats, counts = _word_hashes(texts[a:b])
            flat = feats.reshape(-1)
            width = feats.shape[1]
            place = np.searchsorted(self.features, flat)
            place = np.minimum(place, max(0, len(self.features) - 1))
            there = self.features[place] == flat if len(self.features) else np.zeros(len(flat), dtype=bool)
            owner = np.repeat(np.arange(b - a), counts * width)[there]
            found = np.unique(owner.astype(np.int64) << 32 | place[there])
            cuts = np.searchsorted(found >> 32, np.arange(b - a + 1))
            out += [(found[x:y] & 0xFFFFFFFF).astype(np.int64) for x, y in zip(cuts, cuts[1:], strict=False)]
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.array([self.weights[h].sum() for h in self.hits(texts)]) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_weights(x: np.ndarray, y: np.ndarray, d: np.ndarray, times: np.ndarray | None = None, *, penalty: float = COUNTERFACTUAL, ridge: float = RIDGE, steps: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method on rows x and labels y, with penalty * mean((d @ w) ** 2) added: d has,
    for each counterfactual, the features it gains less those it loses, so d @ w is the change of its score; times says
    how often each row of d counts."""
    n, k = x.shape
    w = np.zeros(k + 1)
    w[k] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    curve = np.diag(np.append(np.full(k, 2 * ridge), 1e-9))
    times = np.ones(len(d)) if times is None else times
    for at in range(0, len(d), 4096):
        part = d[at : at + 4096].astype(np.float64)
        curve[:k, :k] += 2 * penalty * ((part * times[at : at + 4096, None]).T @ part) / times.sum()
    for _ in range(steps):
        gradient, hessian = curve @ w, curve.copy()
        for at in range(0, n, 4096):  # in blocks, so that no second copy of x is held
            xb = np.hstack([x[at : at + 4096].astype(np.float64), np.ones((len(x[at : at + 4096]), 1))])
            p = 1 / (1 + np.exp(-np.clip(xb @ w, -30, 30)))
            gradient += xb.T @ (p - y[at : at + 4096]) / n
            hessian += (xb * (p * (1 - p))[:, None]).T @ xb / n
        step = np.linalg.solve(hessian + 1e-9 * np.eye(k + 1), gradient)
        w -= step * min(1.0, 10 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:k], float(w[k])


def _count_features(batches):
    """Partial counts (feature, toxic documents, other documents) of a task's batches."""
    for pdf in batches:
        sets, toxic = feature_sets(pdf["text"].tolist()), pdf["toxic"].to_numpy()
        if not len(sets):
            continue
        every = np.concatenate(sets)
        ones = np.repeat(toxic == 1, [len(s) for s in sets])
        names, back = np.unique(every, return_inverse=True)
        n1 = np.bincount(back[ones], minlength=len(names))
        n0 = np.bincount(back[~ones], minlength=len(names))
        yield pd.DataFrame({"feature": names.view(np.int64), "n1": n1, "n0": n0})


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, features: int = FEATURES, least: int = LEAST, penalty: float = COUNTERFACTUAL) -> Model:
    """Learn from labelled rows that are not held out.

    Rows are chosen by a hash of their id, at a rate that makes `sample` of them (a documented bound: the driver fits on
    as many rows of feature indices); a row counts as toxic if any of its labels says so, and labels or ids that are
    null are skipped; a null text counts as empty; of repeated documents each row is learned from. Features are words
    and their first 4, 5 and 6 bytes that the log-likelihood ratio ties to toxic documents, counted by Spark, and the
    identity terms; the fit is a ridge logistic regression that pays for each change of score between the
    forms of a sentence (see counterfactual). Without rows of both labels the model has no features."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id")), F.lit(1_000_000))
    known = known.where(draw < int(min(1.0, sample / max(1, n)) * 1_000_000))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    # The rate makes the list about `sample` ids long; it is broadcast for that reason, and joined if chance made it twice that.
    known = F.broadcast(known) if known.limit(2 * sample + 1).count() <= 2 * sample else known
    rows = materialize(rows.join(known, "doc_id").select("text", "toxic"), "labelled")

    counts = rows.mapInPandas(_count_features, "feature long, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    sums = rows.agg(F.count_if(F.col("toxic") == 1), F.count("*")).first()
    toxic, other = sums[0] or 0, (sums[1] or 0) - (sums[0] or 0)
    if not toxic or not other:
        return Model(np.zeros(0, dtype=U64), np.zeros(0), float(np.log((toxic + 0.5) / (other + 0.5))))
    p1, p0 = (F.col("n1") + 0.5) / (toxic + 1.0), (F.col("n0") + 0.5) / (other + 1.0)
    gain = F.col("n1") * F.log(p1 / p0) + (toxic - F.col("n1")) * F.log((1.0 - p1 + 1e-9) / (1.0 - p0 + 1e-9))
    best = counts.where((F.col("n1") >= least) & (p1 > 2 * p0)).withColumn("gain", gain)
    best = best.orderBy(F.desc("gain"), "feature").limit(features).select("feature").toPandas()
    names = np.union1d(best["feature"].to_numpy(dtype=np.int64).view(U64), identity_features())
    model = Model(names, np.zeros(len(names)), 0.0)
    return Model(names, *_fit(rows, model, penalty))


def _fit(rows: DataFrame, empty: Model, penalty: float) -> tuple[np.ndarray, float]:
    def make():
        def work(batch):
            forms = [counterfactual(t) for t in batch.column("text").to_pylist()]
            own, one, other, bare = (empty.hits([f[k] for f in forms]) for k in range(4))
            changes = [(np.setdiff1d(y, x), np.setdiff1d(x, y)) for more in (other, bare) for x, y in zip(one, more, strict=True)]
            texts = ["|".join(",".join(map(str, side)) for side in change) for change in changes]
            return {"own": own, "swap": texts[: len(own)], "drop": texts[len(own) :]}

        return work

    fields = {"own": ("array<long>", lambda: pa.list_(pa.int64())), "swap": ("string", pa.string), "drop": ("string", pa.string)}
    found = add_columns(rows, ["toxic"], make, fields).toPandas()
    changes = Counter(found["swap"]) + Counter(found["drop"])  # few are distinct
    del changes["|"]
    d = np.zeros((len(changes), len(empty.features)), dtype=np.int8)
    times = np.zeros(len(changes))
    for at, change in enumerate(sorted(changes)):
        for side, sign in zip(change.split("|"), (1, -1), strict=True):
            d[at, [int(k) for k in side.split(",") if k]] = sign
        times[at] = changes[change]
    order = sorted(range(len(found)), key=lambda i: (found["toxic"][i], tuple(found["own"][i])))
    x = np.zeros((len(found), len(empty.features)), dtype=np.uint8)
    for at, i in enumerate(order):  # in a fixed order, so that reruns agree
        x[at, found["own"][i]] = 1
    y = (found["toxic"].to_numpy()[order] == 1).astype(np.float64)
    del found
    return fit_weights(x, y, d, times, penalty=penalty)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """Columns `keep` of docs and a double `score`: how likely the whole text is toxic. Null counts as empty, which
    scores the bias; equal texts score alike; an empty table gives an empty result."""

    def make():
        return lambda batch: {"score": model.scores([t or "" for t in batch.column(text_col).to_pylist()])}

    return add_columns(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])]), keep, make, {"score": ("double", pa.float64)})


def reject_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, whole, whose score is under the threshold: null and empty texts stay unless the bias alone is
    over it, repeated rows go or stay together. Columns stay as they are, whatever their names."""
    name = fresh(docs, "_siftframe_score")
    scored = add_columns(docs, docs.columns, lambda: lambda batch: {name: model.scores([t or "" for t in batch.column(text_col).to_pylist()])}, {name: ("double", pa.float64)})
    return scored.where(F.col(name) < threshold).drop(name)
