"""Toxic texts by a subsequence string kernel, Nystroem landmarks and a support vector machine.

Kernel: two words are alike when they share subsequences of four characters that lie within five, a
skipped character costing ``GAP``; word ends count as characters. Words above ``LONGEST`` characters are
taken in overlapping pieces. Marks and digits between letters are gaps at no cost, and so are blanks
between single letters: such a word counts by its letters alone as well. The most telling words are learned
with a character left out, changed or put in, too (``DISGUISED``). The features are hashed to ``DIM`` places and the kernel is
the product of two words' feature vectors, scaled to unit length.

Model: landmark words, the most telling ones of the labelled texts, span the Nystroem map
``K(w, landmarks) K(landmarks, landmarks)^-1/2``. A support vector machine with squared hinge loss is
trained on it, over words that carry their texts' labels. As kernel and map are linear in the
features, the machine folds into one weight per feature: scoring a word is a sum over its features.
A text's score comes from its highest word scores, its highest sentence and the share of telling
words, by a logistic layer fitted on texts that the word machine has not seen; 0.3 is where the
predictions on those are best (F1).

Learning reads at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled texts, picked by a hash of their id, in
one task, and of their distinct words at most ``TRAIN_WORDS``: half the most telling, half drawn from all; scoring reads every text whole, and a score depends on the text alone. NULL and empty
texts have the score of a text without words. Without labels of both kinds every score is 0. Repeated
label rows count once, toxic if any is. Other columns pass through or are ignored.
"""

import pickle
import re
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIM = 1 << 16
GAP = np.float32(0.6)
#: Offsets of the second to fourth character, and the cost.
SHAPES = ((1, 2, 3, np.float32(1)), (1, 2, 4, GAP), (1, 3, 4, GAP), (2, 3, 4, GAP))
LANDMARKS = 320
MAX_TOXIC, MAX_CLEAN = 1500, 2500
TRAIN_WORDS = 50_000
THRESHOLD = 0.3
#: Of the logistic layer, per unit of its weights squared.
RIDGE = 1.0
#: Words whose scores a task remembers.
CACHE = 200_000
#: Characters of a word that are one vector.
LONGEST = 200
#: A mark inside a word ends nothing.
SENTENCE_END = re.compile(r"[.!?]+(?=\s|$)|\n+")
LETTERS = re.compile(r"[^\W\d_]+")
#: Telling words that are also learned with a character left out, changed or put in, and what that weighs.
DISGUISED, DISGUISED_COST = 300, 10.0


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature place, weight and word number of each feature, words in order; unit length by word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    places, weights, owners = [], [], []
    for a, b, c, cost in SHAPES:
        n = len(codes) - c
        if n <= 0:
            continue
        ok = owner[:n] == owner[c:]
        h = codes[:n] * np.uint64(0x9E3779B1) + codes[a : a + n] * np.uint64(0x85EBCA77)
        h += codes[b : b + n] * np.uint64(0xC2B2AE3D27D4EB) + codes[c:] * np.uint64(0x165667B19E3779)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        places.append((h >> np.uint64(48))[ok].astype(np.int64))
        owners.append(owner[:n][ok])
        weights.append(np.full(len(owners[-1]), cost, np.float32))
    if not places:
        empty = np.empty(0, np.int64)
        return empty, np.empty(0, np.float32), empty
    owners, weights = np.concatenate(owners), np.concatenate(weights)
    norm = np.sqrt(np.bincount(owners, weights * weights, len(words))).astype(np.float32)
    return np.concatenate(places), weights / norm[owners], owners


def words_of(text: str) -> list[str]:
    """Lower-case words without the marks around them. A word with marks or digits inside counts by its
    parts and by its letters alone, three or more single letters in a row also as one word: what stands
    between letters is a gap that costs nothing. Of a word above ``LONGEST`` there are pieces, which overlap
    by what a subsequence spans less one."""
    words, single = [], []
    for raw in text.lower().split():
        if raw.isalpha() and len(raw) > 1:
            words.append(raw)
            if len(single) > 2:
                words.append("".join(single))
            single = []
            continue
        w = raw.strip("#*$%&.,;:!?()[]|\"'")
        if not w:
            continue
        parts = LETTERS.findall(w)
        if len(parts) == 1 and len(parts[0]) == 1:
            single.append(parts[0])
        else:
            if len(single) > 2:
                words.append("".join(single))
            single = []
        if w.isalpha() or not parts:
            words.append(w)
            continue
        if len(parts) > 1:
            words += [x for x in parts if len(x) > 1]
        words.append("".join(parts))
    if len(single) > 2:
        words.append("".join(single))
    if max(map(len, words), default=0) <= LONGEST:
        return words
    step = LONGEST - SHAPES[-1][2]
    return [w[i : i + LONGEST] for w in words for i in range(0, max(1, len(w) - SHAPES[-1][2]), step)]


def disguises(word: str) -> list[str]:
    """The word with each inner character left out, another in its place, or one put in before it."""
    inner = range(1, len(word) - 1)
    return [v for i in inner for v in (word[:i] + word[i + 1 :], word[:i] + "*" + word[i + 1 :], word[:i] + "*" + word[i:])]


class WordScorer:
    """Scores of words by folded feature weights; remembers a bounded number of words."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = list(words)
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            places, weights, owners = word_features(part)
            scores = np.bincount(owners, self.weights[places] * weights, len(part)) + self.bias
            self.known.update(zip(part, scores.tolist()))

    def text_features(self, texts: list[str]) -> np.ndarray:
        split = [[words_of(s) for s in SENTENCE_END.split(t)] for t in texts]
        self.learn({w for t in split for s in t for w in s})
        out, known = np.zeros((len(texts), 8)), self.known
        for row, sentences in zip(out, split):
            scored = [[known[w] for w in s] for s in sentences if s]
            if not scored:
                row[:] = (-0.5, -0.5, -0.5, -0.5, 0, 0, 0, 0)
                continue
            every = np.array([x for s in scored for x in s])
            top = np.sort(every)[-8:][::-1]
            n = len(every)
            best = max(sum(sorted(s)[-2:]) / 2 if len(s) > 1 else s[0] / 2 for s in scored)
            row[:] = (
                top[0], top[min(1, len(top) - 1)], top[min(3, len(top) - 1)], best,
                np.maximum(every, 0).sum() / np.sqrt(n), (every > 0).sum() / np.sqrt(n), np.maximum(every + 0.5, 0).mean(),
                np.log(n),
            )
        return out


def fit_words(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Folded feature weights and bias of the word machine."""
    # Words are counted by hash; only the chosen ones are ever held as text.
    digest = lambda w: xxhash.xxh3_64_intdigest(w)
    hashed = [np.fromiter({digest(w) for w in words_of(t)}, np.uint64) for t in texts]
    words = np.unique(np.concatenate([*hashed, np.empty(0, np.uint64)]))
    n = np.zeros((len(words), 2))
    for y in (0, 1):
        found, times = np.unique(np.concatenate([h for h, x in zip(hashed, toxic) if x == y]), return_counts=True)
        n[np.searchsorted(words, found), y] = times
    del hashed
    rate = max(1, toxic.sum()) / max(1, (1 - toxic).sum())
    telling = (n[:, 1] / rate - n[:, 0]) / np.sqrt(n[:, 1] / rate**2 + n[:, 0] + 1)
    order = np.argsort(-telling, kind="stable")
    rng = np.random.default_rng(5)
    rest = order[LANDMARKS * 3 // 4 :]
    marks = np.concatenate([order[: LANDMARKS * 3 // 4], rng.choice(rest, min(len(rest), LANDMARKS // 4), replace=False)])

    # Words of toxic texts come first: they carry what there is to learn.
    chosen = np.concatenate([order[: TRAIN_WORDS // 2], rng.choice(len(words), min(len(words), TRAIN_WORDS // 2), replace=False)])
    chosen = np.unique(chosen)
    wanted = dict.fromkeys(words[np.union1d(np.union1d(marks, chosen), order[:DISGUISED])].tolist())
    for t in texts:
        for w in words_of(t):
            h = digest(w)
            if h in wanted:
                wanted[h] = w
    mark_words = [wanted[h] for h in words[marks].tolist()]
    chosen_words = [wanted[h] for h in words[chosen].tolist()]
    told = [(k, v) for k in order[:DISGUISED].tolist() for v in disguises(wanted[int(words[k])])]
    del wanted

    places, weights, owners = word_features(mark_words)
    basis = np.zeros((DIM, len(marks)), np.float32)
    np.add.at(basis, (places, owners), weights)

    def kernel(some: list[str]) -> np.ndarray:
        out = np.zeros((len(some), len(marks)), np.float32)
        for at in range(0, len(some), 500):
            p, v, o = word_features(some[at : at + 500])
            by = np.argsort(o, kind="stable")
            p, v, o = p[by], v[by], o[by]
            if len(p):
                first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                out[at + o[first]] = np.add.reduceat(basis[p] * v[:, None], first, axis=0)
        return out

    values, vectors = np.linalg.eigh(kernel(mark_words).astype(float))
    held = values > 1e-3
    root = (vectors[:, held] / np.sqrt(values[held])) @ vectors[:, held].T
    # Disguises of a telling word share the cost of one more such word.
    shares = np.bincount([k for k, _ in told], minlength=len(words)) if told else np.ones(len(words))
    chosen_words += [v for _, v in told]
    n = np.r_[n[chosen], [DISGUISED_COST * n[k] / shares[k] for k, _ in told]] if told else n[chosen]
    z = np.ones((len(chosen_words), len(marks) + 1), np.float32)
    for at in range(0, len(z), 5000):
        z[at : at + 5000, :-1] = kernel(chosen_words[at : at + 5000]) @ root.astype(np.float32)
    machine = np.zeros(z.shape[1])
    cost_toxic, cost_clean = n[:, 1] / rate * 0.4, n[:, 0]
    total = (cost_toxic + cost_clean).sum()
    for _ in range(20):  # Newton steps on the squared hinge loss
        f = (z @ machine.astype(np.float32)).astype(float)
        a = np.where(f < 1, cost_toxic, 0) / total
        b = np.where(f > -1, cost_clean, 0) / total
        ridge = 1e-5 * np.r_[np.ones(len(machine) - 1), 0]
        gradient = z.T @ (a * (f - 1) + b * (f + 1)).astype(np.float32) + ridge * machine
        curve = np.diag(ridge + 1e-9)
        for at in range(0, len(z), 5000):
            part = z[at : at + 5000].astype(float)
            curve += (part * (a + b)[at : at + 5000, None]).T @ part
        step = np.linalg.solve(curve, gradient)
        machine -= step
        if np.abs(step).max() < 1e-4:
            break
    return basis @ (root @ machine[:-1]).astype(np.float32), float(machine[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (cost * p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (cost * (p - y)) + RIDGE * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return mean, spread, w


def fit(texts: list[str], toxic: np.ndarray, clean_weight: float = 1.0) -> dict | None:
    """The model as plain arrays; None if one kind of label is missing."""
    if not 0 < toxic.sum() < len(toxic):
        return None
    fold = np.arange(len(texts)) % 2
    features = np.zeros((len(texts), 8))
    for k in (0, 1):
        other, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if not 0 < toxic[other].sum() < len(other):
            other = np.arange(len(texts))
        scorer = WordScorer(*fit_words([texts[i] for i in other], toxic[other]))
        features[own] = scorer.text_features([texts[i] for i in own])
    cost = np.where(toxic == 1, 1.0, clean_weight)
    mean, spread, w = fit_logistic(features, toxic, cost)
    raw = np.c_[(features - mean) / spread, np.ones(len(texts))] @ w
    order = np.argsort(-raw, kind="stable")
    hits, shown = np.cumsum(toxic[order]), np.cumsum(cost[order])
    best = int(np.argmax(2 * hits / (shown + toxic.sum())))
    cut = (raw[order[best]] + raw[order[min(best + 1, len(order) - 1)]]) / 2
    w[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - cut
    weights, bias = fit_words(texts, toxic)
    # Outside what was seen the layer goes no further.
    low, high = features.min(0), features.max(0)
    return {"weights": weights, "bias": bias, "mean": mean, "spread": spread, "layer": w, "low": low, "high": high}


def score_texts(model: dict | None, scorer: WordScorer | None, texts: list[str]) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    x = (np.clip(scorer.text_features(texts), model["low"], model["high"]) - model["mean"]) / model["spread"]
    return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ model["layer"], -30, 30)))


def held_out():
    """Rows that learning never sees."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def train(documents: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> dict | None:
    """Fit on a bounded sample of the labelled texts that are not held out, in one task; the model
    alone, of fixed size, reaches the driver."""
    seen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda y, n: seen.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, max_toxic).union(pick(0, max_clean))
    n_clean = seen.where("toxic = 0").count()

    def fit_sample(batches):
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        rows.sort(key=lambda r: ((r[0] * 2654435761) % (1 << 32), r[0]))
        used = sum(y == 0 for *_, y in rows)
        model = fit([t or "" for _, t, _ in rows], np.array([y for *_, y in rows], int), n_clean / max(1, used))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    found = rows.repartition(1).mapInArrow(fit_sample, "model binary").first()
    return pickle.loads(found["model"]) if found else None


def with_scores(docs: DataFrame, model: dict | None, out: str = "score") -> DataFrame:
    """``docs`` with a score for each text. The model is of fixed size."""
    docs = docs.drop(out)
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        model = held.value
        scorer = WordScorer(model["weights"], model["bias"]) if model else None
        for batch in batches:
            column, scores, part, size = batch.column(place), [], [], 0
            for text in column:
                part.append(text.as_py() or "")
                size += len(part[-1])
                if size > 1 << 20:
                    scores.append(score_texts(model, scorer, part))
                    part, size = [], 0
            scores.append(score_texts(model, scorer, part))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(scores), pa.float64())], names=[*batch.schema.names, out]
            )

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def op10_scores(spark, documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = with_scores(documents.select("doc_id", "text"), train(documents, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
