"""Toxicity: a support vector machine on subsequence string kernels with Nyström landmarks.

The kernel of two strings counts their common subsequences of ORDER characters, each weighted by DECAY to the power of the
lengths that it spans in both, so gaps and inserted characters weaken a match instead of breaking it.
Landmarks are character runs of words, chosen one after the other as those that explain most toxic training documents, the less
explained ones first, at the least cost in clean ones, so every family of insults gets its own. A word's kernel with a landmark, over the landmark's
own (at most 1), says how much of the landmark is in it; a landmark counts as absent from a word that lacks more
than a fifth of its letters or of which less than WEAK is there. A document's kernel row sums over its words and also keeps the
largest; rows are multiplied by the inverse root of the landmarks' kernel matrix (Nyström) and a linear machine with squared hinge loss,
solved by Newton steps, is trained on them; a logistic curve turns margins into scores.

Training takes at most SAMPLE labelled rows of each class, by the hash of their ids, of texts of up to SAMPLE_CHARS: the only bounded sample here. Every document is scored
whole. Workers remember words (emptied beyond CACHE_CHARS and at the end of a task, which changes only time).

Defined cases: null and empty texts score like texts without words; a null doc_id is held in or out as an empty string;
null labels don't train; a repeated label row counts once, toxic if any is; without both classes the score is
the share of toxic labels; repeated rows get equal scores; an empty table gives an empty result; other columns pass through,
but those named like the ones that are added are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.shipping import ship
from tessera.llm.common import tidy

SAMPLE, LANDMARKS, RARE = 2500, 40, 50
#: Longest text that training takes, in characters; with SAMPLE it bounds what the driver gathers.
SAMPLE_CHARS = 50_000
ORDER, DECAY, WEAK, STRONG = 3, 0.6, 0.4, 0.9
#: Lengths of landmarks; words are looked at in windows of so many characters, each overlapping the next by half.
SHORT, LONG, WINDOW = 4, 8, 24
#: Characters of remembered words, OVERHEAD for each word included: some 100 MB.
CACHE_CHARS, OVERHEAD = 24_000_000, 100
#: Stands before every word, so that landmarks can tell a word's head; how many words of a text should have a landmark.
START, LEVELS = "^", (1, 3)
_JUNK = re.compile(r"[\W_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case words; three or more single characters in a row also count as one word."""
    found = (text or "").lower().split()
    single = [i for i, w in enumerate(found) if len(w) == 1 and w.isalnum()]
    lo = 0
    for k in range(1, len(single) + 1):
        if k == len(single) or single[k] != single[k - 1] + 1:
            if k - lo >= 3:
                found.append("".join(found[i] for i in single[lo:k]))
            lo = k
    return found


def _codes(strings: list[str], width: int) -> np.ndarray:
    return np.array(strings, dtype=f"<U{width}").reshape(-1).view(np.uint32).reshape(len(strings), width)


def _letters(codes: np.ndarray) -> np.ndarray:
    """A bit for each letter of a string."""
    return np.bitwise_or.reduce(np.where(codes > 0, np.uint64(1) << (codes % 63).astype(np.uint64), np.uint64(0)), axis=1)


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The gap-weighted subsequence kernel of the strings s[i] and t[i] (rows of codes, 0: nothing)."""
    n, a, b = len(s), s.shape[1], t.shape[1]
    square = DECAY * DECAY
    prime = [np.ones((b + 1, n))] + [np.zeros((b + 1, n)) for _ in range(ORDER - 1)]
    total = np.zeros(n)
    for i in range(a):
        # s's padding matches nothing and only decays what no later character reads
        match = [(s[:, i] == t[:, j]) & (t[:, j] > 0) for j in range(b)]
        if not any(m.any() for m in match):
            for q in range(1, ORDER):
                prime[q] *= DECAY
            continue
        for j in range(b):
            total += match[j] * (square * prime[ORDER - 1][j])
        for q in range(ORDER - 1, 0, -1):
            run = np.zeros(n)
            fresh = prime[q] * DECAY
            for j in range(b):
                run = DECAY * run + match[j] * (square * prime[q - 1][j])
                fresh[j + 1] += run
            prime[q] = fresh
    return total


class Model:
    """Landmarks and the machine; small, and pickled to the workers."""

    def __init__(self, landmarks: list[str], prior: float):
        self.landmarks, self.prior = landmarks, prior
        self.codes = _codes(landmarks, LONG) if landmarks else np.zeros((0, LONG), np.uint32)
        self.masks = _letters(self.codes)
        self.need = np.ceil(0.8 * np.bitwise_count(self.masks)).astype(np.uint8)
        self.own = kernel(self.codes, self.codes) if landmarks else np.ones(0)
        self.root = np.eye(0)
        if landmarks:
            m = len(landmarks)
            i, j = (x.ravel() for x in np.meshgrid(range(m), range(m), indexing="ij"))
            k = kernel(self.codes[i], self.codes[j]).reshape(m, m) / np.sqrt(np.outer(self.own, self.own))
            values, vectors = np.linalg.eigh(k)
            self.root = (vectors / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
        self.weights: np.ndarray | None = None
        self.curve = (1.0, 0.0)
        self.known: set[str] = set()
        self.hits: dict[str, list[tuple[int, float]]] = {}
        self.chars = 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": set(), "hits": {}, "chars": 0}

    def forget_words(self) -> None:
        self.known.clear()
        self.hits.clear()
        self.chars = 0

    def learn_words(self, new: list[str]) -> None:
        """Match words that were not met before with the landmarks."""
        self.known.update(new)
        self.chars += sum(map(len, new)) + OVERHEAD * len(new)
        owner, pieces = [], []
        for w in new:
            clean = START + _JUNK.sub("", w)
            if len(clean) > ORDER:
                for at in range(0, max(1, len(clean) - WINDOW // 2), WINDOW // 2):
                    owner.append(w)
                    pieces.append(clean[at : at + WINDOW])
        if not pieces:
            return
        codes = _codes(pieces, WINDOW)
        shared = np.bitwise_count(_letters(codes)[:, None] & self.masks) >= self.need
        row, mark = np.nonzero(shared)
        for lo in range(0, len(row), 20_000):
            r, z = row[lo : lo + 20_000], mark[lo : lo + 20_000]
            c = np.minimum(kernel(codes[r], self.codes[z]) / self.own[z], 1.0)
            for k in np.flatnonzero(c >= WEAK).tolist():
                self.hits.setdefault(owner[r[k]], []).append((int(z[k]), float(c[k])))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: per landmark the log of the summed matches, the largest, their density and how many words match strongly, then the length."""
        m = len(self.landmarks)
        out = np.zeros((len(texts), 4 * m + 1))
        split = [words_of(t) for t in texts]
        if self.chars > CACHE_CHARS:
            self.forget_words()
        new = set().union(*split).difference(self.known) if split else set()
        if new:
            self.learn_words(list(new))
        for i, words in enumerate(split):
            some = self.hits.keys() & set(words)
            if some:
                total, largest, strong = np.zeros(m), np.zeros(m), np.zeros(m)
                for w, n in Counter(w for w in words if w in some).items():
                    for z, c in self.hits[w]:
                        total[z] += n * (c - WEAK) / (1 - WEAK)
                        largest[z] = max(largest[z], c)
                        strong[z] += c >= STRONG
                out[i, :m] = self.root @ np.log1p(total)
                out[i, m : 2 * m] = largest
                out[i, 2 * m : 3 * m] = self.root @ np.log1p(1000 * total / len(words))
                out[i, 3 * m : 4 * m] = np.log1p(strong)
            out[i, -1] = np.log1p(len(words)) / 10
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> None:
        """Newton steps of the squared hinge loss, then of the logistic curve of its margins."""
        x1 = np.c_[x, np.ones(len(x))]
        s = np.where(y > 0, 1.0, -1.0)
        weight = weight / weight.sum()
        w = np.zeros(x1.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-9
        for _ in range(50):
            act = s * (x1 @ w) < 1
            a = x1[act] * weight[act, None]
            new = np.linalg.solve(a.T @ x1[act] + np.diag(penalty), a.T @ s[act])
            if np.abs(new - w).max() < 1e-8:
                break
            w = 0.5 * w + 0.5 * new if _ > 20 else new
        margin = x1 @ w
        g, b = 1.0, 0.0
        f = np.c_[margin, np.ones(len(margin))]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(g * margin + b, -30, 30)))
            grad = f.T @ (weight * (p - y)) + 1e-4 * np.array([g, 0.0])
            hess = (f * (weight * p * (1 - p))[:, None]).T @ f + 1e-4 * np.eye(2)
            step = np.linalg.solve(hess, grad)
            g, b = g - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        self.weights, self.curve = w, (float(g), float(b))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        margin = np.c_[self.features(texts), np.ones(len(texts))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * margin + self.curve[1], -30, 30)))


def choose_landmarks(texts: list[str | None], y: np.ndarray, most: int = LANDMARKS) -> list[str]:
    """Runs of characters, each chosen for the toxic texts that have it in one word, or in three, less the clean ones that do.

    A text counts half as much for each run chosen so far that it has; runs that share SHORT characters with a chosen one are
    left out. Runs must be in three toxic texts and in one of RARE at least, and be twice as frequent there as in clean ones.
    """
    def runs(text: str | None) -> Counter[str]:
        """How many different words have each run."""
        found = {START + _JUNK.sub("", w) for w in words_of(text)}
        return Counter(g for w in found for g in {w[a : a + n] for n in range(SHORT, LONG + 1) for a in range(len(w) - n + 1)})

    good = [i for i in range(len(y)) if y[i]]
    n1, n0 = max(1, len(good)), max(1, len(y) - len(good))
    floor = max(3, len(good) // RARE)
    toxic: dict[tuple[str, int], list[int]] = defaultdict(list)
    for i in good:
        for g, n in runs(texts[i]).items():
            for level in LEVELS:
                if n >= level:
                    toxic[g, level].append(i)
    toxic = {k: x for k, x in toxic.items() if len(x) >= floor}
    names = {g for g, _ in toxic}
    clean: Counter[tuple[str, int]] = Counter()
    for i in range(len(y)):
        if not y[i]:
            clean.update((g, level) for g, n in runs(texts[i]).items() if g in names for level in LEVELS if n >= level)
    rate0 = {k: clean[k] / n0 for k in toxic}
    left = {k: np.array(x) for k, x in toxic.items() if len(x) / n1 > 2 * rate0[k] + 0.002}
    open_ = np.ones(len(y))
    chosen: list[str] = []
    while left and len(chosen) < most:
        gain = {k: open_[x].sum() / n1 - 3 * rate0[k] for k, x in left.items()}
        best = max(left, key=lambda k: (gain[k], len(k[0]), k))
        if gain[best] < floor / n1:
            break
        chosen.append(best[0])
        open_[left[best]] /= 2
        kin = {best[0][a : a + SHORT] for a in range(len(best[0]) - SHORT + 1)}
        left = {k: x for k, x in left.items() if kin.isdisjoint(k[0][a : a + SHORT] for a in range(len(k[0]) - SHORT + 1))}
    return chosen


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that no training sees: CRC-32 of the id as text, modulo 5, is 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def gist(text: str | None) -> int:
    """The least hash of a text's three-word shingles: equal for copies and, as a rule, for near copies."""
    words = (text or "").split()
    return min(zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` rows of each class out of the rows that aren't held out."""
    docs = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    there = known.join(docs.select("doc_id").distinct(), "doc_id")
    counts = {r["toxic"]: r["count"] for r in there.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    if not counts.get(0) or not counts.get(1):
        return Model([], prior)
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    picked = [there.where(F.col("toxic") == k).orderBy(*order).limit(sample) for k in (0, 1)]
    few = F.broadcast(picked[0].union(picked[1]))  # 2 x sample rows at most
    rows = docs.select("doc_id", "text").join(few, "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    # copies of one text would make anything in it look like an insult
    rows = list({(r["toxic"], gist(r["text"])): r for r in reversed(rows)}.values())
    texts, y = [r["text"] for r in rows], np.array([r["toxic"] for r in rows])
    share = {k: counts[k] / max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    model = Model(choose_landmarks(texts, y), prior)
    if model.landmarks:
        model.fit(np.concatenate([model.features(texts[i : i + 256]) for i in range(0, len(texts), 256)]), y, weight)
    return model


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != into]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(into, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = model.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(got)], names=[*kept, into])

    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(tidy(run, model.forget_words), schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, into: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with a score (double) and a prediction (int, 1 where the score is 0.5 or more)."""
    return score(docs, train(docs, labels, sample), into).withColumn(predicted, (F.col(into) >= 0.5).cast("int"))
