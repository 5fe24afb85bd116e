"""Toxicity: a subsequence string kernel, Nyström landmarks and a support vector machine trained on labelled sentences.

Kernel. A text is cut into sentences and words (letters only, lower-cased; letters spelt one by one are joined). A
word is compared with a landmark by the gap-weighted subsequence kernel of order 3, normalised, at its best window of
up to three letters more than the landmark: inserted letters and gaps lower the value instead of hiding the match, and so does
a letter of the landmark that is left out. Windows that lack two letters or more and values below ``FLOOR`` count as 0,
which keeps the rows sparse. The ends of words are marks of their own; the mark of the beginning is a letter of landmarks
of up to five letters, so that those glued behind others have a lower value.

Landmarks. At most ``landmarks`` word beginnings, mined greedily from documents that are labelled toxic: the next one covers the most
toxic documents that the ones before leave uncovered, against the clean ones. Up to a third as many more are whole words that begin
alike but stand in clean documents as often.

Machine. A sentence has of every landmark the best value of its words, and the ``SHARP``-th power of that, which is
a kernel too and tells whole matches from near ones. Times the inverse roots of the landmarks' own kernel matrices (Nyström) these are
the rows of a squared-hinge support vector machine, each sentence labelled as its document is; those of clean documents weigh
``CLEAN`` times. Landmarks with a letter slipped in, with one left out and glued behind others, all letters drawn at
random, stand for the spellings that the sample lacks. A document is scored from the margins of its sentences through
a logistic curve fitted on the same labelled rows.

Training takes at most ``max_docs`` labelled documents of each class, whole texts, in the order of a hash of
the id; scoring reads every whole text. Only texts are inputs of a score.

Null and empty texts get the score of a text without toxic words. Labels that are null or other than 0 and
1 are ignored; of several labels of one document the highest counts. Without labels of both classes every
score is 0. Repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heapreplace
from sys import intern

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

DECAY, ORDER = 0.5, 3
SLACK, ANCHORED = 3, 5
WIDTH, STRIDE = 24, 11
MIN_LANDMARK, MAX_LANDMARK, LANDMARKS = 4, 9, 96
FLOOR, SHARP = 0.2, 10
FORMS, DAMAGED, CLEAN = 12, 0.2, 5.0
START, END = "^", "$"
CACHE, GROUP_CHARS, KERNEL_ROWS = 300_000, 2_000_000, 1_024
SENTENCE = re.compile(r"[.!?\n]+")
BREAK = re.compile(r"(?<=[.!?])\s+|\n")
SPELT = re.compile(r"(?<!\S)[^\W\d_](?:[\s.*_-]+[^\W\d_]){3,}(?!\S)")
MARKS = ".,;:!?()[]\"'#*%&|<>-_"
LEET = str.maketrans("013457@$", "oieastas")


def clean_word(token: str) -> str:
    """Lower-case letters of a token; digits and signs between letters are read as the letters they imitate."""
    token = token.lower()
    if token.isalpha():
        return token
    inner = token.strip(MARKS)
    if inner.isalpha():
        return inner
    token = inner.strip("".join(c for c in set(inner) if not c.isalnum()))
    letters = sum(c.isalpha() for c in token)
    if letters > len(token) - letters:
        token = token.translate(LEET)
    return "".join(c for c in token if c.isalpha())


def gap_kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise gap-weighted subsequence kernel of two code arrays (0 pads and matches nothing)."""
    return np.concatenate([_gap_kernel(x[at : at + KERNEL_ROWS], y[at : at + KERNEL_ROWS]) for at in range(0, max(1, len(x)), KERNEL_ROWS)])


def _gap_kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``gap_kernel`` of few rows, which are the last axis here so that every step reads its cells in one run."""
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    (a, n), b = x.shape, len(y)
    same = ((x[:, None] == y[None]) & (x[:, None] > 0)) * (DECAY * DECAY)
    below = np.ones((a, b, n))
    for _ in range(ORDER - 1):
        ending = same * below
        above = np.zeros((a + 1, b + 1, n))
        for i in range(a):
            run = np.zeros(n)
            for j in range(b):
                run *= DECAY
                run += ending[i, j]
                np.multiply(above[i, j + 1], DECAY, out=above[i + 1, j + 1])
                above[i + 1, j + 1] += run
        below = above[:a, :b]
    return (same * below).sum(axis=(0, 1))


def common_length(words: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    """Longest common subsequence of every row with a landmark, 32 cells a machine word; ``table``: code to its places."""
    full = np.uint32((1 << size) - 1)
    state = np.full(len(words), full, dtype=np.uint32)
    for column in words.T:
        hit = state & table[column]
        state = ((state + hit) | (state - hit)) & full
    return size - np.bitwise_count(state)


@dataclass
class KernelMap:
    """Kernel values of words against the landmarks."""

    landmarks: list[str]
    letters: dict[int, int] = field(init=False)

    def __post_init__(self) -> None:
        alphabet = sorted(set("".join(self.landmarks)) | {START, END})
        self.letters = {ord(c): i + 1 for i, c in enumerate(alphabet)}
        self.other = len(alphabet) + 1
        self.lookup = np.full(max(self.letters, default=0) + 2, self.other, dtype=np.uint8)
        for point, code in self.letters.items():
            self.lookup[point] = code
        self.bits = np.array([0] + [1 << min(i, 63) for i in range(len(alphabet))] + [0], dtype=np.uint64)
        marked = [START + w if len(w.strip(END)) <= ANCHORED else w for w in self.landmarks]
        self.coded = [self._codes([w], MAX_LANDMARK + 2)[0][: len(w)] for w in marked]
        self.masks = [np.bitwise_or.reduce(self.bits[c]) for c in self.coded]
        self.tables = []
        for codes in self.coded:
            table = np.zeros(self.other + 1, dtype=np.uint32)
            for place, code in enumerate(codes):
                table[code] |= np.uint32(1 << place)
            self.tables.append(table)
        self.own = [gap_kernel(c[None], c[None])[0] for c in self.coded]

    def _codes(self, words: list[str], width: int) -> np.ndarray:
        """Rows of letter codes, padded with 0: all words joined, looked up at once and cut apart again."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        out = np.zeros((len(words), width), dtype=np.uint8)
        out[np.arange(width) < sizes[:, None]] = self.lookup[np.minimum(points, len(self.lookup) - 1)]
        return out

    def __call__(self, words: list[str]) -> np.ndarray:
        """(words, landmarks): the best normalised kernel value of any window of a word.

        A word over ``WIDTH`` letters takes its best over overlapping parts.
        """
        parts, owner = [], []
        for i, word in enumerate(words):
            word = f"{START}{word}{END}"
            for at in range(0, max(1, len(word) - WIDTH + STRIDE), STRIDE) if len(word) > WIDTH else (0,):
                parts.append(word[at : at + WIDTH])
                owner.append(i)
        out = np.zeros((len(words), len(self.landmarks)))
        if not parts or not self.landmarks:
            return out
        owner, codes = np.array(owner), self._codes(parts, WIDTH)
        sizes = (codes > 0).sum(axis=1)
        masks = np.bitwise_or.reduce(self.bits[codes], axis=1)
        for lo, hi in ((MIN_LANDMARK - 1, 8), (8, STRIDE), (STRIDE, WIDTH)):
            rows = np.flatnonzero((sizes > lo) & (sizes <= hi))
            if len(rows):
                self._fill(out, codes[rows, :hi], sizes[rows], masks[rows], owner[rows])
        return out

    def _fill(self, out: np.ndarray, codes: np.ndarray, sizes: np.ndarray, masks: np.ndarray, owner: np.ndarray) -> None:
        """Values of words of similar length: letters present, then common subsequence, then the kernel on windows."""
        for k, (own_codes, mask, table, own) in enumerate(zip(self.coded, self.masks, self.tables, self.own, strict=True)):
            size = len(own_codes)
            need = size - 1
            rows = np.flatnonzero((np.bitwise_count(mask & ~masks) <= 1) & (sizes >= need))
            rows = rows[common_length(codes[rows], table, size) >= need]
            if not len(rows):
                continue
            views, whose = [], []
            known = table[codes] > 0
            # a window that begins or ends with a letter the landmark lacks has a lower value than the one without it
            for width in range(need, min(size + SLACK, codes.shape[1]) + 1):
                for at in range(codes.shape[1] - width + 1):
                    fit = rows[known[rows, at] & known[rows, at + width - 1]]
                    view = np.zeros((len(fit), size + SLACK), dtype=np.uint8)
                    view[:, :width] = codes[fit, at : at + width]
                    views.append(view)
                    whose.append(fit)
            view, fit = np.concatenate(views), np.concatenate(whose)
            near = common_length(view, table, size) >= need
            view, fit = view[near], fit[near]
            view, which = np.unique(view, axis=0, return_inverse=True)
            value = gap_kernel(view, np.broadcast_to(own_codes, (len(view), size))) / np.sqrt(gap_kernel(view, view) * own + 1e-12)
            np.maximum.at(out[:, k], owner[fit], value[which.reshape(-1)])
        out[out < FLOOR] = 0


def spelt_words(text: str) -> list[str]:
    """Words whose letters stand one by one, joined."""
    return ["".join(c for c in run if c.isalpha()) for run in SPELT.findall(text)]


def words_of(sentence: str) -> list[str]:
    words = [clean_word(t) for t in sentence.split()]
    return [w for w in words if len(w) >= MIN_LANDMARK - 1] + [w.lower() for w in spelt_words(sentence)]


def beginnings(word: str) -> list[str]:
    return [word[:n] for n in range(MIN_LANDMARK, min(len(word), MAX_LANDMARK) + 1)]


def mine_landmarks(toxic: list[set[str]], clean: Iterator[set[str]], n_clean: int, limit: int = LANDMARKS) -> list[str]:
    """Word beginnings by greedy weighted cover of the toxic documents; matched words leave the pool. One gives way to
    the longest that reaches nine tenths of its documents, since long landmarks bear damage better.

    Of the clean documents, which pass by once, only counts for beginnings of toxic documents' words are kept.
    """
    places = defaultdict(list)
    for i, words in enumerate(toxic):
        for word in words:
            places[word].append(i)
    members = defaultdict(list)
    for word in places:
        for stem in beginnings(word):
            members[stem].append(word)
    members = {s: words for s, words in members.items() if len(words) > 2 or len({i for w in words for i in places[w]}) > 2}
    in_clean = dict.fromkeys(members, 0)
    for words in clean:
        for word in words:
            for stem in beginnings(word):
                if stem in in_clean:
                    in_clean[stem] += 1
    covered, gone, chosen = np.zeros(len(toxic)), set(), []

    def reach(stem: str) -> set[int]:
        return {i for w in members[stem] if w not in gone for i in places[w]}

    def gain(stem: str) -> float:
        hit = reach(stem)
        if len(hit) < 3:
            return 0.0
        ratio = ((len(hit) + 0.5) / len(toxic)) / ((in_clean[stem] + 0.5) / n_clean)
        return sum(0.5 ** covered[i] for i in hit) * np.log(ratio) if ratio >= 5 else 0.0

    heap = [(-gain(s), -len(s), s) for s in members]
    heap = [x for x in heap if x[0] < 0]
    heapify(heap)
    while heap and len(chosen) < limit:
        value, _, stem = heap[0]
        now = -gain(stem)
        if now != value:
            heapreplace(heap, (now, -len(stem), stem)) if now < 0 else heappop(heap)
            continue
        if -value < max(5.0, 0.02 * len(toxic)):
            break
        heappop(heap)
        longer = [w for w in members if w.startswith(stem) and w not in chosen and len(reach(w)) >= 0.9 * len(reach(stem))]
        stem = max(longer, key=lambda w: (len(w), w), default=stem)
        chosen.append(stem)
        fresh = [w for w in members[stem] if w not in gone]
        for i in {i for w in fresh for i in places[w]}:
            covered[i] += 1
        gone.update(fresh)
    return chosen


def clean_lookalikes(stems: list[str], toxic: list[set[str]], clean: Iterator[set[str]], n_clean: int, limit: int) -> list[str]:
    """Whole words with a landmark's beginning that clean documents hold as often as toxic ones, most frequent first."""
    heads = set(stems)
    bad, good = Counter(), Counter()
    for found, bags in ((bad, toxic), (good, clean)):
        for words in bags:
            found.update(w for w in words if len(w) <= MAX_LANDMARK and not heads.isdisjoint(beginnings(w)))
    chosen = [w for w, c in good.items() if c >= 3 and c * len(toxic) >= bad[w] * n_clean]
    return [w + END for w in sorted(chosen, key=lambda w: (-good[w], w))[:limit]]


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (the last one the bias) of a linear machine, by Newton steps on the active rows; ``y``: side and margin wanted."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.eye(len(w)) * ridge
    keep[-1, -1] = 1e-6
    for _ in range(50):
        on = y * (x @ w) < y * y
        a = x[on] * weight[on, None]
        new = np.linalg.solve(keep + a.T @ x[on], a.T @ y[on])
        if np.allclose(new, w, atol=1e-9):
            break
        w = 0.5 * w + 0.5 * new if _ > 25 else new
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (the last one the intercept) of a logistic curve, by Newton steps that are halved until the loss falls."""
    x = np.column_stack([x, np.ones(len(x))])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * w @ w)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        while (new := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if now - new < 1e-10 * (1 + now):
            break
        w, now = w + step, new
    return w


def nystroem_root(own: np.ndarray) -> np.ndarray:
    """Inverse root of the landmarks' own kernel matrix, which turns kernel values into features."""
    value, vector = np.linalg.eigh(own)
    return vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T


def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.block([[a, np.zeros((len(a), len(b)))], [np.zeros((len(b), len(a))), b]])


def both_powers(values: np.ndarray) -> np.ndarray:
    """Kernel values and their ``SHARP``-th powers, which is a kernel too and tells whole matches from near ones."""
    return np.concatenate([values, values**SHARP], axis=1)


def damaged(word: str, draw: random.Random) -> list[str]:
    """A word with a letter slipped in, with one left out, and glued behind others; letters are drawn from all."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    i, j = draw.randrange(1, len(word)), draw.randrange(1, len(word))
    return [word[:i] + draw.choice(letters) + word[i:], word[:j] + word[j + 1 :], "".join(draw.choices(letters, k=draw.randint(2, 6))) + word]


class ToxicModel:
    """A trained scorer; without landmarks (no labels of both classes) all scores are 0."""

    def __init__(self, texts: list[str], labels: list[int], clean_per_toxic: float | None = None, landmarks: int = LANDMARKS) -> None:
        """``clean_per_toxic``: of all labels, where the sample holds another share than they do."""
        pairs = list(dict(zip(texts, labels, strict=True)).items())
        toxic = [t for t, y in pairs if y == 1]
        clean = [t for t, y in pairs if y != 1]
        self.limit = CACHE
        self.cache: dict[str, tuple | None] = {}
        self.kernel = KernelMap([])
        if not toxic or not clean:
            return

        def bags(texts: list[str]) -> Iterator[set[str]]:
            return ({intern(w) for s in SENTENCE.split(t) for w in words_of(s)} for t in texts)

        stems = mine_landmarks(list(bags(toxic)), bags(clean), len(clean), landmarks)
        if not stems:
            return
        self.kernel = KernelMap(stems + clean_lookalikes(stems, list(bags(toxic)), bags(clean), len(clean), landmarks // 3))
        own = self.kernel([w.strip(END) for w in self.kernel.landmarks])
        own = (own + own.T) / 2
        root = _block(nystroem_root(own), nystroem_root(own**SHARP))  # kernel values to features
        bad, good = (list(self._in_groups(texts)) for texts in (toxic, clean))
        sizes = [len(toxic), len(clean)]
        odds = (clean_per_toxic or sizes[1] / sizes[0]) * sizes[0] / sizes[1]  # what a clean document of the sample stands for
        weight = np.repeat([1.0, odds], sizes)
        self._fit_sentences(root, bad, good, odds)
        self.curve = logistic(np.array([self._evidence(rows) for rows in bad + good]), np.repeat([1.0, 0.0], sizes), weight)
        self.cache = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def _fit_sentences(self, root: np.ndarray, bad: list[np.ndarray], good: list[np.ndarray], odds: float) -> None:
        """The machine on sentences with the labels of their documents, as often as these have them. Sentences of damaged
        forms of landmarks join the toxic ones, and a row without any value stands for all other sentences."""
        count = len(self.kernel.landmarks)
        draw = random.Random(7)
        formed = self.kernel(sorted({f for w in self.kernel.landmarks if END not in w for _ in range(FORMS) for f in damaged(w, draw)}))
        formed = formed[formed.any(axis=1)]
        toxic, clean = (np.unique(np.concatenate([*rows, np.zeros((1, count))]).round(3), axis=0, return_counts=True) for rows in (bad, good))
        x = both_powers(np.concatenate([toxic[0], formed, clean[0]])) @ root
        y = np.repeat([1.0, -1.0], [len(toxic[0]) + len(formed), len(clean[0])])
        share = toxic[1] * toxic[0].any(axis=1) / len(bad)
        weight = np.concatenate([share, np.full(len(formed), DAMAGED * share.sum() / max(1, len(formed))), np.where(clean[0].any(axis=1), CLEAN * clean[1] / len(good), 1.0)])
        w = squared_hinge(x, y, weight * 100)
        self.alpha, self.bias = root @ w[:-1], w[-1]

    def _learn_words(self, tokens: set[str]) -> None:
        """Kernel values of unseen tokens into the cache, which is emptied when full; None for a token without any."""
        fresh = [t for t in tokens if t not in self.cache]
        if len(self.cache) > self.limit:
            self.cache.clear()
            fresh = list(tokens)
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            values = self.kernel([clean_word(t) for t in part])
            found = dict.fromkeys(part)
            for i in np.flatnonzero(values.any(axis=1)):
                at_landmarks = np.flatnonzero(values[i])
                found[part[i]] = at_landmarks, values[i, at_landmarks]
            self.cache.update(found)

    def _in_groups(self, texts: list[str]) -> Iterator[np.ndarray]:
        """``_near_sentences`` of every text; the tokens of many texts are looked up at once."""
        at = 0
        while at < len(texts):
            group, chars = [], 0
            while at < len(texts) and (not group or chars < GROUP_CHARS):
                group.append(texts[at])
                chars += len(texts[at])
                at += 1
            spelt = [spelt_words(text) for text in group]
            self._learn_words({t for text in group for t in text.split()}.union(*spelt))
            yield from map(self._near_sentences, group, spelt)

    def _near_sentences(self, text: str, spelt: list[str]) -> np.ndarray:
        """Kernel values of the text's sentences that have any: of every landmark the best value of a word."""
        cache = self.cache
        near = {t for t in (*text.split(), *spelt) if cache[t] is not None}
        rows = []
        if near:
            sentences = [near.intersection(s.split()) for s in BREAK.split(text)] if not near.isdisjoint(text.split()) else []
            for words in [*sentences, *[{t} for t in spelt if t in near]]:
                if words:
                    row = np.zeros(len(self.kernel.landmarks))
                    for word in words:
                        at, values = cache[word]
                        row[at] = np.maximum(row[at], values)
                    rows.append(row)
        return np.array(rows).reshape(-1, len(self.kernel.landmarks))

    def _margins(self, rows: np.ndarray) -> np.ndarray:
        return both_powers(rows) @ self.alpha + self.bias

    def _evidence(self, rows: np.ndarray) -> tuple[float, float]:
        """Logs of two sums over sentences, of how far each lies beyond the half of the way from a sentence without any value
        to the toxic side, and of the square of that: many weak sentences weigh in the one, a strong one in the other."""
        beyond = np.maximum(self._margins(rows) - self.bias / 2, 0)
        return float(np.log1p((beyond**2).sum())), float(np.log1p(beyond.sum()))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.kernel.landmarks:
            return np.zeros(len(texts))
        out = [self._evidence(rows) for rows in self._in_groups([t or "" for t in texts])]
        x = np.array(out).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 2000) -> ToxicModel:
    """Fit on at most ``max_docs`` labelled documents of each class that are not held out."""
    known = labels.select(F.col("doc_id").alias("its_id"), F.col("toxic").cast("int").alias("label")).filter("label IN (0, 1) AND its_id IS NOT NULL")
    known = known.filter(~held_out(F.col("its_id"))).groupBy("its_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = [F.xxhash64("its_id"), F.col("its_id")]
    sample = known.filter("label = 1").orderBy(*order).limit(max_docs).unionByName(known.filter("label = 0").orderBy(*order).limit(max_docs))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("its_id")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
    odds = sizes.get(0, 0) / max(1, sizes.get(1, 0)) or None

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "label": []}), *batches]).sort_values(["doc_id", "text"])
        yield pd.DataFrame({"model": [pickle.dumps(ToxicModel(sample["text"].tolist(), sample["label"].astype(int).tolist(), odds))]})

    # the sample is bounded, so one task holds it; only the model comes to the driver
    found = rows.repartition(1).mapInPandas(fit, "model binary").first()
    return pickle.loads(found["model"]) if found else ToxicModel([], [])


def toxic_score(model: ToxicModel, text: Column) -> Column:
    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        its = shared.value
        for batch in batches:
            yield pd.Series(its.scores(list(batch)))

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, max_docs: int = 2000) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = train(docs, labels, max_docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxic_score(model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_docs: int = 2000, training_docs: DataFrame | None = None) -> DataFrame:
    """The rows below one half, with all columns; the labels' texts come from ``training_docs`` if given."""
    model = train(docs if training_docs is None else training_docs, labels, max_docs)
    rows = docs.select(F.struct("*").alias("row"), toxic_score(model, F.col("text")).alias("score"))
    return rows.filter("score < 0.5").select("row.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
