"""Toxicity scores by weak supervision.

Method. Voters: words of a general lexicon of insults; words, and beginnings of words, that training labels show to be as
telling (many times more frequent in toxic texts, in many different contexts, so that a text copied around doesn't make
its rare words voters; they are judged in the 200 words where most of them stand, however long the text is); and patterns (shouting, runs of marks, address together with insults, density of insults ...). Each voter votes toxic,
clean or not at all. A generative label model estimates by expectation-maximisation, over a sample of texts, how
accurate each voter is, with the labels of training rows as one more, noisy voter; it also estimates which voters are
correlated beyond what the class explains, and lets a correlated set speak with one voice. Its posteriors are the labels
of a linear (logistic) classifier on the voters' signals, which scores all texts.

On Spark: only labelled training rows are used for learning, at most SAMPLE of them, chosen by a hash of the id (the
bound is a parameter); their word statistics are aggregated by Spark and at most LEARNED words come to the driver, as
do the sample's signals, a few dozen numbers a row. All texts are scored whole, in one pass without a shuffle.

Defined cases: null and empty texts have no signals and get the score of a text without any; labels with a null doc_id
or label take no part, a doc_id with several labels is toxic if one says so; rows with a null doc_id are scored, not
learned from; repeated rows give one row each; labels, lang, source and ids are no inputs of a score; columns other than
doc_id and text are not read; without labelled rows the general lexicon votes alone; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import crc_of, slices, texts

STRETCH, TOGETHER = 200, 3  # words of a stretch; words with hits that it has to hold if the text is longer
STEM = (4, 9)  # letters of a beginning of words
SAMPLE, LEARNED = 8_000, 200  # labelled rows that are learned from, and words learned from them, at most
# A general lexicon of insults, in natural order.
LEXICON = (
    "arse arsehole asshole bastard bitch bollocks bonehead bozo brainless bullshit clown coward creep crap cretin cunt damn degenerate dickhead dimwit "
    "disgusting dipshit douchebag dumb dumbass dunce fool freak fuck fucking garbage halfwit hideous idiot idiotic ignorant imbecile jackass jerk lame "
    "loser lunatic maggot moron moronic motherfucker nitwit parasite pathetic pig pissed prick psycho repulsive retard retarded scum scumbag shit "
    "shithead shitty shut slut sleazy stupid subhuman sucker trash twat twit ugly useless vermin vile wanker weakling whore worthless wretch").split()
WORD = re.compile(r"[^\W\d_]+")
RUN = re.compile(r"\S+")
ADDRESS = frozenset("you your yourself youre u ur du dich dein tu toi vous te ti usted eres".split())
PATTERNS = ("insults_2", "insults_dense", "insults_distinct", "shouting", "marks", "repetition", "address_and_insult", "no_insult")


@dataclass
class Rules:
    """The voters' words, and their beginnings of words."""
    words: list[str]
    stems: list[str]

    def __len__(self):
        return len(self.words) + len(self.stems)

    def automaton(self):
        a = ahocorasick.Automaton()
        for w in {*self.words, *self.stems}:
            as_word = self.words.index(w) if w in self.words else -1
            as_stem = len(self.words) + self.stems.index(w) if w in self.stems else -1
            a.add_word(w, (as_word, as_stem, len(w)))
        a.make_automaton()
        return a


def telling(count: int, length: int) -> bool:
    """Whether a beginning of words comes often enough in a stretch of so many words."""
    return count >= 2 and STRETCH * count >= length


def densest(places: list[int], length: int) -> tuple[int, int]:
    """First and last of the hits (given by the places of their words, in order) that lie in one stretch, as many as possible."""
    best, first = (0, 0), 0
    for last, place in enumerate(places):
        while place - places[first] >= STRETCH:
            first += 1
        if last + 1 - first > best[1] - best[0]:
            best = (first, last + 1)
    return best


def signals(raw: bytes, automaton, n: int) -> np.ndarray:
    """Counts of the voters' words (log) and rates of their beginnings of words, then the patterns' strengths.

    Learned words and beginnings are judged in the stretch of STRETCH words where most of them stand, so that a passage
    gives the same signals in a short text and in a long one; in longer texts three hits at least have to stand together.
    """
    low = raw.decode("utf-8", "replace").lower()
    out, words_met, stems_met = np.zeros(n + len(PATTERNS)), Counter(), Counter()
    size = len(low)
    hits: list[tuple[int, int, int]] = []  # of words and of beginnings: place in the text, word or -1, beginning or -1
    for end, (as_word, as_stem, length) in automaton.iter(low):
        start = end - length
        if start < 0 or not low[start].isalpha():
            whole = end + 1 >= size or not low[end + 1].isalpha()
            if as_stem >= 0 or as_word >= 0 and whole:
                hits.append((start + 1, as_word if whole else -1, as_stem))
    words = low.split()
    length = max(1, len(words))
    places = []
    if hits:
        begins = [m.start() for m in RUN.finditer(low)] if length > STRETCH else [0]
        places = [bisect_right(begins, h[0]) for h in hits]
    learned = [i for i, h in enumerate(hits) if h[2] >= 0 or h[1] >= len(LEXICON)]
    first, last = densest([places[i] for i in learned], length)
    stretch = min(length, STRETCH)
    words_met.update(h[1] for h in hits if 0 <= h[1] < len(LEXICON))
    if length <= STRETCH or len({places[i] for i in learned[first:last]}) >= TOGETHER:
        for i in learned[first:last]:
            if hits[i][2] >= 0:
                stems_met[hits[i][2]] += 1
            if hits[i][1] >= len(LEXICON):
                words_met[hits[i][1]] += 1
    stems_met = {i: c for i, c in stems_met.items() if telling(c, stretch)}
    for i, c in words_met.items():
        out[i] = np.log1p(c)
    for i, c in stems_met.items():
        out[i] = 0.5 + min(1.0, 20 * c / stretch)
    # Beginnings overlap each other: the most frequent one stands for all.
    total = sum(words_met.values()) + max(stems_met.values(), default=0)
    distinct = len(words_met) + 2 * bool(stems_met)
    voting = [places[i] for i, h in enumerate(hits) if 0 <= h[1] and h[1] in words_met]
    dense = densest(voting, length)
    dense = dense[1] - dense[0] + max(stems_met.values(), default=0)
    b = np.frombuffer(raw, np.uint8)
    upper, lower = int(((b >= 65) & (b <= 90)).sum()), int(((b >= 97) & (b <= 122)).sum())
    marks = sum(low.count(x) for x in ("!!", "??", "###", "***", "$$$", "%%%", "&&&"))
    often = max(Counter(words).values()) if len(words) > 20 else 0
    out[n:] = (min(total, 6) / 2 if total > 1 else 0, min(1.0, 30 * dense / stretch) if total else 0, min(distinct, 5) / 2 if distinct > 1 else 0,
               float(upper > lower and upper > 20), min(1.0, 5 * marks / length), float(2 * often > length),
               float(total > 0 and not ADDRESS.isdisjoint(words)), float(total == 0))
    return out


def votes(x: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 none; the last pattern speaks for clean texts."""
    v = (x > 0.4).astype(np.int8)
    v[:, -1] *= -1
    return v


@dataclass
class LabelModel:
    prior: float
    fires: np.ndarray  # voter fires given clean, given toxic: (2, voters)
    voice: np.ndarray  # 1 / size of each voter's correlated set
    label: np.ndarray  # label 1 given clean, given toxic

    def posterior(self, v: np.ndarray, y: np.ndarray) -> np.ndarray:
        f = (v != 0).astype(float)
        ratio = np.log(self.fires[1] / self.fires[0]) * self.voice
        silent = np.log((1 - self.fires[1]) / (1 - self.fires[0])) * self.voice
        silent[-len(PATTERNS):] = 0  # patterns follow from the words: their silence says nothing new
        odds = np.log(self.prior / (1 - self.prior)) + f @ ratio + (1 - f) @ silent
        odds += np.where(y == 1, np.log(self.label[1] / self.label[0]), np.where(y == 0, np.log((1 - self.label[1]) / (1 - self.label[0])), 0.0))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def correlated_sets(f: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
    """Size of the set of voters that each one belongs to, by correlation within the classes."""
    left = f - (np.outer(q, (q @ f) / max(q.sum(), 1e-9)) + np.outer(1 - q, ((1 - q) @ f) / max((1 - q).sum(), 1e-9)))
    spread = np.sqrt((left ** 2).mean(axis=0)) + 1e-9
    near = (left.T @ left) / len(f) / np.outer(spread, spread) > least
    label = np.arange(f.shape[1])
    while True:
        new = np.where(near | np.eye(len(label), dtype=bool), label[None, :], len(label)).min(axis=1)
        if (new == label).all():
            break
        label = new
    return np.bincount(label, minlength=len(label))[label].astype(float)


def fit_labels(v: np.ndarray, y: np.ndarray, rounds: int = 30) -> LabelModel:
    """Expectation-maximisation, from what words and labels say together; y: labels, -1 where there is none."""
    f = (v != 0).astype(float)
    word = v[:, :v.shape[1] - len(PATTERNS)].any(axis=1)
    q = np.where(word, np.where(y == 1, 0.97, np.where(y == 0, 0.1, 0.7)), np.where(y == 1, 0.3, 0.03))
    n, voice = len(v), np.ones(v.shape[1])
    for k in range(rounds):
        toxic, clean = q.sum(), n - q.sum()
        fires = np.stack([((1 - q) @ f + 0.05) / (clean + 1), (q @ f + 0.5) / (toxic + 1)])
        # A voter for toxicity is taken to fire no less often on toxic texts, and the other way round.
        fires[1, :-1] = np.maximum(fires[1, :-1], fires[0, :-1])
        fires[1, -1] = min(fires[1, -1], fires[0, -1])
        fires = np.clip(fires, 1e-5, 1 - 1e-5)
        known = y >= 0
        label = np.array([((1 - q)[known] @ (y[known] == 1) + 1) / ((1 - q)[known].sum() + 20), (q[known] @ (y[known] == 1) + 9) / (q[known].sum() + 10)])
        if k in (2, 10):
            voice = 1 / correlated_sets(f, q, 0.5)
        model = LabelModel(float(np.clip(toxic / n, 0.005, 0.5)), fires, voice, label)
        q = model.posterior(v, y)
    return model


def fit_linear(x: np.ndarray, q: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the constant last) of a logistic classifier of the posteriors, by Newton's method."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag(penalty + 1e-6), a.T @ (q - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def contexts(labelled: DataFrame) -> DataFrame:
    """For every word (kind w) and beginning (kind s) of the sample: the different contexts it has in toxic and in clean texts."""
    def run(batches):
        for batch in batches:
            kinds, voters, keys, toxic = [], [], [], []
            for t, y in zip(texts(batch.column("text")), batch.column("toxic").to_pylist()):
                ws = WORD.findall(t.decode("utf-8", "replace").lower())
                count, first, found = Counter(), {}, {}
                for a, w, b in zip(["", *ws], ws, [*ws[1:], ""]):
                    if w not in found:
                        found[w] = f"{a} {b}"
                        for n in range(STEM[0], min(STEM[1], len(w) - 1) + 1):
                            first.setdefault(w[:n], f"{w} {b}")
                    for n in range(STEM[0], min(STEM[1], len(w) - 1) + 1):
                        count[w[:n]] += 1
                some = [("w", w, k) for w, k in found.items() if 2 < len(w) <= 40]
                some += [("s", w, first[w]) for w, c in count.items() if telling(c, len(ws))]
                for kind, w, k in some:
                    kinds.append(kind)
                    voters.append(w)
                    keys.append(k)
                    toxic.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (kinds, voters, keys)] + [pa.array(toxic, pa.int32())], names=["kind", "word", "context", "toxic"])
    rows = labelled.select("text", "toxic").mapInArrow(run, "kind string, word string, context string, toxic int")
    # Copies share a word's first context: texts are counted by distinct contexts.
    seen = rows.groupBy("kind", "word", "context").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("least"))
    return seen.groupBy("kind", "word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("least")).alias("clean"))


@dataclass
class Classifier:
    rules: Rules
    weights: np.ndarray
    labels: LabelModel | None = None

    def scores(self, made: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(made @ self.weights[:-1] + self.weights[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, learned: int = LEARNED, lift: float = 15.0) -> Classifier:
    """labels: doc_id, toxic of the rows to learn from."""
    spark = docs.sparkSession
    chosen = (labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect())  # `sample` pairs of numbers at most
    rows = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], "doc_id long, toxic int")
    sampled = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    n_toxic, n = sum(r["toxic"] for r in chosen), len(chosen)
    words, stems = list(LEXICON), []
    if n_toxic and n_toxic < n:
        ratio = (F.col("toxic") + 0.1) / (n_toxic + 0.2) / ((F.col("clean") + 0.1) / (n - n_toxic + 0.2))
        top = (contexts(sampled).filter(F.col("toxic") >= max(4, n_toxic // 40)).filter(ratio >= lift)
               .orderBy(F.desc(ratio), "kind", "word").limit(learned).collect())
        words += [r["word"] for r in top if r["kind"] == "w" and r["word"] not in LEXICON]
        stems = [r["word"] for r in top if r["kind"] == "s"]
    rules = Rules(words, stems)

    def run(batches):
        automaton = rules.automaton()
        for batch in batches:
            for part, ts in slices(batch, "text"):
                made = [signals(t, automaton, len(rules)).tolist() for t in ts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(made, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    # Of the texts of a repeated id the one with the largest signals is learned from, whatever the order of rows.
    made = sampled.mapInArrow(run, "doc_id long, toxic int, x array<double>").groupBy("doc_id").agg(F.max(F.struct("x", "toxic")).alias("r")).select("doc_id", "r.*").collect()
    made.sort(key=lambda r: r["doc_id"])
    width = len(rules) + len(PATTERNS)
    if not made:
        weights = np.zeros(width + 1)
        weights[:len(rules)], weights[-1] = 6.0, -3.0
        return Classifier(rules, weights)
    x, y = np.array([r["x"] for r in made]).reshape(-1, width), np.array([r["toxic"] for r in made])
    model = fit_labels(votes(x), y)
    # What the labels say of one row is in the posteriors of training only through the voters' accuracies.
    posterior = model.posterior(votes(x), np.full(len(y), -1))
    return Classifier(rules, fit_linear(x, posterior), model)


def scored(docs: DataFrame, classifier: Classifier, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in `keep`, score of every row."""
    names = ["doc_id", *[c for c in keep if c != "doc_id"]]
    n = len(classifier.rules)

    def run(batches):
        automaton = classifier.rules.automaton()
        for batch in batches:
            for rows, parts in slices(batch, "_text"):
                made = np.array([signals(t, automaton, n) for t in parts])
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(classifier.scores(made))], names=[*names, "score"])

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("score", T.DoubleType())])
    return docs.select(*names, F.col("text").alias("_text")).mapInArrow(run, schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Those of rows whose crc32 of the id, as text, is not 1 modulo 3."""
    return labels.filter(crc_of("doc_id", 3) != 1)
