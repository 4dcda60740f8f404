"""Toxicity by weak supervision: many weak voters, a generative label model, a linear classifier.

Voters are lexicons and patterns that fire on a text or abstain.  A few are fixed; most are lexicons
induced from the labelled documents: words and beginnings of words that stand in toxic texts far more
often than in others, in bands by precision, each firing at one occurrence, and again where they are dense.

The label model knows no true label: y is hidden, P(y) is a prior, each voter depends on y and, since
voters are correlated, on one other voter, which the pairwise statistics given y choose (a maximum
spanning tree of conditional mutual information).  Expectation-maximisation over the vote vectors of all
documents estimates accuracies and correlations.  A given label is one more voter, which abstains on
most documents and is trusted; texts with one start the estimation and weigh more than the rest, so the
hidden y stays toxicity.

A logistic regression on words, beginnings of words and votes is trained on the posterior labels of a
bounded sample of texts (``SAMPLE``); everything else counts all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.scratch import arrow_batches, settle

#: Distinct texts, at most, that the classifier is trained on; features it uses, chosen by association.
SAMPLE, FEATURES = 20_000, 1024
#: Lengths of the beginnings of words that are features beside whole words of up to ``LONGEST`` letters.
BEGINNINGS, LONGEST = (4, 5, 6, 7), 24
#: Least texts with a feature; least z-score of a lexicon's entries; least precision (smoothed) of its bands, as
#: a share of the way from the share of toxic texts to one.
SUPPORT, STRONG, BANDS = 3, 4.0, (0.75, 0.25)
#: Occurrences, and share of all words, from which on a lexicon's second voter fires.
DENSE = (2, 0.01)
#: Rounds of expectation-maximisation, least accuracy of given labels, weight of a text without one where some have one,
#: and penalty of the regression's weights.
ROUNDS, GIVEN, HIDDEN, PENALTY = 6, 0.99, 0.1, 0.3
#: Distinct features a task counts before it hands them on.
HELD = 500_000
LOGS = [math.log1p(n) for n in range(64)]

WORDS = re.compile(r"[^\W\d_]+")
#: Insults and hostile phrases that need no labels. A fixed list.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown imbecile fool jerk creep filth vermin bastard coward".split())
#: Hostile phrases, sought in lower-cased text.
PHRASES = ("shut up", "go away", "get lost", "drop dead", "hate you", "kill you", "kill yourself", "shame on you", "piece of")
#: Heaps of marks, masked words (in lower-cased text), and shouting.
MARKS, MASKS = ("!!!", "???", "!?!"), ("**", "##", "@@", "$$", "*#", "#*", "@#", "$#")
SHOUTING = re.compile(r"[A-Z]{3,}\s+[A-Z]{3,}\s+[A-Z]{3}")
KINDS = ("word", *BEGINNINGS)
#: Two voters for each lexicon and for the fixed list, one each for phrases, marks, masks and shouting, and one for the absence of any strong entry.
VOTERS = 2 * len(KINDS) * len(BANDS) + 2 + 5


def features(word: str) -> list[str]:
    """Names of a lower-case word's features: itself with its end marked, and its beginnings."""
    own = [f"{word}$"] if len(word) <= LONGEST else []
    return own + [word[:n] for n in BEGINNINGS if len(word) > n]


def associations(texts: DataFrame) -> DataFrame:
    """(feature, toxic, n): texts with a feature, over rows (text, toxic 0/1); counted in the tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, toxic = Counter(), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*n], pa.string()), pa.array([toxic[f] for f in n], pa.int64()), pa.array([*n.values()], pa.int64())], names=["feature", "toxic", "n"])

        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = {f for w in {*WORDS.findall((text or "").lower())} for f in features(w)}
                n.update(found)
                if y:
                    toxic.update(found)
                if len(n) > HELD:
                    yield out()
                    n.clear()
                    toxic.clear()
        yield out()

    with arrow_batches(texts.sparkSession, 256):
        counted = texts.select("text", "toxic").mapInArrow(run, "feature string, toxic long, n long")
        return settle(counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).filter(F.col("n") >= SUPPORT), "associations")


def chosen(counts: DataFrame, toxic: int, n: int) -> list[tuple[str, float, float]]:
    """The ``FEATURES`` (feature, z, precision) with the largest z-scores of their log odds ratio, either sign."""
    a, b = F.col("toxic") + 0.5, F.col("n") - F.col("toxic") + 0.5
    c, d = F.lit(toxic + 1.0) - a, F.lit(n - toxic + 1.0) - b
    z = F.log(a * d / (b * c)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    base = (toxic + 1) / (n + 2)
    scored = counts.select("feature", z.alias("z"), ((F.col("toxic") + base) / (F.col("n") + 1)).alias("p"))
    return [tuple(r) for r in scored.orderBy(F.desc(F.abs("z")), "feature").limit(FEATURES).collect()]


class Reader:
    """Votes and features of a text, by one automaton over the chosen features, so its size is bounded."""

    def __init__(self, entries: list[tuple[str, float, float]], base: float):
        lines = [base + (1 - base) * share for share in BANDS]
        held: dict[str, tuple[int, bool, list[int]]] = {}  # pattern -> (feature or -1, a beginning only, lexicons)
        for i, (f, z, p) in enumerate(entries):
            kind = 0 if f.endswith("$") else KINDS.index(len(f))
            lexicons = [kind * len(BANDS) + k for k, line in enumerate(lines) if z >= STRONG and p >= line]
            held[f" {f[:-1]} " if kind == 0 else f" {f}"] = (i, kind > 0, lexicons)
        for w in INSULTS:
            i, start, lexicons = held.get(f" {w} ", (-1, False, []))
            held[f" {w} "] = (i, start, [*lexicons, len(KINDS) * len(BANDS)])
        self.automaton = ahocorasick.Automaton()
        for pattern, what in held.items():
            self.automaton.add_word(pattern, what)
        self.automaton.make_automaton()

    def read(self, text: str | None) -> tuple[int, dict[int, int]]:
        """(votes as bits, occurrences of each chosen feature)."""
        text = text or ""
        low = text.lower()
        words = WORDS.findall(low)
        line = f" {'  '.join(words)} "  # words share no space, so whole words side by side are both found
        hits, found = [0] * (len(KINDS) * len(BANDS) + 1), {}
        for end, (i, start, lexicons) in self.automaton.iter(line):
            if start and line[end + 1] == " ":
                continue
            if i >= 0:
                found[i] = found.get(i, 0) + 1
            for k in lexicons:
                hits[k] += 1
        dense = max(DENSE[0], DENSE[1] * len(words))
        fires = [h >= at for h in hits for at in (1, dense)]
        fires += [any(p in low for p in PHRASES), any(m in text for m in MARKS), any(m in low for m in MASKS), bool(SHOUTING.search(text)), not any(hits)]
        return sum(1 << k for k, f in enumerate(fires) if f), found

    def inputs(self, text: str | None) -> tuple[int, list[int], list[float]]:
        """(votes, positions, values) of the classifier's inputs: chosen features by the logarithm of their
        occurrences, then votes, and the logarithm of the length."""
        votes, found = self.read(text)
        at = [*found, *[FEATURES + k for k in range(VOTERS) if votes >> k & 1], FEATURES + VOTERS]
        logs = [LOGS[n] if n < 64 else math.log1p(n) for n in found.values()]
        return votes, at, [*logs, *[1.0] * votes.bit_count(), math.log1p(len(text or "")) / 10]


def bits(votes: np.ndarray) -> np.ndarray:
    return (votes[:, None] >> np.arange(VOTERS) & 1).astype(np.float64)


class LabelModel:
    """Hidden label, voters in a tree, and the given label: log-probabilities and their estimation."""

    def __init__(self, prior: float):
        self.prior, self.given, self.parents, self.tables = prior, GIVEN, None, None

    def start(self, votes: np.ndarray, given: np.ndarray) -> np.ndarray:
        """First posteriors: the given label, else by the fixed list and the strong lexicons."""
        v = bits(votes)
        fixed = 2 * len(KINDS) * len(BANDS)
        strong = v[:, [4 * k + 1 for k in range(len(KINDS))]].sum(axis=1) + 2 * v[:, fixed]
        guess = np.where(strong >= 2, 0.8, self.prior / 2)
        return np.where(given == 1, self.given, np.where(given == 0, 1 - self.given, guess))

    def posterior(self, votes: np.ndarray, given: np.ndarray) -> np.ndarray:
        """P(y = 1) of vote vectors and given labels (1, 0, or -1 for none)."""
        if self.tables is None:
            return self.start(votes, given)
        v = bits(votes).astype(int)
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(v), 1))
        for j, parent in enumerate(self.parents):
            seen = v[:, parent] if parent >= 0 else np.zeros(len(v), dtype=int)
            for y in (0, 1):
                log[:, y] += np.log(self.tables[j][y][seen, v[:, j]])
        for y in (0, 1):
            log[:, y] += np.where(given < 0, 0.0, np.log(np.where(given == y, self.given, 1 - self.given)))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))

    def fit(self, weight: np.ndarray, pairs: np.ndarray, right: float, told: float) -> None:
        """New parameters from P(y) sums ``weight[y]``, ``pairs[y, j, k]`` (both fire; j = k: fires), and the
        weight with which given labels are right."""
        n = weight.sum()
        self.prior = float(np.clip((weight[1] + 1) / (n + 2), 1e-4, 0.5))
        self.given = max(GIVEN, min((right + 1) / (told + 1.02), 0.999))
        both = [np.empty((VOTERS, VOTERS, 2, 2)) for _ in (0, 1)]
        for y in (0, 1):
            fire = np.diag(pairs[y])
            both[y][:, :, 1, 1] = pairs[y]
            both[y][:, :, 1, 0] = fire[:, None] - pairs[y]
            both[y][:, :, 0, 1] = fire[None, :] - pairs[y]
            both[y][:, :, 0, 0] = weight[y] - fire[:, None] - fire[None, :] + pairs[y]
            both[y] = np.maximum(both[y], 0) + 0.25
        info = np.zeros((VOTERS, VOTERS))
        for y in (0, 1):
            p = both[y] / both[y].sum(axis=(2, 3), keepdims=True)
            info += weight[y] / n * (p * np.log(p / (p.sum(axis=3, keepdims=True) * p.sum(axis=2, keepdims=True)))).sum(axis=(2, 3))
        self.parents = [-1] * VOTERS
        near = {j: 0 for j in range(1, VOTERS)}  # Prim's tree from voter 0
        while near:
            j = max(near, key=lambda x: (info[x, near[x]], -x))
            self.parents[j] = near.pop(j)
            near = {k: (j if info[k, j] > info[k, p] else p) for k, p in near.items()}
        self.tables = []
        for j, parent in enumerate(self.parents):
            rows = []
            for y in (0, 1):
                t = both[y][parent, j] if parent >= 0 else np.tile(both[y][j, j].diagonal(), (2, 1))
                rows.append(t / t.sum(axis=1, keepdims=True))
            self.tables.append(rows)


def estimate(vectors: DataFrame, prior: float) -> LabelModel:
    """The label model of vote vectors (votes, given, n); each round is one job over the distinct vectors,
    which brings back sums for pairs of voters only."""
    model, hidden = LabelModel(prior), 0.0
    if vectors.filter("given >= 0").isEmpty():
        hidden = 1.0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, pairs, right, told = np.zeros(2), np.zeros((2, VOTERS, VOTERS)), 0.0, 0.0
        for b in batches:
            votes, given, n = (np.asarray(c) for c in b.columns)
            p = model.posterior(votes, given)
            n = np.where(given < 0, hidden * n, n)
            v = bits(votes)
            for y, q in enumerate((n * (1 - p), n * p)):
                weight[y] += q.sum()
                pairs[y] += (v * q[:, None]).T @ v
                right += q[given == y].sum()
            told += n[given >= 0].sum()
        yield pa.RecordBatch.from_arrays([pa.array([[*weight, *pairs.ravel(), right, told]], pa.list_(pa.float64()))], names=["s"])

    for _ in range(ROUNDS):
        with arrow_batches(vectors.sparkSession, 8192):
            total = np.sum([r.s for r in vectors.select("votes", "given", "n").mapInArrow(sums, "s array<double>").collect()], axis=0)
        if not total[:2].sum():
            break
        model.fit(total[:2], total[2:-2].reshape(2, VOTERS, VOTERS), total[-2], total[-1])
        hidden = max(hidden, HIDDEN)
    return model


def regression(at: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, steps: int = 120) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on soft labels, by limited-memory BFGS."""
    rows = np.repeat(np.arange(len(at)), [len(x) for x in at])
    cols, vals = np.concatenate(at), np.concatenate(values)
    size = FEATURES + VOTERS + 1

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        m = np.bincount(rows, vals * w[cols], len(at)) + w[-1]
        loss = float((np.logaddexp(0, m) - target * m).sum() + PENALTY / 2 * (w[:-1] ** 2).sum())
        d = 1 / (1 + np.exp(-np.clip(m, -60, 60))) - target
        return loss, np.append(np.bincount(cols, vals * d[rows], size) + PENALTY * w[:-1], d.sum())

    w = np.zeros(size + 1)
    loss, g = value(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, used = g.copy(), []
        for s, y in reversed(past):
            a = s @ q / (s @ y)
            q -= a * y
            used.append(a)
        q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(g).max())
        for (s, y), a in zip(past, reversed(used), strict=True):
            q += s * (a - y @ q / (s @ y))
        step = 1.0
        while True:
            new_loss, new_g = value(w - step * q)
            if new_loss <= loss - 1e-4 * step * (g @ q) or step < 1e-8:
                break
            step /= 2
        s, y = -step * q, new_g - g
        w, done, loss, g = w + s, loss - new_loss < 1e-9 * max(1.0, abs(loss)), new_loss, new_g
        if done:
            break
        if s @ y > 1e-12:
            past = [*past, (s, y)][-10:]
    return w


def learn(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list, float, np.ndarray]:
    """(features, share of toxic texts, weights): all that scoring needs, of bounded size.

    ``keep`` tells the documents to learn from.  Equal texts count once, with the label of most of their
    rows (half: toxic); null ids and ids without a label have none.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.coalesce(keep, F.lit(False))).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    told = labels.groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col)).alias("y")).filter("id is not null and y is not null")
    heads = settle(rows.select("id", "h").join(told, "id").groupBy("h").agg((F.avg("y") >= 0.5).cast("int").alias("toxic")), "labelled")
    n, toxic = heads.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    base = (toxic + 1) / (n + 10)
    one = rows.select("h", "text").dropDuplicates(["h"]).join(heads, "h")  # copies fold before texts move
    entries = chosen(associations(one.select("text", "toxic")), toxic, n)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(entries, base)
        for b in batches:
            out = [reader.inputs(t) if taken else (reader.read(t)[0], None, None) for t, taken in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            at, values = pa.array([x[1] for x in out], pa.list_(pa.int32())), pa.array([x[2] for x in out], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.int64()), at, values], names=["h", "votes", "at", "values"])

    texts = rows.select(F.approx_count_distinct("h")).first()[0]
    line = int(min(1.0, 0.9 * SAMPLE / max(texts, 1)) * ((1 << 32) - 1))
    taken = F.pmod(F.xxhash64("h"), F.lit(1 << 32)) <= line
    with arrow_batches(spark, 256):
        voted = settle(rows.select("h", "text", taken.alias("taken")).mapInArrow(read, "h long, votes long, at array<int>, values array<double>"), "votes")
    given = heads.select("h", F.col("toxic").cast("long").alias("given"))
    each = voted.select("h", "votes").distinct().join(given, "h", "left").withColumn("given", F.coalesce("given", F.lit(-1).cast("long")))
    vectors = settle(each.groupBy("votes", "given").agg(F.count("*").alias("n")), "vectors")
    model = estimate(vectors, base)
    sample = voted.filter("at is not null").dropDuplicates(["h"]).join(given, "h", "left").orderBy("h").limit(SAMPLE)
    sample = sample.select("votes", F.coalesce("given", F.lit(-1)).alias("given"), "at", "values").collect()  # at most SAMPLE rows of chosen features
    if not sample:
        return entries, base, np.append(np.zeros(FEATURES + VOTERS + 1), math.log(base / (1 - base)))
    posterior = model.posterior(np.array([r.votes for r in sample]), np.array([r.given for r in sample]))
    weights = regression([np.array(r.at, dtype=np.int64) for r in sample], [np.array(r["values"]) for r in sample], posterior)
    return entries, base, weights


def score(docs: DataFrame, learned: tuple[list, float, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row: the classifier's probability of toxic, of the whole text; null counts as empty."""
    entries, base, weights = learned
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, w = Reader(entries, base), weights.tolist()
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                _, at, values = reader.inputs(t)
                m = w[-1] + math.sumprod(map(w.__getitem__, at), values)
                out.append(1 / (1 + math.exp(-max(-60.0, min(60.0, m)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["id", "score"])

    with arrow_batches(docs.sparkSession, 256):
        out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, score double")
        return settle(out, "toxicity").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, score) per row, learned from the documents that ``keep`` tells.

    Scores depend on the text alone.  Repeated rows are kept; an empty table gives an empty result;
    without labels the fixed voters decide; null labels and ids do not count; other columns are ignored.
    """
    return score(docs, learn(docs, labels, keep, id_col, text_col, label_col), id_col, text_col)
