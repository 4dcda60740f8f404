"""Language-model scores: a causal self-attention model over subword ids, trained in numpy.

P(token | context) = P(group | h) * P(member | h, group) * P(token | leaf).  ``h`` is the sum of the
last subword's embedding and of a single-head causal attention over the embeddings of the window.
Frequent tokens have a leaf (group, member) of their own; the rest share leaves by word-end mark and
frequency band, and their shares inside a leaf come from counts over all training documents.

Training sees every distinct training text whole.  Texts are cut into pieces, and pieces are dealt by
a hash of the text into units of a bounded number of tokens, which grow in number with the corpus.
In each round the next part of the units is trained on, every unit from the same weights, and the
moves are averaged by occurrences as whole numbers.  A unit is one row of a stored table, sorted
inside, so the weights do not depend on partitions, tasks or retries.

Scoring cuts a document into overlapping windows; each token is scored once, with at least LEAD
tokens of context (start marks before the document).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm import subwords
from lodestack.scratch import arrow_batches, setting, settle

DIM = GROUPS = SUBS = 16
LEAVES, SINGLE = GROUPS * SUBS, 192
WINDOW, STEP = 24, 18
#: Positions of a window that only give context.
LEAD = WINDOW - STEP
#: Windows of a document that are scored together, and windows in a gradient step.
BATCH, STEP_BATCH = 128, 192
ROUNDS, RATE = 4, 0.03
#: Tokens of a piece of a text, and mean tokens of a training unit.
PIECE, UNIT = 1 << 15, 1 << 19
END = 2
#: Words whose counts are handed to every task; all others go through a join.
FREQUENT = 1 << 18
F32 = np.float32
_OPEN = np.tril(np.ones((WINDOW, WINDOW), dtype=F32))
_ONES = np.ones(max(BATCH, STEP_BATCH) * WINDOW, dtype=F32)
_EYE = np.eye(GROUPS, dtype=F32)
#: Where each row of a flat array with 16 columns begins.
_ROWS = np.arange(len(_ONES)) * DIM


def shapes(vocabulary: int) -> dict[str, tuple[int, int]]:
    """Shapes of the weights; all have DIM columns.  The last embedding is that of the start."""
    return {"emb": (vocabulary + 1, DIM), "pos": (WINDOW, DIM), "wa": (DIM, DIM), "wo": (DIM, DIM), "wg": (DIM, GROUPS), "bg": (1, GROUPS), "gate": (GROUPS, DIM), "ws": (DIM, SUBS), "bs": (GROUPS, SUBS)}


def forward(w: dict[str, np.ndarray], x: np.ndarray, g: np.ndarray, s: np.ndarray, first: int = 0) -> tuple:
    """``leaf_logs`` of windows (B, WINDOW) of input tokens ``x``."""
    e = w["emb"].take(x, axis=0)
    e += w["pos"]
    return leaf_logs(w, e, g, s, first)


@np.errstate(over="ignore", invalid="ignore")
def leaf_logs(w: dict[str, np.ndarray], e: np.ndarray, g: np.ndarray, s: np.ndarray, first: int = 0, held: bool = False) -> tuple:
    """Natural log-probabilities of the leaves (g, s), flat, for positions from ``first`` on.

    ``e`` has windows (B, WINDOW, DIM) of embeddings with their places added.  One matrix stands for the
    product of query and key projections, and the embeddings themselves are keys and values.  Exponents
    are ``held`` within bounds only where sums and logarithms show that some lie outside.
    """
    n = len(e)
    own = np.ascontiguousarray(e[:, first:]).reshape(-1, DIM)
    q = own @ w["wa"]
    a = q.reshape(n, -1, DIM) @ e.transpose(0, 2, 1)
    if held:
        np.minimum(a, 60, out=a)
    np.exp(a, out=a)
    a *= _OPEN[first:]
    sums = a.reshape(-1, WINDOW) @ _ONES[:WINDOW]
    sums += F32(1e-30)
    a /= sums.reshape(n, -1, 1)
    c = (a @ e).reshape(-1, DIM)
    h = c @ w["wo"]
    h += own
    pg = h @ w["wg"]
    lines = pg.reshape(-1, (WINDOW - first) * GROUPS)  # long rows add faster than short ones
    lines += np.concatenate([w["bg"][0]] * (WINDOW - first))
    if held:
        pg.clip(-40, 40, out=pg)
    gate = w["gate"].take(g, axis=0)
    hg = h * gate
    ps = hg @ w["ws"]
    ps += w["bs"].take(g, axis=0)
    if held:
        ps.clip(-40, 40, out=ps)
    at_g, at_s = _ROWS[: len(h)] + g, _ROWS[: len(h)] + s
    z, zs = pg.take(at_g), ps.take(at_s)
    np.exp(pg, out=pg)
    np.exp(ps, out=ps)
    tg, ts = pg @ _ONES[:GROUPS], ps @ _ONES[:SUBS]
    if not held and n:
        # what an exponent below -40 adds to such sums is less than their last bit
        low, high = np.minimum.reduce, np.maximum.reduce
        fine = high(sums) < 1e26 and high(tg) < 2e17 and high(ts) < 2e17 and low(tg) > 1e-7 and low(ts) > 1e-7 and low(z) > -40 and low(zs) > -40
        if not fine:
            return leaf_logs(w, e, g, s, first, True)
    z += zs
    z -= np.log(tg * ts)
    return z, (pg, ps, tg, ts, h, gate, hg, c, a, e, q, at_g, at_s)


def gradients(w: dict[str, np.ndarray], x: np.ndarray, g: np.ndarray, s: np.ndarray, mask: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the mean negative log-probability where ``mask`` is set.

    ``emb`` has rows only for the input tokens that occur, which come second."""
    n = len(x)
    _, (pg, ps, tg, ts, h, gate, hg, c, a, e, q, at_g, at_s) = forward(w, x, g, s)
    m = mask.reshape(-1).astype(F32)
    m /= max(F32(1), m.sum())
    one = _ONES[: len(h)]
    pg *= (m / tg)[:, None]
    pg.reshape(-1)[at_g] -= m
    ps *= (m / ts)[:, None]
    ps.reshape(-1)[at_s] -= m
    hot = _EYE.take(g, axis=0).T
    out = {"wg": h.T @ pg, "bg": (one @ pg)[None], "ws": hg.T @ ps, "bs": hot @ ps}
    d = ps @ w["ws"].T
    h *= d
    out["gate"] = hot @ h
    d *= gate
    d += pg @ w["wg"].T
    out["wo"] = c.T @ d
    dc = d @ w["wo"].T
    c *= dc
    back = (c @ _ONES[:DIM]).reshape(n, WINDOW, 1)
    dc = dc.reshape(n, WINDOW, DIM)
    de = a.transpose(0, 2, 1) @ dc
    da = dc @ e.transpose(0, 2, 1)
    da -= back
    da *= a
    de += da.transpose(0, 2, 1) @ q.reshape(n, WINDOW, DIM)
    dq = (da @ e).reshape(-1, DIM)
    out["wa"] = e.reshape(-1, DIM).T @ dq
    de = de.reshape(-1, DIM)
    de += dq @ w["wa"].T
    de += d
    out["pos"] = (_ONES[:n] @ de.reshape(n, -1)).reshape(WINDOW, DIM)
    order = np.argsort(x, axis=None, kind="stable")
    seen = x.reshape(-1).take(order)
    first = np.concatenate([[0], np.flatnonzero(seen[1:] != seen[:-1]) + 1])
    out["emb"] = np.add.reduceat(de.take(order, axis=0), first, axis=0)
    return out, seen[first]


def training_windows(ids: np.ndarray, before: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, targets) of windows side by side, the first of which begins LEAD tokens early.

    ``before`` is the input of the first token, ``start`` stands for what lies before it.  Targets
    outside of the sequence are -1; each one inside occurs once."""
    count = -(-(LEAD + len(ids)) // WINDOW)
    x, y = np.zeros(count * WINDOW, dtype=ids.dtype), np.full(count * WINDOW, -1, dtype=np.int32)
    x[:LEAD], x[LEAD], x[LEAD + 1 : LEAD + len(ids)] = start, before, ids[:-1]
    y[LEAD : LEAD + len(ids)] = ids
    return x.reshape(count, WINDOW), y.reshape(count, WINDOW)


def leaf_map(counts: np.ndarray, ends_word: np.ndarray) -> np.ndarray:
    """Leaf of each token id: the SINGLE most frequent alone, the rest by word end and band."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    out = np.zeros(len(counts), dtype=np.int64)
    out[order[:SINGLE]] = np.arange(min(SINGLE, len(counts)))
    half = (LEAVES - SINGLE) // 2
    for end in (0, 1):
        rest = order[SINGLE:][ends_word[order[SINGLE:]] == end]
        if len(rest):
            mass = np.cumsum(counts[rest] + 0.5)
            out[rest] = SINGLE + end * half + np.minimum(half - 1, (mass / mass[-1] * half).astype(np.int64))
    return out


class Model:
    """All that scoring needs: leaf of each token, log share inside its leaf, weights."""

    def __init__(self, counts: np.ndarray, ends_word: np.ndarray, seed: int = 5):
        leaf = leaf_map(counts, ends_word)
        self.group, self.member = leaf // SUBS, leaf % SUBS
        total = np.bincount(leaf, weights=counts, minlength=LEAVES)
        members = np.bincount(leaf, minlength=LEAVES)
        self.inside = np.log((counts + 0.5) / (total + 0.5 * members)[leaf])
        rng = np.random.default_rng(seed)
        self.weights = {k: (rng.standard_normal(s) * (0.3 if k == "emb" else 0.15)).astype(F32) for k, s in shapes(len(counts)).items()}
        self.weights["gate"] += 1
        share = (total + 0.5).reshape(GROUPS, SUBS)
        self.weights["bg"] = np.log(share.sum(axis=1) / share.sum()).astype(F32)[None]
        self.weights["bs"] = np.log(share / share.sum(axis=1, keepdims=True)).astype(F32)

    def rows(self) -> np.ndarray:
        """The weights as new rows of DIM numbers, embeddings first."""
        return np.concatenate([self.weights[k] for k in shapes(len(self.group))])

    def set_rows(self, rows: np.ndarray) -> None:
        """Take the weights from such rows, as views if they have single precision."""
        at = 0
        for k, s in shapes(len(self.group)).items():
            self.weights[k] = rows[at : at + s[0]].astype(F32, copy=False)
            at += s[0]

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each document's ids (16 bits each, end included, none empty).

        A window scores its last STEP positions; a document's windows are computed on their own, since
        the last bit of a matrix product depends on a row's place in it."""
        out, emb, pos, start = np.zeros(len(docs)), self.weights["emb"], self.weights["pos"], len(self.group)
        for i, ids in enumerate(docs):
            total = 0.0
            for at in range(0, len(ids), STEP * BATCH):
                own, seen = ids[at : at + STEP * BATCH], ids[max(0, at - LEAD - 1) : at]
                n, lead = -(-len(own) // STEP), LEAD + 1
                x = np.full(lead + n * STEP, start)
                x[lead - len(seen) : lead], x[lead : lead + len(own)], x[lead + len(own) :] = seen, own, 0
                y, rows = x[lead:], emb.take(x[:-1], axis=0)
                # windows overlap: each is a view of the rows from its first on
                e = np.ndarray((n, WINDOW, DIM), F32, rows, strides=(STEP * rows.strides[0], *rows.strides)) + pos
                got = leaf_logs(self.weights, e, self.group.take(y), self.member.take(y), LEAD)[0] + self.inside.take(y)
                total += got[: len(own)].sum()
            out[i] = total
        return out / np.log(10)

    def fit(self, pieces: list[tuple[np.ndarray, int]], rate: float, seed: int = 0) -> int:
        """Adam steps over all windows of (ids, input before them); returns the number of targets."""
        parts = [training_windows(d, p, len(self.group)) for d, p in pieces]
        inputs, targets = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.random.default_rng(seed).permutation(len(inputs))
        w = self.rows()
        self.set_rows(w)  # all weights are one array, so that a step is one
        m, v, kinds = np.zeros_like(w), np.zeros_like(w), list(shapes(len(self.group)))
        rest = np.arange(len(self.weights["emb"]), len(w))
        for step, lo in enumerate(range(0, len(order), STEP_BATCH), 1):
            some = order[lo : lo + STEP_BATCH]
            y = targets.take(some, axis=0).reshape(-1)
            grad, met = gradients(self.weights, inputs.take(some, axis=0), self.group.take(y), self.member.take(y), y >= 0)
            r = F32(rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step))
            at, d = np.concatenate([met, rest]), np.concatenate([grad[k] for k in kinds])  # embeddings move where their token occurs
            mk, vk, wk = (z.take(at, axis=0) for z in (m, v, w))
            mk *= F32(0.9)
            mk += F32(0.1) * d
            vk *= F32(0.99)
            d *= d
            d *= F32(0.01)
            vk += d
            m[at], v[at] = mk, vk
            np.sqrt(vk, out=vk)
            vk += F32(1e-6)
            mk *= r
            mk /= vk
            wk -= mk
            w[at] = wk
        return sum(len(d) for d, _ in pieces)


def flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch of texts, A-Z lower-cased, as one binary array, and the text of each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten().cast(pa.binary())
    own = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty word
    return words.filter(some), own[some.to_numpy(zero_copy_only=False)]


def word_counts(train: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, c) over all rows: words of every whole text, without end marks."""
    def run(batches):
        def out(held):
            got = pa.chunked_array(held, pa.binary()).value_counts()
            return pa.RecordBatch.from_arrays([got.field("values"), got.field("counts")], names=["word", "c"])

        held, size = [], 0
        for b in batches:
            held.append(flat_words(b.column(0))[0])
            size += len(held[-1])
            if size > 4_000_000:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    return train.select(F.col(text_col).alias("t")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(words: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The words of the highest counts, at most ``most``: all from a threshold on.

    The threshold comes from a histogram over sixteenths of powers of two, which has some hundred
    rows, so no part of the word table is sorted or gathered to find it."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    total, least = 0, None
    for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        total += r.n
        if total > most:
            break
        least = r.step
    return words.filter(step >= least) if least is not None else words.limit(0)


def together(batches: Iterable[pa.RecordBatch], size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes, or one given batch if that is larger."""
    held = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if rest := pa.Table.from_batches(held).combine_chunks().to_batches() if held else []:
        yield rest[0]


def text_ids(memo: subwords.Memo, texts: pa.Array, coded: pa.DictionaryArray, own: np.ndarray) -> list[bytes]:
    """Subword ids of each text, whose words are ``coded``, with the text of each in ``own``."""
    at, data = np.concatenate([[0], np.cumsum(pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False))]).tolist(), b""
    if at[-1]:
        data = coded.dictionary.buffers()[2].to_pybytes()
    runs = pa.array([memo[data[a:b]] for a, b in zip(at, at[1:], strict=False)], pa.binary()).take(coded.indices)
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(runs).to_numpy(zero_copy_only=False))])
    cuts = ends[np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(texts)))])].tolist()
    joined = b"" if not cuts[-1] else runs.buffers()[2].to_pybytes()  # the ids of all words in a row
    out = [joined[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    for i, t in enumerate(texts.to_pylist()):
        if memo.literal(t):
            out[i] = memo.ids(t)
    return out


def encode(docs: DataFrame, words: DataFrame, n_docs: int, path: str) -> DataFrame:
    """Rows (id, train, t) with their subword ids and their part of the base score, stored.

    ``base`` lacks the gain of the words in ``rare``, whose counts are not handed to the tasks."""
    spark = docs.sparkSession
    got = frequent_words(words).toPandas()  # at most FREQUENT words
    shared = spark.sparkContext.broadcast((pa.array(map(bytes, got["word"]), pa.binary()), np.append(np.log10(got["c"].to_numpy(dtype=float) + 0.5), np.log10(0.5))))
    ended = float(np.log10(n_docs + 0.5))

    def run(batches):
        (known, logs), memo = shared.value, subwords.memo(path)
        mark = np.array([END], dtype="<u2").tobytes()
        uid = TaskContext.get().partitionId() << 40
        for b in together(batches):
            n = b.num_rows
            words, own = flat_words(b.column(2))
            coded = words.dictionary_encode()  # what a word costs is paid once a batch
            distinct, code = coded.dictionary, coded.indices.to_numpy()
            ids = [x + mark for x in text_ids(memo, b.column(2), coded, own)]
            at = pc.index_in(distinct, known).fill_null(-1).to_numpy(zero_copy_only=False)[code]
            base = ended + np.bincount(own, weights=logs[at], minlength=n)
            hits = np.bincount(own[at >= 0], minlength=n) + int(n_docs > 0)
            # the rest, each word of a text once with its number
            pairs, times = np.unique(own[at < 0] * max(1, len(distinct)) + code[at < 0], return_counts=True)
            ends = np.concatenate([[0], np.cumsum(np.bincount(pairs // max(1, len(distinct)), minlength=n))])
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), distinct.take(pa.array(pairs % max(1, len(distinct)))))
            times = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(times, pa.int32()))
            sizes = np.bincount(own, minlength=n) + 1
            keys = [hashlib.md5(x).digest() for x in ids]
            columns = [np.arange(uid, uid + n), b.column(0), b.column(1), sizes, hits, base, rare, times, pa.array(keys, pa.binary()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["uid", "id", "train", "n_tokens", "n_known", "base", "rare", "times", "key", "ids"])
            uid += n

    kind = dict(docs.dtypes)["id"]
    with arrow_batches(spark, 512):
        return settle(docs.mapInArrow(run, f"uid long, id {kind}, train boolean, n_tokens long, n_known long, base double, rare array<binary>, times array<int>, key binary, ids binary"), "encoded")


def token_counts(ids: DataFrame) -> np.ndarray:
    """Counts of subword ids over rows of ``ids`` (one binary column)."""
    def run(batches):
        total, none = np.zeros(1 << 16, dtype=np.int64), np.zeros(0, dtype="<u2")
        for b in batches:
            held = []
            for x in b.column(0).to_pylist():
                held.append(np.frombuffer(x, dtype="<u2"))
            total += np.bincount(np.concatenate([none, *held]), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["token", "n"])

    out = np.zeros(1 << 16, dtype=np.int64)
    with arrow_batches(ids.sparkSession, 256):
        for r in ids.mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
            out[r.token] = r.n  # at most 65536 rows
    return out


def training_units(train: DataFrame, tokens: int) -> DataFrame:
    """(round, unit, pieces): the distinct pieces of (key, ids) rows, sorted inside each unit.

    A piece is the key, its number in 4 bytes, and its ids; all but a text's first begin with the id
    before them.  Equal texts are one text, so copies neither crowd a unit nor count twice.
    """
    units = ROUNDS * max(1, -(-tokens // (ROUNDS * UNIT)))
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("ids") / 2 - 1) / PIECE).cast("int")))
    rows = train.select("key", "ids", piece.alias("i"))
    lead = F.when(F.col("i") > 0, 1).otherwise(0)
    part = F.substring(F.col("ids"), (F.col("i") * PIECE - lead) * 2 + 1, (F.lit(PIECE) + lead) * 2)
    rows = rows.select(F.pmod(F.xxhash64("key", "i"), F.lit(units)).cast("int").alias("unit"), F.concat("key", F.unhex(F.lpad(F.hex("i"), 8, "0")), part).alias("piece"))
    rows = rows.groupBy("unit").agg(F.array_sort(F.collect_set("piece")).alias("pieces"))
    # few bytes but much work: as many tasks as the shuffle has partitions, not as bytes would give
    with setting(train.sparkSession, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        return settle(rows.select((F.col("unit") % ROUNDS).alias("round"), "unit", "pieces"), "units")


def train_model(units: DataFrame, counts: np.ndarray, path: str) -> Model:
    """Fit the weights on all training units, in ROUNDS rounds of local steps and averaging.

    A round averages the units' moves by targets, and an embedding's by its token's occurrences."""
    spark = units.sparkSession
    tokenizer = subwords.memo(path).tokenizer
    size = tokenizer.get_vocab_size()
    ends = np.zeros(size, dtype=np.int64)
    for token, i in tokenizer.get_vocab().items():
        ends[i] = token.endswith("</w>")
    model = Model(counts[:size], ends)
    parts = [f"v{i}" for i in range(DIM)]
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)
        rate = RATE * (1 - 0.8 * r / ROUNDS)

        def run(batches, shared=shared, rate=rate):
            import copy

            start = shared.value.rows().astype(np.float64)
            n, moved = np.zeros(len(start), dtype=np.int64), np.zeros(start.shape, dtype=np.int64)
            for b in batches:
                for unit, pieces in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    mine, docs = copy.copy(shared.value), []
                    mine.weights = {k: a.copy() for k, a in mine.weights.items()}
                    for p in pieces:
                        ids, lead = np.frombuffer(p, dtype="<u2", offset=20), int(any(p[16:20]))
                        docs.append((ids[lead:], int(ids[0]) if lead else size))
                    seen = np.bincount(np.concatenate([d for d, _ in docs]), minlength=size)
                    total = mine.fit(docs, rate, unit)
                    times = np.concatenate([seen, np.full(len(start) - size, total)])
                    met = np.flatnonzero(times)
                    moved[met] += np.round((mine.rows()[met] - start[met]) * (1 << 20)).astype(np.int64) * times[met, None]
                    n += times
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), *[pa.array(c) for c in np.ascontiguousarray(moved[at].T)]], names=["i", "n", *parts])

        with arrow_batches(spark, 4):
            sums = units.filter(F.col("round") == r).select("unit", "pieces").mapInArrow(run, "i int, n long, " + ", ".join(f"{c} long" for c in parts)).groupBy("i")
            sums = sums.agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in parts])
            got = sums.select("i", *[(F.col(c).cast("double") / F.col("n") / (1 << 20)).alias(c) for c in parts]).toPandas()
        if len(got):  # at most as many rows as the model has
            rows = model.rows().astype(np.float64)
            rows[got["i"].to_numpy()] += got[parts].to_numpy()
            model.set_rows(rows)
    return model


def score(docs: DataFrame, is_train: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``is_train`` picks the rows to learn from (null counts as not held out and not learned from).
    Null texts count as empty: one end token.  base_score is the smoothed log10 unigram probability
    of words and end; score is the model's log10 probability of all subwords and the end id, to six
    decimals.  Equal texts get equal scores, whatever the partitions.
    """
    spark = docs.sparkSession
    path = vocabulary or subwords.default_path()
    rows = docs.select(F.col(id_col).alias("id"), is_train.alias("train"), F.col(text_col).alias("t"))
    train = rows.filter("train")
    n_docs = train.count()
    with arrow_batches(spark, 256):
        words = settle(word_counts(train, "t"), "words")
    v, n = words.agg(F.count("*"), F.sum("c")).first()
    v, n = v + (n_docs > 0), (n or 0) + n_docs
    encoded = encode(rows, words, n_docs, path)
    learn = encoded.filter("train")
    counts = token_counts(learn.select("ids"))
    model = train_model(training_units(learn, int(counts.sum())), counts, path)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            got = shared.value.score([np.frombuffer(x, dtype="<u2") for x in b.column(5).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], b.column(6), pa.array(np.round(got, 6))], names=[*b.schema.names[:5], "base", "score"])

    kind = dict(encoded.dtypes)["id"]
    with arrow_batches(spark, 256):
        scored = encoded.select("uid", "id", "train", "n_tokens", "n_known", "ids", "base").mapInArrow(run, f"uid long, id {kind}, train boolean, n_tokens long, n_known long, base double, score double")
        scored = settle(scored, "scored")
    each = encoded.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("uid", F.col("r.rare").alias("word"), F.col("r.times").alias("k"))
    gain = each.join(words, "word").groupBy("uid").agg(F.sum("k").alias("found"), F.sum(F.col("k") * (F.log10(F.col("c") + 0.5) - float(np.log10(0.5)))).alias("gain"))
    out = scored.join(gain, "uid", "left")
    base = F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))
    return out.select(F.col("id").alias(id_col), (~F.coalesce("train", F.lit(True))).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
