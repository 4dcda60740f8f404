"""The near-duplicate stage against all pairs of texts, with no candidate rule in between."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from lodestack.llm import simhash


def shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def alike_pairs(texts):
    """Every pair (a, b), a < b, of different texts with a similarity of 0.8 or more, by an inverted index."""
    sets = {k: shingles(t) for k, t in texts.items() if (t or "").split()}
    at = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            at[x].append(k)
    common = defaultdict(int)
    for ks in at.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                common[min(a, b), max(a, b)] += 1
    return {p for p, n in common.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}


def grouped(spark, texts):
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    rows, groups = simhash.similar_rows(frame)
    return {r.doc_id: r.group for r in rows.join(groups, "row").select("doc.doc_id", "group").collect()}


def test_recall_over_all_pairs(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    rng = random.Random(4)
    for d in rng.sample(sorted(texts), 150):  # more near copies, by changed words
        ws = (texts[d] or "").split()
        for _ in range(len(ws) // 60):
            ws[rng.randrange(len(ws))] = f"changed{rng.randrange(9)}"
        texts[100_000 + d] = " ".join(ws)
    pairs = {p for p in alike_pairs(texts) if texts[p[0]] != texts[p[1]]}
    got = grouped(spark, texts)
    found = sum(got[a] == got[b] for a, b in pairs)
    assert len(pairs) > 100 and found >= 0.9 * len(pairs), (found, len(pairs))
    linked = defaultdict(set)
    for a, b in alike_pairs(texts):
        linked[a].add(b)
        linked[b].add(a)
    members = defaultdict(set)
    for d, g in got.items():
        members[g].add(d)
    same = lambda a, b: (texts[a] or "").lower().split() == (texts[b] or "").lower().split()
    for ds in members.values():  # nothing is put together without a chain of alike or equal texts
        seen, todo = set(), [min(ds)]
        while todo:
            d = todo.pop()
            if d not in seen:
                seen.add(d)
                todo += [x for x in ds if x not in seen and (x in linked[d] or same(x, d))]
        assert seen == ds


def swapped(words, at):
    out = list(words)
    out[at], out[at + 1] = out[at + 1], out[at]
    return " ".join(out)


def test_a_third_text_undoes_no_link(spark):
    """B and C are alike; texts of the same words in any other order must not part them."""
    words = [f"w{i}" for i in range(200)]
    pair = {1: " ".join(words), 2: swapped(words, 100)}
    assert len(set(grouped(spark, pair).values())) == 1
    rng = random.Random(0)
    texts = dict(pair)
    for i in range(3, 15):
        other = words[:]
        rng.shuffle(other)
        texts[i] = " ".join(other)
    got = grouped(spark, texts)
    assert got[1] == got[2] and len(set(got.values())) == len(texts) - 1


def test_more_rows_never_undo_a_link(spark):
    rng = random.Random(7)
    base = [[f"{c}{i}" for i in range(120)] for c in "abc"]
    texts = {}
    for i in range(90):
        ws = list(base[i % 3])
        for _ in range(rng.randrange(4)):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(1000)}"
        texts[i] = " ".join(ws)
    few = {k: texts[k] for k in range(45)}
    before, after = grouped(spark, few), grouped(spark, texts)
    assert all(after[a] == after[b] for a in few for b in few if before[a] == before[b])


def test_groups_of_near_copies_of_any_size_are_exact(spark):
    """Buckets far over 24 fingerprints: three hundred copies of one text with a changed word each, all alike;
    beside them copies of the same words in an order of their own, which are not."""
    words = [f"w{i}" for i in range(100)]
    texts = {i: " ".join(words[: i % 100] + [f"v{i}"] + words[i % 100 + 1 :]) for i in range(300)}
    rng = random.Random(1)
    for i in range(300, 340):
        other = words[:]
        rng.shuffle(other)
        texts[i] = " ".join(other)
    fps = {f for t in texts.values() for f in [simhash.family_fingerprints(t)[0]]}
    assert len(fps) > simhash.BUCKET
    got = grouped(spark, texts)
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in alike_pairs(texts):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    whole = {k: root(k) for k in texts}
    parts = lambda g: sorted(sorted(k for k in g if g[k] == v) for v in set(g.values()))
    assert parts(got) == parts(whole) and len(set(got.values())) >= 41


def test_links_within_groups_are_all_pairs_by_brute_force(spark):
    """Random sets in given groups, chains among them: the exact join against all pairs."""
    rng = np.random.default_rng(3)
    sets, group = {}, {}
    for g in range(4):
        core = rng.integers(0, 1 << 60, 40)
        for i in range(60):
            keep = core[rng.random(40) < (0.97 if i % 2 else 0.85)]
            sets[g * 100 + i] = sorted({*keep.tolist(), *rng.integers(0, 1 << 60, rng.integers(0, 6)).tolist()})
            group[g * 100 + i] = g % 3  # two cores share a group
    frame = spark.createDataFrame([(k, len(s), s) for k, s in sets.items()], "node long, n long, s array<long>")
    held = spark.createDataFrame(list(group.items()), "node long, group long")
    labels = {r.node: r.label for r in simhash.components(simhash.verified_links(held, frame)).collect()}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and group[a] == group[b]:
                i = len({*sets[a]} & {*sets[b]})
                if i >= 0.8 * (len(sets[a]) + len(sets[b]) - i):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    assert {k: labels.get(k, k) for k in sets} == {k: root(k) for k in sets}
    assert frame.filter(F.col("n") > 0).count() == len(sets)


def test_edited_copies_of_one_text_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Four hundred sets around one, most too far from it to be alike, and a few twins among them: as many
    links as by brute force, and compared pairs that do not grow with the square of the group."""
    rng = np.random.default_rng(8)
    core = rng.integers(0, 1 << 60, 150)
    sets = {}
    for i in range(400):
        own = core[: rng.integers(130, 151)].copy()
        at = rng.choice(len(own), rng.integers(5, 45), replace=False)
        own[at] = rng.integers(0, 1 << 60, len(at))
        sets[i] = sorted({*own.tolist()})
        if i % 40 == 0:
            sets[1000 + i] = sorted({*sets[i][3:], i})
    compared, alike = [], simhash.alike

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return alike(pairs, *rest)

    monkeypatch.setattr(simhash, "alike", counted)
    frame = spark.createDataFrame([(k, len(s), s) for k, s in sets.items()], "node long, n long, s array<long>")
    held = frame.select("node", F.lit(0).cast("long").alias("group"))
    labels = {r.node: r.label for r in simhash.components(simhash.verified_links(held, frame)).collect()}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            i = len({*sets[a]} & {*sets[b]}) if a < b else 0
            if i and i >= 0.8 * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {k: labels.get(k, k) for k in sets} == {k: root(k) for k in sets}
    assert sum(compared) < 10 * len(sets), compared
