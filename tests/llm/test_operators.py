"""Each corpus operator against a plain restatement on small tables, and on odd input."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from lodestack.llm import language, lm, media, mixing, packing, pii, rans, registry, search, sharding, simhash, subwords, tokenfiles
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


# op1


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, p) in enumerate(BASE.items()):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_pii_base_is_the_plain_rule(spark, docs, texts):
    tricky = ["a@b.c_d@e.f.g", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.0003.4", "+1 (743) 555-3824, +12 345", "4111 1111 1111 1111 4111-1111-1111-1112 5", "é😀 x@y.zz é +44 20 7946 0958.", "..a@b.c@d.e", "99.1.2.3.4@a.b", "1 2 3 4 5 6 7 8 9 0 1 2 3 7"]
    frame = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(tricky)], "doc_id long, text string")
    got = pii.digest(pii.extract(docs.select("doc_id", "text").unionByName(frame))).collect()
    every = texts | {10_000 + i: t for i, t in enumerate(tricky)}
    assert len(got) == len(every)
    for r in got:
        base = plain_spans(every[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), every[r.doc_id][:200]
        assert set(base) <= set(r.spans.split(",")) or not base
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in base) for k in BASE]


def test_pii_discovers_by_context_and_leaves_others_alone(spark):
    seeds = [(i, f"please write to mailbox: user{i}@example{i}.org today") for i in range(12)]
    hidden = [(100, "and the mailbox: someone42@localhost is not matched by the base"), (101, "the price of 42420001 apples"), (102, "nothing")]
    frame = spark.createDataFrame(seeds + hidden, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.digest(pii.extract(frame)).collect()}
    assert found[100].spans == "email:17:36" and found[100].n_email == 0
    assert found[101].spans == "" and found[102].spans == ""
    text = {r.doc_id: r.text for r in pii.redact(frame, pii.extract(frame)).collect()}
    assert text[0] == "please write to mailbox: <EMAIL> today" and text[100].startswith("and the mailbox: <EMAIL> is") and text[102] == "nothing"


def plain_beliefs(edges, least=pii.LEAST_SEEDS):
    """{value: kind} by sets and loops; edges are (pattern, value, rank, seed)."""
    of = defaultdict(dict)
    for p, v, rank, seed in edges:
        of[p][v] = (rank, seed)
    known = {}
    while True:
        trust = {}
        for p, vs in of.items():
            for k in range(len(pii.ALL)):
                c = sum(k == (r if r is not None else known.get(v, s)) for v, (r, s) in vs.items())
                if c >= least and c / (len(vs) + 1) >= pii.TRUST:
                    trust[p, k] = c / (len(vs) + 1)
        new = {}
        for v in {v for vs in of.values() for v, (r, _) in vs.items() if r is None} - set(known):
            best = []
            for k, name in enumerate(pii.ALL):
                doubt = math.prod(1 - trust.get((p, k), 0) for p, vs in of.items() if v in vs)
                if re.search(pii.SHAPES[name], v) and 1 - doubt >= pii.ACCEPT:
                    best.append((1 - doubt, -k))
            if best:
                new[v] = -max(best)[1]
        if not new:
            return known
        known |= new


def test_beliefs_are_the_plain_ones(spark):
    rng = np.random.default_rng(3)
    values = [f"+1 55501{i:05}" if i % 3 else f"{i:012}x" for i in range(120)]
    edges = {}
    for v in values:
        rank = int(rng.integers(0, 4)) if rng.random() < 0.3 else 3 if rng.random() < 0.4 else None
        seed = None if rank is not None or rng.random() < 0.8 else 4
        for p in rng.choice(24, 3):
            edges[f"word{p} _", v] = (rank, seed)
    for i in range(8):  # a chain: each instance is what makes the next pattern trusted
        for j in range(12):
            edges[f"chain{i} _", f"+44 20 7946 {i + j:04}"] = (3 if i + j < 12 else None, None)
    rows = [(p, v, *x) for (p, v), x in edges.items()]
    got = {r.value: r.kind for r in pii.believed(spark.createDataFrame(rows, "pattern string, value string, rank int, seed int")).collect()}
    want = plain_beliefs(rows)
    assert got == want and sum(v.startswith("+44") for v in want) >= 6


def test_pii_discovers_groups_of_digits_and_secrets(spark):
    rows = [(i, f"You can call our office: +44 20 7946 {1000 + i} (daily), or write.") for i in range(12)]
    rows += [(50 + i, f"the api token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" of host {i}") for i in range(12)]
    hidden = [(100, "You can call our OFFICE: (555) 123-4567 today"), (101, "Call our office (020 7946 0958)."), (102, "api token = 'Zx81-abcDEF_0012345678'"), (103, "a total of 4242 0001 apples"), (104, "commit " + "ab12" * 10)]
    frame = spark.createDataFrame(rows + hidden, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.digest(pii.extract(frame)).collect()}
    text = dict(rows + hidden)
    cut = lambda d: [(x.split(":")[0], text[d][int(x.split(":")[1]) : int(x.split(":")[2])]) for x in found[d].split(",") if x]
    assert cut(100) == [("phone", "(555) 123-4567")] and cut(101) == [("phone", "020 7946 0958")]
    assert cut(102) == [("secret", "Zx81-abcDEF_0012345678")] and cut(103) == cut(104) == []
    assert all(cut(50 + i) == [("secret", hashlib.sha1(str(i).encode()).hexdigest())] for i in range(12))


# op2


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = registry.op2_language_id(spark, "/root/testdata/sf0.01").filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_vectors_are_the_plain_sum():
    text = "Abc, äb!"
    codes = [32 if not c.isalpha() else ord(c) for c in " abc äb "]
    want = sum(np.roll(language.letter_vector(a), 2) * np.roll(language.letter_vector(b), 1) * language.letter_vector(c) for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))
    got, has = language.bundle([text, None, "123", "x"])
    assert np.array_equal(got[0], want) and has.tolist() == [True, False, False, True]


def test_language_predictions_are_the_plain_cosines(spark, docs, texts):
    langs = {r.doc_id: r.lang for r in docs.collect()}
    some = [d for d in sorted(texts) if len(texts[d]) < 3000][:60]

    def vector(text):
        chars = "".join(c if c.isalpha() else " " for c in text.lower())
        chars = [ord(c) for c in (" " + " ".join(chars.split()) + " ")] if chars.split() else []
        out = np.zeros(language.DIM)
        for a, b, c in zip(chars, chars[1:], chars[2:], strict=False):
            out += np.roll(language.letter_vector(a), 2) * np.roll(language.letter_vector(b), 1) * language.letter_vector(c)
        return out

    vectors = {d: vector(texts[d]) for d in some}
    learned = some[:40]
    proto = {k: sum(vectors[d] for d in learned if langs[d] == k) for k in sorted({langs[d] for d in learned if langs[d]})}
    frame = docs.filter(F.col("doc_id").isin(some))
    profiles = language.prototypes(frame.filter(F.col("doc_id").isin(learned)))
    for r in language.identify(frame, profiles).collect():
        cos = {k: float(vectors[r.doc_id] @ p / np.linalg.norm(vectors[r.doc_id]) / np.linalg.norm(p)) for k, p in proto.items()}
        best = max(cos, key=cos.get)
        assert r.lang_pred == best and r.score == pytest.approx(max(0, cos[best]), abs=1e-6)


def test_language_keeps_columns_of_any_name(spark):
    frame = spark.createDataFrame([(1, "the cat and the dog", "en", 0.5, "x")], "doc_id long, text string, lang string, score double, `lang pred` string")
    row = language.identify(frame, language.prototypes(frame), keep=tuple(frame.columns)).first()
    assert (row.kept.score, row.kept["lang pred"], row.lang_pred) == (0.5, "x", "en") and row.score == pytest.approx(1, abs=1e-6)
    assert [tuple(r) for r in simhash.keep_one(frame).collect()] == [tuple(r) for r in frame.collect()]


# op3


def plain_targets(size):
    names = sorted(s for s in size if s is not None) + [s for s in size if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * size[s] if s in full else rest * weight[s] / w for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * size[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == docs.count()
    size, taken = Counter(), Counter()
    for r in got:
        assert r.size == len(WORD.findall(texts[r.doc_id])) and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        size[r.source] += r.size
        taken[r.source] += r.taken
    want = plain_targets(size)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
    for s in size:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s], s


def plain_copies(words, target):
    """Expected copies of each weight, from {weight: words}: the level by bisection."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(n * min(3, mid * w) for w, n in words.items()) < target else (lo, mid)
    return {w: min(3, hi * w) for w in words}


def test_mixing_draws_by_weight(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    weight = lambda n: 1.5 if n >= 1024 else 2.0 if n >= 256 else 1.5 if n >= 64 else 1.0
    words, got, taken, target = defaultdict(Counter), defaultdict(list), Counter(), {}
    for r in mixing.mix(docs).collect():
        words[r.source][weight(r.size)] += r.size
        got[r.source, weight(r.size)].append((r.size, r.copies))
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s in target:
        assert abs(taken[s] - target[s]) <= 0.002 * target[s]
        for w, mean in plain_copies(words[s], target[s]).items():
            rows = [x for x in got[s, w] if x[0]]
            assert all(math.floor(mean + 1e-9) <= c <= math.ceil(mean - 1e-9) for _, c in rows), (s, w, mean)
            spread = math.sqrt((mean % 1) * (1 - mean % 1) / len(rows))
            assert abs(sum(c for _, c in rows) / len(rows) - mean) <= 5 * spread + 0.02, (s, w, mean)


def test_mixing_follows_document_weights(spark):
    rows = [(i, "w " * 10, "a" if i % 2 else "b", 20.0 if i < 200 else 1.0) for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    got = mixing.mix(frame, weight_col="weight", weights=(1, 3)).filter("source = 'b'").collect()
    assert all(r.copies == 3 for r in got if r.doc_id < 200) and {r.copies for r in got if r.doc_id >= 200} == {1, 2}
    assert abs(sum(r.taken for r in got) - got[0].target) <= 10


# op4


def stored_form(body, chunks):
    """The frames of one medium in order, read from the two Parquet tables by the format alone."""
    out, at = b"", 0
    while at < len(body):
        size = int.from_bytes(body[at : at + 4], "big")
        out += body[at : at + 36 + size] if size else chunks[body[at + 4 : at + 36]]
        at += 36 + size
    return out


def test_media_round_trip(spark, docs, texts):
    at_media, at_chunks = media.store(docs.unionByName(docs.limit(20)))
    got = {r.id: r for r in media.read_back(spark, at_media, at_chunks).collect()}
    chunks = {r.digest: r.frame for r in pq.read_table(at_chunks.removeprefix("file://")).to_pandas().itertuples()}
    rows = list(pq.read_table(at_media.removeprefix("file://")).to_pandas().itertuples())
    assert len(rows) == len(texts) + 20 and len(chunks) > 0
    for row in rows:
        payload, n = media.payload_of(texts[row.id])
        stored, r = stored_form(row.body, chunks), got[row.id]
        assert (r.n_bytes, r.payload_bytes) == (row.n_bytes, len(payload)) == (n, len(payload)) and len(payload) % 576 == 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        samples, at = b"", 0
        while at < len(stored):
            size = int.from_bytes(stored[at : at + 4], "big")
            part = stored[at + 36 : at + 36 + size % (1 << 31)]
            part = zstandard.ZstdDecompressor().decompress(part) if size >> 31 else part
            assert hashlib.sha256(part).digest() == stored[at + 4 : at + 36]
            samples, at = samples + part, at + 36 + size % (1 << 31)
        assert samples == payload


def test_chunks_of_shared_passages_are_stored_once(spark, tmp_path):
    rng = np.random.default_rng(0)
    shared = "".join(map(chr, rng.integers(97, 123, 30_000)))
    rows = [(i, "".join(map(chr, rng.integers(97, 123, 3000))) + shared) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    at_media, at_chunks = media.store(frame)
    inline = spark.read.parquet(at_media).agg(F.sum(F.octet_length("body"))).first()[0]
    assert inline < 20 * 8000 and spark.read.parquet(at_chunks).count() < 60
    assert {r.payload_sha256 for r in media.read_back(spark, at_media, at_chunks).collect()} == {hashlib.sha256(media.payload_of(t)[0]).hexdigest() for _, t in rows}


def test_damage_is_noticed():
    c = b"x" * 600
    digest = hashlib.sha256(c).digest()
    assert media._measure(media.frame(c, digest), {})[0] == 600
    for packer in (None, zstandard.ZstdCompressor(level=1)):
        assert media._measure(media.frame(b"", digest), {digest: media.frame(c, digest, packer)})[0] == 600
    for wrong in (media.frame(b"y" * 600, digest), media.frame(b"", digest)):
        with pytest.raises((ValueError, KeyError)):
            media._measure(wrong, {})


# op5


def plain_bm25(texts, query, k):
    tokens = {d: Counter(WORD.findall(lower(t or ""))) for d, t in texts.items()}
    n, mean = len(tokens), sum(sum(c.values()) for c in tokens.values()) / len(tokens)
    df = Counter(w for c in tokens.values() for w in c)
    out = []
    for d, c in tokens.items():
        s = 0
        for w, q in Counter(WORD.findall(lower(query or ""))).items():
            if w in c:
                idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                s += math.floor(idf * q * (c[w] * 2.2) / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) * 1e6 + 0.5)
        if s:
            out.append((-s, d))
    return [(d, -s / 1e6) for s, d in sorted(out)[:k]]


def test_search_is_exact(spark, docs, texts):
    asked = {i: texts[i] for i in (0, 20, 40, 60, 80)} | {900: "the of and", 901: "", 902: "zzzz-not-there"}
    queries = spark.createDataFrame([(i, t) for i, t in asked.items()], "query_id long, text string")
    index = search.build_index(docs.repartition(5))
    got = defaultdict(list)
    for r in search.search(index, queries, 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    for i, t in asked.items():
        want = plain_bm25(texts, t, 7)
        assert [d for d, _ in got[i]] == [d for d, _ in want], i
        assert [s for _, s in got[i]] == pytest.approx([s for _, s in want])


def test_search_takes_ids_of_any_kind(spark):
    docs = spark.createDataFrame([("b", "red fox"), ("a", "red fox"), (None, "red fox"), ("c", "blue fox")], "key string, text string")
    queries = spark.createDataFrame([("q1", "red"), ("q1", "fox"), ("q2", "blue")], "doc_id string, text string")
    got = [(r.doc_id, r["rank"], r.found_id) for r in search.search(search.build_index(docs.coalesce(1), "key"), queries, 3, "doc_id").orderBy("doc_id", "rank").collect()]
    assert got == [("q1", 1, "a"), ("q1", 2, "b"), ("q1", 3, None), ("q2", 1, "c")]


def test_wand_skips_but_stays_exact():
    rng = np.random.default_rng(3)
    dl = rng.integers(5, 400, 20_000).astype(np.int32)
    cursors, brute, scored = [], np.zeros(20_000, dtype=np.int64), []
    for df in (15_000, 9000, 700, 40, 3):
        d = np.sort(rng.choice(20_000, df, replace=False)).astype(np.int32)
        tf = rng.integers(1, 9, df).astype(np.int32)
        at = np.arange(0, df, search.BLOCK)
        idf = math.log(1 + (20_000 - df + 0.5) / (df + 0.5))
        c = search.Cursor(d, tf, np.maximum.reduceat(tf, at), np.minimum.reduceat(dl[d], at), dl, idf, 1, 200.0)
        brute[d] += search.impact(tf.astype(float), dl[d].astype(float), idf, 1, 200.0)
        plain = c.value
        c.value = lambda plain=plain: (scored.append(1), plain())[1]
        cursors.append(c)
    want = sorted(((int(s), -i) for i, s in enumerate(brute) if s), reverse=True)[:10]
    assert search.block_max_wand(cursors, 10) == [(s, -i) for s, i in want]
    assert len(scored) < 6000


# op6


def plain_print(text):
    ws = lower(text or "").encode().split()
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 3]), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, radius=2):
    ids, parent = list(fps), {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_covering_masks_cover_every_pair():
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks()]
    assert len(masks) == 7
    for i in range(64):
        for j in range(i, 64):
            assert any(not m & (1 << i | 1 << j) for m in masks)


def test_simhash_components(spark, docs, texts):
    got = simhash.near_duplicate_groups(docs).collect()
    fps = {d: plain_print(t) for d, t in texts.items()}
    want = plain_components(fps)
    assert {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in got} == {d: (fps[d], want[d]) for d in fps}


def test_large_buckets_and_chains(spark):
    rng = np.random.default_rng(1)
    center = int(rng.integers(0, 1 << 63))
    fps = {center} | {center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (200, 2))}
    chain = [int(rng.integers(0, 1 << 62))]
    for i in range(12):
        chain.append(chain[-1] ^ (3 << (2 * i)))
    fps |= set(chain) | {int(x) for x in rng.integers(0, 1 << 62, 60)}
    named = dict(enumerate(sorted(fps)))
    signed = [(0, f - (1 << 64) if f >> 63 else f) for f in fps]
    labels = {r.node & (1 << 64) - 1: r.label for r in simhash.components(simhash.close_links(spark.createDataFrame(signed, "family int, fp long"))).collect()}
    want = plain_components(named)
    groups, mine = defaultdict(set), defaultdict(set)
    for i, f in named.items():
        groups[want[i]].add(f)
        mine[labels.get(f, f"alone {f}")].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def plain_families(text, families=simhash.FAMILIES):
    ws, full = {*lower(text or "").encode().split()}, (1 << 64) - 1
    hs, out = {xxhash.xxh64_intdigest(w, 42) for w in ws}, []
    for f in range(families):
        mixed = []
        for h in hs:
            x = h * (0x9E3779B97F4A7C15 * (2 * f + 1)) & full
            x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & full
            mixed.append(x ^ x >> 32)
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(mixed)))
    return out


def plain_groups(texts):
    """{key: least key of its group}: keys are linked by equal words, or within two bits in any family
    and by a similarity of 0.8 over five words."""
    words = {k: tuple(lower(t or "").encode().split()) for k, t in texts.items()}
    prints = {k: plain_families(t) for k, t in texts.items()}
    sets = {k: {w[i : i + 5] for i in range(max(1, len(w) - 4))} for k, w in words.items()}
    parent, keys = {k: k for k in texts}, sorted(texts)

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            near = any(bin(x ^ y).count("1") <= 2 for x, y in zip(prints[a], prints[b], strict=True))
            if words[a] == words[b] or (near and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in keys}


def test_similar_rows_are_the_plain_groups(spark, docs, texts):
    rng, more = np.random.default_rng(8), {}
    for d, t in list(texts.items())[:60]:  # near copies by changed words
        ws = t.split()
        for at in rng.integers(0, len(ws), max(1, len(ws) // 60)):
            ws[at] = "changed"
        more[10_000 + d] = " ".join(ws)
    every = texts | more
    frame = spark.createDataFrame(list(every.items()), "doc_id long, text string").repartition(5)
    rows, groups = simhash.similar_rows(frame)
    got = {r.doc_id: r.group for r in rows.join(groups, "row").select("doc.doc_id", "group").collect()}
    want = plain_groups(every)
    mine, theirs = defaultdict(set), defaultdict(set)
    for d in every:
        mine[got[d]].add(d)
        theirs[want[d]].add(d)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))
    assert {r.doc_id for r in simhash.keep_one(frame).collect()} == {min(g) for g in theirs.values()}


# op7


def test_rans_round_trip_and_segments():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.3, 200_000), 49_000).astype(np.uint16)
    table = rans.Table(np.bincount(ids, minlength=1 << 16))
    words, points, sums = rans.encode(ids, table)
    assert np.array_equal(rans.decode(words, points, sums, len(ids), table), ids)
    span = rans.STRIDE * rans.LANES
    assert np.array_equal(rans.decode(words, points, sums, len(ids), table, range(2, 3)), ids[2 * span : 3 * span])
    p = np.bincount(ids) / len(ids)
    assert len(words) < len(ids) * -(p[p > 0] * np.log2(p[p > 0])).sum() / 8 * 1.05
    with pytest.raises(ValueError):
        rans.decode(bytes([words[0] ^ 1]) + words[1:], points, sums, len(ids), table)
    for n in (0, 1, 511, 512, 513):
        small = ids[:n]
        t = rans.Table(np.bincount(small, minlength=1 << 16))
        assert np.array_equal(rans.decode(*rans.encode(small, t), n, t), small)


def test_memo_is_the_library():
    memo = subwords.memo(subwords.default_path())
    plain = memo.tokenizer
    for t in ["The cat's HAT, won't 123 é😀 é İstanbul ΣΑΣ", "a\xa0b\x85c\x1cd　e", "<|endoftext|> x", "ﬁne ²½ KelvinK", "", "don't!!! I'LL we've"]:
        assert np.frombuffer(memo.ids(t), "<u2").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_added_tokens_are_the_library_s(spark):
    from tokenizers import Tokenizer

    fresh, memo = Tokenizer.from_file(subwords.default_path()), subwords.memo(subwords.default_path())
    texts = ["<|endoftext|> x", "a<|startoftext|>B  c", "<|ENDOFTEXT|> x", "É<|EndOfText|>é", "x\u3000<|endoftext|>Y's", "plain"]
    want = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert {49406, 49407} <= {i for ids in want for i in ids}
    assert [np.frombuffer(memo.ids(t), "<u2").tolist() for t in texts] == want
    frame, start = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 0
    got = {r.doc_id: r for r in tokenfiles.token_files(frame).collect()}
    for i, ids in enumerate(want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 2], dtype="<u4").tobytes()))
        start += len(ids) + 1
    rows = frame.select("doc_id", F.lit(True).alias("train"), F.col("text").alias("t")).withColumnRenamed("doc_id", "id")
    coded = lm.encode(rows, lm.word_counts(rows, "t"), len(texts), subwords.default_path())
    assert np.array_equal(lm.token_counts(coded.select("ids")), np.bincount([i for ids in want for i in [*ids, 2]], minlength=1 << 16))


def test_token_files(spark, docs, texts):
    got = {r.doc_id: r for r in tokenfiles.token_files(docs.repartition(6)).collect()}
    plain, start = subwords.memo(subwords.default_path()).tokenizer, 0
    for d in sorted(texts):
        ids = np.array([*plain.encode(texts[d], add_special_tokens=False).ids, 2], dtype="<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


# op8


def test_sharding(spark, docs, texts):
    got = sharding.assign_shards(docs).collect()
    load, slots, place = Counter(), defaultdict(list), {}
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        assert place.setdefault(raw, r.shard) == r.shard
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(load) <= set(range(24))
    largest = max(Counter(t for t in texts.values()).items(), key=lambda x: x[1] * len(x[0].encode()))
    assert max(load.values()) <= 1.1 * max(sum(load.values()) / 24, largest[1] * len(largest[0].encode()))


def test_longest_first_bound():
    items = [(int(x), i) for i, x in enumerate(np.random.default_rng(0).pareto(1.2, 500) * 100 + 1)]
    placed, load = sharding.longest_first(items, 7), Counter()
    for s, i in items:
        load[placed[i]] += s
    best = max(max(s for s, _ in items), sum(s for s, _ in items) / 7)
    assert max(load.values()) <= (4 / 3) * best + 1


# op9


def test_counts_of_words_are_sought_once_for_many_batches(monkeypatch):
    """The table of frequent words is built anew at each look-up, so small batches are put together; large ones stay."""
    import pyarrow as pa

    rows = pa.record_batch({"id": pa.array(range(5000)), "t": pa.array([f"Word{i} don't, été 12a" * (i % 3) for i in range(5000)])})
    small = [rows.slice(i, 512) for i in range(0, 5000, 512)]
    assert [b.equals(rows) for b in lm.together(small)] == [True]
    assert [b.num_rows for b in lm.together(small, 1)] == [b.num_rows for b in small] and not list(lm.together([]))
    memo = subwords.memo(subwords.default_path())
    texts = pa.array([None, "", " \t", "<|endoftext|> It's", "It's 3rd-rate, it'll do!!", "naïve Œuvre ’t 日本 x\u00a0y", "it's", *rows.column(1).to_pylist()[:50]])
    for part in (texts, texts[:3], texts[3:7]):
        words, own = lm.flat_words(part)
        assert lm.text_ids(memo, part, words.dictionary_encode(), own) == [memo.ids(t) for t in part.to_pylist()]


def test_lm_scores(spark, docs, texts):
    got = {r.doc_id: r for r in registry.op9_lm_score(spark, SF).collect()}
    train = [d for d in texts if zlib.crc32(str(d).encode()) % 5 != 1]
    counts = Counter(w for d in train for w in WORD.findall(lower(texts[d])))
    end, n = len(train), sum(counts.values()) + len(train)
    v = len(counts) + 1
    for d, t in texts.items():
        ws = WORD.findall(lower(t))
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws) + math.log10((end + 0.5) / (n + 0.5 * (v + 1)))
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d not in train, len(ws) + 1, sum(w in counts for w in ws) + 1, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def small_model(n=300, seed=4):
    m = lm.Model(np.arange(n, 0, -1) * 3, np.arange(n) % 2)
    rng = np.random.default_rng(seed)
    for k, a in m.weights.items():
        m.weights[k] = (a + rng.standard_normal(a.shape) * 0.2).astype(np.float32)
    return m, rng


def plain_score(m, ids):
    """log10 probability of a document, token by token in double precision."""
    w, n, total = {k: a.astype(float) for k, a in m.weights.items()}, len(ids), 0.0
    for t in range(n):
        lo = t // lm.STEP * lm.STEP - lm.LEAD
        x = [len(m.group) if j <= 0 else ids[j - 1] for j in range(lo, t + 1)]
        e = np.array([w["emb"][i] + w["pos"][p] for p, i in enumerate(x)])
        a = np.exp(np.minimum(e[-1] @ w["wa"] @ e.T, 60))
        h = e[-1] + (a / a.sum()) @ e @ w["wo"]
        g, s = m.group[ids[t]], m.member[ids[t]]
        pg = h @ w["wg"] + w["bg"][0]
        ps = (h * w["gate"][g]) @ w["ws"] + w["bs"][g]
        total += pg[g] - np.log(np.exp(pg).sum()) + ps[s] - np.log(np.exp(ps).sum()) + m.inside[ids[t]]
    return total / math.log(10)


def test_scores_are_the_plain_ones():
    m, rng = small_model()
    docs = [rng.integers(0, 300, n).astype("<u2") for n in (1, 2, 31, 32, 33, 55, 56, 57, 81, 400, 5000)]
    got = m.score(docs)
    assert got == pytest.approx([plain_score(m, d.tolist()) for d in docs], abs=1e-4, rel=1e-6)
    assert np.array_equal(got[::-1], m.score(docs[::-1])) and m.score([docs[3]])[0] == got[3]


def test_scoring_embeds_a_token_once_and_bounds_exponents_only_where_needed(monkeypatch):
    class Counted(np.ndarray):
        taken = 0

        def take(self, at, axis=None):
            Counted.taken += np.size(at)
            return np.asarray(self).take(at, axis=axis)

    m, rng = small_model()
    ids, runs, plain = rng.integers(0, 300, 18 * 200).astype("<u2"), [], lm.leaf_logs
    monkeypatch.setattr(lm, "leaf_logs", lambda *a: runs.append(len(a) > 5) or plain(*a))
    m.weights["emb"] = m.weights["emb"].view(Counted)
    m.score([ids])
    assert Counted.taken <= len(ids) + 2 * lm.LEAD and not any(runs)
    # windows with exponents far outside of the bounds, in attention, groups and members
    x, y = rng.integers(0, 300, (2, lm.WINDOW)), rng.integers(0, 300, 2 * lm.WINDOW)
    for k, times in (("wa", 1e5), ("wg", 1e4), ("ws", 1e4), ("ws", 1e-9)):
        w = m.weights | {k: m.weights[k] * np.float32(times)}
        runs.clear()
        got = lm.forward(w, x, m.group[y], m.member[y])[0]
        assert any(runs) == (times > 1) and np.isfinite(got).all() and got.min() >= -200
        e = np.asarray(w["emb"])[x] + w["pos"]
        assert np.array_equal(got, plain(w, e, m.group[y], m.member[y], 0, True)[0])


def test_steps_are_those_of_adam_weight_by_weight():
    (m, rng), (plain, _) = small_model(), small_model()
    pieces = [(rng.integers(0, 40, n).astype("<u2"), 300) for n in (2000, 3000)]
    m.fit(pieces, 0.02, 7)
    x, y = (np.concatenate(c) for c in zip(*[lm.training_windows(d, p, 300) for d, p in pieces]))
    order, w = np.random.default_rng(7).permutation(len(x)), plain.weights
    state = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in w.items()}
    for step, lo in enumerate(range(0, len(order), lm.STEP_BATCH), 1):
        some = order[lo : lo + lm.STEP_BATCH]
        t = y[some].reshape(-1)
        grad, met = lm.gradients(w, x[some], plain.group[t], plain.member[t], t >= 0)
        for k, d in grad.items():
            at, (a, b) = met if k == "emb" else slice(None), state[k]
            a[at], b[at] = 0.9 * a[at] + 0.1 * d, 0.99 * b[at] + 0.01 * d * d
            w[k][at] -= 0.02 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step) * a[at] / (np.sqrt(b[at]) + 1e-6)
    assert step > 1 and all(np.allclose(m.weights[k], w[k], atol=1e-4) for k in w)


def test_latin_words_of_letters_need_no_pattern(monkeypatch):
    memo = subwords.Memo(subwords.default_path())
    words = ["naïve", "été,", "Œuvre", "straße.", "x²é", "İx.", "ª", "é!!", "l'été", "§;", "é" * 200]
    want = [b"".join(i.to_bytes(2, "little") for i in memo.plain.encode(w, add_special_tokens=False).ids) for w in words]
    assert [memo[w.encode()] for w in words] == want
    monkeypatch.setattr(subwords, "SPLIT", None)
    memo.clear()
    assert [memo[w.encode()] for w in words[:4]] == want[:4]


def test_probabilities_add_up_and_see_no_future():
    m, rng = small_model()
    x = rng.integers(0, 300, (2, lm.WINDOW)).astype("<u2")
    whole = 0
    for t in range(300):
        y = np.full(2 * lm.WINDOW, t)
        whole = whole + np.exp(lm.forward(m.weights, x, m.group[y], m.member[y])[0] + m.inside[y])
    assert whole == pytest.approx(np.ones(2 * lm.WINDOW), rel=1e-4)
    changed, y = x.copy(), np.zeros(2 * lm.WINDOW, dtype=int)
    changed[:, 20:] = 0
    a, b = (lm.forward(m.weights, z, y, y)[0].reshape(2, -1)[:, :20] for z in (x, changed))
    assert np.allclose(a, b)


def test_attention_gradients():
    m, rng = small_model()
    x, y = rng.integers(0, 300, (3, lm.WINDOW)).astype("<u2"), rng.integers(0, 300, 3 * lm.WINDOW)
    w = {k: a.astype(float) for k, a in m.weights.items()}
    loss = lambda: -lm.forward(w, x, m.group[y], m.member[y])[0].mean()
    g, met = lm.gradients(m.weights, x, m.group[y], m.member[y], np.ones((3, lm.WINDOW)))
    for k in w:
        for _ in range(4):
            at = tuple(int(rng.integers(0, s)) for s in g[k].shape)
            place = (met[at[0]], at[1]) if k == "emb" else at
            kept = w[k][place]
            w[k][place] = kept + 1e-4
            up = loss()
            w[k][place] = kept - 1e-4
            assert g[k][at] == pytest.approx((up - loss()) / 2e-4, abs=2e-4), k
            w[k][place] = kept


def test_attention_learns_from_context():
    rng = np.random.default_rng(0)
    doc = lambda: (np.cumsum(rng.integers(1, 3, 400)) % 90).astype("<u2")
    m = lm.Model(np.full(2000, 10), np.zeros(2000, dtype=np.int64))
    before = m.score([doc() for _ in range(5)]).sum()
    m.fit([(doc(), 2000) for _ in range(60)], 0.02)
    assert m.score([doc() for _ in range(5)]).sum() > before * 0.8


def frame_of(spark, texts):
    return lm.encode(spark.createDataFrame([(i, True, t) for i, t in enumerate(texts)], "id long, train boolean, t string"), spark.createDataFrame([], "word binary, c long"), len(texts), subwords.default_path())


def test_units_hold_every_distinct_text_once(spark, monkeypatch):
    monkeypatch.setattr(lm, "PIECE", 8)
    texts = ["a long walk by the river and over the hills " * 3, "seven green bottles", "", "seven green bottles"]
    pieces = [p for r in lm.training_units(frame_of(spark, texts), 100).collect() for p in r.pieces]
    want = set()
    for t in set(texts):
        ids = [*subwords.memo(subwords.default_path()).tokenizer.encode(t, add_special_tokens=False).ids, lm.END]
        want |= {tuple(ids[max(0, at - 1) : at + 8]) for at in range(0, len(ids), 8)}
    assert len(pieces) == len(want) and {tuple(np.frombuffer(p, "<u2", offset=20).tolist()) for p in pieces} == want


def test_every_training_text_moves_the_weights(spark):
    path, counts = subwords.default_path(), np.ones(1 << 16, dtype=np.int64)
    texts = ["a long walk by the river", "seven green bottles on a wall"]
    start = lm.train_model(lm.training_units(frame_of(spark, []), 0), counts, path).weights["emb"]
    got = lm.train_model(lm.training_units(frame_of(spark, texts), 20), counts, path).weights["emb"]
    moved = set(np.flatnonzero((got != start).any(axis=1)).tolist())
    assert moved == {i for t in texts for i in subwords.memo(path).tokenizer.encode(t, add_special_tokens=False).ids} | {len(got) - 1}


def test_scores_do_not_depend_on_partitions_and_beat_the_unigram(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "UNIT", 20_000)  # several units a round
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    one, many = (lm.score(d, learn).toPandas().set_index("doc_id").sort_index() for d in (docs.coalesce(1), docs.repartition(7)))
    assert (one["score"] == many["score"]).all()
    memo = subwords.memo(subwords.default_path())
    ids = {r.doc_id: np.frombuffer(memo.ids(r.text), "<u2") for r in docs.collect()}
    held = one.index[one["held_out"]]
    counts = np.bincount(np.concatenate([ids[d] for d in one.index[~one["held_out"]]]), minlength=memo.tokenizer.get_vocab_size()) + 0.5
    unigram = sum(np.log10(counts / counts.sum())[ids[d]].sum() for d in held)
    assert one.loc[held, "score"].sum() > unigram


def test_context_is_told_apart_by_subword():
    m = lm.Model(np.arange(2000, 0, -1), np.zeros(2000, dtype=np.int64))
    a, b = lm.SINGLE + 1000, lm.SINGLE + 1001
    assert (m.group[a], m.member[a]) == (m.group[b], m.member[b])
    ids = lambda *x: np.array(x * 8, dtype="<u2")
    m.fit([(ids(a, 1), 2000), (ids(b, 2), 2000)] * 4000, 0.02)
    right, wrong = m.score([ids(a, 1), ids(b, 2)]), m.score([ids(a, 2), ids(b, 1)])
    assert (right > wrong + 5).all()


# op10


def check_bins(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r[0]].append(r)
    for members in bins.values():
        assert sum(m[1] for m in members) <= capacity
        assert len({m[2] for m in members}) == len(members) and len({m[3] for m in members}) == len(members)


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(5)
    pieces = sorted(((int(x), int(s), int(c)) for x, s, c in zip(rng.integers(1, 100, 400), rng.integers(0, 9, 400), rng.integers(0, 300, 400), strict=True)), reverse=True)
    got, room, held = packing.best_fit(pieces, 100), [], []
    for (n, s, c), b in zip(pieces, got, strict=True):
        fit = [(room[i], i) for i in range(len(room)) if room[i] >= n and s not in held[i][0] and c not in held[i][1]]
        if fit:
            assert room[b] == min(fit)[0]
        else:
            assert b == len(room)
            room.append(100)
            held.append((set(), set()))
        room[b] -= n
        held[b][0].add(s)
        held[b][1].add(c)


def test_packing(spark, docs, texts):
    got = packing.pack(docs, capacity=700, group=64).collect()
    check_bins([(r.bin, r.n_tokens, r.source, texts[r.doc_id]) for r in got], 700)
    size = Counter()
    for r in got:
        size[r.doc_id] += r.n_tokens
        assert r.start == 700 * r.piece
    assert size == {d: len(WORD.findall(t)) + 1 for d, t in texts.items()}


# odd input


def test_odd_input(spark, odd, nothing):
    n = odd.count()
    known = {"doc_id", "text", "source", "lang"}
    runs = {
        "pii": lambda d: pii.digest(pii.extract(d)), "redact": lambda d: pii.redact(d, pii.extract(d)), "mix": mixing.mix, "media": media.media_columns,
        "language": lambda d: language.identify(d, language.prototypes(d)), "simhash": simhash.near_duplicate_groups, "tokens": tokenfiles.token_files, "shard": sharding.assign_shards,
        "lm": lambda d: lm.score(d, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1),
    }
    assert known <= set(odd.columns)
    for name, f in runs.items():
        assert len(f(odd).collect()) == n, name
        assert f(nothing).count() == 0, name
    pieces = packing.pack(odd, capacity=50).collect()
    assert sum(r.piece == 0 for r in pieces) == n and packing.pack(nothing).count() == 0
    index = search.build_index(odd)
    first = search.search(index, odd.filter("doc_id = 1").limit(1), 5, "doc_id").first()
    assert (first.doc_id, first.found_id) == (1, 1)
    assert search.search(search.build_index(nothing), odd.filter("doc_id = 7"), 5, "doc_id").count() == 0
    assert search.search(index, nothing, 5, "doc_id").count() == 0
