"""The Merkle manifest against trees built in plain Python."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from lodestack.llm import merkle, registry
from tests.conftest import SF


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def siblings(levels, i):
    return [level[(i >> k) ^ 1] if (i >> k) ^ 1 < len(level) else "" for k, level in enumerate(levels[:-1])]


def plain(rows):
    """(group, order, leaf) -> sorted (order, leaf, subroot, root, proof digest)."""
    groups = defaultdict(list)
    for g, o, x in rows:
        groups[g].append((o is not None, o or 0, x))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x for _, _, x in sorted(groups[g])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for j, g in enumerate(order):
        for i, (has, o, x) in enumerate(sorted(groups[g])):
            out.append((str(o if has else None), x, trees[g][-1][0], top[-1][0], H("".join(siblings(trees[g], i) + siblings(top, j)))))
    return sorted(out)


def built(frame):
    out = merkle.verified(merkle.manifest(frame, "g", "o", "x"), F.col("x"))
    rows = out.select(F.col("o").cast("string").alias("o"), "x", "subroot", "root", merkle.sha256(merkle.proof(F.col("path"))).alias("p"), "folded_root", "verified").collect()
    assert all(r.verified and r.folded_root == r.root for r in rows)
    return sorted((str(r.o), r.x, r.subroot, r.root, r.p) for r in rows)


def test_trees_of_every_small_size(spark):
    for sizes in ((1,), (2, 1), (3, 5, 7), (256, 257, 4), (512, 255, 1, 513)):
        rows = [(f"g{g}", i * 3 % 1009, H(f"{g}-{i}")) for g, n in enumerate(sizes) for i in range(n)]
        assert built(spark.createDataFrame(rows, "g string, o long, x string")) == plain(rows)


def test_three_rounds_of_blocks_beside_a_small_group(spark):
    n = 65_536 + 300
    frame = spark.range(n + 9).select(F.when(F.col("id") < n, "big").otherwise(F.lit(None)).alias("g"), F.col("id").alias("o"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("x"))
    assert built(frame) == plain([("big" if i < n else None, i, H(str(i))) for i in range(n + 9)])


def test_many_groups_null_orders_and_repeated_rows(spark):
    rows = [(f"é{i}" if i % 3 else (None if i % 2 else ""), None if i % 5 == 0 else i % 7, H(str(i % 11))) for i in range(3000)]
    assert built(spark.createDataFrame(rows, "g string, o long, x string")) == plain(rows)


def test_a_third_of_all_rows_equal(spark):
    rows = [("a", 1, H("same"))] * 1000 + [("a", i, H(str(i))) for i in range(2000)]
    assert built(spark.createDataFrame(rows, "g string, o long, x string")) == plain(rows)


def test_tampering_is_found_and_only_that(spark):
    got = {r.doc_id: r for r in registry.op12_merkle(spark, SF).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.verified == (zlib.crc32(str(i).encode()) % 7 != 0 or docs[i].n_chars is None), i
        d = docs[i]
        assert r.leaf == H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d.doc_id, d.source, d.lang, d.n_chars, d.text)))


def test_query_is_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = registry.op12_merkle(spark, SF)
    want = con.sql(registry.OP12_SQL)
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[want.columns.index(c)] for c in df.columns) for r in want.fetchall())


def test_odd_input(spark, odd, nothing):
    for frame in (odd, nothing):
        leaf = merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
        rows = merkle.manifest(frame.withColumn("leaf", leaf), "lang", "doc_id").collect()
        assert len(rows) == frame.count() and len({r.root for r in rows}) <= 1
