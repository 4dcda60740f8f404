"""The corpus operators as registered queries over the ``documents``, ``benchmark``, ``labels`` and ``embeddings`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import language, lm, media, merkle, mixing, packing, pii, search, sharding, simhash, tokenfiles, toxicity, whitening
from lodestack.llm.textops import id_crc


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data: base counts, digest of base spans, and all spans."""
    return pii.digest(pii.extract(documents(spark, sf_dir).select("doc_id", "text")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language; documents whose crc32(doc_id) mod 3 is 1 are held out.

    A null doc_id is neither learned from nor held out.
    """
    docs = documents(spark, sf_dir)
    learn = id_crc(F.col("doc_id")) % 3 != 1
    profiles = language.prototypes(docs.filter(learn))
    out = language.identify(docs, profiles)
    return out.select("doc_id", (F.coalesce(id_crc(F.col("doc_id")) % 3, F.lit(0)) == 1).alias("held_out"), "lang_pred", "score")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixture of all sources by weights 5, 2, 1, documents by the weight of their length, with at most three copies of one."""
    out = mixing.mix(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads stored as deduplicated chunks and read back."""
    return media.media_columns(documents(spark, sf_dir))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents by BM25 for every benchmark passage whose item_id is divisible by 20."""
    queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("item_id % 20 = 0")
    return search.search(search.build_index(documents(spark, sf_dir)), queries, 10, "item_id", "text")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    out = simhash.near_duplicate_groups(documents(spark, sf_dir))
    return out.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files, written and read back."""
    return tokenfiles.token_files(documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of near equal bytes; equal texts stay together."""
    out = sharding.assign_shards(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention-model and unigram scores; documents whose crc32(doc_id) mod 5 is 1 are held out."""
    return lm.score(documents(spark, sf_dir), id_crc(F.col("doc_id")) % 5 != 1)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in bins of 2048 words, no source or copy twice in a bin."""
    return packing.pack(documents(spark, sf_dir))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores; documents whose crc32(doc_id) mod 4 is 2 are held out, null ids are neither learned from nor held out."""
    docs, part = documents(spark, sf_dir), id_crc(F.col("doc_id")) % 4
    out = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), part != 2)
    return out.select("doc_id", (F.coalesce(part, F.lit(0)) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents by lang, proofs, and the check of rows of which some were tampered with.

    Where 7 divides crc32(doc_id), n_chars is one more than when the manifest was made; null ids and
    null n_chars stay as they are."""
    docs, changed = documents(spark, sf_dir), id_crc(F.col("doc_id")) % 7 == 0
    fields = lambda n: merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang")], n, F.col("text"))
    more = F.col("n_chars").cast("decimal(20,0)") + 1  # no overflow
    rows = docs.select("doc_id", "lang", fields(F.col("n_chars")).alias("leaf"), F.when(changed, fields(more)).alias("now"))
    out = merkle.verified(merkle.manifest(rows, "lang", "doc_id", carry=("now",)), F.coalesce("now", "leaf"))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.sha256(merkle.proof(F.col("path"))).alias("proof_sha256"), "folded_root", "verified")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of all embeddings, by exact covariances."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_pii, op2_language_id, op3_mixing, op4_media, op5_topk_search, op6_simhash, op7_token_files, op8_sharding, op9_lm_score, op10_packing, op11_toxicity, op12_merkle, op13_whitening)
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


OP3_SQL = """
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\x0C\\r]+')) AS BIGINT) AS size FROM documents),
steps AS (
  SELECT *, CASE WHEN size >= 1024 THEN 24 WHEN size >= 256 THEN 32 WHEN size >= 64 THEN 24 ELSE 16 END AS steps FROM base),
per AS (SELECT source, count(*) AS n, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS cap FROM per),
levels AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
    coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM weighed WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, CAST(total - cap_before AS DOUBLE) / CAST(all_w - w_before AS DOUBLE) * w >= cap AS is_full FROM levels),
summed AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS rest, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () AS open_w FROM marked),
targets AS (
  SELECT source, n, source_size,
    CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(total - rest AS DOUBLE) / CAST(open_w AS DOUBLE) * w END AS target FROM summed),
weighted AS (SELECT source, steps, CAST(sum(size) AS BIGINT) AS words FROM steps GROUP BY source, steps HAVING sum(size) > 0),
solved AS (
  SELECT w.*, t.source_size, t.target,
    (t.target - coalesce(sum(w.words) OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3)
      / CAST(sum(w.words * w.steps) OVER (d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighted w JOIN targets t ON w.source IS NOT DISTINCT FROM t.source WINDOW d AS (PARTITION BY w.source ORDER BY w.steps DESC)),
limits AS (SELECT *, target >= source_size * 3 OR level * steps >= 3 AS full_up FROM solved),
opened AS (SELECT source, arg_max(level, steps) AS level FROM limits WHERE NOT full_up GROUP BY source),
expected AS (
  SELECT l.* EXCLUDE (level), CASE WHEN full_up THEN 3.0::DOUBLE ELSE o.level * steps END AS copies
  FROM limits l LEFT JOIN opened o ON l.source IS NOT DISTINCT FROM o.source),
split AS (SELECT *, CAST(floor(copies) AS BIGINT) AS whole, copies - floor(copies) AS p FROM expected),
rests AS (
  SELECT source, greatest(any_value(target) - CAST(sum(whole * words) AS BIGINT), 0.0) AS left_words, CAST(sum(CASE WHEN p > 0 THEN words ELSE 0 END) AS BIGINT) AS pool
  FROM split GROUP BY source),
shares AS (SELECT source, left_words, least(greatest(CASE WHEN pool > 0 THEN left_words / pool ELSE 0.0 END, 1e-9), 1 - 1e-9) AS share FROM rests),
drawn AS (
  SELECT b.doc_id, b.size, b.source, t.n, t.source_size, t.target, coalesce(s.whole, 0) AS whole, coalesce(s.p, 0) AS p0, coalesce(r.left_words, 0) AS left_words, coalesce(r.share, 0) AS share,
    least(greatest(coalesce(s.p, 0), 1e-9), 1 - 1e-9) AS p,
    (CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(b.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM steps b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source
  LEFT JOIN split s ON b.source IS NOT DISTINCT FROM s.source AND b.steps = s.steps LEFT JOIN shares r ON b.source IS NOT DISTINCT FROM r.source),
ranked AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS q, CAST(ceil(sqrt(n)) AS BIGINT) AS slots, size > 0 AND left_words > 0 AND p0 > 0 AS can FROM drawn),
spread AS (SELECT *, q * (share / (1 - share)) AS even FROM ranked),
slotted AS (SELECT *, least(CAST(floor(even / (1 + even) * slots) AS BIGINT), slots - 1) AS slot FROM spread),
slot_sums AS (SELECT source, slot, sum(size) AS words, any_value(left_words) AS left_words FROM slotted WHERE can GROUP BY source, slot),
running AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY slot) AS upto FROM slot_sums),
border AS (SELECT source, min(slot) AS border, min(upto) AS upto, arg_min(words, slot) AS words FROM running WHERE upto > left_words GROUP BY source),
joined AS (SELECT s.*, b.border, b.upto - b.words AS before FROM slotted s LEFT JOIN border b ON s.source IS NOT DISTINCT FROM b.source),
e0 AS (SELECT *, left_words - before AS room, false AS took FROM joined WHERE can AND slot BETWEEN border AND border + 7),
{fills}
nearest AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN took THEN NULL ELSE abs(size - room) END ASC NULLS LAST, q, doc_id, size) AS rn FROM e{n}),
final_edge AS (SELECT * EXCLUDE (took), took OR (rn = 1 AND abs(size - room) < room) AS took FROM nearest),
done AS (
  SELECT doc_id, size, source_size, target, whole + CASE WHEN can AND (border IS NULL OR slot < border) THEN 1 ELSE 0 END AS copies
  FROM joined WHERE NOT coalesce(can AND slot BETWEEN border AND border + 7, false)
  UNION ALL
  SELECT doc_id, size, source_size, target, whole + CASE WHEN took THEN 1 ELSE 0 END FROM final_edge)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM done
"""
FILL_SQL = """
f{i} AS (SELECT *, sum(CASE WHEN NOT took AND size <= room THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM e{j}),
g{i} AS (SELECT *, NOT took AND size <= room AND run <= room AS is_new FROM f{i}),
h{i} AS (SELECT *, sum(CASE WHEN is_new THEN size ELSE 0 END) OVER (PARTITION BY source) AS got FROM g{i}),
e{i} AS (SELECT * EXCLUDE (room, took, run, is_new, got), room - got AS room, took OR is_new AS took FROM h{i}),
"""

OP5_SQL = """
WITH toks AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\x0C\\r]+')) AS term FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY doc_id, term),
lens AS (SELECT doc_id, sum(tf) AS dl FROM post GROUP BY doc_id),
stats AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM lens)::DOUBLE / (SELECT count(*) FROM documents) AS mean),
asked AS (
  SELECT item_id, term, count(*) AS qtf FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\x0C\\r]+')) AS term
    FROM benchmark WHERE item_id % 20 = 0) GROUP BY item_id, term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
parts AS (
  SELECT a.item_id, p.doc_id,
    CAST(floor(ln(1 + (s.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) * a.qtf * (p.tf * 2.2::DOUBLE) / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / s.mean)) * 1000000 + 0.5) AS BIGINT) AS w
  FROM asked a JOIN post p USING (term) JOIN dfs d USING (term) JOIN lens l ON l.doc_id = p.doc_id CROSS JOIN stats s),
sums AS (SELECT item_id, doc_id, sum(w) AS s FROM parts GROUP BY item_id, doc_id HAVING sum(w) > 0),
ranked AS (SELECT item_id, doc_id, s, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank FROM sums)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(s AS DOUBLE) / 1000000.0 AS score FROM ranked WHERE rank <= 10
"""

OP12_SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, n_chars, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS before,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS after, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END AS id,
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, [ord(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]), lambda a, b:
      list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(id || before || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || after) AS leaf,
    CASE WHEN crc % 7 = 0 THEN sha256(id || before || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) END || after) END AS now FROM fields),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS i FROM leaves),
trees(lang, lvl, nodes) AS (
  SELECT lang, 0, list(leaf ORDER BY i) FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, lvl + 1, [sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], '')) FOR k IN range(0, (len(nodes) + 1) // 2)] FROM trees WHERE len(nodes) > 1),
levels AS (SELECT lang, list(nodes ORDER BY lvl) AS levels FROM trees GROUP BY lang),
subs AS (SELECT *, levels[-1][1] AS subroot, CAST(row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS BIGINT) AS j FROM levels),
tops(lvl, nodes) AS (
  SELECT 0, list(subroot ORDER BY j) FROM subs
  UNION ALL
  SELECT lvl + 1, [sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], '')) FOR k IN range(0, (len(nodes) + 1) // 2)] FROM tops WHERE len(nodes) > 1),
top AS (SELECT list(nodes ORDER BY lvl) AS upper FROM tops),
paths AS (
  SELECT p.doc_id, p.leaf, coalesce(p.now, p.leaf) AS now, s.subroot, t.upper[-1][1] AS root,
    list_concat([{'r': (i >> k) & 1 = 1, 's': coalesce(levels[k + 1][xor(i >> k, 1) + 1], '')} FOR k IN range(0, len(levels) - 1)],
                [{'r': (j >> k) & 1 = 1, 's': coalesce(upper[k + 1][xor(j >> k, 1) + 1], '')} FOR k IN range(0, len(upper) - 1)]) AS path
  FROM placed p JOIN subs s ON p.lang IS NOT DISTINCT FROM s.lang, top t),
folded AS (
  SELECT *, sha256(array_to_string([x.s FOR x IN path], '')) AS proof_sha256,
    list_reduce(list_prepend({'r': false, 's': now}, path), lambda a, x: {'r': false, 's': sha256(CASE WHEN x.r THEN x.s || a.s ELSE a.s || x.s END)}).s AS folded_root
  FROM paths)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator; the others are tested against brute force."""
    fills = "".join(FILL_SQL.format(i=i, j=i - 1) for i in range(1, mixing.FILLS + 1))
    return {"op3_mixing": OP3_SQL.replace("{fills}", fills).replace("{n}", str(mixing.FILLS)), "op5_topk_search": OP5_SQL, "op12_merkle": OP12_SQL}
