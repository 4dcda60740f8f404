"""Full-text queries: documents as catalogue, benchmark passages as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import stems as E
from lodestack.operators import search as S
from lodestack.operators.tables import with_children
from lodestack.plans.base import query

TOK = r"list_filter(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
POST = f"""ta AS (SELECT doc_id AS doc, unnest({TOK.format("source")}) AS term, generate_subscripts({TOK.format("source")}, 1) - 1 AS i FROM documents),
tc AS (SELECT doc_id AS doc, unnest({TOK.format("lang")}) AS term, generate_subscripts({TOK.format("lang")}, 1) - 1 AS i FROM documents),
td AS (SELECT doc_id AS doc, unnest({TOK.format("'https://' || source || '.example/' || doc_id")}) AS term, generate_subscripts({TOK.format("'https://' || source || '.example/' || doc_id")}, 1) - 1 AS i FROM documents),
tb AS (SELECT doc_id AS doc, unnest({TOK.format("text")}) AS term, generate_subscripts({TOK.format("text")}, 1) - 1 AS i FROM documents),
stops AS (SELECT * FROM (VALUES ('the'), ('of'), ('and'), ('de'), ('la'), ('to'), ('in'), ('a')) AS s(term)),
post0 AS (SELECT * FROM (SELECT doc, term, i AS pos, 1.0::DOUBLE AS weight FROM ta UNION ALL SELECT doc, term, 1099511627776 + i, 0.4::DOUBLE FROM tb UNION ALL SELECT doc, term, 2 * 1099511627776 + i, 0.2::DOUBLE FROM tc UNION ALL SELECT doc, term, 3 * 1099511627776 + i, 0.1::DOUBLE FROM td) WHERE term NOT IN (SELECT term FROM stops))"""


def _rules(rules: tuple, x: str = "x") -> str:
    """A step of the stemmer over columns x, r1 and r2."""
    arms = []
    for suffix, ways in E.by_suffix(rules):
        size = f"length({x}) - {len(suffix)}"
        inner = ""
        for region, pattern, instead in ways:
            held = ["true", f"{size} >= r1", f"{size} >= r2"][region] if region < 3 else "false"
            if pattern:
                held += f" AND {'NOT ' if pattern[0] == '!' else ''}regexp_matches(left({x}, {size}), '{pattern.lstrip('!')}')"
            inner += f" WHEN {held} THEN left({x}, {size}) || '{instead}'"
        arms.append(f"WHEN ends_with({x}, '{suffix}') THEN CASE{inner} ELSE {x} END")
    return f"CASE {' '.join(arms)} ELSE {x} END"


def _stems() -> str:
    """CTEs v0 .. voc (term, stem): regions first, then a step each."""
    region = "CASE WHEN regexp_matches({0}, '" + E.REGION + "') THEN length(regexp_extract({0}, '" + E.REGION + "')) ELSE length({0}) END"
    steps = ["v0 AS (SELECT term, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS x FROM (SELECT term FROM post0 UNION SELECT term FROM qt))",
             f"va AS (SELECT term, x, CASE WHEN regexp_matches(x, '{E.BEGINNINGS}') THEN length(regexp_extract(x, '{E.BEGINNINGS}')) ELSE {region.format('x')} END AS r1 FROM v0)",
             f"vb AS (SELECT term, x, r1, r1 + {region.format('substring(x, r1 + 1)')} AS r2 FROM va)",
             f"vc AS (SELECT term, {_rules(E.PLURALS)} AS x, r1, r2 FROM vb)",
             f"vd AS (SELECT term, x AS whole, {_rules(E.ENDINGS)} AS x, r1, r2 FROM vc)",
             f"ve AS (SELECT *, {_rules(E.AFTER_ENDINGS)} AS mended FROM vd)",
             f"v1 AS (SELECT term, whole, r1, r2, CASE WHEN x = whole OR regexp_matches(whole, 'eed(ly)?$') THEN x WHEN mended <> x THEN mended WHEN length(x) <= r1 AND regexp_matches(x, '{E.SHORT}') THEN x || 'e' ELSE x END AS x FROM ve)"]
    rest = (E.LAST_Y, E.DERIVED, E.DERIVED_TWICE, E.BARE, E.LAST)
    steps += [f"v{i + 2} AS (SELECT term, whole, r1, r2, {_rules(r)} AS x FROM v{i + 1})" for i, r in enumerate(rest)]
    known = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in E.EXCEPTIONS.items())
    kept = ", ".join(f"'{w}'" for w in E.KEPT)
    return ", ".join(steps) + f", voc AS (SELECT term, CASE WHEN length(term) <= 2 THEN term ELSE CASE term {known} ELSE CASE WHEN whole IN ({kept}) THEN whole ELSE replace(x, 'Y', 'y') END END END AS stem FROM v{len(rest) + 1})"


QT = f"""qt AS (SELECT item_id AS query, unnest({TOK.format("text")}) AS term, generate_subscripts({TOK.format("text")}, 1) - 1 AS i FROM benchmark)"""
QQ = f"""{QT}, {_stems()},
qq AS (SELECT query, stem AS term, CASE WHEN query % 4 = 2 THEN 'phrase' WHEN query % 4 = 3 AND i = 4 THEN 'not' WHEN query % 4 = 1 OR (query % 4 = 3 AND i % 8 > 0) THEN 'any' ELSE 'must' END AS role, i AS position
  FROM qt JOIN voc USING (term) WHERE term NOT IN (SELECT term FROM stops)),
post AS (SELECT doc, stem AS term, pos, weight FROM post0 JOIN voc USING (term))"""
MATCH = """need AS (SELECT query, count(DISTINCT term) AS need FROM qq WHERE role IN ('must', 'phrase') GROUP BY query),
per AS (SELECT q.query, p.doc, count(DISTINCT CASE WHEN role <> 'any' THEN p.term END) AS got FROM post p JOIN (SELECT DISTINCT query, term, role FROM qq WHERE role <> 'not') q USING (term) GROUP BY q.query, p.doc),
ok0 AS (SELECT per.query, doc FROM per LEFT JOIN need USING (query) WHERE got = coalesce(need, 0)),
st AS (SELECT q.query, p.doc, p.pos - q.position AS start, count(DISTINCT q.position) AS n FROM post p JOIN qq q ON p.term = q.term AND q.role = 'phrase' GROUP BY 1, 2, 3),
fu AS (SELECT DISTINCT st.query, doc FROM st JOIN (SELECT query, count(*) AS k FROM qq WHERE role = 'phrase' GROUP BY query) c ON c.query = st.query AND n = k),
ok1 AS (SELECT * FROM ok0 WHERE query NOT IN (SELECT query FROM qq WHERE role = 'phrase') OR (query, doc) IN (SELECT query, doc FROM fu)),
hits AS (SELECT * FROM ok1 WHERE (query, doc) NOT IN (SELECT q.query, p.doc FROM post p JOIN qq q ON q.term = p.term AND q.role = 'not'))"""
RANK = """seen AS (SELECT h.query, h.doc, p.pos, p.term, p.weight FROM post p JOIN (SELECT DISTINCT query, term FROM qq WHERE role <> 'not') q ON q.term = p.term JOIN hits h ON h.query = q.query AND h.doc = p.doc),
own AS (SELECT DISTINCT query, doc, term AS other FROM seen),
grid AS (SELECT s.*, o.other, max(CASE WHEN s.term = o.other THEN s.pos END) OVER (PARTITION BY s.query, s.doc, o.other ORDER BY s.pos ROWS UNBOUNDED PRECEDING) AS last FROM seen s JOIN own o USING (query, doc)),
cover AS (SELECT query, doc, pos, weight, CASE WHEN count(last) = count(*) THEN min(last) ELSE -1 END AS start, count(*) AS k FROM grid GROUP BY query, doc, pos, weight),
late AS (SELECT *, coalesce(max(start) OVER (PARTITION BY query, doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM cover),
ranked AS (SELECT query, doc, CAST(sum(CASE WHEN start > before THEN CAST(floor(weight * 1000000 / (1 + greatest(pos - start + 1 - k, 0))) AS BIGINT) ELSE 0 END) AS DOUBLE) / 1000000 AS rank FROM late GROUP BY query, doc)"""
TOP = """top AS (SELECT query, doc, rank, place FROM (SELECT r.*, CAST(row_number() OVER (PARTITION BY query ORDER BY rank DESC, n_chars DESC, doc) AS INTEGER) AS place FROM ranked r JOIN documents ON doc_id = doc) WHERE place <= 10)"""


def postings(t):
    stops = t.spark.sql("SELECT * FROM VALUES ('the'), ('of'), ('and'), ('de'), ('la'), ('to'), ('in'), ('a') AS s(term)")  # of known size, so no posting is shuffled for it
    d = t.documents.withColumn("url", F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")))
    return S.build_postings(d, "doc_id", {"source": "A", "text": "B", "lang": "C", "url": "D"}, stops), stops


def prepared(t):
    """Postings and queries by stems: all words of every passage, in roles by passage and place."""
    p, stops = postings(t)
    q = t.benchmark.select(F.col("item_id").alias("query"), F.posexplode(S.tokens(F.col("text"))).alias("position", "term")).join(stops, "term", "left_anti")
    k, i = F.col("query") % 4, F.col("position")
    role = F.when(k == 2, "phrase").when((k == 3) & (i == 4), "not").when((k == 1) | ((k == 3) & (i % 8 > 0)), "any").otherwise("must")
    return S.prepare(p, q.select("query", "term", role.alias("role"), "position"), t.documents.count())


def top_ten(t, p, q):
    return S.rank_top(p, q, t.documents.select(F.col("doc_id").alias("doc"), F.col("n_chars").alias("updated")), 10)


@query("build_postings", f"WITH {POST} SELECT doc, count(*) AS n, count(DISTINCT term) AS terms, CAST(sum(pos) AS BIGINT) AS positions, round(sum(weight), 3) AS weight FROM post0 GROUP BY doc")
def _(t):
    p, _s = postings(t)
    return p.groupBy("doc").agg(F.count("*").alias("n"), F.count_distinct("term").alias("terms"), F.sum("pos").alias("positions"), F.round(F.sum("weight"), 3).alias("weight"))


@query("stem_vocabulary", f"WITH {POST}, {QQ} SELECT stem, count(*) AS variants FROM voc WHERE term IN (SELECT term FROM post0) GROUP BY stem")
def _(t):
    return S.stem_vocabulary(postings(t)[0]).groupBy("stem").agg(F.count("*").alias("variants"))


@query("match_terms", f"WITH {POST}, {QQ}, {MATCH} SELECT query, doc FROM hits")
def _(t):
    return S.match_terms(*prepared(t))


@query("match_queries", f"WITH {POST}, {QQ} SELECT query, count(DISTINCT doc) AS docs FROM post JOIN qq USING (term) GROUP BY query")
def _(t):
    p, q = prepared(t)
    met = p.select("doc", "term").join(q.select("query", "term").distinct(), "term").select("query", "doc").distinct()
    return met.groupBy("query").agg(F.count("*").alias("docs"))


@query("cover_density_rank", f"WITH {POST}, {QQ}, {MATCH}, {RANK} SELECT query, doc, rank FROM ranked")
def _(t):
    p, q = prepared(t)
    return S.cover_density(p, q, S.match_terms(p, q))


@query("rank_catalog", f"WITH {POST}, {QQ}, {MATCH}, {RANK}, {TOP} SELECT query, doc, rank, place FROM top")
def _(t):
    return top_ten(t, *prepared(t)).select("query", "doc", "rank", "place")


@query("local_first", f"WITH {POST}, {QQ}, {MATCH} SELECT query, CASE WHEN query IN (SELECT query FROM hits) THEN 'local' ELSE 'online' END AS route FROM (SELECT DISTINCT query FROM qq)")
def _(t):
    p, q = prepared(t)
    return S.local_first(q, S.match_terms(p, q))


@query("search_with_children", f"WITH {POST}, {QQ}, {MATCH}, {RANK}, {TOP} SELECT query, doc, place, CAST(count(l.doc_id) AS INTEGER) AS n_children FROM top LEFT JOIN labels l ON l.doc_id = doc GROUP BY 1, 2, 3")
def _(t):
    top = top_ten(t, *prepared(t)).select("query", "doc", "place")
    labels = t.labels.withColumnRenamed("doc_id", "doc").join(top.select("doc").distinct(), "doc", "left_semi")
    return with_children(top, labels, "doc", F.col("quality"), ["quality", "toxic"]).select("query", "doc", "place", F.size("children").alias("n_children"))
