"""Personal data by bootstrapped contextual extraction, in DataFrame expressions only.

Seeds are the identifiers that the base patterns find in every whole text, and strings in the form
of a key or token.  The words around a seed are lexical patterns.  Every other identifier-like
string, in one token or in groups of digits, is a candidate and carries the patterns around it,
which makes a graph of patterns and instances.  A pattern's score is the share of its distinct
instances that are believed; an instance is believed once the trusted patterns around it say so
with enough certainty.  Rounds over the graph go on until no further instance is believed, so an
instance found in one round can support a pattern in the next.  Believed instances are added as
spans; seeds in the form of a key count as instances and become spans only that way.  Base spans are
never changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.scratch import let, settle

KINDS = ("email", "ip", "card", "phone")
#: All kinds of spans; secrets have no base pattern.
ALL = (*KINDS, "secret")
#: The base patterns, written without backtracking so that long runs cost linear time and no
#: stack: possessive runs, and starts only where a run or the previous match ends.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: What a discovered instance of each kind must look like.
SHAPES = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^(?=(?:[^0-9]*[0-9]){4})(?=.*[.:].*[.:])[0-9a-fA-F.:]+$",
    "card": r"^(?=(?:[^0-9]*[0-9]){12})[0-9][0-9Xx*\x20-]*$",
    "phone": r"^(?=(?:[^0-9]*[0-9]){7})[+(]?[0-9][0-9().\x20-]*$",
    "secret": r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=.-]{16,}$",
}
#: Seeds of secrets: 32 or more hexadecimal digits with letters among them, and public key prefixes.
SECRET = r"^(?:(?=[^a-f]*[a-f])(?=[^0-9]*[0-9])[0-9a-f]{32,}|(?=[^A-F]*[A-F])(?=[^0-9]*[0-9])[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})$"
#: Candidates: groups of digits with single spaces, and tokens with a digit or an at sign.
GROUPED = r"(?:\G|(?<![\p{L}\p{N}@._+-]))[+(]?[0-9][0-9().-]*+(?:\x20[(]?[0-9][0-9().-]*+)++"
TOKEN = r"(?:\G|(?<![\p{L}\p{N}@._%+/*:=-]))(?=[\p{L}._%+/*:=-]*+[0-9@])[\p{L}\p{N}@._%+/*:=-]++"
#: A pattern needs this many believed instances of a kind, and this score to be trusted.
LEAST_SEEDS, TRUST = 3, 0.75
#: An instance is believed from this certainty on.
ACCEPT = 0.75
#: Code points beside an instance in which its pattern words lie; longer words are no pattern words.
REACH = 48
BLOCK = 64
#: Code points, at least, of the pieces that a long text is cut into, each up to a space between two letters.
PIECE = 16_384
CUT = rf"(?s).{{{PIECE}}}.*?(?<=\p{{L}})\x20(?=\p{{L}})|.+"


def _starts(gaps: Column, lens: Column) -> Column:
    """Start of each match from the lengths of gaps and matches, in blocks to stay near linear."""
    def body(v: Column) -> Column:
        steps, n = v["steps"], F.size(v["steps"])
        add = lambda a, x: a + x
        zero = F.lit(0).cast("long")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)), zero, add))
        def offsets(sums: Column) -> Column:
            before = F.transform(sums, lambda _, i: F.aggregate(F.slice(sums, F.lit(1), i), zero, add))
            def place(base: Column) -> Column:
                return F.transform(v["gaps"], lambda g, i: F.element_at(base, F.floor(i / BLOCK).cast("int") + 1) + F.aggregate(F.slice(steps, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK), zero, add) + g)
            return let(before, place)
        return let(blocks, offsets)

    steps = F.zip_with(gaps, lens, lambda g, n: g + n)
    return let(F.struct(steps.alias("steps"), gaps.alias("gaps")), body)


def _luhn(digits: Column) -> Column:
    """Luhn check of a digit string of at most 19 digits."""
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))


SPAN = "array<struct<start:bigint,rank:int,end:bigint,value:string>>"
PLACES = "array<struct<start:bigint,end:bigint,value:string>>"


def _kind_spans(text: Column, rank: int, kind: str) -> Column:
    """Valid spans of one kind in order of start."""
    def spans(v: Column) -> Column:
        lens = F.transform(v["m"], lambda m: F.length(m).cast("long"))
        # one gap more than matches: the last gap follows the last match
        gaps = F.transform(F.slice(v["g"], F.lit(1), F.size(v["m"])), lambda g: F.length(g).cast("long"))
        rows = F.zip_with(_starts(gaps, lens), v["m"], lambda at, m: F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + F.length(m)).alias("end"), m.alias("value")))
        return F.when(F.size(v["m"]) > 0, F.filter(rows, lambda x: _valid(kind, x["value"])))

    found = F.struct(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("m"), F.split(text, PATTERNS[kind], -1).alias("g"))
    hint = F.contains(text, F.lit(HINT[kind])) if HINT[kind] else F.lit(True)
    return F.coalesce(F.when(hint, let(found, spans)), F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """All base spans of a text, ordered by start and kind; null text gives none."""
    found = [_kind_spans(text, rank, kind) for rank, kind in enumerate(KINDS)]
    every = F.array_sort(F.concat(*found))
    return F.when(text.rlike("[0-9@]"), every).otherwise(F.array().cast(SPAN))


def _matches(text: Column, pattern: str) -> Column:
    """All matches with their places: structs of start, end, value."""
    def place(v: Column) -> Column:
        lens = F.transform(v["m"], lambda m: F.length(m).cast("long"))
        gaps = F.transform(F.slice(v["g"], F.lit(1), F.size(v["m"])), lambda g: F.length(g).cast("long"))
        return F.zip_with(_starts(gaps, lens), v["m"], lambda at, m: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("value")))

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    return F.coalesce(F.when(text.rlike(pattern), let(found, place)), F.array().cast(PLACES))


def _trimmed(x: Column) -> Column:
    """The span without punctuation at its ends and without brackets around it."""
    boxed = x["value"].rlike(r"^\([^()]*\)[^\p{L}\p{N}]*$")
    open_ = F.when(boxed, r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$").otherwise(r"^[^\p{L}\p{N}+(]+|[^\p{L}\p{N})]+$")
    core = F.regexp_replace(x["value"], open_, F.lit(""))
    lead = F.length(F.regexp_extract(x["value"], r"^[^\p{L}\p{N}+(]*", 0)) + F.when(boxed, 1).otherwise(0)
    return F.struct((x["start"] + lead).alias("start"), (x["start"] + lead + F.length(core)).alias("end"), core.alias("value"))


def candidates(text: Column, base: Column) -> Column:
    """Identifier-like strings with their places: four digits or an at sign, in order.

    A token inside of grouped digits is part of the group.  What touches a base span is no candidate
    unless it has the form of a secret and holds the whole span."""
    enough = lambda x: x["value"].rlike("[^@]@[^@]|[0-9][^0-9]*[0-9][^0-9]*[0-9][^0-9]*[0-9]")
    touch = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])

    def pick(v: Column) -> Column:
        tokens = F.filter(v["t"], lambda t: ~F.exists(v["g"], lambda g: touch(t, g)))
        rows = F.filter(F.transform(F.array_sort(F.concat(v["g"], tokens)), _trimmed), enough)
        return F.filter(rows, lambda c: ~F.exists(base, lambda b: touch(b, c) & ~((c["start"] <= b["start"]) & (b["end"] <= c["end"]) & c["value"].rlike(SHAPES["secret"]))))

    none = F.array().cast(PLACES)
    return F.when(text.rlike("[0-9@]"), let(F.struct(F.filter(_matches(text, GROUPED), enough).alias("g"), _matches(text, TOKEN).alias("t")), pick)).otherwise(none)


def _patterns(text: Column, x: Column) -> Column:
    """The lexical patterns around a span, lower-cased, the span as ``_``: the last word before it,
    the last two, the word after it, and both sides.  Words are runs of letters; anything else
    between them and the span is skipped."""
    begin = F.greatest(x["start"] - REACH, F.lit(0).cast("long"))
    before = F.lower(F.substring(text, (begin + 1).cast("int"), (x["start"] - begin).cast("int")))
    after = F.lower(F.substring(text, (x["end"] + 1).cast("int"), F.lit(REACH)))
    word = r"(?<![\p{L}])(\p{L}+)[^\p{L}]*$"
    last = F.regexp_extract(before, word, 1)
    two = F.regexp_extract(before, r"(?<![\p{L}])(\p{L}+[^\p{L}]+\p{L}+)[^\p{L}]*$", 1)
    nxt = F.regexp_extract(after, r"^[^\p{L}]*(\p{L}+)(?![\p{L}])", 1)

    def build(v: Column) -> Column:
        some = lambda c, out: F.when(c != "", out)
        every = F.array(some(v["last"], F.concat(v["last"], F.lit(" _"))), some(v["two"], F.concat(F.regexp_replace(v["two"], r"[^\p{L}]+", " "), F.lit(" _"))),
                        some(v["next"], F.concat(F.lit("_ "), v["next"])), F.when((v["last"] != "") & (v["next"] != ""), F.concat(v["last"], F.lit(" _ "), v["next"])))
        return F.array_compact(every)

    return let(F.struct(last.alias("last"), two.alias("two"), nxt.alias("next")), build)


def _pieces(text: Column) -> Column:
    """The text as structs of t, at (its start), and left and right (what stands around it, as far as patterns
    reach).  A long text is cut about every ``PIECE`` code points, at a space between two letters, which no span
    can hold; so all work on a piece is bounded, and on a text linear."""
    def build(cut: Column) -> Column:
        lens = F.transform(cut, lambda p: F.length(p).cast("long"))

        def piece(p: Column, i: Column) -> Column:
            at = F.aggregate(F.slice(lens, F.lit(1), i), F.lit(0).cast("long"), lambda a, b: a + b)
            left, right = F.right(F.get(cut, i - 1), F.lit(REACH)), F.left(F.get(cut, i + 1), F.lit(REACH))
            return F.struct(p.alias("t"), at.alias("at"), F.coalesce(left, F.lit("")).alias("left"), F.coalesce(right, F.lit("")).alias("right"))

        return F.transform(cut, piece)

    return let(F.when(F.length(text) <= 2 * PIECE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(CUT), F.lit(0))), build)


def _seen(piece: Column) -> Column:
    """Base spans and candidates of a piece, placed in its text, with their patterns."""
    none, lead = F.lit(None).cast("int"), F.length(piece["left"])
    around = F.concat(piece["left"], piece["t"], piece["right"])
    secret = lambda c: F.when(c["value"].rlike(SECRET), F.lit(len(KINDS)))

    def row(x: Column, around: Column, rank: Column, seed: Column) -> Column:
        near = _patterns(around, {"start": x["start"] + lead, "end": x["end"] + lead})
        return F.struct((x["start"] + piece["at"]).alias("start"), (x["end"] + piece["at"]).alias("end"), x["value"], rank.alias("rank"), seed.alias("seed"), near.alias("patterns"))

    def both(base: Column) -> Column:
        seeds = let(around, lambda a: F.transform(base, lambda b: row(b, a, b["rank"], none)))
        return F.concat(seeds, let(around, lambda a: F.transform(candidates(piece["t"], base), lambda c: row(c, a, none, secret(c)))))

    return let(base_spans(piece["t"]), both)


def _list(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in ALL])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def believed(edges: DataFrame, seeds: int = LEAST_SEEDS) -> DataFrame:
    """(value, kind): the instances that rounds over the graph come to believe.

    ``edges`` has distinct (pattern, value, rank, seed): ``rank`` is the kind of a base seed, which is
    believed from the start and never changes, ``seed`` the kind of a seed that has yet to be
    confirmed.  A pattern is trusted for a kind when at least ``seeds`` of its instances are believed
    or seeds of it and they are a share of at least TRUST of (instances + 1).  A candidate of the
    kind's shape is believed when 1 - product(1 - share) over its trusted patterns reaches ACCEPT.
    What is believed only grows, so the rounds end; ties between kinds go to the first.
    """
    kinds = range(len(ALL))
    edges = settle(edges, "edges")
    spark, known, count = edges.sparkSession, None, -1
    while True:
        rows = edges.withColumn("kind", F.coalesce("rank", "seed"))
        if known is not None:
            rows = rows.drop("kind").join(known, "value", "left").withColumn("kind", F.coalesce("rank", "kind", "seed"))
        share = [(F.count_if(F.col("kind") == k)).alias(f"c{k}") for k in kinds]
        trust = rows.groupBy("pattern").agg(F.count("*").alias("n"), *share)
        trust = trust.select("pattern", *[F.when(F.col(f"c{k}") >= seeds, F.col(f"c{k}") / (F.col("n") + 1)).otherwise(0.0).alias(f"p{k}") for k in kinds])
        trust = settle(trust.filter(F.greatest(*[F.col(f"p{k}") for k in kinds]) >= TRUST), "trusted")
        doubt = [F.sum(F.when(F.col(f"p{k}") >= TRUST, F.log(1 - F.col(f"p{k}"))).otherwise(0.0)).alias(f"d{k}") for k in kinds]
        found = edges.filter("rank is null").join(trust, "pattern").groupBy("value").agg(*doubt)
        sure = [F.struct(F.when(F.col("value").rlike(SHAPES[ALL[k]]), 1 - F.exp(F.col(f"d{k}"))).otherwise(0.0).alias("a"), F.lit(-k).alias("k")) for k in kinds]
        found = found.select("value", F.array_max(F.array(*sure)).alias("best")).filter(F.col("best.a") >= ACCEPT)
        found = found.select("value", (-F.col("best.k")).alias("kind"))
        if known is not None:  # the first kind that a value is believed for stays
            found = known.unionByName(found.join(known, "value", "left_anti"))
        known = settle(found, "believed")
        now = known.count()
        if now == count or now == 0:
            return known if now else spark.createDataFrame([], "value string, kind int")
        count = now


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: int = LEAST_SEEDS) -> DataFrame:
    """One row per input row: id, key (hash of the text), base and spans (arrays of structs).

    ``base`` has the base spans, ``spans`` the base and the discovered ones, each ordered by start
    and kind, in code points with exclusive ends.  Null texts count as empty.  Rows with the same
    id and text get the same spans.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    seen = F.flatten(F.transform(_pieces(text), _seen))
    rows = settle(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), seen.alias("seen")), "spans")
    base = F.transform(F.filter("seen", lambda s: s["rank"].isNotNull()), lambda s: F.struct(s["start"], s["rank"], s["end"], s["value"]))
    rows = rows.withColumn("base", base)

    seen = rows.select("id", "key", F.explode("seen").alias("s")).select("id", "key", "s.*").withColumn("v", F.lower("value"))
    edges = seen.select(F.explode("patterns").alias("pattern"), F.col("v").alias("value"), "rank", "seed")
    edges = edges.groupBy("pattern", "value").agg(F.max("rank").alias("rank"), F.max("seed").alias("seed"))
    named = believed(edges, seeds).withColumnRenamed("value", "v")
    more = seen.filter("rank is null").join(named, "v")
    more = more.groupBy("id", "key").agg(F.collect_set(F.struct("start", F.col("kind").alias("rank"), "end", "value")).alias("more"))
    more = settle(more, "discovered")
    out = rows.alias("r").join(more.alias("m"), F.col("r.id").eqNullSafe(F.col("m.id")) & (F.col("r.key") == F.col("m.key")), "left")
    spans = F.array_sort(F.concat("r.base", F.coalesce("m.more", F.array().cast(SPAN))))
    return out.select(F.col("r.id").alias(id_col), F.col("r.key").alias("key"), F.col("r.base").alias("base"), spans.alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans, the digest of their list, and the list of all spans."""
    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(_list(F.col("base")), 256).alias("base_sha256"), _list(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``found`` replaced by ``<KIND>``; overlapping spans merge into
    the first.  Rows without spans keep their text, null included."""
    marks = F.array(*[F.lit(f"<{k.upper()}>") for k in ALL])
    spans = settle(found.filter(F.size("spans") > 0).select(F.col(id_col).alias("__id"), F.col("key").alias("__key"), F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["rank"])).alias("__spans")).distinct(), "redactions")
    text = F.col(text_col)

    def clean_piece(p: Column) -> Column:
        """Spans lie within pieces, so each piece is rebuilt on its own."""
        def step(acc: Column, s: Column) -> Column:
            start, end = s["start"] - p["at"], s["end"] - p["at"]
            gap = F.substring(p["t"], (acc["at"] + 1).cast("int"), (start - acc["at"]).cast("int"))
            return F.when(start < acc["at"], F.struct(F.greatest(acc["at"], end).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], gap, F.element_at(marks, s["rank"] + 1)).alias("out")))

        own = F.filter("__spans", lambda s: (s["start"] >= p["at"]) & (s["start"] < p["at"] + F.length(p["t"])))
        return F.aggregate(own, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(p["t"], (acc["at"] + 1).cast("int"), F.length(p["t"]))))

    clean = F.array_join(F.transform(_pieces(text), clean_piece), "")
    keyed = docs.withColumn("__k", F.xxhash64(F.coalesce(text, F.lit(""))))
    joined = keyed.join(spans, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__key")), "left")
    return joined.withColumn(text_col, F.when(F.col("__spans").isNotNull(), clean).otherwise(text)).select(*docs.columns)
