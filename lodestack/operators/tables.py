"""Relational building blocks of the catalogue: latest rows, children, paging, replay and audits.

Windows are always partitioned by the entity they describe; where only one row of a group is needed
the operators aggregate (``max_by``) instead, which combines before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` of every key, by aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def with_children(parents: DataFrame, children: DataFrame, key: str, order: Column, fields: list[str], name: str = "children") -> DataFrame:
    """Parents with an ordered array of child structs; parents without children get an empty one."""
    child = F.struct(order.alias("_o"), *fields)
    nested = children.groupBy(key).agg(F.array_sort(F.collect_list(child)).alias("_c"))
    nested = nested.select(key, F.transform("_c", lambda c: F.struct(*[c[f].alias(f) for f in fields])).alias(name))
    kind = dict(nested.dtypes)[name]
    return parents.join(nested, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def first_position_last_content(df: DataFrame, keys: list[str], position: str, content: list[str]) -> DataFrame:
    """One row per key: where it first appears, with the content of its last appearance."""
    return df.groupBy(*keys).agg(F.min(position).alias(position), F.max_by(F.struct(*content), F.struct(position, *content)).alias("_c")).select(*keys, position, "_c.*")


def dedupe_then_cap(df: DataFrame, group: str, keys: list[str], position: str, content: list[str], n: int) -> DataFrame:
    """Per group: deduplicate by key, order by first appearance, keep n, and flag what was cut."""
    rows = first_position_last_content(df, [group, *keys], position, content)
    w = Window.partitionBy(group).orderBy(position)
    rows = rows.withColumns({"place": F.row_number().over(w), "limited": F.count("*").over(Window.partitionBy(group)) > n})
    return rows.filter(F.col("place") <= n)


def bounded_rows(df: DataFrame, group: str, order: list[Column | str], n: int) -> DataFrame:
    """First n rows of each group with their rank and the group's total."""
    return df.withColumns({"rank": F.row_number().over(Window.partitionBy(group).orderBy(*order)), "total": F.count("*").over(Window.partitionBy(group))}).filter(F.col("rank") <= n)


def numbered_pages(df: DataFrame, group: str, order: list[Column | str], size: int) -> DataFrame:
    """Page number, position inside the page, and whether the group has later pages."""
    rn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    total = F.count("*").over(Window.partitionBy(group))
    out = df.withColumns({"_rn": rn, "_all": total}).withColumns({"page": F.floor((F.col("_rn") - 1) / size).cast("int"), "pos": ((F.col("_rn") - 1) % size).cast("int")})
    return out.withColumn("has_more", (F.col("page") + 1) * size < F.col("_all")).drop("_rn", "_all")


def read_after(df: DataFrame, time: str, key: str, cursor: tuple | None, n: int) -> DataFrame:
    """Newest first, strictly below the cursor; n + 1 rows so that the caller sees if more follow."""
    if cursor is not None:
        df = df.filter((F.col(time) < F.lit(cursor[0])) | ((F.col(time) == F.lit(cursor[0])) & (F.col(key) < F.lit(cursor[1]))))
    return df.orderBy(F.desc(time), F.desc(key)).limit(n + 1)


def audit_rules(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every broken row rule, in one pass."""
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))


def audit_unique(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key, F.lit("unique").alias("rule"))


def audit_foreign(df: DataFrame, key: str, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    orphans = df.join(parents.select(F.col(parent_key).alias(column)), column, "left_anti")
    return orphans.filter(F.col(column).isNotNull()).select(key, F.lit("foreign").alias("rule"))


def select_resources(df: DataFrame, group: str, order: list[Column | str], passed: str, max_checks: int = 3, max_saved: int = 1) -> DataFrame:
    """Check at most ``max_checks`` resources in order and stop once ``max_saved`` have passed."""
    w = Window.partitionBy(group).orderBy(*order)
    before = F.coalesce(F.sum(F.col(passed).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = df.withColumns({"check": F.row_number().over(w), "_before": before, "_all": F.count("*").over(Window.partitionBy(group))})
    out = out.filter((F.col("check") <= max_checks) & (F.col("_before") < max_saved))
    return out.withColumns({"kept": F.col(passed), "limited": F.col("_all") > max_checks}).drop("_before", "_all")


def method_fallback(df: DataFrame, group: str, order: str, terminal: str) -> DataFrame:
    """Methods in priority order up to and including the first that ends the record."""
    stop = df.groupBy(group).agg(F.min(F.when(F.col(terminal), F.col(order))).alias("_stop"))
    return df.join(stop, group).filter(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop")


def provider_results(parts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows with ``provider``, ranks) of readers that give a frame each, in their order."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("provider", F.lit(n)) for n, df in parts.items()])
    return rows, rows.sparkSession.createDataFrame([(n, i) for i, n in enumerate(parts)], "provider string, provider_rank int")


def combine_providers(rows: DataFrame, ranks: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with provider_rank, warnings) of all providers' results in one table with a ``provider`` column.

    ``ranks`` (provider, provider_rank) has every provider that was asked; ``status`` (provider, ok) tells
    which failed.  A failed one only warns: its rows go, and a warning names it, whose code is all_failed
    where every provider failed.  One pass over the rows, whatever the number of providers."""
    failed = status.filter("ok = false").select("provider").distinct()
    code = "all_failed" if ranks.join(failed, "provider", "left_anti").isEmpty() else "incomplete"
    return rows.join(ranks.join(failed, "provider", "left_anti"), "provider"), failed.withColumn("code", F.lit(code))


def plan_collection(candidates: DataFrame, collected: DataFrame, active: DataFrame) -> DataFrame:
    """(candidate_id, url, action, target): reuse a collected dataset, join the newest active job,
    or open a new job; of several candidates for one new url the first opens it."""
    newest = active.groupBy("url").agg(F.max("job_id").alias("job_id"))
    rows = candidates.join(collected.select("url", "dataset_id"), "url", "left").join(newest, "url", "left")
    first = rows.filter("dataset_id is null and job_id is null").groupBy("url").agg(F.min("candidate_id").alias("opener"))
    rows = rows.join(first, "url", "left")
    action = F.when(F.col("dataset_id").isNotNull(), "already_collected").when(F.col("job_id").isNotNull(), "join_active").when(F.col("candidate_id") == F.col("opener"), "new_job").otherwise("share_new_job")
    return rows.select("candidate_id", "url", action.alias("action"), F.coalesce("dataset_id", "job_id", "opener").alias("target"))


def compare_snapshots(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Full outer comparison: both sides as structs, and what happened to the key."""
    def side(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        return df.select(key, F.struct(*rest).alias(name))

    both = side(before, "before").join(side(after, "after"), key, "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return both.withColumn("change", change)


def close_stale(df: DataFrame, status: str, running: tuple[str, ...], code: str) -> DataFrame:
    """Rows left running by an earlier run become errors with a diagnostic."""
    stale = F.col(status).isin(*running)
    return df.withColumns({"code": F.when(stale, code), status: F.when(stale, "error").otherwise(F.col(status))})


def evidence_checksum(fields: list[str]) -> Column:
    """SHA-256 over one JSON object of the fields in name order; nulls are written, so they differ from blanks."""
    return F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {"ignoreNullFields": "false"}), 256)
