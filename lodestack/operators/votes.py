"""Ensembles of votes: decisions, labels, reasons, progress, reuse and audits.

A vote table has (item_id, voter_id, voter_order, status, label) and, where used, reason and
missing_information.  Every aggregate here combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCEPTING = ("relevant", "somewhat_relevant")
#: From most to least conservative; ties take the first.
CAUTION = ("not_relevant", "insufficient_information", "somewhat_relevant", "relevant")
MIN_ACCEPT, MIN_SUCCESS = 2, 3


def succeeded() -> Column:
    return F.col("status") == "succeeded"


def accepts() -> Column:
    return succeeded() & F.col("label").isin(*ACCEPTING)


def ensemble_expr(min_accept: int = MIN_ACCEPT, min_success: int = MIN_SUCCESS) -> dict[str, Column]:
    """The decision as aggregate expressions over the votes of a group."""
    good, yes = F.count_if(succeeded()), F.count_if(accepts())
    no = good - yes
    decision = F.when(good < min_success, "incomplete").when(yes >= min_accept, "accepted").otherwise("rejected")
    reason = F.when(good < min_success, "classification_incomplete").when(yes >= min_accept, "enough_accept_votes").when(no >= min_accept, "rejected_by_majority").otherwise("insufficient_accept_votes")
    return {"successes": good, "accepts": yes, "rejects": no, "decision": decision, "decision_reason": reason}


def vote_ensemble(votes: DataFrame, min_accept: int = MIN_ACCEPT, min_success: int = MIN_SUCCESS) -> DataFrame:
    """One decision per item, with the supporting and the failed voters in voter order."""
    def voters(which: Column) -> Column:
        held = F.collect_list(F.when(which, F.struct("voter_order", "voter_id")))
        return F.array_join(F.transform(F.array_sort(held), lambda s: s["voter_id"]), ",")

    out = votes.groupBy("item_id").agg(*[e.alias(n) for n, e in ensemble_expr(min_accept, min_success).items()], voters(accepts()).alias("yes_voters"), voters(succeeded() & ~F.col("label").isin(*ACCEPTING)).alias("no_voters"), voters(~succeeded()).alias("failed_voters"))
    support = F.when(F.col("decision") == "accepted", F.col("yes_voters")).when(F.col("decision") == "rejected", F.col("no_voters")).otherwise("")
    return out.select("item_id", "decision", "decision_reason", "successes", "accepts", "rejects", support.alias("supporting"), "failed_voters")


def supporting_votes(votes: DataFrame, min_accept: int = MIN_ACCEPT, min_success: int = MIN_SUCCESS) -> DataFrame:
    """The votes that agree with their item's decision."""
    w = Window.partitionBy("item_id")  # a group holds one row per voter
    yes = F.count_if(accepts()).over(w) >= min_accept
    enough = F.count_if(succeeded()).over(w) >= min_success
    return votes.withColumns({"_yes": yes, "_ok": enough}).filter(F.col("_ok") & succeeded() & (accepts() == F.col("_yes"))).drop("_yes", "_ok")


def majority_label(votes: DataFrame) -> DataFrame:
    """The most frequent label among supporting votes; ties go to the most conservative."""
    rank = F.array_position(F.array(*map(F.lit, CAUTION)), F.col("label"))
    counts = supporting_votes(votes).groupBy("item_id", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("item_id").agg(F.min_by("label", F.struct(-F.col("n"), rank)).alias("label"), F.max("n").alias("label_votes"))


def decision_reason_text(votes: DataFrame) -> DataFrame:
    """First non-empty reason of the winning label in voter order, and ordered distinct missing items."""
    own = supporting_votes(votes)
    rows = own.join(majority_label(votes).select("item_id", F.col("label").alias("won")), "item_id").filter("label = won")
    items = F.array_sort(F.collect_list(F.struct("voter_order", "missing_information")))
    flat = F.array_distinct(F.flatten(F.transform(items, lambda s: s["missing_information"])))
    return rows.groupBy("item_id").agg(F.coalesce(F.min_by("reason", F.when(F.trim("reason") != "", F.col("voter_order"))), F.lit("")).alias("reason"), F.array_join(flat, "|").alias("missing"))


def vote_progress(votes: DataFrame) -> DataFrame:
    return votes.groupBy("item_id").agg(F.count("*").alias("total"), F.count_if(succeeded()).alias("succeeded"), F.count_if(F.col("status") == "error").alias("failed"))


def memoised_votes(wanted: DataFrame, known: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(reused, missing): wanted votes that a succeeded known vote answers, and those to score."""
    good = known.filter(succeeded()).dropDuplicates(key)
    return wanted.join(good, key), wanted.join(good.select(*key), key, "left_anti")


def redact_failures(votes: DataFrame, code: Column) -> DataFrame:
    """Failures as (voter, controlled code) in voter order; the voter's own text is dropped."""
    held = F.collect_list(F.when(~succeeded(), F.struct("voter_order", "voter_id", code.alias("code"))))
    return votes.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(held), lambda s: F.concat(s["voter_id"], F.lit(":"), s["code"])), ",").alias("failures"))


def check_vote_response(responses: DataFrame, body: str = "body") -> DataFrame:
    """Accept a model's JSON vote only if label, reason and missing information fit the contract."""
    parsed = F.from_json(F.col(body), "label string, reason string, missing_information array<string>")
    out = responses.withColumn("_v", parsed)
    missing = F.coalesce("_v.missing_information", F.array().cast("array<string>"))
    reason = F.trim(F.col("_v.reason"))
    ok = F.col("_v.label").isin(*CAUTION) & (F.length(reason).between(1, 2000)) & (F.size(missing) <= 20) & F.forall(missing, lambda m: F.length(m).between(1, 500))
    ok = ok & ((F.size(missing) == 0) | (F.col("_v.label") == "insufficient_information"))
    good = F.coalesce(ok, F.lit(False))
    return out.select(*responses.columns, F.when(good, "succeeded").otherwise("error").alias("status"), F.when(good, F.col("_v.label")).alias("label"), F.when(~good, "llm_invalid_response").alias("code"))


def audit_decisions(stored: DataFrame, votes: DataFrame) -> DataFrame:
    """Rules that a stored (item_id, accepted, label, accepts, total) row breaks against its votes."""
    recount = votes.groupBy("item_id").agg(F.count_if(accepts()).alias("_yes"), F.count("*").alias("_all"))
    r = stored.join(recount, "item_id", "left")
    label_accepts = F.col("label").isin(*ACCEPTING)
    rules = {
        "label_mismatch": F.col("accepted") != label_accepts,
        "accept_count": F.col("accepts") != F.coalesce("_yes", F.lit(0)),
        "total_count": F.col("total") != F.coalesce("_all", F.lit(0)),
        "count_bounds": (F.col("accepts") < 0) | (F.col("accepts") > F.col("total")),
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return r.select("item_id", F.explode(broken).alias("rule"))


def attempt_models(attempts: DataFrame, config: DataFrame) -> DataFrame:
    """Model of each attempt from its run's configured voters (first entry of a voter wins)."""
    each = config.select("run_id", F.posexplode("voters").alias("pos", "v")).select("run_id", "pos", F.col("v.voter_id").alias("voter_id"), F.col("v.model").alias("model"))
    first = each.groupBy("run_id", "voter_id").agg(F.min_by("model", "pos").alias("model"))
    return attempts.join(first, ["run_id", "voter_id"], "left")
