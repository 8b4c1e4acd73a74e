"""Retrieval evaluation: recall, MRR, nDCG, pass rate, policy counts, latencies, bootstrap intervals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallframe.functions.rng import bounded_draws
from recallframe.operators.lifecycle import SCOPE

SEED, RESAMPLES = 2026081901, 10_000


def judged(hits: DataFrame, relevance: DataFrame) -> DataFrame:
    """Hits with the relevance of their candidate, 0 if it has none; judgments hold in every arm."""
    return hits.join(relevance, ["query_id", "candidate_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))


def quality(hits: DataFrame, relevance: DataFrame, k: int, ndcg_k: int, arms: list[str] | None = None) -> DataFrame:
    """Per query with judgments: recall at k, reciprocal rank, nDCG, and whether all relevant are within k.

    With ``arms``, hits have a column arm, and every judged query has a row in each of
    these arms, of zeros where the arm found nothing.
    """
    key = ["query_id"] if arms is None else ["arm", "query_id"]
    asked = relevance.where("relevance > 0")
    ideal_rank = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "candidate_id")
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    ideal = asked.withColumn("i", F.row_number().over(ideal_rank)).groupBy("query_id").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("i") <= ndcg_k, gain / F.log2(F.col("i") + 1.0))).alias("ideal")
    )
    found = judged(hits, relevance).where("relevance > 0").groupBy(*key).agg(
        F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= ndcg_k, gain / F.log2(F.col("rank") + 1.0))).alias("dcg")
    )
    if arms is not None:
        ideal = ideal.withColumn("arm", F.explode(F.lit(arms)))
    rows = ideal.join(found, key, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return rows.select(
        *key, F.round(F.col("found") / F.col("n"), 9).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 9).alias("mrr"),
        F.round(F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)), 9).alias("ndcg"), (F.col("found") == F.col("n")).alias("passed"),
    )


def arm_aggregate(per_query: DataFrame, *arm: str) -> DataFrame:
    """Macro averages over the queries that have judgments, by the columns ``arm``."""
    return per_query.groupBy(*arm).agg(
        F.count("*").alias("quality_query_count"), *[F.round(F.avg(m), 6).alias(m) for m in ("recall", "mrr", "ndcg")], F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"), F.bool_and("passed").alias("all_passed")
    )


COUNTERS = ["forbidden_hits", "unknown_hits", "scope_violations", "non_active_hits", "expired_hits", "duplicate_hits", "over_limit_hits", "missing_sources"]


#: What ``source_policy`` counts.
SOURCE_COUNTERS = ["missing_sources", "reordered_sources", "unknown_source_ids", "source_scope_violations", "evidence_payload_violations"]


def policy(hits: DataFrame, queries: DataFrame, cards: DataFrame, links: DataFrame, forbidden: DataFrame, limit: int, as_of: int, require_empty: DataFrame | None = None) -> DataFrame:
    """Violation counts per query over all observed hits (query_id, the hit's own scope, id, rank), and whether the query passed.

    A card is known by scope and id: one of the same id elsewhere says nothing about
    a hit. ``forbidden`` names cards as hits do. Queries of ``require_empty`` (query_id) fail if they have any hit. A query
    without hits has zeros and passes. Null ids don't count.
    """
    key = ["query_id", *SCOPE, "id"]
    owned = cards.select(*SCOPE, "id", "status", "expires_us", "candidate_id", F.lit(True).alias("known"))
    times = Window.partitionBy(*key).orderBy("rank")
    seen = hits.select(*key, "rank").withColumn("turn", F.row_number().over(times)).join(owned, [*SCOPE, "id"], "left")
    seen = seen.join(links.select(*SCOPE, "candidate_id").distinct().withColumn("sourced", F.lit(1)), [*SCOPE, "candidate_id"], "left")
    seen = seen.join(forbidden.select(*key).distinct().withColumn("forbidden", F.lit(1)), key, "left")
    rows = queries.select("query_id", F.struct(*SCOPE).alias("asked")).join(seen, "query_id", "left")
    hit = F.col("id").isNotNull()
    known = F.coalesce("known", F.lit(False))
    counted = rows.groupBy("query_id").agg(
        F.count("id").alias("hits"), F.count("forbidden").alias("forbidden_hits"), F.count_if(hit & ~known).alias("unknown_hits"),
        F.count_if(known & (F.struct(*SCOPE) != F.col("asked"))).alias("scope_violations"),
        F.count_if(known & (F.col("status") != "active")).alias("non_active_hits"), F.count_if(known & (F.col("expires_us") <= as_of)).alias("expired_hits"),
        F.count_if(F.col("turn") > 1).alias("duplicate_hits"), F.count_if(F.col("rank") > limit).alias("over_limit_hits"), F.count_if(known & F.col("sourced").isNull()).alias("missing_sources"),
    )
    if require_empty is None:
        counted = counted.withColumn("require_empty_failure", F.lit(False))
    else:
        counted = counted.join(require_empty.select("query_id").distinct().withColumn("__empty", F.lit(True)), "query_id", "left")
        counted = counted.withColumn("require_empty_failure", F.coalesce("__empty", F.lit(False)) & (F.col("hits") > 0)).drop("__empty")
    clean = sum((F.col(c) for c in COUNTERS), F.lit(0)) == 0
    return counted.withColumn("passed", clean & ~F.col("require_empty_failure"))


def policy_totals(per_query: DataFrame) -> DataFrame:
    """Counters of ``policy``, and those of ``source_policy`` where they are joined to it, summed per arm (column arm; null is an arm of its own), failures of empty queries, and whether all passed."""
    sums = [F.sum(c).alias(c) for c in (*COUNTERS, *[c for c in SOURCE_COUNTERS if c in per_query.columns and c not in COUNTERS])]
    return per_query.groupBy("arm").agg(F.count("*").alias("query_count"), *sums, F.count_if("require_empty_failure").alias("require_empty_failures"), F.bool_and("passed").alias("all_passed"))


def latency(samples: DataFrame, group: str, value: str) -> DataFrame:
    """Nearest-rank p50 and p95: the ceil(p * n)-th smallest."""
    return samples.groupBy(group).agg(
        F.count("*").alias("n"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"), F.max(value).alias("largest")
    )


def ranking_stability(first: DataFrame, second: DataFrame) -> DataFrame:
    """Whether two runs gave each query the same ids and scores in the same order."""
    lists = [r.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias(f"l{i}")) for i, r in enumerate((first, second))]
    return lists[0].join(lists[1], "query_id", "full_outer").select("query_id", F.col("l0").eqNullSafe(F.col("l1")).alias("stable"))


def bootstrap(per_query: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """95 % intervals of the four means per arm (columns arm, query_id, recall, mrr, ndcg, passed).

    One reproducible stream of draws runs through all resamples of an arm, in the
    order of query ids, so an arm is one group; it holds as many rows as an
    evaluation has queries.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        values = pdf.sort_values("query_id")[["recall", "mrr", "ndcg", "passed"]].to_numpy(float)
        n = len(values)
        draws = bounded_draws(seed, n)
        sums = np.zeros((resamples, values.shape[1]))
        block = max(1, (1 << 20) // n)
        for at in range(0, resamples, block):
            picked = draws(min(block, resamples - at) * n).reshape(-1, n)
            total = np.zeros((len(picked), values.shape[1]))
            for k in range(n):  # in the order of draws, as sums depend on it
                total += values[picked[:, k]]
            sums[at : at + block] = total / n
        sums.sort(axis=0)
        low, high = (-(-resamples * b // 10_000) - 1 for b in (250, 9750))
        out = []
        for i, metric in enumerate(("recall", "mrr", "ndcg", "pass_rate")):
            lo, hi = float(sums[low, i]), float(sums[high, i])
            out.append((pdf["arm"].iloc[0], metric, float(values[:, i].sum() / n), lo, hi, lo == hi and lo in (0.0, 1.0)))
        return pd.DataFrame(out, columns=["arm", "metric", "estimate", "lower", "upper", "boundary_degenerate"])

    return per_query.groupBy("arm").applyInPandas(work, "arm string, metric string, estimate double, lower double, upper double, boundary_degenerate boolean")


def source_policy(packs: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per query what is wrong with the sources of its items (query_id, scope, id, candidate_id, sources: array of tenant_id, user_id, id and content).

    Counts sources that their own scope lacks, are of another scope or differ in
    content, and items with another number of sources than expected, or another
    order. Links and evidence of other scopes don't count, whatever their ids.
    """
    wanted = links.groupBy(*SCOPE, "candidate_id").agg(F.array_sort(F.collect_list(F.struct("source_order", "evidence_id")))["evidence_id"].alias("wanted"))
    lists = packs.join(wanted, [*SCOPE, "candidate_id"], "left").withColumn("wanted", F.coalesce("wanted", F.array().cast("array<string>")))
    short = F.size("sources") != F.size("wanted")
    by_item = lists.groupBy("query_id").agg(F.count_if(short).alias("missing_sources"), F.count_if(~short & (F.col("sources.id") != F.col("wanted"))).alias("reordered_sources"))
    known = evidence.select(*SCOPE, F.col("id").alias("source_id"), F.col("content").alias("expected"), F.lit(True).alias("known"))
    asked = F.struct(*SCOPE).alias("asked")
    each = packs.select("query_id", asked, F.explode("sources").alias("s")).select("query_id", "asked", *[F.col(f"s.{c}").alias(c) for c in SCOPE], F.col("s.id").alias("source_id"), F.col("s.content").alias("content"))
    by_source = each.join(known, [*SCOPE, "source_id"], "left").groupBy("query_id").agg(
        F.count_if(F.col("known").isNull()).alias("unknown_source_ids"), F.count_if(F.struct(*SCOPE) != F.col("asked")).alias("source_scope_violations"),
        F.count_if(F.col("known") & ~F.col("expected").eqNullSafe(F.col("content"))).alias("evidence_payload_violations"),
    )
    return by_item.join(by_source, "query_id", "left").select("query_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in SOURCE_COUNTERS])
