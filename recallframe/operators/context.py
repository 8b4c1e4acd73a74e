"""Hydration of ranked hits with their ordered evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallframe.operators.lifecycle import SCOPE, serviceable


def point_lookup(rows: DataFrame, tenant: str, user: str, id_: str) -> DataFrame:
    return rows.where((F.col("tenant_id") == tenant) & (F.col("user_id") == user) & (F.col("id") == id_))


def multi_get(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """requests (request_id, scope, ids) to rows in request order, repeats kept; ``found`` is false on a miss."""
    asked = requests.select("request_id", *SCOPE, F.posexplode("ids").alias("position", "id"))
    known = evidence.select(*SCOPE, "id", "content", F.lit(True).alias("found"))
    return asked.join(known, [*SCOPE, "id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def first_missing(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """(request_id, scope, position, id) of the first id of a request that isn't in its scope: such a request fails as a whole. Requests without a miss, or without ids, don't appear."""
    missed = multi_get(requests, evidence).where(~F.col("found"))
    first = missed.groupBy("request_id", *SCOPE).agg(F.min_by(F.struct("position", "id"), "position").alias("first"))
    return first.select("request_id", *SCOPE, "first.position", "first.id")


def missing_sources(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Links whose evidence isn't in their scope."""
    return links.join(evidence.select(*SCOPE, F.col("id").alias("evidence_id")), [*SCOPE, "evidence_id"], "left_anti")


class Untrusted(RuntimeError):
    """A retriever returned what may not be served."""


def _owned(hits: DataFrame, queries: DataFrame, cards: DataFrame) -> DataFrame:
    """``hits`` with their query's scope and, if their own scope has such a card, its columns. Ids are unique within a scope only.

    Hits that carry tenant_id and user_id are of that scope, others of their query's.
    """
    asked = queries.select("query_id", *[F.col(c).alias(f"asked_{c}") for c in SCOPE])
    scoped = hits.join(asked, "query_id")
    if not set(SCOPE) <= set(hits.columns):
        scoped = scoped.select(*hits.columns, *[f"asked_{c}" for c in SCOPE], *[F.col(f"asked_{c}").alias(c) for c in SCOPE])
    own = cards.select(*SCOPE, "id", "candidate_id", "memory_key", "value", "status", "expires_us", F.lit(True).alias("known"))
    return scoped.join(own, [*SCOPE, "id"], "left")


def untrusted_hits(hits: DataFrame, queries: DataFrame, cards: DataFrame, links: DataFrame, evidence: DataFrame, as_of_us: int) -> DataFrame:
    """(query_id, id, rule) of hits that no pack may hold: of another scope than their query's, unknown or not serviceable, without a source, or with a source that its scope lacks."""
    rows = _owned(hits, queries, cards)
    found = links.join(evidence.select(*SCOPE, F.col("id").alias("evidence_id"), F.lit(1).alias("there")), [*SCOPE, "evidence_id"], "left")
    sources = found.groupBy(*SCOPE, "candidate_id").agg(F.count("*").alias("n"), F.count("there").alias("n_there"))
    rows = rows.join(sources, [*SCOPE, "candidate_id"], "left")
    outside = F.col("tenant_id") != F.col("asked_tenant_id"), F.col("user_id") != F.col("asked_user_id")
    rules = {"out_of_scope": outside[0] | outside[1], "not_serviceable": ~F.coalesce(F.col("known") & serviceable(F.lit(as_of_us)), F.lit(False)), "no_source": F.col("n").isNull(), "missing_source": F.col("n_there") < F.col("n")}
    broken = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))
    return rows.select("query_id", "id", F.explode(broken).alias("rule")).distinct()


def context_items(hits: DataFrame, queries: DataFrame, cards: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Hits with value and evidence ids and contents of their query's scope, in source order.

    Only a scope's own cards and evidence answer its queries, whatever ids others
    use. Hits whose card or evidence is missing don't appear; ``untrusted_hits`` names them.
    """
    same = (F.col("tenant_id") == F.col("asked_tenant_id")) & (F.col("user_id") == F.col("asked_user_id"))
    chosen = _owned(hits, queries, cards).where(same & F.col("known"))
    sources = chosen.select("query_id", "id", *SCOPE, "candidate_id").join(links, [*SCOPE, "candidate_id"]).join(
        evidence.select(*SCOPE, F.col("id").alias("evidence_id"), "content"), [*SCOPE, "evidence_id"]
    )
    packed = sources.groupBy("query_id", "id").agg(F.array_sort(F.collect_list(F.struct("source_order", "evidence_id", "content"))).alias("sources"))
    return chosen.join(packed, ["query_id", "id"]).select("query_id", *SCOPE, "rank", "id", "score", "candidate_id", "memory_key", "value", "sources")


def context_packs(items: DataFrame, queries: DataFrame, as_of_us: int) -> DataFrame:
    """One pack per query with its items in rank order; a query without hits has an empty pack."""
    packed = items.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "memory_key", "value", "sources"))).alias("items"))
    rows = queries.join(packed, "query_id", "left")
    empty = F.array().cast(packed.schema["items"].dataType)
    return rows.select("query_id", *SCOPE, F.col("text").alias("query"), F.coalesce("items", empty).alias("items"), F.lit(as_of_us).alias("generated_us"))
