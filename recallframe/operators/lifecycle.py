"""Evidence, candidates, reviews and cards as set-based replays of append-only logs.

Times are microseconds since the epoch (long). A scope is (tenant_id, user_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from recallframe.functions.text import identity_key

SCOPE = ["tenant_id", "user_id"]


def append_evidence(existing: DataFrame, log: DataFrame) -> DataFrame:
    """New evidence of ``log``: the first delivery (by seq) of each id that ``existing`` lacks."""
    key = [*SCOPE, "id"]
    fresh = log.join(existing.select(*key), key, "left_anti")
    first = Window.partitionBy(*key).orderBy("seq")
    return fresh.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def create_candidates(requests: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Requests with at least one source, none twice, all in scope."""
    known = evidence.select(*SCOPE, F.col("id").alias("evidence_id"), F.lit(1).alias("known"))
    checked = links.join(known, [*SCOPE, "evidence_id"], "left").groupBy(*SCOPE, "candidate_id").agg(
        F.count("*").alias("n"), F.count_distinct("evidence_id").alias("different"), F.count("known").alias("found")
    )
    good = checked.where("n = different and n = found").select(*SCOPE, F.col("candidate_id").alias("id"))
    return requests.join(good, [*SCOPE, "id"], "left_semi")


def candidates_with_sources(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """Candidates with their source ids in order; none gives an empty array."""
    sources = links.groupBy(*SCOPE, F.col("candidate_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("source_order", "evidence_id"))).alias("s"))
    joined = candidates.join(sources, [*SCOPE, "id"], "left")
    return joined.withColumn("source_event_ids", F.coalesce(F.col("s.evidence_id"), F.array().cast("array<string>"))).drop("s")


def review_status(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Candidates with their status: the first review decides, pending without one."""
    first = Window.partitionBy(*SCOPE, "candidate_id").orderBy("commit_seq")
    decided = reviews.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    decided = decided.select(*SCOPE, F.col("candidate_id").alias("id"), F.when(F.col("decision") == "approve", "approved").otherwise("rejected").alias("status"))
    return candidates.join(decided, [*SCOPE, "id"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def _epochs(events: DataFrame, erasures: DataFrame) -> DataFrame:
    """Events with erasure_epoch, the erasures of their scope up to them, and erasure_count, all of these.

    A scope's erasures become one short array, so a scope that holds many events
    isn't gathered in one task.
    """
    marks = erasures.groupBy(*SCOPE).agg(F.collect_list("commit_seq").alias("__marks"))
    joined = events.join(marks, SCOPE, "left").withColumn("__marks", F.coalesce("__marks", F.array().cast("array<long>")))
    before = F.size(F.filter("__marks", lambda s: s <= F.col("commit_seq"))).cast("long")
    return joined.withColumn("erasure_epoch", before).withColumn("erasure_count", F.size("__marks").cast("long")).drop("__marks")


def first_reviews(reviews: DataFrame) -> DataFrame:
    """The review that decided each candidate: the first one committed. Later ones change nothing."""
    first = F.min(F.struct("commit_seq", "reviewed_us", "decision")).alias("r")
    return reviews.groupBy(*SCOPE, "candidate_id").agg(first).select(*SCOPE, "candidate_id", "r.*")


def _chain() -> WindowSpec:
    """An identity's approvals between two erasures, in commit order. Those of one commit go by id, so that the order is the same in every run and window."""
    return Window.partitionBy(*SCOPE, "erasure_epoch", "identity_key").orderBy("commit_seq", "id")


def card_versions(candidates: DataFrame, reviews: DataFrame, erasures: DataFrame) -> DataFrame:
    """All card versions that approvals made, with what became of them.

    Per scope, erasure epoch and identity, versions count up in commit order, then by id.
    Times are strictly increasing: created_n = max(base_n, created_(n-1) + 1),
    in closed form n + max over i <= n of (base_i - i). A version is superseded
    at the next one's time. ``erased`` marks epochs that a later erasure ended.
    """
    approved = first_reviews(reviews).where("decision = 'approve'").select(*SCOPE, F.col("candidate_id").alias("id"), "reviewed_us", "commit_seq")
    cards = candidates.join(approved, [*SCOPE, "id"]).withColumn(
        "identity_key", identity_key(*[F.col(c) for c in ("kind", "category", "memory_key", "person", "relationship")])
    )
    placed = _epochs(cards, erasures)
    chain = _chain()
    base = F.greatest("reviewed_us", "created_us")
    versioned = placed.withColumn("version", F.row_number().over(chain))
    upto = chain.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timed = versioned.withColumn("card_created_us", F.col("version") + F.max(base - F.col("version")).over(upto))
    done = timed.withColumn("superseded_us", F.lead("card_created_us").over(chain))
    return done.withColumn("status", F.when(F.col("superseded_us").isNull(), "active").otherwise("superseded")).withColumn(
        "erased", F.col("erasure_epoch") < F.col("erasure_count")
    )


def current_cards(versions: DataFrame) -> DataFrame:
    """The cards that erasures left, under their card columns."""
    return versions.where(~F.col("erased")).select(
        *SCOPE, F.concat(F.lit("m"), F.substring("id", 2, 40)).alias("id"), F.col("id").alias("candidate_id"), "identity_key", "kind", "category",
        "memory_key", "value", "person", "relationship", "backstory", "version", "status", F.col("card_created_us").alias("created_us"), "superseded_us", "expires_us",
    )


def serviceable(as_of_us: Column) -> Column:
    """Active and not expired; a card that expires at ``as_of`` is expired."""
    return (F.col("status") == "active") & (F.col("expires_us").isNull() | (F.col("expires_us") > as_of_us))


def identity_chains(versions: DataFrame) -> DataFrame:
    return versions.where(~F.col("erased")).groupBy(*SCOPE, "identity_key").agg(F.max("version").alias("latest_version"), F.max("card_created_us").alias("latest_us"))


#: What moves a scope's revision on; new evidence, candidates and rejections don't.
BUMPS = ["approve", "forget", "embedding", "finalize", "repair", "promotion"]


def revision_bumps(
    reviews: DataFrame, erasures: DataFrame, embeddings: DataFrame | None = None, finalized: DataFrame | None = None, repairs: DataFrame | None = None, promotions: DataFrame | None = None
) -> DataFrame:
    """(scope, commit_seq, kind): one row for each time that a scope's revision goes up.

    Approvals, of each candidate's first review; erasures, of unknown scopes too;
    ``embeddings`` and ``finalized`` (scope, commit_seq, bumps_revision), one for each
    row whose vector changed what is served; ``repairs`` (scope, commit_seq,
    bumps_scope) and ``promotions`` (scope, commit_seq), once a scope for each commit,
    however many of its cards one touches.
    """
    row = lambda df, kind: df.select(*SCOPE, F.col("commit_seq").cast("long").alias("commit_seq"), F.lit(kind).alias("kind"))
    bumps = row(first_reviews(reviews).where("decision = 'approve'"), "approve").unionByName(row(erasures, "forget"))
    for rows, kind in ((embeddings, "embedding"), (finalized, "finalize")):
        if rows is not None:
            bumps = bumps.unionByName(row(rows.where("bumps_revision"), kind))
    if repairs is not None:
        bumps = bumps.unionByName(row(repairs.where("bumps_scope"), "repair").distinct())
    if promotions is not None:
        bumps = bumps.unionByName(row(promotions, "promotion").distinct())
    return bumps


def context_revisions(scopes: DataFrame, bumps: DataFrame, upto: int | None = None) -> DataFrame:
    """(scope, context_revision) after all bumps, or those up to a commit; 0 without any. Counts are summed before they are shuffled."""
    counted = (bumps if upto is None else bumps.where(F.col("commit_seq") <= upto)).groupBy(*SCOPE).agg(F.count("*").alias("n"))
    return scopes.join(counted, SCOPE, "left").select(*SCOPE, F.coalesce("n", F.lit(0)).alias("context_revision"))


def revision_log(bumps: DataFrame) -> DataFrame:
    """(scope, commit_seq, n_bumps, context_revision): each commit's bumps of a scope and the revision after it. A scope's commits are summed first, so a scope is as many rows as it has commits."""
    each = bumps.groupBy(*SCOPE, "commit_seq").agg(F.count("*").alias("n_bumps"))
    upto = Window.partitionBy(*SCOPE).orderBy("commit_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.withColumn("context_revision", F.sum("n_bumps").over(upto))


def context_revision(scopes: DataFrame, reviews: DataFrame, erasures: DataFrame) -> DataFrame:
    """Revision of every scope by approvals and erasures alone."""
    return context_revisions(scopes, revision_bumps(reviews, erasures))


def forget_receipt(erasures: DataFrame, evidence: DataFrame, candidates: DataFrame, cards: DataFrame) -> DataFrame:
    """Rows per erased scope that go: evidence, candidates, cards."""
    scopes = erasures.select(*SCOPE).distinct()
    out = scopes
    for name, rows in (("evidence_deleted", evidence), ("candidates_deleted", candidates), ("cards_deleted", cards)):
        out = out.join(erased(rows, erasures).groupBy(*SCOPE).agg(F.count("*").alias(name)), SCOPE, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def _erased(rows: DataFrame, erasures: DataFrame, how: str) -> DataFrame:
    last = erasures.groupBy(*[F.col(c).alias(f"__{c}") for c in SCOPE]).agg(F.max("commit_seq").alias("__seq"))
    met = (F.col("tenant_id") == F.col("__tenant_id")) & (F.col("user_id") == F.col("__user_id"))
    return rows.join(last, met & (F.col("commit_seq") < F.col("__seq")) if "commit_seq" in rows.columns else met, how)


def erased(rows: DataFrame, erasures: DataFrame) -> DataFrame:
    """Rows of erased scopes; where rows carry a commit_seq, those written before the scope's last erasure."""
    return _erased(rows, erasures, "left_semi")


def forget(rows: DataFrame, erasures: DataFrame) -> DataFrame:
    """The rows that ``erased`` doesn't hold."""
    return _erased(rows, erasures, "left_anti")


def residue(tables: dict[str, DataFrame], scopes: DataFrame) -> DataFrame:
    """Rows left per scope and table; a clean scope has zeros throughout."""
    counts = None
    for name, rows in tables.items():
        one = rows.groupBy(*SCOPE).agg(F.count("*").alias("n")).withColumn("table_name", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    names = F.explode(F.array(*[F.lit(n) for n in tables])).alias("table_name")
    wanted = scopes.select(*SCOPE, names)
    return wanted.join(counts, [*SCOPE, "table_name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def cleanup(left: DataFrame, prefix: str) -> DataFrame:
    """Per scope of ``residue``: rows left, and whether the scope may be cleaned up: only one of the prefix, and only if all its tables are empty."""
    totals = left.groupBy(*SCOPE).agg(F.sum("n").alias("n_left"))
    verdict = F.when(~F.col("tenant_id").startswith(prefix), "not_allowed").when(F.col("n_left") > 0, "residue").otherwise("cleaned")
    return totals.withColumn("verdict", verdict)


def extraction_metadata(run: Column, protocol: str, grounding: str, n_sources: Column) -> Column:
    """The four entries that an extraction stamps on its candidates; a run's id comes from its key."""
    run_id = F.concat(F.lit("extract_"), F.substring(F.sha2(run, 256), 1, 32))
    return F.create_map(
        F.lit("extraction_run_id"), run_id, F.lit("extraction_protocol"), F.lit(protocol), F.lit("extraction_grounding"), F.lit(grounding),
        F.lit("extraction_source_count"), n_sources.cast("string"),
    )


def candidate_batches(requests: DataFrame, good: DataFrame, revisions: DataFrame) -> DataFrame:
    """Batches (scope, batch_id, expected_revision, id): accepted if every member is good and the scope's revision is the expected one."""
    members = requests.join(good.select(*SCOPE, "id", F.lit(True).alias("ok")), [*SCOPE, "id"], "left").join(revisions, SCOPE, "left")
    fenced = F.coalesce("context_revision", F.lit(0)) == F.col("expected_revision")
    checked = members.groupBy(*SCOPE, "batch_id").agg(F.count("*").alias("n"), F.count("ok").alias("n_ok"), F.bool_and(fenced).alias("fenced"))
    return checked.withColumn("verdict", F.when(~F.col("fenced"), "stale_revision").when(F.col("n") > F.col("n_ok"), "invalid").otherwise("accepted")).drop("fenced")


def multi_key_lookup(keys: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the wanted (scope, id) keys."""
    return rows.join(keys.select(*SCOPE, "id").distinct(), [*SCOPE, "id"], "left_semi")


def as_of(versions: DataFrame, at: Column) -> DataFrame:
    """The card versions that were active at a time, whatever came later; erasures aside."""
    active = (F.col("card_created_us") <= at) & (F.col("superseded_us").isNull() | (F.col("superseded_us") > at))
    return versions.where(active & (F.col("expires_us").isNull() | (F.col("expires_us") > at)))


def lifetimes(versions: DataFrame, erasures: DataFrame) -> DataFrame:
    """Card versions with the commits between which they live: from ``commit_seq`` on and before ``until_seq`` (null: still), which is that of the next version or of the scope's next erasure."""
    marks = erasures.groupBy(*SCOPE).agg(F.collect_list("commit_seq").alias("__marks"))
    joined = versions.withColumn("__next", F.lead("commit_seq").over(_chain())).join(marks, SCOPE, "left")
    erased_at = F.array_min(F.filter(F.coalesce("__marks", F.array().cast("array<long>")), lambda s: s > F.col("commit_seq")))
    return joined.withColumn("until_seq", F.least("__next", erased_at)).drop("__marks", "__next")


def replay_queries(queries: DataFrame, versions: DataFrame, erasures: DataFrame) -> DataFrame:
    """The cards that each query (query_id, scope, seq, at_us) of a timeline could see, as (query_id, scope, id, version).

    ``seq`` is the query's place among the commits of reviews and erasures, ``at_us``
    its own time. A card is seen if it was approved before, neither replaced nor
    erased since, and isn't expired at that time; what comes later doesn't matter.
    """
    lives = lifetimes(versions, erasures).select(*SCOPE, "id", "version", "commit_seq", "until_seq", "expires_us")
    seen = queries.select("query_id", *SCOPE, "seq", "at_us").join(lives, SCOPE)
    live = (F.col("commit_seq") < F.col("seq")) & (F.col("until_seq").isNull() | (F.col("until_seq") >= F.col("seq")))
    return seen.where(live & (F.col("expires_us").isNull() | (F.col("expires_us") > F.col("at_us")))).select("query_id", *SCOPE, "id", "version")
