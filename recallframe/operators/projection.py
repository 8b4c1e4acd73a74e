"""The embedding-projection job machine, coverage, repair and promotion as pure frame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallframe.operators.lifecycle import SCOPE, serviceable

STATES = ["pending", "leased", "retry", "succeeded", "dead", "cancelled"]
CLASSES = ["missing_job", "version_invariant", "in_flight", "dead", "cancelled", "succeeded_missing_embedding", "content_hash_mismatch", "converged"]
# fixed values: the error codes of the job machine, the first four of which may be tried again
ERROR_CODES = [
    "transport", "provider_timeout", "provider_rate_limited", "provider_unavailable", "provider_rejected", "invalid_response",
    "model_mismatch", "dimension_mismatch", "non_finite_vector", "space_conflict", "attempts_exhausted",
]
RETRYABLE = ERROR_CODES[:4]
MAX_ATTEMPTS = 5


def enqueue(cards: DataFrame, targets: DataFrame) -> DataFrame:
    """One pending job per new card and target that enqueues; targets are a handful of rows."""
    open_ = targets.where(F.col("enqueue_new") & F.col("state").isin("shadow", "serving")).select("embedding_space")
    return cards.where("status = 'active'").select(*SCOPE, F.col("id").alias("memory_id"), F.col("version").alias("expected_memory_version")).crossJoin(F.broadcast(open_)).withColumn("state", F.lit("pending"))


def stats(jobs: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("state") == s).alias(s) for s in STATES]
    return jobs.groupBy("embedding_space").agg(
        F.count("*").alias("total"), *counts, F.min(F.when(F.col("state").isin("pending", "retry"), F.col("available_us"))).alias("oldest_available_us"), F.max("attempt_count").alias("max_attempts")
    )


def _open(now: int) -> Column:
    """Pending, waiting to be tried again, or leased beyond its time."""
    return F.col("state").isin("pending", "retry") | ((F.col("state") == "leased") & (F.col("lease_until_us") <= now))


def to_cancel(jobs: DataFrame, cards: DataFrame, targets: DataFrame, now: int) -> DataFrame:
    """Open jobs whose card is gone, inactive, expired or of another version, or whose target is retired."""
    good = cards.where(serviceable(F.lit(now))).select(*SCOPE, F.col("id").alias("memory_id"), F.col("version").alias("expected_memory_version"))
    alive = targets.where("state <> 'retired'").select("embedding_space")
    wanted = jobs.join(good, [*SCOPE, "memory_id", "expected_memory_version"], "left_semi").join(alive, "embedding_space", "left_semi")
    return jobs.where(_open(now)).join(wanted.select("id"), "id", "left_anti")


def dead_lettered(jobs: DataFrame, now: int, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    spent = ((F.col("state") == "retry") | ((F.col("state") == "leased") & (F.col("lease_until_us") <= now))) & (F.col("attempt_count") >= max_attempts)
    return jobs.where(spent).withColumn("state", F.lit("dead")).withColumn("last_error_code", F.lit("attempts_exhausted"))


def claim(jobs: DataFrame, cards: DataFrame, targets: DataFrame, owner: str, n: int, now: int, lease_us: int) -> DataFrame:
    """The ``n`` next runnable jobs of each space, leased to ``owner``. Blocked and retired spaces give none."""
    runnable = ((F.col("state").isin("pending", "retry") & (F.col("available_us") <= now)) | ((F.col("state") == "leased") & (F.col("lease_until_us") <= now)))
    spent = F.col("state").isin("retry", "leased") & (F.col("attempt_count") >= MAX_ATTEMPTS)
    serving = targets.where(~F.col("state").isin("blocked", "retired")).select("embedding_space")
    left = jobs.where(runnable & ~spent).join(serving, "embedding_space", "left_semi").join(to_cancel(jobs, cards, targets, now).select("id"), "id", "left_anti")
    order = Window.partitionBy("embedding_space").orderBy("available_us", "created_us", "id")
    picked = left.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return picked.select(
        "id", *SCOPE, "memory_id", "embedding_space", F.lit("leased").alias("state"), (F.col("attempt_count") + 1).alias("attempt_count"),
        (F.col("lease_version") + 1).alias("lease_version"), F.lit(owner).alias("lease_owner"), F.lit(now + lease_us).alias("lease_until_us"),
    )


def _fenced(jobs: DataFrame, commands: DataFrame, now: int) -> DataFrame:
    """``commands`` (id, lease_owner, lease_version, ...) with their jobs' columns and ``held``: whether owner and version hold a lease that still runs."""
    own = commands.withColumnRenamed("lease_owner", "__owner").withColumnRenamed("lease_version", "__version")
    live = (F.col("state") == "leased") & (F.col("lease_owner") == F.col("__owner")) & (F.col("lease_version") == F.col("__version")) & (F.col("lease_until_us") > now)
    return own.join(jobs, "id").withColumn("held", F.coalesce(live, F.lit(False)))


def finalize(jobs: DataFrame, commands: DataFrame, cards: DataFrame, targets: DataFrame, hashes: DataFrame, vectors: DataFrame, now: int) -> DataFrame:
    """What each command (id, lease_owner, lease_version) to finalize a job would do: its outcome, and whether the scope's revision goes up.

    A lease that ran out, is another owner's or has another version is lost. Commands of unknown jobs give no row.
    """
    c = cards.select(*SCOPE, F.col("id").alias("memory_id"), F.col("version"), serviceable(F.lit(now)).alias("live"))
    v = vectors.select(*SCOPE, "memory_id", "embedding_space", F.col("content_sha256").alias("stored"))
    t = targets.select("embedding_space", F.col("state").alias("target_state"))
    rows = _fenced(jobs, commands, now).join(t, "embedding_space").join(c, [*SCOPE, "memory_id"], "left").join(hashes, [*SCOPE, "memory_id"], "left").join(v, [*SCOPE, "memory_id", "embedding_space"], "left")
    valid = F.coalesce(F.col("live") & (F.col("version") == F.col("expected_memory_version")), F.lit(False))
    outcome = (
        F.when(~F.col("held"), "lease_lost").when(F.col("target_state") == "retired", "cancelled").when(F.col("target_state") == "blocked", "retry")
        .when(~valid, "cancelled").when(F.col("stored").isNotNull() & (F.col("stored") != F.col("expected_sha256")), "conflict").otherwise("succeeded")
    )
    done = rows.withColumn("outcome", outcome)
    return done.withColumn("bumps_revision", (F.col("outcome") == "succeeded") & (F.col("target_state") == "serving") & F.col("stored").isNull()).select("id", "outcome", "bumps_revision")


def transition(jobs: DataFrame, commands: DataFrame, now: int) -> DataFrame:
    """What each command (id, lease_owner, lease_version, verb, code, backoff_us) does: verb is retry, dead or cancel.

    A command whose lease isn't held changes nothing and has outcome lease_lost.
    The old error code stays unless a new one is given. Commands of unknown jobs give no row.
    """
    rows = _fenced(jobs, commands, now)
    new = F.when(F.col("verb") == "retry", "retry").when(F.col("verb") == "dead", "dead").otherwise("cancelled")
    error = F.when(F.col("held"), F.coalesce("code", "last_error_code")).otherwise(F.col("last_error_code"))
    available = F.when(~F.col("held"), F.col("available_us")).otherwise(F.lit(now) + F.when(F.col("verb") == "retry", F.coalesce("backoff_us", F.lit(0))).otherwise(0))
    return rows.select(
        "id", "verb", F.when(F.col("held"), "applied").otherwise("lease_lost").alias("outcome"), F.when(F.col("held"), new).otherwise(F.col("state")).alias("state"),
        error.alias("last_error_code"), available.cast("long").alias("available_us"),
    )


def retry_schedule(jobs: DataFrame, now: int, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """After an error: tried again with doubling backoff if the code is retryable and attempts are left, else dead."""
    again = F.coalesce(F.col("last_error_code").isin(RETRYABLE), F.lit(False)) & (F.col("attempt_count") < max_attempts)
    seconds = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.least(F.col("attempt_count") - 1, F.lit(8)))).cast("long")
    return jobs.where(F.col("last_error_code").isNotNull()).select("id", F.when(again, "retry").otherwise("dead").alias("state"), F.when(again, F.lit(now) + seconds * 1_000_000).alias("available_us"))


def target_transition(targets: DataFrame, changes: DataFrame) -> DataFrame:
    """The verdict on each requested change (embedding_space, new_state, at_us) of a target."""
    rows = changes.join(targets, "embedding_space", "left")
    verdict = (
        F.when(F.col("state").isNull(), "not_found").when(F.col("new_state") == "serving", "conflict").when(F.col("state") == "serving", "conflict")
        .when((F.col("at_us") == F.col("updated_us")) & (F.col("new_state") == F.col("state")), "unchanged").when(F.col("at_us") <= F.col("updated_us"), "conflict")
        .when(F.col("state") == "retired", "conflict").otherwise("applied")
    )
    return rows.select("embedding_space", "new_state", verdict.alias("verdict"), ((verdict == "applied") & (F.col("new_state") == "retired")).alias("cancels_jobs"))


def coverage(cards: DataFrame, jobs: DataFrame, vectors: DataFrame, hashes: DataFrame, space: str, as_of: int) -> DataFrame:
    """(scope, memory_id, class, stale) of every serviceable card in a space."""
    c = cards.where(serviceable(F.lit(as_of))).select(*SCOPE, F.col("id").alias("memory_id"), "version")
    j = jobs.where(F.col("embedding_space") == space).select(*SCOPE, "memory_id", F.col("state").alias("job_state"), "expected_memory_version")
    v = vectors.where(F.col("embedding_space") == space).select(*SCOPE, "memory_id", "content_sha256")
    rows = c.join(j, [*SCOPE, "memory_id"], "left").join(v, [*SCOPE, "memory_id"], "left").join(hashes, [*SCOPE, "memory_id"], "left")
    stale = F.col("content_sha256").isNotNull() & (F.col("content_sha256") != F.col("expected_sha256"))
    kind = (
        F.when(F.col("job_state").isNull(), "missing_job").when(F.col("expected_memory_version") != F.col("version"), "version_invariant")
        .when(F.col("job_state").isin("pending", "leased", "retry"), "in_flight").when(F.col("job_state").isin("dead", "cancelled"), F.col("job_state"))
        .when(F.col("content_sha256").isNull(), "succeeded_missing_embedding").when(stale, "content_hash_mismatch").otherwise("converged")
    )
    return rows.select(*SCOPE, "memory_id", kind.alias("class"), stale.alias("stale"))


def coverage_report(covered: DataFrame) -> DataFrame:
    """All eight classes with their counts, zeros included."""
    counts = covered.groupBy().agg(F.count("*").alias("scanned"), *[F.count_if(F.col("class") == c).alias(c) for c in CLASSES])
    return counts


def repairs(covered: DataFrame, serving: bool) -> DataFrame:
    """What repairing does per card, and whether its scope's revision goes up (once per scope)."""
    action = (
        F.when(F.col("class") == "missing_job", "enqueue").when(F.col("class").isin("succeeded_missing_embedding", "content_hash_mismatch"), "reset").otherwise("none")
    )
    vector_lost = F.col("stale") | (F.col("class") == "succeeded_missing_embedding")
    return covered.select(*SCOPE, "memory_id", action.alias("action"), F.col("stale").alias("delete_vector"), (F.lit(serving) & vector_lost).alias("bumps_scope")).where("action <> 'none' or delete_vector")


def promotion_plan(cards: DataFrame, covered: DataFrame, targets: DataFrame, to_space: str, allow_empty: bool, as_of: int) -> DataFrame:
    """Counts of live scopes, live cards and covered cards, whether promotion may go, and the time its swap gets."""
    live = cards.where(serviceable(F.lit(as_of)))
    totals = live.groupBy().agg(F.count_distinct(F.struct(*SCOPE)).alias("live_scopes"), F.count("*").alias("live_cards"))
    good = covered.groupBy().agg(F.count_if((F.col("class") == "converged")).alias("covered_cards"))
    at = targets.groupBy().agg((F.greatest(F.max("updated_us") + 1, F.lit(as_of))).alias("promoted_us"))
    may = (F.col("covered_cards") == F.col("live_cards")) & ((F.col("live_cards") > 0) | F.lit(allow_empty))
    return totals.crossJoin(F.broadcast(good)).crossJoin(F.broadcast(at)).withColumn("allowed", may).withColumn("to_space", F.lit(to_space))


#: Columns of a promotion's receipt.
RECEIPT = ["operation_id", "from_space", "to_space", "allow_empty", "live_scopes", "live_cards", "covered_cards", "previous_generation", "generation", "cutoff_us", "promoted_us"]


def promotion(cards: DataFrame, covered: DataFrame, targets: DataFrame, deployment: DataFrame, operation_id: str, to_space: str, allow_empty: bool, as_of: int) -> dict[str, DataFrame]:
    """The rows that a promotion commits together: all ``targets`` with the two swapped, the next ``deployment`` (generation), ``bumps`` of each live scope's revision, and the ``receipts`` row.

    All of them are empty if the plan doesn't allow it: every live card is covered in
    ``to_space`` by ``covered``, there is one unless ``allow_empty``, and ``to_space``
    is a shadow that takes new jobs.
    """
    plan = promotion_plan(cards, covered, targets, to_space, allow_empty, as_of)
    ready = targets.where((F.col("embedding_space") == to_space) & (F.col("state") == "shadow") & F.col("enqueue_new")).select(F.lit(True).alias("ready"))
    current = targets.where("state = 'serving'").groupBy().agg(F.max("embedding_space").alias("from_space"))  # no row gives null
    go = F.broadcast(plan.where("allowed").crossJoin(ready).crossJoin(current).crossJoin(deployment.select(F.col("generation").alias("previous_generation"))))  # one row at most
    state = F.when(F.col("embedding_space") == to_space, "serving").when(F.col("state") == "serving", "shadow").otherwise(F.col("state"))
    moved = targets.crossJoin(go.select("promoted_us")).withColumn("__new", state)
    swapped = moved.select(*[F.col("__new").alias(c) if c == "state" else F.when(F.col("__new") != F.col("state"), F.col("promoted_us")).otherwise(F.col(c)).alias(c) if c == "updated_us" else c for c in targets.columns])
    live = cards.where(serviceable(F.lit(as_of))).select(*SCOPE).distinct()
    bumps = live.crossJoin(go.select(F.col("promoted_us").alias("commit_seq"))).withColumn("kind", F.lit("promotion"))
    generation = (F.col("previous_generation") + 1).alias("generation")
    receipt = go.select(F.lit(operation_id).alias("operation_id"), "from_space", "to_space", F.lit(allow_empty).alias("allow_empty"), "live_scopes", "live_cards", "covered_cards", "previous_generation", generation, F.lit(as_of).alias("cutoff_us"), "promoted_us")
    return {"targets": swapped, "deployment": go.select(generation), "bumps": bumps, "receipts": receipt.select(*RECEIPT)}


def keyset_page(cards: DataFrame, after: tuple[str, str, str] | None, n: int, as_of: int) -> DataFrame:
    """Up to n + 1 keys after a cursor in byte order; row n + 1 says that there are more. The OR form reaches the scan."""
    live = cards.where(serviceable(F.lit(as_of)))
    if after:
        t, u, i = after
        live = live.where((F.col("tenant_id") > t) | ((F.col("tenant_id") == t) & ((F.col("user_id") > u) | ((F.col("user_id") == u) & (F.col("id") > i)))))
    return live.select(*SCOPE, "id").orderBy(*SCOPE, "id").limit(n + 1)


def embedding_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of vectors: insert, unchanged, or conflict where the content of a space would change."""
    key = [*SCOPE, "memory_id", "embedding_space"]
    o = old.select(*key, F.col("content_sha256").alias("old_sha"), F.lit(True).alias("known"))
    joined = new.join(o, key, "left")
    change = F.when(F.col("known").isNull(), "insert").when(~F.col("old_sha").eqNullSafe(F.col("content_sha256")), "conflict").otherwise("unchanged")
    return joined.select(*key, change.alias("change"), (change == "insert").alias("bumps_revision"))


def registry_conflicts(registered: DataFrame, requested: DataFrame, columns: list[str]) -> DataFrame:
    """The verdict on each requested space: inserted, known, or conflict where an immutable column drifts or serving is asked for."""
    old = registered.select("embedding_space", F.struct(*columns).alias("old"))
    rows = requested.withColumn("new", F.struct(*columns)).join(old, "embedding_space", "left")
    verdict = F.when(F.col("state") == "serving", "conflict").when(F.col("old").isNull(), "inserted").when(F.col("old") != F.col("new"), "conflict").otherwise("known")
    return rows.select("embedding_space", verdict.alias("verdict"), (verdict == "inserted").alias("bumps_generation"))


def promotion_verdicts(receipts: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests by operation id: a stored one of the same shape returns its receipt, of another shape is a conflict, none goes on."""
    shape = ["from_space", "to_space", "allow_empty"]
    old = receipts.select("operation_id", F.struct(*shape).alias("old"), "generation")
    rows = requests.withColumn("new", F.struct(*shape)).join(old, "operation_id", "left")
    verdict = F.when(F.col("old").isNull(), "promote").when(F.col("old") == F.col("new"), "replay").otherwise("conflict")
    return rows.select("operation_id", verdict.alias("verdict"), F.when(verdict == "replay", F.col("generation")).alias("generation"))
