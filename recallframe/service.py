"""The service's verbs over snapshots: evidence, candidates, reviews, context packs, erasure.

State is append-only logs (evidence, candidates with their links, reviews, erasures,
and what moved the scopes' revisions on) in a snapshot folder; cards, revisions and
chains are replays of them.
Each verb checks its input, appends to a log and commits with compare-and-set,
so two writers never both win. Inputs are frames, so one call takes a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallframe.operators import context, lifecycle, retrieval, validation
from recallframe.operators.lifecycle import SCOPE
from recallframe.session import stored
from recallframe.sources.snapshots import Conflict, Snapshots

LOGS = {
    "evidence": "tenant_id string, user_id string, id string, session_id string, actor string, content string, occurred_us long",
    "candidates": "tenant_id string, user_id string, id string, kind string, category string, memory_key string, value string, person string, relationship string, backstory string, created_us long, expires_us long",
    "links": "tenant_id string, user_id string, candidate_id string, evidence_id string, source_order int",
    "reviews": "tenant_id string, user_id string, candidate_id string, decision string, reviewed_us long, commit_seq long",
    "erasures": "tenant_id string, user_id string, commit_seq long",
    "bumps": "tenant_id string, user_id string, commit_seq long, kind string",
}
#: Logs that erasures leave alone: a scope's revision never goes back.
KEPT = ("erasures", "bumps")
#: Context packs hold DEFAULT_LIMIT items unless asked for 1 to MAX_LIMIT.
DEFAULT_LIMIT, MAX_LIMIT = 5, 20


#: (queries, cards, limit, as_of_us) to ranked hits.
Search = Callable[[DataFrame, DataFrame, int, int], DataFrame]


class Invalid(ValueError):
    """Input that breaks a rule."""


class NotFound(LookupError):
    pass


#: Times that packs are built anew if their scopes change meanwhile.
ATTEMPTS = 3


class MemoryService:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.snapshots = spark, Snapshots(spark, folder)

    def _logs(self, version: int) -> dict[str, DataFrame]:
        if version == 0:
            return {name: self.spark.createDataFrame([], schema) for name, schema in LOGS.items()}
        return {name: self.snapshots.read(name, version) for name in LOGS}

    def _append(self, version: int, **rows: DataFrame) -> int:
        """Commits ``rows`` behind the logs of ``version``, against which they were checked; a conflict if there is a newer one."""
        logs = self._logs(version)
        new = {name: r.select(*logs[name].columns) for name, r in rows.items()}
        empty = {name: r for name, r in logs.items() if version == 0 and name not in new}
        return self.snapshots.commit(empty, version, added=new)

    def _refuse(self, broken: DataFrame) -> None:
        first = broken.limit(1).collect()
        if first:
            raise Invalid(str(first[0].asDict()))

    def append_evidence(self, rows: DataFrame) -> int:
        """All rows or none: ids must be new and content valid."""
        version = self.snapshots.version()
        self._refuse(validation.violations(rows, validation.evidence_rules(), "id"))
        known = self._logs(version)["evidence"]
        if rows.join(known, [*SCOPE, "id"], "left_semi").limit(1).count() or validation.duplicates(rows, *SCOPE, "id").limit(1).count():
            raise Conflict("an evidence id exists")
        return self._append(version, evidence=rows)

    def propose(self, candidates: DataFrame, links: DataFrame) -> int:
        """All candidates or none; every source must be evidence of the candidate's scope, and none occur twice."""
        version = self.snapshots.version()
        self._refuse(validation.violations(candidates, validation.candidate_rules(), "id"))
        logs = self._logs(version)
        self._refuse(context.missing_sources(links, logs["evidence"]))
        good = lifecycle.create_candidates(candidates, links, logs["evidence"])
        self._refuse(candidates.join(good, [*SCOPE, "id"], "left_anti").select("id"))
        if candidates.join(logs["candidates"], [*SCOPE, "id"], "left_semi").limit(1).count() or validation.duplicates(candidates, *SCOPE, "id").limit(1).count():
            raise Conflict("a candidate id exists")
        return self._append(version, candidates=candidates, links=links)

    def review(self, reviews: DataFrame) -> int:
        """First decisions on pending candidates; commit order is the log's."""
        version = self.snapshots.version()
        logs = self._logs(version)
        keys = logs["candidates"].select(*SCOPE, F.col("id").alias("candidate_id"))
        if reviews.join(keys, [*SCOPE, "candidate_id"], "left_anti").limit(1).count():
            raise NotFound("a candidate doesn't exist")
        if reviews.join(logs["reviews"], [*SCOPE, "candidate_id"], "left_semi").limit(1).count() or validation.duplicates(reviews, *SCOPE, "candidate_id").limit(1).count():
            raise Conflict("a candidate is reviewed already")
        return self._append(version, reviews=reviews, bumps=lifecycle.revision_bumps(reviews, logs["erasures"].limit(0)))

    def forget_user(self, scopes: DataFrame) -> DataFrame:
        """Erases scopes: their rows leave all logs but the erasures. Returns the receipt, one row for each scope; no scopes change nothing."""
        version = self.snapshots.version()
        logs = self._logs(version)
        receipt = stored(lifecycle.forget_receipt(scopes, logs["evidence"], logs["candidates"], self.cards(version)))
        if receipt.isEmpty():
            return receipt
        kept = {n: lifecycle.forget(r, scopes) for n, r in logs.items() if n not in KEPT}
        new = {"erasures": scopes.select(*logs["erasures"].columns), "bumps": lifecycle.revision_bumps(logs["reviews"].limit(0), scopes)}
        self.snapshots.commit(kept, version, added=new)
        return receipt

    def cards(self, version: int | None = None) -> DataFrame:
        logs = self._logs(self.snapshots.version() if version is None else version)
        return lifecycle.current_cards(lifecycle.card_versions(logs["candidates"], logs["reviews"], logs["erasures"]))

    def revisions(self, scopes: DataFrame, version: int | None = None) -> DataFrame:
        """(scope, context_revision) of ``scopes`` in a version; 0 for unknown ones."""
        return lifecycle.context_revisions(scopes, self._logs(self.snapshots.version() if version is None else version)["bumps"])

    def context_packs(self, queries: DataFrame, as_of_us: int, limit: int = DEFAULT_LIMIT, search: Search = retrieval.full_text) -> DataFrame:
        """Packs for a batch of queries, all from one pinned version.

        A hit that may not be served, be it of another scope, not serviceable, or
        without its sources, refuses the batch. If a scope that is asked has another
        revision once the packs are built, they are built anew, ``ATTEMPTS`` times at
        most, and then there is a conflict.
        """
        if not 1 <= limit <= MAX_LIMIT:
            raise Invalid(f"limit {limit}")
        asked = queries.select(*SCOPE).distinct()
        for _ in range(ATTEMPTS):
            version = self.snapshots.version()
            logs, cards = self._logs(version), self.cards(version)
            hits = stored(search(queries, cards, limit, as_of_us))
            broken = context.untrusted_hits(hits, queries, cards, logs["links"], logs["evidence"], as_of_us).limit(1).collect()
            packs = stored(context.context_packs(context.context_items(hits, queries, cards, logs["links"], logs["evidence"]), queries, as_of_us))
            end = self.snapshots.version()
            if end != version and not self.revisions(asked, version).exceptAll(self.revisions(asked, end)).isEmpty():
                continue
            if broken:
                raise context.Untrusted(str(broken[0].asDict()))
            return packs
        raise Conflict("scopes changed while their packs were built")
