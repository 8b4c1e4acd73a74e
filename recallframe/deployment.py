"""Which embedding space serves: targets, a generation, and promotions, in one snapshot.

A search takes a pin of what serves, its space, its target's time and the generation,
and is only answered if the same still holds once its hits are there. A promotion
swaps targets, moves the revisions of all live scopes and the generation on, and
leaves its receipt, in one commit; a retry with the same operation id gets the receipt.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from recallframe.operators import projection
from recallframe.service import NotFound
from recallframe.session import stored
from recallframe.sources.snapshots import Conflict, Snapshots

BUMPS = "tenant_id string, user_id string, commit_seq long, kind string"
RECEIPTS = "operation_id string, from_space string, to_space string, allow_empty boolean, live_scopes long, live_cards long, covered_cards long, previous_generation long, generation long, cutoff_us long, promoted_us long"


@dataclass(frozen=True)
class Pin:
    """What serves at one moment."""

    space: str
    updated_us: int
    generation: int


class Deployment:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.snapshots = spark, Snapshots(spark, folder)

    def create(self, targets: DataFrame) -> int:
        """The first version: ``targets`` (embedding_space, state, enqueue_new, updated_us, ...) and generation 0."""
        empty = {"bumps": self.spark.createDataFrame([], BUMPS), "receipts": self.spark.createDataFrame([], RECEIPTS)}
        return self.snapshots.commit({"targets": targets, "deployment": self.spark.createDataFrame([(0,)], "generation long"), **empty}, 0)

    def pin(self, version: int | None = None) -> Pin:
        version = self.snapshots.version() if version is None else version
        found = self.snapshots.read("targets", version).where("state = 'serving' and enqueue_new").crossJoin(self.snapshots.read("deployment", version)).limit(1).collect()
        if not found:
            raise NotFound("no space serves")
        return Pin(found[0].embedding_space, found[0].updated_us, found[0].generation)

    def search(self, pin: Pin, find: Callable[[str], DataFrame]) -> DataFrame:
        """The hits that ``find`` gets in the pinned space. A conflict if something else serves, before or once they are there; a search for no hits is fenced like any other."""
        if self.pin() != pin:
            raise Conflict(f"{pin} doesn't serve any more")
        hits = stored(find(pin.space))
        if (now := self.pin()) != pin:
            raise Conflict(f"{now} came up while {pin} was searched")
        return hits

    def promote(
        self, operation_id: str, cards: DataFrame, covered: DataFrame, to_space: str, expected_from: str | None, expected_generation: int, as_of: int, allow_empty: bool = False
    ) -> Row:
        """Commits a promotion and returns its receipt; a conflict if what serves isn't as expected, ``to_space`` isn't covered, or somebody else commits first."""
        version = self.snapshots.version()
        targets, deployment, receipts = (self.snapshots.read(t, version) for t in ("targets", "deployment", "receipts"))
        # the serving space went over to shadow with the promotion, so an operation's shape is what was asked
        known = receipts.where(F.col("operation_id") == operation_id).limit(1).collect()
        if known:
            if (known[0].from_space, known[0].to_space, known[0].allow_empty) != (expected_from, to_space, allow_empty):
                raise Conflict(f"operation {operation_id} was another one")
            return known[0]
        generation = deployment.first().generation
        serving = targets.agg(F.max(F.when(F.col("state") == "serving", F.col("embedding_space")))).first()[0]
        if (serving, generation) != (expected_from, expected_generation):
            raise Conflict(f"{serving} serves in generation {generation}")
        rows = projection.promotion(cards, covered, targets, deployment, operation_id, to_space, allow_empty, as_of)
        receipt = stored(rows["receipts"])
        done = receipt.collect()
        if not done:
            raise Conflict(f"{to_space} isn't ready or not covered")
        self.snapshots.commit({t: rows[t] for t in ("targets", "deployment")}, version, added={"bumps": rows["bumps"], "receipts": receipt})
        return done[0]
