"""Candidates from evidence by a pluggable model that answers in JSON.

An extractor sees one batch of a scope's evidence and returns text. The text must be
one JSON object of the schema below, with no field twice and nothing after it, and
every quote must occur to the byte in the evidence that it names. One fault refuses
the whole batch: nothing of it gets through, and the fault's name stands in its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallframe.operators.lifecycle import SCOPE
from recallframe.operators.validation import BACKSTORY_BYTES, CONTENT_BYTES, LABEL_BYTES, MAX_CANDIDATES, MAX_EVIDENCE, MAX_QUOTE_BYTES, MAX_TOTAL_BYTES, VALUE_BYTES
from recallframe.sources.datasets import KINDS, DatasetError, parse, strict

SUPPORT = {"event_id": str, "quote": str}
CANDIDATE = {"kind": str, "category": str, "key": str, "value": str, "person": str, "relationship": str, "backstory": str, "supports": list}
ANSWER = {"candidates": list}
#: Largest sizes of a candidate's texts, in bytes, and of an answer.
SIZES = {"kind": LABEL_BYTES, "category": LABEL_BYTES, "key": LABEL_BYTES, "value": VALUE_BYTES, "person": LABEL_BYTES, "relationship": LABEL_BYTES, "backstory": BACKSTORY_BYTES}
ANSWER_BYTES = 1 << 20
_CANDIDATE = "kind:string,category:string,memory_key:string,value:string,person:string,relationship:string,backstory:string,supports:array<struct<evidence_id:string,quote:string>>"
SCHEMA = f"tenant_id string, user_id string, batch_id string, fault string, candidates array<struct<{_CANDIDATE}>>"


class Refused(ValueError):
    """A fault that refuses a batch; its text is the fault's name."""


class Extractor(Protocol):
    def extract(self, evidence: list[dict[str, str]]) -> bytes: ...


def checked(answer: bytes, contents: dict[str, str]) -> list[dict]:
    """The candidates of an answer, with their supports in order."""
    if len(answer) > ANSWER_BYTES:
        raise Refused("answer_too_long")
    try:
        found = strict(parse(answer), ANSWER, "answer")["candidates"]
        for c in found:
            strict(c, CANDIDATE, "candidate")
            for s in c["supports"]:
                strict(s, SUPPORT, "support")
    except DatasetError as e:
        raise Refused("invalid_answer") from e
    if len(found) > MAX_CANDIDATES:
        raise Refused("too_many_candidates")
    out, seen = [], set()
    for c in found:
        texts = {f: c.get(f, "").strip() for f in SIZES}
        if texts["kind"] not in KINDS or not (texts["category"] and texts["key"] and texts["value"]):
            raise Refused("incomplete_candidate")
        if any(len(t.encode()) > SIZES[f] for f, t in texts.items()):
            raise Refused("candidate_too_long")
        identity = tuple(texts[f].lower() for f in ("kind", "category", "key", "person", "relationship"))
        if identity in seen:
            raise Refused("duplicate_identity")
        seen.add(identity)
        events = [s["event_id"] for s in c["supports"]]
        if not events:
            raise Refused("no_support")
        if len(set(events)) < len(events):
            raise Refused("repeated_support")
        for s in c["supports"]:
            if s["event_id"] not in contents:
                raise Refused("unknown_evidence")
            if not s["quote"].strip() or len(s["quote"].encode()) > MAX_QUOTE_BYTES or s["quote"] not in contents[s["event_id"]]:
                raise Refused("ungrounded_quote")
        texts["memory_key"] = texts.pop("key")
        out.append({**texts, "supports": [{"evidence_id": s["event_id"], "quote": s["quote"]} for s in c["supports"]]})
    return out


def extract(batches: DataFrame, extractor: Extractor) -> DataFrame:
    """(scope, batch_id, fault, candidates) of batches (scope, batch_id, evidence: array of id, actor and content).

    A batch without fault has a null fault; one with a fault has null candidates. A
    batch without evidence, or with more than the limits allow, never reaches the
    extractor; one whose extractor raises has the fault ``unavailable``.
    """

    def one(evidence: list[dict] | None, extractor: Extractor = extractor) -> list[dict]:
        contents = {e["id"]: e["content"] or "" for e in evidence or []}
        sizes = [len(c.encode()) for c in contents.values()]
        if not contents:
            raise Refused("no_evidence")
        if len(evidence) > MAX_EVIDENCE or sum(sizes) > MAX_TOTAL_BYTES or max(sizes) > CONTENT_BYTES or len(contents) < len(evidence):
            raise Refused("too_much_evidence")
        try:
            answer = extractor.extract(evidence)
        except Exception as e:  # whatever the model's client raises
            raise Refused("unavailable") from e
        return checked(answer, contents)

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in frames:
            faults, found = [], []
            for evidence in batch.column("evidence").to_pylist():
                try:
                    found.append(one(evidence))
                    faults.append(None)
                except Refused as e:
                    found.append(None)
                    faults.append(str(e))
            text = pa.string()
            kind = kind or pa.list_(pa.struct([*[(f, text) for f in ("kind", "category", "memory_key", "value", "person", "relationship", "backstory")], ("supports", pa.list_(pa.struct([("evidence_id", text), ("quote", text)])))]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*SCOPE, "batch_id")], pa.array(faults, text), pa.array(found, kind)], [*SCOPE, "batch_id", "fault", "candidates"])

    return batches.select(*SCOPE, "batch_id", "evidence").mapInArrow(work, SCHEMA)


def proposals(extracted: DataFrame, created_us: int) -> tuple[DataFrame, DataFrame]:
    """(candidates, links) of the batches without fault, as the service takes them; ids come from the batch and the candidate's place in it."""
    each = extracted.where("fault is null").select(*SCOPE, "batch_id", F.posexplode("candidates").alias("place", "c"))
    each = each.withColumn("id", F.concat(F.lit("c"), F.substring(F.sha2(F.concat_ws("/", *SCOPE, "batch_id", F.col("place").cast("string")), 256), 1, 32)))
    names = ["kind", "category", "memory_key", "value", "person", "relationship", "backstory"]
    candidates = each.select(*SCOPE, "id", *[F.col(f"c.{n}").alias(n) for n in names], F.lit(created_us).alias("created_us"), F.lit(None).cast("long").alias("expires_us"))
    links = each.select(*SCOPE, F.col("id").alias("candidate_id"), F.posexplode("c.supports").alias("source_order", "s")).select(*SCOPE, "candidate_id", F.col("s.evidence_id").alias("evidence_id"), "source_order")
    return candidates, links
