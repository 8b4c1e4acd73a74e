"""Strict loading of the small evaluation datasets (JSON), on the driver, into frames.

Unknown fields, wrong types, trailing content and broken rules are refused with
a ``DatasetError``; the frames that come out are what operators take.
"""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallframe.operators import lifecycle


class DatasetError(ValueError):
    pass


MEMORY = {"kind": str, "category": str, "key": str, "value": str, "person": str, "relationship": str, "backstory": str, "evidence": str}
CASE = {"id": str, "query": str, "memories": list, "gold_keys": list}
DATASET = {"schema_version": str, "id": str, "version": str, "description": str, "cases": list}
KINDS = {"episodic", "semantic", "procedural"}
OPTIONAL = {"person", "relationship", "backstory", "description", "metadata", "expires_at", "memory_as", "evidence_events", "relevance", "forbidden", "require_empty", "tags"}

#: Fields of the timeline's operations by their discriminator.
OPERATIONS = {
    "evidence.append": {"op": str, "as": str, "scope": str, "session_id": str, "at": str, "actor": str, "content": str, "metadata": dict},
    "candidate.propose": {"op": str, "as": str, "scope": str, "at": str, "source_event_ids": list, "memory": dict, "extractor": str, "extractor_version": str, "metadata": dict},
    "candidate.review": {"op": str, "candidate": str, "scope": str, "at": str, "decision": str, "memory_as": str, "reviewer_id": str, "reason": str},
    "memory.remember": {"op": str, "memory_ref": str, "scope": str, "at": str, "review_state": str, "memory": dict, "evidence": list},
    "forget_user": {"op": str, "scope": str, "at": str},
    "query": {"op": str, "id": str, "scope": str, "at": str, "text": str, "judgments": dict},
}


def _pairs(pairs: list[tuple[str, Any]]) -> dict:
    keys = [k for k, _ in pairs]
    if len(set(keys)) < len(keys):
        raise DatasetError(f"a field occurs twice among {keys}")
    return dict(pairs)


def parse(raw: bytes) -> Any:
    """One JSON value and nothing after it."""
    try:
        return json.loads(raw.decode("utf-8"), object_pairs_hook=_pairs)
    except (UnicodeDecodeError, json.JSONDecodeError) as e:
        raise DatasetError(str(e)) from e


def strict(value: Any, fields: dict[str, type], where: str) -> dict:
    if not isinstance(value, dict):
        raise DatasetError(f"{where}: not an object")
    if unknown := set(value) - set(fields):
        raise DatasetError(f"{where}: unknown fields {sorted(unknown)}")
    for name, kind in fields.items():
        if name not in value:
            if name in OPTIONAL:
                continue
            raise DatasetError(f"{where}: {name} is missing")
        if not isinstance(value[name], kind):
            raise DatasetError(f"{where}: {name} is not a {kind.__name__}")
    return value


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise DatasetError(why)


def load_cases(raw: bytes) -> dict:
    """A checked dataset of single-scope cases, with the SHA-256 of its bytes."""
    data = strict(parse(raw), DATASET, "dataset")
    _need(data["schema_version"] == "1", "unknown schema_version")
    _need(bool(data["id"].strip() and data["version"].strip() and data["cases"]), "id, version and cases are required")
    seen: set[str] = set()
    for case in data["cases"]:
        strict(case, CASE, "case")
        _need(bool(case["id"].strip() and case["query"].strip()) and case["id"] not in seen, f"case id {case['id']!r} is blank or occurs twice")
        seen.add(case["id"])
        _need(bool(case["memories"] and case["gold_keys"]), f"case {case['id']}: no memories or gold keys")
        for m in case["memories"]:
            strict(m, MEMORY, f"case {case['id']}")
            _need(m["kind"] in KINDS and all(m[f].strip() for f in ("category", "key", "value", "evidence")), f"case {case['id']}: an incomplete memory")
        keys = [m["key"] for m in case["memories"]]
        _need(len(set(keys)) == len(keys), f"case {case['id']}: a key occurs twice")
        _need(len(set(case["gold_keys"])) == len(case["gold_keys"]) and set(case["gold_keys"]) <= set(keys), f"case {case['id']}: gold keys")
    return data | {"sha256": hashlib.sha256(raw).hexdigest()}


def case_frames(spark: SparkSession, data: dict, created_us: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, cards, gold) of a dataset; every case is a scope of its own and its memories are approved."""
    queries = [(c["id"], c["id"], "user", c["query"]) for c in data["cases"]]
    cards = [
        (c["id"], "user", f"{c['id']}/{m['key']}", m["kind"], m["category"], m["key"], m["value"], m.get("person", ""), m.get("relationship", ""), m.get("backstory", ""), 1, "active", created_us + i, None)
        for c in data["cases"] for i, m in enumerate(c["memories"])
    ]
    gold = [(c["id"], f"{c['id']}/{k}", 1) for c in data["cases"] for k in c["gold_keys"]]
    return (
        spark.createDataFrame(queries, "query_id string, tenant_id string, user_id string, text string"),
        spark.createDataFrame(cards, CARD_SCHEMA),
        spark.createDataFrame(gold, "query_id string, candidate_id string, relevance int"),
    )


CARD_SCHEMA = (
    "tenant_id string, user_id string, id string, kind string, category string, memory_key string, value string, person string, relationship string, backstory string, "
    "version int, status string, created_us long, expires_us long"
)


def load_timeline(raw: bytes) -> list[dict]:
    """The checked operations of a timeline: known ``op``, known fields, times that don't go back, aliases before their use, relevance 1 to 3."""
    operations = parse(raw)
    _need(isinstance(operations, list), "not a list of operations")
    last, events, candidates = "", set(), set()
    for i, o in enumerate(operations):
        _need(isinstance(o, dict) and o.get("op") in OPERATIONS, f"operation {i}: unknown op")
        strict(o, OPERATIONS[o["op"]], f"operation {i}")
        _need(o["at"] >= last, f"operation {i}: time goes back")
        last = o["at"]
        if o["op"] == "evidence.append":
            _need(o["as"] not in events, f"operation {i}: alias occurs twice")
            events.add(o["as"])
        elif o["op"] == "candidate.propose":
            _need(bool(o["source_event_ids"]) and set(o["source_event_ids"]) <= events, f"operation {i}: unknown source")
            candidates.add(o["as"])
        elif o["op"] == "candidate.review":
            _need(o["candidate"] in candidates and o["decision"] in ("approve", "reject"), f"operation {i}: unknown candidate or decision")
        elif o["op"] == "query":
            profile = o["judgments"].get("memory_cards", {})
            relevance, forbidden = profile.get("relevance", {}), profile.get("forbidden", [])
            _need(all(r in (1, 2, 3) for r in relevance.values()), f"operation {i}: relevance")
            _need(not set(relevance) & set(forbidden) and not (relevance and profile.get("require_empty")), f"operation {i}: judgments contradict")
    return operations


SCOPED = "tenant_id string, user_id string, "
MEMORY_FIELDS = ["kind", "category", "key", "value", "person", "relationship", "backstory"]
TIMELINE = {
    "evidence": SCOPED + "id string, session_id string, actor string, content string, occurred_us long, seq long",
    "candidates": SCOPED + "id string, kind string, category string, memory_key string, value string, person string, relationship string, backstory string, created_us long, expires_us long",
    "links": SCOPED + "candidate_id string, evidence_id string, source_order int",
    "reviews": SCOPED + "candidate_id string, decision string, reviewed_us long, commit_seq long",
    "erasures": SCOPED + "commit_seq long",
    "queries": "query_id string, tenant_id string, user_id string, text string, at_us long, seq long",
    "judgments": "query_id string, candidate_id string, relevance int, forbidden boolean, require_empty boolean",
}


def micros(at: str) -> int:
    """Microseconds since the epoch of an ISO time; one without a zone is UTC."""
    time = datetime.fromisoformat(at)
    whole = (time if time.tzinfo else time.replace(tzinfo=UTC)) - datetime(1970, 1, 1, tzinfo=UTC)
    return (whole.days * 86_400 + whole.seconds) * 1_000_000 + whole.microseconds


def timeline_frames(spark: SparkSession, operations: list[dict], scopes: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """The operations of a checked timeline as typed frames, one for each kind of row (``TIMELINE``).

    ``seq`` and ``commit_seq`` are an operation's place. Evidence goes by its alias, a
    candidate by c and its alias, so that its card is m and the alias; a remembered
    memory is its evidence, its candidate and, unless it is pending, its review at
    once. Judgments name memories: by the alias that a review gave, or a candidate's own.
    """
    rows: dict[str, list[tuple]] = {name: [] for name in TIMELINE}
    named: dict[str, str] = {}

    def candidate(scope: tuple[str, str], alias: str, memory: dict, at: int, sources: list[str]) -> None:
        expires = memory.get("expires_at")
        rows["candidates"].append((*scope, f"c{alias}", *[memory.get(f, "") for f in MEMORY_FIELDS], at, micros(expires) if expires else None))
        rows["links"] += [(*scope, f"c{alias}", e, i) for i, e in enumerate(sources)]
        named[alias] = f"c{alias}"

    for seq, o in enumerate(operations):
        _need(o["scope"] in scopes, f"operation {seq}: unknown scope")
        scope, at = scopes[o["scope"]], micros(o["at"])
        match o["op"]:
            case "evidence.append":
                rows["evidence"].append((*scope, o["as"], o["session_id"], o["actor"], o["content"], at, seq))
            case "candidate.propose":
                candidate(scope, o["as"], o["memory"], at, o["source_event_ids"])
            case "candidate.review":
                rows["reviews"].append((*scope, f"c{o['candidate']}", o["decision"], at, seq))
                if o.get("memory_as"):
                    named[o["memory_as"]] = f"c{o['candidate']}"
            case "memory.remember":
                rows["evidence"] += [(*scope, e["alias"], e["session_id"], e["actor"], e["content"], micros(e["occurred_at"]), seq) for e in o["evidence"]]
                candidate(scope, o["memory_ref"], o["memory"], at, [e["alias"] for e in o["evidence"]])
                if o["review_state"] != "pending":
                    rows["reviews"].append((*scope, f"c{o['memory_ref']}", {"approved": "approve", "rejected": "reject"}[o["review_state"]], at, seq))
            case "forget_user":
                rows["erasures"].append((*scope, seq))
            case "query":
                rows["queries"].append((o["id"], *scope, o["text"], at, seq))
                profile = o["judgments"].get("memory_cards", {})
                relevance = profile.get("relevance", {})
                for alias in [*relevance, *profile.get("forbidden", [])]:
                    _need(alias in named, f"operation {seq}: unknown memory {alias!r}")
                    rows["judgments"].append((o["id"], named[alias], relevance.get(alias, 0), alias not in relevance, False))
                if profile.get("require_empty"):
                    rows["judgments"].append((o["id"], None, 0, False, True))
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in TIMELINE.items()}


def visible(frames: dict[str, DataFrame]) -> DataFrame:
    """The cards that each query of a timeline could see (``lifecycle.replay_queries``); ids are those of candidates."""
    versions = lifecycle.card_versions(frames["candidates"], frames["reviews"], frames["erasures"])
    return lifecycle.replay_queries(frames["queries"], versions, frames["erasures"])


def unserviceable_judgments(frames: dict[str, DataFrame]) -> DataFrame:
    """(query_id, candidate_id) of memories that are judged relevant to a query which couldn't see them; a timeline that has any is refused."""
    relevant = frames["judgments"].where("relevance > 0").select("query_id", "candidate_id")
    return relevant.join(visible(frames).select("query_id", F.col("id").alias("candidate_id")), ["query_id", "candidate_id"], "left_anti")


def checked_frames(spark: SparkSession, raw: bytes, scopes: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """The frames of a timeline whose judgments all hold."""
    frames = timeline_frames(spark, load_timeline(raw), scopes)
    wrong = unserviceable_judgments(frames).limit(1).collect()
    _need(not wrong, f"a relevant memory isn't serviceable: {wrong}")
    return frames
