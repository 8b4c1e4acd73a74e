import json
import random

import pytest

from recallframe.deployment import Deployment
from recallframe.operators import lifecycle
from recallframe.service import NotFound
from recallframe.sources import datasets, extraction
from recallframe.sources.snapshots import Conflict

SCOPED = "tenant_id string, user_id string, "
CARD = SCOPED + "id string, version int, status string, expires_us long"
COVERED = SCOPED + "memory_id string, class string, stale boolean"


def deployed(spark, folder):
    targets = [("old", "serving", True, 5), ("new", "shadow", True, 9), ("gone", "retired", False, 7)]
    deployment = Deployment(spark, folder)
    deployment.create(spark.createDataFrame(targets, "embedding_space string, state string, enqueue_new boolean, updated_us long"))
    cards = spark.createDataFrame([("t", "u", "m1", 1, "active", None), ("t", "u", "m2", 1, "active", None), ("t", "v", "m1", 1, "active", 3), ("x", "v", "m1", 1, "active", None)], CARD)
    covered = spark.createDataFrame([("t", "u", "m1", "converged", False), ("t", "u", "m2", "converged", False), ("x", "v", "m1", "converged", False)], COVERED)
    return deployment, cards, covered


def test_promotion_commits_all_or_nothing(spark, tmp_path):
    d, cards, covered = deployed(spark, f"file://{tmp_path}/d")
    pin = d.pin()
    assert (pin.space, pin.updated_us, pin.generation) == ("old", 5, 0)
    for change in ({"expected_generation": 1}, {"expected_from": "new"}, {"to_space": "gone"}, {"covered": covered.limit(2)}, {"to_space": "none"}):
        with pytest.raises(Conflict):
            d.promote(**{"operation_id": "op", "cards": cards, "covered": covered, "to_space": "new", "expected_from": "old", "expected_generation": 0, "as_of": 8, **change})
        assert d.pin() == pin and d.snapshots.version() == 1
    receipt = d.promote("op", cards, covered, "new", "old", 0, 8)
    assert (receipt.live_scopes, receipt.live_cards, receipt.previous_generation, receipt.generation, receipt.promoted_us) == (2, 3, 0, 1, 10)
    rows = {r.embedding_space: (r.state, r.updated_us) for r in d.snapshots.read("targets").collect()}
    assert rows == {"old": ("shadow", 10), "new": ("serving", 10), "gone": ("retired", 7)}
    assert sorted((r.tenant_id, r.user_id, r.kind) for r in d.snapshots.read("bumps").collect()) == [("t", "u", "promotion"), ("x", "v", "promotion")]
    # again, the receipt comes back and nothing changes; another shape is a conflict, and so is a stale generation
    assert d.promote("op", cards, covered, "new", "old", 0, 99) == receipt and d.snapshots.version() == 2
    with pytest.raises(Conflict):
        d.promote("op", cards, covered, "old", "old", 0, 8)
    with pytest.raises(Conflict):
        d.promote("op-2", cards, covered, "old", "new", 0, 8)
    assert d.promote("op-2", cards, covered, "old", "new", 1, 8).generation == 2
    assert d.snapshots.read("receipts").count() == 2


def test_searches_are_pinned(spark, tmp_path):
    d, cards, covered = deployed(spark, f"file://{tmp_path}/d")
    pin, hits = d.pin(), spark.range(2)
    assert d.search(pin, lambda space: hits).count() == 2

    def promoting(space):
        assert space == "old"
        d.promote("op", cards, covered, "new", "old", 0, 8)
        return hits

    with pytest.raises(Conflict):
        d.search(pin, promoting)
    with pytest.raises(Conflict):
        d.search(pin, lambda space: hits.limit(0))
    assert d.search(d.pin(), lambda space: hits).count() == 2
    empty = Deployment(spark, f"file://{tmp_path}/e")
    empty.create(d.snapshots.read("targets").where("state <> 'serving'"))
    with pytest.raises(NotFound):
        empty.pin()


def test_revisions_equal_a_fold(spark):
    rng = random.Random(6)
    reviews, erasures, embeddings, finalized, repairs, promotions, want = [], [], [], [], [], [], {}
    reviewed = set()
    for seq in range(300):
        scope = (rng.choice("ab"), rng.choice("uv"))
        kind = rng.choice([*lifecycle.BUMPS, "reject", "unchanged"])
        bump = kind not in ("reject", "unchanged")
        if kind in ("approve", "reject"):
            c = f"c{rng.randrange(60)}"
            bump = bump and (scope, c) not in reviewed
            reviewed.add((scope, c))
            reviews.append((*scope, c, kind, 0, seq))
        elif kind == "forget":
            erasures.append((*scope, seq))
        elif kind in ("embedding", "finalize", "unchanged"):
            (finalized if kind == "finalize" else embeddings).append((*scope, seq, bump))
        elif kind == "repair":
            repairs += [(*scope, seq, True)] * 3 + [(*scope, seq, False)]
        else:
            promotions += [(*scope, seq)] * 2
        if bump:
            want.setdefault(scope, []).append(seq)
    change = spark.createDataFrame(embeddings, SCOPED + "commit_seq long, bumps_revision boolean"), spark.createDataFrame(finalized, SCOPED + "commit_seq long, bumps_revision boolean")
    bumps = lifecycle.revision_bumps(
        spark.createDataFrame(reviews, SCOPED + "candidate_id string, decision string, reviewed_us long, commit_seq long"), spark.createDataFrame(erasures, SCOPED + "commit_seq long"), *change,
        spark.createDataFrame(repairs, SCOPED + "commit_seq long, bumps_scope boolean"), spark.createDataFrame(promotions, SCOPED + "commit_seq long"),
    )
    got = {}
    for r in lifecycle.revision_log(bumps).collect():
        got[r.tenant_id, r.user_id, r.commit_seq] = r.context_revision
    assert got == {(*s, seq): i + 1 for s, seqs in want.items() for i, seq in enumerate(seqs)}
    scopes = spark.createDataFrame([("a", "u"), ("z", "z")], "tenant_id string, user_id string")
    assert {r.tenant_id: r.context_revision for r in lifecycle.context_revisions(scopes, bumps, upto=150).collect()} == {"a": sum(s <= 150 for s in want[("a", "u")]), "z": 0}


def timeline(rng):
    """Random operations of all six kinds, and per query the candidates that a sequential fold sees."""
    ops, seen, chains, evidence, pending = [], {}, {}, [], []
    at = lambda i: f"2026-01-01T00:{i // 60:02d}:{i % 60:02d}+00:00"
    for i in range(160):
        scope = rng.choice(["s", "r"])
        memory = {"kind": "semantic", "category": "c", "key": f"k{rng.randrange(3)}", "value": f"v{i}"} | ({"expires_at": at(i + rng.randrange(1, 40))} if rng.random() < 0.3 else {})
        common = {"scope": scope, "at": at(i)}
        approved = lambda alias, sc, m: chains.__setitem__((sc, m["key"]), (f"c{alias}", m.get("expires_at")))
        kind = rng.choice(["evidence.append", "candidate.propose", "candidate.review", "memory.remember", "query", "query"] + ["forget_user"] * (i % 5 == 0))
        if kind == "evidence.append" or not evidence:
            evidence.append((f"e{i}", scope))
            ops.append({"op": "evidence.append", "as": f"e{i}", "session_id": "x", "actor": "user", "content": "text", **common})
        elif kind == "candidate.propose":
            pending.append((f"p{i}", scope, memory))
            ops.append({"op": kind, "as": f"p{i}", "source_event_ids": [evidence[-1][0]], "memory": memory, "extractor": "m", "extractor_version": "1", **common})
        elif kind == "candidate.review" and pending:
            alias, own, memory = pending.pop(rng.randrange(len(pending)))
            decision = rng.choice(["approve", "approve", "reject"])
            if decision == "approve":
                approved(alias, own, memory)
            ops.append({"op": kind, "candidate": alias, "decision": decision, "memory_as": f"card-{alias}", "reviewer_id": "r", "reason": "", **common, "scope": own})
        elif kind == "memory.remember":
            state = rng.choice(["approved", "rejected", "pending"])
            if state == "approved":
                approved(f"r{i}", scope, memory)
            ops.append({"op": kind, "memory_ref": f"r{i}", "review_state": state, "memory": memory, "evidence": [{"alias": f"x{i}", "session_id": "x", "actor": "user", "content": "y", "occurred_at": at(i)}], **common})
        elif kind == "forget_user":
            chains = {k: v for k, v in chains.items() if k[0] != scope}
            pending = [p for p in pending if p[1] != scope]
            ops.append({"op": kind, **common})
        else:
            seen[f"q{i}"] = {c for (own, _), (c, expires) in chains.items() if own == scope and (expires is None or expires > at(i))}
            ops.append({"op": "query", "id": f"q{i}", "text": "which", "judgments": {}, **common})
    return ops, seen


SCOPES = {"s": ("t", "u"), "r": ("t", "v")}


def test_timelines_replay_as_a_fold(spark):
    ops, want = timeline(random.Random(9))
    frames = datasets.timeline_frames(spark, datasets.load_timeline(json.dumps(ops).encode()), SCOPES)
    got = {q: set() for q in want}
    for r in datasets.visible(frames).collect():
        got[r.query_id].add(r.id)
    assert got == want and any(want.values())
    assert set(frames) == set(datasets.TIMELINE) and all(f.count() for n, f in frames.items() if n != "judgments")
    # a memory that is judged relevant must be seen
    last = {"op": "query", "id": "last", "scope": "s", "at": "2027-01-01", "text": "x"}
    some = {"op": "memory.remember", "memory_ref": "new", "scope": "s", "at": "2026-12-31", "review_state": "approved", "memory": {"kind": "semantic", "category": "c", "key": "z", "value": "v"}, "evidence": [{"alias": "n", "session_id": "x", "actor": "user", "content": "y", "occurred_at": "2026-12-31"}]}
    judged = lambda *between: json.dumps([*ops, some, *between, last | {"judgments": {"memory_cards": {"relevance": {"new": 2}}}}]).encode()
    assert datasets.checked_frames(spark, judged(), SCOPES)["judgments"].count() == 1
    with pytest.raises(datasets.DatasetError):
        datasets.checked_frames(spark, judged({"op": "forget_user", "scope": "s", "at": "2026-12-31"}), SCOPES)
    for wrong in ([{**last, "scope": "none", "judgments": {}}], [{**last, "judgments": {"memory_cards": {"relevance": {"who": 1}}}}]):
        with pytest.raises(datasets.DatasetError):
            datasets.timeline_frames(spark, wrong, SCOPES)


GOOD = {"kind": "semantic", "category": "drink", "key": "tea", "value": "green tea", "supports": [{"event_id": "e1", "quote": "green tea"}]}
FAULTS = {
    "invalid_answer": [b"no json", b'{"candidates": []} x', b'{"candidates": [], "candidates": []}', json.dumps({"candidates": [], "more": 1}).encode(), json.dumps({"candidates": [GOOD | {"value": 1}]}).encode(), json.dumps({"candidates": [GOOD | {"more": ""}]}).encode(), b"\xff"],
    "too_many_candidates": [json.dumps({"candidates": [GOOD | {"key": str(i)} for i in range(11)]}).encode()],
    "incomplete_candidate": [json.dumps({"candidates": [GOOD | {"kind": "other"}]}).encode(), json.dumps({"candidates": [GOOD | {"value": " "}]}).encode()],
    "candidate_too_long": [json.dumps({"candidates": [GOOD | {"value": "x" * 5000}]}).encode()],
    "duplicate_identity": [json.dumps({"candidates": [GOOD, GOOD | {"key": " TEA "}]}).encode()],
    "no_support": [json.dumps({"candidates": [GOOD | {"supports": []}]}).encode()],
    "repeated_support": [json.dumps({"candidates": [GOOD | {"supports": GOOD["supports"] * 2}]}).encode()],
    "unknown_evidence": [json.dumps({"candidates": [GOOD | {"supports": [{"event_id": "e9", "quote": "green"}]}]}).encode()],
    "ungrounded_quote": [json.dumps({"candidates": [GOOD | {"supports": [{"event_id": "e1", "quote": q}]}]}).encode() for q in ("black tea", "", "x" * 2000)],
    "answer_too_long": [b" " * (extraction.ANSWER_BYTES + 1)],
}


def test_extraction_refuses_whole_batches(spark):
    class Scripted:
        """Answers by the batch's first evidence. Made here, so that it travels to the tasks by value."""

        def __init__(self, answers):
            self.answers = answers

        def extract(self, evidence):
            return self.answers[evidence[0]["id"]]

    cases = [(f"{fault}-{i}", fault, answer) for fault, answers in FAULTS.items() for i, answer in enumerate(answers)]
    cases += [("good", None, json.dumps({"candidates": [GOOD, GOOD | {"key": "cup"}]}).encode()), ("none", None, b'{"candidates": []}')]
    schema = SCOPED + "batch_id string, evidence array<struct<id:string,actor:string,content:string>>"
    event = lambda i, content="I like green tea": (i, "user", content)
    answers, rows = {}, []
    for n, (batch, _, answer) in enumerate(cases):
        answers[f"first{n}"] = answer
        rows.append(("t", "u", batch, [event(f"first{n}"), event("e1")]))
    rows += [("t", "u", "empty", []), ("t", "u", "null", None), ("t", "u", "raises", [event("nobody")]), ("t", "u", "much", [event("e1", "x" * 40_000)]), ("t", "u", "many", [event(f"e{i}") for i in range(21)]), ("t", "u", "twice", [event("e1")] * 2)]
    want = {b: f for b, f, _ in cases} | {"empty": "no_evidence", "null": "no_evidence", "raises": "unavailable", "much": "too_much_evidence", "many": "too_much_evidence", "twice": "too_much_evidence"}
    got = extraction.extract(spark.createDataFrame(rows, schema), Scripted(answers))
    assert {r.batch_id: r.fault for r in got.collect()} == want
    assert all((r.candidates is None) == (r.fault is not None) for r in got.collect())
    candidates, links = extraction.proposals(got, 7)
    assert sorted(c.memory_key for c in candidates.collect()) == ["cup", "tea"] and links.count() == 2 and links.join(candidates.selectExpr("id as candidate_id"), "candidate_id").count() == 2
