import random

import numpy as np
import pytest

from recallframe.llm import simhash_wide as S


def shingles(text, width=5):
    w = text.split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def test_near_copies_are_grouped_and_others_left_alone(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    rows, group = [], {}
    for g in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(80, 400))]
        for k in range(1 + g % 6):
            words = list(base)
            for _ in range(len(words) // 150 if k else 0):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            i = len(rows)
            rows.append((i, " ".join(words), "x"))
            group[i] = g
    rows += [(9000, None, "x"), (9001, "", "x"), (9002, "one", "x"), (9002, "one", "x"), (9003, "One", "x"), (None, "alone in here", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, group_id string")
    got = {r.doc_id: r.group_id for r in S.groups(df, "doc_id", "text", 5).collect()}
    assert (got[9000], got[9001], got[9002], got[9003], got[None]) == (9000, 9000, 9002, 9002, None)
    first = {}
    for i in sorted(group):
        first.setdefault(group[i], i)
    wrong = [i for i in group if got[i] in group and group[got[i]] != group[i]]
    missed = [i for i in group if got[i] != first[group[i]]]
    assert not wrong and len(missed) <= 0.03 * len(group)
    assert S.groups(df.limit(0), "doc_id", "text", 5).count() == 0


def pairs_of(n, seed, length=300, most=10):
    """(id, text) rows, two of a pair, and each pair's similarity by the id of its second text."""
    rng = random.Random(seed)
    rows, known = [], {}
    for g in range(n):
        base = [f"w{rng.randrange(4000)}" for _ in range(length)]
        other = list(base)
        for at in rng.sample(range(length), 1 + g % most):
            other[at] = f"v{rng.randrange(4000)}"
        a, b = (" ".join(x) for x in (base, other))
        rows += [(2 * g, a), (2 * g + 1, b)]
        known[2 * g + 1] = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    return rows, known


@pytest.mark.parametrize("layout", [S.LAYOUT, S.Layout(640, 32, 6)])
def test_pairs_meet_in_an_entry(layout):
    """By brute force on fingerprints: pairs of similarity 0.8 and more share an entry and pass the distance."""
    rows, known = pairs_of(300, 2, most=8)
    caught = {0.9: [], 0.8: [], 0.0: []}
    for i, j in known.items():
        prints = [S.fingerprint_of_set(S.shingles_of(rows[k][1].encode(), 5), layout) for k in (i - 1, i)]
        size = layout.segments * layout.segment
        bits = [np.unpackbits(np.frombuffer(p[0], np.uint8), bitorder="little") for p in prints]
        off = bits[0] != bits[1]
        parted = off[:size].reshape(layout.segments, layout.segment)
        low = [np.frombuffer(p[1], np.uint8).reshape(layout.segments, layout.flips) for p in prints]
        meets = any(set(np.flatnonzero(parted[s])) <= set(low[k][s].tolist()) for s in range(layout.segments) for k in (0, 1))
        caught[max(x for x in caught if j >= x)].append(meets and off.sum() <= layout.distance)
    assert np.mean(caught[0.9]) >= 0.98 and np.mean(caught[0.8]) >= 0.9


@pytest.mark.parametrize(("layout", "bucket"), [(S.LAYOUT, 64), (S.Layout(640, 32, 6), 64), (S.Layout(512, 8, 1), 64), (S.Layout(512, 8, 1), 2)])
def test_recall_of_groups_with_crowded_entries(spark, monkeypatch, layout, bucket):
    """Segments of 8 bits crowd every entry with unlike texts; a small bucket sends their members the exact way."""
    monkeypatch.setattr(S, "BUCKET", bucket)
    exact, calls = S._rarest, []
    monkeypatch.setattr(S, "_rarest", lambda *x: calls.append(1) or exact(*x))
    rows, known = pairs_of(250, 5)
    # a passage that all share skews the votes of a third of the texts
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{t} {passage}" if i % 6 < 2 else t) for i, t in rows]
    sets = {i: shingles(t) for i, t in rows}
    known = {i: len(sets[i] & sets[i - 1]) / len(sets[i] | sets[i - 1]) for i in known}
    got = {r.doc_id: r.group_id for r in S.groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5, layout).collect()}
    assert not [i for i in got if got[i] != i and known.get(i, 0) < 0.8]
    alike = [i for i, j in known.items() if j >= 0.8]
    assert np.mean([got[i] == i - 1 for i in alike]) >= 0.95
    assert bool(calls) == (bucket < 64)


def test_similarity_is_exact_on_both_sides(spark):
    """Of pairs of known similarity, those below 0.8 stay apart and nearly all others are grouped; a repeated line doesn't count."""
    rows, known = pairs_of(160, 6)
    line = " ".join(f"l{i}" for i in range(20)) + " "
    unlike = [line * 40 + " ".join(f"{x}{i}" for i in range(100)) for x in "ab"]
    rows += [(1001, unlike[0]), (1002, unlike[1])]
    got = {r.doc_id: r.group_id for r in S.groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5).collect()}
    assert got[1002] == 1002
    assert not [i for i, j in known.items() if j < 0.8 and got[i] != i]
    alike = [i for i, j in known.items() if j >= 0.8]
    assert sum(got[i] == i - 1 for i in alike) >= 0.9 * len(alike)
