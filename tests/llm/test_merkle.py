import base64
import hashlib
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from recallframe.llm import merkle, queries

SF = "/root/testdata/sf0.001"


def mixed(x):
    m = (1 << 64) - 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
    return x ^ (x >> 31)


def slow_leaves(text):
    """Leaves by character, one after another."""
    out, leaf = [], ""
    gap = lambda c: c == " " or "\t" <= c <= "\r"
    for i, c in enumerate(text):
        leaf += c
        window = sum((ord(text[i - k]) + 1) * pow(merkle.MIX, k + 1, 1 << 64) for k in range(min(4, i + 1))) % (1 << 64)
        h = mixed(window) >> 40
        cuts = h % 16 == 0 if not gap(c) else (i + 1 == len(text) or not gap(text[i + 1])) and h % 2 == 0
        if cuts or c == "\n" or i + 1 == len(text) or len(leaf) == 64:
            out.append(leaf)
            leaf = ""
    return out


def slow_digest(leaf):
    own = sum(mixed((ord(c) + merkle.MIX) % (1 << 64)) * pow(merkle.STEP, k, 1 << 64) for k, c in enumerate(leaf)) % (1 << 64)
    return base64.b64encode((mixed((own + len(leaf)) % (1 << 64)) >> 40).to_bytes(3)).decode()


def slow_likeness(t, u):
    if t == u:
        return 1.0
    a, b = (Counter(slow_digest(x) for line in s.splitlines(keepends=True) if line.strip() for x in slow_leaves_of[s][line]) for s in (t, u))
    total = a.total() + b.total()
    return min(2 * (a & b).total() / total, 1 - 1 / (total + 1)) if total else 0.0


class Lines(dict):
    """Leaves of a text by line, found once."""

    def __missing__(self, text):
        by = {}
        line, found = "", []
        for x in slow_leaves(text):
            line, found = line + x, [*found, x]
            if x.endswith("\n"):
                by[line], line, found = found, "", []
        by[line] = found
        self[text] = by
        return by


slow_leaves_of = Lines()


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    """(key, length, digest of the edited text, text, edited text, next text) in any order of repeated keys."""
    texts = [(k, t or "") for k, t in rows]
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest(r[1].encode(), 42) ^ (1 << 63)))
    out = []
    for i, (k, t) in enumerate(order):
        u = order[(i + 1) % len(order)][1]
        n = len(t) // 2
        out.append((k, t, t[: len(t) - n] + u[:n], u))
    return out


def held(got, rows, slow=True):
    by = sorted(((k, len(t), digest(e), merkle.fingerprint(t), merkle.fingerprint(e), e, u, t) for k, t, e, u in brute(rows)), key=lambda x: str(x[:4]))
    got = sorted(map(tuple, got), key=lambda x: str(x[:4]))
    assert [g[:5] for g in got] == [b[:5] for b in by]
    for g, (*_, e, u, t) in zip(got, by, strict=True):
        if slow:
            assert abs(g[5] - slow_likeness(t, e)) < 1e-12 and abs(g[6] - slow_likeness(t, u)) < 1e-12


def test_leaves_by_character():
    for t in ("", "a", "alpha beta  gamma\n\n \tdelta", "漢字かな交じり文" * 20, "x" * 300, "é\x0b\x85\x1c b\n", "".join(map(chr, range(9, 900)))):
        ends, digests = merkle.leaves(t)
        want = slow_leaves(t)
        assert [int(e) + 1 for e in ends] == [sum(map(len, want[: i + 1])) for i in range(len(want))]
        assert [base64.b64encode(int(d).to_bytes(3)).decode() for d in digests] == [slow_digest(x) for x in want]


def test_op10_against_brute_force(spark):
    got = queries.op10_merkle(spark, SF).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    held(got, docs)
    assert sum(r[5] > r[6] for r in got if r[1] > 40) >= 0.99 * sum(r[1] > 40 for r in got)


def test_edited_texts_are_nearer_than_the_next_in_any_script():
    rng = random.Random(3)
    kinds = {
        "han": lambda: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(4000)),
        "unspaced": lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(3000)),
        "short": lambda: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(20)),
    }
    for kind, make in kinds.items():
        for _ in range(60):
            t, u = make(), make()
            f = merkle.fingerprint(t)
            near = merkle.likeness(f, merkle.fingerprint(merkle.half_replaced(t, u)))
            assert near > merkle.likeness(f, merkle.fingerprint(u)) and near > 0.1, kind


def test_odd_rows(spark):
    rows = [(None, "x y."), (None, None), (3, ""), (3, "same"), (3, "same"), (9, "a\n\n" * 40_000), (-5, "é" * 999), (1 << 40, "one")]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, fingerprint string")
    for parts in (1, 3):
        held(merkle.compare_with_next(df.repartition(parts)).collect(), rows, slow=False)
    held(merkle.compare_with_next(df.where("doc_id = 9")).collect(), rows[5:6], slow=False)
    assert merkle.compare_with_next(df.limit(0)).count() == 0
    broken = df.limit(1).selectExpr("doc_id", "cast(unhex('61ff20') as string) AS text")
    assert merkle.compare_with_next(broken).first().n_chars == 3
    prints = {(r.doc_id, r.fingerprint) for r in merkle.fingerprints(df).collect()}
    assert prints == {(k, merkle.fingerprint(t or "")) for k, t in rows}


def test_trees_locate_edits():
    a = "Title one.\n\nFirst paragraph. It has two.\nSecond line here.\n\nLast."
    b = a.replace("two", "three")
    f, g = merkle.fingerprint(a), merkle.fingerprint(b)
    assert merkle.edits(f, g) == [(1, 0)] and merkle.edits(f, f) == []
    assert 0.5 < merkle.likeness(f, g) < 1 and merkle.likeness(f, f) == 1
    assert merkle.fingerprint("a b") != merkle.fingerprint("a  b") != merkle.fingerprint("a b\n")
    assert merkle.likeness(merkle.fingerprint("a\nb"), merkle.fingerprint("b\na")) < 1


def test_hot_keys_spread_over_ranges(spark):
    """One id holds most rows; their different texts are dealt over several ranges, and the order still closes."""
    rows = [(5, f"text {i} " + "w " * (i % 40)) for i in range(3000)] + [(i, f"other {i}") for i in range(100, 400)] + [(5, "equal")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    dealt = merkle.with_next(df, "doc_id", "text").where("key = 5 and not tail").groupBy("range").count().collect()
    assert len(dealt) > 4
    held(merkle.compare_with_next(df).collect(), rows, slow=False)


def test_periodic_texts():
    """No leaf is longer than LEAF_MOST characters, so what repeats a few characters has leaves to compare."""
    following = "Quite another text. " * 200
    for text in ("a" * 5000, "ab" * 2500, "QUJD" * 1200, "\u00e9" * 999, "x" * 64, "x" * 65, "a" * 63 + " " + "b" * 200):
        ends, digests = merkle.leaves(text)
        sizes = np.diff(np.concatenate(([-1], ends)))
        assert len(ends) == len(digests) and ends[-1] == len(text) - 1 and 0 < sizes.min() and sizes.max() <= merkle.LEAF_MOST
        if len(text) > 500:
            p = merkle.fingerprint(text)
            edited, other = merkle.fingerprint(merkle.half_replaced(text, following)), merkle.fingerprint(following)
            assert merkle.likeness(p, edited) > 0.1 > merkle.likeness(p, other)


def test_few_rows_reach_the_driver(spark):
    """Ranges hold like numbers of bytes, from a bounded sample, with a few long texts among many short ones."""
    rows = [(i, "word " * (20_000 if i % 500 == 7 else 3)) for i in range(4000)]
    dealt = merkle.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), "doc_id", "text").where("not tail")
    sizes = [r.z for r in dealt.groupBy("range").agg(F.sum(F.length("text")).alias("z")).collect()]
    assert len(sizes) >= 8 and max(sizes) <= 300_000 and sum(sizes) == sum(len(t) for _, t in rows)
