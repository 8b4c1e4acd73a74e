import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from recallframe.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    own = bpe.codec(RANKS, P.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def _texts():
    rng = random.Random(7)
    yield from ["", " ", "\n\n  x", "don't  stop'll", "a" * 3000, "ab" * 2500, "ß" * 900, "中文" * 700, "=-" * 1500]
    yield " \t\n" * 8000 + "x"
    yield "x" * 40_000 + " y" * 20_000
    for alphabet in ("ab ", "the of\n,.'s", "aeiouäöüß  \t", "01234 %%%***", "é中  　x"):
        for n in (3, 50, 700, 9000, 40_000):
            yield "".join(rng.choice(alphabet) for _ in range(n))
    yield "".join(chr(rng.choice([*range(32, 127), *range(160, 1500), 0x1F600])) for _ in range(30_000))


def test_encode_matches_the_public_library(both):
    own, known = both
    for text in _texts():
        ids = memoryview(own.encode(text)).cast("i").tolist()
        assert ids == known.encode_ordinary(text), text[:40]
        assert own.decode(ids) == text.encode()


def test_join_of_any_cut_is_the_whole(both):
    own, _ = both
    rng = random.Random(3)
    for alphabet in (b"ab", b"theofinga", b"0011==--"):
        for _ in range(60):
            data = bytes(rng.choice(alphabet) for _ in range(rng.randrange(2, 300)))
            cut = rng.randrange(len(data) + 1)
            assert own.join(own.span(data[:cut]), own.span(data[cut:])) == own.merge(data) == own._merge_heap(data)


def test_frames(spark, both):
    own, known = both
    rows = [(1, "The cat's hat", "c"), (1, "The cat's hat", "c"), (2, None, None), (None, "", "x"), (3, "é\n" * 9000, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    coded = bpe.encode(df, "text", RANKS, P.PATTERN)
    got = bpe.digests(bpe.decode(coded, "token_ids", RANKS, P.PATTERN)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = known.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert [r.n for r in bpe.count_tokens(df, "text", RANKS, P.PATTERN, "n").orderBy("n").collect()] == sorted(w[1] for w in want)
    assert coded.limit(0).count() == 0 and bpe.encode(df.limit(0), "text", RANKS, P.PATTERN).count() == 0


def test_words_before_a_long_run(both):
    own, known = both
    for text in ("ab " * 3000 + "x" * 20_000, "ab " * 3000 + "x" * 20_000 + " y", " a" * 9000 + "0z" * 30_000 + "\n" * 9):
        leaves = list(own.leaves(text))
        assert "".join(leaves) == text and len(leaves) < 40
        assert memoryview(own.encode(text)).cast("i").tolist() == known.encode_ordinary(text)


def test_what_a_worker_keeps_is_bounded(both, monkeypatch):
    own, known = both
    fresh = bpe.Codec(own.ranks, P.PATTERN)
    monkeypatch.setattr(fresh.match, "bound", 500)
    rng = random.Random(11)
    long = ["".join(rng.choice("aeiouxyz") for _ in range(20_000)) for _ in range(4)]
    for text in [*(f"w{i}x{'y' * (i % 7)} {i}" for i in range(3000)), *long]:
        assert memoryview(fresh.encode(text)).cast("i").tolist() == known.encode_ordinary(text)
    # by size, not by entries alone: texts without a blank are one match each
    assert len(fresh.match) <= 500 and max(map(len, fresh.match)) <= 256
    assert bpe.MATCHES_KEPT * (220 + 256 * 3) < 160 << 20
