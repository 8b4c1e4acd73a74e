import random
import uuid
import weakref
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from recallframe.llm import ids, queries
from recallframe.session import shared_dir

SF = "/root/testdata/sf0.001"


def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def tokens(texts):
    return [[*x.ids, 0] for x in library().encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_op11_against_the_library(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda d: d.doc_id)
    want, at = [], 0
    for d, own in zip(docs, tokens([d.text for d in docs]), strict=True):
        want.append((d.doc_id, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    got = queries.op11_ids(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert sorted(map(tuple, got.collect())) == want


def test_texts_cut_at_blanks_encode_as_whole():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", " \n", "\t", " ", " ", "\x1c", "\x85", "a", "Don't", "it's", "é", "中文", "123", "!?", "'s", " 's", "<|endoftext|>", "\U0001f600", "́", ""]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    own = ids.Encoder(P.path("byte_bpe_50k.json"), "u2")
    assert [np.frombuffer(x, "<u2").tolist() + [0] for x in own.encode(texts)] == tokens(texts)


def test_words_cut_from_what_ends_them_encode_as_whole():
    rng = random.Random(4)
    parts = [" ", " ", "\n", "\n", ".", ",", "'", "'s", "'re", "&&&", "(", "7", "word", "Éa", "ß", "é\u0301", "ж", "—", "\x00", "\t", "\r", "  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)]
    texts += ["\n".join(["one", "two."] * 20_000), ".\n".join(["a"] * 20_000), " " + "x," * 20_000, "", " ", "\n"]
    own = ids.Encoder(P.path("byte_bpe_50k.json"), "u2")
    assert [np.frombuffer(x, "<u2").tolist() + [0] for x in own.encode(texts)] == tokens(texts)
    assert own.encode([]) == [] and own.encode(["", ""]) == [b"", b""]


def test_repeats_in_many_texts_are_looked_up_once(monkeypatch):
    """Even if nothing is remembered, each different word is made once, not each occurrence."""
    monkeypatch.setattr(ids, "LONG", -1)
    own, made = ids.Encoder(P.path("byte_bpe_50k.json"), "u2"), []
    plain, after = own.plain.make, own.after.make
    own.plain.make = lambda x: made.append(x) or plain(x)
    own.after.make = lambda x: made.append(x) or after(x)
    texts = ["start " + "some words, words. again&& " * 50 + "end"] * 40
    got = own.encode(texts)
    assert [np.frombuffer(x, "<u2").tolist() + [0] for x in got] == tokens(texts)
    assert len(made) <= 20


def test_workers_hold_little_after_encoding(spark):
    """Later steps free the encoders, and digests need one Python worker a task."""
    own = weakref.ref(ids.encoder(P.path("byte_bpe_50k.json"), "u2"))
    own().encode(["some words, kept"])
    ids.forget()
    assert own() is None
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    ids.write(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), folder, P.path("byte_bpe_50k.json"))
    plan = ids.digests(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "EvalPython" not in plan


def test_ids_are_counted_where_they_are_made(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", None, "b, b", ""] * 5)], "doc_id long, text string").repartition(3)
    made = ids.encoded(docs, "doc_id", "text", P.path("byte_bpe_50k.json"), 0, "u2")
    want = np.bincount(np.concatenate(tokens(["a b", None, "b, b", ""] * 5)))
    got = ids.count_ids(made.where("counts is not null"))
    assert sorted(map(tuple, got.collect())) == [(i, want[i]) for i in np.flatnonzero(want)]
    assert made.where("ids is not null").count() == 20 and not made.where("ids is not null and counts is not null").count()


def test_white_space_of_python_is_known_to_the_cut():
    space = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    own = ids.Encoder(P.path("byte_bpe_50k.json"), "u2")
    texts = [f"a {c}b {c}" for c in space] + [f"a  {c} c" for c in space]
    assert [np.frombuffer(x, "<u2").tolist() + [0] for x in own.encode(texts)] == tokens(texts)


def best_cost(counts, limit):
    """Least bits by trying all length sequences of a full code, for few counts."""
    from functools import cache

    ordered = sorted(counts, reverse=True)

    @cache
    def cost(i, room, least):
        if i == len(ordered):
            return 0
        return min((ordered[i] * n + cost(i + 1, room - 2 ** (limit - n), n) for n in range(least, limit + 1) if 2 ** (limit - n) <= room - (len(ordered) - i - 1)), default=float("inf"))

    return cost(0, 2**limit, 1)


def test_code_lengths_are_best_under_the_limit():
    rng = random.Random(5)
    for limit in (3, 4, 6):
        for n in range(2, min(9, 2**limit + 1)):
            counts = np.array([rng.choice([1, 2, 5, 100, 10_000]) for _ in range(n)])
            lengths = ids.code_lengths(counts, limit)
            assert lengths.max() <= limit and sum(2.0**-lengths) <= 1
            assert (lengths * counts).sum() == best_cost(tuple(counts.tolist()), limit)
    assert ids.code_lengths(np.array([7]), 4).tolist() == [1] and not len(ids.code_lengths(np.array([], int), 4))
    with pytest.raises(ValueError):
        ids.code_lengths(np.ones(9, int), 3)


def test_codewords_are_canonical_and_round_trip():
    rng = np.random.default_rng(1)
    known = rng.choice(50_000, 3000, replace=False)
    counts = np.maximum(1, (1e6 / np.arange(1, 3001) ** 1.3).astype(int))
    code = ids.Code(known, ids.code_lengths(counts, 16))
    words = [format(w, f"0{n}b") for w, n in zip(code.words, code.lengths, strict=True)]
    assert words == sorted(words) and not any(b.startswith(a) for a, b in zip(words, words[1:], strict=False))
    sizes = np.array([0, 1, 255, 256, 257, 0, 5000, 3])
    data = rng.choice(known, sizes.sum(), p=counts / counts.sum())
    bits, marks = code.encode(data, sizes)
    spelled = dict(zip(code.ids.tolist(), words, strict=True))
    at = 0
    for n, b, m in zip(sizes, bits, marks, strict=True):
        plain = "".join(spelled[x] for x in data[at : at + n].tolist())
        assert b == (int(plain.ljust(-(-len(plain) // 8) * 8, "0"), 2).to_bytes(-(-len(plain) // 8), "big") if plain else b"")
        assert len(m) == 4 * max(0, -(-n // ids.EVERY) - 1)
        at += n
    assert (code.decode(bits, marks, sizes) == data).all()
    # a block is decoded alone, and a stretch of it from its checkpoint on
    assert (code.decode(bits[6:7], marks[6:7], sizes[6:7]) == data[769 : 769 + 5000]).all()
    one = ids.Code(np.array([9]), np.array([1]))
    assert one.decode(*one.encode(np.full(300, 9), np.array([300])), np.array([300])).tolist() == [9] * 300


def test_odd_tables(spark):
    long = "word " * 40_000 + "x" * 50_000
    rows = [(3, "b b", 1), (None, None, 2), (1, long, 3), (3, "a", 4), (3, "a", 4), (2, "", 5), (None, "null id", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first int").repartition(3)
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    ids.write(docs, folder, P.path("byte_bpe_50k.json"))
    got = sorted(map(tuple, ids.digests(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 1, 2, 3, 3, 3]
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got[:-1]]).tolist()
    want = sorted((r[0] or -1, len(t), zlib.crc32(np.array(t, "<u4").tobytes())) for r, t in zip(rows, tokens([r[1] for r in rows]), strict=True))
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == want
    blocks = sorted(ids.read(spark, folder).where("doc = 1").collect(), key=lambda r: r.block)
    assert len(blocks) > 1 and [x for b in blocks for x in b.ids] == tokens([long])[0] and len({b.start for b in blocks}) == 1
    empty = f"{folder}-empty"
    ids.write(docs.limit(0), empty, P.path("byte_bpe_50k.json"))
    assert ids.digests(spark, empty).count() == 0 and ids.read(spark, empty).count() == 0
