import math
import re
from collections import Counter

import public_tokenizers as P
import sentencepiece

from recallframe.llm import fertility, queries

SF = "/root/testdata/sf0.001"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_op4_base_counts_and_labels(spark):
    got = {r.doc_id: r for r in queries.op4_fertility(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for d in docs:
        r, want = got[d.doc_id], brute(d.text)
        assert tuple(r[c] for c in fertility.BASE) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)
        n = len(model.encode(re.findall(r"[^\x20\x09-\x0D]+", d.text)) and sum(model.encode(re.findall(r"[^\x20\x09-\x0D]+", d.text)), []))
        assert n == 0 or abs(r.chars_per_token - want[1] / n) < 1e-9
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    judged = [r for r in got.values() if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in judged) >= 0.98 * len(judged)


def test_odd_rows(spark):
    texts = [None, "", "\n\n", "a a a a a a", "é\x0b\x1cb\x85 c", "#*$ <>\nx\nx\n x", "x " * 20_000, "x " * 20_000]
    rows = [(i if i else None, t, None if i % 2 else "en", "kept") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    got = fertility.judge(df, "text", queries.PIECES, "lang").collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in fertility.BASE) == brute(texts[r.doc_id or 0])
        assert not r.kept
    assert fertility.judge(df.limit(0), "text", queries.PIECES, "lang").count() == 0


def measures(text, model):
    """The three measures by the library's own ids, one word at a time."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    ids = [i for w in words for i in model.encode(w)]
    if not ids:
        return 0.0, 0.0, 0.0
    counts = Counter(ids).values()
    entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts) / math.log2(len(ids) + 1)
    return sum(map(len, words)) / len(ids), sum(model.is_byte(i) for i in ids) / len(ids), entropy


def verdicts(rows):
    """(kept, reason) of rows of (group, n_words, failed, three measures): fences around the quartiles of binned values."""
    out = []
    half_up = lambda x: math.floor(x + 0.5)
    for group, n_words, failed, own in rows:
        reason = None
        for k, m in enumerate(fertility.MEASURES):
            bins = sorted(half_up(r[3][k] / fertility.STEP[m]) for r in rows if r[0] == group and not r[2])
            if not bins or failed:
                continue
            q1, q3 = (bins[math.ceil(len(bins) * q / 4) - 1] * fertility.STEP[m] for q in (1, 3))
            reach = max((q3 - q1) * fertility.FENCE, fertility.SLACK[m]) * math.sqrt(1 + fertility.SHORT / max(n_words, 1))
            if reason is None and not q1 - reach <= own[k] <= q3 + reach:
                reason = m
        out.append((not failed and reason is None, reason))
    return out


def test_measures_bands_and_verdicts_of_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()
    docs = [tuple(d) for d in docs]
    plain = [d for d in docs if brute(d[2])[0] >= 80 and 2 * brute(d[2])[4] <= brute(d[2])[0]][:3]
    # byte fallback, long tokens and few different tokens: one odd text for each measure, and a group of its own
    odd = [" ".join(chr(0x1F300 + 7 * i + k) for k in range(3)) for i in range(40)]
    docs += [(-1, "en", " ".join(odd)), (-2, "en", " ".join(f"international{'ly' * (i % 3)} understanding{i}" for i in range(60))), (-3, None, plain[0][2]), (-4, None, plain[1][2]), (-5, "en", " ".join("ab"[i * i % 7 % 2] * (1 + i % 11) for i in range(200)))]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in fertility.judge(df, "text", queries.PIECES, "lang").collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = []
    for doc_id, lang, text in docs:
        base, own = brute(text), measures(text, model)
        assert all(abs(got[doc_id][m] - x) < 1e-9 for m, x in zip(fertility.MEASURES, own, strict=True))
        rows.append((lang, base[0], base[0] < 50 or 100 * base[4] > 50 * base[0], own))
    want = verdicts(rows)
    assert [(got[d[0]].kept, got[d[0]].reason) for d in docs] == want
    assert got[-1].reason == "chars_per_token" and got[-3].kept
    # narrow bands of the two other measures alone
    monkeypatch.setattr(fertility, "FENCE", 0.2)
    monkeypatch.setattr(fertility, "SHORT", 0.0)
    monkeypatch.setattr(fertility, "SLACK", {"chars_per_token": 100.0, "fallback_share": 0.001, "token_entropy": 0.001})
    got = {r.doc_id: r for r in fertility.judge(df, "text", queries.PIECES, "lang").collect()}
    want = verdicts(rows)
    assert [(got[d[0]].kept, got[d[0]].reason) for d in docs] == want
    assert {r for _, r in want} == {None, "fallback_share", "token_entropy"}
