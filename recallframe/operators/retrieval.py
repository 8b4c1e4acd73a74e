"""Batch retrieval: many queries over many scopes in one job.

Every retriever takes queries (query_id, tenant_id, user_id, ...) and cards and
returns ranked hits (query_id, id, score, created_us, rank). Filters sit below
the ranking; top-k is a row_number window, which Spark turns into a partial and
a final group limit, so a scope of any size sends k rows per task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallframe.functions import text as X
from recallframe.functions.vectors import cosine, cosines
from recallframe.operators.lifecycle import SCOPE, serviceable
from recallframe.session import scratch, stored

K1, B = 1.2, 0.75
#: Field weights of BM25 count into both term frequency and length.
BM25_FIELDS = {"memory_key": 3, "value": 2, "category": 1, "person": 1, "relationship": 1, "backstory": 1}
RRF_K = 60
#: Queries with a vector each that are broadcast at most; beyond, queries and cards of a block.
FEW_QUERIES = 4096
QUERY_BLOCK, CARD_BLOCK = 1024, 4096
#: Pairs of a query and a card that a task scores at once.
PAIRS = 1 << 21
#: Bytes of different asked terms, or of scopes with many rows, that are broadcast at most.
SMALL_TERMS = 32 << 20
#: Stands for the card itself among its tokens; no token is empty.
CARD = ""
#: Decimals that ranked scores are shown with.
DIGITS = 6


def ranked(hits: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` hits of each query. Ranks go by whole scores; what is shown of them may be rounded afterwards."""
    best = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def asked_only(postings: DataFrame, asked: DataFrame, term: str) -> DataFrame:
    """Postings whose (scope, term) some query asks for; asked terms of up to ``SMALL_TERMS`` bytes go to the postings, which then stay where they are."""
    wanted = asked.select(*SCOPE, term).distinct()
    size = wanted.agg(F.sum(F.octet_length(term) + sum(F.octet_length(c) for c in SCOPE) + 64)).first()[0] or 0
    return postings.join(F.broadcast(wanted) if size <= SMALL_TERMS else wanted, [*SCOPE, term], "left_semi")


def card_terms(cards: DataFrame, asked: DataFrame) -> DataFrame:
    """(scope, id, created_us, len, token, tf) of the cards' asked tokens, and one row with the token ``CARD`` for each card of an asked scope; tokenises once."""
    weighted = F.flatten(F.array(*[F.array_repeat(X.tokens(F.col(c)), w) for c, w in BM25_FIELDS.items()]))
    counted = cards.select(*SCOPE, "id", "created_us", F.flatten(weighted).alias("all"))
    terms = counted.select(*SCOPE, "id", "created_us", F.size("all").alias("len"), F.explode(F.concat("all", F.array(F.lit(CARD)))).alias("token"))
    wanted = asked.select(*SCOPE, "token").unionByName(asked.select(*SCOPE, F.lit(CARD).alias("token")))
    return asked_only(terms, wanted, "token").groupBy(*SCOPE, "id", "created_us", "len", "token").agg(F.count("*").alias("tf"))


def corpus_stats(cards: DataFrame) -> DataFrame:
    """(scope, n, avgdl) of the corpus of each scope; cards without tokens count."""
    length = sum((F.size(X.tokens(F.col(c))) * w for c, w in BM25_FIELDS.items()), F.lit(0))
    return cards.groupBy(*SCOPE).agg(F.count("*").alias("n"), F.avg(length).alias("avgdl"))


def bm25(queries: DataFrame, cards: DataFrame, limit: int, as_of_us: int) -> DataFrame:
    """BM25 within each query's scope; only positive scores; score down, newest first, id.

    The asked terms of the cards are written once and read for frequencies,
    lengths and scores; only the hits, ``limit`` a query, outlive the call.
    """
    if limit <= 0:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("id", "string"), ("score", "double"), ("created_us", "long"), ("rank", "int"))]
        return queries.select("query_id", *nothing).limit(0)
    live = cards.where(serviceable(F.lit(as_of_us)))
    asked = queries.select("query_id", *SCOPE, F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("query_id", *SCOPE, "token").agg(F.count("*").alias("qtf"))
    with scratch(queries.sparkSession):
        found = stored(card_terms(live, asked))
        stats = found.where(F.col("token") == CARD).groupBy(*SCOPE).agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
        terms = found.where(F.col("token") != CARD)
        frequency = terms.groupBy(*SCOPE, "token").agg(F.count("*").alias("df"))
        scored = asked.join(frequency, [*SCOPE, "token"]).join(terms, [*SCOPE, "token"]).join(stats, SCOPE)
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = F.col("qtf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
        # summed in the order of terms, so that scores don't depend on the shuffle
        parts = F.transform(F.array_sort(F.collect_list(F.struct("token", part.alias("part")))), lambda x: x["part"])
        hits = scored.groupBy("query_id", "id", "created_us").agg(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x).alias("score"))
        best = ranked(hits.where("score > 0"), limit, F.desc("score"), F.desc("created_us"), F.col("id"))
        return stored(best.withColumn("score", F.round("score", DIGITS)), keep=True)


#: Weights of labels A (key), B (value), C (category, person, relationship), D (backstory).
FTS_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def fts_query(text: Column) -> Column:
    """Distinct lexemes, all of them alternatives; no query syntax."""
    return F.array_sort(F.array_distinct(X.lexemes(text)))


def full_text(queries: DataFrame, cards: DataFrame, limit: int, as_of_us: int) -> DataFrame:
    """Weighted occurrences of any query lexeme; newest first on ties, then id."""
    live = cards.where(serviceable(F.lit(as_of_us)))
    labels = {"A": X.lexemes(F.col("memory_key")), "B": X.lexemes(F.col("value")), "C": X.lexemes(F.concat_ws(" ", "category", "person", "relationship")), "D": X.lexemes(F.col("backstory"))}
    occurrences = F.concat(*[_weighted(v, FTS_WEIGHTS[k]) for k, v in labels.items()])
    postings = live.select(*SCOPE, "id", "created_us", F.explode(occurrences).alias("o")).select(*SCOPE, "id", "created_us", "o.*")
    asked = queries.select("query_id", *SCOPE, F.explode(fts_query(F.col("text"))).alias("lexeme"))
    postings = asked_only(postings, asked, "lexeme").groupBy(*SCOPE, "id", "created_us", "lexeme").agg(F.sum("weight").alias("weight"))
    hits = asked.join(postings, [*SCOPE, "lexeme"]).groupBy("query_id", "id", "created_us").agg(F.round(F.sum("weight") / 10, DIGITS).alias("score"))
    return ranked(hits, limit, F.desc("score"), F.desc("created_us"), F.col("id"))


def _weighted(lexemes: Column, weight: float) -> Column:
    # tenths as whole numbers: sums are exact
    return F.transform(lexemes, lambda t: F.struct(t.alias("lexeme"), F.lit(round(weight * 10)).alias("weight")))


def rarest_overlap(queries: DataFrame, documents: DataFrame, terms: int, limit: int) -> DataFrame:
    """Documents (candidate_id, text) by how many of a query's (query_id, text) ``terms`` rarest lexemes they hold; ties by candidate id.

    Rare is what few documents hold, ties by lexeme; lexemes of no document don't count.
    A query without lexemes has no hits. Frequent lexemes meet no document, unless a
    query has fewer than ``terms`` others. Runs when it is called, as the postings of
    asked lexemes are written once and read for frequencies and matches.
    """
    asked = queries.select("query_id", F.explode(fts_query(F.col("text"))).alias("lexeme"))
    postings = documents.select("candidate_id", F.explode(F.array_distinct(X.lexemes(F.col("text")))).alias("lexeme"))
    wanted = asked.select("lexeme").distinct()
    size = wanted.agg(F.sum(F.octet_length("lexeme") + 64)).first()[0] or 0
    with scratch(queries.sparkSession):
        found = stored(postings.join(F.broadcast(wanted) if size <= SMALL_TERMS else wanted, "lexeme", "left_semi"))
        held = asked.join(found.groupBy("lexeme").agg(F.count("*").alias("df")), "lexeme")
        rarest = ranked(held, terms, F.col("df"), F.col("lexeme")).select("query_id", "lexeme")
        hits = rarest.join(found, "lexeme").groupBy("query_id", "candidate_id").agg(F.count("*").alias("shared"))
        return stored(ranked(hits, limit, F.desc("shared"), F.col("candidate_id")), keep=True)


def vector_search(queries: DataFrame, cards: DataFrame, vectors: DataFrame, limit: int, as_of_us: int) -> DataFrame:
    """Exact cosine in each query's scope; queries carry ``vector``.

    Up to ``FEW_QUERIES`` of them go to the vectors, so those stay where they are.
    More of them meet the cards in blocks, see ``block_hits``. Without a vector on
    either side, or with vectors of different lengths, a pair's score is null and sorts last.
    """
    live = cards.where(serviceable(F.lit(as_of_us))).select(*SCOPE, "id", "created_us")
    embedded = live.join(vectors.select(*SCOPE, F.col("memory_id").alias("id"), F.col("embedding").alias("v")), [*SCOPE, "id"])
    asked = queries.select("query_id", *SCOPE, "vector")
    if queries.limit(FEW_QUERIES + 1).count() <= FEW_QUERIES:
        hits = F.broadcast(asked).join(embedded, SCOPE).select("query_id", "id", "created_us", cosine(F.col("vector"), F.col("v")).alias("score"))
    else:
        hits = block_hits(asked, embedded, limit)
    best = ranked(hits, limit, F.desc("score"), F.desc("created_us"), F.col("id"))
    return best.withColumn("score", F.round("score", DIGITS))


def _dealt(rows: DataFrame, own: tuple[str, int, str], other: tuple[str, int, DataFrame]) -> DataFrame:
    """``rows`` with the block that a hash of their id gives them among their scope's, once for each block of the other side."""
    name, size, id_ = own
    other_name, other_size, other_rows = other

    def blocks(of: DataFrame, n: int, alias: str) -> DataFrame:
        # only scopes of more than one block, so there are few
        several = stored(of.groupBy(*SCOPE).agg(F.ceil(F.count("*") / n).cast("int").alias(alias)).where(F.col(alias) > 1))
        size = several.agg(F.sum(sum(F.octet_length(c) for c in SCOPE) + 64)).first()[0] or 0
        return F.broadcast(several) if size <= SMALL_TERMS else several

    told = rows.join(blocks(rows, size, "__own"), SCOPE, "left").join(blocks(other_rows, other_size, "__other"), SCOPE, "left")
    mine = F.pmod(F.xxhash64(id_), F.coalesce("__own", F.lit(1))).cast("int")
    theirs = F.explode(F.sequence(F.lit(0), F.coalesce("__other", F.lit(1)) - 1))
    return told.withColumn(name, mine).withColumn(other_name, theirs).drop("__own", "__other")


def block_hits(queries: DataFrame, cards: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, created_us, score): each query's best ``limit`` cards (v) of each block of its scope's cards.

    A scope's queries and cards are cut into blocks of about ``QUERY_BLOCK`` and
    ``CARD_BLOCK`` rows. Each pair of blocks is a task group of its own, of bounded size
    however many rows a scope has, and hands on ``limit`` hits a query. Scores are
    those of ``cosine`` to the last bit; equal ones go by newest, then id.
    """
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id string, created_us long, score double"
    key = [*SCOPE, "__q", "__c"]

    def score(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[np.ndarray]] = {"query_id": [], "id": [], "created_us": [], "score": []}
        if len(asked) and len(held):
            # the order of ties: newest, then id by code point
            held = held.iloc[sorted(range(len(held)), key=lambda i: (-held["created_us"].iat[i], held["id"].iat[i].encode("utf-8", "surrogatepass")))]
            ids, created = held["id"].to_numpy(object), held["created_us"].to_numpy()
            step = max(1, PAIRS // len(held))
            for at in range(0, len(asked), step):
                part = asked.iloc[at : at + step]
                scores = cosines(list(part["vector"]), list(held["v"]))
                first = np.argsort(np.where(np.isnan(scores), np.inf, -scores), axis=1, kind="stable")[:, :limit]
                n = first.shape[1]
                own = np.take_along_axis(scores, first, axis=1).ravel()
                found = np.repeat(part["query_id"].to_numpy(object), n), ids[first].ravel(), created[first].ravel(), own
                for column, values in zip(out.values(), found, strict=True):
                    column.append(values)
        rows = pd.DataFrame({c: np.concatenate(x) if x else [] for c, x in out.items()})
        return rows.astype({"query_id": object, "id": object, "score": "Float64"})

    with scratch(queries.sparkSession):
        queries, cards = stored(queries), stored(cards)
        asked = _dealt(queries, ("__q", QUERY_BLOCK, "query_id"), ("__c", CARD_BLOCK, cards))
        held = _dealt(cards, ("__c", CARD_BLOCK, "id"), ("__q", QUERY_BLOCK, queries))
        hits = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(score, schema)
        return stored(hits, keep=True)


def ready_cards(cards: DataFrame, vectors: DataFrame, jobs: DataFrame, targets: DataFrame, links: DataFrame, space: str) -> DataFrame:
    """Cards that the serving fence lets through: the space serves and enqueues, their job succeeded at their version, and they have a vector and a source."""
    serving = targets.where((F.col("embedding_space") == space) & (F.col("state") == "serving") & F.col("enqueue_new")).select("embedding_space")
    done = jobs.where("state = 'succeeded'").join(serving, "embedding_space", "left_semi").select(*SCOPE, F.col("memory_id").alias("id"), F.col("expected_memory_version").alias("version"))
    sourced = links.select(*SCOPE, "candidate_id").distinct()
    embedded = vectors.where(F.col("embedding_space") == space).select(*SCOPE, F.col("memory_id").alias("id"))
    return cards.join(done, [*SCOPE, "id", "version"], "left_semi").join(embedded, [*SCOPE, "id"], "left_semi").join(sourced, [*SCOPE, "candidate_id"], "left_semi")


def branch_depth(limit: int) -> int:
    """Hits that each branch of a hybrid search is asked for."""
    return min(100, max(20, 4 * limit))


def reciprocal_rank_fusion(lexical: DataFrame, dense: DataFrame, limit: int) -> DataFrame:
    """Score is the sum of 1 / (60 + rank); ties by best rank, newest, id."""
    both = lexical.select("query_id", "id", "created_us", "rank").unionByName(dense.select("query_id", "id", "created_us", "rank"))
    hits = both.groupBy("query_id", "id", "created_us").agg(F.sum(F.lit(1.0) / (F.col("rank") + RRF_K)).alias("score"), F.min("rank").alias("best_rank"))
    return ranked(hits, limit, F.desc("score"), F.col("best_rank"), F.desc("created_us"), F.col("id"))


def fusion_violations(branch: DataFrame, queries: DataFrame, cards: DataFrame, links: DataFrame, depth: int, as_of_us: int) -> DataFrame:
    """What a hit of a branch (query_id, the hit's own scope, id, rank) may not be, as (query_id, scope, id, rule): blank, out of scope, not serviceable, without a source, twice, too deep."""
    key = ["query_id", *SCOPE, "id"]
    hits = branch.select(*key, "rank")
    n = hits.groupBy(*key).agg(F.count("*").alias("times"))
    owned = cards.select(*SCOPE, "id", serviceable(F.lit(as_of_us)).alias("live"), "candidate_id")
    asked = queries.select("query_id", F.struct(*SCOPE).alias("asked"))
    sourced = links.select(*SCOPE, "candidate_id").distinct().withColumn("sourced", F.lit(True))
    seen = hits.join(asked, "query_id").join(owned, [*SCOPE, "id"], "left").join(sourced, [*SCOPE, "candidate_id"], "left").join(n, key)
    rules = {
        "blank_id": F.trim("id") == "", "out_of_scope": F.struct(*SCOPE) != F.col("asked"), "not_serviceable": ~F.coalesce("live", F.lit(False)),
        "no_source": F.col("sourced").isNull(), "duplicate": F.col("times") > 1, "over_depth": F.col("rank") > depth,
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))
    return seen.select(*key, F.explode(broken).alias("rule")).distinct()
