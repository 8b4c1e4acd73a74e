"""Every registered query of the reference's operators, each with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallframe.operators import context, evaluation, lifecycle, projection, retrieval, validation
from recallframe.operators.lifecycle import SCOPE
from recallframe.sources.fixtures import AS_OF_US, BASE_US, SPACE, frames, oracle
from recallframe.session import table

LIMIT = 5
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Expressions that oracles share, in DuckDB SQL. An identity is compared by its normal parts, hashed as the operator does.
_part = "(CAST(octet_length(encode({0})) AS VARCHAR) || ':' || {0} || chr(0))"
_norm = "lower(trim({0}))"
SHARED = {
    "card_versions_all": f"""
      SELECT *, version + max(greatest(reviewed_us, created_us) - version) OVER (PARTITION BY tenant_id, user_id, erasure_epoch, identity_key ORDER BY commit_seq ROWS UNBOUNDED PRECEDING) AS card_created_us
      FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, user_id, erasure_epoch, identity_key ORDER BY commit_seq) AS version
        FROM (SELECT c.*, r.reviewed_us, r.commit_seq, sha256({" || ".join(_part.format(_norm.format(c)) for c in ("kind", "category", "memory_key", "person", "relationship"))}) AS identity_key,
            (SELECT count(*) FROM erasures e WHERE e.tenant_id = c.tenant_id AND e.user_id = c.user_id AND e.commit_seq <= r.commit_seq) AS erasure_epoch,
            (SELECT count(*) FROM erasures e WHERE e.tenant_id = c.tenant_id AND e.user_id = c.user_id) AS erasure_count
          FROM candidates c JOIN reviews r ON c.tenant_id = r.tenant_id AND c.user_id = r.user_id AND c.id = r.candidate_id AND r.decision = 'approve'))""",
    "card_versions_timed": """
      SELECT *, lead(card_created_us) OVER (PARTITION BY tenant_id, user_id, erasure_epoch, identity_key ORDER BY commit_seq) AS superseded_us FROM card_versions_all""",
    "cards": """
      SELECT tenant_id, user_id, 'm' || substr(id, 2) AS id, id AS candidate_id, identity_key, kind, category, memory_key, value, person, relationship, backstory, version,
        CASE WHEN superseded_us IS NULL THEN 'active' ELSE 'superseded' END AS status, card_created_us AS created_us, superseded_us, expires_us
      FROM card_versions_timed WHERE erasure_epoch >= erasure_count""",
    "card_chains": "SELECT tenant_id, user_id, identity_key FROM cards GROUP BY ALL",
    "live": f"SELECT * FROM cards WHERE status = 'active' AND (expires_us IS NULL OR expires_us > {AS_OF_US})",
    "card_tokens": r"""
      SELECT tenant_id, user_id, id, created_us, unnest(list_transform(list_concat(
          f(memory_key), f(memory_key), f(memory_key), f(value), f(value), f(category), f(person), f(relationship), f(backstory)), lambda w: n(w))) AS token FROM live""",
    "bm25_terms": "SELECT tenant_id, user_id, id, created_us, token, count(*) AS tf FROM card_tokens GROUP BY ALL",
    "bm25_lengths": "SELECT tenant_id, user_id, id, count(*) AS len FROM card_tokens GROUP BY ALL",
    "bm25_stats": "SELECT l.tenant_id, l.user_id, count(*) AS n, sum(coalesce(b.len, 0)) / count(*) AS avgdl FROM live l LEFT JOIN bm25_lengths b USING (tenant_id, user_id, id) GROUP BY ALL",
    "bm25_df": "SELECT tenant_id, user_id, token, count(*) AS df FROM bm25_terms GROUP BY ALL",
    "bm25_asked": "SELECT query_id, tenant_id, user_id, token, count(*) AS qtf FROM (SELECT query_id, tenant_id, user_id, unnest(list_transform(f(text), lambda w: n(w))) AS token FROM queries) GROUP BY ALL",
    "bm25_hits": """
      SELECT query_id, id, created_us, score FROM (
        SELECT query_id, id, created_us, list_sum(list(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl)) ORDER BY token)) AS score
        FROM bm25_asked JOIN bm25_df USING (tenant_id, user_id, token) JOIN bm25_terms USING (tenant_id, user_id, token) JOIN bm25_lengths USING (tenant_id, user_id, id) JOIN bm25_stats USING (tenant_id, user_id)
        GROUP BY query_id, id, created_us) WHERE score > 0""",
    "bm25_deep": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_us DESC, id) AS INT) AS rank FROM bm25_hits) WHERE rank <= 20",
    "fts_postings": """
      SELECT tenant_id, user_id, id, created_us, lexeme, sum(w) AS weight FROM (
        SELECT tenant_id, user_id, id, created_us, unnest(x(memory_key)) AS lexeme, 10 AS w FROM live UNION ALL SELECT tenant_id, user_id, id, created_us, unnest(x(value)), 4 FROM live
        UNION ALL SELECT tenant_id, user_id, id, created_us, unnest(x(category || ' ' || person || ' ' || relationship)), 2 FROM live
        UNION ALL SELECT tenant_id, user_id, id, created_us, unnest(x(backstory)), 1 FROM live) GROUP BY ALL""",
    "fts_hits": """
      SELECT query_id, id, created_us, round(sum(weight) / 10, 6) AS score
      FROM (SELECT query_id, tenant_id, user_id, unnest(list_distinct(x(text))) AS lexeme FROM queries) JOIN fts_postings USING (tenant_id, user_id, lexeme) GROUP BY query_id, id, created_us""",
    "vector_hits": """
      SELECT query_id, l.id, l.created_us, list_sum(list_transform(list_zip(vector, embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))
          / sqrt(list_sum(list_transform(vector, lambda a: CAST(a AS DOUBLE) * CAST(a AS DOUBLE))) * list_sum(list_transform(embedding, lambda a: CAST(a AS DOUBLE) * CAST(a AS DOUBLE)))) AS score
      FROM vector_queries q JOIN live l USING (tenant_id, user_id) JOIN vectors v ON v.tenant_id = l.tenant_id AND v.user_id = l.user_id AND v.memory_id = l.id""",
    "covered": f"""
      SELECT l.tenant_id, l.user_id, l.id AS memory_id, v.content_sha256 IS NOT NULL AND v.content_sha256 <> h.expected_sha256 AS stale,
        CASE WHEN j.state IS NULL THEN 'missing_job' WHEN j.expected_memory_version <> l.version THEN 'version_invariant' WHEN j.state IN ('pending', 'leased', 'retry') THEN 'in_flight'
          WHEN j.state IN ('dead', 'cancelled') THEN j.state WHEN v.content_sha256 IS NULL THEN 'succeeded_missing_embedding'
          WHEN v.content_sha256 <> h.expected_sha256 THEN 'content_hash_mismatch' ELSE 'converged' END AS class
      FROM live l LEFT JOIN (SELECT * FROM jobs WHERE embedding_space = '{SPACE}') j ON j.tenant_id = l.tenant_id AND j.user_id = l.user_id AND j.memory_id = l.id
      LEFT JOIN (SELECT * FROM vectors WHERE embedding_space = '{SPACE}') v ON v.tenant_id = l.tenant_id AND v.user_id = l.user_id AND v.memory_id = l.id
      LEFT JOIN expected_hashes h ON h.tenant_id = l.tenant_id AND h.user_id = l.user_id AND h.memory_id = l.id""",
    "cancelled_jobs": f"""
      SELECT j.* FROM jobs j WHERE (state IN ('pending', 'retry') OR (state = 'leased' AND lease_until_us <= {AS_OF_US}))
        AND NOT EXISTS (SELECT 1 FROM live l JOIN targets t ON t.state <> 'retired' WHERE l.tenant_id = j.tenant_id AND l.user_id = j.user_id AND l.id = j.memory_id AND l.version = j.expected_memory_version AND t.embedding_space = j.embedding_space)""",
    "document_lexemes": "SELECT 'c' || CAST(doc_id AS VARCHAR) AS candidate_id, unnest(list_distinct(x(text))) AS w FROM documents",
    "quality": """
      SELECT arm, query_id, round(coalesce(found, 0) / n, 9) AS recall, round(coalesce(1.0 / first, 0), 9) AS mrr, round(coalesce(dcg / ideal, 0), 9) AS ndcg, coalesce(found, 0) = n AS passed FROM (
        SELECT query_id, unnest(['rarest', 'bm25']) AS arm, count(*) AS n, sum(CASE WHEN i <= 10 THEN (pow(2, relevance) - 1) / log2(i + 1) END) AS ideal
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, candidate_id) AS i FROM relevance) GROUP BY query_id)
      LEFT JOIN (
        SELECT arm, query_id, count(*) FILTER (WHERE rank <= 5) AS found, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN (pow(2, relevance) - 1) / log2(rank + 1) END) AS dcg
        FROM judged_hits JOIN relevance USING (query_id, candidate_id) GROUP BY arm, query_id) USING (arm, query_id)""",
    "rarest_lexemes": """
      SELECT query_id, w FROM (SELECT 'q' || CAST(item_id AS VARCHAR) AS query_id, unnest(list_distinct(x(text))) AS w FROM benchmark) JOIN (SELECT w, count(*) AS df FROM document_lexemes GROUP BY w) USING (w)
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY df, w) <= 8""",
    "judged_hits": """
      SELECT 'bm25' AS arm, query_id, 'c' || substr(id, 2) AS candidate_id, rank FROM bm25_deep UNION ALL
      SELECT 'rarest', query_id, candidate_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, candidate_id) AS INT) AS rank
      FROM (SELECT query_id, candidate_id, count(*) AS shared FROM rarest_lexemes JOIN document_lexemes USING (w) GROUP BY ALL) QUALIFY rank <= 20""",
}
SHARED = {k: SHARED[k] for k in [*[k for k in SHARED if k not in ("quality", "judged_hits")], "judged_hits", "quality"]}


# classes of lexemes as DuckDB's expressions state them: no bounds, no look ahead
_W, _H, _P = r"[\p{L}\p{M}\p{Nd}]", r"(?:[a-z0-9][a-z0-9_-]*\.)+[a-z]{2,}", r"\p{Nd}*[\p{L}\p{M}][\p{L}\p{M}\p{Nd}]*"
_TOKENS = "|".join([
    r"<[a-z/!?][^<>]*>", r"&(?:[a-z][a-z0-9]+|#[0-9]+|#x[0-9a-f]+);", r"[a-z][a-z0-9]*://", rf"[a-z0-9][a-z0-9_.+-]*@{_H}", rf"{_H}(?::[0-9]+)?/[!#-;=?-\[\]_a-z~]*", rf"{_H}(?::[0-9]+)?",
    r"[-+]?[0-9]+(?:\.[0-9]+)?e[-+]?[0-9]+", r"[0-9]+(?:\.[0-9]+){2,}", r"[-+]?[0-9]+\.[0-9]+", r"[-+][0-9]+",
    r"[a-z][a-z0-9]*(?:[./][a-z0-9_][a-z0-9_-]*)+", r"(?:~|\.{1,2})?(?:/[a-z0-9_][a-z0-9_.-]*)+", rf"{_P}(?:-{_P})+", rf"{_W}+",
])
_LEXEMES = rf"""flatten(list_transform(regexp_extract_all(lower({{}}), '{_TOKENS}'), lambda t: CASE
  WHEN t LIKE '<%' OR t LIKE '&%' OR t LIKE '%://' THEN []
  WHEN regexp_full_match(t, '{_H}(?::[0-9]+)?/.*') THEN [t, split_part(t, '/', 1), substr(t, strpos(t, '/'))]
  WHEN regexp_full_match(t, '{_P}(?:-{_P})+') THEN list_concat([t], string_split(t, '-')) ELSE [t] END))"""


def _words(sql: str) -> str:
    """Expands the short names of tokenizers: f(..) words, n(..) normal form, x(..) lexemes."""
    sql = re.sub(r"\bf\((\w+)\)", r"regexp_extract_all(lower(\1), '[\\p{L}\\p{Nd}]+')", sql)
    sql = re.sub(r"\bx\(([^()]+)\)", lambda m: _LEXEMES.replace("{}", m[1]), sql)
    plural = "CASE WHEN octet_length(encode(w)) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' AND w NOT LIKE '%us' THEN substr(w, 1, length(w) - 1) ELSE w END"
    return re.sub(r"\bn\(w\)", plural, sql)


SHARED["hybrid_lexical"] = re.sub(r"\bqueries\b", "hybrid_queries", SHARED["fts_hits"])
SHARED["hybrid_dense"] = SHARED["vector_hits"].replace("vector_queries", "hybrid_queries")
SHARED = {k: _words(v) for k, v in SHARED.items()}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir), under its own name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(_words(sql), SHARED)
        return f

    return add


def versions(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.card_versions(*frames(spark, d, "candidates", "reviews", "erasures"))


def cards(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.current_cards(versions(spark, d))


def live_cards(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d).where(lifecycle.serviceable(F.lit(AS_OF_US)))


# --- scans and lookups


@query("SELECT * FROM evidence WHERE tenant_id = 'src1' AND user_id = 'en'")
def evidence_of_scope(spark, d):
    (evidence,) = frames(spark, d, "evidence")
    return evidence.where("tenant_id = 'src1' and user_id = 'en'")


@query("SELECT tenant_id, user_id, id, content FROM evidence WHERE tenant_id || user_id || id = (SELECT min(tenant_id || user_id || id) FROM evidence)")
def evidence_point_lookup(spark, d):
    (evidence,) = frames(spark, d, "evidence")
    first = evidence.agg(F.min_by(F.struct(*SCOPE, "id"), F.concat(*SCOPE, "id")).alias("k")).first()["k"]
    return context.point_lookup(evidence, *first).select(*SCOPE, "id", "content")


_REQUESTS = """SELECT candidate_id AS request_id, l.tenant_id, l.user_id, CAST(p AS INT) AS position, CASE p WHEN 1 THEN 'e0' ELSE evidence_id END AS id
  FROM (SELECT * FROM links WHERE source_order = 0) l, (SELECT unnest([0, 1, 2]) AS p)"""


@query(f"SELECT r.*, e.content, e.id IS NOT NULL AS found FROM ({_REQUESTS}) r LEFT JOIN evidence e ON r.tenant_id = e.tenant_id AND r.user_id = e.user_id AND r.id = e.id")
def evidence_multi_get(spark, d):
    links, evidence = frames(spark, d, "links", "evidence")
    ids = F.array("evidence_id", F.lit("e0"), "evidence_id").alias("ids")
    return context.multi_get(links.where("source_order = 0").select(F.col("candidate_id").alias("request_id"), *SCOPE, ids), evidence)


_ASKED = """SELECT candidate_id || '/' || CAST(source_order AS VARCHAR) AS request_id, l.tenant_id, l.user_id, CAST(p AS INT) AS position, CASE p WHEN 1 THEN 'e0' ELSE evidence_id END AS id
  FROM (SELECT * FROM bad_links WHERE source_order IN (0, 9)) l, (SELECT unnest([0, 1, 2]) AS p)"""


@query(f"""SELECT request_id, tenant_id, user_id, min(position) AS position, arg_min(id, position) AS id FROM ({_ASKED}) r
  WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.tenant_id = r.tenant_id AND e.user_id = r.user_id AND e.id = r.id) GROUP BY ALL""")
def evidence_first_missing(spark, d):
    links, evidence = frames(spark, d, "bad_links", "evidence")
    asked = links.where("source_order in (0, 9)").withColumn("request_id", F.concat_ws("/", "candidate_id", F.col("source_order").cast("string")))
    return context.first_missing(asked.select("request_id", *SCOPE, F.array("evidence_id", F.lit("e0"), "evidence_id").alias("ids")), evidence)


@query("""SELECT c.tenant_id, c.user_id, c.id, coalesce(s.ids, '') AS source_event_ids FROM candidates c LEFT JOIN (
  SELECT tenant_id, user_id, candidate_id, string_agg(evidence_id, ',' ORDER BY source_order) AS ids FROM links GROUP BY ALL) s ON s.tenant_id = c.tenant_id AND s.user_id = c.user_id AND s.candidate_id = c.id""")
def candidate_with_sources(spark, d):
    rows = lifecycle.candidates_with_sources(*frames(spark, d, "candidates", "links"))
    return rows.select(*SCOPE, "id", F.array_join("source_event_ids", ",").alias("source_event_ids"))


@query("SELECT tenant_id, user_id, id, version, created_us, expires_us FROM live")
def serviceable_cards(spark, d):
    return live_cards(spark, d).select(*SCOPE, "id", "version", "created_us", "expires_us").orderBy("created_us", "id")


@query("""SELECT s.*, (SELECT count(*) FROM reviews r WHERE r.decision = 'approve' AND r.tenant_id = s.tenant_id AND r.user_id = s.user_id)
  + (SELECT count(*) FROM erasures e WHERE e.tenant_id = s.tenant_id AND e.user_id = s.user_id) AS context_revision FROM scopes s""")
def context_revision(spark, d):
    return lifecycle.context_revision(*frames(spark, d, "scopes", "reviews", "erasures"))


@query("SELECT t.embedding_space, t.state, t.model, count(j.id) AS n_jobs FROM targets t LEFT JOIN jobs j USING (embedding_space) GROUP BY ALL")
def projection_targets(spark, d):
    targets, jobs = frames(spark, d, "targets", "jobs")
    counts = jobs.groupBy("embedding_space").agg(F.count("*").alias("n_jobs"))
    return targets.join(counts, "embedding_space", "left").select("embedding_space", "state", "model", F.coalesce("n_jobs", F.lit(0)).alias("n_jobs"))


@query("SELECT id, tenant_id, user_id, state, available_us FROM jobs WHERE state IN ('pending', 'retry', 'leased') ORDER BY available_us, created_us, id LIMIT 1000")
def projection_jobs(spark, d):
    (jobs,) = frames(spark, d, "jobs")
    open_ = jobs.where(F.col("state").isin("pending", "retry", "leased"))
    return open_.orderBy("available_us", "created_us", "id").limit(1000).select("id", *SCOPE, "state", "available_us")


@query("SELECT embedding_space, updated_us, (SELECT count(*) FROM jobs) AS generation FROM targets WHERE state = 'serving'")
def serving_state(spark, d):
    targets, jobs = frames(spark, d, "targets", "jobs")
    return targets.where("state = 'serving'").select("embedding_space", "updated_us").crossJoin(jobs.agg(F.count("*").alias("generation")))


# --- mutations as replays


@query("""SELECT tenant_id, user_id, id, content, seq FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, user_id, id ORDER BY seq) AS n FROM evidence_log) l
  WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM stored_evidence s WHERE s.tenant_id = l.tenant_id AND s.user_id = l.user_id AND s.id = l.id)""")
def evidence_append_dedup(spark, d):
    return lifecycle.append_evidence(*frames(spark, d, "stored_evidence", "evidence_log"))


@query("""SELECT c.tenant_id, c.user_id, c.id FROM candidates c JOIN (SELECT b.tenant_id, b.user_id, b.candidate_id FROM bad_links b LEFT JOIN evidence e ON e.tenant_id = b.tenant_id AND e.user_id = b.user_id AND e.id = b.evidence_id
  GROUP BY ALL HAVING count(*) = count(DISTINCT b.evidence_id) AND count(*) = count(e.id)) g ON g.tenant_id = c.tenant_id AND g.user_id = c.user_id AND g.candidate_id = c.id""")
def candidate_create(spark, d):
    return lifecycle.create_candidates(*frames(spark, d, "candidates", "bad_links", "evidence")).select(*SCOPE, "id")


@query("SELECT b.* FROM bad_links b WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.tenant_id = b.tenant_id AND e.user_id = b.user_id AND e.id = b.evidence_id)")
def missing_sources(spark, d):
    return context.missing_sources(*frames(spark, d, "bad_links", "evidence"))


@query("""SELECT c.tenant_id, c.user_id, c.id, CASE r.decision WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'pending' END AS status
  FROM candidates c LEFT JOIN reviews r ON r.tenant_id = c.tenant_id AND r.user_id = c.user_id AND r.candidate_id = c.id""")
def review_status(spark, d):
    return lifecycle.review_status(*frames(spark, d, "candidates", "reviews")).select(*SCOPE, "id", "status")


@query("SELECT c.tenant_id, c.user_id, c.id FROM candidates c JOIN reviews r ON r.tenant_id = c.tenant_id AND r.user_id = c.user_id AND r.candidate_id = c.id AND r.decision = 'reject'")
def review_reject(spark, d):
    return lifecycle.review_status(*frames(spark, d, "candidates", "reviews")).where("status = 'rejected'").select(*SCOPE, "id")


@query("""SELECT tenant_id, user_id, id, identity_key, CAST(version AS INT) AS version, erasure_epoch, card_created_us, superseded_us, CASE WHEN superseded_us IS NULL THEN 'active' ELSE 'superseded' END AS status,
  erasure_epoch < erasure_count AS erased FROM card_versions_timed""")
def card_versions(spark, d):
    return versions(spark, d).select(*SCOPE, "id", "identity_key", "version", "erasure_epoch", "card_created_us", "superseded_us", "status", "erased")


@query("SELECT tenant_id, user_id, identity_key, max(version) AS latest_version, max(created_us) AS latest_us FROM cards GROUP BY ALL")
def identity_chains(spark, d):
    return lifecycle.identity_chains(versions(spark, d))


@query("SELECT l.id, l.tenant_id, l.user_id, l.version AS expected_memory_version, t.embedding_space, 'pending' AS state FROM cards l, targets t WHERE l.status = 'active' AND t.enqueue_new AND t.state IN ('shadow', 'serving')")
def outbox_enqueue(spark, d):
    (targets,) = frames(spark, d, "targets")
    return projection.enqueue(cards(spark, d), targets).withColumnRenamed("memory_id", "id")


@query("""SELECT e.tenant_id, e.user_id, (SELECT count(*) FROM evidence x WHERE x.tenant_id = e.tenant_id AND x.user_id = e.user_id) AS evidence_deleted,
  (SELECT count(*) FROM candidates x WHERE x.tenant_id = e.tenant_id AND x.user_id = e.user_id) AS candidates_deleted,
  (SELECT count(*) FROM card_versions_timed x WHERE x.tenant_id = e.tenant_id AND x.user_id = e.user_id AND x.commit_seq < e.commit_seq) AS cards_deleted FROM erasures e""")
def forget_user_receipt(spark, d):
    erasures, evidence, candidates = frames(spark, d, "erasures", "evidence", "candidates")
    return lifecycle.forget_receipt(erasures, evidence, candidates, versions(spark, d))


@query("SELECT x.tenant_id, x.user_id, x.id FROM evidence x WHERE NOT EXISTS (SELECT 1 FROM erasures e WHERE x.tenant_id = e.tenant_id AND x.user_id = e.user_id AND CAST(substr(x.id, 2) AS BIGINT) * 7919 % 100003 < e.commit_seq)")
def forget_user_remaining(spark, d):
    """Evidence that was written after its scope's erasure, or whose scope has none."""
    evidence, erasures = frames(spark, d, "evidence", "erasures")
    return lifecycle.forget(evidence.withColumn("commit_seq", F.substring("id", 2, 40).cast("long") * 7919 % 100003), erasures).select(*SCOPE, "id")


#: The seven tables of a scope.
SCOPED = {"evidence": "evidence", "candidates": "candidates", "links": "links", "cards": "cards", "chains": "card_chains", "jobs": "jobs", "vectors": "vectors"}
_LEFT = " UNION ALL ".join(f"SELECT tenant_id, user_id, '{n}' AS table_name, count(*) AS n FROM {t} GROUP BY ALL" for n, t in SCOPED.items())
_RESIDUE = f"""SELECT s.*, x.table_name, coalesce(y.n, 0) AS n FROM scopes s CROSS JOIN (SELECT unnest({list(SCOPED)}) AS table_name) x
  LEFT JOIN ({_LEFT}) y ON y.tenant_id = s.tenant_id AND y.user_id = s.user_id AND y.table_name = x.table_name"""


def scoped_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    evidence, candidates, links, jobs, vectors = frames(spark, d, "evidence", "candidates", "links", "jobs", "vectors")
    v = versions(spark, d)
    return {"evidence": evidence, "candidates": candidates, "links": links, "cards": lifecycle.current_cards(v), "chains": lifecycle.identity_chains(v), "jobs": jobs, "vectors": vectors}


@query(_RESIDUE)
def scope_residue_counts(spark, d):
    (scopes,) = frames(spark, d, "scopes")
    return lifecycle.residue(scoped_tables(spark, d), scopes)


@query(f"""SELECT tenant_id, user_id, CAST(sum(n) AS BIGINT) AS n_left, CASE WHEN NOT starts_with(tenant_id, 'src3') THEN 'not_allowed' WHEN sum(n) > 0 THEN 'residue' ELSE 'cleaned' END AS verdict
  FROM (SELECT r.tenant_id, r.user_id, CASE WHEN e.tenant_id IS NULL OR r.user_id = 'de' THEN n ELSE 0 END AS n FROM ({_RESIDUE}) r LEFT JOIN erasures e ON e.tenant_id = r.tenant_id AND e.user_id = r.user_id) GROUP BY tenant_id, user_id""")
def scope_cleanup(spark, d):
    """Cleanup of all scopes after erasures of which those of one user failed; only one tenant's scopes may be cleaned up."""
    scopes, erasures = frames(spark, d, "scopes", "erasures")
    done = erasures.where("user_id <> 'de'")
    left = {name: lifecycle.forget(rows, done) for name, rows in scoped_tables(spark, d).items()}
    return lifecycle.cleanup(lifecycle.residue(left, scopes), "src3")


@query(f"""SELECT n.tenant_id, n.user_id, n.memory_id, CASE WHEN o.memory_id IS NULL THEN 'insert' WHEN o.content_sha256 <> n.content_sha256 THEN 'conflict' ELSE 'unchanged' END AS change, o.memory_id IS NULL AS bumps_revision
  FROM (SELECT tenant_id, user_id, memory_id, '{SPACE}' AS embedding_space, expected_sha256 AS content_sha256 FROM expected_hashes) n LEFT JOIN vectors o ON o.tenant_id = n.tenant_id AND o.user_id = n.user_id AND o.memory_id = n.memory_id""")
def embedding_upsert_changes(spark, d):
    vectors, hashes = frames(spark, d, "vectors", "expected_hashes")
    new = hashes.select(*SCOPE, "memory_id", F.lit(SPACE).alias("embedding_space"), F.col("expected_sha256").alias("content_sha256"))
    return projection.embedding_changes(vectors, new).drop("embedding_space")


@query("SELECT c.tenant_id, c.user_id, c.id, v.memory_id IS NOT NULL AS had_vector FROM cards c LEFT JOIN vectors v ON v.tenant_id = c.tenant_id AND v.user_id = c.user_id AND v.memory_id = c.id WHERE c.status = 'superseded'")
def supersede_cleanup(spark, d):
    (vectors,) = frames(spark, d, "vectors")
    gone = cards(spark, d).where("status = 'superseded'").select(*SCOPE, "id")
    had = vectors.select(*SCOPE, F.col("memory_id").alias("id"), F.lit(True).alias("had"))
    return gone.join(had, [*SCOPE, "id"], "left").select(*SCOPE, "id", F.coalesce("had", F.lit(False)).alias("had_vector"))


# --- retrieval


@query("SELECT query_id, id, round(score, 6) AS score, created_us, rank FROM bm25_deep WHERE rank <= 5")
def bm25_topk(spark, d):
    (queries,) = frames(spark, d, "queries")
    return retrieval.bm25(queries, cards(spark, d), LIMIT, AS_OF_US)


@query("SELECT tenant_id, user_id, n, round(avgdl, 6) AS avgdl FROM bm25_stats")
def bm25_corpus_stats(spark, d):
    return retrieval.corpus_stats(live_cards(spark, d)).withColumn("avgdl", F.round("avgdl", 6))


@query("SELECT * FROM (SELECT query_id, id, score, created_us, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_us DESC, id) AS INT) AS rank FROM fts_hits) WHERE rank <= 5")
def fts_topk(spark, d):
    (queries,) = frames(spark, d, "queries")
    return retrieval.full_text(queries, cards(spark, d), LIMIT, AS_OF_US)


@query("SELECT query_id, array_to_string(list_sort(list_distinct(x(text))), ' | ') AS lexemes FROM queries")
def fts_query_lexemes(spark, d):
    (queries,) = frames(spark, d, "queries")
    return queries.select("query_id", F.array_join(retrieval.fts_query(F.col("text")), " | ").alias("lexemes"))


@query("SELECT * FROM (SELECT query_id, id, round(score, 6) AS score, created_us, CAST(row_number() OVER (PARTITION BY query_id ORDER BY vector_hits.score DESC, created_us DESC, id) AS INT) AS rank FROM vector_hits) WHERE rank <= 5")
def vector_topk(spark, d):
    queries, vectors = frames(spark, d, "vector_queries", "vectors")
    return retrieval.vector_search(queries, cards(spark, d), vectors, LIMIT, AS_OF_US)


@query(f"""SELECT * FROM (SELECT query_id, h.id, round(h.score, 6) AS score, h.created_us, CAST(row_number() OVER (PARTITION BY query_id ORDER BY h.score DESC, h.created_us DESC, h.id) AS INT) AS rank
  FROM vector_hits h JOIN vector_queries q USING (query_id) JOIN live l ON l.id = h.id AND l.tenant_id = q.tenant_id AND l.user_id = q.user_id JOIN jobs j ON j.memory_id = l.id AND j.tenant_id = l.tenant_id AND j.user_id = l.user_id AND j.state = 'succeeded' AND j.expected_memory_version = l.version AND j.embedding_space = '{SPACE}'
  WHERE EXISTS (SELECT 1 FROM links k WHERE k.tenant_id = l.tenant_id AND k.user_id = l.user_id AND k.candidate_id = l.candidate_id)) WHERE rank <= 5""")
def serving_vector_topk(spark, d):
    queries, vectors, jobs, targets, links = frames(spark, d, "vector_queries", "vectors", "jobs", "targets", "links")
    ready = retrieval.ready_cards(cards(spark, d), vectors, jobs, targets, links, SPACE)
    return retrieval.vector_search(queries, ready, vectors, LIMIT, AS_OF_US)


_RRF = """SELECT * FROM (SELECT query_id, id, created_us, round(score, 9) AS score, best_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, created_us DESC, id) AS INT) AS rank
  FROM (SELECT query_id, id, created_us, sum(1.0 / (60 + rank)) AS score, min(rank) AS best_rank FROM (
    SELECT query_id, id, created_us, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_us DESC, id) AS INT) AS rank FROM hybrid_lexical) WHERE rank <= 20
    UNION ALL SELECT query_id, id, created_us, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_us DESC, id) AS INT) AS rank FROM hybrid_dense) WHERE rank <= 20)
  GROUP BY query_id, id, created_us)) WHERE rank <= 5"""


@query(_RRF)
def hybrid_rrf(spark, d):
    """Full text and vectors, fused; hits of one branch alone count."""
    queries, vectors = frames(spark, d, "hybrid_queries", "vectors")
    c, depth = cards(spark, d), retrieval.branch_depth(LIMIT)
    fused = retrieval.reciprocal_rank_fusion(retrieval.full_text(queries, c, depth, AS_OF_US), retrieval.vector_search(queries, c, vectors, depth, AS_OF_US), LIMIT)
    return fused.withColumn("score", F.round("score", 9))


#: Hits of an untrusted branch: a query's own cards, those of the same user under other tenants, and one card of each scope by an id that it lacks.
_UNTRUSTED = """SELECT query_id, q.tenant_id, q.user_id, id, rank FROM bm25_deep JOIN (SELECT query_id, tenant_id, user_id FROM queries) q USING (query_id)
  UNION ALL SELECT h.query_id, 'twin', q.user_id, h.id, h.rank FROM bm25_deep h JOIN queries q USING (query_id)
  UNION ALL SELECT h.query_id, q.tenant_id, q.user_id, h.id, h.rank + 20 FROM bm25_deep h JOIN queries q USING (query_id) WHERE h.rank = 2
  UNION ALL SELECT query_id, tenant_id, user_id, 'none', 3 FROM queries UNION ALL SELECT query_id, tenant_id, user_id, ' ', 4 FROM queries"""


def _untrusted(spark, d):
    (queries,) = frames(spark, d, "queries")
    own = retrieval.bm25(queries, cards(spark, d), 20, AS_OF_US).select("query_id", "id", "rank").join(queries.select("query_id", *SCOPE), "query_id")
    names = ["query_id", *SCOPE, "id", "rank"]
    other = own.withColumn("tenant_id", F.lit("twin"))
    again = own.where("rank = 2").withColumn("rank", F.col("rank") + 20)
    odd = [queries.select("query_id", *SCOPE, F.lit(i).alias("id"), F.lit(r).alias("rank")) for i, r in (("none", 3), (" ", 4))]
    out = own.select(*names)
    for part in (other, again, *odd):
        out = out.unionByName(part.select(*names))
    return queries, out


@query(f"""SELECT * FROM (WITH u AS ({_UNTRUSTED}), n AS (SELECT query_id, tenant_id, user_id, id, count(*) AS times FROM u GROUP BY ALL)
  SELECT DISTINCT query_id, tenant_id, user_id, id, rule FROM (
  SELECT u.query_id, u.tenant_id, u.user_id, u.id, unnest(list_filter([CASE WHEN c.id IS NULL OR NOT (status = 'active' AND (expires_us IS NULL OR expires_us > {AS_OF_US})) THEN 'not_serviceable' END,
    CASE WHEN NOT EXISTS (SELECT 1 FROM links k WHERE k.tenant_id = c.tenant_id AND k.user_id = c.user_id AND k.candidate_id = c.candidate_id) THEN 'no_source' END,
    CASE WHEN trim(u.id) = '' THEN 'blank_id' END, CASE WHEN n.times > 1 THEN 'duplicate' END, CASE WHEN u.rank > 20 THEN 'over_depth' END,
    CASE WHEN u.tenant_id <> q.tenant_id OR u.user_id <> q.user_id THEN 'out_of_scope' END], lambda r: r IS NOT NULL)) AS rule
  FROM u JOIN queries q USING (query_id) JOIN n ON n.query_id = u.query_id AND n.tenant_id = u.tenant_id AND n.user_id = u.user_id AND n.id = u.id
  LEFT JOIN cards c ON c.tenant_id = u.tenant_id AND c.user_id = u.user_id AND c.id = u.id))""")
def hybrid_violations(spark, d):
    queries, untrusted = _untrusted(spark, d)
    (links,) = frames(spark, d, "links")
    return retrieval.fusion_violations(untrusted, queries, cards(spark, d), links, retrieval.branch_depth(LIMIT), AS_OF_US)


@query(f"""SELECT * FROM (WITH u AS (SELECT DISTINCT query_id, tenant_id, user_id, id FROM ({_UNTRUSTED})), k AS (
    SELECT l.tenant_id, l.user_id, l.candidate_id, count(*) AS n, count(e.id) AS n_there FROM bad_links l LEFT JOIN evidence e ON e.tenant_id = l.tenant_id AND e.user_id = l.user_id AND e.id = l.evidence_id GROUP BY ALL)
  SELECT DISTINCT query_id, id, rule FROM (SELECT u.query_id, u.id, unnest(list_filter([CASE WHEN u.tenant_id <> q.tenant_id OR u.user_id <> q.user_id THEN 'out_of_scope' END,
    CASE WHEN c.id IS NULL OR NOT (status = 'active' AND (expires_us IS NULL OR expires_us > {AS_OF_US})) THEN 'not_serviceable' END,
    CASE WHEN k.n IS NULL THEN 'no_source' END, CASE WHEN k.n_there < k.n THEN 'missing_source' END], lambda r: r IS NOT NULL)) AS rule
  FROM u JOIN queries q USING (query_id) LEFT JOIN cards c ON c.tenant_id = u.tenant_id AND c.user_id = u.user_id AND c.id = u.id
  LEFT JOIN k ON k.tenant_id = c.tenant_id AND k.user_id = c.user_id AND k.candidate_id = c.candidate_id))""")
def context_untrusted(spark, d):
    """Hits that make a pack fail: of other scopes, unknown, expired, without a source or with one that is missing."""
    queries, untrusted = _untrusted(spark, d)
    links, evidence = frames(spark, d, "bad_links", "evidence")
    return context.untrusted_hits(untrusted, queries, cards(spark, d), links, evidence, AS_OF_US)


@query("""SELECT h.query_id, h.rank, h.id, c.memory_key, s.sources FROM (SELECT * FROM bm25_deep WHERE rank <= 5) h JOIN queries q USING (query_id) JOIN cards c ON c.tenant_id = q.tenant_id AND c.user_id = q.user_id AND c.id = h.id JOIN (
  SELECT k.tenant_id, k.user_id, k.candidate_id, string_agg(k.evidence_id || ':' || sha256(e.content), ',' ORDER BY source_order, k.evidence_id) AS sources FROM links k JOIN evidence e ON e.tenant_id = k.tenant_id AND e.user_id = k.user_id AND e.id = k.evidence_id GROUP BY ALL) s
  ON s.tenant_id = c.tenant_id AND s.user_id = c.user_id AND s.candidate_id = c.candidate_id""")
def context_pack(spark, d):
    queries, links, evidence = frames(spark, d, "queries", "links", "evidence")
    c = cards(spark, d)
    items = context.context_items(retrieval.bm25(queries, c, LIMIT, AS_OF_US), queries, c, links, evidence)
    packs = context.context_packs(items, queries, AS_OF_US)
    flat = packs.select("query_id", F.explode("items").alias("i"))
    sources = F.array_join(F.transform("i.sources", lambda s: F.concat(s["evidence_id"], F.lit(":"), F.sha2(s["content"], 256))), ",")
    return flat.select("query_id", "i.rank", "i.id", "i.memory_key", sources.alias("sources"))


# --- projection


@query("SELECT id, tenant_id, user_id, memory_id FROM cancelled_jobs")
def jobs_to_cancel(spark, d):
    jobs, targets = frames(spark, d, "jobs", "targets")
    return projection.to_cancel(jobs, cards(spark, d), targets, AS_OF_US).select("id", *SCOPE, "memory_id")


@query(f"SELECT id, 'dead' AS state, 'attempts_exhausted' AS last_error_code FROM jobs WHERE (state = 'retry' OR (state = 'leased' AND lease_until_us <= {AS_OF_US})) AND attempt_count >= 5")
def jobs_dead_lettered(spark, d):
    (jobs,) = frames(spark, d, "jobs")
    return projection.dead_lettered(jobs, AS_OF_US).select("id", "state", "last_error_code")


@query(f"""SELECT id, memory_id, 'leased' AS state, attempt_count + 1 AS attempt_count, lease_version + 1 AS lease_version, 'worker-1' AS lease_owner, {AS_OF_US} + 30000000 AS lease_until_us FROM (
  SELECT j.*, row_number() OVER (PARTITION BY embedding_space ORDER BY available_us, created_us, id) AS place FROM jobs j
  WHERE ((state IN ('pending', 'retry') AND available_us <= {AS_OF_US}) OR (state = 'leased' AND lease_until_us <= {AS_OF_US})) AND NOT (state IN ('retry', 'leased') AND attempt_count >= 5)
    AND id NOT IN (SELECT id FROM cancelled_jobs)) WHERE place <= 50""")
def job_claim(spark, d):
    jobs, targets = frames(spark, d, "jobs", "targets")
    claimed = projection.claim(jobs, cards(spark, d), targets, "worker-1", 50, AS_OF_US, 30_000_000)
    return claimed.select("id", "memory_id", "state", "attempt_count", "lease_version", "lease_owner", "lease_until_us")


@query(f"""SELECT j.id, o.outcome, o.outcome = 'succeeded' AND v.content_sha256 IS NULL AS bumps_revision FROM jobs j
  LEFT JOIN live l ON l.tenant_id = j.tenant_id AND l.user_id = j.user_id AND l.id = j.memory_id AND l.version = j.expected_memory_version
  LEFT JOIN vectors v ON v.tenant_id = j.tenant_id AND v.user_id = j.user_id AND v.memory_id = j.memory_id LEFT JOIN expected_hashes h ON h.tenant_id = j.tenant_id AND h.user_id = j.user_id AND h.memory_id = j.memory_id,
  LATERAL (SELECT CASE WHEN j.id % 4 = 3 OR lease_until_us <= {AS_OF_US} THEN 'lease_lost' WHEN l.id IS NULL THEN 'cancelled' WHEN v.content_sha256 <> h.expected_sha256 THEN 'conflict' ELSE 'succeeded' END AS outcome) o WHERE j.state = 'leased'""")
def job_finalize_outcomes(spark, d):
    jobs, targets, hashes, vectors = frames(spark, d, "jobs", "targets", "expected_hashes", "vectors")
    # a quarter of the commands come with an old version of the lease
    old = (F.col("id") % 4 == 3).cast("int")
    commands = jobs.where("state = 'leased'").select("id", "lease_owner", (F.col("lease_version") - old).alias("lease_version"))
    return projection.finalize(jobs, commands, cards(spark, d), targets, hashes, vectors, AS_OF_US)


@query(f"""SELECT id, verb, CASE WHEN held THEN 'applied' ELSE 'lease_lost' END AS outcome, CASE WHEN NOT held THEN state WHEN verb = 'retry' THEN 'retry' WHEN verb = 'dead' THEN 'dead' ELSE 'cancelled' END AS state,
  CASE WHEN held AND verb = 'retry' THEN 'provider_timeout' ELSE last_error_code END AS last_error_code, CASE WHEN NOT held THEN available_us WHEN verb = 'retry' THEN {AS_OF_US} + 1000 ELSE {AS_OF_US} END AS available_us
  FROM (SELECT *, state = 'leased' AND coalesce(lease_owner, '') = 'w1' AND id % 2 = 0 AND lease_until_us > {AS_OF_US} AS held FROM jobs, (SELECT unnest(['retry', 'dead', 'cancel']) AS verb)) WHERE state = 'leased'""")
def job_transitions(spark, d):
    """Commands of one worker on all leased jobs, half of them with an old version of the lease."""
    (jobs,) = frames(spark, d, "jobs")
    verbs = F.explode(F.array(*[F.lit(v) for v in ("retry", "dead", "cancel")])).alias("verb")
    commands = jobs.where("state = 'leased'").select("id", F.lit("w1").alias("lease_owner"), (F.col("lease_version") - F.col("id") % 2).alias("lease_version"), verbs)
    coded = commands.withColumn("code", F.when(F.col("verb") == "retry", "provider_timeout")).withColumn("backoff_us", F.lit(1000).cast("long"))
    return projection.transition(jobs, coded, AS_OF_US)


@query(f"""SELECT id, CASE WHEN again = 'transport' AND attempt_count < 5 THEN 'retry' ELSE 'dead' END AS state,
  CASE WHEN again = 'transport' AND attempt_count < 5 THEN {AS_OF_US} + CAST(pow(2, greatest(0, least(attempt_count - 1, 8))) AS BIGINT) * 1000000 END AS available_us FROM (SELECT *, CASE WHEN last_error_code IN ('transport', 'provider_timeout', 'provider_rate_limited', 'provider_unavailable') THEN 'transport' END AS again FROM jobs) WHERE last_error_code IS NOT NULL""")
def job_retry_schedule(spark, d):
    (jobs,) = frames(spark, d, "jobs")
    return projection.retry_schedule(jobs, AS_OF_US)


@query(f"""SELECT embedding_space, count(*) AS total, {", ".join(f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in projection.STATES)},
  min(available_us) FILTER (WHERE state IN ('pending', 'retry')) AS oldest_available_us, max(attempt_count) AS max_attempts FROM jobs GROUP BY ALL""")
def projection_job_stats(spark, d):
    (jobs,) = frames(spark, d, "jobs")
    return projection.stats(jobs)


def covered(spark, d):
    jobs, vectors, hashes = frames(spark, d, "jobs", "vectors", "expected_hashes")
    return projection.coverage(cards(spark, d), jobs, vectors, hashes, SPACE, AS_OF_US)


@query("SELECT * FROM covered")
def coverage_classes(spark, d):
    return covered(spark, d)


@query(f"SELECT count(*) AS scanned, {', '.join(f"count(*) FILTER (WHERE class = '{c}') AS {c}" for c in projection.CLASSES)} FROM covered")
def coverage_report(spark, d):
    return projection.coverage_report(covered(spark, d))


@query("""SELECT tenant_id, user_id, memory_id, action, stale AS delete_vector, stale OR class = 'succeeded_missing_embedding' AS bumps_scope FROM (
  SELECT *, CASE WHEN class = 'missing_job' THEN 'enqueue' WHEN class IN ('succeeded_missing_embedding', 'content_hash_mismatch') THEN 'reset' ELSE 'none' END AS action FROM covered) WHERE action <> 'none' OR stale""")
def reconcile_repairs(spark, d):
    return projection.repairs(covered(spark, d), serving=True)


@query(f"""SELECT *, live_cards = covered_cards AND live_cards > 0 AS allowed FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT tenant_id, user_id FROM live)) AS live_scopes, (SELECT count(*) FROM live) AS live_cards, (SELECT count(*) FROM covered WHERE class = 'converged') AS covered_cards,
  (SELECT greatest(max(updated_us) + 1, {AS_OF_US}) FROM targets) AS promoted_us, 'space_v1_next' AS to_space)""")
def promotion_plan(spark, d):
    (targets,) = frames(spark, d, "targets")
    return projection.promotion_plan(cards(spark, d), covered(spark, d), targets, "space_v1_next", False, AS_OF_US)


_PROMOTED = f"(SELECT greatest(max(updated_us) + 1, {AS_OF_US}) FROM targets)"


@query(f"""SELECT 'target' AS part, embedding_space AS key, CASE WHEN embedding_space = 'space_v1_next' THEN 'serving' WHEN state = 'serving' THEN 'shadow' ELSE state END AS value,
    CASE WHEN embedding_space = 'space_v1_next' OR state = 'serving' THEN {_PROMOTED} ELSE updated_us END AS number FROM targets
  UNION ALL SELECT 'deployment', '', '', count(*) + 1 FROM jobs
  UNION ALL SELECT DISTINCT 'bump', tenant_id, user_id, {_PROMOTED} FROM live
  UNION ALL SELECT 'receipt', 'op-1', '{SPACE}>space_v1_next/' || CAST((SELECT count(*) FROM (SELECT DISTINCT tenant_id, user_id FROM live)) AS VARCHAR) || '/' || CAST((SELECT count(*) FROM live) AS VARCHAR) || '/' || CAST((SELECT count(*) FROM live) AS VARCHAR)
    || '/' || CAST(count(*) AS VARCHAR) || '/{AS_OF_US}/' || CAST({_PROMOTED} AS VARCHAR), count(*) + 1 FROM jobs""")
def promotion_commit(spark, d):
    """What a promotion commits once all live cards are covered: swapped targets, the next generation, a bump for each live scope, and the receipt."""
    targets, jobs = frames(spark, d, "targets", "jobs")
    repaired = covered(spark, d).withColumn("class", F.lit("converged"))
    rows = projection.promotion(cards(spark, d), repaired, targets, jobs.agg(F.count("*").alias("generation")), "op-1", "space_v1_next", False, AS_OF_US)
    line = lambda part, key, value, number: [F.lit(part).alias("part"), key.alias("key"), value.alias("value"), number.cast("long").alias("number")]
    counts = F.concat_ws("/", *[F.col(c).cast("string") for c in ("live_scopes", "live_cards", "covered_cards", "previous_generation", "cutoff_us", "promoted_us")])
    parts = [
        rows["targets"].select(*line("target", F.col("embedding_space"), F.col("state"), F.col("updated_us"))), rows["deployment"].select(*line("deployment", F.lit(""), F.lit(""), F.col("generation"))),
        rows["bumps"].select(*line("bump", F.col("tenant_id"), F.col("user_id"), F.col("commit_seq"))),
        rows["receipts"].select(*line("receipt", F.col("operation_id"), F.concat("from_space", F.lit(">"), "to_space", F.lit("/"), counts), F.col("generation"))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT DISTINCT tenant_id, user_id FROM live")
def live_scopes(spark, d):
    (scopes,) = frames(spark, d, "scopes")
    return scopes.join(live_cards(spark, d), SCOPE, "left_semi")


@query("SELECT tenant_id, user_id, id FROM live WHERE (tenant_id, user_id, id) > ('src1', 'en', 'm5') ORDER BY tenant_id, user_id, id LIMIT 51")
def keyset_page(spark, d):
    return projection.keyset_page(cards(spark, d), ("src1", "en", "m5"), 50, AS_OF_US)


_CHANGES = f"""SELECT embedding_space, new_state, updated_us + shift AS at_us FROM targets, (SELECT unnest(['serving', 'shadow', 'blocked', 'retired']) AS new_state), (SELECT unnest([-1, 0, 5]) AS shift)"""


@query(f"""SELECT c.embedding_space, new_state, at_us - updated_us AS shift, CASE WHEN new_state = 'serving' OR state = 'serving' THEN 'conflict' WHEN at_us = updated_us AND new_state = state THEN 'unchanged'
  WHEN at_us <= updated_us OR state = 'retired' THEN 'conflict' ELSE 'applied' END AS verdict FROM ({_CHANGES}) c JOIN targets t ON t.embedding_space = c.embedding_space""")
def target_transitions(spark, d):
    (targets,) = frames(spark, d, "targets")
    states, shifts = F.array(*[F.lit(s) for s in ("serving", "shadow", "blocked", "retired")]), F.array(F.lit(-1), F.lit(0), F.lit(5))
    asked = targets.select("embedding_space", "updated_us", F.explode(states).alias("new_state")).select("*", F.explode(shifts).alias("shift"))
    # verdicts carry no time: the three shifts come from one request each
    parts = None
    for shift in (-1, 0, 5):
        one = projection.target_transition(targets, asked.where(F.col("shift") == shift).select("embedding_space", "new_state", (F.col("updated_us") + shift).alias("at_us")))
        one = one.select("embedding_space", "new_state", F.lit(shift).cast("long").alias("shift"), "verdict")
        parts = one if parts is None else parts.unionByName(one)
    return parts


# --- evaluation and validation


ARMS = ["rarest", "bm25"]


def rarest_hits(spark, d):
    """A plain untrusted arm for evaluation: documents of any scope by a query's rarest lexemes."""
    asked = table(spark, d, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("query_id"), "text")
    docs = table(spark, d, "documents").select(F.concat(F.lit("c"), "doc_id").alias("candidate_id"), "text")
    return retrieval.rarest_overlap(asked, docs, 8, 20).select("query_id", "candidate_id", "rank")


def judged_hits(spark, d):
    """Hits of two arms: the untrusted one, and BM25 in the query's scope."""
    (queries,) = frames(spark, d, "queries")
    best = retrieval.bm25(queries, cards(spark, d), 20, AS_OF_US).select("query_id", F.concat(F.lit("c"), F.substring("id", 2, 40)).alias("candidate_id"), "rank")
    return rarest_hits(spark, d).withColumn("arm", F.lit("rarest")).unionByName(best.withColumn("arm", F.lit("bm25")))


@query("SELECT * FROM quality")
def eval_quality(spark, d):
    (relevance,) = frames(spark, d, "relevance")
    return evaluation.quality(judged_hits(spark, d), relevance, 5, 10, ARMS)


def _quality_column(name: str, column: str):
    def run(spark, d):
        return eval_quality(spark, d).select("arm", "query_id", column)

    run.__name__ = name
    return query(f"SELECT arm, query_id, {column} FROM quality")(run)


for _name, _column in (("eval_recall", "recall"), ("eval_mrr", "mrr"), ("eval_ndcg", "ndcg"), ("eval_pass", "passed")):
    _quality_column(_name, _column)


@query("SELECT arm, count(*) AS quality_query_count, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(CAST(passed AS DOUBLE)), 6) AS pass_rate, bool_and(passed) AS all_passed FROM quality GROUP BY arm")
def eval_arm_aggregate(spark, d):
    return evaluation.arm_aggregate(eval_quality(spark, d), "arm")


_POLICY = f"""SELECT q.query_id, count(h.id) AS hits, count(CASE WHEN h.id LIKE '%9' THEN 1 END) AS forbidden_hits, count(*) FILTER (WHERE h.id IS NOT NULL AND c.id IS NULL) AS unknown_hits,
  count(*) FILTER (WHERE c.tenant_id <> q.tenant_id OR c.user_id <> q.user_id) AS scope_violations, count(*) FILTER (WHERE c.status <> 'active') AS non_active_hits, count(*) FILTER (WHERE c.expires_us <= {AS_OF_US}) AS expired_hits,
  count(h.id) - count(DISTINCT (h.tenant_id, h.id)) FILTER (WHERE h.id IS NOT NULL) AS duplicate_hits, count(*) FILTER (WHERE h.rank > 5) AS over_limit_hits,
  count(*) FILTER (WHERE c.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM links k WHERE k.tenant_id = c.tenant_id AND k.user_id = c.user_id AND k.candidate_id = c.candidate_id)) AS missing_sources,
  q.query_id LIKE '%0' AND count(h.id) > 0 AS require_empty_failure
  FROM queries q LEFT JOIN (SELECT query_id, CASE WHEN rank % 4 = 1 THEN 'twin' ELSE source END AS tenant_id, lang AS user_id, 'm' || substr(candidate_id, 2) AS id, unnest(CASE WHEN rank = 3 THEN [3, 21] ELSE [rank] END) AS rank
    FROM judged_hits JOIN documents ON 'c' || CAST(doc_id AS VARCHAR) = candidate_id WHERE arm = 'rarest' AND query_id NOT LIKE '%3' AND (query_id NOT LIKE '%1' OR rank <= 2)) h USING (query_id)
  LEFT JOIN cards c ON c.tenant_id = h.tenant_id AND c.user_id = h.user_id AND c.id = h.id GROUP BY q.query_id"""
_PASSED = " AND ".join(f"{c} = 0" for c in evaluation.COUNTERS) + " AND NOT require_empty_failure"


@query(f"SELECT *, {_PASSED} AS passed FROM ({_POLICY})")
def eval_policy(spark, d):
    """Hits of which the third comes twice and every fourth is of another tenant; some queries have few or none, and some must have none."""
    queries, links = frames(spark, d, "queries", "links")
    own = table(spark, d, "documents").select(F.concat(F.lit("c"), "doc_id").alias("candidate_id"), F.col("source").alias("tenant_id"), F.col("lang").alias("user_id"))
    hits = rarest_hits(spark, d).where("query_id not like '%3' and (query_id not like '%1' or rank <= 2)").join(own, "candidate_id")
    tenant = F.when(F.col("rank") % 4 == 1, "twin").otherwise(F.col("tenant_id"))
    hits = hits.select("query_id", tenant.alias("tenant_id"), "user_id", F.concat(F.lit("m"), F.substring("candidate_id", 2, 40)).alias("id"), "rank")
    hits = hits.unionByName(hits.where("rank = 3").withColumn("rank", F.lit(21)))
    forbidden = hits.where("id like '%9'").select("query_id", *SCOPE, "id").distinct()
    return evaluation.policy(hits, queries, cards(spark, d), links, forbidden, LIMIT, AS_OF_US, require_empty=queries.where("query_id like '%0'"))


@query(f"""SELECT 'judged' AS arm, count(*) AS query_count, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in evaluation.COUNTERS)}, count(*) FILTER (WHERE require_empty_failure) AS require_empty_failures,
  bool_and({_PASSED}) AS all_passed FROM ({_POLICY})""")
def eval_policy_totals(spark, d):
    return evaluation.policy_totals(eval_policy(spark, d).withColumn("arm", F.lit("judged")))


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS largest FROM events GROUP BY ALL")
def latency_percentiles(spark, d):
    return evaluation.latency(table(spark, d, "events"), "event_type", "value")


@query()
def eval_bootstrap_ci(spark, d):
    return evaluation.bootstrap(eval_quality(spark, d))


@query("SELECT query_id, count(*) FILTER (WHERE id LIKE '%7') = 0 AS stable FROM bm25_deep WHERE rank <= 5 GROUP BY query_id")
def ranking_stability(spark, d):
    """Two runs, the second of which scores some cards otherwise."""
    again = bm25_topk(spark, d)
    return evaluation.ranking_stability(bm25_topk(spark, d), again.withColumn("score", F.when(F.col("id").like("%7"), F.col("score") + 1).otherwise(F.col("score"))))


@query("""SELECT id, unnest(list_filter([CASE WHEN trim(content) = '' THEN 'blank_content' END, CASE WHEN octet_length(encode(content)) > 32768 THEN 'content_too_long' END], lambda r: r IS NOT NULL)) AS rule FROM evidence""")
def evidence_violations(spark, d):
    (evidence,) = frames(spark, d, "evidence")
    return validation.violations(evidence, validation.evidence_rules(), "id")


@query("SELECT id, 'value_too_long' AS rule FROM candidates WHERE octet_length(encode(value)) > 4096")
def candidate_violations(spark, d):
    (candidates,) = frames(spark, d, "candidates")
    return validation.violations(candidates, validation.candidate_rules(), "id")


@query("SELECT id, 'leased_attempts' AS rule FROM jobs WHERE state = 'leased' AND attempt_count = 0")
def constraint_violations(spark, d):
    (jobs,) = frames(spark, d, "jobs")
    broken = validation.violations(cards(spark, d), validation.card_rules(), "id")
    return validation.violations(jobs, validation.job_rules(), "id").unionByName(broken.withColumn("id", F.col("id").try_cast("long")))


_TWICE = "SELECT * FROM cards UNION ALL SELECT * FROM cards WHERE id LIKE '%3'"


@query(f"""SELECT 'one_active' AS rule, tenant_id, user_id, identity_key, NULL::BIGINT AS version, count(*) AS n FROM ({_TWICE}) WHERE status = 'active' GROUP BY ALL HAVING n > 1
  UNION ALL SELECT 'one_of_version', tenant_id, user_id, identity_key, version, count(*) AS n FROM ({_TWICE}) GROUP BY ALL HAVING n > 1
  UNION ALL SELECT 'one_of_candidate', tenant_id, user_id, candidate_id, NULL, count(*) AS n FROM ({_TWICE}) GROUP BY ALL HAVING n > 1
  UNION ALL SELECT 'one_serving', NULL, NULL, NULL, NULL, count(*) AS n FROM targets WHERE state IN ('serving', 'shadow') HAVING n > 1""")
def uniqueness_violations(spark, d):
    """One active card per identity, one card per version of it and per candidate, over cards some of which were written twice; one serving target, where the shadow serves as well."""
    (targets,) = frames(spark, d, "targets")
    c = cards(spark, d)
    twice = c.unionByName(c.where("id like '%3'"))
    active = validation.duplicates(twice.where("status = 'active'"), *SCOPE, "identity_key").withColumn("version", F.lit(None).cast("long")).withColumn("rule", F.lit("one_active"))
    each = validation.duplicates(twice, *SCOPE, "identity_key", "version").withColumn("version", F.col("version").cast("long")).withColumn("rule", F.lit("one_of_version"))
    null = [F.lit(None).cast("string").alias(c) for c in (*SCOPE, "identity_key")]
    no_version = F.lit(None).cast("long").alias("version")
    candidate = validation.duplicates(twice, *SCOPE, "candidate_id").select(*SCOPE, F.col("candidate_id").alias("identity_key"), no_version, "n", F.lit("one_of_candidate").alias("rule"))
    swapped = targets.withColumn("state", F.when(F.col("state") == "shadow", "serving").otherwise(F.col("state")))
    serving = validation.duplicates(swapped.where("state = 'serving'"), "state").select(*null, no_version, "n", F.lit("one_serving").alias("rule"))
    return active.unionByName(each).unionByName(candidate).unionByName(serving)


_FKS = {
    "job_card": ("jobs", "cards", "memory_id", "id"), "vector_card": ("vectors", "cards", "memory_id", "id"),
    "link_candidate": ("bad_links", "candidates", "candidate_id", "id"), "link_evidence": ("bad_links", "evidence", "evidence_id", "id"),
}


@query(" UNION ALL ".join(
  f"SELECT '{name}' AS fk, x.tenant_id, x.user_id, x.{c} AS id FROM {child} x WHERE NOT EXISTS (SELECT 1 FROM {parent} y WHERE y.tenant_id = x.tenant_id AND y.user_id = x.user_id AND y.{k} = x.{c})"
  for name, (child, parent, c, k) in _FKS.items()))
def fk_violations(spark, d):
    """Rows whose key, scope included, their parent table lacks."""
    found = None
    for name, (child, parent, column, key) in _FKS.items():
        (rows,) = frames(spark, d, child)
        owners = cards(spark, d) if parent == "cards" else frames(spark, d, parent)[0]
        broken = validation.dangling(rows, owners.select(*SCOPE, F.col(key).alias(column)), [*SCOPE, column])
        one = broken.select(F.lit(name).alias("fk"), *SCOPE, F.col(column).alias("id"))
        found = one if found is None else found.unionByName(one)
    return found


#: Batches of two sizes by the candidate's number, and quotes of which some aren't in their evidence.
_BATCH = "CASE WHEN CAST(substr({0}, 2) AS BIGINT) % 2 = 0 THEN 'b' || CAST(CAST(substr({0}, 2) AS BIGINT) % 40 AS STRING) ELSE 'w' || CAST(CAST(substr({0}, 2) AS BIGINT) % 3 AS STRING) END"


@query(f"""SELECT * FROM (WITH p AS (SELECT tenant_id, user_id, {_BATCH.format("id")} AS batch_id, count(*) AS candidates, count(*) - count(DISTINCT (kind, category, memory_key, person, relationship)) AS duplicate_identities,
    count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM bad_links k WHERE k.tenant_id = c.tenant_id AND k.user_id = c.user_id AND k.candidate_id = c.id)) AS unsupported FROM candidates c GROUP BY ALL),
  s AS (SELECT b.tenant_id, b.user_id, {_BATCH.format("b.candidate_id")} AS batch_id, b.candidate_id, b.evidence_id, e.content,
    CASE WHEN b.evidence_id LIKE '%37' THEN 'never said' WHEN b.evidence_id LIKE '%41' THEN substr(e.content, 1, 1500) ELSE substr(e.content, 1, 60) END AS quote
    FROM bad_links b LEFT JOIN evidence e ON e.tenant_id = b.tenant_id AND e.user_id = b.user_id AND e.id = b.evidence_id),
  t AS (SELECT tenant_id, user_id, batch_id, count(*) AS supports, count(*) FILTER (WHERE NOT coalesce(contains(content, quote) AND quote <> '' AND octet_length(encode(quote)) <= 1024, false)) AS ungrounded,
    count(*) FILTER (WHERE content IS NULL) AS missing, count(*) - count(DISTINCT (candidate_id, evidence_id)) AS repeated, count(DISTINCT evidence_id) AS sources FROM s GROUP BY ALL),
  z AS (SELECT tenant_id, user_id, batch_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_bytes FROM (SELECT tenant_id, user_id, batch_id, evidence_id, max(octet_length(encode(content))) AS n FROM s GROUP BY ALL) GROUP BY ALL)
  SELECT p.*, coalesce(supports, 0) AS supports, coalesce(ungrounded, 0) AS ungrounded, coalesce(missing, 0) AS missing, coalesce(repeated, 0) AS repeated, coalesce(sources, 0) AS sources, coalesce(total_bytes, 0) AS total_bytes,
    coalesce(ungrounded, 0) = 0 AND coalesce(repeated, 0) = 0 AND duplicate_identities = 0 AND unsupported = 0 AND candidates <= 10 AND coalesce(sources, 0) <= 20 AND coalesce(total_bytes, 0) <= 65536 AS accepted
  FROM p LEFT JOIN t USING (tenant_id, user_id, batch_id) LEFT JOIN z USING (tenant_id, user_id, batch_id))""")
def grounding_check(spark, d):
    """Batches of candidates with quotes of their sources, some of which are missing, repeated, too long or never said."""
    candidates, links, evidence = frames(spark, d, "candidates", "bad_links", "evidence")
    key = lifecycle.identity_key(*[F.col(c) for c in ("kind", "category", "memory_key", "person", "relationship")])
    proposals = candidates.select(*SCOPE, F.expr(_BATCH.format("id")).alias("batch_id"), F.col("id").alias("candidate_id"), key.alias("identity_key"))
    contents = evidence.select(*SCOPE, F.col("id").alias("evidence_id"), "content")
    quote = F.expr("CASE WHEN evidence_id LIKE '%37' THEN 'never said' WHEN evidence_id LIKE '%41' THEN substr(content, 1, 1500) ELSE substr(content, 1, 60) END")
    supports = links.join(contents, [*SCOPE, "evidence_id"], "left").select(*SCOPE, F.expr(_BATCH.format("candidate_id")).alias("batch_id"), "candidate_id", "evidence_id", quote.alias("quote"))
    return validation.grounding(supports, evidence, proposals)


# --- fences, receipts, replays


@query("""SELECT t.embedding_space, CASE WHEN t.embedding_space = 'space_v1_demo' THEN 'conflict' WHEN n = 2 AND t.embedding_space <> 'space_v1_next' THEN 'conflict' WHEN n = 3 THEN 'inserted' ELSE 'known' END AS verdict, n = 3 AS bumps_generation
  FROM (SELECT embedding_space, 1 AS n FROM targets UNION ALL SELECT embedding_space, 2 FROM targets UNION ALL SELECT embedding_space || '-' || CAST((SELECT count(*) FROM jobs) AS VARCHAR), 3 FROM targets WHERE state <> 'serving') t""")
def space_registry_conflicts(spark, d):
    targets, jobs = frames(spark, d, "targets", "jobs")
    drifted = targets.withColumn("model", F.when(F.col("embedding_space") == "space_v1_next", F.col("model")).otherwise("drifted"))
    n = jobs.agg(F.count("*").cast("string").alias("n"))
    new = targets.where("state <> 'serving'").crossJoin(n).withColumn("embedding_space", F.concat_ws("-", "embedding_space", "n")).drop("n")
    return projection.registry_conflicts(targets, targets.unionByName(drifted).unionByName(new), ["model"])


@query("""SELECT operation_id, CASE WHEN vec_id % 3 = 0 THEN 'promote' WHEN vec_id % 3 = 1 THEN 'replay' ELSE 'conflict' END AS verdict, CASE WHEN vec_id % 3 = 1 THEN vec_id END AS generation
  FROM (SELECT 'op-' || CAST(vec_id AS VARCHAR) AS operation_id, vec_id FROM embeddings)""")
def promotion_receipt(spark, d):
    ids = table(spark, d, "embeddings").select(F.concat(F.lit("op-"), "vec_id").alias("operation_id"), "vec_id")
    shape = [F.lit("a").alias("from_space"), F.lit("b").alias("to_space")]
    receipts = ids.where("vec_id % 3 <> 0").select("operation_id", F.col("vec_id").alias("generation"), *shape, F.lit(False).alias("allow_empty"))
    requests = ids.select("operation_id", *shape, (F.col("vec_id") % 3 == 2).alias("allow_empty"))
    return projection.promotion_verdicts(receipts, requests)


@query("""SELECT c.tenant_id, c.user_id, c.kind AS batch_id, count(*) AS n, count(g.id) AS n_ok, CASE WHEN any_value(r.rev) <> 0 THEN 'stale_revision' WHEN count(*) > count(g.id) THEN 'invalid' ELSE 'accepted' END AS verdict
  FROM candidates c LEFT JOIN (SELECT c.tenant_id, c.user_id, c.id FROM candidates c JOIN (SELECT b.tenant_id, b.user_id, b.candidate_id FROM bad_links b LEFT JOIN evidence e ON e.tenant_id = b.tenant_id AND e.user_id = b.user_id AND e.id = b.evidence_id
    GROUP BY ALL HAVING count(*) = count(DISTINCT b.evidence_id) AND count(*) = count(e.id)) k ON k.tenant_id = c.tenant_id AND k.user_id = c.user_id AND k.candidate_id = c.id) g ON g.tenant_id = c.tenant_id AND g.user_id = c.user_id AND g.id = c.id
  JOIN (SELECT s.*, (SELECT count(*) FROM reviews r WHERE r.decision = 'approve' AND r.tenant_id = s.tenant_id AND r.user_id = s.user_id) + (SELECT count(*) FROM erasures e WHERE e.tenant_id = s.tenant_id AND e.user_id = s.user_id) AS rev FROM scopes s) r
    ON r.tenant_id = c.tenant_id AND r.user_id = c.user_id GROUP BY c.tenant_id, c.user_id, c.kind""")
def candidate_batch(spark, d):
    candidates, links, evidence = frames(spark, d, "candidates", "bad_links", "evidence")
    requests = candidates.select(*SCOPE, F.col("kind").alias("batch_id"), F.lit(0).alias("expected_revision"), "id")
    return lifecycle.candidate_batches(requests, lifecycle.create_candidates(candidates, links, evidence), context_revision(spark, d))


@query("SELECT e.tenant_id, e.user_id, e.id, e.content FROM evidence e WHERE EXISTS (SELECT 1 FROM links k WHERE k.source_order = 0 AND k.tenant_id = e.tenant_id AND k.user_id = e.user_id AND k.evidence_id = e.id)")
def multi_key_lookup(spark, d):
    links, evidence = frames(spark, d, "links", "evidence")
    keys = links.where("source_order = 0").select(*SCOPE, F.col("evidence_id").alias("id"))
    return lifecycle.multi_key_lookup(keys, evidence).select(*SCOPE, "id", "content")


_BUMPS = f"""SELECT tenant_id, user_id, commit_seq FROM reviews WHERE decision = 'approve' UNION ALL SELECT tenant_id, user_id, commit_seq FROM erasures
  UNION ALL SELECT tenant_id, user_id, 200000 + CAST(substr(memory_id, 2) AS BIGINT) FROM ({ORACLES["embedding_upsert_changes"]}) WHERE bumps_revision
  UNION ALL SELECT j.tenant_id, j.user_id, 300000 + j.id FROM ({ORACLES["job_finalize_outcomes"]}) o JOIN jobs j ON j.id = o.id WHERE o.bumps_revision
  UNION ALL SELECT DISTINCT tenant_id, user_id, 200001 FROM ({ORACLES["reconcile_repairs"]}) WHERE bumps_scope UNION ALL SELECT DISTINCT tenant_id, user_id, 400001 FROM live"""


@query(f"SELECT tenant_id, user_id, commit_seq, n_bumps, CAST(sum(n_bumps) OVER (PARTITION BY tenant_id, user_id ORDER BY commit_seq) AS BIGINT) AS context_revision FROM (SELECT tenant_id, user_id, commit_seq, count(*) AS n_bumps FROM ({_BUMPS}) GROUP BY ALL)")
def revision_log(spark, d):
    """The revisions of all scopes by all six kinds of bumps: approvals, erasures, new vectors, finished jobs, a repair and a promotion."""
    reviews, erasures, jobs = frames(spark, d, "reviews", "erasures", "jobs")
    changes = embedding_upsert_changes(spark, d).withColumn("commit_seq", 200000 + F.substring("memory_id", 2, 40).cast("long"))
    finalized = job_finalize_outcomes(spark, d).join(jobs.select("id", *SCOPE), "id").withColumn("commit_seq", 300000 + F.col("id"))
    repairs = reconcile_repairs(spark, d).withColumn("commit_seq", F.lit(200001))
    promotions = projection.promotion(cards(spark, d), covered(spark, d).withColumn("class", F.lit("converged")), *frames(spark, d, "targets"), jobs.agg(F.count("*").alias("generation")), "op-1", "space_v1_next", False, AS_OF_US)
    bumps = lifecycle.revision_bumps(reviews, erasures, changes, finalized, repairs, promotions["bumps"].withColumn("commit_seq", F.lit(400001)))
    return lifecycle.revision_log(bumps)


#: Places in the log of commits that each query is put at.
ASKED_SEQ = [20_000, 50_000, 70_000, 200_000]


@query(f"""SELECT q.query_id || '/' || CAST(seq AS VARCHAR) AS query_id, v.tenant_id, v.user_id, v.id, CAST(v.version AS INT) AS version FROM queries q, (SELECT unnest({ASKED_SEQ}) AS seq) s, card_versions_all v
  WHERE v.tenant_id = q.tenant_id AND v.user_id = q.user_id AND v.commit_seq < seq AND (v.expires_us IS NULL OR v.expires_us > {AS_OF_US})
    AND NOT EXISTS (SELECT 1 FROM card_versions_all n WHERE n.tenant_id = v.tenant_id AND n.user_id = v.user_id AND n.erasure_epoch = v.erasure_epoch AND n.identity_key = v.identity_key AND n.version = v.version + 1 AND n.commit_seq < seq)
    AND NOT EXISTS (SELECT 1 FROM erasures e WHERE e.tenant_id = v.tenant_id AND e.user_id = v.user_id AND e.commit_seq > v.commit_seq AND e.commit_seq < seq)""")
def timeline_queries(spark, d):
    """The cards that each query could see at four places of the log, before and after erasures."""
    queries, erasures = frames(spark, d, "queries", "erasures")
    asked = queries.withColumn("seq", F.explode(F.array(*[F.lit(s) for s in ASKED_SEQ])))
    asked = asked.select(F.concat_ws("/", "query_id", F.col("seq").cast("string")).alias("query_id"), *SCOPE, "seq", F.lit(AS_OF_US).alias("at_us"))
    return lifecycle.replay_queries(asked, versions(spark, d), erasures)


#: Times that the replay is asked about.
ASKED_US = [BASE_US + 40_000_000_000_000 + i for i in (-1, 0, 2, 4, 1_000_000)]


@query(f"""SELECT asked_us, count(*) AS n_active, CAST(sum(version) AS BIGINT) AS versions FROM card_versions_timed, (SELECT unnest({ASKED_US}) AS asked_us)
  WHERE card_created_us <= asked_us AND (superseded_us IS NULL OR superseded_us > asked_us) AND (expires_us IS NULL OR expires_us > asked_us) GROUP BY asked_us""")
def timeline_replay(spark, d):
    asked = versions(spark, d).withColumn("asked_us", F.explode(F.array(*[F.lit(t) for t in ASKED_US])))
    active = lifecycle.as_of(asked, F.col("asked_us"))
    return active.groupBy("asked_us").agg(F.count("*").alias("n_active"), F.sum("version").alias("versions"))


@query("SELECT query_id, sha256(CAST(recall AS DECIMAL(12, 9))::VARCHAR || '|' || CAST(mrr AS DECIMAL(12, 9))::VARCHAR || '|' || CAST(ndcg AS DECIMAL(12, 9))::VARCHAR || '|' || passed::VARCHAR) AS result_sha256 FROM quality")
def eval_result_hash(spark, d):
    fixed = [F.col(c).cast("decimal(12,9)").cast("string") for c in ("recall", "mrr", "ndcg")]
    return eval_quality(spark, d).select("query_id", F.sha2(F.concat_ws("|", *fixed, F.col("passed").cast("string")), 256).alias("result_sha256"))


@query("""SELECT c.id, 'extract_' || substr(sha256(c.tenant_id || '/' || c.user_id), 1, 32) AS extraction_run_id, 'json-schema-v1' AS extraction_protocol, 'verbatim-quote-v1' AS extraction_grounding, CAST(count(k.evidence_id) AS VARCHAR) AS extraction_source_count
  FROM candidates c LEFT JOIN links k ON k.tenant_id = c.tenant_id AND k.user_id = c.user_id AND k.candidate_id = c.id GROUP BY ALL""")
def extraction_candidates(spark, d):
    rows = lifecycle.candidates_with_sources(*frames(spark, d, "candidates", "links"))
    stamp = lifecycle.extraction_metadata(F.concat_ws("/", *SCOPE), "json-schema-v1", "verbatim-quote-v1", F.size("source_event_ids"))
    keys = ("extraction_run_id", "extraction_protocol", "extraction_grounding", "extraction_source_count")
    return rows.select("id", stamp.alias("m")).select("id", *[F.col("m")[k].alias(k) for k in keys])


@query()
def job_log_replay(spark, d):
    """The job machine over the events table: users are jobs, event types its verbs."""
    from recallframe.streaming.ingest import replay_jobs

    verbs = F.create_map(*[F.lit(x) for x in ("view", "enqueue", "signup", "enqueue", "click", "claim", "error", "retry", "purchase", "finish")])
    owner = F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string"))
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), verbs[F.col("event_type")].alias("event"), owner.alias("owner"), (F.col("event_id") * 1_000_000).alias("at_us"))
    return replay_jobs(log)


@query("""SELECT query_id, count(*) FILTER (WHERE fault = 0) AS missing_sources, count(*) FILTER (WHERE fault IN (1, 2)) AS reordered_sources, count(*) FILTER (WHERE fault = 2) + count(*) FILTER (WHERE fault = 5 AND NOT there) AS unknown_source_ids,
    count(*) FILTER (WHERE fault = 5) AS source_scope_violations, count(*) FILTER (WHERE fault = 3) + count(*) FILTER (WHERE fault = 5 AND there) AS evidence_payload_violations
  FROM (SELECT h.query_id, CASE WHEN number % 6 = 1 AND n < 2 THEN 4 ELSE number % 6 END AS fault, EXISTS (SELECT 1 FROM evidence e WHERE e.tenant_id = 'elsewhere' OR (e.tenant_id = CASE WHEN h.tenant_id = 'twin' THEN 'src1' ELSE 'twin' END AND e.user_id = h.user_id AND e.id = s.last)) AS there
    FROM (SELECT b.*, q.tenant_id, q.user_id, CAST(substr(id, 2) AS BIGINT) AS number FROM bm25_deep b JOIN queries q USING (query_id) WHERE rank <= 5) h JOIN cards c ON c.tenant_id = h.tenant_id AND c.user_id = h.user_id AND c.id = h.id
    JOIN (SELECT k.tenant_id, k.user_id, k.candidate_id, count(*) AS n, arg_max(k.evidence_id, k.source_order) AS last FROM links k GROUP BY ALL) s ON s.tenant_id = c.tenant_id AND s.user_id = c.user_id AND s.candidate_id = c.candidate_id) GROUP BY query_id""")
def eval_source_policy(spark, d):
    """Context items whose sources were tampered with, by the card's number: cut, turned round, replaced, rewritten, moved to another tenant's scope, or left alone."""
    queries, links, evidence = frames(spark, d, "queries", "links", "evidence")
    c = cards(spark, d)
    items = context.context_items(retrieval.bm25(queries, c, LIMIT, AS_OF_US), queries, c, links, evidence)
    make = lambda tenant, i, content: F.struct(tenant.alias("tenant_id"), F.col("user_id"), i.alias("id"), content.alias("content"))
    own = F.col("tenant_id")
    rows = items.withColumn("plain", F.transform("sources", lambda s: make(own, s["evidence_id"], s["content"])))
    number = F.substring("id", 2, 40).cast("long") % 6
    last = F.element_at("plain", -1)
    but_last = F.slice("plain", 1, F.size("plain") - 1)
    other = F.when(own == "twin", "src1").otherwise("twin")
    ends = {2: make(own, F.lit("nowhere"), last["content"]), 3: make(own, last["id"], F.concat(last["content"], F.lit("!"))), 5: make(other, last["id"], last["content"])}
    tampered = F.when(number == 0, but_last).when(number == 1, F.reverse("plain"))
    for fault, end in ends.items():
        tampered = tampered.when(number == fault, F.concat(but_last, F.array(end)))
    return evaluation.source_policy(rows.select("query_id", *SCOPE, "id", "candidate_id", tampered.otherwise(F.col("plain")).alias("sources")), links, evidence)
