"""The driver tables seen as domain frames, in SQL that Spark and DuckDB both run.

The mapping is this repository's own choice: scopes are (source, lang), cards
come from documents, reviews from labels, jobs from embeddings. Times are
microseconds since the epoch.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from recallframe.operators.projection import ERROR_CODES

BASE_US = 1_700_000_000_000_000
AS_OF_US = BASE_US + 50_000_000_000_000
RAW = ["region", "documents", "labels", "benchmark", "embeddings", "conversations", "events"]
SPACE = "space_v1_demo"

_QUOTE = "'\"' || replace(replace(replace(replace(replace({0}, '{b}', '{b}{b}'), '\"', '{b}\"'), chr(10), '{b}n'), chr(13), '{b}r'), chr(9), '{b}t') || '\"'"

_CODES = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(ERROR_CODES))

#: Frames in order; later ones may use earlier ones. {sha:x} is the hex SHA-256 of x.
FRAMES: dict[str, str] = {
    # every fourth document is also in a scope of another tenant, under the same ids and with another text
    "rows": """
        SELECT source AS tenant_id, lang AS user_id, doc_id, text FROM documents
        UNION ALL SELECT 'twin', lang, doc_id, 'twin of ' || text FROM documents WHERE doc_id % 4 = 1""",
    "scopes": "SELECT DISTINCT tenant_id, user_id FROM rows",
    "evidence": f"""
        SELECT tenant_id, user_id, 'e' || CAST(doc_id AS STRING) AS id, 's' || CAST(doc_id % 97 AS STRING) AS session_id,
          CASE doc_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'agent' ELSE 'tool' END AS actor, text AS content, {BASE_US} + doc_id * 1000000 AS occurred_us
        FROM rows""",
    "evidence_log": """
        SELECT tenant_id, user_id, id, content, occurred_us AS seq FROM evidence
        UNION ALL SELECT tenant_id, user_id, id, 'again', occurred_us + 500 FROM evidence WHERE occurred_us % 3000000 = 0""",
    "stored_evidence": "SELECT * FROM evidence WHERE occurred_us % 5000000 = 0",
    "candidates": f"""
        SELECT tenant_id, user_id, 'c' || CAST(doc_id AS STRING) AS id, CASE doc_id % 2 WHEN 0 THEN 'preference' ELSE 'Fact ' END AS kind, user_id AS category,
          'topic ' || CAST(doc_id % 4 AS STRING) AS memory_key, text AS value, CASE WHEN doc_id % 11 = 0 THEN 'Ann' ELSE '' END AS person,
          CASE WHEN doc_id % 11 = 0 THEN 'friend' ELSE '' END AS relationship, CASE WHEN doc_id % 6 = 0 THEN 'told in ' || tenant_id ELSE '' END AS backstory,
          {BASE_US} + doc_id * 1000000 + 500000 AS created_us, CASE WHEN doc_id % 7 = 0 THEN {AS_OF_US} + (doc_id % 3) - 1 END AS expires_us
        FROM rows""",
    "links": """
        SELECT tenant_id, user_id, 'c' || CAST(doc_id AS STRING) AS candidate_id, 'e' || CAST(doc_id AS STRING) AS evidence_id, 1 AS source_order
        FROM rows a WHERE doc_id % 13 <> 0 AND (tenant_id <> 'twin' OR doc_id % 3 <> 0)
        UNION ALL
        SELECT tenant_id, user_id, 'c' || CAST(doc_id AS STRING), 'e' || CAST(before AS STRING), 0
        FROM (SELECT tenant_id, user_id, doc_id, lag(doc_id) OVER (PARTITION BY tenant_id, user_id ORDER BY doc_id) AS before FROM rows) b
        WHERE before IS NOT NULL AND doc_id % 2 = 0""",
    "bad_links": """
        SELECT * FROM links
        UNION ALL SELECT tenant_id, user_id, candidate_id, 'missing', 9 FROM links WHERE evidence_id LIKE '%7' AND source_order = 1
        UNION ALL SELECT tenant_id, user_id, candidate_id, evidence_id, 8 FROM links WHERE evidence_id LIKE '%4' AND source_order = 1""",
    "reviews": f"""
        SELECT tenant_id, user_id, 'c' || CAST(d.doc_id AS STRING) AS candidate_id, CASE quality WHEN 1 THEN 'approve' ELSE 'reject' END AS decision,
          {BASE_US} + 40000000000000 + d.doc_id % 5 AS reviewed_us, d.doc_id * 7919 % 100003 AS commit_seq
        FROM rows d JOIN labels l ON d.doc_id = l.doc_id""",
    "erasures": "SELECT tenant_id, user_id, CAST(50000 AS BIGINT) AS commit_seq FROM scopes WHERE tenant_id = 'src3' OR (tenant_id = 'src0' AND user_id = 'fr') OR (tenant_id = 'twin' AND user_id = 'es')",
    "queries": """
        SELECT 'q' || CAST(item_id AS STRING) AS query_id, CASE WHEN item_id % 7 = 3 THEN 'twin' ELSE 'src' || CAST(item_id % 20 AS STRING) END AS tenant_id,
          CASE WHEN item_id % 5 = 1 THEN 'fr' WHEN item_id % 5 = 2 THEN 'de' WHEN item_id % 5 = 3 THEN 'es' ELSE 'en' END AS user_id, text
        FROM benchmark""",
    "vector_queries": """
        SELECT 'v' || CAST(vec_id AS STRING) AS query_id, source AS tenant_id, lang AS user_id, embedding AS vector
        FROM embeddings JOIN documents ON vec_id = doc_id""",
    "hybrid_queries": """
        SELECT 'h' || CAST(vec_id AS STRING) AS query_id, source AS tenant_id, lang AS user_id, text, embedding AS vector
        FROM embeddings JOIN documents ON vec_id = doc_id""",
    "targets": f"""
        SELECT CASE r_regionkey WHEN 0 THEN '{SPACE}' WHEN 1 THEN 'space_v1_next' WHEN 2 THEN 'space_v1_held' ELSE 'space_v1_gone' || CAST(r_regionkey AS STRING) END AS embedding_space,
          CASE r_regionkey WHEN 0 THEN 'serving' WHEN 1 THEN 'shadow' WHEN 2 THEN 'blocked' ELSE 'retired' END AS state, r_regionkey < 2 AS enqueue_new, {BASE_US} + r_regionkey * 5 AS updated_us, 'model-' || lower(r_name) AS model
        FROM region""",
    "jobs": f"""
        SELECT source AS tenant_id, lang AS user_id, 'm' || CAST(vec_id AS STRING) AS memory_id, '{SPACE}' AS embedding_space,
          CASE WHEN label = 8 THEN 2 ELSE 1 END AS expected_memory_version,
          CASE label WHEN 3 THEN 'pending' WHEN 4 THEN 'leased' WHEN 5 THEN 'retry' WHEN 6 THEN 'dead' WHEN 7 THEN 'cancelled' ELSE 'succeeded' END AS state,
          CAST(vec_id % 7 AS INT) AS attempt_count, {AS_OF_US} + (vec_id % 9 - 5) * 1000000 AS available_us, {BASE_US} + vec_id * 10 AS created_us,
          CASE WHEN label = 4 THEN {AS_OF_US} + (vec_id % 5 - 2) * 1000000 END AS lease_until_us, CASE WHEN label = 4 THEN 'w' || CAST(vec_id % 3 AS STRING) END AS lease_owner,
          CAST(CASE WHEN label = 4 THEN vec_id % 4 + 1 ELSE 0 END AS BIGINT) AS lease_version, CASE WHEN label IN (4, 5, 6) THEN CASE vec_id % 11 {_CODES} END END AS last_error_code, vec_id AS id
        FROM embeddings JOIN documents ON vec_id = doc_id WHERE label <> 9""",
    "vectors": f"""
        SELECT source AS tenant_id, lang AS user_id, 'm' || CAST(vec_id AS STRING) AS memory_id, '{SPACE}' AS embedding_space, embedding,
          CASE WHEN vec_id % 11 = 0 THEN {{sha:'stale'}} ELSE {{sha:vec_id}} END AS content_sha256
        FROM embeddings JOIN documents ON vec_id = doc_id WHERE vec_id % 17 <> 3""",
    "expected_hashes": """
        SELECT tenant_id, user_id, 'm' || CAST(doc_id AS STRING) AS memory_id, {sha:doc_id} AS expected_sha256 FROM rows""",
    "relevance": """
        SELECT 'q' || CAST(item_id AS STRING) AS query_id, 'c' || CAST(doc_id AS STRING) AS candidate_id, CAST(1 + doc_id % 3 AS INT) AS relevance
        FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)""",
}


def _dialect(sql: str, duck: bool) -> str:
    form = "sha256(CAST({0} AS STRING))" if duck else "sha2(CAST({0} AS STRING), 256)"
    return re.sub(r"\{sha:([^}]*)\}", lambda m: form.format(m[1]), sql)


def _needed(names: list[str]) -> list[str]:
    """The frames that these need, themselves included, in order."""
    wanted: set[str] = set()

    def visit(name: str) -> None:
        if name in FRAMES and name not in wanted:
            wanted.add(name)
            for other in FRAMES:
                if other != name and re.search(rf"\b{other}\b", FRAMES[name]):
                    visit(other)

    for n in names:
        visit(n)
    return [n for n in FRAMES if n in wanted]


def frames(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named frames over the tables of ``sf_dir``."""
    out = []
    for name in names:
        chain = _needed([name])
        raw = [r for r in RAW if any(re.search(rf"\b{r}\b", FRAMES[c]) for c in chain)]
        parts = [f"{r} AS (SELECT * FROM parquet.`{sf_dir}/{r}.parquet`)" for r in raw]
        parts += [f"{c} AS ({_dialect(FRAMES[c], duck=False)})" for c in chain]
        out.append(spark.sql(f"WITH {', '.join(parts)} SELECT * FROM {name}"))
    return out


def oracle(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` for DuckDB, with the frames and the ``extra`` expressions that it uses put before it."""
    extra = extra or {}
    used, texts = [], [sql]
    for name in reversed(extra):
        if any(re.search(rf"\b{name}\b", t) for t in texts):
            used.insert(0, name)
            texts.append(extra[name])
    chain = _needed([f for f in FRAMES if any(re.search(rf"\b{f}\b", t) for t in texts)])
    parts = [f"{c} AS ({_dialect(FRAMES[c], duck=True)})" for c in chain] + [f"{n} AS ({_dialect(extra[n], duck=True)})" for n in used]
    return f"WITH {', '.join(parts)} {_dialect(sql, duck=True)}" if parts else sql
