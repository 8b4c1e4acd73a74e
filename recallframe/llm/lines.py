"""Line dedup by a tree of log templates, in DataFrame functions only.

A line's digits are masked and its words parsed down a tree of fixed depth: the
number of words, then the leading words. Where these lead to a leaf of fewer than
``min_docs`` documents, they are variable: all four levels turn into wildcards, and
the next four words lead instead. In a leaf, a word is fixed at its place if the
lines that have it there come from ``min_docs`` documents or more (summed over
different lines), else it is a variable field. A line whose fixed words make up
``fixed_share`` of it belongs to the template of its fixed words and their
places; a template that ``min_docs`` documents share recurs, and its lines are
dropped everywhere but in the first document that has it. A line of
``long_words`` words or more recurs as soon as two documents have it as it is.

Hot lines cost nothing special: leaves, lines and templates are summed before
they are shuffled, and what goes back to the rows goes by joins that split. The
text moves twice, next to the narrow lists of its candidate and dropped lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallframe.llm.text import WORD_GAP
from recallframe.session import scratch, stored, without

#: Words of a leaf's path, groups of words that may lead, least documents of a template, least share of fixed words, words from which two documents suffice.
DEPTH, LEVELS, MIN_DOCS, FIXED_SHARE, LONG_WORDS = 4, 3, 3, 0.8, 50
#: A line without such a character (rules, brackets, blank lines) is never dropped.
SPEAKING = r"[\p{L}\p{N}]"


def words_of(line: Column) -> Column:
    """The words of a line with runs of digits masked."""
    return F.array_remove(F.split(F.regexp_replace(line, "[0-9]+", "0"), WORD_GAP), "")


def _leaf(words: Column, level: int) -> Column:
    """The leaf of a line's words behind ``level`` groups of wildcards, for lines that have words there."""
    return F.when(F.size(words) > DEPTH * level, F.xxhash64(F.size(words), F.lit(level), F.slice(words, DEPTH * level + 1, DEPTH)))


def _keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``docs`` with what tells rows apart: __d, the id, and __k, a hash of id and text. Equal rows are treated alike."""
    return docs.withColumn("__d", F.col(doc)).withColumn("__k", F.xxhash64(doc, text))


def _positions(rows: DataFrame) -> DataFrame:
    """Per row the sorted places of its lines; a place list is at most as long as its text has lines."""
    return rows.groupBy("__d", "__k").agg(F.sort_array(F.collect_set("pos")).alias("__places"))


def _to_rows(rows: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Joins place lists to their rows; the lists, not the texts, are the side that is held."""
    held = places.select(F.col("__d").alias("__pd"), F.col("__k").alias("__pk"), "__places").hint("shuffle_hash")
    return rows.join(held, (F.col("__k") == F.col("__pk")) & F.col("__d").eqNullSafe(F.col("__pd")), how)


def _split(rows: DataFrame, text: Column, out: str) -> DataFrame:
    """``rows`` with the lines of ``text`` as array ``out``. A generator splits once for each row, whatever looks into the array later."""
    return rows.select("*", F.explode(F.array(F.split(text, "\n"))).alias(out))


def _recurring(leaves: DataFrame, leaf: str, min_docs: int) -> DataFrame:
    """The leaves of ``min_docs`` documents or more."""
    again = leaves.select(leaf, "__k").distinct().groupBy(F.col(leaf).alias("__leaf")).agg(F.count("*").alias("docs"))
    # read back, it has no partitioning of its own, and Spark can split the join where a leaf holds many lines
    return stored(again.where(F.col("docs") >= min_docs).select("__leaf"))


def candidates(docs: DataFrame, doc: str, text: str, min_docs: int = MIN_DOCS, long_words: int = LONG_WORDS) -> DataFrame:
    """(__d, __k, pos, leaf, masked, line, exact, long) of the lines whose leaf occurs in ``min_docs`` documents or more, or behind wildcards in two.

    ``line`` is a hash of the leaf and the masked line, ``exact`` one of the line as it is.
    """
    rows = _keyed(docs, doc, text).select("__d", "__k", F.col(text).alias("__text"))
    lines = rows.select("__d", "__k", F.posexplode(F.split("__text", "\n")).alias("pos", "line")).where(F.col("line").rlike(SPEAKING))
    lines = lines.select("__d", "__k", "pos", F.explode(F.array(words_of(F.col("line")))).alias("words"))  # taken apart once, as in _split
    levels = [f"leaf{i}" for i in range(LEVELS)]
    left = stored(lines.where(F.size("words") > 0).select("__d", "__k", "pos", *[_leaf(F.col("words"), i).alias(c) for i, c in enumerate(levels)]))
    kept = None
    for i, c in enumerate(levels):
        shared = _recurring(left.where(F.col(c).isNotNull()), c, min_docs if i + 1 < LEVELS else 2)
        part = left.join(shared, F.col(c) == F.col("__leaf")).select("__d", "__k", "pos", F.col(c).alias("leaf"))
        kept = part if kept is None else kept.unionByName(part)
        if i + 1 < LEVELS:
            others = left.where(F.col(levels[i + 1]).isNotNull()).join(shared, F.col(c) == F.col("__leaf"), "left_anti")
            left = stored(others.select("__d", "__k", "pos", *levels[i + 1 :]))
    places = kept.groupBy("__d", "__k").agg(F.sort_array(F.collect_set(F.struct("pos", "leaf"))).alias("__places"))
    found = _split(_to_rows(rows, places, "inner"), F.col("__text"), "all").select("__d", "__k", "all", F.explode("__places").alias("place"))
    each = found.select("__d", "__k", "place.pos", "place.leaf", F.element_at("all", F.col("place.pos") + 1).alias("own"))
    words = F.col("words")
    masked = each.select("*", F.explode(F.array(words_of(F.col("own")))).alias("words")).select(
        "__d", "__k", "pos", "leaf", F.array_join(words, " ").alias("masked"), F.xxhash64("own").alias("exact"), (F.size(words) >= long_words).alias("long")
    )
    return masked.withColumn("line", F.xxhash64("leaf", "masked"))


def templates(found: DataFrame, min_docs: int = MIN_DOCS, fixed_share: float = FIXED_SHARE) -> DataFrame:
    """(line, template) of every different candidate line that has enough fixed words."""
    different = found.select("__d", "__k", "line").distinct().groupBy("line").agg(F.count("*").alias("docs"))
    spelled = found.groupBy("line").agg(F.min("masked").alias("masked"), F.min("leaf").alias("leaf")).join(different, "line")
    fields = spelled.select("line", "leaf", "docs", F.posexplode(F.split("masked", " ")).alias("place", "word")).select("line", "docs", F.xxhash64("leaf", "place", "word").alias("field"))
    common = fields.groupBy("field").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).select("field", F.lit(True).alias("fixed"))
    judged = fields.select("line", "field").join(common, "field", "left")
    # a field's hash holds leaf and place, so the sorted fixed fields are the template
    lines = judged.groupBy("line").agg(F.count("*").alias("n"), F.count("fixed").alias("n_fixed"), F.sort_array(F.collect_list(F.when(F.col("fixed"), F.col("field")))).alias("fields"))
    return lines.where(F.col("n_fixed") >= F.col("n") * fixed_share).select("line", F.xxhash64("fields").alias("template"))


def _later(parsed: DataFrame, kind: str, min_docs: int) -> DataFrame:
    """The rows of ``parsed`` whose ``kind`` is found in ``min_docs`` documents or more, less those of the first one."""
    shared = parsed.select(kind, "__d", "__k").distinct().groupBy(F.col(kind).alias("__kind")).agg(F.count("*").alias("docs"), F.min(F.struct("__d", "__k")).alias("first"))
    recurring = stored(shared.where(F.col("docs") >= min_docs).select("__kind", "first"))
    return parsed.join(recurring, F.col(kind) == F.col("__kind")).where(F.struct("__d", "__k") != F.col("first")).select(*parsed.columns)


def dropped(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, fixed_share: float = FIXED_SHARE, long_words: int = LONG_WORDS) -> DataFrame:
    """(__d, __k, __places) of the lines to drop."""
    found = stored(candidates(docs, doc, text, min_docs, long_words))
    lines = stored(templates(found, min_docs, fixed_share))
    alike = _later(found.join(lines, "line").select("template", "__d", "__k", "pos"), "template", min_docs)
    equal = _later(found.where("long").select("exact", "__d", "__k", "pos"), "exact", 2)
    return alike.select("__d", "__k", "pos").unionByName(equal.select("__d", "__k", "pos")).groupBy("__d", "__k").agg(F.sort_array(F.collect_set("pos")).alias("__places"))


def dedup_lines(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, fixed_share: float = FIXED_SHARE, long_words: int = LONG_WORDS
) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and n_dropped (long).

    All rows stay. A null text stays null, a text that loses all lines becomes
    empty, one that loses none stays as it is to the byte. Documents are told
    apart by id and text: repeats of one row count as one document, rows that
    share an id (or have none) but differ in text as several; the first is that
    with the smallest id, nulls first (of one id, any fixed one). Lines without
    a letter or digit are never dropped. An input column n_dropped is replaced;
    others stay.
    """
    kept = without(docs, "n_dropped")
    with scratch(docs.sparkSession):
        places = stored(dropped(docs, doc, text, min_docs, fixed_share, long_words), keep=True)
    joined = _to_rows(_keyed(kept, doc, text), places, "left")
    some = F.col("__places").isNotNull()
    cut_up = _split(joined, F.when(some, F.col(text)), "__all")
    stay = F.array_except(F.sequence(F.lit(0), F.size("__all") - 1), F.col("__places"))
    left = F.array_join(F.transform(stay, lambda i: F.element_at("__all", i + 1)), "\n")
    cleaned = F.when(some, left).otherwise(F.col(text))
    count = F.when(some, F.size("__places")).otherwise(0).cast("long").alias("n_dropped")
    return cut_up.select(*[cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in kept.columns], count)


#: The same in DuckDB, over view documents; lines, words and templates stay spelled out.
ORACLE = rf"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS r FROM docs),
lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM numbered
), parsed AS (
  SELECT r, pos, line, list_filter(regexp_split_to_array(regexp_replace(line, '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM lines WHERE regexp_matches(line, '{SPEAKING}')
), leaved AS (
  SELECT *, len(words) AS n, words[1:{DEPTH}] AS lead, words[{DEPTH + 1}:{2 * DEPTH}] AS later, words[{2 * DEPTH + 1}:{3 * DEPTH}] AS latest FROM parsed WHERE len(words) > 0
), own AS (
  SELECT n, lead FROM leaved GROUP BY n, lead HAVING count(DISTINCT r) >= {MIN_DOCS}
), others AS (
  SELECT l.* FROM leaved l ANTI JOIN own USING (n, lead) WHERE n > {DEPTH}
), wild AS (
  SELECT n, later FROM others GROUP BY n, later HAVING count(DISTINCT r) >= {MIN_DOCS}
), rest AS (
  SELECT l.* FROM others l ANTI JOIN wild USING (n, later) WHERE n > {2 * DEPTH}
), wilder AS (
  SELECT n, latest FROM rest GROUP BY n, latest HAVING count(DISTINCT r) > 1
), found AS (
  SELECT r, pos, line, words, n, lead AS leaf, 0 AS wild FROM leaved JOIN own USING (n, lead)
  UNION ALL SELECT r, pos, line, words, n, later, 1 FROM others JOIN wild USING (n, later)
  UNION ALL SELECT r, pos, line, words, n, latest, 2 FROM rest JOIN wilder USING (n, latest)
), different AS (
  SELECT words, n, leaf, wild, count(DISTINCT r) AS docs FROM found GROUP BY ALL
), fields AS (
  SELECT words, n, leaf, wild, docs, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM different
), judged AS (
  SELECT *, sum(docs) OVER (PARTITION BY n, leaf, wild, place, word) >= {MIN_DOCS} AS fixed FROM fields
), templated AS (
  SELECT words, leaf, wild, list((place, word) ORDER BY place) FILTER (WHERE fixed) AS template, any_value(n) AS n
  FROM judged GROUP BY words, leaf, wild HAVING count(*) FILTER (WHERE fixed) >= any_value(n) * {FIXED_SHARE}
), recurring AS (
  SELECT n, leaf, wild, template, min(r) AS first FROM found JOIN templated USING (words, n, leaf, wild) GROUP BY n, leaf, wild, template HAVING count(DISTINCT r) >= {MIN_DOCS}
), exact AS (
  SELECT line, min(r) AS first FROM found GROUP BY line HAVING count(DISTINCT r) > 1
), equal AS (
  SELECT r, pos, n, line FROM found JOIN exact USING (line) WHERE r <> first
), gone AS (
  SELECT r, list(DISTINCT pos) AS places FROM (
    SELECT r, pos FROM found JOIN templated USING (words, n, leaf, wild) JOIN recurring USING (n, leaf, wild, template) WHERE r <> first
    UNION ALL SELECT r, pos FROM equal WHERE n >= {LONG_WORDS}
  ) GROUP BY r
), cleaned AS (
  SELECT doc_id, text AS old, CASE WHEN places IS NULL THEN text ELSE array_to_string(
      list_transform(list_filter(list_zip(string_split(text, chr(10)), generate_series(1, len(string_split(text, chr(10))))), lambda x: NOT list_contains(places, x[2])), lambda x: x[1]), chr(10)) END AS text,
    coalesce(len(places), 0) AS n_dropped
  FROM numbered LEFT JOIN gone USING (r)
)
SELECT d.doc_id, c.text, CAST(c.n_dropped AS BIGINT) AS n_dropped
FROM documents d JOIN cleaned c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.text IS NOT DISTINCT FROM c.old
"""
