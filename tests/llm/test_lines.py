import time

import duckdb
import pytest

from recallframe.llm import lines, queries

SF = "/root/testdata/sf0.001"


def oracle(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(con.execute(lines.ORACLE).fetchall(), key=str)


def test_op3_against_sql(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op3_lines(spark, SF).collect()), key=str)
    assert got == oracle(docs) and any(r[2] for r in got)


@pytest.fixture
def rows():
    note = "Contact us right here {} for details about this very long notice today please"
    rows = [(i, f"own line number {chr(97 + i)} {'x' * i}\n{note.format('n' * (i + 1))}\n\nYes no\nRead on page {i} of 90") for i in range(8)]
    rows += [(None, "All rights reserved."), (None, "more here now"), (2, "All rights reserved.\nmore here now"), (3, "All rights reserved."), (3, "All rights reserved.")]
    return rows + [(20, None), (21, ""), (21, ""), (22, "long " * 50_000), (23, "tab\tand\x0bgap line"), (24, "\n\n")]


def test_templates_and_odd_rows(spark, rows):
    df = spark.createDataFrame([(*r, "z", 5) for r in rows], "doc_id long, text string, places string, n_dropped int")
    out = lines.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "places", "n_dropped"]
    got = sorted(((r.doc_id, r.text, r.n_dropped) for r in out.collect()), key=str)
    assert got == oracle(rows) and len(got) == len(rows)
    by = {(r[0], r[2]): r[1] for r in got}
    assert by[0, 0] == rows[0][1] and "Contact" not in by[5, 3] and "Yes no" not in by[5, 3] and "page" not in by[5, 3] and "own" in by[5, 3]
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plan = lines.dedup_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_wildcards_long_lines_and_short_ones(spark):
    """Fields that vary within the leading words, passages of 50 words in two documents, lines in scripts without spaces, rules."""
    passage = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50))
    rows = [(i, f"Dear {'n' * (i + 1)} your order has been sent out today\n----\n東京は日本の首都です\n}}\nbody {chr(97 + i) * 5} of {chr(107 + i) * 4}") for i in range(5)]
    more = " ".join(f"m{i}x" for i in range(30))
    rows += [(10, f"first\n{passage}"), (11, f"second {more}\n{passage}"), (12, passage[:-4] + "\nthird"), (15, f"one\n{passage.upper()}"), (16, f"one\n{passage.upper()}\nsmall"), (13, "alone\n" + passage[:60]), (14, "else\n" + passage[:60])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in lines.dedup_lines(df).collect()), key=str)
    assert got == oracle(rows)
    by = {r[0]: r[1] for r in got}
    assert by[0] == rows[0][1] and by[3] == "----\n}\nbody ddddd of nnnn"
    assert by[10] == rows[5][1] and by[11] == f"second {more}" and by[12] == rows[7][1] and by[14] == next(t for i, t in rows if i == 14)
    assert by[16] == "one\nsmall"  # whatever share of a text its repeats are


def test_fields_with_repeated_values(spark):
    """A template's field takes each value once, twice or thrice, in the leading words, behind them, or in both."""
    for times in (1, 2, 3):
        for line in ("Dear {} your order number has been sent out today by our own staff", "Your order and {} has been sent out today by our own staff there", "Dear {} your order and {} has been sent out today by our own staff then"):
            value = lambda i: "abcdefghijkl"[i // times] * 3
            rows = [(i, line.format(*[value(i)] * line.count("{}"))) for i in range(12)]
            got = sorted((tuple(r) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
            assert got == oracle(rows)
            # a value of three documents leads to a template of its own
            assert sum(r[2] for r in got) == 12 - (4 if times == 3 else 1)


def test_share_of_repeats_makes_no_difference(spark):
    passage = ["\n".join(" ".join(f"w{n}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)) for n in range(4))]
    for tail in (5, 45, 70):
        rows = [(0, passage[0]), (1, passage[0] + "\n" + " ".join(f"t{i}" for i in range(tail)))]
        got = {r.doc_id: r.n_dropped for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {0: 0, 1: 4}


def test_many_lines_take_linear_time(spark):
    """Three documents of 100,000 lines each, all alike but for one line."""
    body = "\n".join(f"line {'abcdefghij'[i % 10]} {chr(97 + i // 10 % 26)}{chr(97 + i // 260 % 26)}{chr(97 + i // 6760 % 26)} here" for i in range(100_000))
    rows = [(i, f"{body}\nown {chr(120 + i)}") for i in range(3)]
    began = time.monotonic()
    got = {r.doc_id: (r.text, r.n_dropped) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.monotonic() - began < 60
    assert got == {0: (rows[0][1], 0), 1: ("own y", 100_000), 2: ("own z", 100_000)}
