from llm.conftest import ODD_TEXTS, with_clashes
from oracle import differing

from tramline.llm import line_dedup

LINE = "This line is shared by many documents, and long enough."


def test_query_matches_its_sql(spark, folder):
    assert differing(line_dedup.op3_line_dedup(spark, folder), line_dedup.OP3_SQL, folder) == ([], [])


def test_edge_cases(spark):
    rows = [(i, f"{LINE}\nown {i}") for i in range(1, 6)] + [(6, f" {LINE.upper()}\t\n{LINE}\r"), (None, LINE), (7, None), (8, "short"), (9, "\n"), *((20 + i, t) for i, t in enumerate(ODD_TEXTS))]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).withColumnRenamed("n", "n_lines")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in out.collect()}
    assert all(got[i] == (f"own {i}", 2, 1) for i in range(1, 6))
    assert got[6] == (f" {LINE.upper()}\t\n{LINE}\r", 2, 0)  # the largest id keeps all its lines
    assert got[None] == (LINE, 1, 0) and got[7] == ("", 1, 0) and got[9] == ("\n", 2, 0)
    assert all(got[20 + i][0] == (t or "") for i, t in enumerate(ODD_TEXTS))
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_four_documents_and_repeated_rows_are_not_enough(spark):
    rows = [(i, LINE) for i in (1, 2, 3, 4, 4, 4)]
    assert {r.n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}
