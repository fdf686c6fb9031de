"""Queries over the whole of their inputs, compared with their SQL on rows that differ late."""

import duckdb
import pytest

from sieveline.plans import catalogue


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("whole"))
    long = "plain words " * 40
    documents = [(i, f"{long}{'fake stocks' if i % 2 else 'end'} {i}", "en", f"src{i % 3}", 500) for i in range(120)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, int(i % 10 == 0)) for i in range(0, 120, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def both(spark, folder, name):
    """Rows of the query, compared with those of its SQL."""
    con = duckdb.connect()
    for table in ("documents", "labels", "conversations", "embeddings"):
        if duckdb.execute(f"SELECT count(*) FROM glob('{folder}/{table}.parquet/*.parquet')").fetchone()[0]:
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = [tuple(r) for r in catalogue.QUERIES[name](spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(con.execute(catalogue.ORACLE_SQL[name]).fetchall(), key=repr)
    return got


def test_cells_keep_whole_texts(spark, tables):
    cells = dict(both(spark, tables, "guarded_cells"))
    assert all(cell.endswith(f" {i}") and cell.startswith("'") == (i % 3 < 2) for i, cell in cells.items()) and len(cells) == 120


def test_inputs_conflict_by_their_last_characters(spark, tables):
    conflicts = both(spark, tables, "input_conflicts")
    assert sum("ambiguous" in reasons for _, reasons, _ in conflicts) == 3  # 0, 52 and 104, of 0, 26, .. 104
    assert both(spark, tables, "selected_inputs")


def test_audit_reads_whole_texts(spark, tables):
    counts = {tuple(r)[0]: tuple(r)[1:] for r in catalogue.QUERIES["audit_issues"](spark, tables).collect()}
    assert "possible_label_marker_in_ocr" in counts, counts


def test_turns_are_read_to_their_ends(spark, tables):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", None if (c, t) == (1, 2) else "" if (c, t) == (2, 0) else f"turn {t} " * (30 + c)) for c in range(3) for t in range(9)]
    spark.createDataFrame([*turns, (7, 0, " ", "")], "conv_id long, turn long, role string, text string").write.parquet(f"{tables}/conversations.parquet")
    texts = {(c, t): x for c, t, x in both(spark, tables, "assemble_text")}
    assert max(map(len, texts.values())) > 200
    found = both(spark, tables, "segment_overlap")
    assert max(end for c, _, _, _, end in found if c == 0) == 9.0  # the last turn is met


def test_signatures_take_all_components(spark, tables):
    base = [1.0 if i % 3 else -1.0 for i in range(64)]
    half = base[:32] + [-x for x in base[32:]]
    near = [-base[0], *base[1:40], -base[40], *base[41:63], -base[63]]
    top = [-base[0], *base[1:]]
    spark.createDataFrame(list(enumerate([base, half, near, base, top])), "vec_id long, embedding array<float>").write.parquet(f"{tables}/embeddings.parquet")
    assert set(both(spark, tables, "signature_pairs")) == {(0, 2, 3), (0, 3, 0), (0, 4, 1), (2, 3, 3), (2, 4, 2), (3, 4, 1)}
