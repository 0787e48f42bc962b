"""Every registered query of the reference's operators: against DuckDB where there is SQL, else it must give rows."""

import pytest
from comparing import same_rows

from quarrymill import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, data, duck):
    df = catalog.QUERIES[name](spark, data)
    if name in catalog.ORACLE_SQL:
        ours, theirs = same_rows(df, duck, catalog.ORACLE_SQL[name])
        assert ours == theirs
    else:
        assert df.limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_nothing_imports_the_corpus_operators():
    import pathlib

    root = pathlib.Path(catalog.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()


def test_windows_around_every_frame(spark, data, duck):
    by_user = {}
    for user, n in duck.execute("select user_id, count(*) from events group by 1").fetchall():
        by_user[user] = range(1, n + 1)
    want = {(u, c, k, min(f, key=lambda x: (abs(x - c - o), x))) for u, f in by_user.items() for c in f for k, o in enumerate((-25, -12, 0, 12, 25))}
    got = catalog.QUERIES["five_point_windows_all"](spark, data).collect()
    assert len(got) == len(want) and {(r.user_id, r.centre, r.position, r.frame) for r in got} == want


def test_whole_inputs(spark, data, duck, tmp_path):
    q = catalog.QUERIES
    assert q["synthetic_frames"](spark, data).select("frame").distinct().count() == 30_000
    spark.range(1, 5201).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    placed = [r.s_suppkey for r in q["flow_assign"](spark, str(tmp_path)).collect()]
    assert len(set(placed)) == len(placed) == 30 and max(placed) > 60
    lines = duck.execute("select l_orderkey, l_linenumber from lineitem").fetchall()
    shared = q["track_similarity_all"](spark, data).groupBy().sum("shared").first()[0]
    assert shared == sum(lines.count((order, 2)) for order, k in lines if k == 1)


def test_searches_with_every_query_over_all_rows(spark, data, duck, monkeypatch, tmp_path):
    import numpy as np

    from quarrymill.operators import retrieval as R
    from quarrymill.plans import search

    monkeypatch.setattr(R, "BLOCK_ROWS", 60)
    (tmp_path / "documents.parquet").symlink_to(f"{data}/documents.parquet")
    spark.read.parquet(f"{data}/embeddings.parquet").where("vec_id < 100").write.parquet(f"{tmp_path}/embeddings.parquet")
    vectors = {k: np.array(v, float) for k, v in duck.execute("select vec_id, embedding from embeddings where vec_id < 100").fetchall()}
    queries = [k for k in vectors if k % 20 == 0]
    lang = dict(duck.execute("select doc_id, lang from documents").fetchall())
    words = {r.doc_id: r.bm25 for r in R.bm25(spark.read.parquet(f"{data}/documents.parquet"), search.TERMS).collect()}
    assert set(words) - set(vectors)
    top = max(words.values())

    def blend(d, q):
        return 0.35 * words[d] / top + (0.65 * min(1, max(0, (vectors[d] @ vectors[q] + 1) / 2)) if d in vectors else 0)

    cases = {
        "cosine_topk_all": (20, vectors, lambda d, q: vectors[d] @ vectors[q]),
        "hybrid_search_all": (25, words, blend),
        "boosted_search_all": (25, words, lambda d, q: min(1, max(0, blend(d, q) + 0.18 * (lang[d] == "en")))),
        "class_filtered_search_all": (10, [d for d in words if lang[d] == "fr"], blend),
    }
    for name, (n, ids, score) in cases.items():
        got = {}
        for r in catalog.QUERIES[name](spark, str(tmp_path)).collect():
            got.setdefault(r[0], []).append(r[2])
        assert set(got) == set(queries)
        for q in queries:
            assert sorted(got[q], reverse=True) == pytest.approx(sorted((score(d, q) for d in ids), reverse=True)[:n], abs=2e-6)
    best = {r.vec_id: r.score for r in catalog.QUERIES["multi_query_argmax_all"](spark, str(tmp_path)).collect()}
    assert best == pytest.approx({v: max(vectors[v] @ vectors[q] for q in queries) for v in vectors}, abs=2e-6)
