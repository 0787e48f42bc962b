"""The corpus pipeline against brute force, stage by stage, and its result as a whole."""

import zlib

import numpy as np
from test_dedup import brute, similar
from test_text_operators import brute_contamination
from test_tokens import plain

import corpus_pipeline as pipeline
from quarrymill.llm import quality
from quarrymill.llm.common import materialize
from quarrymill.llm.simhash import fingerprint_of


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_and_run(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before, kept = docs, []
    for _, stage in pipeline.STAGES:
        after = materialize(stage(spark, before, data), "stage")
        kept.append((rows(before), after))
        before = after
    assert all(after.columns == docs.columns for _, after in kept[:-1])

    model = quality.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    matrix = np.array([quality.statistics((r.text or "").encode()) for r in kept[0][0].values()])
    good = {d for d, p in zip(kept[0][0], model.probability(matrix), strict=True) if p >= 0.3}
    assert set(rows(kept[0][1])) == good

    texts = {d: r.text for d, r in kept[1][0].items()}
    prints = {d: fingerprint_of(t.encode(), 2) for d, t in texts.items()}
    left, firsts = sorted(prints), set()
    while left:
        group, todo = {left[0]}, [left[0]]
        while todo:
            x = todo.pop()
            new = {d for d in left if d not in group and (prints[d] ^ prints[x]).bit_count() <= 8 and similar(texts[d], texts[x])}
            group |= new
            todo += new
        firsts.add(min(group))
        left = [d for d in left if d not in group]
    assert set(rows(kept[1][1])) == firsts

    want = {d: (n, removed) for d, n, removed, _, _ in brute([(d, r.text) for d, r in kept[2][0].items()], 100)}
    got = rows(kept[2][1])
    assert set(got) == {d for d, (n, removed) in want.items() if removed < n or n == 0}
    for d, r in got.items():
        n, removed = want[d]
        assert n - removed - 6 <= len(r.text.encode()) <= n - removed and r.n_chars == len(r.text)
        assert (r.lang, r.source) == (kept[2][0][d].lang, kept[2][0][d].source)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    hit = {d: brute_contamination(r.text, items) for d, r in kept[3][0].items()}
    assert set(rows(kept[3][1])) == {d for d, (n, h, _) in hit.items() if not (h and 20 * h >= n)}

    packed = kept[4][1].toPandas()
    for d, r in kept[4][0].items():
        ids = np.array([*plain(r.text), 1], "<u4")
        own = packed[packed.doc_id == d].sort_values("start")
        assert own.length.sum() == len(ids) and [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
    assert sorted(map(tuple, pipeline.run(spark, data).collect())) == sorted(map(tuple, kept[4][1].collect()))


def test_stages_on_odd_rows(spark, odd, empty, data):
    """Nulls, empty and long texts, repeated ids and rows, clashing columns, and no row at all, through every stage."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    all_rows = sorted((tuple(r) for r in odd.select(*columns).collect()), key=repr)
    for k, (name, stage) in enumerate(pipeline.STAGES):
        nothing = stage(spark, empty, data)
        assert nothing.count() == 0, name
        got = stage(spark, odd.union(odd), data)
        if k == 4:
            assert got.agg({"length": "sum"}).first()[0] == 2 * sum(len(plain(r[1])) + 1 for r in all_rows)
            continue
        assert got.columns == columns and nothing.columns == columns
        rows = sorted((tuple(r) for r in got.collect()), key=repr)
        if name == "SimHash near-dedup":
            texts = [r[1] for r in rows]
            assert len(set(texts)) == len(texts) and sum(not t.strip() for t in texts) == 1
            assert {r[0] for r in rows} >= {None, 5, 6, 7} and sum(r[0] == 7 for r in rows) == 2 and not {r[0] for r in rows} & {1, 3, 4}
        if name == "suffix-array dedup":
            assert all(r[1] is not None for r in rows) and sum(len((r[1] or "").encode()) for r in rows) < sum(len((r[1] or "").encode()) for r in all_rows)
        if name == "benchmark decontamination":
            assert rows == sorted(all_rows * 2, key=repr)


def test_run_leaves_only_what_its_result_reads(spark, data):
    import pathlib

    from quarrymill.llm import common

    mark = common.written()
    result = pipeline.run(spark, data)
    folder = pathlib.Path(common.shared_dir(spark).removeprefix("file://"))
    left = {p.name.rsplit("-", 1)[0] for p in folder.iterdir()}
    assert "suffix-array-dedup" not in left or result.count()
    assert "quality-classifier" not in left and "SimHash-near-dedup" not in left
    assert len(common._written) - mark <= 6
