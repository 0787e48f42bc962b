import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quarrymill.llm import simhash, suffix_dedup
from quarrymill.llm.components import connected_components
from quarrymill.llm.suffix_array import later_windows, shares_prefix, suffix_array

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(nodes, near):
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if near(nodes[i], nodes[j]):
                parent[find(i)] = find(j)
    return [find(k) for k in range(len(nodes))]


def test_near_duplicates_against_all_pairs(odd):
    rows = [(r.doc_id, fingerprint(r.text)) for r in odd.collect()]
    near = lambda a, b: (a[1] ^ b[1]).bit_count() <= 4 or a[0] == b[0] is not None
    labels = components_of(rows, near)
    least = {}
    for label, (doc_id, _) in zip(labels, rows, strict=True):
        if doc_id is not None:
            least[label] = min(least.get(label, doc_id), doc_id)
    want = sorted(((d, format(f, "016x"), least.get(x)) for x, (d, f) in zip(labels, rows, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()), key=repr) == want


def test_near_duplicates_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("rows", [8192, 16])
@pytest.mark.parametrize("tau", [4, 7])
def test_links_keep_all_components(spark, monkeypatch, rows, tau):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", rows)  # 16: buckets are cut into blocks
    rng = random.Random(tau)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for c in centres for _ in range(60)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp long"), tau).collect()
    at = {s: k for k, s in enumerate(signed)}
    found = {(at[r.a], at[r.b]) for r in links}
    assert all((prints[a] ^ prints[b]).bit_count() for a, b in found)
    ours = components_of(range(len(prints)), lambda a, b: (a, b) in found or (b, a) in found)
    true = components_of(prints, lambda a, b: (a ^ b).bit_count() <= tau)
    assert len(set(zip(ours, true, strict=True))) == len(set(ours)) == len(set(true))


def test_thresholds_sum_and_prefer_cheap_groups():
    cost, chosen = simhash.allocate([[10, 100, 1000], [1, 5, 500], [3, 300, 3000]], 2)
    assert sum(chosen) == 2 and chosen == [0, 1, 1] or cost <= 10 + 5 + 300
    assert simhash.allocate([[5.0], [1.0], [2.0]], -1) == (3.0, [-1, 0, 0])


def test_every_plan_finds_every_pair():
    rng = np.random.default_rng(1)
    together = rng.integers(200, 300, (64, 64)).astype(float)
    for n in (10, 10**6, 10**10):
        plan = simhash.make_plan(n, together, 4)
        bits = sorted(b for g, _ in plan for b in g)
        assert len(bits) == len(set(bits))
        m = len(plan) if len(bits) == 64 else None
        if m:
            assert sum(t for _, t in plan) == 4 - m + 1


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 100)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1100), 1000)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab", min_size=1, max_size=80), st.integers(1, 12))
def test_suffix_array(text, depth):
    t = np.frombuffer(text.encode(), np.uint8)
    order = suffix_array(t, depth)
    heads = [text[k : k + depth] for k in order]
    assert sorted(order.tolist()) == list(range(len(text))) and heads == sorted(heads)
    if depth >= 8:
        want = [a == b and len(a) == depth for a, b in zip(heads[1:], heads, strict=False)]
        assert [x and len(h) == depth for x, h in zip(shares_prefix(t, order, depth).tolist(), heads[1:], strict=True)] == want
        valid = np.arange(len(text)) <= len(text) - depth
        assert later_windows(t, valid, depth).tolist() == [v and text.find(text[k : k + depth]) < k for k, v in enumerate(valid)]


def test_suffixes_that_repeat_are_not_sorted_again(monkeypatch):
    """A passage that stands twice is compared to the whole depth, but its ties are not sorted at every step of it."""
    passage = np.random.default_rng(3).integers(97, 123, 5000).astype(np.uint8)
    text = np.concatenate([passage, [255], passage]).astype(np.uint8)
    sizes = []
    for name in ("argsort", "lexsort"):
        plain = getattr(np, name)
        monkeypatch.setattr(np, name, lambda a, *args, plain=plain, **kw: sizes.append(len(a[0]) if isinstance(a, tuple) else len(a)) or plain(a, *args, **kw))
    later = later_windows(text, np.arange(len(text)) <= len(text) - 100, 100)
    assert later.tolist() == [k > 5000 and k <= len(text) - 100 for k in range(len(text))]
    assert sum(sizes) < 2 * len(text)


def brute(rows, width):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        data = (text or "").encode()
        mark = bytearray(len(data))
        for k in range(len(data) - width + 1):
            w = data[k : k + width]
            if w in seen:
                mark[k : k + width] = b"\1" * width
            seen.add(w)
        kept = bytes(c for c, m in zip(data, mark, strict=True) if not m)
        out.append((doc_id, len(data), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [2_000_000, 1500])
def test_remove_repeats_against_brute_force(odd, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)  # small: large keys are dealt by windows
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(odd).collect()]
    assert sorted(got, key=repr) == brute([(r.doc_id, r.text) for r in odd.collect()], 100)


def test_remove_repeats_in_texts_longer_than_a_chunk(spark):
    rng = random.Random(9)
    noise = "".join(rng.choice("abcdefgh é") for _ in range(1_150_000))
    rows = [(1, noise), (2, "x" * 99 + noise[1_040_000:1_049_000] + "y"), (3, "z" * 300_000)]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == brute(rows, 100)


def test_remove_repeats_as_text_and_of_nothing(spark, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    rows = [(1, "é" * 60), (2, "a" + "é" * 60 + "b")]
    got = {r.doc_id: r.kept for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), as_text=True).collect()}
    assert set(got[2]) <= set("aéb") and got[2][0] == "a" and got[2][-1] == "b"


def removed(spark, rows):
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=repr)


@pytest.mark.parametrize("steps", [(24, 6, 1), (1,)])
@pytest.mark.parametrize("limit", [100, 400, 3000])
def test_keys_of_many_contents_are_sorted_in_parts(spark, odd, monkeypatch, limit, steps):
    """One passage stands in every text, with other words before and after it, or cut short."""
    monkeypatch.setattr(suffix_dedup, "KEY_BYTES", limit)
    monkeypatch.setattr(suffix_dedup, "STEPS", steps)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_KEYS", 3)
    rng = random.Random(limit)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    passage = " ".join(word() for _ in range(40))
    rows = []
    for k in range(120):
        a, b = rng.choice([(0, 10**6), (0, 10**6), (rng.randint(0, 60), 10**6), (0, rng.randint(80, 160))])
        rows.append((k, f"{' '.join(word() for _ in range(rng.randint(0, 12)))} {passage[a:b]} {' '.join(word() for _ in range(rng.randint(0, 12)))}"))
    rows += [(1000 + k, "z" * 500) for k in range(5)] + [(2000, "ab" * 400)]
    assert removed(spark, rows) == brute(rows, 100)


def test_folds_keep_two_and_part_keys_of_many_contents(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FOLD_KEY", 3)
    key = np.array([5] * 10 + [6] * 4, np.int64)
    content = np.array([1, 1, 1, 2, 3, 4, 4, 4, 5, 6, 9, 9, 9, 9], np.int64)
    doc = np.arange(14)
    got = suffix_dedup._fold([key, content, doc, np.zeros(14, np.int64), suffix_dedup._pack(np.zeros(14), np.ones(14), np.zeros(14))]).to_pydict()
    marks = {d: p & 3 for d, p in zip(got["doc"], got["place"], strict=True)}
    assert [marks[d] for d in range(14)] == [0, 0, 2, 0, 0, 1, 1, 2, 1, 1, 0, 0, 2, 2]
    route = dict(zip(got["doc"], got["route"], strict=True))
    assert {route[d] for d in (0, 1, 3, 4)} == {5} and route[5] == route[6] != 5 and route[10] == 6
    assert got["key"] == key.tolist() and got["content"] == content.tolist()


def test_a_second_segment_that_differs_is_reported():
    one, other = b"x" * 60 + b"abcdefgh" * 10, b"y" * 60 + b"abcdefgh" * 10
    import pyarrow as pa

    rows = [(1, -1, 0, 1, 0, 0, one), (1, -1, 1, 2, 0, 0, other), (2, -1, 0, 1, 0, 0, one[1:]), (2, -1, 1, 3, 0, 0, one[1:])]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), suffix_dedup._CUT.values(), strict=True)], names=list(suffix_dedup._CUT))
    got = [r for b in suffix_dedup._sort_segments(100, 24, True)(iter([batch])) for r in b.to_pylist()]
    assert {r["key"] for r in got if r["kind"] == suffix_dedup.WRONG} == {1}


def test_wrong_hashes_lose_nothing(spark, monkeypatch):
    """Segments are taken for copies of each other though their bytes differ; the suffix arrays set it right."""
    plain = suffix_dedup._find_segments

    def blind(width):
        def run(batches):
            for batch in plain(width)(batches):
                yield batch.set_column(2, "content", (batch.column(2).to_numpy() & 1).astype(np.int64))

        return run

    monkeypatch.setattr(suffix_dedup, "_find_segments", blind)
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(k, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 200))) + passage[rng.randint(0, 50) : rng.randint(150, 300)]) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(5)]
    assert removed(spark, rows) == brute(rows, 100)


def shingle_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def similar(a, b, least=0.8):
    a, b = shingle_set(a), shingle_set(b)
    return a == b or len(a & b) >= least * len(a | b)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
    return " ".join(words)


@pytest.mark.parametrize(("rows", "tau"), [(1024, 64), (16, 64), (16, 8)])
def test_similar_documents_against_all_pairs(spark, odd, monkeypatch, rows, tau):
    monkeypatch.setattr(simhash, "GROUP_ROWS", rows)  # 16: groups are cut into blocks
    rng = random.Random(rows)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 120, 400]))] for _ in range(6)]
    made = [(5000 + k, edited(rng, base[k % 6], rng.choice([0, 1, 2, 5]) * len(base[k % 6]) // 100)) for k in range(90)]
    docs = odd.select("doc_id", "text", F.lit("x").alias("doc"), F.lit(1).alias("turn")).union(spark.createDataFrame(made, "doc_id long, text string").selectExpr("*", "'x'", "1"))
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    prints = [simhash.fingerprint_of(t.encode(), 2) for _, _, t in texts]
    labels = components_of(list(range(len(texts))), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= tau and similar(texts[a][2], texts[b][2]))
    least = {}
    for k, label in enumerate(labels):
        least.setdefault(label, k)
    want = sorted((texts[k][:2], texts[least[label]][:2]) for k, label in enumerate(labels))
    null = -(1 << 63)
    name = lambda d: (d != null, d if d != null else 0)
    if tau == 64:
        monkeypatch.setattr(simhash, "near_links", lambda p, t: p.select(F.col("fp").alias("a"), F.lit(prints[0] - (1 << 64) if prints[0] >> 63 else prints[0]).alias("b")).where("a <> b"))
    got = simhash.similar_documents(docs, tau=tau).collect()
    assert sorted((name(r.doc), name(r.first_doc)) for r in got) == want
    assert len({(r.doc, r.turn) for r in got}) == len(got)


def test_similar_documents_of_nothing(empty):
    assert simhash.similar_documents(empty).count() == 0


def test_most_similar_documents_are_found(spark):
    """Of the pairs of sf0.01 with a similarity of 0.8 or more, nine tenths end in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    group = {r.doc: r.first_doc for r in simhash.similar_documents(docs).collect()}
    sets = {d: shingle_set(t) for d, t in texts.items()}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, set()).add(d)
    pairs = {(a, b) for h in holders.values() if len(h) > 1 for a in h for b in h if a < b}
    near = [(a, b) for a, b in pairs if sets[a] != sets[b] and similar(texts[a], texts[b])]
    assert near and sum(group[a] == group[b] for a, b in near) >= 0.9 * len(near)
    firsts = {}
    for d, f in group.items():
        firsts.setdefault(f, []).append(d)
    for f, members in firsts.items():  # nothing is linked that isn't similar
        assert f == min(members) and all(any(similar(texts[a], texts[b]) for b in members if b != a) for a in members if len(members) > 1)


@pytest.mark.parametrize("tau", [4, 8, 13, 24, 40])
def test_plans_for_any_distance(tau):
    plan = simhash.make_plan(1000, np.diag(np.full(64, 500.0)) + 250, tau)
    assert sum(t for _, t in plan) - (6 - len(plan)) >= tau - 5 - 6 and all(t >= 0 for _, t in plan)
