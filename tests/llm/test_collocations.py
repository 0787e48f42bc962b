"""Phrase mining against a plain count of every phrase."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarrymill.llm import collocations as C


def brute(rows, least, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    found = set()
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least}
        covered = {p[i : i + m] for p, a in often.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if a >= often[p[i : i + m]]}
        scored = []
        for p, a in often.items():
            if len(p) > 1 and p not in covered:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            found.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return found


def mined(df, **options):
    return [tuple(r) for r in C.collocations(df, **options).collect()]


@pytest.mark.parametrize("cells", [None, 64, 4096])
def test_odd_rows(odd, cells):
    rows = [(r.lang, r.text) for r in odd.collect()]
    got = mined(odd, least=4, top=50, cells=cells)
    want = brute(rows, 4, 50)
    assert len(got) == len(want) > 20 and set(got) == want


def test_parts_of_a_text_share_their_edges(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_WORDS", 7)
    rows = [("en", "One two three, four five six seven eight nine ten one TWO three. " * 9), (None, "é\xa0x y\ty x é\xa0x y.a\rb"), ("und", "é\xa0x y"), ("de", None), ("fr", " ,;"), ("en", "four five\x00 six\x0bseven")]
    tokens = [C.tokens_of(x.encode()) for _, x in rows if x]
    for t in tokens:
        numbers = C._Words().numbers(t)
        assert len(numbers) == len(t)
    bits = np.full((2, 8), 255, np.uint8)
    counts = Counter()
    for part, own in C._parts(tokens[0]):
        words = C._Words()
        numbers = words.numbers(part)
        for batch in C._count_part("en", numbers, words, bits, own):
            for r in batch.to_pylist():
                counts[r["phrase"]] += r["f"]
    assert counts["nine ten one two three"] == 9 and counts["eight nine"] == 9 and counts[""] == 13 * 9 and counts["three four"] == 0
    df = spark.createDataFrame(rows, "lang string, text string")
    assert set(mined(df, least=2)) == brute(rows, 2, 2000)


def test_tasks_hold_numbers_of_words_not_words(spark, monkeypatch):
    """Both passes over a million words, 200,000 of them different, in texts of two languages."""
    df, passes = spark.createDataFrame([("en", "a b")], "lang string, text string"), []
    plain = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a: passes.append(f) or plain(self, f, *a))
    C.phrase_counts(df, cells=4096)
    sketch, _, count = passes

    def batches():
        rng = random.Random(1)
        for _ in range(20):
            texts = [" ".join(f"{rng.randrange(200_000):09x}" for _ in range(500)) for _ in range(100)]
            yield pa.RecordBatch.from_arrays([pa.array(["en", "de"] * 50), pa.array(texts)], names=["lang", "text"])

    for one in (sketch, count):
        tracemalloc.start()
        for _ in one(batches()):
            pass
        most = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert most < 90


def test_long_texts_and_forgotten_words(spark, monkeypatch):
    monkeypatch.setattr(C, "SLICE", 5)
    monkeypatch.setattr(C, "MOST_KNOWN", 3)
    text = "One two\tthree, four five.six seven!eight \xe9\xa0\xe9 nine\nten averylongwordindeed eleven "
    assert b"".join(C._slices(text.encode())) == text.encode() and len(list(C._slices(text.encode()))) > 9
    assert [t for s in C._slices(text.encode()) for t in C.tokens_of(s)] == C.tokens_of(text.encode())
    rows = [("en", text * 3), ("de", "one two three"), (None, text), ("en", "four five"), ("de", text)] * 2
    words, counts = C._Words(), Counter()
    batch = pa.RecordBatch.from_arrays([pa.array([lang or "und" for lang, _ in rows]), pa.array([t for _, t in rows])], names=["lang", "text"])
    for lang, numbers in C._chunks(iter([batch]), words):
        counts.update((lang, words.words[k]) for k in numbers.tolist() if k)
    assert counts == Counter((lang or "und", t) for lang, x in rows for t in C.tokens_of(x.encode()) if t != b".")
    df = spark.createDataFrame(rows, "lang string, text string")
    assert set(mined(df, least=2)) == brute(rows, 2, 2000)


def test_sketches_only_overestimate():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 500).astype(np.uint64)[rng.zipf(1.3, 20_000) % 500]
    whole, parts = C.Sketch(128, 100), [C.Sketch(128, 100) for _ in range(3)]
    for k, s in enumerate(parts):
        s.add(keys[k::3])
    whole.add(keys)
    merged = np.minimum(sum(s.rows.astype(int) for s in parts), 100)
    assert (merged == whole.rows).all()
    names, n = np.unique(keys, return_counts=True)
    bits = np.packbits(merged >= 100, axis=1)
    assert C._among(names, bits)[n >= 100].all() and not C._among(names, np.packbits(merged > 100, axis=1)).any()


def test_counts_do_not_grow_with_the_parts_of_a_table(spark, monkeypatch):
    """A phrase comes from a number of tasks that the cores fix, not from every part of the table."""
    rows = [("en", "One two three, two three.")] * 64
    df = spark.sparkContext.parallelize(rows, 64).toDF("lang string, text string")
    frame, handed = type(df), []
    plain = frame.groupBy
    monkeypatch.setattr(frame, "groupBy", lambda self, *by: handed.append(self) or plain(self, *by))
    got = {(r.phrase, r.words): r.f for r in C.phrase_counts(df, least=2).collect()}
    assert got == {("", 0): 320, ("one", 1): 64, ("two", 1): 128, ("three", 1): 128, ("one two", 2): 64, ("two three", 2): 128, ("one two three", 3): 64}
    most = C.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert df.rdd.getNumPartitions() == 64 > most
    counts = next(x for x in handed if x.columns == ["lang", "phrase", "words", "f"])
    assert counts.count() <= most * len(got)


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big), ("en", "b", 1, big + 7), ("en", "", 0, 10 * big)], "lang string, phrase string, words int, f long")
    row = C.score_phrases(counts).first()
    assert row.score == 1000 * big * 10 * big // (big * (big + 7))


def test_empty(empty):
    assert mined(empty) == []
