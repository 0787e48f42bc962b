import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrymill.llm import packing, tokens

REFERENCE = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))


def plain(text):
    return REFERENCE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abCÉéßİſΣς .,;:!?'\n\t ́ क़한글你<|>0१-"), max_size=60))
def test_words_put_together_give_the_ids_of_the_text(text):
    assert np.frombuffer(tokens.WordEncoder.get(tokens.TOKENIZER).encode(text.encode()), "<u4").tolist() == plain(text)


def test_special_tokens_in_texts():
    for text in ("a <|endoftext|> b", "A <|ENDOFTEXT|> B", "x<|startoftext|>y"):
        assert np.frombuffer(tokens.WordEncoder.get(tokens.TOKENIZER).encode(text.encode()), "<u4").tolist() == plain(text)


def test_words_of_many_scripts_and_cases():
    words = "École ÉCOLE e\u0301cole straße ΣΑΣ σας Ǆ ǆ İstanbul ıssız ŉ ﬁn Привет, 你好。 हिन्दी ʼn Ǆungla don't x2y a,b word. word.. (word) É. Ω! ſo Kelvin".split()
    got = tokens.WordEncoder(tokens.TOKENIZER)._encode_words([w.encode() for w in words])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain(w) for w in words]


def test_vocabularies_whose_tokens_cross_spaces_are_encoded_whole():
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "Two  words, and\nmore"
    assert np.frombuffer(tokens.WordEncoder("byte_bpe_50k.json").encode(text.encode()), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def test_memo_generations_change_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 3)
    encoder = tokens.WordEncoder(tokens.TOKENIZER)
    for text in ["one two three four", "five one six", "two seven eight nine ten", "one two"] * 3:
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == plain(text)


def test_token_files_round_trip(spark, odd):
    folder, index = tokens.write_token_files(odd, seq_len=64, batch_rows=4, partitions=3)
    got = sorted(tokens.read_token_files(folder, index).collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    for r, (doc_id, text) in zip(got, want, strict=True):
        ids = np.array([*plain(text), 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_sequences_are_views_with_masks(spark, odd):
    folder, index = tokens.write_token_files(odd, seq_len=64, batch_rows=4, partitions=1)
    shard, total = index.first().shard, index.agg(F.sum("n_tokens")).first()[0]
    reader = tokens.ShardReader(folder, shard)
    n = -(-total // 64)
    masks = [sum(reader.sequence(k)[1].to_pylist()) for k in range(n)]
    assert masks[:-1] == [64] * (n - 1) and sum(masks) == total
    assert not reader.sequence(0)[0].flags.owndata and reader.sequence(0)[0].dtype == np.uint16


def test_empty_tables(empty):
    folder, index = tokens.write_token_files(empty)
    assert tokens.read_token_files(folder, index).count() == 0
    assert packing.pack_documents(empty).count() == 0
    assert tokens.context_limits(tokens.length_histogram(empty)).count() == 0


def test_context_limits(odd):
    lengths = np.array([len(plain(r.text)) for r in odd.collect()])
    limits = tokens.context_limits(tokens.length_histogram(odd), block=16).cache()
    for r in limits.collect():
        assert (r.n_docs, r.docs_longer, r.truncated_total, r.total) == ((lengths == r.n_tokens).sum(), (lengths > r.n_tokens).sum(), np.minimum(lengths, r.n_tokens).sum(), lengths.sum())
        assert r.tokens_longer == lengths[lengths > r.n_tokens].sum() and r.lost_tokens == r.total - r.truncated_total
    for limit in (0, 1, 7, 50, 10**6):
        r = tokens.totals_at(limits, limit).first()
        assert (r.docs_longer, r.truncated_total) == ((lengths > limit).sum(), np.minimum(lengths, limit).sum())
    assert tokens.length_quantile(limits, 0.5).first().n_tokens == np.sort(lengths)[-(-len(lengths) // 2) - 1]


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 10_000), st.sampled_from([64, 2048]))
def test_cut_lengths(n, capacity):
    tail = 8 if capacity == 64 else 32
    lengths = packing.cut_lengths(n, capacity, tail)
    assert sum(lengths) == n and all(0 < x <= capacity for x in lengths)
    assert all(x <= tail or x == capacity // (capacity // x) for x in lengths)


@pytest.mark.parametrize("limit", [packing.BROADCAST_ROWS, 0])
def test_packing_covers_every_id_once(odd, monkeypatch, limit):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", limit)
    p = packing.pack_documents(odd, capacity=64, tail=8).toPandas()
    assert p.length.sum() == sum(len(plain(r.text)) + 1 for r in odd.collect())
    for _, g in p.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.r_[0, np.cumsum(g.length)[:-1]]).all() and g.length.sum() <= 64
    assert sorted(p.sequence_id.unique()) == list(range(p.sequence_id.nunique()))
    assert p.length.sum() / (64 * p.sequence_id.nunique()) > 0.9
    by_text = {r.doc_id: r.text for r in odd.collect() if r.doc_id not in (7, None)}
    for doc_id, g in p[p.doc_id.isin(list(by_text))].groupby("doc_id"):
        ids = b"".join(g.sort_values("start").ids)
        assert np.frombuffer(ids, "<u4").tolist() == [*plain(by_text[int(doc_id)]), 1]
