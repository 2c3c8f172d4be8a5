"""Packing: ids as the tokenizer's own, every id once, capacity, balance, odd input."""

import zlib

import numpy as np
import pytest

from gridloom.llm.packing import Encoder, assign, encoder, pack

TEXTS = ["", "Hello, don't STOP 42!", "a\x1cb", "naïve <|endoftext|> ok", "²½ x\x85y", "日本 text", "ǅ", "µ ª", "\xa0x\xa0", "'S 'x ''ll", "word " * 3000, "x" * 5000]


@pytest.fixture(scope="module")
def path(tokenizers):
    return tokenizers("word_bpe_49k.json")


def test_encoder_equals_tokenizer(path):
    small, wide = Encoder(path, table_size=40), Encoder(path)
    for e in (small, wide):
        for got, text in zip(e.texts(TEXTS), TEXTS, strict=True):
            assert np.array_equal(got, e.whole(text)), text


def test_assign_fills_and_balances():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 2048, 300)
    parts = assign(lengths, 2048, 1.0, 1 / 2048)
    assert [sum(n for _, n in p) for p in parts] == lengths.tolist()
    filled, cost = {}, {}
    for p in parts:
        for b, n in p:
            filled[b] = filled.get(b, 0) + n
            cost[b] = cost.get(b, 0) + n + n * n / 2048
    assert max(filled.values()) <= 2048 and len(filled) == -(-int(lengths.sum()) // 2048)
    # in input order, each where it first fits, costs spread more widely
    naive, room = [0.0], 2048
    for n in lengths.tolist():
        if n > room:
            naive, room = [*naive, 0.0], 2048
        naive[-1] += n + n * n / 2048
        room -= n
    assert np.std(list(cost.values())) < np.std(naive)


def test_pack_covers_every_id_once(spark, path):
    from tokenizers import Tokenizer

    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(100, None, 1), (1, TEXTS[1], 1), (None, "null id", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int")
    out = pack(docs, path, bucket=4).collect()
    t = Tokenizer.from_file(path)
    for i, text in {(i, x) for i, x, _ in rows}:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        pieces = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        copies = 2 if i == 1 else 1
        assert sum(r.length for r in pieces) == copies * len(ids)
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and sum(n for _, n in own) <= 2048
    assert pack(docs.where("false"), path).count() == 0


def test_words_met_again_are_not_encoded_again(path):
    """What a worker's earlier tasks and texts have met goes to the tokenizer no more, frequent words not even when tables change."""
    e, texts = encoder(path), ["Plenty of wörds, met (again) and again.", "and again of plenty; (of it)"]
    assert encoder(path) is e
    small, learnt = Encoder(path, table_size=30), []
    for known in (e, small):
        known.texts(texts)
        learn = known.learn
        known.learn = lambda words, learn=learn: (learnt.extend(words), learn(words))
        for k in range(40):
            assert all(np.array_equal(got, known.whole(t)) for got, t in zip(known.texts([*texts, f"x{'y' * k}"]), [*texts, f"x{'y' * k}"], strict=True))
        del known.learn
    assert set(learnt) == {f"x{'y' * k}" for k in range(40)}


def test_words_apart_by_any_white_space(path):
    draw, signs = np.random.default_rng(3), "abzAZ019'sStTrReEvVmMlLdD \t\n\r\x0b\x0c\x1c\x85\xa0\xaa\xb2\xb5\xb9\xbc\xc9\xd7\xdf\xe9\xff.,-_<|>\x00\x7f\xad"
    e = Encoder(path, table_size=60)
    for _ in range(2000):
        text = "".join(draw.choice(list(signs), draw.integers(0, 25)))
        assert np.array_equal(e.text(text), e.whole(text)), text
