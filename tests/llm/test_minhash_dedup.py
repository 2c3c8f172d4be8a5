"""Order MinHash against all pairs."""

import random

import numpy as np
import pytest

from gridloom.llm import minhash_dedup as M


def vocabulary(n=400):
    rng = random.Random(1)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def brute(docs):
    s = M.Shingler()
    words = {i: M.WORD.findall(t.lower()) for i, t in docs if t and i is not None}
    root = {i: i for i in words}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    shingles = {i: s.of(w) if w else None for i, w in words.items()}
    text = dict(docs)
    for i in words:
        for j in words:
            if i < j and (words[i] == words[j] and (words[i] or text[i] == text[j]) or words[i] and words[j] and M.aligned(shingles[i], shingles[j], 0.8)):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in words}


def corpus():
    rng, words = random.Random(7), vocabulary()
    docs = []
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 60, 150, 300]))]
        docs.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 5])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 30))):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append(" ".join(own).upper() if k % 3 else " ".join(own) + " .")
    passage = [rng.choice(words) for _ in range(70)]
    docs += [" ".join(passage + [rng.choice(words) for _ in range(30)]) for _ in range(20)]
    half = docs[2].split()
    docs += [" ".join(half[len(half) // 2 :] + half[: len(half) // 2]), "", "???", "???", "!!", "a a a a a a a a a a a", "a a a a a a a a a a a a"]
    return [(i, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("block, repeats", [(256, 32), (3, 32), (3, 1)])
def test_classes_equal_all_pairs(spark, block, repeats):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs] + [(900, None, "x", 0), (None, "no id", "x", 0)], "doc_id long, text string, class_id string, kept int")
    rows = M.classes(df, block=block, repeats=repeats).collect()
    assert len(rows) == len(docs) + 2
    got, expected = {r.doc_id: r.class_id for r in rows}, brute(docs)
    assert {i: c for i, c in got.items() if i in expected} == expected
    assert got[900] == 900 and got[None] is None
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows if r.doc_id is not None)
    assert M.classes(df.where("false")).count() == 0


def test_similar_texts_share_a_rare_shingle():
    """Under any counters: those of the texts themselves, all equal, and all unlike."""
    rng, words, s = random.Random(13), vocabulary(), M.Shingler()
    for n in (5, 6, 14, 40, 150):
        for _ in range(40):
            base = [rng.choice(words) for _ in range(n + 4)]
            own = list(base)
            for _ in range(rng.randint(0, max(1, n // 50))):
                own[rng.randrange(len(own))] = rng.choice(words)
            a, b = s.of(base), s.of(own[: len(own) - rng.randint(0, n // 10)])
            if not M.aligned(a, b, 0.8):
                continue
            slots = (np.concatenate([a, b]) % np.uint64(M.COUNTERS)).astype(int)
            for counts in (np.bincount(slots, minlength=M.COUNTERS), np.full(M.COUNTERS, 9), np.random.default_rng(n).integers(2, 99, M.COUNTERS)):
                assert set(M.rare_prefix(a, counts, 0.8).tolist()) & set(M.rare_prefix(b, counts, 0.8).tolist())


def test_texts_alike_in_a_passage_only_do_not_meet(spark):
    rng, words, s = random.Random(17), vocabulary(3000), M.Shingler()
    passage = [rng.choice(words) for _ in range(100)]
    texts = [passage + [rng.choice(words) for _ in range(80)] for _ in range(300)]
    texts += [t[:-3] + [rng.choice(words) for _ in range(3)] for t in texts[:7]]
    held = spark.createDataFrame([(i, i, bytearray(s.of(t).astype("<u8").tobytes())) for i, t in enumerate(texts)], "id long, component long, shingles binary")
    met = {}
    for r in M._by_rare_shingle(held, 0.8).collect():
        met.setdefault(r.key, set()).add(r.id)
    pairs = {(a, b) for ids in met.values() for a in ids for b in ids if a < b}
    assert {(i, 300 + i) for i in range(7)} <= pairs
    assert len(pairs) < 100  # of 47,000
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in M.classes(df, block=16, repeats=2).collect()}
    assert got == {i: i if i < 300 else i - 300 for i in range(307)}


def test_order_matters():
    s = M.Shingler()
    w = vocabulary()[:200]
    a, b = s.of(w), s.of(w[100:] + w[:100])
    assert M.aligned(a, b, 0.1) < 0.4
    assert len(set(M.sketch_keys(a, 20, 4)) & set(M.sketch_keys(s.of(w), 20, 4))) == 20


def test_repeated_shingles_are_told_apart():
    s = M.Shingler()
    many = s.of(["a"] * 30)
    assert len(set(many.tolist())) == 26
    assert np.array_equal(s.of(["a"] * 20), many[:16])


def test_recall_at_the_threshold():
    rng, words, s = random.Random(3), vocabulary(), M.Shingler()
    near = missed = 0
    while near < 60:
        base = [rng.choice(words) for _ in range(200)]
        own = list(base)
        for _ in range(4):
            own[rng.randrange(200)] = rng.choice(words)
        a, b = s.of(base), s.of(own)
        if M.aligned(a, b, 0.8):
            near += 1
            missed += not set(M.sketch_keys(a, 20, 4)) & set(M.sketch_keys(b, 20, 4))
    assert missed == 0


@pytest.mark.parametrize("words, other", [(9, 8), (9, 10), (14, 13), (20, 18), (37, 36)])
def test_short_texts_share_sketches(words, other):
    """Pairs near the threshold of few shingles: of 300 each none is missed (sketches of four missed 1 in 80 of 5 and 4 shingles)."""
    rng, vocab, s = random.Random(words), vocabulary(), M.Shingler()
    for _ in range(300):
        base = [rng.choice(vocab) for _ in range(max(words, other))]
        a, b = s.of(base[:words]), s.of(base[:other])
        assert M.aligned(a, b, 0.8) >= 0.8
        assert set(M.keys_of(a, 20, 4)) & set(M.keys_of(b, 20, 4))


def test_short_pairs_are_found(spark):
    rng, vocab = random.Random(8), vocabulary(3000)
    docs = []
    for k in range(800):
        n = rng.choice([9, 10, 13, 20, 21, 36, 40])
        base = [rng.choice(vocab) for _ in range(n)]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:-1]))]
    got = {r.doc_id: r.class_id for r in M.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[2 * k + 1] == 2 * k for k in range(800))


def test_kinds_of_sketches_overlap():
    s, v = M.Shingler(), vocabulary()
    counts = {n: len(M.keys_of(s.of(v[: n + 4]), 20, 4)) for n in (1, 2, 15, 16, 32, 33)}
    assert counts == {1: 0, 2: 20, 15: 20, 16: 40, 32: 40, 33: 20}
    own = [M.keys_of(s.of(v[: n + 4]), 20, 4) for n in (15, 20, 40)]
    table = M.aligned_keys(own, [15, 20, 40], 20)
    assert table[0, :20].tolist() == own[0] and table[1].tolist() == own[1] and table[2, 20:].tolist() == own[2] and not table[0, 20:].any() and not table[2, :20].any()


def test_a_text_of_many_shingles_equals_itself():
    s = M.Shingler()
    a = s.of([str(i) for i in range(200_004)])
    assert len(np.unique(a)) == len(a) and M.aligned(a, a, 0.8) == 1.0


def test_low_thresholds_are_refused(spark):
    with pytest.raises(ValueError):
        M.classes(spark.createDataFrame([], "doc_id long, text string"), threshold=0.5)


def test_alignment_against_full_table():
    rng = random.Random(5)
    for _ in range(100):
        a = rng.sample(range(60), rng.randint(5, 50))
        b = [x for x in a if rng.random() > 0.1] + rng.sample(range(100, 140), rng.randint(0, 4))
        if rng.random() < 0.3:
            rng.shuffle(b)
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        n = table[-1, -1]
        value = n / (len(a) + len(b) - n)
        assert M.aligned(np.array(a), np.array(b), 0.8) == (value if value >= 0.8 else 0.0)
