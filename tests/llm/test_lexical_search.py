"""Lexical search against a plain loop over all documents and items."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import lexical_search as L


def split(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [t for t in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered) if t]


def brute(docs, items, k=10):
    found = [(i, Counter(split(t))) for i, t in docs]
    filled = [(i, c) for i, c in found if c]
    n_docs, n_terms = len(filled), sum(sum(c.values()) for _, c in filled)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(split(text))
    out = []
    for item, terms in asked.items():
        rows = []
        for doc_id, c in filled:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_terms
            score = 0
            for t in terms:
                if c[t]:
                    df = sum(1 for _, o in filled if o[t])
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, **settings):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, L.search(d, q, **settings).collect()), key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [*"abcdefgh", "haus", "Ärger", "été", "x1", "İstanbul", "東京"]
    docs = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "_", "\t!"]) for _ in range(rng.randint(0, 25)))
        docs.append((i, text))
    docs += [(1000 + i, docs[i % 7][1]) for i in range(60)]  # copies, so that classes and ties are met
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))) for i in range(12)]
    return docs, items


@pytest.mark.parametrize("block_terms", [200_000, 9])
def test_search_equals_a_plain_loop(spark, block_terms):
    docs, items = corpus(1)
    assert run(spark, docs, items, block_terms=block_terms) == brute(docs, items)


def test_odd_rows(spark):
    """Null and empty texts, no terms, null and repeated ids, repeated and null items, a very long text, items without words."""
    docs, items = corpus(2, 40)
    docs += [(None, "haus haus"), (None, "haus b"), (5, "haus a"), (5, "haus a"), (2000, None), (2001, ""), (2002, "?! --"), (2003, "haus " * 60_000 + "Q"), (-3, "HAUS\x00a")]
    items += [(3, "Haus extra"), (3, "q"), (None, "haus"), (50, None), (51, ""), (52, "nowhere"), (53, "HAUS!")]
    assert run(spark, docs, items, k=15) == brute(docs, items, 15)


def test_copies_fill_the_ranks_by_ascending_id(spark):
    """A group of copies larger than the ranks, and others of equal score: least ids first, whatever their class."""
    docs = [(i, "a b") for i in range(30, 90)] + [(i, "b a") for i in (3, 41)] + [(7, "a c"), (1, "z"), (2, "zz z")]
    got = run(spark, docs, [(0, "a")])
    assert got == brute(docs, [(0, "a")]) and [r[2] for r in sorted(got, key=lambda r: r[1])][:3] == [3, 7, 30]


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 1.0, "x")], "doc_id long, text string, score double, bag string")
    items = spark.createDataFrame([(1, "A", 2, 3)], "item_id long, text string, rank int, n int")
    assert [tuple(r) for r in L.search(docs, items).collect()] == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 8 * 100)))]
    for d, q in ((docs.limit(0), items), (docs, items.limit(0)), (docs.withColumn("text", F.lit("?")), items)):
        assert L.search(d, q).collect() == []


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    """Classes are their bags and factors, not their hashes: one hash for all gives the same ranks."""
    docs, items = corpus(3, 50)
    monkeypatch.setattr(L.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    found = run(spark, docs, items)
    monkeypatch.undo()
    assert found == brute(docs, items)


def test_sums_are_exact_beyond_doubles():
    values = np.array([2**52 + 1, 2**52 + 1, 3, 2**53 + 1], dtype=np.int64)
    assert L.sums_by_cell(np.array([0, 0, 0, 2]), values, 3).tolist() == [2**53 + 5, 0, 2**53 + 1]


def test_opened_bags():
    column = pa.array([b"", np.array([[1, 2], [7, 4_000_000_000]], dtype="<u4").tobytes(), np.array([[0, 1]], dtype="<u4").tobytes()])
    row, word, n = L.opened(column)
    assert row.tolist() == [1, 1, 2] and word.tolist() == [1, 7, 0] and n.tolist() == [2, 4_000_000_000, 1]
