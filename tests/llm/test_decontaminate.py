"""Pigeonhole matching against a full edit-distance table."""

import random

from gridloom.llm import decontaminate as D


def distance(item, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        now = [i + 1]
        for j, d in enumerate(text):
            now.append(min(before[j] + (c != d), before[j + 1] + 1, now[j] + 1))
        before = now
    return min(before)


def damaged(rng, text, edits, letters):
    out = list(text)
    for _ in range(edits):
        k = rng.randrange(len(out) + 1)
        kind = rng.random()
        if kind < 0.3 and out:
            out[k % len(out)] = rng.choice(letters)
        elif kind < 0.6:
            out.insert(k, rng.choice(letters))
        elif out:
            del out[k % len(out)]
    return "".join(out)


def test_matcher_against_table():
    rng, hits = random.Random(3), 0
    for _ in range(250):
        letters = rng.choice(["abc ", "abcdefghij "])
        item = D.normalise("".join(rng.choice(letters) for _ in range(rng.randint(5, 60))))
        if not item:
            continue
        text = D.normalise("".join(rng.choice(letters) for _ in range(40)) + damaged(rng, item, rng.randint(0, 8), letters) + "".join(rng.choice(letters) for _ in range(40)))
        found, least, budget = D.Matcher([(1, item)], 0.1).matches(text), distance(item, text), int(len(item) * 0.1)
        assert bool(found) == (least <= budget)
        if found:
            hits += 1
            assert found[0][2] == least and distance(item, text[found[0][3] : found[0][4]]) == least
    assert hits > 50


def test_pieces_cover_the_item():
    for n, e in ((10, 0), (23, 2), (100, 10)):
        item = "x" * n
        parts = D.pieces(item, e)
        assert len(parts) == e + 1 and "".join(p for _, p in parts) == item
        assert [p for g in D.grouped(parts) for p in g] == parts


def test_find_and_clean(spark):
    item = "The quick brown fox, it seems, jumped over one of the very lazy dogs."
    docs = spark.createDataFrame(
        [(1, "start " + item + " end", 0), (2, "x THE quick brwn fox -- it seems  jumped over one\nof the very lazy dogs", 0), (3, "nothing of the kind", 0), (4, None, 0), (5, "", 0), (None, item, 0), (1, "other", 0), (6, "very long " * 20_000 + item, 0)],
        "doc_id long, text string, item_id int",
    )
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "  "), (None, item)], "item_id long, text string")
    for limit in (8_000_000, 10):
        rows = sorted((r.doc_id or -1, r.item_id, r.distance) for r in D.find(docs, bench, max_block_chars=limit).collect())
        assert rows == [(-1, 7, 0), (1, 7, 0), (2, 7, 1), (6, 7, 0)]
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "None"]
    assert D.find(docs, bench.where("false")).count() == 0 and D.clean(docs.where("false"), bench).count() == 0
