"""Filter interaction audit against a plain loop over all orders."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from gridloom.llm import filter_audit


def fails(text, smaller):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
        out.add("C")
    if any(c in "#$%&*|" for c in text):
        out.add("D")
    if smaller:
        out.add("E")
    return out


def brute(docs, labels):
    first, best = {}, {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    for doc_id, quality, toxic in labels:
        q, t = best.get(doc_id, (0, 0))
        best[doc_id] = (max(q, quality or 0), max(t, toxic or 0))
    rows = [(part or "", fails(text or "", doc_id is not None and first[text or ""] < doc_id), *(best.get(doc_id, (0, 0)) if doc_id is not None else (0, 0))) for doc_id, text, part in docs]
    out, removed_of = [], {}
    for part in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                redundant = sum(x in r[1] for r in own) - len(gone)
                left = [r for r in left if x not in r[1]]
                removed_of[part, x] = removed_of.get((part, x), 0) + len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), redundant, sum(r[1] == {x} for r in own), sum(r[2] == 1 for r in gone), sum(r[3] == 1 for r in gone)])
    return sorted(tuple([*r, removed_of[r[0], r[1][r[2] - 1]]]) for r in out)


def corpus():
    rng = random.Random(4)
    docs = []
    for i in range(80):
        words = [rng.choice(["haus", "Baum", "ÄRGER", "x", "東京", "The", "a b", "\x0b", " "]) + (str(k) if rng.random() < 0.5 else "") for k in range(rng.choice([3, 150, 205, 400]))]
        if rng.random() < 0.2:
            words.append(rng.choice("#$%&*|"))
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(words), rng.choice(["s0", "s1", None])))
    docs += [(200 + i, docs[i % 9][1], f"s{i % 2}") for i in range(30)]  # copies
    docs += [(5, docs[5][1], "s1"), (5, docs[5][1], "s0"), (None, docs[5][1], "s1"), (None, None, None), (300, None, "s0"), (299, "", "s0"), (301, "A" * 5000, "s1"), (302, "word " * 3000, "s1")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 310, 3)] + [(6, 1, None), (6, None, 1), (None, 1, 1)]
    return docs, labels


def test_audit_equals_a_plain_loop(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5).withColumns({"mask": F.lit("x"), "kept": F.lit(1), "bits": F.lit(1.5)})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("y"))
    got = sorted(tuple(r) for r in filter_audit.audit(d, marks).collect())
    assert got == brute(docs, labels)
    assert filter_audit.audit(d.limit(0), marks).count() == 0
    unlabelled = filter_audit.audit(d.where("doc_id < 3"), marks.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(unlabelled) == (0, 0)


def test_walk_has_every_prefix_and_mask_once(spark):
    rows = filter_audit.walk(spark, "ABC").collect()
    assert len(rows) == len({(r.prefix, r["mask"]) for r in rows}) == (3 + 6 + 6) * 8
    assert {r.prefix for r in rows if r.step == 3} == {"".join(p) for p in permutations("ABC")}
    for r in rows:
        bits = [1 << "ABC".index(x) for x in r.prefix]
        before, own, m = sum(bits[:-1]), bits[-1], r["mask"]
        assert (r.kept, r.removed, r.redundant, r.lone) == (not m & (before | own), bool(m & own and not m & before), bool(m & own and m & before), m == own)
