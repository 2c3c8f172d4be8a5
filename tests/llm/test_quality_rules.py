"""Quality rules against a plain loop over texts, lines and hosts."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gridloom.llm import quality_rules as Q

SPACE = r"[\x20\x09-\x0D]+"


def split(text):
    return [w for w in re.split(SPACE, text) if w]


def plain_measures(text):
    words = split(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if split(line):
            twice += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twice, len(covered), failed


def brute(docs, limits):
    lines = [[" ".join(split(x.lower())) for x in (t or "").split("\n") if split(x)] for _, t, _ in docs]
    name = [i if i is not None else ("row", k) for k, (i, _, _) in enumerate(docs)]
    holders, hosts = defaultdict(set), defaultdict(set)
    for k, (_, _, host) in enumerate(docs):
        hosts[host or ""].add(name[k])
        for x in lines[k]:
            holders[host or "", x].add(name[k])
    often = {key for key, own in holders.items() if len(own) > limits.documents and len(own) > limits.share * len(hosts[key[0]])}
    out = []
    for (doc_id, text, host), own in zip(docs, lines, strict=True):
        found = plain_measures(text or "")
        removed = sum(len(x.split(" ")) for x in own if (host or "", x) in often)
        rest = found[0] - removed
        kept = not found[5] and not (removed and (rest < limits.least_words or rest < limits.least_rest * found[0]))
        out.append((doc_id, *found, removed, kept))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(6)
    words = [*"abcde", "Haus", "ÉTÉ", "x#1", "<b>", "東京"]
    text = lambda n, own: "".join(rng.choice(own) + rng.choice([" ", " ", "\n", " \t ", "\r\n", "\n\n \n"]) for _ in range(n))
    fresh = [f"w{i}" for i in range(3000)]
    docs = [(i, text(rng.choice([0, 10, 60, 300]), words if i % 4 == 0 else fresh), rng.choice(["h0", "h0", "h1", None])) for i in range(70)]
    shared = "All  rights RESERVED here"
    docs += [(100 + i, text(70, fresh) + "\n" + (shared if i % 2 else shared.lower().replace("  ", " ")) + "\n" + "tail word " * (i % 3), "h0") for i in range(14)]
    whole = "\n".join(f"one{i} line{i} of{i} a copied{i} text{i}" for i in range(20))
    docs += [(200 + i, whole, "h1") for i in range(9)] + [(300, whole, "h0")]
    docs += [(400, " ".join(f"u{i}" for i in range(60)) + "\nrepeated row line", "h2")] * 12  # one document
    docs += [(None, " ".join(f"v{i}" for i in range(60)) + "\nline without id", "h2") for _ in range(9)]
    docs += [(500, None, None), (501, "", "h0"), (502, " \n \t\n", "h0"), (503, "a " * 30_000, "h0"), (504, "one two", "h1"), (505, "x y z x y z", "h1"), (506, "a a a a", "h1"), (507, "\n".join(f"line {i} {i * 7}" for i in range(5000)), "h1")]
    return docs


def test_verdicts_equal_a_plain_loop(spark):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4).withColumns({"words": F.lit(1), "row": F.lit("x"), "host": F.lit("y"), "every": F.lit("z"), "line": F.lit(2)})
    columns = ["own.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"]
    for limits in (Q.Limits(), Q.Limits(documents=6, share=0.05, least_words=60, least_rest=0.9)):
        expected = brute(docs, limits)
        assert sorted((tuple(r) for r in Q.judge(frame, limits=limits, keep=["doc_id"]).select(*columns).collect()), key=repr) == expected
    lost = [r for r in expected if not r[6] and not r[8]]
    assert {r[0] for r in lost} >= {200, 208} and 300 not in {r[0] for r in lost}  # the copies, but not the one of another host
    assert Q.judge(frame.limit(0)).collect() == []


def test_cleaned_texts_lose_their_frequent_lines(spark):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("frequent", F.lit(1.5))
    out = Q.cleaned(frame, limits=Q.Limits(documents=6, share=0.05))
    assert out.columns == frame.columns
    rows = {r.doc_id: r for r in out.collect()}
    given = {i: t for i, t, _ in docs}
    for i in range(100, 114):
        left = [x for x in given[i].split("\n") if " ".join(split(x.lower())) != "all rights reserved here"]
        assert rows[i].text == "\n".join(left) and rows[i].frequent == 1.5
    assert rows[400].text == given[400] and 200 not in rows and 501 not in rows


def test_main_path_has_no_python(spark):
    frame = spark.createDataFrame([(1, "a b", "h")], "doc_id long, text string, source string")
    plan = Q.judge(frame)._jdf.queryExecution().toString() + Q.measured(frame)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
