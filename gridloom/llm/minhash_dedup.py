"""Near-duplicate texts by Order MinHash.

A sketch takes the few least five-word shingles, labelled by occurrence, under one hash order and
keeps them in the order of the text, so texts agree in it only where shingles agree in their order.
Texts that share a sketch are candidates; a banded alignment of their shingles decides. Similarity
is aligned / (a + b - aligned) for a and b shingles of which `aligned` match in order: the Jaccard
measure of five-word shingles, for matches that keep their order.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import connected_components, joined_components, stage

WORD = re.compile(r"\w+")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Occurrence-labelled shingle hashes of a text; word hashes are kept in a bounded table."""

    def __init__(self, words: int = 5, table_size: int = 300_000):
        self.words, self.size, self.table = words, table_size, {}
        rng = np.random.default_rng(11)
        self.weights = rng.integers(1, 2**63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, words: list[str]) -> np.ndarray:
        """One hash for each window of words in order; a shorter text is one shingle. The same shingle's n-th occurrences agree."""
        table = self.table
        if new := set(words).difference(table):
            if len(table) + len(new) > self.size:
                table.clear()
                new = set(words)
            table.update((w, xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in new)
        h = np.fromiter(map(table.__getitem__, words), dtype=np.uint64, count=len(words))
        n = max(1, len(h) - self.words + 1)
        total = np.zeros(n, dtype=np.uint64)
        for j in range(min(self.words, len(h))):
            total += h[j : j + n] * self.weights[j]
        total = mix(total + np.uint64(len(h) if len(h) < self.words else 0))
        order = np.argsort(total, kind="stable")
        ranked = total[order]
        same = np.append(False, ranked[1:] == ranked[:-1])
        if same.any():
            at = np.arange(n)
            occurrence = at - np.maximum.accumulate(np.where(same, 0, at))
            labels = np.empty(n, dtype=np.uint64)
            labels[order] = occurrence.astype(np.uint64)
            total = np.where(labels > 0, mix(total + labels * GOLDEN), total)
        return total


def sketch_keys(shingles: np.ndarray, sketches: int, size: int) -> list[int]:
    """One key for each sketch: `size` least shingles under one order, in text order; sizes have orders of their own. None for texts of fewer shingles."""
    if len(shingles) < size:
        return []
    salts = mix(np.arange(1, sketches + 1, dtype=np.uint64) * GOLDEN + np.uint64(size << 32))
    keys = np.empty(sketches, dtype=np.uint64)
    step = max(1, 2_000_000 // len(shingles))  # bounds the table of ranks for long texts
    for lo in range(0, sketches, step):
        own = salts[lo : lo + step, None]
        rank = (shingles[None, :] ^ own) * (own | np.uint64(1))
        least = np.sort(np.argpartition(rank, size - 1, axis=1)[:, :size], axis=1)
        key = own[:, 0].copy()
        for j in range(size):
            key = mix(key * GOLDEN + shingles[least[:, j]])
        keys[lo : lo + step] = key
    return keys.view(np.int64).tolist()


#: Sketches of texts of few shingles, and the numbers of shingles up to which a text has these and from which it has the others.
#: Where the similarity is over a half, two similar texts have one kind in common.
SHORT_SIZE, SHORT_UP_TO, LONG_FROM = 2, 32, 16


def keys_of(shingles: np.ndarray, sketches: int, size: int) -> list[int]:
    """The sketches of a text by its number of shingles: smaller ones, larger ones, or both.

    A sketch draws without replacement, so few shingles agree in `size` of them far less often than
    many do: at a similarity of 0.8, 5 and 4 shingles share a sketch of four with a chance of 1/5, one
    of two with 3/5.
    """
    n = len(shingles)
    short = sketch_keys(shingles, sketches, SHORT_SIZE) if n <= SHORT_UP_TO else []
    return short + (sketch_keys(shingles, sketches, size) if n >= LONG_FROM else [])


def aligned_keys(keys: list, numbers: list[int], sketches: int) -> np.ndarray:
    """keys_of() as one row a text, sketches of either kind at the same places; 0 where a text has none."""
    out = np.zeros((len(keys), 2 * sketches), dtype=np.int64)
    for i, (own, n) in enumerate(zip(keys, numbers, strict=True)):
        first = 0 if n <= SHORT_UP_TO else sketches
        out[i, first : first + len(own)] = own
    return out


def aligned(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Similarity of two labelled shingle sequences, or 0 where it can't reach the threshold.

    An alignment that reaches it leaves so few shingles unmatched that matches lie within a band
    around the diagonal; in it, the longest increasing run of matched places is the best alignment.
    """
    la, lb = len(a), len(b)
    need = int(np.ceil(threshold / (1 + threshold) * (la + lb) - 1e-9))
    if min(la, lb) < need:
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = np.abs(ia - ib) <= max(la, lb) - need
    if band.sum() < need:
        return 0.0
    places = ib[band][np.argsort(ia[band], kind="stable")]
    if (np.diff(places) > 0).all():
        n = len(places)
    else:
        tails: list[int] = []
        for p in places.tolist():
            k = bisect_left(tails, p)
            tails[k : k + 1] = [p]
        n = len(tails)
    value = n / (la + lb - n)
    return value if value >= threshold else 0.0


def _sketches(docs: DataFrame, sketches: int, size: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"].tolist(), batch["text"].tolist(), strict=True):
                words = WORD.findall(text.lower())
                whole = xxhash.xxh128_intdigest((" ".join(words) if words else text).encode("utf-8", "surrogatepass"))
                keys = keys_of(shingler.of(words), sketches, size) if words else []
                rows.append((key, (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63), keys))
            yield pd.DataFrame(rows, columns=["id", "d1", "d2", "keys"])

    return docs.mapInPandas(run, "id long, d1 long, d2 long, keys array<long>")


def _shingles(docs: DataFrame) -> DataFrame:
    """(id, n, shingles, keys): shingle hashes in text order for the alignment, and the sketches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            own = [shingler.of(WORD.findall(t.lower())).astype("<u8") for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "n": [len(s) for s in own], "shingles": [s.tobytes() for s in own], "keys": batch["keys"]})

    return docs.mapInPandas(run, "id long, n int, shingles binary, keys array<long>")


def _verified(edges: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """Of (src, dst) edges those that the alignment confirms."""
    left = shingles.select(F.col("id").alias("src"), F.col("n").alias("n1"), F.col("shingles").alias("s1"))
    right = shingles.select(F.col("id").alias("dst"), F.col("n").alias("n2"), F.col("shingles").alias("s2"))
    fitting = edges.join(left, "src").join(right, "dst").where(F.least("n1", "n2") >= threshold * F.greatest("n1", "n2"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [aligned(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), threshold) > 0 for a, b in zip(batch["s1"], batch["s2"], strict=True)]
            yield batch.loc[good, ["src", "dst"]]

    return fitting.select("src", "dst", "s1", "s2").mapInPandas(run, "src long, dst long")


def _join_block(group: pd.DataFrame, threshold: float, between: bool, sketches: int) -> pd.DataFrame:
    """Links of one block, as a forest: pairs already in one component aren't compared, nor those without a common sketch.

    `between`: both sides are the same kind of row, and each pair is compared one way round.
    """
    root = {c: c for c in group["component"]}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    ids, components, outside = group["id"].tolist(), group["component"].tolist(), group["outsider"].to_numpy()
    arrays = [np.frombuffer(s, "<u8") for s in group["shingles"]]
    keys = aligned_keys(group["keys"].tolist(), [len(a) for a in arrays], sketches)
    members = np.flatnonzero(~outside)
    links = []
    for i in np.flatnonzero(outside):
        for j in members[((keys[members] == keys[i]) & (keys[i] != 0)).any(1)]:
            if between and ids[i] >= ids[j]:
                continue
            a, b = find(components[i]), find(components[j])
            if a != b and aligned(arrays[i], arrays[j], threshold) > 0:
                root[a] = b
                links.append((ids[i], ids[j]))
    return pd.DataFrame(links, columns=["src", "dst"]).astype("int64")


def _sized(inner: DataFrame, outer: DataFrame, at: str, block: int) -> DataFrame:
    """(at, inner, outer, repeats): how many blocks of about `block` rows the two sides of each `at` are, and into how many pairs of blocks a row of it goes on average."""
    size = lambda rows, name: rows.groupBy(at).agg(F.count("*").alias(f"{name}_rows"), F.ceil(F.count("*") / block).cast("int").alias(name))
    repeats = F.expr("(inner_rows * outer + outer_rows * inner) / (inner_rows + outer_rows)")
    return size(inner, "inner").join(size(outer, "outer"), at).select(at, "inner", "outer", repeats.alias("repeats"))


def _searched(inner: DataFrame, outer: DataFrame, at: str, blocks: DataFrame, shingles: DataFrame, threshold: float, between: bool, sketches: int) -> DataFrame:
    """Links between `inner` and `outer` rows (at, id, component) of equal `at`, in pairs of the `blocks` that each side is dealt into."""
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = inner.join(blocks, at).select(at, "id", "component", deal("inner").alias("b"), every("outer").alias("c"), F.lit(False).alias("outsider"))
    right = outer.join(blocks, at).select(at, "id", "component", every("inner").alias("b"), deal("outer").alias("c"), F.lit(True).alias("outsider"))
    rows = left.unionByName(right).join(shingles.select("id", "shingles", "keys"), "id")
    groups = rows.select("id", "component", "outsider", "shingles", "keys", F.struct(at, "b", "c").alias("at"))
    return groups.groupBy("at").applyInPandas(lambda g: _join_block(g, threshold, between, sketches), "src long, dst long")


def _opened(placed: DataFrame, tested: DataFrame) -> DataFrame:
    """Rows (key, id, component, main, parts) of the keys that hold several components; a key of one pair that was compared already is left out.

    `main` is the key's largest component, `parts` the number of its components.
    """
    counted = placed.groupBy("key", "component").agg(F.count("*").alias("c"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    mixed = counted.groupBy("key").agg(F.max(F.struct("c", "component")).alias("largest"), F.sum("c").alias("n"), F.count("*").alias("parts"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("parts > 1")
    mixed = stage(mixed.join(tested, ["lo", "hi", "n"], "left_anti").select("key", F.col("largest.component").alias("main"), "parts"), "mixed")
    return stage(placed.join(mixed, "key").select("key", "id", "component", "main", "parts"), "open")


#: Counters of shingles, by hash: as many whatever the corpus.
COUNTERS = 1 << 20


def shingle_counts(held: DataFrame) -> np.ndarray:
    """For each counter the number of times that its shingles occur in `held` texts: at least the number of texts that hold any one of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            own += np.bincount((np.frombuffer(b"".join(batch["shingles"]), "<u8") % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(own)
        yield pd.DataFrame({"slot": at, "n": own[at]})

    summed = held.select("shingles").mapInPandas(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, dtype=np.int64)
    counts[summed["slot"].to_numpy()] = summed["n"].to_numpy()
    return counts


def rare_prefix(shingles: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    """Those of a text's rarest shingles of which any similar text has one among its own rarest.

    All texts rank shingles by counter and then by hash. A similar text shares at least `threshold`
    of this text's shingles, so it can't lack all of the first n - ceil(threshold * n) + 1. What
    no other text holds is left out.
    """
    n = counts[(shingles % np.uint64(COUNTERS)).astype(np.int64)]
    first = np.lexsort((shingles, n))[: len(shingles) - int(np.ceil(threshold * len(shingles) - 1e-9)) + 1]
    return shingles[first[n[first] > 1]]


def _by_rare_shingle(held: DataFrame, threshold: float) -> DataFrame:
    """(key, id, component): `held` texts by the shingles of their rare_prefix(), where these bring several components together.

    Any two similar texts meet in a key. Shingles that bring the same texts together are one key.
    """
    counts = shingle_counts(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rare = [rare_prefix(np.frombuffer(s, "<u8"), counts, threshold).view("<i8") for s in batch["shingles"]]
            sizes = [len(r) for r in rare]
            yield pd.DataFrame({"key": np.concatenate(rare), "id": np.repeat(batch["id"], sizes), "component": np.repeat(batch["component"], sizes)})

    rare = stage(held.mapInPandas(run, "key long, id long, component long"), "rare")
    several = rare.groupBy("key").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("component").alias("a"), F.max("component").alias("b")
    )
    different = stage(several.where("a <> b").groupBy("n", "x", "lo", "hi").agg(F.min("key").alias("key")), "buckets")
    return stage(rare.join(different.select("key"), "key"), "placed")


def classes(docs: DataFrame, threshold: float = 0.8, sketches: int = 20, size: int = 4, block: int = 256, repeats: int = 32, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, exact_id, class_id, kept), one row for each input row.

    class_id is the least id of the texts that links of at least `threshold` connect, exact_id the
    least id whose words are the same in the same order; kept marks the row whose id is class_id.
    Words are lower-cased runs of letters and digits; texts of fewer than five are one shingle. A
    text without words is compared with equal texts only. Null and empty texts and null ids are
    classes of their own. Rows with one id count as one document: their classes are one.

    Equal texts are one row from the start. Of the texts that share sketches, each is first held
    against the one text of its buckets that shares most sketches with others; buckets that still
    hold several components are then searched, each member outside the bucket's largest component
    against all of that component that shares a sketch with it, and these members among each other.
    A large group of copies thus costs a comparison a text. Both sides are dealt into blocks of about
    `block` rows, but where a row would go into more than `repeats` pairs of blocks, as where many
    texts hold one passage, texts meet by the rarest of their shingles instead, of which similar
    texts must share one whatever the sketches (rare_prefix): a row then has one key for about every
    fifth of its shingles at most, and texts alike in a passage only don't meet. Either way all similar
    pairs of a bucket that are in different components are compared, and no bucket meets in one task:
    what is known of a key is one row, written before rows meet it, so that adaptive execution can
    split a hot key's rows.

    A pair of exactly 0.8 shares no sketch with a chance near 3e-5 (1e-8 for up to 32 shingles).
    `threshold` must be over a half, which texts of one shingle and the kinds of sketches rely on.
    Texts of any length are compared whole; further columns, whatever their names, are ignored. An
    empty table gives no rows.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("threshold must be over 0.5 and at most 1")
    given = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    usable = F.col("id").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "")
    sketched = stage(_sketches(given.where(usable), sketches, size), "sketches")
    texts = stage(sketched.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.min_by("keys", "id").alias("keys")), "texts")

    exploded = texts.select("id", F.explode("keys").alias("key"))
    buckets = exploded.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("n > 1")
    # sketches that bring the same texts together are one bucket
    different = stage(buckets.groupBy("n", "x", "lo", "hi").agg(F.min("key").alias("key")), "buckets")
    members = stage(exploded.join(different.select("key", "n"), "key"), "members")

    shared = members.groupBy("id").agg(F.sum("n").alias("shared"))
    ranked = members.join(shared, "id").select("key", "id", "n", F.struct("shared", (-F.col("id")).alias("minus")).alias("rank"))
    centres = stage(ranked.groupBy("key").agg(F.max("rank").alias("centre")), "centres")
    nearest = members.join(centres, "key").groupBy("id").agg(F.max("centre").alias("centre"))
    edges = stage(nearest.select(F.col("id").alias("src"), (-F.col("centre.minus")).alias("dst")).where("src <> dst"), "candidates")

    # the texts of candidates, by a shuffle at every size: candidates grow with the corpus
    wanted = texts.select("id", "keys").join(shared.select("id"), "id")
    shingles = stage(_shingles(given.where(usable).join(wanted.hint("merge"), "id")), "shingles")
    first = stage(_verified(edges, shingles, threshold), "links")
    parts = connected_components(first)

    placed = members.join(parts.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    placed = stage(placed, "placed")
    # two texts that were compared already
    tested = edges.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), F.lit(2).cast("long").alias("n"))
    opened = _opened(placed, tested)
    # against the largest components: whatever buckets a text and a component meet in, they meet in one search
    near = opened.where("component = main").select("main", "id", "component").distinct()
    far = opened.where("component <> main").select("main", "id", "component").distinct()
    # among the others of a bucket
    others = opened.where("component <> main and parts > 2").select("key", "id", "component")
    sides, crowds = stage(_sized(near, far, "main", block), "sides"), stage(_sized(others, others, "key", block), "crowds")
    # where rows would be repeated for too many blocks, texts meet by rare shingles instead
    plain = F.col("repeats") <= repeats
    links = _searched(near, far, "main", sides.where(plain), shingles, threshold, False, sketches).unionByName(
        _searched(others, others, "key", crowds.where(plain), shingles, threshold, True, sketches)
    )
    second = stage(links, "links")
    hot_sides, hot_crowds = sides.where(~plain).select("main"), crowds.where(~plain).select("key")
    met = [rows.join(hot, at).select("id", "component") for rows, hot, at in ((near, hot_sides, "main"), (far, hot_sides, "main"), (others, hot_crowds, "key"))]
    hot = stage(met[0].unionByName(met[1]).unionByName(met[2]).distinct(), "hot")
    if not hot.isEmpty():
        held = stage(shingles.select("id", "shingles").join(hot, "id"), "hot-shingles")
        again = _opened(_by_rare_shingle(held, threshold), tested)
        inside = again.where("component = main").select("key", "id", "component")
        outside = again.where("component <> main").select("key", "id", "component")
        rest = again.where("component <> main and parts > 2").select("key", "id", "component")
        further = _searched(inside, outside, "key", _sized(inside, outside, "key", block), shingles, threshold, False, sketches).unionByName(
            _searched(rest, rest, "key", _sized(rest, rest, "key", block), shingles, threshold, True, sketches)
        )
        second = second.unionByName(stage(further, "links"))
    final = joined_components(parts, second)

    named = texts.select("d1", "d2", F.col("id").alias("exact_id")).join(final.select(F.col("node").alias("exact_id"), "component"), "exact_id", "left")
    known = sketched.select("id", "d1", "d2").join(named, ["d1", "d2"]).select("id", "exact_id", F.coalesce("component", "exact_id").alias("class_id"))
    rest = given.where(~usable | F.col("id").isNull()).select("id", F.col("id").alias("exact_id"), F.col("id").alias("class_id"))
    return known.unionByName(rest).select(F.col("id").alias("doc_id"), "exact_id", "class_id", (F.col("id").isNull() | (F.col("id") == F.col("class_id"))).alias("kept"))
