"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy inside tasks.

Each word's embedding is the sum of two rows of hashed tables. Filters of several widths slide over
the whole text, their largest responses feed a logistic layer. Thresholds are set for each language,
and a text's language is itself guessed from its words alone.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import stage

WORD = re.compile(r"\w+")
#: Texts go through the filters in stretches of so many words, which overlap by the widest filter.
STRETCH = 50_000
#: Labelled ids of one shard, which one task trains on in turn.
SHARD_ROWS = 20_000
#: Steps to which logits are rounded where thresholds are set, so that what the driver holds is bounded.
LOGIT_STEPS = 1024
#: Changes of parameters are summed as whole numbers of this part, so that sums don't depend on their order.
CHANGE_STEPS = 1 << 24


class Hasher:
    """Two hashed slots for each word, kept in a bounded table."""

    def __init__(self, bits: int, table_size: int = 100_000):
        self.mask, self.size, self.table = (1 << bits) - 1, table_size, {}

    def slots(self, text: str | None) -> np.ndarray:
        """(words, 2) slots; a text without words has one row of slot 0, which stands for nothing."""
        words = WORD.findall(text.lower()) if text else []
        table, mask = self.table, self.mask
        if new := set(words).difference(table):
            if len(table) + len(new) > self.size:
                table.clear()
                new = set(words)
            for w in new:
                raw = w.encode("utf-8", "surrogatepass")
                a, b = zlib.crc32(raw), zlib.crc32(raw, 0x9E3779B9)
                # a multiplicative step makes the second slot differ even where checksums are related
                table[w] = (a & mask) << 32 | (b * 0x9E3779B97F4A7C15 >> 40) & mask
        packed = np.fromiter(map(table.__getitem__, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
        return np.stack([packed >> 32, packed & 0xFFFFFFFF], axis=1)


class Classifier:
    """Embedding tables, filters, output layer, language table and thresholds; bounded by its parameters."""

    def __init__(self, bits: int, size: int, widths: tuple[int, ...], filters: int, seed: int):
        rng = np.random.default_rng(seed)
        n = 1 << bits
        self.bits, self.widths = bits, widths
        self.one = rng.normal(0, 0.02, (n, size)).astype(np.float32)
        self.two = rng.normal(0, 0.02, (n, size)).astype(np.float32)
        self.kernels = [rng.normal(0, 0.3, (w, size, filters)).astype(np.float32) for w in widths]
        for k in self.kernels:  # half of the filters start by looking at the informed dimension
            k[:, 0, : filters // 2] = np.abs(k[:, 0, : filters // 2]) + 0.5
        self.bias = [np.zeros(filters, dtype=np.float32) for _ in widths]
        self.out = np.abs(rng.normal(0, 0.1, filters * len(widths))).astype(np.float32)
        self.offset = np.float32(-1.0)
        self.languages: list[str] = []
        self.words_of = np.zeros((n, 0), dtype=np.float32)
        self.thresholds: dict[str, float] = {}

    def responses(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of every filter over the text, and where its window starts."""
        x = self.one[slots[:, 0]] + self.two[slots[:, 1]]
        best, place = [], []
        for kernel, bias in zip(self.kernels, self.bias, strict=True):
            w = len(kernel)
            padded = x if len(x) >= w else np.concatenate([x, np.zeros((w - len(x), x.shape[1]), dtype=np.float32)])
            n = len(padded) - w + 1
            r = padded[:n] @ kernel[0]
            for j in range(1, w):
                r += padded[j : j + n] @ kernel[j]
            at = r.argmax(0)
            place.append(at)
            best.append(r[at, np.arange(r.shape[1])] + bias)
        return np.concatenate(best), np.concatenate(place)

    def strongest(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """responses() of a text of any length, stretch by stretch."""
        step = STRETCH - max(self.widths) + 1
        best, place = self.responses(slots[:STRETCH])
        for lo in range(step, len(slots) - max(self.widths) + 1, step):
            r, at = self.responses(slots[lo : lo + STRETCH])
            best, place = np.where(r > best, r, best), np.where(r > best, at + lo, place)
        return best, place

    def pooled(self, slots: np.ndarray) -> np.ndarray:
        return np.maximum(self.strongest(slots)[0], 0)

    def logit(self, slots: np.ndarray) -> float:
        return float(self.pooled(slots) @ self.out + self.offset)

    def language(self, slots: np.ndarray) -> str:
        return self.languages[int(self.words_of[slots[:, 0]].sum(0).argmax())] if self.languages else ""

    def score(self, slots: np.ndarray) -> float:
        """Probability, moved so that the threshold of the text's language lies at one half."""
        z = self.logit(slots) - self.thresholds.get(self.language(slots), self.thresholds.get("", 0.0))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def threshold(logits: np.ndarray, toxic: np.ndarray, rows: np.ndarray | int = 1) -> float:
    """The cut with the fewest errors; the middle of the widest gap among equal ones. 0 where one class is missing. `rows` tells how often each pair occurs."""
    if not len(logits) or toxic.min() == toxic.max():
        return 0.0
    z, at = np.unique(logits, return_inverse=True)
    bad, good = (np.bincount(at, weights=(toxic == k) * rows, minlength=len(z)) for k in (1, 0))
    # cutting before position i: positives below are missed, negatives at or above are false alarms
    errors = np.concatenate([[0], np.cumsum(bad)]) + np.concatenate([np.cumsum(good[::-1])[::-1], [0]])
    edges = np.concatenate([[z[0] - 2.0], z, [z[-1] + 2.0]])
    middles, gaps = (edges[:-1] + edges[1:]) / 2, np.diff(edges)
    best = np.flatnonzero(errors == errors.min())
    return float(middles[best[gaps[best].argmax()]])


def inform(model: Classifier, seen: list[np.ndarray]) -> list[np.ndarray]:
    """Sets the informed dimension of both tables, the shrunken log-odds of the documents that hold a slot; returns how far each slot may move.

    `seen` has for each table the clean and the toxic documents with each slot.
    """
    trust = []  # slots seen in few documents move little, lest they stand for single documents
    for own, table in zip(seen, (model.one, model.two), strict=True):
        prior = own.sum(1) / max(1.0, own.sum())
        odds = np.log((own[1] + 4 * prior[1] + 1e-3) / (prior[1] + 1e-3)) - np.log((own[0] + 4 * prior[0] + 1e-3) / (prior[0] + 1e-3))
        strength = own.sum(0) / (own.sum(0) + 5)
        table[:, 0] = np.clip(odds * strength * 0.25, -1, 1)
        trust.append((np.maximum(own.sum(0) - 5, 0) / (own.sum(0) + 30)).astype(np.float32)[:, None])
        table[:, 1:] *= trust[-1]
    return trust


def tell_languages(model: Classifier, words: dict[str, np.ndarray]) -> None:
    """Sets the language table from how often each slot of the first table occurs in each language."""
    model.languages = sorted(words)
    if words:
        counts = np.stack([words[name] for name in model.languages], axis=1) + 1.0
        model.words_of = np.log(counts / counts.sum(0)).astype(np.float32)


class Descent:
    """AdaGrad on log loss, in which a toxic text counts `weight` times; changes its model text by text."""

    def __init__(self, model: Classifier, trust: list[np.ndarray], rate: float, weight: float = 1.0):
        self.model, self.trust, self.rate, self.weight = model, trust, rate, weight
        self.squares = [np.full_like(k, 1e-2) for k in model.kernels]
        self.out_sq, self.off_sq = np.full_like(model.out, 1e-2), np.full(1, 1e-2)

    def dense(self) -> np.ndarray:
        """All but the tables as one array, sums of squares too."""
        m = self.model
        return np.concatenate([x.ravel().astype(np.float64) for x in (*m.kernels, *m.bias, m.out, np.array([m.offset]), *self.squares, self.out_sq, self.off_sq)])

    def set_dense(self, values: np.ndarray) -> None:
        m, offset, lo = self.model, np.zeros(1, dtype=np.float32), 0
        for x in (*m.kernels, *m.bias, m.out, offset, *self.squares, self.out_sq, self.off_sq):
            x[...] = values[lo : lo + x.size].reshape(x.shape)
            lo += x.size
        m.offset = offset[0]

    def step(self, s: np.ndarray, toxic: float) -> None:
        model, trust, rate = self.model, self.trust, self.rate
        r, place = model.strongest(s)
        h = np.maximum(r, 0)
        p = 1.0 / (1.0 + np.exp(-np.clip(h @ model.out + model.offset, -30, 30)))
        g = float(p - toxic)
        if abs(g) < 0.02:
            return
        if toxic:
            g *= self.weight
        back = g * model.out * (r > 0)
        gout = g * h + 1e-4 * model.out
        self.out_sq += gout * gout
        model.out -= rate * gout / np.sqrt(self.out_sq)
        self.off_sq += g * g
        model.offset -= np.float32(rate * g / np.sqrt(self.off_sq[0]))
        filters = len(model.out) // len(model.widths)
        for k, (kernel, width) in enumerate(zip(model.kernels, model.widths, strict=True)):
            own = slice(k * filters, (k + 1) * filters)
            live = np.flatnonzero(back[own])
            for j in range(width):
                at = place[own] + j
                ok = live[at[live] < len(s)]
                if not len(ok):
                    continue
                a, b = s[at[ok], 0], s[at[ok], 1]
                x = model.one[a] + model.two[b]
                gk = x * back[own][ok][:, None]
                self.squares[k][j][:, ok] += (gk * gk).T
                gx = kernel[j][:, ok].T * back[own][ok][:, None]
                kernel[j][:, ok] -= rate * gk.T / np.sqrt(self.squares[k][j][:, ok])
                np.add.at(model.one, a, -0.1 * rate * gx * trust[0][a])
                np.add.at(model.two, b, -0.1 * rate * gx * trust[1][b])
            model.bias[k] -= np.float32(0.1 * rate) * back[own]


def train(texts: list[str], toxic: np.ndarray, langs: list[str | None], bits: int = 17, size: int = 12, widths=(1, 2, 3), filters: int = 12, epochs: int = 3, rate: float = 0.05, seed: int = 7, min_language: int = 30) -> Classifier:
    """fit() of a few texts at hand, as one shard in a drawn order; a fifth of them is kept for the thresholds."""
    model, hasher = Classifier(bits, size, widths, filters, seed), Hasher(bits, table_size=10**9)
    slots = [hasher.slots(t) for t in texts]
    fold = np.arange(len(texts)) % 5 == 4
    learn = np.flatnonzero(~fold)
    seen, words = [np.zeros((2, 1 << bits)) for _ in range(2)], {}
    for i in learn:
        for column in range(2):
            seen[column][int(toxic[i]), np.unique(slots[i][:, column])] += 1
        if langs[i] is not None:
            np.add.at(words.setdefault(langs[i], np.zeros(1 << bits)), slots[i][:, 0], 1)
    descent = Descent(model, inform(model, seen), rate)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(learn):
            descent.step(slots[i], float(toxic[i]))
    tell_languages(model, words)
    logits = np.array([model.logit(s) for s in slots])
    spoken = np.array([model.language(s) for s in slots])
    set_thresholds(model, spoken[fold], logits[fold], toxic[fold], np.ones(fold.sum()), min_language)
    return model


def set_thresholds(model: Classifier, spoken: np.ndarray, logits: np.ndarray, toxic: np.ndarray, rows: np.ndarray, min_language: int) -> None:
    """Thresholds of all texts and of each language that has enough of them and both classes."""
    model.thresholds = {"": threshold(logits, toxic, rows)}
    for name in model.languages:
        own = spoken == name
        if rows[own].sum() >= min_language and toxic[own].min() < toxic[own].max():
            model.thresholds[name] = threshold(logits[own], toxic[own], rows[own])


def sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_characters: int) -> DataFrame:
    """(doc_id, text, lang, toxic) of at most `max_rows` documents, a third of them toxic where there are enough, for trials by train(); fit() takes all.

    The documents are those with the least hashes of their ids among those with a label, a text and at
    most `max_characters` characters; of a document with several labels the larger counts, of rows that
    repeat an id the first by text and language. Ids are picked first, so that texts of other rows never
    move, and repeated rows meet as partial minima.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    able = docs.where(F.col("doc_id").isNotNull() & (F.length("text") <= max_characters)).select("doc_id", "text", "lang")
    known = marks.join(able.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((0, max_rows - max_rows // 3), (1, max_rows // 3))]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most max_rows ids
    one = able.join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("row"))
    return one.select("doc_id", "row.text", "row.lang", "toxic")


def taught_rows(docs: DataFrame, labels: DataFrame, bits: int, shards: int) -> DataFrame:
    """(shard, kept, toxic, lang, slots) of every labelled document, written to the shared folder: whole texts as hashed words.

    Of a document with several labels the larger counts, of rows that repeat an id the one whose text has the
    least hash. Shards, their order and the fifth that is kept for thresholds follow from hashes of the
    id; a file holds one shard, so what is trained doesn't depend on where rows lay. Texts are hashed and
    packed before they move, and move once, whether labels are few or many.
    """
    return stage(dealt_rows(docs, labels, bits, shards), "taught")


def dealt_rows(docs: DataFrame, labels: DataFrame, bits: int, shards: int) -> DataFrame:
    """The rows of taught_rows(), a shard in each partition. One sort serves the windows and the order of training, so that a task holds its shard once."""
    marks = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    able = docs.where("doc_id is not null and text is not null").select("doc_id", "text", "lang")
    kept = F.pmod(F.xxhash64("doc_id", F.lit("kept")), F.lit(5)) == 4
    texts = able.select("doc_id", "lang", F.xxhash64("text").alias("first"), by_text(Packing(bits), "binary")("text").alias("slots"))
    # labels and texts meet as rows of one id, since a join may deal rows out anew, to other shards
    dealt = texts.unionByName(marks, allowMissingColumns=True).repartition(shards, "doc_id").withColumn("turn", F.xxhash64("doc_id", F.lit("order")))
    own = W.partitionBy("turn", "doc_id").orderBy(F.col("slots").isNull(), "first", "lang")
    whole = own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    known = dealt.select("doc_id", "turn", "lang", "slots", F.max("toxic").over(whole).alias("toxic"), F.row_number().over(own).alias("place"))
    ordered = known.where("place = 1 and slots is not null and toxic is not null").sortWithinPartitions("turn", "doc_id")
    return ordered.select(F.spark_partition_id().alias("shard"), kept.alias("kept"), "toxic", "lang", "slots")


def by_text(of_text: Callable, kind: str) -> Callable:
    """A function of text columns that reach Python some hundred at a time: Arrow's batches would hold 10,000 whole texts in each task, in Python and beside the heap."""
    return F.udf(of_text, kind, useArrow=False)


class Packing:
    """Hashed words of a text, packed; the table of words is made in the task."""

    def __init__(self, bits: int):
        self.bits, self.hasher = bits, None

    def __call__(self, text: str) -> bytes:
        self.hasher = self.hasher or Hasher(self.bits)
        return packed(self.hasher.slots(text))


class Judging:
    """Score of a text by a broadcast model; the table of words is made in the task."""

    def __init__(self, shared: Broadcast):
        self.shared, self.hasher = shared, None

    def __call__(self, text: str | None) -> float:
        model = self.shared.value
        self.hasher = self.hasher or Hasher(model.bits)
        return model.score(self.hasher.slots(text))


def packed(slots: np.ndarray) -> bytes:
    return zlib.compress(slots.astype(np.uint32).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=np.uint32).reshape(-1, 2).astype(np.int64)


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, str | None, np.ndarray]]:
    """(shard, toxic, lang, slots) of the rows of taught_rows()."""
    slots = batch.column("slots")
    for k, known in enumerate(zip(*[batch.column(c).to_pylist() for c in ("shard", "toxic", "lang")], strict=True)):
        yield *known, unpacked(slots[k].as_buffer())


def count_words(rows: DataFrame, bits: int) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    """For inform() and tell_languages(): documents of each class by slot, and words of each language by slot, of all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str | None], np.ndarray] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for (part, lang), n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.int32()), pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["part", "lang", "at", "n"])
            held.clear()

        zeros = lambda: np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for _, toxic, lang, s in texts_of(batch):
                for column in range(2):
                    held.setdefault((2 * column + toxic, None), zeros())[np.unique(s[:, column])] += 1
                if lang is not None:
                    np.add.at(held.setdefault((4, lang), zeros()), s[:, 0], 1)
                if len(held) > 100:
                    yield from given()
        yield from given()

    got = rows.mapInArrow(count, "part int, lang string, at int, n long").groupBy("part", "lang", "at").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    seen, words = [np.zeros((2, 1 << bits)) for _ in range(2)], {}
    for part in range(4):
        own = got[got["part"] == part]
        seen[part // 2][part % 2, own["at"].to_numpy()] = own["n"].to_numpy()
    for lang, own in got[got["part"] == 4].groupby("lang"):
        words[lang] = np.zeros(1 << bits)
        words[lang][own["at"].to_numpy()] = own["n"].to_numpy()
    return seen, words


def train_round(rows: DataFrame, descent: Descent) -> None:
    """One pass over all rows: every shard goes on from the same model, which then moves by the mean of their changes.

    The mean is weighted by texts; a row of a table moves by the mean of the shards that changed it, as
    most words are in few. Changes are summed by Spark; the driver gets one row for each row of the tables.
    """
    spark, size = rows.sparkSession, descent.model.one.shape[1]
    shared = spark.sparkContext.broadcast(descent)
    names = ["part", "at", "n", *[f"c{k}" for k in range(size)]]

    def changes(own: Descent, n: int) -> Iterator[pa.RecordBatch]:
        begun = shared.value
        moved = own.dense() - begun.dense()
        parts = [(2, np.arange(-(-len(moved) // size)), np.pad(moved, (0, -len(moved) % size)).reshape(-1, size))]
        for part, new, old in ((0, own.model.one, begun.model.one), (1, own.model.two, begun.model.two)):
            at = np.flatnonzero((new != old).any(1))
            parts.append((part, at, new[at].astype(np.float64) - old[at]))
        for part, at, change in parts:
            whole = np.rint(change * n * CHANGE_STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.int32()), pa.array(at.astype(np.int32)), pa.array([n] * len(at), pa.int64()), *[pa.array(whole[:, k]) for k in range(size)]], names=names)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, n = None, None, 0
        for batch in batches:
            for shard, toxic, _, s in texts_of(batch):
                if shard != at:
                    if own is not None:
                        yield from changes(own, n)
                    own, at, n = copy.deepcopy(shared.value), shard, 0
                own.step(s, float(toxic))
                n += 1
        if own is not None:
            yield from changes(own, n)

    given = rows.mapInArrow(learn, "part int, at int, " + ", ".join(f"{c} long" for c in names[2:]))
    got = given.groupBy("part", "at").agg(*[F.sum(c).alias(c) for c in names[2:]]).toArrow().to_pandas()
    shared.destroy()
    moved = got[names[3:]].to_numpy() / CHANGE_STEPS / got[["n"]].to_numpy()
    part, at = got["part"].to_numpy(), got["at"].to_numpy()
    for k, table in ((0, descent.model.one), (1, descent.model.two)):
        table[at[part == k]] += moved[part == k].astype(np.float32)
    dense = descent.dense()
    change = np.zeros(-(-len(dense) // size) * size).reshape(-1, size)
    change[at[part == 2]] = moved[part == 2]
    descent.set_dense(dense + change.ravel()[: len(dense)])


def judged(rows: DataFrame, model: Classifier) -> pd.DataFrame:
    """(spoken, z, toxic, n): how many of all rows have a guessed language, a logit in whole steps and a class."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [(own.language(s), round(max(-40.0, min(40.0, own.logit(s))) * LOGIT_STEPS), toxic) for _, toxic, _, s in texts_of(batch)]
            yield pa.RecordBatch.from_pylist([dict(zip(("spoken", "z", "toxic"), f, strict=True)) for f in found], pa.schema([("spoken", pa.string()), ("z", pa.int32()), ("toxic", pa.int32())]))

    got = rows.mapInArrow(judge, "spoken string, z int, toxic int").groupBy("spoken", "z", "toxic").agg(F.count("*").alias("n")).toArrow().to_pandas()
    shared.destroy()
    return got


def fit(docs: DataFrame, labels: DataFrame, bits: int = 17, size: int = 12, widths: tuple[int, ...] = (1, 2, 3), filters: int = 12, epochs: int = 3, rate: float = 0.15, seed: int = 7, min_language: int = 30, shard_rows: int = SHARD_ROWS) -> Classifier:
    """Fits on every labelled document and its whole text; null labels and null texts teach nothing.

    `docs` has doc_id, text and lang (lang only teaches which words mark a language, for the
    thresholds); `labels` has doc_id and toxic. Four fifths of the documents teach word counts and filters,
    the last fifth, by a hash of the id, sets the thresholds. All passes are Spark jobs; what the driver
    holds is bounded by the parameters and the number of languages.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id").distinct().count()
    if not known:
        return Classifier(4, 2, (1,), 2, 0)
    rows = taught_rows(docs, labels, bits, -(-known // shard_rows))
    teach, keep = rows.where("not kept"), rows.where("kept")
    if teach.isEmpty():
        return Classifier(4, 2, (1,), 2, 0)
    model = Classifier(bits, size, tuple(widths), filters, seed)
    seen, words = count_words(teach, bits)
    toxic = teach.agg(F.avg("toxic")).first()[0]
    weight = max(1.0, (1 - toxic) / toxic / 2) if toxic else 1.0  # as if a third of the texts were toxic
    descent = Descent(model, inform(model, seen), rate, weight)
    for _ in range(epochs):
        train_round(teach, descent)
    tell_languages(model, words)
    got = judged(keep, model)
    set_thresholds(model, got["spoken"].to_numpy(), got["z"].to_numpy() / LOGIT_STEPS, got["toxic"].to_numpy(), got["n"].to_numpy(), min_language)
    return model


def classify(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """All columns of `docs` plus score (0 to 1) and predicted (1 from 0.5 on); such columns are replaced.

    Null, empty and wordless texts get the score of a text whose only word is unknown. Very long
    texts are read whole, stretch by stretch. Equal texts score alike.
    """
    judge = by_text(Judging(docs.sparkSession.sparkContext.broadcast(model)), "double")  # bounded: see Classifier
    kept = docs.drop("score", "predicted")
    return kept.withColumn("score", judge(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
