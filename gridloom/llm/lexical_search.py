"""Ranked lexical search by bag deduplication.

Documents are cut down to the words that items ask for. Documents with equal bags (the same words,
each as often) and an equal length factor score alike for every item, so each such class is scored
once, and its members are put in its place at the end, by ascending id. All arithmetic but the
logarithm of a word's weight is in 64-bit integers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import stage

#: A term: letters and digits of ASCII, and anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERMS = re.compile(TERM)
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Constants of the score: one unit of weight and of term frequency, and how much a text's length counts (of 100).
UNIT, TF_UNIT, LENGTH_SHARE = 1000, 1_000_000_000, 90


def terms_of(text: str | None) -> list[str]:
    """Terms in order; only A to Z are lower-cased."""
    return TERMS.findall(text.translate(LOWER)) if text else []


@dataclass
class Block:
    """Some items and the words that they ask for; bounded by search()'s `block_terms`."""

    items: list
    vocabulary: dict[str, int]
    #: Items that ask for word k are asked[first[k] : first[k + 1]], as places in `items`.
    first: np.ndarray
    asked: np.ndarray

    @classmethod
    def of(cls, wanted: list[tuple]) -> Block:
        """From (item, term) pairs, each once."""
        items = sorted({item for item, _ in wanted})
        place = {item: k for k, item in enumerate(items)}
        by_term: dict[str, list[int]] = {}
        for item, term in sorted(wanted, key=lambda x: (x[1], place[x[0]])):
            by_term.setdefault(term, []).append(place[item])
        first = np.cumsum([0, *map(len, by_term.values())])
        return cls(items, {t: k for k, t in enumerate(by_term)}, first, np.array([i for own in by_term.values() for i in own], dtype=np.int64))


def bags(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, n, bag): each document's number of terms, and its bag over the vocabulary.

    A bag is a run of pairs of little-endian unsigned 32-bit numbers, word and occurrences, by
    ascending word; it is empty where no word is asked for. Null texts have no terms.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded, see search()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sizes, out = [], []
            for text in batch.column("text").to_pylist():
                found = terms_of(text)
                sizes.append(len(found))
                counted = Counter(found)
                own = sorted((known[t], counted[t]) for t in counted.keys() & known.keys())
                out.append(np.array(own, dtype="<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n", "bag"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, n long, bag binary")


def opened(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, occurrences) of all bags of a column."""
    raw = [b.as_buffer() for b in column]
    rows = np.repeat(np.arange(len(raw)), [b.size // 8 for b in raw])
    pairs = np.frombuffer(b"".join(raw), dtype="<u4").reshape(-1, 2)
    return rows, pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)


def document_frequencies(classes: DataFrame, words: int) -> np.ndarray:
    """Documents that hold each word: class sizes summed in tasks, so that a task gives one number a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(words, dtype=np.int64)
        for batch in batches:
            row, word, _ = opened(batch.column("bag"))
            np.add.at(total, word, batch.column("members").to_numpy()[row])
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["word", "df"])

    found = classes.select("bag", "members").mapInArrow(count, "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(words, dtype=np.int64)  # at most a row a word of the block
    out[found["word"].to_numpy()] = found["df"].to_numpy()
    return out


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(UNIT * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], dtype=np.int64)


def sums_by_cell(cells: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """64-bit integer sums of values by cell: halves of 26 bits, so that sums of doubles are exact."""
    low, high = values & (1 << 26) - 1, values >> 26
    total = lambda v: np.bincount(cells, v, minlength=size).astype(np.int64)
    return (total(high) << 26) + total(low)


def scored(bag: pa.Array, m: np.ndarray, block: Block, weight: np.ndarray) -> np.ndarray:
    """score[class, item]: sums over the words that both have."""
    row, word, tf = opened(bag)
    own = weight[word] * ((TF_UNIT * tf) // (UNIT * tf + 8 * m[row]))
    fan = block.first[word + 1] - block.first[word]
    # each word of a class meets the items that ask for it
    at = np.repeat(block.first[word] - np.concatenate([[0], np.cumsum(fan)[:-1]]), fan) + np.arange(fan.sum())
    cells = np.repeat(row, fan) * len(block.items) + block.asked[at]
    return sums_by_cell(cells, np.repeat(own, fan), len(m) * len(block.items)).reshape(len(m), len(block.items))


class Best:
    """The best classes of each item so far: at most `k` an item, by score and then the least member."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.rows = pd.DataFrame({"item": [], "score": [], "least": [], "absent": [], "h": [], "m": [], "bag": []})
        self.floor = np.zeros(items, dtype=np.int64)

    def add(self, score: np.ndarray, least: np.ndarray, absent: np.ndarray, h: np.ndarray, m: np.ndarray, bag: pa.Array) -> None:
        row, item = np.nonzero((score > 0) & (score >= self.floor))
        if not len(row):
            return
        new = pd.DataFrame({"item": item, "score": score[row, item], "least": least[row], "absent": absent[row], "h": h[row], "m": m[row], "row": row})
        both = pd.concat([self.rows.assign(row=-1), new], ignore_index=True) if len(self.rows) else new
        both = both.sort_values(["item", "score", "absent", "least"], ascending=[True, False, True, True], kind="stable").groupby("item", sort=False).head(self.k)
        fresh = both["row"].to_numpy()
        own = both["bag"].tolist() if "bag" in both else [None] * len(both)
        both["bag"] = [b if r < 0 else bag[r].as_py() for b, r in zip(own, fresh.tolist(), strict=True)]
        self.rows = both.drop(columns="row")
        size = self.rows.groupby("item")["score"].agg(["size", "min"])
        full = size[size["size"] == self.k]
        self.floor[full.index.to_numpy(dtype=np.int64)] = full["min"].to_numpy()


def best_classes(classes: DataFrame, block: Block, weight: np.ndarray, k: int) -> DataFrame:
    """(item, score, least, h, m, bag) of each item's `k` best classes: the best of a task first, then those of all tasks."""
    shared = classes.sparkSession.sparkContext.broadcast((block, weight))  # bounded, see search()
    step = max(1, 2_000_000 // max(1, len(block.asked)))  # a class meets each of these once at most

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight_of = shared.value
        best = Best(len(own.items), k)
        for batch in batches:
            for lo in range(0, len(batch), step):
                part = batch.slice(lo, step)
                m, least = part.column("m").to_numpy(), part.column("least")
                absent = np.array(least.is_null().to_numpy(zero_copy_only=False))
                best.add(scored(part.column("bag"), m, own, weight_of), least.fill_null(0).to_numpy(), absent, part.column("h").to_numpy(), m, part.column("bag"))
        rows = best.rows
        least = pa.array(rows["least"].astype("int64"), pa.int64(), mask=rows["absent"].to_numpy(dtype=bool))
        numbers = [pa.array(rows[c].astype("int64"), pa.int64()) for c in ("item", "score", "h", "m")]
        yield pa.RecordBatch.from_arrays([*numbers[:2], least, *numbers[2:], pa.array(rows["bag"].tolist(), pa.binary())], names=["item", "score", "least", "h", "m", "bag"])

    found = classes.select("least", "h", "m", "bag").mapInArrow(judge, "item long, score long, least long, h long, m long, bag binary")
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("least"), "h", "m", "bag"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place", "least")


def ranked(cut: DataFrame, block: Block, documents: int, terms: int, k: int) -> DataFrame:
    """(item, rank, doc_id, score) of one block over the written table of bags()."""
    factor = F.lit(100 - LENGTH_SHARE).cast("long") + F.call_function("div", F.lit(LENGTH_SHARE).cast("long") * F.col("n") * F.lit(documents), F.lit(terms).cast("long"))
    rows = cut.where(F.octet_length("bag") > 0).select("doc_id", factor.alias("m"), "bag").withColumn("h", F.xxhash64("m", "bag"))
    # equal hashes are not yet equal classes: factor and bag are part of the key
    classes = stage(rows.groupBy("h", "m", "bag").agg(F.count("*").alias("members"), F.min("doc_id").alias("least")), "classes")
    weight = weights(document_frequencies(classes, len(block.vocabulary)), documents)
    best = stage(best_classes(classes, block, weight, k), "best_classes")  # at most k rows an item of the block
    # members of these classes alone, and of each no more than k ids, limited before they are shuffled
    near = rows.join(F.broadcast(best.select("h").distinct()), "h", "left_semi")
    order = F.row_number().over(W.partitionBy("h", "m", "bag").orderBy(F.asc_nulls_last("doc_id")))
    members = near.withColumn("place", order).where(F.col("place") <= k).drop("place")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return members.join(best, ["h", "m", "bag"]).withColumn("rank", rank).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = 200_000) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `k` best documents with a score above 0, best first, equal scores by ascending doc_id.

    `docs` has doc_id and text, `items` has item_id and text; further columns are ignored, whatever
    their names. Null and empty texts and texts without terms have no score; they and documents that
    share no word with an item are in no result, though the latter count in the statistics. Each row
    of `docs` is a document: rows that repeat an id are ranked each, rows without id come last among
    equal scores. Rows that repeat an item_id are one item, which asks for the words of all its texts;
    rows without item_id are left out. Empty tables give no rows. Texts of any length count whole.

    Items are dealt by a hash into blocks of about `block_terms` item words, each with its own pass
    over the documents; what tasks hold of items is bounded by that and by the largest item. Shuffled are
    bags, once for each block, as classes with partial counts: copies are one row a task.
    """
    spark = docs.sparkSession
    split = F.udf(lambda text: sorted(set(terms_of(text))), "array<string>")
    wanted = stage(items.where("item_id is not null").select("item_id", F.explode(split("text")).alias("term")).distinct(), "item_terms")
    blocks = max(1, math.ceil(wanted.count() / block_terms))
    out = spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id long, score long")
    for number in range(blocks):
        pairs = [(r["item_id"], r["term"]) for r in wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).toLocalIterator()]
        if not pairs:
            continue
        block = Block.of(pairs)
        cut = stage(bags(docs, block.vocabulary), "bags")
        sizes = cut.where("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
        if sizes["documents"] == 0:
            return out
        names = spark.createDataFrame(list(enumerate(block.items)), f"item long, item_id {dict(items.dtypes)['item_id']}")
        found = ranked(cut, block, sizes["documents"], sizes["terms"], k)
        # at most k rows an item: written, so that the next block starts from a short plan
        out = out.unionByName(stage(found.join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
    return out
