"""Language identification by unigram pieces, summed over all segmentations.

A fixed public vocabulary gives the pieces. Each language has a probability for every piece; a
word's probability is the sum over all ways to cut it into pieces, found by a forward pass. Pieces
never cross words, so a text's probability is the product over its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import stage, unused

UND = "und"
#: Runs of letters (numerals of the kinds No and Nl also match and are sorted out later).
RUN = re.compile(r"[^\W\d_]+")


def load_pieces(model_file: str) -> dict[str, int]:
    """Ordinary pieces of a sentencepiece vocabulary, lower-cased; `▁` marks a word's start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found: dict[str, int] = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)):
            found.setdefault(sp.id_to_piece(i).lower(), len(found))
    return found


def beginnings(pieces: dict[str, int]) -> dict[str, int]:
    """Every beginning of a piece, with the piece's number where it is one itself, else -1."""
    found = {p[:n]: -1 for p in pieces for n in range(1, len(p))}
    return found | pieces


def edges_of(word: str, known: dict[str, int], unknown: int) -> list[int]:
    """All segmentation edges of a word and its start mark, one number each: 18 bits of piece, 8 of its length, the rest the start.

    A single character outside the vocabulary is an edge of the piece `unknown`, which stands for all
    such characters. `known` has the beginnings of pieces, so that a stretch is followed only as long
    as a piece may go on.
    """
    get = known.get
    edges: list[int] = []
    add = edges.append
    w = "▁" + word
    n = len(w)
    for a in range(n):
        at = a << 26
        p = get(w[a])
        add(at | 1 << 18 | (unknown if p is None or p < 0 else p))
        if p is None:
            continue
        for b in range(a + 2, n + 1):
            p = get(w[a:b])
            if p is None:
                break
            if p >= 0:
                add(at | (b - a) << 18 | p)
    return edges


def of_like_length(words: list[str], cells: int = 400_000) -> Iterator[list[int]]:
    """Places of words, shortest first, in groups whose number times the longest word stays bounded; a longer word is a group of its own."""
    group: list[int] = []
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        if group and (len(group) + 1) * (len(words[i]) + 2) > cells:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def summed_log(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log of the sums of exponentials of stretches of rows; `first` has where each stretch begins."""
    top = np.maximum.reduceat(x, first)
    sizes = np.diff(np.append(first, len(x)))
    return top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, sizes, axis=0)), first))


class Lattices:
    """All segmentation edges of some words, taken up by the position where they end.

    Sums are kept as logarithms, each taken around its largest term, so that words of any length and
    pieces of any probability stay in the range of doubles.
    """

    def __init__(self, words: list[str], known: dict[str, int], unknown: int):
        edges = [edges_of(w, known, unknown) for w in words]
        e = np.array([x for own in edges for x in own], dtype=np.int64)
        self.word = np.repeat(np.arange(len(words)), [len(own) for own in edges])
        self.start, self.piece = e >> 26, e & (1 << 18) - 1
        self.end = self.start + (e >> 18 & 255)
        self.lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
        self.last = int(self.lengths.max(initial=0))

    def steps(self, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each position in `at` in turn: the edges there, a word's together, and where each word begins."""
        order = np.lexsort((self.word, at))
        cuts = np.searchsorted(at[order], np.arange(self.last + 2))
        for b in range(self.last + 1):
            own = order[cuts[b] : cuts[b + 1]]
            if len(own):
                word = self.word[own]
                yield b, own, np.flatnonzero(np.append(True, word[1:] != word[:-1]))

    def forward(self, log_p: np.ndarray) -> np.ndarray:
        """alpha[word, position, language]: log probability of the word up to there."""
        alpha = np.zeros((len(self.lengths), self.last + 1, log_p.shape[1]))
        for b, own, first in self.steps(self.end):
            alpha[self.word[own[first]], b] = summed_log(alpha[self.word[own], self.start[own]] + log_p[self.piece[own]], first)
        return alpha

    def log_probability(self, log_p: np.ndarray) -> np.ndarray:
        return self.forward(log_p)[np.arange(len(self.lengths)), self.lengths]

    def expected(self, log_p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected piece counts of one language, over all segmentations (forward and backward)."""
        log_p = log_p[:, None]
        alpha = self.forward(log_p)[:, :, 0]
        at = np.arange(len(self.lengths))
        beta = np.zeros((len(self.lengths), self.last + 1, 1))
        for a, own, first in reversed(list(self.steps(self.start))):
            beta[self.word[own[first]], a] = summed_log(beta[self.word[own], self.end[own]] + log_p[self.piece[own]], first)
        share = alpha[self.word, self.start] + log_p[self.piece, 0] + beta[self.word, self.end, 0] - alpha[at, self.lengths][self.word]
        return np.bincount(self.piece, counts[self.word] * np.exp(share), minlength=len(log_p))


def expected_counts(words: list[str], counts: np.ndarray, known: dict[str, int], probabilities: np.ndarray) -> np.ndarray:
    """Expected piece counts of words of any length in one language."""
    total, log_p = np.zeros(len(probabilities)), np.log(probabilities)
    for group in of_like_length(words):
        total += Lattices([words[i] for i in group], known, len(probabilities) - 1).expected(log_p, counts[group])
    return total


class Identifier:
    """Piece probabilities of each language; picklable, bounded by vocabulary times languages."""

    def __init__(self, pieces: dict[str, int], languages: list[str], probabilities: np.ndarray):
        self.pieces, self.languages, self.probabilities = pieces, languages, probabilities
        self.known, self.log_p = beginnings(pieces), np.log(probabilities)

    def words(self, words: list[str]) -> np.ndarray:
        """log P(word | language), one row a word; words that hold no letter have zeros."""
        out = np.zeros((len(words), len(self.languages)))
        lettered = [i for i, w in enumerate(words) if any(map(str.isalpha, w))]
        for group in of_like_length([words[i] for i in lettered], 1_600_000 // len(self.languages)):
            own = [lettered[i] for i in group]
            out[own] = Lattices([words[i] for i in own], self.known, len(self.pieces)).log_probability(self.log_p)
        return out


class Scorer:
    """Scores texts with a bounded table of word vectors; runs inside a task."""

    def __init__(self, model: Identifier, table_size: int = 200_000):
        self.model, self.size = model, table_size
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.vectors = np.zeros((1024, len(self.model.languages)))
        self.letters = np.zeros(1024, dtype=bool)

    def learn(self, new: list[str]) -> None:
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            n = len(self.slot)
            if n + len(part) > len(self.vectors):
                grow = max(len(self.vectors) * 2, n + len(part))
                self.vectors = np.concatenate([self.vectors, np.zeros((grow - len(self.vectors), self.vectors.shape[1]))])
                self.letters = np.concatenate([self.letters, np.zeros(grow - len(self.letters), dtype=bool)])
            self.vectors[n : n + len(part)] = self.model.words(part)
            self.letters[n : n + len(part)] = [any(map(str.isalpha, w)) for w in part]
            self.slot.update(zip(part, range(n, n + len(part)), strict=True))

    def batch(self, texts: list[str]) -> list[tuple[str, float]]:
        runs = [RUN.findall(t.lower()) for t in texts]
        new = set().union(*runs).difference(self.slot)
        if len(self.slot) + len(new) > self.size:
            self.clear()
            new = set().union(*runs)
        self.learn(sorted(new))
        out = []
        for words in runs:
            at = np.fromiter(map(self.slot.__getitem__, words), dtype=np.int64, count=len(words))
            if not self.letters[at].any():
                out.append((UND, 0.0))
                continue
            total = self.vectors[at].sum(0)
            best = int(np.argmax(total))
            out.append((self.model.languages[best], float(1.0 / np.exp(total - total[best]).sum())))
        return out


def fit(labelled: DataFrame, vocabulary: str, max_documents_per_language: int = 150, rounds: int = 3, smoothing: float = 0.1) -> Identifier:
    """From (text, lang) rows; null languages, null texts and texts without letters teach nothing.

    A classifier fitted on a bounded sample: for each language about `max_documents_per_language`
    different texts with the least hashes, however often each is there (all of them where there are
    no more), and every word of these, of any length. Each round of expectation maximisation is a
    Spark job over the counted words; a task gives one sum for each piece and language, and only
    their totals, bounded by vocabulary times languages, reach the driver.
    """
    rows = labelled.select("lang", "text").where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}")).withColumn("hash", F.xxhash64("text"))
    sizes = {r["lang"]: r["n"] for r in rows.select("lang", "hash").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(-1.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, max_documents_per_language / n).otherwise(share)
    place = (F.shiftrightunsigned("hash", 11) / F.lit(float(2**53))).cast("double")
    texts = rows.where(place < share).groupBy("lang", "hash").agg(F.first("text").alias("text"))
    words = texts.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counted = stage(words.groupBy("lang", "word").count(), "words")
    pieces = load_pieces(vocabulary)
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    place_of, known = {lang: k for k, lang in enumerate(languages)}, beginnings(pieces)
    table = np.full((len(pieces) + 1, max(1, len(languages))), 1.0 / (len(pieces) + 1))
    spark = labelled.sparkSession
    dealt = counted.repartition(spark.sparkContext.defaultParallelism, "lang", "word")
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast((known, table))

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own_known, own = shared.value  # noqa: B023
            total = np.zeros_like(own)
            for batch in batches:
                for lang, part in batch.groupby("lang"):
                    k = place_of[lang]
                    for lo in range(0, len(part), 5000):
                        some = part.iloc[lo : lo + 5000]
                        total[:, k] += expected_counts([w.lower() for w in some["word"]], some["count"].to_numpy(dtype=float), own_known, np.ascontiguousarray(own[:, k]))
            piece, language = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "language": language, "n": total[piece, language]})

        sums = dealt.mapInPandas(expect, "piece long, language long, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        seen = np.full_like(table, smoothing)
        np.add.at(seen, (sums["piece"].to_numpy(), sums["language"].to_numpy()), sums["n"].to_numpy())
        table = seen / seen.sum(0)
        shared.unpersist()
    return Identifier(pieces, languages or [UND], table)


def identify(docs: DataFrame, model: Identifier, text: str = "text") -> DataFrame:
    """All columns of `docs` plus `lang_pred` and `score`, the posterior under equal priors.

    `und` with score 0 for texts that are null or hold no letter. Columns of these two names are
    replaced, others stay whatever their names. Equal texts get equal results; ties go to the first
    language in order. Texts and words of any length count whole; an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded: vocabulary size times languages
    kept = docs.drop("lang_pred", "score")
    names = kept.columns

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            own = ["" if t is None else t for t in texts.tolist()]
            rows = [row for lo in range(0, len(own), 128) for row in scorer.batch(own[lo : lo + 128])]
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    judged = unused(kept, "judged")
    return kept.withColumn(judged, judge(F.col(text))).select(*names, F.col(judged)["lang_pred"].alias("lang_pred"), F.col(judged)["score"].alias("score"))
