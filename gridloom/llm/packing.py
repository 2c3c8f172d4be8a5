"""Sequence packing balanced by attention cost.

Documents become token ids inside tasks; each task packs what it reads in bounded buckets, so
there is no shuffle, no group grows with the data and a lost task repeats its own part only.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"

#: Pre-tokens of texts within Latin-1, for which normalisation is lower-casing: contractions, runs of
#: letters, single digits or numerals, runs of the rest. Letters and numerals as in Unicode's L and N.
LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
#: Characters that the two libraries' notions of white space don't share, as Latin-1.
ODD = bytes((*range(0x1C, 0x20), 0x85))


class Encoder:
    """Token ids of a text, equal to the tokenizer's own.

    Words between white space repeat, and no pre-token crosses white space, so the ids of words are kept in a
    bounded table, and only pre-tokens of new words go to the tokenizer. Words of the table before the
    last are taken over when met again, so frequent ones stay. Texts beyond Latin-1, with odd characters or
    with marks of special tokens are encoded whole.
    """

    def __init__(self, path: str, table_size: int = 250_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.table, self.former, self.table_size = Tokenizer.from_file(path), {}, {}, table_size
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for word, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends_word[i] = word.endswith("</w>")
        # pre-tokens come lower-cased and apart by spaces: nothing is left to normalise or to split but at these
        self.of_words = Tokenizer.from_file(path)
        self.of_words.normalizer = normalizers.Sequence([])
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def learn(self, words: list[str]) -> None:
        """Encodes new pre-tokens, apart by spaces; only the last token of each carries the word end."""
        ids = np.array(self.of_words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
        raw = ids.tobytes()
        if len(ends) == len(words):
            self.table.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(words, [0, *ends[:-1]], ends, strict=True))
        else:
            self.table.update((w, self.whole(w).tobytes()) for w in words)

    def add(self, words: set[str]) -> None:
        """Brings words into the table."""
        former, table = self.former, self.table
        for w in words:
            if w in former:
                table[w] = former[w]
        words = words.difference(table)
        cut = {w: LATIN.findall(w) for w in words if not w.isalpha()}
        if new := {p for own in cut.values() for p in own}.union(w for w in words if w not in cut).difference(table):
            self.learn(list(new))
        for w, own in cut.items():
            table[w] = b"".join(map(table.__getitem__, own))

    def text(self, text: str) -> np.ndarray:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        if "<|" in text or len(raw.translate(None, ODD)) < len(raw):
            return self.whole(text)
        words = text.lower().split()
        if len(self.table) > self.table_size:
            self.former, self.table = self.table, {}
        table = self.table
        known = list(map(table.get, words))
        if new := {w for w, ids in zip(words, known, strict=True) if ids is None}:
            if len(new) > self.table_size // 2:  # a giant text of its own
                return self.whole(text)
            self.add(new)
            known = [table[w] if ids is None else ids for w, ids in zip(words, known, strict=True)]
        return np.frombuffer(b"".join(known), dtype="<u4")

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        return [self.text(t) for t in texts]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of a Python worker, which goes on with the words of its earlier tasks."""
    return Encoder(path)


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[list[tuple[int, int]]]:
    """For each length, its parts as (sequence, length): descending lengths, each to the cheapest sequence with room.

    There are just as many sequences as the tokens need. Cost is linear * n + quadratic * n * n for
    each part of n tokens. Where no sequence has room for a whole length, it is cut: the cheapest
    sequence with any room takes what it can, and so on. Ties go to the first in order.
    """
    bins = max(1, -(-int(lengths.sum()) // capacity))
    cost, room = np.zeros(bins), np.full(bins, capacity)
    parts: list[list[tuple[int, int]]] = [[] for _ in lengths]
    for i in np.argsort(-lengths, kind="stable").tolist():
        left = int(lengths[i])
        while left:
            fits = np.flatnonzero(room >= left)
            if not len(fits):
                fits = np.flatnonzero(room > 0)
            b = int(fits[np.argmin(cost[fits])])
            n = min(left, int(room[b]))
            room[b] -= n
            cost[b] += linear * n + quadratic * n * n
            parts[i].append((b, n))
            left -= n
    return parts


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float | None = None, bucket: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document: where it starts, its checksum, its sequence and offset there.

    Attention cost of n tokens is linear * n + quadratic * n * n; the default quadratic weight makes
    both terms equal at a full sequence. A document's whole stretches of `capacity` tokens are
    sequences of their own; the rests of up to `bucket` documents are packed together, so padding is
    below `capacity` tokens a bucket. Null texts count as empty: the end token alone. Ids may repeat
    or be null; each row is packed. An empty table gives no rows. Extra columns are not carried.
    """
    square = 1.0 / capacity if quadratic is None else quadratic

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = encoder(tokenizer_path)
        base, used = TaskContext.get().partitionId() << 40, 0
        held: list[tuple] = []

        def rows(out):
            kinds = [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("cost", pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, (_, kind) in zip(zip(*out, strict=True), kinds, strict=True)], schema=pa.schema(kinds))

        def flush():
            nonlocal used
            parts = assign(np.array([len(h[2]) for h in held], dtype=np.int64), capacity, linear, square)
            filled: dict[int, int] = {}
            out = []
            for (key, start, ids, total), own in zip(held, parts, strict=True):
                at = 0
                for b, n in own:
                    off = filled.get(b, 0)
                    filled[b] = off + n
                    out.append((key, start + at, n, zlib.crc32(ids[at : at + n].tobytes()), total, base + used + b, off, linear * n + square * n * n))
                    at += n
            used += len(filled)
            held.clear()
            return out

        for batch in batches:
            out = []
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(texts), 64):
                for key, ids in zip(keys[lo : lo + 64], known.texts([t or "" for t in texts[lo : lo + 64].to_pylist()]), strict=True):
                    ids = np.append(ids, np.array([end_id], dtype="<u4")).astype("<u4")
                    total = len(ids)
                    whole = total // capacity * capacity
                    for start in range(0, whole, capacity):
                        out.append((key, start, capacity, zlib.crc32(ids[start : start + capacity].tobytes()), total, base + used, 0, linear * capacity + square * capacity * capacity))
                        used += 1
                    if total > whole:
                        held.append((key, whole, ids[whole:].copy(), total))
                        if len(held) >= bucket:
                            out += flush()
            if out:
                yield rows(out)
        if held:
            yield rows(flush())
        known.former = {}  # what stays in an idle worker is one table at most

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, SCHEMA)
