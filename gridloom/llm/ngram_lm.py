"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays.

Tasks sort and sum what they read before anything is shuffled, so a frequent word or pair is one
entry a task; shards are ranges of hashed keys and so even. Each shard's sorted arrays become files
in the shared folder, which workers map into memory to score texts.

A word's id is its place in the sorted array of word hashes. A pair's key is a reversible scramble
of (first id, second id), so distinct pairs never collide.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import new_folder

#: The end of a text counts as a token; no word can hold a line feed.
END = b"\n</s>"
#: Tokens that a task sorts and sums at a time; more where that would leave fewer than so many a shard, up to a bound of memory.
CHUNK, CHUNK_A_SHARD, MOST_CHUNK = 3_000_000, 32, 8_000_000
#: Ids whose statistics are one file.
RANGE = 1 << 18


def tokens(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, parted by spaces and the control characters 9 to 13, then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def squeeze(values: np.ndarray) -> bytes:
    """Sorted or small unsigned numbers as bytes: differences, laid out by byte place, compressed."""
    v = values.astype("<u8")
    return zlib.compress(np.diff(v, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def expand(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(flat.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def plain(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unplain(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view("<u8").ravel()


def summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and each column summed over equal keys."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    return (keys[starts], *(np.add.reduceat(c[order], starts) if len(keys) else c[:0] for c in columns))


class Scramble:
    """A permutation of the numbers below 2^bits that spreads neighbours evenly; `undo` is its inverse."""

    def __init__(self, bits: int):
        self.bits, self.mask, self.shift = bits, np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
        self.odd = [0x9E3779B97F4A7C15 & ((1 << bits) - 1) | 1, 0xBF58476D1CE4E5B9 & ((1 << bits) - 1) | 1]
        self.back = [pow(x, -1, 1 << bits) for x in self.odd]

    def do(self, x: np.ndarray) -> np.ndarray:
        for odd in self.odd:
            x = (x ^ (x >> self.shift)) * np.uint64(odd) & self.mask
        return x ^ (x >> self.shift)

    def undo(self, x: np.ndarray) -> np.ndarray:
        x = x ^ (x >> self.shift)
        for odd in reversed(self.back):
            x = x * np.uint64(odd) & self.mask
            x = x ^ (x >> self.shift)
        return x


def save(folder: str, name: str, values: np.ndarray) -> None:
    """Writes an array under a name; a repeated task replaces its own file with equal bytes."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/{name}.{xxhash.xxh64_hexdigest(str(np.random.default_rng().integers(2**63)))}"
    with store.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(values).data)
    store.move(part, f"{path}/{name}")


class Files:
    """Arrays of a folder, mapped into memory. A store without local paths is copied to a folder of the worker's own, which goes with it."""

    def __init__(self, folder: str):
        self.folder, self.local, self.open = folder, None, {}
        if "://" not in folder or folder.startswith("file:"):
            self.local = folder.removeprefix("file:")
            while self.local.startswith("//"):
                self.local = self.local[1:]

    def array(self, name: str, kind: str) -> np.ndarray:
        if name not in self.open:
            if self.local is None:
                self.local = tempfile.mkdtemp()
                atexit.register(shutil.rmtree, self.local, True)
            path = f"{self.local}/{name}"
            if "://" in self.folder and not self.folder.startswith("file:"):
                from pyarrow import fs

                store, base = fs.FileSystem.from_uri(self.folder)
                fs.copy_files(f"{base}/{name}", path, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
            import os

            empty = os.path.getsize(path) == 0
            self.open[name] = np.zeros(0, dtype=kind) if empty else np.memmap(path, dtype=kind, mode="r")
        return self.open[name]


def discounts(counts: list[int]) -> np.ndarray:
    """D(0), D(1), D(2), D(3 or more) from the numbers of entries that occur 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = counts
    if not (n1 and n2):
        return np.array([0.0, 0.5, 0.75, 1.0])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))])


class Shards:
    """Sorted arrays in key ranges: `find` gives each key's place among all, or -1."""

    def __init__(self, files: Files, prefix: str, sizes: list[int], bits: int):
        self.files, self.prefix, self.bits = files, prefix, bits
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.n = len(sizes)

    def shard(self, keys: np.ndarray) -> np.ndarray:
        return shard_of(keys, self.bits, self.n)

    def find(self, keys: np.ndarray, values: str = "") -> np.ndarray:
        """With `values`: that array's entry for each key, 0 for missing ones."""
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        out = np.zeros(len(keys), dtype=np.int64) if values else np.full(len(keys), -1, dtype=np.int64)
        for s, lo, hi in stretches(self.shard(ranked)):
            if self.offsets[s] == self.offsets[s + 1]:
                continue  # an empty shard has no file
            held = self.files.array(f"{self.prefix}-{s:05d}.keys", "<u8")
            at = np.minimum(np.searchsorted(held, ranked[lo:hi]), len(held) - 1)
            hit = held[at] == ranked[lo:hi]
            got = self.files.array(f"{self.prefix}-{s:05d}.{values}", "<u8")[at] if values else self.offsets[s] + at
            out[order[lo:hi][hit]] = got[hit]
        return out


def stretches(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of the stretches of equal values in a sorted array: as many steps as there are distinct ones."""
    if len(values):
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        yield from zip(values[first].tolist(), first.tolist(), np.append(first[1:], len(values)).tolist(), strict=True)


def shard_of(keys: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Equal ranges of keys below 2^bits; increases with the key."""
    top = min(bits, 32)
    return ((keys >> np.uint64(bits - top)) * np.uint64(n) >> np.uint64(top)).astype(np.int64)


class Model:
    """What tasks need to score: folder, shard sizes, totals and discounts. The arrays stay in files."""

    def __init__(self, folder: str, word_sizes: list[int], tokens_seen: int):
        self.folder, self.word_sizes, self.tokens_seen = folder, word_sizes, tokens_seen
        self.vocabulary = sum(word_sizes)
        self.span = self.vocabulary + 1  # ids, and one more for the start of a text
        self.bits = max(8, (self.span * self.span).bit_length())
        if self.bits > 64:
            raise ValueError("pairs of more than 4.29e9 distinct words don't fit 64-bit keys")
        self.pair_sizes: list[int] = []
        self.range_size = 1
        self.ranges = 0
        self.pair_discounts = self.word_discounts = np.zeros(4)
        self.word_backoff = 1.0


class Words:
    """Ids of words by the mapped vocabulary, with a bounded table of those seen."""

    def __init__(self, model: Model, files: Files, table_size: int = 300_000):
        self.shards, self.size, self.table = Shards(files, "word", model.word_sizes, 64), table_size, {}

    def ids(self, words: list[bytes]) -> np.ndarray:
        table = self.table
        if new := list(set(words).difference(table)):
            if len(table) + len(new) > self.size:
                table.clear()
                new = list(set(words))
            found = self.shards.find(np.array([xxhash.xxh64_intdigest(w) for w in new], dtype=np.uint64))
            table.update(zip(new, found.tolist(), strict=True))
        return np.fromiter(map(table.__getitem__, words), dtype=np.int64, count=len(words))

    def of(self, group: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all tokens of some texts, and where each text starts: new words of a group are looked up together."""
        starts = np.concatenate([[0], np.cumsum([len(t) for t in group])[:-1]]).astype(np.int64)
        return self.ids([w for text in group for w in text]), starts


def _blobs(keys: np.ndarray, columns: list[np.ndarray | None], shards: np.ndarray) -> pd.DataFrame:
    """A row for each shard that has keys; a column of None stands for zeros and is empty."""
    rows = [(s, squeeze(keys[lo:hi]), *(b"" if c is None else plain(c[lo:hi]) for c in columns)) for s, lo, hi in stretches(shards)]
    return pd.DataFrame(rows, columns=["shard", "keys", *(f"c{i}" for i in range(len(columns)))])


def chunk_for(shards: int) -> int:
    """Tokens of a chunk, so that blobs (chunks times shards) grow with the tokens and not with their square."""
    return min(max(CHUNK, CHUNK_A_SHARD * shards), MOST_CHUNK)


def _texts(batches: Iterator[pd.DataFrame], limit: int = 250_000) -> Iterator[list[list[bytes]]]:
    """Token lists of texts, in groups of about `limit` tokens."""
    held, n = [], 0
    for batch in batches:
        for text in batch["text"]:
            held.append(tokens(text))
            n += len(held[-1])
            if n >= limit:
                yield held
                held, n = [], 0
    if held:
        yield held


def _chunks(arrays: Iterator[np.ndarray], limit: int) -> Iterator[np.ndarray]:
    held, n = [], 0
    for a in arrays:
        held.append(a)
        n += len(a)
        if n >= limit:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def before_each(ids: np.ndarray, starts: np.ndarray, begin: int) -> np.ndarray:
    """The id before each token; `begin` at the start of a text."""
    before = np.append(-1, ids[:-1])
    before[starts] = begin
    return before


def count_words(texts: DataFrame, folder: str, shards: int) -> Model:
    """Counts the words of `texts` and writes the vocabulary: one sorted array of hashes and one of counts for each shard."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table: dict[bytes, int] = {}

        def hashed() -> Iterator[np.ndarray]:
            for group in _texts(batches):
                words = [w for text in group for w in text]
                if new := set(words).difference(table):
                    if len(table) + len(new) > 300_000:
                        table.clear()
                        new = set(words)
                    table.update((w, xxhash.xxh64_intdigest(w)) for w in new)
                yield np.fromiter(map(table.__getitem__, words), dtype=np.uint64, count=len(words))

        for every in _chunks(hashed(), chunk_for(shards)):
            keys, counts = np.unique(every, return_counts=True)
            yield _blobs(keys, [counts], shard_of(keys, 64, shards))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        s = int(group["shard"].iloc[0])
        keys, counts = summed(np.concatenate([expand(x) for x in group["keys"]]), np.concatenate([unplain(x) for x in group["c0"]]))
        save(folder, f"word-{s:05d}.keys", keys.astype("<u8"))
        save(folder, f"word-{s:05d}.counts", counts.astype("<u8"))
        return pd.DataFrame({"shard": [s], "n": [len(keys)], "total": [int(counts.sum())]})

    blobs = texts.mapInPandas(count, "shard int, keys binary, c0 binary")
    done = {r["shard"]: r for r in blobs.groupBy("shard").applyInPandas(merge, "shard int, n long, total long").collect()}  # a row a shard
    return Model(folder, [done[s]["n"] if s in done else 0 for s in range(shards)], sum(r["total"] for r in done.values()))


def count_pairs(texts: DataFrame, model: Model, shards: int) -> None:
    """Counts pairs of neighbours, writes them as sorted hash arrays, and what lower order and back-off need for each word."""
    folder, span, scramble = model.folder, model.span, Scramble(model.bits)
    # ranges follow the vocabulary: each shard of pairs has a blob for each, of as many words as fit
    model.ranges = ranges = -(-span // RANGE)
    model.range_size = width = -(-span // ranges)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(model, Files(folder))

        def pairs() -> Iterator[np.ndarray]:
            for group in _texts(batches):
                ids, starts = words.of(group)
                yield before_each(ids, starts, model.vocabulary).astype(np.uint64) * np.uint64(span) + ids.astype(np.uint64)

        for every in _chunks(pairs(), chunk_for(shards)):
            keys, counts = np.unique(scramble.do(every), return_counts=True)
            yield _blobs(keys, [counts], shard_of(keys, model.bits, shards))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        s = int(group["shard"].iloc[0])
        keys, counts = summed(np.concatenate([expand(x) for x in group["keys"]]), np.concatenate([unplain(x) for x in group["c0"]]))
        save(folder, f"pair-{s:05d}.keys", keys.astype("<u8"))
        save(folder, f"pair-{s:05d}.counts", counts.astype("<u8"))
        both = scramble.undo(keys)
        first, second = both // np.uint64(span), both % np.uint64(span)
        one = np.ones(len(keys), dtype=np.uint64)
        kinds = [(counts == k).astype(np.uint64) for k in (1, 2)] + [(counts > 2).astype(np.uint64)]
        # first words: total and numbers of followers seen once, twice, more; second words: numbers of predecessors
        heads = summed(first, counts, *kinds)
        tails = summed(second, one)
        out = []
        for keys_, columns in ((heads[0], [*heads[1:], None]), (tails[0], [None] * 4 + [tails[1]])):
            out.append(_blobs(keys_, columns, (keys_ // np.uint64(width)).astype(np.int64)))
        table = pd.concat(out, ignore_index=True)
        of = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        summary = pd.DataFrame([(-1, b"", b"", b"", b"", b"", b"", s, len(keys), *of)], columns=["shard", "keys", "c0", "c1", "c2", "c3", "c4", "source", "n", "n1", "n2", "n3", "n4"])
        return pd.concat([table, summary], ignore_index=True).fillna({k: 0 for k in ("source", "n", "n1", "n2", "n3", "n4")}).astype({k: "int64" for k in ("source", "n", "n1", "n2", "n3", "n4")})

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        r = int(group["shard"].iloc[0])
        dense = np.zeros((5, width), dtype=np.uint64)
        for row in group.itertuples():
            at = (expand(row.keys) - np.uint64(r * width)).astype(np.int64)
            for i in range(5):
                if own := getattr(row, f"c{i}"):
                    dense[i, at] += unplain(own)
        save(folder, f"stats-{r:05d}.values", dense.astype("<u8").T)
        tail = dense[4]
        return pd.DataFrame([(r, *(int((tail == k).sum()) for k in (1, 2, 3, 4)), int((tail > 2).sum()), int(tail.sum()))], columns=["range", "n1", "n2", "n3", "n4", "more", "total"])

    schema = "shard int, keys binary, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary, source long, n long, n1 long, n2 long, n3 long, n4 long"
    blobs = texts.mapInPandas(count, "shard int, keys binary, c0 binary")
    from gridloom.llm.common import stage

    merged = stage(blobs.groupBy("shard").applyInPandas(merge, schema), "pair-stats")
    summaries = merged.where("shard = -1").select("source", "n", "n1", "n2", "n3", "n4").collect()  # a row a shard
    sizes = {r["source"]: r["n"] for r in summaries}
    model.pair_sizes = [sizes.get(s, 0) for s in range(shards)]
    model.pair_discounts = discounts([sum(r[f"n{k}"] for r in summaries) for k in (1, 2, 3, 4)])
    parts = merged.where("shard >= 0").groupBy("shard").applyInPandas(finish, "range int, n1 long, n2 long, n3 long, n4 long, more long, total long").collect()  # a row a range
    for r in set(range(ranges)) - {p["range"] for p in parts}:
        save(folder, f"stats-{r:05d}.values", np.zeros((width, 5), dtype="<u8"))
    model.word_discounts = discounts([sum(p[f"n{k}"] for p in parts) for k in (1, 2, 3, 4)])
    n1, n2, more = (sum(p[k] for p in parts) for k in ("n1", "n2", "more"))
    d, total = model.word_discounts, sum(p["total"] for p in parts)
    model.word_backoff = float((d[1] * n1 + d[2] * n2 + d[3] * more) / total) if total else 1.0


class Scorer:
    """Scores token lists against the mapped model."""

    def __init__(self, model: Model):
        self.model, self.files = model, Files(model.folder)
        self.words = Words(model, self.files)
        self.pairs = Shards(self.files, "pair", model.pair_sizes, model.bits)
        self.scramble = Scramble(model.bits)
        self.pair_total = sum(model.pair_sizes)

    def gather(self, ids: np.ndarray, name: str, kind: str, size: int, columns: int = 0) -> np.ndarray:
        """Entries of ids from arrays that are cut into equal ranges; ids below 0 give zeros."""
        out = np.zeros((len(ids), columns) if columns else len(ids), dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        ranked = ids[order]
        for r, lo, hi in stretches(np.where(ranked >= 0, ranked // size, -1)):
            if r >= 0:
                held = self.files.array(f"{name}-{r:05d}.values", kind)
                out[order[lo:hi]] = (held.reshape(-1, columns) if columns else held)[ranked[lo:hi] - r * size]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        shards, out = self.words.shards, np.zeros(len(ids), dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        ranked = ids[order]
        for s, lo, hi in stretches(np.where(ranked >= 0, np.searchsorted(shards.offsets, ranked, side="right") - 1, -1)):
            if s >= 0:
                out[order[lo:hi]] = self.files.array(f"word-{s:05d}.counts", "<u8")[ranked[lo:hi] - shards.offsets[s]]
        return out

    def texts(self, group: list[list[bytes]]) -> list[tuple[int, int, float, float]]:
        """(tokens, known tokens, base score, score) of each text, in log10."""
        m = self.model
        lengths = np.array([len(t) for t in group])
        ids, starts = self.words.of(group)
        before = before_each(ids, starts, m.vocabulary)
        distinct, back = np.unique(ids, return_inverse=True)
        c = self.counts(distinct)[back]
        base = np.log10((c + 1) / (m.tokens_seen + (m.vocabulary + 1)))
        # lower order: how many different words a word follows
        tails = self.gather(distinct, "stats", "<u8", m.range_size, 5)[:, 4][back]
        d1, d2 = m.word_discounts, m.pair_discounts
        low = np.maximum(tails - d1[np.minimum(tails, 3)], 0) / max(1, self.pair_total) + m.word_backoff / (m.vocabulary + 1)
        heads, back = np.unique(before, return_inverse=True)
        stats = self.gather(heads, "stats", "<u8", m.range_size, 5)
        total = stats[:, 0]
        gamma = np.where(total > 0, (d2[1] * stats[:, 1] + d2[2] * stats[:, 2] + d2[3] * stats[:, 3]) / np.maximum(total, 1), 1.0)
        known = (ids >= 0) & (before >= 0)
        pair = np.zeros(len(ids), dtype=np.int64)
        keys = before[known].astype(np.uint64) * np.uint64(m.span) + ids[known].astype(np.uint64)
        pair[known] = self.pairs.find(self.scramble.do(keys), "counts")
        high = np.maximum(pair - d2[np.minimum(pair, 3)], 0) / np.maximum(total[back], 1)
        score = np.log10(high + gamma[back] * low)
        cut = lambda x: np.add.reduceat(x, starts).tolist()
        return list(zip(lengths.tolist(), cut((c > 0).astype(np.int64)), cut(base), cut(score), strict=True))


def train(texts: DataFrame, chars_per_shard: int = 16_000_000, least_shards: int = 32) -> Model:
    """Learns from every row of a `text` column (null: empty). The number of shards follows the characters read."""
    texts = texts.select("text")
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    shards = max(least_shards, -(-chars // chars_per_shard))
    folder = new_folder(texts.sparkSession, "ngram-lm")
    model = count_words(texts, folder, shards)
    count_pairs(texts, model, shards)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns in `keep` (all but the text if None) plus n_tokens, n_known, base_score, score and perplexity.

    One row for each input row, whole texts of any length, null as empty: the end of the text alone.
    score is the log10 probability under the model, base_score under add-one unigrams, perplexity
    10 ^ (-score / n_tokens). An unknown word gets the lower order's share for unseen words; after an
    unknown word the lower order alone decides. An untrained model (no texts) spreads evenly. Result
    columns replace input columns of their names, others stay; repeated rows score alike, and an empty
    table gives no rows.
    """
    results = ["n_tokens", "n_known", "base_score", "score"]
    given = list(keep) if keep is not None else [n for n in docs.columns if n not in (text, *results, "perplexity")]
    body = "text to score"
    while body in given:
        body += " "
    kept = docs.select(*([c.alias(n) for n, c in keep.items()] if keep is not None else [F.col(f"`{n}`") for n in given]), F.col(text).alias(body))
    names = [n for n in kept.columns if n != body]
    schema = ", ".join([*(f"`{n}` {kept.schema[n].dataType.simpleString()}" for n in names), "n_tokens long, n_known long, base_score double, score double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            rows, held, n = [], [], 0
            for value in batch[body]:
                held.append(tokens(value))
                n += len(held[-1])
                if n >= 250_000:
                    rows += scorer.texts(held)
                    held, n = [], 0
            if held:
                rows += scorer.texts(held)
            yield pd.concat([batch[names].reset_index(drop=True), pd.DataFrame(rows, columns=results)], axis=1)

    return kept.mapInPandas(run, schema).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
