"""Benchmark decontamination by pigeonhole edit matching.

A test item that may hold e errors is cut into e + 1 pieces; wherever the item occurs with at most e
edits, one piece occurs unchanged. An Aho-Corasick automaton finds all pieces of all items in one
pass over a text, and Myers' bit-parallel distance decides on the stretch around each hit.

Pieces are grouped in twos (the last group may have three), and the same principle holds one level
up: some group of g pieces has at most g - 1 errors, and so an unchanged piece. A hit whose group
has more errors is dropped before the whole item is compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BREAKS = re.compile(r"[\W_]+")
SCHEMA = "doc_id long, item_id long, item_chars int, distance int, match_start long, match_end long"


def normalise(text: str | None) -> str:
    """Lower-cased words apart by single spaces; what isn't a letter or digit parts words."""
    return BREAKS.sub(" ", text.lower()).strip() if text else ""


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item cut into errors + 1 pieces of nearly equal length, with their offsets."""
    n, k = len(item), errors + 1
    return [(n * i // k, item[n * i // k : n * (i + 1) // k]) for i in range(k)]


def grouped(parts: list[tuple[int, str]]) -> list[list[tuple[int, str]]]:
    groups = [parts[i : i + 2] for i in range(0, len(parts), 2)]
    if len(groups) > 1 and len(groups[-1]) == 1:
        last = groups.pop()
        groups[-1] = groups[-1] + last
    return groups


class Pattern:
    """One text, with the bit masks for Myers' algorithm."""

    def __init__(self, item_id: int, text: str, errors: int):
        self.item_id, self.text, self.errors = item_id, text, errors
        self.masks = self._masks(text)
        self.backward = self._masks(text[::-1])

    @staticmethod
    def _masks(text: str) -> dict[str, int]:
        masks: dict[str, int] = {}
        for i, c in enumerate(text):
            masks[c] = masks.get(c, 0) | 1 << i
        return masks

    def search(self, text: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
        """(least edit distance of the item to any substring, end of the first such substring)."""
        masks = self.masks if masks is None else masks
        m = len(self.text)
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score, best, end = full, 0, m, m, 0
        for i, c in enumerate(text):
            eq = masks.get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            up = minus | (full & ~(xh | plus))
            down = plus & xh
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best, end = score, i + 1
            up, down = up << 1 & full, down << 1 & full
            plus, minus = down | (full & ~(xv | up)), up & xv
        return best, end

    def within(self, text: str, lo: int, hi: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of the best match in text[lo:hi], or None beyond the error budget."""
        at = text.find(self.text, lo, hi)
        if at >= 0:
            return 0, at, at + len(self.text)
        distance, end = self.search(text[lo:hi])
        if distance > self.errors:
            return None
        first = max(0, end - len(self.text) - distance)
        _, back = self.search(text[lo + first : lo + end][::-1], self.backward)
        return distance, lo + end - back, lo + end


class Matcher:
    """All items of one block; built once a task."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.patterns = [Pattern(i, t, int(len(t) * error_rate)) for i, t in items]
        found: dict[str, list[tuple[int, int, int, Pattern]]] = {}
        for k, p in enumerate(self.patterns):
            for group in grouped(pieces(p.text, p.errors)):
                first = group[0][0]
                whole = Pattern(p.item_id, "".join(x for _, x in group), len(group) - 1)
                for offset, piece in group:
                    found.setdefault(piece, []).append((k, offset, first, whole))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item, length, distance, start, end), the best place of each item that the text holds."""
        spots: dict[int, list[int]] = {}
        for last, (n, where) in self.automaton.iter(text):
            for k, offset, first, group in where:
                start = last + 1 - n - offset
                at, e = max(0, start + first), group.errors
                if text.startswith(group.text, at) or group.search(text[max(0, at - e) : start + first + len(group.text) + e])[0] <= e:
                    spots.setdefault(k, []).append(start)
        out = []
        for k, starts in spots.items():
            p = self.patterns[k]
            best, m, e = None, len(p.text), p.errors
            starts.sort()
            i = 0
            while i < len(starts):  # stretches that overlap are searched once
                lo, hi = starts[i] - e, starts[i] + m + e
                while i + 1 < len(starts) and starts[i + 1] - e <= hi:
                    i += 1
                    hi = starts[i] + m + e
                i += 1
                got = p.within(text, max(0, lo), hi)
                if got is not None and (best is None or got < best):
                    best = got
            if best is not None:
                out.append((p.item_id, m, *best))
        return sorted(out)


def find(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.1, max_block_chars: int = 8_000_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document row and benchmark item that it holds with at most error_rate * length edits.

    Both sides are compared as lower-cased words apart by single spaces; match_start and match_end
    count characters of that form of the document, distance is the least one. Null or wordless
    items and texts match nothing; an item too short for any error must occur exactly. Repeated
    document rows give repeated results, an item id of several texts a row for each that is found.
    The benchmark's size is measured first: up to `max_block_chars` it is one block that every task
    holds; a larger one is dealt by hash into blocks of about that size, each scanned in its own pass.
    """
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // max_block_chars))
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    parts = []
    for b in range(blocks):
        own = sorted({(r["item_id"], t) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect() if (t := normalise(r["text"]))})
        shared = docs.sparkSession.sparkContext.broadcast(own)  # one block, of a size known from the count above

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            matcher = Matcher(shared.value, error_rate) if shared.value else None
            for batch in batches:
                rows = []
                if matcher is not None:
                    for key, value in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                        rows += [(None if pd.isna(key) else int(key), *m) for m in matcher.matches(normalise(value))]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "item_chars", "distance", "match_start", "match_end"]).astype({"doc_id": "Int64"})

        parts.append(whole.mapInPandas(scan, SCHEMA))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents that hold no benchmark item; rows with a null id are kept."""
    held = find(docs, benchmark, **settings).select(F.col("doc_id").alias("_held")).distinct()
    return docs.join(held, docs["doc_id"].cast("long") == held["_held"], "left_anti")
