"""Secret scan: fixed patterns plus a character Markov model, as DataFrame functions only.

Spans are array<struct<start int, kind string, end int>> in code points, end exclusive, sorted by
start and then by kind in the order assign, access, hex, markov.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import stage, unused

#: Fixed patterns of the base kinds. ASSIGN holds its key words in either case; its second group is the value.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: What the model judges: runs of token characters, long enough for transitions to tell.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "markov")
SPANS = "array<struct<start:int,kind:string,end:int>>"


def none() -> Column:
    return F.array().cast(SPANS)


def matches(text: Column, pattern: str, kind: str, keep=None, values: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of `pattern`; `keep(match, value)` drops some.

    What lies between the matches comes from split(), so that a match starts where all earlier
    gaps and matches end. Texts without a match cost one search.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    if values is not None:
        pairs = F.zip_with(pairs, values, lambda p, v: F.struct(p["gap"].alias("gap"), p["m"].alias("m"), v.alias("value")))

    def add(acc, p):
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["m"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        good = p["m"].isNotNull() if keep is None else p["m"].isNotNull() & F.coalesce(keep(p), F.lit(False))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(good, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), none().alias("spans"))
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, add, lambda acc: acc["spans"])).otherwise(none())


def base_spans(text: Column) -> dict[str, Column]:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    return {
        "assign": matches(text, ASSIGN, "assign", lambda p: F.length(p["value"]) >= 12, values),
        "access": matches(text, ACCESS, "access"),
        "hex": matches(text, HEX, "hex"),
    }


def bigram_slots(token: Column) -> Column:
    """Slots of a token's adjacent characters in a 128 x 128 table of ASCII pairs; others share slot 0."""
    code = lambda c: F.when(F.ascii(c).between(0, 127), F.ascii(c)).otherwise(0)
    at = F.when(F.length(token) >= 2, F.sequence(F.lit(1), F.length(token) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: code(F.substring(token, i, F.lit(1))) * 128 + code(F.substring(token, i + 1, F.lit(1))))


#: Alphabets of keys and tokens in common encodings.
ALPHABETS = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "abcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
)


def random_strings(spark: SparkSession, n: int) -> DataFrame:
    """`n` strings of 16 to 48 characters, each drawn from one of ALPHABETS by hashes of its place: the same on every run."""
    alphabet = F.element_at(F.array(*map(F.lit, ALPHABETS)), (F.pmod("id", F.lit(len(ALPHABETS))) + 1).cast("int"))
    drawn = lambda i: F.substring(F.col("alphabet"), (F.pmod(F.xxhash64("id", i), F.length("alphabet")) + 1).cast("int"), F.lit(1))
    rows = spark.range(n).select("id", alphabet.alias("alphabet"), (F.pmod(F.xxhash64("id"), F.lit(33)) + 16).cast("int").alias("size"))
    return rows.select(F.array_join(F.transform(F.sequence(F.lit(1), F.col("size")), drawn), "").alias("token"), F.lit(1).alias("random"))


def ordinary(rest: Column) -> Column:
    """Distinct ordinary tokens of a text: its long words, its runs of token characters, and identifiers of three neighbouring words each.

    Words are joined as identifiers and paths join them; a fourth of these are upper-case, a fourth end in a number.
    """
    distinct = lambda pattern: F.array_distinct(F.regexp_extract_all(rest, F.lit(pattern), F.lit(0)))

    def identifiers(words):
        at = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3, F.lit(3))).otherwise(F.array().cast("array<int>"))

        def joined_words(i):
            own = [F.get(words, i + k) for k in range(3)]
            h = F.xxhash64(*own)
            joiner = F.element_at(F.array(*map(F.lit, ("_", "-", "/", ""))), (F.pmod(h, F.lit(4)) + 1).cast("int"))
            camel = F.concat(F.lower(own[0]), *[F.initcap(w) for w in own[1:]])
            name = F.when(joiner == "", camel).otherwise(F.concat_ws("", own[0], joiner, own[1], joiner, own[2]))
            name = F.when(F.pmod(F.shiftright(h, 24), F.lit(4)) == 0, F.upper(name)).otherwise(name)
            return F.concat(name, F.when(F.pmod(F.shiftright(h, 8), F.lit(4)) == 0, F.pmod(F.shiftright(h, 16), F.lit(2100)).cast("string")).otherwise(""))

        return F.transform(at, joined_words)

    # the words are bound to a variable, so that they are found once a text and not once an identifier
    named = F.get(F.transform(F.array(distinct("[A-Za-z]{2,}")), identifiers), 0)
    return F.array_distinct(F.concat(distinct("[A-Za-z][A-Za-z0-9_-]{5,}"), distinct(CANDIDATE), named))


def sample_texts(docs: DataFrame, max_documents: int, max_characters: int) -> DataFrame:
    """(text): at most `max_documents` different texts of at most `max_characters` characters, those with the least hashes; however often a text is there, it counts once."""
    held = docs.where(F.length("text") <= max_characters).select(F.xxhash64("text").alias("hash"), "text")
    last = held.select("hash").distinct().orderBy("hash").limit(max_documents).agg(F.max("hash")).first()[0]
    return held.where(F.col("hash") <= F.lit(last)).groupBy("hash").agg(F.first("text").alias("text")).select("text")


def labelled_samples(docs: DataFrame, max_documents: int = 1000, max_characters: int = 100_000, strings: int = 6000) -> DataFrame:
    """(token, random 0 or 1): drawn random strings, and ordinary tokens of the sample_texts().

    A bounded training sample that doesn't depend on the order of rows. What the base patterns catch is
    no sample of either kind. Null and empty texts give no tokens.
    """
    rest = F.col("text")
    for p in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, p, " ")
    sample = sample_texts(docs, max_documents, max_characters).select(rest.alias("rest"))
    words = sample.select(F.explode(ordinary(F.col("rest"))).alias("token"), F.lit(0).alias("random"))
    return random_strings(docs.sparkSession, strings).unionByName(words)


def train(samples: DataFrame, smoothing: float = 0.5, pull: float = 5.0) -> list[float]:
    """Log-likelihood ratios, random against ordinary, of all 128 x 128 transitions.

    Two first-order chains. A transition's chance is drawn by `pull` counts towards the chance of
    its second character alone in that class, which has additive smoothing. What reaches the driver
    is at most one count for each of the 2 x 16,384 slots.
    """
    counts = samples.select("random", F.explode(bigram_slots(F.col("token"))).alias("slot")).groupBy("random", "slot").count()
    table = {(r["random"], r["slot"]): r["count"] for r in counts.collect()}
    from_one = {k: [sum(table.get((k, a * 128 + b), 0) for b in range(128)) for a in range(128)] for k in (0, 1)}
    to_one = {k: [sum(table.get((k, a * 128 + b), 0) for a in range(128)) + smoothing for b in range(128)] for k in (0, 1)}
    alone = {k: [n / sum(row) for n in row] for k, row in to_one.items()}
    chance = lambda k, a, b: (table.get((k, a * 128 + b), 0) + pull * alone[k][b]) / (from_one[k][a] + pull)
    return [math.log(chance(1, a, b) / chance(0, a, b)) for a in range(128) for b in range(128)]


def mean_ratio(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions, in nats; null for fewer than two characters."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")  # a constant: folded once
    slots = bigram_slots(token)
    return F.try_divide(F.aggregate(slots, F.lit(0.0), lambda acc, s: acc + F.get(table, s)), F.size(slots))


class Model(NamedTuple):
    """Ratios of all transitions, the mean from which a run counts as random, and the held-out shares behind that."""

    ratios: list[float]
    least_mean: float
    recall: float
    false_share: float


def fit(samples: DataFrame, most_false: float = 0.001) -> Model:
    """Trains on four fifths of the samples, told apart by a hash, and takes the cut from the rest.

    The cut is the least mean that at most `most_false` of the held-out ordinary tokens of candidate
    length reach, and no less than 0, where both classes are as likely.
    """
    samples = stage(samples, "secret-samples")
    held_out = F.pmod(F.xxhash64("token"), F.lit(5)) == 0
    ratios = train(samples.where(~held_out))
    judged = samples.where(held_out & F.col("token").rlike(f"^{CANDIDATE}$")).select("random", mean_ratio(F.col("token"), ratios).alias("mean"))
    judged = stage(judged, "secret-means")
    cut = judged.where("random = 0").agg(F.percentile_approx("mean", 1 - most_false, 100_000)).first()[0]
    cut = max(0.0, (cut or 0.0) + 1e-6)
    shares = {r["random"]: r["share"] for r in judged.groupBy("random").agg(F.avg((F.col("mean") >= cut).cast("double")).alias("share")).collect()}
    return Model(ratios, cut, shares.get(1, 0.0), shares.get(0, 0.0))


def markov_spans(text: Column, ratios: list[float], min_mean: float) -> Column:
    """Candidates whose mean log-likelihood ratio a transition is at least `min_mean` nats."""
    return matches(text, CANDIDATE, "markov", lambda p: mean_ratio(p["m"], ratios) >= min_mean)


def scan(docs: DataFrame, ratios: list[float], min_mean: float, text: str = "text") -> DataFrame:
    """Adds `spans` to every row; a column of that name is replaced, others stay whatever their names. Null and empty texts have none, an empty table gives no rows.

    Spans of one kind never overlap; base kinds may overlap each other. A model span that touches
    a base span is left out, so that base spans stay as they are. Repeated rows give equal results.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    own = {k: unused(docs, f"_{k}") for k in KINDS}
    found = base_spans(value) | {"markov": markov_spans(value, ratios, min_mean)}
    marked = docs.withColumns({own[k]: c for k, c in found.items()})
    fixed = F.concat(own["assign"], own["access"], own["hex"])
    apart = F.filter(own["markov"], lambda m: ~F.exists(fixed, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    order = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))
    spans = F.transform(F.array_sort(F.transform(F.concat(fixed, apart), order)), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return marked.withColumn("spans", spans).drop(*own.values())


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by `mask`; overlapping spans make one stretch."""
    value = F.coalesce(text, F.lit(""))

    def cut(acc, s):
        begin = F.greatest(acc["at"], s["start"])
        piece = F.concat(acc["out"], F.substring(value, acc["at"] + 1, begin - acc["at"]), F.lit(mask))
        fresh = (s["start"] >= acc["at"]) | (acc["at"] == 0)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = lambda acc: F.concat(acc["out"], F.substring(value, acc["at"] + 1, F.length(value)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, cut, done)).otherwise(text)
