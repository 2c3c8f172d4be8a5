"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

Everything runs as DataFrame functions and the DataFrame-based ML library inside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of hosts that are to be blocked, by kind.
BLOCKED = {
    "adult": "adult porn xxx sex nude escort camgirls hot-singles adult-video erotic",
    "gambling": "casino poker slots roulette jackpot betting bingo lottery casino-bonus sportsbet",
    "pharmacy": "pills viagra cialis pharmacy meds diet-pills weight-loss cheap-meds steroids",
    "advertising": "ads adserver ad-banner popunder tracker track-pixel click-track adclick affiliate-clicks ads-network",
    "malware": "crack keygen warez malware phishing free-download cracked-games serial-key trojan",
    "scams": "spam spam-mail get-rich payday-loan prize-winner free-iphone replica-watches cheap-watches fast-cash seo-links link-farm backlinks click-farm win-money",
}
#: Words of hosts that are to be allowed.
ALLOWED = (
    "news library museum garden weather city recipes travel history school forum wiki sports science music health theatre maps university "
    "docs archive gallery cooking nature mountain river photography poetry astronomy chemistry parish council railway festival kitchen "
    "woodwork knitting cycling hiking orchestra academy institute journal research software hardware robotics farming harvest tracks "
    "additions adventure advice adult-education address roads reads upload grads heads trackwork paper pillow village windmill"
)
ONSETS, VOWELS, CODAS = "b br c cl d f g gr h j k l m n p r s st t tr v w z".split(), "a e i o u ai ea ou".split(), ("", "", "l", "n", "r", "s", "t", "m")
LANGUAGES, ENDINGS = ("en", "de", "fr", "es"), ("org", "net", "com")


def invented_name(k: int, syllables: int) -> str:
    """A name without meaning: each syllable is an onset, a vowel and a coda, picked by strides through the lists."""
    places = [k * (2 * j + 5) + 11 * j + k // 23 for j in range(syllables)]
    return "".join(ONSETS[p % len(ONSETS)] + VOWELS[p // 3 % len(VOWELS)] + CODAS[p // 5 % len(CODAS)] for p in places)


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table, 1 to be blocked: what a URL shows of the words above, in its host or in its path.

    Evidence in the host: each word in three forms of host, above a plain path of language and number. Evidence
    in the path: each word as a folder and as a page, on a host with an invented name. Evidence in neither: invented
    names of one to three syllables with plain paths, allowed. Languages, numbers, fronts and ends of hosts and
    schemes fall alike on both classes. All hosts are invented.
    """
    words = [(w, 1) for own in BLOCKED.values() for w in own.split()] + [(w, 0) for w in ALLOWED.split()]
    seen = []  # (host, path, label)

    def plain(k: int) -> str:
        language = LANGUAGES[k // 2 % 4]
        return ("", f"{language}/{k * 37 % 997}", f"{language}/{k * 53 % 4999}.html", f"{language}/{k * 11 % 9973}/")[k % 4]

    for k, (w, label) in enumerate(words):
        for j, host in enumerate((w, f"my-{w}", f"{w}-online")):
            seen.append((host, plain(3 * k + j), label))
        seen.append((invented_name(2 * k, 1 + k % 3), f"{w}/{k * 29 % 997}", label))
        seen.append((invented_name(2 * k + 1, 1 + k % 3), f"{LANGUAGES[k % 4]}/{w}.html", label))
    seen += [(invented_name(2 * len(words) + k, 1 + k % 3), plain(k), 0) for k in range(240)]
    rows = {}
    for k, (host, path, label) in enumerate(seen):
        front, below = ("", "www.", "m.", "blog.")[k % 4], (".example", "")[k // 4 % 2]
        rows[f"{('http', 'https')[k // 8 % 2]}://{front}{host}{below}.{ENDINGS[k % 3]}/{path}"] = label
    return list(rows.items())


#: (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first `://` with A-Z lower-cased, then the path; both empty without `://` or for null."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does. Of rules equally long that with the longer host wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, below in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(below)
        rule, verdict = F.when(fits, F.lit(at + below)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def ngrams(host: Column, path: Column, sizes: Sequence[int]) -> Column:
    """Distinct character n-grams of host and path, told apart by a prefix; `^` and `$` mark the ends."""

    def of(text: Column, mark: str, n: int) -> Column:
        whole = F.concat(F.lit("^"), text, F.lit("$"))
        at = F.when(F.length(whole) >= n, F.sequence(F.lit(1), F.length(whole) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(F.lit(mark), F.substring(whole, i, F.lit(n))))

    return F.array_distinct(F.concat(*[of(x, m, n) for n in sizes for x, m in ((host, "h:"), (path, "p:"))]))


class UrlFilter:
    """Fitted filter; `apply` adds host, path, rule, score and verdict to a table of URLs."""

    def __init__(self, hashing, model, rules, sizes):
        self.hashing, self.model, self.rules, self.sizes = hashing, model, rules, sizes

    def apply(self, df: DataFrame, url: str = "url") -> DataFrame:
        """One row per input row; other columns stay unless they bear the names of those added, which are replaced.

        A null URL, or one without `://`, has an empty host and path and no rule; the classifier
        then judges two empty strings. Score is the probability of `block`; 0.5 or more blocks.
        URLs of any length are judged whole, repeated rows alike; an empty table gives no rows.
        """
        own = ["host", "path", "rule", "score", "verdict"]
        link = F.col(url)
        host, path = host_and_path(link)
        kept = [c for c in df.columns if c not in own]
        parsed = df.select(*kept, host.alias("host"), path.alias("path"))
        rule, verdict = rule_columns(F.col("host"), F.col("path"), self.rules)
        grams = parsed.select(F.struct(*kept).alias("row"), "host", "path", rule.alias("rule"), verdict.alias("ruled"), ngrams(F.col("host"), F.col("path"), self.sizes).alias("grams"))
        scored = self.model.transform(self.hashing.transform(grams))
        score = vector_to_array("probability")[1]
        return scored.select("row.*", "host", "path", "rule", score.alias("score"), F.coalesce("ruled", F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"))


def fit(spark: SparkSession, labelled: Sequence[tuple[str, int]] | None = None, rules=RULES, sizes: Sequence[int] = (2, 3, 4, 5), dimensions: int = 16384, regularisation: float = 0.005) -> UrlFilter:
    """Logistic regression on binary hashed n-grams, from a small labelled table of (url, 0 or 1), labelled_urls() if None."""
    rows = spark.createDataFrame(list(labelled_urls() if labelled is None else labelled), "url string, label int").coalesce(1)
    host, path = host_and_path(F.col("url"))
    grams = rows.select(F.col("label").cast("double").alias("label"), host.alias("host"), path.alias("path")).select("label", ngrams(F.col("host"), F.col("path"), sizes).alias("grams"))
    hashing = HashingTF(numFeatures=dimensions, binary=True, inputCol="grams", outputCol="features")
    model = LogisticRegression(regParam=regularisation, maxIter=60).fit(hashing.transform(grams))
    return UrlFilter(hashing, model, rules, tuple(sizes))
