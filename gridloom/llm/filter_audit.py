"""What each of several filters removes, in every order in which they could be applied.

Each document has a mask, one bit for each filter that it fails; all that orders can tell follows from
the counts of masks. A recursive query extends prefixes of orders by the letters that they lack,
carries the bits applied so far and meets every mask cell: each of its levels gives that step's
metrics. The prefixes (325 for five filters) times the masks (32) are its rows, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import stage

LETTERS = "ABCDE"
#: Runs between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions that need the text alone, by letter."""
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * F.lit(100).cast("long") < F.size(words) * F.lit(50).cast("long"),
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * F.lit(100).cast("long") > F.length(text) * F.lit(2).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks_of_texts(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, digest, bits) of documents: bits of the filters A to D, and what tells equal texts.

    Built-in functions only; the digest is SHA-256, so that texts don't move.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    # through a generator, so that the words of a text are found once and not in each condition
    split = F.array_remove(F.split("text", SPACES), "")
    held = own.select("*", F.inline(F.array(F.struct(split.alias("words")))))
    fails = text_filters(F.col("text"), F.col("words"))
    bits = sum((F.when(fails[x], 1 << k).otherwise(0) for k, x in enumerate(LETTERS) if x in fails), F.lit(0))
    return held.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.cast("int").alias("bits"))


def mask_cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part and mask, and how many of them bear each label.

    E, an equal text under a smaller id, is told without gathering a group of copies: each group of
    equal texts is cut down to a row for each part, label and task before it moves. Rows that repeat an
    id are counted each, and none of them is the smaller of the other; rows without id fail E never and
    make no other row fail it. Of a document with several labels the larger counts.
    """
    rows = stage(masks_of_texts(docs, part), "masks")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marked = rows.join(marks, "doc_id", "left")
    flags = [F.coalesce(F.col(c) == 1, F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    each = marked.groupBy("doc_id", "part", "digest", "bits", *flags).agg(F.count("*").alias("n"))
    lone = F.col("doc_id").isNull().alias("lone")
    # of the rows of a text, part and label: all, the least id, and the rows of that id
    same = each.groupBy("digest", "part", "bits", "good", "toxic", lone).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    same = stage(same, "texts")
    first = same.groupBy("digest").agg(F.min("least").alias("first"))
    told = same.join(first, "digest").withColumn("kept", F.when(F.col("lone"), F.col("n")).when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0))
    both = F.array(F.struct(F.col("bits").alias("mask"), F.col("kept").alias("n")), F.struct((F.col("bits") + F.lit(1 << LETTERS.index("E"))).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))
    cells = told.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias(flag)
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


#: One row for each prefix of an order and mask: is a document of that mask kept after the prefix's last
#: filter, removed by it, redundant there, or failing nothing else.
WALK = """
    WITH RECURSIVE letter(letter, bit) AS (VALUES {letters}),
    cell(mask) AS (SELECT explode(sequence(0, {masks} - 1))),
    walk(prefix, step, letter, applied, bit, mask) AS (
        SELECT letter, 1, letter, 0, bit, mask FROM letter, cell
        UNION ALL
        SELECT concat(w.prefix, l.letter), w.step + 1, l.letter, w.applied | w.bit, l.bit, w.mask
        FROM walk w JOIN letter l ON ((w.applied | w.bit) & l.bit) = 0)
    SELECT prefix, step, letter, mask,
        (mask & (applied | bit)) = 0 AS kept,
        (mask & bit) <> 0 AND (mask & applied) = 0 AS removed,
        (mask & bit) <> 0 AND (mask & applied) <> 0 AS redundant,
        mask = bit AS lone
    FROM walk"""


def walk(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    return spark.sql(WALK.format(letters=", ".join(f"('{x}', {1 << k})" for k, x in enumerate(letters)), masks=1 << len(letters)))


def orders_of_prefixes(steps: DataFrame) -> DataFrame:
    """(filter_order, prefix): each whole order with its prefixes."""
    whole = steps.where(F.length("prefix") == len(LETTERS)).select(F.col("prefix").alias("filter_order")).distinct()
    return whole.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("n")).select("filter_order", F.substring("filter_order", F.lit(1), F.col("n")).alias("prefix"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows for each part of `docs`.

    `docs` has doc_id, text and the column `part` (null: empty string); null texts are empty, texts of
    any length count whole, and further columns are ignored, whatever their names. `labels` has doc_id,
    quality and toxic; nulls there are no label. An empty table has no parts and gives no rows.
    Repeated rows and null ids as in mask_cells().
    """
    spark = docs.sparkSession
    cells = stage(mask_cells(docs, labels, part), "mask_cells")
    steps = stage(walk(spark), "walk")  # 325 prefixes times 32 masks
    lost = lambda name, flag, n: F.sum(F.when(F.col(flag), F.col(n)).otherwise(0)).alias(name)
    met = cells.join(F.broadcast(steps), "mask").groupBy("part", "prefix", "step", "letter").agg(
        lost("kept", "kept", "n"), lost("removed", "removed", "n"), lost("redundant", "redundant", "n"), lost("unique_fails", "lone", "n"), lost("good_lost", "removed", "good"), lost("toxic_lost", "removed", "toxic"),
    )
    shown = met.join(F.broadcast(orders_of_prefixes(steps)), "prefix")
    return shown.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "letter"))).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
