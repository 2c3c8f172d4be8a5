"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, embedding_dedup, filter_audit, langid, lexical_search, minhash_dedup, ngram_lm, packing, quality_rules, secrets, toxicity, url_filter, warc
from gridloom.llm.common import crc_of_id, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all `documents` in sequences of at most 2048 tokens; null text is empty, repeated rows are packed each, an empty table gives no rows."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each row of `documents`; null and empty texts and null ids as in minhash_dedup.classes()."""
    return minhash_dedup.classes(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all `embeddings`; odd vectors link with nothing, as in embedding_dedup.link()."""
    return embedding_dedup.link(table(spark, sf_dir, "embeddings"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in `documents`; null and empty texts and items give none, repeated rows as in decontaminate.find()."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each row of `documents`, taught by labels outside the held-out fold. Null and empty texts get the score of no words; a null id is neither held out nor taught from; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    taught = crc_of_id("doc_id") % 5 != 0
    model = toxicity.fit(docs.where(taught), labels.where(taught))
    scored = toxicity.classify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(~taught, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each row of `documents`, taught outside the held-out fold. Texts without letters are `und`; a null id is neither held out nor taught from; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_of_id("doc_id") % 3 == 1, F.lit(False))
    model = langid.fit(docs.where(crc_of_id("doc_id") % 3 != 1), tokenizer_path("piece_bpe_32k.model"))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and record types read back from archives of all `pages`, and each capture's place in its URL's history. One row for each page with an id, as in warc.archive()."""
    # the table has no capture times: one second a page from a fixed day on
    date = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod("page_id", F.lit(1_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    index = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html", date.alias("warc_date")))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "warc_date", "history_no")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in each row of `documents`; null and empty texts have none, repeated rows give equal results, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secrets.fit(secrets.labelled_samples(docs))
    found = secrets.scan(docs, model.ratios, model.least_mean)
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"), n("markov"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of each row of `documents`, learnt outside the held-out fold. A null text is its end alone; a null id is neither held out nor learnt from; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_of_id("doc_id") % 7 == 2, F.lit(False))
    model = ngram_lm.train(docs.where(crc_of_id("doc_id") % 7 != 2))
    scored = ngram_lm.score(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": held_out})
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens_seen).cast("long").alias("train_tokens"), "base_score", "score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for each row of `pages`; a null url is judged as two empty strings, repeated rows alike, an empty table gives no rows."""
    judged = url_filter.fit(spark).apply(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best rows of `documents` for each row of `benchmark`; nulls, empty texts, repeated rows and empty tables as in lexical_search.search()."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over `documents` in all 120 orders, by source; nulls, repeated rows and empty tables as in filter_audit.audit()."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict for each row of `documents`; nulls, empty texts, repeated rows and empty tables as in quality_rules.judge()."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("own.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_secret_scan": op8_secret_scan,
    "op9_lm_scores": op9_lm_scores,
    "op10_url_filter": op10_url_filter,
    "op11_lexical_search": op11_lexical_search,
    "op12_filter_audit": op12_filter_audit,
    "op13_quality_rules": op13_quality_rules,
}

#: DuckDB twins of the queries that SQL can express; the others have brute-force twins in the tests.
ORACLES: dict[str, str] = {
    "op3_embedding_dedup": """
        WITH RECURSIVE good AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        reach(a, b) AS (SELECT vec_id, vec_id FROM good UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
        part AS (SELECT a, min(b) AS component FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(p.component, e.vec_id) AS component_id, e.vec_id IS NULL OR e.vec_id = coalesce(p.component, e.vec_id) AS kept
        FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN part p ON p.a = e.vec_id""",
    "op7_warc": """
        WITH p AS (
            SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d,
                strftime(make_timestamp((1704067200 + (page_id % 1000000000 + 1000000000) % 1000000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS warc_date,
                CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages WHERE page_id IS NOT NULL),
        q AS (
            SELECT *, regexp_extract(rest, '^[^/?#]*') AS place, regexp_replace(lower(regexp_extract(rest, '^[^/?#:]*')), '^www[0-9]*\\.', '') AS host,
                max(page_id) FILTER (WHERE n >= 1000) OVER (PARTITION BY d) AS original FROM p),
        k AS (
            SELECT *, CASE WHEN url IS NULL THEN '' ELSE array_to_string(list_reverse(list_filter(string_split(host, '.'), lambda x: x <> '')), ',') || ')' || lower(substr(rest, length(place) + 1)) END AS url_key FROM q)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id < original THEN original END AS refers_to, url_key, warc_date,
            row_number() OVER (PARTITION BY url_key ORDER BY warc_date, page_id) - 1 AS history_no
        FROM k""",
    "op11_lexical_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
            FROM documents),
        q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
            FROM benchmark WHERE item_id IS NOT NULL),
        s AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS terms FROM d WHERE len(ts) > 0),
        f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
        w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM s) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f GROUP BY t),
        m AS (SELECT r, doc_id, 100 - 90 + (90 * len(ts) * (SELECT docs FROM s)) // (SELECT terms FROM s) AS m FROM d WHERE len(ts) > 0),
        p AS (
            SELECT item_id, m.r, m.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
            FROM q JOIN w USING (t) JOIN f USING (t) JOIN m ON m.r = f.r GROUP BY item_id, m.r, m.doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score
        FROM p WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= 10""",
    "op12_filter_audit": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        first AS (SELECT text, min(doc_id) AS first FROM words GROUP BY text),
        mark AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
        doc AS (
            SELECT part, coalesce(m.quality = 1, false) AS good, coalesce(m.toxic = 1, false) AS bad,
                (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
                + (CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]+', '', 'g')) > 2 * length(d.text) THEN 4 ELSE 0 END)
                + (CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN coalesce(d.doc_id > f.first, false) THEN 16 ELSE 0 END) AS mask
            FROM words d JOIN first f ON f.text = d.text LEFT JOIN mark m ON m.doc_id = d.doc_id),
        cell AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM doc GROUP BY part, mask),
        letter(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        walk(prefix, applied, bit, letter) AS (
            SELECT letter, 0, bit, letter FROM letter
            UNION ALL
            SELECT w.prefix || l.letter, w.applied | w.bit, l.bit, l.letter FROM walk w JOIN letter l ON ((w.applied | w.bit) & l.bit) = 0),
        met AS (
            SELECT part, prefix, letter, CAST(sum(CASE WHEN mask & (applied | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
                CAST(sum(CASE WHEN mask & bit <> 0 AND mask & applied = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
                CAST(sum(CASE WHEN mask & bit <> 0 AND mask & applied <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
                CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
                CAST(sum(CASE WHEN mask & bit <> 0 AND mask & applied = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
                CAST(sum(CASE WHEN mask & bit <> 0 AND mask & applied = 0 THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost
            FROM cell, walk GROUP BY part, prefix, letter)
        SELECT part, o.prefix AS filter_order, CAST(length(m.prefix) AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
        FROM met m JOIN (SELECT prefix FROM walk WHERE length(prefix) = 5) o ON starts_with(o.prefix, m.prefix)""",
    "op13_quality_rules": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        raw AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        line AS (SELECT r, trim(regexp_replace(lower(unnest(ls)), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM raw),
        host AS (SELECT host, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'r' || r)) AS total FROM d GROUP BY host),
        often AS (
            SELECT host, line FROM line JOIN d USING (r) JOIN host USING (host)
            GROUP BY host, line, total HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'r' || r)) > greatest(10, total * 0.01)),
        lost AS (SELECT r, sum(len(string_split(line, ' '))) AS n FROM line JOIN d USING (r) JOIN often USING (host, line) GROUP BY r),
        triple AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
        again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM triple) WHERE n > 1),
        rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + unnest([0, 1, 2]) AS i FROM again) GROUP BY r),
        m AS (
            SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS removed_words
            FROM d JOIN raw USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
            NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (removed_words > 0 AND (n_words - removed_words < 50 OR (n_words - removed_words) * 2 < n_words)) AS kept, removed_words
        FROM m""",
}
