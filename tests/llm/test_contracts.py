"""The registered queries against DuckDB and the standard library: contract columns, types, folds and values, on the smallest tables."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from gridloom.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return duck.sql("select doc_id, coalesce(text, '') from documents").fetchall()


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def types(df, expected):
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields][: len(expected.split(", "))] == [tuple(c.split()) for c in expected.split(", ")]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    key = lambda row: tuple((v is None, v) for v in row)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=key)
    assert got == sorted(duck.sql(f"select {', '.join(order)} from ({queries.ORACLES[name]})").fetchall(), key=key) and got


def test_packing(spark, documents, tokenizers):
    from tokenizers import Tokenizer

    df = queries.op1_packing(spark, SF)
    types(df, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    ids = {i: [*Tokenizer.from_file(tokenizers("word_bpe_49k.json")).encode(t, add_special_tokens=False).ids, 1] for i, t in documents}
    pieces, sequences = {}, {}
    for r in df.collect():
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert len(own) == r.length > 0 and zlib.crc32(own.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    gapless = lambda spans: [a for a, _ in sorted(spans)] == np.cumsum([0, *(n for _, n in sorted(spans))])[:-1].tolist()
    assert pieces.keys() == ids.keys() and all(gapless(s) and sum(n for _, n in s) == len(ids[i]) for i, s in pieces.items())
    assert all(gapless(s) and sum(n for _, n in s) <= 2048 for s in sequences.values())


def test_toxicity(spark, documents):
    df = queries.op5_toxicity(spark, SF)
    types(df, "doc_id bigint, held_out boolean, score double, predicted int")
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in documents)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_language(spark, documents):
    df = queries.op6_language_id(spark, SF)
    types(df, "doc_id bigint, held_out boolean, lang_pred string, score double")
    rows = {r.doc_id: r for r in df.collect()}
    assert rows.keys() == {i for i, _ in documents}
    assert all(r.held_out == (fold(i, 3) == 1) and 0 <= r.score <= 1 for i, r in rows.items())
    assert all((rows[i].lang_pred == "und") == (not any(map(str.isalpha, t))) for i, t in documents)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_secrets(spark, documents):
    df = queries.op8_secret_scan(spark, SF)
    types(df, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    rows = {r.doc_id: r for r in df.collect()}
    for i, t in documents:
        base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(base))
        r = rows.pop(i)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("markov")) == joined
    assert not rows


def test_language_model(spark, duck):
    df = queries.op9_lm_scores(spark, SF)
    types(df, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    duck.create_function("crc", lambda i: zlib.crc32(str(i).encode()), ["BIGINT"], "BIGINT")
    want = duck.sql("""
        with t as (select doc_id, crc(doc_id) % 7 = 2 as held_out, list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda w: w <> ''), E'\\n') as w from documents),
        x as (select doc_id, held_out, unnest(w) as w from t),
        c as (select w, count(*) as c from x where not held_out group by w),
        n as (select sum(c) as n, count(*) as v from c)
        select doc_id, any_value(held_out), count(*), count(c.c), any_value(n.n), sum(log10((coalesce(c.c, 0) + 1) / (n.n + (n.v + 1))))
        from x left join c using (w), n group by doc_id""").fetchall()
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == len(want)
    for i, held_out, tokens, known, total, base in want:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out, tokens, known, total)
        # N + 1 * (V + 1), as the contract's formula was read
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0


def test_urls(spark, duck):
    df = queries.op10_url_filter(spark, SF)
    types(df, "page_id bigint, host string, path string, rule string, verdict string")
    want = duck.sql("""
        with p as (select page_id, translate(case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') else '' end, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path from pages),
        r(verdict, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        m as (select page_id, arg_max(h || r.p, length(h || r.p)) as rule, arg_max(verdict, length(h || r.p)) as verdict from p, r where (host = h or ends_with(host, '.' || h)) and starts_with(path, r.p) group by page_id)
        select p.page_id, host, path, rule, m.verdict from p left join m using (page_id)""").fetchall()
    got = {r.page_id: r for r in df.collect()}
    assert len(got) == len(want)
    for i, host, path, rule, verdict in want:
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
