"""Embeddings, URL filters, the pipeline, and the registered queries against SQL."""

import importlib
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corridor.llm import capfilter, queries, urlfilter

DIR = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are absent")


def brute(rows, cosine=0.95):
    good = {i: np.array(v, float) / max(map(abs, v)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i, _ in rows}
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]):
                x, y = good[a], good[b]
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[a].add(b)
                    links[b].add(a)
    comp = {}
    for i in sorted(links):
        if i not in comp:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in comp:
                    comp[k] = i
                    todo += links[k]
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(capfilter, "BLOCK", 16)
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((8, 24))
    rows = [(k, (centres[k % 8] + 0.18 * rng.standard_normal(24)).tolist()) for k in range(200)]
    rows += [(300 + k, rows[0][1]) for k in range(20)] + [(400, None), (401, []), (402, [0.0] * 24), (403, [float("nan")] * 24), (404, [None] + [1.0] * 23), (405, [float("inf")] + [0.0] * 23), (406, [1.0, 2.0]), (407, [2.0, 4.0]), (408, [1e-200] * 24), (409, [-0.0] * 23 + [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS component", "2 AS v")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in capfilter.near_duplicates(df).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert got == want  # no link is missed: by the plan at most one in a million is
    assert capfilter.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_repeated_rows_and_null_ids(spark):
    v, other = [1.0, 2.0, 0.5, 1.0], [-1.0, 0.0, 3.0, 0.2]
    rows = [(2, v), (2, v), (5, v), (7, other), (7, other), (None, v), (None, None), (9, None)]
    got = sorted(map(str, capfilter.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    row = lambda i, n, c, k: f"Row(vec_id={i}, n_links={n}, component_id={c}, kept={k})"
    assert got == sorted([row(2, 1, 2, True)] * 2 + [row(5, 1, 2, False)] + [row(7, 0, 7, True)] * 2 + [row(None, 0, None, True)] * 2 + [row(9, 0, 9, True)])


@pytest.mark.parametrize("seed", range(5))
def test_forests_connect_what_the_pairs_connect(seed):
    rng = np.random.default_rng(seed)
    u, w = rng.integers(0, 60, (2, int(rng.integers(0, 70))))
    p, q = capfilter._forest(u, w, 60)
    component = lambda a, b: brute_components(a.tolist(), b.tolist(), 60)
    assert component(u, w) == component(p, q) and len(p) < 60


def brute_components(a, b, n):
    label = list(range(n))
    for _ in range(n):
        for x, y in zip(a, b, strict=True):
            label[x] = label[y] = min(label[x], label[y])
    return label


def test_addresses_are_named_as_a_whole(spark):
    urls = [(1, "http://10.1.3.4/a"), (2, "http://x.3.4.com/"), (3, "10.1.3.4/a"), (4, "http://[::1]/b")]
    c = spark.createDataFrame([(i, u, 5) for i, u in urls], "page_id long, url string, day int").withColumn("blocks", F.lit(9))
    e = spark.createDataFrame([("l", "block", p, 1, "add", 1) for p in ("3.4", "10.1.3.4", "4.com")], "list string, kind string, pattern string, day int, action string, seq int")
    assert {r.page_id: (r.blocks, r.first_rule) for r in urlfilter.judged(c, e).collect()} == {1: (1, "l|10.1.3.4"), 2: (1, "l|4.com"), 3: (0, None), 4: (0, None)}


def test_decoding_finds_exactly_the_exceeded_filters():
    rng = np.random.default_rng(1)
    x = capfilter._unit(rng.standard_normal((30, 10)))
    t, m = 1.2, 12
    r, f = capfilter.decode(x, t, m)
    q, b1, b2 = capfilter.code(10, m)
    y = x @ q
    s = (y[:, :5] @ b1.T * 5**0.5)[:, :, None] + (y[:, 5:] @ b2.T * 5**0.5)[:, None, :]
    want = {(i, a * m + b) for i, a, b in zip(*np.nonzero(s >= t), strict=True)}
    got = set(zip(r.tolist(), f.tolist(), strict=True))
    assert want <= got and {i for i, _ in got - want}.isdisjoint({i for i, _ in want})


@pytest.mark.parametrize("n, dim", [(10_000, 64), (3_000_000, 64), (1_000_000, 16), (1_000_000, 4), (100_000, 3), (1000, 2), (100, 1)])
def test_pairs_at_the_threshold_share_a_filter_at_every_size(n, dim):
    x, y = capfilter.pairs_at(300, dim, 0.951, 3)
    t, m, codes = capfilter.plan(n, dim, 0.95)
    assert (sum(capfilter.sharing(x, y, t, m, c) for c in range(codes)) > 0).all()


def judge(spark, urls, events):
    c = spark.createDataFrame([(i, u, d) for i, (u, d) in enumerate(urls)], "page_id long, url string, day int")
    e = spark.createDataFrame(events, "list string, kind string, pattern string, day int, action string, seq int")
    return {r.page_id: (r.blocks, r.allows, r.blocked) for r in urlfilter.judged(c, e).collect()}


def test_entries_hold_from_their_day_to_the_next_event(spark):
    ev = [("l", "block", "bad.org", 5, "add", 1), ("l", "block", "bad.org", 8, "remove", 2), ("l", "block", "bad.org", 8, "remove", 2), ("l", "block", None, 1, "add", 1), ("l", "block", "x.org", None, "add", 1),
          ("l", "block", "twice.org", 3, "add", 1), ("l", "block", "twice.org", 3, "remove", 2), ("a", "allow", "http://bad.org/ok", 6, "add", 1)]
    urls = [("http://bad.org/p", 4), ("http://bad.org/p", 5), ("http://u@WWW.Bad.ORG.:80/p?q", 7), ("http://bad.org/p", 8), ("http://bad.org/ok?x#y", 7), ("http://twice.org", 9), (None, 5), ("nonsense", 5), ("http://bad.org/", None), ("http://notbad.org/", 6)]
    got = judge(spark, urls, ev)
    assert [k for k, v in got.items() if v[2]] == [1, 2] or {k for k, v in got.items() if v[2]} == {1, 2}
    assert got[4] == (1, 1, False) and len(got) == len(urls)
    assert judge(spark, [], ev) == {} and judge(spark, urls[:2], []) == {0: (0, 0, False), 1: (0, 0, False)}


def test_repeated_captures_are_all_returned_with_single_counts(spark):
    rows = [(1, "http://a.bad.org/p", 5)] * 3 + [(1, "http://a.bad.org/p", 4), (None, None, None), (None, None, None), (2, "http://bad.org/", None)]
    c = spark.createDataFrame(rows, "page_id long, url string, day int")
    e = spark.createDataFrame([("l", "block", "bad.org", 5, "add", 1)], "list string, kind string, pattern string, day int, action string, seq int")
    got = sorted(map(str, urlfilter.judged(c, e).select("page_id", "url", "day", "blocks", "first_rule", "blocked").collect()))
    want = [(*r, int(r[2] == 5), "l|bad.org" if r[2] == 5 else None, r[2] == 5) for r in rows]
    assert got == sorted(map(str, spark.createDataFrame(want, "page_id long, url string, day int, blocks long, first_rule string, blocked boolean").collect()))


def norm(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else str(x)


@there
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    ours = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    assert ours == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())


@there
def test_all_ten_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
    entry = importlib.import_module("__spark_entry__")
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@there
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    n, ids = docs.count(), {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        if k == len(corpus_pipeline.STAGES) - 1:
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == ids
            break
        assert out.columns == docs.columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= ids and 0.6 * n < len(kept)
        ids = kept
    assert len(ids) < n


@there
def test_stages_take_empty_tables_and_nulls(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(3)
    odd = docs.limit(0).unionByName(docs.selectExpr("doc_id", "CAST(NULL AS string) AS text", "CAST(NULL AS string) AS lang", "CAST(NULL AS string) AS source", "CAST(NULL AS long) AS n_chars"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DIR).count() == 0, name
        stage(spark, odd, DIR).collect()


@there
def test_stages_equal_brute_force_on_odd_tables(spark):
    """Repeated rows, null ids, names that operators use, a text beyond a chunk: each stage against its own input."""
    from test_text_operators import jaccard_components, prose, removed

    from corridor.llm import cotrain, tokens, toxicity

    base = spark.read.parquet(f"{DIR}/documents.parquet").limit(110)
    long_ = prose(50, 180_000)
    assert len(long_) > 1 << 20
    extra = [(5000, long_), (5001, "start " + long_[700_000:720_000]), (5002, ""), (5003, None), (None, prose(51, 40)), (None, None)]
    more = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in extra], base.schema)
    docs = base.unionByName(more).unionByName(base.limit(5))
    for name in ("sig", "marks", "row", "key", "score", "place", "component_id", "text_score"):
        docs = docs.withColumn(name, F.lit(7))
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        given = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, DIR).collect()
        key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
        got = sorted(((r.doc_id, r.text) for r in out), key=key) if name != "packing" else None
        labels = spark.read.parquet(f"{DIR}/labels.parquet")
        if name in ("toxicity", "quality_classifier"):
            op, col = (toxicity, "toxicity") if name == "toxicity" else (cotrain, "quality_score")
            plain = docs.select("doc_id", "text", "lang", "source")
            rows = op.scored(plain, op.train(plain, labels)).collect()
            want = [(r.doc_id, r.text) for r in rows if (r[col] < 0.7 if name == "toxicity" else r[col] >= 0.5)]
        elif name == "minhash_near_dedup":
            label = jaccard_components([x for x in {k: v for k, v in given if k is not None}.items()], 5)
            want = [(i, t) for i, t in given if i is None or label[i][1] == i]
        elif name == "suffix_array_dedup":
            size = {i: x[0] - x[1] for i, x in removed(sorted({k: v for k, v in given if k is not None}.items()), 100).items()}
            assert all(len((t or "").encode()) <= size.get(i, 1 << 30) for i, t in got)
            assert [i for i, _ in got] == [i for i, _ in sorted(given, key=key)]
            assert sum(len((t or "").encode()) < size.get(i, 0) for i, t in got) <= 3  # bytes of characters that were cut
            want = got
        else:
            ids = tokens.word_ids(tokens.vocabulary_path())
            raw = [(t or "").encode() for _, t in given]
            _, count = ids.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]))
            assert sum(r.length for r in out) == count.sum()
            break
        assert got == sorted(want, key=key), name
        docs = spark.createDataFrame([r for r in out], docs.schema)


def test_embeddings_meet_in_passes_whose_shuffles_go(spark, monkeypatch):
    monkeypatch.setattr(capfilter, "AT_ONCE", 300_000)
    monkeypatch.setattr(capfilter, "BLOCK", 64)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    rows = [(k, (centres[k % 40] + 0.2 * rng.standard_normal(16)).astype(np.float32).astype(float).tolist()) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "cast(embedding as array<float>) as embedding")
    files = lambda: spark._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().size()
    written, wrote = [], capfilter.saved

    def saved(d):
        out = wrote(d)
        written.append((d.columns, files()))
        return out

    monkeypatch.setattr(capfilter, "saved", saved)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in capfilter.near_duplicates(df).collect()}
    assert got == brute(rows)
    turns = [n for c, n in written if c == ["rep", "n", "other"]]
    assert len(turns) > 3 and max(turns) == turns[0]  # no pass leaves what it sent
