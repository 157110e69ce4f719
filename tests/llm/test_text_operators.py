"""Operators on texts against brute force, exact round trips and held-out accuracy, with the awkward cases."""

import collections
import hashlib
import itertools
import re
import struct
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corridor.llm import common, cotrain, learn, lm, media, minhash, packing, pieces, rlindex, suffix, tokens, toxicity
from corridor.llm.components import connected

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[k] + str(rng.integers(0, 40)) for k in rng.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 220)
    near = base.split()
    near[100] = "OTHER"
    out = [None, "", " \t\n", "one", "One two", "one two", base, base, " ".join(near), prose(2, 90), "x" * 450, "ab" * 300, prose(3, 4), "Grüße an alle ▁   \x01 end \x00",
           prose(4, 3000), prose(5, 60) + "\n" + base[200:700], base[150:260], "it's <|endoftext|> Ünïcodé ! 12 34,5"]
    return list(enumerate(out, 10))


@pytest.fixture
def docs(spark, texts):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "src", None if t is None else len(t)) for i, t in texts]
    # an extra column with a name that operators use themselves
    return spark.createDataFrame(rows, SCHEMA).withColumn("sig", F.lit("mine")).withColumn("component_id", F.lit(-1)).withColumn("marks", F.lit(0)).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def word_list(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER))


# ------------------------------------------------------------------ components and near-duplicates


def test_components(spark):
    e = [(1, 2), (2, 3), (3, 1), (7, 8), (9, 9), (None, 4)] + [(20, k) for k in range(21, 60)] + [(k, k + 1) for k in range(100, 140)]
    got = {r.id: r.component for r in connected(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {k: 1 for k in (1, 2, 3)} | {7: 7, 8: 7} | {k: 20 for k in range(20, 60)} | {k: 100 for k in range(100, 141)}


def jaccard_components(texts, n, percent=80):
    sets = {}
    for i, t in texts:
        w = word_list(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("n", [4, 5])
def test_minhash_equals_brute_force(spark, docs, texts, n):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, n).collect()}
    assert got == jaccard_components(texts, n)
    assert got[16][1] == got[17][1] == got[18][1] == 16 and got[14][1] == got[15][1] == 14


def test_minhash_many_near_copies_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    base = prose(9, 80).split()
    rows = [(k, " ".join(base[:k] + [f"new{k}"] + base[k + 1 :])) for k in range(60)] + [(200, prose(10, 50)), (200, prose(10, 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in minhash.near_duplicates(df, 5).collect()]
    want = {i: c for i, (_, c) in jaccard_components(rows, 5).items()}
    assert sorted(got) == sorted([(i, want[i]) for i, _ in rows])


def test_minhash_large_groups_in_blocks(spark, monkeypatch):
    """Candidate groups of several true groups, far beyond the block sizes."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "GROUP_BYTES", 3000)
    base, rows = prose(21, 60).split(), []
    for k in range(5):
        own = base[: 8 * k + 5] + [f"own{k}{j}" for j in range(3)] + base[8 * k + 8 :]
        rows += [(100 * k + j, " ".join([*own[:57], f"end{j}", *own[58:]]) if j else " ".join(own)) for j in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 5).collect()}
    want = jaccard_components(rows, 5)
    assert len({c for _, c in want.values()}) > 1 and got == want


def test_minhash_empty_and_null_ids(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    df = spark.createDataFrame([(None, prose(1, 30)), (1, prose(1, 30)), (2, prose(1, 30))], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == {None: (None, True), 1: (1, True), 2: (1, False)}


# ------------------------------------------------------------------ repeated strings


def removed(rows, size):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for p in range(len(b) - size + 1):
            w = b[p : p + size]
            if w in seen:
                hit[p : p + size] = b"\1" * size
            seen.add(w)
        left = bytes(c for c, h in zip(b, hit, strict=True) if not h)
        out[i] = (len(b), sum(hit), sum(1 for k in range(len(hit)) if hit[k] and (not k or not hit[k - 1])), hashlib.sha256(left).hexdigest())
    return out


def digest(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_suffix_equals_brute_force(spark, docs, texts):
    assert digest(suffix.deduplicated(docs)) == removed(texts, 100)


@pytest.mark.parametrize("seed", range(4))
def test_segments_of_periodic_and_random_text(seed):
    """Equal windows have equal anchors, and every window lies in one segment."""
    rng = np.random.default_rng(seed)
    t = [bytes(rng.choice(list(b"ab" if seed % 2 else b"abcdefgh"), 400)), b"xyz" * 90, b"q" * 300, b"xyz" * 50, bytes(range(120))]
    t.append(t[0][37:260])
    data, off = np.frombuffer(b"".join(t), np.uint8), np.cumsum([0] + [len(x) for x in t])
    got = suffix.segments(data, off, 100, np.zeros(0, np.uint64))
    anchor, windows = {}, 0
    for a, d, s, nw in zip(got["a"].tolist(), got["d"].tolist(), got["s"].tolist(), got["nw"].tolist(), strict=True):
        for p in range(s, s + nw):
            w = t[d][p : p + 100]
            assert anchor.setdefault(w, a) == a
            windows += 1
    assert windows == sum(max(0, len(x) - 99) for x in t)


@pytest.mark.parametrize("many, split, share", [(4096, 64, 1), (20, 1 << 40, 64), (20, 200, 4)])
def test_suffix_hot_anchors_go_by_windows(spark, monkeypatch, many, split, share):
    """Found beforehand, found in a bucket, or either: the same bytes go."""
    for name, value in (("MANY", many), ("SPLIT", split), ("SHARE", share)):
        monkeypatch.setattr(suffix, name, value)
    shared = prose(77, 25)  # a passage with other words around it in every document
    rows = [(k, prose(100 + k, 12) + " " + shared + " " + prose(300 + k, 12)) for k in range(700)] + [(900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert digest(suffix.deduplicated(df)) == removed(rows, 100)


def test_suffix_whatever_anchors_collide(spark, monkeypatch):
    """Anchors only bring segments together: with eight different ones the same bytes go."""
    narrow = suffix.substring
    monkeypatch.setattr(suffix, "substring", lambda h, s, e: narrow(h, s, e) % np.uint64(8))
    rows = [(k, prose(k % 7, 40) + prose(k, 30)) for k in range(25)]
    data, off = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8), np.cumsum([0] + [len(t) for _, t in rows])
    got = suffix.segments(data, off, 100, np.zeros(0, np.uint64))
    assert len(np.unique(got["a"])) <= 8
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert digest(suffix.deduplicated(df)) == removed(rows, 100)


def test_suffix_long_documents(spark):
    """Documents beyond a chunk of bytes, with a repeat far inside and a copy of half of one."""
    base = prose(8, 200_000)
    assert len(base) > 1 << 20
    rows = [(1, base), (2, prose(9, 50) + base[500_000:1_100_000]), (3, "y" * 3000 + base[1_000_000:1_000_400])]
    got = digest(suffix.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1][1] == 0 and got[2][:3] == (len(rows[1][1]), 600_000, 1)
    assert got[3][:3] == (3400, 3399, 1)  # all but the first of the equal bytes


def test_suffix_every_period_in_one_document(spark):
    rng = np.random.default_rng(9)
    rows = []
    for times in (2, 3, 5):
        for period in range(1, 201):
            rows.append((len(rows), "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz \n"), period)) * times))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert digest(suffix.deduplicated(df, size=100)) == removed(rows, 100)


def test_suffix_index_of_the_usual_size_takes_little_memory():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 123, suffix.INDEX_SYMBOLS, dtype=np.uint8)
    off = np.append(np.arange(0, len(data), 150), len(data))
    tracemalloc.start()
    try:
        rlindex.RunIndex(data, off).repeats(100)
        assert tracemalloc.get_traced_memory()[1] < 48 << 20
    finally:
        tracemalloc.stop()


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_worker_gives_back_what_its_task_freed():
    def task(batches):
        held = [np.ones(6000) for _ in range(4000)]  # small enough to lie in the heap
        kept.append(held[-1])  # at its end, so that nothing before it goes back by itself
        yield from batches

    kept = []
    before = resident()
    assert list(common.tidy(task)([1, 2])) == [1, 2]
    assert resident() - before < 64 << 20  # of 192 MB


def test_tokenizers_are_forgotten():
    tokens.word_ids(tokens.vocabulary_path())
    tokens.forget()
    assert not tokens._memory


def test_suffix_repeated_rows_empty_tables_and_cleaning(spark, docs, texts):
    assert suffix.deduplicated(empty(spark)).count() == 0
    t = prose(5, 60)
    twice = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix.deduplicated(twice).collect())
    assert got == [("1", 0), ("1", 0), ("2", len(t)), ("None", 0)]
    out = suffix.cleaned(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[17].text == "" and rows[17].n_chars == 0 and rows[10].text is None and rows[16].text == texts[6][1] and rows[17].marks == 0


@pytest.mark.parametrize("seed", range(6))
def test_run_index_finds_all_repeats(seed):
    rng = np.random.default_rng(seed)
    t = [bytes(rng.choice(list(b"ab"), rng.integers(0, 50))) for _ in range(7)]
    t += [t[2], b"aaaaaaaaaaaa", b""]
    data, off = np.frombuffer(b"".join(t), np.uint8), np.cumsum([0] + [len(x) for x in t])
    index = rlindex.RunIndex(data, off)
    assert index.lengths.sum() == len(data) + len(t)
    seen, want, p = set(), [], 0
    for x in t:
        for i in range(len(x)):
            if i + 6 <= len(x):
                if x[i : i + 6] in seen:
                    want.append(p)
                seen.add(x[i : i + 6])
            p += 1
        p += 1
    assert index.repeats(6).tolist() == want


# ------------------------------------------------------------------ learnt operators


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(4)
    docs, labels = [], []
    for k in range(900):
        w = prose(1000 + k, int(rng.integers(20, 90))).split()
        toxic = k % 6 == 0
        if toxic:
            for at in rng.integers(0, len(w), 4):
                w[at] = ["idiotx", "moronx"][int(rng.integers(0, 2))]
        bad = k % 5 == 0
        docs.append((k, " ".join(x + "%%%" for x in w) if bad else " ".join(w) + ".", "en", f"s{k % 3}", 0))
        labels.append((k, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r for r in labels}


def held(i, m=3, r=1):
    return zlib.crc32(str(i).encode()) % m == r


def test_toxicity_on_held_out_rows(spark, corpus, docs):
    d, labels, truth = corpus
    model = toxicity.train(d, labels)
    got = [r for r in toxicity.scored(d, model, passages_col="passages").collect() if held(r.doc_id)]
    right = sum((r.toxicity >= 0.7) == bool(truth[r.doc_id][2]) for r in got)
    assert right / len(got) > 0.97
    assert all(r.passages for r in got if truth[r.doc_id][2])
    odd = toxicity.scored(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.toxicity < 0.5 for r in odd) and odd[0].sig == "mine"


def test_toxicity_without_labels(spark, corpus):
    d, labels, _ = corpus
    model = toxicity.train(d, labels.limit(0))
    assert {round(r.toxicity, 3) for r in toxicity.scored(d.limit(5), model).collect()} == {0.5}
    assert toxicity.scored(empty(spark), model).count() == 0


def maximal_by_definition(x):
    """All segments each of whose proper beginnings and ends has a positive sum, and that no longer such one holds."""
    sums = np.concatenate([[0], np.cumsum(x)])
    good = []
    for a in range(len(x)):
        for b in range(a, len(x)):
            inner = sums[a + 1 : b + 1]
            if sums[b + 1] > sums[a] and (inner > sums[a]).all() and (inner < sums[b + 1]).all():
                good.append((a, b))
    return sorted(g for g in good if not any(h != g and h[0] <= g[0] and g[1] <= h[1] for h in good))


def test_extremes_match_the_tail():
    """Greatest segments drawn from the distribution: its parameters, and as many exceedances as expected."""
    rng = np.random.default_rng(6)
    n = rng.integers(20, 2000, 20_000)
    top = np.maximum((np.log(0.01 * n) - np.log(-np.log(rng.random(len(n))))) / 1.7, 0)
    rate, k = toxicity.extremes(n, np.where(top < 1.0, 0, top), 1.0)
    assert rate == pytest.approx(1.7, rel=0.04) and k == pytest.approx(0.01, rel=0.1)
    for x in (2.0, 3.0, 4.0):
        assert (1 - np.exp(-k * n * np.exp(-rate * x))).sum() == pytest.approx((top > x).sum(), rel=0.1)
    assert all(np.isfinite(toxicity.extremes(np.array([5, 0]), np.zeros(2), 0.7))) and all(np.isfinite(toxicity.extremes(np.zeros(0), np.zeros(0), 1.0)))


def test_toxicity_expects_as_many_segments_as_harmless_texts_have(spark):
    """Harmless texts hold the words too, now and then: expected and observed exceedances agree on held-out ones."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for k in range(3000):
        w = prose(k, int(rng.integers(20, 120))).split()
        toxic = k % 4 == 0
        for at in rng.integers(0, len(w), 5 if toxic else rng.poisson(len(w) / 100)):
            w[at] = ["idiotx", "moronx"][int(rng.integers(0, 2))]
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    calm = [(t or "").encode() for k, t in rows if k % 4 and held(k)]
    got = toxicity.evidence(np.frombuffer(b"".join(calm), np.uint8), np.cumsum([0] + [len(t) for t in calm]), model.table)
    n, top = np.array([x for x, _ in got]), np.array([max((s for _, _, s in g), default=0) for _, g in got])
    for x in (1, 2, 3):
        x *= float(model.table.score.min())
        want = (1 - np.exp(-model.k * n * np.exp(-model.rate * x))).sum()
        assert want == pytest.approx((top >= x).sum(), rel=0.3, abs=8)


def test_names_that_exist_are_refused(spark, corpus):
    d, labels, _ = corpus
    model = toxicity.train(d, labels)
    with pytest.raises(ValueError, match="toxicity"):
        toxicity.scored(d.withColumn("Toxicity", F.lit(1)), model)
    with pytest.raises(ValueError, match="text_score"):
        cotrain.scored(d.withColumn("text_score", F.lit(1)), cotrain.train(d.limit(0), labels))
    with pytest.raises(ValueError, match="parts"):
        media.sniffed(d.select(F.col("text").cast("binary").alias("v"), F.lit(1).alias("parts")), "v")


def test_maximal_segments_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        at = np.sort(rng.choice(n, int(rng.integers(0, n)), replace=False))
        s = rng.integers(1, 5, len(at)) + 0.25
        full = np.full(n, -1.0)
        full[at] = s
        got = toxicity.maximal_segments(s, at, -1.0)
        if len(at):  # the best of all substrings is among them
            best = max(full[a:b].sum() for a in range(n) for b in range(a + 1, n + 1))
            assert max(x for _, _, x in got) == pytest.approx(best)
        for a, b, x in got:
            assert full[a : b + 1].sum() == pytest.approx(x)
        assert sorted((a, b) for a, b, _ in got) == maximal_by_definition(full)
        assert all(p[1] < q[0] for p, q in itertools.pairwise(sorted(got)))


def test_exchanged_labels_improve_each_view():
    """Views that see different halves of what tells classes apart, and few labels: the exchange helps both."""
    gains = []
    for seed in range(6):
        rng = np.random.default_rng(seed)
        y = rng.integers(0, 2, 3000)
        text, meta = (np.where(y == 1, 1.0, -1.0)[:, None] * w + rng.normal(0, 1, (3000, 25)) for w in (rng.normal(0, 0.38, 25), rng.normal(0, 0.38, 25)))
        known = np.where(np.arange(3000) < 60, y, -1)
        test = np.arange(3000) >= 1500
        known_ = np.where(test, -2, known)
        accuracy = []
        for rounds in (0, 4):
            m = cotrain.cotrain(text[~test], meta[~test], known_[~test], rounds)
            z = m.logits(text[test], meta[test])
            accuracy.append(((z > 0) == (y[test] == 1)[:, None]).mean(axis=0))
        gains.append(accuracy[1] - accuracy[0])
    assert (np.mean(gains, axis=0) > 0.005).all()


def test_quality_text_view_reads_words(spark):
    """Good and bad documents differ in their words alone: same letters' classes, lengths and metadata."""
    rng = np.random.default_rng(2)
    good, bad = (["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(12)] for _ in range(2))
    rows = [(k, " ".join(rng.choice(good if k % 2 else bad, 30)), "en", "s", 0) for k in range(600)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, quality int")
    d = spark.createDataFrame(rows, SCHEMA)
    got = [r for r in cotrain.scored(d, cotrain.train(d, labels)).collect() if r.doc_id >= 400]
    assert np.mean([(r.text_score > 0.5) == (r.doc_id % 2 == 1) for r in got]) > 0.95


def test_cotraining_on_held_out_rows(spark, corpus, docs):
    d, labels, truth = corpus
    model = cotrain.train(d, labels.where("doc_id < 300"))  # the others are the unlabelled pool
    got = [r for r in cotrain.scored(d, model).collect() if r.doc_id >= 300 or held(r.doc_id)]
    assert sum((r.quality_score >= 0.5) == bool(truth[r.doc_id][1]) for r in got) / len(got) > 0.97
    assert len(cotrain.scored(docs, model).collect()) == docs.count()
    assert cotrain.scored(empty(spark), model).count() == 0
    nothing = cotrain.train(empty(spark), labels.limit(0))
    assert cotrain.scored(d.limit(1), nothing).first().quality_score == 0.5


def test_logistic_is_the_maximum(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3))
    y = (x @ [2.0, -1.0, 0.0] + 0.5 + rng.logistic(size=400) > 0).astype(float)
    w = learn.logistic(x, y, 1e-3)
    p = learn.sigmoid(x @ w[:-1] + w[-1])
    np.testing.assert_allclose(x.T @ (p - y) + 1e-3 * 400 * w[:-1], 0, atol=1e-5)


def test_language_model_counts_and_normalisation(spark, docs, texts):
    got = {r.doc_id: r for r in lm.scores(docs).collect()}
    tok = {i: word_list(t) + [None] for i, t in texts}
    c = collections.Counter(x for i, w in tok.items() if not held(i, 7, 2) for x in w)
    n, v = sum(c.values()), len(c)
    for i, w in tok.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, held(i, 7, 2))
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0
    assert lm.scores(empty(spark)).count() == 0


def toy_model(seed=0, words_=60, tokens_=6000):
    """A model of words that mostly follow their neighbours, and its stream of rows."""
    rng = np.random.default_rng(seed)
    keys = rng.integers(1, 1 << 62, words_).astype(np.uint64)
    counts = np.sort(rng.integers(20, 400, words_))[::-1]
    v = lm.Vocabulary(keys, counts, rng.integers(0, 90, lm.SHAPES).astype(float), rng.integers(1, 9, lm.SHAPES).astype(float), 50)
    row = np.empty(tokens_, np.int64)
    row[0] = 3
    for k in range(1, tokens_):
        row[k] = (row[k - 1] + 1) % words_ if rng.random() < 0.9 else rng.integers(0, v.rows)
    return v, row, np.full(20, tokens_ // 20)


def test_language_model_is_normalised_and_learns():
    v, row, count = toy_model()
    assert v.word_classes == 8 and (np.diff(v.cls[: v.size]) >= 0).all() and sorted(v.row.tolist()) == list(range(v.size))
    assert v.index(v.keys, np.zeros(v.size, np.uint8)).tolist() == v.row.tolist()
    place = lm.places(count)
    assert place[:3].tolist() == [0, 1, 2] and place[299] == 299 and place[300] == 0
    m = lm.Bilinear(v)
    before = m.log_probs(row, place).mean()
    stream = lm.Stream(m, 1)
    for _ in range(30):
        stream.add(row, count)
    stream.end()
    assert m.log_probs(row, place).mean() > before + 1
    for high in (0, 200):  # beyond what single precision can raise e to
        m.u[:, -1] += high
        for k in (0, 5, 299):
            p = [m.log_probs(np.append(row[:k], w), np.arange(k + 1))[-1] for w in range(v.rows)]
            assert np.exp(p).sum() == pytest.approx(1, abs=1e-4)


def test_language_model_batches_are_those_of_the_stream():
    """Pieces of any size give the same model; contexts go on across batches and begin anew with documents."""
    v, row, count = toy_model(1, 40, 40_000)
    models = []
    for cut in (20, 1, 7):
        m = lm.Bilinear(v)
        stream = lm.Stream(m, 1)
        for k in range(0, 20, cut):
            own = slice(k * 2000, (k + cut) * 2000)
            stream.add(row[own], count[k : k + cut])
        stream.end()
        models.append(m)
    for m in models[1:]:
        assert all(np.array_equal(getattr(m, x), getattr(models[0], x)) for x in m.NAMES)


def test_language_model_gradient_of_contexts():
    """What a step gives the vectors of contexts, against sums over every token and place."""
    v, row, count = toy_model(2, 30, 400)
    place, m = lm.places(count), lm.Bilinear(v)
    seen = {}
    m._step = lambda name, rows, g: seen.setdefault(name, []).append((rows.copy(), g.copy()))
    around = np.concatenate([np.full(lm.CONTEXT, v.end), row])
    q = m.query(around, place)[0][:, :-1]
    ctx = naive_contexts(v, row, count)
    np.testing.assert_allclose(q, sum(m.e[ctx[:, k]] * m.a[k] for k in range(lm.CONTEXT)), atol=1e-5)
    m.train(around, place, np.random.default_rng(1))
    step = np.zeros_like(m.e)
    rows, g = seen["e"][0]
    step[rows] = g
    # the same again with one context at a time: a change of a vector changes the score of what was predicted from it
    total = np.zeros(lm.WIDTH)
    for k in range(lm.CONTEXT):
        total += (seen["a"][0][1][k] * m.a[k]).astype(float)
    np.testing.assert_allclose((step * m.e).sum(axis=0), total, rtol=1e-3, atol=1e-3)  # both are the sum of dq * a_k * e over tokens and places


def test_language_model_steps_once_for_all_classes():
    """A batch updates the words of all classes together, each as often as it is met; a class of one word learns nothing."""
    v, row, count = toy_model(4, 60, 3000)
    v = lm.Vocabulary(v.keys, np.r_[9000, 400 - np.arange(59)], v.tail, v.kinds, 50)
    alone = np.flatnonzero(np.diff(v.first) == 1)
    assert 0 < len(alone) < v.word_classes
    m, steps = lm.Bilinear(v), []
    before, step = m.t.copy(), m._step
    m._step = lambda name, rows, g: (steps.append((name, rows.copy())), step(name, rows, g))
    m.train(np.concatenate([np.full(lm.CONTEXT, v.end), row]), lm.places(count), np.random.default_rng(1))
    assert [x for x, _ in steps] == ["t", "u", "u", "e", "a"]
    rows = steps[0][1]
    assert set(row[row < v.size]) - set(v.first[alone]) <= set(rows.tolist()) and len(set(rows.tolist())) == len(rows)
    assert not set(v.cls[rows]) & set(alone.tolist()) and (m.t[v.first[alone]] == before[v.first[alone]]).all()


@pytest.mark.parametrize("shift", [-200, -40, 0, 40, 200])
def test_language_model_takes_scores_of_any_size(shift):
    """Sums of exponentials that single precision cannot hold, too large and too small."""
    rng = np.random.default_rng(0)
    q, vectors = rng.normal(0, 2, (9, lm.WIDTH + 1)).astype(np.float32), rng.normal(0, 1, (20, lm.WIDTH + 1)).astype(np.float32)
    q[:, -1], vectors[:, -1] = 1, vectors[:, -1] + shift
    z = q.astype(float) @ vectors.T.astype(float)
    want = z[np.arange(9), 3] - z.max(axis=1) - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1))
    m = lm._log_softmax(q, vectors, np.full(9, 3), *([np.empty(180, np.float32)] if lm._log_softmax.__code__.co_argcount > 3 else []))
    np.testing.assert_allclose(m, want, atol=1e-3)


def naive_contexts(v, row, count):
    out, first = [], 0
    for n in count:
        for p in range(n):
            out.append([row[first + p - k - 1] if p > k else v.end for k in range(lm.CONTEXT)])
        first += n
    return np.array(out)


def test_language_model_probabilities_equal_plain_loops():
    v, row, count = toy_model(3, 10, 400)
    m = lm.Bilinear(v)
    lm.Stream(m, 1).add(row, count)
    m.e *= 3
    rng = np.random.default_rng(2)
    shape = rng.integers(0, lm.SHAPES, 400).astype(np.uint8)
    key = np.where(row < v.size, v.keys[np.argsort(v.row)][np.minimum(row, v.size - 1)], np.where(row == v.end, lm.END_KEY, np.uint64(7)))
    shape = np.where((row >= v.size) & (row < v.end), row - v.size, shape).astype(np.uint8)
    seen = rng.integers(0, 5, 400)
    got = lm.log10_probs(m, key, shape, count, seen)
    ctx = naive_contexts(v, row, count)
    for k in range(0, 400, 7):
        q = sum(m.e[ctx[k, j]].astype(float) * m.a[j] for j in range(lm.CONTEXT))
        z = np.exp(m.u[:, :-1] @ q + m.u[:, -1])
        p = z[v.cls[row[k]]] / z.sum()
        if row[k] < v.size:
            same = np.flatnonzero(v.cls[: v.size] == v.cls[row[k]])
            y = np.exp(m.t[same, :-1] @ q + m.t[same, -1])
            p *= y[same == row[k]][0] / y.sum()
        elif row[k] != v.end:
            s = row[k] - v.size
            p *= (seen[k] + 1) / (v.tail[s] + v.kinds[s] + 1)
        assert got[k] == pytest.approx(np.log10(p), rel=1e-4)


def test_language_model_is_the_same_however_the_input_is_split(spark, monkeypatch):
    """Several shards, null ids and repeated rows."""
    monkeypatch.setattr(lm, "SHARD", 1 << 14)
    rows = [(k, prose(k, 40 + 13 * (k % 50))) for k in range(240)] + [(3, prose(3, 79)), (3, "again"), (None, prose(1, 30)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((str(r.doc_id), r.n_tokens, r.base_score, r.score) for r in lm.scores(df.repartition(n)).collect()) for n in (1, 5)]
    assert len(got[0]) == len(rows)
    assert [x[:3] for x in got[0]] == [x[:3] for x in got[1]]
    np.testing.assert_allclose([x[3] for x in got[0]], [x[3] for x in got[1]], rtol=1e-6)


def test_language_model_takes_a_single_text(spark):
    rows = spark.createDataFrame([(1, "a b " * 300), (2, None)], "doc_id long, text string")
    assert all(r.score < 0 for r in lm.scores(rows).collect())


def test_language_model_beats_single_word_counts(spark):
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(x for _ in range(60) for x in [["the", "cat"], ["a", "dog"], ["my", "hat"]][int(rng.integers(0, 3))])) for k in range(120)]
    got = [r for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)  # logarithms: closer to zero is better


# ------------------------------------------------------------------ encodings


def test_tokens_equal_the_tokenizer(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    raw = [(x or "").encode() for _, x in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw])
    for _ in range(2):  # the second time from memory
        ids, count = tokens.word_ids(tokens.vocabulary_path()).encode(data, off)
        for part, (_, x) in zip(np.split(ids, np.cumsum(count)[:-1]), texts, strict=True):
            assert part.tolist() == t.encode(x or "", add_special_tokens=False).ids + [1]


def test_packing_holds_each_id_once(spark, docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    got = packing.packed(docs, length=64).collect()
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append((r.offset, r.length))
    for i, x in texts:
        ids, at = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for k, v in seq.items():
        ends = [0] + [a + b for a, b in sorted(v)]
        assert [a for a, _ in sorted(v)] == ends[:-1] and (ends[-1] == 64 or k == max(seq))
    assert sorted(seq) == list(range(len(seq)))
    assert packing.packed(empty(spark)).count() == 0


def test_packing_repeated_rows_null_ids_and_ranges(spark, monkeypatch):
    """Many ranges and partitions give the same pieces as one; every row is packed as often as it is given."""
    rows = [(k % 40, prose(k % 9, 1 + 37 * (k % 9))) for k in range(200)] + [(None, "one two"), (None, None), (7, "x " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, packing.packed(df.repartition(1), length=2048).collect()))
    monkeypatch.setattr(packing, "RANGE", 9)
    monkeypatch.setattr(packing, "PART", 1 << 12)
    got = packing.packed(df.repartition(5), length=2048).collect()
    assert sorted(map(str, got)) == want
    seq = collections.defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.offset + r.length))
    for k, v in seq.items():
        assert [0, *[b for _, b in sorted(v)]] == [a for a, _ in sorted(v)] + [2048 if k < max(seq) else max(b for _, b in v)]
    assert sum(r.start == 0 for r in got) == len(rows)


def test_packing_lays_similar_documents_side_by_side(spark):
    """Documents of four vocabularies: neighbours in the stream share theirs far more often than by chance."""
    rng = np.random.default_rng(4)
    names = [[f"{chr(97 + g)}{chr(97 + k)}word{k}" for k in range(30)] for g in range(4)]
    rows = [(k, " ".join(rng.choice(names[k % 4], 80))) for k in range(400)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length=2048).where("start = 0").collect()
    order = [r.doc_id % 4 for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))]
    assert np.mean([x == y for x, y in zip(order[:-1], order[1:], strict=True)]) > 0.5  # by chance 0.25


def test_hilbert_curve_visits_neighbours():
    x = np.array(list(itertools.product(range(8), repeat=2)))
    path = x[np.argsort(packing.hilbert(x, 3))]
    assert sorted(packing.hilbert(x, 3)) == list(range(64)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_pieces_are_lossless_and_reproducible(spark, docs, texts):
    a = {r.doc_id: r for r in pieces.encoded(docs, keep_ids=True).collect()}
    b = {r.doc_id: r for r in pieces.encoded(docs.repartition(1), keep_ids=True).collect()}
    other = {r.doc_id: r for r in pieces.encoded(docs, seed=2, keep_ids=True).collect()}
    lat = pieces.lattices(pieces.model_path(), 1.0)
    for i, t in texts:
        assert a[i].lossless and a[i].ids == b[i].ids and lat.decode(np.array(a[i].ids, np.int64)) == (t or "").encode()
    assert a[16].ids != a[17].ids  # equal texts, other rows
    assert any(a[i].ids != other[i].ids for i in a)
    assert pieces.encoded(empty(spark)).count() == 0


def test_sampling_follows_the_lattice():
    """Frequencies of whole segmentations against their probabilities by enumeration."""
    lat = pieces.lattices(pieces.model_path(), 1.0)
    word = b"ther"
    ids = {b: i for i, b in enumerate(lat.bytes) if b and not (len(b) == 1 and i == lat.byte_id[b[0]])}

    def paths(p):
        if p == len(word):
            yield (), 0.0
        for k in range(1, len(word) - p + 1):
            for i in {ids.get(word[p : p + k])} - {None}:
                for rest, c in paths(p + k):
                    yield (int(i), *rest), c - lat.cost[i]

    want = {k: np.exp(v) for k, v in paths(0)}
    total = sum(want.values())
    n = 20_000
    data, off = np.frombuffer(word * n, np.uint8), np.arange(n + 1) * len(word)
    got, count = lat.sample(data, off, np.arange(n).astype(np.uint64), 5)
    seen = collections.Counter(tuple(x.tolist()) for x in np.split(got, np.cumsum(count)[:-1]))
    for k, v in want.items():
        p = v / total
        assert abs(seen[k] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3


def edge_shares(lat, text):
    """Probability of each (start, piece) by forward and backward sums over the text's whole lattice."""
    ids = {b: i for i, b in enumerate(lat.bytes) if b and not (len(b) == 1 and i == lat.byte_id[b[0]])}
    chars = [c.encode() for c in text.decode()]
    starts = np.cumsum([0] + [len(c) for c in chars])
    edges = [(int(p), ids[text[p : p + k]], k) for p in starts[:-1] for k in range(1, 65) if p + k <= len(text) and text[p : p + k] in ids]
    edges += [(int(p) + k, int(lat.byte_id[c[k]]), 1) for p, c in zip(starts, chars) for k in range(len(c)) if c not in ids]
    f, b = np.full(len(text) + 1, -np.inf), np.full(len(text) + 1, -np.inf)
    f[0] = b[-1] = 0
    for p, i, k in sorted(edges):
        f[p + k] = np.logaddexp(f[p + k], f[p] - lat.cost[i])
    for p, i, k in sorted(edges, reverse=True):
        b[p] = np.logaddexp(b[p], b[p + k] - lat.cost[i])
    return {(p, i): min(1.0, float(np.exp(f[p] - lat.cost[i] + b[p + k] - f[-1]))) for p, i, k in edges}


def check_edges(text, n=4000):
    lat = pieces.lattices(pieces.model_path(), 1.0)
    want = edge_shares(lat, text)
    got, count = lat.sample(np.frombuffer(text * n, np.uint8), np.arange(n + 1) * len(text), np.arange(n).astype(np.uint64), 5)
    assert lat.decode(got) == text * n
    seen = collections.Counter()
    for x in np.split(got.astype(np.int64), np.cumsum(count)[:-1]):
        size = np.array([len(lat.bytes[i]) for i in x])
        seen.update(zip((np.cumsum(size) - size).tolist(), x.tolist(), strict=True))
    assert seen.keys() <= want.keys()
    for k, p in want.items():
        assert abs(seen[k] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3
    return seen


def test_pieces_cross_every_place_of_long_runs():
    url = b"https://www.international.example.org/information/understanding/configuration?identifier=internationalization"
    seen = check_edges(url)
    lat = pieces.lattices(pieces.model_path(), 1.0)
    assert any(p < 48 < p + len(lat.bytes[i]) for p, i in seen)
    check_edges("東京都は日本の首都であり、世界最大級の都市の一つである。中华人民共和国𠀀ภาษาไทย".encode())
    check_edges(b"=" * 130, 2000)


def test_pieces_of_several_spaces_are_sampled():
    lat = pieces.lattices(pieces.model_path(), 1.0)
    seen = check_edges(b"if x:\n        return  y    # z" + b" " * 40)
    assert {len(lat.bytes[i]) for _, i in seen if not lat.bytes[i].strip(b" ")} >= {1, 2, 4, 8, 16}


# ------------------------------------------------------------------ media


def png(data=b"\0\1\2"):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


GIF = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04cd\x12\xff\x00\x34\xff\xd0\x56\xff\xd9"


def crc(data, width, poly):
    """Checksum bit by bit."""
    out = 0
    for byte in data:
        out ^= byte << (width - 8)
        for _ in range(8):
            out = (out << 1 ^ poly if out >> (width - 1) else out << 1) & ((1 << width) - 1)
    return out


def ogg_page(flags, body):
    head = b"OggS\0" + bytes([flags]) + bytes(16)
    rest = bytes([1, len(body)]) + body
    return head + struct.pack("<I", crc(head + bytes(4) + rest, 32, 0x04C11DB7)) + rest


def flac_file(frames=3):
    out = b"fLaC\0\0\0\x22" + struct.pack(">HH", 4096, 4096) + b"\0\0\x10\0\0\x40" + bytes(24) + b"\x84\0\0\2ab"
    for k in range(frames):
        head = b"\xff\xf8\xc9\x18" + bytes([k])
        frame = head + bytes([crc(head, 8, 0x07)]) + hashlib.sha256(bytes([k])).digest()
        out += frame + struct.pack(">H", crc(frame, 16, 0x8005))
    return out


def test_archives_of_many_entries_take_linear_time():
    import io
    import time
    import zipfile

    took = []
    for n in (500, 4000):
        z = io.BytesIO()
        with zipfile.ZipFile(z, "w") as f:
            for k in range(n):
                f.writestr(f"name{k}", "x")
        began = time.perf_counter()
        assert media.sniff(z.getvalue())[0] == ("application/zip", 0, len(z.getvalue()))
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * 4 * took[0] + 0.05


def test_signatures_are_confirmed_and_carved(spark):
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    pdf = b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF"
    box = lambda k, v: struct.pack(">I", 8 + len(v)) + k + v
    mp4 = box(b"ftyp", b"isom\0\0\0\0isom") + box(b"moov", b"abc") + box(b"mdat", b"x" * 30)
    frame = b"\xff\xfb\x90\x64" + bytes(413)
    id3 = b"ID3\4\0\0\0\0\0\x05hello" + frame * 2
    element = lambda k, v: k + bytes([0x80 | len(v)]) + v
    webm, mkv = (element(b"\x1a\x45\xdf\xa3", element(b"\x42\x86", b"\1") + element(b"\x42\x82", n)) + element(b"\x18\x53\x80\x67", b"segment") for n in (b"webm", b"matroska"))
    bmp = b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + bytes(24) + b"\1\2\3\0"
    tiff = b"II*\0" + struct.pack("<IHHHIIHHIII", 8, 2, 273, 4, 1, 38, 279, 4, 1, 5, 0) + b"strip"
    whole = {
        "image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "application/gzip": gzip.compress(b"x" * 50), "application/zip": z.getvalue(), "application/pdf": pdf,
        "audio/ogg": ogg_page(4, b"abc"), "audio/flac": flac_file(), "audio/wav": media.wave(b"ab"), "video/mp4": mp4, "audio/mpeg": id3, "video/webm": webm, "video/x-matroska": mkv, "image/bmp": bmp, "image/tiff": tiff,
    }
    for kind, b in whole.items():
        assert media.sniff(b)[0] == (kind, 0, len(b)), kind
        assert media.sniff(b"text " + b + b" more prose here") == [(kind, 5, len(b))], kind
        assert not [x for x in media.sniff(b[: len(b) - 3]) if x[0] == kind and kind not in ("audio/flac", "audio/mpeg")], kind
    assert media.sniff(frame * 4) == [("audio/mpeg", 0, 4 * len(frame))] and not media.sniff(frame * 3 + b"text")
    assert not media.sniff(b"fLaC\x80\0\0\x22" + bytes(34) + b"\xff followed by prose " * 20)
    bad = bytearray(ogg_page(4, b"abc"))
    bad[-1] ^= 1
    assert not media.sniff(bytes(bad))
    bad = bytearray(flac_file())
    bad[60] ^= 1
    assert media.sniff(bytes(bad)) != [("audio/flac", 0, len(bad))]
    inside = media.wave(b"ab" + png() + b"x" * (len(png()) % 2))
    assert [x[0] for x in media.sniff(inside)] == ["audio/wav", "image/png"]
    rows = [(1, png(), "text/html"), (2, b"RIFF is a word, GIF89a too, %PDF-x", "text/plain"), (3, None, "image/png"), (4, b"", None)]
    got = {r.id: (r.media_type, r.type_corrected, len(r.parts)) for r in media.sniffed(spark.createDataFrame(rows, "id int, v binary, said string"), "v", "said").collect()}
    assert got == {1: ("image/png", True, 0), 2: ("text/plain", False, 0), 3: (None, False, 0), 4: (None, False, 0)}


def test_stored_texts_come_back(spark, docs, texts):
    got = {r.doc_id: r for r in media.read_back(media.stored(docs)).collect()}
    for i, t in texts:
        b = (t or "").encode()
        x = b + bytes((64 - len(b) % 64) % 64 if b else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-64:]))
        assert r.media_bytes == len(x) + 44 and r.media_sha256 == hashlib.sha256(media.wave(x)).hexdigest()
    assert got[16].feature == got[17].feature
    assert media.read_back(media.stored(empty(spark))).count() == 0


def test_saved_cuts_the_lineage(spark):
    df = common.saved(spark.range(5))
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().executedPlan().toString()
