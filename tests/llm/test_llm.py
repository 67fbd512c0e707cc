"""Problems 3, 5, 6, 7 and 8 against brute force, exact encodings and held-out ratings, and on awkward inputs."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from nubila.llm import encode, leakage, mcl, percentiles, reading
from nubila.llm.fmindex import FMIndex, suffix_order
from nubila.llm.syllables import syllables

POINT = "pid bigint, x double, y double, z double, label bigint, n string, cell int"
DOC = "doc_id bigint, text string, lang string, words int, ids string"


# ---- clusters -----------------------------------------------------------------


def grouped(p, radius, least):
    n = len(p)
    top = list(range(n))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    for a, b in np.argwhere(np.triu(d < radius, 1)):
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    sets = {}
    for a in range(n):
        sets.setdefault(find(a), []).append(a)
    return {(k, a) for k, v in sets.items() if len(v) >= least for a in v}


def test_clusters_are_what_links_connect(spark):
    rng = np.random.default_rng(2)
    chain = np.c_[np.arange(60) * 0.9, np.zeros(60), np.zeros(60)]  # through many cells
    cloud = rng.uniform(0, 14, (500, 3)) * (1, 1, 0.1) + (0, 5, 0)
    p = np.round(np.concatenate((chain, cloud, cloud[:20], [[100, 100, 0]] * 12)), 2)
    df = spark.createDataFrame([(i, *map(float, v), 1, "n", 2) for i, v in enumerate(p)], POINT)
    for least in (1, 10):
        got = mcl.markov_clusters(df, 1.0, least, cell_rows=40).select("cluster", "id").collect()
        assert sorted(map(tuple, got)) == sorted(grouped(p, 1.0, least))
    whole = mcl.describe(mcl.markov_clusters(df, 1.0, 10)).collect()
    for more in ({"cell_rows": 40}, {"cell_rows": 15}, {"cell_rows": 40, "block_nodes": 30}):  # in cells, across them, and as joins
        told = mcl.describe(mcl.markov_clusters(df, 1.0, 10, **more)).collect()
        assert sorted(map(str, told)) == sorted(map(str, whole)) and all(len(r.typical) == 3 and r["size"] >= 10 for r in told)


def row_matrix(p, radius, inflation):
    """Markov clustering of all rows, one by one: (most of each column, flow into each row, flow after a round)."""
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    m = np.where(d < radius, 1 - 0.9 * d / radius, 0)
    np.fill_diagonal(m, 0)
    np.fill_diagonal(m, np.where(m.max(axis=0) > 0, m.max(axis=0), 1))
    m, first = m / m.sum(axis=0), None
    for _ in range(mcl.ROUNDS):
        old, m = m, (m @ m) ** inflation
        m /= m.sum(axis=0)
        m[(m < 1e-9) & (m < m.max(axis=0))] = 0
        m /= m.sum(axis=0)
        first = m.sum(axis=1) if first is None else first
        if np.abs(m - old).max() < 1e-7:
            break
    return m, m.sum(axis=1), first


def test_flow_is_that_of_the_matrix_of_all_rows(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.uniform(0, 6, (90, 3)) * (1, 1, 0.1), 2)
    p = np.concatenate((p, p[:15], p[:5]))
    m, flow, pull = row_matrix(p, 1.0, mcl.INFLATION)
    df = spark.createDataFrame([(i, *map(float, v), 1, "n", 2) for i, v in enumerate(p)], POINT)
    place = {tuple(v): i for i, v in reversed(list(enumerate(p.tolist())))}
    at = np.array([place[tuple(v)] for v in p.tolist()])
    got = {r.id: r for r in mcl.markov_clusters(df, 1.0, cell_rows=10**6).collect()}
    for want, name, error in ((flow, "flow", 0.35), (pull, "pull", 0.1)):
        of = np.bincount(at, want, len(p))[at]
        assert np.abs(of - [got[i][name] for i in range(len(p))]).max() < error  # small entries are pruned
    mass = np.zeros((len(p), len(p)))
    np.add.at(mass, at, m)
    sure = np.sort(mass, axis=0)[-1] > np.sort(mass, axis=0)[-2] + 0.2
    assert sure.mean() > 0.8 and all(got[i].attractor == mass[:, i].argmax() for i in np.flatnonzero(sure))


def test_blocks_dense_sparse_and_distributed_agree(spark):
    rng = np.random.default_rng(7)
    p = rng.uniform(0, 5, (120, 2))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    a, b = np.nonzero(np.triu(d < 0.9, 1))
    w, rows = 1 - 0.9 * d[a, b] / 0.9, rng.integers(1, 4, 120)
    block = mcl.linked(120, a, b)
    want = mcl.block_flow(block, a, b, w, rows)
    groups = set()
    for inflation in (1.3, 2.0, 4.0):
        groups.add(len(np.unique(mcl.block_flow(block, a, b, w, rows, inflation)[0])))
    assert len(groups) == 3  # inflation sets how fine the attractor groups are
    sparse = mcl.sparse_flow(120, a, b, w, rows.astype(float))
    nodes = spark.createDataFrame([(i, int(r)) for i, r in enumerate(rows)], "node bigint, n bigint")
    links = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), w.tolist())), "a bigint, b bigint, w double")
    joined = {r.node: r for r in mcl.distributed_flow(nodes, links).collect()}
    for k, name in enumerate(("attractor", "flow", "pull")):
        assert np.allclose(want[k], sparse[k], atol=0.05) and np.allclose(want[k], [joined[i][name] for i in range(120)], atol=0.05)
    assert want[1].sum() == pytest.approx(rows.sum())


def test_crowded_places_stay_few_nodes(spark):
    rng = np.random.default_rng(9)
    crowd = rng.uniform(0, 0.4, (6000, 3)) + (0.05, 0.05, 0.05)
    p = np.concatenate((crowd, [[1.44, 0.2, 0.2], [2.4, 0.2, 0.2], [1.5, 3, 0]], crowd[:700] + (0, 1.6, 0), crowd[:300] + (30, 0, 0)))
    node = mcl._nodes(p, np.ones(len(p), dtype=bool), 1.0, "euclidean")
    a, b, w = mcl._links(p, np.ones(len(p), dtype=bool), node, 1.0, "euclidean")
    assert len(np.unique(node[:6000])) < 100 and len(a) < 10_000
    df = spark.createDataFrame([(i, *map(float, v), 1, "n", 2) for i, v in enumerate(p)], POINT)
    for cells in (10**6, 900):
        got = mcl.markov_clusters(df, 1.0, 10, cell_rows=cells).select("cluster", "id").collect()
        near = {(0, i) for i in range(6002)}  # both single ones are linked through others, the third is alone
        assert {tuple(r) for r in got} - {(r, i) for r in (6003, 6703) for i in range(6003, 7003)} == near or len(got) == 7002


def test_clusters_of_nothing_and_of_bad_rows(spark):
    assert mcl.markov_clusters(spark.createDataFrame([], POINT), 1.0).count() == 0
    rows = [(1, 0.0, 0.0, 0.0, 1, "n", 1), (2, None, 0.0, 0.0, 1, "n", 1), (None, 0.0, 0.0, 0.0, 1, "n", 1), (3, float("nan"), 0.0, 0.0, 1, "n", 1), (4, 0.0, 0.0, 0.0, 1, "n", 1)]
    assert {tuple(r) for r in mcl.markov_clusters(spark.createDataFrame(rows, POINT), 1.0, 2).select("cluster", "id").collect()} == {(1, 1), (1, 4)}


def test_dense_rows_stay_one_group():
    a, b = np.triu_indices(6, 1)
    attractor, flow, pull = mcl.block_flow(np.zeros(6, dtype=int), a, b, np.ones(len(a)), np.ones(6))
    assert set(attractor.tolist()) == {0} and flow.sum() == pytest.approx(6) and pull.sum() == pytest.approx(6)
    assert mcl.linked(5, np.array([0, 1, 2]), np.array([1, 2, 3])).tolist() == [0, 0, 0, 0, 4]


# ---- percentiles --------------------------------------------------------------


def test_percentiles_exact_small_and_within_error_merged(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 19, 20, 21, 999, 4000):
        v = np.round(rng.normal(size=n), 3)
        df = spark.createDataFrame([(float(x),) for x in v], "v double").withColumn("day", F.monotonically_increasing_id() % 7)
        whole = percentiles.sketches(df, [], {"v": F.col("v")})
        parts = percentiles.merged(percentiles.sketches(df, ["day"], {"v": F.col("v")}), [], ["v"])
        s = np.sort(v)
        for sk in (whole, parts):
            row = sk.select(*(percentiles.percentile(F.col("v"), p).alias(f"p{p}") for p in (5, 50, 95))).first()
            assert [row[f"p{p}"] for p in (5, 50, 95)] == [s[int(n * p / 100)] for p in (5, 50, 95)]
    n = 200_000
    df = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("v"), (F.col("id") % 5).alias("day"))
    sk = percentiles.merged(percentiles.sketches(df, ["day"], {"v": F.col("v")}), [], ["v"])
    got = sk.select(*(percentiles.percentile(F.col("v"), p) for p in (5, 50, 95))).first()
    assert all(abs(g / n - p / 100) < 2 * percentiles.rank_error() for g, p in zip(got, (5, 50, 95)))


def test_percentiles_leave_out_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("b", None), (None, 3.0)], "k string, v double")
    rows = {r.k: r.p for r in percentiles.sketches(df, ["k"], {"v": F.col("v")}).select("k", percentiles.percentile(F.col("v"), 50).alias("p")).collect()}
    assert rows["a"] == 1.0 and rows["b"] is None and rows[None] == 3.0


# ---- encoding -----------------------------------------------------------------

TEXTS = [None, "", " ", "\n\n", "a", "The item is closed.", "it's we'll 'tis o'clock ''s", "  two  spaces \t\n end  ", "<|endoftext|> stays text", "naïve cöoperate 🗳️👍🏽 §12–14 ½", "日本語の文章。" * 40, "x" * 5000, "1234567890 000111 3.14159 1,000,000 " * 50, "word-\nbroken (aside) [b] " * 200, "​‮﻿\x07", "a b c　d"]


@pytest.mark.skipif(not os.path.exists(encode.TOKENIZERS), reason="no tokenizer files")
def test_ids_are_those_of_the_whole_text(spark):
    import tokenizers

    rng = np.random.default_rng(1)
    words = "some families support'd gates, the 12 règles; über-all  now.\n\n (Hear!) don't".split(" ")
    texts = TEXTS + [" ".join(rng.choice(words, 400)) for _ in range(40)]
    texts += texts[-40:-20]
    t = tokenizers.Tokenizer.from_file(os.path.join(encode.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    df = spark.createDataFrame([(i, x, "en", 1, "c") for i, x in enumerate(texts)], DOC)
    got = {r.doc_id: r.ids for r in encode.encoded(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert encode.encoded(spark.createDataFrame([], DOC)).count() == 0
    enc = encode.ChunkEncoder("byte_bpe_50k", encode.ranks_file("byte_bpe_50k", encode.TOKENIZERS))
    import pyarrow as pa

    enc.batch(pa.array(texts))
    assert enc.reused > 0  # shared chunks are encoded once


@pytest.mark.skipif(not os.path.exists(encode.TOKENIZERS), reason="no tokenizer files")
def test_joins_that_do_not_agree_are_encoded_together():
    enc = encode.ChunkEncoder("byte_bpe_50k", encode.ranks_file("byte_bpe_50k", encode.TOKENIZERS))
    data = b"unbelievable stories"
    for cut in range(1, len(data)):
        assert np.concatenate(enc.text(data, [cut])).tolist() == enc.encode(data.decode())
    assert np.concatenate(enc.text(data, list(range(1, len(data))))).tolist() == enc.encode(data.decode())  # merged back and back


@pytest.mark.skipif(not os.path.exists(encode.TOKENIZERS), reason="no tokenizer files")
def test_chunks_are_found_again_after_the_cache_turned(monkeypatch):
    monkeypatch.setattr(encode, "REMEMBER", 2000)
    enc = encode.ChunkEncoder("byte_bpe_50k", encode.ranks_file("byte_bpe_50k", encode.TOKENIZERS))
    for k in range(30):
        enc.ids(b"always the same")
        enc.ids(b"new %d" % k)
    assert enc.reused == 29 and enc.asked == 60


# ---- leakage ------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 7, 300, 3000])
def test_fm_index(n):
    rng = np.random.default_rng(n)
    text = np.append(rng.integers(1, 6, n), 0)
    if n == 3000:
        text[1000:2000] = text[:1000]  # long repeats
    order = suffix_order(text, 3)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    index = FMIndex(text, 6, sample=4)
    phrases = rng.integers(1, 6, (40, 3))
    lo, hi = index.search(phrases)
    for p, a, b in zip(phrases.tolist(), lo, hi):
        want = [i for i in range(len(text) - 2) if text[i : i + 3].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def passages_of(items):
    ((vocabulary, (block,), _),) = leakage.stated(items)
    return vocabulary, leakage.Passages(*block, len(vocabulary) + 2)


def leaked(texts, items):
    vocabulary, p = passages_of(items)
    out = set()
    for d, t in texts:
        w = [vocabulary.get(x, 1) for x in leakage.words_of(t or "")]
        grams = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for j, i in enumerate(p.ids):
            own = p.words[j].tolist()
            need = math.ceil(0.75 * len(own) - 1e-9)
            if any(tuple(own[k : k + 12]) in grams for k in range(len(own) - 11)) or any(lcs(own, w[k : k + p.stretch[j]]) >= need for k in range(max(1, len(w)))):
                out.add((i, d))
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for k, y in enumerate(b, 1):
            old, row[k] = row[k], old + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(25)]  # few words, so that chance comes near the conditions
    items = [(k, " ".join(rng.choice(words, int(rng.integers(4, 30))))) for k in range(12)] + [(50, None), (51, "..."), (52, "one two three four five six seven eight nine ten eleven twelve thirteen")]
    texts = [(100 + k, " ".join(rng.choice(words, int(rng.integers(0, 90))))) for k in range(60)]
    for k in range(40):
        w = items[k % 12][1].split()
        kept = [x for x in w if rng.random() < 0.85]
        mixed = [y for x in kept for y in ([x] if rng.random() < 0.8 else [x, str(rng.choice(words))])]
        texts.append((300 + k, "Before. " + " ".join(mixed).upper() + ", after"))
    texts += [(400, "One, two (Hear, hear!) three\nfour fi-\nve six [x] SEVEN eight nine ten eleven twelve!"), (401, texts[60][1]), (402, texts[60][1]), (403, None), (404, ""), (405, " ".join(rng.choice(words, 4000)))]
    df = spark.createDataFrame([(d, t, "en", 1, "c") for d, t in texts], DOC)
    it = spark.createDataFrame([(i, p, "s", 1) for i, p in items], "item_id bigint, passage string, suite string, doc_id int")
    want = leaked(texts, [x for x in items if x[1]])
    for shard, block, most in ((1 << 19, 1 << 17, 1 << 26), (600, 1 << 17, 1 << 26), (1 << 19, 40, 100)):  # in one shard, long texts in pieces, passages in blocks and passes
        monkeypatch.setattr(leakage, "SHARD_WORDS", shard)
        monkeypatch.setattr(leakage, "BLOCK_WORDS", block)
        monkeypatch.setattr(leakage, "PASS_WORDS", most)
        got = leakage.leaks(df, it)
        assert {(r.item_id, r.doc_id) for r in got.collect()} == want and want
    assert (52, 400) in want
    spans = leakage.removal_spans(leakage.leaks(df, it)).collect()
    assert {i for r in spans for i in r["items"]} == {i for i, _ in want}
    assert leakage.leaks(spark.createDataFrame([], DOC), it).count() == 0
    assert leakage.leaks(df, it.limit(0)).count() == 0


def test_passages_of_every_small_size_equal_brute_force():
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(9)]
    items = [(n * 10 + k, " ".join(rng.choice(words[: 4 + k], n))) for n in range(1, 13) for k in range(6)] + [(0, "alpha beta gamma delta")]
    texts = [(1000 + k, " ".join(rng.choice(words, int(rng.integers(0, 14))))) for k in range(250)] + [(2000, "alpha one two beta delta"), (2001, "alpha"), (2002, "alpha one two three beta delta")]
    for k in range(150):  # copies with words lost and put in
        w = items[k % 72][1].split()
        kept = [x for x in w if rng.random() < 0.85]
        texts.append((3000 + k, " ".join(y for x in kept for y in ([x] if rng.random() < 0.6 else [x, "other"]))))
    want = leaked(texts, items)
    vocabulary, p = passages_of(items)
    docs = [([d], 0, [vocabulary.get(x, 1) for x in t.split()]) for d, t in texts if t]
    assert {r[:2] for r in leakage.search_shard(p, leakage.Shard(docs, p.symbols))} == want
    assert (0, 2000) in want and (0, 2002) not in want and {i // 10 for i, _ in want} == set(range(13))


def test_all_seeds_come_from_the_index():
    vocabulary, p = passages_of([(1, "a b c d e f g h i j"), (2, "x")])
    docs = [([7], 0, [vocabulary.get(w, 1) for w in "a b q c d q e f g q h i j x".split()])]
    shard = leakage.Shard(docs, p.symbols)
    assert {r[:2] for r in leakage.search_shard(p, shard)} == {(1, 7), (2, 7)}
    shard.index = FMIndex(np.zeros(1, dtype=np.int64), p.symbols)
    assert leakage.search_shard(p, shard) == []


def test_removal_spans_cover_the_whole_passage():
    passage = [f"p{k}" for k in range(60)]
    edited = [f"x{k}" if k % 10 == 9 else w for k, w in enumerate(passage)]  # no 12 words unchanged
    own = [f"f{k}" if k % 3 else passage[(7 * k) % 60] for k in range(80)]  # words of the passage, out of order
    vocabulary, p = passages_of([(1, " ".join(passage))])
    spans_of = lambda ids: [r[3:] for r in leakage.search_shard(p, leakage.Shard([([9], 0, ids)], p.symbols))]
    for text in (own + edited + own[::-1], edited, own + edited + ["and"] * 3 + edited):
        inside = {k for a, b in spans_of([vocabulary.get(w, 1) for w in text]) for k in range(a, b + 1)}
        for at in (k for k in range(len(text)) if text[k : k + 60] == edited):
            assert set(range(at, at + 59)) <= inside  # the last word is one of the changed
    ids, two = [vocabulary.get(w, 1) for w in edited], [1, vocabulary["p50"]] * 15
    assert spans_of([1] * 40 + ids + two + ids + [1] * 40) == [(40, 98), (130, 188)]


# ---- reading ------------------------------------------------------------------


def test_syllables():
    known = {
        "en": "cat 1 table 2 make 1 united 3 nation 2 created 3 science 2 being 2 idea 3 area 3 people 2 business 2 something 2 statement 2 element 3 the 1 houses 2 changed 1 wanted 2 sea 1 beyond 2 dying 2 question 2 social 2 society 4 patient 2 client 2 actual 3 language 2 quiet 2 fluid 2 real 2 theatre 3 video 3 going 2 poet 2 chaos 2 parliament 3 responsibilities 6 administrations 5 unprecedented 5 rehabilitate 5 reevaluate 5 lonely 2 safety 2 ocean 2 piece 1 friend 1 rhythm 1",
        "de": "Haus 1 Theater 3 Familien 4 Nation 3 Parteien 3 Bauern 2 Freude 2 Wien 1 beenden 3 Quelle 2 Verantwortlichkeiten 6 Museum 3",
        "fr": "école 2 parlent 1 nation 2 souvent 2 moment 2 gouvernement 4 créer 2 évalué 4 poésie 3 quatre 1 naïve 2 tiennent 1 argent 2 président 3 les 1 famille 2",
    }
    for lang, text in known.items():
        it = iter(text.split())
        wrong = [(w, n, syllables(w, lang)) for w, n in zip(it, it) if syllables(w, lang) != int(n)]
        assert not wrong, wrong
    assert syllables("палата", "other") == 1 and syllables("casa", "other") == 2 and syllables("x" * 10_000, "en") == 1


def test_counts_of_very_long_texts_and_languages_of_whole_texts():
    cache: dict = {}
    text = "letters " * 3_000_000
    assert reading.measure(text, "en", cache)[3:8] == (3_000_000, 6_000_000, 0, 21_000_000, 3_000_000)
    german = "wir sehen die Tore und ihre Felder gegen alle Deiche . "
    assert reading.measure("They see all of the gates. " * 60 + german * 200, None, cache)[0] == "de"
    assert reading.measure("ja wer hat das gesagt", "??", cache)[0] == "de" and reading.measure("Casa blanca ma non troppo fa bene", None, cache)[0] == "other"


def test_bands_follow_ratings(spark):
    rng = np.random.default_rng(6)
    short, long = "cat dog run big red sun hat map".split(), "responsibilities administration extraordinary international considerations".split()
    docs, labels = [], []
    for k in range(400):
        band = k % 5 + 1
        text = "I call the next speaker. " if k % 3 == 0 else "Smith: "
        for _ in range(14):
            n = 4 + band * 4
            text += " ".join(rng.choice(long if rng.random() < band * 0.12 else short) for _ in range(n)) + " (Hear, hear!). "
        docs.append((k, text, ["en", "ENG", None, "fr"][k % 4 if k % 7 == 0 else 0], 1, "c"))
        if k % 2:
            labels.append((k, "r", band if rng.random() > 0.1 else max(1, band - 1)))
    docs += [(900, None, "en", 1, "c"), (901, "", "en", 1, "c"), (902, "Too short. ", "en", 1, "c"), (None, docs[0][1], "en", 1, "c"), (903, "?! " * 500, "de", 1, "c"), (904, "word " * 3000, "de", 1, "c")]
    df = spark.createDataFrame(docs, DOC)
    lb = spark.createDataFrame(labels + [(1, "r", None), (None, "r", 3)], "doc_id bigint, rater string, band int")
    rows = {r.doc_id: r.band for r in reading.reading_bands(df, lb).collect()}
    assert not set(rows) & {900, 901, 902, 903, None} and 904 in rows
    held = [rows[k] == k % 5 + 1 for k in range(0, 400, 2)]
    assert np.mean(held) > 0.9
    none = reading.reading_bands(df, lb.limit(0)).collect()
    assert {r.doc_id for r in none} == set(rows) and all(1 <= r.band <= 5 for r in none)
    assert reading.reading_bands(df.limit(0), lb.limit(0)).count() == 0


def test_formulas_and_asides_are_left_out():
    cache = {}
    plain = reading.measure("We build homes. They need roads.", "en", cache)
    noisy = reading.measure("Smith (LP): We build (Applause.) homes. – Abg. Muster: Quatsch! – They need [x] roads.", "en", cache)
    assert plain[2:4] == noisy[2:4] == (2, 6) and plain[1] == noisy[1]
    assert reading.measure("M. Dupont parle. Non.", "fr", cache)[2] == 2


def test_formulas_are_what_many_texts_and_speakers_share(spark):
    own = [f"We plan road number {'abcdefghijklmnopqrstuvwxyz'[k % 26] * (1 + k // 26)} now." for k in range(60)]
    docs = [(k, f"{own[k]} Then we rest. {'The item is closed. ' if k % 2 else ''}{own[(k + 5) % 60]}", "en", k % 5) for k in range(60)]
    docs += [(100 + k, "A copied speech about gates. It ends here.", "en", k) for k in range(40)]  # copies are one text
    docs += [(200 + k, f"{own[k]} My own saying. More.", "en", 77) for k in range(30)]  # one speaker
    feats = reading.features(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, speaker_id bigint"))
    got = {r.h for r in reading.formulas(feats).collect()}
    h = lambda t: reading._hash(t)
    assert {h("then we rest"), h("the item is closed")} <= got and not got & {h("it ends here"), h("my own saying"), h("more")}
    left = {r.doc_id: r.words for r in reading.without_formulas(feats).collect()}
    assert left[100] == 8 and left[1] < 17


def test_best_cuts():
    g = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10.0])
    assert reading.best_cuts(g, np.repeat([1, 2, 3, 4, 5], 2).astype(float)) == [2.5, 4.5, 6.5, 8.5]
