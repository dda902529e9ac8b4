import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from siltstone.llm import langid, quality, toxicity

VOCAB = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(s, pieces, unknown):
    """Sum over all segmentations, by recursion."""
    if not s:
        return 1.0
    total = sum(pieces[s[:k]] * segmentations(s[k:], pieces, unknown) for k in range(1, len(s) + 1) if s[:k] in pieces)
    if s[0] not in pieces:
        total += unknown * segmentations(s[1:], pieces, unknown)
    return total


def test_forward_sums_all_segmentations():
    names = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "c"]
    rng = np.random.default_rng(1)
    p = rng.random((len(names) + 1, 2))
    model = langid.Model(["x", "y"], names, p)
    words = ["ab", "aba", "abab", "bca", "zab", "a" * 20, "ab" * 20]
    scores = model.word_scores(words)
    for k in range(2):
        table = dict(zip(names, p[:-1, k]))
        for w, row in zip(words[:5], scores):
            assert abs(np.exp(row[k]) / segmentations("▁" + w, table, p[-1, k]) - 1) < 1e-9
    # A long word, summed in logarithms, agrees with the plain sum.
    lattice = langid.Lattice(names)
    alpha = langid.forward(lattice.arcs(["ab" * 20]), np.array([41]), p)
    assert np.allclose(np.log(alpha[0, 41]), scores[-1])


def test_learning_raises_likelihood():
    names = ["▁", "▁the", "t", "h", "e", "he", "th"]
    lattice = langid.Lattice(names)
    words, counts = ["the", "he", "het"], np.array([10.0, 3.0, 1.0])
    p = langid.learn(lattice, words, counts, smoothing=1e-6)
    uniform = np.full(len(names) + 1, 1 / (len(names) + 1))
    value = lambda q: (counts * langid.Model(["x"], names, q[:, None]).word_scores(words)[:, 0]).sum()
    assert abs(p.sum() - 1) < 1e-9 and value(p) > value(uniform)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.language_query(docs, VOCAB).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "le chat est là", "fr", 0.0), (2, "the cat is there", "en", 0.0), (3, "a", None, 0.0)] * 3, "doc_id long, text string, lang string, score double")
    model = langid.fit(docs, VOCAB)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "123 ½ !", 1), (None, "the cat " + "x" * 3000, 1), (5, "le chat", 1)], "doc_id long, text string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(odd, model).collect()}
    assert [got[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3 and got[None][0] == "en" and got[5][0] == "fr"
    nothing = langid.fit(docs.where("lang = 'xx'"), VOCAB)
    assert {r.lang_pred for r in langid.predicted(odd, nothing).collect()} == {"und"}
    assert langid.predicted(odd.limit(0), model).count() == 0


def toxic_corpus(n=900):
    rng = random.Random(8)
    plain = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in ["n", "r", "st", "nd"]]
    rows, labels = [], []
    for d in range(n):
        bad = rng.random() < 0.2
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 200))]
        if bad:
            words.insert(rng.randrange(len(words)), "zork" + rng.choice(plain))
        rows.append((d, " ".join(words), 0.5))
        labels.append((d, int(bad), None))
    return rows, labels


def test_toxic_stems_are_found_in_held_out_documents(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels + [(None, 1, None), (3, None, None)], "doc_id long, toxic int, text string")
    got = toxicity.toxicity_query(docs, marks).collect()
    truth = {d: y for d, y, _ in labels}
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_toxic_counts_equal_brute_force_over_many_partitions(spark):
    rows, labels = toxic_corpus(60)
    truth = {d: y for d, y, _ in labels}
    frame = spark.createDataFrame([(t, truth[d]) for d, t, _ in rows], "text string, toxic int").repartition(60)
    got = frame.mapInPandas(toxicity._gram_counts, "gram string, clean long, toxic long").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    want: dict = {}
    for d, text, _ in rows:
        for gram in {g for w in text.split() for g in toxicity.grams_of(w)}:
            want.setdefault(gram, [0, 0])[truth[d]] += 1
    assert {r.gram: [r.clean, r.toxic] for r in got.collect()} == want
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(60)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, text string").repartition(30)
    assert toxicity.toxicity_query(docs, marks).count() == 60


def test_few_labels_still_make_features(spark):
    rows = [(1, "zork zork plain"), (2, "plain words"), (3, "zork again"), (4, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, toxic int"), min_texts=1)
    assert model.score("a zork here") > model.score("words here")


def test_language_of_long_letter_runs(spark):
    rng = random.Random(2)
    run = lambda letters: "".join(rng.choice(letters) for _ in range(400))
    docs = spark.createDataFrame([(n, run("aeioumn"), "xx") for n in range(40)] + [(n, run("krtszgd"), "yy") for n in range(40, 80)], "doc_id long, text string, lang string")
    model = langid.fit(docs, VOCAB)
    assert model.predict([run("aeioumn"), run("krtszgd")])[0] == ["xx", "yy"]


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, "x" * 10000)], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity_query(docs, empty).collect()} == {0}
    assert toxicity.toxicity_query(docs.limit(0), empty).count() == 0


def test_quality_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality_query(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.keep == r.quality for r in held) >= 0.95 * len(held)


def test_sparse_sites_shrink_towards_their_host(spark):
    rows = [(d, "plain words of a text", "big", "a") for d in range(200)] + [(200, "plain words of a text", "big", "b"), (201, "plain words of a text", None, None), (None, None, "big", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(d, int(d % 4 > 0)) for d in range(200)] + [(200, 0), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == 203 and all(0 <= r.score <= 1 for r in got.values())
    assert 0 < got[200].path_rate < got[0].path_rate
    assert abs(got[200].host_rate - got[0].host_rate) < 1e-12
    assert got[201].path_rate > 0.5
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert {round(r.evidence, 3) for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def brute_strength(sites, rates):
    """Pseudo-counts by moments of [(n, good)] around `rates`."""
    w, k = sum(n for n, _ in sites), len(sites)
    if k < 2:
        return 100.0
    within = sum(n * r * (1 - r) for (n, _), r in zip(sites, rates)) / w
    spread = sum(n * (g / n - r) ** 2 for (n, g), r in zip(sites, rates))
    between = (spread - (k - 1) * within) / max(w - sum(n * n for n, _ in sites) / w, 1e-9)
    return min(1e6, max(1.0, within / max(between, 1e-9) - 1))


def test_quality_leaves_a_document_out_of_its_own_site(spark):
    rng = random.Random(5)
    rows = [(d, "word " * rng.randint(1, 30), f"h{d % 4}", rng.choice("abc")) for d in range(120)]
    marks = {d: int(rng.random() < (0.9 if d % 4 else 0.2)) for d in range(0, 120, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 AS evidence", "'x' AS own")
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    own = {d: (1.0, float(marks[d])) if d in marks else (0.25, 0.25 * got[d].evidence) for d, *_ in rows}
    hosts, paths = {}, {}
    for d, _, host, path in rows:
        for sums, key in ((hosts, host), (paths, (host, path))):
            n, good = sums.get(key, (0.0, 0.0))
            sums[key] = (n + own[d][0], good + own[d][1])
    rate = sum(g for _, g in hosts.values()) / sum(n for n, _ in hosts.values())
    s_host = brute_strength(list(hosts.values()), [rate] * len(hosts))
    host_rate = {h: (g + s_host * rate) / (n + s_host) for h, (n, g) in hosts.items()}
    s_path = brute_strength(list(paths.values()), [host_rate[h] for h, _ in paths])
    logit = lambda p: np.log(p / (1 - p))
    for d, _, host, path in rows:
        n, good = own[d]
        others = (hosts[host][1] - good + s_host * rate) / (hosts[host][0] - n + s_host)
        others = (paths[host, path][1] - good + s_path * others) / (paths[host, path][0] - n + s_path)
        z = logit(got[d].evidence) + logit(others) - logit(rate)
        assert abs(got[d].score - 1 / (1 + np.exp(-z))) < 1e-6
        assert abs(got[d].host_rate - host_rate[host]) < 1e-9
