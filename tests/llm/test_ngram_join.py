import random
import re

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import ngram_join, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    sets = [(d, brute_set(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    owners = {}
    for i, (d, s) in enumerate(sets):
        for j in {j for t in s for j in owners.get(t, ())}:
            e, o = sets[j]
            if 100 * len(s & o) >= 80 * len(s | o):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
        for t in s:
            owners.setdefault(t, []).append(i)
    return {d: (len(s), root(d)) for d, s in sets}


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.5:
            words = (rng.choice(texts[-40:]) or "").split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        elif kind < 0.75:
            texts.append(" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 9, 30, 120]))))
    return list(enumerate(texts))


def test_shingles_equal_brute_force():
    texts = [t for _, t in corpus(3)] + [None, "", " ", "A b\tC\nd\x0be", "a b c d e f a b c d e f", "é À x", "x" * 5000, "a b c d", "A B C D", " a  b c  d "]
    got = list(shingles.shingle_sets(pa.array(texts)))
    seen = {}
    for text, tokens in zip(texts, got):
        assert len(tokens) == len(brute_set(text))
        assert np.all(np.sort(tokens) == tokens)
        for other, key in seen.items():
            assert (key == tokens.tobytes()) == (brute_set(other) == brute_set(text))
        seen[text] = tokens.tobytes()
    small = shingles.SLICE_BYTES
    shingles.SLICE_BYTES = 100
    try:
        assert all(np.array_equal(a, b) for a, b in zip(got, shingles.shingle_sets(pa.array(texts))))
    finally:
        shingles.SLICE_BYTES = small


@pytest.mark.parametrize("seed,heavy", [(1, 64), (2, 4)])
def test_components_equal_brute_force(spark, monkeypatch, seed, heavy):
    monkeypatch.setattr(ngram_join, "LEAST_HEAVY", heavy)
    rows = corpus(seed)
    want = brute_components(rows)
    frame = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, size int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(frame).collect()}
    assert got == want


def test_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(docs).collect()} == want


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "one two three"), (3, "one two three"), (3, "one two three"), (4, None), (5, " "), (None, None)]
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == [(-1, 0, -1), (-1, 1, 3), (3, 1, 3), (3, 1, 3), (4, 0, 4), (5, 0, 5)]
    assert ngram_join.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_id_with_different_texts(spark):
    rng = random.Random(5)
    a, b, c = ([f"{n}{rng.randrange(900)}" for _ in range(60)] for n in "abc")
    near = lambda words: " ".join([*words[:-1], "other"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (3, " ".join(b)), (7, near(a)), (None, " ".join(c)), (None, "six words that none else has"), (9, near(c))]
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = {len(brute_set(t)) for _, t in rows}
    assert len(got) == len(rows) and {r.n_shingles for r in got} == sets
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 9), (3, 3), (5, 3), (5, 5), (7, 5), (9, 9)]
    assert all(r.class_id == r.doc_id for r in got if r.doc_id in (7, 9))


def test_links_of_repeated_and_null_ids(spark):
    rng = random.Random(6)
    a, b, c, d = ([f"{n}{rng.randrange(900)}" for _ in range(60)] for n in "abcd")
    text, near = " ".join, lambda words: " ".join([*words, "more"])
    told = lambda rows: sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert told([(3, text(a)), (5, text(a)), (5, text(b)), (9, near(b))]) == [(3, 56, 3), (5, 56, 3), (5, 56, 5), (9, 57, 5)]
    assert told([(None, text(a)), (7, text(a))]) == [(-1, 56, 7), (7, 56, 7)]
    assert told([(None, text(c)), (None, text(d)), (7, near(c)), (8, near(d))]) == [(-1, 56, 7), (-1, 56, 8), (7, 57, 7), (8, 57, 8)]
    # A third of the rows equal in id and text.
    assert told([(4, text(a))] * 30 + [(2, near(a))] + [(n, text(b)) for n in range(10, 40)]) == [(2, 57, 2)] + [(4, 56, 2)] * 30 + [(n, 56, 10) for n in range(10, 40)]


def test_chain_and_cluster_without_centre(spark):
    """Links that no representative shows: a chain of drifting copies, and variants of a text that is not there."""
    rng = random.Random(9)
    rows, words = [], [f"v{rng.randrange(2000)}" for _ in range(80)]
    for n in range(25):
        rows.append((n, " ".join(words)))
        words = [*words[5:], *[f"v{rng.randrange(2000)}" for _ in range(5)]]
    base = [f"w{rng.randrange(2000)}" for _ in range(120)]
    for n in range(100, 180):
        own = list(base)
        for _ in range(rng.randrange(1, 5)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(2000)}"
        rows.append((n, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
