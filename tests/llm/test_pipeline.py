import random

import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontam import brute as leaked
from tests.llm.test_line_dedup import brute as kept_lines
from tests.llm.test_ngram_join import brute_components


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in ["n", "r", "st", "nd", "l"]]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(30)) for i in range(5)]
    docs, labels = [], []
    for d in range(240):
        lines = [say(rng.randrange(3, 40)) for _ in range(rng.randrange(1, 5))]
        if d % 5 == 1:
            lines.append("zork" + say(6))
        if d % 7 == 2:
            lines.append("a common footer line of many words")
        if d % 11 == 3:
            lines.append(say(3) + " " + items[d % 5][1])
        if d % 6 == 4 and docs:
            lines = docs[-1][1].split("\n")
        docs.append((d, "\n".join(lines), "en", "src", len("\n".join(lines))))
        labels.append((d, 1, int(any("zork" in line for line in lines))))
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for (name, stage), number in zip(corpus_pipeline.STAGES[:-1], (4, 6, 2, 10)):
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns
        texts = {d: r.text for d, r in before.items()}
        if number == 4:
            assert set(after) == {d for d, t in texts.items() if "zork" not in t}
        elif number == 6:
            want = kept_lines(list(texts.items()))
            assert {d: r.text for d, r in after.items()} == {d: t for (d, old), t in want.items() if t.strip() or t == old}
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif number == 2:
            assert set(after) == {root for _, root in brute_components(list(texts.items())).values()}
        else:
            assert set(after) == set(texts) - {d for d, _ in leaked(list(texts.items()), items)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) == set(texts)
    for d, r in out.items():
        assert r.ids == library.encode(texts[d], add_special_tokens=False).ids and r.decoded == texts[d]


def test_rows_of_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(3)
    say = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(40))
    a, b, c, d, e = (say() for _ in range(5))
    schema = "doc_id long, text string"
    rows = [(1, a), (1, b), (None, c), (None, c), (None, d), (2, d), (3, e), (None, None)]
    got = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, schema), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, a), (1, b), (0, c), (0, d), (3, e), (0, "")])
    spark.createDataFrame([(1, b), (2, c)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.drop_leaked(spark, spark.createDataFrame(rows, schema), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, a), (0, d), (2, d), (3, e), (0, "")])
