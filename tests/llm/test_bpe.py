import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import public_tokenizers
from tokenizers import Tokenizer

from siltstone.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


TEXTS = [
    None, "", " ", "  two  spaces ", "it's we'll I'M 'S", "a<|endoftext|>b  <|endoftext|>", "!<|endoftext|>  x", "<|endoftext|>", "é𝄞 ñandú 日本語 ١٢٣ ½ ²",
    "tabs\t\tand\n\nlines \n x", " nbsp　wide\x1c\x85", "word " * 5000, "a" * 5000, "x\r\ny​z é",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(rows, texts, library):
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids), (r.doc_id, texts[r.doc_id])
        assert r.ids_sha256 == sha(",".join(map(str, ids)))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_equals_the_library(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 9000)
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, block int")
    check(bpe.digest(frame, PATH).collect(), dict(enumerate(TEXTS)), library)


def test_on_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(bpe.digest(docs, PATH).collect(), {r.doc_id: r.text for r in docs.collect()}, library)


def test_null_ids_repeated_rows_and_empty_table(spark):
    frame = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, tuple(r.ids)) for r in bpe.encode(frame, PATH).collect())[0][1] == tuple(bpe.encode(frame, PATH).first().ids)
    assert bpe.encode(frame, PATH).count() == 3
    assert bpe.digest(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cn", "Co"]), max_size=40))
def test_words_alone_encode_as_in_the_text(text):
    library = Tokenizer.from_file(PATH) if not hasattr(test_words_alone_encode_as_in_the_text, "own") else test_words_alone_encode_as_in_the_text.own
    test_words_alone_encode_as_in_the_text.own = library
    words = bpe.Splitter(["<|endoftext|>"])(text)
    assert "".join(words) == text
    assert [i for w in words for i in library.encode(w, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids


def test_latin_texts_split_alike(library):
    rng = random.Random(3)
    alphabet = "abÀéßªµº×÷0 9''sdt\n\t\r\x85\xa0\x1c\x1f_-²³¹¼½¾!¡ <|>" + "".join(map(chr, range(256)))
    splitter = bpe.Splitter([])
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30)))
        assert [i for w in splitter(text) for i in library.encode(w, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_are_encoded_in_one_text(library):
    words = ["a", " b", "<", "<|endoftext|", "|>", "  ", "é", " 日本", "\x00", "'s"] * 50
    sizes = []

    class Counting:
        token_to_id = library.token_to_id

        def encode_batch_fast(self, texts, **options):
            sizes.append(len(texts))
            return library.encode_batch_fast(texts, **options)

    mark = bpe.separator(library.to_str())
    assert mark == "<|endoftext|>"
    alone = bpe._ids_of(Counting(), words, None)
    assert bpe._ids_of(Counting(), words, mark) == alone and sizes == [len(words), 1]
    own = bpe._ids_of(Counting(), [*words, mark], mark)
    assert own[:-1] == alone and len(own) == len(words) + 1


def test_texts_of_lists(library):
    table = bpe.pa.array(bpe.piece_table(library.to_str()), bpe.pa.large_binary())
    texts = ["", "one two", "", "日本 é", "<|endoftext|>", ""]
    lists = bpe.pa.array([library.encode(t).ids for t in texts], bpe.pa.list_(bpe.pa.int32()))
    assert bpe._texts(lists, table) == texts and bpe._texts(lists.slice(3, 2), table) == texts[3:5]
    assert bpe._texts(lists.slice(0, 1), table) == [""] and bpe._texts(lists.slice(0, 0), table) == []
