"""BPE by a distinct-word table: split words in Spark, encode each once, join ids back by position.

Documents are dealt into blocks of about BLOCK_BYTES of text by a hash. Each block yields its distinct
words (pre-tokens), numbered in sorted order; all blocks' words are dealt by word, so each distinct
word of the corpus meets the encoder once, and its ids go back to (block, number). There the texts
of the block are split again and every position takes the ids of its word. Text is shuffled once,
compressed; words are shuffled once a block and not once an occurrence.

Decoding joins ids with the table of pieces, which has as many rows as the vocabulary and so is sent
to every task. The vocabulary file's path is a parameter, read by the driver alone.

A null or empty text has no ids and decodes to the empty text; repeated rows are encoded each; other
columns are ignored. Strings of special tokens inside a text become that token, as the library has it.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import trim

BLOCK_BYTES = 8 << 20
#: Most partitions of a shuffle; beyond it a partition holds several blocks, one at a time.
MOST_PARTITIONS = 20_000
#: Distinct words that a task keeps encoded at once.
TABLE_WORDS = 1_000_000
#: Documents that are decoded at once.
DECODED = 200
#: The pre-tokenizer's pattern, with its white space spelled out (fixed values of the vocabulary's format).
SPACE = r"\t\n\v\f\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


#: The same pattern for texts of Latin-1 letters, which the standard library matches faster. The
#: Latin-1 numbers that are not digits are left to the full pattern.
LATIN_LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
LATIN_SPACE = r"\t\n\v\f\r \x85\xa0"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN_LETTERS}]+| ?[0-9]+| ?[^{LATIN_SPACE}{LATIN_LETTERS}0-9]+|[{LATIN_SPACE}]+(?![^{LATIN_SPACE}])|[{LATIN_SPACE}]+"
LATIN_NUMBERS = "\xb2\xb3\xb9\xbc\xbd\xbe"


def is_plain_latin(text: str) -> bool:
    """True if both patterns split a text alike."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not any(c in text for c in LATIN_NUMBERS)


class Splitter:
    """Splits texts into pre-tokens; special tokens stand alone."""

    def __init__(self, specials: list[str]) -> None:
        self.specials = sorted(specials, key=len, reverse=True)
        self._compiled = None

    def __getstate__(self) -> dict:
        return {"specials": self.specials, "_compiled": None}

    def _words(self, text: str) -> list[str]:
        return self._compiled[0 if is_plain_latin(text) else 1].findall(text)

    def __call__(self, text: str) -> list[str]:
        if self._compiled is None:
            import regex

            marks = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
            self._compiled = re.compile(LATIN_PATTERN), regex.compile(PATTERN), marks
        marks = self._compiled[2]
        if marks is None or not any(s in text for s in self.specials):
            return self._words(text)
        found: list[str] = []
        for i, part in enumerate(marks.split(text)):
            found += [part] if i % 2 else self._words(part)
        return found


class Numbering(dict):
    """Numbers new keys in order of first use."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def special_tokens(tokenizer_json: str) -> list[str]:
    return [t["content"] for t in json.loads(tokenizer_json).get("added_tokens", [])]


def piece_table(tokenizer_json: str) -> list[bytes]:
    """The bytes of every id: the byte-level alphabet undone, special tokens as they are."""
    told = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    others = [b for b in range(256) if b not in set(told)]
    byte_of = {chr(b): b for b in told} | {chr(256 + i): b for i, b in enumerate(others)}
    parsed = json.loads(tokenizer_json)
    rows = {i: bytes(byte_of[c] for c in piece) for piece, i in parsed["model"]["vocab"].items()}
    rows |= {t["id"]: t["content"].encode() for t in parsed.get("added_tokens", [])}
    return [rows.get(i, b"") for i in range(max(rows) + 1)]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a batch that go to one block, compressed together."""
    for batch in batches:
        block = batch.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        bounds = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0, True]) if len(block) else np.zeros(1, np.int64)
        blocks, packed = [], []
        for a, b in zip(bounds, bounds[1:]):
            some = batch.select(["doc_id", "text"]).take(pa.array(order[a:b]))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, some.schema) as out:
                out.write_batch(some)
            blocks.append(int(block[order[a]]))
            packed.append(zstandard.compress(sink.getvalue(), 3))
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], ["block", "packed"])


def _unpack(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(bytes(packed))).read_all()


def _words_of(splitter: Splitter, parts: int):
    """The distinct words of a block, numbered in sorted order and packed by the part that encodes them."""

    def words(part: pd.DataFrame) -> pd.DataFrame:
        found: set[str] = set()
        for packed in part["packed"]:
            for text in _unpack(packed)["text"].to_pylist():
                found.update(splitter(text))
        dealt: dict[int, tuple[list[int], list[str]]] = {}
        for number, word in enumerate(sorted(found)):
            numbers, own = dealt.setdefault(zlib.crc32(word.encode()) % parts, ([], []))
            numbers.append(number)
            own.append(word)
        rows = [(k, part["block"].iloc[0], _squeeze(numbers), _squeeze(own)) for k, (numbers, own) in dealt.items()]
        dealt.clear()
        found.clear()
        trim()
        return pd.DataFrame(rows, columns=["part", "block", "numbers", "words"])

    return words


def _squeeze(values: list) -> bytes:
    """A list of words, or of rising numbers as their differences, compressed."""
    if values and isinstance(values[0], str):
        table = pa.table({"w": pa.array(values, pa.large_string())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return zstandard.compress(sink.getvalue(), 3)
    return zstandard.compress(np.diff(np.array(values, np.int32), prepend=np.int32(0)).tobytes(), 3)


def _numbers(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(bytes(packed)), np.int32), dtype=np.int64)


def separator(tokenizer_json: str) -> str | None:
    """The special token of a vocabulary that has a single one, if it splits any text where it stands."""
    added = json.loads(tokenizer_json).get("added_tokens", [])
    if len(added) != 1 or any(added[0].get(flag) for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    mark = added[0]["content"]
    return None if any(mark.startswith(mark[-n:]) for n in range(1, len(mark))) else mark


def _ids_of(tokenizer, words: list[str], mark: str | None) -> list[bytes]:
    """The ids of each word. One long text costs less than many short ones, so words are joined by `mark`."""
    if mark is not None and not any(mark in w for w in words):
        ids = np.array(tokenizer.encode_batch_fast([mark.join(words)], add_special_tokens=False)[0].ids, np.int32)
        cuts = np.flatnonzero(ids == tokenizer.token_to_id(mark)).tolist()
        if len(cuts) == len(words) - 1:
            return [ids[a + 1 : b].tobytes() for a, b in zip([-1, *cuts], [*cuts, len(ids)])]
    return [np.array(e.ids, np.int32).tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def _encode_words(tokenizer_json):
    """Each distinct word of a part is encoded once; ids and their counts go back to every block with it."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json.value)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        mark = separator(tokenizer_json.value)
        table: dict[str, bytes] = {}
        for batch in batches:
            for block, numbers, packed in zip(batch["block"], batch["numbers"], batch["words"]):
                words = pa.ipc.open_stream(zstandard.decompress(bytes(packed))).read_all()["w"].to_pylist()
                new = [w for w in words if w not in table]
                if len(table) + len(new) > TABLE_WORDS:
                    table, new = {}, words
                for at in range(0, len(new), 5000):
                    some = new[at : at + 5000]
                    table.update(zip(some, _ids_of(tokenizer, some, mark)))
                ids = [table[w] for w in words]
                counts = np.array([len(i) // 4 for i in ids], np.int32)
                yield pd.DataFrame({"block": [block], "numbers": [numbers], "counts": [zstandard.compress(counts.tobytes(), 3)], "ids": [zstandard.compress(b"".join(ids), 3)]})
        table.clear()
        trim()

    return encode


def _place(splitter: Splitter):
    """Split a block's texts again and put the ids of its words at their positions."""

    def place(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        docs, places = [], []
        at_of = Numbering()
        for packed in texts["packed"]:
            table = _unpack(packed)
            docs += table["doc_id"].to_pylist()
            for text in table["text"].to_pylist():
                found = splitter(text)
                places.append(np.fromiter(map(at_of.__getitem__, found), np.int32, len(found)))
        # Numbers count the sorted words; `at_of` counts them as they came.
        number = np.empty(len(at_of), np.int64)
        number[[at_of[w] for w in sorted(at_of)]] = np.arange(len(at_of))
        numbers = [_numbers(p) for p in words["numbers"]]
        counts = [np.frombuffer(zstandard.decompress(bytes(p)), np.int32) for p in words["counts"]]
        count_of = np.zeros(len(at_of), np.int64)
        start_of = np.zeros(len(at_of), np.int64)
        flat = np.concatenate([np.frombuffer(zstandard.decompress(bytes(p)), np.int32) for p in words["ids"]] or [np.zeros(0, np.int32)])
        if sum(map(len, numbers)) != len(at_of):
            raise ValueError("a block has other words than it was encoded with")
        if len(at_of):
            all_numbers, all_counts = np.concatenate(numbers), np.concatenate(counts)
            count_of[all_numbers] = all_counts
            start_of[all_numbers] = np.cumsum(all_counts) - all_counts
        out = []
        for place in places:
            own = number[place]
            n = count_of[own]
            ends = np.cumsum(n)
            index = np.repeat(start_of[own] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
            out.append(flat[index])
        del places, at_of, flat
        trim()
        return pd.DataFrame({"doc_id": pd.array(docs, dtype="Int64"), "ids": out})

    return place


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and `ids` (array<int>) of every whole text of `docs`."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        text_of = f.read()
    tokenizer_json = spark.sparkContext.broadcast(text_of)
    splitter = Splitter(special_tokens(text_of))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    base = base.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    partitions = min(blocks, MOST_PARTITIONS)
    packed = base.mapInArrow(_pack, "block int, packed binary").repartition(partitions, "block")
    words = packed.groupBy("block").applyInPandas(_words_of(splitter, partitions), "part int, block int, numbers binary, words binary")
    encoded = words.repartition(partitions, "part").mapInPandas(_encode_words(tokenizer_json), "block int, numbers binary, counts binary, ids binary")
    return packed.groupBy("block").cogroup(encoded.groupBy("block")).applyInPandas(_place(splitter), "doc_id long, ids array<int>")


def _texts(ids: pa.ListArray, table: pa.Array) -> list[str]:
    """The texts of lists of ids: all their pieces are taken at once and lie in one buffer."""
    found = table.take(ids.flatten())
    at = ids.offsets.to_numpy()
    ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[at - at[0]].tolist()
    data = (found.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """`encoded` (doc_id, ids) with `decoded`, the text of the ids' pieces."""
    with open(tokenizer_path, encoding="utf-8") as f:
        pieces = encoded.sparkSession.sparkContext.broadcast(piece_table(f.read()))

    @F.arrow_udf("string")
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = pa.array(pieces.value, pa.large_binary())
        for column in batches:
            yield pa.array([text for at in range(0, len(column), DECODED) for text in _texts(column.slice(at, DECODED), table)], pa.string())
        trim()

    return encoded.select("doc_id", "ids", joined("ids").alias("decoded"))


def digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode and decode all of `docs`; one row per document with the digests of both."""
    both = decode(encode(docs, tokenizer_path), tokenizer_path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
