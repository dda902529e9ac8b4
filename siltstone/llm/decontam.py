"""Benchmark decontamination by spaced seeds.

Texts are words (runs of letters and digits, lower case). Fixed masks pick some of the words of a
short window and ignore the others, so that a substituted word spoils only the masks that pick it.
Hashes of the picked words of all benchmark items meet those of all training texts in a join; each
hit fixes an alignment, and along it words are compared one by one. A text holds a passage of an
item if some stretch of WINDOW aligned words (the whole item if it is shorter) agrees in at least
four fifths of its words.

Items of fewer than five words have no seed and match nothing. A null text has no words. Repeated
benchmark ids count as one item with several texts; repeated documents are reported once for each
distinct text. Null ids are kept as null. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.merging import BROADCAST_BYTES, HASHED_BYTES, short
from siltstone.scratch import written

#: 1: the word is hashed; 0: it is ignored. Five words are picked by each mask.
MASKS = ("11111", "110111", "1101011", "10110011")
WINDOW = 20
SHARE_5TH = 4


def words_of(text: Column) -> Column:
    """Words of a text: runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seeds(hashes: Column, size: Column) -> Column:
    """For each place and mask in turn, the hash of the picked words, or null where the mask does not fit."""

    def at(place: Column) -> Column:
        told = []
        for number, mask in enumerate(MASKS):
            picked = [F.get(hashes, place + k) for k, c in enumerate(mask) if c == "1"]
            told.append(F.when(place + len(mask) <= size, F.xxhash64(F.lit(number), *picked)))
        return F.array(*told)

    shortest = min(map(len, MASKS))
    places = F.when(size >= shortest, F.sequence(F.lit(0), size - shortest)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(places, at))


def _seeded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, `at` (place of the seed) and `seed` for every seed of every row's text."""
    words = rows.select(*keys, F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    seeds = words.select(*keys, F.posexplode(_seeds(F.col("hashes"), F.size("hashes"))).alias("k", "seed")).where("seed IS NOT NULL")
    return seeds.select(*keys, F.expr(f"k div {len(MASKS)}").cast("int").alias("at"), "seed")


def _sent(table: DataFrame, sizes: DataFrame) -> DataFrame:
    """`table`, to be broadcast if the bytes of its rows (`size` of `sizes`) are few."""
    told = sizes.agg(F.sum(F.col("size").cast("long")), F.count("*")).first()
    return F.broadcast(table) if (told[0] or 0) + HASHED_BYTES * told[1] <= BROADCAST_BYTES else table


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it holds a passage of: doc_id, item_id, the best stretch
    (`start` in words of the document, `words`) and how many of its words agree (`same`)."""
    return _found(docs, benchmark).drop("body")


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`contaminations` with `body`, the hash of the document's text."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "text"))
    seeds = short(_seeded(items, ["item"]).withColumnRenamed("at", "item_at").distinct(), 32)
    base = docs.select("doc_id", "text").where("text IS NOT NULL").withColumn("body", F.xxhash64("text"))
    hits = _seeded(base, ["doc_id", "body"]).join(seeds, "seed")
    aligned = hits.select("doc_id", "body", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    known = items.select("item", "item_id", words_of(F.col("text")).alias("item_words"))
    aligned = aligned.groupBy(F.col("doc_id").alias("hit_id"), F.col("body").alias("hit_body")).agg(F.collect_list(F.struct("item", "shift")).alias("found"))
    aligned = written(aligned, "leak-aligned")
    near = _sent(aligned, aligned.select((32 * F.size("found")).alias("size")))
    on = base["doc_id"].eqNullSafe(near["hit_id"]) & (base["body"] == near["hit_body"])
    rows = base.join(near, on).select("doc_id", "body", words_of(F.col("text")).alias("words"), "found").dropDuplicates(["doc_id", "body"])
    # What an alignment can cover is cut out before the alignments become rows; the longest item bounds it.
    longest = items.agg(F.max(F.size(words_of(F.col("text"))))).first()[0] or 1

    def cut(pair: Column) -> Column:
        begin = F.greatest(pair["shift"], F.lit(0))
        return F.struct(pair["item"].alias("item"), pair["shift"].alias("shift"), begin.alias("begin"), F.slice("words", begin + 1, F.lit(longest)).alias("part"))

    rows = rows.select("doc_id", "body", F.explode(F.transform("found", cut)).alias("f")).select("doc_id", "body", "f.*")
    # A word in an array takes its bytes and, with its place, up to 16 more.
    rows = rows.join(_sent(known, items.select((9 * F.octet_length("text")).alias("size"))), "item")
    length = F.least(F.size("part"), F.size("item_words") - F.greatest(-F.col("shift"), F.lit(0)))
    rows = rows.withColumn("own", F.slice("item_words", F.greatest(-F.col("shift"), F.lit(0)) + 1, F.greatest(length, F.lit(0))))
    same = F.zip_with(F.slice("part", 1, F.size("own")), "own", lambda a, b: F.when(a == b, F.lit(1)).otherwise(F.lit(0)))
    rows = rows.withColumn("same", same).withColumn("span", F.least(F.lit(WINDOW), F.size("item_words"))).where("size(same) >= span")
    # Running counts give the words that agree in every stretch.
    rows = rows.withColumn("sums", F.transform(F.sequence(F.lit(1), F.size("same") - F.col("span") + 1), lambda s: F.aggregate(F.slice("same", s, F.col("span")), F.lit(0), lambda a, b: a + b)))
    rows = rows.withColumn("best", F.array_max("sums")).where(f"5 * best >= {SHARE_5TH} * span")
    start = F.col("begin") + F.array_position("sums", F.col("best")).cast("int") - 1
    rows = rows.select("doc_id", "item_id", "body", start.alias("start"), F.col("span").alias("words"), F.col("best").alias("same"))
    best = F.max(F.struct((F.col("same") / F.col("words")).alias("share"), F.col("words"), (-F.col("start")).alias("back"), F.col("same"))).alias("b")
    out = rows.groupBy("doc_id", "item_id", "body").agg(best)
    return out.select("doc_id", "item_id", "body", (-F.col("b.back")).alias("start"), F.col("b.words").alias("words"), F.col("b.same").alias("same"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents that hold a passage of an item; columns and other rows as they are."""
    found = _found(docs, benchmark).select(F.col("doc_id").alias("leaked_id"), F.col("body").alias("leaked_body")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["leaked_id"]) & (F.xxhash64(docs["text"]) == found["leaked_body"]), "left_anti")
