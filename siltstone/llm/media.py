"""Media columns: payloads cut by content, stored once per distinct chunk, rebuilt and verified.

A text becomes a payload of 8-bit samples (UTF-8, padded with bytes 255 to a positive multiple of
576) inside a mono WAV. A rolling gear hash cuts the payload; chunk digests are deduplicated by
Spark aggregations and joins; the store keeps each distinct chunk once, beside ordered chunk lists
from which every medium is rebuilt and checked against its digest.

Chunk bytes stay where their document is: only digests are shuffled, and the few chunks that one
medium borrows from another. Nulls: a null text is empty; a null doc_id is kept as null. Equal
texts are one medium; repeated rows each get their row; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.scratch import written

UNIT = 576
PAD = 255
RATE = 8000
#: Chunk sizes in bytes, and the bits of the gear hash that are zero at a cut (one byte in 1024).
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 256, 4096, 10
#: The gear hash looks back 32 bytes, fewer than MIN_CHUNK, so no cut depends on what stands before.
GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)
#: Most bytes of a list of shared chunks that is broadcast; a longer one is joined by shuffle.
BROADCAST_BYTES = 64 << 20
NO_ID = -(2**63)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload of a text, and its bytes before padding."""
    data = (text or "").encode("utf-8", "replace")
    units = max(1, -(-len(data) // UNIT))
    return data + bytes([PAD]) * (units * UNIT - len(data)), len(data)


def wav_header(n: int) -> bytes:
    """The 44 bytes that make `n` 8-bit mono samples a WAV file."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def cut_points(payload: bytes) -> list[int]:
    """Ends of the chunks of a payload: where the gear hash has CUT_BITS zero bits, within the sizes."""
    n = len(payload)
    h = GEAR[np.frombuffer(payload, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        shifted = h.copy()
        shifted[k:] += h[:-k] << np.uint32(k)
        h = shifted
    found = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    ends, start = [], 0
    while n - start > MIN_CHUNK:
        at = np.searchsorted(found, start + MIN_CHUNK)
        end = min(int(found[at]) if at < len(found) else n, start + MAX_CHUNK, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunks_of(payload: bytes) -> tuple[list[bytes], list[bytes], list[int]]:
    """Distinct digests, their bytes, and the payload as a list of positions among them."""
    seen: dict[bytes, int] = {}
    parts, order, start = [], [], 0
    for end in cut_points(payload):
        part = payload[start:end]
        digest = hashlib.blake2b(part, digest_size=16).digest()
        if digest not in seen:
            seen[digest] = len(parts)
            parts.append(part)
        order.append(seen[digest])
        start = end
    return list(seen), parts, order


def media_feature(samples: np.ndarray) -> str:
    """Mean, deviation, entropy of the histogram and zero-crossing share of 8-bit samples."""
    n = len(samples)
    counts = np.bincount(samples, minlength=256)
    values = np.arange(256)
    mean = float((counts * values).sum()) / n
    variance = float((counts * (values - mean) ** 2).sum()) / n
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum())
    high = samples >= 128
    crossings = int((high[1:] != high[:-1]).sum())
    return f"mean={mean:.4f};std={variance**0.5:.4f};entropy={entropy:.4f};crossings={crossings};peak={int(samples.max())}"


MANIFEST = "id long, media_key binary, n_bytes long, payload_bytes long, digests array<binary>"


def _manifest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch["id"], batch["text"]):
            payload, n = payload_of(text)
            rows.append((doc, hashlib.sha256(payload + n.to_bytes(8, "big")).digest(), n, len(payload), chunks_of(payload)[0]))
        yield pd.DataFrame(rows, columns=["id", "media_key", "n_bytes", "payload_bytes", "digests"])


STORE = "media_key binary, n_bytes long, header binary, chunk_order array<int>, digests array<binary>, chunks array<binary>, borrowed boolean, lent array<int>"


def _store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, foreign, lent in zip(batch["text"], batch["foreign"], batch["lent"]):
            payload, n = payload_of(text)
            digests, parts, order = chunks_of(payload)
            away = set() if foreign is None else {int(i) for i in foreign}
            rows.append((
                hashlib.sha256(payload + n.to_bytes(8, "big")).digest(), n, wav_header(len(payload)), order, digests,
                [None if i in away else p for i, p in enumerate(parts)], bool(away), [] if lent is None else [int(i) for i in lent],
            ))
        yield pd.DataFrame(rows, columns=["media_key", "n_bytes", "header", "chunk_order", "digests", "chunks", "borrowed", "lent"])


READ = "media_key binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, n, header, order, chunks in zip(batch["media_key"], batch["n_bytes"], batch["header"], batch["chunk_order"], batch["chunks"]):
            payload = b"".join(chunks[i] for i in order)
            if hashlib.sha256(payload + int(n).to_bytes(8, "big")).digest() != bytes(key):
                raise ValueError("a rebuilt payload differs from its digest")
            rows.append((
                key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(header) + len(payload),
                hashlib.sha256(bytes(header) + payload).hexdigest(), media_feature(np.frombuffer(payload, np.uint8)),
            ))
        yield pd.DataFrame(rows, columns=["media_key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_manifest(docs: DataFrame) -> DataFrame:
    """One row per document: its medium's key, sizes and distinct chunk digests in order."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return base.mapInPandas(_manifest, MANIFEST)


def media_store(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """The chunk store: a row per distinct medium, holding the chunks that no other medium holds for it.

    Each medium is stored beside its first document and each shared chunk in the medium of the
    smallest first document; `borrowed` media lack the chunks that others have `lent`.
    """
    media = manifest.groupBy("media_key").agg(F.min("id").alias("owner"), F.count("*").alias("copies"))
    owned = manifest.join(media, "media_key").where("id = owner").dropDuplicates(["media_key"])
    uses = owned.select("media_key", "owner", "copies", F.posexplode("digests").alias("at", "digest"))
    # Media of one document (a repeated id) are told apart by their key, so each chunk has one holder.
    shared = uses.groupBy("digest").agg(F.min("owner").alias("first"), F.count("*").alias("uses")).where("uses > 1")
    holder = uses.join(shared, "digest").where("owner = first").groupBy("digest").agg(F.min("media_key").alias("holder"))
    marks = uses.join(holder, "digest").groupBy("media_key").agg(
        F.collect_list(F.when(F.col("media_key") != F.col("holder"), F.col("at"))).alias("foreign"),
        F.collect_list(F.when(F.col("media_key") == F.col("holder"), F.col("at"))).alias("lent"),
    )
    notes = written(media.where("copies > 1").select("media_key", "owner").join(marks, "media_key", "full_outer"), "media-notes")
    notes_bytes = notes.agg(F.sum(F.lit(64) + 8 * (F.greatest(F.size("foreign"), F.lit(0)) + F.greatest(F.size("lent"), F.lit(0))))).first()[0] or 0
    # The scan of texts meets the short list of notes by the medium's key, computed alike on both sides.
    body = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    body = body.withColumn("media_key", _media_key(F.col("text")))
    if notes_bytes <= BROADCAST_BYTES:
        notes = F.broadcast(notes)
    kept = body.join(notes, "media_key", "left").where("owner IS NULL OR owner = id").select("text", "foreign", "lent")
    return kept.mapInPandas(_store, STORE)


def _media_key(text):
    """The key that `_manifest` computes, as a Spark expression."""
    data = F.encode(text, "UTF-8")
    n = F.octet_length(text)
    units = F.greatest(F.lit(1), F.ceil(n / F.lit(UNIT)).cast("int"))
    pad = F.unhex(F.repeat(F.lit("FF"), units * UNIT - n))
    return F.unhex(F.sha2(F.concat(data, pad, F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))), 256))


def read_media(store: DataFrame) -> DataFrame:
    """Rebuild every medium of a store from its ordered chunk list, verify it and compute its columns."""
    whole = store.where("NOT borrowed").select("media_key", "n_bytes", "header", "chunk_order", "chunks")
    lent = store.where("size(lent) > 0").select(F.explode("lent").alias("at"), "digests", "chunks")
    lent = lent.select(F.element_at("digests", F.col("at") + 1).alias("digest"), F.element_at("chunks", F.col("at") + 1).alias("chunk"))
    lent = lent.dropDuplicates(["digest"])
    parts = store.where("borrowed").select("media_key", F.posexplode(F.arrays_zip("digests", "chunks")).alias("at", "p"))
    parts = parts.select("media_key", "at", F.col("p.digests").alias("digest"), F.col("p.chunks").alias("chunk"))
    parts = parts.dropDuplicates(["media_key", "at"])  # equal rows store a medium twice
    found = parts.where("chunk IS NULL").drop("chunk").join(lent, "digest").select("media_key", "at", "chunk")
    rebuilt = parts.where("chunk IS NOT NULL").select("media_key", "at", "chunk").unionByName(found)
    rebuilt = rebuilt.groupBy("media_key").agg(F.expr("transform(array_sort(collect_list(struct(at, chunk))), x -> x.chunk)").alias("chunks"))
    heads = store.where("borrowed").select("media_key", "n_bytes", "header", "chunk_order").dropDuplicates(["media_key"])
    return whole.unionByName(heads.join(rebuilt, "media_key").select(whole.columns)).mapInPandas(_read_back, READ)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text of `docs` as a medium and return one row per document, computed from what was stored."""
    manifest = written(media_manifest(docs), "media-manifest")
    store = written(media_store(docs, manifest), "media-store")
    # Two equal rows (same id, same text) store a medium twice; its columns are equal, one is taken.
    read = read_media(store).dropDuplicates(["media_key"])
    out = manifest.select("id", "media_key").join(read, "media_key")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), *read.columns[1:])
