import hashlib
import zlib

from siltstone.llm import media


def brute(text):
    payload, n = media.payload_of(text)
    whole = media.wav_header(len(payload)) + payload
    return (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(whole), hashlib.sha256(whole).hexdigest())


def base_texts():
    words = " ".join(f"word{i * 7919 % 1009}" for i in range(3000))
    return [None, "", "a", "x" * 576, "é" * 300, words, words + " tail", "head " + words, words[:9000] + "changed" + words[9000:], words, "A" * 50000]


def test_round_trip_of_shared_chunks(spark):
    texts = base_texts()
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(5, texts[5], "k"), (5, "other", "k"), (None, texts[6], "k"), (6, texts[6], "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, media_key string")
    got = media.media_columns(frame).collect()
    assert sorted((r.doc_id or -1, r.payload_sha256) for r in got) == sorted((d or -1, brute(t)[2]) for d, t, _ in rows)
    for r in got:
        same = {brute(t) for d, t, _ in rows if d == r.doc_id}
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) in same
    manifest = media.media_manifest(frame).cache()
    store = media.media_store(frame.dropDuplicates(), manifest)
    held = [bytes(c) for r in store.collect() for c in r.chunks if c is not None]
    assert len(held) < sum(len(r.digests) for r in manifest.collect())


def test_cuts_do_not_depend_on_what_stands_before():
    payload = media.payload_of(base_texts()[5])[0]
    ends = media.cut_points(payload)
    assert ends[-1] == len(payload) and all(b - a <= media.MAX_CHUNK for a, b in zip([0, *ends], ends))
    first = ends[2]
    assert media.cut_points(payload[first:]) == [e - first for e in ends[3:]]


def test_empty_table(spark):
    assert media.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0
