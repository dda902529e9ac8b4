import random
import re

from siltstone.llm import decontam


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    """Documents and items with a stretch that agrees, over all alignments that share a seed."""
    found = set()
    for d, text in docs:
        own = words(text)
        for i, item in items:
            theirs = words(item)
            span = min(decontam.WINDOW, len(theirs))
            for shift in range(-len(theirs) + 1, len(own)):
                low, high = max(0, -shift), min(len(theirs), len(own) - shift)
                same = [own[k + shift] == theirs[k] for k in range(low, high)]
                seeded = any(all(same[k + j] for j, c in enumerate(m) if c == "1") for m in decontam.MASKS for k in range(len(same) - len(m) + 1))
                if seeded and any(5 * sum(same[k : k + span]) >= 4 * span for k in range(len(same) - span + 1)):
                    found.add((d, i))
    return found


def test_equals_brute_force_and_tolerates_substitutions(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([35, 40, 12, 6, 25, 4, 20])]
    items += [(9, None), (9, ""), (9, items[0][1])]
    docs = []
    for d in range(80):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if d % 2:
            passage = rng.choice([t for _, t in items if t]).split()
            passage = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.1, 0.2, 0.4]) else w for w in passage]
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage[: rng.choice([15, 22, 60])]
        docs.append((d, " ".join(body).upper() + "!"))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1])]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.contaminations(frame, bench).collect()
    got = [(r.doc_id, r.item_id) for r in rows]
    assert len(got) == len(set(got)) and set(got) == brute(docs, [(i, t) for i, t in items if t])
    assert {r.doc_id for r in rows} >= {102}
    left = {r.doc_id for r in decontam.decontaminated(frame, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in got}


def test_nulls_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(None, text)], "item_id long, text string")
    docs = spark.createDataFrame([(None, "x " + text), (1, "clean words here only")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.start, r.same) for r in decontam.contaminations(docs, bench).collect()] == [(None, None, 1, 20)]
    assert [r.doc_id for r in decontam.decontaminated(docs, bench).collect()] == [1]
    assert decontam.contaminations(docs.limit(0), bench).count() == 0
    assert decontam.contaminations(docs, bench.limit(0)).count() == 0
