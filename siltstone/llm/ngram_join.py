"""N-gram Jaccard join by adaptive multi-match prefixes.

Texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8 are linked, exactly,
and every document gets the smallest id it can reach by links.

Plan. Documents of one shingle set form a class, named by 64 bits of its digest, so ids may be null or
repeat with different texts; one row, told by (id, hash of the text), stands for a class. A set's tokens are put in one global order: first
those that repeat little, by hash, then the frequent ones (a bounded list of heavy hitters). With
`need` = ceil(0.8 * size), two linked sets share at least m tokens within the first
size - need + m of each, for every m up to `need`. Each class picks its own m: where a prefix meets
many others, it is lengthened and m shared tokens are asked for, if the estimated cost of fetching
and verifying candidates is lower so. A pair needs the smaller m of its two classes.

Large groups of near copies are never expanded into pairs. Rounds (`merging`) verify each class against a few
classes that stand for its tokens and join what is linked. What is left is made into pairs of stars (a
class and what was linked to it first) of different components; stars are compared by their centres
and opened only where the triangle inequality leaves room for a link and no link has joined their
components meanwhile. An opened star is compared in blocks, which yield links and not pairs. All links
are verified on whole sets.

Defined cases: null, empty and blank texts have no set and are their own component; rows of one id
are compared each with its own text and report the component of that text; a component is named by
the smallest id that is not null in it, or null if there is none; rows equal in id and text are
reported each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.batches import small_batches, trim
from siltstone.llm.components import connected
from siltstone.llm.merging import merge, short
from siltstone.llm.shingles import shingle_sets
from siltstone.scratch import discard, written

#: Largest number of shared prefix tokens that is asked for.
MOST_MATCHES = 4
#: Cost of verifying a candidate pair, in units of one pair of prefix entries.
VERIFY_COST = 8.0
#: The list of frequent tokens never has more entries than this (8 bytes each).
MOST_HEAVY = 1 << 20
#: A token that fewer texts have is not frequent at any size of the input.
LEAST_HEAVY = 64
NO_ID = -(2**63)
#: Tokens that a task counts at once when it looks for frequent ones.
COUNT_TOKENS = 2_000_000
#: Rows that a task sends on at once.
SEND_ROWS = 200_000
#: Classes in a block when stars are opened.
BLOCK = 64
#: Frequent tokens are counted in so many parts each.
SALTS = 64


def required(size):
    """The least overlap of a set of this size with any set linked to it: ceil(0.8 * size)."""
    return (4 * size + 4) // 5


PROFILE = "id long, body long, size int, node long, token long, n long"


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and class of each text's set; and, in rows of their own, tokens that repeat within a
    stretch of texts, with counts."""
    held: list[np.ndarray] = []
    size = 0

    def rows(length: int, **known: pa.Array) -> pa.RecordBatch:
        types = {"id": pa.int64(), "body": pa.int64(), "size": pa.int32(), "node": pa.int64(), "token": pa.int64(), "n": pa.int64()}
        return pa.RecordBatch.from_arrays([known[c] if c in known else pa.nulls(length, t) for c, t in types.items()], list(types))

    def repeats() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        keep = counts > 1
        return rows(int(keep.sum()), token=pa.array(values[keep].view(np.int64)), n=pa.array(counts[keep].astype(np.int64)))

    for batch in batches:
        sizes, names = [], []
        for tokens in shingle_sets(batch.column("text")):
            sizes.append(len(tokens))
            names.append(_name(tokens))
            held.append(tokens)
            size += len(tokens)
            if size >= COUNT_TOKENS:
                yield repeats()
                held, size = [], 0
        yield rows(len(sizes), id=batch.column("id"), body=batch.column("body"), size=pa.array(sizes, pa.int32()), node=pa.array(names, pa.int64()))
    yield repeats()
    held.clear()
    trim()


def frequent_tokens(profiles: DataFrame) -> np.ndarray:
    """Heavy hitters among all tokens of all texts, sorted: at most MOST_HEAVY of them.

    A token counts where it repeats within a stretch; its count is a lower bound. The list only sets
    the order of tokens, so it changes cost and never results.
    """
    counts = profiles.where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n"))
    total = profiles.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
    least = max(LEAST_HEAVY, -(-total // MOST_HEAVY))
    found = counts.where(f"n >= {least}").select("token").toPandas()["token"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def _name(tokens: np.ndarray) -> int:
    """The class of a set: 64 bits of its digest."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


ENTRY = "key long, node long, size int, place int, common boolean"


def _entries(heavy):
    """A row for each token of each text's longest prefix: token, class, size, place, and if it is frequent."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = heavy.value
        names, heads, sizes, rare, rows = [], [], [], [], 0

        def told() -> pa.RecordBatch:
            counts = [len(h) for h in heads]
            place = np.concatenate([np.arange(c, dtype=np.int32) for c in counts] or [np.zeros(0, np.int32)])
            tokens = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
            columns = [tokens.view(np.int64), np.repeat(np.array(names, np.int64), counts), np.repeat(np.array(sizes, np.int32), counts), place, place >= np.repeat(np.array(rare, np.int32), counts)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "size", "place", "common"])

        for batch in batches:
            for tokens in shingle_sets(batch.column("text")):
                size = len(tokens)
                names.append(_name(tokens))
                length = min(size, size - required(size) + MOST_MATCHES)
                rare.append(size)
                if len(frequent) and size:
                    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                    common = frequent[at] == tokens
                    rare[-1] = size - int(common.sum())
                    tokens = np.concatenate([tokens[~common], tokens[common]])
                # A copy, as a view would keep the whole set in memory.
                heads.append(tokens[:length].copy())
                sizes.append(size)
                rows += length
                if rows >= SEND_ROWS:
                    yield told()
                    names, heads, sizes, rare, rows = [], [], [], [], 0
        yield told()
        names, heads, sizes, rare = [], [], [], []
        trim()

    return entries


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class and whole set of each text that has one."""
    schema = pa.schema([("node", pa.int64()), ("tokens", pa.list_(pa.int64()))])
    for batch in batches:
        held, size = [], 0
        for tokens in shingle_sets(batch.column("text")):
            if len(tokens):
                held.append(tokens.view(np.int64))
                size += len(tokens)
            if size >= SEND_ROWS:
                yield _listed(held, schema)
                held, size = [], 0
        yield _listed(held, schema)
    trim()


def _listed(held: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, held)], dtype=np.int32)
    flat = np.concatenate(held) if held else np.zeros(0, np.int64)
    names = [_name(t) for t in held]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], schema=schema)


class _Texts:
    """The texts that stand for classes: `base` (id, body, text), where rows may repeat."""

    def __init__(self, base: DataFrame, reps: DataFrame, repeated: DataFrame) -> None:
        self.reps = reps
        self.parts = [base.where("text IS NOT NULL")]
        if repeated.count():
            once = self.parts[0].join(short(repeated, 32), ["id", "body"], "left_semi").groupBy("id", "body").agg(F.first("text").alias("text"))
            self.parts = [self.parts[0].join(short(repeated, 32), ["id", "body"], "left_anti"), written(once, "repeated-texts")]

    def of(self, rows: DataFrame, how: str = "left_semi") -> DataFrame:
        """Texts whose id and body are, or with left_anti are not, in `rows`; each once."""
        parts = [p.join(short(rows, 32), ["id", "body"], how).select("text") for p in self.parts]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def compared(self, pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) with the sizes of their whole sets (nx, ny), and of intersection and union."""
        wanted = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
        found = written(self.reps.join(short(written(wanted, "wanted"), 16), "node", "left_semi").select("id", "body"), "wanted-texts")
        sets = written(self.of(found).mapInArrow(_sets, "node long, tokens array<long>"), "sets")
        one, two = sets.toDF("x", "tx"), sets.toDF("y", "ty")
        both = short(pairs, 48).join(one, "x").join(two, "y").withColumn("shared", F.size(F.array_intersect("tx", "ty")).cast("long"))
        both = both.select(*pairs.columns, "shared", F.size("tx").alias("nx"), F.size("ty").alias("ny"))
        out = written(both.withColumn("union", F.col("nx") + F.col("ny") - F.col("shared")), "compared")
        discard(sets, found)
        return out


    def opened(self, lone: DataFrame, members: DataFrame) -> DataFrame:
        """Links (x, y) between the classes of `lone` and of `members` that have the same `star`."""
        members = members.join(short(written(lone.select("star").distinct(), "opened"), 16), "star", "left_semi")
        wanted = written(lone.select("node").unionByName(members.select("node")).distinct(), "wanted")
        found = written(self.reps.join(short(wanted, 16), "node", "left_semi").select("id", "body"), "wanted-texts")
        sets = written(self.of(found).mapInArrow(_sets, "node long, tokens array<long>"), "sets")

        def blocks(rows: DataFrame, side: str) -> DataFrame:
            sizes = rows.groupBy("star").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
            rows = rows.join(sizes, "star").select("star", F.pmod(F.xxhash64("node"), "blocks").alias("block"), "node").join(sets, "node")
            rows = rows.groupBy("star", "block").agg(F.collect_list(F.struct("node", "tokens")).alias("rows"))
            return written(rows.select("star", F.col("rows.node").alias(f"nodes{side}"), F.col("rows.tokens").alias(f"tokens{side}")), f"blocks-{side}")

        met = blocks(lone, "x").join(blocks(members, "y"), "star").drop("star")
        return written(met.mapInArrow(_block_links, "x long, y long").distinct(), "block-links")


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The linked pairs of two blocks of sets, block by block."""
    for batch in batches:
        xs, ys = [], []
        for nx, tx, ny, ty in zip(*(batch.column(c) for c in ("nodesx", "tokensx", "nodesy", "tokensy"))):
            ty, names = ty.values, ny.values.to_numpy()
            sizes = ty.value_lengths().to_numpy()
            flat, owner = ty.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
            for name, own in zip(nx.values.to_numpy(), tx.values):
                own = np.sort(own.values.to_numpy())
                found = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                shared = np.bincount(owner[found], minlength=len(sizes))
                linked = (100 * shared >= 80 * (len(own) + sizes - shared)) & (names != name)
                ys.append(names[linked])
                xs.append(np.full(int(linked.sum()), name))
        flat = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys)]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in flat], ["x", "y"])


def _linked(compared: DataFrame) -> DataFrame:
    return compared.where("100 * shared >= 80 * union")


def _alike(a: str, b: str) -> str:
    """SQL: sizes a and b may be linked."""
    return f"5 * least({a}, {b}) >= 4 * greatest({a}, {b})"


def _prefixes(own: DataFrame, heavy) -> DataFrame:
    """Prefix entries of classes: key (token), node (class), size, m (matches it asks for), and how common its tokens are."""
    entries = own.mapInArrow(_entries(heavy), ENTRY)
    # One shuffle by token counts its texts; the frequent ones, which are known, are counted in parts.
    entries = entries.withColumn("salt", F.when(F.col("common"), F.pmod("node", F.lit(SALTS))).otherwise(F.lit(0)))
    entries = entries.withColumn("df", F.count("*").over(Window.partitionBy("key", "salt")) * F.when(F.col("common"), F.lit(SALTS)).otherwise(F.lit(1)))
    entries = entries.where("df > 1").drop("salt")
    # The number of matches that each class asks for: the cheapest by the estimate below.
    first = "size - (4 * size + 4) div 5"
    own = Window.partitionBy("node")
    costs = [F.sum(F.expr(f"CASE WHEN place < {first} + {m} THEN df - 1 ELSE 0 END")).over(own) for m in range(1, MOST_MATCHES + 1)]
    # Fetching costs a unit for each entry met; at most cost / m candidates share m tokens.
    estimates = [F.when(F.expr(f"(4 * size + 4) div 5 >= {m}"), c * (1 + VERIFY_COST / m)).otherwise(F.lit(float("inf"))) for m, c in enumerate(costs, 1)]
    entries = entries.withColumn("estimates", F.array(*estimates)).withColumn("score", F.sum(F.log("df")).over(own))
    entries = entries.withColumn("m", F.expr("cast(array_position(estimates, array_min(estimates)) as int)"))
    return entries.where(f"place < {first} + m").select("key", "node", "size", "m", "score", F.expr(f"({first} + m + 2) div 3").alias("least"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs` (doc_id, text), class_id (the smallest id of
    its class), body (hash of the text) and group_id (the component, told apart where smallest ids are equal)."""
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text", F.xxhash64("text").alias("body"))
    scanned = written(base.mapInArrow(_profiles, PROFILE), "profiles")
    heavy = spark.sparkContext.broadcast(frequent_tokens(scanned))
    profiles = scanned.where("token IS NULL").select("id", "body", "size", "node")
    full = profiles.where("size > 0")
    named = F.min(F.when(F.col("id") != NO_ID, F.col("id"))).alias("first")
    # One row for each class: the smallest id, then the smallest text hash.
    least = full.groupBy("node").agg(F.min("id").alias("id"), named)
    reps = full.join(least, ["node", "id"]).groupBy("node", "id", "first").agg(F.min("body").alias("body"))
    reps = written(reps, "classes")
    rows = full.groupBy("id", "body", "node").agg(F.count("*").alias("n"))
    repeated = written(rows.where("n > 1").select("id", "body"), "repeated")
    copies = written(rows.select("id", "body").join(reps.select("id", "body"), ["id", "body"], "left_anti"), "copies")
    texts = _Texts(base, reps, repeated)

    entries = written(_prefixes(texts.of(copies, "left_anti"), heavy), "prefixes")
    links, active = merge(entries, lambda pairs: _linked(texts.compared(pairs)).drop("ny", "union"), _alike("size", "other.size"))
    links = written(links, "star-links")
    members = links.groupBy(F.col("x").alias("node")).agg(F.min(F.struct("y", "shared", "nx")).alias("s"))
    members = members.select("node", F.col("s.y").alias("star"), F.col("s.shared").alias("shared"), F.col("s.nx").alias("size"))
    members = written(members, "members")

    # The members of a star are one, and pairs are made of stars of different components, by their centres.
    active = active.join(members.select("node", "star"), "node", "left").withColumn("single", (F.col("component") == F.col("node")) & F.col("star").isNull())
    active = written(active.withColumn("star", F.coalesce("star", "node")).select("key", "size", "m", "component", "star", "single"), "stars")
    groups = active.groupBy("key", "star", "component").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.min("m").alias("m"), F.min("single").alias("single"))
    met = groups.alias("a").join(groups.alias("b"), F.expr("a.key = b.key AND a.star < b.star AND a.component <> b.component AND 5 * a.high >= 4 * b.low AND 5 * b.high >= 4 * a.low"))
    met = met.groupBy(F.col("a.star").alias("x"), F.col("b.star").alias("y")).agg(F.count("*").alias("n"), F.min(F.least("a.m", "b.m")).alias("m"), F.min("a.single").alias("lonex"), F.min("b.single").alias("loney"), F.min("a.component").alias("cx"), F.min("b.component").alias("cy"))
    compared = texts.compared(written(met.where("n >= m").drop("n", "m"), "star-pairs"))
    links = links.select("x", "y").unionByName(_linked(compared).select("x", "y"))

    # Opened are stars of components that no link has joined meanwhile. By the triangle inequality two stars
    # can only hold a link if their centres are within distance 0.6 (members are within 0.2 of them), and a
    # class and a star if class and centre are within 0.4; so one star's members first meet the other's centre.
    joined = connected(_linked(compared).select("cx", "cy"))
    for c in ("cx", "cy"):
        compared = compared.join(short(joined.toDF(c, f"{c}_joined"), 32), c, "left").withColumn(c, F.coalesce(f"{c}_joined", c)).drop(f"{c}_joined")
    wide = written(compared.where("cx <> cy AND NOT (lonex AND loney) AND 10 * shared >= 4 * union"), "wide")
    near = "10 * shared >= 6 * union"
    centre = wide.where("NOT loney").where(near).select(F.col("x").alias("node"), F.col("y").alias("star"))
    centre = centre.unionByName(wide.where("loney").where(near).select(F.col("y").alias("node"), F.col("x").alias("star")))
    both = wide.where("NOT lonex AND NOT loney").select(F.col("x").alias("star"), "y")
    both = texts.compared(written(members.join(short(both, 32), "star").select(F.col("node").alias("x"), "y"), "member-pairs"))
    links = links.unionByName(_linked(both).select("x", "y"))
    known = centre.unionByName(both.where("100 * shared < 80 * union").where(near).select(F.col("x").alias("node"), F.col("y").alias("star"))).distinct()
    links = links.unionByName(texts.opened(written(known, "known"), members.select("node", "star")))
    found = connected(links)

    # Components are named by the smallest id in them.
    told = reps.select("node", "first").join(short(found, 32), "node", "left").withColumn("group", F.coalesce("component", "node"))
    least = told.groupBy("group").agg(F.min("first").alias("smallest"))
    told = written(told.join(least, "group").select("node", "group", F.col("first").alias("class_id"), "smallest"), "components")
    out = full.join(short(told, 48), "node").select("id", "body", "size", "class_id", "smallest", "group")
    real = F.when(F.col("id") != NO_ID, F.col("id"))
    out = out.unionByName(profiles.where("size = 0").select("id", "body", "size", real.alias("class_id"), real.alias("smallest"), F.lit(None).cast("long").alias("group")))
    return out.select(real.alias("doc_id"), F.col("size").cast("long").alias("n_shingles"), F.col("smallest").alias("component_id"), "class_id", "body", F.col("group").alias("group_id"))
