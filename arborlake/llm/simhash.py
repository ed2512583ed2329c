"""SimHash near-duplicate groups by covering locality-sensitive hashing.

Every bit position gets a nonzero vector of radius + 1 bits; each nonzero vector
v gives a mask of the positions whose vector has odd parity with v.  Differing
positions of a pair within the radius span less than the whole space, so some v
is orthogonal to all of them: in that table both have the same masked bits.
The guarantee is structural, nothing is left to chance.

Inside a bucket no pairs are formed.  Every fingerprint is written under each
value within radius / 2 flips of it (only of bits that the mask leaves out); two
that meet at a value are within the radius, and two within the radius meet at a
midpoint.  At most one fingerprint per flip set can meet at a value, so those
groups are small by construction, and a bucket costs rows in proportion to its
members.

``similar_groups`` links texts by the Jaccard similarity of their shingle sets instead.
Texts whose whole fingerprints are within the radius meet under the covering masks, as
above.  Two texts at 0.8 differ in some ten of 64 bits, too many for masks over one
fingerprint, so further masks cut the shingle set: one of P masks keeps the shingles
whose hash falls into its class, and texts meet where the shingles kept have one
fingerprint.  Fewer than P differing shingles leave some class untouched, so with P over
a quarter of the shingles every pair in reach agrees in a class.  Texts meet in all
classes up to CLASSES, long ones in the first CLASSES of P.  What meets is compared
exactly, by counting shared shingles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, prepare, utf8, written

BITS = 64
#: Classes of shingles in which a text is put into a bucket, the mean number of shingles in one, and the least number of classes.
CLASSES, PER_CLASS, LEAST_CLASSES = 16, 3, 8
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_digests(text: bytes, words_per_shingle: int) -> list[bytes]:
    """XXH64 (seed 42) of every word shingle, big-endian, repeats included."""
    words = text.lower().split()  # on bytes, both touch ASCII only
    if not words:
        return []
    digest = xxhash.xxh64_digest
    if len(words) <= words_per_shingle:
        return [digest(b" ".join(words), 42)]
    runs = [words[i:] for i in range(words_per_shingle)]
    return [digest(s, 42) for s in map(b" ".join, zip(*runs))]


def fingerprint(text: bytes, words_per_shingle: int = 3) -> bytes:
    """Eight bytes, most significant bit first: a bit is set if set in over half the shingle hashes."""
    digests = shingle_digests(text, words_per_shingle)
    if not digests:
        return bytes(8)
    a = np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 8)
    spread = a.astype(np.int64) + np.arange(0, 2048, 256)
    counts = np.bincount(spread.reshape(-1), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return np.packbits((2 * counts > len(digests)).reshape(-1)).tobytes()


def fingerprints(documents: DataFrame, *, key: str, text: str, words_per_shingle: int = 3) -> DataFrame:
    """(key, fp) with the fingerprint as a signed 64-bit number; null texts give 0."""

    def per_batch(batch):
        prints = b"".join(fingerprint(t, words_per_shingle) for t in utf8(batch.column("text")))
        return {"key": batch.column("key"), "fp": np.frombuffer(prints, dtype=">i8").astype(np.int64)}

    slim = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    return map_arrow(slim, per_batch, f"key {kind}, fp long")


def masks(radius: int) -> list[int]:
    """The covering masks: 2 ** (radius + 1) - 1 sets of bit positions."""
    span = (1 << (radius + 1)) - 1
    vectors = [i % span + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vectors[i] & v).bit_count() % 2) for v in range(1, span + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(_signed(v)).cast("long") for v in values])


def links(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b) with a < b: true links that connect all distinct fp within the radius.

    prints: distinct values in column fp.  radius must be even.
    """
    if radius % 2:
        raise ValueError("radius must be even: pairs meet at midpoints")
    covers = masks(radius)
    flips = []
    for m in covers:
        free = [1 << i for i in range(BITS) if not m >> i & 1]
        flips.append([sum(c) for n in range(radius // 2 + 1) for c in combinations(free, n)])
    entries = prints.select("fp", F.posexplode(_longs(covers)).alias("t", "mask")).select(
        "t", F.col("fp").bitwiseAND(F.col("mask")).alias("bucket"), "fp"
    )
    shared = entries.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = entries.join(shared, ["t", "bucket"]).select("t", "fp")
    moved = members.select(
        "t",
        "fp",
        F.explode(F.element_at(F.array(*[_longs(f) for f in flips]), F.col("t") + 1)).alias("flip"),
    ).select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    met = (
        moved.groupBy("t", "value")
        .agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all"))
        .where(F.size("all") > 1)
    )
    return met.select("a", F.explode("all").alias("b")).where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, c): for each end of an edge (a, b) the smallest value reachable.

    Each round takes the least label among neighbours and then jumps to the label's
    own label, so long chains need a logarithmic number of rounds.  Rounds are
    checkpointed; only one flag per round comes to the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    label = both.groupBy("a").agg(F.min("b").alias("c")).select(F.col("a").alias("v"), F.least("a", "c").alias("c"))
    label = label.checkpoint()
    while True:
        seen = (
            both.join(label.withColumnRenamed("v", "b"), "b")
            .groupBy("a")
            .agg(F.min("c").alias("m"))
            .withColumnRenamed("a", "v")
        )
        lower = label.join(seen, "v").select("v", F.least("c", "m").alias("c"), F.col("c").alias("old"))
        jump = label.select(F.col("v").alias("c"), F.col("c").alias("next"))
        after = lower.join(jump, "c").select("v", F.least("c", "next").alias("c"), "old").checkpoint()
        label = after.select("v", "c")
        if after.where("c <> old").isEmpty():
            return label


def near_duplicates(
    documents: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    words_per_shingle: int = 3,
    radius: int = 2,
) -> DataFrame:
    """(key, fingerprint, component_id) for every row, repeated rows included.

    fingerprint: 16 lowercase hexadecimal digits.  component_id: the smallest key
    among all rows whose fingerprints are reachable over links of at most ``radius``
    differing bits, the row's own included.  Null and empty texts have fingerprint
    zero, which links like any other.  A null key gets its group's smallest key, and
    null if the group has none.  Only key and text are read.
    """
    prepare(documents.sparkSession)
    prints = written(fingerprints(documents, key=key, text=text, words_per_shingle=words_per_shingle), "simhash")
    first = prints.groupBy("fp").agg(F.min("key").alias("first")).checkpoint()
    label = components(links(first.select("fp"), radius))
    linked = label.join(first, label["v"] == first["fp"]).select("fp", "c", "first")
    least = linked.groupBy("c").agg(F.min("first").alias("group_first"))
    moved = linked.join(least, "c").select("fp", "group_first")
    by_print = first.join(moved, "fp", "left").select(
        "fp", F.coalesce("group_first", "first").alias("component_id")
    )
    # written first, so that the last join is a plain one whose hot fingerprints Spark can split
    by_print = by_print.checkpoint()
    return prints.join(by_print, "fp").select(
        F.col("key").alias(key),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


# links by similarity of whole shingle sets


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, words_per_shingle: int = 5) -> np.ndarray:
    """The distinct hashes of all word shingles, sorted; a shorter text is one shingle, one without words none.

    A shingle's hash mixes its words' XXH64 in order, which spares one digest per shingle.
    """
    words = text.lower().split()  # on bytes, both touch ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= words_per_shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
    n = len(hashes) - words_per_shingle + 1
    run = np.zeros(n, np.uint64)
    for i in range(words_per_shingle):
        run = _mixed(run) + hashes[i : i + n]
    return np.unique(_mixed(run))


def _ladder(least: tuple[int, int]) -> np.ndarray:
    """Lower bounds of size classes: sizes of similar sets are in one class or in neighbouring ones."""
    up, down = least
    return (down / up) ** np.arange(int(40 / np.log2(down / up)))


def class_buckets(sets: list[np.ndarray], ladder: np.ndarray) -> list[np.ndarray]:
    """Buckets of each set: per class of its size and of the next larger one, the fingerprint of the shingles kept."""
    owner, tables, kept = [], [], []
    for i, found in enumerate(sets):
        if not len(found):
            continue
        size_class = int(np.searchsorted(ladder, len(found), side="right")) - 1
        spread = _mixed(found) >> np.uint64(32)
        for c in (size_class, size_class + 1):
            parts = max(LEAST_CLASSES, int(np.ceil(ladder[c + 1] / PER_CLASS)))
            at = (spread * np.uint64(parts)) >> np.uint64(32)
            low = at < CLASSES
            kept.append(found[low])
            tables.append(at[low].astype(np.int64) + c * CLASSES)
            owner.append(np.full(int(low.sum()), i, np.int64))
    if not kept:
        return [np.zeros(0, np.int64) for _ in sets]
    hashes, table, who = np.concatenate(kept), np.concatenate(tables), np.concatenate(owner)
    order = np.lexsort((table, who))
    hashes, table, who = hashes[order], table[order], who[order]
    first = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]) | (who[1:] != who[:-1])])
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    size = np.diff(np.r_[first, len(hashes)])
    prints = np.packbits(2 * np.add.reduceat(bits, first, axis=0, dtype=np.int64) > size[:, None], axis=1)
    keys = _mixed(_mixed(table[first].astype(np.uint64)) + prints.reshape(-1).view(">u8").astype(np.uint64)).view(np.int64)
    return np.split(keys, np.searchsorted(who[first], np.arange(1, len(sets))))


def set_prints(sets: list[np.ndarray]) -> np.ndarray:
    """The SimHash fingerprint of each whole shingle set: a bit is set if set in over half its hashes."""
    votes = [np.unpackbits(s.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for s in sets]
    half = np.array([len(s) for s in sets], np.int64)[:, None]
    if not votes:
        return np.zeros(0, np.uint64)
    return np.packbits(2 * np.array(votes) > half, axis=1).reshape(-1).view(">u8").astype(np.uint64)


def print_buckets(prints: np.ndarray, covers: np.ndarray) -> np.ndarray:
    """A row of buckets per fingerprint, one for each covering mask: prints within the radius share one."""
    tables = _mixed(np.arange(1, len(covers) + 1, dtype=np.uint64) << np.uint64(40))
    return _mixed(tables + _mixed(prints[:, None] & covers)).view(np.int64)


def _entries(documents: DataFrame, words_per_shingle: int, least: tuple[int, int], radius: int) -> DataFrame:
    """(id, size, buckets) of the documents (id, text) that have words."""
    ladder, covers = _ladder(least), np.array(masks(radius), np.uint64)

    def per_batch(batch):
        sets = [shingle_set(t, words_per_shingle) for t in utf8(batch.column("text"))]
        by_class = [b for i in range(0, len(sets), 512) for b in class_buckets(sets[i : i + 512], ladder)]
        buckets = [np.concatenate(both) for both in zip(print_buckets(set_prints(sets), covers), by_class)]
        return {"id": batch.column("id"), "size": [len(s) for s in sets], "buckets": buckets}

    kind = documents.schema["id"].dataType.simpleString()
    return map_arrow(documents.select("id", "text"), per_batch, f"id {kind}, size int, buckets array<long>").where("size > 0")


def spanning_links(sets: list[np.ndarray], least: tuple[int, int]) -> list[tuple[int, int]]:
    """Pairs of positions whose sets are similar, enough of them to connect all that similar pairs connect.

    One member is compared with all others by counting, over an inverted index, the
    shingles that they share.  The most central member goes first; whoever it is then
    connected with needs no comparison of its own, everyone else is compared in turn.
    """
    up, down = least
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(n), sizes)
    _, code, spread = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(code, kind="stable")
    holders, start = owner[order], np.cumsum(spread) - spread
    central = np.bincount(owner, weights=spread[code], minlength=n) / sizes
    root = np.arange(n)
    found = []
    first = int(central.argmax())
    for x in [first, *range(n)]:
        if x != first and root[x] == root[first]:
            continue
        own = code[ends[x] - sizes[x] : ends[x]]
        own = own[spread[own] > 1]
        shared = np.zeros(n, np.int64)
        for i in range(0, len(own), 1024):
            part = own[i : i + 1024]
            runs = spread[part]
            at = np.repeat(start[part] - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
            shared += np.bincount(holders[at], minlength=n)
        near = shared * down >= up * (sizes[x] + sizes - shared)
        for y in np.flatnonzero(near & (root != root[x])):
            if root[y] != root[x]:
                found.append((x, int(y)))
                root[root == root[y]] = root[x]
    return found


def similar_links(documents: DataFrame, words_per_shingle: int, least: tuple[int, int], cell_shingles: int, radius: int = 2) -> DataFrame:
    """(a, b): true links that connect the ids of all similar texts that meet in a bucket.

    A bucket's leader is the member that shares most buckets, and a leader's buckets form
    one team, so that texts travel once a team and not once a bucket.  A team is dealt
    into blocks of about ``cell_shingles`` shingles, and every two blocks meet in a task
    of their own, which emits less links than it has members.
    """
    found = written(_entries(documents, words_per_shingle, least, radius), "near-entries")
    entries = found.select("id", "size", F.explode("buckets").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(entries.join(shared, "bucket"), "near-members")
    fame = members.groupBy("id").agg(F.sum("n").alias("fame"))
    leaders = members.join(fame, "id").groupBy("bucket").agg(F.max(F.struct("fame", "id"))["id"].alias("leader"))
    teams = written(members.join(leaders, "bucket").select("leader", "id", "size").distinct(), "near-teams")
    blocks = F.ceil(F.sum("size") / cell_shingles).cast("int")
    weights = teams.groupBy("leader").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = teams.join(weights, "leader").select("leader", "id", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = placed.select("leader", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id")
    kind = documents.schema["id"].dataType.simpleString()

    def meet(cell: pa.Table) -> pa.Table:
        sets = [shingle_set(t, words_per_shingle) for t in utf8(cell.column("text"))]
        some = [i for i, s in enumerate(sets) if len(s)]
        links = spanning_links([sets[i] for i in some], least) if len(some) > 1 else []
        ids, ends = cell.column("id"), np.array(some, np.int64)[np.array(links, np.int64).reshape(-1, 2)]
        return pa.table({"a": ids.take(pa.array(ends[:, 0])), "b": ids.take(pa.array(ends[:, 1]))})

    return cells.join(documents, "id").groupBy("leader", "i", "j").applyInArrow(meet, f"a {kind}, b {kind}")


def similar_groups(
    documents: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    words_per_shingle: int = 5,
    least: tuple[int, int] = (4, 5),
    cell_shingles: int = 1 << 19,
    radius: int = 2,
) -> DataFrame:
    """(key, component_id) of the keys in a group of several: the smallest key reachable over similar texts.

    Candidates are texts whose SimHash fingerprints are within ``radius`` bits, by covering
    masks and without loss, and those that agree in the fingerprint of a class of their
    shingles.  They are similar if shared / all distinct shingles >= least[0] / least[1],
    confirmed on the whole sets, so every link is true.  A pair at exactly 0.8 is missed with a
    probability of about 2 in 100,000, closer and shorter ones less often.  Texts without
    words are in no group; null keys are left out; rows that repeat a key with other texts
    are compared as they come, and the key is in the groups of all of them.
    """
    prepare(documents.sparkSession)
    docs = documents.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL")
    label = components(similar_links(docs, words_per_shingle, least, cell_shingles, radius))
    return label.select(F.col("v").alias(key), F.col("c").alias("component_id"))
