"""The near-copy groups start from whole fingerprints within the radius, beside the classes of shingles."""

import numpy as np

from arborlake.llm import simhash


def test_fingerprints_within_the_radius_share_a_bucket():
    covers = np.array(simhash.masks(2), np.uint64)
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    own = simhash.print_buckets(prints, covers)
    for i in range(64):
        for j in range(i, 64):
            flipped = prints ^ np.uint64(1 << i | 1 << j)
            assert (own == simhash.print_buckets(flipped, covers)).any(axis=1).all()


def test_entries_hold_the_covers_of_the_whole_fingerprint(spark):
    texts = ["one two three four five six seven eight", "a b", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: set(r["buckets"]) for r in simhash._entries(docs, 5, (4, 5), 2).collect()}
    assert set(got) == {0, 1}
    sets = [simhash.shingle_set(t.encode(), 5) for t in texts[:2]]
    want = simhash.print_buckets(simhash.set_prints(sets), np.array(simhash.masks(2), np.uint64))
    bits = np.unpackbits(sets[0].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    majority = np.packbits(2 * bits.sum(axis=0, dtype=int) > len(sets[0])).view(">u8")[0]
    assert simhash.set_prints(sets)[0] == majority
    assert all(set(w.tolist()) < got[i] for i, w in enumerate(want))
