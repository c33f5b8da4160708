"""The pipeline's near-dedup stage goes through SimHash."""

import random

from stepforge.llm import op10_simhash


def test_fingerprints_find_near_copies_that_no_band_shares(spark):
    words = [f"w{i}" for i in range(500)]
    for seed in range(50):
        draw = random.Random(seed)
        one = [draw.choice(words) for _ in range(1000)]
        two = [*one[:500], "other", *one[501:]]
        a, b = ({*op10_simhash.shingles(" ".join(x), 5).tolist()} for x in (one, two))
        prints = [op10_simhash.simhash(op10_simhash.np.array(sorted(x), op10_simhash.np.uint64)) for x in (a, b)]
        if 0 < (prints[0] ^ prints[1]).bit_count() <= op10_simhash.RADIUS:
            break
    else:
        raise AssertionError("no such pair")
    assert len(a & b) >= 0.8 * len(a | b)
    texts = [" ".join(one), " ".join(two), " ".join(reversed(one)), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rule = op10_simhash.Similar(bands=1, rows=4000)  # a pair like this shares that band with probability 4e-18
    assert sorted(r.doc_id for r in op10_simhash.one_of_each(docs, similar=rule).collect()) == [0, 2, 3]
