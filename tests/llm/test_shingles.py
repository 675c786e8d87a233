"""Shingle sets of large batches."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from driftlock.llm import shingles


def test_a_large_batch_holds_little_beside_its_sets():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = pa.array([None if i % 97 == 0 else " ".join(rng.choices(words, k=rng.randint(0, 500))) for i in range(10000)])
    tracemalloc.start()
    made = shingles.shingle_sets(texts)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 4 * kept
    # Slices of a batch give the sets that each text gives alone.
    for i in [0, 1, 97, shingles.TEXTS - 1, shingles.TEXTS, 9999]:
        assert np.array_equal(made[i], shingles.shingle_sets(texts.slice(i, 1))[0])
    assert len(made) == len(texts) and shingles.shingle_sets(texts.slice(0, 0)) == []
