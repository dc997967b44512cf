"""Word vectors that many tasks add up are those of one task."""

import numpy as np

from helixframe.llm import quality


def test_vectors_of_many_tasks(spark):
    rng = np.random.default_rng(2)
    texts = [(" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 9))),) for _ in range(400)]
    docs = spark.createDataFrame([*texts, (None,), ("",)], "text string")
    one = quality.word_vectors(docs.coalesce(1))
    assert one.any() and np.array_equal(one, quality.word_vectors(docs.repartition(150)))
