"""Round 4: what the driver holds of a model while it is made and sent."""

import tracemalloc

import numpy as np
import pytest

pytest.importorskip("fathom.llm.toxicity")
from fathom.llm import toxicity  # noqa: E402


def index(vectors, size):
    return toxicity.Index.build(vectors, [0] * len(vectors), list(range(len(vectors))), size)


def test_a_packed_model_is_never_whole_in_memory():
    """The pickled model goes into the compressor piece by piece; what is unpacked is the same."""
    model = toxicity.Model(["a", "b"], index([(np.array([0, 1]), np.array([0.6, 0.8]))], 2), np.ones(2), 0.5, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    for name in ("dense", "tops", "docs", "weights"):
        setattr(model.index, name, np.zeros(1 << 20))
    tracemalloc.start()
    data = toxicity.packed(model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * model.index.dense.nbytes
    got = toxicity.unpacked(data)
    assert got.words == model.words and all(np.array_equal(getattr(got.index, n), getattr(model.index, n)) for n in ("at", "column", "dense", "weights"))


def test_a_model_keeps_no_examples_of_its_own(spark):
    """The examples' words serve the calibration only; they aren't sent with the model."""
    rows = [(i, f"word{i % 7} word{i % 11} {'bad' if i % 3 == 0 else 'good'}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    assert len(model.index.labels) and len(model.steps[0]) > 2 and sum(x.size for x in model.index.own[1:]) == 0
