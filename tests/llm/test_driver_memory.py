"""What the driver holds while it fits models."""

import tracemalloc

import numpy as np

from spanweave.llm import langid


def test_language_model_makes_no_copy_of_its_features():
    n = 400
    x = langid.blank(n)
    x[:, :-1] = np.random.default_rng(3).random((n, langid.BUCKETS), np.float32) * 1e-3
    tracemalloc.start()
    model = langid.Model(x, [("en", "de", "fr", "es")[i % 4] for i in range(n)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.rest) == len(model.families) > 1 and all(np.isfinite(w).all() for w, _ in model.rest)
    assert peak < 1.2 * x.nbytes, (peak, x.nbytes)
