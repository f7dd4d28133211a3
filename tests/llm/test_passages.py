import numpy as np

from newsloom.llm import toxicity


def test_a_passage_quoted_twice_is_reported_twice():
    words = ["vile", "nasty"]
    keys = {toxicity.keys_of(w)[-1]: 3.0 for w in words}
    at = np.array(sorted(keys), np.int64)
    model = toxicity.Model(at, np.full(len(at), 3.0, np.float32), 1.0)
    scorer = toxicity.Scorer(model, 1.0, 0.0)
    calm = [f"calm{k}" for k in range(40)]
    n, found, z, _ = scorer.judge(" ".join(words + calm + words))
    assert n == 44 and [(a, b) for a, b, _ in found] == [(0, 2), (42, 44)]
    assert found[0][2] == found[1][2]
    once = toxicity.passages(model.of(words + calm + words))
    assert z == toxicity.evidence([s for _, _, s in once], 44, 1.0)
