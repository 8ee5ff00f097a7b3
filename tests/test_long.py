"""One giant series in chunks against the exact recursion over the whole series."""

import numpy as np
import pytest

from breakline.functions import costs
from breakline.operators import long as L
from breakline.operators.detect import Spec


def changing(family, seed, n=6000):
    rng = np.random.default_rng(seed)
    cuts = np.sort(rng.choice(np.arange(100, n - 100, 40), 22, replace=False))
    which = np.searchsorted(cuts, np.arange(n), "right")
    if family == "lm":
        x = rng.normal(size=n)
        return np.column_stack([rng.choice([-2.0, 0.5, 3.0, 6.0], 23)[which] * x + rng.normal(size=n), x])
    level = rng.normal(0, 3, 23)[which] if family != "variance" else 0.0
    spread = rng.choice([0.5, 1.5, 5.0], 23)[which] if family != "mean" else 1.0
    return (100 * (family != "variance") + level + spread * rng.normal(size=n))[:, None]


@pytest.mark.parametrize("family", L.FAMILIES)
def test_chunks_find_what_the_exact_recursion_finds(spark, family):
    x = changing(family, 7)
    exact = Spec(family=family).solve(x)
    df = spark.createDataFrame([(t, *map(float, r)) for t, r in enumerate(x)], "t long, v double" + (", x double" if family == "lm" else ""))
    found = [r.cp for r in L.detect_long(df, "t", "v", "x" if family == "lm" else None, family, chunk=500).collect()]
    same = len(set(found) & set(exact)) / len(exact)
    print(family, len(exact), len(found), same)
    assert len(exact) >= 12 and same >= 0.9 and len(set(found) - set(exact)) <= 0.1 * len(exact) + 1


def test_long_edges(spark):
    none = spark.createDataFrame([], "t long, v double")
    assert L.detect_long(none, "t", "v").collect() == [] == L.detect_long(spark.createDataFrame([(1, 2.0)], "t long, v double"), "t", "v").collect()
    for bad in ({"family": "rank"}, {"family": "lm"}, {"x": "v"}):
        with pytest.raises(ValueError):
            L.detect_long(none, "t", "v", **bad)


@pytest.mark.parametrize("family", ("variance", "lm"))
def test_chunk_prices_few_segments(monkeypatch, family):
    """A chunk without changes has no start that pruning takes out; yet few are priced for each row."""
    priced, n, rng = [], 5000, np.random.default_rng(0)
    kind = costs.Linear if family == "lm" else costs.Moment
    for name in ("pairs", "under", "__call__"):
        real = getattr(kind, name, None)
        if real:
            monkeypatch.setattr(kind, name, lambda self, s, e, real=real: [out := real(self, s, e), priced.append(np.size(out))][0])
    x = rng.normal(size=(n, 1)) if family == "variance" else np.column_stack([rng.normal(size=n), 1 + rng.random(n)])
    assert Spec(family=family, beta=40.0).solve(x) == [] and sum(priced) < 600 * n
