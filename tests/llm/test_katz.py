import numpy as np
import pytest

from pointloom.llm import katz as Z
from pointloom.llm import tokens

U64 = np.uint64


@pytest.mark.parametrize("wide", [[3, 50, 9], [40, 2, 63], [63, 63, 63], [0, 0, 0]])
@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_ranked_is_the_stable_order(wide, n):
    rng = np.random.default_rng(n)
    values = [rng.integers(0, 1 << w, 40) if w < 63 else rng.integers(0, 2**63 - 1, 40) for w in wide]
    keys = [v[rng.integers(0, 40, n)] for v in values]
    by, new = Z._ranked(*keys)
    assert (by == np.lexsort(keys[::-1])).all()
    rows = list(zip(*[x[by].tolist() for x in keys], strict=True))
    assert new.tolist() == [k == 0 or rows[k] != rows[k - 1] for k in range(n)]
    ordered, by = Z._sorted(keys[0])
    assert (by == np.argsort(keys[0], kind="stable")).all() and (ordered == keys[0][by]).all()


@pytest.mark.parametrize("kind", ["different", "upper bits", "first name", "last name"])
def test_distinct_tells_names_that_clash(kind):
    rng = np.random.default_rng(5)
    first, other = rng.integers(0, 2**64, 50, dtype=U64), rng.integers(0, 2**64, 50, dtype=U64)
    if kind == "upper bits":
        first[:20] = first[0] ^ np.arange(20, dtype=U64)
    elif kind == "first name":
        first[:2] = first[0]
    elif kind == "last name":
        first[:5] = U64(2**64 - 1)
    pick = rng.integers(0, 50, 3000)
    for got, want in zip(Z._distinct(first[pick], other[pick]), tokens.distinct(first[pick], other[pick]), strict=True):
        assert (got == want).all()
