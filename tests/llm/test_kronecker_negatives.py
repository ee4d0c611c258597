"""Hard negatives against plain inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamops.llm import kronecker_negatives as kn
from streamops.llm.common import prepare


@pytest.mark.parametrize("bound, dim", [(0, 3), (1, 1), (300, 64), (30_000, 16), (1 << 27, 8)])
def test_fields_hold_exact_products(bound, dim):
    rnd = np.random.default_rng(bound + dim)
    rows = rnd.integers(-bound, bound, (50, dim), endpoint=True)
    rows[0], rows[1] = bound, -bound
    fields = kn.Fields(bound, dim)
    packed, sums = fields.pack(rows), rows.sum(axis=1)
    for anchor in rows:
        exact = [sum(int(a) * int(b) for a, b in zip(anchor, row)) for row in rows]
        assert fields.scores(anchor, packed, sums).tolist() == exact


def test_scores_beyond_a_long_are_refused():
    with pytest.raises(ValueError):
        kn.Fields(1 << 31, 64)


def plain(rows):
    usable = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows
              if i is not None and l is not None and v is not None
              and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    seen = set()
    for i, l, v in usable:
        if i % 100 or (i, l, tuple(v)) in seen:
            continue
        seen.add((i, l, tuple(v)))
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in usable
                        if j != i and len(w) == len(v))
        for score, j, _ in [s for s in scored if s[2] == l][:5]:
            near = [s for s in scored if s[2] != l and 80 * -score <= 100 * -s[0] <= 100 * -score][:5]
            out += [(i, j, k + 1, s[1], -score, -s[0]) for k, s in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("cell_bytes", [kn.CELL_BYTES, 8 * 4 * 7])
def test_mining_equals_a_plain_search(spark, cell_bytes):
    prepare(spark)
    rnd = random.Random(3)
    rows = [(k, rnd.randrange(3), [rnd.gauss(0.3, 0.2) for _ in range(4)]) for k in range(401)]
    rows += [(500, 1, [0.5] * 4), (500, 1, [0.5] * 4), (500, 2, [0.4] * 4), (600, None, [0.5] * 4),
             (700, 1, None), (800, 1, [0.5, None, 0.5, 0.5]), (900, 1, [float("nan")] * 4),
             (1000, 1, [float("inf")] * 4), (None, 1, [0.5] * 4), (1100, 0, [0.5, 0.5]), (1101, 0, [0.5, 0.6]),
             (1102, 1, [0.5, 0.5]), (1200, 1, []), (1201, 1, []), (1300, 1, [0.0] * 4), (-100, 2, [-0.5] * 4)]
    rows += [(2001, 1, [0.5] * 4)] * 90 + [(2000 + k, 2, [0.5] * 4) for k in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>") \
        .withColumns({c: F.lit("x") for c in ("score", "row", "dim", "v", "rank", "chunk")})
    found = kn.mine(frame, F.col("vec_id") % 100 == 0, cell_bytes=cell_bytes)
    single = [(i, l, None if v is None else [None if x is None else float(np.float32(x)) for x in v])
              for i, l, v in rows]
    got = sorted(tuple(r) for r in found.collect())
    assert got == plain(single) and len(got) > 50


def test_without_rows_or_anchors(spark):
    prepare(spark)
    frame = spark.createDataFrame([(1, 1, [0.5]), (2, 2, [0.5])], "vec_id long, label int, embedding array<double>")
    anchor = F.col("vec_id") % 100 == 0
    assert kn.mine(frame, anchor).count() == 0
    assert kn.mine(frame.limit(0), anchor).count() == 0
