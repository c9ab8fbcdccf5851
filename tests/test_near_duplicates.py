"""Membership of equal hashes, and vectors of more than 64 components."""

import random

from roadlake.plans import registry


def test_members_and_long_vectors(spark, tmp_path):
    rnd = random.Random(1)
    base = [rnd.choice([-1.0, 1.0]) for _ in range(100)]
    flip = lambda v, at: [-x if n in at else x for n, x in enumerate(v)]
    rows = [(1, base), (2, [3 * x for x in base]), (3, flip(base, range(90, 96))), (4, flip(base, range(70, 90))), (5, [-x for x in base]), (6, [-x for x in base])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    known = registry.queries()
    assert [tuple(r) for r in known["near_duplicate_hashes"](spark, str(tmp_path)).select("a", "b", "bits").collect()] == [(1, 3, 6)]
    got = {r.member: r.representative for r in known["near_duplicate_members"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5}
