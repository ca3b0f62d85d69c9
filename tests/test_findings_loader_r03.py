"""What the draws of fixed negatives hash and store."""

import hashlib

from chronoloom.operators import sampling as S


def test_a_stored_pool_is_not_stored_again(spark, monkeypatch):
    rows = [(i, 1000 + i * 7 % 31, 1996 + i % 5) for i in range(3000)]
    pool = spark.createDataFrame(rows, "src long, tgt long, year int")
    order = sorted(rows, key=lambda r: hashlib.md5("|".join(map(str, (7, *r))).encode()).hexdigest())
    stored, real = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df: stored.append(df.count()) or real(df))
    assert sorted(map(tuple, S.fixed_negatives(pool, 300, 7, kept=True).collect())) == sorted(order[:300])
    assert sum(stored) < 500
    for n in (0, 1, 1500, 2999, 4000):  # few, many, and more than there are
        assert sorted(map(tuple, S.fixed_negatives(pool, n, 7, kept=True).collect())) == sorted(order[:n])
