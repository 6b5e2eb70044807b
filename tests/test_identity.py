"""One code for a type through time, and the assignment behind it."""

import random
from itertools import permutations

from tessera.operators import model


def test_assignment_is_the_best_of_all():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 5)
        m = n + rng.randint(0, 2)
        cost = [[rng.randint(-9, 9) for _ in range(m)] for _ in range(n)]
        got = model.assignment(cost)
        assert len(set(got)) == n
        assert sum(cost[i][j] for i, j in enumerate(got)) == min(sum(cost[i][j] for i, j in enumerate(p)) for p in permutations(range(m), n))
    assert model.assignment([]) == []


def test_match_takes_the_first_of_equal_maps(spark):
    tie = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "a int, b int")
    assert sorted(map(tuple, model.match_labels(tie, "a", "b", 2).collect())) == [(0, 0), (1, 1)]
    turned = spark.createDataFrame([(2, 0), (2, 0), (0, 1), (1, 2), (1, 1)], "a int, b int")
    assert sorted(map(tuple, model.match_labels(turned, "a", "b", 3).collect())) == [(0, 2), (1, 0), (2, 1)]


def test_codes_follow_their_members(spark):
    rows = []
    for t, turn in enumerate(({0: 0, 1: 1, 2: 2}, {0: 2, 1: 0, 2: 1}, {0: 1, 1: 2, 2: 0})):
        rows += [(i, t, turn[i // 10]) for i in range(30)]
    # in the last period the first type falls into five small ones, each of which overlaps it by 0.2
    rows += [(i, 3, i // 10 if i >= 10 else 5 + i % 5) for i in range(30)]
    got = {(r.id, r.t): r.c for r in model.canonical(spark.createDataFrame(rows, "id int, t int, c int"), "id", "t", "c").collect()}
    assert all(got[i, t] == i // 10 for i in range(30) for t in range(3)) and all(got[i, 3] == i // 10 for i in range(10, 30))
    assert sorted({got[i, 3] for i in range(10)}) == [3, 4, 5, 6, 7]
    assert model.canonical(spark.createDataFrame([], "id int, t int, c int"), "id", "t", "c").count() == 0
