"""Shapley values of trees against the sum over all subsets."""

from itertools import combinations
from math import factorial

import numpy as np

from fleetlag.operators.shapley import expectation, shapley


def random_tree(rng, depth, features):
    """Arrays of a tree in which features come back on a path and covers are uneven."""
    nodes = []

    def grow(level, rows):
        at = len(nodes)
        nodes.append({"rows": rows, "value": float(rng.normal()), "leaf": True, "feature": 0, "cut": 0.0, "left": at, "right": at, "null_right": False})
        if level < depth and rows >= 2 and rng.random() < 0.85:
            left = int(rng.integers(1, rows))
            nodes[at].update(leaf=False, feature=int(rng.integers(features)), cut=float(rng.normal()))
            nodes[at]["left"] = grow(level + 1, left)
            nodes[at]["right"] = grow(level + 1, rows - left)
        return at

    grow(0, 200)
    return {k: np.array([n[k] for n in nodes]) for k in nodes[0]}


def value_of(tree, row, known, player_of, at=0):
    if tree["leaf"][at]:
        return tree["value"][at]
    left, right = tree["left"][at], tree["right"][at]
    if player_of[tree["feature"][at]] in known:
        return value_of(tree, row, known, player_of, left if row[tree["feature"][at]] <= tree["cut"][at] else right)
    share = tree["rows"][left] / tree["rows"][at]
    return share * value_of(tree, row, known, player_of, left) + (1 - share) * value_of(tree, row, known, player_of, right)


def by_subsets(tree, row, player_of, players):
    out = np.zeros(players)
    for p in range(players):
        others = [q for q in range(players) if q != p]
        for size in range(players):
            weight = factorial(size) * factorial(players - 1 - size) / factorial(players)
            for held in combinations(others, size):
                out[p] += weight * (value_of(tree, row, {*held, p}, player_of) - value_of(tree, row, set(held), player_of))
    return out


def test_shapley_equals_the_sum_over_all_subsets():
    rng = np.random.default_rng(9)
    player_of = np.array([0, 1, 2, 3, 0, 1])  # two features belong to one player
    for depth in (0, 1, 3, 6):
        for _ in range(4):
            tree = random_tree(rng, depth, 6)
            rows = rng.normal(size=(5, 6))
            found = shapley(tree, rows, player_of, 4)
            want = np.array([by_subsets(tree, row, player_of, 4) for row in rows])
            assert np.allclose(found, want, atol=1e-12)
            whole = [value_of(tree, row, {0, 1, 2, 3}, player_of) for row in rows]
            assert np.allclose(expectation(tree) + found.sum(axis=1), whole, atol=1e-12)
            assert np.isclose(expectation(tree), value_of(tree, rows[0], set(), player_of))
