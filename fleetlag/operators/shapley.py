"""Exact Shapley values of trees, over rows at once.

The value of a set of features is the tree's expectation when only they are known: at a split on an unknown feature both
branches count by the training rows that went there. A leaf takes part through the features on its path alone. For one
of them, every subset of the others is summed by its size: the product of ``z_i + o_i x`` over the others has as its
coefficient of ``x^t`` the sum over subsets of ``t`` features, with ``o`` whether the row keeps to the path at all splits
of a feature and ``z`` the share of training rows that does. A path is no longer than the tree is deep, so a row costs
leaves times depth squared.
"""

from math import factorial

import numpy as np

MISSING = -1e7  # stands for NULL, next to a flag for trees that cannot learn its side


def goes_left(x, cut, null_right):
    """Whether values keep to the left of a split; a missing one takes the side that the split learned."""
    return np.where(x == MISSING, ~np.asarray(null_right), x <= cut)


def leaf_paths(tree: dict, player_of: np.ndarray) -> list[tuple[float, dict]]:
    """Value of each leaf and, per player on its path, the splits ``(feature, cut, null_right, left)`` and the share of rows ``z``."""
    out, waiting = [], [(0, {})]
    while waiting:
        at, path = waiting.pop()
        if tree["leaf"][at]:
            out.append((float(tree["value"][at]), path))
            continue
        feature, player = int(tree["feature"][at]), int(player_of[tree["feature"][at]])
        for side in ("left", "right"):
            child = int(tree[side][at])
            splits, z = path.get(player, ((), 1.0))
            step = (feature, float(tree["cut"][at]), bool(tree["null_right"][at]), side == "left")
            share = tree["rows"][child] / tree["rows"][at] if tree["rows"][at] else 0.0  # no row comes here
            waiting.append((child, {**path, player: ((*splits, step), z * share)}))
    return out


def expectation(tree: dict) -> float:
    """The tree's mean over its training rows: the value of the empty set."""
    paths = leaf_paths(tree, np.arange(int(tree["feature"].max(initial=0)) + 1))
    return sum(value * float(np.prod([z for _, z in path.values()])) for value, path in paths)


def shapley(tree: dict, matrix: np.ndarray, player_of: np.ndarray, players: int) -> np.ndarray:
    """Value of every player for every row; with :func:`expectation` they add up to the tree's output."""
    out = np.zeros((len(matrix), players))
    for value, path in leaf_paths(tree, player_of):
        names, k = list(path), len(path)
        if not k:
            continue
        keeps, shares = np.ones((k, len(matrix))), np.array([path[p][1] for p in names])
        for i, p in enumerate(names):
            for feature, cut, null_right, left in path[p][0]:
                keeps[i] *= goes_left(matrix[:, feature], cut, null_right) == left
        weight = [factorial(t) * factorial(k - 1 - t) / factorial(k) for t in range(k)]
        for i, p in enumerate(names):
            sums = np.zeros((k, len(matrix)))  # by size of the subset of the others
            sums[0] = 1.0
            for j in range(k):
                if j != i:
                    sums[1:] = sums[1:] * shares[j] + sums[:-1] * keeps[j]
                    sums[0] *= shares[j]
            out[:, p] += value * (keeps[i] - shares[i]) * np.tensordot(weight, sums, 1)
    return out
