"""Area under the curve, by ranks."""

import numpy as np


def auc(score, label):
    order = np.argsort(score, kind="stable")
    values, at = np.unique(score, return_inverse=True)
    mean = np.array([0.0] * len(values))
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    np.add.at(mean, at, rank)
    rank = (mean / np.bincount(at))[at]
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
