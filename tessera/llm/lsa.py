"""Truncated singular value decompositions by random projection, and TF-IDF over hashed n-grams of bytes."""

from __future__ import annotations

import numpy as np

from tessera.llm.blocks import byte_grams


def gram_counts(data: np.ndarray, bounds: np.ndarray, n: int, slots: int) -> np.ndarray:
    """How often each slot's n-grams of bytes stand in each row, as rows x slots."""
    rows = len(bounds) - 1
    if len(data) < n:
        return np.zeros((rows, slots), np.float32)
    slot = (byte_grams(data, n) >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)
    row = np.repeat(np.arange(rows), np.diff(bounds))[: len(slot)]
    within = np.arange(len(slot)) + n <= bounds[row + 1]
    return np.bincount(row[within] * slots + slot[within], minlength=rows * slots).reshape(rows, slots).astype(np.float32)


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(1 + log tf) x idf, each row of length 1 (rows without terms stay 0)."""
    out = np.zeros_like(counts)
    np.log(counts, out=out, where=counts > 0)
    out[counts > 0] += 1
    out *= idf
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    out /= np.maximum(norm, 1e-12)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def range_finder(columns: int, rank: int, seed: int = 7) -> np.ndarray:
    """Random test matrix of a randomised SVD: columns x rank."""
    return np.random.default_rng(seed).normal(size=(columns, rank)).astype(np.float32)


def svd_basis(x: np.ndarray, rank: int, rounds: int = 3) -> np.ndarray:
    """The first right singular vectors of x, as columns (features x rank), by randomised subspace iteration."""
    rank = min(rank, *x.shape)
    q = x.T @ (x @ range_finder(x.shape[1], rank + 8))
    for _ in range(rounds):
        q = x.T @ (x @ np.linalg.qr(q)[0])
    q = np.linalg.qr(q)[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T[:, :rank]).astype(np.float32)
