"""Complete-linkage clusters of a bucket and the templates that alignment or pattern mining folds them to."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Params
from ..plans.shipping import ship

WILDCARD = "<*>"
#: Different token sets of one bucket that are clustered exactly; a distance matrix of them is held by one task.
MAX_SETS = 12_000
#: A fixed-threshold bucket with more messages is clustered on a sample of this size, the others follow their leader.
SAMPLE_LIMIT, SAMPLE_SEED = 5_000, 42


@dataclass(frozen=True)
class Mining:
    """How buckets become clusters and clusters become templates."""

    params: Params = Params()
    #: None for the elbow cutoff, else a fixed similarity.
    similarity: float | None = None
    #: "align" folds by longest common subsequences, "pattern" mines each position.
    fold: str = "align"


def distance_matrix(sets: Sequence[frozenset]) -> np.ndarray:
    """Jaccard distances of token sets by a product of their incidence matrix; empty sets are at 1 from everything."""
    number = {t: k for k, t in enumerate(dict.fromkeys(t for s in sets for t in sorted(s)))}
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.float64)
    common = np.zeros((n, n))
    for first in range(0, len(number), 4_096):
        part = np.zeros((n, min(4_096, len(number) - first)), dtype=np.float32)
        for i, s in enumerate(sets):
            for t in s:
                k = number[t] - first
                if 0 <= k < part.shape[1]:
                    part[i, k] = 1
        common += part @ part.T
    union = size[:, None] + size[None, :] - common
    return np.where(union > 0, 1.0 - common / np.where(union > 0, union, 1), 1.0)


def elbow(d: np.ndarray, weight: np.ndarray, total: int, min_similarity: float) -> float:
    """Cutoff from distances with multiplicities; the same rule as for one entry per pair."""
    if total == 0:
        return 0.5
    if total == 1:
        return float(d[0])
    order = np.argsort(d, kind="stable")
    d, weight = d[order], weight[order]
    end = np.cumsum(weight)
    first, last = end - weight, end - 1
    v, h = d[-1] - d[0], total - 1
    drop = (d - d[0]) * h
    a, b = np.abs(first * v - drop), np.abs(last * v - drop)
    best = np.maximum(a, b)
    k = np.where(a >= b, first, last)
    top = np.flatnonzero(best == best.max())
    at = top[np.argmin(k[top])]
    return float(min(d[at], 1.0 - min_similarity))


def complete_linkage(d: np.ndarray, cutoff: float) -> np.ndarray:
    """Labels of complete-linkage clusters joined at heights up to cutoff, by the nearest-neighbour chain.

    Ties: a chain starts at the lowest live item, the lowest nearest neighbour is taken unless the previous chain
    element is as near, and a merged cluster keeps the higher index.
    """
    n = len(d)
    d = d.copy()
    np.fill_diagonal(d, np.inf)
    live = np.ones(n, dtype=bool)
    up = np.arange(n)
    chain: list[int] = []
    merges = []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(live)[0]))
        while True:
            x = chain[-1]
            row = np.where(live, d[x], np.inf)
            y = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[y]:
                y = chain[-2]
            if len(chain) > 1 and y == chain[-2]:
                break
            chain.append(y)
        height = d[x, y]
        del chain[-2:]
        low, high = min(x, y), max(x, y)
        merges.append((height, low, high))
        merged = np.maximum(d[low], d[high])
        d[high, :], d[:, high] = merged, merged
        d[high, high] = np.inf
        live[low] = False

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for height, low, high in merges:
        if height <= cutoff:
            up[root(low)] = root(high)
    return np.array([root(i) for i in range(n)])


def _sets_of(messages: Sequence[Sequence[str]]) -> tuple[list[frozenset], np.ndarray]:
    """Different token sets and the set of each message; empty messages stay apart, being at 1 from each other."""
    seen: dict = {}
    at = np.empty(len(messages), dtype=np.int64)
    sets = []
    for i, m in enumerate(messages):
        s = frozenset(m)
        key = s if s else ("empty", i)
        if key not in seen:
            seen[key] = len(sets)
            sets.append(s)
        at[i] = seen[key]
    return sets, at


def cluster_messages(messages: Sequence[Sequence[str]], min_similarity: float, fixed: float | None = None) -> list[list[int]]:
    """Clusters (lists of message numbers, in order of first members) of one bucket's token lists."""
    n = len(messages)
    if n == 1:
        return [[0]]
    if fixed is not None and n > SAMPLE_LIMIT:
        return _follow_leaders(messages, fixed)
    sets, at = _sets_of(messages)
    if len(sets) > MAX_SETS:
        raise ValueError(f"a bucket of {len(sets)} different messages; train on the most frequent strings instead")
    d = distance_matrix(sets)
    count = np.bincount(at, minlength=len(sets)).astype(np.int64)
    if fixed is None:
        i, j = np.triu_indices(len(sets), 1)
        pair_d, pair_w = d[i, j], count[i] * count[j]
        inner = int((count * (count - 1) // 2).sum())
        pair_d, pair_w = np.append(pair_d, 0.0), np.append(pair_w, inner)
        some = pair_w > 0
        cutoff = elbow(pair_d[some], pair_w[some], n * (n - 1) // 2, min_similarity)
    else:
        cutoff = 1.0 - fixed
    label = complete_linkage(d, cutoff) if len(sets) > 1 else np.zeros(1, dtype=np.int64)
    out: dict[int, list[int]] = {}
    for i, s in enumerate(at):
        out.setdefault(int(label[s]), []).append(i)
    return list(out.values())


def _follow_leaders(messages: Sequence[Sequence[str]], fixed: float) -> list[list[int]]:
    """Cluster a seeded sample; then each message goes to the leader most like it, or leads a cluster of its own."""
    picked = random.Random(SAMPLE_SEED).sample(range(len(messages)), SAMPLE_LIMIT)
    groups = cluster_messages([messages[i] for i in picked], 0.0, fixed)
    leaders = [frozenset(messages[picked[g[0]]]) for g in groups]
    by_token: dict[str, list[int]] = {}
    for k, s in enumerate(leaders):
        for t in s:
            by_token.setdefault(t, []).append(k)
    out: list[list[int]] = [[] for _ in leaders]
    for i, m in enumerate(messages):
        s = frozenset(m)
        common: dict[int, int] = {}
        for t in s:
            for k in by_token.get(t, ()):
                common[k] = common.get(k, 0) + 1
        best, score = 0, 0.0
        for k in sorted(common):
            v = common[k] / (len(s) + len(leaders[k]) - common[k])
            if v > score:
                best, score = k, v
        if leaders and score >= fixed:
            out[best].append(i)
        else:
            for t in s:
                by_token.setdefault(t, []).append(len(leaders))
            leaders.append(s)
            out.append([i])
    return [g for g in out if g]


def spread_sample(n_tokens: Sequence[int], size: int) -> list[int]:
    """Numbers of the messages to fold: all if few, else the shortest, the longest and evenly spaced ones between."""
    n = len(n_tokens)
    if n <= size:
        return list(range(n))
    if size < 3:
        raise ValueError("sample_size must be at least 3 to sample a larger cluster")
    order = sorted(range(n), key=lambda i: n_tokens[i])
    step = (n - 2) / (size - 2)
    ranks = dict.fromkeys([0, n - 1, *(int(1 + i * step) for i in range(1, size - 1))])
    return [order[r] for r in ranks]


def align(template: Sequence[str], message: Sequence[str]) -> list[str]:
    """Merge along a longest common subsequence: what differs becomes one wildcard, common tokens stay."""
    a, b = list(template), list(message)
    if a == b:
        return a
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        row, above = table[i + 1], table[i]
        for j, y in enumerate(b):
            row[j + 1] = above[j] + 1 if x == y else max(above[j + 1], row[j])
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
            continue
        if not out or out[-1] != WILDCARD:
            out.append(WILDCARD)
        if not (i and j):
            break
        if table[i - 1][j] > table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def fold_aligned(messages: Sequence[Sequence[str]], size: int) -> str:
    """A cluster's template: its spread sample merged one after the other."""
    picked = spread_sample([len(m) for m in messages], size)
    merged = list(messages[picked[0]])
    for k in picked[1:]:
        merged = align(merged, messages[k])
    return " ".join(merged)


def mine_clusters(df: DataFrame, mining: Mining) -> DataFrame:
    """Clusters and templates of bucketed items (idx, tokens, bucket): (idx, cluster_id, log_count, template).

    Each bucket is one group of a grouped-map function; cluster ids count buckets by appearance, then clusters by
    their first item. template is null when positions are to be mined (see patterns).
    """
    ship(df.sparkSession)
    p, fixed, fold = mining.params, mining.similarity, mining.fold

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", ignore_index=True)
        messages = [list(t) for t in rows["tokens"]]
        found = cluster_messages(messages, p.min_similarity, fixed)
        parts = []
        for k, members in enumerate(found):
            template = fold_aligned([messages[i] for i in members], p.sample_size) if fold == "align" else None
            parts.append(pd.DataFrame({"idx": rows["idx"].iloc[members].to_numpy(), "bucket_first": rows["idx"].iloc[0], "local": k, "log_count": len(members), "template": template}))
        return pd.concat(parts, ignore_index=True)

    schema = "idx long, bucket_first long, local int, log_count long, template string"
    return df.select("idx", "tokens", "bucket").groupBy("bucket").applyInPandas(one, schema)


def number_clusters(mined: DataFrame) -> DataFrame:
    """cluster_id from (bucket_first, local), counted from 1; one task orders the training items, whose number is bounded."""
    return mined.withColumn("cluster_id", F.dense_rank().over(W.orderBy("bucket_first", "local"))).select("idx", "cluster_id", "log_count", "template")
