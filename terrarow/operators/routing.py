"""Tours over inspection targets, one tour per group in a numpy kernel; iterations are capped, not time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tour(d: np.ndarray, rounds: int = 50) -> list[int]:
    """A closed tour from node 0: nearest neighbour (smaller index first), then 2-opt by the best move of each node."""
    n = len(d)
    order, gone = np.zeros(n, int), np.zeros(n)
    gone[0] = math.inf
    for i in range(1, n):
        order[i] = int((d[order[i - 1]] + gone).argmin())
        gone[order[i]] = math.inf
    for _ in range(rounds):
        better = False
        for i in range(1, n - 1):
            a, b = order[i - 1], order[i]
            ends = order[i + 1 :]
            after = np.append(order[i + 2 :], order[0])
            gain = d[a, b] + d[ends, after] - d[a, ends] - d[b, after]
            k = int(gain.argmax())
            if gain[k] > 0.1:
                order[i : i + k + 2] = order[i : i + k + 2][::-1].copy()
                better = True
        if not better:
            break
    return order.tolist()


def tours(targets: DataFrame, group: str, x: str, y: str, order: str) -> DataFrame:
    """group, stop, target id, walked length so far: a closed walk over each group's targets from the smallest id."""
    kind = dict(targets.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        p = pdf[[x, y]].to_numpy(float)
        d = np.hypot(p[:, None, 0] - p[None, :, 0], p[:, None, 1] - p[None, :, 1])
        t = tour(d)
        steps = [0.0, *(d[a, b] for a, b in zip(t, t[1:]))]
        return pd.DataFrame({group: pdf[group].iloc[0], "stop": np.arange(len(t)), order: pdf[order].to_numpy()[t], "walked": np.round(np.cumsum(steps), 2), "closed": np.round(sum(steps) + d[t[-1], t[0]], 2)})

    return targets.select(group, order, x, y).groupBy(group).applyInPandas(run, f"{group} {kind[group]}, stop bigint, {order} {kind[order]}, walked double, closed double")


def _cross(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def enters(ring: np.ndarray, a: np.ndarray, b: np.ndarray, eps: float = 1e-6) -> bool:
    """Whether the way from a to b runs through the inside of a convex ring for more than eps."""
    d = b - a
    t0, t1 = 0.0, 1.0
    if sum(_cross(p, q, r) for p, q, r in zip(ring, np.roll(ring, -1, 0), np.roll(ring, -2, 0))) < 0:
        ring = ring[::-1]
    for p, q in zip(ring, np.roll(ring, -1, 0)):
        n = np.array([-(q - p)[1], (q - p)[0]])
        size = math.hypot(*n)
        if not size:
            continue
        n = n / size
        f, g = float((a - p) @ n), float(d @ n)
        if abs(g) < 1e-15:
            if f <= 1e-9:
                return False
        elif g > 0:
            t0 = max(t0, -f / g)
        else:
            t1 = min(t1, -f / g)
    return (t1 - t0) * math.hypot(*d) > eps


def seen(a: np.ndarray, others: np.ndarray, obstacles: list[np.ndarray], eps: float = 1e-6) -> np.ndarray:
    """For each of others whether the way from a to it enters no obstacle: enters, for all ways from one point at once."""
    d = others - a
    size, free = np.hypot(*d.T), np.ones(len(others), bool)
    for ring in obstacles:
        if sum(_cross(p, q, r) for p, q, r in zip(ring, np.roll(ring, -1, 0), np.roll(ring, -2, 0))) < 0:
            ring = ring[::-1]
        t0, t1, out = np.zeros(len(others)), np.ones(len(others)), np.zeros(len(others), bool)
        for p, q in zip(ring, np.roll(ring, -1, 0)):
            n = np.array([-(q - p)[1], (q - p)[0]])
            length = math.hypot(*n)
            if not length:
                continue
            n = n / length
            f, g = float((a - p) @ n), d @ n
            flat = np.abs(g) < 1e-15
            at = -f / np.where(flat, 1.0, g)
            t0 = np.where(~flat & (g > 0), np.maximum(t0, at), t0)
            t1 = np.where(~flat & (g < 0), np.minimum(t1, at), t1)
            out |= flat & (f <= 1e-9)
        free &= out | ~((t1 - t0) * size > eps)
    return free


def visible_paths(points: np.ndarray, obstacles: list[np.ndarray]):
    """Shortest ways between points around convex obstacles: lengths, way(s, t) as a path of nodes, and the nodes (points, then corners).

    Ways bend at corners only, so a way is straight, or leads from a point to a corner, between corners, and on to the other point.
    """
    nodes = np.concatenate([points, *obstacles]) if obstacles else points
    m, k = len(points), len(nodes) - len(points)
    corners = nodes[m:]
    # between corners, with the next corner on the way
    between, then = np.full((k, k), math.inf), np.tile(np.arange(k), (k, 1))
    for i in range(k):
        between[i] = np.where(seen(corners[i], corners, obstacles), np.hypot(*(corners - corners[i]).T), math.inf)
    between = np.minimum(between, between.T)
    np.fill_diagonal(between, 0.0)
    for j in range(k):
        via = between[:, j, None] + between[None, j]
        shorter = via < between - 1e-12
        between, then = np.where(shorter, via, between), np.where(shorter, then[:, j, None], then)
    dist, leave = np.full((m, m), math.inf), np.full((m, k), math.inf)
    for s in range(m):
        free, far = seen(nodes[s], nodes, obstacles), np.hypot(*(nodes - nodes[s]).T)
        dist[s] = np.where(free[:m], far[:m], math.inf)
        leave[s] = np.where(free[m:], far[m:], math.inf)
    dist = np.minimum(dist, dist.T)
    straight = np.isfinite(dist)
    for s in range(m if k else 0):
        hidden = np.flatnonzero(~straight[s])
        if len(hidden):
            dist[s, hidden] = ((leave[s, :, None] + between).min(0)[None] + leave[hidden]).min(1)
    np.fill_diagonal(dist, 0.0)

    def way(s: int, t: int) -> list[int]:
        if s == t or straight[s, t]:
            return [s, t][: 1 + (s != t)]
        start = leave[s, :, None] + between
        last = int((start.min(0) + leave[t]).argmin())
        at = int(start[:, last].argmin())
        line = [s, m + at]
        while at != last:
            at = int(then[at, last])
            line.append(m + at)
        return [*line, t]

    return dist, way, nodes


def walk(start: np.ndarray, targets: np.ndarray, obstacles: list[np.ndarray]) -> tuple[np.ndarray, float, list[int]]:
    """A closed walk from start over the targets that can be reached, never through an obstacle; its points, length, unreached targets."""
    points = np.concatenate([start[None], targets])
    dist, way, nodes = visible_paths(points, obstacles)
    reached = [i for i in range(len(points)) if np.isfinite(dist[0, i])]
    order = [reached[i] for i in tour(dist[np.ix_(reached, reached)])]
    line = [0]
    for a, b in zip(order, [*order[1:], 0]):
        line += way(a, b)[1:]
    return nodes[line], float(sum(dist[a, b] for a, b in zip(order, [*order[1:], 0]))), [i - 1 for i in range(1, len(points)) if i not in reached]


def walks(requests: DataFrame, key: str) -> DataFrame:
    """key, coords, length_m, unreachable, closed, clear: requests have start, targets and obstacles (convex rings)."""
    kind = dict(requests.dtypes)[key]

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                xy = lambda ps: np.array([(p["x"], p["y"]) for p in ps], float).reshape(-1, 2)
                obstacles = [xy(o) for o in r.obstacles]
                line, length, missed = walk(xy([r.start])[0], xy(r.targets), obstacles)
                clear = not any(enters(o, a, b) for o in obstacles for a, b in zip(line, line[1:]))
                out.append((getattr(r, key), [{"x": float(a), "y": float(b)} for a, b in line], round(length, 3), missed, bool((line[0] == line[-1]).all()), clear))
            yield pd.DataFrame(out, columns=[key, "coords", "length_m", "unreachable", "closed", "clear"])

    # few rows of much work: by number, as adaptive execution would put them into one task, and by a hash of its own, as an exchange by key alone would be left out behind a grouping
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return requests.select(key, "start", "targets", "obstacles").repartition(parts, F.xxhash64(key)).mapInPandas(run, f"{key} {kind}, coords array<struct<x:double,y:double>>, length_m double, unreachable array<int>, closed boolean, clear boolean")
