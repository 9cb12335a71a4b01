"""Volume of the convex hull of points in one, two or three dimensions (numpy only)."""

from __future__ import annotations

import numpy as np


def _hull2(p: np.ndarray) -> np.ndarray:
    """Corners of a planar hull in order (monotone chain)."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def chain(points: np.ndarray) -> list:
        out: list = []
        for q in points:
            while len(out) > 1:
                a, b = out[-1] - out[-2], q - out[-2]
                if a[0] * b[1] - a[1] * b[0] > 0:
                    break
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def _faces(p: np.ndarray, tol: float) -> np.ndarray:
    """Triangles (indices, outward) of a hull in space, built by adding one point after another."""
    # Four points that span a volume.
    a = int(np.argmin(p[:, 0]))
    b = int(np.argmax(((p - p[a]) ** 2).sum(axis=1)))
    c = int(np.argmax(np.linalg.norm(np.cross(p - p[a], p[b] - p[a]), axis=1)))
    n = np.cross(p[b] - p[a], p[c] - p[a])
    d = int(np.argmax(np.abs((p - p[a]) @ n)))
    if abs((p[d] - p[a]) @ n) <= tol * max(np.linalg.norm(n), 1e-300):
        return np.zeros((0, 3), int)
    centre = p[[a, b, c, d]].mean(axis=0)

    def outward(f: np.ndarray) -> np.ndarray:
        m = np.cross(p[f[:, 1]] - p[f[:, 0]], p[f[:, 2]] - p[f[:, 0]])
        turn = ((p[f[:, 0]] - centre) * m).sum(axis=1) < 0
        return np.where(turn[:, None], f[:, ::-1], f)

    faces = outward(np.array([[a, b, c], [a, b, d], [a, c, d], [b, c, d]]))
    for i in range(len(p)):
        m = np.cross(p[faces[:, 1]] - p[faces[:, 0]], p[faces[:, 2]] - p[faces[:, 0]])
        seen = ((p[i] - p[faces[:, 0]]) * m).sum(axis=1) > tol * np.linalg.norm(m, axis=1)
        if not seen.any():
            continue
        edges = np.concatenate([faces[seen][:, [k, (k + 1) % 3]] for k in range(3)])
        have = set(map(tuple, edges.tolist()))
        rim = np.array([e for e in edges.tolist() if (e[1], e[0]) not in have])
        faces = np.concatenate([faces[~seen], np.column_stack([rim, np.full(len(rim), i)])])
    return faces


def hull_points(p: np.ndarray) -> np.ndarray:
    """The corners of the hull of ``p`` among its points; hulls of parts can be merged by their corners."""
    p = np.unique(p[np.isfinite(p).all(axis=1)], axis=0)
    if len(p) <= p.shape[1] + 1:
        return p
    if p.shape[1] == 1:
        return p[[0, -1]]
    if p.shape[1] == 2:
        return _hull2(p)
    f = _faces(p, 1e-12 * float(np.ptp(p, axis=0).max()))
    return p[np.unique(f)] if len(f) else p


def hull_volume(p: np.ndarray) -> float:
    """Length, area or volume of the hull; 0 if the points don't span one."""
    p = np.unique(p[np.isfinite(p).all(axis=1)], axis=0)
    if len(p) <= p.shape[1]:
        return 0.0
    if p.shape[1] == 1:
        return float(p[-1, 0] - p[0, 0])
    if p.shape[1] == 2:
        h = _hull2(p)
        return float(abs(np.dot(h[:, 0], np.roll(h[:, 1], -1)) - np.dot(h[:, 1], np.roll(h[:, 0], -1))) / 2)
    f = _faces(p, 1e-12 * float(np.ptp(p, axis=0).max()))
    q = p - p.mean(axis=0)
    return float(np.abs(np.einsum("ij,ij->i", q[f[:, 0]], np.cross(q[f[:, 1]], q[f[:, 2]])).sum()) / 6)
