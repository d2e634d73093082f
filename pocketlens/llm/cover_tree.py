"""Cover tree over norm-augmented vectors, for exact inner-product search in numpy.

Every vector gets one more coordinate that brings all of a tree to the same norm, so the
inner product with a query falls with the distance on a sphere.  A node at a level covers
its points within that level's radius, and radii fall by a fixed factor from level to
level; as points lie on the sphere, a node's radius is an angle around its centre, and
that angle bounds the inner products of all its points from above and from below.
"""

from __future__ import annotations

import heapq
import io

import numpy as np

#: Radii fall by this factor from one level to the next.
BASE = 1.3
#: A node of so few points is a leaf, whose inner products are all computed.
LEAF = 96
#: Relative slack of bounds, far above the rounding of the angles.
SLACK = 1e-7


class CoverTree:
    """Points of one block with their ids and labels.

    ``vectors`` hold whole numbers with squared norms under 2**53, so inner products are
    exact.  Node arrays: ``centre`` (row of vectors), ``angle``, ``first`` and ``count``
    (children), ``start`` and ``stop`` (points that hang on the node itself: a leaf's
    points, or points alone in their ball).
    """

    ARRAYS = ("vectors", "ids", "labels", "norm", "centre", "angle", "first", "count", "start", "stop")

    def __init__(self, **arrays: np.ndarray):
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])
        self.centres = np.ascontiguousarray(self.vectors[self.centre])
        self.top = float(self.norm[0])

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> "CoverTree":
        squares = np.einsum("ij,ij->i", vectors, vectors)
        norm = float(np.sqrt(squares.max(initial=0.0)))
        on_sphere = np.column_stack([vectors, np.sqrt(np.maximum(0.0, norm * norm - squares))])

        def distances(members: np.ndarray, centre: int) -> np.ndarray:
            return np.sqrt(np.maximum(0.0, 2 * (norm * norm - on_sphere[members] @ on_sphere[centre])))

        nodes, order, placed = [], [], 0
        everything = np.arange(len(ids))
        pending = [(0, everything, distances(everything, 0))] if len(ids) else []
        top = float(pending[0][2].max()) if pending else 0.0
        nodes.extend(pending)
        centre, angle, first, count, start, stop = [], [], [], [], [], []
        at = 0
        while at < len(nodes):
            middle, members, away = nodes[at]
            nodes[at] = None
            at += 1
            widest = float(away.max())
            centre.append(middle)
            angle.append(2 * np.arcsin(min(1.0, (widest / (2 * norm) if norm else 0.0) + SLACK)))
            first.append(len(nodes))
            if len(members) <= leaf or widest <= norm * 1e-6:
                own, children = members, []
            else:
                own, children = cls._cover(members, middle, away, top, distances)
            nodes.extend(children)
            count.append(len(children))
            order.append(own)
            start.append(placed)
            placed += len(own)
            stop.append(placed)
        order = np.concatenate(order) if order else everything
        row = np.empty(len(ids), np.int64)
        row[order] = np.arange(len(ids))
        return cls(
            vectors=np.ascontiguousarray(vectors[order]),
            ids=ids[order],
            labels=labels[order],
            norm=np.array([norm]),
            centre=row[np.array(centre, np.int64)],
            angle=np.array(angle, float),
            first=np.array(first, np.int64),
            count=np.array(count, np.int64),
            start=np.array(start, np.int64),
            stop=np.array(stop, np.int64),
        )

    @staticmethod
    def _cover(members, middle, away, top, distances):
        """Balls of the first level whose radius is under the node's: the centre's own, then of points left over."""
        level = np.ceil(np.log(top / away.max()) / np.log(BASE) + 1e-9)
        radius = top * BASE**-level
        while radius >= away.max():
            radius /= BASE
        alone, children = [], []

        def ball(centre, inside, dist):
            if len(inside) == 1:
                alone.append(inside)
            else:
                children.append((centre, inside, dist))

        near = away <= radius
        if near.any():
            ball(middle, members[near], away[near])
        rest = members[~near]
        while len(rest):
            dist = distances(rest, rest[0])
            near = dist <= radius
            near[0] = True
            ball(rest[0], rest[near], dist[near])
            rest = rest[~near]
        return (np.concatenate(alone) if alone else members[:0]), children

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.ARRAYS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> "CoverTree":
        with np.load(io.BytesIO(data)) as held:
            return cls(**{name: held[name] for name in cls.ARRAYS})

    def _bounds(self, nodes: slice, query: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product that points of the nodes can have."""
        scale = length * self.top
        if not scale:
            none = np.zeros(nodes.stop - nodes.start)
            return none, none
        angle = np.arccos(np.clip(self.centres[nodes] @ query / scale, -1.0, 1.0))
        width = self.angle[nodes]
        most = np.where(angle <= width, 1.0, np.cos(np.maximum(0.0, angle - width))) + SLACK
        least = np.where(angle + width >= np.pi, -1.0, np.cos(np.minimum(np.pi, angle + width))) - SLACK
        return least * scale, most * scale

    def search(
        self, query: np.ndarray, label: int, same: bool, skip: int, lows: np.ndarray, highs: np.ndarray, k: int
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window [low, high] of inner products its first ``k`` points (scores, ids), highest first, ties by id.

        Points of the given label (``same``) or of all others take part; the point of id ``skip`` never.
        Nodes come best bound first; one whose bounds lie outside what each window still
        wants is skipped, the others' points are verified by their inner products.
        """
        if len(query) < self.vectors.shape[1]:
            query = np.pad(query, (0, self.vectors.shape[1] - len(query)))
        query = query[: self.vectors.shape[1]]
        found = [(np.empty(0), np.empty(0, np.int64)) for _ in lows]
        floors = np.where(lows <= highs, lows, np.inf).astype(float)
        length, top = float(np.sqrt(query @ query)), float(highs.max(initial=-np.inf))
        heap = []

        def push(nodes: slice) -> None:
            least, most = self._bounds(nodes, query, length)
            wanted = ((most[:, None] >= floors) & (least[:, None] <= highs)).any(axis=1)
            for i in np.flatnonzero(wanted).tolist():
                heapq.heappush(heap, (-most[i], nodes.start + i))

        def verify(points: slice) -> None:
            scores = self.vectors[points] @ query
            fits = (scores >= floors.min()) & (scores <= top) & ((self.labels[points] == label) == same)
            rows = np.flatnonzero(fits)
            if not len(rows):
                return
            scores, ids = scores[rows], self.ids[points][rows]
            scores, ids = scores[ids != skip], ids[ids != skip]
            for j, (low, high) in enumerate(zip(floors, highs)):
                inside = (scores >= low) & (scores <= high)
                if inside.any():
                    both, names = np.r_[found[j][0], scores[inside]], np.r_[found[j][1], ids[inside]]
                    best = np.lexsort((names, -both))[:k]
                    found[j] = both[best], names[best]
                    if len(best) == k:
                        floors[j] = max(floors[j], found[j][0][-1])

        if len(self.centre):
            push(slice(0, 1))
        while heap:
            most, node = heapq.heappop(heap)
            if -most < floors.min():
                break
            if self.stop[node] > self.start[node]:
                verify(slice(self.start[node], self.stop[node]))
            if self.count[node]:
                push(slice(self.first[node], self.first[node] + self.count[node]))
        return found
