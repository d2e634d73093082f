"""Cuckoo filters in numpy: compact sets of 64-bit keys that allow deletion.

A key is known by its class, a 16-bit fingerprint and a pair of buckets, either of which
is found from the other and the fingerprint.  A filter holds one entry for each class;
different keys may share a class, so a hit means "perhaps there" and a miss "not there".
An entry may go only when no key of its class is left, which the caller's exact table
says.  A filter grows by layers of a fixed size; what a full layer turns out goes to the next.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

SLOTS = 4
#: Buckets of a layer (a power of two); a layer takes up to some 95 % of its slots.
BUCKETS = 1 << 15
#: Evictions in a row after which a layer counts as full.
MAX_KICKS = 200


def classes_of(keys: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """The class of each 64-bit key, as (smaller bucket, fingerprint) in one integer."""
    mixed = mix64(keys.view(np.uint64))
    print_ = (mixed >> np.uint64(48)).astype(np.int64)
    print_[print_ == 0] = 1
    bucket = (mixed & np.uint64(buckets - 1)).astype(np.int64)
    return np.minimum(bucket, other_bucket(bucket, print_, buckets)) << 16 | print_


def other_bucket(bucket: np.ndarray, print_: np.ndarray, buckets: int) -> np.ndarray:
    return bucket ^ (mix64(print_.astype(np.uint64)) & np.uint64(buckets - 1)).astype(np.int64)


class CuckooFilter:
    """Entries of classes; ``layers`` are arrays (buckets, SLOTS) of fingerprints, 0 for an empty slot."""

    def __init__(self, buckets: int = BUCKETS, data: bytes | None = None):
        self.buckets = buckets
        held = np.frombuffer(data or b"", np.uint16).reshape(-1, buckets, SLOTS)
        self.layers = [layer.copy() for layer in held] or [np.zeros((buckets, SLOTS), np.uint16)]

    def to_bytes(self) -> bytes:
        return np.stack(self.layers).tobytes()

    def __len__(self) -> int:
        return int(sum(np.count_nonzero(layer) for layer in self.layers))

    def _where(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        print_, bucket = classes & 0xFFFF, classes >> 16
        return print_, bucket, other_bucket(bucket, print_, self.buckets)

    def holds(self, classes: np.ndarray) -> np.ndarray:
        print_, one, two = self._where(classes)
        found = np.zeros(len(classes), bool)
        for layer in self.layers:
            found |= (layer[one] == print_[:, None]).any(axis=1) | (layer[two] == print_[:, None]).any(axis=1)
        return found

    def insert(self, classes: np.ndarray) -> None:
        """Add one entry for each different class that is not there yet."""
        classes = np.unique(classes)
        print_, bucket, _ = self._where(classes[~self.holds(classes)])
        while len(print_):
            print_, bucket = self._fill(self.layers[-1], print_, bucket)
            if len(print_):
                self.layers.append(np.zeros((self.buckets, SLOTS), np.uint16))

    def _fill(self, layer: np.ndarray, print_: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place entries, evicting others to their second bucket; returns the entries left without a place."""
        tried = np.zeros(len(print_), bool)
        for kick in range(MAX_KICKS):
            if not len(print_):
                break
            first = np.unique(bucket, return_index=True)[1]  # one entry for each bucket at a time
            free = layer[bucket[first]] == 0
            room = free.any(axis=1)
            done = first[room]
            layer[bucket[done], free[room].argmax(axis=1)] = print_[done]
            full = first[~room]
            swap = full[tried[full]]  # both buckets were full: take the place of another entry
            slot = (print_[swap] + kick) % SLOTS
            out = layer[bucket[swap], slot].astype(np.int64)
            layer[bucket[swap], slot] = print_[swap]
            print_[swap] = out
            tried[full] = True
            bucket[full] = other_bucket(bucket[full], print_[full], self.buckets)
            left = np.ones(len(print_), bool)
            left[done] = False
            print_, bucket, tried = print_[left], bucket[left], tried[left]
        return print_, bucket

    def delete(self, classes: np.ndarray) -> None:
        """Take away the entries of the classes; the caller knows that no key of them is left."""
        print_, one, two = self._where(np.unique(classes))
        for p, buckets in zip(print_.tolist(), zip(one.tolist(), two.tolist())):
            for layer in self.layers:
                row = next((b for b in buckets if (layer[b] == p).any()), None)
                if row is not None:
                    layer[row, int((layer[row] == p).argmax())] = 0
                    break
