"""A bounded map from frequent strings to what was computed for them."""

from __future__ import annotations

from itertools import islice


class PieceCache(dict):
    """Calls make(key) for a missing key. When it is full, the entries seen first stay, as frequent strings turn up early."""

    def __init__(self, make, limit: int = 400_000, keep: int = 200_000):
        super().__init__()
        self.make, self.limit, self.keep = make, limit, keep

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.limit:
            for old in list(islice(self, self.keep, None)):
                del self[old]
        if len(key) <= 64:
            self[key] = value
        return value


class TwoAges:
    """A bounded map that is asked for many distinct keys at once. A key asked for again moves from the young to the old
    entries; when the young are too many they go all, as most strings never come back, and of the old ones those moved last."""

    def __init__(self, make, young: int, old: int):
        self.make, self.limits, self.young, self.old = make, (young, old), {}, {}

    def many(self, keys: list) -> list:
        young, old, make, out = self.young, self.old, self.make, []
        for key in keys:
            value = old.get(key)
            if value is None:
                value = young.pop(key, None)
                if value is None:
                    value = make(key)
                    if len(key) <= 64:
                        young[key] = value
                else:
                    old[key] = value
            out.append(value)
        if len(young) > self.limits[0]:
            young.clear()
        if len(old) > self.limits[1]:
            for key in list(islice(old, self.limits[1] * 2 // 3, None)):
                del old[key]
        return out
