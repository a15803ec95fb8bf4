"""Plain versions of what the operators do."""

import re

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(s):
    return WORD.findall((s or "").translate({c: c + 32 for c in range(65, 91)}))


def near_classes(rows):
    """Ids of each class of texts that 5-word shingle sets at a Jaccard of 0.8 connect; rows with null ids are left out."""
    sets = []
    for i, t in rows:
        w = words(t)
        if w and i is not None:
            sets.append((i, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}))
    root = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(a):
                x, y = sets[a][1], sets[b][1]
                if root[a] != root[b] and len(x & y) >= 0.8 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    out = {}
    for (i, _), r in zip(sets, root, strict=True):
        out.setdefault(r, []).append(i)
    return list(out.values())
