"""Near copies by direct comparison of all pairs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def direct_near_classes(texts, least=0.8, width=5):
    """Class of each text by single links of Jaccard similarity."""
    sets = []
    for t in texts:
        ws = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(" ".join(ws[i:i + width]) for i in range(len(ws) - width + 1)) or frozenset([" ".join(ws)] if ws else []))
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def kept_by(rows, classes):
    best = {}
    for i, (d, t) in enumerate(rows):
        key = (d is None, d or 0, hashlib.md5((t or "").encode()).digest())
        if classes[i] not in best or key < best[classes[i]][0]:
            best[classes[i]] = (key, d, t or "")
    return sorted(((d, t) for _, d, t in best.values()), key=str)
