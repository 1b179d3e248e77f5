"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return WORD.findall(text or "")


def lower_words(text):
    return words((text or "").translate(LOWER))


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


def shingle_sets(texts, k):
    out = []
    for t in texts:
        w = lower_words(t)
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def groups(ids, sets, percent=80):
    """The smallest id of each row's group."""
    parent = list(range(len(ids)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    members = collections.defaultdict(list)
    for i in range(len(ids)):
        members[find(i)].append(ids[i])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return [low[find(i)] for i in range(len(ids))]
