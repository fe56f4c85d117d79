"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def components(docs, k=5, percent=80):
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)])
    lists, parent = defaultdict(list), {i: i for i in sets}
    for i, x in sets.items():
        for y in x:
            lists[y].append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in sets.items():
        same = Counter(j for y in x for j in lists[y] if j < i)
        for j, n in same.items():
            if 100 * n >= percent * (len(x) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def word_windows(docs, width=50):
    words, first = {i: WORD.findall(t or "") for i, t in docs}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    out = {}
    for i, x in words.items():
        gone = [False] * len(x)
        for k in range(len(x) - width + 1):
            if first[tuple(x[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = (len(x), sum(gone), " ".join(a for a, g in zip(x, gone) if not g))
    return out


def byte_windows(docs, width=400, keep="none"):
    data, places = {i: (t or "").encode() for i, t in docs}, defaultdict(list)
    for i in sorted(data):
        for k in range(len(data[i]) - width + 1):
            places[data[i][k : k + width]].append((i, k))
    out = {}
    for i, x in data.items():
        gone = bytearray(len(x))
        for k in range(len(x) - width + 1):
            at = places[x[k : k + width]]
            if len(at) > 1 and (keep == "none" or at[0] < (i, k)):
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for k in range(len(x)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(x), sum(gone), spans, sha(bytes(a for a, g in zip(x, gone) if not g)))
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def deduped_all_lines(docs, fuzzy=10, chars=20):
    """Exact repeats of any line with a word; one edit, of characters in lines of few words."""
    out, seen = {}, defaultdict(list)
    for i, t in sorted(docs, key=lambda r: r[0]):
        kept = []
        for line in (t or "").split("\n"):
            w = tuple(WORD.findall(line))
            few = len(w) < fuzzy
            u = tuple(" ".join(w)) if few else w
            near = not few or len(u) >= chars
            if not w or not any(o == u or (near and len(o) >= chars * few and one_edit(o, u)) for o in seen[few]):
                kept.append(line)
            if w:
                seen[few].append(u)
        out[i] = None if t is None else "\n".join(kept)
    return out


def losses(docs, target, smoothing):
    words = {i: WORD.findall((t or "").translate(LOWER)) for i, t in docs}
    two, two_t, one, one_t = Counter(), Counter(), Counter(), Counter()
    for i, w in words.items():
        for x, y in zip(w, w[1:]):
            two[x, y] += 1
            one[x] += 1
            if i in target:
                two_t[x, y] += 1
                one_t[x] += 1
    every, own = sum(one.values()), sum(one_t.values())
    scale, add = own / every, smoothing * len({x for w in words.values() for x in w})
    out = {}
    for i, w in words.items():
        n = max(1, len(w) - 1)
        t = sum(math.log(one_t[x] + add) - math.log(two_t[x, y] + smoothing) for x, y in zip(w, w[1:])) / n
        b = sum(math.log(scale * one[x] + add) - math.log(scale * two[x, y] + smoothing) for x, y in zip(w, w[1:])) / n
        out[i] = (t, b)
    return out
