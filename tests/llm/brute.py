"""Plain versions of what the operators compute, for small inputs."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size=5):
    own = words(lowered(text))
    if not own:
        return []
    if len(own) < size:
        return [tuple(own)]
    return [tuple(own[i : i + size]) for i in range(len(own) - size + 1)]


def near_duplicates(texts, percent=85):
    """doc_id -> (set size, least id reachable) for {doc_id: text}."""
    sets = {d: set(shingles(t)) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = sets[a] | sets[b]
            if both and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in texts}


def without_repeated_words(texts, window=13):
    """doc_id -> (words, removed, kept words) for {doc_id: text}."""
    seen, found = {}, {}
    own = {d: words(t) for d, t in texts.items()}
    for d in sorted(own):
        for i in range(len(own[d]) - window + 1):
            seen.setdefault(tuple(own[d][i : i + window]), d)
    for d, ws in own.items():
        gone = set()
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i : i + window])] < d:
                gone.update(range(i, i + window))
        found[d] = len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)
    return found


def without_repeated_bytes(texts, length=100):
    """doc_id -> (bytes, removed, runs, kept bytes) for {doc_id: text}."""
    seen, found = set(), {}
    for d in sorted(texts):
        body = (texts[d] or "").encode()
        gone = set()
        for i in range(len(body) - length + 1):
            piece = body[i : i + length]
            if piece in seen:
                gone.update(range(i, i + length))
            seen.add(piece)
        runs = sum(1 for i in gone if i - 1 not in gone)
        found[d] = len(body), len(gone), runs, bytes(c for i, c in enumerate(body) if i not in gone)
    return found


def similarity(a, b):
    a, b = collections.Counter(a), collections.Counter(b)
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def leaks(texts, items, least=0.8):
    """(doc_id, item_id) -> best similarity of an item-sized window."""
    found = {}
    for d, text in texts.items():
        own = words(lowered(text))
        for item, wanted in items.items():
            size, target = len(words(wanted)), shingles(wanted)
            if not size or not own:
                continue
            best = max(
                similarity(shingles(" ".join(own[p : p + size])), target) for p in range(max(1, len(own) - size + 1))
            )
            if best >= least:
                found[d, item] = best
    return found


def sha256(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def characters(text):
    """Lower-cased letters, anything else and the end one space; nothing if there is no letter."""
    found = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    return re.sub(" +", " ", found).strip(" ") + " " if found.strip() else ""


class CharacterModel:
    """Interpolated Kneser-Ney over 4-grams of one language, by its definition."""

    def __init__(self, texts, alphabet):
        self.levels = [collections.Counter()]
        for text in texts:
            own = "   " + characters(text)
            self.levels[0].update(own[i : i + 4] for i in range(len(own) - 3))
        while len(self.levels) < 4:
            self.levels.append(collections.Counter(gram[1:] for gram in self.levels[-1]))
        self.alphabet = alphabet
        self.discounts = []
        for level in self.levels:
            once, twice = (sum(n == k for n in level.values()) for k in (1, 2))
            self.discounts.append(once / (once + 2 * twice) if once and twice else 0.5)

    def chance(self, gram, k=0):
        level, discount = self.levels[k], self.discounts[k]
        same = {g: n for g, n in level.items() if g[:-1] == gram[:-1]}
        below = 1 / self.alphabet if k == 3 else self.chance(gram[1:], k + 1)
        if not same:
            return below
        left = discount * len(same) * below
        return (max(level.get(gram, 0) - discount, 0) + left) / sum(same.values())
