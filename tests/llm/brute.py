"""Plain Python forms of the operators' contracts, over small lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quality(text):
    words = WORD.findall(text or "")
    n, seen, dup = len(words), set(), 0
    for line in (x for x in (text or "").split("\n") if WORD.search(x)):
        dup += line in seen
        seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(n - 7)]
    times, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            inside |= set(range(i, i + 8))
    failed = n < 20 or 100 * len(inside) > 30 * n
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside), failed


def later_gram_chars(text, size):
    """Characters of words inside n-grams that occurred earlier."""
    words, seen, inside = WORD.findall(text or ""), set(), set()
    for i in range(len(words) - size + 1):
        gram = tuple(words[i:i + size])
        if gram in seen:
            inside |= set(range(i, i + size))
        seen.add(gram)
    return sum(len(words[i]) for i in inside)


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def components(docs, size, percent):
    """Of each row: set size and the smallest doc_id of its component."""
    sets = [shingles(t, size) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [(len(s), low.get(root(i)) if s else docs[i][0]) for i, s in enumerate(sets)]


def base_scores(docs):
    """Of each row: held_out, tokens, known tokens, base score; and the number of training tokens."""
    rows = [(zlib.crc32(str(d).encode()) % 5 == 1 if d is not None else False, WORD.findall((t or "").translate(LOWER)) + [None])
            for d, t in docs]
    counts = Counter(w for held, words in rows if not held for w in words)
    n, v = sum(counts.values()), len(counts)
    score = lambda words: sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
    return [(held, len(words), sum(counts[w] > 0 for w in words), score(words)) for held, words in rows], n


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(digits[::-1]))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return True


def personal(text):
    """Counts by kind, digest and list of base spans."""
    spans, counts = [], []
    for kind, pattern in KINDS.items():
        own = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if passes(kind, m[0])]
        spans += own
        counts.append(len(own))
    return counts, hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(spans)


def line_windows(docs):
    """Text of each (doc_id, text) after line dedup; rows with one key are one text."""
    texts = {}
    for d, t in docs:
        if t is not None:
            lines = [(i, x.strip(" \t\r\f\x0b")) for i, x in enumerate(t.split("\n"))]
            lines = [x for x in lines if x[1]]
            texts[d, t] = [(tuple(x[1] for x in lines[k:k + 3]), [x[0] for x in lines[k:k + 3]]) for k in range(len(lines) - 2)]
    first, times = {}, Counter()
    for key in sorted(texts, key=lambda k: (k[0] is not None, k[0] or 0)):
        for window, at in texts[key]:
            first.setdefault(window, (key, at[0]))
            times[window] += 1
    out = {}
    for key, windows in texts.items():
        gone = set()
        for window, at in windows:
            if times[window] > 1 and first[window] != (key, at[0]):
                gone.update(at)
        out[key] = "\n".join(x for i, x in enumerate(key[1].split("\n")) if i not in gone)
    return out


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    values = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Root of a list of nodes, and each one's (siblings, sides)."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for i in range(len(nodes)):
            other = i ^ 1
            for k in owners[i]:
                paths[k].append((nodes[other] if other < len(nodes) else "", i % 2))
        owners = [sum(owners[i:i + 2], []) for i in range(0, len(nodes), 2)]
        nodes = [sha(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def merkle(rows):
    """Of each (doc_id, source, lang, n_chars, text): what the manifest query returns."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs]
    trees = [climb([leaf(r) for r in g]) for g in groups]
    root, tops = climb([t[0] for t in trees])
    out = []
    for group, (subroot, paths), top in zip(groups, trees, tops):
        for row, path in zip(group, paths):
            x = leaf(row, more=row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0)
            for node, side in path + top:
                x = sha(node, x) if side else sha(x, node)
            out.append((row[0], leaf(row), subroot, root, sha(*(n for n, _ in path + top)), x, x == root))
    return out


def runs_of_words(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def resampling(docs, target, percent=25, seed=7):
    """Of each (doc_id, text): n_words, n_features, weight, score; and the ranks of (score, doc_id) drawn."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, x in docs for f in runs_of_words(x)[1])
    t = Counter(bucket(f) for x in target for f in runs_of_words(x)[1])
    total, aim = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + 10_000) / ((s[b] + 1) * (aim + 10_000))))
    out = []
    for d, x in docs:
        words, features = runs_of_words(x)
        weight = sum(gain(bucket(f)) for f in features) // len(features) if features else 0
        h = int(sha(f"{seed}:", "" if d is None else str(d))[:8], 16)
        out.append((d, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((-r[4], r[0] is not None, r[0] or 0) for r in out if r[1] >= 20)
    return out, [(-s, d if known else None) for s, known, d in able[:percent * len(able) // 100]]


def kept(text):
    """The verdict of the quality rules: the base rules, then shares of characters and of symbols."""
    words, chars, symbols, _, _, failed = quality(text)
    seen, again = set(), 0
    for line in (x for x in (text or "").split("\n") if WORD.search(x)):
        again += len("".join(WORD.findall(line))) if line in seen else 0
        seen.add(line)
    limits = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
    return (not failed and 100 * again <= 20 * chars and 100 * symbols <= 50 * words
            and all(100 * later_gram_chars(text, n) <= limit * chars for n, limit in limits.items()))


def masked(text, secrets):
    """Text with base spans and the values that the pattern `secrets` gives replaced by their kinds."""
    kinds = [*KINDS, "secret"]
    found = [s.split(":") for s in personal(text)[2].split(",") if s]
    spans = [(int(a), int(b), kinds.index(k)) for k, a, b in found] + [(*m.span(1), 4) for m in re.finditer(secrets, text)]
    out, at = "", 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += text[at:start] + f"[{kinds[kind].upper()}]"
        at = max(at, end)
    return out + text[at:] if spans else text


def pipeline(docs, secrets):
    """doc_id and text of what quality rules, line dedup, near-duplicate removal and masking leave of (doc_id, text)."""
    docs = [(d, t) for d, t in docs if kept(t)]
    texts = line_windows(docs)
    docs = [(d, texts[d, t]) for d, t in docs if texts[d, t] == t or WORD.search(texts[d, t])]
    docs = [x for x, (n, low) in zip(docs, components(docs, 5, 80)) if not n or x[0] == low]
    return [(d, masked(t, secrets)) for d, t in docs]
