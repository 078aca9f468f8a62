"""Plain versions of the operators, for small fixtures."""

import hashlib
import math
import re


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def solid_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text, k):
    w = solid_words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def components(rows, k=4, percent=85):
    """rows: (id, text), ids not null. {id: smallest id reachable}."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, k))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(p and q and 100 * len(p & q) >= percent * len(p | q) for p in sets[a] for q in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def contaminated(text, items, window=10):
    """(words, hit words, item ids that occur)."""
    w = alnum_words(text)
    hit, found = set(), set()
    for item, t in items:
        v = alnum_words(t)
        n = min(window, len(v))
        if not n or item is None:
            continue
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), len(hit), found


def without_repeats(rows, length=50):
    """rows: (id, text) with different ids or equal rows. {id: (bytes, removed, spans, sha256 of the rest)}."""
    seen, out = set(), {}
    for i, t in sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0]):
        b = (t or "").encode()
        gone, own = bytearray(len(b)), set()
        for s in range(len(b) - length + 1):
            g = b[s : s + length]
            own.add(g)
            if g in seen:
                gone[s : s + length] = b"\1" * length
        seen |= own
        rest = bytes(c for c, m in zip(b, gone, strict=True) if not m)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), len(b) - len(rest), spans, hashlib.sha256(rest).hexdigest())
    return out


def line_windows_removed(rows, window=3):
    """rows: (id, text) in order. {id: text without later occurrences of three-line windows}."""
    seen, out = set(), {}
    for i, t in rows:
        if t is None:
            out[i] = None
            continue
        lines = t.split("\n")
        solid = [k for k, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for s in range(len(solid) - window + 1):
            key = tuple(lines[k] for k in solid[s : s + window])
            if key in seen:
                gone |= set(solid[s : s + window])
            seen.add(key)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def kneser_ney_counts(given, order=7):
    """given: (word, toxic, ordinary). Counts by longest n-gram, totals and kinds by its context, and by n continuations with theirs."""
    full, contexts, kinds = {}, {}, [set() for _ in range(order - 1)]
    for w, *n in given:
        w = b" " + w + b" "
        for i in range(1, len(w)):
            g = w[max(0, i - order + 1) : i + 1]
            full[g] = [a + b for a, b in zip(full.get(g, [0, 0]), n, strict=True)]
            for k in range(1, min(i, order - 1) + 1):
                kinds[k - 1].add(w[i - k : i + 1])
    for g, (a, b) in full.items():
        contexts[g[:-1]] = [x + y for x, y in zip(contexts.get(g[:-1], [0] * 4), (a, a > 0, b, b > 0), strict=True)]
    shared = []
    for longer in kinds:
        counts, above = {}, {}
        for g in longer:
            counts[g[1:]] = counts.get(g[1:], 0) + 1
        for g, n in counts.items():
            above[g[:-1]] = [x + y for x, y in zip(above.get(g[:-1], [0, 0]), (n, 1), strict=True)]
        shared.append((counts, above))
    return full, contexts, shared


def kneser_ney_ratio(given, word, order=7):
    """Log-likelihood of the word in the toxic model less that in the ordinary one."""
    full, contexts, shared = kneser_ney_counts(given, order)

    def discount(counts):
        once, twice = sum(c == 1 for c in counts), sum(c == 2 for c in counts)
        return once / (once + 2 * twice) if once and twice else 0.5

    def backoff(context, letter):
        p = 1 / 256
        for n in range(len(context) + 1):
            h = context[len(context) - n :]
            counts, above = shared[n]
            if h in above:
                total, kinds = above[h]
                d = discount(counts.values())
                p = (max(counts.get(h + letter, 0) - d, 0) + d * kinds * p) / total
        return p

    w, out = b" " + word + b" ", 0.0
    for i in range(1, len(w)):
        h, letter = w[max(0, i - order + 1) : i], w[i : i + 1]
        p = backoff(h[1:], letter)
        for c, sign in ((0, 1), (1, -1)):
            total, kinds = contexts.get(h, [0] * 4)[2 * c : 2 * c + 2]
            d = discount([x[c] for x in full.values()])
            q = (max(full.get(h + letter, [0, 0])[c] - d, 0) + d * kinds * p) / total if total else p
            out += sign * math.log(q)
    return out
