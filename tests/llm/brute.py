"""Plain Python statements of what the operators must return."""
from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def contamination(docs, items, window=10):
    owners = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            owners.setdefault(tuple(w[i:i + size]), set()).add(str(item) if item is not None else "null")
    sizes = {len(k) for k in owners}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if own := owners.get(tuple(w[i:i + size])):
                    hit.update(range(i, i + size))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return out


def fingerprint(text, n=3):
    parts = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if w]
    if not parts:
        return 0
    grams = [" ".join(parts[i:i + n]) for i in range(max(1, len(parts) - n + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def simhash_groups(docs, bits=2):
    fps = {d: fingerprint(t) for d, t in docs}
    by = {}
    for d, f in fps.items():
        by.setdefault(f, []).append(d)
    keys = sorted(by)
    pairs = [(min(by[a]), min(by[b])) for i, a in enumerate(keys) for b in keys[i + 1:] if (a ^ b).bit_count() <= bits]
    pairs += [(min(v), x) for v in by.values() for x in v]
    comp = components(pairs, fps)
    return {(d, f"{fps[d]:016x}", comp[d]) for d in fps}


def lm_scores(docs, order=3, alpha=0.4):
    from collections import Counter
    from math import log10
    all_words = {d: words(t) for d, t in docs}

    def counts(w):
        c = Counter()
        for k in range(1, order + 1):
            c.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
        c[()] = len(w)
        return c
    own = {d: counts(w) for d, w in all_words.items()}
    total = Counter()
    for c in own.values():
        total.update(c)
    out = {}
    for d, w in all_words.items():
        s, unseen = 0.0, 0
        for i in range(len(w)):
            top = min(order, i + 1)
            for k in range(top, 0, -1):
                g = tuple(w[i - k + 1:i + 1])
                n = total[g] - own[d][g]
                if n > 0:
                    s += log10(n / (total[g[:-1]] - own[d][g[:-1]])) + (top - k) * log10(alpha)
                    break
            else:
                unseen += 1
                s += -log10(max(1, total[()] - own[d][()])) + top * log10(alpha)
        out[d] = (len(w), unseen, s)
    return out


def segments(line, classes):
    """(what the line holds in its own places, what it holds there or at the shifts that are looked at)."""
    own, seen, n = set(), set(), len(line)
    for c, (least, end, k, size) in enumerate(classes):
        if least <= n and (end is None or n < end):
            for side, many in ((0, (k + 2) // 2), (1, k + 1 - (k + 2) // 2)):
                for i in range(many):
                    for s in range(-i, i + 1):
                        at = n - (i + 1) * size + s if side else i * size + s
                        part = (c, side, i, line[at:at + size])
                        seen.add(part)
                        if s == 0:
                            own.add(part)
    return own, seen


def limit(n, max_edits, per):
    return max_edits if per is None else min(30, max(max_edits, n // per))


def near_lines(docs, max_edits=2, min_chars=24, per=None, links=None):
    """Per document: (lines, exact repeats, near repeats, text left); all pairs of near lines if ``links``."""
    keyed = [(d, i, ln) for d, t in sorted(docs) if t is not None for i, ln in enumerate(t.split("\n"))]
    first = {}
    for d, i, ln in keyed:
        if ln.strip():
            first.setdefault(ln, (d, i))
    distinct = [ln for ln in first if len(ln) >= min_chars]
    bags = {ln: Counter(ln) for ln in distinct}
    near = set()
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            most = limit(max(len(a), len(b)), max_edits, per)
            # an edit changes the numbers of one or two characters by one
            if abs(len(a) - len(b)) <= most and ((bags[a] - bags[b]) + (bags[b] - bags[a])).total() <= 2 * most and edits(a, b) <= most:
                near.add(max((a, b), key=first.get))
                if links is not None:
                    links.append((a, b))
    out = {}
    for d, t in docs:
        if t is None:
            out[d] = (0, 0, 0, None)
            continue
        lines = t.split("\n")
        exact = [ln.strip() != "" and first[ln] != (d, i) for i, ln in enumerate(lines)]
        gone = [e or ln in near for e, ln in zip(exact, lines)]
        out[d] = (len(lines), sum(exact), sum(gone) - sum(exact),
                  "\n".join(ln for ln, g in zip(lines, gone) if not g))
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def article(page):
    """Main text of the generated pages: the blocks of their one article element."""
    import html
    body = page[page.index("<article>") + 9:page.index("</article>")]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(b for b in blocks if b)
