"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

BLANK = r"[\x20\x09-\x0D]"


def words(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    w, t = words(text), text or ""
    triples = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def shingles(text, width):
    w = words(lowered(text))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def near(docs, width, percent):
    """[(doc_id, size, component)] of [(doc_id, text)] with distinct ids."""
    sets = {i: shingles(t, width) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def repeats(texts, window):
    """[(words, removed, kept)] of the texts."""
    split = [words(t) for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {i + k for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def exact(docs):
    """[(doc_id, keep_id, size, sha)] of [(doc_id, text)]."""
    groups = defaultdict(list)
    for i, t in docs:
        groups[sha(re.sub(BLANK, "", t or ""))].append((-len(t or ""), i is None, i or 0, i))
    return [(i, min(groups[k])[3], len(groups[k]), k) for k in groups for _, _, _, i in groups[k]]


def fill(have, children):
    """Shares of [(weight, capacity)] by repeated water filling."""
    share = [0.0] * len(children)
    full: set[int] = set()
    while True:
        left = have - sum(children[i][1] for i in full)
        w = sum(children[i][0] for i in range(len(children)) if i not in full)
        over = [i for i in range(len(children)) if i not in full and left * children[i][0] / w >= children[i][1] - 1e-9]
        if not over:
            return [children[i][1] if i in full else left * children[i][0] / w for i in range(len(children))] if len(full) < len(children) else [c for _, c in children]
        full |= set(over)
        if len(full) == len(children):
            return [c for _, c in children]


def mix(docs, budget, epochs, weights, seed):
    """Counter of (doc_id, pass) chosen from [(doc_id, text, lang, source)]."""
    key = lambda v: "~" if v is None else "=" + v
    domain = lambda s: None if s is None else f"group{ord(hashlib.md5(s.encode()).hexdigest()[0]) % 4}"
    rows = [(i, len(words(t)), (key(domain(s)), key(g), key(s))) for i, t, g, s in docs]
    size = Counter()
    for _, n, leaf in rows:
        size[leaf] += n
    share = {(): budget * sum(size.values())}
    for level, name in enumerate(("domain", "lang", "source")):
        for parent in {x[:level] for x in size if size[x] and x[:level] in share}:
            kids = sorted({x[: level + 1] for x in size if x[:level] == parent and size[x]})
            caps = [epochs * sum(n for x, n in size.items() if x[: level + 1] == k) for k in kids]
            share |= dict(zip(kids, fill(share[parent], [(weights.get(name, {}).get(k[-1], 1.0), float(c)) for k, c in zip(kids, caps)])))
    out = Counter()
    for leaf, total in size.items():
        if not total:
            continue
        full = int((share[leaf] + 1e-6) // total)
        rest = int(share[leaf] + 1e-6 - full * total)
        keyed = defaultdict(int)
        order = lambda i: hashlib.md5(f"{seed}:{full + 1}:{'' if i is None else i}".encode()).hexdigest()  # noqa: B023, E731
        mine = [(i, n) for i, n, x in rows if x == leaf]
        for i, n in mine:
            keyed[order(i)] += n
        taken, so_far = set(), 0
        for k in sorted(keyed):
            so_far += keyed[k]
            if rest <= 0 or so_far > rest:
                break
            taken.add(k)
        for i, _ in mine:
            out.update((i, e) for e in range(1, full + 1 + (order(i) in taken)))
    return out


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))


def search(docs, items, k):
    """[(item_id, rank, doc_id, score)] of [(doc_id, text)] and [(item_id, text)]; rows of one item_id are one item."""
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, vocabulary in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c, _ in held) + 1))) for t in vocabulary}
        rows = []
        for i, c, n in held:
            m = 10 + 90 * n * n_docs // n_terms
            if (score := sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in vocabulary if t in c)) > 0:
                rows.append((score, i))
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1]))
        out += [(item, rank + 1, i, score) for rank, (score, i) in enumerate(rows[:k])]
    return out


def leaks(docs, items, window):
    """[(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)]."""
    windows = defaultdict(set)
    for i, t in items:
        w = terms(t)
        for at in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[at : at + window])].add(i)
    out = []
    for i, t in docs:
        w, hit, found = terms(t), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[at : at + n]))) is not None:
                    hit |= set(range(at, at + n))
                    found |= got - {None}
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def trie(turns):
    """[(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)] of [(conv_id, turn, role, text)]."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn, sha(f"{len(role.encode())}:{role}{text}"), role, text))
    own = {c: [x[3:] for x in sorted(rows, key=lambda x: x[:3])] for c, rows in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - int(math.fmod(c, 20))
        path = tuple(own.get(donor, [])[:h] + rows[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        inner = {x[:-1] for x in members if x}
        saved = sum((len(members[x]) - 1) * len(words(x[-1][1])) for x in below if x)
        digest = sha(",".join(map(str, sorted(ends.get(node, [])))))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), sum(len(x) == len(node) + 1 for x in below), sum(x not in inner for x in below), saved, digest))
    return out
