"""Brute-force versions of the operators, one document after the other."""

import hashlib
import math
import re
import string
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(docs, window=20):
    docs = sorted((i, WORD.findall(t or "")) for i, t in docs)
    first = {}
    for i, w in docs:
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), (i, k))
    out = {}
    for i, w in docs:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (i, k):
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), kept)
    return out


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(docs):
    """By row: size of the set, smallest doc_id of the component (None if it has none), number of links."""
    sets = [shingles(t) for _, t in docs]
    parent, links = list(range(len(docs))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in where[g]).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
                links.update((i, j))
        for g in s:
            where[g].append(i)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            ids[find(i)].append(doc_id)
    return [(d, len(sets[i]), min(ids[find(i)], default=None), links[i]) for i, (d, _) in enumerate(docs)]


def line_dedup(docs, least=10):
    lines = {i: (t or "").split("\n") for i, t in docs}
    key = lambda x: x.strip("\t\n\x0b\x0c\r ").translate(LOWER)
    held = defaultdict(set)
    for i, own in lines.items():
        for x in own:
            if len(key(x)) >= least:
                held[key(x)].add(i)
    out = {}
    for i, own in lines.items():
        kept = [x for x in own if not (len(held.get(key(x), ())) >= 2 and min(held[key(x)]) != i)]
        out[i] = (len(own), len(own) - len(kept), "\n".join(kept))
    return out


def weighted_jaccard(a, b):
    x, y = Counter(WORD.findall(a)), Counter(WORD.findall(b))
    both = sum((x | y).values())
    return sum((x & y).values()) / both if both else 1.0


def letters_only(text):
    return "".join(" " if c in string.punctuation + string.digits else c for c in (text or "").lower()).split()


def grams_of(word, depth=6):
    s = f"^{word}$"
    return [s[max(0, i - depth) : i + 1] for i in range(1, len(s))]


def gram_ratios(docs, kinds, discount=0.9, prior=5.0):
    """Kneser-Ney over all documents; class likelihoods by seen and expected counts. ``kinds``: 0 and 1 are counted."""
    a, b, t = Counter(), Counter(), Counter()
    for i, text in docs:
        own = Counter(g for w in set(letters_only(text)) for g in grams_of(w))
        t.update(own)
        if kinds.get(i) in (0, 1):
            (a, b)[kinds[i]].update(own)
    totals = [Counter(), Counter(), Counter()]
    for total, own in zip(totals, (a, b, t), strict=True):
        for g, n in own.items():
            total[g[:-1]] += n
    follow, places, letters = Counter(g[:-1] for g in t), Counter(g[-2:] for g in t), {g[-1] for g in t}
    starts, kinds_after = Counter(), Counter()
    for pair, n in places.items():
        starts[pair[0]] += n
        kinds_after[pair[0]] += 1
    out = {}
    for g in t:
        c, y = g[:-1], g[-2]
        base = (max(places[g[-2:]] - discount, 0) + discount * kinds_after[y] / len(letters)) / starts[y]
        shared = (max(t[g] - discount, 0) + discount * follow[c] * base) / totals[2][c]
        toxic, plain = ((own[g] + prior) / (total[c] * shared + prior) for own, total in ((b, totals[1]), (a, totals[0])))
        out[g] = math.log(toxic / plain)
    return out, t


def toxic_features(docs, ratios, half=3.0):
    """By text: the mean over its words of their log-likelihood ratios, each weighed by its size, on a scale of logarithms."""
    out = {}
    for _, text in docs:
        words = letters_only(text)
        each = [sum(ratios[g] for g in grams_of(w)) for w in words]
        mean = sum(r * r**8 / (r**8 + half**8) for r in each) / max(1, len(words))
        out[text] = math.copysign(math.log1p(abs(mean) / 0.003), mean)
    return out


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def digest(*parts):
    return sha("".join(parts))


def tree_levels(leaves, arity):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][k : k + arity]) for k in range(0, len(out[-1]), arity)])
    return out


def siblings(levels, at, arity):
    out = []
    for level in levels[:-1]:
        begin = at // arity * arity
        out.append((level[begin:at], level[at + 1 : begin + arity]))
        at //= arity
    return out


def merkle(rows, arity=16):
    """(doc_id, leaf, subroot, root, proof digest, root folded from the tampered leaf) of rows (doc_id, source, lang, n_chars, text, tampered leaf or None)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, digest(*map(field, r[:5])), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = tree_levels([x[2] for x in groups[s]], arity)
    top = tree_levels([trees[s][-1][0] for s in names], arity)
    out = []
    for k, s in enumerate(names):
        for at, (_, _, leaf, r) in enumerate(groups[s]):
            steps = siblings(trees[s], at, arity) + siblings(top, k, arity)
            fold = r[5] or leaf
            for a, b in steps:
                fold = digest(*a, fold, *b)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], digest(*(x for a, b in steps for x in (*a, *b))), fold))
    return out


def repairs(rows):
    """The cheapest edits of rows (turn, role, text), by trying all: counts, cost, audit and the repaired turns."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
    seen, kinds = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    goes = re.compile(r"(s?(ua)+)?")
    ways = [(0, "", "", [])]

    def inserted(ways):
        """With up to two turns inserted; a start of the pattern must remain one."""
        out, last = list(ways), ways
        for _ in range(2):
            last = [(c + 2, a + "I", i + x, [*t, (r, "")]) for c, a, i, t in last for x, r in (("u", "user"), ("a", "assistant")) if begins(i + x)]
            out += last
        return out

    def begins(initials):
        return any(goes.fullmatch(initials + end) for end in ("", "a", "ua"))

    def best(ways):
        """Of ways to the same end the ten cheapest."""
        by = defaultdict(list)
        for w in ways:
            by[w[2][-1:], len(w[2]) == 0].append(w)
        return [w for own in by.values() for w in sorted(own)[:10]]

    ways = inserted(ways)
    for (_, role, text), kind in zip(rows, kinds, strict=True):
        new = [(c + 3, a + "D", i, t) for c, a, i, t in ways]
        if kind not in ("blank", "duplicate"):
            more = int(kind == "truncated")
            new += [(c + more, a + "K", i + role[:1], [*t, (role, text)]) for c, a, i, t in ways if role and begins(i + role[:1])]
            new += [(c + 2 + more, a + "R", i + r[0], [*t, (r, text)]) for c, a, i, t in ways for r in ("user", "assistant") if begins(i + r[0])]
        ways = best(inserted(new))
    cost, audit, _, turns = min(w for w in ways if goes.fullmatch(w[2]))
    known = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in turns))), turns
