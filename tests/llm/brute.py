"""Plain Python versions of the operators, for small fixtures."""

import hashlib
import random
import re
from collections import defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def low(text):
    return (text or "").translate(UPPER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus(n=120, seed=3):
    """Texts with copies, near copies, shared passages, nulls, blanks, odd spaces and other scripts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "straße", "日本", "İx", "don't", "a_b"]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    made = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 4, 12, 13, 30, 80]))]
        kind = rng.randrange(8)
        if kind == 0 and made:
            made.append(rng.choice(made))
            continue
        if kind == 1 and made and made[-1]:
            words = made[-1].split(" ")
            words[rng.randrange(len(words))] = "changed"
        if kind == 2:
            a, b = sorted(rng.sample(range(60), 2))
            words = words[:10] + passage[a:b] + words[10:]
        made.append(rng.choice([" ", " ", "  ", "\n", "\t "]).join(words))
    made += [None, "", " ", made[7], (made[7] or "x").upper(), "A" * 200_000, " ".join(passage * 300)]
    return list(enumerate(made))


def frame(spark, rows):
    """A table of documents with columns whose names the operators use inside."""
    rows = [(i, t, None, "x", i, "h", 1, True) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, words string, rid long, digest string, n long, stays boolean").repartition(3)


def copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    return {i: (max(groups[low(t)]), len(groups[low(t)]), i == max(groups[low(t)]), sha(low(t))) for i, t in rows}


def contaminated(rows, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall(low(text))
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[k : k + size])].add(str(item))
    out = {}
    for i, text in rows:
        w, hit, found = WORD.findall(low(text)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out[i] = (len(w), len(hit), sorted(found))
    return out


def without_repeats(rows, size=13):
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(split):
        for k in range(len(split[i]) - size + 1):
            first.setdefault(tuple(split[i][k : k + size]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


def similar(rows, n=5, least=0.8):
    """Class of each row (its smallest id) and the links between different sets."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(low(t))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    ids, root, links = list(sets), {i: i for i in sets}, defaultdict(set)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                p, q = sorted((top(a), top(b)))
                root[q] = p
                if sets[a] != sets[b]:
                    links[a].add(sets[b])
                    links[b].add(sets[a])
    return {i: (top(i), len(links[i])) for i in ids}


def base_spans(text):
    text, out = text or "", []
    for order, (kind, pattern, flags, group, least) in enumerate([
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 0, 16),
        ("hex", r"[0-9a-f]+", 0, 0, 32),
    ]):
        out += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]
