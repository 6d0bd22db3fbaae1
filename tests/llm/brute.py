"""Each operator's result worked out plainly, row against row."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LOWEST = -(2**63)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key(doc_id):
    return LOWEST if doc_id is None else doc_id


def conversations(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((key(turn), role or "", text or ""))
    out = {}
    for conv, own in turns.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        out[conv] = (len(own), sha("".join(f"{r}\n{t}\n" for _, r, t in own)), len(loss), sha(loss))
    return out


def exact(rows):
    """(doc_id, keep_id, group_size, text digest), and how many stay of each text."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        out += [(i, max(known) if known else None, len(ids), sha(text)) for i in ids]
    return out, len(groups)


def lines(rows, min_chars=20, min_docs=3):
    def bare(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(bare(line)) >= min_chars:
                holders[bare(line)].add(key(doc_id))
    common = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc_id, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if common.get(bare(x), key(doc_id)) == key(doc_id)]
        out.append((doc_id, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return out


def targets(rows):
    """Source to (size, target), by sharing out again until no source is above its cap."""
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(WORD.findall(text or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(size.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * size[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= 3 * size[s]
            free.remove(s)
    return {s: (size[s], target[s]) for s in order}


def quality(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
    known, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in known
            known.add(line)
    n = len(words)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), symbols, again, len(covered), failed


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    counts = [sum(s[1] == k for s in spans) for k in range(3)]
    return (*counts, sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))))


def shingles(text, width=3):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near(rows, percent=85, width=3):
    """(doc_id, n_shingles, component_id), all pairs of sets compared."""
    members = defaultdict(list)
    for doc_id, text in rows:
        members[shingles(text, width)].append(key(doc_id))
    sets = [s for s in members if s]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
                continue
            shared = len(a & b)
            if 100 * shared >= percent * (len(a) + len(b) - shared):
                root[find(i)] = find(j)
    least = {}
    for i, s in enumerate(sets):
        least[find(i)] = min(least.get(find(i), 2**63), min(members[s]))
    name = {s: least[find(i)] for i, s in enumerate(sets)}
    out = []
    for doc_id, text in rows:
        s = shingles(text, width)
        component = name[s] if s else key(doc_id)
        out.append((doc_id, len(s), None if component == LOWEST else component))
    return out


def repeats(rows, length=400):
    """(doc_id, n_bytes, n_removed, n_spans, digest of the rest), every window against every other."""
    data = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    seen = Counter(d[s : s + length] for _, d in data for s in range(len(d) - length + 1))
    out = []
    for doc_id, d in data:
        gone = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((doc_id, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
