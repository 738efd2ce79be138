"""Plain single-machine versions of the operators, straight from their definitions."""
import collections
import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=True):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def repeats(docs, width=100):
    """{doc_id: (bytes, removed, spans, sha256)}; ids are unique."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        raw = (text or "").encode()
        marks, done = bytearray(len(raw)), 0
        for at in range(len(raw) - width + 1):
            window = raw[at : at + width]
            if window in seen:
                begin = max(at, done)
                marks[begin : at + width] = b"\1" * (at + width - begin)
                done = at + width
            else:
                seen.add(window)
        spans = sum(1 for k, m in enumerate(marks) if m and not (k and marks[k - 1]))
        kept = bytes(c for c, m in zip(raw, marks, strict=True) if not m)
        out[doc] = (len(raw), sum(marks), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, width):
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}


def jaccard_components(docs, width, num, den):
    """{doc_id: (set size, component)}; ids are unique."""
    sets = {doc: shingles(text, width) for doc, text in docs}
    where = collections.defaultdict(list)
    for doc, own in sets.items():
        for s in own:
            where[s].append(doc)
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for doc, own in sets.items():
        for other, common in collections.Counter(o for s in own for o in where[s] if o < doc).items():
            if den * common >= num * (len(own) + len(sets[other]) - common):
                a, b = root(doc), root(other)
                parent[max(a, b)] = min(a, b)
    return {doc: (len(own), root(doc)) for doc, own in sets.items()}


def base_quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = words(text, lower=False)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    times = collections.Counter(windows)
    covered = {p for k, x in enumerate(windows) if times[x] > 1 for p in range(k, k + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def leaks(text, items, width=10):
    """(n_words, n_hit, items) by comparing every position with every window."""
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = split.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, other in items:
        v = split.findall((other or "").translate(LOWER))
        n = min(width, len(v))
        for s in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[s : s + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
    return len(w), len(hit), ",".join(sorted(found))
