"""Plain versions of the run, piece and spelling operators, for small inputs."""
import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(words, least=12):
    """(start, length, period) of all runs, each under its smallest period."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(least, 2 * p):
                found.setdefault((start, i + p - start), p)
    return sorted((s, n, p) for (s, n), p in found.items())


def planted(doc_id, text):
    """Words of a document after the test edit that makes every tenth one periodic."""
    words = WORD.findall(text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def run_row(doc_id, text):
    words = planted(doc_id, text)
    found = runs(words)
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    longest = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(found, key=lambda r: (r[0], r[2])))
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    return (doc_id, len(found), *best, sha(listed), sha(kept))


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def word_counts(rows, least, edited=None):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if edited and doc_id is not None and h % edited == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                counts[word] += 1
    return counts


def spelling_groups(counts, ratio):
    """(word, form, root, n, n_near, form_n) by comparing all words."""
    near_words = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for word, others in near_words.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * counts[word]:
            form[word] = best
    rows = set()
    for word in counts:
        root = word
        while root in form:
            root = form[root]
        rows.add((word, form.get(word), root, counts[word], len(near_words[word]), counts.get(form.get(word))))
    return rows
