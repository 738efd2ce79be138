"""Byte-level BPE ids of many texts: words are cut by array operations and every distinct word is encoded once.

Byte-level BPE never merges across the pre-tokens of its split pattern, so the ids of a text are the ids of its pre-tokens in
order. The cutter follows the public pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?O+|white space before white space|white space`` over code point classes. Texts with the special token's
name, or with code points that Python's Unicode tables do not know, go to the tokenizer library as they are, so the ids are the
library's for every text.
"""
import base64
import os
import unicodedata

import numpy as np

from .bytescan import span_hashes

END_ID = 0
SPECIAL = b"<|endoftext|>"
CACHE_WORDS = 1_000_000  # distinct words kept by a worker; beyond it the cache starts anew, results do not change
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
_loaded = {}


def vocabulary_path(name="byte_bpe_50k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes():
    """Class of each code point, filled by runs of 256."""
    if "classes" not in _loaded:
        _loaded["classes"] = np.full(0x110000, 255, np.uint8)
    return _loaded["classes"]


def code_point_classes(codes):
    table = _classes()
    classes = table[codes]
    if classes.max(initial=0) == 255:
        for page in np.unique(codes[classes == 255] >> 8):
            for c in range(int(page) << 8, (int(page) + 1) << 8):
                kind = unicodedata.category(chr(c))
                table[c] = {"L": LETTER, "N": NUMBER}.get(kind[0], UNKNOWN if kind == "Cn" else OTHER)
        table[WHITE] = SPACE
        classes = table[codes]
    return classes


def pretokens(codes, classes, row_ends):
    """Starts of the pre-tokens of all rows; ``row_ends`` are the rows' ends, no pre-token crosses them."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    row_end = np.zeros(n + 1, bool)
    row_end[row_ends] = True
    run = np.ones(n, bool)
    run[1:] = classes[1:] != classes[:-1]
    run |= row_end[:n]
    start = run.copy()
    white = classes == SPACE
    last_white = np.zeros(n, bool)  # last white space of a run that something of the same row follows
    last_white[:-1] = white[:-1] & ~white[1:]
    last_white &= ~row_end[1:]
    start |= last_white
    follower = np.flatnonzero(last_white & (codes == 32)) + 1
    start[follower] = False
    quote = np.flatnonzero(start & (codes == 39))
    for ending in ("s", "t", "re", "ve", "m", "ll", "d"):
        width = len(ending)
        at = quote[quote + width < n]
        good = run[at + 1] & ~row_end[at + 1]
        for k, letter in enumerate(ending):
            good &= codes[at + 1 + k] == ord(letter)
            if k:
                good &= ~row_end[at + 1 + k]
        at = at[good]
        start[at + 1] = False
        beyond = at + width + 1
        inside = beyond[(beyond < n)]
        start[inside] |= classes[inside] == LETTER
    return np.flatnonzero(start)


class Encoder:
    """Ids of lists of texts under one vocabulary file, with a bounded cache of words."""

    def __init__(self, path):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = None  # a rank file alone has no special tokens
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
        self.word_encoder = _rank_encoder(path)
        self._forget()

    def _forget(self):
        self.known = np.zeros(0, np.uint64)  # sorted hashes
        self.place = np.zeros(0, np.int64)
        self.begin = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes, words):
        encoded = [self.word_encoder(w) for w in words]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        if len(self.known) + len(hashes) > CACHE_WORDS:
            self._forget()
        base = len(self.begin)
        self.begin = np.append(self.begin, len(self.ids) + np.cumsum(lengths) - lengths)
        self.length = np.append(self.length, lengths)
        self.ids = np.append(self.ids, np.fromiter((i for e in encoded for i in e), np.uint32, int(lengths.sum())))
        known = np.append(self.known, hashes)
        order = np.argsort(known, kind="stable")
        self.known, self.place = known[order], np.append(self.place, np.arange(base, base + len(hashes)))[order]

    def _lookup(self, hashes):
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        return at, (self.known[at] == hashes) if len(self.known) else np.zeros(len(hashes), bool)

    def encode(self, texts):
        """(ids of all texts, their first id of each text and one more at the end). ``texts``: list of bytes or None."""
        return self.encode_cut(Cut(texts))

    def encode_cut(self, cut):
        """``encode`` for texts that are cut already, so that several vocabularies share the work."""
        _, found = self._lookup(cut.distinct)
        new = np.flatnonzero(~found)
        if len(new) and len(self.known) + len(new) > CACHE_WORDS:
            self._forget()
            new = np.arange(len(cut.distinct))
        if len(new):
            at = cut.first[new]
            spans = zip(cut.starts[at].tolist(), cut.ends[at].tolist(), strict=True)
            self._learn(cut.distinct[new], [cut.whole[s:e] for s, e in spans])
        entry = self.place[self._lookup(cut.distinct)[0]][cut.back] if len(cut.distinct) else np.zeros(0, np.int64)
        sizes = self.length[entry]
        until = np.cumsum(sizes)
        total = int(until[-1]) if len(until) else 0
        ids = self.ids[np.repeat(self.begin[entry] - (until - sizes), sizes) + np.arange(total)]
        bounds = np.append(0, until)[cut.word_first]
        if cut.odd and self.library:
            parts = [ids[bounds[k] : bounds[k + 1]] for k in range(len(cut.strings))]
            for k in cut.odd:
                parts[k] = np.asarray(self.library.encode(cut.strings[k], add_special_tokens=False).ids, np.uint32)
            ids = np.concatenate(parts)
            bounds = np.append(0, np.cumsum([len(p) for p in parts]))
        return ids, bounds


class Cut:
    """Texts cut into pre-tokens: code points, pre-token spans, the distinct pre-tokens and where each text begins."""

    def __init__(self, texts):
        self.strings = [(t or b"").decode("utf-8", "replace") for t in texts]
        self.whole = "".join(self.strings)
        self.codes = np.frombuffer(self.whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.lengths = np.fromiter(map(len, self.strings), np.int64, len(self.strings))
        self.row_ends = np.cumsum(self.lengths)
        self.classes = code_point_classes(self.codes)
        self.odd = {k for k, t in enumerate(texts) if SPECIAL in (t or b"")}
        unknown = np.flatnonzero(self.classes == UNKNOWN)
        self.odd |= set(np.searchsorted(self.row_ends, unknown, "right").tolist())
        self.starts = pretokens(self.codes, self.classes, self.row_ends)
        self.ends = np.append(self.starts[1:], len(self.codes))
        hashes = span_hashes(self.codes, self.starts, self.ends)
        self.distinct, self.first, self.back = np.unique(hashes, return_index=True, return_inverse=True)
        self.word_first = np.append(np.searchsorted(self.starts, self.row_ends - self.lengths), len(self.starts))


def _rank_encoder(path):
    """Encoder of single words from the rank file beside the vocabulary, or the library itself where there is none."""
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        return lambda word: library.encode(word, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return encoding.encode_ordinary


def encoder(path):
    """One encoder per worker and vocabulary."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
