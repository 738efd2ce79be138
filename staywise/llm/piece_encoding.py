"""SentencePiece encoding with the byte spans of every piece, and decoding, as the public library does them.

A text is normalised by the model's compiled character map: at each place the longest prefix that the map's trie knows is replaced, any
other character stays. Every normalised character keeps the place in the source where its prefix began, so each piece is projected back to a span
of the text's own UTF-8 bytes. Merges then join pieces, best score first and leftmost among equals; characters outside the vocabulary
become one piece per byte, the last of which carries the span.

No merge crosses two neighbouring characters that stand side by side in no piece, so the normalised text is cut there, every
distinct part is merged once per worker (the cache is bounded), and the ids of a text are the ids of its parts in order.

Spark deals out the rows; a task holds a block of about 2 MB of texts, or one longer text. Null and empty texts have only the begin and end
ids and decode to an empty string. Rows are independent: null ids, repeated rows and ties of any kind give a row each; no rows give none. Columns other than
the id and the text are not read.
"""
import heapq
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .bpe import Encoder, vocabulary_path
from .bytescan import binary_values, slices, span_hashes
from .tables import per_batch

MODEL = "piece_bpe_32k.model"
MARK = "▁"  # stands for a space inside pieces
SHORT = 200  # characters of a part whose pairs are kept in a plain list
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model file
_models = {}


def _message(data):
    """(field, value) of a serialised protocol buffer message."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else number()
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


class CharacterMap:
    """A compiled character map: a double-array trie over byte strings whose values are places in a pool of replacements."""

    def __init__(self, compiled):
        self.units, self.pool = (), b""
        if compiled:
            size = struct.unpack_from("<I", compiled)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", compiled, 4)
            self.pool = compiled[4 + size :]
            self.starts = frozenset(b for b in range(256) if self._child(self._jump(0), b) is not None)

    def _jump(self, node):
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 512) >> 6))

    def _child(self, base, byte):
        node = base ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, data, at):
        """(replacement, bytes it stands for) of the longest known prefix at a place, or None."""
        if not self.units or data[at] not in self.starts:
            return None
        base, found = self._jump(0), None
        for k in range(at, len(data)):
            node = self._child(base, data[k])
            if node is None:
                break
            base = self._jump(node)
            if self.units[node] & 256:
                value = self.units[base] & 0x7FFFFFFF
                found = self.pool[value : self.pool.index(b"\0", value)], k + 1 - at
        return found


class PieceModel:
    """Pieces and settings of a model file of merges."""

    def __init__(self, data):
        self.pieces, trainer, normalizer = [], {}, {}
        for field, value in _message(data):
            if field == 1:
                entry = dict(_message(value))
                score = struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0
                self.pieces.append((entry[1].decode(), score, entry.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_message(value))
            elif field == 3:
                normalizer = dict(_message(value))
        if trainer.get(3, 1) != 2 or any(kind in (USER, UNUSED) for _, _, kind in self.pieces):
            raise ValueError("only models of merges without user-defined or unused pieces are supported")
        self.map = CharacterMap(normalizer.get(2, b""))
        self.dummy_prefix, self.trim = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        if trainer.get(24, 0) or not normalizer.get(5, 1):
            raise ValueError("marks after words and unmarked spaces are not supported")
        self.unknown, self.begin, self.end = trainer.get(40, 0), trainer.get(41, 1), trainer.get(42, 2)
        self.unknown_text = trainer.get(44, " ⁇ ".encode())
        self.score = {p: s for p, s, kind in self.pieces if kind == NORMAL}
        self.id = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        byte_ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.byte_id = [byte_ids[f"<0x{b:02X}>"] for b in range(256)] if len(byte_ids) == 256 and trainer.get(35, 0) else None
        self._tables()

    def _tables(self):
        """Neighbours inside pieces as a matrix over the characters that have any; lengths and texts of ids."""
        pairs = {(a, b) for p in self.id for a, b in zip(p, p[1:], strict=False)}
        letters = sorted({c for pair in pairs for c in pair})
        self.place = np.zeros(0x110000, np.int32)
        self.place[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for a, b in pairs:
            self.joined[self.place[ord(a)], self.place[ord(b)]] = True
        texts = []
        for piece, _, kind in self.pieces:
            text = {CONTROL: b"", UNKNOWN: self.unknown_text, BYTE: b"?"}.get(kind, piece.replace(MARK, " ").encode())
            texts.append(bytes([int(piece[3:5], 16)]) if kind == BYTE else text)
        self.texts = np.frombuffer(b"".join(texts), np.uint8)
        self.text_size = np.array([len(t) for t in texts], np.int64)
        self.text_begin = np.cumsum(self.text_size) - self.text_size
        self.is_byte = np.array([kind == BYTE for _, _, kind in self.pieces], bool)
        self.marked = np.array([kind == NORMAL and p.startswith(MARK) for p, _, kind in self.pieces], bool)
        self.silent = np.array([kind == CONTROL for _, _, kind in self.pieces], bool)
        self.points = np.array([len(p) if kind in (NORMAL, UNKNOWN) else 0 for p, _, kind in self.pieces], np.int64)

    def normalised(self, text):
        """The normalised string and the source byte at which each of its characters began, with the end of the text at the end.

        ``text``: UTF-8 bytes. Spaces are marks; with ``trim``, outer spaces go and inner runs become one.
        """
        data, parts, at = text, [], 0
        while at < len(data):
            hit = self.map.longest(data, at)
            size = hit[1] if hit else _char_size(data[at])
            new = (hit[0] if hit else data[at : at + size]).decode()
            parts += [(c, at) for c in new.replace(" ", MARK)]
            at += size
        if self.trim:
            parts = [x for k, x in enumerate(parts) if x[0] != MARK or (k and parts[k - 1][0] != MARK)]
            if parts and parts[-1][0] == MARK:
                parts.pop()
        if not parts:
            return "", np.zeros(1, np.int64)
        if self.dummy_prefix:
            parts.insert(0, (MARK, parts[0][1]))
        return "".join(c for c, _ in parts), np.array([at for _, at in parts] + [len(data)], np.int64)

    def merged(self, part):
        """Ids of a part: characters joined by the best pair until no pair is a piece, then bytes of what is unknown."""
        ids = []
        for text in self._joined_pairs(part) if len(part) <= SHORT else self._joined_by_queue(part):
            known = self.id.get(text)
            if known is not None:
                ids.append(known)
            elif self.byte_id:
                ids += [self.byte_id[b] for b in text.encode()]
            else:
                ids.append(self.unknown)
        return ids

    def _joined_pairs(self, part):
        """The pieces of a short part: the scores of all neighbours in a list, its largest entry first."""
        score, none = self.score.get, -np.inf
        texts = list(part)
        pairs = [score(a + b, none) for a, b in zip(texts, texts[1:], strict=False)]
        while pairs and (best := max(pairs)) != none:
            at = pairs.index(best)
            texts[at : at + 2] = [texts[at] + texts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(texts[at - 1] + texts[at], none)
            if at < len(pairs):
                pairs[at] = score(texts[at] + texts[at + 1], none)
        return texts

    def _joined_by_queue(self, part):
        """The same for a part of any length, with a queue of pairs and links between what is left."""
        texts, queue = list(part), []
        after, before = list(range(1, len(texts) + 1)), list(range(-1, len(texts) - 1))

        def offer(left):
            right = after[left]
            if right < len(texts):
                score = self.score.get(texts[left] + texts[right])
                if score is not None:
                    heapq.heappush(queue, (-score, left, right, len(texts[left]) + len(texts[right])))

        for left in range(len(texts) - 1):
            offer(left)
        while queue:
            _, left, right, size = heapq.heappop(queue)
            if not texts[left] or not texts[right] or len(texts[left]) + len(texts[right]) != size:
                continue  # one of them was joined meanwhile
            texts[left] += texts[right]
            texts[right] = ""
            after[left] = after[right]
            if after[right] < len(texts):
                before[after[right]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return filter(None, texts)


def _char_size(lead):
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def model_path(name=MODEL):
    return vocabulary_path(name)


def load(path):
    """The model and the part encoder of a worker, read once."""
    if path not in _models:
        with open(path, "rb") as file:
            model = PieceModel(file.read())
        _models[path] = model, PartEncoder(model)
    return _models[path]


class PartEncoder(Encoder):
    """The cached encoder of distinct parts, with this module's merges as its word encoder."""

    def __init__(self, model):
        self.library, self.word_encoder = None, model.merged
        self._forget()


class Parts:
    """Normalised texts of a block as code points, cut into parts that no merge crosses; ``source`` has the bytes at which characters began."""

    def __init__(self, model, texts):
        self.odd, self.strings = (), texts
        if model.map.units or model.trim:
            both = [model.normalised(t) for t in texts]
            pieces = [s for s, _ in both]
            self.whole = "".join(pieces)
            self.codes = np.frombuffer(self.whole.encode("utf-32-le"), np.uint32)
            self.lengths = np.array([len(s) for s in pieces], np.int64)
            self.source = np.concatenate([a for _, a in both]) if both else np.zeros(0, np.int64)
        else:
            self._identity(texts, MARK if model.dummy_prefix else "")
        self.row_ends = np.cumsum(self.lengths)
        start = np.ones(len(self.codes), bool)
        place = model.place[self.codes]
        start[1:] = ~model.joined[place[:-1], place[1:]]
        start[(self.row_ends - self.lengths)[self.lengths > 0]] = True
        self.starts = np.flatnonzero(start)
        self.ends = np.append(self.starts[1:], len(self.codes))
        hashes = span_hashes(self.codes, self.starts, self.ends)
        self.distinct, self.first, self.back = np.unique(hashes, return_index=True, return_inverse=True)
        self.word_first = np.append(np.searchsorted(self.starts, self.row_ends - self.lengths), len(self.starts))

    def _identity(self, texts, prefix):
        """An empty map leaves every character, so source places are running sums of the characters' own bytes."""
        strings = [prefix + t.decode() if t else "" for t in texts]
        whole = "".join(strings)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        self.lengths = np.array([len(s) for s in strings], np.int64)
        size = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        first = (np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]
        if prefix:
            size[first] = 0
        before = np.append(0, np.cumsum(size))
        base = before[np.cumsum(self.lengths) - self.lengths] if len(texts) else before[:0]
        row = np.repeat(np.arange(len(texts)), self.lengths + 1)
        place = np.arange(len(row)) - row  # each row has its end as one place more
        self.source = before[place] - base[row]
        self.whole = whole.replace(" ", MARK)
        self.codes = np.where(codes == 32, np.uint32(ord(MARK)), codes)


def ragged(sizes):
    """For runs of these sizes one after the other: the run of each place and its place inside the run."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def encode_block(model, encoder, texts):
    """(ids, begins, ends, bounds) of a list of texts as bytes: source spans of all pieces and where each text's ids begin, one more at the end."""
    parts = Parts(model, texts)
    ids, bounds = encoder.encode_cut(parts)
    ids = ids.astype(np.int64)
    points = model.points[ids]
    if model.byte_id:  # the last byte of a character carries it
        at = np.flatnonzero(model.is_byte[ids])
        value = ids[at] - model.byte_id[0] if model.byte_id == list(range(model.byte_id[0], model.byte_id[0] + 256)) else None
        value = np.array([model.byte_id.index(i) for i in ids[at]], np.int64) if value is None else value
        lead = value & 0xC0 != 0x80
        last = np.ones(len(at), bool)
        last[:-1] = lead[1:] | (np.diff(at) != 1)
        points[at[last]] = 1
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    until = np.cumsum(points) + row  # places of ``source`` have one more at the end of each row
    return ids, parts.source[until - points], parts.source[until], bounds


def decode_block(model, ids, bounds):
    """Texts of rows of ids as (bytes, first byte of each row and one more at the end).

    The mark that the encoder put in front is dropped from the first piece, bytes that form no character become U+FFFD each.
    """
    rows = len(bounds) - 1
    row = np.repeat(np.arange(rows), np.diff(bounds))
    size, begin = model.text_size[ids].copy(), model.text_begin[ids].copy()
    if model.dummy_prefix or model.trim:
        spoken = np.flatnonzero(~model.silent[ids])
        if len(spoken):
            front = spoken[np.append(True, np.diff(row[spoken]) > 0)]
            front = front[model.marked[ids[front]]]
            size[front] -= 1
            begin[front] += 1
    run, inside = ragged(size)
    data = model.texts[begin[run] + inside]
    sizes = np.bincount(row, weights=size, minlength=rows).astype(np.int64)
    edges = np.append(0, np.cumsum(sizes))
    at = np.flatnonzero(model.is_byte[ids])
    if len(at):
        place = np.append(0, np.cumsum(size))
        wrong = _broken_runs(data, place, at, row)
        if wrong:
            return _mended(data, edges, wrong)
    return data, edges


def _broken_runs(data, place, at, row):
    """Runs of byte pieces that are not UTF-8, as (first byte, end byte, row)."""
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(row[at]) != 0)) + 1
    wrong = []
    for some in np.split(at, cut):
        a, b = int(place[some[0]]), int(place[some[-1] + 1])
        try:
            data[a:b].tobytes().decode()
        except UnicodeDecodeError:
            wrong.append((a, b, int(row[some[0]])))
    return wrong


def _mended(data, edges, wrong):
    """The texts again with each byte that belongs to no character replaced."""
    out, last, grown = [], 0, np.zeros(len(edges), np.int64)
    for a, b, row in wrong:
        good, rest = b"", data[a:b].tobytes()
        while rest:
            size = _char_size(rest[0])
            try:
                rest[:size].decode()
                good += rest[:size]
            except UnicodeDecodeError:
                size = 1
                good += "�".encode()
            rest = rest[size:]
        out += [data[last:a].tobytes(), good]
        last = b
        grown[row + 1 :] += len(good) - (b - a)
    return np.frombuffer(b"".join([*out, data[last:].tobytes()]), np.uint8), edges + grown


def with_ends(model, ids, begins, ends, bounds):
    """The same with a begin and an end id around every text, whose spans are empty."""
    rows = len(bounds) - 1
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(rows), sizes)
    place = np.arange(len(ids)) + 2 * row + 1
    new = np.append(0, np.cumsum(sizes + 2))
    full = [np.zeros(new[-1], np.int64) for _ in range(3)]
    full[0][new[:-1]], full[0][new[1:] - 1] = model.begin, model.end
    for whole, values in zip(full, (ids, begins, ends), strict=True):
        whole[place] = values
    last = np.zeros(rows, np.int64)
    last[sizes > 0] = ends[bounds[1:][sizes > 0] - 1]
    full[1][new[1:] - 1] = full[2][new[1:] - 1] = last
    return *full, new


def _packed(values, bounds):
    """Numbers of each row as little-endian unsigned 32-bit bytes, an Arrow column."""
    return _binary(np.ascontiguousarray(values, "<u4").view(np.uint8), 4 * bounds, pa.large_binary()).cast(pa.binary())


def _binary(data, edges, kind):
    buffers = [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(kind, len(edges) - 1, buffers)


def encode_documents(docs, model=None, doc_id="doc_id", text="text"):
    """One row per row of ``docs``: doc_id, ``ids`` with begin and end id, ``begins`` and ``ends`` (the source bytes of each id; all three packed as
    little-endian unsigned 32-bit numbers) and ``decoded``, the text that the ids give back."""
    path = model or model_path()

    def run(batch):
        pieces, encoder = load(path)
        ids, values = batch.column(0), binary_values(batch.column(1))
        for low, high in slices(values):
            coded = encode_block(pieces, encoder, [v or b"" for v in values[low:high]])
            numbers, begins, ends, bounds = with_ends(pieces, *coded)
            decoded = _binary(*decode_block(pieces, numbers, bounds), pa.large_string()).cast(pa.string())
            packed = {k: _packed(v, bounds) for k, v in (("ids", numbers), ("begins", begins), ("ends", ends))}
            yield {"doc_id": ids.slice(low, high - low), **packed, "decoded": decoded}

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, ids binary, begins binary, ends binary, decoded string"
    return per_batch(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, schema)


def encoding_digests(encoded):
    """Per document the number of ids, digests of the ids and of the decoded text, and a checksum of the spans."""
    return encoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.crc32(F.concat("begins", "ends")).alias("spans_crc32"),
    )
