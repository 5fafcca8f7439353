"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of scored pieces.

The pieces come from a model file; nothing is trained. The file is a BPE model: negative merge ranks stand in for log scores. A space is written as the marker U+2581, and one stands before the
text. A piece holds markers at its start alone and joins characters of one group alone, such as Latin letters or signs, so
the best segmentation of a text is that of its units, each a run of markers and the run of one group behind it; a task
remembers short units. Units of a batch are solved together, one array step for each position and piece length, and their
best paths are read off together, one step for each piece. A character that no piece of its own covers becomes its UTF-8 bytes;
a literal U+2581 does too, so decoding gives back every text exactly.
"""

from __future__ import annotations

import re
import struct
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNK_PENALTY = 10.0
#: Units up to this length are solved together; longer ones, such as texts without spaces, one at a time.
BATCHED = 64
#: Units that a task remembers, and their length at most: some 200 bytes each, 800 if all their characters are bytes.
CACHE, CACHED = 200_000, 32
#: Ids that are decoded in one array step.
DECODED = 1 << 16


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: (number, value)."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, i = varint(i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


class DoubleArray:
    """A trie in two arrays: state ``s`` goes by code ``c`` to ``t = base[s] + c`` if ``check[t] == s``."""

    def __init__(self, words: list[tuple[list[int], int]], codes: int):
        trie: list[dict[int, int]] = [{}]
        ends = {}
        for word, value in words:
            node = 0
            for c in word:
                if c not in trie[node]:
                    trie[node][c] = len(trie)
                    trie.append({})
                node = trie[node][c]
            ends[node] = value
        size = 2 * len(trie) + 2 * codes + 2
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0], free, top = -2, 1, 1
        queue = deque([(0, 0)])  # node, state
        while queue:
            node, state = queue.popleft()
            value[state] = ends.get(node, -1)
            kids = sorted(trie[node])
            if not kids:
                continue
            while check[free] != -1:
                free += 1
            at, tries = max(free, kids[0] + 1), 0
            while True:
                if at + codes >= size:
                    for array, fill in ((base, 0), (check, -1), (value, -1)):
                        array.extend([fill] * (at + codes))
                    size += at + codes
                if all(check[at - kids[0] + c] == -1 for c in kids):
                    break
                tries += 1
                at = at + 1 if tries < 64 else max(at, top) + 1  # beyond all that is used, so a place is found soon
            base[state], top = at - kids[0], max(top, at - kids[0] + kids[-1])
            for c in kids:
                check[base[state] + c] = state
                queue.append((trie[node][c], base[state] + c))
        end = max(i for i, c in enumerate(check) if c != -1) + codes + 2
        self.base, self.check, self.value = (np.array((a + [f] * codes)[:end], dtype=np.int32) for a, f in ((base, 0), (check, -1), (value, -1)))


def _units(pieces: list[str]) -> re.Pattern:
    """Units of a text: no piece reaches across the end of one.

    Two characters are of one group if a chain of neighbours within ``pieces`` leads from one to the other. Groups of 16 and
    more characters are runs of their own; all others share one kind of run.
    """
    group: dict[str, list[str]] = {}
    for piece in pieces:
        for c in (word := piece.lstrip(MARK)):
            if (mine := group.setdefault(c, [c])) is not (first := group[word[0]]):
                less, more = sorted((mine, first), key=len)
                more.extend(less)
                group.update(dict.fromkeys(less, more))
    large = ["".join(map(re.escape, sorted(g))) for g in {id(g): g for g in group.values()}.values() if len(g) >= 16]
    return re.compile(" *(?:" + "".join(f"[{g}]+|" for g in large) + f"[^ {''.join(large)}]+)| +")


class Pieces:
    """A model's pieces, their scores, and the trie over them."""

    def __init__(self, model: bytes):
        rows = []
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                rows.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0" * 4))[0], piece.get(3, NORMAL)))
        self.texts = [t for t, _, _ in rows]
        plain = [(i, t) for i, (t, _, kind) in enumerate(rows) if kind in (NORMAL, USER)]
        if any(MARK in t.lstrip(MARK) for _, t in plain):
            raise ValueError("a piece holds a marker after other characters, so texts can't be cut at markers")
        self.units = _units([t for _, t in plain])
        self.bytes = {int(t[3:5], 16): i for i, (t, _, kind) in enumerate(rows) if kind == BYTE}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        self.scores = np.array([s for _, s, _ in rows])
        self.unknown = min(s for _, s, kind in rows if kind == NORMAL) - UNK_PENALTY
        alphabet = sorted({c for _, t in plain for c in t.replace(MARK, " ")})
        self.code = np.full(0x110000, -1, dtype=np.int32)
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.longest = max(len(t) for _, t in plain)
        self.trie = DoubleArray([(self.code[[ord(c) for c in t.replace(MARK, " ")]].tolist(), i) for i, t in plain], len(alphabet) + 1)
        #: What a piece decodes to; control and unknown pieces decode to nothing.
        output = [bytes([int(t[3:5], 16)]) if kind == BYTE else t.replace(MARK, " ").encode() if kind in (NORMAL, USER) else b"" for t, _, kind in rows]
        self.output = np.frombuffer(b"".join(output), dtype=np.uint8)
        self.output_sizes = np.array([len(o) for o in output])
        self.output_starts = np.cumsum(self.output_sizes) - self.output_sizes

    def _ids(self, unit: str, starts: list[int], pieces: list[int]) -> bytes:
        """The pieces on the best path to the end, as little-endian ints; ``starts[e]`` and ``pieces[e]`` end at ``e``."""
        out, end = [], len(unit)
        while end:
            start = starts[end]
            if pieces[end] >= 0:
                out.append(pieces[end])
            else:
                out.extend(self.bytes[b] for b in reversed(unit[start:end].encode("utf-8", "surrogatepass")))
            end = start
        return np.array(out[::-1], dtype="<i4").tobytes()

    def solve(self, units: list[str]) -> list[bytes]:
        """Best segmentation of each unit. On ties the piece that starts first wins."""
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        order = np.argsort(sizes, kind="stable")
        short = int(np.searchsorted(sizes[order], BATCHED, side="right"))
        order = order.tolist()
        out: list[bytes] = [b""] * len(units)
        for at in range(0, short, 4096):
            some = order[at : min(at + 4096, short)]
            for i, ids in zip(some, self._together([units[i] for i in some])):
                out[i] = ids
        for i in order[short:]:
            out[i] = self._ids(units[i], *self._path(units[i]))
        return out

    def _codes(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]

    def _together(self, units: list[str]) -> list[bytes]:
        """What ``_ids`` and ``_path`` give for each of ``units``, which come in order of length."""
        sizes = np.array([len(u) for u in units])
        starts, pieces = self._paths(units, sizes)
        passed = np.zeros(starts.T.shape, dtype=bool)  # ends of pieces on the best paths
        rows, ends = np.arange(len(units)), sizes
        while (on := ends > 0).any():
            rows, ends = rows[on], ends[on]
            passed[rows, ends] = True
            ends = starts[ends, rows]
        rows, ends = np.nonzero(passed)
        ids = pieces[ends, rows]
        if (alone := ids < 0).any():
            utf8 = [units[r][e - 1].encode("utf-8", "surrogatepass") for r, e in zip(rows[alone].tolist(), ends[alone].tolist())]
            width = np.ones(len(ids), dtype=np.int64)
            width[alone] = [len(u) for u in utf8]
            rows, ids, alone = np.repeat(rows, width), np.repeat(ids, width), np.repeat(alone, width)
            ids[alone] = [self.bytes[b] for b in b"".join(utf8)]
        data = ids.astype("<i4").tobytes()
        cuts = [0, *(4 * np.cumsum(np.bincount(rows, minlength=len(units)))).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _paths(self, units: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``_path`` of each unit, a column each. Code 0 leads nowhere; it stands for the end and for characters of no piece."""
        n, width = len(units), int(sizes[-1])
        codes = np.zeros((n, width + 1), dtype=np.int32)
        codes[np.arange(width + 1) < sizes[:, None]] = np.maximum(self._codes("".join(units)), 0)
        codes = np.ascontiguousarray(codes.T)
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        starts, pieces = np.zeros((width + 1, n), dtype=np.int32), np.full((width + 1, n), -1, dtype=np.int32)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        for i in range(width):
            first = int(np.searchsorted(sizes, i, side="right"))
            rows, state, alone = np.arange(first, n), np.zeros(n - first, dtype=np.int32), np.ones(n, dtype=bool)
            alone[:first] = False
            for end in range(i + 1, min(width, i + self.longest) + 1):
                then = base[state] + codes[end - 1][rows]
                on = np.flatnonzero(check[then] == state)
                if not len(on):
                    break
                rows, state = rows[on], then[on]
                found = value[state]
                hit = np.flatnonzero(found >= 0)
                r, p = rows[hit], found[hit]
                if end == i + 1:
                    alone[r] = False
                score = best[i][r] + scores[p]
                better = np.flatnonzero(score > best[end][r])
                r = r[better]
                best[end][r], starts[end][r], pieces[end][r] = score[better], i, p[better]
            r = np.flatnonzero(alone)
            r = r[best[i][r] + self.unknown > best[i + 1][r]]
            best[i + 1][r], starts[i + 1][r], pieces[i + 1][r] = best[i][r] + self.unknown, i, -1
        return starts, pieces

    def _path(self, unit: str) -> tuple[list[int], list[int]]:
        codes = self._codes(unit).tolist()
        base, check, value, scores = self._lists()
        n = len(codes)
        best, starts, pieces = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            state, alone, here = 0, True, best[i]
            for end in range(i + 1, n + 1):
                code = codes[end - 1]
                then = base[state] + code
                if code < 0 or check[then] != state:
                    break
                state = then
                if (p := value[state]) >= 0:
                    alone = alone and end > i + 1
                    if here + scores[p] > best[end]:
                        best[end], starts[end], pieces[end] = here + scores[p], i, p
            if alone and here + self.unknown > best[i + 1]:
                best[i + 1], starts[i + 1], pieces[i + 1] = here + self.unknown, i, -1
        return starts, pieces

    def _lists(self):
        if not hasattr(self, "_as_lists"):
            self._as_lists = tuple(a.tolist() for a in (self.trie.base, self.trie.check, self.trie.value, self.scores))
        return self._as_lists

    def encode(self, texts: list[str], cache: dict[str, bytes]) -> list[np.ndarray]:
        cut = [self.units.findall(" " + t) if t else [] for t in texts]
        known = [list(map(cache.get, units)) for units in cut]
        new = list({u for units, found in zip(cut, known) for u, ids in zip(units, found) if ids is None})
        solved = dict(zip(new, self.solve(new)))
        if len(cache) + len(new) > CACHE:
            cache.clear()
        if len(new) <= CACHE:
            cache.update((u, ids) for u, ids in solved.items() if len(u) <= CACHED)
        return [
            np.frombuffer(b"".join([solved[u] if ids is None else ids for u, ids in zip(units, found)]), dtype="<i4") for units, found in zip(cut, known)
        ]

    def decode(self, ids: np.ndarray) -> str:
        parts = []
        for at in range(0, len(ids), DECODED):
            some = ids[at : at + DECODED]
            sizes = self.output_sizes[some]
            ends = np.cumsum(sizes)
            parts.append(self.output[np.repeat(self.output_starts[some] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        data = b"".join(parts)
        return data[1 if data[:1] == b" " else 0 :].decode("utf-8", "replace")


def _model(spark, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(Pieces(f.read()))  # the size of a vocabulary, whatever the input


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model_path: str = MODEL, carry: tuple[str, ...] = (), decoded: bool = False
) -> DataFrame:
    """``(id, piece_ids, n_fallback)`` and the columns of ``carry``, for every row of ``docs``.

    ``decoded`` adds ``text``, what the ids decode to, in the same pass: one Python worker a task instead of two.

    ``n_fallback`` counts the byte pieces. A null or empty text has no pieces. Repeated rows and null ids each come out; an
    empty table gives no rows. Other columns are not read. A name in ``carry`` must not be one of the three.
    """
    source = only(docs, id=id_col, text=text_col, **{c: c for c in carry})
    model = _model(docs.sparkSession, model_path)
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = f"id {kinds['id']}, piece_ids array<int>, n_fallback bigint" + "".join(f", `{c}` {kinds[c]}" for c in carry) + ", text string" * decoded
    names = ["id", "piece_ids", "n_fallback", *carry] + ["text"] * decoded

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, cache = model.value, {}
        fallback = np.zeros(len(pieces.texts), dtype=bool)
        fallback[list(pieces.bytes.values())] = True
        for whole in batches:
            for at in range(0, len(whole), 128):
                batch = whole.slice(at, 128)
                ids = pieces.encode([t or "" for t in batch.column(1).to_pylist()], cache)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                n = pa.array([int(fallback[i].sum()) for i in ids], pa.int64())
                texts = [pa.array([pieces.decode(i) for i in ids], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, n, *(batch.column(2 + i) for i in range(len(carry))), *texts], names)

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids_col: str = "piece_ids", *, model_path: str = MODEL) -> DataFrame:
    """Replace the column of piece ids by the ``text`` that it decodes to; null ids give an empty text."""
    rest = [c for c in encoded.columns if c != ids_col]
    if "text" in rest:
        raise ValueError("the encoded table has a column named text already")
    model = _model(encoded.sparkSession, model_path)
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in rest) + ", text string"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model.value
        for batch in batches:
            texts = [pieces.decode(v.values.to_numpy() if v.is_valid else np.empty(0, np.int32)) for v in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), pa.array(texts, pa.string())], [*rest, "text"])

    return encoded.select(*(f"`{c}`" for c in rest), f"`{ids_col}`").mapInArrow(run, schema)
