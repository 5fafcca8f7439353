"""Suffix-array dedup: remove every byte that a repeated string covers, keeping the copy of the smallest id.

A string of ``length`` bytes is repeated if it also starts in a row of a smaller id. All positions of all texts are judged,
but only suffixes that can repeat are sorted:

1. Texts are packed into batches of a few MB, written once.
2. A string's key is the least hash of the grams in it, so equal strings have equal keys, and a key lasts for a run of
   neighbouring positions. A batch sends its different keys, five bytes each, to the parts that own them; a part answers
   with the keys that another batch holds too. A batch's texts stay in their bucket, and answers come to them.
3. A batch cuts out the runs whose keys occur elsewhere, or in two of its own texts, and sends their bytes to the key's
   part. Of equal runs in a batch only those of the smallest id travel; the others are repeated for certain.
4. A part sorts the suffixes of its runs up to ``length`` bytes by deep-shallow sorting (Manzini and Ferragina, 2004):
   multikey quicksort on eight-byte characters down to ``SHALLOW`` bytes, then a blind trie over each group that is
   still together. Leaves of more than one suffix are repeated strings; the smallest id keeps them.
5. Ranges go back to their batches, which cut them out and digest what stays.

Texts meet batch by batch, whatever their keys, so a popular text or source makes no partition larger. A key that more than
``HOT_BATCHES`` batches hold, and whose different runs would weigh more than a batch in its part, is dealt otherwise: its strings go one by one, each to the part of its own hash, and of equal
strings of a batch only those of the smallest id. First their hashes alone, five bytes each, so a string that no other batch
holds goes no further. The others meet in two levels, among the batches of a group and then among the groups, with as many
groups as batches in a group, so a part gets a popular string at most as often as the square root of the number of batches
(and once more for each repeat within the text of the smallest id).
"""

from __future__ import annotations

import hashlib
import os
import pickle
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, only, shuffle_partitions

BATCH_BYTES = 8 << 20
#: Bytes hashed at a time.
CHUNK = 1 << 18
SHALLOW = 16
#: Low bits of a key that are sent; the bits above choose the part.
LOW_BITS = 40
PART_BYTES = 64 << 20
#: A key that more batches hold is dealt string by string if its runs are more than ``hot_batches / HOT_BATCHES`` of a batch
#: in bytes. Strings weigh more than runs, so only keys whose runs could fill a task are worth it; a line that all batches
#: have is one run of each.
HOT_BATCHES = 256
#: A batch weighs the runs of a key of which it has more, and otherwise takes them for one of twice the length.
WEIGHED_RUNS = 16
SORT_AT_ONCE = 1 << 20


def _pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def _unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _words(buffer: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes at every position of a byte array, as unaligned views."""
    return np.ndarray((max(0, len(buffer) - 7),), f"{order}u8", buffer, 0, (1,))


def window_keys(buffer: np.ndarray, length: int) -> np.ndarray:
    """Key of the string of ``length`` bytes at each position: the least hash of its grams."""
    gram = min(16, max(8, length // 3))
    if len(buffer) < length:
        return np.empty(0, dtype=np.uint64)
    words = _words(buffer, "<")
    n = len(buffer) - gram + 1
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= words[gram - 8 :][:n] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if width > have:
        h = np.minimum(h[: have - width], h[width - have :])
    return h


class Batch:
    """Texts of a batch, one after the other, with the key runs of those that have an id."""

    def __init__(self, blob: bytes, ids: np.ndarray, sizes: np.ndarray, named: np.ndarray, length: int):
        self.ids, self.sizes = ids, sizes
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.buffer = np.frombuffer(blob, dtype=np.uint8)
        self.length = length
        keys, starts, stops = [], [], []
        for a in range(0, len(self.buffer), CHUNK):
            key = window_keys(self.buffer[a : a + CHUNK + length - 1], length)
            if not len(key):
                break
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            keys.append(key[cut])
            starts.append(cut + a)
            stops.append(np.append(cut[1:], len(key)) + a)
        none = np.empty(0, dtype=np.int64)
        key, start, stop = (np.concatenate(x) if x else none for x in (keys, starts, stops))
        # A run may reach over the end of a text: it is cut into the parts that lie in one text and fit into it.
        first = np.searchsorted(self.ends, start, side="right")
        last = np.searchsorted(self.ends, stop - 1, side="right")
        spread = last - first + 1
        run = np.repeat(np.arange(len(start)), spread)
        text = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(spread) - spread, spread)
        start = np.maximum(start[run], self.starts[text])
        stop = np.minimum(stop[run], self.ends[text] - length + 1)
        keep = (stop > start) & named[text]
        self.key, self.text, self.start, self.stop = key[run][keep].astype(np.uint64), text[keep], start[keep], stop[keep]


def run_weights(b: Batch, weighed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of a batch, and how many bytes the different runs of each have beyond what any key counts for."""
    order = np.argsort(b.key, kind="stable")
    new = np.flatnonzero(np.concatenate(([True], b.key[order][1:] != b.key[order][:-1]))) if len(order) else order
    keys, count = b.key[order][new], np.diff(np.append(new, len(order)))
    weight = np.zeros(len(keys), dtype=np.int64)
    data = b.buffer.tobytes() if weighed else b""
    for k in np.flatnonzero(count > WEIGHED_RUNS).tolist() if weighed else ():
        runs = order[new[k] : new[k] + count[k]]
        seen = {data[s : e + b.length - 1] for s, e in zip(b.start[runs].tolist(), b.stop[runs].tolist())}
        weight[k] = max(0, sum(map(len, seen)) - 2 * b.length)
    return keys, weight


def _weights(weight: np.ndarray | None = None) -> bytes:
    """Places and values of the weights that are not 0, before a part's keys."""
    some = np.flatnonzero(weight) if weight is not None else np.empty(0, np.int64)
    return len(some).to_bytes(4, "little") + (np.stack([some, weight[some]], axis=1).astype("<u4").tobytes() if len(some) else b"")


def string_hashes(buffer: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of the whole string of ``length`` bytes at each place."""
    words, h = _words(buffer, "<"), np.zeros(len(at), dtype=np.uint64)
    for offset in [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else []):
        h = (h ^ words[at + offset]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def least_of_equal(buffer: np.ndarray, at: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Whether no equal string among those at ``at`` has a smaller id, for each of them."""
    first = np.ones(len(at), dtype=bool)
    order, starts = equal_groups(buffer, at, length) if len(at) else (at, at)
    if len(order):
        owner = ids[order]
        least = np.repeat(np.minimum.reduceat(owner, starts), np.diff(np.append(starts, len(order))))
        first[order[owner > least]] = False
    return first


def _parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(LOW_BITS)) % np.uint64(parts)).astype(np.int64)


def _slices(parts: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Sorted part numbers as (part, slice)."""
    cuts = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1]))) if len(parts) else np.empty(0, np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(parts))):
        yield int(parts[a]), slice(int(a), int(b))


def equal_groups(buffer: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow sort of the suffixes at ``at``, compared up to ``length`` bytes: their order, and starts in it of
    groups of equal strings; strings that occur once are left out."""
    words = _words(buffer, ">")
    offsets = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    shallow = [o for o in offsets if o < SHALLOW]
    order, group = np.arange(len(at)), np.zeros(len(at), dtype=np.int64)

    def split(order: np.ndarray, group: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sort each group by a character of eight bytes; suffixes that end up alone are done and leave."""
        o = np.lexsort((word, group)) if group[-1] else np.argsort(word, kind="stable")
        word, group, order = word[o], group[o], order[o]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (word[1:] != word[:-1])))
        alone = new & np.append(new[1:], True)
        return order[~alone], (np.cumsum(new) - 1)[~alone]

    for offset in shallow:
        if not len(order):
            break
        order, group = split(order, group, words[at[order] + offset].astype(np.uint64))
    # Blind tries, all groups at once: a node looks for the first character in which its suffixes differ, skipping those
    # they share, and branches there; a node without one is a leaf of equal strings.
    leaves_order, leaves_group, named = [], [], 0
    deep = [o for o in offsets if o >= SHALLOW]
    while len(order):
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        number = np.cumsum(np.concatenate(([0], group[1:] != group[:-1])))
        leader = at[order[starts]][number]
        branch = np.full(len(starts), -1)
        for i, offset in enumerate(deep):
            open_ = branch[number] < 0
            differs = np.zeros(len(order), dtype=bool)
            mine = at[order[open_]]
            differs[open_] = words[mine + offset] != words[leader[open_] + offset]
            some = np.logical_or.reduceat(differs, starts)
            branch[some & (branch < 0)] = i
        leaf = branch[number] < 0
        if leaf.any():
            leaves_order.append(order[leaf])
            leaves_group.append(number[leaf] + named)
            named += len(starts)
        order, number = order[~leaf], number[~leaf]
        if not len(order):
            break
        character = words[at[order] + np.array(deep)[branch[number]]].astype(np.uint64)
        order, group = split(order, number, character)
    if not leaves_order:
        none = np.empty(0, dtype=np.int64)
        return none, none
    order, group = np.concatenate(leaves_order), np.concatenate(leaves_group)
    return order, np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Rows (part, batch, payload), sorted by part, as (part, [(batch, payload)])."""
    now, held = None, []
    for batch in batches:
        for part, number, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if part != now and held:
                yield now, held
                held = []
            now = part
            held.append((number, payload))
    if held:
        yield now, held


def _out(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)


_PAYLOAD = "part bigint, batch bigint, payload binary"
_SORTED = (["batch", "ranges", "part", "payload"], [pa.int64(), pa.binary(), pa.int64(), pa.binary()])
_ROW = (["part", "batch", "payload"], [pa.int64(), pa.int64(), pa.binary()])


def pack_batches(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``(batch, n_bytes, ids, named, sizes, digests, blob)``: neighbouring rows ``(id, text)`` packed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, named, texts, size = [], [], [], 0
        names = ["batch", "n_bytes", "ids", "named", "sizes", "digests", "blob"]
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary()]

        def out() -> pa.RecordBatch:
            number = int.from_bytes(os.urandom(8), "little") >> 1
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            row = (number, size, list(ids), list(named), [len(t) for t in texts], [hashlib.sha256(t).digest() for t in texts], blob)
            for x in (ids, named, texts):
                x.clear()
            return _out([row], names, types)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = t.as_buffer().to_pybytes() if t.is_valid else b""
                if texts and size + len(data) > batch_bytes:
                    yield out()
                    size = 0
                ids.append(i or 0)
                named.append(i is not None)
                texts.append(data)
                size += len(data)
        if texts:
            yield out()

    schema = "batch bigint, n_bytes bigint, ids array<bigint>, named array<boolean>, sizes array<bigint>, digests array<binary>, blob binary"
    return docs.mapInArrow(run, schema)


def _batch(row: dict, length: int) -> Batch:
    blob = zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=max(1, row["n_bytes"]))
    return Batch(blob, np.array(row["ids"], np.int64), np.array(row["sizes"], np.int64), np.array(row["named"], bool), length)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def repeated_ranges(packed: DataFrame, length: int, parts: int, groups: int, scratch: Scratch, sort_at_once: int = SORT_AT_ONCE, hot_batches: int = HOT_BATCHES, hot_bytes: int = BATCH_BYTES) -> DataFrame:
    """``(batch, ranges)``: for each batch packed arrays (text, start, stop) of repeated bytes."""
    weighed = groups * groups > hot_batches  # with fewer batches no key is hot
    n = shuffle_partitions(packed.sparkSession)
    body = packed.select("batch", "n_bytes", "ids", "named", "sizes", "blob")

    def send_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            keys, weight = run_weights(_batch(row, length), weighed)
            part = _parts_of(keys, parts)
            order = np.argsort(part, kind="stable")
            keys, part, weight = keys[order], part[order], weight[order]
            low = keys.view(np.uint8).reshape(-1, 8)[:, :5]
            yield _out([(p, row["batch"], _weights(weight[s]) + np.ascontiguousarray(low[s]).tobytes()) for p, s in _slices(part)], *_ROW)

    def answer_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _by_part(batches):
            heavy = [np.frombuffer(p, "<u4", 2 * int.from_bytes(p[:4], "little"), 4).reshape(-1, 2) for _, p in held]
            bodies = [p[4 + h.nbytes :] for h, (_, p) in zip(heavy, held)]
            sizes = [len(p) // 5 for p in bodies]
            low = np.zeros((sum(sizes), 8), dtype=np.uint8)
            low[:, :5] = np.frombuffer(b"".join(bodies), dtype=np.uint8).reshape(-1, 5)
            low = low.view("<u8").ravel()
            known, place, count = np.unique(low, return_inverse=True, return_counts=True)
            weight = count * 2 * length
            for h, start in zip(heavy, np.cumsum([0, *sizes])):
                np.add.at(weight, place[start + h[:, 0].astype(np.int64)], h[:, 1].astype(np.int64))
            hit, hot, rows, at = np.isin(low, known[count > 1]), np.isin(low, known[(count > hot_batches) & (weight > hot_bytes)]), [], 0
            for (number, _), size in zip(held, sizes):
                mine, often = low[at : at + size][hit[at : at + size]], hot[at : at + size][hit[at : at + size]]
                at += size
                if len(mine):
                    found = np.concatenate((mine[~often], mine[often]))
                    keys = np.ascontiguousarray(found.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
                    rows.append((part, number, int(often.sum()).to_bytes(4, "little") + keys))
            yield _out(rows, *_ROW)

    dealt = lambda df: df.repartition(n, "part").sortWithinPartitions("part")
    answers = dealt(body.mapInArrow(send_keys, _PAYLOAD)).mapInArrow(answer_keys, _PAYLOAD)
    answers = answers.groupBy("batch").agg(F.collect_list(F.struct("part", "payload")).alias("shared"))

    def sent_strings(number: int, data: np.ndarray, at, ids, text, start, to) -> list[tuple]:
        """Rows of single strings for the places ``to``: beyond ``parts`` those of the first level."""
        order = np.argsort(to, kind="stable")
        rows = []
        for p, s in _slices(to[order]):
            o = order[s]
            content = data[at[o][:, None] + np.arange(length)].tobytes()
            rows.append((p, number, b"S" + _pack(ids[o], text[o], start[o].astype(np.int32), content)))
        return rows

    def received_strings(held: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
        """Bytes, ids, texts, starts and batches of the single strings among a part's rows."""
        sent = [(number, _unpack(p[1:])) for number, p in held if p[:1] == b"S"]
        data = np.frombuffer(b"".join(x[3] for _, x in sent), dtype=np.uint8)
        none = [np.empty(0, dtype=np.int64)]
        ids, text, start = (np.concatenate([x[i] for _, x in sent] or none) for i in range(3))
        return data, ids, text, start.astype(np.int64), np.repeat([b for b, _ in sent], [len(x[0]) for _, x in sent]).astype(np.int64)

    def unpack_answers(shared: list | None) -> dict[int, tuple[np.ndarray, int]]:
        """Keys by part, those of few batches first, and how many these are."""
        out = {}
        for x in shared or []:
            raw = np.zeros((len(x["payload"]) // 5, 8), dtype=np.uint8)
            raw[:, :5] = np.frombuffer(x["payload"], dtype=np.uint8, offset=4).reshape(-1, 5)
            out[x["part"]] = raw.view("<u8").ravel(), len(raw) - int.from_bytes(x["payload"][:4], "little")
        return out

    def answered(b: Batch, shared: list | None) -> tuple[np.ndarray, np.ndarray]:
        """Whether the key of each run is held by other batches, by few and by many."""
        part, low = _parts_of(b.key, parts), b.key & np.uint64((1 << LOW_BITS) - 1)
        few, many = np.zeros(len(b.key), dtype=bool), np.zeros(len(b.key), dtype=bool)
        known, order = unpack_answers(shared), np.argsort(part, kind="stable")
        for p, s in _slices(part[order]):
            if p in known:
                some, (keys, plain) = order[s], known[p]
                few[some] = np.isin(low[some], keys[:plain])
                many[some] = np.isin(low[some], keys[plain:])
        return few, many

    def hot_strings(b: Batch, runs: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Place, id, text and start of the strings of some runs, and whether each is the first among equal ones here; all
        strings of a key together, and as many keys at a time as make ``sort_at_once`` strings, one at least."""
        runs = runs[np.argsort(b.key[runs], kind="stable")]
        done = np.append(0, np.cumsum(b.stop[runs] - b.start[runs]))
        ends = np.append(np.flatnonzero(b.key[runs][1:] != b.key[runs][:-1]) + 1, len(runs))
        a = 0
        while a < len(runs):
            later = ends[ends > a]
            fits = later[done[later] - done[a] <= sort_at_once]
            e = int(fits[-1] if len(fits) else later[0])
            some = runs[a:e]
            count = b.stop[some] - b.start[some]
            run = np.repeat(some, count)
            at = b.start[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
            text = b.text[run]
            yield at, b.ids[text], text, at - b.starts[text], least_of_equal(b.buffer, at, b.ids[text], length)
            a = e

    def send_hot_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if not any(x["payload"][:4] != b"\0\0\0\0" for x in row["shared"] or []):
                continue
            b = _batch(row, length)
            runs = np.flatnonzero(answered(b, row["shared"])[1])
            keys = [np.unique(string_hashes(b.buffer, at[first], length)) for at, *_, first in hot_strings(b, runs)]
            keys = np.unique(np.concatenate(keys)) if keys else b.key[:0]
            part = _parts_of(keys, parts)
            order = np.argsort(part, kind="stable")
            low = keys[order].view(np.uint8).reshape(-1, 8)[:, :5]
            yield _out([(p, row["batch"], _weights() + np.ascontiguousarray(low[s]).tobytes()) for p, s in _slices(part[order])], *_ROW)

    def send_hot(number: int, b: Batch, runs: np.ndarray, shared: list | None) -> Iterator[pa.RecordBatch]:
        """The strings of runs with hot keys: the first among equal ones, if another batch holds them, go to the first level."""
        known = unpack_answers(shared) if len(runs) else {}
        for at, ids, text, start, first in hot_strings(b, runs):
            lost = ~first
            local = [(number % parts, number, b"L" + _pack(text[lost].astype(np.int64), start[lost], start[lost] + length))] if lost.any() else []
            go = np.flatnonzero(first)
            key = string_hashes(b.buffer, at[go], length)
            part, low, elsewhere = _parts_of(key, parts), key & np.uint64((1 << LOW_BITS) - 1), np.zeros(len(go), dtype=bool)
            order = np.argsort(part, kind="stable")
            for p, s in _slices(part[order]):
                if p in known:
                    elsewhere[order[s]] = np.isin(low[order[s]], known[p][0])
            go, part = go[elsewhere], part[elsewhere]
            to = parts + (part * groups + number % groups) % parts
            sent = sent_strings(number, b.buffer, at[go], ids[go], text[go].astype(np.int32), start[go], to)
            yield _out(local + sent, *_ROW)

    def thin(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        """First level of hot strings: those with an equal one of a smaller id are repeated; the others go on."""
        data, ids, text, start, number = received_strings(held)
        at = np.arange(len(ids)) * length
        part = _parts_of(string_hashes(data, at, length), parts)
        first = least_of_equal(data, at, ids, length)
        order = np.argsort(number, kind="stable")
        rows = []
        for b, s in _slices(number[order]):
            o = order[s]
            lost, on = o[~first[o]], o[first[o]]
            if len(lost):
                rows.append((b, _pack(text[lost].astype(np.int64), start[lost], start[lost] + length), None, None))
            rows += [(b, None, p, payload) for p, _, payload in sent_strings(b, data, at[on], ids[on], text[on], start[on], part[on])]
        return _out(rows, *_SORTED)

    def send_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = _batch(row, length)
            part, low = _parts_of(b.key, parts), b.key & np.uint64((1 << LOW_BITS) - 1)
            kept, often = answered(b, row["shared"])
            # Keys of two texts of this batch.
            pairs = np.unique(np.stack([b.key, b.text.astype(np.uint64)], axis=1), axis=0)[:, 0] if len(b.key) else b.key
            kept |= np.isin(b.key, pairs[1:][pairs[1:] == pairs[:-1]])
            yield from send_hot(row["batch"], b, np.flatnonzero(often), row["again"])
            runs = np.flatnonzero(kept & ~often)
            if not len(runs):
                continue
            data = b.buffer.tobytes()
            content = [data[s : e + length - 1] for s, e in zip(b.start[runs].tolist(), b.stop[runs].tolist())]
            ids = b.ids[b.text[runs]]
            least: dict[bytes, int] = {}
            for c, i in zip(content, ids.tolist()):
                if least.get(c, i) >= i:
                    least[c] = i
            smallest = np.array([least[c] for c in content])
            local = runs[ids > smallest]
            rows = []
            if len(local):
                found = (b.text[local], b.start[local] - b.starts[b.text[local]], b.stop[local] + length - 1 - b.starts[b.text[local]])
                rows.append((int(row["batch"] % parts), row["batch"], b"L" + _pack(*found)))
            go = np.flatnonzero(ids == smallest)
            go = go[np.argsort(part[runs[go]], kind="stable")]
            for p, s in _slices(part[runs[go]]):
                some = go[s]
                r = runs[some]
                sent = (low[r], ids[some], b.text[r].astype(np.int32), b.start[r] - b.starts[b.text[r]], b.stop[r] - b.start[r], b"".join(content[i] for i in some.tolist()))
                rows.append((p, row["batch"], b"R" + _pack(*sent)))
            yield _out(rows, *_ROW)

    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at_part, held in _by_part(batches):
            if at_part >= parts:
                yield thin(held)
                continue
            yield _out([(number, p[1:], None, None) for number, p in held if p[:1] == b"L"], *_SORTED)
            data, ids, text, start, number = received_strings(held)
            if len(ids):
                lost = ~least_of_equal(data, np.arange(len(ids)) * length, ids, length)
                text, start, number = text[lost], start[lost], number[lost]
                order = np.argsort(number, kind="stable")
                spans = [(b, text[order[s]].astype(np.int64), start[order[s]]) for b, s in _slices(number[order])]
                yield _out([(b, _pack(t, at, at + length), None, None) for b, t, at in spans], *_SORTED)
            sent = [(number, _unpack(p[1:])) for number, p in held if p[:1] == b"R"]
            del held
            if not sent:
                continue
            key, ids, text, start, count = (np.concatenate([x[i] for _, x in sent]) for i in range(5))
            number = np.repeat([b for b, _ in sent], [len(x[0]) for _, x in sent])
            buffer = np.frombuffer(b"".join(x[5] for _, x in sent), dtype=np.uint8)
            begin = np.cumsum(count + length - 1) - (count + length - 1)
            del sent
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
            found = []
            done = np.concatenate(([0], np.cumsum(count[order])))
            a = 0
            while a < len(order):  # as many keys at a time as make a million suffixes, one at least
                later = cuts[cuts > a]
                fits = later[done[later] - done[a] <= sort_at_once]
                e = int(fits[-1]) if len(fits) else int(later[0]) if len(later) else len(order)
                e = len(order) if done[-1] - done[a] <= sort_at_once else e
                found.append(_repeats(buffer, order[a:e], begin, count, ids, length))
                a = e
            run, first, last = (np.concatenate(x) for x in zip(*found))
            by = np.argsort(number[run], kind="stable")
            rows = []
            run, first, last = run[by], first[by], last[by]
            for b, s in _slices(number[run]):
                r = run[s]
                rows.append((b, _pack(text[r].astype(np.int64), start[r] + first[s], start[r] + last[s] + length), None, None))
            yield _out(rows, *_SORTED)

    asked = body.join(answers, "batch", "left").select(*body.columns, "shared")
    again = dealt(asked.mapInArrow(send_hot_keys, _PAYLOAD)).mapInArrow(answer_keys, _PAYLOAD)
    again = again.groupBy("batch").agg(F.collect_list(F.struct("part", "payload")).alias("again"))
    asked = asked.join(again, "batch", "left").select(*asked.columns, "again")
    schema = "batch bigint, ranges binary, part bigint, payload binary"
    once = scratch.write(dealt(asked.mapInArrow(send_runs, _PAYLOAD)).mapInArrow(sort_runs, schema))
    again = dealt(once.where("part is not null").select("part", "batch", "payload")).mapInArrow(sort_runs, schema)
    return once.where("ranges is not null").unionByName(again).select("batch", "ranges")


def _repeats(buffer, runs, begin, count, ids, length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated strings of some runs: run, and the first and last of neighbouring places within it."""
    which = np.repeat(runs, count[runs])
    place = np.arange(len(which)) - np.repeat(np.cumsum(count[runs]) - count[runs], count[runs])
    order, starts = equal_groups(buffer, begin[which] + place, length)
    if not len(order):
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    owner = ids[which[order]]
    least = np.repeat(np.minimum.reduceat(owner, starts), np.diff(np.append(starts, len(order))))
    hit = np.sort(order[owner > least])
    w, p = which[hit], place[hit]
    new = np.concatenate(([True], (w[1:] != w[:-1]) | (p[1:] != p[:-1] + 1))) if len(hit) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit)) - 1 if len(hit) else first
    return w[first], p[first], p[last]


def suffix_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    length: int = 50,
    with_text: bool = False,
    batch_bytes: int = BATCH_BYTES,
    sort_at_once: int = SORT_AT_ONCE,
    hot_batches: int = HOT_BATCHES,
) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row, and ``kept``, the bytes that stay, if asked for.

    A row's bytes are removed where a string of ``length`` bytes covers them that starts in a row of a smaller id too, as
    the input stands. ``n_spans`` counts the maximal removed runs. Ids are integers. A row whose id is null loses nothing
    and makes no other lose; rows of one id don't make each other lose. A null text is empty; texts shorter than
    ``length`` stay. An empty table gives no rows. Other columns are not read. Kept bytes need not be valid UTF-8.
    """
    if length < 8:
        raise ValueError("strings of less than eight bytes are not supported")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    source = only(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    packed = scratch.write_dealt(pack_batches(source, batch_bytes), "batch", shuffle_partitions(spark))
    total, batches = packed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    parts = max(3 * shuffle_partitions(spark), -(-total // PART_BYTES))
    ranges = repeated_ranges(packed, length, parts, isqrt(batches) + 1, scratch, sort_at_once, hot_batches, hot_batches * batch_bytes // HOT_BATCHES).groupBy("batch").agg(F.collect_list("ranges").alias("ranges"))
    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_text
        for row in _rows(batches):
            blob = zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=max(1, row["n_bytes"]))
            found = [_unpack(r) for r in row["ranges"] or []]
            text, start, stop = (np.concatenate([x[i] for x in found]) for i in range(3)) if found else (np.empty(0, np.int64),) * 3
            order = np.lexsort((start, text))
            text, start, stop = text[order], start[order], stop[order]
            of = dict(_slices(text))
            rows, at = [], 0
            for i, (doc, named, size) in enumerate(zip(row["ids"], row["named"], row["sizes"])):
                data = blob[at : at + size]
                at += size
                pieces, spans, end, removed = [], 0, 0, 0
                if i in of:
                    a, b = start[of[i]], np.maximum.accumulate(stop[of[i]])
                    new = np.concatenate(([True], a[1:] > b[:-1]))
                    firsts = np.flatnonzero(new)
                    for x, y in zip(a[firsts].tolist(), b[np.append(firsts[1:], len(a)) - 1].tolist()):
                        pieces.append(data[end:x])
                        end, spans, removed = y, spans + 1, removed + y - x
                kept = b"".join([*pieces, data[end:]])
                rows.append((doc if named else None, size, removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] * with_text)))
            yield _out(rows, names, types)

    body = packed.select("batch", "n_bytes", "ids", "named", "sizes", "blob")
    return body.join(ranges, "batch", "left").select(*body.columns, "ranges").mapInArrow(cut, schema)
