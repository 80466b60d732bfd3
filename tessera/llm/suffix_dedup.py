"""Removal of repeated byte strings by a sorted sparse set of suffixes.

A byte goes if a 50-byte string that covers it also starts in a document with a lesser id. Two equal strings have the same
minimizer: the least hash among the GRAM-byte grams inside, the leftmost of equals. So each string is held by one anchor, a gram
that is the minimizer of some string, and equal strings have equal anchors:

1. Anchors (about one in 18 bytes) are dealt by hash; those whose gram is in one document only are dropped. Grams that are common in
   the texts of a task are known not to be, and only two of their anchors a task are dealt.
2. Around each anchor that is left its context is cut out: the strings that it is the minimizer of, which are neighbours.
3. Equal contexts are folded to one with their least document before they are shuffled, so a passage that very many documents
   share is some rows. Folded ones are range-partitioned by the anchor's leading bytes with sampled splitters. In each range all
   suffixes that start a string are sorted by multikey quicksort on words of 8 bytes, down to LENGTH bytes; runs of equal
   suffixes get their least id. Equal leading bytes lie in one range, so no run crosses a boundary. What each kind of context
   loses is joined back to the documents that hold it.
4. Strings with a lesser id than their document's are removed from it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

LENGTH, GRAM = 50, 16
STRINGS = LENGTH - GRAM + 1
PIECE = 1 << 19
#: Contexts whose suffixes are sorted at once, or those of one gram.
KINDS = 20_000
#: A gram that is more often than this among a million anchors at hand, in several texts, is flagged before it is dealt.
COMMON = 16
#: Contexts that are folded at once before they are shuffled.
KINDS_FOLDED = 200_000
ODD = np.uint64(0x9E3779B97F4A7C15)
NONE = -(1 << 63)

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ODD and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE + 4096)
        inverse = pow(int(ODD), -1, 1 << 64)
        for name, base in (("up", int(ODD)), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A mixed 64-bit hash of the gram at each byte (u8)."""
    n = len(data)
    up, down = _power(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = (sums[size:] - sums[:-size]) * down[: n - size + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def minimizers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string of LENGTH bytes the place of its minimizer, and the gram hashes. data: at most 2**24 bytes."""
    h = gram_hashes(data)
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    span, width = low, 1
    while 2 * width <= STRINGS:
        span = np.minimum(span[:-width], span[width:])
        width *= 2
    if width < STRINGS:
        span = np.minimum(span[: len(span) - (STRINGS - width)], span[STRINGS - width :])
    return (span & np.uint64(0xFFFFFF)).astype(np.int64), h


def pieces(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a text, each string in exactly one, with their place."""
    for a in range(0, len(text) - LENGTH + 1, PIECE):
        yield a, np.frombuffer(text, np.uint8, min(PIECE + LENGTH - 1, len(text) - a), a)


def groups(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined into arrays of about PIECE bytes: the bytes, and for each string's place its text's number and place in the
    text; -1 where a string would cross texts. A long text comes in pieces."""
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for i, text in enumerate(texts):
        for at, part in pieces(text):
            if held and size + len(part) > PIECE + 4096:
                yield _joined(held)
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.concatenate([p for _, _, p in held])
    sizes = [len(p) for _, _, p in held]
    owner = np.repeat([i for i, _, _ in held], sizes)
    ends = np.cumsum(sizes)
    place = np.arange(len(data)) + np.repeat([at - (end - n) for (_, at, _), end, n in zip(held, ends, sizes, strict=True)], sizes)
    for end in ends:
        owner[max(0, end - LENGTH + 1) : end] = -1
    n = max(0, len(data) - LENGTH + 1)
    return data, owner[:n], place[:n]


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """For groups of texts: (bytes, anchor places in them, first and last string of each, text number, place of the first string in
    the text, gram hash). One anchor comes twice if its strings are in two pieces of a long text."""
    for data, owner, place in groups(texts):
        least, h = minimizers(data)
        live = np.flatnonzero(owner >= 0)
        if not len(live):
            continue
        at, own = least[live], owner[live]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (own[1:] != own[:-1]) | (live[1:] != live[:-1] + 1)]))
        last = live[np.concatenate([new[1:] - 1, [len(live) - 1]])]
        first = live[new]
        yield data, at[new], first, last, own[new], place[first], h[at[new]]


def multikey_runs(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Run number of each suffix, equal for suffixes that agree in LENGTH bytes; words[i]: the 8 bytes from i.

    Multikey quicksort with 8-byte characters: sort by the first, then only runs of equals by the next, and so on.
    """
    run = np.zeros(len(places), np.int64)
    live = np.arange(len(places))
    numbers = 0
    for depth in [*range(0, LENGTH - 7, 8), *([LENGTH - 8] if LENGTH % 8 else [])]:
        own, key = run[live], words[places[live] + depth]
        order = np.argsort(key, kind="stable") if depth == 0 else np.lexsort((key, own))
        own, key = own[order], key[order]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])])
        ids = numbers + np.cumsum(new)
        run[live[order]] = ids
        numbers = int(ids[-1]) if len(ids) else numbers
        sizes = np.diff(np.append(np.flatnonzero(new), len(ids)))
        live = live[order][np.repeat(sizes > 1, sizes)]
        if not len(live):
            break
    return run


def removed(raw: list[bytes], ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts, each with its document's id and place: number of the context, and first byte and end of each stretch of
    strings that also start in a document with a lesser id."""
    data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
    sizes = np.array([len(x) for x in raw])
    words = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | data[k : len(data) - 7 + k]
    strings = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(raw)), strings)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    run = multikey_runs(words, np.repeat(np.cumsum(sizes) - sizes, strings) + inside)
    order = np.argsort(run, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], run[order][1:] != run[order][:-1]]))
    least = np.minimum.reduceat(ids[owner[order]], heads)
    best = np.empty(len(owner), np.int64)
    best[order] = np.repeat(least, np.diff(np.append(heads, len(order))))
    hit = np.flatnonzero(best < ids[owner])
    if not len(hit):
        return (np.empty(0, np.int64),) * 3
    new = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])]))
    end = hit[np.append(new[1:] - 1, len(hit) - 1)]
    return owner[hit[new]], starts[owner[hit[new]]] + inside[hit[new]], starts[owner[end]] + inside[end] + LENGTH


BUCKET = "bucket int, payload binary"
FLAG = "bucket int, payload binary"
PLACES = "t64 long, at array<int>"
CONTEXT = "lead long, raw binary, off int, id long, t64 long, start int"
FOLDED = "lead long, k long, raw binary, off int, least long, most long"
KIND = "lead long, k long, least long, starts array<int>, stops array<int>"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _turned(a: np.ndarray) -> bytes:
    """The array's bytes by significance, which compresses better."""
    return a.view(np.uint8).reshape(len(a), -1).T.tobytes()


def _back(data: bytes, at: int, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(-1)


def _by_text(t64: np.ndarray, place: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """Flagged places dealt by text: bucket and payload (the texts' hashes, their numbers of places, the places)."""
    to = (t64.view(np.uint64) >> np.uint64(16)) % np.uint64(buckets)
    order = np.argsort(to, kind="stable")
    stops = np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64))
    names, out = [], []
    for b, (x, y) in enumerate(zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)):
        if x < y:
            own = order[x:y][np.argsort(t64[order[x:y]], kind="stable")]
            new = np.flatnonzero(np.concatenate([[True], t64[own][1:] != t64[own][:-1]]))
            counts = np.diff(np.append(new, y - x)).astype(np.uint32)
            names.append(b)
            out.append(np.array([len(new), y - x], np.uint32).tobytes() + _turned(t64[own][new]) + _turned(counts) + _turned(place[own]))
    return names, out


def _common(key: np.ndarray, t64: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of anchors, those whose gram is here more than COMMON times and in several texts, and two of each such gram, of different texts."""
    order = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    sizes = np.diff(np.append(heads, len(order)))
    often = np.flatnonzero(sizes > COMMON)
    rows = order[np.repeat(heads[often], sizes[often]) + np.arange(sizes[often].sum()) - np.repeat(np.cumsum(sizes[often]) - sizes[often], sizes[often])]
    if not len(rows):
        return rows, rows
    rows = rows[np.lexsort((t64[rows], key[rows]))]
    new = np.flatnonzero(np.concatenate([[True], key[rows][1:] != key[rows][:-1]]))
    last = np.append(new[1:] - 1, len(rows) - 1)
    several = t64[rows[new]] != t64[rows[last]]
    return rows[np.repeat(several, last - new + 1)], np.concatenate([rows[new[several]], rows[last[several]]])


def _deal(buckets: int):
    """Anchors of texts (t64, text), dealt by gram hash: for each bucket the texts' hashes, their numbers of anchors, the grams and places.

    A gram that is common among the anchors at hand is flagged here: two of its anchors stand for it in its bucket, so that
    is bounded by the number of tasks, and all go on to their texts' buckets, told by -1 - bucket.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            t64, place, h = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (h >> np.uint64(32)) % np.uint64(buckets)
            names, out = [], []
            sure, marks = _common((bucket << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)), t64)
            if len(sure):
                flagged, payloads = _by_text(t64[sure], place[sure], buckets)
                names, out = [-1 - b for b in flagged], payloads
                left = np.ones(len(t64), bool)
                left[sure] = False
                left[marks] = True
                t64, place, h, bucket = t64[left], place[left], h[left], bucket[left]
            order = np.argsort(bucket, kind="stable")
            stops = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            for b, (x, y) in enumerate(zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)):
                if x < y:
                    own = order[x:y]
                    new = np.flatnonzero(np.concatenate([[True], t64[own][1:] != t64[own][:-1]]))
                    counts = np.diff(np.append(new, y - x)).astype(np.uint32)
                    head = np.array([len(new), y - x], np.uint32).tobytes()
                    names.append(b)
                    out.append(head + _turned(t64[own][new]) + _turned(counts) + _turned(h[own].astype(np.uint32)) + _turned(place[own]))
            return pa.RecordBatch.from_pydict({"bucket": pa.array(names, pa.int32()), "payload": pa.array(out, pa.binary())})

        for whole in batches:
            for batch in _portions(whole, 1):
                hashes = batch.column(0).to_numpy(zero_copy_only=False)
                for _, at, first, _, own, place, h in anchors([x.encode() for x in batch.column(1).to_pylist()]):
                    held.append((hashes[own], (place + at - first).astype(np.uint32), h))
                    size += len(at)
                    if size > 1_000_000:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return deal


def _flag(buckets: int):
    """Of some buckets of grams, the places of anchors whose gram is in another text too; dealt again, by text."""

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, hashes, places = [], [], []
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket < 0:
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([-1 - bucket], pa.int32()), "payload": pa.array([data], pa.binary())})
                    continue
                docs, n = (int(x) for x in np.frombuffer(data, np.uint32, 2))
                hashes.append(np.repeat(_back(data, 8, docs, "<i8"), _back(data, 8 + 8 * docs, docs, "<u4")))
                keys.append(_back(data, 8 + 12 * docs, n, "<u4").astype(np.uint64) | np.uint64(bucket << 32))
                places.append(_back(data, 8 + 12 * docs + 4 * n, n, "<u4"))
        if not keys:
            return
        key, t64, place = np.concatenate(keys), np.concatenate(hashes), np.concatenate(places)
        del keys, hashes, places
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        several = np.minimum.reduceat(t64[order], heads) != np.maximum.reduceat(t64[order], heads)
        kept = order[np.repeat(several, np.diff(np.append(heads, len(order))))]
        if not len(kept):
            return
        names, out = _by_text(t64[kept], place[kept], buckets)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(names, pa.int32()), "payload": pa.array(out, pa.binary())})

    return flag


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of some buckets of texts, each text's flagged places in order, once."""
    hashes, places = [], []
    for batch in batches:
        for data in batch.column(1).to_pylist():
            docs, n = (int(x) for x in np.frombuffer(data, np.uint32, 2))
            hashes.append(np.repeat(_back(data, 8, docs, "<i8"), _back(data, 8 + 8 * docs, docs, "<u4")))
            places.append(_back(data, 8 + 12 * docs, n, "<u4").astype(np.int32))
    if not hashes:
        return
    t64, place = np.concatenate(hashes), np.concatenate(places)
    order = np.lexsort((place, t64))
    t64, place = t64[order], place[order]
    once = np.concatenate([[True], (t64[1:] != t64[:-1]) | (place[1:] != place[:-1])])
    t64, place = t64[once], place[once]
    heads = np.flatnonzero(np.concatenate([[True], t64[1:] != t64[:-1]]))
    stops = np.append(heads, len(t64)).astype(np.int32)
    for i in range(0, len(heads), 5000):
        part = stops[i : i + 5001]
        lists = pa.ListArray.from_arrays(pa.array(part - part[0]), pa.array(place[part[0] : part[-1]]))
        yield pa.RecordBatch.from_arrays([pa.array(t64[heads[i : i + 5000]]), lists], names=["t64", "at"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts of flagged anchors of texts (id, t64, text, at)."""
    for whole in batches:
        for batch in _portions(whole, 2):
            ids, hashes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            texts = [x.encode() for x in batch.column(2).to_pylist()]
            lists = batch.column(3)
            flagged = (np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False)) << 40) + lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            for data, at, first, last, own, place, _ in anchors(texts):
                key = (own << 40) + place + at - first
                spot = np.minimum(np.searchsorted(flagged, key), len(flagged) - 1)
                hit = np.flatnonzero(flagged[spot] == key)
                if not len(hit):
                    continue
                at, first, last, own, place = (x[hit] for x in (at, first, last, own, place))
                lead = np.zeros(len(at), np.uint64)
                for k in range(8):
                    lead = (lead << np.uint64(8)) | data[at + k]
                raw = data.tobytes()
                yield pa.RecordBatch.from_pydict({
                    "lead": pa.array(lead.view(np.int64)), "raw": pa.array([raw[a:b] for a, b in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)], pa.binary()),
                    "off": pa.array((at - first).astype(np.int32)), "id": pa.array(ids[own]), "t64": pa.array(hashes[own]), "start": pa.array(place.astype(np.int32)),
                })


def _folded(raw: pa.Array, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each context's kind (equal bytes and place of the anchor), and the first context of each kind."""
    marks = pa.Array.from_buffers(pa.binary(), len(off), [None, pa.py_buffer(np.arange(len(off) + 1, dtype=np.int32)), pa.py_buffer(off.astype(np.uint8))])
    kind = pc.binary_join_element_wise(raw, marks, pa.scalar(b"", pa.binary())).dictionary_encode().indices.to_numpy().astype(np.int64)
    first = np.empty(int(kind.max()) + 1, np.int64)
    first[kind[::-1]] = np.arange(len(kind))[::-1]
    return kind, first


def _bounds(kind: np.ndarray, kinds: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least of low and the greatest of high of each kind."""
    least, most = np.full(kinds, np.iinfo(np.int64).max), np.full(kinds, np.iinfo(np.int64).min)
    np.minimum.at(least, kind, low)
    np.maximum.at(most, kind, high)
    return least, most


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts (lead, k, raw, off, id), equal ones of some hundred thousand as one with their least and greatest id."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        lead, k, raw, off, ids = (rows.column(i).combine_chunks() for i in range(5))
        kind, first = _folded(raw, off.to_numpy())
        least, most = _bounds(kind, len(first), ids.to_numpy(), ids.to_numpy())
        at = pa.array(first)
        return pa.RecordBatch.from_pydict({"lead": lead.take(at), "k": k.take(at), "raw": raw.take(at), "off": off.take(at), "least": least, "most": most})

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= KINDS_FOLDED:
            yield flush()
            held, size = [], 0
            pa.default_memory_pool().release_unused()
    if size:
        yield flush()


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range of leading bytes with folded contexts, the kinds that have something to remove (KIND).

    A kind goes whole from documents with more than its least id. What is left is one context of each kind; where its gram has
    only one kind nothing is to compare, else its suffixes are sorted with the others of the range, and stretches that start in
    a document with a lesser id go from the kind's least document.
    """
    rows = list(batches)
    if not sum(b.num_rows for b in rows):
        return
    table = pa.Table.from_batches(rows).combine_chunks()
    lead, k, raw, off, low, high = (table.column(i).combine_chunks() for i in range(6))
    del rows, table
    kind, first = _folded(raw, off.to_numpy())
    least, most = _bounds(kind, len(first), low.to_numpy(), high.to_numpy())
    at = pa.array(first)
    lead, k, raw, off = (x.take(at) for x in (lead, k, raw, off))
    # the gram: the leading bytes, which are the lead, and the others
    data, places = np.frombuffer(raw.buffers()[2], np.uint8), np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1)[:-1] + off.to_numpy()
    second = np.zeros(len(raw), np.uint64)
    for i in range(8, GRAM):
        second = (second << np.uint64(8)) | data[places + i]
    head = lead.to_numpy()
    order = np.lexsort((second, head))
    new = np.concatenate([[True], (head[order][1:] != head[order][:-1]) | (second[order][1:] != second[order][:-1])])
    sizes = np.diff(np.append(np.flatnonzero(new), len(order)))
    mixed = order[np.repeat(sizes > 1, sizes)]
    ends = np.cumsum(sizes[sizes > 1]).tolist()
    found, start = [], 0
    # some grams at a time: what has equal suffixes here has equal grams
    for i, end in enumerate(ends):
        if end - start >= KINDS or i == len(ends) - 1:
            part = mixed[start:end]
            which, x, y = removed(raw.take(pa.array(part)).to_pylist(), least[part], np.zeros(len(part), np.int64))
            found.append((part[which], x, y))
            start = end
    which, x, y = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
    order = np.lexsort((x, which))
    which, x, y = which[order], x[order], y[order]
    told = np.flatnonzero((most > least) | np.isin(np.arange(len(least)), which))
    for i in range(0, len(told), 10_000):
        own = told[i : i + 10_000]
        a, b = np.searchsorted(which, own), np.searchsorted(which, own, "right")
        stops = np.concatenate([[0], np.cumsum(b - a)])
        spot = np.arange(stops[-1]) + np.repeat(a - stops[:-1], b - a)
        lists = [pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(v[spot].astype(np.int32))) for v in (x, y)]
        yield pa.RecordBatch.from_arrays([lead.take(pa.array(own)), k.take(pa.array(own)), pa.array(least[own]), *lists], names=["lead", "k", "least", "starts", "stops"])
    del lead, k, raw, off, data
    pa.default_memory_pool().release_unused()


def _portions(batch: pa.RecordBatch, column: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes in a text column, one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the stretches of texts (doc_id, text, starts, stops)."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    for whole in batches:
        for batch in _portions(whole, 1):
            rows = []
            texts = batch.column(1).cast(pa.binary())
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                data, kept, at, removed_bytes, spans = texts[i].as_py(), hashlib.sha256(), 0, 0, 0
                for a, b in sorted(zip(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), strict=True)):
                    if a > at or spans == 0:
                        kept.update(data[at:a])
                        spans, removed_bytes, at = spans + 1, removed_bytes + b - a, b
                    elif b > at:
                        removed_bytes, at = removed_bytes + b - at, b
                kept.update(data[at:])
                rows.append((doc_id, len(data), removed_bytes, spans, kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove from every whole text, as UTF-8 bytes, what a 50-byte string covers that also starts in a document with a lesser key.

    Returns a row (RESULT) for each row of docs. Strings are judged on the input, overlaps count, matches never cross documents. A
    null text is empty; a null key is less than all others; rows that share a key never remove from each other.

    Texts that equal a text with a lesser key go whole by their SHA-256 (if they have 50 bytes) and take no further part. Texts are
    shuffled twice, to cut contexts and to remove stretches; anchors and contexts are dealt by their content. A gram's contexts
    meet in one task, equal ones as one: that is as many as differ around it.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(NONE).cast("long")).alias("id"), F.xxhash64(body).alias("t64"), body.alias("text"))
    heads = cut(slim.select("doc_id", "id", "t64", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "heads")
    first = cut(heads.groupBy("sha").agg(F.min(F.struct("id", "t64")).alias("f")).select("sha", "f.id", "f.t64"), "first")

    # a bucket is held by one worker: so many that each has the anchors of some 64 MB of text at most
    total = heads.agg(F.sum("n_bytes")).collect()[0][0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (64 << 20)))
    dealt = slim.where(F.octet_length("text") >= LENGTH).select("t64", "text").mapInArrow(_deal(buckets), BUCKET)
    flags = dealt.repartition(buckets, "bucket").mapInArrow(_flag(buckets), FLAG)
    places = cut(flags.repartition(buckets, "bucket").mapInArrow(_gather, PLACES), "places", release=True)
    wanted = places.join(first.select("t64", "id"), "t64")
    held = slim.join(wanted, ["id", "t64"]).select("id", "t64", "text", "at").mapInArrow(_contexts, CONTEXT)
    contexts = cut(held, "contexts", release=True)
    k = F.xxhash64("raw", "off").alias("k")
    folded = contexts.select("lead", k, "raw", "off", "id").mapInArrow(_fold, FOLDED)
    kinds = cut(folded.repartitionByRange(buckets, "lead").mapInArrow(_resolve, KIND), "kinds", release=True)
    # back to the documents: a kind is told by its lead and a hash, 128 bits in all
    holders = contexts.select("lead", k, F.octet_length("raw").alias("size"), "id", "t64", "start").join(kinds, ["lead", "k"])
    whole = F.array(F.struct(F.col("start").alias("start"), (F.col("start") + F.col("size")).alias("stop")))
    parts = F.zip_with("starts", "stops", lambda x, y: F.struct((F.col("start") + x).alias("start"), (F.col("start") + y).alias("stop")))
    found = holders.select("id", "t64", F.explode(F.when(F.col("id") > F.col("least"), whole).otherwise(parts)).alias("s"))
    spans = cut(found.select("id", "t64", "s.start", "s.stop"), "spans", release=True)
    stretches = spans.groupBy("id", "t64").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    touched = slim.join(stretches, ["id", "t64"]).select("doc_id", "text", "starts", "stops").mapInArrow(_apply, RESULT)
    named = heads.join(first.select("sha", F.col("id").alias("least")), "sha")
    # a hashed anti join on small rows: what has stretches is in touched
    rest = named.join(spans.select("id", "t64").distinct(), ["id", "t64"], "left_anti")
    copy = (F.col("id") > F.col("least")) & (F.col("n_bytes") >= LENGTH)
    gone = rest.select("doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(copy, 1).otherwise(0).cast("long").alias("n_spans"), F.when(copy, hashlib.sha256().hexdigest()).otherwise(F.col("sha")).alias("kept_sha256"))
    return touched.unionByName(gone)
