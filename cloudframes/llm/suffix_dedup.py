"""Repeated 50-byte strings across documents, by a depth-limited most-significant-digit radix sort of suffixes.

Suffixes are ordered no deeper than the threshold, and never all of them. Documents are kept in blocks, the unit of all exchanges.

1. Pruning. Of the suffixes that begin in a 50-byte string, the one whose first GRAM bytes have the least code stands for the string
   (its anchor; equal strings have equal anchors at equal places). Blocks send the codes of their anchors' grams; a gram that lies in
   one document alone can't be part of a repeated string. Codes only prune: a chance collision costs time, never a byte.
2. Digits. Around the other anchors, the bytes of all strings that have this anchor (its reach) are dealt out by gram, and merged
   within a block first. A bucket orders suffixes by digits of eight bytes, the most significant first; after each pass only groups
   that can still hold a repeated string go on. First whole reaches: of equal ones the smallest document's stands for all. Then, of
   the grams that two documents still have, all strings; the groups left after the last digit have equal bytes, and are exactly the
   repeated strings. Of a gram with very many different reaches, each string is dealt out by its own bytes, so that no bucket is hot.

Answers are arrays in the order of what a block sent, so messages carry no places. Bytes that are sent and work grow with the text. The
rows that carry them are one for each block and bucket, so they grow with its square until each has one entry, and with the text beyond.
"""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, documents, frugal, mixed, text_bytes, written

#: A gram's size leaves 23 anchors to choose from, so that the strings of a reach fit a mask of 32 bits.
WINDOW, GRAM = 50, 28
#: Bytes of text of a block (a longer document is a block alone), and for each bucket of grams and of reaches.
BLOCK, BUCKET, STRINGS = 6 << 20, 32 << 20, 16 << 20
#: A gram's strings travel one by one if it has so many reaches in all blocks, and so many different ones of 128 codes.
MANY, DIFFERENT = 512, 64
#: A part of a document that is worked on at once; longer documents come in parts that overlap by a string.
PART = 1 << 18
#: Strings that a bucket orders at once; more are ordered by ranges of the first digit.
RANGE = 2 << 20
#: The bits of codes that are used; results are the same with any, only slower.
CODE = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]
CLOSED, OPEN, HOT = 0, 1, 2


def parts(offsets: np.ndarray):
    """(first row, end row, begin, end): runs of documents, or parts of one, of about PART bytes. Every string is in one part."""
    i, n = 0, len(offsets) - 1
    while i < n:
        size = offsets[i + 1] - offsets[i]
        if size > 2 * PART:
            for at in range(0, size - WINDOW + 1, PART):
                yield i, i + 1, offsets[i] + at, offsets[i] + min(size, at + PART + WINDOW - 1)
            i += 1
            continue
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] <= PART:
            j += 1
        yield i, j, offsets[i], offsets[j]
        i = j


def eights(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from every place on as one number, as a view; past the end are zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data), kind, buffer=padded.data, strides=(1,))


def _coded(eight: np.ndarray, at: np.ndarray | None, length, n: int = 0) -> np.ndarray:
    """Codes of strings of 50 to 72 bytes from `at` on, or of the grams at the first n places."""
    if at is None:
        h = eight[:n] * _ODD[0]
        for k, step in enumerate((8, 16, GRAM - 8)):
            h += eight[step : step + n] * _ODD[k + 1]
        return mixed(h)
    h = length.astype(np.uint64)
    for k in range(6):
        h += eight[at + 8 * k] * _ODD[k]
    for k in range(3):
        h += eight[at + length - 8 * (k + 1)] * _ODD[k + 6]
    return mixed(h)


class Anchors:
    """Of a block: for each anchor the gram's code, the first string's start, the number of strings, the document's row, and the gram's place."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        found = [self._part(data[a:b], np.clip(offsets[i : j + 1], a, b) - a, i, a) for i, j, a, b in parts(offsets) if b - a >= WINDOW]
        self.data = data
        kinds = (np.uint64, np.int64, np.int64, np.int64, np.uint8)
        self.gram, self.start, self.count, self.row, self.place = (np.concatenate([np.zeros(0, t), *x]) for x, t in zip(zip(*found, strict=True) if found else [()] * 5, kinds, strict=True))
        self._eight = None

    @staticmethod
    def _part(data: np.ndarray, offsets: np.ndarray, first_row: int, begin: int):
        n, m = len(data), len(data) - WINDOW + 1
        g = _coded(eights(data).astype(np.uint64), None, None, n - GRAM + 1)
        low = np.uint64((1 << 22) - 1)
        least = (g & ~low) | np.arange(len(g), dtype=np.uint64)
        wide, span = 1, WINDOW - GRAM + 1
        while wide * 2 <= span:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        least = np.minimum(least[:m], least[span - wide : span - wide + m])
        inside = np.repeat(offsets[1:], np.diff(offsets))[:m] >= np.arange(WINDOW, n + 1)
        at = np.flatnonzero(inside)
        anchor = (least[at] & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(at) else at
        start = at[first]
        place = anchor[first]
        return g[place] & CODE, start + begin, np.diff(np.append(first, len(at))), np.searchsorted(offsets, start, side="right") - 1 + first_row, (place - start).astype(np.uint8)

    def eight(self) -> np.ndarray:
        if self._eight is None:
            self._eight = eights(self.data).astype(np.uint64)
        return self._eight

    def reach(self) -> np.ndarray:
        return _coded(self.eight(), self.start, self.count + WINDOW - 1) & CODE


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _spread(starts: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """values, one for each run, on all of the run's members."""
    return np.repeat(values, np.diff(np.append(starts, n)))


def bucket_of(code: np.ndarray, n: int) -> np.ndarray:
    """Ascending in the code."""
    return ((code >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _each(starts: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, index) of runs of places: count places from each start on."""
    which = np.repeat(np.arange(len(starts)), count)
    return np.repeat(starts - np.cumsum(count) + count, count) + np.arange(len(which)), which


# --- blocks of documents
BLOCK_DDL = "block long, size long, ids binary, sizes binary, packed binary"


def packed(batches):
    """Texts to zstd frames, so that joins move a third of the bytes."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        frames = [squeeze.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(frames, pa.binary())], names=["doc_id", "packed"])


def blocks(batches):
    """Documents to blocks: ids, sizes and one compressed text. Numbers of blocks are unique, for a task counts within its own range."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    squeeze = zstandard.ZstdCompressor(level=3)
    held, size = [], 0

    def row():
        ids, sizes, texts = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(texts)]), pa.array([ids.tobytes()]), pa.array([sizes.tobytes()]), pa.array([squeeze.compress(texts.tobytes())])], names=["block", "size", "ids", "sizes", "packed"])

    for batch in batches:
        ids = np.asarray(batch.column(0))
        data, offsets = text_bytes(batch.column(1))
        i = 0
        while i < len(ids):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK - size, side="right")) - 1)
            j = min(j, len(ids))
            if held and size + offsets[j] - offsets[i] > BLOCK:
                yield row()
                number, held, size = number + 1, [], 0
                continue
            held.append((ids[i:j], np.diff(offsets[i : j + 1]), data[offsets[i] : offsets[j]]))
            size += int(offsets[j] - offsets[i])
            i = j
    if held:
        yield row()


def _block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, data, offsets)"""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["packed"], max_output_size=max(1, row["size"])), np.uint8)
    return np.frombuffer(row["ids"], np.int64), data, np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))])


def _rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: batch.column(n)[k].as_py() for n in batch.schema.names}


# --- pruning by grams
GRAM_DDL = "bucket int, block long, codes binary, reaches binary, marks binary"
ANSWER_DDL = "block long, bucket int, answers binary"


class Grams:
    """The distinct grams of a block in ascending order."""

    def __init__(self, x: Anchors):
        self.order = np.argsort(x.gram)
        gram = x.gram[self.order]
        self.runs = _runs(gram)
        self.codes, self.x = gram[self.runs], x

    def of_anchors(self, values: np.ndarray) -> np.ndarray:
        """Values of grams, for each anchor."""
        out = np.empty(len(self.order), values.dtype)
        out[self.order] = _spread(self.runs, len(self.order), values)
        return out

    def described(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of different reaches, a 7-bit code of one, and in the highest bit whether two documents have the gram)."""
        n, runs = len(self.order), self.runs
        if not n:
            return np.zeros(0, np.uint8), np.zeros(0, np.uint8)
        reach, doc = self.x.reach(), ids[self.x.row[self.order]]
        count = np.diff(np.append(runs, n))
        several = np.flatnonzero(_spread(runs, n, count > 1))
        gram = _spread(runs, n, np.arange(len(runs)))[several]
        some = reach[self.order[several]]
        inside = np.lexsort((some, gram))
        gram, some = gram[inside], some[inside]
        reaches = np.ones(len(runs), np.int64)
        different = np.bincount(gram[_runs(gram, some)], minlength=len(runs))
        reaches[count > 1] = different[count > 1]
        shared = np.minimum.reduceat(doc, runs) < np.maximum.reduceat(doc, runs)
        return np.minimum(reaches, 255).astype(np.uint8), (mixed(reach[self.order[runs]]) & np.uint64(127)).astype(np.uint8) | (shared.astype(np.uint8) << np.uint8(7))


def send_grams(n: int):
    def run(batches):
        for row in _rows(batches):
            ids, data, offsets = _block(row)
            g = Grams(Anchors(data, offsets))
            reaches, marks = g.described(ids)
            bucket = bucket_of(g.codes, n)
            cuts = np.append(_runs(bucket), len(bucket))
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            low = g.codes.astype(np.uint32)
            if spans:
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int32()), pa.array([row["block"]] * len(spans), pa.int64()), *(pa.array([v[i:j].tobytes() for i, j in spans], pa.binary()) for v in (low, reaches, marks))], names=["bucket", "block", "codes", "reaches", "marks"])

    return run


def _joined(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of arrays, and how many each row has."""
    views = [np.frombuffer(x.as_buffer() or b"", kind) for x in column]
    return (np.concatenate(views) if views else np.zeros(0, kind)), np.array([len(v) for v in views], np.int64)


def _answers(table: pa.Table, sizes: np.ndarray, values: np.ndarray) -> pa.Table:
    cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "answers": pa.array([values[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())})


def settle(table: pa.Table) -> pa.Table:
    """A bucket of grams: for each that was sent whether two documents have it, and whether its reaches are many."""
    codes, sizes = _joined(table.column("codes"), np.uint32)
    reaches, _ = _joined(table.column("reaches"), np.uint8)
    marks, _ = _joined(table.column("marks"), np.uint8)
    order = np.argsort(codes, kind="stable")
    sorted_codes = codes[order]
    runs = _runs(sorted_codes)
    n = len(codes)
    state = np.zeros(n, np.uint8)
    if n:
        size = np.diff(np.append(runs, n))
        open_ = (size > 1) | (np.maximum.reduceat(marks[order], runs) > 127)
        many = open_ & (np.add.reduceat(reaches[order].astype(np.int64), runs) > MANY)
        for k in np.flatnonzero(many).tolist():  # a gram in very many blocks may still have few different reaches
            at = order[runs[k] : runs[k] + size[k]]
            many[k] = reaches[at].max() > DIFFERENT or len(np.unique(marks[at] & 127)) > DIFFERENT
        state[order] = _spread(runs, n, np.where(many, HOT, np.where(open_, OPEN, CLOSED)).astype(np.uint8))
    return _answers(table, sizes, state)


# --- digits of reaches
class Units:
    """What a block sends of its open anchors: reaches, or single strings of hot grams, each once with its smallest doc_id."""

    def __init__(self, x: Anchors, ids: np.ndarray, state: np.ndarray):
        cold, hot = np.flatnonzero(state == OPEN), np.flatnonzero(state == HOT)
        at, which = _each(x.start[hot], x.count[hot])
        self.start = np.concatenate([x.start[cold], at])
        self.count = np.concatenate([x.count[cold], np.ones(len(at), np.int64)])
        row = np.concatenate([x.row[cold], x.row[hot][which]])
        self.place = np.concatenate([x.place[cold], (x.place[hot][which] + x.start[hot][which] - at).astype(np.uint8)])
        eight, n = x.eight(), len(self.start)
        code = _coded(eight, self.start, self.count + WINDOW - 1) & CODE if n else np.zeros(0, np.uint64)
        to = np.concatenate([mixed(x.gram[cold]), code[len(cold) :]])
        doc = ids[row]
        order = np.lexsort((doc, code))
        runs = _runs(code[order])
        leader = np.empty(n, np.int64)
        leader[order] = _spread(runs, n, order[runs])
        same = self._equal(eight, leader)
        leader = np.where(same, leader, np.arange(n))
        self.all_gone = same & (doc > doc[leader])
        sent = np.flatnonzero(leader == np.arange(n))
        sent = sent[np.argsort(to[sent], kind="stable")]
        place = np.empty(n, np.int64)
        place[sent] = np.arange(len(sent))
        self.entry = place[leader]
        self.sent, self.to, self.doc = sent, to[sent], doc[sent]

    def _equal(self, eight: np.ndarray, leader: np.ndarray) -> np.ndarray:
        """Whether each unit has its leader's bytes."""
        a, b, length = self.start, self.start[leader], self.count + WINDOW - 1
        same = self.count == self.count[leader]
        for k in range(9):
            other = np.flatnonzero(same & (leader != np.arange(len(leader))))
            step = np.minimum(8 * k, length[other] - 8)
            same[other] = eight[a[other] + step] == eight[b[other] + step]
        return same


def _state(row: dict, kind) -> np.ndarray:
    """A block's answers in the order of what it sent."""
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(a["answers"], kind) for a in sorted(row or [], key=lambda a: a["bucket"]))])


REACH_DDL = "bucket int, block long, counts binary, places binary, docs binary, bytes binary"


def send_reaches(n: int):
    def run(batches):
        for row in _rows(batches):
            ids, data, offsets = _block(row)
            x = Anchors(data, offsets)
            u = Units(x, ids, Grams(x).of_anchors(_state(row["grams"], np.uint8)))
            bucket = bucket_of(u.to, n)
            cuts = np.append(_runs(bucket), len(bucket))
            out = []
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                s = u.sent[i:j]
                at, _ = _each(u.start[s], u.count[s] + WINDOW - 1)
                out.append((int(bucket[i]), row["block"], u.count[s].astype(np.uint8).tobytes(), u.place[s].tobytes(), u.doc[i:j].tobytes(), data[at].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["bucket", "block", "counts", "places", "docs", "bytes"])

    return run


def passes(eight: np.ndarray, live: np.ndarray, group: np.ndarray, digits, keep) -> tuple[np.ndarray, np.ndarray]:
    """(members, group of each) that are left after passes by digits of eight bytes, in the order of groups.

    digits is a list of functions from members to the places of a digit. Each pass orders a group's members by the next one, which
    splits it; keep tells which of the new groups, given by their starts, go on.
    """
    for digit_of in digits:
        digit = eight[digit_of(live)].astype(np.uint64)
        order = np.lexsort((digit, group))
        live, group, digit = live[order], group[order], digit[order]
        runs = _runs(group, digit)
        if not len(runs):
            break
        on = _spread(runs, len(live), keep(runs, live))
        live, group = live[on], _spread(runs, len(live), np.arange(len(runs), dtype=np.int32))[on]
    return live, group


class Reaches:
    """The reaches of a bucket: bytes, their starts, numbers of strings, places of the gram and documents."""

    def __init__(self, data: np.ndarray, count: np.ndarray, place: np.ndarray, doc: np.ndarray):
        self.eight, self.count, self.doc = eights(data, ">u8"), count, doc
        self.length = count + WINDOW - 1
        self.start = np.cumsum(self.length) - self.length
        self.gram = self.start + place

    def _two_documents(self, runs: np.ndarray, live: np.ndarray) -> np.ndarray:
        doc = self.doc[live]
        return np.minimum.reduceat(doc, runs) < np.maximum.reduceat(doc, runs)

    def leaders(self) -> np.ndarray:
        """For each reach the one of the same bytes with the smallest document."""
        n = len(self.count)
        several = lambda runs, live: np.diff(np.append(runs, len(live))) > 1
        digit = lambda k: lambda live: self.start[live] + np.minimum(8 * k, self.length[live] - 8)
        live, group = passes(self.eight, np.arange(n), self.count, [digit(k) for k in range(-(-int(self.length.max(initial=0)) // 8))], several)
        order = np.lexsort((self.doc[live], group))
        live, runs = live[order], _runs(group[order])
        out = np.arange(n)
        out[live] = _spread(runs, len(live), live[runs])
        return out

    def masks(self) -> np.ndarray:
        """Of each reach the strings that a smaller document has, as bits."""
        n = len(self.count)
        leader = self.leaders()
        # different reaches can only share strings if they share the gram
        open_ = lambda runs, live: self._two_documents(runs, live) & (np.maximum.reduceat(self.count[live], runs) > 1)
        digits = [lambda live, k=k: self.gram[live] + k for k in (0, 8, 16, GRAM - 8)]
        live, _ = passes(self.eight, np.flatnonzero(leader == np.arange(n)), np.zeros(n, np.int32)[leader == np.arange(n)], digits, open_)
        at, which = _each(self.start[live], self.count[live])
        of = live[which]
        gone = self._repeated(at, self.doc[of])
        out = np.bincount(of[gone], 2.0 ** (at[gone] - self.start[of[gone]]), minlength=n).astype(np.uint32)[leader]
        out[self.doc > self.doc[leader]] = 0xFFFFFFFF
        return out

    def _repeated(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Indexes of the strings at these places that also begin in a smaller document; many are ordered by ranges of the first digit."""
        if len(at) <= RANGE:
            ranges = [np.arange(len(at))]
        else:
            step = len(at) // RANGE + 1
            sample = np.sort(self.eight[at[:: max(1, len(at) // 65_536)]])
            ends = np.unique(sample[:: max(1, len(sample) // step)])[1:]
            first = np.concatenate([np.searchsorted(ends, self.eight[at[k : k + RANGE]], side="right").astype(np.int32) for k in range(0, len(at), RANGE)])
            ranges = (np.flatnonzero(first == k) for k in range(len(ends) + 1))
        found = [np.zeros(0, np.int64)]
        for live in ranges:
            low_high = lambda runs, live: np.minimum.reduceat(doc[live], runs) < np.maximum.reduceat(doc[live], runs)
            live, group = passes(self.eight, live, np.zeros(len(live), np.int32), [lambda live, k=k: at[live] + k for k in (0, 8, 16, 24, 32, 40, WINDOW - 8)], low_high)
            if len(live):
                runs = _runs(group)
                found.append(live[doc[live] > _spread(runs, len(live), np.minimum.reduceat(doc[live], runs))])
        return np.concatenate(found)


def order_reaches(table: pa.Table) -> pa.Table:
    """A bucket of reaches: for each that was sent, the mask of its strings that a smaller doc_id has."""
    count, sizes = _joined(table.column("counts"), np.uint8)
    place, doc, data = (_joined(table.column(c), t)[0] for c, t in (("places", np.uint8), ("docs", np.int64), ("bytes", np.uint8)))
    return _answers(table, sizes, Reaches(data, count.astype(np.int64), place, doc).masks())


def each_bucket(f):
    """f of the table of each bucket; a task's rows hold whole buckets, mostly one."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            del held
            buckets = np.asarray(table.column("bucket"))
            for k in np.unique(buckets).tolist():
                yield from f(table.filter(pa.array(buckets == k)) if (buckets != k).any() else table).to_batches()

    return run


KEPT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def kept_bytes(with_bytes: bool):
    """What is left of each document of a block, once all answers are there."""

    def run(batches):
        for row in _rows(batches):
            ids, data, offsets = _block(row)
            gone = np.zeros(len(data), bool)
            state = _state(row["grams"], np.uint8)
            if state.any():
                x = Anchors(data, offsets)
                u = Units(x, ids, Grams(x).of_anchors(state))
                mask = _state(row["reaches"], np.uint32)[u.entry].astype(np.int64)
                mask[u.all_gone] = -1
                at, which = _each(u.start, u.count)
                at = at[(mask[which] >> (at - u.start[which])) & 1 > 0]
                n = len(data) + 1
                gone = np.cumsum(np.bincount(at, minlength=n) - np.bincount(at + WINDOW, minlength=n))[:-1] > 0
            text = data.tobytes()
            out = []
            for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                cut = gone[i:j]
                n = int(cut.sum())
                left = data[i:j][~cut].tobytes() if n else text[i:j]
                spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()) if n else 0
                out.append((j - i, n, spans, hashlib.sha256(left).hexdigest(), left if with_bytes else None))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _by_block(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "answers")).alias(name))


def remove_repeats(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left) of every row of docs (doc_id, text).

    A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id, judged on the texts as given. Null
    text is empty; texts under 50 bytes stay whole; rows with equal doc_id are no smaller than each other and are worked on
    alike; a null doc_id is less than all others; an empty table gives no rows; other columns are ignored.
    """
    docs = doc_text(docs).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text")
    held = written(docs.mapInArrow(frugal(blocks), BLOCK_DDL), "repeats-blocks")
    total = held.agg(F.sum("size")).first()[0] or 0
    n = max(64, -(-total // BUCKET))
    sent = held.mapInArrow(frugal(send_grams(n)), GRAM_DDL).repartitionById(n, "bucket")
    grams = written(sent.mapInArrow(frugal(each_bucket(settle)), ANSWER_DDL), "repeats-grams")
    with_grams = held.join(_by_block(grams, "grams"), "block", "left")
    m = max(64, -(-total // STRINGS))
    sent = with_grams.mapInArrow(frugal(send_reaches(m)), REACH_DDL).repartitionById(m, "bucket")
    reaches = written(sent.mapInArrow(frugal(each_bucket(order_reaches)), ANSWER_DDL), "repeats-reaches")
    result = with_grams.join(_by_block(reaches, "reaches"), "block", "left").mapInArrow(frugal(kept_bytes(with_bytes)), KEPT_DDL)
    result = result.withColumn("doc_id", F.when(F.col("doc_id") > -(1 << 63), F.col("doc_id")))
    return result if with_bytes else result.drop("kept")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


#: Every 50-byte string as hexadecimal digits, with the smallest document in which it begins.
OP2_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, base, substring(h, 2 * base + 1, 2146) AS h FROM (SELECT *, unnest(range(0, len(h) // 2, 1024)) AS base FROM h)),
w AS (SELECT doc_id, base + i AS pos, substring(h, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, least(len(h) // 2 - 49, 1024))) AS i FROM p)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT doc_id, pos, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 50, true)::INT AS new FROM w JOIN f USING (s) WHERE doc_id > first),
r AS (SELECT doc_id, min(pos) AS a, max(pos) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g) GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
c AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans, max(b) AS last, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM k JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN c USING (doc_id)
"""
