"""Byte-level BPE with vectorised pre-tokenisation and cached pair merging, and its decoding.

Pre-tokens are found without a regular expression. Each code point becomes a symbol: its class (letter, number, white space, other)
with what the next code points decide, such as whether white space is the last before a word. A symbol is a transition function on
the state "which token is open"; composing such functions is associative. The array is cut into columns; one sweep composes each
column's functions, a prefix scan over the columns gives the state in which each begins, and a second sweep gives all states.
"""

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import unicodedata
from pyspark.sql import DataFrame

from .common import doc_text, documents, frugal, text_tiles

RANKS = "byte_bpe_multi_50k.tiktoken"
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: White space of the pattern's \s, as fixed by Unicode.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pre-tokens whose ids a worker keeps, in each of two generations; the older is forgotten when the younger is full.
KEPT = 1 << 17
TILE = 1 << 19


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    table = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[WHITE] = SPACE
    return table


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, byte offset of each and of the end, document offsets in code points) of valid UTF-8."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.append(lead, len(data))
    return points, at, np.searchsorted(at, offsets)


#: Symbols: letter, number, other, an apostrophe that one or two letters of a contraction follow, white space before white space or
#: the end, a blank before something else, and other white space before something else.
S_LETTER, S_NUMBER, S_OTHER, S_TICK1, S_TICK2, S_WHITE, S_BLANK, S_LAST = range(8)
#: States: no token open, an open run of letters, numbers, others or white space, a blank that takes the next run along, and a
#: contraction that wants one or two more letters.
T_NONE, T_LETTER, T_NUMBER, T_OTHER, T_WHITE, T_BLANK, T_ONE, T_TWO = range(8)


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token begins) by symbol and state; symbols from 8 on begin a document, whatever the state."""
    after, begins = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for symbol in range(8):
        run = {S_LETTER: T_LETTER, S_NUMBER: T_NUMBER, S_OTHER: T_OTHER, S_TICK1: T_ONE, S_TICK2: T_TWO, S_WHITE: T_WHITE, S_BLANK: T_BLANK, S_LAST: T_NONE}[symbol]
        for state in range(8):
            to, new = run, True
            if symbol in (S_LETTER, S_NUMBER, S_OTHER, S_WHITE) and state == run or symbol in (S_LETTER, S_NUMBER, S_OTHER) and state == T_BLANK:
                new = False
            elif symbol in (S_TICK1, S_TICK2) and state in (T_OTHER, T_BLANK):
                to, new = T_OTHER, False
            elif symbol == S_LETTER and state in (T_ONE, T_TWO):
                to, new = (T_NONE, T_ONE)[state - T_ONE], False
            after[symbol, state], begins[symbol, state] = to, new
        after[symbol + 8], begins[symbol + 8] = after[symbol, T_NONE], True
    return after, begins


AFTER, BEGINS = _transitions()
#: Code points of a column of the scan.
COLUMN = 128


def symbols(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """The symbol of each code point; 8 more where a document begins."""
    n = len(points)
    kind = class_table()[points]
    fresh = np.zeros(n + 1, bool)
    fresh[doc_starts] = True
    after = np.full(n, SPACE, np.uint8)
    after[:-1] = kind[1:]
    after[fresh[1:]] = SPACE
    out = np.array([S_OTHER, S_LETTER, S_NUMBER, S_WHITE], np.uint8)[kind]
    last = (kind == SPACE) & (after != SPACE)
    out[last] = np.where(points[last] == 32, S_BLANK, S_LAST)
    tick = np.flatnonzero((points == 39) & (after == LETTER))
    if len(tick):
        c1, ends = points[tick + 1], doc_starts[np.searchsorted(doc_starts, tick, side="right")]
        c2 = np.where(tick + 2 < ends, points[np.minimum(tick + 2, n - 1)], 0)
        out[tick[np.isin(c1, [115, 116, 109, 100])]] = S_TICK1
        out[tick[((c1 == 114) | (c1 == 118)) & (c2 == 101) | (c1 == 108) & (c2 == 108)]] = S_TICK2
    out[fresh[:-1]] += 8
    return out


def scanned(symbol: np.ndarray, column: int = COLUMN) -> np.ndarray:
    """Whether a token begins at each symbol, by composing transition functions."""
    n = len(symbol)
    wide = -(-n // column)
    grid = np.zeros(wide * column, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(wide, column).T)
    table = AFTER.ravel()
    # a column's function: the state after it for each state before it
    whole = np.repeat(np.arange(8, dtype=np.uint8)[:, None], wide, 1)
    for row in grid:
        whole = table[(row.astype(np.int16) << 3) + whole]
    # prefix scan over the columns, twice as many composed each time
    step = 1
    while step < wide:
        joined = whole.copy()
        joined[:, step:] = np.take_along_axis(whole[:, step:], whole[:, :-step].astype(np.int64), 0)
        whole, step = joined, step * 2
    state = np.concatenate([[T_NONE], whole[T_NONE, :-1]]).astype(np.int16)
    begins, out = BEGINS.ravel(), np.empty(grid.shape, bool)
    for k, row in enumerate(grid):
        at = (row.astype(np.int16) << 3) + state
        out[k], state = begins[at], table[at].astype(np.int16)
    return out.T.ravel()[:n]


def boundaries(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Indexes at which a pre-token begins; documents, given by their starts and the end, are apart."""
    return np.flatnonzero(scanned(symbols(points, doc_starts))) if len(points) else np.zeros(0, np.int64)


class Vocabulary:
    """Ranks of byte strings: ids of pre-tokens by pair merging, and bytes of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {i: b for b, i in self.rank.items()}
        self.kept: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The pair of least rank is merged, leftmost first, until no pair has a rank."""
        rank = self.rank
        if piece in rank:
            return [rank[piece]]
        if len(piece) > 200:
            return self._merged_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while pairs:
            least = min(pairs)
            if least == 1 << 60:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = rank.get(parts[i - 1] + parts[i], 1 << 60)
        return [rank[p] for p in parts]

    def _merged_long(self, piece: bytes) -> list[int]:
        """The same with a heap and a linked list, for pre-tokens of any length."""
        import heapq

        rank, n = self.rank, len(piece)
        parts: list = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= n or len(parts[i]) + len(parts[j]) != size or rank.get(parts[i] + parts[j]) != r:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank.get(parts[i] + parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[after[i]])))
            if (k := before[i]) >= 0 and (r := rank.get(parts[k] + parts[i])) is not None:
                heapq.heappush(heap, (r, k, len(parts[k]) + len(parts[i])))
        return [rank[p] for p in parts if p is not None]

    def ids(self, pieces: list[bytes]) -> list[tuple]:
        if len(self.kept) > KEPT:
            self.kept, self.old = {}, self.kept
        kept, old = self.kept, self.old
        for p in set(pieces).difference(kept):
            kept[p] = old.get(p) or tuple(self.merged(p))
        return list(map(kept.__getitem__, pieces))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded(column, vocab: Vocabulary):
    """For each text of an Arrow string column: ids, and the byte offset at which each pre-token begins with its number of ids."""
    for _, _, data, offsets in text_tiles(column, TILE):
        points, at, docs = code_points(data, offsets)
        starts = boundaries(points, docs)
        first = np.searchsorted(starts, docs)
        begin = at[starts]
        raw, marks = data.tobytes(), [*begin.tolist(), len(data)]
        pieces = [raw[a:b] for a, b in zip(marks, marks[1:])]
        ids = vocab.ids(pieces)
        for k in range(len(offsets) - 1):
            i, j = first[k], first[k + 1]
            part = ids[i:j]
            yield [x for piece in part for x in piece], begin[i:j] - offsets[k], list(map(len, part))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, pre-token byte offsets and the number of ids of each, a row for each row; null text is empty.

    Empty texts have empty lists; equal texts equal ids; an empty table gives no rows; other columns are ignored.
    """
    path = path or ranks_path()

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = list(encoded(part.column(1), vocab))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["doc_id", "ids", "piece_at", "piece_ids"])

    return doc_text(docs).mapInArrow(frugal(run), "doc_id long, ids array<int>, piece_at array<long>, piece_ids array<int>")


def decode_documents(encoded_docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the decoded bytes of ids, a row for each row; null and empty ids are no bytes; an id outside the vocabulary is an error.

    An empty table gives no rows; other columns are ignored.
    """
    path = path or ranks_path()

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([vocab.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return encoded_docs.select("doc_id", "ids").mapInArrow(frugal(run), "doc_id long, decoded binary")


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_pieces long"


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of each text's ids and of what they decode to, without moving the ids.

    A row for each row of docs: null and empty text have no ids; special strings are ordinary text; texts of any length are
    taken whole; equal rows give equal rows; other columns are ignored.
    """
    path = path or ranks_path()

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for ids, begins, _ in encoded(part.column(1), vocab):
                    rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(vocab.decode(ids)).hexdigest(), len(begins)))
                n, ids_sha, decoded_sha, pieces = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha), pa.array(pieces, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_pieces"])

    return doc_text(docs).mapInArrow(frugal(run), OUT)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir))
