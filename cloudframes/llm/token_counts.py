"""Token counts with a library tokenizer: overlapping chunks of huge documents, spliced at proven boundaries."""

import json
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_text, documents

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Code points: a document over HUGE is encoded in chunks of CHUNK that overlap by OVERLAP at first.
HUGE, CHUNK, OVERLAP = 1 << 15, 1 << 13, 1 << 7
#: Pieces whose counts a worker keeps, in each of two generations; the older is forgotten when the younger is full.
KEPT = 1 << 18


#: What the boundaries of `stable` are proven for: this normaliser and this splitting (fixed values of the tokenizer).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def stable(text: str, at: int, special: tuple[str, ...] = ()) -> bool:
    """Whether the tokens on both sides of this place can't depend on each other.

    They can't at a space or line end: the normaliser composes no character with one, and the splitting pattern drops white
    space and starts afresh after it. They can't either between ASCII characters of different classes (letter, digit, other),
    nor beside a digit, for each match of the pattern stays within a class; only from other to letter may a match pass ('s).
    Special strings, which the library looks for first, are never cut.
    """
    if at <= 0 or at >= len(text):
        return True
    if any(text.find(s, max(0, at - len(s) + 1), at + len(s) - 1) >= 0 for s in special):
        return False
    a, b = text[at - 1], text[at]
    if b in " \n" or a in " \n" and b.isascii():
        return True
    if not (a.isascii() and b.isascii()) or a.isspace() or b.isspace():
        return False
    if a.isdigit() or b.isdigit():
        return True
    return a.isalpha() and not b.isalpha()


def spliced(text: str, encode, special: tuple[str, ...] = (), chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Starts, as code points of text, of the tokens of all of text, from chunks alone.

    Each chunk reaches over the start of the next by the overlap. The two are spliced at the first place in the overlap that is
    stable and at which no token of either goes on; if there is none, the overlap is doubled, up to the whole rest of the text.
    """
    out, begin, n = [], 0, len(text)
    while begin < n:
        reach, wide = min(n, begin + chunk), overlap
        while True:
            end = min(n, reach + wide)
            left = encode(text[begin:end])
            spans = [(a + begin, b + begin) for a, b in left.offsets]
            if end == n:
                return out + [a for a, _ in spans]
            cut = _cut(text, spans, reach, end, encode, special)
            if cut is not None:
                break
            wide *= 2
        out += [a for a, _ in spans if a < cut]
        begin = cut
    return out


def _cut(text: str, spans: list[tuple[int, int]], reach: int, end: int, encode, special: tuple[str, ...]) -> int | None:
    """A place in [reach, end) where the left chunk and a fresh start from reach agree on a boundary, and that is stable."""
    over = [s for s in spans if s[1] > reach]
    fresh = {a + reach for a, _ in encode(text[reach:end]).offsets}
    inside = 0
    for at in range(reach, end):
        while inside < len(over) and over[inside][1] <= at:
            inside += 1
        cuts_token = inside < len(over) and over[inside][0] < at
        if not cuts_token and stable(text, at, special) and (at in fresh or text[at].isspace()):
            return at
    return None


class Counter:
    """Counts tokens of texts. Pieces between spaces and line ends are independent of each other, so their counts are kept.

    That, like stable boundaries, is proven for one kind of splitting; texts are encoded whole by a tokenizer with any other.
    """

    def __init__(self, path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tokenizer, self.huge, self.chunk, self.overlap, self.kept = _tokenizer(path), huge, chunk, overlap, {}
        self.old: dict[str, int] = {}
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        config = json.loads(self.tokenizer.to_str())
        splits = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
        self.proven = config.get("normalizer") == NORMALIZER and splits[0] == SPLIT and not any(c.isspace() for t in self.special for c in t)

    def encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def counts(self, texts: list[str]) -> list[int]:
        if not self.proven:
            return list(map(len, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)))
        short = [t.replace("\n", " ").split(" ") if len(t) <= self.huge else None for t in texts]
        if len(self.kept) > KEPT:
            self.kept, self.old = {}, self.kept
        kept, old = self.kept, self.old
        new = {p for pieces in short if pieces for p in pieces if p not in kept}
        kept.update((p, old[p]) for p in new if p in old)
        new = [p for p in new if p not in kept]
        for at in range(0, len(new), 8192):
            part = new[at : at + 8192]
            kept.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return [sum(map(kept.__getitem__, pieces)) if pieces is not None else len(spliced(t, self.encode, self.special, self.chunk, self.overlap)) for t, pieces in zip(texts, short, strict=True)]


OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit), a row for each row of docs.

    Null and empty text have no bytes and no tokens; texts of any length are counted whole; equal rows give equal rows; other
    columns are ignored.
    """
    path = path or tokenizer_path()

    def run(batches):
        counter = Counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                texts = [t or "" for t in batch.column(1)[at : at + 128].to_pylist()]
                n = counter.counts(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 128], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return doc_text(docs).mapInArrow(run, OUT)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
