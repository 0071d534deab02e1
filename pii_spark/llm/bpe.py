"""Byte-level BPE as a streaming transducer with a computed lookahead, and its incremental inverse."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenizer pattern that the vocabulary was made with. White space is spelled out
#: since engines differ in what else they count to it.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

#: The same for texts of Latin-1, in a form that is searched faster.
LATIN_PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[{l}]+| ?[{n}]+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+"
).format(l=r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", n=r"0-9\xb2\xb3\xb9\xbc-\xbe", s=r"\t-\r \x85\xa0")

#: Pre-tokens that a worker remembers, the longest one remembered, and characters that are cut at once.
CACHED_PIECES, CACHED_CHARS, CHARS_AT_ONCE = 800_000, 40, 1 << 16

#: Where a text can be cut without cutting a pre-token: before a single space.
CUT = re.compile(r"(?<=\S) (?=\S)")

#: What sorts behind every merge.
_NO_MERGE = (1 << 62, 0)

#: Bytes that the transducer reads beyond its lookahead before it emits.
BLOCK = 4096


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in vocabulary files of byte-level BPE: printable Latin-1
    characters for themselves, all other bytes for the code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Piece(NamedTuple):
    """A pre-token: its ids, these as decimals with commas, and the bytes that they decode to."""

    ids: tuple[int, ...]
    decimals: str
    decoded: bytes


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Bpe:
    """A vocabulary file: ids, merges by rank, and the sufficient lookahead of the merge list."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        to_byte = {c: b for b, c in byte_alphabet().items()}
        vocabulary = data["model"]["vocab"]
        self.token_bytes = {i: bytes(to_byte[c] for c in token) for token, i in vocabulary.items()}
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.token_bytes |= {i: content.encode() for content, i in self.specials.items()}
        self.decimals = {i: str(i) for i in self.token_bytes}
        self.byte_ids = [vocabulary[c] for _, c in sorted(byte_alphabet().items())]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(data["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[vocabulary[left], vocabulary[right]] = (rank, vocabulary[left + right])
        self.lookahead = self._lookahead()
        self.pieces, self.latin_pieces = regex.compile(PIECES), re.compile(LATIN_PIECES)
        names = "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))
        self.split_specials = regex.compile(f"({names})").split if names else lambda text: [text]
        self.known: dict[str, Piece] = {}

    def _lookahead(self) -> int:
        """How many bytes before the end of the input a token must end to be final.

        More input can change tokens only by a chain of merges from the end to the left. The first
        merge takes a token u that was last; what stands left of u changes only if a later merge has
        on its right the token that now begins where u began, hence one that has u as prefix; and so
        on, with rising ranks. The longest such chain, in bytes of its left parts, bounds the change.
        """
        reach: dict[bytes, int] = {}
        for left, right in self.merges:
            after = self.token_bytes[right]
            best = max((reach.get(after[:n], 0) for n in range(1, len(after) + 1)), default=0)
            before = self.token_bytes[left]
            reach[before] = max(reach.get(before, 0), best + len(before))
        return max(reach.values(), default=0) + max(map(len, self.token_bytes.values()))

    def merge(self, data: bytes) -> list[int]:
        """Token ids of a run of bytes: merges by rank, leftmost first."""
        return self._merge_short(data) if len(data) <= CACHED_CHARS else self._merge_long(data)

    def _merge_short(self, data: bytes) -> list[int]:
        ids, merge = [self.byte_ids[b] for b in data], self.merges.get
        found = [merge(pair, _NO_MERGE) for pair in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best is _NO_MERGE:
                break
            i, merged = found.index(best), best[1]
            ids[i : i + 2] = (merged,)
            del found[i]
            if i:
                found[i - 1] = merge((ids[i - 1], merged), _NO_MERGE)
            if i < len(found):
                found[i] = merge((merged, ids[i + 1]), _NO_MERGE)
        return ids

    def _merge_long(self, data: bytes) -> list[int]:
        ids: list[int | None] = [self.byte_ids[b] for b in data]
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        queue_key = lambda m, i, j: (m[0], m[1], i, ids[i], ids[j])
        # Entries order by rank, then by place: a rank has one merged id.
        while queue:
            _, merged, i, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = merged, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((merged, ids[k])):
                    heapq.heappush(queue, queue_key(m, i, k))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], merged))):
                heapq.heappush(queue, queue_key(m, h, i))
        return [i for i in ids if i is not None]

    def stream(self, data: bytes, block: int = BLOCK) -> Iterator[int]:
        """Ids of one pre-token, emitted once stable; at most lookahead + ``block`` bytes are held."""
        start = end = 0
        while end < len(data):
            end = min(len(data), max(end, start + self.lookahead) + block)
            held = self.merge(data[start:end])
            stable = len(data) if end == len(data) else end - self.lookahead
            for token in held:
                size = len(self.token_bytes[token])
                if start + size > stable:
                    break
                start += size
                yield token

    def _piece(self, piece: str) -> Piece:
        data = piece.encode()
        ids = tuple(self.merge(data) if len(data) <= BLOCK else self.stream(data))
        return Piece(ids, ",".join([self.decimals[i] for i in ids]), b"".join([self.token_bytes[i] for i in ids]))

    def _pieces(self, texts: list[str]) -> list[Piece]:
        known, long = self.known, []
        if len(known) >= CACHED_PIECES:
            known.clear()
        for text in set(texts).difference(known):
            known[text] = self._piece(text)
            if len(text) > CACHED_CHARS:
                long.append(text)
        found = [known[text] for text in texts]
        for text in long:
            del known[text]
        return found

    def cut(self, text: str) -> Iterator[list[Piece]]:
        """The pre-tokens of a text with their ids, a list for every ``CHARS_AT_ONCE`` characters."""
        for i, part in enumerate(self.split_specials(text)):
            if i % 2:
                special = self.specials[part]
                yield [Piece((special,), self.decimals[special], self.token_bytes[special])]
                continue
            find = (self.latin_pieces if _is_latin(part) else self.pieces).findall
            begin = 0
            while begin < len(part):
                space = CUT.search(part, begin + CHARS_AT_ONCE)
                end = space.start() if space else len(part)
                yield self._pieces(find(part[begin:end]))
                begin = end

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, list by list."""
        for pieces in self.cut(text):
            yield list(chain.from_iterable([p.ids for p in pieces]))


class Decoder:
    """Text of ids that come in lists: bytes of a character that is not complete wait for the next list."""

    def __init__(self, bpe: Bpe):
        self.token_bytes = bpe.token_bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        known = self.token_bytes
        return self.feed_bytes(b"".join([known[i] for i in ids]), last)

    def feed_bytes(self, data: bytes, last: bool = False) -> str:
        return self.state.decode(data, last)


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One vocabulary per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def _with_column(batch: pa.RecordBatch, array: pa.Array, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, array], names=[*batch.schema.names, name])


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` and a column of token ids. Null texts are empty. Special tokens in a text get their ids."""
    out = docs.drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = [list(chain.from_iterable(bpe.encode(t or ""))) for t in texts]
            yield _with_column(batch, pa.array(found, pa.list_(pa.int32())), ids)

    return out.mapInArrow(run, out.withColumn(ids, F.lit(None).cast("array<int>")).schema)


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``tokens`` and the text of a column of token ids; null ids are empty.

    Bytes that are no UTF-8 become U+FFFD, ids that the vocabulary lacks are an error.
    """
    out = tokens.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            lists = batch.column(ids).to_pylist()
            found = [Decoder(bpe).feed(one or [], last=True) for one in lists]
            yield _with_column(batch, pa.array(found, pa.string()), text)

    return out.mapInArrow(run, out.withColumn(text, F.lit("")).schema)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``docs`` (doc_id, text).

    Ids are hashed and decoded as they are emitted, so a text of any length holds one list of ids at a
    time. Every row gives a row: repeated rows and null ids too. An empty table gives an empty result.
    """

    def one(bpe: Bpe, text: str | None) -> tuple[int, str, str]:
        decoder, n = Decoder(bpe), 0
        of_ids, of_text = hashlib.sha256(), hashlib.sha256()
        for pieces in bpe.cut(text or ""):
            # An empty list comes from no text: every piece has ids.
            of_ids.update(("," * (n > 0) + ",".join([p.decimals for p in pieces])).encode())
            of_text.update(decoder.feed_bytes(b"".join([p.decoded for p in pieces])).encode())
            n += sum([len(p.ids) for p in pieces])
        of_text.update(decoder.feed([], last=True).encode())
        return n, of_ids.hexdigest(), of_text.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            made = [one(bpe, t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*made, strict=True)) or [[], [], []]
            types = [pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
