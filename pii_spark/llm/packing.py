"""Documents as token pieces, packed into sequences by bounded-space online best fit."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pii_spark.llm.bpe import byte_alphabet
from pii_spark.llm.common import free_name, written

#: Pieces whose ids a task remembers, the longest one remembered, and bytes of text encoded at once.
CACHED_PIECES, CACHED_BYTES, BYTES_AT_ONCE = 500_000, 48, 1 << 20

#: Fixed value: the pieces that the tokenizer cuts a text into, for texts of Latin-1 whose only characters
#: beyond ASCII are letters. ASCII is lower-cased before, other capitals after.
_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xc0-\xff]+|[0-9]|[^\s0-9a-z\xc0-\xff]+")

#: Characters of Latin-1 that other texts have: signs, and control characters that engines differ on.
_OTHER = bytes([*range(0x1C, 0x20), *range(0x80, 0xC0), 0xD7, 0xF7])


def simple_pieces(text: bytes) -> list[bytes] | None:
    """The pieces of a text in Latin-1, None if it holds other characters or the start of a special token."""
    try:
        latin = text.decode().encode("latin-1")
    except UnicodeEncodeError:
        return None
    if len(latin.translate(None, _OTHER)) < len(latin) or b"<|" in latin:
        return None
    return _PIECES.findall(latin.lower())


class WordEncoder:
    """Ids of texts, by a tokenizer that lower-cases, drops white space and cuts texts into pieces.

    A text of ASCII and Latin-1 letters is cut by ``simple_pieces``, and the tokenizer's model gives the
    ids of each distinct piece once. All other texts go through the tokenizer word by word, parted at
    ASCII white space, which it drops.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()
        self.known: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def _of_piece(self, piece: bytes) -> bytes:
        text = piece.decode("latin-1")
        if not piece.isalpha():
            text = text.lower().encode().decode("latin-1").translate(self.alphabet)
        ids = [token.id for token in self.model.tokenize(text)]
        return pack_ids(f"<{len(ids)}I", *ids)

    def _by_word(self, text: bytes) -> bytes:
        words = text.split()
        fresh = list(set(words) - self.words.keys())
        found = self.tokenizer.encode_batch([w.decode() for w in fresh], add_special_tokens=False)
        self.words.update((w, pack_ids(f"<{len(e.ids)}I", *e.ids)) for w, e in zip(fresh, found, strict=True))
        out = b"".join([self.words[w] for w in words])
        if len(self.words) > CACHED_PIECES // 8 or any(len(w) > CACHED_BYTES for w in fresh):
            self.words.clear()
        return out

    def forget(self) -> None:
        """Workers live on after a task, and what they remember would add up with what other stages need."""
        self.known.clear()
        self.words.clear()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [simple_pieces(text) for text in texts]
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        known, long = self.known, []
        for piece in set().union(*filter(None, cut)).difference(known):
            known[piece] = self._of_piece(piece)
            if len(piece) > CACHED_BYTES:
                long.append(piece)
        ids = known.__getitem__
        out = [self._by_word(text) if pieces is None else b"".join(map(ids, pieces)) for text, pieces in zip(texts, cut, strict=True)]
        for piece in long:
            del known[piece]
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def in_groups(encoder: WordEncoder, texts: list[bytes]) -> Iterator[bytes]:
    """Ids of each text, encoded by groups of about ``BYTES_AT_ONCE``."""
    begin = size = 0
    for end, text in enumerate(texts, 1):
        size += len(text)
        if size >= BYTES_AT_ONCE or end == len(texts):
            yield from encoder.encode(texts[begin:end])
            begin, size = end, 0


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of ``docs`` (doc_id, text).

    A document is its ids and ``end_id``; only one of more than ``capacity`` ids is cut, into pieces
    of ``capacity``, the last of which may be shorter. Null texts are empty: one piece with
    ``end_id``. Repeated rows and null ids give pieces of their own.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * keep_ids
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
        for batch in batches:
            rows = []
            texts = [text or b"" for text in batch.column(1).cast(pa.binary()).to_pylist()]
            for key, ids in zip(batch.column(0).to_pylist(), in_groups(encoder, texts), strict=True):
                ids += end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    row = (key, at // step, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4").astype("i4")) if keep_ids else row)
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        encoder.forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in order of arrival.

    Open bins are kept by their free space, whose values are the set bits of one integer. A length
    goes to the open bin with the least sufficient space, else into a new bin. If ``open_bins`` are
    open then, the fullest closes first.
    """
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces, n_open, n_bins = 0, 0, 0
    bins, offsets = [], []
    for length in lengths:
        fitting = spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            chosen = by_space[space].pop()
            if not by_space[space]:
                spaces ^= 1 << space
            n_open -= 1
        else:
            if n_open >= open_bins:
                fullest = (spaces & -spaces).bit_length() - 1
                by_space[fullest].pop()
                if not by_space[fullest]:
                    spaces ^= 1 << fullest
                n_open -= 1
            chosen, space = n_bins, capacity
            n_bins += 1
        bins.append(chosen)
        offsets.append(capacity - space)
        left = space - length
        if left:
            if not by_space[left]:
                spaces |= 1 << left
            by_space[left].append(chosen)
            n_open += 1
    return bins, offsets


def pack(
    pieces: DataFrame, capacity: int = 4096, open_bins: int = 65_536, rows_per_stream: int = 65_536
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (``length`` from 1 to ``capacity``).

    The pieces are dealt by hash of a row number into streams of about ``rows_per_stream``, whatever
    their ids, so no key can overfill one. Each stream is one online best fit, in which the longest
    pieces arrive first. More pieces make more streams; each leaves a few sequences partly empty. Other
    columns pass through whatever their names, nulls included; ``sequence_id`` and ``offset`` are
    replaced. Equal rows are pieces of their own. An empty table gives an empty result. ``pieces`` is written to the shared folder.
    """
    row, made = free_name(pieces, "_row"), ("sequence_id", "offset")
    rest = pieces.select(*[c for c in pieces.columns if c not in made])
    kept = written(rest.withColumn(row, F.monotonically_increasing_id()), "pieces")
    streams = max(1, round(kept.count() / rows_per_stream))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row"], ascending=[False, True])
        bins, offsets = best_fit(group["length"].tolist(), capacity, open_bins)
        base = int(group["stream"].iloc[0]) << 32
        return pd.DataFrame({row: group["row"], "sequence_id": np.array(bins, "i8") + base, "offset": offsets})

    placed = (
        kept.select(F.col(row).alias("row"), "length", F.pmod(F.xxhash64(row), F.lit(streams)).alias("stream"))
        .groupBy("stream")
        .applyInPandas(fill, f"`{row}` long, sequence_id long, offset long")
    )
    return kept.join(placed, row).drop(row)


def packed_ids(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the sequences of ``pack`` over pieces that kept their ``ids``.

    A sequence holds at most ``capacity`` ids, so each group is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
