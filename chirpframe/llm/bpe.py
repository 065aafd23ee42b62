"""Byte-level BPE: token ids, character offsets, and decoding.

A vocabulary file lists byte strings with their ranks. The ``tokenizers``
library works on characters, so every byte is shown to it as one character (a
fixed table); each way to cut a token into two known tokens becomes a merge with
the token's rank. Texts are cut by the vocabulary's pattern first, and pieces
that a worker has met before come from a bounded cache. Decoding turns the
characters back to bytes; a character whose bytes are spread over several
tokens appears with the token that completes it.

Defined cases: null text encodes as empty (no ids), and so decodes to empty bytes. Long texts
are encoded whole. Rows are independent, so ties, repeats and empty tables need no rule. The
columns added (``ids``, ``starts``, ``ends``, ``decoded``, ``decoded_text``) replace columns of
those names; all other columns pass through.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

CACHED_PIECES = 300_000
ROWS = 256


def byte_table() -> list[str]:
    """Character for each byte: printable Latin-1 bytes as themselves, the rest from U+0100 on, in byte order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = [""] * 256
    for byte in plain:
        table[byte] = chr(byte)
    spare = iter(range(0x100, 0x200))
    return [c or chr(next(spare)) for c in table]


_TABLE = byte_table()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Decoder:
    """Bytes of each id, by reversing the byte table."""

    def __init__(self, path: str):
        back = {c: b for b, c in enumerate(byte_table())}
        shown = {rank: shown_token(token) for token, rank in read_ranks(path).items()}
        self.tokens = [b""] * (max(shown, default=-1) + 1)
        for rank, token in shown.items():
            self.tokens[rank] = bytes(back[c] for c in token)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist() if hasattr(ids, "tolist") else ids))

    def decode_pieces(self, ids) -> Iterator[str]:
        """Text that each token completes; bytes that never make a character give U+FFFD at the end."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        last = len(ids) - 1
        for i, token in enumerate(ids):
            yield decoder.decode(self.tokens[token], final=i == last)

    def offsets(self, text: str | None, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character range of each token; parts of one character share its range."""
        if not len(ids):
            return np.empty(0, np.int32), np.empty(0, np.int32)
        raw = np.frombuffer((text or "").encode("utf-8"), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # byte -> character
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        return char[starts].astype(np.int32), (char[ends - 1] + 1).astype(np.int32)


def shown_token(token: bytes) -> str:
    """A byte string as the library sees it."""
    return "".join(map(_TABLE.__getitem__, token))


class Encoder:
    """Ids of texts for one vocabulary file and pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        merges = []
        for token, _ in sorted(ranks.items(), key=lambda item: item[1]):
            cuts = [(token[:i], token[i:]) for i in range(1, len(token))]
            known = [(a, b) for a, b in cuts if a in ranks and b in ranks]
            merges += [(shown_token(a), shown_token(b)) for a, b in sorted(known, key=lambda ab: ranks[ab[0]])]
        vocab = {shown_token(token): rank for token, rank in ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab, merges, cache_capacity=0, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        """Encode pieces not met before, all in one call; ids are kept as packed int32."""
        if len(self.cache) > CACHED_PIECES:
            self.cache.clear()
        new = [p for p in pieces if p not in self.cache]
        if not new:
            return
        found = self.tokenizer.encode(new, is_pretokenized=True, add_special_tokens=False)
        packed = np.array(found.ids, np.int32).tobytes()
        cut = (np.searchsorted(np.array(found.word_ids), np.arange(len(new) + 1)) * 4).tolist()
        for piece, a, b in zip(new, cut, cut[1:]):
            self.cache[piece] = packed[a:b]

    def encode(self, text: str | None) -> np.ndarray:
        pieces = self.pattern.findall(text or "")
        try:
            joined = b"".join(map(self.cache.__getitem__, pieces))
        except KeyError:
            self._learn(set(pieces))
            joined = b"".join(map(self.cache.__getitem__, pieces))
        return np.frombuffer(joined, np.int32)


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@lru_cache(maxsize=4)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))


def _added(df: DataFrame, keep: list[str] | None, new: str, run) -> DataFrame:
    """``df``'s columns ``keep`` (default: all) and the columns ``new`` that ``run`` computes for each record batch.

    Batches are cut to ``ROWS`` rows before ``run`` sees them, so what a task holds is one batch of Spark's
    (bounded in bytes) and the results of a few rows.
    """
    added = StructType.fromDDL(new)
    kept = [c for c in (df.columns if keep is None else keep) if c not in added.names]
    schema = StructType([*[df.schema[c] for c in kept], *added.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *run(part)], names=schema.names)

    return df.mapInArrow(work, schema)


def encode(
    docs: DataFrame, path: str, pattern: str, offsets: bool = False, round_trip: bool = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``ids`` (array<int>); with ``offsets`` character ``starts`` and ``ends``; with ``round_trip`` also ``decoded``.

    ``keep`` names the columns of ``docs`` to return (all by default).
    """

    def run(part: pa.RecordBatch) -> list[pa.Array]:
        texts = part.column("text").to_pylist()
        ids = [encoder(path, pattern).encode(t) for t in texts]
        out = [_lists(ids)]
        if offsets:
            pairs = [decoder(path).offsets(t, i) for t, i in zip(texts, ids)]
            out += [_lists([a for a, _ in pairs]), _lists([b for _, b in pairs])]
        if round_trip:
            out.append(pa.array([decoder(path).decode(i) for i in ids], pa.binary()))
        return out

    new = "ids array<int>" + ", starts array<int>, ends array<int>" * offsets + ", decoded binary" * round_trip
    return _added(docs, keep, new, run)


def decode(encoded: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """Add ``decoded`` (bytes) and ``decoded_text`` (its characters, U+FFFD for bytes that make none) from ``ids``."""

    def run(part: pa.RecordBatch) -> list[pa.Array]:
        raw = [decoder(path).decode(i or []) for i in part.column("ids").to_pylist()]
        return [pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())]

    return _added(encoded, keep, "decoded binary, decoded_text string", run)
