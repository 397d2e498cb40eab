"""SentencePiece encoding with source offsets, and decoding.

Encoding first normalises a text the way the model says: at each place the
longest key of the model's compiled character map that matches is replaced,
and a dummy prefix and escaped spaces are added.  Every normalised byte keeps
the source byte it came from.  The pieces of the library tile the normalised
text, so their borders are projected through that alignment to byte spans of
the original text.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_MARK = "▁".encode()
BATCH_DOCS = 64


def charsmap_entries(blob: bytes) -> dict[bytes, bytes]:
    """The keys and replacements of a compiled character map.

    The map is a 32-bit trie size, a double-array trie over UTF-8 keys whose
    values are offsets, and the replacement strings, each ended by a zero.
    """
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units, strings = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
    label = lambda u: u & 0x800000FF
    step = lambda u: (u >> 10) << ((u & 0x200) >> 6)
    found, open_ = {}, [(0, b"")]
    while open_:
        at, key = open_.pop()
        base = at ^ step(units[at])
        if units[at] & 0x100:
            begin = units[base] & 0x7FFFFFFF
            found[key] = strings[begin : strings.index(b"\0", begin)]
        open_ += [(base ^ c, key + bytes([c])) for c in range(1, 256) if (base ^ c) < len(units) and label(units[base ^ c]) == c]
    return found


@dataclass(frozen=True)
class Normaliser:
    """A model's normalisation, with the source byte of each result byte."""

    entries: dict[bytes, bytes]
    dummy_prefix: bool
    remove_extra: bool
    escape: bool

    @classmethod
    def of(cls, spec) -> Normaliser:
        return cls(charsmap_entries(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and for the end its source byte."""
        if not text:
            return b"", np.zeros(1, "int64")
        if not self.entries and not self.remove_extra:
            return self._plain(text)
        out, src = bytearray(), []
        longest = max(map(len, self.entries), default=0)
        lead = {k[0] for k in self.entries}
        at = 0
        chunks = []
        while at < len(text):
            took = 0
            if text[at] in lead:
                took = next((k for k in range(min(longest, len(text) - at), 0, -1) if text[at : at + k] in self.entries), 0)
            if took:
                chunks.append((at, took, self.entries[text[at : at + took]]))
            else:
                b = text[at]
                took = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                chunks.append((at, took, text[at : at + took]))
            at += took
        if self.remove_extra:
            while chunks and chunks[0][2] in (b"", b" "):
                chunks.pop(0)
        if not chunks:
            return b"", np.asarray([len(text)])
        mark = SPACE_MARK if self.escape else b" "
        if self.dummy_prefix:
            out += mark
            src += [chunks[0][0]] * len(mark)
        blank = self.remove_extra
        end = len(text)
        for at, _, new in chunks:
            if blank:
                new = new.lstrip(b" ")
            for b in new:
                if b == 0x20:
                    out += mark
                    src += [at] * len(mark)
                else:
                    out.append(b)
                    src.append(at)
            if new:
                blank = self.remove_extra and new.endswith(b" ")
        if self.remove_extra:
            while out.endswith(mark):
                end = src[-len(mark)]
                del out[-len(mark) :], src[-len(mark) :]
        return bytes(out), np.asarray([*src, end], "int64")

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Without a map only the spaces change, so the alignment is arithmetic."""
        mark = SPACE_MARK if self.escape else b" "
        raw = np.frombuffer(text, "u1")
        src = np.repeat(np.arange(len(raw)), np.where(raw == 0x20, len(mark), 1))
        lead = len(mark) if self.dummy_prefix else 0
        return (mark if lead else b"") + text.replace(b" ", mark), np.concatenate((np.zeros(lead, "int64"), src, [len(raw)]))


class Codec:
    """A model file with its library processor, normaliser and piece lengths."""

    def __init__(self, model: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as f:
            spec.ParseFromString(f.read())
        self.normalise = Normaliser.of(spec.normalizer_spec)
        #: Normalised bytes that a piece covers: a byte piece covers one.
        self.covers = np.asarray([1 if p.type == p.BYTE else len(p.piece.encode()) for p in spec.pieces])
        self.unknown = {i for i, p in enumerate(spec.pieces) if p.type == p.UNKNOWN}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.processor.decode(ids, num_threads=1)

    def spans(self, text: str, ids: list[int]) -> np.ndarray:
        """Source byte spans of the pieces, one row (begin, end) each.

        Pieces that share a source character, as byte pieces of one character
        do not but parts of one replacement do, start at the same byte; the
        dummy prefix has no source bytes.
        """
        normal, source = self.normalise(text.encode())
        sizes = self.covers[np.asarray(ids, "int64")]
        ends = np.cumsum(sizes)
        if len(ids) and (self.unknown.intersection(ids) or ends[-1] != len(normal)):
            return self._library_spans(text)
        return np.stack((source[ends - sizes], source[ends]), 1) if len(ids) else np.zeros((0, 2), "int64")

    def _library_spans(self, text: str) -> np.ndarray:
        """Where an unknown piece has no fixed length, the library's own offsets count."""
        proto = self.processor.encode(text, return_type="proto")
        return np.asarray([(p.begin, p.end) for p in proto.pieces], "int64").reshape(-1, 2)


@lru_cache(maxsize=2)
def codec(model: str) -> Codec:
    return Codec(model)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_decode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model=default_model) -> DataFrame:
    """Encode every whole text and decode it again.

    ``model`` gives the model file's path on whatever machine it is called.
    Returns ``id_col``, ``ids`` (array<int>), ``span_begin`` and ``span_end``
    (array<int>, source bytes of each piece) and ``decoded``.

    A null or empty text has no pieces and decodes to the empty text; very
    long texts are encoded whole, one at a time; repeated rows and null ids
    are kept; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model())
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(lo, BATCH_DOCS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = c.encode(texts)
                spans = [c.spans(t, i) for t, i in zip(texts, ids, strict=True)]
                edges = pa.array(np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype("int32"))
                flat = lambda parts: pa.ListArray.from_arrays(edges, pa.array(np.concatenate(parts).astype("int32")))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), flat([np.asarray(i, "int32") for i in ids]), flat([s[:, 0] for s in spans]), flat([s[:, 1] for s in spans]), pa.array(c.decode(ids), pa.string())],
                    ["doc", "ids", "span_begin", "span_end", "decoded"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(run, "doc long, ids array<int>, span_begin array<int>, span_end array<int>, decoded string")
    return out.withColumnRenamed("doc", id_col)
