"""SentencePiece ids with the byte span of every piece in the original text, and decoding.

The text is normalised here: at each place the longest prefix that the model's compiled character map
knows is replaced, anything else is copied, white space is escaped, and every byte of the result records
the byte of the original that it came from. The library segments the normalised text; adding up piece
lengths and looking up the recorded bytes gives the original span of each piece.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_SPACE = SPACE.encode()


class CharMap:
    """A compiled map: a double-array trie over the keys, then the replacements, ended by zero bytes."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0]
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.targets = blob[4 + size :]
        self.first = [self._child(0, b) is not None for b in range(256)]

    def _offset(self, unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _child(self, node: int, byte: int) -> int | None:
        nxt = node ^ self._offset(self.units[node]) ^ byte
        if nxt >= len(self.units) or self.units[nxt] & 0x800000FF != byte:
            return None
        return nxt

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that begins at ``at``."""
        node, best = 0, None
        for i in range(at, len(data)):
            node = self._child(node, data[i])
            if node is None:
                break
            unit = self.units[node]
            if unit >> 8 & 1:
                value = self.units[node ^ self._offset(unit)] & 0x7FFFFFFF
                best = i + 1 - at, value
        if best is None:
            return None
        end = self.targets.index(b"\0", best[1])
        return best[0], self.targets[best[1] : end]


class PieceCodec:
    """Normalisation, segmentation and decoding by one model; made once in a task."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            raw = f.read()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(raw)
        spec = model.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        kinds = model.SentencePiece
        pieces = [(p.piece, p.type) for p in model.pieces]
        self.sizes = np.array([1 if t == kinds.BYTE else 0 if t == kinds.CONTROL else len(p.encode()) for p, t in pieces], np.int64)
        self.unknown = next((i for i, (_, t) in enumerate(pieces) if t == kinds.UNKNOWN), -1)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.end_id = self.library.eos_id()
        plain = model.normalizer_spec
        plain.name, plain.precompiled_charsmap = "identity", b""
        plain.add_dummy_prefix = plain.remove_extra_whitespaces = plain.escape_whitespaces = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and the original byte of each of them and of the end."""
        data = text.encode()
        if self.map is None and not self.squeeze and not self.suffix:
            return self._copied(data)
        out, source, at = bytearray(), [], 0
        while at < len(data):
            found = self.map.longest(data, at) if self.map is not None and self.map.first[data[at]] else None
            if found is None:
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = n, data[at : at + n]
            n, value = found
            last_space = not out or out[-1] == 32
            if self.squeeze and last_space:
                value = value.lstrip(b" ")
            out += value
            source += [at] * len(value)
            at += n
        end = len(data)
        if self.squeeze:
            while tail := next((t for t in (b" ", _SPACE) if out.endswith(t) and (self.escape or t == b" ")), b""):
                end = source[-len(tail)]
                del out[-len(tail) :], source[-len(tail) :]
        if not out:
            return b"", np.zeros(1, np.int64)
        if self.prefix:
            if self.suffix:
                out += b" "
                source.append(end)
            else:
                out, source = bytearray(b" ") + out, [source[0], *source]
        return self._escaped(np.frombuffer(bytes(out), np.uint8), np.array([*source, end], np.int64))

    def _copied(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int64)
        source = np.arange(len(data) + 1)
        if self.prefix:
            data, source = b" " + data, np.concatenate(([0], source))
        return self._escaped(np.frombuffer(data, np.uint8), source)

    def _escaped(self, data: np.ndarray, source: np.ndarray) -> tuple[bytes, np.ndarray]:
        if not self.escape:
            return data.tobytes(), source
        widths = np.where(data == 32, 3, 1)
        return data.tobytes().replace(b" ", _SPACE), np.append(np.repeat(source[:-1], widths), source[-1])

    def encode(self, texts: list[str]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        """Per text its ids without special ones, and start and end of each piece in the original bytes."""
        normal, source = zip(*map(self.normalise, texts), strict=True) if texts else ((), ())
        words = [x.decode() for x in normal]
        out = []
        for ids, word, data, where in zip(self.segmenter.encode(words, num_threads=1), words, normal, source, strict=True):
            at = np.array(ids, np.int64)
            sizes = self.sizes[at]
            if (at == self.unknown).any():
                sizes = np.where(at == self.unknown, [len(p.encode()) for p in self.segmenter.encode(word, out_type=str)], sizes)
            ends = np.cumsum(sizes)
            if len(data) != (ends[-1] if len(ends) else 0):
                raise ValueError("the pieces do not add up to the normalised text")
            out.append((ids, where[ends - sizes], where[ends]))
        return out


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends): the ids with the end id last, and the original byte span of each piece.

    A null or empty text has the end id only. The end id spans nothing. A null id stays null; repeated rows
    each get a row; extra columns are ignored; an empty table gives no rows. Texts are worked on whole and
    one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                cols: list[list] = [[], [], []]
                texts = [x or "" for x in part.column(1).to_pylist()]
                for text, (ids, starts, ends) in zip(texts, codec.encode(texts), strict=True):
                    size = len(text.encode())
                    for col, x in zip(cols, ([*ids, codec.end_id], np.append(starts, size), np.append(ends, size)), strict=True):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.list_(pa.int32())) for c in cols]], ["doc_id", "ids", "starts", "ends"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode_pieces(tokens: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) decoded from arrays of ids; a null or empty array gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model)
        for batch in batches:
            texts = [codec.library.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes_spanned long"


def piece_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of what ``encode_pieces`` and ``decode_pieces`` give for every row, without moving the ids.

    ``n_bytes_spanned`` adds up the original bytes under the pieces: all of them unless the model drops
    white space. Nulls, empty texts, ties and extra columns are treated as there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                rows = []
                for ids, starts, ends in codec.encode([x or "" for x in part.column(1).to_pylist()]):
                    ids.append(codec.end_id)
                    sha = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
                    back = hashlib.sha256(codec.library.decode(ids).encode()).hexdigest()
                    rows.append([len(ids), sha, back, int((ends - starts).sum())])
                names = ["n_tokens", "ids_sha256", "decoded_sha256", "n_bytes_spanned"]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, zip(*rows, strict=True))], ["doc_id", *names])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, DIGESTS)
