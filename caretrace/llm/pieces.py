"""Subword encoding with source offsets: longest-prefix normalisation, segmentation, projection to original bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

SPACE = "▁"
SPACE_BYTES = SPACE.encode()
#: Documents handed back to Spark at a time, in bytes of text.
BATCH_BYTES = 1 << 20


class CharacterMap:
    """The compiled character map of a model: a double-array trie of UTF-8 prefixes and their replacements."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist() if blob else []
        self.replacements = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest key that ``data`` has at ``at``; None without one."""
        if not self.units:
            return None
        units, best = self.units, None
        node = self._child_base(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= self._child_base(unit)
            if unit >> 8 & 1:
                best = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        end = self.replacements.index(b"\0", best[1])
        return best[0], self.replacements[best[1] : end]

    @staticmethod
    def _child_base(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Encoder:
    """A model file opened twice: as it is for decoding, and without its normaliser for segmenting normalised text."""

    def __init__(self, model_path: str) -> None:
        with open(model_path, "rb") as f:
            blob = f.read()
        proto = model_pb2.ModelProto()
        proto.ParseFromString(blob)
        rules = proto.normalizer_spec
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.dummy_prefix, self.squeeze, self.escape = rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces
        self.suffix_space = proto.trainer_spec.treat_whitespace_as_suffix
        self.fixed = sorted((p.piece.encode() for p in proto.pieces if p.type == p.USER_DEFINED), key=len, reverse=True)
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=blob)
        rules.name, rules.precompiled_charsmap = "identity", b""
        rules.add_dummy_prefix = rules.remove_extra_whitespaces = rules.escape_whitespaces = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        kinds = [p.type for p in proto.pieces]
        self.end_id = proto.trainer_spec.eos_id
        self.unknown_id = proto.trainer_spec.unk_id
        self.width = np.array([1 if k == 6 else len(p.piece.encode()) for k, p in zip(kinds, proto.pieces, strict=True)], dtype=np.int64)  # 6: a single byte

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, original byte offset of each of its bytes, and one more for the end)."""
        data = text.encode()
        if not self.map.units and not self.fixed:
            norm, at = np.frombuffer(data, np.uint8), np.arange(len(data) + 1)
        else:
            out, places, i = bytearray(), [], 0
            while i < len(data):
                piece = next((p for p in self.fixed if data.startswith(p, i)), None)
                used, new = (len(piece), piece) if piece else self.map.longest(data, i) or self._one(data, i)
                out += new
                places += [i] * len(new)
                i += used
            norm, at = np.frombuffer(bytes(out), np.uint8), np.array([*places, len(data)], dtype=np.int64)
        space = norm == 32
        if self.squeeze:  # single spaces inside, none at the ends
            keep = ~space
            keep[1:] |= ~space[:-1]
            full = np.flatnonzero(~space)
            keep[full[-1] + 1 if len(full) else 0 :] = False
            keep[: full[0] if len(full) else 0] = False
            end = at[full[-1] + 1] if len(full) else at[-1]
            norm, at = norm[keep], np.append(at[:-1][keep], end)
        if self.dummy_prefix and len(norm):
            norm, at = (np.append(norm, 32), np.append(at, at[-1])) if self.suffix_space else (np.append(np.uint8(32), norm), np.append(at[0], at))
        if not self.escape:
            return norm.astype(np.uint8).tobytes().decode(), at
        times = np.where(norm == 32, len(SPACE_BYTES), 1)
        return norm.astype(np.uint8).tobytes().replace(b" ", SPACE_BYTES).decode(), np.append(np.repeat(at[:-1], times), at[-1])

    @staticmethod
    def _one(data: bytes, i: int) -> tuple[int, bytes]:
        n = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
        return n, data[i : i + n]

    def encode(self, text: str, offsets: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids with the end id, begin and end byte of each in the original text); the end id stands at the end."""
        norm, at = self.normalise(text)
        ids = np.array(self.segmenter.encode(norm), dtype=np.int32)
        if not offsets:
            none = np.zeros(0, np.int32)
            return np.append(ids, np.int32(self.end_id)), none, none
        if self.unknown_id in ids:  # such a piece is as long as its surface
            pieces = self.segmenter.encode(norm, return_type="proto").pieces
            width = np.array([len(p.surface.encode()) for p in pieces], dtype=np.int64)
        else:
            width = self.width[ids]
        ends = np.cumsum(width)
        if len(ids) and ends[-1] != len(at) - 1:
            raise ValueError("pieces do not cover the normalised text")
        starts = ends - width
        tail = np.int32(at[-1])
        return np.append(ids, np.int32(self.end_id)), np.append(at[starts].astype(np.int32), tail), np.append(at[ends].astype(np.int32), tail)

    def decode(self, ids: np.ndarray) -> str:
        return self.decoder.decode(ids.tolist())


@lru_cache(maxsize=4)
def encoder(model_path: str) -> Encoder:
    """One encoder per Python worker and model."""
    return Encoder(model_path)


def encode_documents(docs: DataFrame, model_path: str, offsets: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, begins, ends, decoded) per document; one pass, no shuffle.

    ``ids`` are the piece ids with an end id, ``begins`` and ``ends`` the span of each piece in bytes of the original
    UTF-8 text (empty arrays without ``offsets``), ``decoded`` the text the ids decode to. The model's path must be
    readable on every executor; the file is opened once per Python worker.

    * null counts as empty: the end id alone, decoded to the empty text
    * texts of any length are encoded as a whole; batches are cut by bytes, so memory follows the longest text
    * repeated rows are encoded each; an empty table gives an empty result; other columns are ignored
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(model_path)

        def packed(keys: list, rows: list) -> pa.RecordBatch:
            def lists(k: int) -> pa.Array:
                sizes = np.array([0, *(len(r[k]) for r in rows)], dtype=np.int32)
                return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(np.concatenate([r[k] for r in rows])))

            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), lists(0), lists(1), lists(2), pa.array([r[3] for r in rows], pa.string())], ["id", "ids", "begins", "ends", "decoded"])

        for batch in batches:
            keys, rows, held = [], [], 0
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                ids, begins, ends = model.encode(text, offsets)
                keys.append(batch.column(0).slice(i, 1))
                rows.append((ids, begins, ends, model.decode(ids)))
                held += len(text) + 16
                if held >= BATCH_BYTES:
                    yield packed(keys, rows)
                    keys, rows, held = [], [], 0
            if rows:
                yield packed(keys, rows)

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, ids array<int>, begins array<int>, ends array<int>, decoded string").withColumnRenamed("id", id_col)
