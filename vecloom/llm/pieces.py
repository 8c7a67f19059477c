"""SentencePiece encoding and decoding with byte offsets into the original text.

``Normalizer`` reads the model's compiled character map (a double-array trie and its replacement strings),
replaces the longest matching prefix at each place and records from which source byte each normalised
byte comes. The library's merges give the pieces; their lengths in the normalised text, projected through
that record, give every piece its byte span in the original.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import map_batches, texts, typed

ESCAPED_SPACE = "▁".encode()


class Normalizer:
    """Text normalisation of a SentencePiece model, with alignment."""

    def __init__(self, spec):
        self.add_dummy_prefix = spec.add_dummy_prefix
        self.remove_extra = spec.remove_extra_whitespaces
        self.escape = spec.escape_whitespaces
        blob = spec.precompiled_charsmap
        self.units, self.strings = None, b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
            self.strings = blob[4 + size :]

    def longest_match(self, data: bytes, at: int) -> tuple[int, int]:
        """Length of the longest key of the map that starts at ``at``, and where its replacement stands."""
        units, node, best, found = self.units, 0, 0, -1
        unit = units[0]
        node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for i in range(at, len(data)):
            byte = data[i]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != byte:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                best, found = i - at + 1, units[node] & ((1 << 31) - 1)
        return best, found

    def step(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What stands for the source bytes from ``at`` on, and how many these are."""
        if self.units is not None:
            n, where = self.longest_match(data, at)
            if n:
                return self.strings[where : self.strings.index(b"\0", where)], n
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + n], n

    def normalize(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and for the end the source byte it comes from."""
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.units is None and not self.remove_extra:
            return self._plain(data)
        at = 0
        if self.remove_extra:
            while at < len(data):
                piece, n = self.step(data, at)
                if piece != b" ":
                    break
                at += n
            if at == len(data):
                return b"", np.array([len(data)], np.int64)
        space = ESCAPED_SPACE if self.escape else b" "
        out, source = bytearray(), []
        if self.add_dummy_prefix:
            out += space
            source += [at] * len(space)
        after_space = self.remove_extra
        while at < len(data):
            piece, n = self.step(data, at)
            while after_space and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                shown = piece.replace(b" ", space) if self.escape else piece
                out += shown
                source += [at] * len(shown)
                after_space = self.remove_extra and piece.endswith(b" ")
            at += n
        if self.remove_extra:
            while out.endswith(space):
                at = source[len(out) - len(space)]
                del out[-len(space) :], source[len(out) :]
        source.append(at)
        return bytes(out), np.array(source, np.int64)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """No map and no spaces to remove: only spaces change their form."""
        space = ESCAPED_SPACE if self.escape else b" "
        raw = np.frombuffer(data, np.uint8)
        width = np.where(raw == 0x20, len(space), 1)
        source = np.repeat(np.arange(len(data)), width)
        prefix = space if self.add_dummy_prefix else b""
        return prefix + data.replace(b" ", space), np.concatenate([np.zeros(len(prefix), np.int64), source, [len(data)]])


class PieceCodec:
    """Encodes texts to ids with original byte spans, and decodes ids; exactly the library's ids and texts."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        self.normalizer = Normalizer(model.normalizer_spec)
        byte = pb.ModelProto.SentencePiece.BYTE
        self.width = np.array([1 if p.type == byte else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.unknown = self.library.unk_id() if not model.trainer_spec.byte_fallback else -1

    def ends(self, data: bytes, ids: list[int]) -> np.ndarray | None:
        """The source byte at which each piece ends; a piece starts where the one before it ends.

        An unknown piece has no length of its own: it takes what the others leave if it is the only one. None where
        spans can't be told: with several unknown pieces, and for models whose pieces do not spell the normalised text.
        """
        normal, source = self.normalizer.normalize(data)
        width = self.width[np.array(ids, np.int64)] if ids else np.zeros(0, np.int64)
        if self.unknown in ids:
            unknown = np.flatnonzero(np.array(ids) == self.unknown)
            if len(unknown) > 1:
                return None
            width[unknown] = len(normal) - (width.sum() - width[unknown[0]])
        end = np.cumsum(width)
        return source[end] if (end[-1] if len(end) else 0) == len(normal) and (width >= 0).all() else None

    def encode(self, batch: list[str]) -> list[tuple[list[int], np.ndarray | None]]:
        return [(ids, self.ends(text.encode(), ids)) for text, ids in zip(batch, self.library.encode(batch, num_threads=1))]

    def decode(self, batch: list[list[int]]) -> list[str]:
        return self.library.decode(batch, num_threads=1)


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The codec of a model file, loaded once in each Python process."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, *, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, ends array<long>: each piece's end in the original text's UTF-8 bytes (null: see ``PieceCodec.ends``).

    Null counts as empty and gives no ids. Every row gives one row, repeated rows too; an empty table gives
    an empty result; other columns are dropped. The model file must exist on every executor at the same
    path (None: the file of the installed package there).
    """

    def run(batch: pa.RecordBatch) -> dict:
        out = codec(model or model_path()).encode(texts(batch, "text"))
        return {"doc_id": batch.column("doc_id"), "ids": [x for x, _ in out], "ends": [x for _, x in out]}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, f"{typed(rows, 'doc_id')}, ids array<int>, ends array<long>", 64)


def decode(encoded: DataFrame, *, model: str | None = None) -> DataFrame:
    """doc_id, text: the decoded ids; null ids give an empty text."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "text": codec(model or model_path()).decode([x or [] for x in batch.column("ids").to_pylist()])}

    rows = encoded.select("doc_id", "ids")
    return map_batches(rows, run, f"{typed(rows, 'doc_id')}, text string", 64)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def round_trip(docs: DataFrame, *, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Digests of encoding and decoding in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 (and ids).

    spans_sha256 is of the pieces' ends as decimal numbers joined by commas (null where there are no spans). Texts
    that stand in a batch several times, as the copies of a mix do, are encoded once there. Cases as in ``encode``.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", *(["ids"] if with_ids else []))
    schema = f"{typed(rows, 'doc_id')}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string" + ", ids array<int>" * with_ids

    def run(batch: pa.RecordBatch) -> dict:
        tool, given = codec(model or model_path()), texts(batch, "text")
        different = list(dict.fromkeys(given))
        out = tool.encode(different)
        made = {}
        for text, (ids, ends), back in zip(different, out, tool.decode([ids for ids, _ in out])):
            spans = None if ends is None else sha(",".join(map(str, ends.tolist())))
            made[text] = (len(ids), sha(",".join(map(str, ids))), sha(back), spans, ids)
        return {"doc_id": batch.column("doc_id")} | {name: [made[text][i] for text in given] for i, name in enumerate(names)}

    return map_batches(rows, run, schema, 64)


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
