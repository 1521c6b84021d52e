"""Byte-level BPE encoding and decoding through a sentencepiece model that is serialised from the vocabulary.

The rank file is never trained on or changed. Each byte stands for one character in the model's pieces, a piece's score is its
negative rank and normalisation is the identity, so sentencepiece's merges (best score first, leftmost on ties) are those of
the rank file. Pre-tokens are cut by the vocabulary's published pattern and encoded separately; ids are decoded by the inverse
of the byte mapping.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Pre-tokens kept per worker; longer ones are encoded anew each time.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 64


def read_ranks(path: str) -> bytes:
    """The rank file as it is: one base64 token and its rank on each line. It is bounded by the vocabulary (about 1 MB)."""
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def byte_characters() -> list[str]:
    """A character for each byte: itself where printable ASCII, else one from U+0100 on, so that no piece has white space."""
    return [chr(b) if 0x21 <= b <= 0x7E else chr(0x100 + b) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto (BPE) whose piece at index r is the token of rank r; the unknown piece comes last.

    Field numbers are those of the public sentencepiece_model.proto: pieces 1 (piece 1, score 2, type 3), trainer_spec 2
    (model_type 3, unk_id 40, bos_id 41, eos_id 42, pad_id 43), normalizer_spec 3 (name 1, add_dummy_prefix 3,
    remove_extra_whitespaces 4, escape_whitespaces 5).
    """
    letters = byte_characters()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0 to n-1, each once")
    parts = []
    for token, rank in by_rank:
        piece = "".join(letters[b] for b in token).encode()
        parts.append(_message(1, _message(1, piece) + b"\x15" + struct.pack("<f", -float(rank))))
    parts.append(_message(1, _message(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + b"\x18\x02"))
    minus_one = _varint((1 << 64) - 1)
    trainer = b"\x18\x02" + b"".join(_varint(f << 3) + v for f, v in ((40, _varint(len(by_rank))), (41, minus_one), (42, minus_one), (43, minus_one)))
    normaliser = _message(1, b"identity") + b"\x18\x00\x20\x00\x28\x00"
    return b"".join(parts) + _message(2, trainer) + _message(3, normaliser)


class ByteBpe:
    """Encoder and decoder of one vocabulary in one process."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = parse_ranks(rank_file)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        # Rust's \s is Unicode's White_Space, which Python's is not.
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.to_letters = {b: ord(c) for b, c in enumerate(byte_characters())}
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        self.pieces = [bytes(to_byte[c] for c in self.processor.id_to_piece(i)) for i in range(len(self.ranks))]
        self.cache: dict[str, bytes] = {}

    def _encode_new(self, tokens: list[str]) -> list[bytes]:
        raw = [t.encode() for t in tokens]
        whole = [self.ranks.get(b) for b in raw]
        rest = [i for i, r in enumerate(whole) if r is None]
        out = [b"" if r is None else struct.pack("<I", r) for r in whole]
        if rest:
            for i, ids in zip(rest, self.processor.encode([raw[i].decode("latin-1").translate(self.to_letters) for i in rest], out_type=int, num_threads=1), strict=True):
                out[i] = np.asarray(ids, "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        cut = [self.pattern.findall(t) for t in texts]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        cache = self.cache
        new = list({t for tokens in cut for t in tokens if t not in cache})
        if not new:
            return [b"".join(map(cache.__getitem__, tokens)) for tokens in cut]
        found = dict(zip(new, self._encode_new(new), strict=True))
        out = []
        for tokens in cut:
            out.append(b"".join([cache.get(t) or found[t] for t in tokens]))
        cache.update((t, ids) for t, ids in found.items() if len(t) <= CACHE_CHARS)
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def _coder(rank_file: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(rank_file, pattern)


def bpe_ids(docs: DataFrame, rank_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode and decode every text.

    Returns doc_id, n_tokens long, ids_sha256, decoded_sha256, and with ``keep_ids`` also ids (array<int>). A null text counts
    as empty: no tokens, digests of nothing. A very long text is encoded whole; its ids are held four bytes a token. Ties: merges
    go by rank, of equal ones the leftmost first, as ranks define. Rows are judged one by one, so repeated rows and ids give repeated results; an
    empty table gives an empty result; other columns are ignored. The vocabulary file is read by the driver and broadcast
    (its size is that of the vocabulary).
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column("text").to_pylist()
                encoded = coder.encode(texts)
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array([len(x) // 4 for x in encoded], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in encoded], pa.string()),
                }
                if keep_ids:
                    columns["ids"] = pa.array([np.frombuffer(x, "<i4") for x in encoded], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    return map_arrow(source, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
