"""SentencePiece models rebuilt for the tokenizers library.

The model protobuf is read field by field; its normaliser, metaspace marker, piece scores,
piece types and byte fallback become a ``tokenizers`` pipeline.  A unigram model takes its
scores as they are; a BPE model (the one installed here) takes them as merge priorities.

Text is cut before each run of markers whenever no piece holds a marker after another
character: no merge can cross such a cut, and each worker keeps a bounded cache of chunks.

New chunks are encoded in batches by the library's own threads; its ids are the result.
Parity is verified, not assumed: each of them is also encoded by the SentencePiece library
and decoded by the rebuilt decoder.  Where ids or texts differ, the rows say so in ``parity``;
the ids stay.

Defined cases: a null or empty text has no ids and decodes to the empty text; very long
texts are encoded whole; repeated rows and doc_ids are rows of their own; extra columns
are ignored; an empty table gives an empty result.  Decoding gives the normalised text:
for the installed model the text itself, save that a marker character in it becomes a space.
"""

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernloom.llm.batches import bounded_slices, small_batches

MARKER = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

# Fixed values of the public SentencePiece model format: field numbers and enum values.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
TRAINER_MODEL_TYPE, TRAINER_BYTE_FALLBACK, TRAINER_UNK = 3, 35, 40
NORMALIZER_CHARSMAP, NORMALIZER_DUMMY_PREFIX, NORMALIZER_EXTRA_SPACES, NORMALIZER_ESCAPE = 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) pairs of a protobuf message; submessages and strings as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = np.frombuffer(data, "<f4", 1, at)[0].item(), at + 4
        elif kind == 1:
            value, at = np.frombuffer(data, "<f8", 1, at)[0].item(), at + 8
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]]
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape: bool = True


def parse_model(data: bytes) -> PieceModel:
    model = PieceModel([])
    for number, value in fields(data):
        own = dict(fields(value)) if number in (PIECES, TRAINER, NORMALIZER) else {}
        if number == PIECES:
            model.pieces.append((own[PIECE_TEXT].decode(), own.get(PIECE_SCORE, 0.0), own.get(PIECE_TYPE, NORMAL)))
        elif number == TRAINER:
            model.model_type = own.get(TRAINER_MODEL_TYPE, UNIGRAM)
            model.byte_fallback = bool(own.get(TRAINER_BYTE_FALLBACK, 0))
            model.unk_id = own.get(TRAINER_UNK, 0)
        elif number == NORMALIZER:
            model.charsmap = own.get(NORMALIZER_CHARSMAP, b"")
            model.dummy_prefix = bool(own.get(NORMALIZER_DUMMY_PREFIX, 1))
            model.remove_extra_spaces = bool(own.get(NORMALIZER_EXTRA_SPACES, 1))
            model.escape = bool(own.get(NORMALIZER_ESCAPE, 1))
    if model.model_type not in (UNIGRAM, BPE):
        raise ValueError(f"model type {model.model_type} is neither unigram nor BPE")
    return model


def merges(model: PieceModel) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first."""
    usable = {text: (-score, i) for i, (text, score, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    pairs = []
    for text, rank in usable.items():
        for cut in range(1, len(text)):
            left, right = text[:cut], text[cut:]
            if left in usable and right in usable:
                pairs.append((rank, usable[left], usable[right], left, right))
    return [(left, right) for *_, left, right in sorted(pairs)]


def chunks_are_independent(model: PieceModel) -> bool:
    """No piece holds a marker after another character, so no merge crosses the start of a marker run."""
    return model.escape and not any(MARKER in text.lstrip(MARKER) for text, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED))


def build(model: PieceModel):
    """A ``tokenizers.Tokenizer`` that encodes and decodes like the model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    vocab = {text: i for i, (text, _, _) in enumerate(model.pieces)}
    unknown = model.pieces[model.unk_id][0]
    if model.model_type == BPE:
        core = models.BPE(vocab, merges(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=1_000)  # the codec keeps its own cache
    else:
        core = models.Unigram([(text, score) for text, score, _ in model.pieces], model.unk_id, model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    mark = MARKER if model.escape else " "
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(mark))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARKER))
    if steps:
        out.normalizer = normalizers.Sequence(steps)
    if chunks_are_independent(model):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return out


SPACES = re.compile(" +[^ ]*")


class Codec:
    """One worker's tokenizer, SentencePiece's own for the parity check, and a bounded cache of chunks."""

    def __init__(self, data: bytes, threads: int = 2, cached_chunks: int = 100_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.model = parse_model(data)
        self.tokenizer = build(self.model)
        self.peer = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.threads, self.cached_chunks = threads, cached_chunks
        m = self.model
        self.chunked = chunks_are_independent(m) and m.dummy_prefix and not m.remove_extra_spaces and not m.charsmap
        self.vocab = {text: i for i, (text, _, _) in enumerate(m.pieces)}
        self.bytes_of = [bytes([int(t[3:5], 16)]) if k == BYTE else t.replace(MARKER, " ").encode() for t, _, k in m.pieces]
        self.bytes_of[m.unk_id] = " \u2047 ".encode()
        self.starts = np.array([t.startswith(MARKER) and k != BYTE for t, _, k in m.pieces])
        self._reset()

    def _reset(self) -> None:
        self.cache: dict[str, bytes] = {}
        self.differ: set[str] = set()

    def _both(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of whole texts as int32 bytes, and whether SentencePiece has the same ids and decoding."""
        ours = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        theirs = self.peer.encode(texts, num_threads=self.threads)
        decoded = self.tokenizer.decode_batch(ours, skip_special_tokens=False)
        ids = [np.array(a, "<i4").tobytes() for a in ours]
        return ids, [a == b and self.decode(i) == d for a, b, i, d in zip(ours, theirs, ids, decoded, strict=True)]

    def _words(self, keys: list[str], at_once: int = 512) -> tuple[list[bytes], list[bool]]:
        """Ids of keys without spaces.  Many are encoded as one text: only a chunk's first piece begins with the marker."""
        groups = [keys[i : i + at_once] for i in range(0, len(keys), at_once)]
        joined = [" ".join(g) for g in groups]
        ours = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        theirs = self.peer.encode(joined, num_threads=self.threads)
        ids, same = [], []
        decoded = self.tokenizer.decode_batch([a.ids for a in ours], skip_special_tokens=False)
        for group, text, a, b, back in zip(groups, joined, ours, theirs, decoded, strict=True):
            found = np.array(a.ids, "<i4")
            first = np.nonzero(self.starts[found])[0]
            if a.ids == b and back == text and len(first) == len(group):
                raw, ends = found.tobytes(), [*(first * 4).tolist(), len(found) * 4]
                ids += [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)]
                same += [True] * len(group)
            else:  # one by one, to know which differ
                one, ok = self._both(group)
                ids += one
                same += ok
        return ids, same

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """The tokenizers library's ids of each text as int32 bytes, and whether SentencePiece agreed on them.

        With independent chunks every distinct chunk is encoded by both libraries once,
        in multithreaded batches, and texts are put together from the chunks.
        """
        if not self.chunked:
            return self._both(texts)
        cut = []
        for text in texts:
            plain = text.replace(MARKER, " ")
            keys = plain.split(" ")
            if "" in keys:  # runs of spaces: a key keeps all but the first of them
                keys = [c[1:] for c in SPACES.findall(f" {plain}")] if plain else []
            cut.append(keys)
        if len(self.cache) > self.cached_chunks:
            self._reset()
        new = set().union(*cut) - self.cache.keys() - {""}
        for keys, encode in (([k for k in new if " " not in k], self._words), ([k for k in new if " " in k], self._both)):
            ids, same = encode(keys)
            self.cache.update(zip(keys, ids, strict=True))
            self.differ.update(k for k, s in zip(keys, same, strict=True) if not s)
        if "" not in self.cache:
            self.cache[""] = np.array([self.vocab.get(MARKER, self.model.unk_id)], "<i4").tobytes()
        get = self.cache.__getitem__
        return [b"".join(map(get, keys)) for keys in cut], [not self.differ or self.differ.isdisjoint(keys) for keys in cut]

    def decode(self, ids: bytes) -> str:
        """The normalised text: pieces and raw bytes joined, the dummy prefix taken off."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        if self.model.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def _codec(data: bytes, threads: int) -> Codec:
    key = hashlib.sha256(data).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(data, threads)
    return _CODECS[key]


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL, threads: int = 2, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 1 << 20) -> DataFrame:
    """``(doc_id, ids, decoded, parity)``; the model file (bounded, under 16 MB) goes out as a broadcast."""
    with open(model_path, "rb") as file:
        data = file.read()
    if len(data) > 16 << 20:
        raise ValueError("model file over 16 MB")
    shared = docs.sparkSession.sparkContext.broadcast(data)
    own = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string, parity boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, threads)
        for whole in batches:
            for part in bounded_slices(whole, 1, batch_chars):
                ids, same = codec.encode([t or "" for t in part.column(1).to_pylist()])
                ends = pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(map(codec.decode, ids), pa.string()), pa.array(same, pa.bool_())], ["doc_id", "ids", "decoded", "parity"])

    return own.mapInArrow(run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded and decoded: ids, their digest, parity and the round trip."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(encode(docs.select("doc_id", "text"), threads=2))


def digests(encoded: DataFrame) -> DataFrame:
    """Token count and digests of ``encode``'s output."""
    joined = F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), "parity")
