"""Token ids of documents in a store of small, separately compressed frames.

A store is a folder::

    segments/      Parquet; a row holds consecutive documents: their ids, each frame's offset in the payload,
                   token counts, the ids before the segment within its part, and the payload, all frames end to end
    parts/         Parquet; a row a part: part, and the ids of all parts before it
    manifest/      Parquet; one row: format, id width in bytes, end id, tokenizer, dictionary and its SHA-256

A frame is one document's id array (little-endian unsigned 16- or 32-bit), compressed by zstandard with one
dictionary that was trained on serialized id arrays. A short document is so read by its own frame: the
offset gives the bytes, the manifest's hash says which dictionary opens them. Documents are in ascending order
of id (nulls first; ties by text).

A null or empty text has the end id alone. Rows with the same id stay separate documents. A text of any length is
one frame. An empty table gives a store without segments. Columns besides id and text are not stored.

Whole texts are encoded by the tokenizers library. For a tokenizer of one known kind, whose rules never look across ASCII white space
(:func:`word_safe`), each worker has the library encode a word when it first meets it and remembers its ids, which gives the same ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import warnings
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, hashed_sample, partitions_for, table

FORMAT = "token-store-1"
END_ID = 2
#: Bounds of the sample that the dictionary is trained on, and of the dictionary.
SAMPLE_DOCS = 1500
SAMPLE_IDS = 2048  # of a document; at most 12 MB in all
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: A segment ends with the document that takes it over this many payload bytes or documents.
SEGMENT_BYTES = 1 << 20
SEGMENT_DOCS = 2048
#: Words that a worker remembers; twice as many at most; the longer unused half goes first.
CACHE_WORDS = 400_000
CACHE_WORD_BYTES = 64

_SEGMENT_SCHEMA = "part int, seq int, first_id long, last_id long, ids array<bigint>, offsets array<int>, counts array<int>, before long, tokens long, payload binary"


#: The cut of the lower-case word tokenizer, a fixed value: none of its parts matches white space or looks past what it matches.
_WORD_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def word_safe(spec: dict) -> bool:
    """Whether a tokenizer is of the kind whose parts never join or look across ASCII white space, and drop it."""
    normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = normal.get("normalizers", [normal])
    first = (pre.get("pretokenizers") or [pre])[0]
    return (
        all(s.get("type") in ("NFC", "Lowercase") or (s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " ") for s in steps)
        and (first.get("type"), first.get("behavior"), first.get("invert")) == ("Split", "Removed", True)
        and (first.get("pattern") or {}).get("Regex") == _WORD_CUT
        and [x.get("type") for x in pre.get("pretokenizers", [])[1:]] == ["ByteLevel"]
        and not (spec.get("model") or {}).get("dropout")
        and not any(set(t["content"]) & set(" \t\n\r\x0b\x0c") for t in spec.get("added_tokens", []))
    )


class TextEncoder:
    """Serialized ids of whole texts by the library, for any tokenizer."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def encode(self, text: bytes | None) -> bytes:
        return np.array(self.tokenizer.encode((text or b"").decode("utf-8", "replace"), add_special_tokens=False).ids, self.dtype).tobytes()


class _Remembered(dict):
    """What a function gives, remembered in two generations: what is not used goes when the younger one is full."""

    def __init__(self, find):
        super().__init__()
        self.find, self.old = find, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.find(key)
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        if len(key) <= CACHE_WORD_BYTES:
            self[key] = value
        return value


class WordEncoder:
    """Serialized ids of whole texts, by way of those of their words.

    A word that is new is cut as the tokenizer cuts it, and the tokenizer's model encodes the pieces, which are
    remembered too. The usual word, Latin letters with signs behind them, is cut here; any other by the library. Ids are in
    the machine's byte order, which has to be little-endian.
    """

    _LATIN = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
    _USUAL = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*)([-.,!?;:#*$%&|)\]]*)")

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.dtype, self.code = ("<u2", "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        self.added = [t["content"].encode() for t in json.loads(spec).get("added_tokens", [])]
        #: How the pre-tokenizer writes letters beyond ASCII.
        self.spelled = str.maketrans({c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in self._LATIN})
        self.pieces = _Remembered(self._piece)
        self.words = _Remembered(self._word)

    def _ids(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._ids([t.id for t in self.tokenizer.model.tokenize(piece)])

    def _word(self, word: bytes) -> bytes:
        usual = self._USUAL.fullmatch(word)
        if usual is None:
            return self._unusual(word)
        letters, signs = usual.groups()
        if signs and letters:
            return self.words[letters] + self.words[signs]
        text = word.decode()
        low = text.lower()
        if low != text:
            return self.words[low.encode()]
        return self._piece(text if text.isascii() else text.translate(self.spelled))

    def _unusual(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if any(a in word for a in self.added):
            return self._ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return b"".join(self.pieces[piece] for piece, _ in cut)

    def encode(self, text: bytes | None) -> bytes:
        return b"".join(map(self.words.__getitem__, (text or b"").split()))


_encoders: dict[str, TextEncoder | WordEncoder] = {}


def encoder_of(path: str) -> TextEncoder | WordEncoder:
    """One encoder a process, so that words stay known from task to task."""
    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            spec = f.read()
        _encoders[path] = WordEncoder(spec) if word_safe(json.loads(spec)) else TextEncoder(spec)
    return _encoders[path]


def train_dictionary(frames: list[bytes]) -> bytes:
    """A zstandard dictionary from serialized id arrays; empty if they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, frames).as_bytes()
    except zstandard.ZstdError as e:
        warnings.warn(f"no dictionary could be trained on {len(frames)} documents ({e}); the store has an empty one", stacklevel=2)
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, and write the store at ``path`` (a folder that all executors reach)."""
    spark = docs.sparkSession
    dtype = encoder_of(tokenizer).dtype
    end = np.array([end_id], dtype).tobytes()

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, most = encoder_of(tokenizer), SAMPLE_IDS * int(dtype[-1])
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([(words.encode(t) + end)[:most] for t in b.column(0).cast(pa.large_binary()).to_pylist()], pa.binary())], ["frame"])

    sample = hashed_sample(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), "i", SAMPLE_DOCS).select("t")
    sample = sample.mapInArrow(sampled, "frame binary").toArrow()["frame"].to_pylist()  # of bounded size
    dictionary = train_dictionary(sample)
    tag = hashlib.sha256(dictionary).hexdigest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder_of(tokenizer)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_content_size=True)
        width = int(dtype[-1])
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        offsets: list[int] = [0]
        counts: list[int] = []
        frames: list[bytes] = []

        def segment() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            row = {
                "part": part, "seq": seq, "first_id": min(known, default=None), "last_id": max(known, default=None), "ids": list(ids),
                "offsets": list(offsets), "counts": list(counts), "before": before, "tokens": sum(counts), "payload": b"".join(frames),
            }
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                got = words.encode(text) + end
                frame = pack.compress(got)
                ids.append(doc)
                counts.append(len(got) // width)
                frames.append(frame)
                offsets.append(offsets[-1] + len(frame))
                if offsets[-1] > SEGMENT_BYTES or len(ids) >= SEGMENT_DOCS:
                    yield segment()
                    before += sum(counts)
                    seq += 1
                    ids, offsets, counts, frames = [], [0], [], []
        if ids:
            yield segment()

    key = (F.col("i").asc_nulls_first(), F.col("h"))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    ordered = rows.repartitionByRange(partitions_for(spark), *key).sortWithinPartitions(*key).select("i", "t")
    ordered.mapInArrow(encode, _SEGMENT_SCHEMA).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/segments")
    # A row a part: as many as there were write tasks.
    parts = spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("tokens").alias("n"))
    run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.select("part", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("base")).write.mode("overwrite").parquet(f"{path}/parts")
    manifest = [(FORMAT, int(dtype[-1]), end_id, tokenizer.rsplit("/", 1)[-1], tag, bytearray(dictionary))]
    spark.createDataFrame(manifest, "format string, width int, end_id int, tokenizer string, dictionary_sha256 string, dictionary binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def _manifest(spark: SparkSession, path: str) -> tuple[str, bytes]:
    m = spark.read.parquet(f"{path}/manifest").first()
    data = bytes(m.dictionary or b"")
    if m.format != FORMAT or hashlib.sha256(data).hexdigest() != m.dictionary_sha256:
        raise ValueError(f"{path}: not a {FORMAT} store, or its dictionary is damaged")
    return f"<u{m.width}", data


def _documents(spark: SparkSession, path: str, segments: DataFrame, wanted: frozenset[int] | None, with_ids: bool) -> DataFrame:
    dtype, dictionary = _manifest(spark, path)
    parts = F.broadcast(spark.read.parquet(f"{path}/parts"))
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for b in batches:
            for s in range(b.num_rows):
                at = b.column("at")[s].as_py()
                payload = memoryview(b.column("payload")[s].as_buffer())
                rows: list[tuple] = []
                offsets = b.column("offsets")[s].as_py()
                for k, (doc, n) in enumerate(zip(b.column("ids")[s].as_py(), b.column("counts")[s].as_py(), strict=True)):
                    if wanted is None or doc in wanted:
                        ids = np.frombuffer(unpack.decompress(payload[offsets[k] : offsets[k + 1]]), dtype)
                        if len(ids) != n:
                            raise ValueError(f"document {doc}: {len(ids)} ids, {n} are indexed")
                        rows.append((doc, at, n, zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype(np.int32)] if with_ids else [])))
                    at += n
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds.values(), strict=True)], list(kinds))

    found = segments.join(parts, "part").select((F.col("base") + F.col("before")).alias("at"), "ids", "offsets", "counts", "payload")
    return found.mapInArrow(decode, schema)


def read_store(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row a document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids."""
    return _documents(spark, path, spark.read.schema(_SEGMENT_SCHEMA).parquet(f"{path}/segments"), None, with_ids)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; opens only segments that may hold them, and of those only their frames."""
    wanted = sorted(set(doc_ids))
    if not wanted:
        return read_store(spark, path).limit(0)
    segments = spark.read.schema(_SEGMENT_SCHEMA).parquet(f"{path}/segments").where((F.col("first_id") <= wanted[-1]) & (F.col("last_id") >= wanted[0]))
    segments = segments.where(F.arrays_overlap("ids", F.lit(wanted).cast("array<bigint>")))
    return _documents(spark, path, segments, frozenset(wanted), True)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = Scratch(spark, "token_store").path("store")
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_store(spark, path, with_ids=False)
