"""Token-ID output: flat unsigned integer files with 64-bit document offsets, memory-mapped on reading.

Documents are dealt by ranges of their id, so that the shards, one for each partition, follow each other in id order.  A task writes
its shard as it goes: ``<shard>.bin`` holds nothing but token ids (16 bits each if the vocabulary allows, else 32, little-endian) and
``<shard>.idx`` the header, n + 1 unsigned 64-bit offsets into the ids, the n document ids (signed 64-bit) and n bytes that
are 1 where a document has no id.  The driver gets one row for each shard; prefix sums over these give each shard's
base, and base + offset is a document's place among all ids.  A shard's name holds its task attempt, and only those
that succeeded are listed, so that a task which is run again does no harm.

Defined results: a null or empty text has the end id alone; a null id comes first; repeated ids are ordered by a hash of
their text and each keeps its row; very long texts are encoded whole; an empty table gives an empty table; other columns are
not looked at.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covaria.llm.common import ROWS_AT_ONCE, shared_path
from covaria.llm.files import local_path, read_bytes, writing

MAGIC = b"CVTOKENS"
END_ID = 1
#: Distinct chunks of text whose ids a worker remembers; beyond that it starts afresh.  Only speed depends on it.
REMEMBERED = 1_000_000
# Fixed value: the split pattern of lower-casing word tokenizers, for which the short cuts below are exact.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A full stop or comma that ends a word but belongs to a longer run of marks.
_LONGER_MARK = re.compile(r"(?:[^\w \n]|_)[.,](?:[ \n]|$)")

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Encodes whole texts and remembers pieces.

    A tokenizer that lower-cases, drops white space and splits by WORDS encodes the text between two blanks alike wherever it
    stands, so ids are looked up by such chunks.  To meet the same chunk more often, texts in Latin-1 are lower-cased first (there
    Python and the tokenizer agree) and single full stops and commas are set apart.  A chunk of letters is one word, for
    which the vocabulary's merges are asked directly; any other chunk passes the whole tokenizer, and so does every text if the
    tokenizer is of another kind.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        splits = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_words = (
            steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"] == {"Regex": WORDS}
            and splits[0]["invert"] and made["model"]["type"] == "BPE" and all(x["content"].startswith("<|") and not x["normalized"] for x in made["added_tokens"])
        )
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = np.array([END_ID], self.dtype).tobytes()
        self.known: dict[str, bytes] = {"": b""}
        # how byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.letters = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, chunk: str, lowered: bool) -> None:
        if lowered and chunk.isalpha():
            word = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(self.letters)
            self.known[chunk] = np.array([t.id for t in self.model.tokenize(word)], self.dtype).tobytes()
        else:
            self.known[chunk] = self._whole(chunk)

    def encode(self, text: str | None) -> bytes:
        """All ids of a text and the end id, in bytes."""
        text = text or ""
        if not self.by_words:
            return self._whole(text) + self.end
        lowered = "<|" not in text and (text.isascii() or _latin(text))
        if lowered:
            text = text.lower()
            if not _LONGER_MARK.search(text):
                text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " . ").replace(",\n", " , ")
        chunks = text.replace("\n", " ").split(" ")
        known = self.known
        if len(known) > REMEMBERED:
            known = self.known = {"": b""}
        for c in chunks:
            if c not in known:
                self._learn(c, lowered)
        return b"".join(map(known.__getitem__, chunks)) + self.end


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, target: str, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Write all ``docs`` below the URI ``target``; returns the manifest, which is also left there as manifest.json."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{target}/{context.partitionId():06d}-{context.taskAttemptId()}"
        encode = encoder(tokenizer)
        ids, nulls, offsets = array("q"), bytearray(), array("Q", [0])
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with writing(f"{name}.bin") as out:
            while first is not None:
                for at in range(0, first.num_rows, ROWS_AT_ONCE):
                    part = first.slice(at, ROWS_AT_ONCE)
                    for i in part.column(0).to_pylist():
                        ids.append(i or 0)
                        nulls.append(i is None)
                    for text in part.column(1).to_pylist():
                        made = encode.encode(text)
                        out.write(made)
                        offsets.append(offsets[-1] + len(made) // encode.dtype.itemsize)
                first = next((b for b in batches if b.num_rows), None)
        with writing(f"{name}.idx") as out:
            out.write(MAGIC + np.array([encode.dtype.itemsize, len(ids)], "<u8").tobytes() + np.array(offsets, "<u8").tobytes())
            out.write(np.array(ids, "<i8").tobytes() + bytes(nulls))
        yield pa.RecordBatch.from_pydict({"shard": [context.partitionId()], "name": [name], "docs": [len(ids)], "tokens": [offsets[-1]]})

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_first(), F.col("hash"), F.col("row")]  # rows of one id may fill many partitions
    dealt = plain.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    rows = sorted(dealt.mapInArrow(write, "shard long, name string, docs long, tokens long").collect(), key=lambda r: r["shard"])
    base, shards = 0, []
    for r in rows:
        shards.append({"name": r["name"], "docs": r["docs"], "tokens": r["tokens"], "base": base})
        base += r["tokens"]
    manifest = {"tokenizer": os.path.basename(tokenizer), "end_id": END_ID, "tokens": base, "shards": shards}
    with writing(f"{target}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def open_shard(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token ids (memory-mapped where the file is mounted), offsets, document ids, and which of them are null."""
    head = read_bytes(f"{name}.idx")
    width, n = np.frombuffer(head, "<u8", 2, len(MAGIC)).tolist()
    if head[: len(MAGIC)] != MAGIC:
        raise ValueError(f"{name}.idx is no token index")
    at = len(MAGIC) + 16
    offsets = np.frombuffer(head, "<u8", n + 1, at)
    ids = np.frombuffer(head, "<i8", n, at + 8 * (n + 1))
    nulls = np.frombuffer(head, np.uint8, n, at + 8 * (2 * n + 1)).astype(bool)
    path = local_path(f"{name}.bin")
    dtype = np.dtype(f"<u{width}")
    tokens = np.memmap(path, dtype, "r") if path else np.frombuffer(read_bytes(f"{name}.bin"), dtype)
    return tokens, offsets, ids, nulls


def read_tokens(spark: SparkSession, manifest: dict) -> DataFrame:
    """Per document of the files: doc_id, start among all ids, n_tokens, crc32 of the ids as 32-bit integers."""
    schema = T._parse_datatype_string("doc_id long, start long, n_tokens long, ids_crc32 long")
    names = schema.fieldNames()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                tokens, offsets, ids, nulls = open_shard(shard["name"])
                for at in range(0, len(ids), 10_000):
                    part = slice(at, at + 10_000)
                    a, b = offsets[:-1][part].astype(np.int64), offsets[1:][part].astype(np.int64)
                    crc = [zlib.crc32(tokens[x:y].astype("<u4")) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part], mask=nulls[part]), pa.array(a + shard["base"]), pa.array(b - a), pa.array(crc, pa.int64())], names=names)

    if not manifest["shards"]:
        return spark.createDataFrame([], schema)
    shards = [(s["name"], s["base"]) for s in manifest["shards"]]
    listed = spark.createDataFrame(shards, "name string, base long").repartition(len(shards))
    return listed.mapInArrow(read, schema)


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return read_tokens(spark, write_tokens(spark, docs, tokenizer, shared_path(spark, "tokens"), id_col, text_col))
