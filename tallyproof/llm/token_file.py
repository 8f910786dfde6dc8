"""Token-id files: documents in doc_id order, encoded in blocks by the adaptive coder of ``token_codec``.

A file set is a Parquet table in the shared folder. Each of its rows is a run of whole documents: part and seq give
its place, doc_ids and doc_lengths its documents, sizes and checksums its blocks, payload their bytes and behind them those of
the row's table of frequencies (the last of sizes). Blocks hold ``block_ids`` ids (the last fewer), start from the same model
and carry a CRC-32 of their ids, so with the table any of them is decoded and verified alone.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyproof.llm.common import shared_folder
from tallyproof.llm.token_codec import decode_blocks, encode_blocks
from tallyproof.llm.tokens import REMEMBERED, chunks, vocabulary_path

_FILE = "part int, seq int, n_ids long, doc_ids array<long>, doc_lengths array<long>, block_ids int, sizes array<int>, checksums array<long>, payload binary"


#: Chunks of Latin letters below U+0250 (but U+0130, which turns into two characters) and ASCII punctuation behind them: the
#: letters, in lower case, and the punctuation are one piece each to the vocabulary, whatever stands beside them.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]*)([!-/:-@\\[-`{-~]*)")


@dataclass(frozen=True)
class TokenFile:
    """end_id: appended to each document. block_ids: ids in a block. row_ids: a row is closed at the first document
    boundary after so many ids, which bounds a task's memory."""

    vocabulary: str = "word_bpe_49k.json"
    end_id: int = 2
    block_ids: int = 2048
    row_ids: int = 6_000_000


class IdEncoder:
    """Whole texts to ids by the tokenizers library, which sees each distinct piece of plain chunks, and each other distinct
    white-space chunk, once while bounded tables remember them; texts with special strings go through it whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a piece
        self.ends[[i for word, i in vocabulary.items() if suffix and word.endswith(suffix)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """As one text, cut where pieces end; a vocabulary that sees other pieces in it gets them one by one."""
        data = self._encode([" ".join(pieces)])[0]
        to = (np.flatnonzero(self.ends[np.frombuffer(data, dtype="<u4")]) + 1) * 4
        if len(to) != len(pieces):
            return self._encode(pieces)
        to = to.tolist()
        return [data[a:b] for a, b in zip([0, *to], to)]

    def _learn(self, new: set[str]) -> None:
        plain, others = [], []
        for chunk in new:
            found = _PLAIN.fullmatch(chunk)
            if found:
                plain.append((chunk, found[1].lower(), found[2]))
            else:
                others.append(chunk)
        if len(self.pieces) > REMEMBERED // 2:
            self.pieces = {"": b""}
        pieces = list({p for _, *both in plain for p in both}.difference(self.pieces))
        if pieces:
            self.pieces.update(zip(pieces, self._encode_pieces(pieces)))
        self.known.update((chunk, self.pieces[word] + self.pieces[rest]) for chunk, word, rest in plain)
        if others:
            self.known.update(zip(others, self._encode(others)))

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if any(m in text for m in self.marks):
            return self._encode([text])[0]
        pieces = chunks(text)
        if len(self.known) > REMEMBERED // 2:
            self.known.clear()
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            self._learn(set(pieces).difference(self.known))
            return b"".join(map(self.known.__getitem__, pieces))


_encoders: dict[str, IdEncoder] = {}


def _file_row(part: int, seq: int, doc_ids: list, lengths: list[int], data: bytes | bytearray, cfg: TokenFile) -> pa.RecordBatch:
    ids = np.frombuffer(data, dtype="<u4")
    blocks = [ids[i : i + cfg.block_ids] for i in range(0, len(ids), cfg.block_ids)]
    payloads = encode_blocks(blocks)
    row = {
        "part": part, "seq": seq, "n_ids": len(ids), "doc_ids": doc_ids, "doc_lengths": lengths, "block_ids": cfg.block_ids,
        "sizes": [len(p) for p in payloads], "checksums": [zlib.crc32(b.tobytes()) for b in blocks], "payload": b"".join(payloads),
    }
    types = {"part": pa.int32(), "seq": pa.int32(), "n_ids": pa.int64(), "doc_ids": pa.list_(pa.int64()), "doc_lengths": pa.list_(pa.int64()), "block_ids": pa.int32(), "sizes": pa.list_(pa.int32()), "checksums": pa.list_(pa.int64()), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in types.items()], names=list(types))


def write_token_file(docs: DataFrame, path: str, cfg: TokenFile = TokenFile()) -> None:
    """Encode every row of ``docs`` (doc_id, text) to a file set at ``path``, ascending by doc_id.

    Null and empty texts are the end id alone. Null doc_ids come first; rows with equal doc_ids follow one another
    by text. Other columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if cfg.vocabulary not in _encoders:
            _encoders[cfg.vocabulary] = IdEncoder(vocabulary_path(cfg.vocabulary))
        encoder, end = _encoders[cfg.vocabulary], np.array([cfg.end_id], dtype="<u4").tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids, lengths, data, held = [], [], bytearray(), 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = encoder.ids(text.as_py()) + end
                doc_ids.append(doc.as_py())
                lengths.append(len(ids) // 4)
                data += ids
                held += lengths[-1]
                if held >= cfg.row_ids:
                    yield _file_row(part, seq, doc_ids, lengths, data, cfg)
                    doc_ids, lengths, data, held, seq = [], [], bytearray(), 0, seq + 1
        if doc_ids:
            yield _file_row(part, seq, doc_ids, lengths, data, cfg)

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, _FILE).write.parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, decoded from the files.

    A block whose checksum does not hold raises ValueError.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {k: batch.column(k)[row].as_py() for k in batch.schema.names}
                ends = np.cumsum(r["sizes"])
                payloads = [r["payload"][e - s : e] for s, e in zip(r["sizes"], ends)]
                n = [min(r["block_ids"], r["n_ids"] - i) for i in range(0, r["n_ids"], r["block_ids"])]
                blocks = decode_blocks(payloads, np.array(n))
                if [zlib.crc32(b.astype("<u4", copy=False)) for b in blocks] != r["checksums"]:
                    raise ValueError(f"a block of part {r['part']}, row {r['seq']} is damaged")
                data = memoryview(np.concatenate(blocks).astype("<u4", copy=False)).cast("B")
                del blocks
                to = np.cumsum(r["doc_lengths"])
                since = to - np.array(r["doc_lengths"])
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(since, to)]
                k = len(crc)
                columns = [pa.array(r["doc_ids"], pa.int64()), pa.array([r["part"]] * k, pa.int32()), pa.array([r["seq"]] * k, pa.int32()), pa.array(since), pa.array(r["doc_lengths"], pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "seq", "since", "n_tokens", "ids_crc32"])

    files = spark.read.schema(_FILE).parquet(path)
    # Running sums in two steps: of the parts (one row for each task that wrote), then of the rows in a part.
    earlier = (Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts = parts.select("part", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("_parts"))
    rows = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*earlier)), F.lit(0)).alias("_rows"))
    starts = rows.join(parts, "part").select("part", "seq", (F.col("_parts") + F.col("_rows")).alias("before"))
    documents = files.mapInArrow(decode, "doc_id long, part int, seq int, since long, n_tokens long, ids_crc32 long")
    return documents.join(starts, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("since")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, cfg: TokenFile = TokenFile()) -> DataFrame:
    """Write ``docs`` to a new file set in the shared folder and read it back."""
    path = f"{shared_folder(docs.sparkSession)}/token-file-{uuid.uuid4().hex}"
    write_token_file(docs, path, cfg)
    return read_token_file(docs.sparkSession, path)
