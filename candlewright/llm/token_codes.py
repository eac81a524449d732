"""Token ids in directly addressable codes.

Format of one segment (all numbers little-endian): the bytes `DAC1`, then 32-bit counts of documents, tokens and levels,
then n_docs + 1 32-bit token offsets of its documents. Each level follows: a 32-bit count of its chunks, the chunks (one
byte each: bits 8k to 8k+7 of the ids that reach level k), a bitmap with one continuation bit for each chunk (low bit
first, padded to 64 bits), and a rank directory with the number of set bits before every 512th bit (32-bit). A chunk
whose bit is set goes on at position rank(bit) of the next level, so any token is read by itself.

Segments are the rows of a Parquet table with columns part, seg, doc_ids, n_tokens, payload; (part, seg) is the order.
Spark's committer makes the write whole or absent on any file system, also when executors are lost.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, small_batches

MAGIC = b"DAC1"
RANK_EVERY = 512
#: A segment ends with the document that brings it to so many tokens.
SEGMENT_TOKENS = 1 << 16
#: Bytes of text encoded at once.
BATCH_BYTES = 10 << 20
#: Texts that are no chain of words: runs of white space, any but spaces and line ends, or at an end; or a NUL.
RUNS = r"^[ \n]|[ \n]\z|[ \n][ \n]|[\x00\x09\x0B-\x0D\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A mark after a letter begins a piece.
LETTER_MARK = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])([!-/:-@\[-`{-~])"
SEGMENTS = "part int, seg int, doc_ids array<bigint>, n_tokens bigint, payload binary"


def encode_segment(ids: np.ndarray, offsets: np.ndarray) -> bytes:
    """ids (unsigned) of all documents in a row, and the n_docs + 1 offsets where they begin and end."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)])
        starts = np.cumsum(np.concatenate([[0], np.add.reduceat(more, np.arange(0, len(more), RANK_EVERY))]) if len(more) else [0])[: -(-len(more) // RANK_EVERY)]
        levels.append(struct.pack("<I", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + starts.astype("<u4").tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    return MAGIC + struct.pack("<III", len(offsets) - 1, len(ids), len(levels)) + offsets.astype("<u4").tobytes() + b"".join(levels)


class Segment:
    """Random access to the tokens of one encoded segment."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        self.n_docs, self.n_tokens, n_levels = struct.unpack_from("<III", data, 4)
        self.offsets = np.frombuffer(data, "<u4", self.n_docs + 1, 16)
        at, self.levels = 16 + 4 * (self.n_docs + 1), []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<I", data, at)
            at += 4
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            size = (n + 63) // 64 * 8
            bits = np.frombuffer(data, np.uint8, size, at)
            at += size
            n_ranks = -(-n // RANK_EVERY)
            self.levels.append((chunks, bits, np.frombuffer(data, "<u4", n_ranks, at)))
            at += 4 * n_ranks

    def token(self, i: int) -> int:
        """The i-th token, with a few byte reads and at most 64 bytes of bitmap for each level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_EVERY
            before = int.from_bytes(bits[block * RANK_EVERY // 8 : (i >> 3) + 1].tobytes(), "little") & ((1 << (i - block * RANK_EVERY)) - 1)
            i = int(ranks[block]) + before.bit_count()
        return value

    def all_tokens(self) -> np.ndarray:
        out, where = np.zeros(self.n_tokens, np.uint32), np.arange(self.n_tokens)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[where] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            where = where[np.unpackbits(bits, bitorder="little")[: len(chunks)].astype(bool)]
        return out

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Tokens start to end - 1: on each level those that go on are a stretch of the next one, so only stretches are read."""
        if not 0 <= start <= end <= self.n_tokens:
            raise IndexError((start, end))
        out, where = np.zeros(end - start, np.uint32), np.arange(end - start)
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out[where] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * k)
            here = np.unpackbits(bits[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 :][: end - start].astype(bool)
            where = where[here]
            if not len(where):
                break
            block = start // RANK_EVERY
            before = np.unpackbits(bits[block * RANK_EVERY // 8 : (start + 7) >> 3], bitorder="little")[: start - block * RANK_EVERY]
            start = int(ranks[block]) + int(before.sum())
            end = start + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.offsets[k]), int(self.offsets[k + 1]))


def split_words(texts: pa.Array) -> pa.Array:
    """The words of texts that are chains of words, each with the space before it; marks and line ends are words too."""
    marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
    return pc.split_pattern(pc.replace_substring_regex(marked, LETTER_MARK, "\\1\0\\2"), "\0")


class CachedEncoder:
    """Encodes whole texts with a byte-level BPE of the tokenizers library; the distinct words of a batch are encoded once.

    The split pattern of these vocabularies begins a new piece at every single space or line end between two other
    characters, and between a letter and a mark. So a text without runs of white space is the chain of its words, each with
    the space before it, its marks and its line ends: Arrow splits a batch into them, numbers the distinct ones, and takes their ids side by side. Texts with such
    runs, and texts that hold an added token, go to the library in one piece.
    """

    #: Words that come more than once in a batch are kept for the next ones; beyond so many the older half is dropped.
    MOST = 400_000
    #: Words in a text that the library gets; line ends part them.
    JOINED = 100

    def __init__(self, model: str, plain: bool = False):
        """plain: special tokens' strings in a text are text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(model)
        self.tok.encode_special_tokens = plain
        self.added = [x.content for x in self.tok.get_added_tokens_decoder().values() if not (plain and x.special)]
        parts = json.loads(model)
        pre = parts.get("pre_tokenizer") or {}
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.by_word = self.by_word and not parts.get("normalizer") and not any(c.isspace() for a in self.added for c in a)
        self.end = self.whole(["\n"])[0]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts that the library gets in one piece."""
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def lines(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts that stand after a line end."""
        return self.whole(texts)

    def words(self, words: list[str], counts: np.ndarray) -> list[bytes]:
        """The ids of distinct words, which come `counts` times."""
        if len(self.young) > self.MOST // 2:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out: list = list(map(young.get, words))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            out[i] = old.get(words[i])
        ask = [i for i, ids in enumerate(out) if ids is None]
        for a in range(0, len(ask), 500 * self.JOINED):
            at = [i for i in ask[a : a + 500 * self.JOINED] if words[i] not in ("", "\n")]
            texts = ["\n".join([words[i] for i in at[k : k + self.JOINED]]) for k in range(0, len(at), self.JOINED)]
            if texts:
                chain = np.concatenate([y for x in self.lines(texts) for y in (x, self.end)])
                ends = np.flatnonzero(chain == self.end[0]).tolist()
                data, last = chain.tobytes(), -1
                for i, e in zip(at, ends, strict=True):
                    out[i] = data[4 * (last + 1) : 4 * e]
                    last = e
        out = [ids if ids is not None else self.end.tobytes() if w else b"" for w, ids in zip(words, out, strict=True)]
        for i in np.flatnonzero(counts > 1).tolist():
            young[words[i]] = out[i]
        return out

    def _chains(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts that are chains of words."""
        split = split_words(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.words(words, np.bincount(coded.indices.to_numpy(), minlength=len(words)))
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        table = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(known), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(known))])
        chain = table.take(coded.indices)
        _, ends, ids = chain.buffers()
        ends = np.frombuffer(ends, np.int64)[chain.offset :][: len(chain) + 1] // 4
        edges = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist() if len(split) else [0]
        ids = np.frombuffer(ids or b"", "<u4")
        return [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def no_chains(self, texts: pa.Array) -> pa.Array:
        """Which of the texts are no chains of words."""
        whole = pc.match_substring_regex(texts, RUNS) if self.by_word else pa.array([True] * len(texts), pa.bool_())
        for a in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, a))
        return whole

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is encoded as the empty text."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        whole = self.no_chains(texts)
        if not pc.any(whole).as_py():
            return self._chains(texts)
        alone = iter(self.whole(texts.filter(whole).to_pylist()))
        chains = iter(self._chains(texts.filter(pc.invert(whole))))
        return [next(alone) if w else next(chains) for w in whole.to_pylist()]


@lru_cache(2)
def encoder(model: str) -> CachedEncoder:
    """One for each vocabulary and Python worker."""
    return CachedEncoder(model)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, in ascending id order (null ids first, null text as empty), into a table of segments.

    Rows are range-partitioned by id, then by the text's hash, so ties and repeated rows have one order and each task
    encodes its own range. A very long text is encoded in one piece and makes a segment of its own size. An empty table
    gives an empty table of segments. Other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))  # one vocabulary file
    schema = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("payload", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, seg, end = encoder(model.value), TaskContext.get().partitionId(), 0, np.array([end_id], "<u4")
        ids: list[np.ndarray] = []
        names: list = []
        held = 0

        def segment() -> pa.RecordBatch:
            nonlocal seg, held
            offsets = np.concatenate([[0], np.cumsum([len(x) + 1 for x in ids])])
            chain = np.concatenate([y for x in ids for y in (x, end)])
            row = pa.RecordBatch.from_pydict({"part": [part], "seg": [seg], "doc_ids": [list(names)], "n_tokens": [held], "payload": [encode_segment(chain, offsets)]}, schema)
            ids.clear()
            names.clear()
            seg, held = seg + 1, 0
            return row

        def encoded() -> Iterator[tuple[int | None, np.ndarray]]:
            waiting: list[pa.RecordBatch] = []
            for batch in itertools.chain(small_batches(batches, "t", BATCH_BYTES), [None]):
                # words come again in larger batches
                if waiting and (batch is None or sum(x.nbytes for x in waiting) + batch.nbytes > BATCH_BYTES):
                    rows = pa.Table.from_batches(waiting).combine_chunks()
                    waiting = []
                    for chunk in rows.to_batches():
                        yield from zip(chunk.column("id").to_pylist(), tok.encode(chunk.column("t")), strict=True)
                waiting += [batch] if batch is not None else []

        for key, x in encoded():
            ids.append(x)
            names.append(key)
            held += len(x) + 1
            if held >= SEGMENT_TOKENS:
                yield segment()
        if ids:
            yield segment()

    # the hash, not the text, breaks ties: range bounds are sampled on the driver
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "t").mapInArrow(encode, SEGMENTS).write.parquet(path)


def _starts(segs: DataFrame) -> DataFrame:
    """(part, seg, base, n_tokens): the tokens before each segment, summed for each part and then over the parts."""
    sizes = segs.select("part", "seg", "n_tokens")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("seg"))), F.lit(0))
    return sizes.withColumn("within", within).join(parts, "part").select("part", "seg", (F.col("base") + F.col("within")).alias("base"), "n_tokens")


def token_at(spark, path: str, position: int) -> int:
    """The token at a position in all documents of the segments at path: one segment is read, and of it a few bytes."""
    segs = spark.read.schema(SEGMENTS).parquet(path)
    found = _starts(segs).filter((F.col("base") <= position) & (F.col("base") + F.col("n_tokens") > position)).first()
    if found is None:
        raise IndexError(position)
    row = segs.filter((F.col("part") == found["part"]) & (F.col("seg") == found["seg"])).select("payload").first()
    return Segment(bytes(row["payload"])).token(position - found["base"])


def read_tokens(spark, path: str) -> DataFrame:
    """One row for each document of the segments at path, in no given order: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it. Null ids are kept, repeated ones are rows of their own, and a path
    without segments has no rows.
    """
    segs = spark.read.schema(SEGMENTS).parquet(path)
    starts = _starts(segs).drop("n_tokens")
    # the segments are decoded where they are read; only the documents' few numbers meet the starts

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, seg, names, payload in zip(pdf["part"], pdf["seg"], pdf["doc_ids"], pdf["payload"], strict=True):
                s = Segment(bytes(payload))
                ids, off = s.all_tokens().astype("<u4"), s.offsets.astype(np.int64)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
                keys = pd.array([None if pd.isna(x) else int(x) for x in names], dtype="Int64")
                yield pd.DataFrame({"part": part, "seg": seg, "doc_id": keys, "start": off[:-1], "n_tokens": off[1:] - off[:-1], "ids_crc32": crc})

    docs = segs.select("part", "seg", "doc_ids", "payload").mapInPandas(decode, "part int, seg int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(starts, ["part", "seg"]).select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write docs' ids below the shared folder and read them back."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_tokens(docs.sparkSession, path)
