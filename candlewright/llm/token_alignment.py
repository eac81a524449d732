"""Alignment of two tokenizers' tokens, and how many documents hold each aligned pair of ids.

Both tokenizers' tokens tile the bytes of a text. Offsets where a token of each ends cut them into groups; a token of one
is linked with every token of the other whose bytes overlap its own. Texts are cut where both tokenizers are sure to begin
a token (before a space, around a line end, between a letter and a mark), and the distinct words of a batch are aligned
once; texts that are no chains of such words are aligned in one piece.

The first pass aligns all documents and lists, for each task, its distinct pairs and the number of its documents that hold
them. The distinct pairs of the corpus, dealt to PARTS parts by a hash, get a minimal perfect hash function a part. With
it each task's list becomes a dense vector of counts, and the vectors are summed up a tree. The second pass aligns the
documents again and looks the counts of their links up: a pair's hash gives its place, the key there is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, own_prefix, small_batches, with_results
from .perfect_hash import PerfectHash, mixed
from .token_codes import LETTER_MARK, CachedEncoder, split_words

#: Parts of the pairs. A part has at most |A| * |B| / PARTS of them, 13 million for vocabularies of 50 000 and 32 000.
PARTS = 128
#: Bytes of text aligned at once.
BATCH_BYTES = 6 << 20
#: A task lists its pairs anew after so many.
LISTED_PAIRS = 2_000_000
#: Vectors summed by one task of the tree.
FAN_IN = 16
#: Pairs whose counts a task of the second pass holds (17 bytes each); of more, the pass is repeated for groups of parts.
HELD_PAIRS = 6_000_000
PAIRS = "task int, part int, keys array<bigint>, docs array<bigint>"
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
RESULTS = f"struct<{','.join(f'{c}:bigint' for c in NUMBERS)},groups:string>"


class PieceEncoder(CachedEncoder):
    """The same for a sentencepiece model, which writes a text's spaces as U+2581 and puts one before it."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.tok = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [self.tok.id_to_piece(i) for i in range(self.tok.get_piece_size())]
        plain = pa.array([p for i, p in enumerate(self.pieces) if not (self.tok.is_byte(i) or self.tok.is_control(i) or self.tok.is_unknown(i))])
        apart = pc.any(pc.match_substring_regex(plain, r"[^\x{2581}]\x{2581}|\n|" + LETTER_MARK)).as_py()
        self.added, self.by_word = [], not apart
        self.end = self.whole(["\n"])[0][-1:]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, "<u4") for x in self.tok.encode(texts, num_threads=1)]

    def lines(self, texts: list[str]) -> list[np.ndarray]:
        start = len(self.whole(["\n"])[0])
        return [x[start:] for x in self.whole(["\n" + t for t in texts])]


def _byte_level() -> dict[str, int]:
    """Characters of a byte-level vocabulary's entries, with their bytes: printable Latin-1 as it is, the others from U+0100 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers, sorted; much faster on many than np.unique."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Aligner:
    """Both encoders, and what their ids stand for."""

    #: Words that each encoder keeps.
    MOST = 250_000

    def __init__(self, a_model: str, b_model: bytes):
        self.a, self.b = CachedEncoder(a_model, plain=True), PieceEncoder(b_model)
        self.a.MOST = self.b.MOST = self.MOST
        self.by_word = self.a.by_word and self.b.by_word
        level, vocab = _byte_level(), self.a.tok.get_vocab(with_added_tokens=True)
        names: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            names[i] = bytes(level[c] for c in piece) if all(c in level for c in piece) else piece.encode()
        b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.tok.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.b.pieces)]
        self.bytes_of = [pa.array(x, pa.large_binary()) for x in (names, b_bytes)]
        self.decimal = [pa.array(list(map(str, range(len(x)))), pa.large_string()) for x in self.bytes_of]

    def units(self, texts: pa.Array) -> tuple[list[pa.Array], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words and distinct whole texts, each with the space before it; the unit of each place (words first); the
        places before each text that has any; and where these texts come from. Texts without a unit are null or empty."""
        texts = pc.fill_null(texts, "")
        whole = self.a.no_chains(texts) if self.by_word else pa.array([True] * len(texts), pa.bool_())
        filled = pc.not_equal(texts, "")
        chain, alone = pc.and_(filled, pc.invert(whole)), pc.and_(filled, whole)
        spaced = pc.binary_join_element_wise(pa.scalar(""), texts, " ")
        split = split_words(spaced.filter(chain))  # what is before a text's first space is empty, and the first of its words
        words = split.flatten()
        words = words.filter(pc.not_equal(words, "")).dictionary_encode()
        wholes = spaced.filter(alone).dictionary_encode()
        places = np.concatenate([words.indices.to_numpy(), wholes.indices.to_numpy() + len(words.dictionary)]).astype(np.int64)
        sizes = np.concatenate([pc.list_value_length(split).to_numpy() - 1, np.ones(len(wholes), np.int64)])
        where = np.concatenate([np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (chain, alone)])
        return [words.dictionary, wholes.dictionary], places, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), where

    def align(self, texts: pa.Array) -> Aligned:
        (words, wholes), places, edges, where = self.units(texts)
        counts = np.bincount(places, minlength=len(words) + len(wholes))[: len(words)]
        listed = words.to_numpy(zero_copy_only=False).tolist()
        ids = [tok.words(listed, counts) + [x.tobytes() for x in tok.whole([t[skip:] for t in wholes.to_pylist()])] for tok, skip in ((self.a, 0), (self.b, 1))]
        names = pa.chunked_array([words.cast(pa.large_binary()), wholes.cast(pa.large_binary())]).combine_chunks()
        return Aligned(self, names, ids, places, edges, where, len(texts))


@lru_cache(1)
def aligner(a_model: str, b_model: bytes) -> Aligner:
    """One for each pair of vocabularies and Python worker."""
    return Aligner(a_model, b_model)


class Aligned:
    """The links of a batch's distinct units, and where its texts hold these."""

    def __init__(self, by: Aligner, names: pa.Array, ids: list[list[bytes]], places: np.ndarray, edges: np.ndarray, where: np.ndarray, n: int):
        self.by, self.places, self.edges, self.where, self.n = by, places, edges, where, n
        n_units = len(names)
        good = np.ones(n_units, bool)
        tokens, starts = [], []
        for table, own in zip(by.bytes_of, ids, strict=True):
            sizes = np.fromiter(map(len, own), np.int64, n_units) // 4
            at = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.frombuffer(b"".join(own), "<u4").astype(np.int64)
            joined = table.take(pa.array(flat))
            ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset :][: len(flat) + 1]
            spelt = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n_units, [None, pa.py_buffer(np.ascontiguousarray(ends[at])), joined.buffers()[2]])
            good &= pc.equal(spelt, names).to_numpy(zero_copy_only=False)
            tokens.append(flat)
            starts.append(at)
        kept = np.flatnonzero(good)
        n_bytes = pc.binary_length(names).to_numpy().astype(np.int64)[kept]
        ends_of = []
        for k, table in enumerate(by.bytes_of):
            mine = np.repeat(good, np.diff(starts[k]))
            tokens[k] = tokens[k][mine]
            ends_of.append(np.cumsum(pc.binary_length(table).to_numpy().astype(np.int64)[tokens[k]]))
        # every byte where a token ends: 1 for A, 2 for B, 3 for both
        mark = np.zeros(int(n_bytes.sum()) + 1, np.uint8)
        mark[ends_of[0]] |= 1
        mark[ends_of[1]] |= 2
        ends = np.flatnonzero(mark)
        a_ends, b_ends, both = mark[ends] & 1 == 1, mark[ends] & 2 == 2, mark[ends] == 3
        a_done, b_done = np.cumsum(a_ends), np.cumsum(b_ends)
        # between two ends lies one link: the tokens that have not ended before it
        self.a_ids, self.b_ids = tokens[0][a_done - a_ends], tokens[1][b_done - b_ends]
        unit = kept[np.searchsorted(np.cumsum(n_bytes), ends)] if len(kept) else kept
        self.bad = ~good
        self.links = np.concatenate([[0], np.cumsum(np.bincount(unit, minlength=n_units))])  # of each unit
        per_unit = lambda flags: np.bincount(unit[flags], minlength=n_units)
        self.n_a, self.n_b, self.n_groups = per_unit(a_ends), per_unit(b_ends), per_unit(both)
        self.group_ends = [np.concatenate([[0], x[both]]) for x in (a_done, b_done)]
        self.tokens = tokens

    def keys(self) -> np.ndarray:
        """Each link as one number."""
        return self.a_ids << 32 | self.b_ids

    def whole_texts(self) -> np.ndarray:
        """Which of the texts that have units have none that is bad."""
        return self.sums(self.bad.astype(np.int64)) == 0

    def sums(self, of_unit: np.ndarray) -> np.ndarray:
        """A unit's number, summed over each text."""
        so_far = np.concatenate([[0], np.cumsum(of_unit[self.places])])
        return so_far[self.edges[1:]] - so_far[self.edges[:-1]]

    def unit_sums(self, of_link: np.ndarray) -> np.ndarray:
        so_far = np.concatenate([[0], np.cumsum(of_link)])
        return so_far[self.links[1:]] - so_far[self.links[:-1]]

    def pair_documents(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs, and how many of the texts hold each."""
        keys = self.keys()
        pairs = _distinct(keys)
        of_link = np.searchsorted(pairs, keys)
        n_units, n_pairs = len(self.bad), max(len(pairs), 1)
        text = np.repeat(np.arange(len(self.where)), np.diff(self.edges))
        fine = self.whole_texts()[text]
        held = _distinct(text[fine] * n_units + self.places[fine])  # each unit once a text
        text, unit = held // max(n_units, 1), held % max(n_units, 1)
        sizes = self.links[unit + 1] - self.links[unit]
        first = np.repeat(self.links[unit] - (np.cumsum(sizes) - sizes), sizes)
        link = first + np.arange(len(first))
        once = _distinct(np.repeat(text, sizes) * n_pairs + of_link[link])
        docs = np.bincount(once % n_pairs, minlength=len(pairs))
        return pairs[docs > 0], docs[docs > 0]

    def groups(self) -> pa.Array:
        """Each text's groups, as decimal ids: `a1,a2|b1;a3|b2,b3`."""
        comma, bar, semicolon = (pa.scalar(c, pa.large_string()) for c in ",|;")
        sides = [pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), by.take(pa.array(ids))), comma) for ids, ends, by in zip(self.tokens, self.group_ends, self.by.decimal, strict=True)]
        each = pc.binary_join_element_wise(*sides, bar)
        units = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(self.n_groups)])), each), semicolon)
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(self.edges), units.take(pa.array(self.places))), semicolon)

    def results(self, counted: dict[str, np.ndarray], groups: bool) -> pa.StructArray:
        """A row for each text of the batch; counted holds more numbers of links to sum up."""
        fine, out = self.whole_texts(), {}
        numbers = {"n_a": self.n_a, "n_b": self.n_b, "n_groups": self.n_groups, "n_links": np.diff(self.links)}
        for name, of_unit in (numbers | {c: self.unit_sums(v) for c, v in counted.items()}).items():
            out[name] = np.zeros(self.n, np.int64)
            out[name][self.where] = np.where(fine, self.sums(of_unit), 0)
        row = np.full(self.n, -1)
        row[self.where[fine]] = np.flatnonzero(fine)
        found = self.groups().take(pa.array(row, mask=row < 0)) if groups and len(self.where) else pa.nulls(self.n, pa.large_string())
        return pa.StructArray.from_arrays([*map(pa.array, out.values()), pc.fill_null(found, "").cast(pa.string())], [*out, "groups"])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of (keys, numbers) as one, with the numbers of a key summed."""
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([v for _, v in parts]), minlength=len(keys)).astype(np.int64)


def _part(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 99) % np.uint64(PARTS)).astype(np.int64)


def list_pairs(docs: DataFrame, a_model: str, b_model: bytes, text_col: str = "text") -> DataFrame:
    """(task, part, keys, docs): each task's distinct pairs by part, and how many of its documents hold them.

    A pair's key is a_id * 2^32 + b_id. Each row of docs is a document; those with null or empty text, or of which a
    tokenizer's bytes are not the text's, hold none.
    """
    models = docs.sparkSession.sparkContext.broadcast((a_model, b_model))  # two vocabulary files

    def rows(found: list) -> Iterator[pa.RecordBatch]:
        keys, docs = _merged(found)
        part = _part(keys)
        order = np.argsort(part, kind="stable")
        keys, docs, ends = keys[order], docs[order], np.cumsum(np.bincount(part, minlength=PARTS))
        for lo, hi, p in zip([0, *ends[:-1].tolist()], ends.tolist(), range(PARTS), strict=True):
            if hi > lo:
                lists = [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), pa.array(x[lo:hi])) for x in (keys, docs)]
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([p], pa.int32()), *lists], ["task", "part", "keys", "docs"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, found = aligner(*models.value), []
        for texts in gathered(b.column(0) for batch in batches for b in small_batches([batch], "t", BATCH_BYTES)):
            found.append(tool.align(texts).pair_documents())
            if sum(len(k) for k, _ in found) > LISTED_PAIRS:
                found = [_merged(found)]
                if len(found[0][0]) > LISTED_PAIRS // 2:
                    yield from rows(found)
                    found = []
        if found:
            yield from rows(found)

    return docs.select(F.col(text_col).alias("t")).mapInArrow(listed, PAIRS)


def gathered(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Neighbouring arrays together, up to about BATCH_BYTES."""
    held: list[pa.Array] = []
    for x in texts:
        if held and sum(h.nbytes for h in held) + x.nbytes > BATCH_BYTES:
            yield pa.concat_arrays(held)
            held = []
        held.append(x)
    if held:
        yield pa.concat_arrays(held)


def count_pairs(lists: DataFrame) -> DataFrame:
    """(part, hash, keys, docs): a part's perfect hash function, and keys and document counts at their places in it.

    lists is what list_pairs gives, written down. A part's distinct pairs are bounded by the vocabularies. Vectors are
    summed FAN_IN at a time, so no task gets all lists of a part, however many tasks listed.
    """

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["key"].to_numpy(np.int64)
        f = PerfectHash.of(keys)
        placed = np.empty(len(keys), np.int64)
        placed[f.index(keys)] = keys
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "hash": [f.to_bytes()], "keys": [placed.astype("<i8").tobytes()]})

    def dense(pdf: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
        f = PerfectHash.from_bytes(tables["hash"].iloc[0])
        vector = np.zeros(f.n, np.int64)
        for keys, docs in zip(pdf["keys"], pdf["docs"], strict=True):
            vector[f.index(np.asarray(keys, np.int64))] += np.asarray(docs, np.int64)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "branch": pdf["branch"].iloc[:1], "docs": [vector.astype("<i8").tobytes()]})

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i8") for x in pdf["docs"])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "branch": pdf["branch"].iloc[:1], "docs": [total.tobytes()]})

    up = (F.col("branch") / FAN_IN).cast("int")
    pairs = lists.select("part", F.explode("keys").alias("key")).distinct()
    tables = materialize(pairs.groupBy("part").applyInPandas(built, "part int, hash binary, keys binary"), "pair-hashes")
    leaves = lists.select("part", (F.col("task") / FAN_IN).cast("int").alias("branch"), "keys", "docs")
    copies = leaves.select(F.col("part").alias("of"), F.col("branch").alias("at")).distinct().join(tables.select(F.col("part").alias("of"), "hash"), "of")
    vectors = leaves.groupBy("part", "branch").cogroup(copies.groupBy("of", "at")).applyInPandas(dense, "part int, branch int, docs binary")
    last = lists.agg((F.max("task") / FAN_IN).cast("int")).first()[0] or 0
    while last:
        vectors = materialize(vectors, "pair-vectors").withColumn("branch", up).groupBy("part", "branch").applyInPandas(summed, "part int, branch int, docs binary")
        last //= FAN_IN
    return materialize(tables.join(vectors.select("part", "docs"), "part"), "pair-counts")


def pair_rows(counts: DataFrame) -> DataFrame:
    """(a_id, b_id, n_docs) for each pair of count_pairs."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for keys, docs in zip(pdf["keys"], pdf["docs"], strict=True):
                k = np.frombuffer(keys, "<i8")
                yield pd.DataFrame({"a_id": k >> 32, "b_id": k & 0xFFFFFFFF, "n_docs": np.frombuffer(docs, "<i8")})

    return counts.select("keys", "docs").mapInPandas(rows, "a_id bigint, b_id bigint, n_docs bigint")


class PairCounts:
    """The counts of some parts, looked up by perfect hash; a pair of other parts counts 0."""

    def __init__(self, rows: list[tuple[int, bytes, bytes, bytes]], most: np.ndarray):
        self.most = most
        self.parts = {p: (PerfectHash.from_bytes(h), np.frombuffer(k, "<i8"), np.frombuffer(d, "<i8")) for p, h, k, d in rows}

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether it is the highest of its A id) of each key."""
        distinct = _distinct(keys)
        back = np.searchsorted(distinct, keys)
        counts, held = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), bool)
        part = _part(distinct)
        order = np.argsort(part, kind="stable")
        ends = np.cumsum(np.bincount(part, minlength=PARTS))
        for p, (f, known, docs) in self.parts.items():
            at = order[ends[p - 1] if p else 0 : ends[p]]
            if len(at):
                i = f.index(distinct[at])
                true = (i >= 0) & (known[i] == distinct[at])
                counts[at[true]], held[at[true]] = docs[i[true]], True
        best = held & (counts == self.most[distinct >> 32])
        return counts[back], best[back].astype(np.int64)


def align_documents(docs: DataFrame, a_model: str, b_model: bytes, text_col: str = "text", groups: bool = True) -> DataFrame:
    """docs with n_a, n_b, n_groups, n_links, n_best, count_sum (all bigint) and groups, a string as in Aligned.groups.

    Texts that are null, empty, or not spelt byte for byte by both tokenizers have zeros and an empty `groups`, and hold no
    pair. Repeated rows are documents like any others. Very long texts are aligned whole. An empty table gives an empty
    result. Of pairs that share an A id's highest count all count as best. Columns named like the results, in whatever
    case, are replaced; all others stay, whatever their names.

    Without groups, `groups` is empty. At most HELD_PAIRS pairs are held at once: with more, the documents are aligned once
    for each group of parts, written down in between.
    """
    counts = count_pairs(materialize(list_pairs(docs, a_model, b_model, text_col), "pair-lists"))
    most = pair_rows(counts).groupBy("a_id").agg(F.max("n_docs").alias("n")).toPandas()  # one row an id of A at most
    best = np.zeros(int(most["a_id"].max()) + 1 if len(most) else 1, np.int64)
    best[most["a_id"].to_numpy(np.int64)] = most["n"].to_numpy(np.int64)
    sizes = {r[0]: r[1] // 8 for r in counts.select("part", F.length("keys")).collect()}  # PARTS rows at most
    passes: list[list[int]] = [[]]
    for p in sorted(sizes):
        if passes[-1] and sum(sizes[x] for x in passes[-1]) + sizes[p] > HELD_PAIRS:
            passes.append([])
        passes[-1].append(p)
    own = own_prefix(docs)
    rows = docs
    for k, parts in enumerate(passes):
        found = _looked_up(docs, counts.filter(F.col("part").isin(parts)), best, a_model, b_model, groups and k == 0)
        rows = rows.withColumn(f"{own}{k}", found(F.col(text_col)))
        if k + 1 < len(passes):
            rows = materialize(rows, "aligned")
    total = lambda c: sum((F.col(f"{own}{k}.{c}") for k in range(1, len(passes))), F.col(f"{own}0.{c}"))
    return with_results(rows, own, {c: total(c) if c in ("n_best", "count_sum") else F.col(f"{own}0.{c}") for c in (*NUMBERS, "groups")})


def _looked_up(docs: DataFrame, counts: DataFrame, best: np.ndarray, a_model: str, b_model: bytes, groups: bool):
    rows = [(r["part"], bytes(r["hash"]), bytes(r["keys"]), bytes(r["docs"])) for r in counts.collect()]  # HELD_PAIRS, or one part
    held = docs.sparkSession.sparkContext.broadcast((a_model, b_model, rows, best))

    @F.arrow_udf(RESULTS)
    def looked_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a, b, table, most = held.value
        tool, known = aligner(a, b), PairCounts(table, most)
        for texts in gathered(batches):
            out = []
            for part in small_batches([pa.RecordBatch.from_arrays([texts], ["t"])], "t", BATCH_BYTES):
                found = tool.align(part.column("t"))
                count, is_best = known.of(found.keys())
                out.append(found.results({"n_best": is_best, "count_sum": count}, groups))
            yield pa.concat_arrays(out)

    return looked_up



def read_models(a_path: str, b_path: str) -> tuple[str, bytes]:
    """A tokenizers file of byte-level BPE and a sentencepiece model, as align_documents takes them."""
    return Path(a_path).read_text(encoding="utf-8"), Path(b_path).read_bytes()
