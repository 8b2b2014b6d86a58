"""Byte-level BPE by a global shuffle of distinct words.

Texts are split into pre-tokens. A block of documents (what one task reads, up to a
bound) keeps the positions as indices into its own list of distinct words, and sends
each word once, with its index, to the word's bucket. A bucket sees all blocks, encodes
each of its words once and answers every block. There the ids are put in at the
positions, which gives the documents' ids. So the words that are shuffled are distinct
a block, and the encoder's work grows with the vocabulary, not with the text.

Decoding looks the ids up in the token-byte table, whose size is that of the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text that a block has at most, unless one document alone has more.
BLOCK_CHARS = 32_000_000
#: Positions that are filled at once, unless one document alone has more.
SLICE = 250_000
Blocks = Iterator[tuple[str, list, np.ndarray, np.ndarray, list[str]]]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file, read where the driver runs."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str) -> Blocks:
    """Name, doc_ids, pre-tokens a document, word indices and words of every block.

    Words are in the order of their frequency, which makes the indices short. The name
    is a digest of all of it: the same documents give the same name.
    """
    find = regex.compile(pattern).findall
    ids, lengths, parts, number, chars = [], [], [], defaultdict(count().__next__), 0

    def close():
        seq = np.concatenate(parts) if parts else np.empty(0, np.int32)
        counts = np.bincount(seq, minlength=len(number))
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        known = list(number)
        words = [known[i] for i in order.tolist()]
        seq = place[seq] if len(seq) else seq
        mark = hashlib.sha256(seq.tobytes())
        mark.update(repr((ids, lengths)).encode())
        mark.update("\0".join(words).encode("utf-8", "surrogatepass"))
        return mark.hexdigest(), ids, np.array(lengths, np.int32), seq, words

    for b in batches:
        for doc_id, text in zip(b.column("doc_id"), b.column("text")):
            text = text.as_py()
            if chars and chars + len(text) > BLOCK_CHARS:
                yield close()
                ids, lengths, parts, number, chars = [], [], [], defaultdict(count().__next__), 0
            found = find(text)
            ids.append(doc_id.as_py())
            lengths.append(len(found))
            parts.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
            chars += len(text) + 1
    if ids:
        yield close()


class TokenBytes:
    """The token-byte table: bytes of all tokens, with the place and length of each."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.joined = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
        """Bytes of the ids between each two cuts, as an Arrow array of binaries."""
        if len(ids) and (self.size[ids] == 0).any():
            raise ValueError("an id is not in the vocabulary")
        ends = np.concatenate(([0], np.cumsum(self.size[ids])))
        at = np.repeat(self.start[ids] - ends[:-1], self.size[ids]) + np.arange(ends[-1])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(ends[cuts]), pa.py_buffer(self.joined[at])]).cast(pa.binary())


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_bytes: bool = False) -> DataFrame:
    """doc_id, ids (array<int>) and n_tokens of every row of ``docs`` (doc_id, text).

    With ``with_bytes`` the ids are decoded again where they are, as column decoded.
    A null text is empty and has no ids. Whole texts are encoded, each match of
    ``pattern`` by itself, without special tokens. Repeated rows are rows of their own;
    null doc_ids stay; other columns are ignored; an empty table gives an empty result.
    The table is read twice, so it should be a stored one; if the two reads differ, the
    job fails rather than mixing them up.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for name, ids, lengths, seq, words in _blocks(batches, pattern):
            planes = np.ascontiguousarray(seq.view(np.uint8).reshape(-1, 4).T)
            yield pa.RecordBatch.from_pydict({"block": [name], "doc_ids": pa.array([ids], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int32())), "n_words": pa.array([len(words)], pa.int32()), "seq": [pack(planes.tobytes())]})

    def dictionaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, _, _, words in _blocks(batches, pattern):
            at = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words)) % np.uint32(buckets)
            order = np.argsort(at, kind="stable").astype(np.int32)
            ends = np.searchsorted(at[order], np.arange(buckets), side="right").tolist()
            column, start = pa.array(words, pa.string()).take(pa.array(order)), 0
            for bucket, end in enumerate(ends):
                if end > start:
                    part = column.slice(start, end - start)
                    yield pa.RecordBatch.from_pydict({"block": [name], "bucket": pa.array([bucket], pa.int32()), "slots": pa.array([order[start:end]], pa.list_(pa.int32())), "words": pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)})
                start = end

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={}).encode_ordinary
        now, known = None, {}
        for b in batches:
            for row in range(b.num_rows):
                if now != (now := b.column("bucket")[row].as_py()):
                    known = {}
                found = []
                for w in b.column("words")[row].as_py():
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = one(w)
                    found.append(ids)
                lens = np.fromiter(map(len, found), np.int32, len(found))
                flat = np.fromiter((i for ids in found for i in ids), np.int32, int(lens.sum()))
                yield pa.RecordBatch.from_pydict({"block": b.column("block").slice(row, 1), "slots": b.column("slots").slice(row, 1), "lens": pa.array([lens], pa.list_(pa.int32())), "flat": pa.array([flat], pa.list_(pa.int32()))})

    def put_together(order: pa.Table, answers: pa.Table) -> pa.Table:
        if order.num_rows == 0:
            raise ValueError("two reads of the documents differ: store the table first")
        seq_of = zstandard.ZstdDecompressor().decompress
        tokens = TokenBytes(shared.value) if with_bytes else None
        made = []
        # Equal blocks (the same documents, stored twice) have equal words; any of the answers will do.
        slots = answers.column("slots").combine_chunks().flatten().to_numpy()
        lens, flat = (answers.column(c).combine_chunks().flatten().to_numpy() for c in ("lens", "flat"))
        n_words = order.column("n_words")[0].as_py()
        starts = np.zeros(n_words, np.int64)
        sizes = np.full(n_words, -1, np.int64)
        starts[slots], sizes[slots] = np.cumsum(lens) - lens, lens
        if (sizes < 0).any():
            raise ValueError("two reads of the documents differ: store the table first")
        for row in range(order.num_rows):
            planes = np.frombuffer(seq_of(order.column("seq")[row].as_py()), np.uint8).reshape(4, -1)
            seq = np.ascontiguousarray(planes.T).view(np.int32).ravel()
            of_doc = np.concatenate(([0], np.cumsum(order.column("lengths")[row].values.to_numpy())))
            doc_ids = order.column("doc_ids")[row].values
            first = 0
            while first < len(doc_ids):
                last = max(first + 1, int(np.searchsorted(of_doc, of_doc[first] + SLICE, side="right")) - 1)
                some = seq[of_doc[first] : of_doc[last]]
                ends = np.concatenate(([0], np.cumsum(sizes[some])))
                ids = flat[np.repeat(starts[some] - ends[:-1], sizes[some]) + np.arange(ends[-1])]
                cuts = ends[of_doc[first : last + 1] - of_doc[first]]
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids, pa.int32()))
                columns = {"doc_id": doc_ids.slice(first, last - first), "ids": lists, "n_tokens": pa.array(np.diff(cuts), pa.int64())}
                made.append(pa.table(columns | ({"decoded": tokens.decode(ids, cuts)} if tokens else {})))
                first = last
        return pa.concat_tables(made)

    by_block = texts.mapInArrow(positions, "block string, doc_ids array<long>, lengths array<int>, n_words int, seq binary").groupBy("block")
    words = texts.mapInArrow(dictionaries, "block string, bucket int, slots array<int>, words array<string>")
    answers = words.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(encoded, "block string, slots array<int>, lens array<int>, flat array<int>")
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(put_together, "doc_id long, ids array<int>, n_tokens long" + ", decoded binary" * with_bytes)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """All columns of ``encoded`` plus decoded (binary): the bytes of its ids.

    Null ids give null. An id that the vocabulary lacks is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("binary")
    def joined(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = TokenBytes(shared.value)
        for some in batches:
            lists = [np.empty(0, np.int32) if ids is None else np.asarray(ids) for ids in some]
            cuts = np.cumsum([0, *map(len, lists)])
            made = tokens.decode(np.concatenate([np.empty(0, np.int32), *lists]), cuts).to_pylist()
            yield pd.Series([None if ids is None else b for ids, b in zip(some, made)], some.index, object)

    return encoded.withColumn("decoded", joined("ids"))
