"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. A task splits its texts into pre-tokens and keeps them by position as
   numbers of a block's own word list (a block is a bounded run of texts).
   The list, each word once, is cut into buckets by a hash of the word.
2. Buckets are shuffled; a bucket meets all blocks' lists, encodes each
   distinct word once, and answers every block in the order of its list.
3. Blocks meet their answers and put ids in the place of the words.

So a word travels once for each block that has it, in compressed runs, however
often it occurs: a word in every text adds one entry a block to its bucket.
Decoding joins ids to the token-byte table, which is as large as the
vocabulary and so is sent to every task.

Edge cases: a null or empty text has no ids and decodes to no bytes; repeated
rows and null ids of documents are kept as they are; ids that the vocabulary
lacks raise an error; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import base64
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm import shared
from veritab.llm.blocks import BLOCK_BYTES, BUCKET_BYTES, MOST_TABLE_BUCKETS, Numbered, block_numbers, bucket_count, pack, pack_words, release, runs, unpack, unpack_words

BLOCKS = "kind string, block bigint, bucket int, payload binary, word_buckets binary, doc_ids array<bigint>, lengths array<int>, carried array<array<string>>"
ANSWERS = "block bigint, bucket int, payload binary"
ENCODED = "doc_id bigint, ids array<int>, carried array<string>"


def load_ranks(path: str) -> dict[bytes, int]:
    """The token bytes and ranks of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _latin_pattern() -> re.Pattern:
    """The byte-level pattern for texts in Latin-1, where the standard engine's explicit classes are faster."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind)
    letter, number, space = of("L"), of("N"), "\\t-\\r \\x85\\xa0"
    return re.compile(
        f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


def splitter(pattern: str):
    """A function from a text to its pre-tokens, as `pattern` splits it."""
    import public_tokenizers

    general = regex.compile(pattern)
    if pattern != public_tokenizers.PATTERN:
        return general.findall
    latin = _latin_pattern()

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return general.findall(text)
        return latin.findall(text)

    return split


def _split_blocks(pattern: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, numbers = splitter(pattern), block_numbers(TaskContext.get().partitionId(), min(buckets, MOST_TABLE_BUCKETS))
        schema = pa.schema([
            ("kind", pa.string()), ("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary()),
            ("word_buckets", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("carried", pa.list_(pa.list_(pa.string()))),
        ])

        def block(local: dict, seqs: list, doc_ids: list, carried: list) -> pa.RecordBatch:
            words = list(local)
            seq = np.concatenate(seqs) if seqs else np.zeros(0, np.int32)
            order = np.argsort(-np.bincount(seq, minlength=len(words)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            encoded = [words[i].encode() for i in order.tolist()]
            of = np.fromiter((zlib.crc32(w) % buckets for w in encoded), np.int64, len(encoded))
            grouped = np.argsort(of, kind="stable")
            number = next(numbers)
            rows = [("doc", number, -1, pack(rank[seq], 4), pack(of, 4), doc_ids, [len(s) for s in seqs], carried)]
            for a, b in runs(of[grouped]):
                part = grouped[a:b].tolist()
                rows.append(("word", number, int(of[part[0]]), pack_words([encoded[i] for i in part]), None, None, None, None))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        local, seqs, doc_ids, carried, held = Numbered(), [], [], [], 0
        for batch in batches:
            for doc_id, text, more in zip(*(batch.column(k) for k in range(3)), strict=True):
                words = split(text.as_py() or "")
                seqs.append(np.fromiter(map(local.__getitem__, words), np.int32, len(words)))
                doc_ids.append(doc_id.as_py())
                carried.append(more.as_py())
                held += 8 + len(text.as_py() or "")
                if held >= BLOCK_BYTES:
                    yield block(local, seqs, doc_ids, carried)
                    local, seqs, doc_ids, carried, held = Numbered(), [], [], [], 0
        if seqs:
            yield block(local, seqs, doc_ids, carried)
        del local, seqs, doc_ids, carried
        release()

    return run


def _encode_buckets(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        piece, known, current = encoder._encode_single_piece, {}, None
        for batch in batches:
            for block, bucket, payload in zip(*(batch.column(k) for k in range(3)), strict=True):
                if bucket.as_py() != current:
                    known, current = {}, bucket.as_py()
                sizes, ids = [], []
                for word in unpack_words(payload.as_py()):
                    if (found := known.get(word)) is None:
                        found = known[word] = piece(word)
                    sizes.append(len(found))
                    ids += found
                answer = pack(np.array([len(sizes), *sizes, *ids], "<u4"), 4)
                yield pa.RecordBatch.from_pydict({"block": [block.as_py()], "bucket": pa.array([current], pa.int32()), "payload": [answer]})
        del known, encoder, piece
        release()

    return run


def _gather(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat[s : s + n] for each start and size, one after the other."""
    place = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    place += np.arange(len(place))
    return flat[place]


def _reassemble(texts: pa.Table, answered: pa.Table) -> pa.Table:
    """One block: its documents' row, and an answer for each of its buckets."""
    release()  # what the block before left
    (doc,) = texts.to_pylist()
    answers = sorted(answered.to_pylist(), key=lambda r: r["bucket"])
    seq = unpack(doc["payload"]).astype(np.int64)
    of = unpack(doc["word_buckets"])
    sizes, ids = [], []
    for row in answers:
        got = unpack(row["payload"])
        n = int(got[0])
        sizes.append(got[1 : n + 1])
        ids.append(got[n + 1 :])
    if sum(map(len, sizes)) != len(of):
        raise ValueError(f"block {doc['block']}: {sum(map(len, sizes))} answers for {len(of)} words")
    place = np.argsort(of, kind="stable")  # the answers' order, as numbers of the block's words
    size, start, flat = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64), np.zeros(0, "<u4")
    if answers:
        joined = np.concatenate(sizes).astype(np.int64)
        size[place], start[place] = joined, np.cumsum(joined) - joined
        flat = np.concatenate(ids)
    each = size[seq]
    out = _gather(start[seq], each, flat).astype(np.int32)
    lengths = np.array(doc["lengths"], np.int64)
    ends = np.concatenate(([0], np.cumsum(each)))[np.concatenate(([0], np.cumsum(lengths)))]
    return pa.table({"doc_id": pa.array(doc["doc_ids"], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out)), "carried": pa.array(doc["carried"], pa.list_(pa.string()))})


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and ids of every text, by the ranks in the file `vocabulary`; `carried` has the row's columns `carry` as strings."""
    spark = docs.sparkSession
    shared.bound_batches(spark)
    buckets = bucket_count(docs, text_col, bucket_bytes)
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))  # of the vocabulary's size, whatever the input's
    blocks = shared.materialize_bucketed(
        docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"), F.array(*[F.col(c).cast("string") for c in carry]).cast("array<string>")).mapInArrow(_split_blocks(pattern, buckets), BLOCKS),
        "bpe-blocks", "kind", "block", min(buckets, MOST_TABLE_BUCKETS),
    )
    answers = (
        blocks.filter("kind = 'word'").select("block", "bucket", "payload")
        .repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(_encode_buckets(ranks, pattern), ANSWERS)
    )
    texts = blocks.filter("kind = 'doc'").select("block", "payload", "word_buckets", "doc_ids", "lengths", "carried")  # bucketed: not shuffled
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_reassemble, ENCODED)


def byte_table(vocabulary: str) -> pa.Array:
    """The bytes of each id, by id; null where an id is not used."""
    ranks = load_ranks(vocabulary)
    out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return pa.array(out, pa.binary())


def decode_ids(ids: np.ndarray, table: pa.Array) -> bytes:
    """Join ids to the byte table, in their order."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(table)):
        raise ValueError("an id is not in the vocabulary")
    taken = table.take(pa.array(ids))
    if taken.null_count:
        raise ValueError("an id is not in the vocabulary")
    _, offsets, data = taken.buffers()
    if not len(ids):
        return b""
    ends = np.frombuffer(offsets, np.int32, len(ids) + 1, taken.offset * 4)
    return data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes()


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    column = batch.column(1)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    ends = ends - ends[0] if len(ends) else ends
    for i, doc_id in enumerate(batch.column(0).to_pylist()):
        yield doc_id, flat[ends[i] : ends[i + 1]]


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and the decoded bytes of every (doc_id, ids)."""
    table = encoded.sparkSession.sparkContext.broadcast(byte_table(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, ids in _each(batch):
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id], pa.int64()), "decoded": pa.array([decode_ids(ids, table.value)], pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded binary")


def round_trip_digests(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every (doc_id, ids)."""
    import hashlib

    table = encoded.sparkSession.sparkContext.broadcast(byte_table(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc_id, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode_ids(ids, table.value)).hexdigest())
                for doc_id, ids in _each(batch)
            ]
            if rows:
                a, b, c, d = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(a, pa.int64()), "n_tokens": pa.array(b, pa.int64()), "ids_sha256": c, "decoded_sha256": d})
        release()

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
