"""A Katz backoff bigram model of the corpus, and the log probability of every text.

Counts are discounted by Good-Turing up to K; what a history's discounts leave
goes to the words not seen after it, in proportion to their unigram
probability, by a backoff weight that is normalised exactly over the words that
were seen: alpha(h) = (1 - sum of P(w|h)) / (1 - sum of P(w)), both sums over
seen w. What the unigrams' discounts leave is the probability of one unknown
word. Evaluation recurs per token: bigram, else alpha times the unigram, else
alpha times the unknown word; after a history that was never seen, the unigram.

A block is a bounded run of texts. Words travel once for each block that has
them, as lists cut into buckets by hash; a bucket numbers and counts its words
and answers each block. Buckets are as many as the counted bytes ask for, so
what one holds does not grow with the input (but for a list a block of the words
that all blocks have). Bigrams do the same: distinct in a block, cut into
buckets by their history. Histories with more than 1 / (4 * buckets) of all
tokens, of which there are fewer than 4 * buckets, are cut by the whole bigram
instead; their sums are added up from the buckets and are the only ones sent
to every task. Buckets leave the model as tables partitioned by kind:
`unigrams` (words and counts) and `bigrams` (pairs of word numbers and counts).

Edge cases: a null or empty text is one end token; a null id is scored and
never learnt from; repeated rows count as often as they occur; without training
rows the one unknown word has all probability, so every score is 0; where
Good-Turing's estimates are not between 0 and 1 (small corpora), an absolute
discount takes their place; a history with no discounted count gets one more
count, so that something is left for the unseen; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm import shared
from veritab.llm.blocks import (
    BLOCK_BYTES, BUCKET_BYTES, MOST_TABLE_BUCKETS, Numbered, block_numbers, bucket_count, pack, pack_floats, pack_pairs, pack_words, release, runs, unpack, unpack_floats,
    unpack_pairs, unpack_words,
)

K = 5
END = b"\n"  # no word holds a blank
START = 2**63 - 1  # above the number of any word
STATS = K + 2  # of a history: n_1 .. n_K, the sum of larger counts, the sum of unigram probabilities
ROWS = "kind string, block bigint, bucket int, hot boolean, payload binary, counts binary, extra binary, stats array<double>"
BLOCKS = ROWS + ", doc_ids array<bigint>, lengths array<int>, train array<boolean>"
SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"
_ARROW = [
    ("kind", pa.string()), ("block", pa.int64()), ("bucket", pa.int32()), ("hot", pa.bool_()), ("payload", pa.binary()),
    ("counts", pa.binary()), ("extra", pa.binary()), ("stats", pa.list_(pa.float64())),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("train", pa.list_(pa.bool_())),
]


def _batch(rows: list[dict], width: int = 8) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema(_ARROW[:width]))


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """d[r], r from 0 to K + 1 (the last for all larger counts), from n[r], r from 0 to K + 1."""
    n = np.asarray(of_counts, np.float64)
    d = np.ones(K + 2)
    with np.errstate(all="ignore"):
        r = np.arange(1, K + 1)
        common = (K + 1) * n[K + 1] / n[1]
        good = ((r + 1) * n[2:] / (r * n[1 : K + 1]) - common) / (1 - common)
    if np.all(np.isfinite(good)) and np.all(good > 0) and np.all(good < 1):
        d[1 : K + 1] = good
    elif n[1] > 0:
        d[1 : K + 1] = (r - n[1] / (n[1] + 2 * n[2])) / r if n[2] > 0 else (r - 0.5) / r
    return d


class Unigrams:
    """Probabilities of words by their counts."""

    def __init__(self, total: float, distinct: float, of_counts: np.ndarray):
        self.total, self.distinct = total, distinct
        self.d = discounts(of_counts)
        seen = 0.0
        if total:
            small = np.arange(1, K + 1)
            seen = float((self.d[1 : K + 1] * small * of_counts[1 : K + 1]).sum() + total - (small * of_counts[1 : K + 1]).sum()) / total
        self.scale = 1.0 if not total or seen < 1 - 1e-12 else total / (total + 1)
        self.unknown = 1 - seen * self.scale

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        c = counts.astype(np.float64)
        known = self.d[np.minimum(counts, K + 1).astype(np.int64)] * c / max(self.total, 1) * self.scale
        return np.where(counts > 0, known, self.unknown)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def _split(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = block_numbers(TaskContext.get().partitionId(), min(buckets, MOST_TABLE_BUCKETS))

        def block(local: dict, seqs: list, ids: list, train: list) -> pa.RecordBatch:
            words, seq = list(local), np.concatenate(seqs)
            order = np.argsort(-np.bincount(seq, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            seq = rank[seq]
            lengths = [len(s) for s in seqs]
            learnt = np.bincount(seq, np.repeat(np.array(train, np.float64), lengths), minlength=len(words)).astype(np.uint64)
            words = [words[i] for i in order.tolist()]
            of = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            grouped = np.argsort(of, kind="stable")
            number = next(numbers)
            rows = [{"kind": "doc", "block": number, "bucket": -1, "hot": False, "payload": pack(seq, 4), "extra": pack(of, 4), "doc_ids": ids, "lengths": lengths, "train": train}]
            for a, b in runs(of[grouped]):
                part = grouped[a:b]
                rows.append({"kind": "word", "block": number, "bucket": int(of[part[0]]), "hot": False, "payload": pack_words([words[i] for i in part.tolist()]), "counts": pack(learnt[part])})
            return _batch(rows, 11)

        local, seqs, ids, train, held = Numbered(), [], [], [], 0
        for batch in batches:
            for doc_id, text, learns in zip(*(batch.column(k) for k in range(3)), strict=True):
                words = tokens(text.as_py())
                seqs.append(np.fromiter(map(local.__getitem__, words), np.int64, len(words)).astype(np.int32))
                ids.append(doc_id.as_py())
                train.append(learns.as_py())
                held += 16 + len(text.as_py() or "")
                if held >= BLOCK_BYTES:
                    yield block(local, seqs, ids, train)
                    local, seqs, ids, train, held = Numbered(), [], [], [], 0
        if seqs:
            yield block(local, seqs, ids, train)
        del local, seqs, ids, train
        release()

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one bucket after the other; they arrive sorted by bucket."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[-1]["bucket"] != row["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _of_counts(counts: np.ndarray) -> list[float]:
    return np.bincount(np.minimum(counts, K + 2).astype(np.int64), minlength=K + 3)[: K + 2].astype(float).tolist()


def _count_words(buckets: int):
    """A bucket of words: numbers and total counts for each block, sums for the driver, the table of unigrams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            number, bucket = Numbered(), rows[0]["bucket"]
            own = []
            for row in rows:
                words = unpack_words(row.pop("payload"))
                own.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            total = np.zeros(len(number), np.uint64)
            for row, at in zip(rows, own, strict=True):
                total[at] += unpack(row["counts"])
            for row, at in zip(rows, own, strict=True):
                yield _batch([{"kind": "answer", "block": row["block"], "bucket": bucket, "hot": False, "payload": pack(at * buckets + bucket), "counts": pack(total[at])}])
            yield _batch([
                {"kind": "sums", "bucket": bucket, "stats": [float(total.sum()), float((total > 0).sum()), *_of_counts(total)]},
                {"kind": "unigrams", "bucket": bucket, "payload": pack_words(list(number)), "counts": pack(total)},
            ])
            del number, own, total
            release()

    return run


class _Block:
    """A block's texts with the numbers and counts of its words, and its distinct bigrams by bucket."""

    def __init__(self, rows: list[dict], buckets: int, hot_from: float):
        self.doc = next(r for r in rows if r["kind"] == "doc")
        seq, of = unpack(self.doc["payload"]).astype(np.int64), unpack(self.doc["extra"]).astype(np.int64)
        place = np.argsort(of, kind="stable")
        words = sorted((r for r in rows if r["kind"] == "answer" and r["extra"] is None and r["stats"] is None), key=lambda r: r["bucket"])
        ids, counts = np.empty(len(of), np.uint64), np.empty(len(of), np.uint64)
        ids[place] = np.concatenate([unpack(r["payload"]) for r in words])
        counts[place] = np.concatenate([unpack(r["counts"]) for r in words])
        self.lengths = np.array(self.doc["lengths"], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.count = counts[seq]  # of each token
        # pairs as numbers of the block's own words, of which there are far fewer than 2**32; the last stands for the start
        before = np.empty(len(seq), np.int64)
        before[1:], before[self.starts] = seq[:-1], len(of)
        pairs, self.which = np.unique((before << 32) | seq, return_inverse=True)
        history, word = pairs >> 32, pairs & 0xFFFFFFFF
        self.history, self.word = np.append(ids, np.uint64(START))[history], ids[word]
        self.history_count, self.word_count = np.append(counts, np.uint64(0))[history], counts[word]
        self.first = history == len(of)
        self.hot = (self.history_count >= hot_from) | self.first
        cut = np.where(self.hot, _mix(_mix(self.history) + self.word), _mix(self.history))
        label = (cut % np.uint64(buckets)).astype(np.int64) * 2 + self.hot
        order = np.argsort(label, kind="stable")
        self.parts = [(int(label[order[a]]) // 2, bool(label[order[a]] % 2), order[a:b]) for a, b in runs(label[order])]


def _emit_bigrams(buckets: int, hot_from: float):
    def run(texts: pa.Table, answered: pa.Table) -> pa.Table:
        release()  # what the block before left
        block = _Block(texts.to_pylist() + answered.to_pylist(), buckets, hot_from)
        learns = np.repeat(np.array(block.doc["train"], np.float64), block.lengths)
        learnt = np.bincount(block.which, learns, minlength=len(block.word)).astype(np.uint64)
        rows = [
            {"kind": "bigram", "block": block.doc["block"], "bucket": bucket, "hot": hot, "payload": pack_pairs(block.history[at], block.word[at]), "counts": pack(learnt[at]), "extra": pack(block.word_count[at])}
            for bucket, hot, at in block.parts
        ]
        return pa.Table.from_batches([_batch(rows)])

    return run


def _history_stats(history: np.ndarray, n: int, counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """STATS numbers of each of n histories, over bigrams that were seen."""
    stats = np.zeros((n, STATS))
    for r in range(1, K + 1):
        stats[:, r - 1] = np.bincount(history, counts == r, minlength=n)
    stats[:, K] = np.bincount(history, np.where(counts > K, counts, 0).astype(np.float64), minlength=n)
    stats[:, K + 1] = np.bincount(history, np.where(counts > 0, lower, 0.0), minlength=n)
    return stats


def _count_bigrams(unigrams: Unigrams):
    """A bucket of bigrams: total counts, and of histories that need a backoff weight what it is made of."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket_rows in _by_bucket(batches):
            bucket, sums = bucket_rows[0]["bucket"], np.zeros(K + 2)
            for hot in (False, True):
                rows = [r for r in bucket_rows if r["hot"] == hot]
                if not rows:
                    continue
                each = [unpack_pairs(r["payload"]) for r in rows]
                histories, left = np.unique(np.concatenate([h for h, _ in each]), return_inverse=True)
                words, right = np.unique(np.concatenate([w for _, w in each]), return_inverse=True)
                pairs, at = np.unique((left << 32) | right, return_inverse=True)  # a bucket has far fewer than 2**32 of either
                total = np.bincount(at, np.concatenate([unpack(r["counts"]) for r in rows]).astype(np.float64), minlength=len(pairs)).astype(np.uint64)
                word_count = np.empty(len(pairs), np.uint64)
                word_count[at] = np.concatenate([unpack(r["extra"]) for r in rows])
                stats = _history_stats(pairs >> 32, len(histories), total, unigrams(word_count))
                bare = stats[:, :K].sum(axis=1) == 0
                sums += _of_counts(total)
                end = 0
                for row, (own, _) in zip(rows, each, strict=True):
                    here = slice(end, end + len(own))
                    end += len(own)
                    counts, extra = total[at[here]], b""
                    if not hot:
                        extra = pack_floats(stats[np.unique(left[here][counts == 0])])
                    guard = np.packbits(bare[left[here]])
                    yield _batch([{"kind": "answer", "block": row["block"], "bucket": bucket, "hot": hot, "payload": guard.tobytes(), "counts": pack(counts), "extra": extra}])
                if hot:
                    yield _batch([{"kind": "hot", "block": int(h), "bucket": bucket, "stats": s.tolist()} for h, s in zip(histories, stats, strict=True)])
                learnt = pairs[total > 0]
                yield _batch([{"kind": "bigrams", "bucket": bucket, "hot": hot, "payload": pack_pairs(histories[learnt >> 32], words[learnt & 0xFFFFFFFF]), "counts": pack(total[total > 0])}])
            yield _batch([{"kind": "sums", "bucket": bucket, "stats": sums.tolist()}])
            release()

    return run


def backoff(stats: np.ndarray, history_count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """alpha of each history from its STATS and count."""
    small = (stats[:, :K] * np.arange(1, K + 1) * d[1 : K + 1]).sum(axis=1)
    divisor = history_count + (stats[:, :K].sum(axis=1) == 0)
    return np.maximum(1 - (small + stats[:, K]) / divisor, 0) / np.maximum(1 - stats[:, K + 1], 1e-300)


def _score(buckets: int, hot_from: float, unigrams: Unigrams, d: np.ndarray, hot: dict[int, list[float]], train_docs: int):
    def run(texts: pa.Table, answered: pa.Table) -> pa.Table:
        release()  # what the block before left
        rows = texts.to_pylist() + answered.to_pylist()
        block = _Block(rows, buckets, hot_from)
        answers = {(r["bucket"], r["hot"]): r for r in rows if r["kind"] == "answer" and r["extra"] is not None}
        count, bare = np.zeros(len(block.word), np.int64), np.zeros(len(block.word), bool)
        history_count = np.where(block.first, train_docs, block.history_count).astype(np.float64)
        alpha = np.ones(len(block.word))
        hot_ids = np.array(sorted(hot), np.uint64)
        hot_stats = np.array([hot[int(h)] for h in hot_ids]).reshape(-1, STATS)
        for bucket, is_hot, at in block.parts:
            row = answers[bucket, is_hot]
            count[at] = unpack(row["counts"]).astype(np.int64)
            bare[at] = np.unpackbits(np.frombuffer(row["payload"], np.uint8), count=len(at)).astype(bool)
            history = block.history[at]
            if is_hot:
                stats, of = hot_stats, np.searchsorted(hot_ids, history)
                bare[at] = stats[of, :K].sum(axis=1) == 0
                open_ = np.arange(len(at))
            else:
                stats = unpack_floats(row["extra"]).reshape(-1, STATS)
                open_ = np.flatnonzero(count[at] == 0)
                of = np.searchsorted(np.unique(history[open_]), history[open_])
            known = open_[history_count[at[open_]] > 0]
            of = of[history_count[at[open_]] > 0]
            alpha[at[known]] = backoff(stats[of], history_count[at[known]], d)
        seen = count > 0
        lower = unigrams(block.word_count)
        p = np.where(seen, d[np.minimum(count, K + 1)] * count / np.maximum(history_count + bare, 1), alpha * lower)
        with np.errstate(divide="ignore"):
            log_p = np.log10(p)[block.which]
        base = np.log10((block.count.astype(np.float64) + 1) / (unigrams.total + unigrams.distinct + 1))
        doc = np.repeat(np.arange(len(block.lengths)), block.lengths)
        total = lambda x: np.bincount(doc, x, minlength=len(block.lengths))
        return pa.table({
            "doc_id": pa.array(block.doc["doc_ids"], pa.int64()), "n_tokens": pa.array(block.lengths),
            "n_known": pa.array(total(block.count > 0).astype(np.int64)), "base_score": pa.array(total(base)), "score": pa.array(total(log_p)),
        })

    return run


def katz_scores(docs: DataFrame, is_train: Column, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, train_tokens of every text; learns from rows where is_train."""
    shared.bound_batches(docs.sparkSession)
    buckets = bucket_count(docs, text_col, bucket_bytes)
    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"), F.coalesce(is_train & F.col(id_col).isNotNull(), F.lit(False)))
    blocks = shared.materialize_bucketed(rows.mapInArrow(_split(buckets), BLOCKS), "katz-blocks", "kind", "block", min(buckets, MOST_TABLE_BUCKETS))
    texts = blocks.filter("kind = 'doc'")  # bucketed: not shuffled
    sorted_ = lambda df: df.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    names = [x.split()[0] for x in ROWS.split(", ")]
    words = shared.materialize(sorted_(blocks.filter("kind = 'word'").select(*names)).mapInArrow(_count_words(buckets), ROWS), "katz-unigrams", partition_by="kind")
    sums = _added(words, K + 4)
    unigrams = Unigrams(sums[0], sums[1], sums[2:])
    hot_from = max(1.0, sums[0] / (4 * buckets))
    numbers = words.filter("kind = 'answer'").select(*names)
    meet = lambda answers: texts.groupBy("block").cogroup(answers.groupBy("block"))
    bigrams = meet(numbers).applyInArrow(_emit_bigrams(buckets, hot_from), ROWS)
    pairs = shared.materialize(sorted_(bigrams).mapInArrow(_count_bigrams(unigrams), ROWS), "katz-bigrams", partition_by="kind")
    d = discounts(_added(pairs, K + 2))
    # fewer than 4 * buckets histories, by the threshold
    hot = pairs.filter("kind = 'hot'").groupBy("block").agg(*[F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(STATS)]).collect()
    by_history = {r["block"]: list(r)[1:] for r in hot}
    train_docs = texts.select(F.sum(F.size(F.filter("train", lambda x: x)))).first()[0] or 0
    answers = numbers.unionByName(pairs.filter("kind = 'answer'").select(*names))
    scored = meet(answers).applyInArrow(_score(buckets, hot_from, unigrams, d, by_history, train_docs), SCORES)
    return scored.withColumn("train_tokens", F.lit(int(sums[0])).cast("bigint"))


def _added(table: DataFrame, width: int) -> np.ndarray:
    """The sums of the buckets' sums."""
    row = table.filter("kind = 'sums'").agg(*[F.sum(F.col("stats")[k]) for k in range(width)]).first()
    return np.array([x or 0.0 for x in row])
