"""Toxic spans by a linear-chain conditional random field.

Labels are of documents, the field needs labels of tokens: a token of a toxic
training document counts as toxic if its word, or a prefix of four to six
letters, occurs significantly more often in toxic training documents than in
clean ones (log-likelihood ratio and odds below). The field has two states;
emissions are sums of weights of a word, its prefixes and its suffix, and
transitions are learnt. Forward-backward marginals give the offending offsets;
a document's score is a logistic function of its largest marginal and of the
expected number of toxic tokens, so it reads the whole text and nothing else.

The fit takes at most `max_clean` and `max_toxic` labelled documents (the first
by a hash of their ids that fit) of at most `max_bytes` together; scoring covers
all.

Edge cases: a null or empty text, or one without letters, gets the score of a
document without evidence; null ids or labels are not learnt from; ids labelled
both ways count as toxic; without toxic or without clean examples every score
is 0 or 1, whichever was seen (0 without any); ties in the sample's hash are
broken by id; repeated rows are learnt from as often as they occur and get equal
scores; a labelled text that exceeds what is left of the sample's bytes is
passed over; an empty table gives no rows;
further columns pass through reject() untouched.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm import shared
from veritab.llm.blocks import release

WORD = re.compile(r"[^\W\d_]+")
SEGMENT = 64
CACHED_WORDS = 200_000
FIT_TOKENS = 200_000
GROUP_BYTES = 1 << 20
MIN_RATIO, MIN_LLR, MIN_DOCS = 10.0, 24.0, 3
SPANS = "array<struct<start:int,end:int,probability:double>>"


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(word: str) -> list[str]:
    word = word.lower()
    return ["w" + word, *("p" + word[:n] for n in (4, 5, 6) if len(word) >= n), "s" + word[-3:]]


def _stems(word: str) -> list[str]:
    return features(word)[:-1]


class _Chain:
    """Documents cut into segments of equal length, so that all advance together."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.parts = -(-lengths // SEGMENT)  # segments of each document
        self.first = np.cumsum(self.parts) - self.parts
        total = int(self.parts.sum())
        doc = np.repeat(np.arange(len(lengths)), self.parts)
        nth = np.arange(total) - self.first[doc]
        inside = np.minimum(lengths[doc] - nth * SEGMENT, SEGMENT)
        begin = (np.cumsum(lengths) - lengths)[doc] + nth * SEGMENT
        steps = np.arange(SEGMENT)[:, None]
        self.here = steps < inside  # (SEGMENT, segments)
        self.index = np.where(self.here, begin + steps, 0)
        self.total = total

    def _pass(self, weight: np.ndarray, step: np.ndarray, backward: bool) -> tuple[np.ndarray, np.ndarray]:
        """Messages (two arrays like here) that arrive at each place, scaled to sum 1.

        weight: the odds of state 1 at each place; step: the 2 x 2 transition.
        A forward message holds the places before, a backward one those after.
        """
        places = range(SEGMENT - 1, -1, -1) if backward else range(SEGMENT)
        t = step if backward else step.T  # new[i] = sum_j t[i, j] * old[j]
        # a message across a whole segment, from either unit vector
        m = np.zeros((2, 2, self.total))
        m[0, 0] = m[1, 1] = 1.0

        def move(a, b, w, here):
            b = b * w
            x, y = t[0, 0] * a + t[0, 1] * b, t[1, 0] * a + t[1, 1] * b
            return np.where(here, x, a), np.where(here, y, b / w)

        for k in places:
            for u in (0, 1):
                m[0, u], m[1, u] = move(m[0, u], m[1, u], weight[k], self.here[k])
            m /= np.maximum(m.sum(axis=(0, 1)), 1e-300)
        enter = np.empty((2, self.total))
        message = np.full((2, len(self.lengths)), 0.5)
        for k in range(int(self.parts.max(initial=0))):
            docs = np.flatnonzero(self.parts > k)
            at = self.first[docs] + (self.parts[docs] - 1 - k if backward else k)
            enter[:, at] = message[:, docs]
            after = (m[:, :, at] * message[:, docs]).sum(axis=1)
            message[:, docs] = after / np.maximum(after.sum(axis=0), 1e-300)
        a, b = enter
        out = np.empty((SEGMENT, self.total)), np.empty((SEGMENT, self.total))
        for k in places:
            s = np.maximum(a + b, 1e-300)
            a, b = a / s, b / s
            out[0][k], out[1][k] = a, b
            a, b = move(a, b, weight[k], self.here[k])
        return out

    def run(self, emission: np.ndarray, transition: np.ndarray, transitions: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The marginal of state 1 at each token, and (where asked for) the expected transitions."""
        if not self.total:
            return np.zeros(0), np.zeros((2, 2))
        weight = np.exp(np.clip(emission, -30, 30))[self.index]
        step = np.exp(transition)
        f0, f1 = self._pass(weight, step, False)
        b0, b1 = self._pass(weight, step, True)
        zero, one = f0 * b0, f1 * b1 * weight
        order = np.argsort(self.index[self.here], kind="stable")
        p = (one / np.maximum(zero + one, 1e-300))[self.here][order]
        if not transitions:
            return p, np.zeros((2, 2))
        # the pair (place, next): forward at the place with its weight, the step, what comes backward to the place
        u = np.stack([f0, f1 * weight])
        norm = zero + one
        inner = self.here.copy()
        last = np.cumsum(self.parts[self.parts > 0]) - 1
        ends = self.lengths[self.parts > 0] - (self.parts[self.parts > 0] - 1) * SEGMENT - 1
        inner[ends, last] = False
        # backward messages are sums over the next state; split them by the message beyond the next place
        n0, n1 = np.roll(b0, -1, axis=0), np.roll(b1, -1, axis=0)
        n0[-1, :-1], n1[-1, :-1] = b0[0, 1:], b1[0, 1:]
        w = np.roll(weight, -1, axis=0)
        w[-1, :-1] = weight[0, 1:]
        nxt = np.stack([n0, n1 * w])
        joint = u[:, None] * step[:, :, None, None] * nxt[None]
        joint /= np.maximum(joint.sum(axis=(0, 1)), 1e-300)
        pairs = (joint * (inner & (norm > 0))).sum(axis=(2, 3))
        return p, pairs


def token_labels(texts: list[list[str]], toxic: list[bool]) -> set[str]:
    """Words and prefixes that mark toxic documents."""
    inside, outside = Counter(), Counter()
    for words, bad in zip(texts, toxic, strict=True):
        (inside if bad else outside).update({s for w in set(words) for s in _stems(w)})
    nt, nc = sum(toxic), len(toxic) - sum(toxic)
    out = set()
    for stem, t in inside.items():
        c = outside[stem]
        if t < MIN_DOCS or (t + 0.5) / (nt + 1) < MIN_RATIO * (c + 0.5) / (nc + 1):
            continue
        et, ec = (t + c) * nt / (nt + nc), (t + c) * nc / (nt + nc)
        if 2 * (t * math.log(t / et) + (c * math.log(c / ec) if c else 0)) >= MIN_LLR:
            out.add(stem)
    return out


def _adam(weights: np.ndarray, grad, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for k in range(1, steps + 1):
        g = grad(weights)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights = weights + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return weights


def _evidence(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each document: log odds of its largest marginal, and log(1 + expected toxic tokens)."""
    out = np.zeros((len(lengths), 2))
    out[:, 0] = -14.0
    ends = np.cumsum(lengths)
    for i in np.flatnonzero(lengths):
        own = p[ends[i] - lengths[i] : ends[i]]
        top = min(max(float(own.max()), 8.4e-7), 1 - 8.4e-7)
        out[i] = math.log(top / (1 - top)), math.log1p(float(own.sum()))
    return out


def fit(texts: list[str], toxic: list[bool], steps: int = 40) -> dict:
    """The field's and the document score's parameters."""
    if not any(toxic) or all(toxic):
        return {"constant": 1.0 if toxic and all(toxic) else 0.0}
    docs = [WORD.findall(t) for t in texts]
    marks = token_labels(docs, toxic)
    number: dict[str, int] = {}
    word_of = np.array([number.setdefault(w, len(number)) for d in docs for w in d], np.int64)
    lengths = np.array([len(d) for d in docs], np.int64)
    del docs
    words = list(number)
    names: dict[str, int] = {}
    pairs = [(i, names.setdefault(f, len(names))) for i, w in enumerate(words) for f in features(w)]
    at, feature = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
    del pairs
    marked = np.array([any(s in marks for s in _stems(w)) for w in words], bool)
    y = (marked[word_of] & np.repeat(np.array(toxic), lengths)).astype(float) if len(words) else np.zeros(0)
    n = len(names)
    starts = np.cumsum(lengths) - lengths
    within = np.ones(len(y), bool)
    within[starts[lengths > 0]] = False
    seen = np.zeros((2, 2))
    if len(y):
        np.add.at(seen, (y[:-1].astype(int)[within[1:]], y[1:].astype(int)[within[1:]]), 1)
    pull = 1.0 / max(1, int(y.sum()))
    # documents by parts, so that memory does not follow the sample
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // FIT_TOKENS, prepend=-1)).tolist() + [len(lengths)]
    chains = [_Chain(lengths[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def marginals(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by_word = np.bincount(at, w[feature], minlength=len(words)) + w[n]
        transition, found, expected, begin = np.array([[0.0, w[n + 1]], [w[n + 2], w[n + 3]]]), [], np.zeros((2, 2)), 0
        for chain in chains:
            end = begin + int(chain.lengths.sum())
            p, own = chain.run(by_word[word_of[begin:end]], transition)
            found.append(p)
            expected += own
            begin = end
        return np.concatenate(found), expected

    def grad(w):
        p, expected = marginals(w)
        by_word = np.bincount(word_of, y - p, minlength=len(words))
        g = np.concatenate([np.bincount(feature, by_word[at], minlength=n), [(y - p).sum()], (seen - expected).ravel()[1:]])
        return g * pull - 0.002 * w

    w = np.zeros(n + 4)
    w[n] = -4.0
    w = _adam(w, grad, steps, 0.4)
    w[:n][np.abs(w[:n]) <= 0.02] = 0.0
    model = {
        "weights": {f: float(w[i]) for f, i in names.items() if w[i]}, "bias": float(w[n]),
        "transition": np.array([[0.0, w[n + 1]], [w[n + 2], w[n + 3]]]),
    }
    x = np.column_stack([_evidence(marginals(w)[0], lengths) / 4, np.ones(len(lengths))])
    target = np.array(toxic, float)
    model["score"] = _adam(np.zeros(3), lambda v: x.T @ (target - 1 / (1 + np.exp(-x @ v))) / len(x) - 0.001 * v, 400, 0.1)
    return model


class _Emission(dict):
    def __init__(self, model: dict):
        self.of, self.bias = model["weights"], model["bias"]

    def __missing__(self, word: str) -> float:
        value = self.bias + sum(self.of.get(f, 0.0) for f in features(word))
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value


def _emissions(model: dict, docs: list[list[str]], cache: _Emission | None = None) -> np.ndarray:
    get = (cache if cache is not None else _Emission(model)).__getitem__
    return np.fromiter((get(w) for d in docs for w in d), np.float64, sum(map(len, docs)))


def score_texts(model: dict, texts: list[str], cache: _Emission | None = None, spans: bool = False) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores from 0 to 1, and where a token's marginal is at least a half: its offsets and the marginal."""
    if "constant" in model:
        return np.full(len(texts), model["constant"]), [[] for _ in texts]
    docs = [WORD.findall(t) for t in texts]
    lengths = np.array([len(d) for d in docs], np.int64)
    p, _ = _Chain(lengths).run(_emissions(model, docs, cache), model["transition"], transitions=False)
    x = np.column_stack([_evidence(p, lengths) / 4, np.ones(len(docs))])
    found: list[list[dict]] = [[] for _ in texts]
    if spans:
        ends = np.cumsum(lengths)
        for i in range(len(texts)):
            own = p[ends[i] - lengths[i] : ends[i]]
            if len(own) and own.max() >= 0.5:
                found[i] = [{"start": m.start(), "end": m.end(), "probability": float(v)} for m, v in zip(WORD.finditer(texts[i]), own, strict=True) if v >= 0.5]
    return 1 / (1 + np.exp(-x @ model["score"])), found


def fit_on(docs: DataFrame, labels: DataFrame, max_toxic: int = 600, max_clean: int = 1800, max_bytes: int = 32 << 20, spare: int = 4) -> dict:
    """Fit on labelled rows that are not held out; the sample is bounded by the parameters.

    Of either kind the first ids by a hash are looked at, `spare` times as many
    as are taken; toxic and clean texts fill their own share of `max_bytes`, and
    a text that does not fit into what is left of it is passed over. Sizes are
    read first: what reaches the driver is at most `max_bytes` of texts. Raises
    if labels of both kinds have texts and none of one kind fits.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    marks = marks.filter(~held_out()).withColumn("place", F.xxhash64("doc_id"))
    most = {1: max_toxic, 0: max_clean}
    take = lambda toxic: marks.filter(F.col("toxic") == toxic).orderBy("place", "doc_id").limit(spare * most[toxic])
    spark = docs.sparkSession
    asked = spark.createDataFrame(take(1).unionByName(take(0)).collect(), "doc_id bigint, toxic int, place bigint")  # bounded by the parameters
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = texts.select("doc_id", F.octet_length("text").cast("bigint").alias("size")).join(F.broadcast(asked), "doc_id")
    found = sizes.groupBy("doc_id", "toxic", "place").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()  # at most a row an id
    taken, left = {0: [], 1: []}, {k: max_bytes * most[k] // max(1, sum(most.values())) for k in most}
    for r in sorted(found, key=lambda r: (r["place"], r["doc_id"])):
        if len(taken[r["toxic"]]) < most[r["toxic"]] and r["size"] <= left[r["toxic"]]:
            taken[r["toxic"]].append(r["doc_id"])
            left[r["toxic"]] -= r["size"]
    kinds = {r["toxic"] for r in found}
    for kind in kinds:
        if not taken[kind] and len(kinds) > 1:
            raise ValueError(f"no labelled text with toxic = {kind} fits into its share of {max_bytes} bytes")
    ids = spark.createDataFrame([(i, k) for k, some in taken.items() for i in some], "doc_id bigint, toxic int")
    rows = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return fit([r["text"] for r in rows], [r["toxic"] == 1 for r in rows])


def _slices(texts: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about `most` bytes, with the place of the first; a longer text is a run of its own."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        held += n or 0
        if held > most and i > start:
            yield start, [t or "" for t in texts.slice(start, i - start).to_pylist()]
            start, held = i, n or 0
    if start < len(texts):
        yield start, [t or "" for t in texts.slice(start).to_pylist()]


def score(docs: DataFrame, model: dict, spans: bool = True) -> DataFrame:
    """doc_id, score and offending spans of every whole text."""
    shared.bound_batches(docs.sparkSession)
    shared_model = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the fit's parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared_model.value
        cache = _Emission(own) if "constant" not in own else None
        for batch in batches:
            for at, texts in _slices(batch.column(1)):
                values, found = score_texts(own, texts, cache, spans)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(values), pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])))],
                    names=["doc_id", "score", "offending"],
                )
        del cache
        release()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, f"doc_id bigint, score double, offending {SPANS}")


def reject(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""
    shared.bound_batches(docs.sparkSession)
    shared_model = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared_model.value
        cache = _Emission(own) if "constant" not in own else None
        for batch in batches:
            for first, texts in _slices(batch.column(at)):
                values, _ = score_texts(own, texts, cache)
                yield batch.slice(first, len(texts)).filter(pa.array(values < threshold))
        del cache
        release()

    return docs.mapInArrow(run, docs.schema)
