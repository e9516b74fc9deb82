"""Subject areas of documents.

Terms: a sentence has one topic, a subject or none; a document mixes topics;
words follow the topic. The labelled examples start the word weights, and rounds
over all documents (expectation and maximisation, word sums gathered by a
shuffle) extend them to words the examples lack. A word speaks for a subject only
if its use is concentrated on it, so templates, greetings and the words of a
language stay neutral. Words are hashed into ``BUCKETS`` places, so every word of
every document counts and the model's size doesn't depend on the corpus.

Labels: a classifier chain, one logistic classifier per subject, reads term
features of a document (hard and expected share of sentences about the subject,
whether the hard share reaches ``FIFTH``, the largest other share), structure
features (sentences, share of lines without an end mark, share of sentences that
can't be told), a source feature (how often documents of the source have the
subject; the corpus rate where the source is null) and the decisions before it in
the chain, which is how co-occurrence enters. It is fitted on ``SAMPLE`` documents
drawn by hash with the labels the term model gives their full text, read once more
with words left out at random, so it learns to decide where the text alone doesn't;
and on documents composed of the labelled examples, whose labels are known. A part
is held out to calibrate each classifier (Platt). A beam search picks the likeliest
combination of labels.

Equal texts are classified once, under the least of their sources. To the driver
come only sums per bucket, the sample's features and the fixed examples.

Defined results: null, empty and blank texts and texts without a subject get no
row; a copy has the same subjects; whole texts are read, whatever their length.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators.skew import attach
from turnloom.runtime import small, stored

FIFTH = 0.2
ROUNDS = 3
#: Places of the hashed words; bounds the model, its sums and its broadcast.
BUCKETS = 1 << 18
EXAMPLE_WEIGHT = 3.0
#: A word met so often is believed by half; no word is believed beyond LEAST_DOUBT.
SMOOTH = 10.0
LEAST_DOUBT = 0.005
#: So many words that speak for subjects count fully in a sentence.
EVIDENCE = 3.0
#: Sentences of each topic that a document is taken to have besides its own.
PRIOR = 0.03
#: Documents the chain is fitted on: about SAMPLE (at most four times as many) of the corpus and COMPOSED of the examples.
SAMPLE = 4000
COMPOSED = 1000
#: Up to this part of a sampled document's words is left out.
LEFT_OUT = 0.3
HELD_OUT = 4
#: Documents that a source is taken to have besides its own.
SOURCE_PRIOR = 20.0
#: Labelled texts read to the driver; a larger table is refused, not cut.
MOST_EXAMPLES = 100_000
BEAM = 8
#: Texts a worker reads at once.
CHUNK = 1000
MISSED = 0.02
#: Distinct words and signs a worker remembers.
REMEMBERED = 500_000

_TAG = re.compile(r"^\s*(?:\d+[.)]\s+|[-*•–]\s+)*(?:\[\w+\]\s*|\w{1,10}(?:\s*[^\w\s:]+)?\s*:\s+|\w{1,10}(?:\s+[^\w\s]+)?\s+[-–—]\s+|[-*•–]\s+|\d+[.)]\s+)*")
_LINES = re.compile("[\r\n\v\f\x85\u2028\u2029]+")
_BREAK = re.compile(r"(?<=[.!?])[\"'”’)\]]*\s+(?=\W*[^\W_])|(?<=[^\W\d_]{2}[.!?])(?=[^\W\d_]+[\s'])")
_END = re.compile(r"[.!?]\W*$")
_WORD = re.compile(r"(?<![\d\w])[^\W\d_]+(?:-[^\W\d_]+)*(?![\d\w])")


class _Plain(dict):
    """Signs without accents, remembered; invisible ones are left out."""

    def __missing__(self, code: int) -> str:
        self[code] = plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
        return plain


_PLAIN = _Plain()


def fold(text: str) -> str:
    """Lower case without accents and invisible characters; an ellipsis is a blank, an invisible break after a sentence too."""
    if text.isascii():
        return text.lower().replace("...", " ")
    text = re.sub("(?<=[.!?])[\u200b\u2060\ufeff]+", " ", text.replace("\u2026", " ").replace("...", " "))
    return text.lower().replace("\u00df", "ss").translate(_PLAIN)


def sentences(text: str) -> list[tuple[list[str], bool]]:
    """(distinct words, has an end mark) of each sentence; speaker tags and list marks are left out."""
    out = []
    for line in _LINES.split(fold(text)):
        for part in _BREAK.split(_TAG.sub("", line)):
            words = list(dict.fromkeys(_WORD.findall(part)))
            if words:
                out.append((words, bool(_END.search(part))))
    return out


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = place = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return place


_BUCKETS = _Buckets()


class Reading:
    """Sentences as the buckets of their words: ``index`` of all, ``ends`` of each (from 0), ``document`` numbers and end marks."""

    def __init__(self, index: np.ndarray, ends: np.ndarray, document: np.ndarray, marks: np.ndarray, n: int):
        self.index, self.ends, self.document, self.marks, self.n = index, ends, document, marks, n

    @classmethod
    def of(cls, lists: list[list[str]], marks: list[bool], sizes: list[int]) -> Reading:
        index = np.fromiter((_BUCKETS[w] for words in lists for w in words), dtype=np.int64)
        return cls(index, np.cumsum([0] + [len(words) for words in lists]), np.repeat(np.arange(len(sizes)), sizes), np.array(marks, dtype=bool), len(sizes))

    @classmethod
    def batches(cls, batch: pa.RecordBatch) -> Iterator[tuple[int, int, Reading]]:
        """The stored columns words, lengths and marks, some texts at a time."""
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            flat = lambda name: part.column(name).flatten().to_numpy(zero_copy_only=False)
            sizes = part.column("lengths").value_lengths().to_numpy(zero_copy_only=False)
            yield at, at + part.num_rows, cls(flat("words").astype(np.int64), np.concatenate([[0], np.cumsum(flat("lengths"))]), np.repeat(np.arange(part.num_rows), sizes), flat("marks").astype(bool), part.num_rows)

    def thinned(self, rng: np.random.Generator) -> Reading:
        """Without a part of each document's words, up to LEFT_OUT of them."""
        rate = rng.random(self.n) * LEFT_OUT
        sentence = np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))
        keep = rng.random(len(self.index)) >= rate[self.document][sentence]
        return Reading(self.index[keep], np.concatenate([[0], np.cumsum(np.bincount(sentence[keep], minlength=len(self.ends) - 1))]), self.document, self.marks, self.n)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """``values`` of each sentence's words put together."""
        total = np.zeros((len(self.ends) - 1, values.shape[1]))
        some = np.flatnonzero(np.diff(self.ends))
        if len(some):
            total[some] = np.add.reduceat(values[self.index], self.ends[some], axis=0, dtype=np.float64)
        return total

    def counts(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and the topic probabilities of the sentences they are in, put together."""
        used, at = np.unique(self.index, return_inverse=True)
        row = np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))
        return used, np.stack([np.bincount(at, weights=p[row, k], minlength=len(used)) for k in range(p.shape[1])], axis=1)


class Topics:
    """Word weights of each topic; the last topic is none."""

    def __init__(self, counts: np.ndarray, first: bool):
        self.k = counts.shape[1]
        totals = counts.sum(axis=1)
        seen = totals > 0
        prior = (counts.sum(axis=0) + 1.0) / (counts.sum() + self.k)
        self.weights, self.speaks = np.zeros(counts.shape, dtype=np.float32), np.full(len(totals), -1, dtype=np.int8 if self.k < 127 else np.int32)
        used = np.flatnonzero(seen)
        into = counts[used]
        doubt = np.clip(SMOOTH / (SMOOTH + totals[used]), LEAST_DOUBT, 1.0)[:, None]  # few counts say little about the topics not met
        weights = np.log((1 - doubt) * into / totals[used][:, None] + doubt * prior[None, :]) - np.log(prior)
        subject = into[:, :-1].sum(axis=1)
        of_subjects = prior[:-1].sum()
        plain = np.log((1 - doubt[:, 0]) * subject / totals[used] + doubt[:, 0] * of_subjects) - np.log(of_subjects)
        share = into[:, :-1] / np.maximum(into[:, :-1].sum(axis=0), 1.0)
        share = share / np.maximum(share.sum(axis=1, keepdims=True), 1e-12)
        ranked = np.sort(share, axis=1)
        high, second = ranked[:, -1], ranked[:, -2] if self.k > 2 else np.zeros(len(ranked))
        topical = (subject >= (2 if first else 3)) & ((high >= 0.6) if first else (high >= 0.6) | ((high >= 0.35) & (high >= 2.5 * second)))
        weights[~topical, :-1] = plain[~topical, None]
        self.weights[used] = weights
        self.speaks[used[topical]] = share[topical].argmax(axis=1)

    def spoken(self, text: Reading) -> np.ndarray:
        """How many words of each sentence speak for each subject."""
        row = np.repeat(np.arange(len(text.ends) - 1), np.diff(text.ends))
        said = self.speaks[text.index].astype(np.int64)
        some = said >= 0
        return np.bincount(row[some] * (self.k - 1) + said[some], minlength=(len(text.ends) - 1) * (self.k - 1)).reshape(-1, self.k - 1)

    def posterior(self, text: Reading) -> tuple[np.ndarray, np.ndarray]:
        """Topic probabilities of each sentence, and :meth:`spoken`."""
        own, spoken = text.sums(self.weights), self.spoken(text)
        own *= (EVIDENCE / np.maximum(EVIDENCE, spoken.sum(axis=1)))[:, None]  # words of a set phrase aren't independent
        mix = np.full((len(own), self.k), 1.0 / self.k)
        p = mix
        for _ in range(4):
            p = own + np.log(mix)
            p = np.exp(p - p.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            held = np.stack([np.bincount(text.document, weights=p[:, k], minlength=text.n) for k in range(self.k)], axis=1)
            mix = np.maximum(held[text.document] - p, 0.0) + PRIOR  # the document without the sentence, so that a sentence doesn't vouch for itself
            mix /= mix.sum(axis=1, keepdims=True)
        return p, spoken

    def features(self, text: Reading) -> np.ndarray:
        """Of each document: hard shares, expected shares, log of sentences, share of lines without an end mark, share of sentences that can't be told.

        A subject needs a word that speaks for it; a line without an end mark counts if it has a subject.
        """
        p, spoken = self.posterior(text)
        m, n = self.k - 1, text.n
        doubtful = (p[:, :m].sum(axis=1) > 0.1) & (p.max(axis=1) < 0.9)
        hard = np.column_stack([p[:, :m] * (spoken > 0), p[:, m] + 1e-9]).argmax(axis=1)
        counted = text.marks | (hard < m)
        sentences_of = np.bincount(text.document, minlength=n)
        n_counted = np.maximum(1, np.bincount(text.document, weights=counted, minlength=n))
        shares = np.bincount(text.document * self.k + hard, minlength=n * self.k).reshape(n, self.k)[:, :m] / n_counted[:, None]
        expected = np.stack([np.bincount(text.document, weights=p[:, s] * counted, minlength=n) for s in range(m)], axis=1) / n_counted[:, None] if m else np.zeros((n, 0))
        per = np.maximum(1, sentences_of)
        return np.column_stack([shares, expected, np.log(n_counted), np.bincount(text.document, weights=~text.marks, minlength=n) / per, np.bincount(text.document, weights=doubtful, minlength=n) / per])


class Chain:
    """One calibrated logistic classifier per subject over features, source rates and the labels decided before it."""

    def __init__(self, order: list[int], coefficients: list[np.ndarray], scales: list[tuple[float, float]], quality: list[dict[str, float]]):
        self.order, self.coefficients, self.scales, self.quality = order, coefficients, scales, quality

    @staticmethod
    def inputs(features: np.ndarray, rates: np.ndarray, s: int, before: np.ndarray) -> np.ndarray:
        m = rates.shape[1]
        share, expected = features[:, :m], features[:, m : 2 * m]
        other = np.delete(share, s, axis=1).max(axis=1) if m > 1 else np.zeros(len(share))
        rate = np.clip(rates[:, s], 1e-3, 1 - 1e-3)
        reached = (share[:, s] >= FIFTH).astype(float)
        return np.column_stack([np.ones(len(share)), share[:, s], expected[:, s], reached, np.sqrt(share[:, s]), other, features[:, 2 * m :], np.log(rate / (1 - rate)), before.sum(axis=1), before])

    @staticmethod
    def logistic(x: np.ndarray, y: np.ndarray, ridge: np.ndarray) -> np.ndarray:
        w = np.zeros(x.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
            step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
            w = w + step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
            if np.abs(step).max() < 1e-6:
                break
        return w

    @classmethod
    def fit(cls, features: np.ndarray, rates: np.ndarray, labels: np.ndarray) -> Chain:
        """Subjects from frequent to rare; every HELD_OUT-th row is held out to calibrate and measure."""
        order = list(np.argsort(-labels.sum(axis=0), kind="stable"))
        held = np.arange(len(labels)) % HELD_OUT == HELD_OUT - 1
        coefficients, scales, quality = [], [], []
        for place, s in enumerate(order):
            x, y = cls.inputs(features, rates, s, labels[:, order[:place]].astype(float)), labels[:, s].astype(float)
            ridge = np.full(x.shape[1], 0.3)
            ridge[:5] = 0.003
            w = cls.logistic(x[~held], y[~held], ridge)
            z = np.clip(x[held] @ w, -30, 30)
            scale = cls.logistic(np.column_stack([z, np.ones(len(z))]), y[held], np.array([0.3, 0.3])) if len(z) and 0 < y[held].sum() < len(z) else np.array([1.0, 0.0])
            scale = (max(float(scale[0]), 0.05), float(scale[1]))
            p = 1 / (1 + np.exp(-np.clip(z * scale[0] + scale[1], -30, 30)))
            bins = np.minimum((p * 10).astype(int), 9)
            gap = sum(abs(p[bins == b].sum() - y[held][bins == b].sum()) for b in range(10)) / max(1, len(p))
            said, right = float((p >= 0.5).sum()), float(((p >= 0.5) & (y[held] > 0)).sum())
            quality.append({"n": float(len(p)), "positive": float(y[held].sum()), "said": said, "right": right, "brier": float(((p - y[held]) ** 2).mean()) if len(p) else 0.0, "ece": float(gap)})
            coefficients.append(w)
            scales.append(scale)
        return cls(order, coefficients, scales, quality)

    def decode(self, features: np.ndarray, rates: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """The likeliest labels of each row, by beam search along the chain."""
        n, m = len(features), len(self.order)
        paths, score = np.zeros((n, 1, m)), np.zeros((n, 1))
        for place, s in enumerate(self.order):
            width = paths.shape[1]
            before = paths[:, :, :place].reshape(n * width, place)
            a, b = self.scales[place]
            z = self.inputs(np.repeat(features, width, axis=0), np.repeat(rates, width, axis=0), s, before) @ self.coefficients[place]
            z = np.clip(np.clip(z, -30, 30) * a + b, -30, 30).reshape(n, width)
            yes, no = paths.copy(), paths
            yes[:, :, place] = 1.0
            both = np.concatenate([no, yes], axis=1)
            total = np.concatenate([score - np.log1p(np.exp(z)), score - np.log1p(np.exp(-z))], axis=1)
            keep = np.argsort(-total, axis=1, kind="stable")[:, :beam]
            paths, score = np.take_along_axis(both, keep[:, :, None], axis=1), np.take_along_axis(total, keep, axis=1)
        out = np.zeros((n, m), dtype=bool)
        out[:, self.order] = paths[:, 0, :] > 0.5
        return out


def compose(topic: np.ndarray, k: int, seed: int = 7) -> tuple[list[np.ndarray], np.ndarray]:
    """Documents put together from the examples' sentences (their numbers), main subjects, passing mentions and filler, and their labels."""
    rng = np.random.default_rng(seed)
    pools = [np.flatnonzero(topic == s) for s in range(k)]
    usable = np.array([s for s in range(k - 1) if len(pools[s])], dtype=np.int64)
    documents, labels = [], []
    for _ in range(COMPOSED if len(usable) else 0):
        n = int(rng.integers(3, 40))
        mains = rng.choice(usable, size=min(len(usable), int(rng.choice([0, 1, 2, 3], p=[0.15, 0.4, 0.25, 0.2]))), replace=False)
        plan, at, used = np.full(n, k - 1), rng.permutation(n), 0
        for s in mains:
            take = max(int(np.ceil(n * FIFTH)), int(n * rng.uniform(FIFTH, 0.9 / len(mains))))
            plan[at[used : used + take]] = s
            used += take
        for s in rng.choice(usable, size=min(len(usable), int(rng.integers(0, 4))), replace=False):
            if used < n and s not in mains and 1 / n < FIFTH:
                take = int(rng.integers(1, max(2, int(n * 0.12) + 1)))
                plan[at[used : used + take]] = s
                used += take
        drawn = np.where(rng.random(n) < MISSED, k - 1, plan)  # a subject's sentence in words no example has looks like filler
        documents.append(np.array([rng.choice(pools[t]) if len(pools[t]) else -1 for t in drawn]))
        labels.append(np.bincount(plan, minlength=k)[: k - 1] / n >= FIFTH)
    return documents, np.array(labels)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_key, _n, _source and the text as buckets of words, words of each sentence and end marks; texts without words are left out."""
    for batch in batches:
        texts = [sentences(t) for t in batch.column("_text").to_pylist()]
        kept = pa.array([i for i, t in enumerate(texts) if t], type=pa.int64())
        texts = [t for t in texts if t]
        each = np.cumsum([0] + [len(t) for t in texts])
        lengths = [len(words) for t in texts for words, _ in t]
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        words = pa.array(np.fromiter((_BUCKETS[w] for t in texts for ws, _ in t for w in ws), dtype=np.int32))
        listed = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), values)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(kept) for c in ("_key", "_n", "_source")), listed(ends[each], words), listed(each, pa.array(lengths, type=pa.int32())), listed(each, pa.array([m for t in texts for _, m in t], type=pa.bool_()))],
            names=["_key", "_n", "_source", "words", "lengths", "marks"],
        )


def _floats(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows, dtype=np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], type=pa.int32()), pa.array(rows.ravel()))


def _matrix(rows: list[list[float]], width: int) -> np.ndarray:
    return np.array(rows, dtype=float).reshape(len(rows), width)


def term_model(bodies: DataFrame, labelled: list[tuple[str, int]], k: int) -> tuple[Topics, Reading, np.ndarray]:
    """The topics after ROUNDS over all texts, the examples' sentences, and the topic of each (k - 1: none)."""
    spark = bodies.sparkSession
    split = [(words, mark, y) for t, y in labelled for words, mark in sentences(t)]
    own = np.array([y for _, _, y in split], dtype=np.int64)
    text = Reading.of([w for w, _, _ in split], [m for _, m, _ in split], [1] * len(split))

    def of_examples(p: np.ndarray) -> np.ndarray:
        counts = np.zeros((BUCKETS, k))
        used, held = text.counts(p)
        counts[used] = held
        return counts

    at = np.arange(len(own))
    sure = np.zeros((len(own), k))
    sure[at, own] = 1.0
    raw = of_examples(sure)
    special = (raw.max(axis=1) >= 0.75 * np.maximum(raw.sum(axis=1), 1)) & (raw.max(axis=1) >= 2)
    row = np.repeat(at, np.diff(text.ends))
    hits = np.bincount(row, weights=(special[text.index] & (raw[text.index].argmax(axis=1) == own[row])).astype(float), minlength=len(own)) > 0
    p_examples = np.zeros((len(own), k))
    p_examples[at, np.where(hits, own, k - 1)] = 1.0

    names = [f"c{j}" for j in range(k)]
    corpus = np.zeros((BUCKETS, k))
    for attempt in range(ROUNDS + 1):
        topics = Topics(EXAMPLE_WEIGHT * of_examples(p_examples) + corpus, attempt == 0)
        scores = text.sums(topics.weights)
        pair = np.stack([scores[at, own], scores[:, -1]], axis=1)
        pair = np.exp(pair - pair.max(axis=1, keepdims=True))
        p_examples = np.zeros((len(own), k))
        p_examples[at, own] = pair[:, 0] / pair.sum(axis=1)
        p_examples[:, -1] = pair[:, 1] / pair.sum(axis=1)
        if attempt == ROUNDS:
            break
        sent = spark.sparkContext.broadcast(topics)

        def expected(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            model = sent.value
            held = np.zeros((BUCKETS, model.k))
            for batch in batches:
                for _, _, part in Reading.batches(batch):
                    used, counts = part.counts(model.posterior(part)[0])
                    held[used] += counts
            used = np.flatnonzero(held.sum(axis=1) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(held[used, j]) for j in range(model.k))], names=["bucket", *names])

        sums = bodies.select("words", "lengths", "marks").mapInArrow(expected, "bucket long, " + ", ".join(f"{c} double" for c in names)).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
        corpus = np.zeros((BUCKETS, k))
        corpus[sums["bucket"].to_numpy()] = np.stack([sums[c].to_numpy() for c in names], axis=1)
        sent.unpersist()
    return topics, text, np.where(p_examples[:, -1] > 0.5, k - 1, own)


def composed(topics: Topics, text: Reading, topic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of documents composed of the examples' sentences."""
    documents, labels = compose(topic, topics.k)
    drawn = [i for d in documents for i in d]
    pieces = [text.index[text.ends[i] : text.ends[i + 1]] if i >= 0 else text.index[:0] for i in drawn]
    sizes = [len(d) for d in documents]
    whole = Reading(np.concatenate(pieces) if pieces else text.index[:0], np.cumsum([0] + [len(p) for p in pieces]), np.repeat(np.arange(len(sizes)), sizes), np.array([i < 0 or text.marks[i] for i in drawn], dtype=bool), len(sizes))
    return topics.features(whole), labels.reshape(len(documents), topics.k - 1)


def _classified(documents: DataFrame, examples: DataFrame, areas: DataFrame, id_column: str, text: str, source: str | None) -> tuple[DataFrame, DataFrame, list[str], Chain]:
    """(_id, _key of the documents with text), (_key, _n, subjects of the texts), the subjects' names and the chain."""
    spark = documents.sparkSession
    names = sorted({str(r["subject"]) for r in small(areas.select("subject").where("subject is not null"), 10_000)})
    known = {n.strip().casefold(): i for i, n in enumerate(names)}
    labelled = [(r["text"], known[r["subject"].strip().casefold()]) for r in small(examples.select("text", "subject").where("text is not null and subject is not null"), MOST_EXAMPLES) if r["subject"].strip().casefold() in known]
    m, k = len(names), len(names) + 1
    from_source = F.col(source).cast("string") if source else F.lit(None).cast("string")
    keyed = documents.where(F.col(text).isNotNull() & (F.trim(text) != "")).select(F.col(id_column).alias("_id"), F.col(text).alias("_text"), from_source.alias("_source"), F.md5(text).alias("_key"))
    distinct = keyed.groupBy("_key").agg(F.first("_text").alias("_text"), F.min("_source").alias("_source"), F.count("*").alias("_n"))
    bodies = stored(distinct.mapInArrow(_read, "_key string, _n long, _source string, words array<int>, lengths array<int>, marks array<boolean>"), "sentences")
    topics, example_text, topic = term_model(bodies, labelled, k)
    sent = spark.sparkContext.broadcast(topics)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part in Reading.batches(batch):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("_key", "_n", "_source")), _floats(sent.value.features(part))], names=["_key", "_n", "_source", "features"])

    def read_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part in Reading.batches(batch):
                rng = np.random.default_rng(zlib.crc32("".join(batch.column("_key").slice(lo, hi - lo).to_pylist()).encode()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("_key", "_source")), _floats(sent.value.features(part)), _floats(sent.value.features(part.thinned(rng)))], names=["_key", "_source", "features", "thinned"])

    features = stored(bodies.mapInArrow(described, "_key string, _n long, _source string, features array<double>"), "text-features")
    reached = [F.sum((F.col("features")[s] >= FIFTH).cast("double")) for s in range(m)]
    total = features.agg(F.count("*").alias("n"), F.array(*reached).alias("with")).first()
    overall = np.array([(w or 0.0) for w in (total["with"] or [])]) / max(1, total["n"])
    rates = features.where("_source is not null").groupBy("_source").agg(F.count("*").alias("_n"), F.array(*reached).alias("with")) if m else features.limit(0).select("_source", "_n", F.array().cast("array<double>").alias("with"))
    prior = F.array(*[F.lit(float(x) * SOURCE_PRIOR) for x in overall]).cast("array<double>")
    rates = stored(rates.select("_source", "_n", F.transform(F.arrays_zip(F.col("with").alias("w"), prior.alias("p")), lambda x: (x["w"] + x["p"]) / (F.col("_n") + SOURCE_PRIOR)).alias("rates")), "source-rates")
    default = F.array(*[F.lit(float(x)) for x in overall]).cast("array<double>")

    every = max(1, total["n"] // SAMPLE)  # about SAMPLE texts by their hash
    drawn = bodies.where(F.pmod(F.xxhash64(F.lit("sample"), "_key"), F.lit(every)) == 0)
    drawn = small(drawn.mapInArrow(read_twice, "_key string, _source string, features array<double>, thinned array<double>").join(rates.select("_source", "rates"), "_source", "left").select("_key", "features", "thinned", F.coalesce("rates", default).alias("rates")).orderBy("_key"), 4 * SAMPLE + 1000)
    full, thin, own_rates = (_matrix([r[c] for r in drawn], w) for c, w in (("features", 2 * m + 3), ("thinned", 2 * m + 3), ("rates", m)))
    made, made_labels = composed(topics, example_text, topic)
    chain = Chain.fit(np.vstack([thin, made]), np.vstack([own_rates, np.tile(overall.reshape(1, m), (len(made), 1))]), np.vstack([full[:, :m] >= FIFTH, made_labels]).astype(bool))
    final = spark.sparkContext.broadcast((chain, names))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, labels = final.value
        for batch in batches:
            if batch.num_rows:
                found = decoder.decode(_matrix(batch.column("features").to_pylist(), 2 * m + 3), _matrix(batch.column("rates").to_pylist(), m))
                yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_n"), pa.array([[labels[s] for s in np.flatnonzero(x)] for x in found], type=pa.list_(pa.string()))], names=["_key", "_n", "subjects"])

    sourced = attach(features.where("_source is not null"), rates, ["_source"]).select("_key", "_n", "features", "rates")
    sourced = sourced.unionByName(features.where("_source is null").select("_key", "_n", "features", default.alias("rates")))
    decided = stored(sourced.mapInArrow(label, "_key string, _n long, subjects array<string>").where(F.size("subjects") > 0), "text-subjects")
    return keyed.select("_id", "_key"), decided, names, chain


def subject_areas(documents: DataFrame, examples: DataFrame, areas: DataFrame, *, id_column: str = "doc_id", text: str = "text", source: str | None = None) -> DataFrame:
    """``id_column``, subject: one row for each document and subject area it is about."""
    keyed, decided, _, _ = _classified(documents, examples, areas, id_column, text, source)
    return attach(keyed, decided, ["_key"]).select(F.col("_id").alias(id_column), F.explode("subjects").alias("subject"))


def subject_report(documents: DataFrame, examples: DataFrame, areas: DataFrame, *, id_column: str = "doc_id", text: str = "text", source: str | None = None) -> DataFrame:
    """Per subject area: documents and their share, and on the chain's held-out rows precision, recall, Brier score and calibration error."""
    keyed, decided, names, chain = _classified(documents, examples, areas, id_column, text, source)
    total = documents.count()
    held = [(names[s], int(q["n"]), q["right"] / q["said"] if q["said"] else None, q["right"] / q["positive"] if q["positive"] else None, q["brier"], q["ece"]) for s, q in zip(chain.order, chain.quality)]
    quality = documents.sparkSession.createDataFrame(held, "subject string, n_held_out long, precision double, recall double, brier double, calibration_error double")
    counts = decided.select("_n", F.explode("subjects").alias("subject")).groupBy("subject").agg(F.sum("_n").alias("n_documents"))
    return quality.join(counts, "subject", "left").select("subject", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), (F.coalesce("n_documents", F.lit(0)) / F.lit(max(1, total))).alias("share"), "n_held_out", "precision", "recall", "brier", "calibration_error")
