"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learned from document labels.

A document is a bag of sentences.  A sentence's probability is a logistic function of its words; the
document is toxic unless every sentence fails to make it so: P = 1 - (1 - leak) * prod(1 - p).  Only
documents carry labels, so the gradient of the bag's likelihood decides which sentences it blames.  The
same sentence scores point to the offending sentences afterwards.

The vocabulary is counted by Spark over the labelled sample; only its most telling words, and for each
training document the sentences that hold them, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.llm.common import saved, text_batches, training_rows
from tarnlake.llm.words import lower_table, text_bytes, word_table, words_in

TRAIN_ROWS = 12_000  # bound of the labelled rows that a fit reads
VOCABULARY = 1_000
STEM = 5  # bytes
SCORE, COUNT, SPANS = "__tox_score", "__tox_sentences", "__tox_spans"
SPAN_TYPE = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())
]))


@dataclass
class BagModel:
    words: list[int]  # sorted hashes
    weights: list[float]
    bias: float  # of a sentence
    leak: float  # chance of a document without any sentence


def sentences_of(data, in_word, lower):
    """(word hashes, sentence of each word, sentence starts, sentence ends) of a text's bytes.

    Sentences end at . ! ? and line ends; stretches without a word are none.  A word stands for itself and
    for its stem, its first bytes, which words with one root and many endings share.
    """
    import numpy as np


    s, e, h, stems = words_in(data, in_word, lower, STEM)
    if not len(s):
        return h, s, s, s
    stops = np.flatnonzero((data == 46) | (data == 33) | (data == 63) | (data == 10))
    raw = np.searchsorted(stops, s)
    first = np.concatenate([[True], raw[1:] != raw[:-1]])
    number = np.cumsum(first) - 1
    begin = s[first]
    last = np.concatenate([np.flatnonzero(first)[1:] - 1, [len(s) - 1]])
    return np.concatenate([h, stems]), np.concatenate([number, number]), begin, e[last]


def _count_words():
    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        in_word, lower = word_table(), lower_table()
        for batch in batches:
            hashes, labels = [], []
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                h = np.unique(np.concatenate(words_in(text_bytes(text), in_word, lower, STEM)[2:]))
                hashes.append(h.view(np.int64))
                labels.append(np.full(len(h), label, np.int32))
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(labels))], ["word", "label"])

    return count


def vocabulary(sample: DataFrame, size: int, min_docs: int) -> list[int]:
    """The words that tell the labels apart best, by chi-square over document counts."""
    totals = sample.agg(F.count("*").alias("n"), F.sum("_label").alias("p")).first()
    n, p = int(totals["n"] or 0), int(totals["p"] or 0)
    if p == 0 or p == n:
        return []
    counts = sample.select("text", F.col("_label").cast("int").alias("label")).mapInArrow(_count_words(), "word long, label int")
    c = counts.groupBy("word").agg(F.count("*").alias("d"), F.sum("label").alias("t")).filter(F.col("d") >= min_docs)
    d, t = F.col("d").cast("double"), F.col("t").cast("double")
    chi = (t * n - d * p) * (t * n - d * p) / (d * (n - d + 1e-9) * p * (n - p)) * n
    return sorted(r["word"] for r in c.withColumn("chi", chi).orderBy(F.col("chi").desc(), "word").limit(size).select("word").collect())


def _bags(words: list[int]):
    def bags(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        in_word, lower, vocab = word_table(), lower_table(), np.array(words, np.int64)
        for batch in batches:
            out = []
            for text in batch.column(1):
                h, number, begin, _ = sentences_of(text_bytes(text), in_word, lower)
                at = np.minimum(np.searchsorted(vocab, h.view(np.int64)), len(vocab) - 1)
                hit = vocab[at] == h.view(np.int64)
                out.append((len(begin), number[hit].astype(np.int32).tolist(), at[hit].astype(np.int32).tolist()))
            n, s, f = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.int32())), pa.array(f, pa.list_(pa.int32()))],
                ["doc_id", "label", "n_sentences", "sentence", "word"],
            )

    return bags


def fit_bags(rows: list, n_words: int, rounds: int = 400, l2: float = 0.05) -> tuple[list[float], float, float]:
    """Weights, sentence bias and leak by gradient ascent on the likelihood of the bags' labels."""
    import numpy as np

    y = np.array([float(r["label"] > 0) for r in rows])
    sentence, word, bag, plain, offset = [], [], [], np.zeros(len(rows)), 0
    for i, r in enumerate(rows):
        s = np.array(r["sentence"], np.int64)
        used, code = np.unique(s, return_inverse=True)
        sentence.append(code + offset)
        word.append(np.array(r["word"], np.int64))
        bag.append(np.full(len(used), i))
        plain[i] = r["n_sentences"] - len(used)  # sentences without a word of the vocabulary
        offset += len(used)
    sentence, word, bag = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sentence, word, bag))
    word_n = np.maximum(np.bincount(word, minlength=n_words), 1)
    doc_of = bag[sentence] if len(sentence) else sentence
    # begin at damped log odds of the words
    pos = np.bincount(word, y[doc_of], n_words) if len(word) else np.zeros(n_words)
    prior = (y.sum() + 1) / (len(y) + 2)
    w = np.clip(np.log((pos + prior) / (word_n - pos + 1 - prior)) - np.log(prior / (1 - prior)), -2, 4) * 0.5
    theta = np.concatenate([w, [-5.0, np.log(prior / (1 - prior)) - 2]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sig = lambda a: 1 / (1 + np.exp(-np.clip(a, -30, 30)))
    soft = lambda a: np.logaddexp(0, a)
    for k in range(1, rounds + 1):
        w, b, c = theta[:-2], theta[-2], theta[-1]
        z = b + np.bincount(sentence, w[word], offset)
        q = np.bincount(bag, soft(z), len(y)) + plain * soft(b) + soft(c)  # -log(1 - P)
        dq = (1 - y) - y / np.expm1(np.clip(q, 1e-9, 50))
        dz = dq[bag] * sig(z)
        gw = np.bincount(word, dz[sentence], n_words) if len(word) else np.zeros(n_words)
        g = np.concatenate([gw + l2 * w, [dz.sum() + (dq * plain).sum() * sig(b), (dq * sig(c)).sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return theta[:-2].tolist(), float(theta[-2]), float(sig(theta[-1]))


def learn_from(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, size: int = VOCABULARY) -> BagModel:
    """Fit on a bounded sample of labelled rows.  Without toxic or without clean rows, the model is the smoothed share."""
    text_batches(docs.sparkSession)
    sample = saved(training_rows(docs.select("doc_id", "text"), labels, "toxic", max_rows), "toxicity_sample")
    words = vocabulary(sample, size, min_docs=5)
    if not words:
        t = sample.agg(F.count("*").alias("n"), F.sum("_label").alias("p")).first()
        return BagModel([], [], -30.0, ((t["p"] or 0) + 0.5) / (t["n"] + 1))
    rows = sample.select("doc_id", "text", F.col("_label").cast("int").alias("label")).mapInArrow(
        _bags(words), "doc_id long, label int, n_sentences long, sentence array<int>, word array<int>"
    ).collect()
    weights, bias, leak = fit_bags(sorted(rows, key=lambda r: r["doc_id"]), len(words))
    return BagModel(words, weights, bias, leak)


def score_toxicity(docs: DataFrame, model: BagModel, text: str = "text", spans: bool = True, threshold: float = 0.5) -> DataFrame:
    """Add ``__tox_score`` (0 to 1), the number of sentences, and the offending sentences with code point bounds.

    Null and empty texts have no sentence and get the model's leak.  Rows are scored one by one, so
    repeated rows get equal scores; other columns pass through unchanged; an empty table stays empty.
    """
    text_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(SCORE, T.DoubleType()), T.StructField(COUNT, T.LongType()), T.StructField(SPANS, SPAN_TYPE)])
    return docs.mapInArrow(_scorer(model, docs.columns.index(text), docs.columns, spans, threshold), schema)


def _scorer(model: BagModel, at: int, names: list[str], spans: bool, threshold: float):
    words, weights, bias, leak = model.words, model.weights, model.bias, model.leak

    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        in_word, lower = word_table(), lower_table()
        vocab, weight = np.array([*words, 2**63 - 1], np.int64), np.array([*weights, 0.0])
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            scores, counts, found = [], [], []
            for value in batch.column(at):
                data = text_bytes(value)
                h, number, begin, end = sentences_of(data, in_word, lower)
                h = h.view(np.int64)
                k = np.searchsorted(vocab, h)
                z = bias + np.bincount(number, np.where(vocab[k] == h, weight[k], 0.0), len(begin)) if len(h) else np.zeros(0)
                scores.append(float(-np.expm1(np.log1p(-leak) - np.logaddexp(0, z).sum())))
                counts.append(len(begin))
                bad = np.flatnonzero(z >= np.log(threshold / (1 - threshold))) if spans else ()
                if len(bad):
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    found.append([
                        {"start": int(points[begin[i]]), "end": int(points[end[i]]), "score": float(1 / (1 + np.exp(-z[i])))} for i in bad
                    ])
                else:
                    found.append([])
            extra = [pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(found, span_type)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, SCORE, COUNT, SPANS])

    return score
