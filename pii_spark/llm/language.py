"""Language of each word, and of each document, by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pii_spark.llm.common import mixed

#: Language of a text that is null or has no letters.
UNDETERMINED = "und"

#: Feature hashes, words of a lexicon per language, words that are labelled at once.
BUCKETS, LEXICON, WORDS_AT_ONCE = 1 << 16, 2000, 200_000

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(line: str) -> list[str]:
    """Runs of letters, in lower case."""
    return _LETTERS.findall(line.lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of words: the word each belongs to, and its bucket.

    Words are framed. Features are the n-grams of 2 and 3 characters of the framed word, which hold the
    shortest prefixes and suffixes, and the prefixes and suffixes of 3 and 4 letters.
    """
    text = "<" + "><".join(words) + ">"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.cumsum(sizes) - sizes
    owner, where = [], []
    hashes = codes.copy()
    for n in range(2, 6):
        # The n-gram from each place on; those that leave their word are masked.
        hashes = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        bucket = (mixed(hashes) % np.uint64(BUCKETS)).astype(np.int64)
        if n <= 3:
            word = np.repeat(np.arange(len(words)), sizes)[: len(bucket)]
            place = np.arange(len(bucket)) - begin[word]
            fits = place + n <= sizes[word]
            owner.append(word[fits])
            where.append(bucket[fits])
        else:
            long = np.flatnonzero(sizes >= n + 1)
            owner += [long, long]
            where += [bucket[begin[long]], bucket[begin[long] + sizes[long] - n]]
    return np.concatenate(owner), np.concatenate(where)


def summed(owner: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``values`` per owner."""
    return np.stack([np.bincount(owner, values[:, j], size) for j in range(values.shape[1])], axis=1)


def _exp(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(axis=-1, keepdims=True))


def marginals(
    emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, learning: bool = False
) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Probability of each label of each word, by forward-backward over many sequences at once.

    ``emissions`` holds the words of all sequences one after the other. When ``learning``, the sum of
    the expected transitions and a mask of the first words of sequences come with the marginals.
    """
    n, k = emissions.shape
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    lengths = lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    local, move = _exp(emissions), np.exp(transitions - transitions.max())
    forward, backward = np.empty((n, k)), np.empty((n, k))
    state = np.exp(start - start.max())[None, :]
    for t in range(steps):
        at = begins[: active[t]] + t
        state = (state if t == 0 else state[: active[t]] @ move) * local[at]
        state /= state.sum(axis=1, keepdims=True)
        forward[at] = state
    state = np.zeros((0, k))
    for t in range(steps - 1, -1, -1):
        more = np.ones((active[t], k))
        if len(state):
            at = begins[: len(state)] + t + 1
            more[: len(state)] = (local[at] * state) @ move.T
        state = more / more.sum(axis=1, keepdims=True)
        backward[begins[: active[t]] + t] = state
    both = forward * backward
    both /= both.sum(axis=1, keepdims=True)
    if not learning:
        return both, None, None
    first = np.zeros(n, bool)
    first[begins[lengths > 0]] = True
    into = np.flatnonzero(~first)
    pair = forward[into - 1][:, :, None] * move[None] * (local[into] * backward[into])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return both, pair.sum(axis=0), first


@dataclass
class Model:
    """Weights of the feature buckets, of the lexicons, of the transitions and of the first word."""

    labels: list[str]
    weights: np.ndarray
    lexicon: dict[str, int]
    lexicon_weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        owner, bucket = grams(words)
        found = summed(owner, self.weights[bucket], len(words))
        entry = np.array([self.lexicon.get(w, -1) for w in words], np.int64)
        listed = entry >= 0
        found[listed] += self.lexicon_weights[entry[listed]]
        return found


def train(lines: list[tuple[str, str]], rounds: int = 30, segment: int = 12, seed: int = 13) -> Model:
    """A model from (language, line). Code-switched sequences are made by joining segments of lines.

    All weights, transitions included, follow the gradient of the log-likelihood (expected minus seen),
    with a rate per weight that falls with its past gradients. The same lines give the same model.
    """
    labels = sorted({language for language, _ in lines})
    index = {language: i for i, language in enumerate(labels)}
    k = len(labels)
    parts = []
    for language, line in sorted(lines):
        words = words_of(line)
        parts += [(index[language], words[i : i + segment]) for i in range(0, len(words), segment)]
    parts = [parts[i] for i in np.random.default_rng(seed).permutation(len(parts))]
    token_words = [w for _, words in parts for w in words]
    if not token_words:
        return Model([], np.zeros((BUCKETS, 0)), {}, np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    truth = np.array([label for label, words in parts for _ in words], np.int64)
    # Two segments in a row make a sequence, so that switches of language are seen.
    sizes = np.array([len(words) for _, words in parts] + [0] * (len(parts) % 2), np.int64)
    lengths = sizes.reshape(-1, 2).sum(axis=1)
    seen: list[Counter] = [Counter() for _ in labels]
    for word, label in zip(token_words, truth.tolist(), strict=True):
        seen[label][word] += 1
    common = {w for counts in seen for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]}
    lexicon = {w: i for i, w in enumerate(sorted(common))}
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(token_words))}
    tokens = np.array([vocabulary[w] for w in token_words], np.int64)
    owner, bucket = grams(list(vocabulary))
    entry = np.array([lexicon.get(w, -1) for w in vocabulary], np.int64)
    listed = np.flatnonzero(entry >= 0)
    values = [np.zeros((BUCKETS, k)), np.zeros((len(lexicon), k)), np.zeros((k, k)), np.zeros(k)]
    weights, lexical, transitions, start = values
    past = [np.full(v.shape, 1e-2) for v in values]
    for _ in range(rounds):
        emission = summed(owner, weights[bucket], len(vocabulary))
        emission[listed] += lexical[entry[listed]]
        error, pairs, first = marginals(emission[tokens], lengths, transitions, start, learning=True)
        error[np.arange(len(tokens)), truth] -= 1
        by_word = summed(tokens, error, len(vocabulary))
        into = np.flatnonzero(~first)
        seen_pairs = np.bincount(truth[into - 1] * k + truth[into], minlength=k * k).reshape(k, k)
        gradients = [
            summed(bucket, by_word[owner], BUCKETS), summed(entry[listed], by_word[listed], len(lexicon)),
            pairs - seen_pairs, error[first].sum(axis=0),
        ]
        for value, gradient, history in zip(values, gradients, past, strict=True):
            step = 1e3 * (gradient / len(tokens) + 1e-7 * value)
            history += step**2
            value -= 0.5 * step / np.sqrt(history)
    return Model(labels, weights.astype(np.float32), lexicon, lexical.astype(np.float32), transitions, start)


def label_documents(model: Model, texts: list[str]) -> np.ndarray:
    """For each text the summed probabilities of the labels over its words, and the number of words."""
    k = len(model.labels)
    words: list[str] = []
    lengths, owner = [], []
    for i, text in enumerate(texts):
        for line in text.split("\n"):
            found = words_of(line)
            if found:
                words += found
                lengths.append(len(found))
                owner.append(i)
    out = np.zeros((len(texts), k + 1))
    if words and k:
        distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
        emissions = model.emissions(list(distinct))[np.array([distinct[w] for w in words], np.int64)]
        both, _, _ = marginals(emissions, np.array(lengths), model.transitions, model.start)
        where = np.repeat(owner, lengths)
        out[:, :k] = summed(where, both, len(texts))
        out[:, k] = np.bincount(where, minlength=len(texts))
    return out


def held_out(doc_id: Column) -> Column:
    """True for a third of the ids, by hash: those that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_lines(
    docs: DataFrame, usable: Column, documents: int = 300, lines: int = 8, words: int = 60
) -> list[tuple[str, str]]:
    """A bounded sample of labelled lines: per language ``documents`` documents by hash of the id, of each
    ``lines`` lines by hash, of each line its first ``words`` words. The bounds hold at every size.

    The ids are chosen without the texts; a limit per language works ahead of the shuffle.
    """
    rank = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        docs.where(usable & F.col("lang").isNotNull()).select("doc_id", "lang")
        .withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= documents).select("doc_id", "lang")
    )
    # ``documents`` rows per language.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL")
    line = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.trim(x)) > 0)
    by_hash = F.slice(F.array_sort(F.transform(line, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), 1, lines)
    short = F.transform(by_hash, lambda s: F.array_join(F.slice(F.split(s["x"], r"\s+"), 1, words), " "))
    return [(r[0], r[1]) for r in texts.select("lang", F.explode(short)).collect()]


def identify(docs: DataFrame, model: Model, min_score: float = 0.0) -> DataFrame:
    """``docs`` and ``lang_pred, score, n_words``.

    Every line of the whole text is one chain. Its words with letters get the probability of each
    language by forward-backward; a document has their mean, ``score`` is the highest and ``lang_pred``
    its language, the first in the alphabet of equals. Null texts, texts without letters and all texts
    under a model without labels are ``und`` with score 0. With ``min_score`` only rows of that score
    and not ``und`` stay. Every row is judged alone: repeated rows and null ids need no care, and an
    empty table gives an empty result. Extra columns pass through.
    """
    made = ("lang_pred", "score", "n_words")
    rest = docs.drop(*made)
    schema = T.StructType([*rest.schema, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sums, begin, size = [], 0, 0
            for end, text in enumerate(texts, 1):
                size += len(text)
                if size >= 6 * WORDS_AT_ONCE or end == len(texts):
                    sums.append(label_documents(crf, texts[begin:end]))
                    begin, size = end, 0
            totals = np.concatenate(sums) if sums else np.zeros((0, len(crf.labels) + 1))
            n = totals[:, -1]
            some = (n > 0) & bool(crf.labels)
            means = totals[:, :-1] / np.maximum(n, 1)[:, None] if crf.labels else np.zeros((len(n), 1))
            best = means.argmax(axis=1)
            names = [crf.labels[i] if ok else UNDETERMINED for i, ok in zip(best, some, strict=True)]
            score = np.where(some, np.clip(means.max(axis=1), 0, 1), 0.0)
            out = pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(n.astype(np.int64))],
                names=[*batch.schema.names, *made],
            )
            yield out.filter(pa.array((score >= min_score) & some)) if min_score > 0 else out

    return rest.mapInArrow(run, schema)
