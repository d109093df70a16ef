"""Language identification by unigram pieces, marginalised over all segmentations.

The pieces are those of a fixed public vocabulary. Each language has a probability for every piece, fitted by
expectation maximisation: forward and backward sums over all segmentations of a word give the expected uses of each
piece. A text's likelihood under a language is the product over its words of the forward sum over all
segmentations; the prediction is the most likely language, its score the posterior under equal priors.

Words are runs of letters (Unicode category L) in lower case, up to ``WORD`` letters long (a longer run counts as several
words). Learning uses at most ``SAMPLE`` rows per language, of at most ``SAMPLE_CHARS`` characters each, those with the
smallest hash of their id among the documents whose CRC-32 of the id is not divisible by five, and the ``LANGUAGES``
languages with the most such rows (ties by name). These bounds are parameters, and hold whatever repeats.

Edge cases: a null text, or one without letters, is ``und`` with score 0, as is every text if nothing could be learned;
digits, numerals such as ``½`` or ``Ⅷ`` and emoji are no letters; letters outside the vocabulary have a small fixed probability; equally likely languages go by name; a row without an
id is held out; repeated rows give equal rows; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchloom.llm.common import written

SAMPLE, SAMPLE_CHARS, LANGUAGES = 300, 20_000, 200
WORD, PIECE = 32, 10
FLOOR, SMOOTH, ROUNDS = 1e-8, 0.05, 3
REMEMBER, WORDS = 250_000, 100_000
ROWS = 1_000
UNKNOWN = "und"
_BASE = 0x9E3779B97F4A7C15
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
words_of = regex.compile(rf"\p{{L}}{{1,{WORD}}}").findall


class Pieces:
    """Pieces by number, found by a 64-bit polynomial hash of their characters."""

    def __init__(self, names: list[str]):
        self.names = names
        hashes = np.array([self._hash(n) for n in names], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have one hash")

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * _BASE + ord(c) + 1) % 2**64
        return h

    def __len__(self) -> int:
        return len(self.names)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are pieces, and the pieces' numbers."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.names) - 1)
        where = np.flatnonzero(self.hashes[at] == hashes)
        return where, self.order[at[where]]


def vocabulary(path: str) -> Pieces:
    """Pieces of letters, in lower case, and of a word's start, of a sentencepiece vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    lower = dict.fromkeys(p.lower() for p in pieces)
    return Pieces([p for p in lower if len(p) <= PIECE and p != "▁" and p.removeprefix("▁").isalpha()])


class Lattice:
    """The pieces at every place of a list of words, for sums over all segmentations."""

    def __init__(self, words: list[str], pieces: Pieces):
        self.n = len(words)
        marked = np.array(["▁" + w for w in words], dtype=np.str_)
        lens = np.char.str_len(marked).astype(np.int64)
        # The longest words first, so that those that reach a place are always the first ones.
        self.order = np.argsort(-lens, kind="stable")
        self.lens = lens[self.order]
        self.width = int(lens.max(initial=0))
        letters = marked[self.order].view(np.uint32).reshape(self.n, -1) if self.n else np.zeros((0, 0), np.uint32)
        sums = np.zeros((self.width + 1, self.n), np.uint64)
        for i in range(self.width):
            sums[i + 1] = sums[i] * np.uint64(_BASE) + letters[:, i] + np.uint64(1)
        self.edges = []
        for end in range(1, self.width + 1):
            reach = int(np.searchsorted(-self.lens, -end, side="right"))
            for start in range(max(0, end - PIECE), end):
                which, ids = pieces.find(sums[end, :reach] - sums[start, :reach] * np.uint64(pow(_BASE, end - start, 2**64)))
                if which.size:
                    self.edges.append((start, end, which, ids))

    def _restored(self, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[self.order] = values
        return out

    def forward(self, probability: np.ndarray) -> np.ndarray:
        """Sums over all segmentations of every prefix: (word, place, language)."""
        alpha = np.zeros((self.n, self.width + 1, probability.shape[1]))
        alpha[:, 0] = 1.0
        at = 0
        for end in range(1, self.width + 1):
            alpha[:, end] += alpha[:, end - 1] * FLOOR
            while at < len(self.edges) and self.edges[at][1] == end:
                start, _, which, ids = self.edges[at]
                alpha[which, end] += alpha[which, start] * probability[ids]
                at += 1
        return alpha

    def totals(self, probability: np.ndarray) -> np.ndarray:
        """The likelihood of every word: (word, language)."""
        return self._restored(self.forward(probability)[np.arange(self.n), self.lens])

    def expected(self, probability: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of every piece, each word counting ``weight`` times (one language)."""
        alpha = self.forward(probability[:, None])[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[np.arange(self.n), self.lens] = 1.0
        at = len(self.edges) - 1
        for end in range(self.width, 0, -1):
            beta[:, end - 1] += beta[:, end] * FLOOR
            while at >= 0 and self.edges[at][1] == end:
                start, _, which, ids = self.edges[at]
                beta[which, start] += beta[which, end] * probability[ids]
                at -= 1
        scale = weight[self.order] / alpha[np.arange(self.n), self.lens]
        out = np.zeros(probability.size)
        for start, end, which, ids in self.edges:
            out += np.bincount(ids, alpha[which, start] * probability[ids] * beta[which, end] * scale[which], probability.size)
        return out


def fit(counts: dict[str, Counter], pieces: Pieces) -> tuple[list[str], np.ndarray]:
    """Languages by name and the probability of every piece under each: (piece, language)."""
    names = sorted(counts)
    columns = []
    for name in names:
        words = list(counts[name])
        weight = np.array([counts[name][w] for w in words], float)
        lattice = Lattice(words, pieces)
        p = np.full(len(pieces), 1.0 / len(pieces))
        for _ in range(ROUNDS):
            p = lattice.expected(p, weight) + SMOOTH
            p /= p.sum()
        columns.append(p)
    return names, np.stack(columns, axis=1) if names else np.zeros((len(pieces), 0))


class _Numbers(dict):
    """Numbers of words, the next one for a word not seen before."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Scorer:
    """Scores texts, remembering the log-likelihoods of recent words."""

    def __init__(self, names: list[str], probability: np.ndarray, pieces: Pieces):
        self.names, self.probability, self.pieces = names, probability, pieces
        self.known = _Numbers()
        self.logs = np.zeros((0, len(names)))

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.known) >= REMEMBER:
            self.known, self.logs = _Numbers(), self.logs[:0]
        split = [words_of(t.lower()) if t else [] for t in texts]
        if not self.names:
            return [(UNKNOWN, 0.0)] * len(texts)
        numbers = [np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)) for words in split]
        if fresh := list(itertools.islice(self.known, len(self.logs), None)):
            logs = [np.log(Lattice(fresh[a : a + 20_000], self.pieces).totals(self.probability)) for a in range(0, len(fresh), 20_000)]
            self.logs = np.concatenate([self.logs, *logs])
        return [self._best(n) if n.size else (UNKNOWN, 0.0) for n in numbers]

    def _best(self, numbers: np.ndarray) -> tuple[str, float]:
        # A long text is summed some words at a time.
        total = sum(self.logs[numbers[a : a + WORDS]].sum(axis=0) for a in range(0, numbers.size, WORDS))
        best = int(total.argmax())
        return self.names[best], float(1.0 / np.exp(total - total[best]).sum())


_scorers: dict[str, Scorer] = {}


def held_out(id_col: Column) -> Column:
    """Whether the CRC-32 of the id's text is divisible by five; true without an id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample_words(spark: SparkSession, docs: DataFrame) -> dict[str, Counter]:
    """Words of the learning sample, by language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") <= SAMPLE_CHARS))
    known = known.select("doc_id", "lang", "text", F.xxhash64("text").alias("th"))
    # Ids may repeat, with one text or several; equal rows are one row of the sample.
    distinct = written(spark, known.select("doc_id", "lang", "th").distinct(), "language-rows")
    most = distinct.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "th"))
    chosen = distinct.join(F.broadcast(most), "lang", "left_semi").withColumn("rank", rank).where(F.col("rank") <= SAMPLE).drop("rank")
    rows = known.join(F.broadcast(chosen), ["doc_id", "lang", "th"], "left_semi").dropDuplicates(["doc_id", "lang", "th"]).select("lang", "text")
    out: dict[str, Counter] = {}
    for row in rows.toLocalIterator():
        out.setdefault(row["lang"], Counter()).update(words_of(row["text"].lower()))
    return {k: c for k, c in out.items() if c}


def _predictor(spark: SparkSession, docs: DataFrame, vocabulary_path: str) -> Callable[[], Scorer]:
    """Learn from ``docs``; what it returns gives each worker process its scorer."""
    pieces = vocabulary(vocabulary_path)
    model, key = spark.sparkContext.broadcast((*fit(sample_words(spark, docs), pieces), pieces)), uuid.uuid4().hex

    def scorer() -> Scorer:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(*model.value)
        return _scorers[key]

    return scorer


def identify(spark: SparkSession, docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred and score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    scorer = _predictor(spark, docs, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                names, scores = zip(*scorer().score(part.column(2).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def keep_identified(spark: SparkSession, docs: DataFrame, vocabulary_path: str, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language can be told: not ``und``, and with a score of at least ``least``."""
    scorer = _predictor(spark, docs, vocabulary_path)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                good = [name != UNKNOWN and score >= least for name, score in scorer().score(part.column(place).to_pylist())]
                yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
