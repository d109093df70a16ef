"""License notices in texts: MinHash bands over overlapping windows, then exact containment; DataFrame functions only.

Words are runs of ``[a-z0-9]`` in lower-cased text. A template of L words is looked for in windows of L + s - 1 words, one at
every s-th word, where s is the largest power of two up to L / 4: so each stretch of L words lies whole in a window.
Window and template are sets of five-word shingles (all words of a shorter template). Each of ``BANDS`` hash minima is a
band; a window goes to the exact test with every template of its length that shares a band. A window that has 0.75 of
a template's shingles is at least 0.5 similar to it, so no band is shared with probability 0.5^20, under one in a million. The exact test keeps
windows that contain at least 0.75 of the shingles of a text, or all of a notice or tag, where a single other word makes
another license.

One pass reads the texts and splits them once, into chunks that overlap by the longest window, so that a long text is
as much work a word as a short one. Windows are made only where they can matter: one that contains enough of a template's
shingles has at least one out of any choice of more than the others, so it has one of the words chosen for these. This
loses nothing.

Edge cases: a null text matches nothing; in a text of fewer words than a window the whole text is the window; rows that
repeat give equal counts per id, a null id is one id; extra columns are ignored; an empty table gives an empty
table; a long text is many windows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.license_texts import TEXTS, notices

SHINGLE, CONTAINMENT, BANDS = 5, 0.75, 20
CHUNK = 1_024
SEPARATOR = "[^a-z0-9]+"


@dataclass(frozen=True)
class Template:
    license: str
    words: tuple[str, ...]
    least: float

    @property
    def size(self) -> int:
        return min(SHINGLE, len(self.words))

    @property
    def shingles(self) -> list[tuple[str, ...]]:
        return list(dict.fromkeys(self.words[i : i + self.size] for i in range(len(self.words) - self.size + 1)))

    @property
    def step(self) -> int:
        """Words from one window to the next; a power of two, so that windows of a chunk are windows of the text."""
        return 1 << max(0, (len(self.words) // 4).bit_length() - 1)

    @property
    def window(self) -> int:
        return len(self.words) + self.step - 1


def template(name: str, text: str, least: float) -> Template:
    return Template(name, tuple(re.findall("[a-z0-9]+", text.lower())), least)


TEMPLATES = (*(template(n, t, CONTAINMENT) for n, t in TEXTS), *(template(n, t, 1.0) for n, t in notices()))


def anchors(templates: Sequence[Template], often: Counter, rare: bool) -> list[str]:
    """Words of which every window has one if it contains enough of a template.

    ``often`` tells how many templates have a word: ``rare`` prefers words of few, for few windows, otherwise words of many
    are preferred, for a short list.
    """
    chosen: list[str] = []
    for t in sorted(templates, key=lambda t: (t.least, -len(t.words), t.license, t.words)):
        left = [s for s in t.shingles if not any(w in s for w in chosen)]
        # Enough shingles can't all be among those left out.
        while len(left) >= _enough(t):
            here = Counter(w for s in left for w in set(s))
            w = max(here, key=lambda w: ((len(w) > 5, -often[w], here[w]) if rare else (len(w) > 5, often[w], here[w]), len(w), w))
            chosen.append(w)
            left = [s for s in left if w not in s]
    return sorted(set(chosen))


def _enough(t: Template) -> int:
    """The least number of its shingles that make up ``t.least`` of them."""
    n = len(t.shingles)
    return next(k for k in range(n + 1) if k / n >= t.least)


def _shingles(words: Column, size: Column | int) -> Column:
    last = F.size(words) - F.lit(size) + 1 if isinstance(size, int) else F.size(words) - size + 1
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda j: F.xxhash64(F.concat_ws(" ", F.slice(words, j, size)))))


def _minima(shingles: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda s: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, s))))


def _starts(words: Column, group: Sequence[Template], marks: list[str]) -> Column:
    """The first words, from 0 on, of the windows of a chunk that have one of the group's anchors."""
    step, window = group[0].step, group[0].window
    at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(marks), i)), lambda i: i.isNotNull())
    first = lambda p: F.greatest(F.lit(0), F.ceil((p - (window - 1)) / F.lit(step)).cast("int"))
    last = lambda p: F.least(F.lit(CHUNK // step - 1), F.floor(p / F.lit(step)).cast("int"))
    spans = F.transform(at, lambda p: F.when(first(p) <= last(p), F.sequence(first(p), last(p))).otherwise(F.array().cast("array<int>")))
    return F.transform(F.array_distinct(F.flatten(spans)), lambda k: k * step)


def _by_length(templates: Sequence[Template]) -> list[list[Template]]:
    lengths: dict[int, list[Template]] = {}
    for t in templates:
        if t.words:
            lengths.setdefault(len(t.words), []).append(t)
    return [group for _, group in sorted(lengths.items())]


def _template_table(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """A row per template and band: how long it is, its shingles and its minimum; a bounded list of literals."""
    listed = [F.struct(F.lit(t.license).alias("license"), F.lit(len(t.words)).alias("t_length"), F.lit(t.size).alias("t_size"), F.lit(t.least).alias("least"), F.split(F.lit(" ".join(t.words)), " ").alias("t_words")) for t in templates]
    table = spark.range(1).select(F.explode(F.array(*listed)).alias("t")).select("t.*")
    table = table.withColumn("t_shingles", _shingles(F.col("t_words"), F.col("t_size"))).withColumn("t_minima", _minima(F.col("t_shingles")))
    return table.select("license", "t_length", "least", "t_shingles", F.posexplode("t_minima").alias("t_band", "t_value"))


def scan_licenses(spark: SparkSession, docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Per document and license found: best containment, number of windows, and the first window's first word."""
    groups = _by_length(templates)
    often = Counter(w for t in templates for w in set(t.words))
    marks = [anchors(group, often, True) for group in groups]
    lower = F.lower("text")
    some = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(m)) for m in anchors(templates, often, False)])
    rows = docs.where(some).select(F.col("doc_id").cast("long").alias("doc_id"), F.filter(F.split(lower, SEPARATOR), lambda w: w != "").alias("all"))
    overlap = max(group[0].window for group in groups)
    numbers = F.sequence(F.lit(0), F.floor((F.size("all") - 1) / F.lit(CHUNK)).cast("int"))
    rows = rows.where(F.size("all") > 0).select("doc_id", F.posexplode(F.transform(numbers, lambda c: F.slice("all", c * CHUNK + 1, CHUNK + overlap))).alias("chunk", "words"))
    rows = rows.where(F.arrays_overlap("words", F.array(*[F.lit(m) for m in sorted(set().union(*marks))])))

    def windows(group: list[Template], marks: list[str]) -> Column:
        t = group[0]
        return F.transform(_starts(F.col("words"), group, marks), lambda i: F.struct(F.lit(len(t.words)).alias("length"), F.lit(t.size).alias("size"), i.alias("start"), F.slice("words", i + 1, t.window).alias("window")))

    rows = rows.select("doc_id", "chunk", F.explode(F.concat(*[windows(*of) for of in zip(groups, marks, strict=True)])).alias("w")).select("doc_id", "chunk", "w.*").where(F.size("window") >= F.col("size"))
    rows = rows.select("doc_id", (F.col("chunk") * CHUNK + F.col("start") + 1).cast("long").alias("word"), "length", _shingles(F.col("window"), F.col("size")).alias("shingles"))
    rows = rows.select("doc_id", "word", "length", "shingles", F.posexplode(_minima(F.col("shingles"))).alias("band", "value"))
    table = _template_table(spark, [t for group in groups for t in group])
    rows = rows.join(F.broadcast(table), (F.col("length") == F.col("t_length")) & (F.col("band") == F.col("t_band")) & (F.col("value") == F.col("t_value")))
    share = F.size(F.array_intersect("shingles", "t_shingles")) / F.size("t_shingles")
    found = rows.select("doc_id", "license", share.alias("containment"), "word", "least").where("containment >= least")
    found = found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.collect_set("word").alias("words"))
    return found.select("doc_id", "license", "containment", F.size("words").cast("long").alias("n_windows"), F.array_min("words").alias("first_word"))
