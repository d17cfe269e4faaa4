"""Quality rules as a short-circuit cascade.

A rule looks at one text and rejects it or not.  On a sample the cascade
times what each rule costs a document, the measurements it needs and its own
test apart, and records what it rejects.  Rules are then picked one by one:
next comes the rule that, of the sample's documents still alive, rejects most
per second, where measurements made for an earlier rule cost nothing any more.
A document that one rule rejects is seen by no later rule, and measurements
are made when first asked for.  A document is kept when no rule rejects it, so
verdicts do not depend on the order found; only the work does.

The base counts of ``measured`` are wanted of every document, so there the
base rules are free and come first; the variety of words and the entropy of
characters, which no count holds, are measured of the documents left.

Words are runs of characters outside blank and the controls U+0009..U+000D.

Defined results: null text is a text without words; it and every other text
of fewer than ten words fails; ties do not occur (documents are judged one by
one; of rules worth the same the cheaper comes first); repeated rows get
the same verdict; a long text is measured whole, in memory in proportion to
it; an empty table gives an empty result; other columns pass through the
filter whatever their names and are ignored elsewhere.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, small_batches

# Fixed values of the base measurements.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20


class Text:
    """A text and what has been measured of it so far."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # on exactly SPACES

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, SPACES)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def worded_lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.worded_lines) - len(set(self.worded_lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a window of five words that occurs at least twice.

        Windows are compared by a 64-bit mix first; those that agree are then
        compared word by word, so the count is exact.
        """
        words, n = self.words, len(self.words) - WINDOW + 1
        if n < 2:
            return 0
        h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        mix = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            mix = (mix ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mix ^= mix >> np.uint64(29)
        order = np.argsort(mix, kind="stable")
        equal = mix[order][1:] == mix[order][:-1]
        if not equal.any():
            return 0
        likely = order[np.concatenate(([False], equal)) | np.concatenate((equal, [False]))].tolist()
        windows = [tuple(words[i : i + WINDOW]) for i in likely]
        times = Counter(windows)
        marks = np.zeros(len(words) + 1, np.int64)
        for i, w in zip(likely, windows, strict=True):
            if times[w] > 1:
                marks[i] += 1
                marks[i + WINDOW] -= 1
        return int((np.cumsum(marks) > 0).sum())


    @cached_property
    def n_distinct(self) -> int:
        return len(set(self.words))

    @cached_property
    def entropy(self) -> float:
        """Bits a character of words, from the frequencies of code points in this text."""
        points = np.frombuffer(self.raw.translate(None, SPACES).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return 0.0
        times = np.bincount(points) if points.max() < 1 << 16 else np.unique(points, return_counts=True)[1]
        times = times[times > 0]
        return float(np.log2(len(points)) - (times * np.log2(times)).sum() / len(points))


#: Measurements in an order in which none needs a later one.
MEASURES = ("raw", "words", "word_chars", "n_symbols", "worded_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "entropy")


@dataclass(frozen=True)
class Rule:
    """``needs`` names the measurements that ``rejects`` reads; their cost is counted once for all rules."""

    name: str
    rejects: Callable[[Text], bool]
    needs: tuple[str, ...] = ()


#: The base rules; a document that fails one of them is never kept.
BASE_RULES = (
    Rule("few_words", lambda t: t.n_words < LEAST_WORDS, ("raw", "words")),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > MOST_REPEATED_PERCENT * t.n_words, ("raw", "words", "n_repeat_words")),
)
#: Least entropy of a text's characters, in bits.
LEAST_ENTROPY = 2.5
#: Further rules: words of impossible length, markup or tables, lines said again and again, few
#: distinct words for the length (texts of n words have far more than the root of n), few characters.
RULES = BASE_RULES + (
    Rule("word_length", lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 20 * t.n_words, ("raw", "words", "word_chars")),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words, ("raw", "words", "n_symbols")),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > len(t.worded_lines), ("raw", "worded_lines", "n_dup_lines")),
    Rule("variety", lambda t: t.n_distinct * t.n_distinct < t.n_words, ("raw", "words", "n_distinct")),
    Rule("entropy", lambda t: t.entropy < LEAST_ENTROPY, ("raw", "entropy")),
)

#: Most rows, on average, of the sample on which costs are estimated.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Estimate:
    """``cost`` in seconds and ``rejected`` as a share of the documents that the rule sees; ``seen`` is their share of all."""

    name: str
    cost: float
    rejected: float
    seen: float = 1.0

    @property
    def worth(self) -> float:
        return self.rejected / max(self.cost, 1e-9)


@dataclass(frozen=True)
class Sample:
    """One row a document: seconds of each measurement, seconds of each rule's own test, verdicts."""

    needed: np.ndarray
    own: np.ndarray
    rejected: np.ndarray


def sampled(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Sample:
    """Time all rules on ``sample_rows`` documents on average, however many there are; that many rows of numbers are gathered."""
    small_batches(docs.sparkSession)
    rows = docs.count()
    fraction = min(1.0, sample_rows / rows) if rows else 1.0

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            needed, own, rejected = [], [], []
            for x in batch.column(0):
                t, marks = Text(x.as_py()), [time.perf_counter()]
                for m in MEASURES:
                    getattr(t, m)
                    marks.append(time.perf_counter())
                verdicts = []
                for rule in rules:
                    verdicts.append(bool(rule.rejects(t)))
                    marks.append(time.perf_counter())
                took = np.diff(marks).tolist()
                needed.append(took[: len(MEASURES)])
                own.append(took[len(MEASURES) :])
                rejected.append(verdicts)
            yield pa.RecordBatch.from_arrays([pa.array(needed, pa.list_(pa.float64())), pa.array(own, pa.list_(pa.float64())), pa.array(rejected, pa.list_(pa.bool_()))], ["needed", "own", "rejected"])

    sample = docs.select(text_col).sample(fraction, seed) if fraction < 1 else docs.select(text_col)
    found = sample.mapInArrow(measure, "needed array<double>, own array<double>, rejected array<boolean>").collect()
    shaped = lambda name, width, kind: np.array([r[name] for r in found], kind).reshape(len(found), width)
    return Sample(shaped("needed", len(MEASURES), float), shaped("own", len(rules), float), shaped("rejected", len(rules), bool))


def _cost(sample: Sample, rules: tuple[Rule, ...], i: int, alive: np.ndarray, made: set[str]) -> float:
    wanted = [k for k, m in enumerate(MEASURES) if m in rules[i].needs and m not in made]
    return float((sample.needed[alive][:, wanted].sum(axis=1) + sample.own[alive, i]).mean()) if alive.any() else 0.0


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Estimate]:
    """Cost and selectivity of each rule alone, best first."""
    sample = sampled(docs, rules, text_col, sample_rows, seed)
    everyone = np.ones(len(sample.own), bool)
    out = [Estimate(r.name, _cost(sample, rules, i, everyone, set()), float(sample.rejected[:, i].mean()) if len(everyone) else 0.0) for i, r in enumerate(rules)]
    return sorted(out, key=lambda e: -e.worth)


def ordered_by(sample: Sample, rules: tuple[Rule, ...], made: tuple[str, ...] = ()) -> list[Estimate]:
    """The cascade: each rule with what it costs and rejects at its place; ``made`` names measurements made anyway."""
    alive, have, left, out = np.ones(len(sample.own), bool), set(made), list(range(len(rules))), []
    while left:
        found = [
            (i, Estimate(rules[i].name, _cost(sample, rules, i, alive, have), float(sample.rejected[alive, i].mean()) if alive.any() else 0.0, float(alive.mean()) if len(alive) else 0.0))
            for i in left
        ]
        i, best = max(found, key=lambda x: (x[1].worth, -x[1].cost))
        out.append(best)
        left.remove(i)
        alive &= ~sample.rejected[:, i]
        have.update(rules[i].needs)
    return out


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, made: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """The rules in the order in which they are to run."""
    by_name = {r.name: r for r in rules}
    return tuple(by_name[e.name] for e in ordered_by(sampled(docs, rules, text_col, sample_rows), rules, made))


def first_rejection(text: Text, ordered: tuple[Rule, ...]) -> str | None:
    for rule in ordered:
        if rule.rejects(text):
            return rule.name
    return None


#: Counts that ``measured`` returns of every document, and the measurements behind them.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MADE = ("raw", "words", "worded_lines", *COUNTS[1:])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, ordered: tuple[Rule, ...] | None = None) -> DataFrame:
    """One row per document: doc_id, all base counts, base_failed, kept and the rule that rejected it first.

    Which rule is first depends on the order, which is found on a sample by
    the clock unless ``ordered`` gives it; all else does not.
    """
    small_batches(docs.sparkSession)
    further = tuple(r for r in rules if r not in BASE_RULES)
    order = cascade(docs, further, text_col, made=_MADE) if ordered is None else tuple(r for r in ordered if r not in BASE_RULES)
    id_type = docs.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values: list[tuple] = []
            for x in batch.column(1):
                t = Text(x.as_py())
                counts = [getattr(t, m) for m in COUNTS]
                failed = first_rejection(t, BASE_RULES)
                by = failed or first_rejection(t, order)
                values.append((*counts, failed is not None, by is None, by))
            columns = list(zip(*values, strict=True)) or [()] * (len(COUNTS) + 3)
            arrays = [pa.array(c, pa.int64()) for c in columns[:-3]] + [pa.array(c, pa.bool_()) for c in columns[-3:-1]] + [pa.array(columns[-1], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *COUNTS, "base_failed", "kept", "rejected_by"])

    schema = f"doc_id {id_type}, " + ", ".join(f"{m} long" for m in COUNTS) + ", base_failed boolean, kept boolean, rejected_by string"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(judge, schema)


def filtered(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns kept; no measurement beyond the first rejection is made."""
    small_batches(docs.sparkSession)
    ordered = cascade(docs, rules, text_col)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = [first_rejection(Text(x.as_py()), ordered) is None for x in batch.column(at)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def audit(docs: DataFrame, ordered: tuple[Rule, ...], text_col: str = "text") -> DataFrame:
    """One row a rule in its order: place, rule, seen and rejected, the documents it judged and those it rejected, and its seconds."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rejected, took = [0] * len(ordered), [0] * len(ordered), [0.0] * len(ordered)
        for batch in batches:
            for x in batch.column(0):
                t = Text(x.as_py())
                for i, rule in enumerate(ordered):
                    began = time.perf_counter()
                    hit = rule.rejects(t)
                    took[i] += time.perf_counter() - began
                    seen[i] += 1
                    if hit:
                        rejected[i] += 1
                        break
        yield pa.RecordBatch.from_pydict({"place": list(range(len(ordered))), "rule": [r.name for r in ordered], "seen": seen, "rejected": rejected, "seconds": took}, schema=schema)

    schema = pa.schema([("place", pa.int64()), ("rule", pa.string()), ("seen", pa.int64()), ("rejected", pa.int64()), ("seconds", pa.float64())])
    each = docs.select(text_col).mapInArrow(count, "place long, rule string, seen long, rejected long, seconds double")
    return each.groupBy("place", "rule").agg(F.sum("seen").alias("seen"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return measured(docs).select("doc_id", *COUNTS, "base_failed", "kept")


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), pos AS (
  SELECT doc_id, words, len(words) AS n, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 6
), win AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + 4], ' ') AS g FROM pos
), rep AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM win
), cover AS (
  SELECT doc_id, i + k AS p FROM rep, range(0, 5) AS t(k) WHERE times > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM cover GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d
), dup AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), chars AS (
  SELECT doc_id, unnest(string_split(array_to_string(words, ''), '')) AS c FROM w WHERE len(words) > 0
), each_char AS (
  SELECT doc_id, c, count(*) AS times FROM chars GROUP BY doc_id, c
), entropies AS (
  SELECT doc_id, log2(sum(times)) - sum(times * log2(times)) / sum(times) AS entropy FROM each_char GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(list_distinct(words)) AS n_distinct, coalesce(entropy, 0) AS entropy, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(dup.n_lines, 0) AS n_lines,
         CAST(coalesce(repeats.n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN repeats ON repeats.doc_id = w.doc_id LEFT JOIN entropies ON entropies.doc_id = w.doc_id
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 20 * n_words
       AND 10 * n_symbols <= n_words AND 2 * n_dup_lines <= n_lines
       AND n_distinct * n_distinct >= n_words AND entropy >= {LEAST_ENTROPY} AS kept
FROM b
"""
