"""Quality rules as a short-circuit cascade.

The rules run one after another, each only on the documents that all earlier rules accepted, so a rejected
text is never scanned again; what a rule needs to know of a text (words, repeated lines, repeated words) is
worked out when the first rule asks for it.  The order is by rejection per cost: each rule's seconds, with all that it
needs, and its rejected share are measured on a random sample of about `sample_rows` rows (a documented
parameter).  A document is kept when no rule rejects it, so the order changes the cost and never the verdict.

`quality_filter` owes nothing but the kept documents: the base test's rules are part of its cascade.
`quality_verdicts` owes the base counts of every document, so those are made first, and the cascade
runs on what passes the base test.

Defined results: null or blank text has no words and fails the base test; repeated rows are
judged row by row; other columns (also of clashing names) are ignored by `quality_verdicts`
and carried through by `quality_filter`; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashes, LANES, SPACE, U, hidden, mix, slices, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
WORDY = LETTER.copy()
WORDY[128:] = True
BANG = np.zeros(256, bool)
BANG[ord("!")] = True


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """True flags of each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


class Texts:
    """Texts end to end, and what is known of them; counts have a value a text and are made when first asked for."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs
        self.rows = len(offs) - 1

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return words(self.data, self.offs)

    @cached_property
    def hashes(self) -> Hashes:
        return Hashes(self.data)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words[2])

    @cached_property
    def n_chars(self) -> np.ndarray:
        """Bytes that aren't white space."""
        return _sums(~SPACE[self.data], self.offs)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return _sums(~SPACE[self.data] & ((self.data & 0xC0) != 0x80), self.offs)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return _sums(SYMBOLS[self.data], self.offs)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those of them that equal an earlier one of their text."""
        breaks = self.data == 10
        end = np.concatenate([np.flatnonzero(breaks), self.offs[1:]])
        end.sort(kind="stable")
        row = np.repeat(np.arange(self.rows), _sums(breaks, self.offs) + 1)
        start = np.empty_like(end)
        start[1:] = end[:-1] + 1
        start[np.searchsorted(row, np.arange(self.rows))] = self.offs[:-1]
        first = self.words[0]
        some = np.searchsorted(first, end) > np.searchsorted(first, start)
        start, end, row = start[some], end[some], row[some]
        key = mix(self.hashes.of(start, end) + mix(row.astype(np.uint64)))
        distinct = np.unique(key, return_index=True)[1]
        count = np.bincount(row, minlength=self.rows)
        return count, count - np.bincount(row[distinct], minlength=self.rows)

    @property
    def n_lines(self) -> np.ndarray:
        return self._lines[0]

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words inside a window of three that the text has twice or more."""
        starts, ends, first = self.words
        row = np.repeat(np.arange(self.rows), np.diff(first))
        h = self.hashes.of(starts, ends)
        covered = np.zeros(len(h), bool)
        if len(h) >= 3:
            window = mix(h[:-2] * LANES[0] + h[1:-1] * LANES[1] + h[2:] * LANES[2] + mix(row[:-2].astype(np.uint64)))
            at = np.flatnonzero(row[2:] == row[:-2])
            order = np.argsort(window[at], kind="stable")
            same = window[at][order][1:] == window[at][order][:-1]
            twice = np.zeros(len(at), bool)
            twice[1:] |= same
            twice[:-1] |= same
            hit = at[order[twice]]
            for k in range(3):
                covered[hit + k] = True
        return np.bincount(row[covered], minlength=self.rows)

    def pick(self, keep: np.ndarray) -> Texts:
        """The kept texts; counts that are known stay known."""
        if keep.all():
            return self
        size = np.diff(self.offs)
        out = Texts(self.data[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])]))
        for name in ("n_words", "n_chars", "word_chars", "n_symbols", "n_repeat_words"):
            if name in self.__dict__:
                out.__dict__[name] = self.__dict__[name][keep]
        if "_lines" in self.__dict__:
            out.__dict__["_lines"] = tuple(x[keep] for x in self._lines)
        return out


@dataclass(frozen=True)
class Rule:
    """accepts(texts) -> one flag a text, over the texts still in the race."""

    name: str
    accepts: Callable[[Texts], np.ndarray]


def length(least: int) -> Rule:
    return Rule("length", lambda t: t.n_words >= least)


#: Integer arithmetic throughout, so that SQL gives the same verdicts.
BASE = (
    length(50),
    Rule("mostly_repeats", lambda t: 100 * t.n_repeat_words <= 50 * t.n_words),
)
RULES = (
    Rule("word_length", lambda t: (t.word_chars >= 2 * t.n_words) & (t.word_chars <= 15 * t.n_words)),
    Rule("symbols", lambda t: 10 * t.n_symbols <= t.n_words),
    Rule("line_repeats", lambda t: 10 * t.n_dup_lines <= 3 * t.n_lines),
    Rule("word_repeats", lambda t: 100 * t.n_repeat_words <= 30 * t.n_words),
    Rule("shouting", lambda t: 2 * _sums(UPPER[t.data], t.offs) <= _sums(LETTER[t.data], t.offs)),
    Rule("exclamations", lambda t: 10 * _sums(BANG[t.data], t.offs) <= t.n_words),
    Rule("letters", lambda t: 10 * _sums(WORDY[t.data], t.offs) >= 6 * t.n_chars),
)


def cascade(texts: Texts, rules) -> np.ndarray:
    """Flags of the texts that every rule accepts."""
    kept = np.ones(texts.rows, bool)
    live = np.arange(texts.rows)
    for rule in rules:
        if not len(live):
            break
        good = rule.accepts(texts)
        kept[live[~good]] = False
        live = live[good]
        texts = texts.pick(good)
    return kept


def base_failed(t: Texts) -> np.ndarray:
    return ~(BASE[0].accepts(t) & BASE[1].accepts(t))


def cascade_order(docs: DataFrame, text_col: str = "text", rules=RULES, sample_rows: int = 500) -> list[Rule]:
    """Rules by rejected share per second, measured where the sampled rows are; nothing known of a text is
    shared between rules, so a rule's seconds have all that it needs."""
    total = docs.count()
    if not total:
        return list(rules)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, lost = np.zeros(len(rules)), np.zeros(len(rules))
        for batch in batches:
            for _, _, data, offs in slices(batch[0]):
                for k, rule in enumerate(rules):
                    t = time.thread_time()
                    lost[k] += (~rule.accepts(Texts(data, offs))).sum()
                    spent[k] += time.thread_time() - t
        yield pa.RecordBatch.from_pydict({"k": np.arange(len(rules)), "spent": spent, "lost": lost})

    sample = docs.select(text_col).sample(fraction=min(1.0, sample_rows / total), seed=11)
    rows = sample.mapInArrow(measure, "k long, spent double, lost double").groupBy("k").agg(F.sum("spent").alias("spent"), F.sum("lost").alias("lost")).collect()
    score = {r.k: r.lost / (r.spent + 1e-6) for r in rows}
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: -score.get(k, 0.0))]


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, sample_rows: int = 500) -> DataFrame:
    """One row a document: id, base counts, base_failed and kept."""
    ordered = cascade_order(docs, text_col, rules, sample_rows)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in COLUMNS.split(", ")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in slices(batch.column(1)):
                texts = Texts(data, offs)
                counts = [pa.array(getattr(texts, name), pa.int64()) for name in names[:-2]]
                failed = base_failed(texts)
                kept = ~failed
                kept[kept] = cascade(texts.pick(kept), ordered)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *counts, pa.array(failed), pa.array(kept)], [id_col, *names])

    return docs.select(id_col, text_col).mapInArrow(judge, f"`{id_col}` {kind}, {COLUMNS}")


def quality_filter(docs: DataFrame, text_col: str = "text", rules=BASE + RULES, sample_rows: int = 500) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    ordered = cascade_order(docs, text_col, rules, sample_rows)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = [cascade(Texts(data, offs), ordered) for _, _, data, offs in slices(batch.column(at))]
            if flags:
                yield batch.filter(pa.array(np.concatenate(flags)))

    return docs.mapInArrow(keep, docs.schema)


_W = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH t AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents
), g AS (
  SELECT rid, doc_id, x, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda s: length(s))), 0) AS word_chars,
    len(regexp_extract_all(x, '[#*$%&|<>]')) AS n_symbols,
    list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '{_W}')) AS lines,
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS win
  FROM t
), m AS (
  SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM g
), u AS (
  SELECT rid, unnest(win) AS k, unnest(range(1, len(win) + 1)) AS i FROM m
), rep AS (
  SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (
    SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM u) WHERE c >= 2
  ) GROUP BY rid
), b AS (
  SELECT doc_id, x, n_words, word_chars, n_symbols, n_lines, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM m LEFT JOIN rep USING (rid)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_symbols <= n_words AND 10 * n_dup_lines <= 3 * n_lines
    AND 100 * n_repeat_words <= 30 * n_words
    AND 2 * length(regexp_replace(x, '[^A-Z]', '', 'g')) <= length(regexp_replace(x, '[^A-Za-z]', '', 'g'))
    AND 10 * length(regexp_replace(x, '[^!]', '', 'g')) <= n_words
    AND 10 * strlen(regexp_replace(x, '[\x00-@\[-`{{-\x7F]', '', 'g')) >= 6 * strlen(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS kept
FROM b
"""
