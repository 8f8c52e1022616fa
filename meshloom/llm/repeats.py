"""Suffix-array deduplication: bytes covered by a `length`-byte string that starts anywhere else too.

A full suffix sort of the corpus isn't needed: only suffixes that can meet are sorted.  A window (a string
of `length` bytes) has one canonical anchor, the k-gram with the least hash in it, so equal windows have
equal anchors at equal offsets, and windows in a row that share an anchor form a *run*.

1. One scan gives the runs (one per about length/2 bytes): anchor, hash of the whole run, place.  Of copies of
   a text two a task are enough.  Equal runs are one string with a weight (partial aggregation, however many
   copies there are); anchors that occur once go.
2. The other runs' texts are strings over a super-alphabet of length/SYMBOLS-byte symbols: for each of the
   first length/SYMBOLS offsets, the symbols that follow each other from there.  Strings that meet in an
   anchor are dealt to SHARDS shards.  Each has its Burrows-Wheeler transform, and shard transforms merge by iterative
   interleave refinement: iteration h orders suffixes by h symbols with one stable pass over the
   transforms, no suffix is sorted again, and a boundary first seen in iteration h is a common
   prefix of h-1 symbols.  Intervals without a boundary after SYMBOLS iterations are the strings of
   `length` bytes; those of weight two or more are repeated.  All repeats come from these intervals.
3. An anchor with more than GROUP different runs (a passage in countless contexts) is split by content: its
   runs are cut into pieces of PIECES[0] windows aligned on the anchor, and pieces meet by their core, the
   bytes that all their windows have; cores of too many different pieces are cut finer, at last to
   single windows, of which equal ones are one string.  Every part goes through the same merge.
4. Repeated windows go back to all places of their runs.

Defined results: null text is empty; texts shorter than `length` keep all bytes; rows repeating
a text (or a whole row) are copies of each other, so all their windows are removed; ids only
pass through and may be null or repeat; other columns are ignored by `repeated_bytes`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashes, LANES, Scratch, U, hidden, mix, powers, signed, slices

K = 24
#: Windows a piece has when hot anchors are split, level by level.
PIECES = (64, 8, 1)
GROUP = 4096
SEGMENT = 1 << 23
SHARDS = 4
#: Bytes of strings that are merged at once (whole groups).
PART_BYTES = 1 << 19
#: Symbols a window has; the super-alphabet's symbols are length/SYMBOLS bytes.
SYMBOLS = 2
_POS = 24


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row, by block-wise prefix and suffix minima."""
    n = len(x) - w + 1
    pad = -len(x) % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs_of(data: np.ndarray, offs: np.ndarray, length: int):
    """(row, offset of first window in the row, windows, anchor's distance from it, anchor hash, run hash)."""
    w = length - K + 1
    if len(data) < length:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    h = Hashes(data)
    up, down = powers(len(data) + 1)
    gram = mix((h.sum[K:] - h.sum[:-K]) * down[: len(data) - K + 1])
    key = (gram >> U(_POS) << U(_POS)) | np.arange(len(gram), dtype=np.uint64)
    anchor = (_sliding_least(key, w) & U((1 << _POS) - 1)).astype(np.int64)
    rows = np.flatnonzero(np.diff(offs) >= length)
    step = np.zeros(len(anchor) + 1, np.int64)
    np.add.at(step, offs[rows], 1)
    np.add.at(step, offs[rows + 1] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(step[:-1]))
    if not len(at):
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    head = np.ones(len(at), bool)
    head[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = at[head]
    last = at[np.append(head[1:], True)]
    a = anchor[first]
    row = np.searchsorted(offs, first, "right") - 1
    whole = mix(h.of(first, last + length) + (a - first).astype(np.uint64) * LANES[20])
    return [row, first - offs[row], last - first + 1, a - first, mix(gram[a] ^ LANES[21]), whole]


def _scan(length: int):
    """Map: (t1, t2, text) -> runs; place is offset, windows and anchor's distance in one number."""
    names = ["t1", "t2", "place", "fp", "rh"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}  # texts of this task and how often they came; forgotten when large
        for batch in batches:
            t1, t2 = batch[0].to_numpy(), batch[1].to_numpy()
            use = np.ones(len(t1), bool)
            for k, key in enumerate(zip(t1.tolist(), t2.tolist(), strict=True)):
                seen[key] = seen.get(key, 0) + 1
                use[k] = seen[key] <= 2  # two copies make a repeat, more add nothing
            if len(seen) > 200_000:
                seen.clear()
            t1, t2, text = t1[use], t2[use], batch[2].filter(pa.array(use))
            for i, j, data, offs in slices(text):
                base = 0
                while True:  # one pass, but for a single text beyond SEGMENT bytes
                    end = min(len(data), base + SEGMENT + length - 1) if j == i + 1 else len(data)
                    part, o = data[base:end], offs if j > i + 1 else np.array([0, end - base], np.int64)
                    row, off, n, dist, fp, rh = runs_of(part, o, length)
                    if len(row):
                        place = off + base << 32 | n << 16 | dist
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t1[i + row], t2[i + row], place, signed(fp), signed(rh))], names)
                    if end == len(data):
                        break
                    base += SEGMENT

    return run, "t1 long, t2 int, place long, fp long, rh long"


# -- shard transforms ------------------------------------------------------------------------


class Shard:
    """Suffixes of a set of strings of super-symbols, in order.  `bwt` is the symbol before each
    (-1: the string starts there), `place` the text position a suffix starts at (-1: it is empty)."""

    def __init__(self, bwt: np.ndarray, place: np.ndarray, strings: int):
        self.bwt, self.place, self.strings = bwt, place, strings

    @classmethod
    def build(cls, symbols: np.ndarray, place: np.ndarray) -> Shard:
        """symbols: strings x most symbols, -1 where a string has ended; place: of each symbol."""
        m, width = symbols.shape
        end = np.full((m, 1), -1, symbols.dtype)
        full = np.concatenate([symbols, end], axis=1)
        size = (symbols >= 0).sum(axis=1)
        which = np.repeat(np.arange(m), size + 1)
        col = np.arange(len(which)) - np.repeat(np.cumsum(size + 1) - (size + 1), size + 1)
        wide = np.concatenate([full, np.full((m, width), -1, symbols.dtype)], axis=1)
        order = np.lexsort((which, *[wide[which, col + k] for k in range(width, -1, -1)]))
        which, col = which[order], col[order]
        before = np.where(col > 0, full[which, col - 1], -1)
        where = np.where(col < size[which], np.concatenate([place, np.full((m, 1), -1)], axis=1)[which, np.minimum(col, width)], -1)
        return cls(before, where, m)


def merge(a: Shard, b: Shard, depth: int) -> tuple[Shard, np.ndarray]:
    """The merged shard, and for each of its suffixes the number of its interval after `depth`
    refinements: suffixes of one interval agree in `depth` symbols (or are both as short)."""
    n = len(a.bwt) + len(b.bwt)
    side = np.zeros(n, bool)
    side[len(a.bwt) :] = True
    ends = np.concatenate([np.zeros(a.strings, bool), np.ones(b.strings, bool)])
    interval = np.zeros(n, np.int64)
    at_depth = None
    h = 0
    while True:
        seq = np.empty(n, a.bwt.dtype)
        seq[~side], seq[side] = a.bwt, b.bwt
        inner = np.flatnonzero(seq >= 0)
        order = inner[np.argsort(seq[inner], kind="stable")]
        new = np.concatenate([ends, side[order]])
        sym, old = seq[order], interval[order]
        bound = np.zeros(n, bool)
        k = len(ends)
        if len(order):
            bound[k] = True
            bound[k + 1 :] = (sym[1:] != sym[:-1]) | (old[1:] != old[:-1])
        interval = np.cumsum(bound)
        h += 1
        if h == depth:
            at_depth = interval
        same = np.array_equal(new, side)
        side = new
        if same and h >= depth:
            break
    place = np.empty(n, a.place.dtype)
    place[~side], place[side] = a.place, b.place
    seq = np.empty(n, a.bwt.dtype)
    seq[~side], seq[side] = a.bwt, b.bwt
    # Later iterations reorder within intervals only, so the ranks of at_depth still hold.
    return Shard(seq, place, a.strings + b.strings), at_depth


def repeated_windows(data: np.ndarray, at: np.ndarray, windows: np.ndarray, weight: np.ndarray, shard: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, window) of each window whose `length` bytes occur with a weight of two or more.  String i
    has windows[i] windows, starts at data[at[i]] and stands for weight[i] equal ones."""
    q, m = length // SYMBOLS, len(at)
    symbols_of = windows + length - q  # symbols start at this many offsets of a string
    base = np.concatenate([[0], np.cumsum(symbols_of)])
    string = np.repeat(np.arange(m), symbols_of)
    offset = np.arange(base[-1]) - base[string]
    where = at[string] + offset
    _, rank = np.unique(Hashes(data).of(where, where + q), return_inverse=True)
    deep = -(-int(symbols_of.max()) // q)
    step = np.arange(q)[:, None] + q * np.arange(deep)  # a row for each offset below q: the symbols that follow from there
    shards = []
    for k in np.unique(shard):
        own = np.flatnonzero(shard == k)
        place = base[own][:, None, None] + step
        place = np.where(step < symbols_of[own][:, None, None], place, -1).reshape(-1, deep)
        shards.append(Shard.build(np.where(place < 0, -1, rank[place]).astype(np.int32), place))
    shards = shards if len(shards) > 1 else [*shards, Shard(shards[0].bwt[:0], shards[0].place[:0], 0)]
    while len(shards) > 1:
        merged = [merge(shards[k], shards[k + 1], SYMBOLS) for k in range(0, len(shards) - 1, 2)]
        shards = [x[0] for x in merged] + shards[2 * len(merged) :]
    interval, place = merged[0][1], shards[0].place
    some = place >= 0
    interval, place = interval[some], place[some]
    whole = offset[place] < windows[string[place]]  # suffixes of SYMBOLS symbols or more
    interval, place = interval[whole], place[whole]
    total = np.bincount(interval, weights=np.minimum(weight, 2)[string[place]])
    hit = np.sort(place[total[interval] >= 2])
    return string[hit], offset[hit]


def _live(data: np.ndarray, at: np.ndarray, windows: np.ndarray, dist: np.ndarray, weight: np.ndarray, group: np.ndarray, length: int):
    """Stretches (string, first window, windows) whose pieces have a core that has weight two or more in its group."""
    size = PIECES[0]
    low, high = dist - windows + 1, dist  # distances from window to anchor
    n = high // size - low // size + 1
    row = np.repeat(np.arange(len(n)), n)
    j = high[row] // size - (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))  # from the first window on
    first = np.maximum(0, dist[row] - (size * j + size - 1))
    last = np.minimum(windows[row] - 1, dist[row] - size * j)
    core = at[row] + dist[row] - size * j  # the bytes that all windows of a whole piece have, so each one here has
    key = mix(Hashes(data).of(core, core - size + 1 + length) ^ mix(group[row] + j.astype(np.uint64) * LANES[22]))
    _, inverse = np.unique(key, return_inverse=True)
    total = np.bincount(inverse, weights=np.minimum(weight, 2)[row])
    keep = total[inverse] >= 2
    row, first, last = row[keep], first[keep], last[keep]
    head = np.ones(len(row), bool)
    head[1:] = (row[1:] != row[:-1]) | (first[1:] != last[:-1] + 1)
    begin = first[head]
    end = last[np.append(head[1:], True)] if len(row) else last
    return row[head], begin, end - begin + 1


def _solve(length: int):
    """Map over strings sorted by key -> (key, sh, spans): the repeated stretches of each string, as
    (first window << 31 | bytes)."""

    from .ngram_join import _groups

    def solve(table: pa.Table) -> pa.RecordBatch | None:
        content = table["content"].combine_chunks().cast(pa.large_binary())
        data = np.frombuffer(content.buffers()[2], np.uint8)
        at = np.frombuffer(content.buffers()[1], np.int64)[content.offset : content.offset + len(content)]
        key, sh, weight, windows, dist = (table[k].to_numpy() for k in ("key", "sh", "w", "n", "dist"))
        string, first, n = _live(data, at, windows, dist, weight, key.view(np.uint64), length)
        if not len(string):
            return None
        shard = (sh[string].view(np.uint64) % U(SHARDS)).astype(np.int64)
        which, window = repeated_windows(data, at[string] + first, n, weight[string], shard, length)
        if not len(which):
            return None
        row, window = string[which], window + first[which]
        head = np.ones(len(row), bool)
        head[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)
        begin, row, end = window[head], row[head], window[np.append(head[1:], True)] + length
        lists = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        spans = pa.ListArray.from_arrays(pa.array(np.append(lists, len(row)), pa.int32()), pa.array(begin << 31 | end - begin))
        return pa.RecordBatch.from_arrays([pa.array(key[row[lists]]), pa.array(sh[row[lists]]), spans], ["key", "sh", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ("key",)):
            key = table["key"].to_numpy()
            heads = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            upto = np.concatenate([[0], np.cumsum(table["n"].to_numpy() + length)])
            s = 0
            while s < len(key):  # whole groups, about PART_BYTES at a time
                fits = heads[(heads > s) & (upto[heads] <= upto[s] + PART_BYTES)]
                e = int(fits[-1]) if len(fits) else int(heads[np.searchsorted(heads, s, "right")])
                if got := solve(table.slice(s, e - s)):
                    yield got
                s = e

    return run, "key long, sh long, spans array<long>"


_STRING = "key long, sh long, w long, n long, dist long, fp long, rh long, at long, content binary"
_KINDS = [pa.int64()] * 8 + [pa.binary()]
_NAMES = [x.split()[0] for x in _STRING.split(", ")]


def _fetch(length: int):
    """Map: (t1, t2, text, asked) -> the strings of asked runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, out, held = None, [], 0
        for batch in batches:
            for t1, t2, text, asked in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2], batch[3].to_pylist(), strict=True):
                if (t1, t2) == before:  # a copy of the same text
                    continue
                before = (t1, t2)
                raw = text.as_buffer()
                for x in asked:
                    off, n = x["place"] >> 32, x["place"] >> 16 & 0xFFFF
                    out.append((x["fp"], x["rh"], x["w"], n, x["place"] & 0xFFFF, x["fp"], x["rh"], 0, raw.slice(off, n - 1 + length).to_pybytes()))
                    held += n + length
                if held > 4 << 20:
                    yield _rows(out)
                    out, held = [], 0
        if out:
            yield _rows(out)

    return run, _STRING


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _KINDS, strict=True)], _NAMES)


def _split(length: int, size: int):
    """Map: strings -> their pieces of up to `size` windows, aligned on the anchor; key is the core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for key, _, w, n, dist, fp, rh, at, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                hashes = Hashes(np.frombuffer(content, np.uint8))
                j = np.arange((dist - n + 1) // size, dist // size + 1)
                first, last = np.maximum(0, dist - (size * j + size - 1)), np.minimum(n - 1, dist - size * j)
                start = dist - size * j
                core = mix(hashes.of(start, start - size + 1 + length) ^ mix(np.full(1, fp, np.int64).view(np.uint64) + j.astype(np.uint64) * LANES[22]))
                piece = mix(hashes.of(first, last + length) + (dist - first).astype(np.uint64) * LANES[23])
                for k in range(len(j)):
                    f, g = int(first[k]), int(last[k])
                    out.append((int(signed(core[k : k + 1])[0]), int(signed(piece[k : k + 1])[0]), w, g - f + 1, dist - f, fp, rh, at + f, content[f : g + length]))
                    held += g - f + length
                if held > 4 << 20:
                    yield _rows(out)
                    out, held = [], 0
        if out:
            yield _rows(out)

    return run, _STRING


def _spans(batch_spans) -> list[tuple[np.ndarray, np.ndarray]]:
    """Maximal removed runs (starts, ends) of each row."""
    out = []
    for x in batch_spans:
        v = np.sort(np.array(x.as_py() or [], np.int64))
        s, e = v >> 31, (v >> 31) + (v & ((1 << 31) - 1))
        if len(v):
            top = np.maximum.accumulate(e)
            head = np.ones(len(s), bool)
            head[1:] = s[1:] > top[:-1]
            s, e = s[head], top[np.append(np.flatnonzero(head)[1:] - 1, len(s) - 1)]
        out.append((s, e))
    return out


def _remove(at_text: int, at_span: int, whole_chars: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kept, size, gone, count = [], [], [], []
            for text, (s, e) in zip(batch.column(at_text), _spans(batch.column(at_span)), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if whole_chars and len(s):  # a character that is only partly covered stays
                    cont = (np.frombuffer(raw + b"a", np.uint8) & 0xC0) == 0x80
                    for _ in range(3):
                        s = s + cont[s]
                        e = e - cont[e]
                    s, e = s[s < e], e[s < e]
                cuts = [0, *np.stack([s, e], axis=1).ravel().tolist(), len(raw)]
                kept.append(raw if not len(s) else b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
                size.append(len(raw))
                gone.append(int((e - s).sum()))
                count.append(len(s))
            if whole_chars:
                text = pa.array([k.decode() if batch.column(at_text)[i].is_valid else None for i, k in enumerate(kept)], pa.string())
                yield pa.RecordBatch.from_arrays([text if i == at_text else batch.column(i) for i in range(at_span)], [batch.schema.names[i] for i in range(at_span)])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (size, gone, count)], pa.array(kept, pa.binary())], [batch.schema.names[0], "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _with_spans(docs: DataFrame, text_col: str, length: int) -> tuple[DataFrame, str]:
    """docs with a column of encoded spans (start << 31 | length) to remove."""
    if length % SYMBOLS or not max(2 * K, 2 * PIECES[0]) <= length < 1 << 16:
        raise ValueError("length must be a multiple of SYMBOLS, at least twice the anchor and piece sizes, and below 65536")
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.xxhash64(text).alias("t1"), F.hash(text).alias("t2"), text.alias("text"))
    run, schema = _scan(length)
    runs = scratch.cut(source.where(F.octet_length("text") >= length).mapInArrow(run, schema), "runs")
    # Runs equal as a whole are one string; anchors that occur once go.
    whole = runs.groupBy("fp", "rh").agg(F.count("*").alias("w"), F.min(F.struct("t1", "t2", "place")).alias("x"))
    anchors = runs.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp")
    asked = whole.join(anchors, "fp").groupBy("x.t1", "x.t2").agg(F.collect_list(F.struct("fp", "rh", "w", "x.place")).alias("asked"))
    asked = scratch.cut(asked, "asked")  # per text, so no list is longer than a text has runs
    run, schema = _fetch(length)
    strings = scratch.cut(source.join(asked.hint("merge"), ["t1", "t2"]).select("t1", "t2", "text", "asked").mapInArrow(run, schema), "strings")
    scratch.release(asked)
    run, schema = _solve(length)
    found, used = [], [runs]
    for size in (*PIECES, None):
        used.append(strings)
        each = strings if size == PIECES[0] else strings.groupBy("key", "sh").agg(F.sum("w").alias("w"), *[F.first(c).alias(c) for c in ("n", "dist", "content")])
        crowded = each.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > GROUP).select("key") if size else None
        if size:
            crowded = scratch.cut(crowded, "crowded")
            each = each.join(crowded, "key", "left_anti")
        solved = each.select("key", "sh", "w", "n", "dist", "content").repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)
        solved = scratch.cut(solved, "solved")
        back = strings.select("key", "sh", "fp", "rh", "at").join(solved, ["key", "sh"])
        found.append(back.select("fp", "rh", F.explode("spans").alias("span"), "at").select("fp", "rh", (F.col("span") + F.shiftleft("at", 31)).alias("span")))
        if not size or crowded.isEmpty():
            break
        cut, kinds = _split(length, size)
        strings = scratch.cut(strings.join(crowded, "key").select(*_NAMES).mapInArrow(cut, kinds), "pieces")
    parts = found[0]
    for x in found[1:]:
        parts = parts.union(x)
    parts = scratch.cut(parts, "parts")
    spans = runs.select("t1", "t2", "fp", "rh", F.shiftright("place", 32).alias("off")).join(parts, ["fp", "rh"])
    spans = spans.select("t1", "t2", (F.col("span") + F.shiftleft("off", 31)).alias("span")).groupBy("t1", "t2").agg(F.collect_set("span").alias("spans"))
    s1, s2, name = hidden("t1_", docs), hidden("t2_", docs), hidden("spans_", docs)
    spans = scratch.cut(spans.select(F.col("t1").alias(s1), F.col("t2").alias(s2), F.col("spans").alias(name)), "spans")
    scratch.release(*used, parts)
    return docs.join(spans, (F.xxhash64(text) == F.col(s1)) & (F.hash(text) == F.col(s2)), "left").drop(s1, s2), name


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of each row: kept is its UTF-8 bytes without those
    that a repeated string of `length` bytes covers, n_spans the maximal removed runs."""
    kind = docs.schema[id_col].dataType.simpleString()
    both, name = _with_spans(docs.select(id_col, text_col), text_col, length)
    return both.select(id_col, text_col, name).mapInArrow(_remove(1, 2, False), f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, text_col: str = "text", length: int = 400) -> DataFrame:
    """docs with the repeated bytes cut out of their texts; characters that are only partly covered
    stay, null texts stay null, all rows and columns stay."""
    both, name = _with_spans(docs, text_col, length)
    return both.mapInArrow(_remove(docs.columns.index(text_col), len(docs.columns), True), docs.schema)
