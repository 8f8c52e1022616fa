"""N-gram Jaccard join by count vectors in R-trees.

A document is the set of its distinct word n-grams.  Tokens (n-grams) are hashed into
GROUPS groups and the group counts of a set are a point; the overlap of two sets is at most
the sum over groups of the smaller count, so an R-tree whose nodes keep the coordinate
maxima (and the range of set sizes) bounds the overlap of a set with everything below a
node.  Pairs that survive are verified on the full sets.

Routing makes this distributed and exact without comparing all pairs:

1. Equal sets become one class, whose representative is its smallest id.
2. All sets order their tokens alike: light ones by the number of sets that have them, then heavy ones
   (by a fixed-size count sketch over all documents).  Sets that link share a token among the first
   n - ceil(t*n) + 1 of each.  One shuffle by token finds which light tokens are shared at all; those go
   back to their sets, of which most have only tokens of their own in their prefix and go.  Lists of
   sets that meet in a prefix token, once each, are what the R-trees index.  What a set shares with any other
   is all that verification needs, so no text is read again.
3. In TURNS each list yields few pairs, stars at first (each set with one set of another component that
   it may link with), then the nearest ones (each set outside the list's largest component with the
   NEAREST sets of other components that have the highest bounds).  The pairs are verified and the
   components they join are merged; lists without such pairs, or of one component, go.  At last the
   remaining lists yield every surviving pair across components, which are verified too.  A pair is
   left out only where its ends are already known to be connected.

Hot lists are split by hash; their least set (in the turns) or the sets outside their largest
component (at last) go to every part.  No list, bucket or group is capped.

Defined results: null and blank texts have empty sets, which link with nothing (component is
their own id); a null id names no document: its row comes back with a null component; rows
that repeat an id come back row by row; other columns are ignored by `ngram_classes`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Hashes, LANES, SYMBOL_LOWER, Scratch, U, components, hidden, mix, signed, slices, words

GROUPS = 256
#: A count of a byte's limit or more stands for any count, so bounds stay upper bounds.
FULL, ANY = 255, 1 << 20
SKETCH_BITS = 16
HOT_LIST = 4096
SMALL_LIST = 32
LEAF = 32
TURNS = ("stars", "stars", "nearest")
NEAREST = 4
#: Tokens of a bucket, on average.
BUCKET = 1 << 21
_BLOCK = 1 << 10


# -- sets ---------------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each row's n-grams of ASCII-lower-cased words; a row with
    fewer words has its whole sequence as one, a row without words none."""
    starts, ends, first = words(data, offs)
    h = Hashes(data, SYMBOL_LOWER).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        grams += h[k : k + len(grams)] * LANES[k]
    grams = mix(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mix((h[a:b] * LANES[: b - a]).sum(keepdims=True) + LANES[32 + b - a]))
        else:
            out.append(h[:0])
    return out


def set_id(s: np.ndarray) -> int:
    return int(signed(mix(mix(s ^ LANES[40]).sum(keepdims=True) + np.array([len(s)], np.uint64) * LANES[41]))[0])


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def need(na, nb, percent: int):
    """Least overlap of linked sets of these sizes: 100*o >= percent*(na+nb-o)."""
    return -(-percent * (na + nb) // (100 + percent))


def _profile(n: int):
    """Map: (doc, text) -> 'd' rows (doc, set id, size) and, at a task's end, 's' rows of its count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            sid, size = [], []
            for _, _, data, offs in slices(batch[1]):
                sets = shingle_sets(data, offs, n)
                sketch += np.bincount((np.concatenate(sets) >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
                sid += [set_id(s) for s in sets]
                size += [len(s) for s in sets]
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch[0], pa.array(sid, pa.int64()), pa.array(size, pa.int64()), pa.nulls(len(sid), pa.binary())], ["doc", "sid", "n", "cells"])
        for k in range(0, len(sketch), _BLOCK):
            if (part := sketch[k : k + _BLOCK]).any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([k], pa.int64()), pa.array([-1], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["doc", "sid", "n", "cells"])

    return run, "doc long, sid long, n long, cells binary"


def _sum_cells(key, table):
    total = np.zeros(_BLOCK, np.int64)
    for x in table["cells"]:
        total += np.frombuffer(x.as_py(), np.int64)
    return pa.table({"sid": [key[0].as_py()], "cells": [total.tobytes()]})


def bucket_bits(tokens: int) -> int:
    """Buckets (a power of two, by the leading bits of a token) of about BUCKET tokens each."""
    return min(16, max(4, int(np.ceil(np.log2(max(1, tokens) / BUCKET)))))


def _short(tokens: np.ndarray, bits: int) -> np.ndarray:
    """What is kept of a token: its bucket and its last 48 bits."""
    return (tokens >> U(64 - bits) << U(48)) | (tokens & U((1 << 48) - 1))


def _send(n: int, percent: int, bits: int, classes: np.ndarray):
    """Map: text -> for each slice and bucket one row with the bucket's light tokens (48 bits each), set by
    set, and for each set one row (bucket -1) with its size, count vector and heavy tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of one task need their rows once; forgotten when large
        for batch in batches:
            for _, _, data, offs in slices(batch[0]):
                sets, ids = [], []
                for s in shingle_sets(data, offs, n):
                    if len(s) and (i := set_id(s)) not in seen:
                        seen.add(i)
                        sets.append(s)
                        ids.append(i)
                if len(seen) > 200_000:
                    seen.clear()
                if not sets:
                    continue
                size, sid = np.array([len(s) for s in sets]), np.array(ids, np.int64)
                token, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
                heavy = classes[(token >> U(64 - SKETCH_BITS)).astype(np.int64)] > 0
                few = np.bincount(row[heavy], minlength=len(sets))
                ends = np.cumsum(few)
                rest = token[heavy]
                vec = [np.bincount((s % U(GROUPS)).astype(np.int64), minlength=GROUPS).clip(max=FULL).astype(np.uint8).tobytes() for s in sets]
                none = pa.nulls(len(sets), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sets), -1, np.int32)), pa.array(sid), pa.array(size), pa.array(vec, pa.binary()), pa.array([rest[b - k : b].tobytes() for k, b in zip(few.tolist(), ends.tolist(), strict=True)], pa.binary()), none], _SENT)
                light, row = token[~heavy], row[~heavy]
                bucket = (light >> U(64 - bits)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                light, row, bucket = light[order], row[order], bucket[order]
                six = np.ascontiguousarray(light.view(np.uint8).reshape(-1, 8)[:, :6])
                head = np.ones(len(row), bool)  # a set's tokens in a bucket
                head[1:] = (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])
                at = np.flatnonzero(head)
                count = np.diff(np.append(at, len(row))).astype(np.uint32)
                group = np.append(np.flatnonzero(np.diff(bucket[at], prepend=-1)), len(at))
                for g, h in zip(group[:-1].tolist(), group[1:].tolist(), strict=True):
                    a, b = at[g], at[h] if h < len(at) else len(row)
                    cells = [pa.array([bucket[a]], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())]
                    cells += [pa.array([x.tobytes()], pa.binary()) for x in (six[a:b], sid[row[at[g:h]]], count[g:h])]
                    yield pa.RecordBatch.from_arrays(cells, _SENT)

    return run, "bucket int, sid long, n long, a binary, b binary, c binary"


_SENT = ["bucket", "sid", "n", "a", "b", "c"]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> for each set, its tokens in the bucket that other sets have too, and their
    frequencies; the sets' own rows pass."""
    from collections import deque

    own_rows: deque[pa.RecordBatch] = deque()

    def light() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = int((batch["bucket"].to_numpy() < 0).sum())
            if k:
                own_rows.append(batch.slice(0, k).select(["sid", "n", "a", "b"]))
            yield batch.slice(k)

    def passed() -> Iterator[pa.RecordBatch]:
        while own_rows:
            yield own_rows.popleft()

    for table in _groups(light(), ("bucket",)):
        yield from passed()
        buckets = table["bucket"].to_numpy()
        heads = np.append(np.flatnonzero(np.diff(buckets, prepend=-1)), len(buckets))
        for s, e in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            one = table.slice(s, e - s)
            six = np.frombuffer(b"".join(one["a"].to_pylist()), np.uint8).reshape(-1, 6)
            token = np.zeros((len(six), 8), np.uint8)
            token[:, :6] = six
            token = token.view(np.uint64).ravel()
            sid = np.frombuffer(b"".join(one["b"].to_pylist()), np.int64)
            count = np.frombuffer(b"".join(one["c"].to_pylist()), np.uint32)
            row = np.repeat(np.arange(len(sid), dtype=np.int32), count)
            order = np.argsort(token)
            token, row = token[order], row[order]
            same = np.zeros(len(token), bool)
            same[1:] = token[1:] == token[:-1]
            same[:-1] |= same[1:]
            token, own = token[same], sid[row[same]]
            order = np.lexsort((own, token))
            token, own = token[order], own[order]
            new = np.ones(len(token), bool)  # equal sets came from several tasks
            new[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
            token, own = token[new], own[new]
            head = np.ones(len(token), bool)
            head[1:] = token[1:] != token[:-1]
            df = np.diff(np.append(np.flatnonzero(head), len(token)))
            df = np.repeat(df, df)
            keep = df >= 2
            token, own, df = token[keep] | (U(int(buckets[s])) << U(48)), own[keep], df[keep].clip(max=65535).astype(np.uint16)
            order = np.argsort(own, kind="stable")
            token, own, df = token[order], own[order], df[order]
            at = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
            to = np.append(at[1:], len(own)) if len(own) else at
            for k in range(0, len(at), 20_000):
                cut = [(token[a:b].tobytes(), df[a:b].tobytes()) for a, b in zip(at[k : k + 20_000].tolist(), to[k : k + 20_000].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own[at[k : k + 20_000]]), pa.nulls(len(cut), pa.int64()), pa.array([x for x, _ in cut], pa.binary()), pa.array([y for _, y in cut], pa.binary())], ["sid", "n", "a", "b"])
    yield from passed()


def _prefixes(percent: int, bits: int, classes: np.ndarray, excess: np.ndarray):
    """Rows sorted by set (its own row, its shared light tokens from all buckets) -> the sets that have a
    shared token in their prefix: (set id, size, vector, all shared tokens, prefix tokens and their parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {k: [] for k in _OPEN}

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            batch = pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(_OPEN, kinds, strict=True)], _OPEN)
            for v in out.values():
                v.clear()
            return batch

        held = 0
        for table in _groups(batches, ("sid",)):
            sid, n = table["sid"].to_numpy(), table["n"].to_numpy(zero_copy_only=False)
            a, b = table["a"].to_pylist(), table["b"].to_pylist()
            heads = np.append(np.flatnonzero(np.append(True, sid[1:] != sid[:-1])), len(sid)).tolist()
            for s, e in zip(heads[:-1], heads[1:], strict=True):
                own = [k for k in range(s, e) if n[k] == n[k]]
                back = [k for k in range(s, e) if n[k] != n[k]]
                size, heavy = int(n[own[0]]), np.frombuffer(b[own[0]], np.uint64)
                light, p = size - len(heavy), prefix_length(size, percent)
                token = np.frombuffer(b"".join(a[k] for k in back), np.uint64)
                want = min(p, light) - (light - len(token))  # shared light tokens in the prefix
                if want <= 0 and p <= light:
                    continue
                df = np.frombuffer(b"".join(b[k] for k in back), np.uint16)
                first = token[np.lexsort((token, df))[: max(0, want)]]
                cell = (heavy >> U(64 - SKETCH_BITS)).astype(np.int64)
                order = np.argsort(classes[cell], kind="stable")[: max(0, p - light)]
                last = _short(heavy[order], bits)
                parts = 1 + excess[cell[order]] // (5 * HOT_LIST)
                part = (mix(np.full(1, sid[s], np.int64).view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
                every = np.sort(np.concatenate([token, _short(heavy, bits)]))
                row = (int(sid[s]), size, a[own[0]], every.tobytes(), signed(np.concatenate([first, last])).tolist(), [-1] * len(first) + np.where(parts > 1, part, -1).tolist())
                for k, v in zip(_OPEN, row, strict=True):
                    out[k].append(v)
                held += len(every)
                if held > 1 << 20:
                    yield flush()
                    held = 0
        if out["sid"]:
            yield flush()

    return run, "sid long, n long, vec binary, shared binary, tokens array<long>, parts array<long>"


_OPEN = ["sid", "n", "vec", "shared", "tokens", "parts"]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, part) -> lists of two sets or more: small ones as one array under a
    hash of their members, others set by set under their token.  Parts of split tokens always stay."""
    held: list[np.ndarray] = []

    def out(tok: np.ndarray, part: np.ndarray, sid: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((sid, part, tok))
        tok, part, sid = tok[order], part[order], sid[order]
        first = np.ones(len(tok), bool)
        first[1:] = (tok[1:] != tok[:-1]) | (part[1:] != part[:-1]) | (sid[1:] != sid[:-1])
        tok, part, sid = tok[first], part[first], sid[first]
        head = np.ones(len(tok), bool)
        head[1:] = (tok[1:] != tok[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, len(tok)))
        keep = (size >= 2) | (part[at] >= 0)
        small = keep & (size <= SMALL_LIST) & (part[at] < 0)
        names, members = [], []
        rows = np.repeat(small, size)
        key = mix(sid.view(np.uint64) ^ LANES[50])
        total = np.add.reduceat(key, at) if len(at) else key[:0]
        for width in np.unique(size[small]):
            pick = at[small & (size == width)]
            names.append(signed(mix(total[small & (size == width)])))
            members.append(sid[pick[:, None] + np.arange(width)])
        big = np.repeat(keep & ~small, size)
        del rows
        for nm, mem in zip(names, members, strict=True):
            nm, where = np.unique(nm, return_index=True)
            mem = mem[where]
            flat = pa.array(mem.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, mem.size + 1, mem.shape[1]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(nm), lists], ["list", "sids"])
        if big.any():
            one = pa.ListArray.from_arrays(pa.array(np.arange(int(big.sum()) + 1), pa.int32()), pa.array(sid[big]))
            yield pa.RecordBatch.from_arrays([pa.array(tok[big]), one], ["list", "sids"])

    # A run of equal (token, part) is never cut; memory follows one batch or the longest run.
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch[k].to_numpy(zero_copy_only=False) for k in ("token", "part", "sid")]
        if held:
            cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        cut = last[-1] + 1 if len(last) else 0
        held = [c[cut:] for c in cols]
        if cut:
            yield from out(*[c[:cut] for c in cols])
    if held and len(held[0]):
        yield from out(*held)


# -- the R-tree ----------------------------------------------------------------------------


class CountTree:
    """Packed R-tree over count vectors.  Points are ordered by set size and, within slabs of
    similar size, by their first counts; a node has coordinate maxima and the range of sizes."""

    def __init__(self, vec: np.ndarray, n: np.ndarray, percent: int):
        self.percent = percent
        m = len(n)
        slab = max(LEAF, int(np.ceil(np.sqrt(m * LEAF))))
        by_size = np.argsort(n, kind="stable")
        rank = np.empty(m, np.int64)
        rank[by_size] = np.arange(m)
        self.order = np.lexsort((vec[:, 1], vec[:, 0], rank // slab))
        self.vec, self.n = vec[self.order], n[self.order]
        self.levels = []
        top, lo, hi = self.vec, self.n, self.n
        while len(top) > LEAF:
            at = np.arange(0, len(top), LEAF)
            top, lo, hi = np.maximum.reduceat(top, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            self.levels.append((top, lo, hi))

    def _fits(self, at: np.ndarray, top: np.ndarray, lo: np.ndarray, hi: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = self.percent
        at = at[(100 * hi[at] >= p * n) & (100 * n >= p * lo[at])]
        bound = np.minimum(np.minimum(top[at], v).sum(axis=1), n).astype(np.int64)
        fits = bound >= need(n, lo[at], p)
        return at[fits], bound[fits]

    def query(self, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of all points whose bound allows a link with (v, n), and the Jaccard bounds."""
        at = None
        for top, lo, hi in reversed(self.levels):
            at = np.arange(len(lo)) if at is None else at[at < len(lo)]
            at, _ = self._fits(at, top, lo, hi, v, n)
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = np.arange(len(self.n)) if at is None else at[at < len(self.n)]
        at, bound = self._fits(at, self.vec, self.n, self.n, v, n)
        bound = np.minimum(bound, self.n[at])
        return self.order[at], bound / np.maximum(1, n + self.n[at] - bound)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Batches sorted by keys, cut into whole groups, many a table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        differs = np.zeros(batch.num_rows, bool)
        for c in cols:
            differs |= c != c[-1]
        last = np.flatnonzero(differs)
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut == 0 and held:
            tail = held[-1]
            if all(tail[k][-1].as_py() == batch[k][0].as_py() for k in keys):
                held.append(batch)
                continue
        if cut == 0 and not held:
            held.append(batch)
            continue
        if cut == 0:
            yield pa.Table.from_batches(held)
            held = [batch]
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _pairs(percent: int, kind: str, turn: int = 0):
    """Map over rows sorted by (list, sub): pairs of different components that the R-tree can't rule
    out.  all: all of them.  stars: sets in an order that each turn draws anew, each with the
    first one before it that it may link with.  nearest: each set outside the largest component with
    the NEAREST ones of highest bounds.  A list with any such pair yields one at least.
    Rows are pairs (without a list) and, but for all, the lists that have any (without a pair)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # pairs that many lists share leave a task once; forgotten when large
        for table in _groups(batches, ("list", "sub")):
            key = [table[k].to_numpy() for k in ("list", "sub")]
            sid, n = table["sid"].to_numpy(), table["n"].to_numpy()
            comp = table["comp"].to_numpy()
            vec = np.frombuffer(b"".join(table["vec"].to_pylist()), np.uint8).reshape(-1, GROUPS).astype(np.uint32)
            vec[vec == FULL] = ANY
            head = np.ones(len(sid), bool)
            head[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])
            at = np.append(np.flatnonzero(head), len(sid))
            left, right = [sid[:0]], [sid[:0]]  # rows of the table
            size = np.diff(at)
            two = at[:-1][size == 2]
            if len(two):  # the commonest lists, all at once
                a, b = two, two + 1
                ok = (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (np.minimum(vec[a], vec[b]).sum(axis=1) >= need(n[a], n[b], percent))
                ok &= comp[a] != comp[b]
                left.append(a[ok])
                right.append(b[ok])
            for s, e in zip(at[:-1][size > 2].tolist(), at[1:][size > 2].tolist(), strict=True):
                drawn = mix(sid[s:e].view(np.uint64) ^ LANES[turn]) if turn else sid[s:e]
                order = s + np.argsort(drawn, kind="stable")
                tree = CountTree(vec[order], n[order], percent)
                c = comp[order]
                free = np.ones(len(order), bool)
                if kind == "nearest":
                    of, counts = np.unique(c, return_counts=True)
                    free = c != of[counts.argmax()]
                for j in range(len(order)):
                    if kind == "all" or free[j]:
                        hit, bound = tree.query(vec[order[j]], n[order[j]])
                        fits = c[hit] != c[j]
                        if kind == "nearest":
                            hit, bound = hit[fits], bound[fits]
                            hit = hit[np.argsort(-bound, kind="stable")[:NEAREST]]
                        elif kind == "stars":
                            hit = hit[fits & free[hit] & (hit > j)]
                            free[hit] = False
                        else:
                            hit = hit[fits & (hit < j)]
                        left.append(np.full(len(hit), order[j]))
                        right.append(order[hit])
            i, j = np.concatenate(left), np.concatenate(right)
            i, j = np.where(sid[i] < sid[j], i, j), np.where(sid[i] < sid[j], j, i)
            lo, hi = sid[i], sid[j]
            if kind != "all" and len(lo):
                lists = pa.array(np.unique(key[0][i]))
                none = pa.nulls(len(lists), pa.int64())
                yield pa.RecordBatch.from_arrays([lists, none, none, none, none], ["list", "a", "b", "u", "v"])
            new = []
            for k, pair in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
                if pair not in seen:
                    seen.add(pair)
                    new.append(k)
            if new:
                none = pa.nulls(len(new), pa.int64())
                yield pa.RecordBatch.from_arrays([none, *[pa.array(x[new]) for x in (lo, hi, comp[i], comp[j])]], ["list", "a", "b", "u", "v"])
            if len(seen) > 200_000:
                seen.clear()

    return run, "list long, a long, b long, u long, v long"


# -- verification --------------------------------------------------------------------------


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y, nx, ny in zip(batch["x"], batch["y"], batch["nx"].to_pylist(), batch["ny"].to_pylist(), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                o = int((large[at] == small).sum()) if len(large) else 0
                good.append(100 * o >= percent * (nx + ny - o))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run, "u long, v long"


def ngram_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """(id, n_shingles, component_id, n_copies) for each row: its set size, the smallest id it is
    connected with by links (Jaccard of n-gram sets >= percent/100), and the rows with the same set."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ngram")
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))

    run, schema = _profile(n)
    profile = scratch.cut(source.mapInArrow(run, schema), "profile")
    blocks = profile.where("n = -1").groupBy("sid").applyInArrow(_sum_cells, "sid long, cells binary").collect()  # at most 2**SKETCH_BITS counts
    cells = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in blocks:
        cells[r.sid : r.sid + _BLOCK] = np.frombuffer(r.cells, np.int64)
    excess = np.maximum(0, cells - 4 * int(cells.mean() + 1))
    classes = np.where(excess > 0, np.frexp(excess.astype(float))[1], 0).astype(np.int16)

    rows = profile.where("n >= 0").select("doc", "sid", "n")
    classed = scratch.cut(rows.where("n > 0 AND doc IS NOT NULL").groupBy("sid").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")), "classed")

    bits = bucket_bits(int(cells.sum()))
    run, schema = _send(n, percent, bits, classes)
    sent = source.where("doc IS NOT NULL").select("text").mapInArrow(run, schema).repartition("bucket", "sid").sortWithinPartitions("bucket")
    shared = sent.mapInArrow(_shared, "sid long, n long, a binary, b binary").repartition("sid").sortWithinPartitions("sid")
    run, schema = _prefixes(percent, bits, classes, excess)
    near = scratch.cut(shared.mapInArrow(run, schema), "near")
    points = near.select("sid", "n", "vec")
    met = near.select("sid", F.explode(F.arrays_zip("tokens", "parts")).alias("t")).select(F.col("t.tokens").alias("token"), F.col("t.parts").alias("part"), "sid")
    met = met.repartition("token", "part").sortWithinPartitions("token", "part")
    lists = met.mapInArrow(_lists, "list long, sids array<long>")
    lists = scratch.cut(lists, "lists")
    small = lists.where("size(sids) > 1").dropDuplicates(["list"])
    members = small.union(lists.where("size(sids) = 1")).select("list", F.explode("sids").alias("sid"))
    members = scratch.cut(members, "members")
    scratch.release(lists)

    def split(rows: DataFrame, everywhere) -> DataFrame:
        """Adds `sub`: 0 for lists of up to HOT_LIST sets; else a part by hash, and all parts where `everywhere`."""
        hot = members.groupBy("list").agg(F.count("*").alias("m"), F.min("sid").alias("hub")).where(f"m > {HOT_LIST}")
        rows = rows.join(hot, "list", "left").withColumn("k", F.coalesce(F.ceil(F.col("m") / HOT_LIST), F.lit(1)).cast("int"))
        own = F.array(F.pmod(F.xxhash64("sid"), F.col("k")).cast("int"))
        subs = F.when(F.col("k") == 1, F.array(F.lit(0))).when(everywhere, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(own)
        return rows.withColumn("sub", F.explode(subs))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b) the ends (u, v), components so far, of those that link."""
        of = lambda sid, n, blob: near.select(F.col("sid").alias(sid), F.col("n").alias(n), F.col("shared").alias(blob))
        both = pairs.join(of("b", "ny", "y"), "b").join(of("a", "nx", "x"), "a")
        run, schema = _verify(percent)
        return scratch.cut(both.select("u", "v", "nx", "ny", "x", "y").mapInArrow(run, schema), "links")

    def grouped(rows: DataFrame, kind: str, turn: int = 0) -> DataFrame:
        run, schema = _pairs(percent, kind, turn)
        rows = rows.select("list", "sub", "sid", "n", "vec", "comp").repartition("list", "sub").sortWithinPartitions("list", "sub")
        return scratch.cut(rows.mapInArrow(run, schema), "pairs")

    hot = members.groupBy("list").agg(F.count("*").alias("m")).where(f"m > {HOT_LIST}").select("list")
    known, tried, merged = members.withColumn("comp", F.col("sid")), None, []
    for turn, kind in enumerate(TURNS):
        if known.isEmpty():  # no list has sets of two components any more
            break
        # A list without a pair in one turn has none in the next; those that are split stay to the end.
        got = grouped(split(known.join(points, "sid"), F.col("sid") == F.col("hub")), kind, turn)
        fresh = got.where("a IS NOT NULL").select("a", "b", "u", "v").distinct()
        fresh = scratch.cut(fresh if tried is None else fresh.join(tried, ["a", "b"], "left_anti"), "fresh")
        tried = fresh.select("a", "b") if tried is None else tried.union(fresh.select("a", "b"))
        # Each turn works on the graph whose nodes are the components of the turn before.
        merged.append(scratch.cut(components(verified(fresh), scratch).withColumnRenamed("node", "comp"), "merged"))
        live = known.join(got.where("list IS NOT NULL").select("list").union(hot).distinct(), "list")
        # Written before it is grouped, so the counts of a hot list are put together from all tasks that have its rows.
        named = scratch.cut(live.join(merged[-1], "comp", "left").select("list", "sid", F.coalesce("component", "comp").alias("comp")), "open")
        mixed = named.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("list")
        known = named.join(mixed, "list")
    if not known.isEmpty():
        size = known.groupBy("list", "comp").agg(F.count("*").alias("c"))
        main = size.groupBy("list").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
        rest = grouped(split(known.join(main, "list").join(points, "sid"), F.col("comp") != F.col("main")), "all")
        rest = rest.select("a", "b", "u", "v").distinct().join(tried, ["a", "b"], "left_anti")
        more = verified(scratch.cut(rest, "rest"))
        merged.append(scratch.cut(components(more, scratch).withColumnRenamed("node", "comp"), "merged"))

    named = classed.withColumn("comp", F.col("sid"))
    for names in merged:
        named = named.join(names, "comp", "left").select("sid", "rep", "copies", F.coalesce("component", "comp").alias("comp"))
    named = scratch.cut(named, "named")
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count("*").alias("c")).where("c > 1").drop("c")
    classed = named.join(least, "comp", "left").select("sid", "copies", F.coalesce("component_id", "rep").alias("component_id"))
    classed = scratch.cut(classed, "classes")
    out = rows.join(classed, "sid", "left")
    own = F.when(F.col("doc").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc")).otherwise(F.col("component_id"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), own.cast("long").alias("component_id"), F.coalesce("copies", F.lit(1)).alias("n_copies"))


def ngram_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id (ids that are no numbers
    follow, null ids come last); of rows that repeat it, one.  Rows are told apart by a number of their
    own, so rows with a null id and rows that share an id but not a text count like any others.  Rows
    without words all stay."""
    scratch, inner = Scratch(docs.sparkSession, "dedup"), Scratch(docs.sparkSession, "ngram")
    row = hidden("row", docs)
    numbered = scratch.cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    got = ngram_classes(numbered, row, text_col, n, percent, inner).select(row, "component_id")
    number = F.col(id_col).try_cast("long")
    rank = F.struct(number.isNull().alias("a"), number.alias("b"), F.col(id_col).isNull().alias("c"), F.col(id_col).alias("d"), F.col(row).alias("row")).alias("rank")
    ranked = scratch.cut(numbered.select(row, rank).join(got, row), "ranked")
    inner.clear()
    stays = ranked.groupBy("component_id").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias(row))
    gone = scratch.cut(ranked.select(row).join(stays, row, "left_anti"), "gone")
    scratch.release(ranked)
    return numbered.join(gone, row, "left_anti").drop(row)


_W = r"[^\x20\x09-\x0D]+"


def sql(n: int = 4, percent: int = 85) -> str:
    """The same classes in SQL, from shared n-grams and a recursive closure (for small inputs)."""
    gram = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(n))
    return rf"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) >= {n} THEN list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: {gram}))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM t
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS k FROM s),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.k = b.k AND a.doc_id != b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
z AS (SELECT g, count(*) AS k FROM (SELECT list_sort(g) AS g FROM s WHERE len(g) > 0) GROUP BY g)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CAST(c.component_id AS BIGINT) AS component_id, CAST(coalesce(z.k, 1) AS BIGINT) AS n_copies
FROM s JOIN c ON s.doc_id = c.a LEFT JOIN z ON list_sort(s.g) = z.g
"""
