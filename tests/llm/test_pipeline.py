"""The pipeline's rows against a plain Python version of its five stages, on a small table with repeated rows, null
ids and texts, near copies, shared passages and personal data."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from meshloom.llm import pseudonyms

from test_llm import CARD, SSN, W, brute_pseudonym, shingles

KEY = "pipeline key"
PRIVATE = (("card", CARD), ("ssn", SSN), ("email", "jo.doe7@ex.com"), ("date", "2024-03-01"), ("ipv4", "10.0.0.9"))


def table():
    rng = np.random.default_rng(12)
    vocab = ["".join(rng.choice(list("abcdefgéß"), int(rng.integers(3, 8)))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocab, n))
    a, b, c = prose(150), prose(90), prose(300)
    short, long = prose(52), prose(70)  # passages of over 50 words
    docs = [(1, a), (1, a), (2, a + " end"), (None, a), (3, b), (4, b.upper()), (5, c), (6, c[: len(c) // 2]), (None, None), (7, ""), (8, "too short")]
    docs += [(9, prose(60) + " " + short + " " + prose(55)), (10, prose(80) + " " + short), (11, short + "\n" + prose(70) + " " + long), (12, long + " " + prose(100))]
    docs += [(13, prose(60) + " " + " ".join(v for _, v in PRIVATE) + " " + prose(20)), (14, prose(70) + " write " + PRIVATE[2][1])]
    docs += [(15, "buy now " * 60), (16, prose(60).replace(" ", " # ")), (17, prose(60).upper().translate(str.maketrans("éß", "EE"))), (18, ("same line of words here\n") * 20 + prose(60)), (19, prose(2000))]
    docs += [(20 + k, prose(int(n))) for k, n in enumerate(rng.integers(50, 140, 6))]
    return [(i, t, "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(docs)]


def kept_by_rules(t):
    w = W.findall(t or "")
    n = len(w)
    win = Counter(tuple(w[k : k + 3]) for k in range(n - 2))
    repeat = len({k + d for k in range(n - 2) if win[tuple(w[k : k + 3])] > 1 for d in range(3)})
    lines = [x for x in (t or "").split("\n") if W.search(x)]
    chars = sum(map(len, w))
    count = lambda p: len(re.findall(p, t or ""))
    solid, wordy = (len("".join(re.findall(p, t or "")).encode()) for p in (r"[^\x20\x09-\x0D]", r"[A-Za-z\x80-\U0010FFFF]"))
    return (
        n >= 1 and 100 * repeat <= 30 * n and 2 * n <= chars <= 15 * n and 10 * count(r"[#*$%&|<>]") <= n and 10 * (len(lines) - len(set(lines))) <= 3 * len(lines)
        and 2 * count("[A-Z]") <= count("[A-Za-z]") and 10 * count("!") <= n and 10 * wordy >= 6 * solid
    )


def without_near_copies(rows):
    sets = [shingles(r[1], 5) for r in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        for i, j in combinations(range(len(rows)), 2):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                comp[i] = comp[j] = min(comp[i], comp[j])
    best = {}
    for k, r in enumerate(rows):
        rank = (r[0] is None, r[0] or 0)
        if comp[k] not in best or rank < best[comp[k]][0]:
            best[comp[k]] = (rank, r)
    return [r for _, r in best.values()]


def without_passages(rows, length):
    raws = [r[1].encode() for r in rows]
    seen = Counter(x[s : s + length] for x in raws for s in range(len(x) - length + 1))
    out = []
    for r, x in zip(rows, raws):
        gone = bytearray(len(x) + 1)
        for s in range(len(x) - length + 1):
            if seen[x[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        text, at = "", 0
        for ch in r[1]:  # a character that is partly covered stays
            n = len(ch.encode())
            text += "" if all(gone[at : at + n]) else ch
            at += n
        out.append((r[0], text, *r[2:]))
    return out


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(table(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.conf.set(pseudonyms.KEY_SETTING, KEY)
    try:
        docs, stages = spark.read.parquet(f"{folder}/documents.parquet"), {}
        for name, f in corpus_pipeline.STAGES[:-1]:
            path = f"{folder}/{name}"
            f(spark, docs, folder).write.parquet(path)
            docs = spark.read.parquet(path)
            stages[name] = (docs.columns, [tuple(r) for r in docs.collect()])
        return stages, corpus_pipeline.run(spark, folder).collect()
    finally:
        spark.conf.unset(pseudonyms.KEY_SETTING)


def test_each_stage_matches_plain_python(result):
    stages, packed = result
    rows = table()
    assert all(columns == ["doc_id", "text", "lang", "source", "n_chars"] for columns, _ in stages.values())
    rows = [r for r in rows if kept_by_rules(r[1])]
    assert Counter(stages["quality"][1]) == Counter(rows) and 8 < len(rows) <= len(table()) - 6
    rows = without_near_copies(rows)
    key = lambda r: r[:3]  # noqa: E731  rows that are equal but for their source stand for each other
    assert Counter(map(key, stages["near_duplicates"][1])) == Counter(map(key, rows)) and {r[0] for r in rows} >= {1, 3, 5, 6, 8}
    rows = without_passages(rows, corpus_pipeline.PASSAGE)
    assert Counter(map(key, stages["repeated_passages"][1])) == Counter(map(key, rows))
    texts = {r[0]: r[1] for r in rows}
    assert len(W.findall(texts[9])) <= 117 and len(W.findall(texts[12])) <= 103  # the passages are gone
    new = {v: brute_pseudonym(k, v, KEY) for k, v in PRIVATE}
    rows = [(r[0], re.sub("|".join(map(re.escape, new)), lambda m: new[m[0]], r[1]), *r[2:]) for r in rows]
    assert Counter(map(key, stages["personal_data"][1])) == Counter(map(key, rows))
    sizes = sorted(len(W.findall(r[1])) for r in rows)
    lengths = sorted(set(sizes))
    pad = lambda bounds: sum(min(x for x in bounds if x >= n) - n for n in sizes)
    assert Counter((r.doc_id, r.n_tokens) for r in packed) == Counter((r[0], len(W.findall(r[1]))) for r in rows)
    assert all(r.bucket_len - r.n_tokens == r.n_pad >= 0 for r in packed) and {r.bucket_len for r in packed} <= set(lengths)
    assert sum(r.n_pad for r in packed) == min(pad([*c, lengths[-1]]) for c in combinations(lengths[:-1], 7))
    slots = Counter((r.bucket, r.batch) for r in packed)
    assert len({(r.bucket, r.batch, r.slot) for r in packed}) == len(packed)
    assert all(n * next(r.bucket_len for r in packed if r.bucket == b) <= 16384 for (b, _), n in slots.items())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
