"""Importance resampling, filter audits and source mixing against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import fixtures as fx
from tomewright.llm import audit, importance, mixing
from tomewright.llm.common import looked_up

ROWS = fx.documents()
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, fx.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], fx.SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, a long text and columns with names used inside."""
    text, long = ROWS[3][1], fx.words(random.Random(9), 300_000)
    rows = [(1, text), (1, text), (2, None), (None, text), (None, None), (3, text + " more"), (4, ""), (5, long)]
    return spark.createDataFrame([(i, t, 7, *["z"] * 9) for i, t in rows], fx.CLASHING)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(40)] + [(5, None, None), (5, 1, 1), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# op11


def features(text, n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def drawn(rows, target, n, buckets, percent, least, seed):
    """(doc_id, n_features, weight, score, rank) of each row, from written-out n-grams."""
    at = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(at(x) for text in texts for x in features(text, n)[1]) for texts in ([r[1] for r in rows], target))
    alls, allt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (alls + buckets) / ((s[b] + 1) * (allt + buckets))))
    out = []
    for i, text in rows:
        words, f = features(text, n)
        weight = sum(gain(at(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, words])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


@given(st.lists(st.binary(min_size=0, max_size=90), min_size=1, max_size=8), st.integers(0, 70))
@settings(max_examples=60, deadline=None)
def test_crcs_combine(parts, zeros):
    crc = np.array([zlib.crc32(p) for p in parts], np.uint32)
    whole = crc[0]
    for p, c in zip(parts[1:], crc[1:], strict=True):
        whole = importance.followed(np.array([whole]), np.array([len(p)]))[0] ^ c
    assert int(whole) == zlib.crc32(b"".join(parts))
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    assert importance.word_crcs(data, ends - [len(p) for p in parts], ends).tolist() == crc.tolist()


@given(st.lists(st.text(alphabet="aBc1 ,é\n語z", max_size=40), min_size=1, max_size=6), st.integers(1, 4))
@settings(max_examples=80, deadline=None)
def test_grams_of_texts(texts, n):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    got = Counter((int(t), int(c)) for text, crc in importance.gram_crcs(importance.LOWER[np.frombuffer(b"".join(raw), np.uint8)], offsets, n) for t, c in zip(text, crc, strict=True))
    assert got == Counter((i, zlib.crc32(x.encode())) for i, t in enumerate(texts) for x in features(t, n)[1])


@pytest.mark.parametrize(("n", "buckets", "percent"), [(1, 10_000, 10), (3, 97, 50)])
def test_importance(spark, docs, n, buckets, percent):
    target = [ROWS[3][1], ROWS[5][1], None, "ééé one"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.importance(docs, frame, n, buckets, percent, min_words=20, seed=7)
    want = drawn([r[:2] for r in ROWS], target, n, buckets, percent, 20, 7)
    assert Counter(tuple(r) for r in got.drop("n_words").collect()) == want
    kept = {i for (i, *_, rank) in want if rank}
    again = importance.resampled(docs, frame, n, buckets, percent, min_words=20, seed=7)
    assert again.columns == docs.columns and {r.doc_id for r in again.collect()} == kept


def test_importance_odd_rows(spark, odd, empty, docs):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = importance.importance(odd, docs, 2, 100, 60, min_words=1)
    assert Counter(tuple(r) for r in got.drop("n_words").collect()) == drawn(rows, [r[1] for r in ROWS], 2, 100, 60, 1, 2024)
    again = importance.resampled(odd, docs, 2, 100, 60, min_words=1)
    assert again.columns == odd.columns and again.count() >= 3
    assert importance.importance(empty, docs).collect() == [] and importance.resampled(empty, docs).collect() == []
    assert importance.importance(docs, empty).count() == len(ROWS)
    assert importance.importance(docs.repartition(1), empty).exceptAll(importance.importance(docs.repartition(5), empty)).count() == 0


# op12


def failures(rows):
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, part in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t],
        }
        yield i, part or "", {f for f, x in fails.items() if x}


def audited(rows, good, toxic):
    """Every order run over every row."""
    seen = list(failures(rows))
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in seen}:
        here = [(i, fails) for i, p, fails in seen if p == part]
        for order in itertools.permutations("ABCDE"):
            left = here
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = sum(f in fails for _, fails in here)
                shapley[part, f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), failing - len(gone), sum(fails == {f} for _, fails in here), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark, labels):
    rng = random.Random(2)
    texts = [fx.words(rng, rng.randint(30, 70)) + rng.choice(["", " #", " A", " " + "the " * 40]) for _ in range(30)]
    rows = [(i, rng.choice([*texts, None, "", "  "]), rng.choice(["a", "b", None, ""])) for i in range(60)]
    rows += [(3, texts[0], "a"), (3, texts[0], "a"), (None, texts[1], "b"), (61, texts[1].upper(), "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    good = {i for i in range(40) if i % 4}
    toxic = {i for i in range(40) if i % 5 == 0}
    got = [tuple(r) for r in audit.audit_filters(df, labels).collect()]
    assert len(got) == len(set(got)) and set(got) == audited(rows, good, toxic)


def test_audit_of_a_hot_text(spark, labels, monkeypatch):
    """One text and one id in most rows, looked up by broadcast."""
    monkeypatch.setattr("tomewright.operators.shared.OFTEN", 2)
    rows = [(i % 7 if i % 2 else i, "same text " * 30 if i % 3 else f"text {i}", "p") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = {tuple(r) for r in audit.audit_filters(df, labels).collect()}
    assert got == audited(rows, {i for i in range(40) if i % 4}, {i for i in range(40) if i % 5 == 0})


def test_audit_odd_rows(odd, empty, labels):
    got = audit.audit_filters(odd, labels, part_col="part").collect()
    rows = [(r.doc_id, r.text, "z") for r in odd.select("doc_id", "text").collect()]
    assert {tuple(r) for r in got} == audited(rows, {1, 2, 3, 5}, {5})
    assert audit.audit_filters(empty, labels).collect() == []
    assert audit.audit_filters(odd, labels.limit(0), part_col="part").count() == 600


def test_looked_up_is_a_left_join(spark):
    df = spark.createDataFrame([(i % 3 if i % 5 else None, i) for i in range(50)], "k long, x long")
    table = spark.createDataFrame([(0, "a"), (2, "c"), (9, "z")], "k long, y string")
    want = sorted(map(str, df.join(table, "k", "left").select("k", "x", "y").collect()))
    for parts in (1, 1000):
        assert sorted(map(str, looked_up(df, "k", table, 50, parts).collect())) == want


# op13


def least_cost(words, members, quotas, copies):
    """(words sent, cost) of the best routing, trying every one; costs of copies 1, 2, .."""
    best = (0, 0)
    arcs = [(p, s) for p, m in enumerate(members) for s in m]
    for x in itertools.product(*[range(min(copies * words[p], quotas[s]) + 1) for p, s in arcs]):
        given = [sum(f for f, (p, _) in zip(x, arcs, strict=True) if p == k) for k in range(len(words))]
        taken = [sum(f for f, (_, s) in zip(x, arcs, strict=True) if s == k) for k in range(len(quotas))]
        if all(g <= copies * w for g, w in zip(given, words, strict=True)) and all(t <= q for t, q in zip(taken, quotas, strict=True)):
            cost = sum(sum(k * min(w, max(0, g - (k - 1) * w)) for k in range(1, copies + 1)) for g, w in zip(given, words, strict=True))
            best = max(best, (sum(x), -cost))
    return best


@given(st.lists(st.integers(0, 4), min_size=2, max_size=3), st.lists(st.integers(0, 5), min_size=2, max_size=2), st.integers(0, 26))
@settings(max_examples=60, deadline=None)
def test_cheapest_flow(words, quotas, kind):
    members = [[[0], [1], [0, 1]][kind // 3**p % 3] for p in range(len(words))]
    flow = mixing.cheapest_flow(words, members, quotas, 2)
    given = [sum(f for (p, _), f in flow.items() if p == k) for k in range(len(words))]
    assert all(0 <= g <= 2 * w for g, w in zip(given, words, strict=True))
    assert all(sum(f for (_, s), f in flow.items() if s == k) <= q for k, q in enumerate(quotas))
    cost = sum(min(g, w) + 2 * max(0, g - w) for g, w in zip(given, words, strict=True))
    assert (sum(given), -cost) == least_cost(words, members, quotas, 2)


def targets(sizes, percent=150, copies=2, weights=(3, 1, 2)):
    """The shares given out anew until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = percent * total / 100 - sum(copies * sizes[s] for s in full)
        open_ = sum(w[s] for s in names if s not in full)
        share = {s: copies * sizes[s] if s in full else w[s] * left / open_ for s in names}
        new = {s for s in names if s not in full and share[s] >= copies * sizes[s]}
        if not new:
            return share
        full |= new


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, fx.words(rng, rng.randint(1, 60)), rng.choices(["b", "a", None, "", "é", "Z"], [1, 8, 2, 2, 3, 1])[0]) for i in range(200)]
    rows += [(7, rows[7][1], "a"), (7, rows[7][1], "a"), (None, "one two three", "a"), (300, None, "a"), (301, "", "only empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.mix_sources(df)
    got = out.collect()
    sizes, taken, partly = Counter(), Counter(), Counter()
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    want = targets(sizes)
    for r in got:
        (share,) = r.shares
        assert 0 <= r.taken <= 2 * r["size"]
        assert share.source_size == sizes[share.source] and abs(share.target - want[share.source]) < 1e-6
        taken[share.source] += r.taken
        partly[share.source] += r["size"] > 0 and r.taken % r["size"] > 0
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes) and max(partly.values()) <= 1
    assert out.exceptAll(mixing.mix_sources(df.repartition(2))).count() == 0
    other = mixing.mix_sources(df, seed=5)
    assert out.exceptAll(other).count() > 0


def test_mixing_of_overlapping_sources(spark):
    """What is in both sources serves the one that would have to repeat its own."""
    rows = [(i, "w " * 10, [["a"], ["b"], ["a", "b"], ["c"]][k]) for k, n in enumerate((2, 20, 10, 3)) for i in range(100 * k, 100 * k + n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    got = mixing.mix_sources(df, F.col("sources"), weights=(3, 3, 1), percent=60).collect()
    flow = {(r.pattern, s.source): (s.flow, s.target) for r in got for s in r.shares}
    assert flow['["c"]', "c"] == (30, 30.0)
    assert flow['["a"]', "a"][0] + flow['["a","b"]', "a"][0] == 90 and flow['["b"]', "b"][0] + flow['["a","b"]', "b"][0] == 90
    assert max(r.taken for r in got) == 10  # nothing twice
    assert sum(r.taken for r in got) == 210


def test_mixing_odd_rows(odd, empty, spark):
    assert mixing.mix_sources(empty).collect() == []
    got = mixing.mix_sources(odd, F.col("part")).collect()
    assert len(got) == 8 and sum(r.taken for r in got) == round(1.5 * sum(r["size"] for r in got))
    nothing = spark.createDataFrame([(1, None, [None, "a"]), (2, "", []), (3, " ", None)], "doc_id long, text string, s array<string>")
    assert [(r["size"], r.taken) for r in mixing.mix_sources(nothing, F.col("s")).collect()] == [(0, 0)] * 3


def test_many_sources_are_numbered(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.concat(F.lit("s"), F.col("id") % 90).alias("source"))
    got = mixing.mix_sources(df).collect()
    want = targets(Counter({f"s{k}": 4 * len(range(k, 500, 90)) for k in range(90)}))
    assert all(abs(r.shares[0].target - want[r.shares[0].source]) < 1e-6 for r in got)
