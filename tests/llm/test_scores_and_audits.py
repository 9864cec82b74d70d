"""Hard negatives, language-model scores and the filter audit: brute force, and rows that are odd in some way."""
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tubelens.llm import filter_audit, kernels, lm, negatives

DOCS = "doc_id long, text string, lang string, source string, n_chars long, p double, key string"


# ---------------------------------------------------------------- language model
def _tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def kneser_ney(train, texts):
    pairs = Counter()
    for t in train:
        for u, w in itertools.pairwise(["<s>", *_tokens(t)]):
            pairs[u, w] += 1
    count, before, total, seen = Counter(), Counter(), Counter(), defaultdict(lambda: [0, 0, 0])
    for (u, w), k in pairs.items():
        count[w] += k
        before[w] += 1
        total[u] += k
        seen[u][min(k, 3) - 1] += 1
    n, v = sum(count.values()), len(count)
    of = lambda c: lm.discounts(*[Counter(c.values())[i] for i in (1, 2, 3, 4)])
    d2, d1 = of(pairs), of(before)
    m = Counter(min(x, 3) for x in before.values())
    over = sum(d * m[i] for i, d in enumerate(d1, 1)) / len(pairs) if pairs else 1.0

    def low(w):
        return ((before[w] - d1[min(before[w], 3) - 1]) / len(pairs) if before[w] else 0.0) + over / (v + 1)

    def prob(u, w):
        if not total[u]:
            return low(w)
        k = pairs[u, w]
        return (k - d2[min(k, 3) - 1] if k else 0.0) / total[u] + sum(a * b for a, b in zip(d2, seen[u])) / total[u] * low(w)

    out = []
    for t in texts:
        toks = _tokens(t)
        out.append((len(toks), sum(count[w] > 0 for w in toks), sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks),
                    sum(math.log10(prob(u, w)) for u, w in itertools.pairwise(["<s>", *toks]))))
    vocab = sum(prob("the", w) for w in count) + prob("the", "never seen")
    return out, n, vocab


def odd_texts():
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdé", k=r.randint(1, 3)))
    return [None, "", "  \t\n", "the", "The THE the", "the\x0bend\x0cthe", " one word", "the " * 50, " ".join(word() for _ in range(4000)),
            *[" ".join(r.choice(["the", word(), word()]) for _ in range(r.randint(1, 60))) for _ in range(60)]]


def test_lm_matches_brute_force(spark, monkeypatch):
    texts = odd_texts()
    rows = [(i if i % 9 else None, t, "x", "s", 0, 0.0, "k") for i, t in enumerate(texts)] + [(5, "the the end", "x", "s", 0, 0.0, "k")] * 2
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    train = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1]
    want, n, whole = kneser_ney([r[1] for r in train], [r[1] for r in rows])
    assert whole == pytest.approx(1.0)
    for piece, flush, hot in ((kernels.CHUNK_BYTES, lm.FLUSH, None), (64, 500, 10)):
        if hot:  # small pieces cut long texts, small blocks send many blobs, the commonest words are dealt by the pair
            monkeypatch.setattr(lm.tokens, "__defaults__", (piece,))
            common = [w.hash[0] for w in (kernels.Words(np.frombuffer(b"the", np.uint8), np.array([0, 3])),)]
            monkeypatch.setattr(lm, "_common_words", lambda d: (1000, np.array(common, dtype=np.uint64)))
        model = lm.train(docs.where(~lm.held_out("doc_id")), flush=flush, shard_tokens=100 if hot else lm.SHARD_TOKENS)
        got = lm.score(docs, model).collect()
        assert model.n_tokens == n and len(got) == len(rows)
        key = lambda x: (x[0], x[1], round(x[2], 6), round(x[3], 6))
        assert sorted(key((g.n_tokens, g.n_known, g.base_score, g.score)) for g in got) == sorted(map(key, want))


def test_lm_without_rows(spark):
    none = spark.createDataFrame([], DOCS)
    one = spark.createDataFrame([(1, "some words", "x", "s", 0, 0.0, "k")], DOCS)
    model = lm.train(none)
    assert lm.score(none, model).count() == 0
    r = lm.score(one, model).first()
    assert (r.n_tokens, r.n_known, r.base_score, r.score) == (3, 0, 0.0, 0.0)


def test_lm_refuses_a_folder_that_workers_cannot_map():
    with pytest.raises(ValueError):
        lm.local_folder("hdfs://host/checkpoints")


# ---------------------------------------------------------------- hard negatives
def mined(rows, every=10, positives=5, k=10):
    part = {}
    for i, lab, v in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= 65536 for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        raw = np.array(q, dtype="<i4").tobytes()
        if i not in part or (lab, raw) < part[i][2:]:
            part[i] = (i, q, lab, raw)
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, q, lab, _ in part.values():
        if i % every:
            continue
        s = sorted((-score(q, v), j, other == lab) for j, v, other, _ in part.values() if j != i)
        for p, j, _ in [x for x in s if x[2]][:positives]:
            ok = [x for x in s if not x[2] and 30 * -p <= 100 * -x[0] <= 90 * -p][:k]
            out += [(i, j, r, m, -p, -n) for r, (n, m, _) in enumerate(ok, 1)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["clusters", "ties", "lengths", "odd"])
def test_negatives_match_brute_force(spark, monkeypatch, shape):
    g = np.random.default_rng(5)
    n, d = 400, 6
    v = g.normal(size=(n, d)) * 0.3
    labels = g.integers(0, 3, n)
    if shape == "clusters":  # near the centres ranges are narrow
        v = g.normal(size=(8, d))[g.integers(0, 8, n)] + g.normal(size=(n, d)) * 0.05
    if shape == "ties":  # a third of all rows share one vector; few values elsewhere
        v = np.round(v)
        v[: n // 3] = 0.5
    if shape == "lengths":
        v *= np.exp(g.normal(size=(n, 1)) * 2)
    rows = [(i, int(x), [float(np.float32(y)) for y in vec]) for i, (x, vec) in enumerate(zip(labels, v))]
    if shape == "odd":
        rows += [(None, 1, [0.1] * d), (1001, None, [0.1] * d), (1002, 1, None), (1003, 1, [0.1, None]), (1004, 1, [float("nan")] * d),
                 (1005, 2, [float("inf")] * d), (1006, 2, [1e30] * d), (1010, 1, []), (1020, 2, [0.7]), (1030, 7, [0.3] * (d + 2)), (20, 0, [9.0] * d)]
    monkeypatch.setattr(negatives.buckets, "__defaults__", (16,))
    monkeypatch.setattr(negatives, "LANE", 3)
    monkeypatch.setattr(negatives._blocks, "__defaults__", (4,))
    df = spark.createDataFrame([(*r, 0.5, "k") for r in rows], "vec_id long, label int, embedding array<float>, score double, key string")
    got = negatives.mine(df.repartition(3), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == mined(rows)


def test_negatives_of_nothing(spark):
    kinds = "vec_id long, label int, embedding array<float>"
    assert negatives.mine(spark.createDataFrame([], kinds), F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(10, 1, [1.0, 2.0])], kinds)
    assert negatives.mine(alone, F.col("vec_id") % 10 == 0).count() == 0


def test_ranges_prune_and_lose_nothing():
    g = np.random.default_rng(1)
    x = np.rint(g.normal(size=(500, 8)) * 20 + 200 * np.eye(8)[g.integers(0, 8, 500)]).astype("<i4")
    order = np.argsort(x, axis=0, kind="stable")
    lens = np.sqrt((x.astype(float) ** 2).sum(1))
    b = negatives.Bucket({"n": 500, "dim": 8, "longest": lens.max(), "shortest": lens.min(), "vectors": x.tobytes(), "labels": np.zeros(500, "<i8").tobytes(),
                          "ids": np.arange(500, dtype="<i8").tobytes(), "per": np.ones(500, "<i4").tobytes(),
                          "values": np.take_along_axis(x, order, 0).T.astype("<i4").tobytes(), "places": order.T.astype("<u2").tobytes()})
    some = 0
    for q in x[:40].astype(np.int64):
        s = x.astype(np.int64) @ q
        for least in np.sort(s)[[-1, -20, -200, 10]]:
            at = b.feasible(q, float(np.sqrt((q.astype(float) ** 2).sum())), int(least))
            assert set(np.flatnonzero(s >= least)) <= set(at.tolist())
            some += len(at) < 500
    assert some > 40


# ---------------------------------------------------------------- filter audit
def audited(rows, labels):
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in (0, 1))
    parts = defaultdict(list)
    for d, text, _, source, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {f for f, x in (("A", len(w) < 50), ("B", 100 * len(set(w)) < 65 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)),
                              ("D", bool(re.search(r"[#$%&*|]", t))), ("E", d is not None and d > first[t])) if x}
        parts[source or ""].append((bad, d in good, d in toxic))
    out = []
    for part, docs in parts.items():
        share = Counter()
        lines = []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                share[f] += len(gone)
                fails = sum(f in x[0] for x in docs)
                lines.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(x[0] == {f} for x in docs),
                              sum(x[1] for x in gone), sum(x[2] for x in gone), f))
        out += [(*x[:-1], share[x[-1]]) for x in lines]
    return sorted(out)


def run_audit(docs, labels, span):
    rows = filter_audit.with_labels(filter_audit.with_copies(filter_audit.judged(docs)), labels)
    cols = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(map(tuple, filter_audit.audit(filter_audit.part_unions(filter_audit.postings(rows, "ABCDE", span), "ABCDE"), "ABCDE").select(*cols).collect()))


@pytest.mark.parametrize("span", [7, filter_audit.SPAN])
def test_audit_matches_brute_force(spark, span):
    r = random.Random(7)
    body = lambda: " ".join(r.choice(["w%d" % r.randint(0, 60), "Xy", "ab"]) for _ in range(r.choice([3, 55, 80])))
    texts = [None, "", " \t", "A#", "é" * 60 + "ABC", "ABCD" + "é" * 76, "a b " * 60, *[body() for _ in range(60)]]
    rows = [(r.choice([None, *range(40)]), r.choice(texts), "x", r.choice([None, "", "hot", "hot", "hot", "web"]), 0, 0.0, "k") for _ in range(150)]
    labels = [(d, r.choice([0, 1, None]), r.choice([0, 1, None])) for d in [None, *range(45), 3, 3, 7]]
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert run_audit(docs.repartition(3), lab, span) == audited(rows, labels)


def test_audit_of_nothing(spark):
    docs, lab = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert run_audit(docs, lab, 7) == []
    one = spark.createDataFrame([(1, "x", "l", None, 0, 0.0, "k")], DOCS)
    got = run_audit(one, lab, 7)
    assert len(got) == 600 and all(x[0] == "" for x in got)


def test_long_texts_are_taken_in_parts(monkeypatch):
    text = ("one two\tthree  " * 40 + "x" * 50 + " end").encode()
    whole = filter_audit._words(text)
    monkeypatch.setattr(filter_audit, "LONG", 16)
    assert filter_audit._words(text) == whole == (122, 5)


def test_unions_of_lists():
    g = np.random.default_rng(2)
    lists = {c: np.flatnonzero(g.random(300) < p).astype(np.int32) for c, p in zip(["A", "B", "C", "good", "toxic"], (0.5, 0.01, 0.2, 0.3, 0.0))}
    got = filter_audit.union_sizes(lists, "ABC")
    for s in range(8):
        u = set().union(*[lists[f].tolist() for i, f in enumerate("ABC") if s >> i & 1])
        assert (got["n"][s], got["good"][s], got["toxic"][s]) == (len(u), len(u & set(lists["good"].tolist())), 0)


# ---------------------------------------------------------------- filtering stages
def test_filters_keep_columns_of_any_name(spark, monkeypatch):
    """Columns named like the operators' own stay as they are, also where values come by joins."""
    from tubelens.llm import exact, minhash, toxicity
    odd = DOCS + ", _gone long, _known string, _th long, word long, value double"
    body = "one two three four five six seven eight nine ten"
    rows = [(i, f"{body} {i // 2}", "x", "s", 0, 0.0, "k", i + 100, "a", i, i, 0.5) for i in range(8)]
    docs = spark.createDataFrame(rows, odd)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(8)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, exact.drop_copies(docs).collect())) == [r for r in rows if r[0] % 2]
    got = minhash.keep_one(docs).collect()
    assert got and all(tuple(r) == rows[r.doc_id] for r in got)
    for most in (toxicity.MODEL_ROWS, 0):
        monkeypatch.setattr(toxicity, "MODEL_ROWS", most)
        got = toxicity.keep_ordinary(docs, labels, threshold=2.0)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == rows
