"""Text operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""
import collections
import hashlib
import math
import random
import re
import struct

import numpy as np
import pytest

from conftest import SF
from tubelens.llm import bpe, bytedup, decontaminate, exact, langid, licenses, minhash, repeats, shards, substring, suffix, toxicity
from tubelens.llm.common import documents, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "_h string, _t string, h long, node long, cell int, w int"


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def frame(spark, texts, first=0):
    rows = [(i + first, t, "en" if i % 2 else None, "s", len(t or ""), "x", "y", 1, 2, 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"{SCHEMA}, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base, passage = say(150), say(60)
    out = [None, "", " \n ", "one", "One", "two words", base, base]
    for _ in range(25):  # near copies: some words changed
        w = base.split()
        for k in rnd.sample(range(150), rnd.randint(1, 14)):
            w[k] = rnd.choice(vocab)
        out.append(" ".join(w))
    for _ in range(12):  # one passage in many texts
        out.append(say(rnd.randint(3, 40)) + "\n" + passage + " " + say(rnd.randint(3, 40)))
    out += [passage + " " + passage, say(6000), "x" * 5000, base.upper(), "é" * 90, "🙂 " * 70]
    return out + [base] * 6


def collect(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---------------------------------------------------------------- exact
def test_exact(spark, texts):
    got = collect(exact.exact_groups(frame(spark, texts)))
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(ids), len(ids), i == max(ids), sha(t))


def test_exact_parts_colliding_hashes(spark, texts):
    from pyspark.sql import functions as F

    weak = lambda c: F.substring(F.md5(F.coalesce(F.col(c), F.lit(""))), 1, 1)
    plain, odd = collect(exact.exact_groups(frame(spark, texts))), collect(exact.exact_groups(frame(spark, texts), hash_fn=weak))
    assert plain == odd


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(df).collect() if r.text_sha256 == sha("a"))
    assert got == [(False, 1, 3, True), (False, 1, 3, True), (True, 1, 3, False)]
    assert [(r.keep_id, r.kept) for r in exact.exact_groups(df).collect() if r.text_sha256 == sha("b")] == [(None, True)]
    assert exact.drop_copies(df.where("doc_id is not null").distinct()).count() == 1


# ---------------------------------------------------------------- near
def near_by_force(texts, k):
    sets = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k", [2, 5])
def test_near_groups(spark, texts, k):
    got = collect(minhash.near_groups(frame(spark, texts), k))
    for i, (n, comp) in enumerate(near_by_force(texts, k)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, comp, i == comp), i


def test_sketches_fill_and_estimate():
    rnd = np.random.default_rng(3)
    pool = rnd.integers(1, 1 << 62, 900).astype(np.uint64)
    sets = [pool[:1], pool[:3], pool[:600], pool[100:700]]
    count = np.array([len(s) for s in sets])
    sk = minhash.sketches(np.concatenate(sets), np.cumsum(count) - count, count)
    assert (sk != np.iinfo(np.uint64).max).all()
    assert abs((sk[2] == sk[3]).mean() - 500 / 700) < 0.15


def test_parities_bound_the_difference():
    rnd = np.random.default_rng(4)
    a = np.unique(rnd.integers(1, 1 << 62, 300).astype(np.uint64))
    b = np.unique(np.concatenate([a[20:], rnd.integers(1, 1 << 62, 15).astype(np.uint64)]))
    count = np.array([len(a), len(b)])
    x, y = minhash.parities(np.concatenate([a, b]), np.cumsum(count) - count, count)
    assert len(x) == len(y)
    d = int(np.bitwise_count(np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)).sum())
    assert 0 < d <= len(np.setxor1d(a, b))


# ---------------------------------------------------------------- licences
def test_licences(spark):
    docs = documents(spark, SF).select("doc_id", "text")
    model = licenses.train(docs)
    lines = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
             "This work is licensed under the GNU General Public License, version 3.", "the cat sat by the door", "", "Distributed under the Zork Private License."]
    df = spark.createDataFrame([(0, "\n".join(lines)), (1, None), (2, ""), (2, "")], "doc_id long, text string")
    got = {r.para: r.family for r in licenses.scan(df, model).collect()}
    assert [got.get(i) for i in range(4)] == ["apache-2.0", "mit", "cc-by-nc-4.0", "gpl-3.0"]
    assert 4 not in got and 5 not in got and got.get(6, "unknown") == "unknown"
    # the pruned scan equals scoring every line in full
    want = score_all_lines(docs.collect(), model)
    have = {(r.doc_id, r.para): (r.family, round(r.score, 4)) for r in licenses.scan(docs, model).collect()}
    assert have == want and want


def score_all_lines(rows, m):
    out, none = {}, m["labels"].index("none")
    at = {v: i for i, v in enumerate(m["vocab"])}
    for r in rows:
        for p, line in enumerate((r.text or "").split("\n")):
            g = set(licenses._grams(line))
            z = m["bias"].round(6) + sum((m["weights"][:, at[x]].round(6) for x in g if x in at), np.zeros(len(m["labels"])))
            q = np.exp(z - z.max())
            if 1 - q[none] / q.sum() < m["thresholds"][0]:
                continue
            best, s = m["labels"][int(z.argmax())], 1 / q.sum()
            forms = [f.format(n) for n in licenses.NAMES.get(best, []) for f in licenses.FRAMES] + licenses.NOTICES.get(best, [])
            cover = max((len(set(licenses._grams(t)) & g) / len(licenses._grams(t)) for t in forms), default=0)
            sure = s >= m["thresholds"][1] and cover >= licenses.CONFIRM
            out[(r.doc_id, p)] = (best if sure else "unknown", round(float(s), 4))
    return out


# ---------------------------------------------------------------- shards
def test_minimax_plan_is_least():
    rnd = random.Random(2)
    for _ in range(200):
        runs = sorted(((rnd.randint(1, 30), rnd.randint(1, 4)) for _ in range(rnd.randint(1, 6))), reverse=True)
        runs = [(s, c) for s, c in dict(runs).items()]
        k = rnd.randint(1, 6)
        items = [s for s, c in runs for _ in range(c)]
        cuts = shards.plan(np.array([s for s, _ in runs]), np.array([c for _, c in runs]), k)
        at = [sum(c for s, c in runs if s > cs) + r for cs, r in cuts]
        got = [sum(items[a:b]) for a, b in zip([0, *at], [*at, len(items)])]
        assert len(got) <= k and sum(got) == sum(items)
        assert max(got) == least_capacity(items, k)


def least_capacity(items, k):
    best = {0: 0}
    for _ in range(k):
        nxt = {}
        for i, m in best.items():
            total = 0
            for j in range(i, len(items) + 1):
                nxt[j] = min(nxt.get(j, math.inf), max(m, total))
                total += items[j] if j < len(items) else 0
        best = nxt
    return best[len(items)]


def test_shards(spark, texts):
    rows = shards.assign(frame(spark, texts), 5).collect()
    assert len(rows) == len(texts)
    import zlib

    place = {}
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 16, zlib.crc32(t), "bytes", None)
        assert place.setdefault(t, r.shard) == r.shard
    for s in range(5):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


# ---------------------------------------------------------------- repeats
def by_force(units, window, smaller):
    """Covered units per document; ``smaller(place, first)`` says whether the first place makes a window go."""
    first = {}
    for d, u in units:
        for i in range(len(u) - window + 1):
            first.setdefault(tuple(u[i:i + window]), (d, i))
    out = {}
    for d, u in units:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if smaller((d, i), first[tuple(u[i:i + window])]):
                gone[i:i + window] = [True] * window
        out[d] = gone
    return out


@pytest.mark.parametrize("hot", [1000, 4])
def test_substring_dedup(spark, texts, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = collect(substring.dedup(frame(spark, texts)))
    units = [(i, WORD.findall(t or "")) for i, t in enumerate(texts)]
    gone = by_force(units, 50, lambda p, f: f[0] < p[0])
    assert any(any(g) and not all(g) for g in gone.values())
    for d, u in units:
        keep = " ".join(x for x, g in zip(u, gone[d]) if not g)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(u), sum(gone[d]), sha(keep)), d


@pytest.mark.parametrize("hot", [1000, 4])
def test_substring_dedup_passage_twice_in_one_document(spark, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    rnd = random.Random(8)
    say = lambda n: [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 999)}" for _ in range(n)]
    passage = say(180)
    part = passage[:75] + ["other"] + passage[76:140]  # a near copy, cut shorter, in the smallest id
    texts = [" ".join(say(9) + part + say(9)), " ".join(passage + say(20) + passage)]
    texts += [" ".join(say(5) + passage + say(5)) for _ in range(6)]
    got = collect(substring.dedup(frame(spark, texts)))
    units = [(i, t.split()) for i, t in enumerate(texts)]
    gone = by_force(units, 50, lambda p, f: f[0] < p[0])
    assert gone[1][:180] == gone[1][200:] and any(gone[1])
    for d, u in units:
        keep = " ".join(x for x, g in zip(u, gone[d]) if not g)
        assert (got[d].n_removed, got[d].kept_sha256) == (sum(gone[d]), sha(keep)), d


@pytest.mark.parametrize("hot", [1000, 1])
def test_repeats_among_many_near_copies(spark, hot, monkeypatch):
    """Windows parted down to single ones (hot 1) give what whole surroundings give; one text is above a megabyte."""
    monkeypatch.setattr(repeats, "HOT", hot)
    rnd = random.Random(21)
    say = lambda n: [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 999)}" for _ in range(n)]
    passage = say(150)
    texts = []
    for i in range(24):
        copy = [x if rnd.random() > 0.01 else say(1)[0] for x in passage]
        texts.append(" ".join(say(i % 3) + copy[rnd.randint(0, 40):150 - rnd.randint(0, 40)] + say(i % 4)))
    texts[7] += " " + texts[7]
    words, wide = list(texts), list(texts)
    words.insert(9, " ".join(say(140_000) + passage + say(140_000)))
    assert len(words[9]) > 1 << 20
    got = collect(substring.dedup(frame(spark, words)))
    units = [(i, t.split()) for i, t in enumerate(words)]
    gone = by_force(units, 50, lambda p, f: f[0] < p[0])
    assert sum(map(sum, gone.values())) > 500
    for d, u in units:
        keep = " ".join(x for x, g in zip(u, gone[d]) if not g)
        assert (got[d].n_removed, got[d].kept_sha256) == (sum(gone[d]), sha(keep)), d
    got = collect(bytedup.dedup(frame(spark, wide)))
    units = [(i, t.encode()) for i, t in enumerate(wide)]
    gone = by_force(units, 100, lambda p, f: f < p)
    for d, u in units:
        assert (got[d].n_removed, got[d].kept_sha256) == (sum(gone[d]), sha(bytes(c for c, x in zip(u, gone[d]) if not x))), d


@pytest.mark.parametrize("hot", [1000, 4])
def test_suffix_dedup(spark, texts, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = collect(bytedup.dedup(frame(spark, texts)))
    units = [(i, (t or "").encode()) for i, t in enumerate(texts)]
    gone = by_force(units, 100, lambda p, f: f < p)
    for d, u in units:
        g = gone[d]
        spans = sum(1 for k in range(len(g)) if g[k] and not (k and g[k - 1]))
        keep = bytes(c for c, x in zip(u, g) if not x)
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(u), sum(g), spans, sha(keep)), d


def test_suffix_array_by_grouping():
    rnd = random.Random(1)
    for _ in range(400):
        a = [rnd.randint(0, rnd.choice([0, 1, 2, 6])) for _ in range(rnd.randint(0, 60))]
        assert suffix.suffix_array(np.array(a, dtype=np.int64)).tolist() == sorted(range(len(a)), key=lambda i: a[i:])


def test_ordered_pieces_give_byte_order():
    rnd = random.Random(3)
    parts = ["".join(rnd.choice("ab \n") for _ in range(rnd.randint(0, 90))).encode() for _ in range(20)]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    buf = np.frombuffer(b"".join(parts), dtype=np.uint8)
    start, rank, common = bytedup.ordered_pieces(buf, at)
    rest = [bytes(buf[s:at[np.searchsorted(at, s, side="right")]]) for s in start]
    order = np.argsort(rank)
    assert [rest[i] for i in order] == sorted(rest)


# ---------------------------------------------------------------- decontamination
def test_decontamination(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([3, 15, 40])))) for i in range(12)] + [(99, None), (98, ""), (97, "--- !!")]
    docs = []
    for d in range(60):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 80))]
        if d % 2:
            it = items[d % 12][1].split()
            for _ in range(rnd.randint(0, 2)):
                it[rnd.choice([0, -1, len(it) // 2])] = "CHANGED"
            w[5:5] = [x.upper() for x in it]
        docs.append((d, (", " if d % 3 else " ").join(w)))
    docs += [(60, None), (61, ""), (1, docs[1][1])]
    split = lambda t: re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())
    want = set()
    for d, t in docs:
        w = split(t)
        for i, x in items:
            y = split(x)
            k = min(5, len(y))
            count = lambda v: collections.Counter(tuple(v[j:j + k]) for j in range(len(v) - k + 1))
            for s in range(len(w) - len(y) + 1 if y else 0):
                a, b = count(w[s:s + len(y)]), count(y)
                both = sum((a & b).values())
                if both and both >= 0.8 * (sum(a.values()) + sum(b.values()) - both):
                    want.add((d, i))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and want
    hit = {d for d, _ in want}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(df, bench).collect()) == sorted(d for d, _ in docs if d not in hit)


def test_decontamination_of_texts_shorter_than_the_item(spark):
    item = [f"w{i}" for i in range(50)]
    small = [f"v{i}" for i in range(9)]
    texts = [item[:46], item[:25] + item[26:], item[:41], item[:40], small[:8], small[1:8], ["w0"] * 40, item[:3], ["x"] + item[:46] + ["x"]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(small)), (3, " ".join(item[::-1]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, round(r.similarity, 6)) for r in decontaminate.leaks(docs, bench).collect()}
    want = {(0, 1): (0, 42 / 46), (1, 1): (0, 41 / 50), (2, 1): (0, 37 / 46), (4, 2): (0, 4 / 5), (8, 1): (0, 42 / 48)}
    assert got == {k: (s, round(v, 6)) for k, (s, v) in want.items()}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()) == [3, 5, 6, 7]


# ---------------------------------------------------------------- language
def test_language(spark):
    docs = documents(spark, SF)
    model = langid.train(docs)
    got = collect(langid.op7_langid(spark, SF))
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [d for d in got if got[d].held_out]
    assert held and sum(got[d].lang_pred == lang[d] for d in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (4, "Жук"), (None, "the and that")], "doc_id long, text string")
    r = collect(langid.predict(odd, model))
    assert [r[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and r[4].lang_pred in model["langs"]
    assert all(0 <= x.score <= 1 for x in r.values())
    assert langid.train(docs.where("false")) is None


def test_mixed_text_gives_spans(spark):
    docs = documents(spark, SF)
    model = langid.train(docs)
    pick = {l: docs.where(f"lang = '{l}' and length(text) > 400").orderBy("doc_id").first().text[:300] for l in ("en", "de")}
    df = spark.createDataFrame([(1, pick["en"] + " " + pick["de"])], "doc_id long, text string")
    assert [r.lang for r in langid.spans(df, model).orderBy("start").collect()] == ["en", "de"]


def test_viterbi_is_best_path():
    rnd = np.random.default_rng(0)
    for _ in range(30):
        n = rnd.integers(0, 6, 3)
        s = rnd.normal(size=(int(n.sum()), 3)).astype(np.float32)
        hi = np.cumsum(n)
        got = langid.viterbi(s, hi - n, hi, 0.7)
        for a, b in zip(hi - n, hi):
            value = lambda p: sum(s[a + i, x] for i, x in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:]))
            best = max((value(p) for p in __import__("itertools").product(range(3), repeat=int(b - a))), default=0)
            assert abs(value(got[a:b].tolist()) - best) < 1e-4


# ---------------------------------------------------------------- BPE
def test_bpe_equals_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["", " ", "aaaaaaaaaaaaa aaaa", "It's I'LL don't 'sx", "x<|endoftext|>y <|startoftext|>", "<|endoftext", "Ünïcode ﬁ ſ Σας İ", "日本語 text 123 4५6",
           "é    z", "🙂🙃 \U0001F468‍\U0001F469", "a" * 3000, "\t\r\n!?!?..", None, "\u0000 nul"]
    odd += [r.text for r in documents(spark, SF).limit(60).collect()]
    got = collect(bpe.digests(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")))
    ids = collect(bpe.encode(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")))
    back = collect(bpe.decode(spark.createDataFrame([(i, r.ids) for i, r in ids.items()], "doc_id long, ids array<int>")))
    for i, t in enumerate(odd):
        want = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(want, skip_special_tokens=False)
        assert ids[i].ids == want and back[i].text == text, t
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(want), sha(struct.pack(f"<{len(want)}I", *want)), sha(text))


# ---------------------------------------------------------------- toxicity
def test_toxicity(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.1"), table(spark, "/root/testdata/sf0.1", "labels")
    got = collect(toxicity.op10_toxicity(spark, "/root/testdata/sf0.1"))
    held = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.9
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    model = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (4, "x" * 20000)], "doc_id long, text string")
    r = collect(toxicity.score(odd, model))
    assert r[1].score == r[2].score == r[3].score and len(r) == 4
    none = toxicity.train(docs, labels.where("false"))
    assert none["ratio"] is None and {x.score for x in toxicity.score(odd, none).collect()} == {0.0}


def test_toxicity_contexts_are_true_and_of_characters(spark):
    rnd = random.Random(6)
    other = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(40_000)]  # fills 2^16 classes
    rows = [(2 * i, " ".join(other[k::80])) for i in range(40) for k in (i, i + 40)]
    cells = lambda rows: toxicity.count_cells(spark.createDataFrame(rows, "toxic int, text string")).collect()
    got = cells([(0, t) for _, t in rows] + [(1, "zqxjkvwh")])
    word = {(w[max(0, i - 5):i], i < 5, w[i]) for w in [*other, "zqxjkvwh"] for i in range(len(w))}
    assert len(got) == len(word) and sum(r.n1 for r in got) == 8
    got = cells([(0, "жшщюябв"), (1, "жшщюягв")])
    assert len(got) == 7 + 2 and sum(r.n0 + r.n1 for r in got) == 14  # seven letters, not fourteen bytes


def test_toxicity_counts_all_rows_but_those_of_the_curve(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_ROWS", 7)
    rows = [(i, f"text{i}", i % 2) for i in range(400)] + [(9, "text9", 1)]
    seen = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, toxic int")
        all_rows = toxicity.labelled(df.select("doc_id", "text").distinct(), df.select("doc_id", "toxic"))
        counted, fits = toxicity.dealt(all_rows)
        n, fit = {r.doc_id: r.part for r in counted.collect()}, {r.doc_id for r in fits.collect()}
        assert len(fit) in (6, 7) and not fit & n.keys() and fit | n.keys() == {r.doc_id for r in all_rows.collect()}
        assert set(n.values()) == {0, 1, 3}
        seen.append(fit)
    assert seen[0] == seen[1]


def test_toxicity_by_joins_equals_broadcast(spark, monkeypatch):
    docs, labels = documents(spark, "/root/testdata/sf0.01"), table(spark, "/root/testdata/sf0.01", "labels")
    some = docs.limit(300).union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "дом")], "doc_id long, text string").join(
        docs.select(*[c for c in docs.columns if c not in ("doc_id", "text")]).limit(1)).select(docs.columns)).cache()
    a = toxicity.train(docs, labels)
    want = {r.doc_id: r.score for r in toxicity.score(some, a).collect()}
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 10)
    b = toxicity.train(docs, labels)
    assert a["ratio"] is not None and b["ratio"] is None
    got = {r.doc_id: r.score for r in toxicity.score(some, {**b, "curve": a["curve"]}).collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in want)


# ---------------------------------------------------------------- empty tables
@pytest.mark.parametrize("run", [
    exact.exact_groups, lambda d: minhash.near_groups(d, 2), lambda d: shards.assign(d, 4), substring.dedup, bytedup.dedup, bpe.digests,
    lambda d: langid.predict(d, None)], ids=["exact", "near", "shards", "substring", "suffix", "bpe", "language"])
def test_empty(spark, run):
    assert run(frame(spark, ["x"]).where("false")).collect() == []


@pytest.mark.parametrize("run", [lambda d: minhash.near_groups(d, 2), substring.dedup, bytedup.dedup], ids=["near", "substring", "suffix"])
def test_null_and_shared_ids(spark, run):
    long = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(None, long), (1, long), (1, long), (1, long + " more"), (2, long), (None, None)], "doc_id long, text string")
    rows = run(df).collect()
    assert len(rows) == 6
    again = [r for r in rows if r.doc_id == 1]
    assert len(again) == 3


@pytest.mark.parametrize("block,elements", [(16, 1 << 20), (512, 400)], ids=["members", "elements"])
def test_near_groups_around_the_threshold(spark, monkeypatch, block, elements):
    """Many versions of one text, most pairs just around the similarity, split over many blocks: no link is lost."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "ELEMENTS", elements)
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(160):
        w = list(base)
        for p in rnd.sample(range(120), rnd.randint(4, 7)):
            w[p] = f"x{rnd.randint(0, 3)}"
        texts.append(" ".join(w))
    texts.append(" ".join(base * 3000))  # above the piece of 256 KB
    want = near_by_force(texts, 2)
    got = collect(minhash.near_groups(frame(spark, texts), 2))
    assert len({r.component_id for r in got.values()}) > 3
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == want


def test_forest_holds_fewer_links_than_members():
    """Every member is left and right; the block's true links come back as a tree."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[:p] + ["other"] + base[p + 1:]) for p in rnd.sample(range(100), 40)]
    sets = [set(zip(t.split(), t.split()[1:])) for t in texts]
    import zstandard
    h, first, count = [], [], []
    for t in texts:
        x, _, c = minhash.shingle_sets(minhash.Words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), lower=True), 2)
        first.append(sum(count)), h.append(x), count.append(int(c[0]))
    par = minhash.parities(np.concatenate(h), np.array(first), np.array(count))
    both = 2 * list(range(40))  # all as left and as right members
    g = {"node": np.array(both), "comp": np.array(both), "n": np.array(count)[both], "free": np.array(both) > 0, "key": 9,
         "parity": [par[i] for i in both], "keys": [np.array([9, i]) for i in both],
         "z": [zstandard.ZstdCompressor().compress(texts[i].encode()) for i in both]}
    links = minhash.forest(g, 40, 2, 80, zstandard.ZstdDecompressor())
    assert len(links) == 39
    assert all(100 * len(sets[u] & sets[v]) >= 80 * len(sets[u] | sets[v]) for u, v in links)
    g["keys"] = [np.array([5, 9]) for _ in both]  # an earlier band is shared: the pairs belong there
    assert minhash.forest(g, 40, 2, 80, zstandard.ZstdDecompressor()) == []


def test_decontamination_keeps_the_type_of_item_ids(spark):
    item = " ".join(f"word{i}" for i in range(40))
    bench = spark.createDataFrame([("q-1", item), ("q-2", item + " more")], "item_id string, text string")
    got = decontaminate.leaks(frame(spark, ["nothing here", f"before {item} after"]), bench)
    assert dict(got.dtypes)["item_id"] == "string"
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, "q-1"), (1, "q-2")]


def test_viterbi_of_many_labels():
    scores = np.full((6, 70_000), -9.0, dtype=np.float32)
    scores[:3, 280] = scores[3:, 69_999] = 5
    got = langid.viterbi(scores, np.array([0]), np.array([6]), 2.0)
    assert got.tolist() == [280] * 3 + [69_999] * 3


def test_bpe_letters_are_those_of_the_library():
    """Code points that a newer Unicode version assigns are no letters to the library."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    enc = bpe.Encoder(bpe.Vocabulary.load(bpe.default_path()))
    for c in [0x88F, 0x1C8A, 0x18D80, 0x191D2, 0x323B0, 0x33479, 0x41, 0x4E00, 0x660, *range(0xA0, 0xD800, 97), *range(0x10000, 0x33480, 97)]:
        text = f"ab{chr(c)}cd {chr(c)}{chr(c)} 1{chr(c)}2"
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, hex(c)
    assert enc.odd  # a word that is known by now, beside a mark
    text = "a \u088f!? \u088f"
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
