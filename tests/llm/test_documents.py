"""Operators on documents against brute force, on a small table and on awkward rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.common import WORD, documents, edge_rows, empty, frame, text_of
from vecspark.llm import bpe, langid, minhash, mixing, queries, substring, suffix, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")


def sha(b):
    return hashlib.sha256(b).hexdigest()


# --- BPE ---------------------------------------------------------------------------


def bpe_expected(rows):
    t = Tokenizer.from_file(PATH)
    out = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        out.append((r[0], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode())))
    return Counter(out)


def test_bpe_edges(spark):
    rows = [*edge_rows(), (20, "x" * 5000 + " " + "ab" * 700), (21, "<|endoftext|><|endoftext|>"), (22, " \r\n  　a'll 'S")]
    assert Counter(map(tuple, bpe.digests(frame(spark, rows), PATH).collect())) == bpe_expected(rows)
    assert bpe.digests(empty(spark), PATH).count() == 0
    docs = frame(spark, rows)
    both = bpe.decode(bpe.encode(docs, PATH), PATH).select("doc_id", "decoded").collect()
    assert Counter(map(tuple, both)) == Counter((r[0], r[1] or "") for r in rows)


def test_bpe_query(spark, sf):
    assert Counter(map(tuple, queries.op3_bpe(spark, sf).collect())) == bpe_expected(documents(sf))


def test_bpe_round_trip_and_invalid_bytes():
    v = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    kept = bpe.Kept(v)
    text = "Ünïcode \x00 mixed text <|endoftext|>"
    assert bpe.decode_ids(bpe.encode_text(text, v, kept), v) == text
    first = np.frombuffer(bpe.encode_text("日", v, kept), "<u4")[:1].tobytes()
    assert bpe.decode_ids(first, v) == Tokenizer.from_file(PATH).decode(np.frombuffer(first, "<u4").tolist(), skip_special_tokens=False)


# --- near duplicates ---------------------------------------------------------------


def near_expected(rows, k):
    sets, ids = defaultdict(set), []
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = WORD.findall(low)
        s = frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        ids.append((i, s))
        if i is not None:
            sets[i].add(s)
    nodes = [(i, s) for i, own in sets.items() for s in own if s]
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for n, (_, s) in enumerate(nodes):
        for g in s:
            where[g].append(n)
    shared = Counter((a, b) for own in where.values() for a in own for b in own if a < b)
    for (a, b), c in shared.items():
        if 100 * c >= 80 * (len(nodes[a][1]) + len(nodes[b][1]) - c):
            x, y = sorted((root(nodes[a][0]), root(nodes[b][0])))
            parent[y] = x
    return Counter((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in ids)


@pytest.mark.parametrize("k", [4, 5])
def test_minhash_edges(spark, k):
    rows = [r[:2] for r in edge_rows()] + [(30, "A b"), (31, "a B"), (32, "a b c")]
    got = minhash.near_duplicates(frame(spark, rows), k)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == near_expected(rows, k)
    assert minhash.near_duplicates(empty(spark), k).count() == 0


def test_minhash_query(spark, sf):
    assert Counter(map(tuple, queries.op5_minhash(spark, sf).collect())) == near_expected(documents(sf), 4)


def test_minhash_dense_region(spark, monkeypatch):
    """Regions far over their size: many near copies, exact copies, and a chain whose ends aren't linked."""
    monkeypatch.setattr(minhash, "REGION", 4)
    base = text_of(9, 150).split()
    rows = []
    for i in range(90):
        w = list(base)
        w[i % 60 * 2 % 150] = f"edit{i}"
        rows.append((i, " ".join(w)))
    for i in range(12):  # each shares most with the one before
        rows.append((200 + i, " ".join([f"c{j}" for j in range(6 * i, 6 * i + 120)])))
    rows += [(300 + i, " ".join(base)) for i in range(40)]
    assert Counter(map(tuple, minhash.near_duplicates(frame(spark, rows), 4).collect())) == near_expected(rows, 4)


def template_family(n, links, seed=0):
    """n documents that are 0.74 alike through a common text; the first ``links`` have one more document that is 0.81 like them."""
    common, rows = text_of(50, 200), []
    for i in range(n):
        own = text_of(seed + 1000 + i, 34).split()
        rows.append((i, " ".join([common, *own])))
        if i < links:
            rows.append((100_000 + i, " ".join([common, *own[:10], *text_of(seed + 500_000 + i, 24).split()])))
    return rows


@pytest.mark.parametrize(("cell", "items"), [(16, 4000), (minhash.CELL, minhash.CELL_ITEMS)])
def test_minhash_template_family(spark, monkeypatch, cell, items):
    """Links at the threshold between documents of a large family that are themselves below it."""
    monkeypatch.setattr(minhash, "CELL", cell)
    monkeypatch.setattr(minhash, "CELL_ITEMS", items)
    rows = template_family(300, 60)
    expected = near_expected(rows, 4)
    assert sum(not kept for *_, kept in expected.elements()) == 60
    assert Counter(map(tuple, minhash.near_duplicates(frame(spark, rows), 4).collect())) == expected


def test_minhash_pairs_grow_with_documents(spark, tmp_path):
    """A family below the threshold makes candidates in proportion to its size."""
    from vecspark.llm.shared import Stage

    made = []
    for n in (300, 600):
        docs, stage = frame(spark, template_family(n, 0)).select("doc_id", "text"), Stage(spark, "pairs")
        sig = stage.write(minhash.signatures(docs, 4).select(F.col("doc_id").alias("id"), "n", "sig"), "sig")
        shared = minhash.regions(sig, stage)
        sets = minhash.sets_of(docs, shared.select("id").distinct(), 4)
        minhash.rare_links(sets.withColumn("label", F.col("id")), 80, stage).count()
        made.append((minhash.neighbours(shared.join(sig, "id"), 80).count(), spark.read.parquet(f"{stage.root}/dealt").count()))
    assert made[1][0] <= 2.5 * made[0][0] and made[1][1] <= 2.5 * made[0][1] + 300, made


@pytest.mark.parametrize("few", [0, 1 << 19])
def test_components(spark, tmp_path, monkeypatch, few):
    """Chains, stars, rings and loose pairs, by steps over tables and in one task."""
    import random

    from vecspark.llm import components
    from vecspark.llm.shared import Stage

    monkeypatch.setattr(components, "FEW", few)
    r = random.Random(4)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, 500 + i) for i in range(1, 60)] + [(900 - i, 900 - (i + 1) % 30) for i in range(30)]
    links += [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(120)] + [(7, 7), (None, 8), (9, 9)]
    r.shuffle(links)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = components.components(spark.createDataFrame(links, "a long, b long"), Stage(spark, "links")).collect()
    assert Counter(map(tuple, got)) == Counter((x, root(x)) for x in parent)
    assert components.components(spark.createDataFrame([], "a long, b long"), Stage(spark, "links")).count() == 0


# --- suffixes and substrings -------------------------------------------------------


def suffix_expected(rows, length):
    order = sorted({i for i, _ in rows if i is not None})
    by, seen, mine = defaultdict(list), set(), {}
    for i, t in rows:
        by[i].append((t or "").encode())
    for i in order:
        for b in by[i]:
            gone = np.zeros(len(b), bool)
            for a in range(len(b) - length + 1):
                if b[a : a + length] in seen:
                    gone[a : a + length] = True
            mine[i, b] = gone
        for b in by[i]:
            seen.update(b[a : a + length] for a in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = mine.get((i, b), np.zeros(len(b), bool))
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return Counter(out)


def test_suffix_edges(spark, monkeypatch):
    rows = [r[:2] for r in edge_rows()] + [(40, "x" * 300), (39, "x" * 49), (41, "y" * 10 + "x" * 120 + "z" * 60), (42, "z" * 55), (0, text_of(1, 120)[30:140])]
    for group in (suffix.GROUP, 1):
        monkeypatch.setattr(suffix, "GROUP", group)
        got = suffix.removals(frame(spark, rows)).drop("rest")
        assert Counter(map(tuple, got.collect())) == suffix_expected(rows, 50)
    assert suffix.removals(empty(spark)).count() == 0


def test_suffix_query(spark, sf):
    assert Counter(map(tuple, queries.op6_suffix(spark, sf).collect())) == suffix_expected(documents(sf), 50)


def test_suffix_rest(spark):
    rows = [(1, text_of(1, 40)), (2, "head " + text_of(1, 40) + " tail")]
    rest = {r.doc_id: r.rest for r in suffix.removals(frame(spark, rows)).collect()}
    assert rest[1] is None and bytes(rest[2]).decode() == "head  tail"


def window_expected(rows, n):
    all_ = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[a : a + n]) for w in all_ for a in range(len(w) - n + 1))
    out = []
    for (i, _), w in zip(rows, all_, strict=True):
        gone = [False] * len(w)
        for a in range(len(w) - n + 1):
            if count[tuple(w[a : a + n])] > 1:
                gone[a : a + n] = [True] * n
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())))
    return Counter(out)


@pytest.mark.parametrize(("window", "base"), [(35, 9), (35, 35), (7, 3), (40, 5)])
def test_substring_edges(spark, window, base):
    rows = [r[:2] for r in edge_rows()] + [(50, text_of(8, 60) + "\n" + text_of(8, 60))]
    got = substring.removals(frame(spark, rows), window, base)
    assert Counter(map(tuple, got.collect())) == window_expected(rows, window)
    assert substring.removals(empty(spark)).count() == 0


def test_substring_query(spark, sf):
    assert Counter(map(tuple, queries.op7_substring(spark, sf).collect())) == window_expected(documents(sf), 35)


def test_substring_documents(spark):
    shared = text_of(1, 40)
    rows = [(1, f"first {shared} one"), (2, f"second  {shared}\ttwo\n"), (3, "left  alone\n"), (4, None), (5, shared)]
    out = frame(spark, rows)
    got = substring.dedup(out)
    assert got.columns == out.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "first one", 2: "second  two", 3: "left  alone\n", 4: None}


def test_sql(sf):
    """The SQL of the three against brute force."""
    import duckdb

    con, rows = duckdb.connect(), documents(sf)
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for sql, expected in ((minhash.SQL, near_expected(rows, 4)), (suffix.SQL, suffix_expected(rows, 50)), (substring.SQL, window_expected(rows, 35))):
        assert Counter(con.sql(sql).fetchall()) == expected


# --- language, toxicity ------------------------------------------------------------


def test_langid(spark, sf):
    import duckdb

    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    got = queries.op2_langid(spark, sf).collect()
    assert len(got) == len(lang) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_langid_edges(spark):
    rows = [*edge_rows(), *((100 + i, text_of(i, 60), "en", None) for i in range(20)), *((200 + i, "ñöç été où " * (i + 2), "fr", None) for i in range(20))]
    got = langid.identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {2, 3, 4, 13} <= und and all(r.score == 0 for r in got if r.lang_pred == "und")
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[5] == "en" and by[210] == "fr"
    assert langid.identify(empty(spark)).count() == 0
    assert {r.lang_pred for r in langid.identify(frame(spark, [(1, "abc", None, None)])).collect()} == {"und"}


def plain_ngrams(text):
    """Buckets of 1- to 3-grams, one by one, with plain integers."""
    out, chars = [], [ord(c) for c in text.lower()]
    for order in (1, 2, 3):
        for a in range(len(chars) - order + 1):
            h = order * 0x9E3779B1 & 0xFFFFFFFF
            for c in chars[a : a + order]:
                h = (h ^ c) * 0x85EBCA6B & 0xFFFFFFFF
                h ^= h >> 15
            out.append(h % langid.BUCKETS)
    return out


def test_naive_bayes_by_brute_force(spark):
    """Every prediction and score from counts made without the operator, in one batch and text by text."""
    rows = [(i, text_of(i, 5 + i % 9) + (" été où ça" * (i % 4) if i % 2 else " the and of"), "fr" if i % 2 else "en", None) for i in range(60)]
    rows += [(100, None, "en", None), (101, "123 !", "fr", None), (102, "Ünd ÉTÉ", None, None), (103, "x", None, None), (104, text_of(9, 3000), None, None)]
    counts, n = {"en": Counter(), "fr": Counter()}, Counter()
    for i, text, lang, _ in rows:
        if lang and text is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang].update(plain_ngrams(text))
            n[lang] += 1
    expected = {}
    for i, text, _, _ in rows:
        if not text or not any(c.isalpha() for c in text):
            expected[i] = ("und", 0.0)
            continue
        total = {}
        for lang, c in counts.items():
            whole = sum(c.values()) + 0.5 * langid.BUCKETS
            total[lang] = math.log(n[lang] / sum(n.values())) + sum(math.log((c[b] + 0.5) / whole) for b in plain_ngrams(text))
        best = max(total, key=total.get)
        expected[i] = (best, 1 / sum(math.exp(max(-700, t - total[best])) for t in total.values()))
    got = {r.doc_id: r for r in langid.identify(frame(spark, rows)).collect()}
    assert {i: r.lang_pred for i, r in got.items()} == {i: e[0] for i, e in expected.items()}
    assert all(abs(r.score - expected[i][1]) < 1e-3 for i, r in got.items())
    model = langid.train(frame(spark, rows))
    texts = [t for _, t, _, _ in rows]
    whole, alone = langid.score_texts(texts, model), [langid.score_texts([t], model) for t in texts]
    assert whole[0] == [p[0] for p, _ in alone] and np.allclose(whole[1], [x[0] for _, x in alone])


def chain_brute(odds, e, start):
    """Marginal odds by summing over all paths."""
    import itertools

    n, total = len(odds), np.zeros((len(odds), 2))
    for path in itertools.product((0, 1), repeat=n):
        p = np.exp(sum(o * s for o, s in zip(odds, path, strict=True))) * (start if path[0] else 1) * np.prod([e[a, b] for a, b in zip(path, path[1:], strict=False)])
        for t, s in enumerate(path):
            total[t, s] += p
    return total[:, 1] / total[:, 0]


def test_chain_marginals():
    rng = np.random.default_rng(1)
    e, start = np.exp(rng.standard_normal((2, 2))), 0.7
    sizes = [3, 0, 1, 8, 5]
    odds = [rng.standard_normal(n) * 2 for n in sizes]
    first = np.r_[0, np.cumsum(sizes)]
    _, _, got = toxicity.forward_backward(np.concatenate(odds), first, e, start)
    assert np.allclose(got, np.concatenate([chain_brute(o, e, start) for o in odds if len(o)]))
    long = rng.standard_normal(1000) * 3  # over many lanes, against a plain loop
    f, _, o = toxicity.forward_backward(long, np.array([0, 1000]), e, start)
    r, plain = None, []
    for x in np.exp(long):
        r = x * start if r is None else x * (e[0, 1] + e[1, 1] * r) / (e[0, 0] + e[1, 0] * r)
        plain.append(r)
    assert np.allclose(f, plain) and np.isfinite(o).all()


def labelled(spark, n=400):
    import random

    r = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        w = text_of(1000 + i, 60).split()
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["vileword", "nastyterm", "grossname"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark):
    rows, labels = labelled(spark)
    rows += [(1000 + i, t) for i, (_, t, *_) in enumerate(edge_rows())] + [(None, "vileword here nastyterm")]
    got = toxicity.classify(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert held and all(r.predicted == (r.doc_id % 3 == 0) for r in held)
    assert all(r.predicted == 0 for r in got if r.doc_id is not None and r.doc_id >= 1000)
    text = dict(rows)
    for r in got:
        if r.doc_id == 0:
            assert r.spans and all(text[0][s.start : s.end] in ("vileword", "nastyterm", "grossname") for s in r.spans)
        if r.doc_id is None:
            assert r.predicted == 1


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.classify(frame(spark, edge_rows()), labels).collect()} == {0.0}
    assert toxicity.classify(empty(spark), labels).count() == 0


def test_toxicity_does_not_depend_on_partitions(spark):
    rows, labels = labelled(spark, 200)
    rows += [(5000, rows[0][1]), (5001, rows[3][1])]
    labels = labels.union(spark.createDataFrame([(5000, 1), (5001, 1)], labels.schema))
    docs = frame(spark, rows)
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.classify(docs.repartition(n), labels.repartition(n)).collect()) for n in (1, 7))
    assert a == b


def test_toxicity_query(spark):
    """Held-out documents, and spans against marginals summed over all paths, at a table that has enough labels."""
    import duckdb

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, sf).collect()}
    assert len(got) == len(documents(sf))
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet' WHERE toxic IS NOT NULL").fetchall())
    held = [(got[i].predicted, t) for i, t in toxic.items() if i in got and got[i].held_out]
    hits = sum(p == t == 1 for p, t in held)
    assert sum(t for _, t in held) > 1 and 2 * hits / (sum(p for p, _ in held) + sum(t for _, t in held)) >= 0.8
    text = dict(documents(sf))
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    assert all(toxicity.TOKEN.fullmatch(text[i][s.start : s.end]) for i, r in got.items() for s in r.spans)
    assert any(r.spans for r in got.values() if r.predicted)


def test_tagger_by_brute_force():
    """Scores' evidence and marginals of short texts by summing over all paths, from the weights alone."""
    words = [["vile", "good", "day"], ["nice", "vile", "rat"], ["good", "nice", "day"]]
    model = toxicity.fit(words, [b"\x01\0\0", b"\0\x01\x01", b"\0\0\0"])
    e, start = np.exp(model["moves"][1:]).reshape(2, 2), float(np.exp(model["moves"][0]))
    texts = ["vile day, good rat!", "", "nice", "good unseen vile"]
    marginals, found = toxicity.Tagger(model).tag(texts)
    for text, p, (top, total) in zip(texts, marginals, found, strict=True):
        tokens = toxicity.TOKEN.findall(text)
        if not tokens:
            assert (len(p), top, total) == (0, -8, 0)
            continue
        odds = chain_brute([float(model["weights"][toxicity.features(w)].sum()) for w in tokens], e, start)
        assert np.allclose(p, odds / (1 + odds), atol=1e-5)
        own = odds / (1 + odds)
        assert np.isclose(top, np.clip(np.log(odds.max()), -8, 8), atol=1e-4) and np.isclose(total, np.log1p(own[own > 0.2].sum()), atol=1e-4)


# --- mixing --------------------------------------------------------------------------


def mix_targets(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=str) + ([None] if None in sizes else [])
    weight = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("block", [1, 7, 128])
def test_mixing_edges(spark, block):
    rows = [*edge_rows(), *((500 + i, text_of(i, 20 + i % 40), "en", f"s{i % 7}") for i in range(150)), (900, "lone words here", "en", "tiny")]
    got = mixing.mix(frame(spark, rows), block, 16).collect()
    assert len(got) == len(rows)
    n = Counter((i, len(WORD.findall(t or "")), s) for i, t, _, s in rows)
    sizes = Counter()
    for (_, size, s), c in n.items():
        sizes[s] += size * c
    expected, source = mix_targets(dict(sizes)), defaultdict(set)
    for _, _, _, s in rows:
        source[sizes[s], round(expected[s], 6)].add(s)
    taken = Counter()
    for r in got:
        assert (r.source_size, round(r.target, 6)) in source and 0 <= r.taken <= 3 * r["size"]
        taken[r.source_size, round(r.target, 6)] += r.taken
    for key, names in source.items():
        assert abs(taken[key] - sum(expected[s] for s in names)) <= len(names)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(frame(spark, rows), block, 16).collect()), key=str)
    assert mixing.mix(empty(spark)).count() == 0
    assert sorted(tuple(r) for r in mixing.mix(frame(spark, [(1, None), (2, "")])).collect()) == [(1, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0)]


def taken_expected(docs, slots, sources, block):
    """Words taken of each document: the documents of a source end to end, and the slots' blocks of them."""
    by, out = defaultdict(list), Counter()
    for r in docs:
        if r["size"]:
            by[r.order].append((r.start, r.start + r["size"], r.doc_id))
    starts = {}
    for o, own in by.items():
        own.sort(key=lambda x: x[0])
        starts[o] = np.array([a for a, _, _ in own])
        assert own[0][0] == 0 and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False)) and own[-1][1] == sources[o].source_size
    for s in slots:
        a, b = s.block * block, s.block * block + s.words
        i = int(np.searchsorted(starts[s.order], a, "right")) - 1
        while i < len(by[s.order]) and by[s.order][i][0] < b:
            x, y, doc = by[s.order][i]
            out[doc] += max(0, min(b, y) - max(a, x))
            i += 1
    return out


@pytest.mark.parametrize("block", [5, 128])
def test_mixing_by_brute_force(spark, sf, block):
    """Every document's taken words, from the slots; the slots against the drawn counts and the targets."""
    from vecspark.llm.shared import Stage

    docs = queries.table(spark, sf, "documents")
    stage = Stage(spark, "brute")
    placed, sources = mixing.placed(docs, stage)
    slots = mixing.plan(sources, stage, block, 64, mixing.SEED).collect()
    source = {r.order: r for r in sources.collect()}
    assert {r.source: round(r.target, 6) for r in source.values()} == {s: round(t, 6) for s, t in mix_targets({r.source: r.source_size for r in source.values()}).items()}
    drawn = {(r.order, r.shard): r.n for r in spark.read.parquet(f"{stage.root}/draws").collect()}
    assert Counter((s.order, s.shard) for s in slots) == drawn
    shards, total = defaultdict(list), Counter()
    for s in slots:
        shards[s.shard].append(s.slot)
        total[s.order] += s.words
    assert all(sorted(x) == list(range(len(x))) for x in shards.values()) and len(shards) > 1
    assert all(total[o] == round(r.target) for o, r in source.items())
    passes = Counter((s.order, s["pass"], s.block) for s in slots)
    assert max(passes.values()) == 1
    for (o, p), blocks in Counter((s.order, s["pass"]) for s in slots).items():
        assert blocks == -(-source[o].source_size // block) or p == max(s["pass"] for s in slots if s.order == o)
    # Counts of shards scatter as multinomial ones do.
    n, k = np.array([drawn.get((o, j), 0) for o in source for j in shards]).reshape(len(source), -1), len(shards)
    mean = n.sum(axis=1, keepdims=True) / k
    chi, degrees = float(((n - mean) ** 2 / mean).sum()), len(source) * (k - 1)
    assert abs(chi - degrees) <= 5 * math.sqrt(2 * degrees), (chi, degrees)
    expected = taken_expected(placed.collect(), slots, source, block)
    got = mixing.mix(docs, block, 64).collect()
    assert len(got) == len(documents(sf)) and {r.doc_id: r.taken for r in got if r.taken} == {i: t for i, t in expected.items() if t}
    assert all(r.taken <= 3 * r["size"] and (r.shards > 0) == (r.taken > 0) for r in got)


def test_mixing_query(spark, sf):
    size, text = Counter(), documents(sf)
    got = queries.op10_mixing(spark, sf).toPandas()
    assert dict(zip(got.doc_id, got["size"], strict=True)) == {i: len(WORD.findall(t or "")) for i, t in text}
    import duckdb

    source = dict(duckdb.sql(f"SELECT doc_id, source FROM '{sf}/documents.parquet'").fetchall())
    taken = Counter()
    for r in got.itertuples():
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
    expected = mix_targets(dict(size))
    assert all(abs(taken[s] - t) <= 1 for s, t in expected.items())
    assert all(abs(r.target - expected[source[r.doc_id]]) < 1e-6 and r.source_size == size[source[r.doc_id]] for r in got.itertuples())


def test_mixing_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 10, 257):
        x = spark.range(n)
        to = mixing.shuffled(F.col("id"), F.lit(n), [F.lit(5), F.lit("k")])
        back = mixing.shuffled(F.col("to"), F.lit(n), [F.lit(5), F.lit("k")], back=True)
        rows = x.select("id", to.alias("to")).select("id", "to", back.alias("back")).collect()
        assert sorted(r.to for r in rows) == list(range(n)) and all(r.id == r.back for r in rows)


def test_mixing_documents(spark):
    rows = [*edge_rows(), *((500 + i, text_of(i, 20 + i % 40), "en", f"s{i % 4}") for i in range(60))]
    docs = frame(spark, rows)
    out = mixing.mixed(docs, 8, 16)
    assert out.columns == docs.columns
    got, taken = Counter(), Counter()
    for r in out.collect():
        assert r.text and r.n_chars == len(r.text)
        got[r.doc_id] += len(WORD.findall(r.text))
    for r in mixing.mix(docs, 8, 16).collect():
        taken[r.doc_id] += r.taken
    assert {k: v for k, v in taken.items() if v} == dict(got)
    assert mixing.mixed(empty(spark)).count() == 0


def test_mixing_is_native(spark, sf, capsys):
    import inspect

    source = inspect.getsource(mixing)
    assert "pandas" not in source and "mapIn" not in source and "udf" not in source.lower()
