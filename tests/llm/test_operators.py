"""Each operator against a brute-force version on a small corpus with the odd cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import blocks, chat, decontam, lines, packing
from pointloom.llm.ann import nearest
from pointloom.llm.jaccard import jaccard_join
from pointloom.llm.katz import katz_scores
from pointloom.llm.licenses import TEMPLATES, build, license_scan, matches
from pointloom.llm.queries import tokenizer_path
from pointloom.llm.substring import substring_dedup

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def low(text):
    return (text or "").translate(UPPER)


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


# Substring dedup


def substring_brute(corpus, window):
    words = {d: SPACE.findall(t or "") for d, t, *_ in corpus}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = []
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


@pytest.mark.parametrize("window", [5, 20, 50])
def test_substring(docs, corpus, window):
    assert rows(substring_dedup(docs, window=window), "doc_id", "n_words", "n_removed", "kept_sha256", "kept") == substring_brute(corpus, window)


def test_substring_is_the_same_however_dealt_out(docs, clashing, corpus, monkeypatch):
    want = substring_brute(corpus, 20)
    monkeypatch.setattr(blocks, "CHUNK_BYTES", 700)
    monkeypatch.setattr(blocks.chunks, "__defaults__", (700, False))
    for df in (docs.repartition(1), clashing.repartition(7)):
        assert rows(substring_dedup(df, window=20), "doc_id", "n_words", "n_removed", "kept_sha256", "kept") == want


# Katz


def good_turing(counts):
    n = Counter(counts.values())
    for k in range(5, 0, -1):
        if all(n[r] for r in range(1, k + 2)):
            a = (k + 1) * n[k + 1] / n[1]
            d = {r: ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) for r in range(1, k + 1)} if a != 1 else {1: 0}
            if all(0 < x < 1 for x in d.values()):
                return d
    return {r: 1 - 0.5 / r for r in range(1, 6)}


def katz_brute(corpus, order):
    """(n_tokens, n_known, N, base, score) of each row, from counts, discounts and weights of its own."""
    texts = [(d, [*SPACE.findall(low(t)), None]) for d, t, *_ in corpus]
    counts, size, after = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)], [defaultdict(set) for _ in range(order + 1)]
    for d, w in texts:
        if zlib.crc32(str(d).encode()) % 5 != 1:
            p = ["\n"] * (order - 1) + w
            for i in range(order - 1, len(p)):
                for k in range(1, order + 1):
                    g = tuple(p[i - k + 1 : i + 1])
                    counts[k][g] += 1
                    size[k][g[:-1]] += 1
                    after[k][g[:-1]].add(g[-1])
    d = [None] + [good_turing(c) for c in counts[1:]]
    cut = lambda k, g: d[k].get(counts[k][g], 1) * counts[k][g]
    n, v, known = sum(counts[1].values()), len(counts[1]), {}

    def history(k, h):
        """Backoff weight and scale of the discounted counts."""
        if (k, h) not in known:
            kept = sum(cut(k, (*h, w)) for w in after[k][h])
            left = max(size[k][h] - kept, 0.5)
            mass = sum(p(k - 1, (*h[1:], w)) for w in after[k][h]) if k > 1 else 0
            known[k, h] = left / size[k][h] / (1 - mass), (size[k][h] - left) / kept / size[k][h]
        return known[k, h]

    def p(k, g):
        if not size[k][g[:-1]]:
            return p(k - 1, g[1:]) if k > 1 else 1.0
        weight, scale = history(k, g[:-1])
        return cut(k, g) * scale if counts[k][g] else weight * (p(k - 1, g[1:]) if k > 1 else 1)

    for k in range(1, order + 1):  # probabilities of all words and of the unknown word sum to 1
        for h in list(size[k])[:40]:
            assert sum(p(k, (*h, *w)) for w in counts[1]) + p(k, (*h, "unheard of")) == pytest.approx(1, abs=1e-9)
    out = []
    for x, w in texts:
        whole = ["\n"] * (order - 1) + w
        score = sum(math.log10(p(order, tuple(whole[i - order + 1 : i + 1]))) for i in range(order - 1, len(whole)))
        base = sum(math.log10((counts[1][(y,)] + 0.5) / (n + 0.5 * (v + 1))) for y in w)
        out.append((x, zlib.crc32(str(x).encode()) % 5 == 1, len(w), sum(counts[1][(y,)] > 0 for y in w), n, base, score))
    return out


def same_scores(got, want):
    key = lambda r: (r[0], r[2], r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_katz(docs, clashing, corpus, order):
    same_scores(katz_scores(docs, order).collect(), katz_brute(corpus, order))
    if order == 3:
        same_scores(katz_scores(clashing.repartition(2)).collect(), katz_brute(corpus, 3))


def test_katz_however_dealt_out(spark, docs, corpus, monkeypatch):
    """Small chunks, histories shared out over buckets, repeated ids, capitals, long texts."""
    odd = [*corpus, (3, "The THE the tHe w1"), (3, "The THE the tHe w1"), (7, "W1 w1 " * 3000)]
    monkeypatch.setattr(blocks.chunks, "__defaults__", (900, False))
    df = spark.createDataFrame([r[:2] for r in odd], "doc_id long, text string").repartition(6)
    same_scores(katz_scores(df, 3, share=4).collect(), katz_brute(odd, 3))
    none = spark.createDataFrame([(8, "no training text"), (8, None)], "doc_id long, text string")
    assert zlib.crc32(b"8") % 5 == 1 and {(r.n_known, r.score) for r in katz_scores(none).collect()} == {(0, 0.0)}


# Packing


def test_packing(docs, corpus):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs, tokenizer_path(), capacity=256, with_ids=True).collect()
    want = {}
    for d, t, *_ in corpus:
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 256):
            want[d, k // 256] = (k, ids[k : k + 256])
    assert {(r.doc_id, r.piece): (r.start, list(r.ids)) for r in got} == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= math.ceil(sum(r.length for r in got) / 256) * 1.03 + 1


@pytest.mark.parametrize("text", ["don't stop...", "Å J̌ end", "<|endoftext|> <|ENDOFTEXT|>x", "1a2.b3,,c!?", "É.é:É", " wide space", "'s 't'll", "ǰJ̌!", "İstanbul.", "x" * 5000])
def test_encoder_is_exact(text):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from pointloom.llm import text as T
    from pointloom.llm.tokens import Encoder

    texts = [text, "", text * 3, f"a {text} b", *[f"word{chr(97 + k)}" for k in range(20)]]
    ids, bounds = Encoder(tokenizer_path())(*T.buffers(pa.array(texts)))
    tool = Tokenizer.from_file(tokenizer_path())
    assert [ids[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:], strict=True)] == [tool.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_everything(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(6, 1, 3000).astype(int), 1, 2048)
    counts = Counter(lengths.tolist())
    made = packing.plan(dict(counts))
    filled = defaultdict(list)
    for length, runs in made.runs.items():
        starts = sorted(runs)
        for (r, q, o), end in zip(starts, [*[x[0] for x in starts[1:]], counts[length]], strict=True):
            for k in range(end - r):
                filled[q + k].append((o, length))
    assert sum(map(len, filled.values())) == 3000 and set(filled) == set(range(made.total))
    for found in filled.values():
        assert [o for o, _ in sorted(found)] == [sum(x for _, x in sorted(found)[:k]) for k in range(len(found))] and sum(x for _, x in found) <= 2048
    assert made.total <= math.ceil(lengths.sum() / 2048) * 1.02 + 2


# Nearest neighbours


def test_nearest(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 24))
    x = np.concatenate([centers[k % 12] + rng.normal(scale=0.2, size=24) for k in range(600)] + [np.tile(centers[0], 1)] * 40).reshape(-1, 24)
    rows_ = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    rows_ += [(900, None), (950, [0.0] * 24), (1000, [float("nan")] * 24), (1050, [None] * 24), (1100, [1.0, 2.0]), (None, [1.0] * 24), (1150, [])]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<float>").repartition(4)
    got = defaultdict(list)
    for r in nearest(df, df.where("vec_id % 50 = 0"), piece_rows=50).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    x = x.astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    found = 0
    assert set(got) == set(range(0, 640, 50))
    for q, near in got.items():
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((np.arange(len(s)), -np.round(s, 9)))[:5]
        found += len(set(best) & {v for v, _ in near})
        assert all(abs(s[v] - c) < 1e-12 for v, c in near) and len(near) == 5
    assert found >= 0.9 * 5 * len(got)
    assert nearest(df.limit(0), df).count() == 0


def vectors(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("n", [1, 2, 4, 6])
def test_nearest_finds_all_of_few(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    df, unit = vectors(spark, x), x / np.linalg.norm(x, axis=1)[:, None]
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest(df, df).orderBy("query_id", "rank").collect()]
    want = [(q, i + 1, int(v)) for q in range(n) for i, v in enumerate([v for v in np.argsort(-(unit @ unit[q])) if v != q][:5])]
    if n < 6:
        assert got == want
    else:
        assert len(got) == len(want) and {(q, v) for q, _, v in got} <= {(q, v) for q in range(n) for v in range(n) if q != v}


def test_nearest_of_a_cluster_opposite(spark):
    """Queries that meet no row at first have k rows in the end."""
    rng = np.random.default_rng(2)
    c = rng.normal(size=64)
    c /= np.linalg.norm(c)
    x, q = c + rng.normal(scale=0.02, size=(1500, 64)), -c + rng.normal(scale=0.02, size=(10, 64))
    asked = vectors(spark, q).selectExpr("vec_id + 5000 as vec_id", "embedding")
    got = defaultdict(list)
    for r in nearest(vectors(spark, x), asked, piece_rows=200).orderBy("query_id", "rank").collect():
        got[r.query_id - 5000].append(r.score)
    cos = np.sort((q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T, axis=1)[:, ::-1]
    assert sorted(got) == list(range(10)) and all(len(v) == 5 and (np.array(v) <= cos[k, :5] + 1e-12).all() for k, v in got.items())


# Chat


def test_chat(spark):
    turns = {1: "abc", 2: "abcd", 3: "abcd", 4: "x", 5: "ab", 6: "ac", 7: "xy", 8: "z", 9: "z"}
    found = [(c, k * 2, "user" if k % 2 == 0 else None, t if t != "z" else None) for c, text in turns.items() for k, t in enumerate(text)]
    found += [(None, 0, "user", "q"), (10, 0, "user", "")]
    df = spark.createDataFrame(found, "conv_id long, turn long, role string, text string").withColumn("hash", F.lit(1)).repartition(3)
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.collapse(df).collect()}
    assert {k: v[:2] for k, v in got.items()} == {2: (4, 2), 6: (2, 1), 7: (2, 1), 8: (1, 2), 10: (1, 1)}
    assert got[6][2] == "<|user|>\na\n<|end|>\n<|unknown|>\nc\n<|end|>\n" and got[8][2] == got[10][2]
    assert chat.collapse(df.limit(0)).count() == 0
    plan = chat.collapse(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Line dedup


def lines_brute(corpus, run):
    split = {d: (t or "").split("\n") if t else [] for d, t, *_ in corpus}
    seen, out = set(), []
    for d in sorted(split):
        x, gone = split[d], set()
        for i in range(len(x) - run + 1):
            k = tuple(x[i : i + run])
            if k in seen:
                gone.update(range(i, i + run))
            seen.add(k)
        out.append((d, len(x), len(gone), "\n".join(v for i, v in enumerate(x) if i not in gone)))
    return out


@pytest.mark.parametrize(("run", "gram"), [(1, 1), (2, 2), (3, 2), (4, 1)])
def test_lines(docs, corpus, run, gram):
    assert rows(lines.line_dedup(docs, run, gram), "doc_id", "n_lines", "n_removed", "text") == lines_brute(corpus, run)


def lines_words_brute(corpus, run, words):
    split = {d: (t or "").split("\n") if t else [] for d, t, *_ in corpus}
    seen, out = set(), []
    for d in sorted(split):
        x, gone = split[d], set()
        for i in range(len(x)):
            for m in range(1, run + 1):
                k = tuple(x[i : i + m])
                if i + m <= len(x) and (m == run or sum(len(SPACE.findall(v)) for v in k) >= words):
                    if k in seen:
                        gone.update(range(i, i + m))
                    seen.add(k)
        out.append((d, len(x), len(gone), "\n".join(v for i, v in enumerate(x) if i not in gone)))
    return out


@pytest.mark.parametrize(("run", "gram", "words"), [(3, 2, 50), (3, 2, 8), (4, 1, 12), (2, 2, 1)])
def test_lines_by_words(spark, docs, corpus, run, gram, words):
    got = rows(lines.line_dedup(docs, run, gram, words), "doc_id", "n_lines", "n_removed", "text")
    assert got == lines_words_brute(corpus, run, words)
    if words == 50:
        assert got == rows(lines.line_dedup(docs), "doc_id", "n_lines", "n_removed", "text") != lines_brute(corpus, run)
    # A passage on one line, and on two lines, between other lines.
    one, two = " ".join(f"a{k}" for k in range(60)), "\n".join(" ".join(f"{c}{k}" for k in range(30)) for c in "bc")
    texts = [(1, f"x\n{one}\ny"), (2, f"{one}\nz"), (3, f"u\n{two}"), (4, f"{two}\nv"), (5, one), (6, f"{one}\n{one}\nw"), (7, f"o\n{one}\t")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert rows(lines.line_dedup(df, run, gram, words), "doc_id", "n_lines", "n_removed", "text") == lines_words_brute(texts, run, words)


def test_lines_keep_columns(clashing, corpus):
    got = lines.deduped(clashing.withColumn("extra", F.array("doc_id")))
    assert got.columns == [*clashing.columns, "extra"]
    want = {d: t for d, n, gone, t in lines_brute(corpus, 3) if not n or gone < n}
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert all(r.extra == [r.doc_id] and r.n_chars == len(r.text) and r.n_removed == "clash" for r in got.collect())


# Decontamination


def decontam_brute(corpus, items, window):
    parts = []
    for k, t in items:
        w = ALNUM.findall(low(t))
        m = min(window, len(w))
        parts += [(k, tuple(w[i : i + m])) for i in range(len(w) - m + 1)] if w else []
    out = []
    for d, t, *_ in corpus:
        w = ALNUM.findall(low(t))
        hit, found = set(), set()
        for k, p in parts:
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found.add(k)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("part_words", [500_000, 20])
def test_decontamination(spark, docs, corpus, part_words):
    items = [(1, corpus[8][1]), (20, " ".join((corpus[5][1] or "x").split()[3:40])), (3, "changed"), (4, None), (5, "..."), (6, "The of"), (7, "a a a a"), (20, "w1 W2"), (100, "x x x x x x x x x x x")]
    df = spark.createDataFrame([*items, (None, "w1")], "item_id long, text string")
    got = decontam.digest(decontam.decontaminate(docs, df, 10, part_words))
    assert rows(got, *got.columns) == decontam_brute(corpus, items, 10)
    none = decontam.decontaminate(docs, df.limit(0))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(corpus)


# Jaccard join


def jaccard_brute(corpus, size, percent):
    sets = {}
    for d, t, *_ in corpus:
        w = SPACE.findall(low(t))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d)) for d, s in sets.items())


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (3, 60), (1, 80), (5, 95)])
def test_jaccard(docs, clashing, corpus, size, percent):
    want = jaccard_brute(corpus, size, percent)
    assert rows(jaccard_join(docs, size, percent), "doc_id", "n_shingles", "component_id") == want
    if percent == 60:
        assert rows(jaccard_join(clashing.repartition(3), size, percent), "doc_id", "n_shingles", "component_id") == want


def test_jaccard_links_chains(spark):
    """Neighbours of a chain link, its ends do not."""
    base = [f"t{k}" for k in range(300)]
    chain = []
    for k in range(40):
        chain.append((k, " ".join(f"c{j // 3}x{j}" if j < 3 * k else w for j, w in enumerate(base))))
    df = spark.createDataFrame(chain, "doc_id long, text string").repartition(6)
    want = jaccard_brute([(d, t) for d, t in chain], 3, 90)
    assert rows(jaccard_join(df), "doc_id", "n_shingles", "component_id") == want


# Licenses


def test_licenses(spark, docs):
    mit, words = TEMPLATES["MIT"][1], TEMPLATES["MIT"][1].split()
    texts = [
        (1, "intro " * 37 + mit.upper() + " outro" * 50), (2, " ".join(words[: len(words) // 2])), (3, "foo Released under\nthe MIT license, bar"), (4, None), (5, ""),
        (6, " ".join("typo" if k == 40 else w for k, w in enumerate(words))), (7, "Licensed under CC BY 4.0. " * 2), (8, "Licensed under CC BY-NC 4.0."),
    ]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(texts, "doc_id long, text string").withColumn("licenses", F.lit(0))).collect()}
    assert {k: v.licenses for k, v in got.items()} == {1: ["MIT"], 2: [], 3: ["MIT"], 4: [], 5: [], 6: ["MIT"], 7: ["CC-BY-4.0"], 8: ["CC-BY-NC-4.0"]}
    assert [(m.start, m.stop, m.containment) for m in got[1].matches] == [(37, 37 + len(ALNUM.findall(low(mit))), 1.0)]
    assert 0.8 <= got[6].matches[0].containment < 1 and len(got[7].matches) == 1
    assert license_scan(docs).count() == docs.count()


def licenses_brute(text, templates):
    """(license, start, stop, containment) from plain sets of every window of every template."""
    w, found = ALNUM.findall(low(text)), []
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    for name, texts in templates.items():
        for t in texts:
            words = ALNUM.findall(low(t))
            own = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
            places = len(words) - 4
            block = 1
            while 2 * block <= places // 4:
                block *= 2
            width = (math.ceil((places - 1) / block) + 1) * block
            for at in range(0, len(grams), block):
                spots = [k for k in range(at, min(at + width, len(grams))) if grams[k] in own]
                share = len({grams[k] for k in spots}) / len(own)
                if len({grams[k] for k in spots}) * 100 >= 80 * len(own):
                    found.append((name, spots[0], spots[-1] + 5, share))
    kept = []
    for name, start, stop, share in sorted(found, key=lambda x: (x[0], x[1], -x[3], x[2])):
        if kept and kept[-1][0] == name and start <= kept[-1][2]:
            if share > kept[-1][3]:
                kept[-1] = (name, start, stop, share)
            continue
        kept.append((name, start, stop, share))
    return kept


def test_licenses_against_brute_force(spark):
    import random

    rng = random.Random(9)
    texts = []
    for k in range(60):
        w = [rng.choice(["the", "of", "software", "license", "and", f"w{rng.randrange(50)}"]) for _ in range(rng.choice([0, 3, 30, 200]))]
        for name in rng.sample(sorted(TEMPLATES), rng.randrange(3)):
            t = rng.choice(TEMPLATES[name]).split()
            for _ in range(rng.choice([0, 0, 1, 3, len(t) // 8])):
                t[rng.randrange(len(t))] = "changed"
            at = rng.randrange(len(w) + 1)
            w = w[:at] + t * rng.choice([1, 1, 2]) + w[at:]
        texts.append((k % 50, " ".join(w)))
    texts += [(90, None), (91, " \n"), (92, "x y " * 300_000 + TEMPLATES["MIT"][1])]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("matches", F.lit("clash")).repartition(4)
    key = lambda r: (r[0], str(r[1]))
    got = sorted(((r.doc_id, [tuple(m) for m in r.matches], r.licenses) for r in license_scan(df).collect()), key=key)
    want = sorted(((d, m, sorted({x[0] for x in m})) for d, t in texts for m in [licenses_brute(t, TEMPLATES)]), key=key)
    assert got == want and sum(bool(m) for _, m, _ in want) > 20


def test_license_bands_retrieve():
    """Without the bands' tables nothing is retrieved, and no template may be missed by more than the stated chance."""
    import pyarrow as pa

    from pointloom.llm import licenses
    from pointloom.llm import text as T

    tables = build({"A": ["one two three four five six seven eight nine"]})
    assert all(t.miss <= licenses.MISS for t in build(TEMPLATES).templates)
    for k in range(40):
        w = T.words(*T.buffers(pa.array(["pad " * k + "one two three four five six seven eight nine" + " end" * (40 - k)])), T.ALNUM, lower=True)
        assert matches(w.hashes, w.others, w.offsets, tables)
    tables.shapes = {}
    assert not matches(w.hashes, w.others, w.offsets, tables)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert substring_dedup(none).count() == katz_scores(none).count() == jaccard_join(none).count() == 0
    assert lines.line_dedup(none).count() == license_scan(none).count() == packing.pack(none, tokenizer_path()).count() == 0


def test_rows_without_an_id_go_and_repeated_rows_stay(spark, docs):
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (1, "other words here in a row")], "doc_id long, text string")
    assert rows(substring_dedup(odd, window=3), "doc_id", "n_removed") == [(1, 0)] * 3
    assert rows(lines.line_dedup(odd, 1, 1), "doc_id", "n_removed") == [(1, 0)] * 3
    assert rows(jaccard_join(odd), "doc_id", "component_id") == [(1, 1)] * 3
    assert katz_scores(odd).count() == 3 and packing.pack(odd, tokenizer_path()).count() == 3


def thue_morse(n):
    """Two strings of 2^n letters that every polynomial hash modulo 2^64 takes for equal."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_unequal_strings_with_equal_polynomials_stay_apart(spark):
    from tokenizers import Tokenizer

    a, b = thue_morse(11)
    rest = [f"r{k}" for k in range(60)]
    texts = [(1, " ".join([a, *rest[:49]])), (2, " ".join([b, *rest[:49]])), (3, " ".join(a)), (4, " ".join(b)), (5, f"{a}\nx\ny"), (6, f"{b}\nx\ny"), (7, a), (8, b)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    assert rows(substring_dedup(df), "doc_id", "n_words", "n_removed", "kept_sha256", "kept") == substring_brute(texts, 50)
    assert rows(lines.line_dedup(df, 3), "doc_id", "n_lines", "n_removed", "text") == lines_brute(texts, 3)
    items = [(1, texts[0][1]), (2, " ".join(b)[:39])]
    got = decontam.digest(decontam.decontaminate(df, spark.createDataFrame(items, "item_id long, text string")))
    assert rows(got, *got.columns) == decontam_brute(texts, items, 10)
    assert rows(jaccard_join(df, 3, 90), "doc_id", "n_shingles", "component_id") == jaccard_brute(texts, 3, 90)
    same_scores(katz_scores(df).collect(), katz_brute(texts, 3))
    tool = Tokenizer.from_file(tokenizer_path())
    ids = {r.doc_id: list(r.ids) for r in packing.pack(df.where("doc_id > 6"), tokenizer_path(), capacity=1 << 14, with_ids=True).collect()}
    assert ids == {d: [*tool.encode(t, add_special_tokens=False).ids, 0] for d, t in texts if d > 6}


def test_near_misses_and_copies_in_one_cluster(spark, monkeypatch):
    """Groups of links larger than a block, next to documents that are alike but below the similarity."""
    import random

    from pointloom.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 7)
    rng = random.Random(4)
    base = [f"t{k}" for k in range(120)]
    texts = []
    for k in range(70):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 4, 5, 9])):
            w[rng.randrange(120)] = f"x{rng.randrange(900)}"
        texts.append((k, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert rows(jaccard_join(df, 3, 90), "doc_id", "n_shingles", "component_id") == jaccard_brute(texts, 3, 90)


def test_long_texts_and_repeated_rows(spark):
    """A text above a slice, one above a chunk, and rows that share an id, with clashing columns."""
    long = " ".join(f"k{k % 7001}" for k in range(300_000)) + "\none line"
    most = ("word " * 30 + "\n") * 60_000  # 9 MB
    texts = [(1, long), (2, most), (3, "word word"), (3, "word word"), (3, "else"), (None, "gone"), (4, None), (5, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({k: F.lit("clash") for k in ("ids", "piece", "n_words", "items", "licenses", "held_out", "chunk")}).repartition(3)
    held = [r for r in texts if r[0] is not None]
    got = decontam.decontaminate(df, spark.createDataFrame([(1, "k1 k2 k3 k4"), (1, "k1 k2 k3 k4")], "item_id long, text string").withColumn("spans", F.lit(1)))
    assert rows(got, "doc_id", "n_words", "n_hit") == sorted((d, len(ALNUM.findall(low(t))), 4 * 42 + 4 * (d == 1 and 300_000 % 7001 > 4) if d == 1 else 0) for d, t in held)
    pieces = packing.pack(df, tokenizer_path()).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("length").alias("tokens"), F.countDistinct("sequence_id").alias("s")).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3, 4, 5} and {r.doc_id: r.tokens for r in pieces}[5] == 1
    assert rows(license_scan(df).withColumn("n", F.size("matches")), "doc_id", "n") == sorted((d, 0) for d, _ in held)
    assert decontam.decontaminate(df.limit(0), spark.createDataFrame([(1, "k1")], "item_id long, text string")).count() == 0
    scores = {r.doc_id: r for r in katz_scores(df.where("doc_id = 1 or doc_id > 3")).collect()}
    assert scores[1].n_tokens == 300_003 and scores[4].n_tokens == 1


def test_nearest_with_repeated_ids_and_clashing_columns(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 16))
    found = [(k % 40, [float(v) for v in r]) for k, r in enumerate(x)]
    df = spark.createDataFrame(found, "vec_id long, embedding array<double>").withColumns({k: F.lit("clash") for k in ("t", "axis", "code", "low", "high", "vec")}).repartition(4)
    got = defaultdict(list)
    for r in nearest(df, df.where("vec_id < 3"), probes=32).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(3):
        best = defaultdict(lambda: -9.0)
        for a in (k for k in range(60) if k % 40 == q):
            for b in range(60):
                if b % 40 != q:
                    best[b % 40] = max(best[b % 40], float(unit[a] @ unit[b]))
        want = sorted(((v, round(s, 9)) for v, s in best.items()), key=lambda p: (-p[1], p[0]))[:5]
        assert got[q] == want


def test_chat_with_repeated_rows(spark):
    found = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "user", "a"), (2, 2, "x", None), (3, None, None, None)]
    df = spark.createDataFrame(found, "conv_id long, turn long, role string, text string").withColumns({"place": F.lit(1), "turns": F.lit(2), "n_copies": F.lit(3)})
    assert sorted((r.conv_id, r.n_turns, r.n_copies) for r in chat.collapse(df).collect()) == [(2, 3, 1), (3, 1, 1)]


def test_nearest_among_copies(spark):
    """Of many equal vectors the smallest ids are the nearest, and a piece sends no more of them."""
    from pointloom.llm import ann

    rng = np.random.default_rng(3)
    x = np.concatenate([np.tile(rng.normal(size=(1, 32)), (300, 1)), rng.normal(size=(60, 32))])
    got = defaultdict(list)
    for r in nearest(vectors(spark, x), vectors(spark, x).where("vec_id % 100 = 0"), piece_rows=50).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[100] == got[200] == [0, 1, 2, 3, 4]
    names = np.zeros((400, 2), np.uint64)
    assert ann._least_of_each(np.arange(400)[::-1].copy(), names, 6).tolist() == [399, 398, 397, 396, 395, 394]


def test_chat_with_many_turns(spark):
    """Hashes take time in proportion to the turns, and their order counts."""
    n = 30000
    long = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    part = long.where(f"turn < {n} - 1").withColumn("conv_id", F.lit(2))
    turned = long.withColumns({"conv_id": F.lit(3), "turn": n - F.col("turn")})
    got = chat.collapse(long.unionByName(part).unionByName(turned)).select("conv_id", "n_turns", F.length("rendered").alias("n")).collect()
    assert sorted((r.conv_id, r.n_turns) for r in got) == [(1, n), (3, n)] and len({r.n for r in got}) == 1
