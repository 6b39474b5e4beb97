"""Near copies, paragraphs and repeated passages, held against brute force; and connected components."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

import corpus_pipeline
from webarc.llm import ngram_join, paragraphs, suffix_dedup
from webarc.llm.common import components, distinct_per_row

WORD = regex.compile(r"[\p{Han}\p{Thai}]|[^\W_\p{Han}\p{Thai}]+")


def grams(text, n):
    w = WORD.findall(text.lower())
    return frozenset(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def similar(sets, threshold):
    """Pairs (i, j, jaccard), i < j."""
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            at[g].append(i)
    for j, s in enumerate(sets):
        for i, k in Counter(i for g in s for i in at[g] if i < j).items():
            sim = k / (len(s) + len(sets[i]) - k)
            if sim >= threshold:
                yield i, j, sim


def clusters(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def edited(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies(words):
    """Documents of many sizes with copies that are edited more and more, groups of copies and unrelated ones."""
    rng, out = random.Random(3), []
    for n in (1, 2, 3, 5, 8, 12, 20, 40, 90, 200, 400):
        for k in range(4):
            base = words(n, seed=100 * n + k)
            out += [base] + [edited(base, max(1, int(n * share)), rng) for share in (0.01, 0.03, 0.06, 0.1, 0.15, 0.3)]
    out += [words(60, seed=9)] * 12 + [edited(words(60, seed=9), 1, rng) for _ in range(30)] + [words(50, seed=1000 + i) for i in range(60)]
    rng.shuffle(out)
    return out


EDGE = [(900, None), (None, "a b c d"), (901, ""), (902, "!?! ..."), (903, "Ünï 漢字"), (904, "ünï 漢字!"), (905, "lone"), (905, "lone"), (906, "Lone")]


def by_brute_force(rows, threshold=ngram_join.THRESHOLD):
    """Of (key, text) rows: the class and the number of links of each, by comparing all sets."""
    sets = [grams(t or "", 2) or ("lone", k) for k, (_, t) in enumerate(rows)]
    each = list(dict.fromkeys(sets))
    at = {s: k for k, s in enumerate(each)}
    pairs = [(i, j) for i, j, _ in similar([s if isinstance(s, frozenset) else frozenset([s]) for s in each], threshold)]
    links = Counter(x for p in pairs for x in p)
    root = clusters(len(each), pairs)
    keys = defaultdict(list)
    for (k, _), s in zip(rows, sets, strict=True):
        keys[root[at[s]]].append(k)
    lowest = {r: min((k for k in v if k is not None), default=None) for r, v in keys.items()}
    return [(k, lowest[root[at[s]]], links[at[s]]) for (k, _), s in zip(rows, sets, strict=True)]


def test_ngram_join(spark, copies):
    rows = list(enumerate(copies)) + EDGE
    docs = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id bigint, ha string, rep int")
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(docs).collect())
    want = Counter(by_brute_force(rows))
    assert sum(got.values()) == len(rows) and sum((want - got).values()) <= 0.03 * len(rows)
    assert {(903, 903, 0), (904, 903, 0), (905, 905, 0), (906, 905, 0), (900, 900, 0), (None, None, 0), (902, 902, 0)} <= set(got)
    assert sum(n * r[2] for r, n in got.items()) <= sum(n * r[2] for r, n in want.items())


def at_the_threshold(words, sizes, each):
    """Pairs of texts whose sets of grams have a Jaccard similarity of 0.7 or little more, and others of just less."""
    rows = []
    for n in sizes:
        for k in range(each):
            w = words(n, seed=10**6 + 1000 * n + k).split()
            most = int(0.3 / 1.7 * (n - 1)) - k % 2  # of n - 1 grams; a run of m new words changes m + 1
            rows += [" ".join(w), " ".join(w[:7] + [f"new{n}x{k}x{i}" for i in range(most - 1)] + w[6 + most :]), " ".join(w[:7] + [f"newer{n}x{k}x{i}" for i in range(most + 2)] + w[9 + most :])]
    return list(enumerate(rows))


@pytest.mark.parametrize("sample", [None, 1 << 12])
def test_ngram_join_misses_no_pair(spark, words, copies, monkeypatch, sample):
    """Sets of all sizes, whether the counts that order the grams are over all texts or few of them."""
    if sample:
        monkeypatch.setattr(ngram_join, "ORDER_BYTES", sample, raising=False)
    rows = at_the_threshold(words, (20, 35, 60, 90, 150, 230, 260, 400, 900), 12)
    rows += [(10_000 + i, t) for i, t in enumerate(copies)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = by_brute_force(rows)
    assert sum(r[2] for r in want[: len(rows) - len(copies)]) >= 200
    assert Counter(tuple(r) for r in ngram_join.near_duplicates(docs).collect()) == Counter(want)


def test_ngram_join_of_frequent_grams(spark, words, monkeypatch):
    """Texts of few words: each gram is in many sets, most of them not similar."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng, few = random.Random(4), words(12, seed=12).split()
    rows = []
    for i in range(300):
        w = [rng.choice(few) for _ in range(rng.choice((3, 8, 20, 45, 120)))]
        rows += [(3 * i + k, edited(" ".join(w), k * len(w) // 20, rng)) for k in range(3)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter(tuple(r) for r in got) == Counter(by_brute_force(rows))


@pytest.mark.parametrize("only_kept", [False, True])
def test_ngram_join_sends_few_sets(spark, monkeypatch, only_kept):
    """Texts that aren't similar: of grams that the sample doesn't know, those of rare words are taken, and sets that only share a passage are parted before their grams are sent."""
    rng = random.Random(11)
    common, rare = [f"the{i}" for i in range(12)], [f"word{i}" for i in range(4000)]
    passage = " ".join(rng.choice(rare) for _ in range(60))
    texts = [" ".join(rng.choice(rare if rng.random() < 0.5 else common) for _ in range(120)) + (" " + passage if i < 40 else "") for i in range(400)]
    made, write = {}, ngram_join.Stored.write

    def counted(self, df, name):
        out = write(self, df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join.Stored, "write", counted)
    monkeypatch.setattr(ngram_join, "ORDER_BYTES", 40_000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    if only_kept:
        assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 400
    else:
        got = ngram_join.near_duplicates(docs).collect()
        assert len(got) == 400 and not any(r["n_links"] for r in got)
    assert made["met"] < 400 and made["grams"] == 0


def test_ngram_join_with_keys_of_any_type(spark, copies):
    rows = [(f"https://example.org/{i:04}", t) for i, t in enumerate(copies[:120])]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got, want = Counter(tuple(r) for r in ngram_join.near_duplicates(docs).collect()), Counter(by_brute_force(rows))
    assert sum((want - got).values()) <= 4
    kept = {r.doc_id for r in ngram_join.drop_near_duplicates(docs).collect()}
    assert len(kept ^ {c for _, c, _ in want}) <= 4


def test_scripts_without_blanks(spark):
    """Each Chinese character is a word; full-width punctuation isn't part of one."""
    rng = random.Random(2)
    text = "".join(chr(rng.randrange(0x4E00, 0x5E00)) + ("，" if k % 9 == 8 else "") for k in range(150))
    other = text[:40] + "。" + text[41:]
    docs = spark.createDataFrame([(1, text), (2, other), (3, text[::-1])], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in ngram_join.near_duplicates(docs).collect()) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_ngram_filter_tells_rows_of_one_key_apart(spark, words):
    a, b = words(60, seed=1), words(60, seed=2)
    rows = [(1, a), (2, edited(a, 1, random.Random(1))), (2, b), (3, b), (None, a + " more"), (4, None), (4, None), (5, ""), (1, a)]
    kept = Counter(r.doc_id for r in ngram_join.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert kept == Counter([1, 1, 2, 4, 4, 5])


def test_ngram_filter_keeps_one_of_each_group(spark, copies, clashing):
    rows = list(enumerate(copies)) + EDGE
    docs = clashing([(i, t, "en", "s") for i, t in rows])
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    best = by_brute_force(rows)
    want = Counter(k for (k, c, _), (_, t) in zip(best, rows, strict=True) if k == c)
    got = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert sum((want - got).values()) == 0 and sum((got - want).values()) <= 0.03 * len(rows)


def test_ngram_filter_keeps_no_similar_pair(spark, words):
    rows = at_the_threshold(words, (60, 260, 400), 8)
    kept = [r.doc_id for r in ngram_join.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(kept) == sorted({r[1] for r in by_brute_force(rows)})


@pytest.mark.parametrize("edits", [2, 6])
def test_ngram_hot_group(spark, words, monkeypatch, edits):
    """A group far larger than a block, so that blocks meet; with few edits it is one home, with many it isn't."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "STAR", 10)
    rng, base = random.Random(1), words(160, seed=77)
    rows = list(enumerate(edited(base, edits, rng) for _ in range(90)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got, want = sorted(tuple(r) for r in ngram_join.near_duplicates(docs).collect()), by_brute_force(rows)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    links, real = sum(r[2] for r in got), sum(r[2] for r in want)
    assert all(g[2] <= w[2] for g, w in zip(got, want, strict=True)) and links >= 0.97 * real > 0
    kept = [r.doc_id for r in ngram_join.drop_near_duplicates(docs).collect()]
    assert sorted(kept) == sorted({r[1] for r in want})


def test_ngram_chain(spark, words):
    """Versions of a page, each near to the next only: one class, though its ends have nothing in common."""
    rng, w = random.Random(5), words(300, seed=3).split()
    rows = []
    for i in range(400):
        w[rng.randrange(len(w))] = f"v{i}"
        rows.append((i, " ".join(w)))
    got = [tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    want = by_brute_force(rows)
    assert {r[1] for r in got} == {0} and sum(r[2] for r in got) >= 0.97 * sum(r[2] for r in want)


def test_sets_of_grams_that_begin_alike():
    rng = np.random.default_rng(3)
    row = np.sort(rng.integers(0, 40, 5000))
    g = rng.integers(0, 9, 5000).astype(np.uint64) << np.uint64(60) | rng.integers(0, 5, 5000).astype(np.uint64)
    got = list(zip(*(x.tolist() for x in distinct_per_row(g, row)), strict=True))
    assert [(r, x) for x, r in got] == sorted(set(zip(row.tolist(), g.tolist(), strict=True)))


def test_bands_cover_all_sizes():
    b = ngram_join.bands(0.7, 5000)
    assert b[0].low == 1 and all(x.high + 1 == y.low for x, y in zip(b, b[1:], strict=False))
    for x in b:
        assert x.low >= 0.7 * x.high - 1e-6 or x.low == x.high
    for size in (3, 6, 9, 13):  # where all signatures are made, any two sets at the threshold share one
        rng = np.random.default_rng(size)
        for _ in range(100):
            base = rng.integers(0, 2**63, size, np.uint64)
            other = base.copy()
            most = int((1 - 0.7) / (1 + 0.7) * size)
            other[:most] = rng.integers(0, 2**63, most, np.uint64)
            g = np.concatenate([np.sort(base), np.sort(other)])
            s, r = ngram_join.signatures(g, np.repeat([0, 1], size), 2, 0.7)
            assert set(s[r == 0].tolist()) & set(s[r == 1].tolist())


def test_paragraphs(spark, copies, words):
    rng = random.Random(8)
    passage = words(70, seed=4)
    texts = ["\n".join(rng.sample(copies, 3)) for _ in range(80)] + [f"{words(30)} {passage[:200]}. {passage}. {words(20)}." for _ in range(3)] + ["", None, "\n \n", "short. lines. only.", words(5000, seed=2), words(5000, seed=2)]
    rows = list(enumerate(texts)) + [(500, texts[0]), (500, texts[0]), (None, texts[0])]
    docs = spark.createDataFrame([(i, t, "p", 0) for i, t in rows], "doc_id bigint, text string, pid string, start int")
    got = {(r.doc_id, r.start, r.stop): (r.kept_id, r.kept_start, r.is_removed) for r in paragraphs.duplicate_paragraphs(docs).collect()}
    parts = [(i, a, b, t[a:b]) for i, t in rows if i is not None and t is not None for a, b in paragraphs.pieces(t)]
    sets = [grams(p[3], paragraphs.GRAM) for p in parts]
    root = clusters(len(parts), [(i, j) for i, j, _ in similar(sets, paragraphs.THRESHOLD)])
    size = Counter(root)
    want = {parts[i][:3]: min(parts[j][:2] for j in range(len(parts)) if root[j] == root[i]) for i in range(len(parts)) if size[root[i]] > 1}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    same = sum(got[k][:2] == want[k] for k in got)
    assert same >= 0.95 * len(got)
    assert all((k[0], k[1]) == v[:2] or v[2] for k, v in got.items())
    assert (500, *paragraphs.pieces(texts[0])[0]) in got and got[(500, *paragraphs.pieces(texts[0])[0])][2]


def test_pieces():
    long = " ".join(["w"] * 20)
    assert [(x, y) for x, y in paragraphs.pieces(f"{long}. {long}\n{long}")] == [(0, 40), (41, 80), (81, 120)]
    assert paragraphs.pieces("") == [] and paragraphs.pieces("a. b. c.") == []
    short = " ".join(["v"] * 8)
    assert paragraphs.pieces(f"{short}. {short}. {short}") == [(0, 33), (17, 49)] and paragraphs.pieces(f"{short}.\n{short}") == []


def test_every_word_is_in_a_paragraph(words):
    """Short lines and sentences too, unless the whole text is short."""
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(words(rng.choice([1, 2, 5, 6, 9, 15, 30])) + rng.choice([". ", "\n", "\n\n", ".\n"]) for _ in range(rng.randint(1, 25)))
        cover = {i for a, b in paragraphs.pieces(t) for i in range(a, b)}
        left = [w.group() for w in re.finditer(r"\S+", t) if not cover >= set(range(*w.span()))] if len(t.split()) >= paragraphs.LINE_WORDS else []
        assert not left, (t, paragraphs.pieces(t))
        for x, y in zip(p := paragraphs.pieces(t), p[1:], strict=False):  # no paragraph is a near copy of one that it overlaps
            a, b = grams(t[slice(*x)], 2), grams(t[slice(*y)], 2)
            assert y[0] >= x[1] or len(a & b) / len(a | b) < paragraphs.THRESHOLD, (t, x, y)


def test_shared_short_lines(spark, words):
    """A poem of 20 lines of 10 words, in documents whose other short lines come to different numbers."""
    poem = "\n".join(words(10, seed=900 + i) for i in range(20))
    texts = ["\n".join([*(words(7, seed=50 * k + i) for i in range(k)), poem, *(words(9, seed=5000 + 50 * k + i) for i in range(k))]) for k in range(8)]
    got = defaultdict(set)
    for r in paragraphs.duplicate_paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).filter("is_removed").collect():
        got[r.doc_id] |= set(range(r.start, r.stop))
    for k in range(1, 8):
        at = texts[k].index(poem)
        assert len(got[k] & set(range(at, at + len(poem)))) > 0.5 * len(poem), k


def test_tuning_reaches_its_recall():
    for t in (0.5, 0.7, 0.9):
        bands, rows = paragraphs.tune(t, 0.95)
        assert 1 - (1 - t**rows) ** bands >= 0.95 and bands * rows <= paragraphs.MOST_HASHES
    with pytest.raises(ValueError):
        paragraphs.tune(0.01, 0.99, 8)


def passages(rows, match):
    """By brute force: {(id, start, stop, words, again)}."""
    word, at, seen = WORD, {}, defaultdict(list)
    for i, t in sorted(set((i, t) for i, t in rows if i is not None and t is not None)):
        at[i, t] = list(word.finditer(t))
        w = ["".join(c.lower() if c < "\x80" else c for c in m.group()) for m in at[i, t]]
        for k in range(len(w) - match + 1):
            seen[tuple(w[k : k + match])].append((i, k, t))
    runs = defaultdict(list)
    for v in seen.values():
        if len(v) > 1:
            for n, (i, k, t) in enumerate(sorted(v)):
                runs[i, t, n > 0].append(k)
    out = set()
    for (i, t, again), ks in runs.items():
        ks.sort()
        first = last = ks[0]
        for k in [*ks[1:], None]:
            if k is None or k > last + match:
                out.add((i, at[i, t][first].start(), at[i, t][last + match - 1].end(), last - first + match, again))
                first = k
            last = k
    return out


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_repeated_passages(spark, words, batches):
    rng = random.Random(batches)
    shared = [words(n, seed=50 + n) for n in (49, 50, 51, 60, 90, 300)]
    texts = []
    for k in range(70):
        parts = [words(rng.randint(0, 80))] + ([rng.choice(shared)] if k % 2 else []) + [words(rng.randint(0, 40))] + ([rng.choice(shared).upper()] if k % 5 == 0 else [])
        texts.append("\n".join(parts) + " é.")
    texts += ["x " * 300, "", None, words(30), texts[1], texts[1], words(6000, seed=1) + " " + shared[4]]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, shared[5]), (None, shared[5])]
    docs = spark.createDataFrame([(i, t, "z", 5) for i, t in rows], "doc_id bigint, text string, key string, pos int")
    got = {tuple(r) for r in suffix_dedup.repeated_passages(docs, batches=batches).select("doc_id", "start", "stop", "n_words", "is_removed").collect()}
    assert got == passages(rows, suffix_dedup.MATCH)


@pytest.mark.parametrize("batches", [1, 4])
def test_passages_of_two_versions_of_a_page(spark, words, batches):
    """Rows of one id with different texts, whose passage is at the same place in both and nowhere else."""
    rows = [(i, words(70, seed=500 + i) + " " + words(20, seed=600 + i + 50 * k)) for i in range(20) for k in range(2)]
    rows += [(30, words(80, seed=700))] * 2 + [(40 + i, words(90, seed=800 + i)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {tuple(r) for r in suffix_dedup.repeated_passages(docs, batches=batches).collect()}
    assert got == passages(rows, suffix_dedup.MATCH) and {r[0] for r in got} == set(range(20))


def test_levels_grow_geometrically(spark, words):
    index = suffix_dedup.SuffixIndex(spark, 20, 8)
    sizes = []
    for k in range(4):
        index.add(spark.createDataFrame([(k, words(100, seed=k) + " " + words(30, seed=99))], "id bigint, t string"))
        sizes.append([n for n, _ in index.levels])
    assert sizes == [[1], [2], [2, 1], [4]]
    keys = [r.key for _, level in index.levels for r in level.collect()]
    assert len(keys) == len(set(keys))


def test_sampling_is_told_by_the_passage(words):
    """Wherever a passage of the least length stands, the same suffixes of it are in the array."""
    import pyarrow as pa

    passage = words(50, seed=12)
    texts = pa.array([f"{words(n)} {passage} {words(9)}" for n in (0, 3, 40)])
    _, _, h, row, _, _ = suffix_dedup._words(texts)
    keys, at = suffix_dedup.sampled(h, row)
    sets = [set(keys[row[at] == i].tolist()) for i in range(3)]
    assert set.intersection(*sets)


@pytest.mark.parametrize("f", [ngram_join.near_duplicates, ngram_join.drop_near_duplicates, paragraphs.duplicate_paragraphs, suffix_dedup.repeated_passages])
def test_empty_tables(spark, f):
    assert f(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(5, 5), (7, None), (400, 401)]
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    real = [(u, v) for u, v in edges if v is not None and u != v]
    root = clusters(481, real)
    assert got == {i: root[i] for e in real for i in e}
