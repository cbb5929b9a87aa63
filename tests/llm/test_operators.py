"""Each corpus operator against a plain version, over tables with nulls, empty and long texts, ties, repeated rows, clashing
columns and no rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import components, cotraining, decontaminate, exact_dedup, jaccard_join, mixing, pii, sentence_spans, suffix_dedup, token_records, toxicity

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "mo", "ti", "re", "su", "lé", "Ni", "9x") for b in ("la", "no", "vi", "der", "ß", "k", "x1", "um")]


def texts(seed, n=60):
    """Texts with exact and near copies, shared passages, null, empty and long ones."""
    rng = random.Random(seed)
    line = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    passage = line(70) + ". "
    out = [None, "", "   ", "a", "Ab ab", "x\n\ny"]
    while len(out) < n:
        t = ". ".join(line(rng.randint(3, 14)) for _ in range(rng.randint(1, 9)))
        kind = rng.randrange(6)
        if kind == 0:
            out += [t, t.upper() if t.isascii() else t, t]
        elif kind == 1:
            words = line(120).split()
            out.append(" ".join(words))
            for _ in range(rng.randint(1, 5)):
                copy = list(words)
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
                out.append(" ".join(copy))
        elif kind == 2:
            out.append(t + " " + passage + line(5))
        else:
            out.append(t)
    out.append("é" * 3000 + " " + "ab " * 2000)
    return out


def table(spark, rows):
    """Rows of texts as documents, with a null id, a repeated row and columns that operators use inside."""
    data = [(i, t, "en", f"s{i % 3}", None) for i, t in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS k", "2 AS sig", "3 AS head", "4 AS hits", "5 AS n", "6 AS print", "7 AS g").repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def odd_rows(spark):
    t = "one two three four five six seven eight nine ten eleven twelve. " * 9
    return spark.createDataFrame([(None, t, None, None, None), (None, None, None, None, None), (4, t, None, None, None), (4, t, None, None, None), (5, None, None, None, None)], SCHEMA)


# --- exact dedup


def plain_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in enumerate(rows):
        groups[(t or "").translate(AZ)].append(i)
    return {i: (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}


def test_exact_dedup(spark):
    rows = texts(1) + ["same"] * 300
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(table(spark, rows), keep="largest").collect()}
    assert got == plain_exact(rows)
    small = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(table(spark, rows)).collect()}
    assert small[len(rows) - 1] == len(rows) - 300
    assert exact_dedup.dedup(table(spark, rows)).count() == len({(t or "").translate(AZ) for t in rows})


def test_exact_dedup_odd(spark):
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    rows = exact_dedup.exact_groups(odd_rows(spark), keep="largest").collect()
    assert len(rows) == 5 and sum(r.kept for r in rows) == 2
    assert {r.keep_id for r in rows if r.group_size == 3} == {4} and {r.keep_id for r in rows if r.group_size == 2} == {5}


# --- decontamination


def plain_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(AZ))


def plain_overlaps(rows, items, window=10):
    wins = collections.defaultdict(set)
    for item, t in items:
        w = plain_words(t)
        for j in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[j : j + window])].add(item)
    out = {}
    for i, t in enumerate(rows):
        w = plain_words(t)
        hit, found = set(), set()
        for win, its in wins.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    found |= its
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 23, 150])
def test_decontamination(spark, block_bytes):
    rows = texts(2, 40)
    long = next(t for t in rows if t and len(t.split()) > 60).split()
    items = [(1, " ".join(long[3:30])), (22, " ".join(long[10:20])), (3, "ab AB"), (4, None), (5, "..."), (6, "zz yy xx ww"), (7, "ab " * 15), (8, " ".join(long[:9]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(table(spark, rows), bench, block_bytes=block_bytes).collect()}
    assert got == plain_overlaps(rows, items)
    best = {r.doc_id: (r.longest, r.longest_item, r.longest_start) for r in decontaminate.find_overlaps(table(spark, rows), bench, block_bytes=block_bytes).collect()}
    assert best[rows.index(" ".join(long))] == (27, 1, 3)


def test_decontamination_odd(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame([(1, "three four"), (None, "one two")], "item_id long, text string")
    assert decontaminate.report(empty(spark), bench).count() == 0
    assert decontaminate.report(odd_rows(spark), none).where("contaminated").count() == 0
    assert decontaminate.report(odd_rows(spark), bench).where("contaminated AND n_hit = 18").count() == 3
    assert decontaminate.clean(odd_rows(spark), bench).count() == 2


# --- Jaccard join


def plain_components(rows, words, num, den):
    sets = {}
    for i, t in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(AZ))
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("words,num,den", [(3, 9, 10), (5, 8, 10)])
def test_jaccard(spark, words, num, den):
    rows = texts(3, 70)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(table(spark, rows), words=words, num=num, den=den).collect()}
    assert got == plain_components(rows, words, num, den)


def test_jaccard_chain(spark):
    """Copies of copies: neighbours are linked, ends are not."""
    words = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(14):
        words[(7 * k) % 150] = f"new{k}"
        rows.append(" ".join(words))
    rows += rows[:5]
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(table(spark, rows), words=3, num=9, den=10).collect()}
    want = {i: c for i, (_, c) in plain_components(rows, 3, 9, 10).items()}
    assert got == want and set(got.values()) == {0}


def test_jaccard_odd(spark):
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0
    got = sorted((str(r.doc_id), r.n_shingles > 0, r.component_id) for r in jaccard_join.near_duplicates(odd_rows(spark)).collect())
    assert got == [("4", True, 4), ("4", True, 4), ("5", False, 5), ("None", False, None), ("None", True, 4)]


def test_jaccard_repeated_rows_count_once(spark):
    """Documents of two thirds common words, far below the threshold, one or both of them in the table twice."""
    rng = random.Random(18)
    data = []
    for k in range(0, 60, 3):
        words = [f"w{rng.randrange(10**9)}" for _ in range(80)]
        other = words[:58] + [f"w{rng.randrange(10**9)}" for _ in range(22)]
        data += [(None if k % 2 else k, " ".join(words), "en", "s", None)] * 2 + [(k + 1, " ".join(other), "en", "s", None)] * (1 + k % 2)
    docs = spark.createDataFrame(data, SCHEMA)
    got = jaccard_join.near_duplicates(docs, words=3, num=8, den=10).collect()
    assert len(got) == len(data) and all(r.component_id == r.doc_id for r in got)


def test_jaccard_lists_all_links(spark):
    """Forty near copies: every pair above the threshold is a link, not one per member only."""
    rng = random.Random(19)
    words = [f"w{k}" for k in range(150)]
    rows = [" ".join(f"new{k}" if j == 3 + 3 * k else w for j, w in enumerate(words)) for k in range(40)] + texts(20, 30)
    rows += rng.sample(rows, 10)
    documents, links, _ = jaccard_join.linked(table(spark, rows), words=3, num=9, den=10)
    keys = {r.doc_id: (r.k, r.n_shingles) for r in documents.select("doc_id", "n_shingles", F.xxhash64("sig").alias("k")).collect()}
    sets = {}
    for i, t in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(AZ))
        if w:
            sets[keys[i][0]] = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)])
    want = {frozenset((a, b)): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b])}
    got = [(frozenset((r.a, r.b)), r.overlap) for r in links.collect()]
    assert len(got) == len(want) > 700 and dict(got) == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(k, k + 1) for k in range(100, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {x: x for e in edges for x in e if x is not None}
    for _ in range(200):
        for a, b in edges:
            if a is not None and b is not None:
                up[a] = up[b] = min(up[a], up[b])
    nodes = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    assert got == {x: up[x] for x in nodes}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- suffix dedup


def plain_repeats(rows, least):
    raws = [(t or "").encode() for t in rows]
    count = collections.Counter(b[k : k + least] for b in raws for k in range(len(b) - least + 1))
    out = {}
    for i, b in enumerate(raws):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - least + 1):
            if count[b[k : k + least]] > 1:
                gone[k : k + least] = True
        edges = np.diff(np.concatenate(([False], gone, [False])).astype(int))
        out[i] = (len(b), np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist(), np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("least,most", [(40, 4000), (40, 2), (400, 4000)])
def test_suffix_dedup(spark, least, most):
    rows = [t if t is None or len(t) < 2500 else t[:2500] for t in texts(5, 50)]
    got = {r.doc_id: (r.n_bytes, list(r.removed_starts), list(r.removed_ends), bytes(r.kept)) for r in suffix_dedup.remove_repeats(table(spark, rows), least=least, most=most).collect()}
    assert got == plain_repeats(rows, least)


def test_suffix_dedup_odd(spark):
    assert suffix_dedup.remove_repeats(empty(spark), least=40).count() == 0
    rows = suffix_dedup.remove_repeats(odd_rows(spark), least=40).collect()
    assert sorted(len(r.kept) for r in rows) == [0] * 5


def test_texts_longer_than_a_block(spark):
    """A passage across the end of a stretch of 4 MB; the operators that hold a text at once read it to its end."""
    rng = np.random.default_rng(25)
    big = "".join(np.array(list("abcdefghijklmnop "))[rng.integers(0, 17, 4_500_000)])
    passage = big[3_999_700:4_000_300]
    rows = [big, "Q" * 50 + passage + "Q" * 50, big.upper(), "x"]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(rows)], SCHEMA)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs.where("doc_id < 2")).collect()}
    for i, at in ((0, 3_999_700), (1, 50)):
        (a,), (b,) = got[i].removed_starts, got[i].removed_ends
        assert (a, b) == (at, at + 600) and bytes(got[i].kept) == (rows[i][:a] + rows[i][b:]).encode()
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(docs).collect()} == {0: 0, 1: 1, 2: 0, 3: 3}
    tail = " ".join(big.split()[-10:])
    items = spark.createDataFrame([(7, tail)], "item_id long, text string")
    found = {r.doc_id: r.n_hit for r in decontaminate.report(docs, items).collect()}
    assert found == {0: 10, 1: 0, 2: 10, 3: 0}


def test_transform_against_counts():
    rng = random.Random(6)
    for _ in range(60):
        least = rng.choice([3, 5, 16, 33])
        base = [bytes(rng.choice(b"ab") for _ in range(rng.randint(least, 80))) for _ in range(3)]
        segs = list(dict.fromkeys(rng.choice(base) + rng.choice(base)[: rng.randint(0, 30)] for _ in range(rng.randint(1, 10))))
        weights = [rng.choice([1, 1, 2]) for _ in segs]
        count = collections.Counter()
        for s, w in zip(segs, weights):
            for k in range(len(s) - least + 1):
                count[s[k : k + least]] += w
        got = [[k for a, b in zip(*r) for k in range(a, b)] for r in suffix_dedup.repeated_windows(segs, weights, least)]
        assert got == [[k for k in range(len(s) - least + 1) if count[s[k : k + least]] > 1] for s in segs]


# --- sentence spans


def plain_spans(rows, span, min_words):
    units = {i: sentence_spans.sentences(t or "") for i, t in enumerate(rows)}
    first, gone = {}, collections.defaultdict(set)
    for i in sorted(units):
        for k in range(len(units[i]) - span + 1):
            run = units[i][k : k + span]
            if sum(u[2] for u in run) >= min_words:
                key = tuple(" ".join(u[3]).lower() for u in run)
                if key in first:
                    gone[i] |= set(range(k, k + span))
                else:
                    first[key] = i
    return {i: (len(u), len(gone[i]), "".join(rows[i][a:b] for k, (a, b, *_) in enumerate(u) if k not in gone[i]) if u else (rows[i] or "")) for i, u in units.items()}


def test_sentence_spans(spark):
    rows = texts(7, 60)
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.clean_text) for r in sentence_spans.remove_repeats(table(spark, rows)).collect()}
    assert got == plain_spans(rows, 3, 12)
    for t in rows:
        u = sentence_spans.sentences(t or "")
        if u:
            assert u[-1][1] == len(t) and all(a[1] == b[0] for a, b in zip(u, u[1:]))


def test_sentence_spans_odd(spark):
    assert sentence_spans.remove_repeats(empty(spark)).count() == 0
    rows = sentence_spans.remove_repeats(odd_rows(spark)).collect()
    assert len(rows) == 5 and len({r.clean_text for r in rows if r.doc_id == 4}) == 1


def distinct_words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]


def test_copy_inside_a_long_sentence_is_found(spark):
    """A passage of 70 words without a full stop, copied behind 0 to 9 other words."""
    rng = random.Random(16)
    passages = [distinct_words(rng, 70) for _ in range(20)]
    rows = [" ".join(distinct_words(rng, 40) + p + distinct_words(rng, 30)) for p in passages]
    rows += [" ".join(distinct_words(rng, 31 + k % 10) + p + distinct_words(rng, 25)) for k, p in enumerate(passages)]
    got = {r.doc_id: r for r in sentence_spans.remove_repeats(table(spark, rows)).collect()}
    for k, p in enumerate(passages):
        assert got[k].n_removed == 0 and got[20 + k].first_docs == [k]
        assert 36 <= got[20 + k].n_words_removed <= 70 and set(rows[20 + k].split()) - set(got[20 + k].clean_text.split()) <= set(p)


def test_pieces_of_periodic_text_fall_alike():
    for period in (["ab"], ["ab", "cd"], ["ab", "cd", "ef"]):
        units = [{" ".join(u[3]) for u in sentence_spans.sentences(" ".join(distinct_words(random.Random(k), 20 + k) + period * 90))[6:-2]} for k in range(5)]
        assert set.intersection(*units)


def test_copies_of_short_sentences_are_found(spark):
    """Lines of one and two words: a span takes as many as it needs, and the last lines are in one too."""
    rng = random.Random(17)
    lines = [" ".join(distinct_words(rng, rng.randint(1, 2))) for _ in range(30)] + ["x", "y"]
    rows = ["\n".join([*distinct_words(rng, 3), *lines, *distinct_words(rng, 3)]) for _ in range(2)]
    got = {r.doc_id: r for r in sentence_spans.remove_repeats(table(spark, rows)).collect()}
    assert got[0].n_removed == 0 and got[1].n_removed == len(lines)
    assert got[1].clean_text.split() == rows[1].split()[:3] + rows[1].split()[-3:]
    few = "one two\nthree four\nfive six"
    assert {r.n_removed for r in sentence_spans.remove_repeats(table(spark, [few, few + "\nseven"])).collect()} == {0}


# --- mixing


def test_rake_meets_targets():
    rng = random.Random(8)
    cells = [(s, x, t, rng.randint(1, 1000)) for s in "abc" for x in "de" for t in "fgh" if rng.random() < 0.9]
    targets = {"source": {"a": 0.2, "b": 0.5, "c": 0.3}, "lang": {"d": 0.6, "e": 0.4}, "topic": {"f": 0.1, "g": 0.1, "h": 0.8}}
    mass = mixing.rake(cells, targets)
    for k, m in enumerate(mixing.MARGINS):
        for v, want in targets[m].items():
            assert math.isclose(sum(x for c, x in zip(cells, mass) if c[k] == v), want, abs_tol=1e-7)
    tokens = np.array([c[3] for c in cells], float)
    p = mixing.probabilities(tokens, mass, 0.6)
    assert p.max() <= 1 and math.isclose((p * tokens).sum(), 0.6 * tokens.sum(), rel_tol=1e-9)
    free = p < 1
    assert np.allclose(p[free] / (mass / tokens)[free], (p[free] / (mass / tokens)[free])[0])


def test_mixing(spark):
    rows = [" ".join(["w"] * (1 + i % 50)) for i in range(600)] + [None, ""]
    docs = table(spark, rows).withColumn("source", F.when(F.col("doc_id") % 5 == 0, "rare").otherwise("hot")).withColumn("lang", F.when(F.col("doc_id") % 7 == 0, None).otherwise("en"))
    targets = {"source": {"rare": 0.5, "hot": 0.5}}
    got = mixing.calibrated(docs, targets=targets, keep=0.1).collect()
    assert len(got) == 602 and all(r.sampled == (r.u < r.probability) for r in got)
    mass = collections.Counter()
    for r in got:
        mass[r.source] += r.n_tokens * r.probability
    assert abs(mass["rare"] / sum(mass.values()) - 0.5) < 1e-6 and abs(sum(mass.values()) / sum(r.n_tokens for r in got) - 0.1) < 1e-6
    table_fit = {r.doc_id: r.probability for r in mixing.calibrated(docs, targets=targets, keep=0.1, driver_cells=1).collect()}
    assert all(abs(table_fit[r.doc_id] - r.probability) < 1e-4 for r in got)
    assert mixing.sample(docs, targets=targets, keep=0.1).columns == docs.columns
    assert mixing.calibrated(empty(spark)).count() == 0
    assert mixing.calibrated(odd_rows(spark)).count() == 5


def test_mixing_fits_alike_as_a_table(spark):
    """Sparse, skewed cells of which many are kept whole: both forms have the same rule."""
    rng = random.Random(21)
    cells = [(f"s{a}", f"l{b}", f"t{c}", int(10 ** rng.uniform(0, 6))) for a in range(60) for b in range(6) for c in range(5) if rng.random() < 0.15]
    cells = sorted(cells)
    targets = {m: {v: 1 / len(vs) for v in vs} for k, m in enumerate(mixing.MARGINS) for vs in [sorted({c[k] for c in cells})]}
    mass = mixing.rake(cells, targets, rounds=8)
    want = mixing.probabilities(np.array([float(c[3]) for c in cells]), mass, 0.7)
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long").coalesce(1).cache()
    got = {(r.source, r.lang, r.topic): r for r in mixing._fit_as_table(df, targets, 0.7, rounds=8).collect()}
    assert len(got) == len(cells) and (want == 1).sum() > 10
    assert max(abs(got[c[:3]].probability - p) for c, p in zip(cells, want)) < 1e-6
    assert max(abs(got[c[:3]].mass - x) for c, x in zip(cells, mass)) < 1e-9
    # a margin of many values stays a table
    mass = mixing.rake(cells, targets, rounds=2)
    got = {(r.source, r.lang, r.topic): r.mass for r in mixing._fit_as_table(df, targets, 0.7, rounds=2, driver_values=20).collect()}
    assert max(abs(got[c[:3]] - x) for c, x in zip(cells, mass)) < 1e-9


def test_mixing_beside_a_plain_version(spark):
    """Counts, topics, targets, fit and probabilities of real forms of text against plain code; clashing columns and odd rows."""
    rows = texts(30, 80) + ["a|b\t|c|d", "1 2 3 44 55", "#$ %& x", "l\nm\nn\no", " \u00a0 x\x0by ", "w " * 900, "w " * 900]
    docs = table(spark, rows).selectExpr("*", "1 AS _u", "2 AS _p", "3 AS _cell", "4 AS u", "5 AS p", "6 AS cell", "7 AS mass", "8 AS tokens")

    def topic(t):
        n = max(len(t), 1)
        share = lambda chars: sum(t.count(c) for c in chars) / n
        forms = (("tabular", "|\t", 0.02), ("marked", "#$%&*<>{}=", 0.05), ("numeric", "0123456789", 0.1), ("list", "\n", 0.02))
        return next((name for name, chars, most in forms if share(chars) > most), "short" if n < 400 else "prose")

    count = {i: len([w for w in re.split(r"[ \t\n\x0b\f\r]+", t or "") if w]) for i, t in enumerate(rows)}
    cell = {i: (f"s{i % 3}", "en", topic(t or "")) for i, t in enumerate(rows)}
    sums = collections.Counter()
    for i in cell:
        sums[cell[i]] += count[i]
    cells = sorted((*c, n) for c, n in sums.items())
    targets = {}
    for k, m in enumerate(mixing.MARGINS):
        own = collections.Counter()
        for c in cells:
            own[c[k]] += c[3]
        powered = {v: n**mixing.TEMPER for v, n in own.items() if n}
        targets[m] = {v: x / sum(powered.values()) for v, x in powered.items()}
    mass = mixing.rake(cells, targets)
    p = dict(zip([c[:3] for c in cells], mixing.probabilities(np.array([float(c[3]) for c in cells]), mass, mixing.KEEP)))
    got = {r.doc_id: r for r in mixing.calibrated(docs).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == count and {i: r.topic for i, r in got.items()} == {i: c[2] for i, c in cell.items()}
    assert all(math.isclose(r.probability, p[cell[i]], abs_tol=1e-9) and r.sampled == (r.u < r.probability) for i, r in got.items())
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.sampled}


# --- toxicity


def toy_labels(spark, n=300):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice(WORDS) for _ in range(30)] + ([rng.choice(["nasty", "vile", "scummy"]) for _ in range(3)] if bad else [])
        rng.shuffle(words)
        rows.append(" ".join(words))
        labels.append((i, int(bad), int(bad)))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity(spark):
    rows, labels = toy_labels(spark)
    docs = table(spark, rows + [None, "", "nasty vile"])
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels, lambda i: i < 200).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(200, 300)) and got[302].predicted == 1 and got[300].predicted == got[301].predicted == 0
    assert all(n < 200 for r in got.values() for n in r.neighbours) and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score_toxicity(empty(spark), labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}


def test_nearest_is_exact():
    rng = np.random.default_rng(10)
    rows = []
    for _ in range(300):
        t = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        w = rng.random(len(t)) + 0.1
        rows.append((t, w / np.sqrt((w * w).sum())))
    index = toxicity.Index.of(list(range(300)), np.zeros(300), rows, 40)
    dense = np.zeros((300, 40))
    for k, (t, w) in enumerate(rows):
        dense[k, t] = w
    for t, w in rows[:60]:
        places, scores = index.nearest(t, w, 7)
        s = dense[:, t] @ w
        best = [k for k in np.lexsort((np.arange(300), -np.round(s, 12)))[:7] if s[k] > 0]
        assert places.tolist() == best and np.allclose(scores, s[best])


def plain_toxicity(rows, order, label):
    """Scores and neighbours without hashes, postings or blocks: dictionaries and dense sums."""

    def terms(t):
        out = collections.Counter()
        for w in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(AZ).encode()):
            out[w, 0] += 1
            for k in (5, 7):
                if len(w) > k:
                    out[w[:k], k] += 1
        return out

    every = [terms(t) for t in rows]
    first, rest = [i for k, i in enumerate(order) if k % 3], order[::3]
    n, n1 = len(first), sum(label[i] for i in first)
    have, with1 = collections.Counter(t for i in first for t in every[i]), collections.Counter(t for i in first if label[i] for t in every[i])
    told = {}
    for t, c in have.items():
        a = with1[t]
        chi2 = n * (a * (n - n1) - (c - a) * n1) ** 2 / (c * (n - c) * n1 * (n - n1)) if c < n else 0.0
        told[t] = min(max((chi2 * c / (c + toxicity.SHRINK) - toxicity.NOISE) / (toxicity.SURE - toxicity.NOISE), 0), 1)
    count = collections.Counter(t for d in every for t in d)
    weight = {t: g * (math.log((1 + len(rows)) / (1 + count[t])) + 1) for t, g in told.items() if g > 0}

    def vector(d):
        v = {t: (1 + math.log(k)) * weight[t] for t, k in d.items() if t in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    examples = [vector(every[i]) for i in first]

    def nearest(d):
        v = vector(d)
        s = [(-round(sum(x * e.get(t, 0) for t, x in v.items()), 12), k) for k, e in enumerate(examples)]
        return [(-x, first[k]) for x, k in sorted(s)[: toxicity.NEIGHBOURS] if x < 0]

    def features(d):
        near = nearest(d)
        return toxicity._features(*toxicity.vote(np.array([label[i] for _, i in near], float), np.array([x for x, _ in near])))

    w = toxicity._calibrated(np.array([features(every[i]) for i in rest]), np.array([label[i] for i in rest], float))
    return [(1 / (1 + math.exp(-float(w @ features(d)))), [i for _, i in nearest(d)]) for d in every]


def test_toxicity_beside_a_plain_version(spark):
    """Votes, calibration and document counts from end to end, with nulls, empty, long and repeated texts."""
    rows, labels = toy_labels(spark, 120)
    rows += [None, "", "nasty " * 3000, rows[0], "nothing of it"]
    docs = table(spark, rows)
    order = [r.doc_id for r in labels.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    label = {r.doc_id: r.toxic for r in labels.collect()}
    want = plain_toxicity(rows, order, label)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, (score, near) in enumerate(want):
        assert math.isclose(got[i].score, score, abs_tol=1e-6) and got[i].neighbours == near, i


# --- quality


def test_quality(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(WORDS) for _ in range(80)]
        if i % 5 == 0:
            words = [w + rng.choice(["###", "$$$", "%%%"]) for w in words] if i % 2 else [w for w in words[:8] for _ in range(10)]
        rows.append(" ".join(words))
        if i < 250:
            labels.append((i, int(i % 5 != 0)))
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    docs = table(spark, rows + [None, ""])
    got = {r.doc_id: r for r in cotraining.classify(docs, labels).collect()}
    right = sum(got[i].accepted == (i % 5 != 0) for i in range(250, 400))
    assert right >= 147 and len(got) == 402
    assert cotraining.keep_good(docs, labels).columns == docs.columns
    assert cotraining.classify(empty(spark), labels).count() == 0
    assert {r.score for r in cotraining.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_beside_a_plain_version(spark):
    """Co-training in memory over the same rows, every unlabelled one of them: equal scores; the exchange has taken place."""
    rng = random.Random(24)
    rows = []
    for i in range(260):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 60))]
        if i % 3 == 0:
            words = [w + rng.choice(["###", "$$$"]) for w in words] if i % 2 else [w for w in words[:5] for _ in range(9)]
        rows.append(" ".join(words))
    rows += [None, "", rows[200], rows[200], "lang " * 4000]
    docs = table(spark, rows).cache()
    quality = {i: int(i % 3 != 0) for i in range(100)}
    labels = spark.createDataFrame(list(quality.items()), "doc_id long, quality int")
    got = {r.doc_id: r for r in cotraining.classify(docs, labels).collect()}
    keys = {r.doc_id: r.key for r in docs.select("doc_id", cotraining._key().alias("key")).collect()}
    small = lambda f: (f[0].astype(np.int32), f[1].astype(np.float32).astype(float))
    both = [(small(cotraining.text_view(t or "")), small(cotraining.meta_view(f"s{i % 3}", "en", t or ""))) for i, t in enumerate(rows)]
    free = list({keys[i]: i for i in range(100, len(rows))}.items())
    told = []

    def choose(w, taken):
        out = [{1.0: [], 0.0: []}, {1.0: [], 0.0: []}]
        for v in (0, 1):
            sure = [(1 / (1 + math.exp(-float(both[i][v][1] @ w[v][both[i][v][0]]))), key, i) for key, i in free if key not in taken[v]]
            for label in (1.0, 0.0):
                best = sorted((-(p if label else 1 - p), key, i) for p, key, i in sure if (p if label else 1 - p) >= cotraining.CONFIDENT)
                out[v][label] = [(key, *both[i]) for _, key, i in best[: cotraining.PER_ROUND]]
        told.append(sum(len(x) for o in out for x in o.values()))
        return out

    model = cotraining.co_train([[both[i][v] for i in range(100)] for v in (0, 1)], np.array([float(quality[i]) for i in range(100)]), choose)
    want = model.scores(*[[b[v] for b in both] for v in (0, 1)])
    assert told[0] > 20 and len(got) == len(rows)
    for i in range(len(rows)):
        assert np.allclose((got[i].text_score, got[i].meta_score, got[i].score), [x[i] for x in want], atol=1e-6)
        assert got[i].accepted == (want[2][i] >= cotraining.REJECT)


# --- personal data

BASES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_base(t):
    out = []
    for kind, pattern in BASES:
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((*m.span(), kind))
    return sorted(out)


def test_base_patterns():
    rng = random.Random(12)
    for chars in ("a1.@+- 2(5)%_é", "1.2 -", "4111 -", "a.@b"):
        for _ in range(1500):
            t = "".join(rng.choice(chars) for _ in range(50))
            assert sorted(pii.base_spans(t)) == plain_base(t)
    assert pii.base_spans("a" * 300_000 + "1" * 300_000) == []


@pytest.fixture(scope="module")
def weights():
    return pii.train()


def test_field_on_new_sentences(weights):
    right = wrong = missed = 0
    for text, spans in pii.training_sentences(200, 77):
        found = set(pii.field_spans(text, weights))
        right, wrong, missed = right + len(found & set(spans)), wrong + len(found - set(spans)), missed + len(set(spans) - found)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_field_finds_long_names_and_hosts(weights):
    for address in ("christopher.anderson [at] example [dot] com", "anna [at] longcompanyname [dot] com", "maximiliane-hohenstein (at) internationalsociety (dot) org", "bartholomew.featherstone[at]northernuniversities[dot]net"):
        for before, after in (("please contact ", " today"), ("write to ", ", thanks"), ("the recommendations of ", " notwithstanding")):
            text = before + address + after
            assert (len(before), len(before) + len(address), "email") in pii.field_spans(text, weights)


def test_dynamic_programme_is_exact(weights):
    def every(n, segments, at=0):
        yield []
        for s, (i, j) in enumerate(segments):
            if i >= at:
                for rest in every(n, segments, j):
                    yield [s, *rest]

    rng = np.random.default_rng(13)
    for _ in range(20):
        n = 5
        segments = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1)]
        scores = rng.normal(size=(len(segments), len(pii.KINDS)))
        all_of = [(sum(scores[s].max() for s in path), path) for path in every(n, segments)]
        best = max(all_of)
        assert [s for s, _ in pii.decode(n, segments, scores)] == best[1]
        z = math.log(sum(math.exp(sum(np.logaddexp.reduce(scores[s]) for s in path)) for _, path in all_of))
        assert math.isclose(pii.marginals(n, segments, scores)[1], z, rel_tol=1e-9)


def test_windows_do_not_change_the_field(weights):
    """One stretch of numbers and names far longer than a window; texts without white space; a plain decoding of it all."""
    sentences = pii.training_sentences(150, 31)
    long = " ".join(t for t, _ in sentences)
    for text in (long, long.replace(" ", ""), "1 2 3 " * 3000, "x" * 400 + "1.2.3.4" + "y" * 400, ""):
        tokens = [m.span() for m in pii._TOKEN.finditer(text)]
        segments, feats, where = pii.lattice(text, tokens)
        want = [(*where[s], pii.KINDS[k]) for s, k in pii.decode(len(tokens), segments, pii._segment_scores(weights, feats) - 2.0, pii.MARGIN)]
        for window in (3, 50, pii.WINDOW):
            assert pii.best_spans(text, tokens, weights, window=window) == want
        assert pii.field_spans(text, weights) == want
    assert len(want) == 0 and len(pii.field_spans(long, weights)) > 100


def test_pii_table(spark):
    rows = ["mail a.b@c.de now", "ip 1.2.3.4, 1.2.3.999", "card 4111 1111 1111 1111", "call +1 (337) 555-7349.", None, "", "write jo [at] host [dot] com", "SSN 123-45-6789"]
    got = {r.doc_id: r for r in pii.find_pii(table(spark, rows)).collect()}
    assert [[(s.start, s.end, s.kind) for s in got[i].base] for i in range(6)] == [[(5, 13, "email")], [(3, 10, "ip")], [(5, 24, "card")], [(5, 22, "phone")], [], []]
    assert [s.kind for s in got[6].spans] == ["email"] and [s.kind for s in got[7].spans] == ["ssn"]
    assert pii.find_pii(empty(spark)).count() == 0 and pii.find_pii(odd_rows(spark)).count() == 5


# --- token records


def test_records_round_trip(spark, tmp_path):
    rows = texts(14, 30) + ["It's <|endoftext|>x I'll a\x1cb É İstanbul ΣΑΣ ½²", "a b c"]
    docs = table(spark, rows)
    path = token_records.default_tokenizer()
    manifest = token_records.write_tokens(docs, str(tmp_path / "t"), path)
    got = {r.doc_id: r for r in token_records.read_tokens(spark, manifest).collect()}
    plain = token_records.Encoder(path, by_chunk=False)
    start = 0
    for i, ids in enumerate(plain([t or "" for t in rows])):
        ids = [*ids.tolist(), 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    one = manifest[0]
    order = list(range(one["n_docs"]))[::-1]
    assert [d for d, _ in token_records.read_records(one["data"], one["index"], order)] == [d for d, _ in token_records.read_records(one["data"], one["index"])][::-1]
    raw = bytearray(open(one["data"], "rb").read())
    raw[20] ^= 1
    open(one["data"], "wb").write(raw)
    with pytest.raises(ValueError):
        list(token_records.read_records(one["data"], one["index"]))


def test_records_odd(spark, tmp_path):
    path = token_records.default_tokenizer()
    assert token_records.read_tokens(spark, token_records.write_tokens(empty(spark), str(tmp_path / "e"), path)).count() == 0
    rows = token_records.read_tokens(spark, token_records.write_tokens(odd_rows(spark), str(tmp_path / "o"), path)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 4, 4, 5] and rows[0].n_tokens == 1


def test_cache_forgets_and_agrees():
    path = token_records.default_tokenizer()
    e = token_records.Encoder(path)
    e.known.size = e.pieces.size = 20
    rows = [t or "" for t in texts(15, 40)]
    got = [e([t])[0].tolist() for t in rows * 2]
    assert got == [x.tolist() for x in token_records.Encoder(path, by_chunk=False)(rows * 2)]


def test_pieces_agree_with_the_library():
    """Texts of letters, marks, contractions, special tokens, white space, controls and scripts in any order."""
    path = token_records.default_tokenizer()
    one, plain = token_records.Encoder(path), token_records.Encoder(path, by_chunk=False)
    rng = random.Random(22)
    parts = [*"abcXYZ 's'll'm <|>.,;:!?0123456789\u00e9\u00c9\u00df\u0130\u0149\u017f\u00f7\u00d7\u00f1\u0160\u017e\u00a0\u2003\u0301\u200b\u4e2d\u03a3\u03c2\u00bd\u00b2\x1c\x7f\t\n\r\x0b\x85\u00bf\u20ac\U0001f600", "<|endoftext|>", "<|ENDOFTEXT|>", " don't ", " 'some "]
    for _ in range(40):
        rows = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(30)]
        assert [x.tolist() for x in one(rows)] == [x.tolist() for x in plain(rows)]
    long = "a\u00e9 " * 700_000 + "x" * 50_000
    assert one([long, "b"])[0].tolist() == plain([long])[0].tolist()


def test_filtering_forms_beside_clashing_columns(spark):
    """Columns named like the helpers inside: all stay, whole rows too."""
    rows = texts(23, 24)
    names = ["kept", "bad", "gone", "cell", "p", "u", "_keep", "_bad", "_gone", "_cell", "_u", "_p", "key", "h", "comp", "t", "score", "accepted", "topic", "tokens", "mass"]
    docs = table(spark, rows).selectExpr("*", *(f"doc_id AS {n}" for n in names)).cache()
    benchmark = spark.createDataFrame([(1, " ".join(rows[-3].split()[:12]))], "item_id long, text string")
    toy, labels = toy_labels(spark, 60)
    for form in (
        lambda d: exact_dedup.dedup(d),
        lambda d: decontaminate.clean(d, benchmark),
        lambda d: cotraining.keep_good(d, labels),
        lambda d: jaccard_join.dedup(d),
        lambda d: mixing.sample(d),
    ):
        got = form(docs)
        assert got.columns == docs.columns
        assert all(r[n] == r.doc_id for r in got.collect() for n in names)


def test_transform_work_and_order(monkeypatch):
    """Boundaries are listed anew only when many are new, and an old list finds the same; suffixes are in order."""
    rng = np.random.default_rng(8)
    a = rng.integers(97, 101, 6000).astype(np.uint8).tobytes()
    texts = [a, rng.integers(97, 101, 500).astype(np.uint8).tobytes() + a[900:5000] + b"x" * 900, b"ab" * 700, a[2000:2399] + b"!" + a[:410]]
    symbols = np.concatenate([np.r_[np.frombuffer(t, np.uint8).astype(np.uint16) + 4, k] for k, t in enumerate(texts)]).astype(np.uint16)
    order, flat = suffix_dedup.suffix_array(symbols, 400), [tuple(symbols[k : k + 400]) for k in range(len(symbols))]
    assert sorted(order) == list(range(len(symbols))) and all(flat[i] <= flat[j] for i, j in zip(order[:-1], order[1:]))
    seen = collections.Counter(t[k : k + 400] for t in texts for k in range(len(t) - 399))
    want = [[k for k in range(len(t) - 399) if seen[t[k : k + 400]] > 1] for t in texts]
    scanned, scan = [0], np.flatnonzero

    def counted(x):
        scanned[0] += np.size(x)
        return scan(x)

    monkeypatch.setattr(suffix_dedup.np, "flatnonzero", counted)
    found = suffix_dedup.repeated_windows(texts, [1] * 4, 400)
    assert scanned[0] < 150 * len(symbols)
    for stale in (0.0, 1 / 64, 2.0):
        monkeypatch.setattr(suffix_dedup, "STALE", stale)
        found = suffix_dedup.repeated_windows(texts, [1] * 4, 400)
        assert [[k for x, y in zip(*f) for k in range(x, y)] for f in found] == want
