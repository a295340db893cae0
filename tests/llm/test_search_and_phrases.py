"""Collocations, lexical search and bottom-k duplicates against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import DOCS, WORDS, awkward, shared_folder  # noqa: F401
from trailgraph.llm import bottom_k, collocations, lexical_search, words


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_words_by_bytes():
    texts = pa.array(["a B,c", None, "", " é\tÉ x", "z"])
    found = words.words_of(texts, words.byte_class(b" \t,"), words.byte_class(b","))
    names = found.distinct.to_pylist()
    assert [names[c] for c in found.code] == ["a", "b", "c", "é", "É", "x", "z"]
    assert found.row.tolist() == [0, 0, 0, 3, 3, 3, 4] and found.piece.tolist() == [0, 0, 1, 1, 1, 1, 1]
    sliced = words.words_of(texts.slice(3, 2), words.byte_class(b" \t"), lower=False)
    assert sliced.row.tolist() == [0, 0, 0, 1] and len(words.words_of(texts.slice(1, 2), words.byte_class(b" ")).code) == 0
    many = pa.array([f"w{k}" for k in range(20_000)] + [f"w{k}" * 40 for k in range(300)])
    one, two = words.hashes_of(many), words.hashes_of(many, 1)
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(many) and not (one == two).any()


def plain_collocations(rows, least, top):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        kept = []
        for phrase, a in f.items():
            if len(phrase) == 1 or a < least:
                continue
            longer = [b for p, b in f.items() if b >= least and len(p) > len(phrase) and phrase in (p[:2], p[1:])]
            if any(100 * b >= 50 * a for b in longer):
                continue
            cuts = [(1000000 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_rows():
    draw = random.Random(4)
    rows = []
    for k in range(300):
        text = "".join(draw.choice(["the ", "of ", "The cat ", "sat ", "é ", ", ", ". ", "\t", "x\n"])
                       for _ in range(draw.randint(0, 40)))
        rows.append((k % 290, text, draw.choice(["en", "fr", None, "und"]), "n"))
    return rows + [(300, None, "en", None), (301, "", None, None), (302, "the of " * 4000, "en", None)]


@pytest.mark.parametrize("stripe_bytes", [6 << 20, 200])
def test_collocations(spark, monkeypatch, stripe_bytes):
    monkeypatch.setattr(collocations, "STRIPE_BYTES", stripe_bytes)
    table = spark.createDataFrame(phrase_rows(), "doc_id bigint, text string, lang string, n string").repartition(3)
    found = collocations.collocations(table, least=3, top=12)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain_collocations([(r[2], r[1]) for r in phrase_rows()], 3, 12)
    assert collocations.collocations(table.limit(0)).count() == 0


def test_hot_prefixes_are_cut_into_segments():
    class Docs:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 2, "text": ["a b c a b d a b e", "a b c x"]})
    told = pa.Table.from_batches(list(collocations.stripes(Docs(), ["a b\ten"])(iter([batch])))).to_pylist()
    cut = [r for r in told if r["prefix"].endswith("\ta b\ten")]
    assert len(cut) == len({r["prefix"] for r in cut}) > 1 and all(r["prefix"][0] != "\t" for r in cut)
    assert sum(int(r["counts"].split(" ")[0]) for r in cut) == 4
    assert all(r["prefix"][0] == "\t" for r in told if "\tb c\t" in r["prefix"])


def test_stripes_leave_in_small_batches(monkeypatch):
    class Docs:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    draw = random.Random(7)
    texts = [" ".join(f"w{draw.randrange(2_000)}" for _ in range(1_000)) for _ in range(80)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "fr"] * 40, "text": texts})
    told = list(collocations.stripes(Docs(), ["w1 w2\ten"])(iter([batch])))
    assert max(some.num_rows for some in told) <= 1 << 16 and max(some.nbytes for some in told) < 4 << 20
    count = lambda names: sum(int(r["counts"].split(" ")[0]) for r in names)
    rows = pa.Table.from_batches(told).to_pylist()
    assert count(rows) == 2 * 80_000  # each word as a word and as the first of a prefix
    assert len({r["prefix"] for r in rows}) == len(rows)


def test_rare_prefixes_are_not_taken_apart(spark):
    rows = [("\ta b\ten", "c d", "9 5 4"), ("\ta b\ten", "c", "4 4"), ("\trare x\ten", "y z", "9 5 4"),
            ("3\ta c\ten", "q", "1 1"), ("3\t\ten", "q r", "21 20 1")]
    told = spark.createDataFrame(rows, "prefix string, nexts string, counts string")
    found = collocations.merged_stripes(told, 9)
    assert sorted(map(tuple, found.collect())) == [
        ("\ta b\ten", "\n", 13), ("\ta b\ten", "c", 9), ("\trare x\ten", "\n", 9),
        ("3\t\ten", "\n", 21), ("3\t\ten", "q", 20), ("3\ta c\ten", "\n", 1),
    ]
    plan = collocations.merged_stripes(told, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window")  # the window stands below


def plain_search(docs, items, top):
    split = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
    bags = [(doc, Counter(split(text))) for doc, text in docs if split(text)]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for name, text in items:
        if name is not None and text is not None:
            asked.setdefault(name, []).extend(split(text))
    out = []
    for name, terms in asked.items():
        scores = []
        for doc, bag in bags:
            m = 75 + 25 * sum(bag.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
                        for t in terms)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(name, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def test_lexical_search(spark):
    draw = random.Random(6)
    extra = [(100 + k, " ".join(draw.choices([f"t{n}" for n in range(300)], k=draw.randint(1, 80))), "en", "") for k in range(400)]
    rows = awkward() + extra + [(600, "t1 " * 5000, None, None)]
    items = [(k, " ".join(draw.choices([f"T{n}" for n in range(300)], k=12))) for k in range(15)]
    items += [(20, None), (21, ""), (None, "w3"), (22, "w1"), (22, "w2 W2"), (23, "nowhere at all"), (24, "t1 w1 w1")]
    table = spark.createDataFrame(rows, DOCS).repartition(3)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    found = lexical_search.ranked_search(table, asked, top=7)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_search([r[:2] for r in rows], items, 7)
    assert lexical_search.ranked_search(table.limit(0), asked).count() == 0
    assert lexical_search.ranked_search(table, asked.limit(0)).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 300)
    items = [(k, f"w{k} w{k + 1}") for k in range(20)]
    table = spark.createDataFrame(awkward(), DOCS)
    found = lexical_search.ranked_search(table, spark.createDataFrame(items, "item_id bigint, text string"), top=3)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_search([r[:2] for r in awkward()], items, 3)


def test_upper_bounds_hold():
    draw = random.Random(3)
    texts = [" ".join(draw.choices([f"t{n}" for n in range(60)], k=draw.randint(1, 90))) for _ in range(50)]
    bags = [Counter(lexical_search.terms_of(t)) for t in texts]
    df = Counter(t for b in bags for t in b)
    items = lexical_search.weighed([(k, draw.choices(sorted(df), k=9)) for k in range(10)], df, len(texts))
    pending, total = lexical_search._Pending(), sum(sum(b.values()) for b in bags)
    for bag in bags:
        hashed = words.hashes_of(pa.array(list(bag), pa.binary()))
        upto = lexical_search.levels_of(np.array(list(bag.values())))
        pending.entries.append(np.concatenate(
            [lexical_search._at_level(hashed[upto > level], level) for level in range(lexical_search.LEVELS)]))
        pending.ids.append(0), pending.sizes.append(sum(bag.values())), pending.texts.append(b"")
    for width in (64, 4096):
        row = pending.row(0, width)
        sizes = np.array(pending.sizes)
        lengths = lexical_search._lengths(sizes, len(texts), total)
        hashed = words.hashes_of(pa.array(items.vocabulary, pa.binary()))
        planes = np.frombuffer(row["signature"], np.uint8).reshape(width, -1)
        bound = lexical_search.upper_bounds(items, hashed, planes, sizes, lengths)
        for lane, bag in enumerate(bags):
            times = np.array([bag[t] for t in items.vocabulary])
            exact = items.scores(lexical_search._worth(times, lengths[lane]))
            assert (bound[:, lane] >= exact).all()
            if width == 4096 and max(bag.values()) == 1:
                assert (bound[:, lane] <= 1.5 * exact + 1e6).mean() > 0.8


def plain_groups(rows):
    sets = []
    for doc, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append((doc, {" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()))
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    least = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    out = []
    for i, (doc, a) in enumerate(sets):
        component = least.get(root(i)) if a else doc
        out.append((doc, len(a), component, doc == component))
    return sorted(out, key=repr)


def edited(seed):
    draw = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(3000)]
    rows = []
    for base in range(12):
        text = draw.choices(vocabulary, k=draw.choice([5, 40, 120, 500]))
        for _ in range(draw.randint(1, 14)):
            copy = list(text)
            for _ in range(draw.randint(0, max(1, len(text) // 18))):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            rows.append((len(rows), " ".join(copy), "en", "x"))
    passage = draw.choices(vocabulary, k=60)
    for _ in range(60):  # a passage that many share, and own words
        rows.append((len(rows), " ".join(passage + draw.choices(vocabulary, k=300)), "en", "x"))
    draw.shuffle(rows)
    return rows + [(len(rows) + k, *row[1:]) for k, row in enumerate(awkward()[30:36])] + awkward()[36:]


@pytest.mark.parametrize("group_rows", [1024, 7])
def test_bottom_k_duplicates(spark, monkeypatch, group_rows):
    monkeypatch.setattr(bottom_k, "GROUP_ROWS", group_rows)
    rows = edited(group_rows)
    table = spark.createDataFrame(rows, DOCS).repartition(4)
    found = bottom_k.near_duplicates(table)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_groups(rows)
    assert bottom_k.near_duplicates(table.limit(0)).count() == 0
    alone = spark.createDataFrame([(1, "a b c d"), (2, "x"), (3, None)], "doc_id bigint, text string")
    assert [tuple(r) for r in bottom_k.near_duplicates(alone).orderBy("doc_id").collect()] == [
        (1, 2, 1, True), (2, 1, 2, True), (3, 0, 3, True)]


def test_pairs_in_long_and_short_lists():
    draw = np.random.default_rng(7)
    base = np.unique(draw.integers(0, 1 << 63, 900).astype(np.uint64))
    sets = []
    for k in range(40):
        kept = base[draw.random(len(base)) < draw.choice([0.9, 0.97])][: draw.choice([100, 200, 800])]
        sets.append(np.unique(np.concatenate([kept, draw.integers(0, 1 << 63, 5).astype(np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    sketches = [(s[: bottom_k.SKETCH] >> np.uint64(32)).astype("<u4") for s in sets]
    labels = np.arange(40) % 30
    i, j = bottom_k.possible_links(labels, sizes, sketches, 85)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*[c.tolist() for c in bottom_k._of_few(labels, sizes, sketches, 85)]))
    for a in range(40):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if labels[a] != labels[b] and 100 * both >= 85 * (sizes[a] + sizes[b] - both):
                assert (b, a) in set(zip(i.tolist(), j.tolist()))
                assert bottom_k.sketch_allows(sets[a], sets[b], 85)


def test_retained_hashes_meet():
    draw = np.random.default_rng(1)
    base = np.unique(draw.integers(0, 1 << 63, 200).astype(np.uint64))
    other = np.unique(np.concatenate([base[:186], draw.integers(0, 1 << 63, 14).astype(np.uint64)]))
    for levels in (np.zeros(1 << 16, np.uint8), draw.integers(0, 9, 1 << 16).astype(np.uint8)):
        starts = np.array([0, len(base), len(base) + len(other)])
        found = bottom_k.retained(np.concatenate([base, other]), starts, levels, 85).to_pylist()
        assert len(found[0]) == len(base) - math.ceil(0.85 * len(base)) + 1
        assert set(found[0]) & set(found[1])


@pytest.mark.parametrize("first_lists", [2, 64])
def test_bottom_k_compares_a_pair_in_its_first_list(spark, monkeypatch, first_lists):
    monkeypatch.setattr(bottom_k, "FIRST_LISTS", first_lists)
    sketch = np.arange(40, dtype="<u4").tobytes()
    # 1 to 8 meet in ten lists, 9 and 10 in others of some of them, always with labels of their own
    held = [(value, node) for value in range(10) for node in range(1, 9)]
    held += [(value, node) for value in (20, 21) for node in (1, 9, 10)] + [(30, 2), (30, 9)]
    sizes = dict(Counter(value for value, _ in held))
    rows = [(value, node, 40, sizes[value], node) for value, node in held]
    lists = spark.createDataFrame(rows, "value bigint, node bigint, size bigint, members bigint, label bigint")
    lists = lists.withColumn("sketch", F.lit(bytearray(sketch)))
    found = [tuple(r) for r in bottom_k.listed_pairs(bottom_k.with_firsts(lists), 85).collect()]
    wanted = {(a, b) for value in sizes for a in (n for v, n in held if v == value)
              for b in (n for v, n in held if v == value) if a < b}
    assert set(found) == wanted
    if first_lists == 64:
        assert len(found) == len(wanted)
