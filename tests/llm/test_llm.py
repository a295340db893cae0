"""The training-data operators against brute force, round trips and held-out labels."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailgraph.llm import (
    decontamination, html_text, line_dedup, near_duplicates, packing, quality, sharding,
    token_files, toxicity, vector_search,
)
from trailgraph.llm.queries import QUERIES, tokenizer_path

DOCS = "doc_id bigint, text string, lang string, n_words string"
WORDS = [f"w{k}" for k in range(40)]


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


def awkward(seed=0):
    """Nulls, empty and long texts, ties, repeated rows, columns with clashing names."""
    draw = random.Random(seed)
    prose = lambda n: " ".join(draw.choices(WORDS, k=n))
    rows = [(k, prose(draw.randrange(1, 60)), "en", "x") for k in range(30)]
    long = "\n".join(prose(40) for _ in range(60))
    rows += [(30, None, None, None), (31, "", "en", ""), (32, long, "en", "1"), (33, long, "en", "1"),
             (33, long, "en", "1"), (34, "  \n \t", "de", "2"), (None, "w1 w2 w3", "en", "3")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def brute_contamination(text, items, window=13):
    words = decontamination.words_of(text)
    hit, names = set(), set()
    for name, phrase in items:
        phrase = decontamination.words_of(phrase)
        if name is None or not phrase:
            continue
        n = min(window, len(phrase))
        grams = {tuple(phrase[k : k + n]) for k in range(len(phrase) - n + 1)}
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in grams:
                hit.update(range(k, k + n))
                names.add(str(name))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("phrase_bytes", [1 << 20, 300])
def test_contamination(spark, docs, phrase_bytes):
    draw = random.Random(3)
    texts = [row[1] for row in awkward() if row[1]]
    items = [(k, " ".join(draw.choice(texts).upper().split()[:20])) for k in range(12)]
    items += [(50, "w1 w2"), (51, None), (52, ""), (None, "w3"), (53, "W7"), (53, "w8")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found, name = decontamination.find_contamination(docs, table, phrase_bytes=phrase_bytes)
    rows = found.collect()
    assert len(rows) == len(awkward())
    for row in rows:
        got = row[name]
        assert (got["n_words"], got["n_hit"], got["items"]) == brute_contamination(row["text"], items)
        assert got["n_hit"] == sum(s["end"] - s["start"] for s in got["spans"])
    kept = decontamination.remove_contamination(docs, table)
    assert kept.columns == docs.columns
    assert decontamination.without_spans("a, B c. d!", [{"start": 1, "end": 3}]) == "a, . d!"


def test_contamination_of_nothing(spark, docs, nothing):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    found, name = decontamination.find_contamination(docs, empty)
    assert found.filter(F.col(f"{name}.n_hit") > 0).count() == 0
    assert decontamination.remove_contamination(nothing, empty).count() == 0


def test_token_files(spark, docs, nothing, tmp_path):
    path = tokenizer_path("word_bpe_49k.json")
    manifest = token_files.write_token_files(docs, path, 2, str(tmp_path / "a"), block=64)
    rows = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r["start"])
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    expected = sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for row, (doc, text, *_) in zip(rows, expected, strict=True):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row["doc_id"], row["start"]) == (doc, at)
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids
        at += len(ids)
    empty = token_files.write_token_files(nothing, path, 2, str(tmp_path / "b"))
    assert token_files.read_token_files(empty).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 32])
def test_packed_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, np.uint32)
    assert (token_files.unpack(token_files.pack(ids, bits), len(ids), bits) == ids).all()


def test_cached_tokens_are_those_of_the_tokenizer():
    from trailgraph.llm.token_cache import Encoder

    texts = ["", " a", "a ", "  a  b", "a\n b", "\n\n x", "x\x1cy", "don't stop. it's!", "<|endoftext|> a",
             "É. è", "日本語 テスト。", "\ta b", "1.5 2,3", "²."] * 2
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = Encoder(tokenizer_path(name))
        for text, ids in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_tokens_of_random_texts(name):
    from trailgraph.llm import token_cache

    draw = random.Random(5)
    parts = ["a", "B", "é", "1", " ", "\n", "  ", "\n\n", "\t", ".", ",", "!", "'s", "-", "日本", "\xa0", "\r\n", "İ", "ﬁ", "²",
             "e\u0301", "\u0958", "<|", "\x00"]
    encoder = token_cache.Encoder(tokenizer_path(name))
    for _ in range(12):
        texts = ["".join(draw.choices(parts, [9, 6, 3, 2, 14, 3] + [2] * (len(parts) - 6), k=draw.randint(0, 30))) for _ in range(200)]
        for text, ids in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_met_again_stay_known(monkeypatch, name):
    from trailgraph.llm import token_cache

    monkeypatch.setattr(token_cache, "KEPT_WORDS", 60)
    often = "Straße über Œuvre, Élan... Ærø!? ŉa ſo İl AÇAÍ;; x&&& don't\nGo 3$ often once."
    texts = [" ".join(["a", often, *(f"{letter * n}Ž" for letter in "bcdefgh")]) for n in range(1, 30)]
    encoder = token_cache.Encoder(tokenizer_path(name))
    once, learned = [], encoder._learned
    monkeypatch.setattr(encoder, "_learned", lambda words: once.extend(map(str, words)) or learned(words))
    for text in texts:
        (ids,) = encoder.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert all(once.count(word) == 1 for word in often.split(" "))  # although many others came and went
    assert len(encoder.known) < 120


def last_sequences(places, counts):
    """The last sequence of each run of equal pieces that ``plan`` returns."""
    for at, (length, rank, first, each, _) in enumerate(places):
        later = [r for n, r, *_ in places if n == length and r > rank]
        rows = min(later, default=counts[length]) - rank
        yield first + -(-rows // each) - 1


def best_fit(lengths, capacity):
    """How many sequences best-fit decreasing takes, one piece after another."""
    left: list[int] = []
    for length in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(left) if room >= length]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= length
        else:
            left.append(capacity - length)
    return len(left)


def test_packing_is_best_fit_decreasing(spark, docs, nothing):
    draw = random.Random(5)
    for capacity in (10, 64):
        lengths = [draw.randint(1, capacity) for _ in range(400)]
        left: list[int] = []
        for length in sorted(lengths, reverse=True):
            fits = [k for k, room in enumerate(left) if room >= length]
            if fits:
                left[min(fits, key=lambda k: left[k])] -= length
            else:
                left.append(capacity - length)
        places = packing.plan(Counter(lengths), capacity)
        assert 1 + max(last_sequences(places, Counter(lengths))) == len(left)
    path = tokenizer_path("byte_bpe_50k.json")
    rows = packing.pack_documents(docs, path, 0, capacity=50).collect()
    used: dict[int, list] = {}
    for row in rows:
        used.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
        assert row["length"] == 50 or row["piece"] == 0
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 50
    assert sum(r["piece"] == 0 for r in rows) == len(awkward())
    assert len(used) == best_fit([r["length"] for r in rows], 50)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    expected = []
    for doc, text, *_ in awkward():
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        edges = [0, *range(len(ids) % 50 or 50, len(ids) + 1, 50)]
        for piece, (a, b) in enumerate(zip(edges, edges[1:])):
            expected.append((doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    mine = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(mine, key=repr) == sorted(expected, key=repr)
    assert packing.pack_documents(nothing, path, 0).count() == 0


def plain_fingerprint(text):
    """SimHash bit by bit, from the contract alone."""
    import re
    from xxhash import xxh64

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [int(xxh64(s.encode(), seed=42).hexdigest(), 16) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [(doc, plain_fingerprint(text)) for doc, text, *_ in rows]
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if label[i] != label[j] and (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {}
    for (doc, _), group in zip(prints, label):
        if doc is not None:
            least[group] = min(doc, least.get(group, doc))
    return sorted(((doc, least.get(group)) for (doc, _), group in zip(prints, label)), key=repr)


def test_linked_sets_have_no_hub():
    values = np.arange(2000, dtype=np.uint64) % np.uint64(16)  # all within the radius
    sizes = np.array([1000, 1000])
    a, b = near_duplicates.group_links(values, sizes, 4)
    assert len(a) == 1998
    places = np.arange(2000, dtype=np.uint64)
    forest = near_duplicates.Forest(2000)
    forest.add(np.arange(1999), np.arange(1, 2000))
    a, b = forest.edges(places)
    assert np.bincount(np.concatenate([a, b]).astype(int)).max() <= near_duplicates.FAN_OUT + 1
    again = near_duplicates.Forest(2000)
    again.add(a.astype(int), b.astype(int))
    assert not again.root.any()


def test_near_duplicates(spark, docs, nothing):
    found = near_duplicates.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in found), key=repr) == brute_components(awkward())
    plain = {(doc, plain_fingerprint(text)) for doc, text, *_ in awkward()}
    assert {(r["doc_id"], r["fp"] % (1 << 64)) for r in found} == plain
    assert near_duplicates.near_duplicates(nothing).count() == 0
    assert near_duplicates.drop_near_duplicates(docs).columns == docs.columns


def test_groups_beyond_the_limit_lose_no_link(spark, monkeypatch):
    draw = np.random.default_rng(1)
    base = draw.integers(0, 1 << 62, 12, np.uint64)
    flips = np.left_shift(np.uint64(1), draw.integers(0, 64, (600, 2)).astype(np.uint64))
    values = np.unique(base[draw.integers(0, 12, 600)] ^ flips[:, 0] ^ flips[:, 1])
    pairs = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    forest = near_duplicates.Forest(len(values))
    forest.add(*np.nonzero(pairs))
    monkeypatch.setattr(near_duplicates, "GROUP_ROWS", 40)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint")
    from trailgraph.llm.common import workspace

    links = near_duplicates.fingerprint_links(frame, len(values), workspace(spark, "t")).collect()
    place = {int(v): k for k, v in enumerate(values.view(np.int64))}
    mine = near_duplicates.Forest(len(values))
    mine.add(np.array([place[r["a"]] for r in links]), np.array([place[r["b"]] for r in links]))
    assert (mine.root == forest.root).all()


def test_sharding(spark, docs, nothing):
    found, names = sharding.shard_documents(docs, 4, range_bytes=2000)
    rows = found.collect()
    assert len(rows) == len(awkward())
    sizes, slots = Counter(), {}
    for row in rows:
        size = len((row["text"] or "").encode()) + 1
        assert row[names["size"]] == size
        sizes[row[names["shard"]]] += size
        slots.setdefault(row[names["shard"]], []).append(row[names["slot"]])
    largest = max(len((r["text"] or "").encode()) + 1 for r in rows)
    assert max(sizes.values()) - min(sizes[k] for k in range(4)) <= 3 * largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(nothing)[0].count() == 0


def test_line_dedup(spark, nothing):
    draw = random.Random(9)
    lines = [" ".join(draw.choices(WORDS, k=draw.randint(3, 30))) for _ in range(25)]
    rows = [(k, "\n".join(draw.choices(lines + ["", "only here %d" % k], k=draw.randint(1, 9))), "en", "")
            for k in range(60)]
    rows += [(60, rows[0][1], "en", ""), (60, rows[0][1], "en", ""), (None, rows[0][1], None, None), (61, None, "", "")]
    table = spark.createDataFrame(rows, DOCS).repartition(4)
    expected = common_runs(rows, 20)
    found = line_dedup.dedup_lines(table, deleted="gone").collect()
    original = {row[0]: row[1] for row in rows}
    assert len(found) == len(rows)
    for row in found:
        gone = expected.get((row["doc_id"], original[row["doc_id"]]), [])
        assert (row["gone"] or []) == gone
        if gone:
            assert row["text"] == line_dedup.without_lines(original[row["doc_id"]], gone)
        else:
            assert row["text"] == original[row["doc_id"]]
    left = {row["doc_id"] for row in line_dedup.drop_repeated(table).collect()}
    assert 60 not in left and 61 in left and None in left
    assert line_dedup.drop_repeated(nothing).columns == nothing.columns


def common_runs(rows, min_words):
    """Places in runs of enough words that an earlier document has as well, by trying all."""
    docs = sorted({(doc, text) for doc, text, *_ in rows if doc is not None and text is not None})
    lines = [[line.strip() for line in text.split("\n") if line.strip()] for _, text in docs]
    gone = {}
    for later, mine in enumerate(lines):
        places = set()
        for other in lines[:later]:
            for i in range(len(mine)):
                for j in range(len(other)):
                    n = 0
                    while i + n < len(mine) and j + n < len(other) and mine[i + n] == other[j + n]:
                        n += 1
                    if sum(len(line.split()) for line in mine[i : i + n]) >= min_words:
                        places.update(range(i, i + n))
        gone[docs[later]] = sorted(places)
    return gone


def short_lines(seed, count):
    draw = random.Random(seed)
    lines = [" ".join(draw.choices(WORDS, k=draw.randint(1, 12))) for _ in range(8)]
    return [(k, "\n".join(draw.choices(lines, k=draw.randint(1, 12))), "en", "") for k in range(count)]


def test_deleted_blocks_stand_in_one_earlier_document(spark):
    a, b, c = (" ".join(f"{name}{k}" for k in range(8)) for name in "abc")
    rows = [(0, "\n".join([a, "x", b, "y", c]), "", ""), (1, "\n".join([a, b, c]), "", "")]
    assert not any(r["gone"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS), deleted="gone").collect())
    rows = short_lines(5, 80)
    allowed, texts = common_runs(rows, 20), {row[0]: row[1] for row in rows}
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3), deleted="gone").collect()
    assert any(r["gone"] for r in found)
    for r in found:
        assert set(r["gone"] or []) <= set(allowed[r["doc_id"], texts[r["doc_id"]]])


def test_blocks_of_every_earlier_document_go(spark):
    p, q = ("\n".join(" ".join(f"{name}{n}{k}" for k in range(9)) for n in range(4)) for name in "pq")
    rows = [(0, q + "\n" + p, "", ""), (1, p + "\n" + q, "", ""), (2, p + "\n" + q, "", ""),
            (3, "---\n" + p + "\nown words\n---\n" + p, "", "")]
    rows += [(k + 4, *row[1:]) for k, row in enumerate(short_lines(6, 80))]
    texts = {row[0]: row[1] for row in rows}
    expected = common_runs(rows, 20)
    table = spark.createDataFrame([*rows, rows[9]], DOCS).repartition(3)
    found = line_dedup.dedup_lines(table, deleted="gone").collect()
    gone = {r["doc_id"]: r["gone"] or [] for r in found}
    assert gone == {k: expected[k, text] for k, text in texts.items()}
    assert [len(gone[k]) for k in range(4)] == [0, 8, 8, 8]


def test_own_words_of_repeated_documents_stay(spark):
    shared = "\n".join(" ".join(f"s{n}{k}" for k in range(30)) for n in range(10))
    rows = [(0, shared, "", ""), (1, shared + "\nmy own words", "", ""), (2, shared, "", "")]
    left = line_dedup.drop_repeated(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: r["text"] for r in left} == {0: shared, 1: "my own words"}


def test_alignment_of_a_pair():
    # a passage in another order, one that is repeated, and lines between
    assert line_dedup.aligned([(0, 10, 3), (3, 0, 3)]) == set(range(6))
    assert line_dedup.aligned([(0, 0, 2), (5, 0, 2), (6, 1, 2)]) == {0, 1, 5, 6, 7}
    assert line_dedup._with_gaps([(0, 0), (1, 5), (2, 5), (3, 9)]) == [(0, 0), (3, 9), (2, 5)]
    draw = random.Random(2)
    for _ in range(50):
        runs = [(draw.randrange(20), draw.randrange(20), draw.randint(1, 4)) for _ in range(draw.randint(1, 8))]
        assert line_dedup.aligned(runs) == {place + k for place, _, size in runs for k in range(size)}


def test_longest_chain():
    assert [line_dedup.longest_chain(p) for p in ([], [3], [5, 1, 2, 9, 3])] == [[], [0], [1, 2, 4]]


def labelled(spark, label):
    draw = random.Random(11)
    rows, marks = [], []
    for k in range(600):
        words = draw.choices(WORDS, k=40)
        bad = k % 4 == 0
        if bad and label == "toxic":
            words += draw.choices(["scumbag", "scumlord"], k=3)
        if bad and label == "quality":
            words = [words[0]] * 40
        if label == "toxic" and (bad or k % 40 == 1):
            words.append("muslims")
        rows.append((k, " ".join(words), "en", ""))
        marks.append((k, int(bad if label == "toxic" else not bad)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, f"doc_id bigint, {label} int"), dict(marks)


def test_toxicity_and_its_swap_penalty(spark, nothing):
    table, labels, marks = labelled(spark, "toxic")
    weights = {}
    for penalty in (0.0, 10.0):
        model = toxicity.fit(table, labels, toxicity.held_out, swap_penalty=penalty)
        weights[penalty] = abs(model.weights["^muslims$"])
        found, name = toxicity.score(table, model)
        for row in found.filter(toxicity.held_out("doc_id")).collect():
            assert (row[name]["score"] >= 0.5) == marks[row["doc_id"]]
        assert all(0 <= s <= 1 for s in model.scores([None, "", "x " * 9999]))
    assert weights[10.0] < weights[0.0] / 2
    assert toxicity.drop_toxic(nothing, labels).columns == nothing.columns
    none = toxicity.fit(table, labels.limit(0), toxicity.held_out)
    assert none.scores(["w1"]) == [0.5]


def test_toxic_terms_late_in_text_without_blanks():
    model = toxicity.Model({"scum": 2.0, "bag$": 2.0}, -3.0)
    text = "漢字仮名" * 100 + "scumbag"
    assert model.present(text) == [0, 1] and model.scores([text])[0] > 0.5
    assert not model.known  # long words are not remembered
    found = toxicity._features({text}, remembered := {})
    assert {"scum", "scumb", "bag$", "^漢字仮", "名scum"} <= found and not remembered
    assert found != toxicity._features({"漢字仮名" * 101 + "scumbag"}, {})


def test_quality(spark, docs, nothing):
    table, labels, marks = labelled(spark, "quality")
    rows = quality.score_quality(table, labels).filter(quality.held_out("doc_id")).collect()
    right = sum((r["score"] >= 0.5) == marks[r["doc_id"]] for r in rows)
    assert right >= 0.97 * len(rows)
    assert {r["score"] for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(nothing, labels).count() == 0
    assert quality.isotonic(np.array([1.0, 0.0, 2.0]), np.ones(3)).tolist() == [0.5, 0.5, 2.0]


def test_exact_top_k(spark):
    draw = np.random.default_rng(2)
    rows = [(k, draw.normal(size=8).tolist()) for k in range(500)]
    rows += [(k, rows[7][1]) for k in range(500, 900)]  # one very common vector
    rows += [(900, None), (901, [1.0, None]), (902, [float("nan")] * 8), (903, [1.0]), (7, rows[7][1]), (None, [1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    found = vector_search.exact_top_k(table, lambda c: F.col(c) % 50 == 0, query_rows=7).collect()
    usable = {}
    for number, vector in rows:
        if number is not None and vector and None not in vector and np.isfinite(vector).all():
            usable[number] = np.floor(1024 * np.array(vector, np.float32).astype(float)).astype(int)
    for query in [k for k in usable if k % 50 == 0]:
        scores = sorted((-int(usable[query][: len(v)] @ v[: len(usable[query])]), k) for k, v in usable.items() if k != query)
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == query)
        assert mine == [(n + 1, k, -s) for n, (s, k) in enumerate(scores[:10])]
    assert vector_search.exact_top_k(table.limit(0), lambda c: F.col(c) == 0).count() == 0


def test_top_k_over_files_of_one_pivot_in_falling_order(spark, tmp_path):
    draw = np.random.default_rng(4)
    x = np.floor(1024 * draw.normal(size=(2000, 3)))
    metric = vector_search.Metric(x[:1], float((x**2).sum(axis=1).max()))
    distance = metric.to_pivots(x)[:, 0]
    order = np.argsort(distance)
    rows = [(0, float(distance[k]), int(k), x[k].astype(int).tolist()) for k in order]
    schema = "pivot int, distance double, vec_id bigint, v array<bigint>"
    for name, part in (("near", rows[:800]), ("far", rows[800:])):  # the larger file is read first
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    index = spark.read.schema(schema).parquet(f"{tmp_path}/near", f"{tmp_path}/far").coalesce(1)
    read = [r["distance"] for r in index.select("distance").collect()]
    assert sum(b < a for a, b in zip(read, read[1:])) == 1
    asked = list(range(0, 2000, 40))
    some = index.filter(F.col("vec_id").isin(asked)).orderBy("vec_id").select("vec_id", "v").collect()
    found = vector_search._pass(index, some, metric, (x[:1], np.array([0])), 3, 10).collect()
    for query in asked:
        scores = x @ x[query]
        best = sorted((-int(scores[k]), k) for k in range(2000) if k != query)[:10]
        assert sorted((-r["score"], r["vec_id"]) for r in found if r["query_id"] == query)[:10] == best


@pytest.mark.parametrize("size", [300_000, 1_000_000])
def test_top_k_of_large_components(spark, size):
    draw = np.random.default_rng(size)
    x = size + draw.integers(-50, 50, (300, 8)) + 0.3
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = vector_search.exact_top_k(table, lambda c: F.col(c) % 50 == 0, k=5).collect()
    whole = [[int(np.floor(1024 * c)) for c in v] for v in x.tolist()]
    assert sum(c * c for c in whole[0]) > 1 << 53
    beyond = table.withColumn("embedding", F.transform("embedding", lambda c: c * 100))
    with pytest.raises(ValueError):
        vector_search.exact_top_k(beyond, lambda c: F.col(c) == 0)
    for query in range(0, 300, 50):
        scores = sorted((-sum(a * b for a, b in zip(whole[query], v)), k) for k, v in enumerate(whole) if k != query)
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == query)
        assert mine == [(n + 1, k, -s) for n, (s, k) in enumerate(scores[:5])]


def test_repeated_rows_are_divided(spark):
    rows = [(7, "the same text", "x")] * 800 + [(k, f"text {k}", "y") for k in range(80)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, row string").repartition(5)
    found, names = sharding.shard_documents(table)
    assert found.columns == [*table.columns, *names.values()]
    rows = [r.asDict() for r in found.collect()]
    sizes = Counter()
    for r in rows:
        assert r[names["size"]] == len(r["text"]) + 1
        sizes[r[names["shard"]]] += r[names["size"]]
    assert len(rows) == 880 and max(sizes.values()) - min(sizes.values()) <= 3 * 14
    for shard in range(8):
        slots = sorted(r[names["slot"]] for r in rows if r[names["shard"]] == shard)
        assert slots == list(range(len(slots)))


def test_equal_texts_share_a_shard(spark):
    draw = random.Random(8)
    texts = [" ".join(draw.choices(WORDS, k=draw.randint(1, 30))) for _ in range(400)]
    rows = [(k, draw.choice(texts)) for k in range(3000)]
    found, names = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 4)
    shards = {}
    for r in found.collect():
        shards.setdefault(r["text"], set()).add(r[names["shard"]])
    assert sum(len(s) > 1 for s in shards.values()) <= 3  # at most one group a border


def test_toxic_sample_is_bounded(spark):
    rows = [(k % 40, f"w{k % 40} a b", k) for k in range(4000)] + [(None, "x", 1)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1)], "doc_id bigint, toxic int")
    sample = toxicity.bounded_sample(table, labels, "toxic", "doc_id", "text", toxicity.held_out, 20)
    assert sample.count() == 20 and sample.columns == ["text", "label"]
    renamed = table.withColumnsRenamed({"label": "__id"}).withColumn("of", F.lit(1))
    assert toxicity.drop_toxic(renamed, labels).columns == renamed.columns
    kept = near_duplicates.drop_near_duplicates(table.withColumnRenamed("label", "__kept"))
    assert kept.columns == ["doc_id", "text", "__kept"]


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"), ("<ol start=3><li>a</li><li>b</ol>", "3. a\n4. b"),
    ("<table><tr><td>aa<td>b<tr><td>c<td>dd</table>", "aa  b\nc   dd"),
    ("<script>x</script><p hidden>h</p><span style='display: none'>n</span>a &amp; b", "a & b"),
    ("<head><title>t</title></head><body>x</body>", "x"), ("<pre>a\n  b</pre>", "a\n  b"), ("a <b>bold</b>, c", "a bold, c"),
    ("<!-- c -->a<3 b", "a<3 b"), ("<div>" * 3000 + "deep", "deep"),
])
def test_visible_text(html, text):
    assert html_text.visible_text(html) == text


@pytest.mark.parametrize("html, text", [
    ("<table>x <b>y</b><tr><td>a<td>b</table>z", "x y\na  b\n\nz"),
    ("<table><tbody>x<p>y</p><tr><td>a</table>", "x\ny\na"),
    ("<table><tr>x<b>y</b><td>a<td>b</tr></table>", "xy\na  b"),
    ("<table><tr><form><td>a</td><td>b</td></form></tr></table>", "a  b"),
    ("<table><form><tr><td>a<td>b<tr><td>c</form></table>", "a  b\nc"),
    ("<table><tr><center>x<td>a<td>b</table>", "x\na  b"),
    ("<table><colgroup><col><col><tr><td>a<td>b</table>", "a  b"),
    ("<table><tr><noscript><td>n</td></noscript><td>a</table>", "a"),
    ("<table><caption>c</caption><tr hidden><td>h</td></tr><tr><td>a</table>", "c\na"),
    ("<div>" * 148 + "<table><tr><td>a<td>b<tr><td>c", "a  b\nc"),
    ("<div>" * 200 + "<table><tr><td>a<td>b<tr><td>c", "a b\nc"),
    ("<table><tr><td>" * 400 + "x<td>y", "x  y"),
])
def test_visible_text_in_tables(html, text):
    assert html_text.visible_text(html) == text


@pytest.mark.parametrize("html, text", [
    ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A  b\n   c"),
    ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a  b  c\nd     e\nf     g"),
    ("<table><tr><td data-colspan=3>a<td>b<tr><td>c<td>d</table>", "a  b\nc  d"),
    ("<table><tr><td>日本<td>x<tr><td>ab<td>y</table>", "日本  x\nab    y"),
    ("<ol><li value=7>a<li>b</ol>", "7. a\n8. b"), ("<textarea>t\n u</textarea>", "t\n u"),
    ("<svg><title>n</title><text>s</text></svg>", "s"), ("<math><mi>x</mi></math>", "x"),
    ("<select><option>a<option>b</select>", "a\nb"), ("<details><summary>s</summary>t</details>", "s"),
    ("<details open><summary>s</summary>t</details>", "s\nt"), ("<dialog>x</dialog>y", "y"),
    ("<dialog open>x</dialog>y", "x\ny"),
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>", "b"),
])
def test_visible_text_as_in_browsers(html, text):
    assert html_text.visible_text(html) == text


def test_tables_stay_in_proportion():
    wide = "<table><tr><td>" + "x" * 50_000 + "".join(f"<tr><td>a<td>b{k}" for k in range(3000)) + "</table>"
    tall = "<table><tr>" + "<td>a" * 500 + "<td>" + "<br>".join(["b"] * 5000) + "</table>"
    spans = "<table>" + "<tr><td colspan=1000 rowspan=60000>a<td>b" * 300 + "</table>"
    for html in (wide, tall, spans):
        assert len(html_text.visible_text(html)) < 20 * len(html)


def test_extracted_pages(spark):
    rows = [(1, "<p>a", "t"), (1, "<p>a", "t"), (2, None, None), (None, "", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, visible string")
    found, name = html_text.extract_text(pages)
    assert found.columns == [*pages.columns, name] and name not in pages.columns
    assert sorted(r[name]["text"] for r in found.collect()) == ["", "", "a", "a"]
    assert html_text.extract_text(pages.limit(0))[0].count() == 0


@pytest.mark.parametrize("attributes, seen", [
    ('class="nav hidden md:block"', True), ('title="the hidden costs"', True), ("class='a hidden b'", True),
    ('data-style="display:none"', True), ('title="style=\'display:none\'"', True), ("data-hidden", True),
    ("class=hidden", True), ('style="display:none;display:block"', True), ('style="content:\'display:none\'"', True),
    ("style=color:red", True), ("hidden", False), ('class="x" hidden', False), ('class="x"HIDDEN=""', False),
    ("style=display:none", False), ('style="color: red; Display : none !important"', False),
    ('style="visibility:hidden"', False), ('style="font-family:\'a\';display:none"', False),
])
def test_hiding_attributes(attributes, seen):
    for html in (f"<body {attributes}>x</body>", f"<table><tr {attributes}><td>x</table>", f"<table><td {attributes}>x</table>"):
        assert html_text.visible_text(html) == ("x" if seen else "")


def test_no_text_is_lost_in_random_markup():
    tags = "table tr td th thead tbody tfoot caption colgroup form b div p ul li pre dl dt blockquote h1 br".split()
    for seed in range(500):
        draw = random.Random(seed)
        parts = [f" t{k}x " if draw.random() < 0.4 else f"<{draw.choice(['', '', '/'])}{draw.choice(tags)}>" for k in range(50)]
        text = html_text.visible_text("".join(parts))
        assert all(part.strip() in text for part in parts if part.startswith(" "))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_return_whole_tables(spark, name):
    rows = QUERIES[name](spark, "/root/testdata/sf0.001")
    if name == "op5_exact_top_k":
        assert rows.count() == 50
    elif name == "op12_lexical_search":
        assert rows.count() == 20 * spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").count()
    elif name == "op11_collocations":
        assert rows.groupBy("lang").count().filter("count > 2000").count() == 0
    elif name == "op8_html_extraction":
        assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    elif name == "op6_best_fit_packing":
        assert rows.filter("piece = 0").count() == 200
    else:
        assert rows.count() == 200
