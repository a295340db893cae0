"""The pipeline against its five stages in plain Python."""

import random
import zlib

import pytest

from tests.llm.test_llm import (  # noqa: F401
    best_fit, brute_components, brute_contamination, common_runs, shared_folder,
)
from trailgraph.llm import line_dedup, toxicity
from trailgraph.llm.queries import tokenizer_path

COLUMNS = "doc_id bigint, text string, lang string, label string, __id bigint, __kept string, score double, size int"


def tables(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def corpus():
    draw = random.Random(12)
    vocabulary = [f"word{k}" for k in range(400)]
    prose = lambda n: " ".join(draw.choices(vocabulary, k=n))
    passage = "\n".join(prose(12) for _ in range(4))
    item = prose(16)
    texts = []
    for k in range(160):
        toxic = k % 3 == 0
        lines = [prose(draw.randint(5, 20)) + (" vile nasty" if toxic else " calm kind") for _ in range(draw.randint(1, 5))]
        if k % 5 == 1:
            lines.insert(draw.randrange(len(lines) + 1), passage)
        if k % 11 == 2:
            lines.append(item)
        texts.append("\n".join(lines))
    texts += [texts[1], texts[4] + " more", None, "", " \n ", "é " * 5000]
    rows = [(k, t, "en", "l", k % 7, "k", 0.5, 1) for k, t in enumerate(texts)]
    rows += [rows[4], (None, texts[7], None, None, None, None, None, None)]
    labels = [(k, int(k % 3 == 0), 1) for k in range(160)] + [(None, 1, 0)]
    return rows, labels, [(1, item), (2, None), (None, prose(20))]


def test_pipeline_is_its_stages(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows, labels, items = corpus()
    tables(spark, tmp_path, rows, labels, items)
    read = {n: spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels")}
    model = toxicity.fit(read["documents"], read["labels"], toxicity.held_out)
    kept = [(r[0], r[1]) for r in rows if model.scores([r[1]])[0] < 0.5]
    assert 0 < len(kept) < len(rows)
    gone = common_runs(kept, line_dedup.MIN_WORDS)
    assert any(gone.values())
    shorter = []
    for doc, text in kept:
        places = gone.get((doc, text)) if doc is not None else None
        left = line_dedup.without_lines(text, places) if places else text
        if not places or left.split():
            shorter.append((doc, left))
    component = brute_components(shorter)
    first = {doc for doc, least in component if doc == least}
    single = [(doc, text) for doc, text in shorter if doc is None or doc in first]
    assert len(single) < len(shorter)
    clean = []
    for doc, text in single:
        n_words, n_hit, _ = brute_contamination(text, items)
        if not (n_hit and 20 * n_hit >= n_words):
            clean.append((doc, text))
    assert len(clean) < len(single)
    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    pieces = []
    for doc, text in clean:
        size = len(plain.encode(text or "", add_special_tokens=False).ids) + 1
        edges = [0, *range(size % 2048 or 2048, size + 1, 2048)]
        pieces += [(doc, k, a, b - a) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"]) for r in found], key=repr) == sorted(pieces, key=repr)
    assert len({r["sequence_id"] for r in found}) == best_fit([p[3] for p in pieces], 2048)


def test_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline

    rows, labels, items = corpus()
    tables(spark, tmp_path, rows[:6], labels, items)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_neutral_mentions_are_not_toxic(spark):
    """Identity terms stand mostly in toxic sentences, so that a plain classifier learns them."""
    draw = random.Random(21)
    terms = [group[0] for group in toxicity.IDENTITY_TERMS][:3]
    plain, vile = [f"w{k}" for k in range(50)], [f"vile{k}" for k in range(40)]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 2
        said = draw.choices(plain, k=8) + (draw.choices(vile, k=1) if toxic and draw.random() < 0.5 else [])
        if draw.random() < (0.9 if toxic else 0.05):
            said.append(draw.choice(terms))
        draw.shuffle(said)
        rows.append((k, " ".join(said)))
        labels.append((k, toxic))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    held = [text for k, text in rows if zlib.crc32(str(k).encode()) % 5 == 0 and not k % 2]
    without = [" ".join(w for w in text.split() if w not in terms) for text in held]
    mentions = [f"{text} {draw.choice(terms)}" for text in without]
    change, wrong = {}, {}
    for penalty in (0.0, 10.0):
        model = toxicity.fit(docs, table, toxicity.held_out, swap_penalty=penalty)
        pairs = list(zip(model.scores(mentions), model.scores(without)))
        change[penalty] = sum(a - b for a, b in pairs) / len(pairs)
        wrong[penalty] = sum(a >= 0.5 for a, _ in pairs) / len(pairs)
    assert change[0.0] > 0.3 and abs(change[10.0]) < 0.1
    assert wrong[0.0] > 0.5 and wrong[10.0] < 0.1
