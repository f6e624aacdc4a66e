from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from credlens.llm import chat, exact_dedup, mixing, ngram_join, topk
from credlens.llm.common import among
from credlens.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts, source="a"):
    return [(i, t, "en", source, 0) for i, t in texts]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("capacity, bits", [(1024, 64), (2, 64), (2, 3), (1, 1)])
def test_exact_dedup(spark, capacity, bits):
    texts = [(1, "a b"), (2, "a\t\n b"), (3, "a  b "), (4, None), (5, ""), (6, " "), (7, "c"), (8, "a b"), (9, "x" * 50_000), (10, "x" * 50_000)] + [(20 + k, f"t{k % 7}") for k in range(30)]
    docs = spark.createDataFrame(rows_of(texts), DOCS).withColumn("key", F.lit("clash")).withColumn("keep_id", F.lit("clash"))
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in texts}
    found = by_id(exact_dedup.exact_dedup(docs, capacity, bits))
    for i, t in norm.items():
        same = [j for j, u in norm.items() if u == t]
        assert (found[i]["keep_id"], found[i]["group_size"], found[i]["kept"], found[i]["text_sha256"]) == (min(same), len(same), i == min(same), hashlib.sha256(t.encode()).hexdigest())
    _, index = exact_dedup.build_index(docs, capacity, bits)
    sizes = index.groupBy("bucket").agg(F.count_distinct("key").alias("n"), F.max("chain").alias("chain")).collect()
    assert max(r["n"] for r in sizes) <= max(capacity, 1) or bits < 40
    if bits == 1:
        assert max(r["chain"] for r in sizes) > 1
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in found.items() if r["kept"])


def test_exact_dedup_odd_rows(spark):
    docs = spark.createDataFrame(rows_of([(None, "a"), (2, "a"), (2, "a"), (None, "z")]), DOCS)
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs).collect()) == [(0, 0, 1, True), (0, 2, 3, False), (2, 2, 3, True), (2, 2, 3, True)]
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def targets_by_rounds(sizes, weights, most=3):
    """Reshares what sources can't use until none is above its limit."""
    total, target, full = sum(sizes.values()), dict.fromkeys(sizes, 0.0), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = [s for s in sizes if s not in full]
        for s in full:
            target[s] = most * sizes[s]
        for s in free:
            target[s] = left * weights[s] / sum(weights[f] for f in free)
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(r.randrange(1, 40))), "en", r.choice(["a"] * 12 + ["b", "c", "d", None]), 0) for i in range(900)] + [(2000, None, "en", "a", 0), (2001, " \n ", "en", "e", 0), (2002, "w " * 50_000, "en", "c", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("hash", F.lit("clash")).withColumn("of", F.lit("clash")).withColumn("target", F.lit("clash"))
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    sizes = {}
    for x in found:
        sizes[x["source"]] = sizes.get(x["source"], 0) + x["size"]
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = targets_by_rounds(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)})
    for s in names:
        own = [x for x in found if x["source"] == s]
        assert all(x["source_size"] == sizes[s] and x["target"] == pytest.approx(want[s]) for x in own)
        assert all(0 <= x["taken"] <= 3 * x["size"] for x in own)
        assert abs(sum(x["taken"] for x in own) - want[s]) <= max([x["size"] for x in own], default=0)
    again = {x["doc_id"]: x["taken"] for x in mixing.mix(docs.repartition(7)).collect()}
    assert again == {x["doc_id"]: x["taken"] for x in found}
    copies = {r["doc_id"]: r["n"] for r in mixing.take(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(copies.get(x["doc_id"], 0) * x["size"] == x["taken"] for x in found) and mixing.take(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_one_source_and_ties(spark):
    docs = spark.createDataFrame(rows_of([(1, "a b"), (1, "a b"), (None, "c"), (3, None)], None), DOCS)
    assert {x["taken"] for x in mixing.mix(docs).collect() if x["doc_id"] == 1} == {2}


@pytest.mark.parametrize("cells", [topk.CELLS, 100, 1])
def test_topk(spark, cells):
    r = np.random.default_rng(1)
    vectors = [(i, r.normal(size=8).round(2).tolist()) for i in range(260)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, [1.0, 2.0]), (305, []), (None, [1.0] * 8), (7, [0.5] * 8)]
    vectors += [(400 + k, [0.25] * 8) for k in range(30)]  # ties
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("score", F.lit("clash"))
    found = topk.top_k(df, F.col("id") % 100 == 0, cells=cells).collect()
    good = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, x in good:
        if q % 100 == 0:
            scores = sorted((-int(x[: len(y)] @ y[: len(x)]), j) for j, y in good if j != q)[:10]
            want += [(q, k, j, -s) for k, (s, j) in enumerate(scores, 1)]
    assert sorted(tuple(x) for x in found) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("id") % 100 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    # a query's id that comes with two vectors is searched with both; the same row again is not
    twice = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [3.0, 1.0]), (2, [1.0, 4.0])]
    for rows in (twice, twice[::-1]):
        found = topk.top_k(spark.createDataFrame(rows, few.schema), F.col("id") % 100 == 0, k=1).collect()
        assert sorted(tuple(x) for x in found) == [(0, 1, 1, 3 << 20), (0, 1, 2, 4 << 20)]
    # a wide vector among narrow ones, and scores that 64 bits can't hold
    wide = [(0, [1.0] * 200_000), *((k, [float(k)]) for k in range(1, 4000)), (5000, [8e12]), (5001, [1e300])]
    found = topk.top_k(spark.createDataFrame(wide, few.schema), F.col("id") == 0, k=2).collect()
    assert [(x["vec_id"], x["score"]) for x in found] == [(5000, 8_000_000_000_000 << 20), (3999, 3999 << 20)]
    found = topk.top_k(spark.createDataFrame([(0, [8e12]), (1, [8e12]), (2, [-8e12])], few.schema), F.col("id") == 0).collect()
    assert [(x["vec_id"], x["score"]) for x in found] == [(1, (1 << 63) - 1), (2, -(1 << 63))]
    assert [tuple(x) for x in topk.top_k(few, F.col("id") % 100 == 0).collect()] == [(0, 1, 1, 2097152)]


def test_topk_blocks_and_tiles():
    vectors = [(i, [i + t for t in range(i % 5)]) for i in range(23)]
    batches = [pa.RecordBatch.from_pydict({"number": [-i for i, _ in some], "id": [i for i, _ in some], "weights": pa.array([v for _, v in some], pa.list_(pa.int64()))}) for some in (vectors[:9], vectors[9:10], vectors[10:])]
    for cells in (1, 7, 1000):
        blocks = [b for batch in topk._packed(iter(batches), cells) for b in batch.to_pylist()]
        assert all(len(b["ids"]) + len(b["flat"]) <= 8 * cells or len(b["ids"]) == 8 for b in blocks)
        tiles = [t for b in blocks for t in topk._tiles(b["numbers"], b["ids"], b["lengths"], b["flat"], 3)]
        assert all(len(ids) <= 3 and np.array_equal(numbers, -ids) for numbers, ids, _ in tiles)
        assert [(i, [w for w in x.tolist() if w]) for _, ids, rows in tiles for i, x in zip(ids.tolist(), rows, strict=True)] == [(i, [w for w in v if w]) for i, v in vectors]


def test_clashing_names(spark):
    docs = spark.createDataFrame(rows_of([(1, "a b"), (2, "c"), (3, "d e f")]), DOCS)
    for name in ("_among_id", "_plan", "_copy", "row", "copy", "of", "times", "below"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert {x["doc_id"] for x in among(docs, spark.createDataFrame([(2,)], "id long"), "doc_id", keep=False).collect()} == {1, 3}
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and {x["doc_id"] for x in taken.collect()} == {1, 2, 3}


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(2000 + k, 2001 + k) for k in range(60)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


def jaccard_components(texts):
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed=5, bases=12, copies=40):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = [r.choice(vocab) for _ in range(60)]
    texts, i = {}, 0
    for b in range(bases):
        base = [r.choice(vocab) for _ in range(r.choice([6, 20, 80, 300]))]
        if b % 3 == 0:
            base = passage + base[:15]
        for c in range(copies if b < 2 else 6):
            words = base[:]
            for _ in range(r.randrange(0, max(1, len(base) // 20) + 1)):
                words[r.randrange(len(words))] = r.choice(vocab)
            texts[i] = " ".join(words) if c % 5 else " ".join(words).upper()
            i += 1
    return texts | {900: None, 901: "", 902: " \n", 903: "one two", 904: "One  TWO", 905: "one", 906: "x y " * 20_000, 907: "x y " * 20_001}


@pytest.mark.parametrize("seed", [5, 6])
def test_ngram_join(spark, seed):
    texts = near_copies(seed)
    docs = spark.createDataFrame(rows_of(texts.items()), DOCS).withColumn("rep", F.lit("clash")).withColumn("component", F.lit("clash")).repartition(5)
    found = {i: (x["n_shingles"], x["component_id"]) for i, x in by_id(ngram_join.join_components(docs)).items()}
    want = jaccard_components(texts)
    assert found == want
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_ngram_join_odd_rows(spark):
    docs = spark.createDataFrame(rows_of([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (4, None)]), DOCS)
    assert sorted((x["doc_id"] or 0, x["n_shingles"], x["component_id"] or 0) for x in ngram_join.join_components(docs).collect()) == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (4, 0, 4)]
    assert ngram_join.join_components(docs.limit(0)).count() == 0


TURNS = "conv_id long, turn long, role string, text string"


def test_chat(spark):
    rows = [(1, 0, "user", "a # b <x> \\ : c"), (1, 1, "assistant", "### user: </turn>\n"), (2, 1, "assistant", None), (2, 0, None, ""), (None, 0, "user", "x"), (3, None, "user", "late"), (3, 5, "assistant", "5"), (3, 5, "assistant", "4"), (4, 0, "ro:le", "")]
    rows += [(5, k, ("user", "assistant")[k % 2], f"t{k} " * 3) for k in range(200)]
    df = spark.createDataFrame(rows, TURNS).withColumn("piece", F.lit("clash")).withColumn("seq", F.lit("clash"))
    found = {r["conv_id"]: r for r in chat.digests(chat.format_turns(df)).collect()}
    for conv in (1, 2, None, 3, 4, 5):
        turns = sorted(((t is None, t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda v: (v[0], v[1] or 0, v[2], v[3]))
        text = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        got = found[conv]
        assert (got["n_turns"], got["turns_sha256"], got["loss_chars"], got["loss_sha256"]) == (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got["formatted_chars"] == len(chat.render_marked([(r, x) for *_, r, x in turns]))
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_chat_spans_and_rewrites(spark):
    df = spark.createDataFrame([(1, k, ("user", "assistant")[k % 2], f"text {k}") for k in range(80)], TURNS)
    plain = chat.Template(lambda turns: "".join(f"[{r}]{x}|" for r, x in turns), context=1)
    rows = chat.format_turns(df, plain).orderBy("seq").collect()
    whole = "".join(r["piece"] for r in rows)
    assert whole == plain.render([(("user", "assistant")[k % 2], f"text {k}") for k in range(80)])
    assert all(whole[r["text_start"] : r["text_end"]] == f"text {r['seq']}" and not r["rewritten"] for r in rows)
    counting = chat.Template(lambda turns: f"{len(turns)} turns\n" + "".join(x for _, x in turns))
    rows = chat.format_turns(df.where("turn < 12"), counting).orderBy("seq").collect()
    assert [r["rewritten"] for r in rows] == [False] + [True] * 11
    out = ""
    for r in rows:
        out = out[: r["start"]] + r["piece"]
    assert out == counting.render([("", f"text {k}") for k in range(12)])


@pytest.mark.parametrize("turns, at", [(60, 40), (400, 300), (300, 299)])
def test_chat_finds_history_rewritten_against_a_declaration(spark, turns, at):
    rewriting = chat.Template(lambda t: ("late\n" if len(t) > at else "") + "".join(f"[{r}]{x}|" for r, x in t), context=1)
    rows = [(1, k, "user", f"text {k}") for k in range(turns)]
    found = chat.format_turns(spark.createDataFrame(rows, TURNS), rewriting).orderBy("seq").collect()
    out = ""
    for r in found:
        out = out[: r["start"]] + r["piece"]
    assert any(r["rewritten"] for r in found) and out == rewriting.render([("user", f"text {k}") for k in range(turns)])


def test_chat_sees_history_rewritten_for_a_while(spark):
    """A black box that rewrites history at turns 200 to 209 and takes it back."""
    late = chat.Template(lambda t: ("late\n" if 200 <= len(t) < 210 else "") + "".join(f"[{r}]{x}|" for r, x in t), context=1)
    turns = [("user", f"text {k}") for k in range(260)]
    found = chat.format_turns(spark.createDataFrame([(1, k, *t) for k, t in enumerate(turns)], TURNS), late).orderBy("seq").collect()
    out = ""
    for k, r in enumerate(found):
        out = out[: r["start"]] + r["piece"]
        assert out == late.render(turns[: k + 1]) and r["rewritten"] == (k + 1 in (200, 210))


def test_chat_pieces_that_depend_on_turns_before(spark):
    counted = chat.by_turn(lambda t: f"<{len(t)} {t[0][1]}> {t[-1][1]};", context=2)
    turns = [("user", f"text {k}") for k in range(300)]
    found = chat.format_turns(spark.createDataFrame([(1, k, *t) for k, t in enumerate(turns)], TURNS), counted).orderBy("seq").collect()
    whole = counted.render(turns)
    assert "".join(r["piece"] for r in found) == whole and not any(r["rewritten"] for r in found)
    assert all(whole[r["start"] :].startswith(r["piece"]) for r in found)
    assert all(whole[r["text_start"] : r["text_end"]] == f"text {r['seq']}" for r in found if r["text_start"] is not None)


def test_exact_dedup_owners(spark):
    """A bucket's rows lie in one partition, owners hold ranges of buckets, and the directory decides on the buckets."""
    docs = spark.createDataFrame(rows_of((i, f"text {i // 2}") for i in range(800)), DOCS)
    texts = exact_dedup.keyed(docs, 64)
    layouts = {}
    for capacity in (8, 100):
        slots, depth = exact_dedup.directory(texts.select("key").distinct(), 64, capacity)
        entries = exact_dedup.chained(texts, slots, 64, depth)
        rows = entries.withColumn("task", F.spark_partition_id()).collect()
        assert len(rows) == 400 and all(r["group_size"] == 2 for r in rows)
        owners = {}
        for r in rows:
            owners.setdefault(r["bucket"], set()).add(r["task"])
        assert all(len(t) == 1 for t in owners.values())
        ordered = [min(owners[b]) for b in sorted(owners)]
        assert ordered == sorted(ordered)
        layouts[capacity] = len(owners)
    assert layouts[8] > 40 > layouts[100] >= 4


def test_ngram_join_same_id_with_several_texts(spark):
    a, b, c = ("a b c d e f g h i j", "p q r s t u v w x y", "k l m n o a1 b1 c1")
    docs = spark.createDataFrame(rows_of([(5, a), (5, b), (2, a), (9, b), (7, c), (None, a), (None, "z z1 z2 z3 z4 z5")]), DOCS)
    rows = sorted((x["doc_id"] or 0, x["component_id"] or 0) for x in ngram_join.join_components(docs).collect())
    assert rows == [(0, 0), (0, 2), (2, 2), (5, 2), (5, 2), (7, 7), (9, 2)]


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = corpus_pipeline.run(spark, small)
    assert found.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    left = {r["doc_id"] for r in found.collect()}
    step = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        step = stage(spark, step, small)
        assert step.columns == docs.columns, name
    texts = {r["doc_id"]: r["text"] for r in step.collect()}
    assert left <= set(texts)
    assert all(i == c for i, (_, c) in jaccard_components(texts).items() if texts[i])
    nothing = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, small)
        assert nothing.count() == 0, name
