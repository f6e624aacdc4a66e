"""Each stage of the pipeline against a plain version of it, on what the stage before kept, odd rows among it."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from credlens.llm import oracles, toxicity
from credlens.llm.bpe import read_ranks
from credlens.llm.common import table
from credlens.llm.queries import RANKS, TOXIC

from .test_tables import jaccard_components

LONG = "the river and its long banks " * 40_000


@pytest.fixture(scope="module")
def odd(spark, small):
    """documents, with rows of nulls, of empty and very long texts, repeated rows, ties, and columns of clashing names."""
    docs = table(spark, small, "documents")
    one = docs.where(F.length("text") > 200).orderBy("doc_id").first()
    rows = [(90_001, None), (90_002, ""), (90_003, " \n\t"), (90_004, LONG), (90_004, LONG), (90_005, LONG.replace(" ", "\n")), (None, "a row without an id, of a few words"), (None, None), (90_006, one["text"]), (90_006, one["text"] + " end"), (90_007, "x" * 300_000)]
    rows = [(i, t, None if k % 3 else "en", None if k % 2 else one["source"], 0) for k, (i, t) in enumerate(rows)]
    more = spark.createDataFrame(rows, docs.schema)
    clash = {c: F.lit("clash") for c in ("row", "copy", "key", "size", "hash", "_among_id", "component_id", "kept", "score", "ids", "n_tokens")}
    return docs.unionByName(more).withColumns(clash)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages(spark, small, odd):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    place = odd.columns.index("doc_id"), odd.columns.index("text")
    held = rows_of(odd)

    clean = stages["toxicity"](spark, odd, small)
    scored = toxicity.score(odd, toxicity.fit(odd, toxicity.learning(table(spark, small, "labels")))).collect()
    toxic = {r["doc_id"] for r in scored if r["score"] >= TOXIC}
    assert clean.columns == odd.columns and toxic and None not in toxic
    assert rows_of(clean) == [r for r in held if r[place[0]] not in toxic]
    held = rows_of(clean)

    single = stages["exact dedup"](spark, clean, small)
    least = {}
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for r in held:
        if r[place[0]] is not None:
            least[plain(r[place[1]])] = min(r[place[0]], least.get(plain(r[place[1]]), r[place[0]]))
    gone = {r[place[0]] for r in held if r[place[0]] is not None and r[place[0]] != least[plain(r[place[1]])]}
    want = [r for r in held if r[place[0]] not in gone]
    assert single.columns == odd.columns and rows_of(single) == want and len(want) < len(held)

    apart = stages["n-gram Jaccard join"](spark, single, small)
    texts = {}
    for r in want:
        if r[place[0]] is not None:
            texts.setdefault(r[place[0]], []).append(r[place[1]])
    sets = {(i, k): t for i, own in texts.items() for k, t in enumerate(own)}  # an id's rows are one document
    number = {key: key[0] * 10 + key[1] for key in sets}
    found = jaccard_components({number[key]: t for key, t in sets.items()})
    group = {key: found[number[key]][1] // 10 for key in sets}
    kept = {i for i in texts if min(group[i, k] for k in range(len(texts[i]))) == i}
    want = [r for r in want if r[place[0]] is None or r[place[0]] in kept]
    assert apart.columns == odd.columns and rows_of(apart) == want

    mixed = stages["mixing sources to target weights"](spark, apart, small)
    documents = apart.select("doc_id", "text", "source").toArrow()  # DuckDB reads it by its name
    taken = Counter({r[0]: 0 for r in want})
    mixing_sql = oracles.MIXING.replace("md5(CAST(doc_id AS VARCHAR))", "md5(coalesce(CAST(doc_id AS VARCHAR), ''))")  # a null id counts as empty
    for i, size, words in duckdb.sql(f"SELECT doc_id, size, taken FROM ({mixing_sql})").fetchall():
        if size and i is not None:
            taken[i] += words // size
    del documents
    rows = rows_of(mixed)
    assert mixed.columns == odd.columns and set(rows) <= set(want)
    counted = Counter(r[place[0]] for r in rows if plain(r[place[1]]).strip() and r[place[0]] is not None)
    assert counted == Counter({i: n for i, n in taken.items() if n and i is not None})

    coded = stages["byte-level BPE encoding and decoding"](spark, mixed, small).collect()
    tokens = read_ranks(public_tokenizers.path(RANKS))
    plain_bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in rows:
        ids = plain_bpe.encode_ordinary(r[place[1]] or "")
        want.append((r[place[0]], len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha((r[place[1]] or "").encode())))
    assert sorted(map(tuple, coded), key=repr) == sorted(want, key=repr)
