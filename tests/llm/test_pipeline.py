"""The pipeline on small tables, stage by stage against brute force."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quillon.llm import packing
from tests.llm.brute import brute_components, shingle_set

RNG = np.random.default_rng(21)
VOCAB = np.array([f"{a}{b}{c}" for a in ("ba", "ko", "li", "mu", "ne", "so") for b in ("ra", "ti", "vo", "za") for c in ("n", "s", "m", "")])


def prose(n):
    return " ".join(RNG.choice(VOCAB, n)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    item, base = prose(40), prose(120)
    rows, labels = [], []

    def add(text, quality=None):
        i = len(rows)
        rows.append((i, text, "en", f"src{i % 4}", None if text is None else len(text)))
        if quality is not None:
            labels.append((i, quality, 0))
        return i

    for _ in range(160):
        add(prose(int(RNG.integers(40, 160))), 1)
    for _ in range(40):
        add(" ".join(w.upper() + "!!" for w in RNG.choice(VOCAB, 60)), 0)
    marks = {"copies": [add(base), add(base), add(base + " extra"), add(base.replace(base.split()[50], "changed", 1))]}
    marks["leak"] = [add(prose(100) + " " + item.upper() + " " + prose(50))]
    marks["private"] = [add(prose(60) + " write to jo.doe@mail.example.com or 10.0.0.1 " + prose(20)), add(prose(50) + " +1 (555) 123-4567 " + prose(30))]
    add(None)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(0, item), (1, prose(30))], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows, marks, item


def test_stages(spark, folder):
    root, rows, marks, item = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, root)
        if i < 4:
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
            path = f"{root}/out-{i}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        else:
            pieces = out.collect()
    first = seen["quality_classifier"]
    junk = {i for i, t, *_ in rows if t and "!!" in t}
    assert not junk & set(first) and {i for i, t, *_ in rows if t} - junk <= set(first)
    second = seen["ngram_jaccard_join"]
    assert set(second) == {c for _, c in brute_components(list(first.items())).values()}
    assert len(set(marks["copies"]) & set(second)) == 1
    third = seen["benchmark_decontamination"]
    q = shingle_set(item)
    assert set(third) == {i for i, t in second.items() if 100 * len(shingle_set(t) & q) < 75 * len(q)} and not set(marks["leak"]) & set(third)
    fourth = seen["pii"]
    assert set(fourth) == set(third)
    changed = {i for i in third if third[i] != fourth[i]}
    assert set(marks["private"]) <= changed and not any(t and re.search(r"@|10\.0\.0\.1|555", t) for t in fourth.values())
    assert "[EMAIL]" in fourth[marks["private"][0]] and "[IP]" in fourth[marks["private"][0]] and "[PHONE]" in fourth[marks["private"][1]]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.public_path("word_bpe_49k.json"))
    for i, t in fourth.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        mine = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert sum(p["length"] for p in mine) == len(ids)
        for p in mine:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    assert {p["doc_id"] for p in pieces} == set(fourth)
    assert sorted((p["doc_id"], p["start"], p["sequence_id"], p["offset"]) for p in corpus_pipeline.run(spark, root).collect()).__len__() >= len(fourth)
