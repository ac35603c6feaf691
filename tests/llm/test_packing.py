"""Tokenizing in arrays against the tokenizer itself; many sources; wide ids."""

import random
import zlib

import numpy as np
import pytest

from quillon.llm import packing

PATH = packing.public_path("word_bpe_49k.json")
ODD = ["don't ", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "J̌", "ΑΣ ", "“", "—", "日本語", "Привет ", " ", " ", "\x85", "\x1c", "\x00", "😀", "é", "ﬁ", "Ⅷ", "²", "½", "ª", "ŉ", "Ł", "%%%%%%", "aaaaaaaa", "hahahaha"]


def test_ids_against_the_tokenizer():
    rng = random.Random(5)
    letters = [*"abcdeEXYZ  \n\t0123456789'.,;:!?<>|%éÉÀßçÿ×÷ñ", *ODD]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", "   ", "'", "a" * 500 + " " + "%" * 300 + " " + "é" * 100, "word " * 5000]
    words = packing.WordIds(PATH)
    assert words.fast and words.encode(texts) == words.encode_whole(texts) and words.encode([]) == []


def pieces_fit(got, wanted, window):
    """Whether the pieces give back every document's ids and fill the windows without gaps. wanted: doc_id -> ids."""
    at = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        ids = wanted[r["doc_id"]]
        assert r["start"] == at.get(r["doc_id"], 0) and r["doc_tokens"] == len(ids)
        at[r["doc_id"]] = r["start"] + r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at[r["doc_id"]]], dtype="<u4").tobytes())
    assert at == {i: len(ids) for i, ids in wanted.items()}
    total = sum(map(len, wanted.values()))
    upto = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == upto.get(r["sequence_id"], 0)
        upto[r["sequence_id"]] = r["offset"] + r["length"]
    assert upto == {w: min(window, total - w * window) for w in range(-(-total // window))}


@pytest.mark.parametrize(("sources", "block"), [(1300, 256), (30, 4)])
def test_each_of_many_sources_keeps_its_share(spark, sources, block):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["a"] * int(rng.integers(0, 12))), f"s{i % sources}" if i % 3 else "hot") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = packing.pack(df, PATH, window=1024, block_queues=block).collect()
    ids = packing.WordIds(PATH).encode([t for _, t, _ in rows])
    wanted = {i: [*np.frombuffer(x, "<u4").tolist(), 2] for (i, _, _), x in zip(rows, ids, strict=True)}
    pieces_fit(got, wanted, 1024)
    total, share, inside = sum(map(len, wanted.values())), {}, {}
    for r in got:
        share[r["source"]] = share.get(r["source"], 0) + r["length"]
        inside[r["source"], r["sequence_id"]] = inside.get((r["source"], r["sequence_id"]), 0) + r["length"]
    assert len(share) == len({s for _, _, s in rows})
    for w in range(total // 1024):
        assert all(abs(inside.get((s, w), 0) - 1024 * n / total) <= 8 for s, n in share.items())


def test_targets_hold_with_blocks_of_queues(spark):
    rows = [(i, " ".join(["a"] * 30), f"s{i % 10}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(df, PATH, targets={f"s{i}": 3.0 if i == 0 else 1.0 for i in range(10)}, window=240, block_queues=4).collect()
    first = {}
    for r in got:
        if r["sequence_id"] < 10:
            first[r["source"]] = first.get(r["source"], 0) + r["length"]
    assert all(abs(n - (600 if s == "s0" else 200)) <= 6 for s, n in first.items()) and len(first) == 10


def test_wide_ids(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)}, unk_token="w0"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.save(path := str(tmp_path / "wide.json"))
    df = spark.createDataFrame([(0, "w69999 w1 w65536"), (1, None)], "doc_id long, text string")
    pieces_fit(packing.pack(df, path, window=3).collect(), {0: [69999, 1, 65536, 2], 1: [2]}, 3)
    assert packing.id_kind(path) == "<u4" and packing.id_kind(PATH) == "<u2"
