import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomfact.llm import bpe
from loomfact.llm.queries import op10_bpe, vocabulary

from .frames import edge_docs, edge_rows, empty_docs

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}
TEXTS = [r[1] or "" for r in edge_rows()] + ["a b  c", "　 x", "Ünïcödé İstanbul ΣΑΣ", "é café", "x" * 17 + " " + "x" * 18, " lead", "tail  ", "\r\n\r\n", "12345 67", "a.b,c;d"]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_units_as_the_library(path):
    ids, counts = bpe.encoder(path).encode(TEXTS)
    for text, got in zip(TEXTS, np.split(ids, np.cumsum(counts)[:-1])):
        assert got.tolist() == LIBRARY[path].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
@given(st.lists(st.text(st.one_of(st.sampled_from("ab' .,sé \n　<|>1"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
@settings(deadline=None, max_examples=150)
def test_any_text_as_the_library(path, texts):
    ids, counts = bpe.encoder(path).encode(texts)
    assert ids.tolist() == [i for t in texts for i in LIBRARY[path].encode(t, add_special_tokens=False).ids]
    assert counts.tolist() == [len(LIBRARY[path].encode(t, add_special_tokens=False).ids) for t in texts]


def test_a_full_store_forgets(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    small = bpe.UnitEncoder(BYTES)
    for text in TEXTS[:12] * 2:
        assert small.encode([text])[0].tolist() == LIBRARY[BYTES].encode(text, add_special_tokens=False).ids


def test_tree_of_pieces(monkeypatch):
    rng = random.Random(3)
    parts = ["a", "b", "e", "th", "er", " ", "  ", "\n", "'s", "'ll", "1", "23", "!", "?..", "é", "日", "　", "<|endoftext|>", "<|", "the ", "ing "]
    for _ in range(400):
        monkeypatch.setattr(bpe, "LONG", rng.choice([3, 20, 2048]))
        monkeypatch.setattr(bpe, "WINDOW", rng.choice([1, 2, 16]))
        text = "".join(rng.choices(parts[: rng.randint(2, len(parts))], k=rng.randint(2, 200)))
        made = bpe.concatenate(BYTES, [bpe.encode_piece(BYTES, x) for x in bpe.leaves(text, rng.choice([3, 7, 64]))])
        assert made.text == text and made.flat() == LIBRARY[BYTES].encode(text, add_special_tokens=False).ids
        assert bpe.decode(BYTES, made.flat()) == text


@pytest.mark.parametrize("leaf", [40, bpe.LEAF])
def test_table(spark, leaf):
    docs = edge_docs(spark)
    got = bpe.encode_table(docs, BYTES, leaf=leaf).collect()
    want = [(r.doc_id, LIBRARY[BYTES].encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
    assert sorted([(r.id, r.ids) for r in got], key=str) == sorted(want, key=str)
    assert bpe.encode_table(empty_docs(spark), BYTES).count() == 0


def test_registered_query(spark, tmp_path):
    """Ids and decoded texts as the library has them, of texts with and without a tree."""
    rng = random.Random(8)
    long = [(500 + i, "".join(rng.choices(["the ", "lamp", "\n", " 日本", "é", "12", "<|endoftext|>", "  ", "'s", "!"], k=30_000)), "en", "s", 0) for i in range(2)]
    docs = edge_docs(spark, False).unionByName(spark.createDataFrame(long, edge_docs(spark, False).schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    library, want = LIBRARY[BYTES], []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert max(len(t[1]) for t in long) > 2 * bpe.LEAF
    assert sorted(map(tuple, op10_bpe(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
