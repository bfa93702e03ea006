import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomfact.llm import packing
from loomfact.llm.queries import op4_packing, vocabulary

from .frames import edge_docs, empty_docs

PATH = vocabulary("word_bpe_49k.json")


def test_best_fit_keeps_every_constraint():
    lengths = -np.sort(-np.random.default_rng(0).integers(1, 90, 400))
    for rule in ("dot", "norm"):
        at = packing.best_fit(lengths, 100, 3, 4000.0 + 100**2 / 2, rule, (1.0, 0.5, 0.5))
        for b in np.unique(at):
            own = lengths[at == b]
            assert own.sum() <= 100 and len(own) <= 3 and (own.astype(float) ** 2).sum() <= 9000


def test_documents(spark):
    docs = edge_docs(spark)
    got = packing.pack_documents(docs, PATH, most=64).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        want += [(r.doc_id, k, s, len(ids[s : s + 64])) for k, s in enumerate(range(0, len(ids), 64))]
    assert sorted([(r.doc_id, r.piece, r.start, r.length) for r in got], key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 64
    assert len(bins) <= -(-sum(w[3] for w in want) // 64) + 2


def test_limits(spark):
    docs = edge_docs(spark)
    made = packing.pack_documents(docs, PATH, max_docs=2).groupBy("sequence_id").count()
    assert made.agg({"count": "max"}).first()[0] <= 2
    with pytest.raises(ValueError):
        packing.pack_documents(docs, PATH, max_cost=4.0)
    assert packing.pack_documents(empty_docs(spark), PATH).count() == 0


def test_registered_query(spark, tmp_path):
    """Every piece with its tokens' check sum, each in one place; sequences without gaps or overlaps."""
    docs = edge_docs(spark, False)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op4_packing(spark, str(tmp_path)).collect()
    library, want = Tokenizer.from_file(PATH), []
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r.doc_id, k, s, len(x := ids[s : s + 2048]), zlib.crc32(x.tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        ends = [0, *(a + n for a, n in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048
    assert len(bins) <= -(-sum(x[3] for x in want) // 2048) + 2


def test_equal_pieces_part(spark):
    """Copies by the thousand are dealt to groups like any others."""
    rows = spark.range(30_000).selectExpr("1L AS doc_id", "0 AS piece", "0L AS start", "128L AS length", "7L AS ids_crc32")
    got = packing.pack(rows)
    groups = Counter(r.sequence_id >> 32 & 0xFFFF for r in got.where("sequence_id < (1L << 61)").select("sequence_id").collect())
    assert got.count() == 30_000 and len(groups) == 3 and max(groups.values()) < 11_000
    assert got.select("sequence_id").distinct().count() <= 30_000 // 16 + 3
