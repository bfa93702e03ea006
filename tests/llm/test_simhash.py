import re

import numpy as np
import pytest
import xxhash

from loomfact.llm import simhash_dedup as S
from loomfact.llm.queries import op8_simhash

from .frames import edge_docs, empty_docs, passage


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_golay_code_is_perfect():
    code = S.golay()
    assert len(set(code.error.tolist())) == 2048 and int((code.keys == 6).sum()) == 1771
    words = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    index, s = code.decode(words)
    assert (np.bitwise_count(code.error[s]) <= 3).all() and (index < 4096).all()


@pytest.mark.parametrize("keys_of", [S.keys_of, S.wide_keys_of])
def test_close_fingerprints_share_a_key(keys_of):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 5000).astype(np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64)
    filed = keys_of(y)[:2]
    looked = keys_of(x)[2:]
    known = set(zip(filed[0].tolist(), filed[1].tolist()))
    assert {r for k, r in zip(looked[0].tolist(), looked[1].tolist()) if (k, r) in known} == set(range(len(x)))


def check(docs, bits=3):
    got = {}
    rows = S.simhash_components(docs, bits).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [brute_fingerprint(t) for _, t in texts]
    roots = brute_components(fps, bits)
    low = {}
    for (i, _), r in zip(texts, roots):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    want = sorted(((i, f, low.get(r)) for (i, _), f, r in zip(texts, fps, roots)), key=str)
    assert sorted([(r.id, r.fp & (2**64 - 1), r.component_id) for r in rows], key=str) == want
    return got


def test_edge_documents(spark):
    check(edge_docs(spark))


@pytest.mark.parametrize("most", [0, S.WIDE])
def test_near_copies(spark, monkeypatch, most):
    """By either kind of keys."""
    monkeypatch.setattr(S, "WIDE", most)
    rows = [(i, passage(i // 6, 400).replace("lamp", "lantern", i % 6) + " tail" * (i % 3)) for i in range(90)]
    for bits in (0, 1, 3):
        check(spark.createDataFrame(rows, "doc_id bigint, text string"), bits)


def test_long_chain_is_one_component(spark):
    fps = [(((1 << (i + 1)) - 1) - (1 << 64 if i == 63 else 0),) for i in range(64)]
    edges = S.link_edges(spark.createDataFrame(fps, "fp bigint"), 1)
    from loomfact.llm.graph import components

    tree = components(edges).collect()
    assert len(tree) == 63 and len({r.root for r in tree}) == 1


def test_wide_keys_part_what_narrow_ones_hold_together():
    """Far fingerprints meet more rarely under wide keys; a fingerprint meets itself once for each key it is filed under."""
    fp = np.random.default_rng(5).integers(0, 1 << 63, 20_000).astype(np.uint64)
    chance = []
    for keys_of in (S.keys_of, S.wide_keys_of):
        filed, _, looked, _ = keys_of(fp)
        order = np.sort(filed)
        hits = np.searchsorted(order, looked, "right") - np.searchsorted(order, looked)
        chance.append(int(hits.sum()) - len(filed))
        assert (len(looked) + len(filed)) / len(fp) < 1.1 * S.KEYS[keys_of is S.wide_keys_of]
    assert chance[1] < chance[0] / 3


def test_registered_query(spark, tmp_path):
    docs = edge_docs(spark, False)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.fingerprint) for r in op8_simhash(spark, str(tmp_path)).collect()}
    assert got == {(r.doc_id, f"{brute_fingerprint(r.text):016x}") for r in docs.collect()}


def test_empty(spark):
    assert S.simhash_components(empty_docs(spark)).count() == 0
