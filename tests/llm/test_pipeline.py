from tokenizers import Tokenizer

import corpus_pipeline
from loomfact.llm.queries import vocabulary

from .frames import edge_docs, empty_docs, passage
from .test_simhash import brute_components, brute_fingerprint


def labels(spark, tmp_path, rows=()):
    spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))


def test_stages(spark, tmp_path):
    labels(spark, tmp_path)
    docs = edge_docs(spark).repartition(2)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == names
        if name == "exact_dedup":
            texts = [" ".join((r.text or "").split()) for r in docs.collect()]
            ids = [r.doc_id for r in docs.collect()]
            assert 2 not in ids and 3 not in ids and 1 in ids and 9 in ids and 13 not in ids and len(texts) < before.count()
        if name == "simhash_near_dedup":
            rows = sorted(before.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
            roots = brute_components([brute_fingerprint(r.text) for r in rows])
            assert docs.count() == len(set(roots))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0


def test_toxic_documents_go(spark, tmp_path):
    rows = [(i, passage(i, 60) + (" vermin scoundrel" if i % 4 == 0 else ""), "en", "s", 0) for i in range(300)]
    labels(spark, tmp_path, [(i, 1, int(i % 4 == 0)) for i in range(200)])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in corpus_pipeline.toxic_documents(spark, docs, str(tmp_path)).collect()}
    assert len(kept & {i for i in range(300) if i % 4 == 0}) <= 3 and len(kept) >= 222


def test_columns_of_any_name(spark, tmp_path):
    """The stages that give documents keep columns whose names they use themselves, or that hold dots."""
    labels(spark, tmp_path)
    rows = [(i, passage(i % 5, 60), "en", i, f"x{i}", 7) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, _row int, `a.b` string, n int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "_row", "a.b", "n"]
    assert sorted((r.doc_id, r._row, r["a.b"], r.n) for r in docs.collect()) == [(i, i, f"x{i}", 7) for i in range(5)]


def test_empty(spark, tmp_path):
    labels(spark, tmp_path)
    empty_docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run(spark, tmp_path):
    """Every surviving row's words arrive in the sequences, once, whatever shares its id; what copies say goes."""
    common, own = passage(900, 40), [passage(i, 60) for i in range(30)]
    rows = [(i, own[i], "en", "s", 0) for i in range(30)]
    rows += [(100, own[3], "en", "s", 0), (101, own[4] + " end", "en", "s", 0), (102, common + " " + passage(77, 30), "en", "s", 0), (103, passage(78, 30) + " " + common, "en", "s", 0)]
    rows += [(200, "same text", "en", "s", 0), (201, "same text", "en", "s", 0), (201, "a unique text", "en", "s", 0), (None, "same text", None, None, None), (None, "only here", None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in got]
    assert sorted(i for i in ids if i is not None) == [*range(30), 102, 103, 200, 201] and ids.count(None) == 1
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    size = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
    lengths = {r.doc_id: r.length for r in got}
    assert all(lengths[i] == size(own[i]) for i in range(30)) and lengths[201] == size("a unique text") and lengths[None] == size("only here")
    assert lengths[102] == size(rows[32][1]) and lengths[103] == size(passage(78, 30))


def test_exact_copies_go_by_row(spark):
    rows = [(1, "a copied text"), (None, "a  copied text"), (None, "only here, without id"), (2, "a copied\ntext"), (2, "only here, with a shared id"), (3, "sent twice"), (3, "sent twice"), (None, "no ids at all"), (None, "no ids at all")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = corpus_pipeline.exact_copies(spark, docs, "").collect()
    want = [(1, "a copied text"), (None, "only here, without id"), (2, "only here, with a shared id"), (3, "sent twice"), (None, "no ids at all")]
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)
