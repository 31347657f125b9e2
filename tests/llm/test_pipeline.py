"""The pipeline against its stages' decisions, taken one by one in plain Python on each stage's own input."""

import public_tokenizers
import sentencepiece

import corpus_pipeline as cp
from millrace.llm import quality_lm, toxicity
from millrace.llm.queries import PIECES
from millrace.llm.runtime import table
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_decontaminate import words
from tests.llm.test_near_dedup import brute as groups

SF = "/root/testdata/sf0.001"


def test_each_stage_acts_on_what_its_predecessor_kept(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        before = {r.doc_id: r.text for r in docs.collect()}
        kept = {r.doc_id for r in out.collect()}
        if name == "quality":
            gone = {r.doc_id for r in quality_lm.classify(docs, labels).collect() if r.rejected}
            assert gone
        elif name == "toxicity":
            gone = {r.doc_id for r in toxicity.score_documents(docs, toxicity.train(docs, labels)).collect() if r.score >= 0.5}
        elif name == "near_dedup":
            gone = {i for i, _, _, first in groups(list(before.items())) if not first}
        else:
            bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
            long = [b for b in bench if len(words(b[1])) >= 13]
            gone = {r[0] for r in contaminated(list(before.items()), bench) if r[-1]} | {r[0] for r in contaminated(list(before.items()), long) if r[2]}
        assert kept == set(before) - gone, name
        docs = spark.createDataFrame(sorted(out.collect()), docs.schema)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    want = {r.doc_id: len(library.encode(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in cp.run(spark, SF).collect()} == want


SCHEMAS = {"documents": "doc_id long, text string, lang string, source string, n_chars long, _rejected_id long, _gone string, _id int, _hash long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}


def tables(spark, folder, **rows):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(rows.get(name, []), schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_odd_rows_and_clashing_columns(spark, tmp_path, prose):
    doc = lambda i, text, lang="en": (i, text, lang, None, 0, 1, "x", 2, 3)
    passage, junk = prose(15, 77), "#$%&*!|@^~" * 40
    docs = [doc(i, f"{prose(60, i)} {'you IDIOT' if i % 4 == 1 else 'friend'} {prose(30, i + 500)}") for i in range(200)]
    docs += [doc(1000, prose(80, 3000)), doc(1001, prose(80, 3000)), doc(1001, prose(80, 3000)), doc(None, prose(80, 3001)), doc(None, None), doc(1002, None, None), doc(1003, "  "), doc(1004, f"{prose(900, 3002)} {passage} {prose(900, 3003)}"), doc(1005, prose(20000, 3004)), doc(1006, junk), doc(1006, junk)]
    labels = [(i, 1, int(i % 4 == 1)) for i in range(200)] + [(1006, 0, 0), (None, 1, None), (77777, 0, 1)]
    folder = tables(spark, tmp_path, documents=docs, labels=labels, benchmark=[(1, passage), (2, None), (None, "one")])
    got = sorted((r.doc_id for r in cp.run(spark, folder).collect()), key=repr)
    odd = [i for i in got if i is None or i >= 1000]
    assert sorted(odd, key=repr) == sorted([1000, None, None, 1002, 1003, 1005], key=repr)
    kept = [i for i in got if i is not None and i < 1000]
    assert len(kept) == len(set(kept)) and sum(i % 4 == 1 for i in kept) <= 2 and sum(i % 4 != 1 for i in kept) >= 140
    first = cp.STAGES[0][1](spark, table(spark, folder, "documents"), folder)
    assert first.columns == table(spark, folder, "documents").columns


def test_empty_tables(spark, tmp_path, prose):
    assert cp.run(spark, tables(spark, tmp_path / "none")).count() == 0
    folder = tables(spark, tmp_path / "docs", documents=[(1, prose(20, 1), "en", None, 0, 1, "x", 2, 3), (2, prose(20, 2), "fr", None, 0, 1, "x", 2, 3)])
    assert {r.doc_id for r in cp.run(spark, folder).collect()} == {1, 2}
