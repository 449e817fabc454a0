"""The pipeline's stages against plain versions of what each must keep."""

import hashlib
import struct

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as P
from test_decontaminate import plain as plain_leaks
from test_line_dedup import plain as plain_lines
from test_simhash import plain_components, plain_fingerprint
from tickframe.llm import resample
from tickframe.llm.common import read, staged

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    assert P.COLUMNS == columns and len(P.STAGES) == 5 and P.ORACLE_SQL is None
    stages = [docs]
    for _, stage in P.STAGES:
        stages.append(staged(stage(spark, stages[-1], SF), "t"))
    assert all(s.columns == columns and s.dtypes == docs.dtypes for s in stages[:-1])
    rows = [{r.doc_id: r for r in s.collect()} for s in stages]
    assert all(len(r) == s.count() for r, s in zip(rows, stages))

    chosen = {r.doc_id for r in resample.resample(docs, read(spark, SF, "labels")).collect() if r.selected}
    assert set(rows[1]) == chosen and all(rows[1][d] == rows[0][d] for d in chosen)

    want = {d: sha for d, _, _, sha in plain_lines([(d, r.text) for d, r in rows[1].items()])}
    assert {d: hashlib.sha256(r.text.encode()).hexdigest() for d, r in rows[2].items()} == want
    assert all(r.n_chars == len(r.text) for r in rows[2].values())

    groups = plain_components([(d, plain_fingerprint(r.text)) for d, r in rows[2].items()])
    assert set(rows[3]) == {d for d, _, c in groups if d == c}

    leaks = {d for d, _, _ in plain_leaks([(d, r.text) for d, r in rows[3].items()], [tuple(r) for r in read(spark, SF, "benchmark").collect()])}
    assert set(rows[4]) == set(rows[3]) - leaks

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(rows[5]) == set(rows[4])
    for d, r in rows[5].items():
        ids = lib.encode(rows[4][d].text, add_special_tokens=False).ids
        assert bytes(r.token_ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(rows[4][d].text.encode()).hexdigest()
    run = {r.doc_id: r for r in E.queries()["pipeline"](spark, SF).collect()}
    assert run == rows[5]


def test_edge_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "text without id", "en", "s", 15), (4, "long text " * 50_000, "en", None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        docs = df.limit(0) if empty else df
        for _, stage in P.STAGES:
            docs = staged(stage(spark, docs, SF), "t")
        assert (docs.count() == 0) == empty
