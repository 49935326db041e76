import hashlib
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from kestrel.llm import mixing, quality
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_rows_match_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.id for r in quality.scored(docs, labels).filter("predicted = 1").collect()}
    rows = [r for r in docs.orderBy("doc_id").collect() if r.doc_id in good]
    seen, unique = set(), []
    for r in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        if norm not in seen:
            seen.add(norm)
            unique.append(r)
    fps = {r.doc_id: plain_fingerprint(r.text) for r in unique}
    component, kept, met = plain_components(fps.values()), [], set()
    for r in unique:  # ascending ids: the first of a component stays
        if component[fps[r.doc_id]] not in met:
            met.add(component[fps[r.doc_id]])
            kept.append(r)
    copies = {r.id: r.copies for r in mixing.mix(spark.createDataFrame(kept, docs.schema), [3, 1, 2]).collect()}
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in kept:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want += [(r.doc_id, len(ids), *digests)] * copies[r.doc_id]
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert 0 < len(kept) <= len(unique) <= len(rows) < docs.count() and got == sorted(want)


def test_stages_keep_the_columns_of_documents(spark):
    assert [name for name, _ in corpus_pipeline.STAGES][:2] == ["quality classifier", "exact dedup"] and len(corpus_pipeline.STAGES) == 5
    empty = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, empty, SF)
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0
