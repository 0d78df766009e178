"""The pipeline against the same stages by brute force, and the registered queries."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from colloquy.llm import bpe, catalog, language_id, mixing
from test_ngram_join import components_by_hand
from test_mixing import targets_by_steps


def by_hand(docs):
    """Rows that reach the mix, with their words, by plain Python on collected rows."""
    kept = language_id.identified(docs).select("doc_id", "text", "source").collect()
    newest = {}
    for r in kept:
        if r.text not in newest or (r.doc_id or -1) > (newest[r.text].doc_id or -1):
            newest[r.text] = r
    rows = list(newest.values())
    leaders = {least for _, n, least in components_by_hand([(r.doc_id, r.text) for r in rows])}
    return [r for r in rows if r.doc_id in leaders]


def test_run_against_brute_force(spark, sf_dir, documents):
    rows = by_hand(documents)
    ranks = bpe.load_ranks(open(public_tokenizers.path(corpus_pipeline.RANKS), "rb").read())
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for r in rows:
        ids = encoding.encode_ordinary(r.text)
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256(r.text.encode()).hexdigest())
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(r.text.split())
    target, taken, times = targets_by_steps(dict(sizes)), Counter(), Counter()
    size = {r.doc_id: (r.source, len(r.text.split())) for r in rows}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        assert tuple(r)[1:] == want[r.doc_id]
        times[r.doc_id] += 1
        taken[size[r.doc_id][0]] += size[r.doc_id][1]
    largest = max(n for _, n in size.values())
    assert max(times.values()) <= mixing.CAP
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in target)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_any_rows(spark, sf_dir, odd, clashing, no_docs, name, stage):
    for docs in (odd, clashing, no_docs):
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        if name != "byte_bpe":
            assert out.columns == docs.columns
            assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
        else:
            assert len(rows) == docs.count()


def test_registration():
    names = entry.queries()
    assert set(catalog.QUERIES) <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES if n.startswith("op")) == list(range(1, 11))
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
