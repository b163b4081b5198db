"""The pipeline against plain versions of its stages."""

from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from test_operators import brute_components, brute_hits, brute_print, same

import corpus_pipeline
from senseloom.llm import pii, quality, queries


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.cache()]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], sf).cache())
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, sf, stages):
    docs, good, single, clean, redacted, packed = stages
    assert all(s.columns == docs.columns for s in stages[:-1])
    all_docs, kept = rows(docs), rows(good)
    model = quality.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"), ~quality.held_out())
    scores = {d: model.score([r.text])[0] for d, r in all_docs.items()}
    assert {d for d in scores if scores[d] >= 0.5} ^ set(kept) <= {d for d in scores if abs(scores[d] - 0.5) < 1e-4}, {d: scores[d] for d in {d for d in scores if scores[d] >= 0.5} ^ set(kept)}

    prints = {d: brute_print(r.text) for d, r in kept.items()}
    ids = sorted(prints)
    part = brute_components(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    one = rows(single)
    assert set(one) == {d for d in ids if part[d] == d} and all(one[d] == kept[d] for d in one)

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {x[0] for x in brute_hits([(d, r.text) for d, r in one.items()], bench) if x[-1]}
    free = rows(clean)
    assert hit and set(free) == set(one) - hit

    spans = {r.doc_id: r.spans for r in pii.find(clean)[0].collect()}
    want = {}
    for d, r in free.items():
        out, at = "", 0
        for s in sorted(spans[d], key=lambda s: (s.s, s.e)):
            if s.s >= at:
                out += r.text[at : s.s] + f"[{pii.KINDS[s.kind].upper()}]"
            at = max(at, s.e)
        want[d] = out + r.text[at:]
    got = rows(redacted)
    assert {d: r.text for d, r in got.items()} == want and all(len(r.text) == r.n_chars for d, r in got.items() if spans[d])

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    pieces = []
    for d, text in want.items():
        x = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        cut = [0, *range(len(x) % 1024 or 1024, len(x) + 1, 1024)]
        pieces += [(d, k, a, b - a, crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed.collect()], pieces)
    same([(r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect()], [(p[0], p[1], p[4]) for p in pieces])


def test_odd_rows(spark, sf):
    docs = spark.createDataFrame([(1, "twice the same text", "en", "a", 5), (1, "twice the same text", "en", "a", 5), (2, None, None, None, None), (None, "", "en", "a", 0), (None, "no id", "en", "a", 1), (3, "", "fr", "b", 0)], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 score", "2 component", "3 cands", "4 spans", "5 rid")
    for df in (docs, docs.limit(0)):
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, df, sf)
            n = out.count()
            assert n <= df.count() or name == "packing"
            if name != "packing":
                assert out.columns == df.columns
                by = defaultdict(int)
                for r in out.collect():
                    by[r.doc_id] += 1
                if name == "near_duplicates" and n:
                    assert by == {1: 1, 2: 1, None: 2}
