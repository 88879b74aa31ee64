import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from prosaic.llm import decontaminate
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_exact_dedup import norm
from tests.llm.test_jaccard import brute as brute_links


def check_pieces(pieces, docs):
    """Every document's tokens once, in sequences without gaps."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for key, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(str(key), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == sorted(want)
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 1024


def test_odd_and_empty_tables(spark, odd, empty, sf_dir, tmp_path):
    for n, docs in enumerate((odd, empty)):
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, sf_dir)
            assert out.columns == docs.columns
            out.write.parquet(f"file://{tmp_path}/{n}-{name}")
            now = spark.read.parquet(f"file://{tmp_path}/{n}-{name}")
        rows = [(r.doc_id, r.text) for r in now.select("doc_id", "text").collect()]
        # 2 equals 1, 8 is a near copy of 7, and 12 has the words of 11; nulls, empty and letterless texts aren't in a language
        assert sorted(k for k, _ in rows) == ([] if n else [1, 6, 7, 10, 11])
        check_pieces(corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).collect(), rows)


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in now.select("doc_id", "text").collect()]
        out = stage(spark, now, sf_dir)
        if name == "best_fit_packing":
            check_pieces(out.collect(), before)
            break
        assert out.columns == docs.columns
        out.write.mode("overwrite").parquet(f"/tmp/checkpoints/test-pipeline/{name}")
        now = spark.read.parquet(f"/tmp/checkpoints/test-pipeline/{name}")
        after = sorted(r.doc_id for r in now.select("doc_id").collect())
        if name == "language_id":
            assert after == sorted(k for k, t in before if any(c.isalpha() for c in t or ""))
        elif name == "exact_dedup":
            first = {}
            for k, t in sorted(before):
                first.setdefault(norm(t), k)
            assert after == sorted(first.values())
        elif name == "ngram_jaccard_join":
            assert after == sorted({c for c, _ in brute_links(before).values()})
        else:
            assert after == sorted(r[0] for r in brute_hits(before, bench) if not r[-1])
    assert decontaminate.WINDOW == 13


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    made = out.toPandas()
    assert len(made) and made.groupby("sequence_id")["length"].sum().max() <= 1024
