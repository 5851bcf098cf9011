"""The registered queries without SQL, held against brute force over their whole tables, and the stages on odd rows."""

import collections
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import registry

FOLDER = "/root/testdata/sf0.001"


def test_pieces_of_all_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d in docs:
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2]
        cut = piece = 0
        while cut < len(ids):
            n = (len(ids) - cut) % 1024 or 1024
            want.append((d.doc_id, piece, cut, n, zlib.crc32(np.array(ids[cut : cut + n], "<u4").tobytes())))
            cut, piece = cut + n, piece + 1
    got = registry.op8_packing(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        ends = np.cumsum([n for _, n in sorted(items)])
        assert [o for o, _ in sorted(items)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024
    assert len(bins) <= 1.02 * sum(n for _, _, _, n, _ in want) / 1024 + 1


def test_taken_words_come_near_targets(spark):
    got = registry.op7_source_mixing(spark, FOLDER).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    taken, target = collections.Counter(), {}
    for r in got:
        assert r.taken % r.size == 0 and r.taken <= 2 * r.size if r.size else r.taken == 0
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)  # sources of ten documents


def test_fingerprints_tell_texts_apart(spark):
    got = {r.doc_id: r for r in registry.op6_order_minhash(spark, FOLDER).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    same = collections.defaultdict(set)
    for i, t in texts.items():
        same[t].add(got[i].fingerprint)
    assert all(len(s) == 1 for s in same.values()) and len({r.fingerprint for r in got.values()}) >= 0.95 * len(same)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    order = sorted(got, reverse=True)
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        assert (got[i].near_next == 1) == (got[i].fingerprint == got[j].fingerprint)
    long = [r for r in got.values() if r.n_chars > 500]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.1


def test_stages_take_odd_rows_and_names(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    text = docs.where("doc_id = 0").first().text
    odd = [(None, text, "en", None, 3), (0, text, "en", "a", 3), (900, None, None, "a", None), (901, "", "en", None, 0), (902, "word " * 200_000 + " " * 200_000, "en", "a", 1), (None, None, None, None, None)]
    odd = spark.createDataFrame(odd, docs.schema)
    names = ["__score", "score", "row", "gone", "__doc", "drops", "copies", "a.b"]
    seen = docs.unionByName(odd).withColumns({n: F.lit(k) for k, n in enumerate(names)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, FOLDER)
        assert out.columns == seen.columns, name
        seen = spark.createDataFrame(out.collect(), seen.schema)
        assert seen.count() > 100
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, FOLDER)
    rows = packed.select("length", F.octet_length("ids").alias("bytes"), "ids_crc32", F.crc32("ids").alias("crc")).collect()
    assert all(r.bytes == 4 * r.length and r.crc == r.ids_crc32 for r in rows)
