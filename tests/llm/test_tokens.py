import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from geoloom.llm.packing import best_fit_decreasing, fill_report, pack  # noqa: E402
from geoloom.llm.pretokens import split  # noqa: E402
from geoloom.llm.tokenise import _assemble, decode_corpus, encode_corpus, token_counts  # noqa: E402

ALPHABET = "ab'stredvlmS  \n\t\r 12.,-!é한字²٣  \u0085 😀\"_"


def test_split_against_the_pattern():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30))) for _ in range(5000)]
    texts[3], texts[4], texts[5] = None, "", "'ll've'S 's"
    words, offsets = split(pa.array(texts))
    words = [w.decode() for w in words.to_pylist()]
    pattern = regex.compile(public_tokenizers.PATTERN)
    for i, t in enumerate(texts):
        assert words[offsets[i] : offsets[i + 1]] == pattern.findall(t or "")
    sliced, cut = split(pa.array(texts).slice(5, 2))
    assert [w.decode() for w in sliced.to_pylist()[: cut[1]]] == pattern.findall(texts[5])


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(1, 200)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "<|endoftext|> text"), (503, "long " * 60_000), (504, "x" * 3000), (7, rows[7][1]), (None, "no id")]
    return spark.createDataFrame([(*r, "kept", 1) for r in rows], "doc_id long, text string, ids string, word int").repartition(3)


@pytest.mark.parametrize("block_bytes", [500, 8 << 20])
def test_encode_decode(docs, block_bytes):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    fixed = docs.sparkSession.createDataFrame(docs.collect(), docs.schema)
    encoded = encode_corpus(fixed, block_bytes=block_bytes)
    want = sorted((str(r.doc_id), t.encode(r.text or "", add_special_tokens=False).ids) for r in fixed.collect())
    assert sorted((str(r.doc_id), list(r.ids)) for r in encoded.collect()) == want
    back = sorted((str(r.doc_id), r.text) for r in decode_corpus(encoded).collect())
    assert back == sorted((str(r.doc_id), r.text or "") for r in fixed.collect())
    counts = sorted((str(r.doc_id), r.n_tokens) for r in token_counts(fixed, block_bytes=block_bytes).collect())
    assert counts == sorted((i, len(x)) for i, x in want)


def test_differing_passes_fail():
    words = pa.table({"block": [1], "check": [5], "word_no": [np.int32([0]).tobytes()], "sizes": [np.int32([1]).tobytes()], "ids": [np.int32([9]).tobytes()]})
    docs = pa.table({"block": [1], "check": [5], "doc_id": [3], "positions": [np.int32([0, 0]).tobytes()]})
    assert _assemble(words, docs).to_pylist() == [{"doc_id": 3, "ids": [9, 9]}]
    with pytest.raises(ValueError, match="different rows"):
        _assemble(words, docs.set_column(1, "check", pa.array([6])))


def test_encode_nothing(docs):
    assert encode_corpus(docs.limit(0)).count() == 0 and decode_corpus(encode_corpus(docs.limit(0))).count() == 0


def plain_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= s]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


def test_runs_are_best_fit_decreasing():
    rnd = random.Random(3)
    for _ in range(60):
        capacity = rnd.choice([1, 7, 64, 512])
        sizes = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 300))]
        runs, bins = best_fit_decreasing({s: sizes.count(s) for s in set(sizes)}, capacity)
        used, placed = np.zeros(bins, int), 0
        for size, lo, hi, first, each in runs:
            for k in range(hi - lo):
                used[first + k // each] += size
            placed += hi - lo
        assert placed == len(sizes) and sorted(capacity - used) == plain_best_fit(sizes, capacity)


def test_pack(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([3, 17, 100, 511, 512])) for i in range(900)] + [(1000, 0), (1001, None), (1002, 1300), (1002, 1300), (1003, 1024), (None, 5)]
    items = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, n_tokens int, bin int")
    kinds = spark.createDataFrame([("a", 512), ("b", 2048), ("b", 2048), ("bad", 0), (None, 5), ("worse", None)], "container string, capacity int")
    packed = pack(items, kinds)
    per = packed.groupBy("container", "capacity", "bin").agg(F.sum("size").alias("s"))
    assert per.where("s > capacity").count() == 0
    assert {r[0] for r in packed.select("container").distinct().collect()} == {"a", "b"}
    sums = {(r.container, r.doc_id): (r.s, r.n) for r in packed.groupBy("container", "doc_id").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
    assert sums["a", 1000] == sums["a", 1001] == (0, 1)
    assert sums["a", 1002] == (2600, 6) and sums["a", 1003] == (1024, 2) and sums["b", 1003] == (1024, 1)
    assert sums["a", None] == (5, 1) and len([k for k in sums if k[0] == "b"]) == len({r[0] for r in rows})
    report = {r.container: r for r in fill_report(packed).collect()}
    sizes = [s or 0 for _, s in rows]
    pieces = [p for s in sizes for p in [512] * (s // 512) + [s % 512] * (s % 512 > 0)]
    assert report["a"].bins == len(plain_best_fit(pieces, 512)) and report["a"].used == sum(sizes)
    assert pack(items.limit(0), kinds).count() == 0 and pack(items, kinds.limit(0)).count() == 0


def test_huge_capacity(spark):
    items = spark.createDataFrame([(k, 400_000_000 + k) for k in range(7)], "doc_id long, n_tokens long")
    packed = pack(items, spark.createDataFrame([("vast", 1_000_000_000)], "container string, capacity int"))
    assert sorted(r.n for r in packed.groupBy("bin").agg(F.count("*").alias("n")).collect()) == [1, 2, 2, 2]


def test_pack_takes_all_kinds_or_raises(spark):
    kinds = spark.range(10_002).select(F.col("id").cast("string").alias("container"), F.lit(7).alias("capacity"))
    with pytest.raises(ValueError, match="kinds"):
        pack(spark.createDataFrame([(1, 5)], "doc_id long, n_tokens long"), kinds)
