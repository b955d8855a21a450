import gc
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, packing, tokens
from quarry.llm.tokens import WordEncoder, default_path

ODD = ["", "İstanbul ΣΑΣ don't I'LL we've <|ENDOFTEXT|> <|endoftext|>x", "á ́b ée", "tab\there\x0bv\x0c f nb em　zz", "x" * 300 + " Ünï-côde 12,3 ½²x", " lead  double ", "ªµº ß ẞ ſ K", "1's .'re x'llama 3½'d \x1c\x85a\xa0b\x00c ÀÉ ''s", "it''s 'tis ’s 日本 語"]


def texts(rng, n):
    words = ["the", "The", "retion,", "of.", "eau", "étre", "don't", "x1y2", "(a)", "--", "élan", "Ø"] + ["".join(rng.choices("aeiourstnéß", k=rng.randint(1, 9))) for _ in range(300)]
    return [" ".join(rng.choices(words, k=int(rng.paretovariate(0.8)) % 6000)) for _ in range(n)]


def test_ids_are_the_tokenizers():
    encoder = WordEncoder(default_path())
    own = ODD + texts(random.Random(1), 50)
    expected = encoder.tokenizer.encode_batch(own, add_special_tokens=False)
    for got in (encoder.encode(own), encoder.encode(own)):
        assert got == [np.array(e.ids, "<u4").tobytes() for e in expected]


@pytest.mark.parametrize("seed", range(5))
def test_latin_1_is_cut_as_the_tokenizer_cuts(seed):
    rng = random.Random(seed)
    pieces = [*map(chr, range(256)), *"''''''", "'s", "'t", "'re", "'VE", "'m", "'ll", "'d", "''s", " ", "\n", "re", "l", "ll's", "1²", "\xa0'"]
    own = ["".join(rng.choices(pieces, k=rng.randint(0, 60))).replace("<|", "<") for _ in range(400)]
    encoder = WordEncoder(default_path())
    assert encoder.encode(own) == [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in own]


def test_plain_texts_are_not_normalised_and_cut_a_second_time():
    """That took more of the CPU than the merges: new pre-tokens go to the model, and known ones nowhere."""
    own = ["Étre l'été, don't 3½", *texts(random.Random(3), 20)]
    encoder, model = WordEncoder(default_path()), []
    expected = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(own, add_special_tokens=False)]
    tokenizer, encoder.tokenizer = encoder.tokenizer, None
    encoder.model = type("Spy", (), {"tokenize": lambda _, w: model.append(w) or tokenizer.model.tokenize(w)})()
    assert encoder.encode(own) == expected and len(model) == len(set(model))
    assert encoder.encode(own) == expected and len(model) == len(set(model))


def test_known_pre_tokens_are_bounded_and_small(monkeypatch):
    """Ids stay right when strings are forgotten, and what is kept takes few bytes for each."""
    rng = random.Random(4)
    words = ["".join(rng.choices("aeioustrnlmk", k=9)) for _ in range(60_000)]
    encoder = WordEncoder(default_path())
    tracemalloc.start()
    first = encoder.encode([" ".join(words)])
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] - sum(map(len, first)) + pa.total_allocated_bytes()
    tracemalloc.stop()
    assert held < 100 * len(words)
    monkeypatch.setattr(tokens, "CACHE", 1000)
    for i in range(0, 20_000, 400):
        some = words[i : i + 400] + rng.choices(words[: i + 1], k=300) + ["x" * 100 + str(i)]
        assert encoder.encode([" ".join(some)]) == [np.array(encoder.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4").tobytes()]
        assert len(encoder.pre_tokens.strings) <= 1000 and max(map(len, encoder.pre_tokens.strings.to_pylist())) <= 64


def test_arrow_batches_are_bounded_by_bytes(spark):
    docs = spark.range(3000).select(F.repeat(F.lit("word "), 1000).alias("text")).coalesce(1)
    name, sizes = "spark.sql.execution.arrow.maxBytesPerBatch", lambda batches: (pa.RecordBatch.from_pydict({"bytes": [b.nbytes]}) for b in batches)
    before = spark.conf.get(name, None)
    with common.arrow_batches(spark, 1 << 20):
        found = [r.bytes for r in docs.mapInArrow(sizes, "bytes long").collect()]
    assert max(found) < 2 << 20 and sum(found) > 15_000_000 and spark.conf.get(name, None) == before


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    encoder = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    own = [*ODD, "The quick brown fox.\n\n  Jumps"]
    assert not encoder.by_words and WordEncoder(default_path()).by_words
    assert encoder.encode(own) == [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in own]


@pytest.mark.parametrize("seed", range(30))
def test_runs_are_no_worse_than_plain_best_fit(seed):
    rng = random.Random(100 + seed)
    capacity = rng.choice([7, 64, 2048])
    sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 300))), reverse=True)
    gaps: list[int] = []
    for x in sizes:
        fits = [g for g in gaps if g >= x]
        gaps.append(capacity - x) if not fits else gaps.__setitem__(gaps.index(min(fits)), min(fits) - x)
    counts = {x: sizes.count(x) for x in sizes}
    assert packing.match(counts, capacity)[1] <= len(gaps)


@pytest.mark.parametrize("seed", range(30))
def test_runs_place_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 7, 64, 2048])
    counts = {length: rng.choice([1, 2, 50, 10**6]) for length in rng.sample(range(1, capacity + 1), min(capacity, rng.randint(1, 40)))}
    placed, bins = packing.match(counts, capacity)
    for length, n in counts.items():
        own = sorted(p for p in placed if p.length == length)
        assert [p.first for p in own] == [sum(q.count for q in own[:i]) for i in range(len(own))] and sum(p.count for p in own) == n
    # Over stretches of bins: what is in a bin is gapless and within the capacity.
    edges = sorted({0, bins, *(p.bin for p in placed), *(p.bin + p.count // p.each for p in placed)})
    for a in edges[:-1]:
        inside = sorted((p.offset, p.length * p.each) for p in placed if p.bin <= a < p.bin + p.count // p.each)
        assert [o for o, _ in inside] == [sum(s for _, s in inside[:i]) for i in range(len(inside))]
        assert 0 < sum(s for _, s in inside) <= capacity
    assert bins >= -(-sum(k * n for k, n in counts.items()) // capacity)


def test_pack(spark):
    own = texts(random.Random(2), 200)
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    rows = packing.pack(docs.repartition(5), capacity=64).collect()
    encoder = WordEncoder.of(default_path())
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == list(range(200))
    for i, ids in enumerate(encoder.encode(own)):
        ids += bytes(4)
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in pieces] == list(range(0, len(ids) // 4, 64)) and [r.piece for r in pieces] == list(range(len(pieces)))
        assert all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in pieces) and sum(r.length for r in pieces) == len(ids) // 4
    for own_rows in by_bin.values():
        at = 0
        for r in sorted(own_rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len(by_bin) <= -(-sum(r.length for r in rows) // 64) * 1.02 + 1
