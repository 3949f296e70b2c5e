"""Problems 8 to 10: an independent tokenizer, the rules of packing, held-out accuracy."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from merloom.llm import language, packing, tokens

DATA = Path("/root/testdata/sf0.001")
needs_vocabulary = pytest.mark.skipif(not Path(tokens.VOCABULARY).exists(), reason="no tokenizer files here")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
TEXTS = ["", None, " ", "Hello world", " a   b  \n\n c\t d  ", "don't we'll  'S\n 's", "a" * 3000, "\U0001f600\U0001f600 é̂ naïve", "x y\xa0 z", "1234567890 " * 50, "\r\n\r\nA\n B \n", "The cat  sat.The cat  sat."]


@needs_vocabulary
def test_tokens_equal_another_implementation(spark):
    hf = pytest.importorskip("tokenizers").Tokenizer.from_file(tokens.VOCABULARY)
    hf.encode_special_tokens = True
    rng = random.Random(1)
    noise = ["".join(rng.choice("abc ABC\n\t.,;'é1ñ ") for _ in range(rng.randrange(200))) for _ in range(200)]
    texts = [*TEXTS, *noise]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["id"]: r["ids"] for r in tokens.token_ids(df).collect()}
    assert got == {i: hf.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    counts = {r["id"]: r["tokens"] for r in tokens.token_counts(df).collect()}
    assert counts == {i: len(x) for i, x in got.items()}


@needs_vocabulary
def test_verified_words_are_merged_words():
    """What passes the pair tests is what exact merging gives; the cache may be emptied between batches."""
    encoder = tokens.Encoder(*tokens.load_vocabulary())
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 12))) for _ in range(2000)})
    unit, _, count = encoder.encode(words)
    ids = np.split(encoder.ids(unit), np.cumsum(count)[:-1])
    assert 0 < encoder.failed < len(words)
    assert [x.tolist() for x in ids] == [encoder.merged(w.encode()) for w in words]
    encoder.forget()
    unit, _, count = encoder.encode(words[:5])
    assert encoder.ids(unit).tolist() == np.concatenate(ids[:5]).tolist()


def test_packing(spark):
    rng = random.Random(1)
    sizes = {i: rng.choice([0, 1, 7, 30, 60, 99, 100, 101, 250, 1000]) for i in range(3000)}
    items = spark.createDataFrame(list(sizes.items()), "id bigint, tokens bigint").repartition(3)
    requests = spark.createDataFrame([(1, 100), (2, 1024), (2, 1024), (3, None), (4, 0)], "request_id int, amount bigint")
    got = packing.pack(items, requests).collect()
    for request, capacity in ((1, 100), (2, 1024)):
        rows = [r for r in got if r["request_id"] == request]
        used, pieces = {}, {}
        for r in rows:
            used[r["container"]] = used.get(r["container"], 0) + r["tokens"]
            pieces.setdefault(r["id"], []).append((r["piece_no"], r["piece_start"], r["tokens"]))
        assert max(used.values()) <= capacity
        assert {i: sum(p[2] for p in x) for i, x in pieces.items()} == sizes
        assert all(len(x) == 1 for i, x in pieces.items() if sizes[i] <= capacity)
        assert all([p[1] for p in sorted(x)] == [k * capacity for k in range(len(x))] for x in pieces.values())
        assert len(used) <= 1.05 * sum(sizes.values()) / capacity + 3
    assert {r["request_id"] for r in got} == {1, 2}
    assert packing.pack(items.limit(0), requests).count() == 0


def test_blocks_and_letters():
    text = "\n \t\nab\ncd\r\n\n\nÉé1\n \r\nx"
    data = np.frombuffer(text.encode(), np.uint8)
    row, start, end = language._blocks(data, np.array([0, len(data)]))
    assert [bytes(data[a:b]).decode().strip() for a, b in zip(start, end, strict=True)] == ["ab\ncd", "Éé1", "x"]
    sums = language._letter_sums(data)
    assert (sums[end] - sums[start]).tolist() == [4, 2, 1]
    assert language._classes(np.frombuffer("É".encode(), np.uint8)).tolist() == language._classes(np.frombuffer("é".encode(), np.uint8)).tolist()


def test_blocks_end_with_their_text():
    data = np.frombuffer(b"ab\ncd", np.uint8)
    row, start, _ = language._blocks(data, np.array([0, 2, 2, 5]))
    assert row.tolist() == [0, 2] and start.tolist() == [0, 3]


@needs_data
def test_languages(spark):
    """Held-out accuracy: documents that were not drawn for training, against their labels where they have one."""
    documents = spark.read.parquet(str(DATA.parent / "sf0.01" / "documents.parquet"))
    samples = spark.read.parquet(str(DATA / "lang_samples.parquet"))
    net = language.fitted(documents, samples, most=500)
    drawn = documents.where("lang is not null").orderBy(F.xxhash64("doc_id")).limit(700)
    held_out = documents.join(drawn.select("doc_id"), "doc_id", "left_anti")
    said = language.languages(held_out, net).where("block_no = 0 and text_letters >= 200").collect()
    known = [r for r in said if r["label"] in language.LANGUAGES]
    assert sum(r["lang"] == r["label"] for r in known) >= 0.85 * len(known)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, " \n\t", "x"), (4, "12 34", "")], "doc_id bigint, text string, lang string")
    got = [(r["id"], r["block_no"], r["lang"], r["confidence"]) for r in language.languages(odd, net).orderBy("id", "block_no").collect()]
    assert got == [(1, 0, "und", 0.0), (2, 0, "und", 0.0), (3, 0, "und", 0.0), (4, 0, "und", 0.0), (4, 1, "und", 0.0)]
    assert language.label_errors(odd, net).count() == 0


def test_gradient_direction():
    """A few steps of training tell two made-up alphabets apart."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    x = rng.integers(4, 17, (400, language.WINDOW)).astype(np.uint8) + (13 * y[:, None]).astype(np.uint8)
    net = language.train(x, y, epochs=3)
    assert (net.log_probabilities(x).argmax(1) == y).mean() > 0.98
