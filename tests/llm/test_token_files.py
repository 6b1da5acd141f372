"""Token files: round trip against the tokenizer itself."""

import random
import zlib

import numpy as np
import pytest

from bellwether.llm import token_files
from bellwether.llm.queries import tokenizer_path
from bellwether.llm.scratch import new_path
from bellwether.llm.token_files import checksums, positions, write_tokens


@pytest.fixture(scope="module")
def path():
    return tokenizer_path("word_bpe_49k.json")


def texts():
    rng = random.Random(1)
    rows = [None, "", " ", "Hello's WORLD", "a<|endoftext|>b <|STARTOFTEXT|>", "naïve café é ß Σας ΣΑΣ", "\x0b\x0c\r\n x\ty"]
    rows += ["non breaking space line", "日本語 emoji 😀😀 1234", "don't can't 'll ''s"]
    rows += [" ".join(rng.choice(("alpha", "Beta!", "12.5", "qux,")) for _ in range(rng.randrange(1, 300))) for _ in range(30)]
    pieces = ["Été", "ÀÖØß", "ÿ", "naïve", "x", "IBM", "don't", "it's.", "co-op", "e\u0301t", "ŀ", "İx", "1a", "a1", "...", "!?", "'", "word'", "-a-"]
    signs = ["", ".", ",", "!)", "_", "`~", "@#", "'", "--", "…", "«"]
    rows += [" ".join(rng.choice(pieces) + rng.choice(signs) for _ in range(200)) for _ in range(20)]
    return rows


@pytest.mark.parametrize("held", [400_000, 5])
def test_round_trip(spark, monkeypatch, path, held):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "WORDS_HELD", held)
    rows = [(3 * i - 10, t, "x") for i, t in enumerate(texts())] + [(None, "null id", "x"), (2, "same", "x"), (2, "same", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(4)
    folder = new_path(spark, "tokens")
    write_tokens(docs, folder, path)
    files = token_files.token_files(spark, folder)
    got = sorted((tuple(r) for r in checksums(files).collect()), key=lambda r: r[1])
    tokenizer = Tokenizer.from_file(path)
    start, found = 0, {}
    for _, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        found[text] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    by_id = {}
    for i, t, _ in rows:
        by_id.setdefault(i, []).append(found[t])
    for doc_id, at, n, crc in got:
        assert at == start and (n, crc) in by_id[doc_id]
        start += n
    one = files.filter("doc_id = -1").select("ids").collect()
    assert list(one[0].ids)[-1] == 1
    assert positions(files).agg({"offset": "min"}).first()[0] == 0


def test_empty(spark, path):
    folder = new_path(spark, "tokens")
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), folder, path)
    assert checksums(token_files.token_files(spark, folder)).collect() == []
