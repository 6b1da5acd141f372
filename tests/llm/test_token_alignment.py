"""Cross-tokenizer alignment against brute force on whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from bellwether.llm import token_alignment
from bellwether.llm.cross_tokens import Pair
from bellwether.llm.queries import QUERIES, tokenizer_path
from bellwether.llm.token_alignment import aligned_documents, packed, pair_counts, scores, unpacked


@pytest.fixture(scope="module")
def paths():
    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def letters():
    """The byte of every letter of a byte-level vocabulary, in the order of its rule."""
    order = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in order]
    return {chr(b): b for b in order} | {chr(256 + n): b for n, b in enumerate(rest)}


def brute(rows, paths):
    """The contract's rows by whole texts, dictionaries and loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(paths[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    table = letters()
    docs, counts = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            a = first.encode(" " + text, add_special_tokens=False).ids
            b = second.encode(text)
            spelt_a = [bytes(table[x] for x in first.id_to_token(i)) for i in a]
            spelt_b = []
            for i in b:
                piece = second.id_to_piece(i)
                spelt_b.append(bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode())
            whole = (" " + text).encode()
            if b"".join(spelt_a) == whole == b"".join(spelt_b):
                ends_a = np.cumsum([len(x) for x in spelt_a]).tolist()
                ends_b = np.cumsum([len(x) for x in spelt_b]).tolist()
                low_a = low_b = 0
                for cut in sorted(set(ends_a) & set(ends_b)):
                    high_a, high_b = ends_a.index(cut) + 1, ends_b.index(cut) + 1
                    groups.append((a[low_a:high_a], b[low_b:high_b]))
                    low_a, low_b = high_a, high_b
        links = [(x, y) for own_a, own_b in groups for x in own_a for y in own_b]
        counts.update(set(links))
        docs.append((doc_id, groups, links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, groups, links in docs:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (
                doc_id,
                sum(len(x) for x, _ in groups),
                sum(len(y) for _, y in groups),
                len(groups),
                len(links),
                sum(counts[p] == most[p[0]] for p in links),
                sum(counts[p] for p in links),
                hashlib.sha256(shown.encode()).hexdigest() if groups else "",
            )
        )
    return out, counts, Counter(p for _, _, links in docs for p in links)


def texts():
    rng = random.Random(3)
    rows = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  ", "a  b", "a \n b", "a\n", "a  b", "x\x1c y", "x   y  \t z "]
    rows += ["<|endoftext|>", "a <|endoftext|> b<s> </s><unk>", "one▁two three", "▁", "naïve café 日本語 😀😀 x", "\u0000 a\u0000"]
    rows += ["don't can't 'll 12345 67,890.5 ...", "é ‍​ ﻿", "tab\tand\r\nline  two   three    four", "<0x41> A"]
    words = ["the", "The", "and,", "tokenizer", "unbelievable", "12", "3.14", "étude", "x=y", "\n", "foo\nbar", "", "ß", "😀"]
    rows += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    rows += ["the cat " * 700, "z" * 5000, "long " * 20_000]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, "x", 1) for i, t in rows], "doc_id long, text string, pair string, documents int"
    )


def result(found):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    out = []
    for r in found.select(*names).collect():
        out.append((*tuple(r)[:-1], hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else r.groups))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_equal_to_brute_force(spark, monkeypatch, paths, small):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "the cat sat"), (3, "the cat sat"), (3, "the cat sat")]
    if small:
        monkeypatch.setattr(token_alignment, "SLICE", 50)
    documents, index = aligned_documents(frame(spark, rows).repartition(3), *paths)
    counts = pair_counts(index)
    wanted, per_pair, links = brute(rows, paths)
    assert result(scores(documents, index, counts)) == sorted(wanted, key=str)
    got = {(r.a, r.b): (r.documents, r.links) for r in counts.collect()}
    assert got == {p: (n, links[p]) for p, n in per_pair.items()}


def test_shards_of_few_rows(paths):
    import pyarrow as pa

    rows = [t for t in texts() if t is None or len(t) < 5000]
    batch = pa.record_batch([pa.array(range(len(rows))), pa.array(rows)], ["doc_id", "text"])
    whole = token_alignment._shard(Pair.of(*paths), batch["doc_id"], batch["text"])
    split = [token_alignment._shard(Pair.of(*paths), b["doc_id"], b["text"]) for b in (batch.slice(0, 9), batch.slice(9))]
    for column in range(6):
        assert whole[0][column].to_pylist() == [x for part in split for x in part[0][column].to_pylist()]


@pytest.mark.parametrize("documents", [1, 15, 16, 17, 1000, 65_536])
def test_bitmaps_round_trip(documents):
    rng = np.random.default_rng(documents)
    rows = [np.sort(rng.choice(documents, size, replace=False)) for size in (1, documents, max(1, documents // 40))]
    row, place = np.repeat(range(3), [len(x) for x in rows]), np.concatenate(rows)
    holders, bits = packed(row, place, 3, documents)
    assert all(len(b.as_py()) <= 2 * min(len(x), (documents + 15) // 16) for b, x in zip(bits, rows, strict=True))
    got = unpacked(holders, np.full(3, documents), bits)
    assert sorted(zip(*map(np.ndarray.tolist, got), strict=True)) == list(zip(row.tolist(), place.tolist(), strict=True))


def test_empty(spark, paths):
    for rows in ([], [(1, None), (2, "")]):
        documents, index = aligned_documents(frame(spark, rows), *paths)
        found = scores(documents, index, pair_counts(index))
        assert result(found) == [(i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows]


def test_query(spark, paths):
    sf_dir = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op11_cross_tokenizer_alignment"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(brute(docs, paths)[0])
