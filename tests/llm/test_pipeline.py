"""The pipeline's stages against what they should leave."""

import random

import corpus_pipeline
from bellwether.llm.mixing import mixed_sources
from bellwether.llm.near_dedup import near_duplicates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def tables(spark, folder):
    rng = random.Random(9)
    vocabulary = {"en": [f"the{i}ing" for i in range(300)], "de": [f"über{i}ß" for i in range(300)]}

    def prose(lang, n):
        return " ".join(rng.choices(vocabulary[lang], k=n))

    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        rows.append((i, "\n".join(prose(lang, rng.randrange(8, 40)) for _ in range(rng.randrange(1, 6))), lang, f"s{i % 4}"))
    long_text = prose("en", 300).replace("\n", " ")
    rows.append((300, long_text, "en", "s0"))
    for i in range(6):  # near copies: other words here and there, in one line
        w = long_text.split(" ")
        w[17 * (i + 1)] = f"the{900 + i}ing"
        rows.append((301 + i, " ".join(w), "en", "s1"))
    rows += [(400, None, "en", "s0"), (401, "", "en", None), (402, "1 2 3", "de", "s2"), (403, rows[5][1], "en", "s3")]
    rows += [rows[7], (404, prose("en", 5000), "en", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    pages = [(f"http://h.example.org/en/{i}", f'<html lang="{lang}">') for i, _, lang, _ in rows[:50]]
    spark.createDataFrame(pages, "url string, html string").write.parquet(f"{folder}/pages.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == list(out)

    language = [r.doc_id for r in out["language_id"].collect()]
    assert sorted(language) == sorted(r[0] for r in rows if r[0] not in (400, 401, 402))
    lines = out["line_dedup"].collect()
    assert 403 not in {r.doc_id for r in lines}
    seen = [x for r in lines for x in r.text.split("\n")]
    assert len(seen) >= len(set(seen)) and all(r.n_chars == len(r.text) for r in lines if r.doc_id < 160)

    near = out["minhash_near_dedup"].collect()
    ids = [r.doc_id for r in near]
    want = {r.component_id for r in near_duplicates(out["line_dedup"]).collect()}
    assert len(ids) == len(set(ids)) and set(ids) == want
    assert len({i for i in ids if 300 <= i < 310}) == 1

    mixed = out["entropy_mixing"]
    words = {r.doc_id: len(r.text.split()) for r in near}
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    planned = {r.doc_id: r.copies for r in mixed_sources(out["minhash_near_dedup"]).collect() if r.copies}
    assert times == planned and set(times) <= set(ids) and max(times.values()) <= 3

    packed = out["best_fit_packing"].collect()
    filled, sources = {}, {}
    for r in packed:
        at = (r.shard, r.bin)
        filled[at] = filled.get(at, 0) + r.n_words
        sources.setdefault(at, []).append(r.source)
    assert max(filled.values()) <= 2048 and all(len(s) == len(set(s)) for s in sources.values())
    assert sum(filled.values()) == sum(words[i] * n for i, n in times.items())


def test_run_and_empty(spark, tmp_path):
    tables(spark, tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 50
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
