"""Fuzzy line dedup against all pairs."""

import random
import re

import pytest
import xxhash

from bellwether.llm import buckets, line_dedup
from bellwether.llm.line_dedup import AGREE, BLOCKS, DISTANCE, PERCENT, line_report, with_lines_removed

SCHEMA = "doc_id long, text string, source string, n_chars int, key string, removed string"


def normalised(line):
    return re.sub("[ \t\x0b\f\r]+", " ", line.lower()).strip(" ")


def simhash(line):
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in dict.fromkeys(line.split(" "))]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    """{(doc_id, text): removed positions}; repeated rows count once."""
    places = {}
    for doc_id, text in dict.fromkeys(rows):
        tid = None if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
        tid = tid and (tid - (1 << 64) if tid >> 63 else tid)
        for pos, line in enumerate([] if text is None else text.split("\n")):
            if normalised(line):
                places.setdefault(normalised(line), []).append(((doc_id, tid, pos), text))
    lines = list(places)
    least = {x: x for x in lines}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    sims = {x: simhash(x) for x in lines}
    for i, x in enumerate(lines):
        for y in lines[:i]:
            if bin(sims[x] ^ sims[y]).count("1") > DISTANCE:
                continue
            if distance(x, y) <= max(len(x), len(y)) * (100 - PERCENT) // 100:
                least[root(x)] = root(y)
    groups = {}
    for x in lines:
        groups.setdefault(root(x), []).extend(places[x])
    removed = {row: set() for row in rows}
    for found in groups.values():
        order = sorted(found, key=lambda f: ((f[0][0] is not None, f[0][0] or 0), f[0][1], f[0][2]))
        for (doc_id, _, pos), text in order[1:]:
            removed[(doc_id, text)].add(pos)
    return {row: sorted(gone) for row, gone in removed.items()}


def corpus():
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(200)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randrange(8, 50))) for _ in range(25)]
    rows = [(0, None), (1, ""), (2, "\n \n\t"), (3, "one"), (4, "ONE\none\n two  2 \ntwo 7"), (None, base[0]), (9, base[1])]
    rows += [(9, base[1]), (9, base[1] + "\nnot the same")]
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(base)
            w = line.split(" ")
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                w[rng.randrange(len(w))] += rng.choice("abc")
            lines.append(" ".join(w).title() if rng.random() < 0.2 else " ".join(w))
        rows.append((20 + i, "\n".join(lines)))
    # A large group of variants of one line.
    for i in range(40):
        rows.append((200 + i, base[3] + " tail" * (i % 4) + f" {rng.choice('xyz')}"))
    return rows


@pytest.mark.parametrize("pivots", [2])
def test_against_all_pairs(spark, monkeypatch, pivots):
    monkeypatch.setattr(buckets, "PIVOTS", pivots)
    rows = corpus()
    want = brute(rows)
    docs = spark.createDataFrame([(i, t, "s", 1, "k", "r") for i, t in rows], SCHEMA).repartition(3)
    assert sum(map(len, want.values())) > 50
    report = line_report(docs).collect()
    texts = dict(rows)
    assert len(report) == len(rows)
    for r in report:
        if r.doc_id != 9:
            text = texts[r.doc_id]
            assert r.removed == want[(r.doc_id, text)], (r, text)
            assert r.n_lines == sum(1 for x in (text or "").split("\n") if normalised(x))
            assert r.n_removed == len(r.removed)
    cut = with_lines_removed(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    for r in cut.collect():
        if r.doc_id is not None and r.doc_id != 9 and r.text is not None:
            text, gone = texts[r.doc_id], want[(r.doc_id, texts[r.doc_id])]
            kept = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
            assert r.text == kept and r.n_chars == (len(kept) if gone else 1)
    filled = {r.doc_id for r in with_lines_removed(docs, keep_emptied=False).collect()}
    emptied = {i for (i, t), gone in want.items() if gone and len(gone) == sum(1 for x in t.split("\n") if normalised(x))}
    assert {i for i, _ in rows} - filled == emptied - {9}


# Percent of one-word edits of similarity 0.8 or more to be found, by words of the line.
RECALL = {(10, 19): 40, (20, 29): 65, (30, 59): 80, (60, 120): 90}


def test_recall_against_edit_similarity_alone(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randrange(2, 10))) for _ in range(3000)]
    rows, of_class = [], {}
    for span in RECALL:
        for _ in range(80):
            w = rng.choices(vocabulary, k=rng.randint(*span))
            line, i = " ".join(w), rng.randrange(len(w))
            w[i] = rng.choice((rng.choice(vocabulary), w[i][:-1] + "z"))
            edited = " ".join(w)
            most = max(len(line), len(edited)) * (100 - PERCENT) // 100
            if edited != line and max(len(w[i]), len(line.split(" ")[i])) <= most:
                of_class[len(rows) + 1] = span
                rows += [(len(rows), line), (len(rows) + 1, edited)]
    docs = spark.createDataFrame([(i, t, "s", 1, "k", "r") for i, t in rows], SCHEMA)
    found = {r.doc_id for r in line_report(docs).collect() if r.n_removed}
    assert found <= of_class.keys()
    recall = {}
    for span in RECALL:
        ids = [i for i, c in of_class.items() if c == span]
        recall[span] = 100 * sum(i in found for i in ids) / len(ids)
    print(recall)
    assert all(recall[span] >= least for span, least in RECALL.items()), recall


def test_blocks_hold_all_bits():
    assert sum(BLOCKS) == 64 and len(BLOCKS) - DISTANCE == AGREE


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert line_report(docs).collect() == [] and with_lines_removed(docs).collect() == []


def test_lines_without_partner_get_no_block_keys(spark, monkeypatch):
    rows = []
    real = line_dedup.written

    def counted(df, name, **options):
        table = real(df, name, **options)
        rows.append((name, table.count()))
        return table

    monkeypatch.setattr(line_dedup, "written", counted)
    keyed = []
    block_keys = line_dedup._block_keys
    monkeypatch.setattr(line_dedup, "_block_keys", lambda sim: keyed.append(dict(rows)) or block_keys(sim))
    texts = [" ".join(f"w{i * 1000 + k}" for k in range(30)) for i in range(200)]
    texts += [texts[7] + "!", texts[9][:-1]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sum(r.n_removed for r in line_report(docs).collect()) == 2
    assert keyed[0]["distinct"] == 202 and keyed[0].get("wanted") == 4


def test_met_finds_every_near_simhash(spark):
    rng = random.Random(3)
    sims = []
    for n in range(600):
        base = rng.getrandbits(64)
        # DISTANCE bits anywhere, crowded into one end, and one bit too many.
        for bits in (rng.sample(range(64), DISTANCE), rng.sample(range(24), DISTANCE), rng.sample(range(64), DISTANCE + 1)):
            if n % 3 == len(bits) % 3 or n % 2:
                sims += [base, base ^ sum(1 << b for b in bits)]
                base = rng.getrandbits(64)
    sims += [0, (1 << 64) - 1, 1 << 63, sims[0]]
    want = {i for i, x in enumerate(sims) if any(i != j and (x ^ y).bit_count() <= DISTANCE for j, y in enumerate(sims))}
    signed = [x - (1 << 64) if x >> 63 else x for x in sims]
    got = line_dedup._met(spark.createDataFrame(list(enumerate(signed)), "id long, sim long")).collect()
    assert {r.id for r in got} == want and len(got) == len(want) and len(want) < len(sims)


def test_simhash_of_long_lines(spark):
    rng = random.Random(4)
    lines = [" ".join(f"{rng.getrandbits(30):x}" for _ in range(n)) for n in (1, 2, 3, 40, 4100, 20000)]
    lines.append(" ".join(chr(0x4E00 + i) for i in range(16383)))
    made = spark.createDataFrame(
        [(i, 0, 0, i, 0, len(x), x) for i, x in enumerate(lines)],
        "doc_id long, tid long, pos int, k1 long, k2 long, chars int, line string",
    )
    sims = {r.doc_id: r.sim % (1 << 64) for r in line_dedup._simhash(made).collect()}
    assert sims == {i: simhash(x) for i, x in enumerate(lines)}


def test_met_of_a_large_group_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(5)
    tables = {}
    real = line_dedup.written

    def counted(df, name, **options):
        tables[name] = real(df, name, **options)
        monkeypatch.setitem(rows, name, tables[name].count())
        return tables[name]

    rows = {}
    monkeypatch.setattr(line_dedup, "written", counted)
    base = rng.getrandbits(63)
    sims = list({base ^ sum(1 << b for b in rng.sample(range(63), 3)) for _ in range(400)})
    far = [rng.getrandbits(63) for _ in range(50)]
    alone = [base ^ sum(1 << b for b in (2, 24, 25, 26, 45, 46, 47))]  # differs from the base in every span
    lines = list(enumerate(sims + far + alone))
    want = {i for i, x in lines if any(i != j and (x ^ y).bit_count() <= DISTANCE for j, y in lines)}
    got = {r.id for r in line_dedup._met(spark.createDataFrame(lines, "id long, sim long")).collect()}
    assert got == want and len(want) >= len(sims)
    # Of a group of n only lines without a near neighbour go on to the lookups' pairs, not n * n of them.
    assert rows["lone"] < len(sims) // 10


def test_block_keys_stay_small_in_a_plan(spark):
    lines = spark.createDataFrame([(1, 5), (2, 5 ^ (1 << 63 - 1)), (3, -1)], "id long, sim long")
    keyed = line_dedup._block_keys(lines)
    keys = {i: {r.key for r in keyed.filter(f"id = {i}").collect()} for i in (1, 2, 3)}
    n = len(BLOCKS)
    choices = n * (n - 1) * (n - 2) // 6
    assert AGREE == 3 and {len(k) for k in keys.values()} == {choices}
    # The choices without the last block, and none of those of unlike lines.
    assert len(keys[1] & keys[2]) == (n - 1) * (n - 2) * (n - 3) // 6 and not keys[1] & keys[3]
    assert keyed._jdf.queryExecution().optimizedPlan().toString().count("shiftright") < 5 * n


def test_block_keys_are_not_broadcast(spark, monkeypatch):
    """Spark takes 120 keys of a line for one row, so they would be broadcast by the size of the lines."""
    plans = {}
    real = line_dedup.written

    def seen(df, name, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name, **options)

    monkeypatch.setattr(line_dedup, "written", seen)
    texts = [f"{i} " + " ".join(f"w{i * 1000 + k}" for k in range(60)) for i in range(100)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *(t + "!" for t in texts)])], "doc_id long, text string")
    assert sum(r.n_removed for r in line_report(docs).collect()) > 50
    by_key = [x for x in plans["buckets"].splitlines() if "Join [key" in x]
    assert by_key and all("SortMergeJoin" in x or "ShuffledHashJoin" in x for x in by_key), by_key


def test_simhashes_with_the_bits_of_a_span_are_looked_up_as_one(spark, monkeypatch):
    rng = random.Random(6)
    rows, cells = {}, []
    real, real_cells = line_dedup.written, line_dedup._cells

    def counted(df, name, **options):
        table = real(df, name, **options)
        rows[name] = table.count()
        return table

    monkeypatch.setattr(line_dedup, "written", counted)
    monkeypatch.setattr(line_dedup, "_cells", lambda known: cells.append(real_cells(known)) or cells[0])
    low = 12345
    sims = [low | rng.getrandbits(41) << 22 for _ in range(500)]
    near = [sims[5] ^ 1 << 30, sims[6] ^ 0b11 << 21, sims[7]]
    lines = list(enumerate(sims + near))
    want = {i for i, x in lines if any(i != j and (x ^ y).bit_count() <= DISTANCE for j, y in lines)}
    # Counted before _met() drops the tables that the cells come from.
    monkeypatch.setattr(line_dedup, "dropped", lambda df: None)
    got = {r.id for r in line_dedup._met(spark.createDataFrame(lines, "id long, sim long")).collect()}
    assert got == want and rows["sims"] == len({x for _, x in lines})
    held = {r.cell: (r.sims, r.fresh) for r in cells[0].filter(f"cell < {1 << 22}").collect()}
    assert len(held) == 2 and len(held[low][0]) == len(set(sims + near)) - 1
    told, fresh = held[low]
    assert 0 < fresh < len(told) and set(told[fresh:]) <= {dict(lines)[i] for i in want}


def test_rows_that_share_a_key_by_chance_leave_the_buckets(spark, monkeypatch):
    held = {}
    real = line_dedup.written

    def kept(df, name, **options):
        table = real(df, name, **options)
        if name == "buckets":
            held[name] = table.collect()
        return table

    monkeypatch.setattr(line_dedup, "written", kept)
    texts = [f"{i} " + " ".join(f"w{i * 1000 + k}" for k in range(60)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *(t + "!" for t in texts)])], "doc_id long, text string")
    assert sum(r.n_removed for r in line_report(docs).collect()) > 200
    members = {}
    for r in held["buckets"]:
        members.setdefault(r.key, []).append(r)
    assert len(members) > 200
    for rows in members.values():
        for x in rows:
            assert any(x.id != y.id and ((x.sim ^ y.sim) % (1 << 64)).bit_count() <= DISTANCE for y in rows)
