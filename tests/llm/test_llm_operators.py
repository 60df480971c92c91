import collections
import hashlib
import itertools
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecspark.llm import ann, chat, decontamination, language, mixing, neardup, packing, pii, quality, repeats, support

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def documents(spark, rows, partitions=3):
    """``rows`` of (doc_id, text[, lang[, source]]) with an extra column that clashes with results."""
    full = [(*r, *[None] * (4 - len(r)), 0, 0.5) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def sentences(seed, n, words=40, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in rng.integers(0, vocabulary, words)) for _ in range(n)]


EDGE = [(None, "a b c"), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "x " * 30_000), (6, "é ü ß")]


# ------------------------------------------------------------- near duplicates


def brute_groups(rows, width, percent=80):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def varied(seed, n, changes):
    """Copies of one text with some words changed each, so that some are too far from others."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(120)]
    out = []
    for _ in range(n):
        own = list(base)
        for i in rng.integers(0, len(base), rng.integers(0, changes)):
            own[i] = f"c{rng.integers(0, 10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("width, small_blocks", [(2, False), (5, True)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, width, small_blocks):
    if small_blocks:
        for name, value in dict(LARGE_GROUP=3, BLOCK_MEMBERS=4, BLOCK_ASKED=3, LIST_BLOCK=4, BUCKET_POSTINGS=50, BLOCK_SHINGLES=200).items():
            monkeypatch.setattr(neardup, name, value)
    texts = sentences(1, 20) + varied(2, 60, 14) + ["same words here"] * 4 + ["Same WORDS here", "one", "ONE", "", None]
    rows = list(enumerate(texts, start=10))
    found = {r[0]: tuple(r)[1:] for r in neardup.near_duplicates(documents(spark, rows), width).collect()}
    assert found == brute_groups(rows, width)


def test_wanted_rows_are_found_without_a_broadcast_join(spark):
    docs = documents(spark, [(5, "a"), (-2, "b"), (None, "c"), (0, "d"), (5, "e"), (9, None)])
    for ids, wanted in (([5, 0, 9], ["a", "d", "e", "None"]), ([None, -2], ["b"]), ([], [])):
        rows = support.only(docs, support.write_step(spark.createDataFrame([(i,) for i in ids], "doc_id long"), "ids"))
        assert sorted(str(r["text"]) for r in rows.collect()) == sorted(wanted) and rows.columns == docs.columns
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_edges(spark):
    found = collections.defaultdict(list)
    for r in neardup.near_duplicates(documents(spark, EDGE), 2).collect():
        found[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert found[None] == [(2, None, True)] and found[1] == [(0, 1, True)] and found[4] == [(1, 4, True)] * 2
    assert neardup.near_duplicates(documents(spark, []), 2).count() == 0
    several = neardup.near_duplicates(documents(spark, [(7, "a b c"), (7, "d e f"), (8, "d e f"), (-3, "a b c")]), 2).collect()
    assert sorted(tuple(r)[:3] for r in several) == [(-3, 2, -3), (7, 2, -3), (7, 2, 7), (8, 2, 7)]


def test_deduplicate_decides_by_text(spark):
    rows = [(7, "a b c"), (7, "d e f"), (7, "d e f"), (8, "d e f"), (-3, "a b c"), (9, "x y z"), (9, "x y z"), (5, "p q"), (5, "P Q"), (None, "a b c"), (None, "a b c")]
    docs = documents(spark, rows)
    kept = neardup.deduplicate(docs, 2)
    found = collections.Counter((r["doc_id"], r["text"].lower()) for r in kept.collect())
    assert kept.columns == docs.columns
    assert found == {(-3, "a b c"): 1, (7, "d e f"): 1, (9, "x y z"): 1, (5, "p q"): 1, (None, "a b c"): 2}
    plain = neardup.deduplicate(documents(spark, [(1, "a b c"), (2, "a b c"), (None, "a b c")]), 2).collect()
    assert sorted((r["doc_id"] or 0) for r in plain) == [0, 1]


# -------------------------------------------------------------- exact repeats


def brute_repeats(rows, window):
    seen, gone, words = {}, collections.defaultdict(set), {}
    for d, t in sorted(rows):
        words[d] = (t or "").encode().split()
        for i in range(len(words[d]) - window + 1):
            if seen.setdefault(tuple(words[d][i : i + window]), (d, i)) != (d, i):
                gone[d].update(range(i, i + window))
    return {d: (len(w), len(gone[d]), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone[d])).hexdigest()) for d, w in words.items()}


@pytest.mark.parametrize("pack", [repeats.PACK_BYTES, 300])
def test_repeats_equal_brute_force(spark, monkeypatch, pack):
    monkeypatch.setattr(repeats, "PACK_BYTES", pack)
    passage, other = sentences(5, 1, 33)[0], sentences(6, 1, 21)[0]
    texts = [f"{a} {passage} {b}" for a, b in zip(sentences(7, 8, 7), sentences(8, 8, 26))]
    texts += [f"{passage} x {other}", other, f"{other} {other}", "a " * 60, "b " * 19, "", None, passage, passage.upper(), f"{passage} {passage[:40]}"]
    rows = list(enumerate(texts))
    found = {r[0]: tuple(r)[1:] for r in repeats.remove_repeats(documents(spark, rows), digest=True).collect()}
    assert found == brute_repeats(rows, 20)
    plain = {r["doc_id"]: r["kept"] for r in repeats.remove_repeats(documents(spark, rows)).collect()}
    assert all(hashlib.sha256(plain[d].encode()).hexdigest() == found[d][2] for d in found)


def test_repeats_edges(spark):
    long = " ".join(f"w{i}" for i in range(25))
    rows = [*EDGE, (9, long), (9, long), (None, long)]
    found = collections.defaultdict(list)
    for r in repeats.remove_repeats(documents(spark, rows)).collect():
        found[r["doc_id"]].append((r["n_words"], r["n_removed"]))
    assert found[9] == [(25, 0)] * 2 and sorted(found[None]) == [(3, 0), (25, 25)] and found[1] == found[2] == found[3] == [(0, 0)]
    assert found[5] == [(30_000, 29_999)]
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


# ---------------------------------------------------------------------- mixing


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 60, 900)
    sources = ["b", "a", None, "c", "é"]
    rows = [(i, "w " * int(n), "en", sources[int(min(i % 7, 4))]) for i, n in enumerate(sizes)]
    found = mixing.mix(documents(spark, rows)).collect()
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len(t.split())
    order = sorted([s for s in size if s is not None]) + [None]
    weight, full, target = {s: 1 + i % 3 for i, s in enumerate(order)}, set(), {}
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        level = left / sum(weight[s] for s in order if s not in full)
        target = {s: 3 * size[s] if s in full else level * weight[s] for s in order}
        over = {s for s in order if target[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    taken = collections.Counter()
    for r in found:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.005 * target[s] + 2 for s in order)
    again = mixing.mix(documents(spark, rows, 5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in found)


def test_mix_edges(spark):
    found = mixing.mix(documents(spark, EDGE)).collect()
    assert len(found) == len(EDGE) and all(r["taken"] == 0 for r in found if r["size"] == 0)
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mix(documents(spark, [(1, ""), (2, None)])).agg(F.sum("taken")).first()[0] == 0
    assert mixing.apply_mix(documents(spark, EDGE)).columns == documents(spark, EDGE).columns


def test_mix_with_prior(spark):
    rows = [(i, "w " * 10, "en", "a" if i % 2 else "b") for i in range(400)]
    docs = documents(spark, rows)
    rates = mixing.mix(docs, prior=F.when(F.col("doc_id") < 200, 4.0).otherwise(1.0)).where("source = 'b'")
    low, high = (rates.where(c).agg(F.avg("rate")).first()[0] for c in ("doc_id >= 200", "doc_id < 200"))
    assert high == pytest.approx(min(3.0, 4 * low), rel=1e-6)


def test_apply_mix_gives_repeated_rows_all_their_copies(spark):
    rows = [(1, "w w w", "en", "a")] * 300 + [(None, "w w", "en", "b")] * 200 + [(1, "w w w", "en", "b")] * 2
    rows += [(i, "v " * (i % 9 + 1), "en", "c" if i % 3 else "b") for i in range(10, 150)]
    docs = documents(spark, rows)
    wanted, found = collections.Counter(), collections.Counter()
    for r in mixing.mix(docs).collect():
        wanted[r["source"]] += r["taken"]
    for r in mixing.apply_mix(docs).collect():
        found[r["source"]] += len(r["text"].split())
    assert found == wanted and min(wanted.values()) > 0


@pytest.mark.parametrize("salts, run_rows", [(1, 100_000), (1, 7), (64, 100_000)])
def test_apply_mix_takes_each_document_as_mix_says(spark, monkeypatch, salts, run_rows):
    monkeypatch.setattr(mixing, "SALTS", salts)
    monkeypatch.setattr(mixing, "RUN_ROWS", run_rows)
    rng = np.random.default_rng(8)
    rows = [(i, f"t{i} " * int(n), "en", "abc"[min(i % 6, 2)]) for i, n in enumerate(rng.integers(0, 90, 700))]
    docs = documents(spark, rows)
    wanted = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
    found = collections.Counter(r["doc_id"] for r in mixing.apply_mix(docs).collect())
    assert found == wanted and set(found.values()) >= {1, 2}


def test_apply_mix_shuffles_no_texts(spark):
    docs = documents(spark, [(i, f"t{i} " * (i % 40), "en", "abc"[i % 3]) for i in range(200)])
    plan = mixing.apply_mix(docs.select("doc_id", "text", "source"))._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line and "REPARTITION_BY_NUM" not in line]


def test_apply_mix_counts_the_words_of_a_text_once_a_scan(spark):
    docs = documents(spark, [(i, f"t{i} " * (i % 40), "en", "abc"[i % 3]) for i in range(200)])
    plan = mixing.apply_mix(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


# ------------------------------------------------------------------------ chat


def test_chat_collapses_snapshots(spark):
    said = {1: ["a", "b", "c"], 2: ["a", "b"], 3: ["a"], 4: ["a", "b", "c"], 5: ["a", "x"], 6: ["b"], 7: [None]}
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", t, 0) for c, turns in said.items() for i, t in enumerate(turns)]
    turns = spark.createDataFrame([*rows, (None, 0, "user", "lost", 0)], "conv_id long, turn long, role string, text string, n_turns int")
    found = {r["conv_id"]: r for r in chat.format_chats(turns).collect()}
    assert set(found) == {1, 5, 6, 7} and found[1]["n_copies"] == 2
    assert found[5]["text"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    for r in found.values():
        for a, b in r["spans"]:
            assert r["text"][:a].endswith("assistant\n") and r["text"][b:].startswith("<|im_end|>")
    assert chat.format_chats(turns.limit(0)).count() == 0


# --------------------------------------------------------------------- packing


def test_packing_round_trip(spark):
    rows = [*EDGE, *enumerate(sentences(9, 50, 300), start=100), (7, "a  b \n c   d's x")]
    packed = packing.pack_documents(documents(spark, rows), capacity=128, shard_chars=20_000).collect()
    parts = collections.defaultdict(dict)
    for r in packed:
        assert len(r["input_ids"]) == len(r["position_ids"]) == 128 and r["cu_seqlens"][0] == 0
        for n, (a, b) in enumerate(zip(r["cu_seqlens"], r["cu_seqlens"][1:])):
            assert r["position_ids"][a:b] == list(range(b - a))
            parts[r["doc_ids"][n]].setdefault(r["piece_starts"][n], []).append(r["input_ids"][a:b])
        assert set(r["input_ids"][r["cu_seqlens"][-1] :]) <= {packing.END_OF_TEXT}
    encoding = packing.encoder(packing.VOCABULARY).encoding
    for d, t in {d: t for d, t in rows if t and d != 4}.items():
        ids = [x for s in sorted(parts[d]) for x in parts[d][s][0]]
        assert ids == [*encoding.encode_ordinary(t), packing.END_OF_TEXT]
    assert len(parts[4][0]) == 2 and 1 not in parts and 2 not in parts
    assert packing.pack_documents(documents(spark, [])).count() == 0
    binary = packing.as_binary(spark.createDataFrame(packed[:2], packing.PACKED)).collect()
    assert [np.frombuffer(r["input_ids"], "<i4").tolist() for r in binary] == [r["input_ids"] for r in packed[:2]]


def test_packing_spreads_equal_rows(spark):
    """A document that makes up most of the table is dealt to many shards, and none of its copies is lost."""
    text = " ".join(["word"] * 200)
    rows = [*[(1, text)] * 300, *enumerate(sentences(31, 60, 100), start=10)]
    packed = packing.pack_documents(documents(spark, rows, 4), capacity=512, shard_chars=10_000).collect()
    copies = collections.Counter()
    for r in packed:
        copies[r["shard"]] += r["doc_ids"].count(1)
    assert sum(copies.values()) == 300
    assert max(copies.values()) <= 40 and len(copies) > 15


def test_best_fit_decreasing():
    lengths = np.random.default_rng(1).integers(1, 101, 400)
    rows = packing.pack_lengths(lengths, 100)
    assert sorted(itertools.chain(*rows)) == list(range(400)) and all(sum(lengths[r]) <= 100 for r in rows)
    rooms = []
    for n in sorted(lengths.tolist(), reverse=True):  # the plain form of the rule
        fit = [r for r in rooms if r[0] >= n]
        best = min(fit, key=lambda r: r[0]) if fit else rooms.append([100]) or rooms[-1]
        best[0] -= n
    assert len(rows) == len(rooms)


# ------------------------------------------------------------- decontamination


def test_decontamination_equals_brute_force(spark):
    items = [(i, t) for i, t in enumerate(sentences(11, 12, 14) + sentences(12, 6, 60) + ["two words", "", None])]
    texts = sentences(13, 30, 700, 5000)
    for n, (_, t) in enumerate(items[:18]):
        words = t.split()
        words = words[: len(words) - n % 3]  # some lack their last words
        texts[n] = f"{texts[n][: 37 * n]} {' '.join(words).upper()} {texts[n][37 * n :]}"
    rows = [*enumerate(texts, start=1000), (99, "Two Words"), (98, items[0][1]), *EDGE[1:]]

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    benchmark = spark.createDataFrame(items, "item_id long, text string")
    sets = {i: shingles(t) for i, t in items}
    wanted = {(d, i) for d, t in rows for i, s in sets.items() if s and len(s & shingles(t)) >= 0.8 * len(s)}
    docs = documents(spark, rows)
    found = decontamination.find_contamination(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == wanted and len(wanted) > 15
    kept = decontamination.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == sum(d not in {x for x, _ in wanted} for d, _ in rows)
    assert decontamination.find_contamination(docs, benchmark.limit(0)).count() == 0
    assert decontamination.find_contamination(docs.limit(0), benchmark).count() == 0


def test_decontamination_finds_every_item_of_one_shingle(spark):
    starts, rests = sentences(14, 4000, 5, 10**6), sentences(15, 4000, 20, 10**6)
    benchmark = spark.createDataFrame(list(enumerate(starts)), "item_id long, text string")
    found = decontamination.find_contamination(documents(spark, [(i, f"{a} {b}") for i, (a, b) in enumerate(zip(starts, rests))]), benchmark)
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(i, i) for i in range(4000)]


# ------------------------------------------------------------------------- pii


def test_permutations_are_one_to_one():
    p = pii.Permuter(b"k")
    for n in (2, 7, 10, 100, 997):
        assert sorted(p.permute("x", i, n) for i in range(n)) == list(range(n))


@pytest.mark.parametrize("length", [1, 2, 3, 30, 47, 63, 64, 65, 128, 230, 300])
def test_pii_names_of_any_length(length):
    p, rng = pii.Permuter(b"k"), np.random.default_rng(length)
    names = {"".join(rng.choice(list("abcxyz"), length)) for _ in range(30)}
    if length > 2:
        names |= {"." + n[1:-1] + "%" for n in list(names)[:5]}
    new = {n: p.name("mail", n) for n in names}
    assert len(set(new.values())) == len(names)
    for old, name in new.items():
        assert len(name) == length and all(a == b if not a.isalnum() else "a" <= b <= "z" for a, b in zip(old, name))
    if length >= 64:  # every part of a long name changes
        assert all(sum(a != b for a, b in zip(o[:20], n[:20])) > 5 for o, n in new.items())
        assert all(sum(a != b for a, b in zip(o[-20:], n[-20:])) > 5 for o, n in new.items())


def test_pii_single_letters_are_permuted():
    p = pii.Permuter(b"k")
    letters = "abcdefghijklmnopqrstuvwxyz"
    assert sorted(p.name("mail", c) for c in letters) == list(letters)


@pytest.mark.parametrize(
    "text, spans",
    [
        ("..ab.c@x.org.", ["ab.c@x.org"]), ("a@b@c.de", ["b@c.de"]), ("@x.org a@.org %@x.org", []), ("a@x.org,b-@y-z.co.uk/", ["a@x.org", "b-@y-z.co.uk"]),
        ("a@x.org@y.org", ["a@x.org"]), ("é1@x.org", ["1@x.org"]), ("a@x", []), ("a@x.o1", []), ("x" * 300 + "@a.bc", ["x" * 300 + "@a.bc"]),
    ],
)
def test_pii_addresses_are_found(text, spans):
    assert [text[a:b] for a, b in pii.addresses(text)] == spans


@pytest.mark.parametrize(
    "block",
    [
        "abc123XYZ" * 120_000, "a." * 500_000, "a@" * 500_000, "a@b." * 250_000, "1-" * 500_000, "12." * 350_000, "AB12" * 250_000,
        "1" * 1_000_000, "+1 " * 350_000, "(" * 1_000_000, "x@y.org " * 20_000,
    ],
)
def test_pii_takes_linear_time(block):
    started = time.time()
    pii.pseudonymise("see 1.2.3.4 " + block, pii.Permuter(b"k"))
    assert time.time() - started < 5


def test_pii_clashing_names_and_long_texts(spark):
    rows = [(1, "mail me@x.org " * 40_000), (2, None), (3, ""), (4, "on 2020-01-31"), (4, "on 2020-01-31")]
    docs = documents(spark, rows).withColumn("n_replaced", F.lit("old")).withColumn("kinds", F.lit(1))
    found = pii.pseudonymise_documents(docs, "k")
    assert sorted(found.columns) == sorted(docs.columns)
    got = collections.defaultdict(list)
    for r in found.collect():
        got[r["doc_id"]].append((r["n_replaced"], r["kinds"], r["text"]))
    assert got[1][0][:2] == (40_000, {"email": 40_000}) and got[2] == [(0, {}, None)] and got[3] == [(0, {}, "")]
    assert got[4][0] == got[4][1] and got[4][0][1] == {"date_iso": 1}


def test_pii_keeps_formats(spark):
    text = "card 4111 1111 1111 1111, 4041894974608795 27.65.93.188 on 1999-12-31 or 31.12.1999 +1 (988) 555-2485 hsr.29@mail5.example.com 123-45-6789"
    clean = "order 1234567890123456 of 999-00-1234 on 2024-02-31 v1.2.3.4.5 and 300.1.1.1"
    rows = [(10, text), (11, f"again {text}"), (12, clean), *EDGE]
    found = {r["doc_id"]: r for r in pii.pseudonymise_documents(documents(spark, rows), "key").collect()}
    assert found[10]["n_replaced"] == 8 and found[12]["text"] == clean and found[1]["text"] is None
    assert found[11]["text"] == f"again {found[10]['text']}"
    new = found[10]["text"].split()
    assert not set(new) & {"4041894974608795", "27.65.93.188", "1999-12-31", "hsr.29@mail5.example.com"}
    assert pii.luhn("".join(new[1:5]).rstrip(",")) and pii.luhn(new[5])
    assert pii.pseudonymise_documents(documents(spark, []), "key").count() == 0


@pytest.mark.parametrize("number", ["AT611904300234573201", "BE68 5390 0754 7034", "DE89370400440532013000", "NO93 8601 1117 947"])
@pytest.mark.parametrize("around", ["{}", "{} BIC", "{} EUR", "{} ABCD EFGH IJ", "AB12 3456 7890 {} PLN", "{} ABC@example.com", "{} PL61 1090 1014 0000 0712 1981 2874 USD"])
def test_pii_ibans_end_where_they_are_valid(number, around):
    new, counts = pii.pseudonymise(around.format(number), pii.Permuter(b"k"))
    alone, _ = pii.pseudonymise(number, pii.Permuter(b"k"))
    assert alone != number and pii.iban_number(alone.replace(" ", "")) % 97 == 1
    assert counts["iban"] == around.count("PL6") + 1 and alone in new and number not in new
    assert "1090 1014" not in new and new.count(" ") == around.format(number).count(" ")
    assert all(w in new for w in ("BIC", "EUR", "ABCD EFGH IJ", "AB12 3456 7890", "PLN", "USD") if w in around)


# --------------------------------------------------- quality and language models


def test_quality_separates(spark):
    good, bad = sentences(20, 300, 80), ["$$ ".join(t.split()[:50]).upper() for t in sentences(21, 300, 80)]
    rows = list(enumerate([*good, *bad, None, "", "  "]))
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(600)] + [(None, 1, 0), (5, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)  # its column score is replaced
    model = quality.train(docs, labels)
    assert quality.score(docs, model).columns.count("score") == 1
    scored = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all((scored[i] >= 0.3) == (i < 300) for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0)
    assert scored[600] == scored[601] == scored[602] == model.empty
    assert quality.train(docs, labels.limit(0)).empty == 0.5 and quality.score(docs.limit(0), model).count() == 0


def test_language_predicts(spark):
    rng = np.random.default_rng(4)
    parts = {"en": "the ing tion and", "de": "sch ung und ei", "fr": "eau que les oi", "es": "cion ñar los ll", "fi": "kk yö ää en"}
    rows = []
    for i in range(400):
        lang = list(parts)[i % 5]
        rows.append((i, " ".join("".join(rng.choice(parts[lang].split(), 2)) for _ in range(30)), lang))
    rows += [(900, None, "en"), (901, "", None), (902, "123 !!", "de"), (903, "the and", None)]
    docs = documents(spark, rows).withColumn("lang_pred", F.lit(0))  # its columns score and lang_pred are replaced
    model = language.train(docs)
    assert sorted(language.identify(docs, model).columns).count("lang_pred") == 1
    found = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert np.mean([found[i]["lang_pred"] == rows[i][2] for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]) > 0.95
    assert [found[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and found[903]["lang_pred"] != "und"
    assert language.train(docs.limit(0)) is None and language.identify(docs, None).where("lang_pred <> 'und'").count() == 0


def test_language_learns_every_language(spark):
    """No language is left out for being rarer than others, and a long or repeated text changes nothing for the rest."""
    rng = np.random.default_rng(8)
    alphabets = [[chr(0x4E00 + 40 * n + j) for j in range(12)] for n in range(30)]
    rows = [(i, " ".join("".join(rng.choice(alphabets[i % 30], 3)) for _ in range(20)), f"l{i % 30:02d}") for i in range(600)]
    rows += [rows[0]] * 50 + [(5000, rows[1][1] * 3000, "l01")]
    model = language.train(documents(spark, rows), total=60)
    assert sorted(m for f in model.families for m in f) == [f"l{n:02d}" for n in range(30)]
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(documents(spark, rows), model).collect()}
    assert np.mean([found[i] == rows[i][2] for i in range(600)]) > 0.95 and found[5000] == "l01"


# ------------------------------------------------------------------------- ann


def test_ann_recall_and_exactness(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 16)) * rng.uniform(0.5, 2, 3000)[:, None]
    x[200:300] = x[200]  # equal vectors, some of them queries
    rows = [(i, [float(c) for c in v], 0.0) for i, v in enumerate(x)]
    bad = [(3000, None, 0.0), (3020, [0.0] * 16, 0.0), (3040, [float("nan")] * 16, 0.0), (None, [1.0] * 16, 0.0), (3060, [None] + [1.0] * 15, 0.0)]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score double").repartition(4)
    found = collections.defaultdict(list)
    for r in sorted(ann.nearest(vectors, k=20, every=20, leaf_rows=64).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 3000, 20))
    recall = []
    for q, answers in found.items():
        s = x @ x[q]
        s[q] = -np.inf
        recall.append(len({v for v, _ in answers} & set(np.lexsort((np.arange(3000), -s))[:20])) / 20)
        assert all(score == pytest.approx(s[v], abs=1e-9) for v, score in answers)
        assert answers == sorted(answers, key=lambda a: (-a[1], a[0]))
    assert np.mean(recall) >= 0.9
    assert ann.nearest(vectors.limit(0)).count() == 0 and ann.nearest(vectors.where("vec_id in (20, 21)")).count() == 1


def test_ann_repeated_ids_and_lengths(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [1.0, 1.0]), (1, [2.0, 5.0]), (1, [2.0, 3.0]), (1, [4.0, 0.0]), (2, [1.0, 0.0])]
    for order in (rows, rows[::-1]):
        found = ann.nearest(spark.createDataFrame(order, schema)).orderBy("rank").collect()
        assert [(r["query_id"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 5.0), (0, 2, 1.0)]
    with pytest.raises(ValueError, match="dimension: 2 and 3"):
        ann.nearest(spark.createDataFrame([*rows, (3, [1.0, 2.0, 3.0])], schema))


def spread_vectors(kind, n):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((n, 64))
    if kind == "clusters":
        return rng.standard_normal((60, 64))[rng.integers(0, 60, n)] + 0.3 * x
    if kind == "gaussian":
        return x
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x if kind == "unit" else x * rng.lognormal(0, 1, n)[:, None]


@pytest.mark.parametrize("kind", ["unit", "gaussian", "lengths", "clusters"])
def test_ann_recall_with_production_parameters(spark, kind):
    x = spread_vectors(kind, 14_000)
    ids = pa.array(np.arange(len(x)))
    values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * 64), pa.array(x.ravel()))
    vectors = spark.createDataFrame(pa.table({"vec_id": ids, "embedding": values})).repartition(4)
    found = collections.defaultdict(set)
    for r in ann.nearest(vectors).collect():
        found[r["query_id"]].add(r["vec_id"])
    recall = []
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        recall.append(len(found[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    print(kind, np.mean(recall))
    assert np.mean(recall) >= 0.9


def test_calibration_of_separable_examples_stays_finite():
    x = np.r_[np.full((200, 3), -1.0), np.full((300, 3), 1.0)] + np.random.default_rng(2).normal(0, 0.01, (500, 3))
    y = np.r_[np.zeros(200), np.ones(300)]
    w = quality._fit_logistic(x, y)
    assert np.abs(w).max() < 50 and (((x @ w[:-1] + w[-1]) > 0) == (y == 1)).all()


# -------------------------------------------------------------------- pipeline


def test_pipeline_sends_small_batches_to_python(spark):
    import corpus_pipeline
    from __spark_entry__ import SMOKE_DIR

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = documents(spark, [(i, f"t{i} " * 5000, "en", "a") for i in range(400)]).coalesce(1)

    def largest(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max(b.nbytes for b in batches)], pa.int64())], ["n"])

    for name, stage in corpus_pipeline.STAGES:
        if name != "mixing":
            spark.conf.unset(key)
            try:
                stage(spark, docs, SMOKE_DIR)
                assert docs.mapInArrow(largest, "n long").first()[0] < 4 << 20
            finally:
                spark.conf.unset(key)
