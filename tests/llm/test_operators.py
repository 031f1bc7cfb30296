"""The training-data operators against brute force, on small fixtures with nulls, empties, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import decontaminate, line_dedup, minhash, mixing, pii, repetition, resampling, sharding, suffix_tree, toxicity
from loomwork.store import stored

LOWER = {c: c + 32 for c in range(65, 91)}
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=True):
    return WORDS.findall((text or "").translate(LOWER) if lower else text or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeioubcdfgé") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30, 120))) for _ in range(25)]
    out = [None, "", " \n\t ", "one", "One two\nthree", "a b c d", "word " * 3000, "x" * 20000]
    for t in base:
        w = t.split(" ")
        out += [t, t]  # exact copies
        for k in (1, 2, 9):
            v = list(w)
            for i in rng.sample(range(len(v)), min(k, len(v))):
                v[i] = rng.choice(vocabulary)
            out.append("\n".join(" ".join(v[i : i + 10]) for i in range(0, len(v), 10)))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, i, "x", True) for i, t in enumerate(texts)]
    # extra columns whose names clash with those that operators make
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long, size string, kept boolean")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def test_repetition(docs, nothing, texts):
    got = {r["doc_id"]: r for r in repetition.repetition_report(docs).collect()}
    for i, t in enumerate(texts):
        w, seen, dup = words(t, False), set(), 0
        for line in (t or "").split("\n"):
            if WORDS.search(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered))
        assert tuple(got[i][k] for k in repetition.MEASURES) == want
        assert got[i]["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert repetition.repetition_report(nothing).count() == 0
    assert repetition.drop_repetitive(docs).columns == docs.columns


def test_near_duplicates(docs, nothing, texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in enumerate(sets):
        for j in range(i):
            if p and sets[j] and 100 * len(p & sets[j]) >= 80 * len(p | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, rules=minhash.NearDuplicateRules(width=4)).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}
    # no pivots and small units: lists are cut into many blocks that meet each other; and every coordinate posted
    for rules in (dict(pivots=False, unit_rows=2, unit_shingles=100), dict(least_matches=1)):
        cut = minhash.near_duplicates(docs, rules=minhash.NearDuplicateRules(width=4, **rules)).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in cut} == got
    assert minhash.near_duplicates(nothing).count() == 0


def test_near_duplicates_with_shared_and_null_ids(spark):
    rng = random.Random(3)
    a, b, c = (" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(3))
    rows = [(5, a), (5, b), (7, a + " x"), (8, b + " x"), (9, c), (None, c + " y"), (None, "only here of all " * 3), (None, None), (9, c), (4, ""), (4, "")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, rules=minhash.NearDuplicateRules(width=4)).collect()), key=str)
    n = len({tuple(("only here of all " * 3).split()[k : k + 4]) for k in range(9)})
    want = [(5, 57, 5, True), (5, 57, 5, True), (7, 58, 5, False), (8, 58, 5, False), (9, 57, 9, True), (9, 57, 9, True), (None, 58, 9, False), (None, n, None, True), (None, 0, None, True), (4, 0, 4, True), (4, 0, 4, True)]
    assert got == sorted(want, key=str)
    left = minhash.drop_near_duplicates(df, rules=minhash.NearDuplicateRules(width=4))
    assert left.columns == df.columns
    left = [(r["doc_id"], r["text"]) for r in left.collect()]
    first = min(a, b, key=lambda t: [x for x in left if x[0] == 5][0][1] != t)
    assert sorted(left, key=str) == sorted([(5, first), (9, c), (None, "only here of all " * 3), (None, None), (4, ""), (4, "")], key=str)


def test_decontamination_whatever_the_probe(spark, docs, nothing, texts):
    items = spark.createDataFrame([(1, " ".join(words(texts[8])[5:25])), (2, "one"), (3, None), (4, "..."), (10, " ".join(words(texts[13])[:13]))], "item_id long, text string")
    wordly = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for r in items.collect():
        w = wordly(r["text"])
        for k in range(max(len(w) - 12, min(len(w), 1))):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(r["item_id"])
    want = {}
    for i, t in enumerate(texts):
        w, hit, found = wordly(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    for probe in (5, 13, 1):
        rows = decontaminate.contamination(docs, items, rules=decontaminate.ContaminationRules(probe=probe)).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows} == want
    assert decontaminate.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(nothing, items).count() == 0


def test_decontamination_finds_a_final_sigma_beside_a_mark(spark):
    items = spark.createDataFrame([(1, "ΟΔΟΣ")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "ΟΔΟΣ"), (2, "x ΟΔΟΣ'Α"), (3, "ΟΔΟΣ.Α"), (4, "ΟΔΟ"), (5, None)], "doc_id long, text string")
    for limit in ("10m", "-1"):  # broadcast and shuffled
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        rows = decontaminate.contamination(docs, items).collect()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert {r["doc_id"]: r["n_hit"] for r in rows} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0}


@pytest.mark.parametrize("drop", [False, True])
def test_decontamination_shuffles_texts_once_as_they_are(spark, drop):
    rng = random.Random(21)
    item = " ".join(f"w{k}" for k in range(13))
    text = lambda: " ".join(f"{rng.getrandbits(40):x}" for _ in range(200))
    rows = [(k, f"{text()} {item} {text()}" if k % 8 == 0 else text()) for k in range(4000)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        found = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
        return [found.apply(k) for k in range(found.size())]

    moved = []
    # the benchmark's tables are broadcast; what grows with the documents is above the first limit, below the other
    for limit in ("3k", "10m"):
        before = {x.stageId() for x in stages()}
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        if drop:  # whole rows move a second time
            kept = stored(decontaminate.drop_contaminated(docs, items, rules=decontaminate.ContaminationRules(percent=1)))
            bad = len(rows) - kept.count()
        else:
            bad = decontaminate.contamination(docs, items).where("n_hit = 13").count()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert bad == 500
        moved.append(sum(x.shuffleWriteBytes() for x in stages() if x.stageId() not in before))
    size = sum(len(t) for _, t in rows)
    assert max(moved) < (2.6 if drop else 1.6) * size and max(moved) < 1.1 * min(moved), (moved, size)


def test_decontamination_of_repeated_rows_and_null_ids(spark):
    item = " ".join(f"w{k}" for k in range(20))
    rows = [(None, item, "a"), (None, "clean", "b"), (3, "x y " + item, "c"), (3, "x y " + item, "c"), (3, "clean", "d"), (4, item[:30], "e"), (5, " ".join(f"v{k}" for k in range(4000)) + " " + item.upper(), "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    for probe in (5, 2):
        rules = decontaminate.ContaminationRules(probe=probe)
        got = sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in decontaminate.contamination(docs, items, rules=rules).collect()], key=str)
        assert got == sorted([(None, 20, 20, True), (None, 1, 0, False), (3, 22, 20, True), (3, 22, 20, True), (3, 1, 0, False), (4, len(item[:30].split()), 0, False), (5, 4020, 20, False)], key=str)
        assert sorted(r["hits"] for r in decontaminate.drop_contaminated(docs, items, rules=rules).collect()) == ["b", "d", "e", "f"]


def test_sharding(docs, nothing, texts):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(texts)
    place = {}
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None)
        assert place.setdefault(t, r["shard"]) == r["shard"]
    for s in range(16):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    assert sharding.shard_documents(nothing).count() == 0
    assert sharding.longest_first([(5, "a"), (4, "b"), (3, "c"), (3, "d")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_mixing_weights_and_budgets(spark, docs, nothing):
    sizes = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens long")
    w = {r["source"]: r for r in mixing.temperature_weights(sizes, mixing.MixRules(entropy=0.8, repeats=1e9)).collect()}
    p = [r["weight"] for r in w.values()]
    assert abs(sum(p) - 1) < 1e-9 and abs(-sum(x * math.log(x) for x in p) - 0.8 * math.log(3)) < 1e-6
    w = mixing.temperature_weights(sizes, mixing.MixRules(entropy=1.0, repeats=2.0)).collect()
    assert abs(max(r["weight"] * 1000 / r["tokens"] for r in w) - 2) < 1e-6
    assert mixing.mix_sources(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


def test_mix_against_plain_python(spark, texts):
    """Quotas, order and copies from the weights, on columns with the names of inner ones, repeated rows and ties."""
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, i, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[9]] * 3 + [(None, "null id", "s1", 0, "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens long, rows string, mix_copies int")
    rules = mixing.MixRules(block_rows=5, entropy=1.0, repeats=3.0, budget=1.5)
    got = mixing.mix_sources(docs, rules=rules).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[2] or ""] += max(len(words(r[1])), 1)
    total, by, copies = sum(size.values()), {}, Counter()
    for r in got:
        by.setdefault(r["mix_source"], []).append(r)
        copies[r["doc_id"]] += r["mix_copies"]
    for source, own in by.items():
        own.sort(key=lambda r: r["mix_start"])
        at, quota = 0, math.floor(own[0]["mix_weight"] * total * 1.5 + 1e-9)
        for r in own:  # end to end, and read until the quota is used up
            assert r["mix_start"] == at
            whole, rest = divmod(quota, size[source])
            assert r["mix_copies"] == whole + (at < rest)
            at += r["mix_tokens"]
        assert at == size[source]
    assert abs(sum(own[0]["mix_weight"] for own in by.values()) - 1) < 1e-9
    mix = mixing.mixed(docs, rules=rules)
    assert mix.columns == docs.columns
    assert Counter(r["doc_id"] for r in mix.collect()) == +copies


def test_line_alignment(docs, nothing, spark):
    a, b = list("abcdxyz"), list("qabcdwxz")
    blocks = line_dedup.patience_blocks([hash(x) for x in a], [hash(x) for x in b])
    assert [(i, j, n) for i, j, n in blocks] == [(0, 1, 4), (4, 6, 1), (6, 7, 1)]
    long = "a line that is long enough to count as a repeated passage"
    rows = spark.createDataFrame([(1, f"first\n{long}"), (2, f"{long}\nsecond"), (3, "third"), (4, None), (5, long), (5, long)], "doc_id long, text string")
    got = {r["doc_id"]: list(r["removed"]) for r in line_dedup.repeated_lines(rows).collect()}
    assert got == {1: [], 2: [0], 3: [], 4: [], 5: [0]}
    assert {r["doc_id"]: r["text"] for r in line_dedup.delete_repeated_lines(rows).where("doc_id < 5").collect()} == {1: f"first\n{long}", 2: "second", 3: "third", 4: None}
    assert line_dedup.repeated_lines(nothing).count() == 0


def test_line_alignment_of_versions_that_share_an_id(spark):
    passage = "a passage that is long enough to be found again elsewhere"
    rows = [(1, f"{passage}\nend", 7), (5, f"other words\n{passage}", 8), (5, f"{passage}\nother last line of five", 9), (None, passage, 10), (6, f"{passage}\n{passage}", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed long")
    got = {r["removed"]: r["text"] for r in line_dedup.delete_repeated_lines(df).collect()}
    assert got == {7: f"{passage}\nend", 8: "other words", 9: "other last line of five", 10: passage, 11: ""}  # one copy heads document 1, the other ends document 5


def test_line_alignment_tries_every_earlier_document(spark):
    rng = random.Random(5)
    pool = [f"{c} {'shared line ' * k}"[: 12 * k] + "!" * (k % 3) for c in "abcdefgh" for k in (1, 2, 3, 4)] + ["", "", "     ", "x", "yy"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.8 else f"own {i} {rng.random()}" for _ in range(rng.randrange(1, 14)))) for i in range(90)]
    x, y, one, two = "the first of two neighbouring lines", "the second of two lines", "a line of forty characters or rather more, one", "a line of forty characters or rather more, two"
    rows += [(100, f"{x}\nqqq"), (101, f"ppp\n{y}"), (102, f"{x}\n{y}\nrrr"), (103, f"sss\n{x}\n{y}")]  # earliest holders differ
    rows += [(110, f"{two}\nt\n{one}"), (111, f"{one}\nu\n{two}\nv\nw"), (112, f"1\n{one}\nu\n{two}\n2")]  # the earliest holder has another order
    want = {}
    for i, t in rows:
        b, gone = t.split("\n"), set()
        for _, s in (r for r in rows if r[0] < i):
            a = s.split("\n")
            if {z for z in b if len(z) >= 20 and z.strip()} & set(a):
                for _, j, n in line_dedup.patience_blocks([z.strip(" ") and z for z in a], [z.strip(" ") and z for z in b]):
                    if sum(map(len, b[j : j + n])) >= 40:
                        gone |= set(range(j, j + n))
        want[i] = sorted(gone)
    got = {r["doc_id"]: list(r["removed"]) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and want[103] == [1, 2] and want[112] == [1, 2, 3]


def test_personal_data(spark, nothing):
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(x - 9 if x > 9 else x for x in (int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(d)))) % 10 == 0
    good = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15}
    texts = ["é a@b.c_d@e.f 1.2.3.4.5.6.7.8 +1 (234) 555-1234 4111 1111-1111 1111 @ x@y ..@a.b", "999.1.1.1 0012.1.1.255 +12-34.56(78)9 é@é.com ü a@b-.c", "1" * 20000, "a" * 20000 + "@b", None, "", "4111111111111112", "4111111111111111 4111111111111111"]
    rows = pii.span_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        t = texts[r["doc_id"]] or ""
        want = [f"{k}:{m.start()}:{m.end()}" for k in base for m in re.finditer(base[k], t) if good[k](m.group())] if len(t) < 5000 else []
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(filter(None, want)) <= set(r["spans"].split(","))
    assert pii.span_report(nothing).count() == 0


def test_personal_data_in_other_formats_however_frequent(spark):
    good = ["ann{0}(at)mail(dot)org", "ann{0} [at] mail.example [dot] org", "10[.]1[.]2[.]{0}", "4111.1111/1111_1111", "378282246310005", "0049 30 1234{0:04}", "(030) 12345{0:03}"]
    junk = ["1234567812345678", "12345678123456{0:02}", "00549940386934{0:02}", "a36974748794293d", "at 5{0} @ 3.50 each", "1700000000{0:03}", "10[.]1[.]2[.]999", "(12345678{0:02} of"]
    kinds = ["email", "email", "ip", "card", "card", "phone", "phone"]
    rows = [(f.format(k % 90 + 1), kind) for k in range(200) for f, kind in zip(good, kinds, strict=True)]
    luhn = lambda d: sum(x - 9 if x > 9 else x for x in (int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(d)))) % 10 == 0
    rows += [(f.format(k % 90 + 1), None) for k in range(30) for f in junk]
    rows += [("bob@mail.org +1 (234) 555-1234 4111111111111111 1.2.3.4", "base")] * 3
    rows = [(i, f"see {s} é", s, kind) for i, (s, kind) in enumerate(rows) if kind or not luhn("".join(re.findall("[0-9]", s))) or s[0] == "a"]
    got = {r["doc_id"]: (r["spans"], r["n_added"]) for r in pii.span_report(spark.createDataFrame(rows, "doc_id long, text string, s string, kind string")).collect()}
    for i, _, s, kind in rows:
        if kind != "base":
            assert got[i] == ((f"{kind}:4:{4 + len(s)}", 1) if kind else ("", 0)), s


def test_long_secrets_are_covered_to_their_end(spark):
    values = ["a1" * 8, "a1" * 100, "a1" * 100 + "b", "a1" * 150 + "+/Z=", "a1" * 50_000 + "=="]
    rows = [(i, f"x token = {v} and") for i, v in enumerate(values)]
    got = {r["doc_id"]: r["spans"] for r in pii.span_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: f"secret:2:{10 + len(v)}" for i, v in enumerate(values)}


def test_suffix_tree(docs, nothing, texts):
    got = {r["doc_id"]: r for r in suffix_tree.suffix_tree_scores(docs).collect()}
    tokens = [[*words(t), "\0"] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) < 1e-6 * len(t)
    assert sum(r["score"] for r in got.values() if r["held_out"]) > sum(r["base_score"] for r in got.values() if r["held_out"])
    assert suffix_tree.suffix_tree_scores(nothing).count() == 0


def test_the_composed_grammar_reads_as_its_parts_in_turn():
    rng, parts = random.Random(1), [toxicity.negation_machine(3), toxicity.threat_machine(), toxicity.report_machine(), toxicity.target_machine()]
    whole = toxicity.grammar(3)
    for _ in range(500):
        word = [rng.randrange(6) for _ in range(rng.randrange(1, 15))]
        symbols, factors, final = word, [1.0] * len(word), 0.0
        for m in parts:  # each machine reads what the one before wrote
            state, written = 0, []
            for k, a in enumerate(symbols):
                b, state, f = m.step[state][a]
                written.append(b)
                factors[k] *= f
            symbols, final = written, final + m.final[state]
        state, got = 0, []
        for a in word:
            b, state, f = whole.step[state][a]
            got.append((b, f))
        assert [g[0] for g in got] == symbols and whole.final[state] == final
        assert all(abs(g[1] - f) < 1e-12 for g, f in zip(got, factors, strict=True))
        bad = [k for k, a in enumerate(word) if a in (toxicity.INSULT, toxicity.THREAT)]
        marked = [k for k, a in enumerate(word) if a]
        if marked:  # skipping words of no class changes nothing
            want = sum(2.0 * factors[k] for k in bad) + whole.final[state] if bad else 0.0
            tail = toxicity.clause_weights([word[k] for k in marked], [2.0] * len(marked), [k + 7 for k in marked], 3)
            assert abs(tail - want) < 1e-9


def test_negated_and_reported_clauses_weigh_less(spark):
    arcs = toxicity.arcs_of([])
    weigh = lambda t: toxicity.score_clauses(*(lambda b: (np.frombuffer(b, np.uint8), np.array([0, len(b)])))(t.encode()), arcs, 3)[0, 1]
    assert weigh("you are an idiot") > weigh("an idiot") > weigh("he said an idiot") > weigh("he said not an idiot") > 0
    assert weigh("you are not an idiot") < weigh("an idiot") and weigh("we kill you, i kill time") > weigh("i kill time") > 0 and weigh("a river") == 0
    df = spark.createDataFrame([(None, "you idiot"), (None, "you idiot"), (1, "")], "doc_id long, text string").withColumn("score", F.lit("x"))
    rows = toxicity.toxicity_scores(df, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(rows) == 3 and all(r["held_out"] is not None and 0 <= r["score"] <= 1 for r in rows)


def test_toxicity_finds_held_out_insults(spark, nothing):
    rng, plain = random.Random(2), ["river", "stone", "cloud", "green", "walks", "today", "under", "light"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(20)]
        if bad := i % 4 == 0:
            w[rng.randrange(20)] = rng.choice(["grumfel", "grumfelous"])  # not in the seed lexicon
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "you are not an idiot")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, marks).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in held) and sum(got[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 403
    assert toxicity.toxicity_scores(nothing, marks).count() == 0


def test_resampling_prefers_the_target(spark, docs, nothing):
    rows = [(i, "good clean words here " * 5 if i % 2 else "junk &&& noise ### " * 5) for i in range(200)] + [(500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    target = df.where("doc_id % 2 = 1 and doc_id < 100").select("doc_id")
    got = resampling.importance_resample(df, target, rules=resampling.ResamplingRules(share=0.5)).collect()
    kept = [r["doc_id"] for r in got if r["kept"]]
    assert len(kept) == 101 and sum(i % 2 for i in kept if i < 200) >= 95  # Gumbel noise lets a few others in
    assert resampling.importance_resample(nothing, target).count() == 0
