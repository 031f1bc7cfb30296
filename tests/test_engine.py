import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import scalars as sc
from loomwork.operators import coco, gates, merging, reviews, splits
from loomwork.operators import detection as det
from loomwork.operators import relational as rel
from loomwork.operators.components import connected_components
from loomwork.sources import files, sinks
from loomwork.streaming.ingest import ingest_new


def test_hamming_pairs_are_all_pairs_within_the_distance(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(12)]
    rows = [(i, base[i % 12] ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(6)))) for i in range(80)]
    got = {(r["a"], r["b"]) for r in rel.hamming_pairs(spark.createDataFrame(rows, "id long, h long"), "id", "h", 4).collect()}
    first = {}
    for i, h in rows:
        first.setdefault(h, i)
    want = {(min(i, j), max(i, j)) for h, i in first.items() for g, j in first.items() if i != j and bin(h ^ g).count("1") <= 4}
    want |= {(first[h], i) for i, h in rows if first[h] != i}
    assert got == want


def test_components_of_a_long_path_and_of_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_matching_is_greedy_by_score_and_breaks_ties_by_the_last_box(spark):
    truth = spark.createDataFrame([(1, 0, 5, 0.0, 0.0, 10.0, 10.0), (1, 1, 6, 0.0, 0.0, 10.0, 10.0), (2, 0, 5, 0.0, 0.0, 4.0, 4.0)], "image_id long, pos long, label long, x1 double, y1 double, x2 double, y2 double")
    pred = spark.createDataFrame([(1, 0, 5, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 5, 0.0, 0.0, 10.0, 10.0, 0.8), (3, 0, 5, 0.0, 0.0, 1.0, 1.0, 0.5)], "image_id long, pos long, label long, x1 double, y1 double, x2 double, y2 double, score double")
    rows = det.match_boxes(truth, pred)
    matched = {(r["pred_pos"], r["truth_pos"]) for r in rows.where("image_id = 1").collect()}
    assert matched == {(0, 1), (1, 0)}
    m = det.micro_metrics(rows).first()
    assert (m["tp"], m["fp"], m["fn"]) == (1, 2, 2)
    assert {(r["pred_pos"], r["truth_pos"]) for r in det.match_boxes(truth, pred, tie_highest=False).where("image_id = 1").collect()} == {(0, 0), (1, 1)}


def test_best_threshold_takes_the_highest_of_equal_ones(spark):
    scored = spark.createDataFrame([(0.9, True), (0.8, True), (0.1, False)], "score double, correct boolean")
    assert det.best_threshold(det.confidence_curve(scored, 2)).first()["step"] == 80


def coco_by_hand(truth, found):
    """label, area, step -> (positives, ap, {m: recall}); plain loops over the definition."""
    out = {}
    for label in {t[2] for t in truth} | {f[2] for f in found}:
        for area, (least, most) in coco.AREAS.items():
            for step in coco.STEPS:
                marks, positives = [], 0
                for image in sorted({r[0] for r in [*truth, *found]}):
                    gt = sorted([t for t in truth if t[0] == image and t[2] == label], key=lambda t: t[1])
                    dt = sorted([f for f in found if f[0] == image and f[2] == label], key=lambda f: (-f[7], f[1]))[:100]
                    out_of = [not least <= t[5] * t[6] <= most for t in gt]
                    order = sorted(range(len(gt)), key=lambda g: out_of[g])
                    positives += out_of.count(False)
                    used = set()
                    for place, d in enumerate(dt):
                        best, at = step, None
                        for g in order:
                            if g in used:
                                continue
                            if at is not None and not out_of[at] and out_of[g]:
                                break
                            t = gt[g]
                            w = max(0, min(t[3] + t[5], d[3] + d[5]) - max(t[3], d[3]))
                            h = max(0, min(t[4] + t[6], d[4] + d[6]) - max(t[4], d[4]))
                            o = w * h / (t[5] * t[6] + d[5] * d[6] - w * h)
                            if o >= best:
                                best, at = o, g
                        if at is not None:
                            used.add(at)
                        ignored = out_of[at] if at is not None else not least <= d[5] * d[6] <= most
                        if not ignored:
                            marks.append((-d[7], image, place, at is not None))
                marks.sort()
                if not positives:
                    out[label, area, step] = (0, None, None)
                    continue
                tp, points = 0, []
                for k, m in enumerate(marks, 1):
                    tp += m[3]
                    points.append((tp, tp / k))
                ap = sum(max([p for n, p in points if 100 * n >= r * positives and (r or n)] or [0]) if r else max([p for n, p in points] or [0]) for r in range(101)) / 101
                out[label, area, step] = (positives, ap, {m: sum(x[3] for x in marks if x[2] < m) / positives for m in coco.MOST})
    return out


def test_coco_table_against_plain_loops(spark):
    rng = random.Random(4)
    truth, found = [], []
    for image in range(25):
        for pos in range(rng.randrange(5)):
            w, h = rng.choice([(10, 12), (50, 60), (120, 100)])
            box = (rng.randrange(200) * 1.0, rng.randrange(200) * 1.0, float(w), float(h))
            truth.append((image, pos, rng.randrange(3), *box))
            for _ in range(rng.randrange(3)):
                found.append((image, len(found), rng.choice([truth[-1][2], rng.randrange(4)]), box[0] + rng.randrange(-4, 9), box[1] + rng.randrange(-4, 4), box[2], box[3], rng.randrange(20) / 20))
    cols = "image_id long, pos long, label long, x double, y double, w double, h double"
    t, f = spark.createDataFrame(truth, cols), spark.createDataFrame(found, cols + ", score double")
    table = coco.coco_table(t, f).cache()
    got = {(r["label"], r["area"], round(r["step"], 2)): r for r in table.collect()}
    want = coco_by_hand(truth, found)
    assert set(got) == set(want)
    for key, (n, ap, recall) in want.items():
        r = got[key]
        assert r["positives"] == n and (r["ap"] is None) == (ap is None)
        if n:
            assert abs(r["ap"] - ap) < 1e-9, key
            assert all(abs(r[f"ar{m}"] - recall[m]) < 1e-9 for m in coco.MOST)
    s = coco.coco_summary(table).first()
    mean = lambda v: sum(v) / len(v)
    assert abs(s["mAP_50_95"] - mean([ap for (_, a, _), (n, ap, _) in want.items() if a == "all" and n])) < 1e-9
    assert abs(s["AR10"] - mean([r[10] for (_, a, _), (n, _, r) in want.items() if a == "all" and n])) < 1e-9
    same = t.withColumn("score", F.lit(0.9))
    assert coco.coco_summary(coco.coco_table(t, same)).first()["mAP_50_95"] == 1.0
    assert coco.coco_summary(coco.coco_table(t, f.limit(0))).first()["mAP_50_95"] == 0.0


def test_coco_table_of_many_images_in_small_batches_and_chunks(spark, monkeypatch):
    rng = random.Random(6)
    truth, found = [], []
    for image in range(40):
        label = rng.choice([None, 1, 2])
        for pos in range(30 if image == 7 else rng.randrange(4)):
            box = (rng.randrange(60) * 1.0, rng.randrange(60) * 1.0, *rng.choice([(20.0, 30.0), (60.0, 60.0), (110.0, 100.0)]))
            truth.append((image, pos, label, *box))
            for _ in range(rng.randrange(3)):
                found.append((image, len(found), rng.choice([label, None, 3]), box[0] + rng.randrange(-4, 9), box[1] + rng.randrange(-4, 4), box[2], box[3], rng.choice([0.25, 0.5, 0.5, 0.9])))
    for name, rows in {"TASK": 100, "BOXES": 7, "CHUNK": 5}.items():
        monkeypatch.setattr(coco, name, rows)
    cols = "image_id long, pos long, label long, x double, y double, w double, h double"
    got = {(r["label"], r["area"], r["step"]): r for r in coco.coco_table(spark.createDataFrame(truth, cols), spark.createDataFrame(found, cols + ", score double")).collect()}
    want = coco_by_hand(truth, found)
    assert set(got) == set(want) and any(label is None and ap for (label, _, _), (_, ap, _) in want.items())
    for key, (n, ap, recall) in want.items():
        assert got[key]["positives"] == n and (got[key]["ap"] is None) == (ap is None)
        assert not n or abs(got[key]["ap"] - ap) < 1e-9 and all(abs(got[key][f"ar{m}"] - recall[m]) < 1e-9 for m in coco.MOST), key
    # pairs of a few detections at a time are the pairs of all
    boxes = [np.array([r[3:7] for r in side]) for side in (truth, found)]
    begin, end = np.zeros(len(found), int), np.arange(len(found)) % (len(truth) + 1)
    every = coco._near(*boxes, begin, end)
    monkeypatch.setattr(coco, "PAIRS", 10)
    assert all((a == b).all() for a, b in zip(every, coco._near(*boxes, begin, end), strict=True))


def test_splits_against_plain_loops(spark):
    rng = random.Random(8)
    key = lambda g: hashlib.sha256(f"split:{g}".encode()).hexdigest()
    groups = [(f"s{rng.randrange(3)}", g, rng.randrange(1, 8)) for g in range(300)]
    df = spark.createDataFrame(groups, "stratum string, gid long, size long")
    got = {r["gid"]: r["split"] for r in splits.fill_splits(df, "gid", "size", 0.15, 0.15, 5, "split").collect()}
    total, want, valid, test = sum(g[2] for g in groups), {}, 0, 0
    for _, g, n in sorted(groups, key=lambda r: key(r[1])):
        if n >= 5:
            want[g] = "train"
        elif valid < int(total * 0.15):
            want[g], valid = "valid", valid + n
        elif test < int(total * 0.15):
            want[g], test = "test", test + n
        else:
            want[g] = "train"
    assert got == want
    got = {r["gid"]: r["split"] for r in splits.stratified_fill(df, "stratum", "gid", "size").collect()}
    want = {}
    for s in ("s0", "s1", "s2"):
        own = sorted([g for g in groups if g[0] == s], key=lambda r: key(r[1]))
        need = [round(0.15 * sum(g[2] for g in own))] * 2
        for _, g, n in own:
            side = None if n >= 5 else 0 if need[0] >= need[1] and need[0] > 0 else 1 if need[1] > 0 else None
            want[g] = "train" if side is None else ("valid", "test")[side]
            if side is not None:
                need[side] -= n
    assert got == want


def test_component_splits_against_plain_loops(spark):
    rng = random.Random(9)
    rows, key = [], (lambda c: hashlib.sha256(f"split:{c}".encode()).hexdigest())
    for c in range(260):
        label = rng.randrange(4)
        for _ in range(rng.randrange(1, 6)):
            rows.append((len(rows), c, label if rng.random() < 0.95 else 3 - label, rng.choice(["train"] * 30 + ["valid", "test"])))
    df = spark.createDataFrame(rows, "key long, component long, label long, split string")
    out = splits.component_splits(df, "component", "label", "split")
    got = {r["key"]: r["assigned"] for r in out.collect()}
    members = {}
    for r in rows:
        members.setdefault(r[1], []).append(r)
    want, free = {}, []
    for c, own in members.items():
        stays = len({r[3] for r in own}) == 1 and len(own) <= 4
        for r in own:
            want[r[0]] = own[0][3] if stays else "train"
        if stays and own[0][3] == "train" and len({r[2] for r in own}) == 1:
            free.append(c)
    free.sort(key=lambda c: key(c))
    free.sort(key=lambda c: -len(members[c]))
    for split in ("valid", "test"):
        for label in range(4):
            target = round(0.15 * sum(r[2] == label for r in rows))
            while (lacking := target - sum(want[r[0]] == split for r in rows if r[2] == label)) > 0:
                fits = [c for c in free if members[c][0][2] == label and len(members[c]) <= lacking + 1]
                if not fits:
                    break
                best = min(fits, key=lambda c: (abs(lacking - len(members[c])), len(members[c])))
                free.remove(best)
                for r in members[best]:
                    want[r[0]] = split
    assert got == want
    moved = {r["key"]: (r["from"], r["to"]) for r in splits.move_log(out, "key", "split").collect()}
    assert moved == {r[0]: (r[3], want[r[0]]) for r in rows if r[3] != want[r[0]]}


def test_merged_boxes_against_plain_loops(spark):
    rng = random.Random(6)
    rows = [(i, 100 * i + k, rng.randrange(2), *(x := (rng.randrange(30) * 1.0, rng.randrange(30) * 1.0)), x[0] + rng.randrange(20, 40), x[1] + rng.randrange(20, 40), rng.random(), [rng.choice("ab")], rng.random() < 0.1) for i in range(30) for k in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "image_id long, ann_id long, label long, x1 double, y1 double, x2 double, y2 double, score double, flags array<string>, barred boolean")
    got = {tuple(r["members"]): (r["ann_id"], r["x1"], r["y1"], r["x2"], r["y2"], r["flags"]) for r in merging.merged_boxes(df, [F.col("score").desc()], 0.5, F.col("barred")).collect()}
    root = {r[1]: r[1] for r in rows}

    def overlap(a, b):
        w, h = max(0, min(a[5], b[5]) - max(a[3], b[3])), max(0, min(a[6], b[6]) - max(a[4], b[4]))
        return w * h / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - w * h)

    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and a[2] == b[2] and not a[9] and not b[9] and overlap(a, b) > 0.5:
                old, new = root[b[1]], root[a[1]]
                root = {k: new if v == old else v for k, v in root.items()}
    want = {}
    for r in set(root.values()):
        own = sorted([x for x in rows if root[x[1]] == r], key=lambda x: x[1])
        best = max(own, key=lambda x: x[7])
        want[tuple(x[1] for x in own)] = (best[1], min(x[3] for x in own), min(x[4] for x in own), max(x[5] for x in own), max(x[6] for x in own), sorted({f for x in own for f in x[8]}))
    assert got == want and any(len(k) > 2 for k in got)


def test_similar_clusters_against_plain_loops(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(62) for _ in range(20)]
    rows = [(k, f"s{k // 2}" if k % 3 else None, base[k % 20] ^ (1 << rng.randrange(60))) for k in range(60)]
    got = {r["node"]: r["component"] for r in reviews.similar_clusters(spark.createDataFrame(rows, "pos long, source string, phash long"), 2).collect()}
    root = list(range(60))
    for a in rows:
        for b in rows:
            if (a[1] and a[1] == b[1]) or bin(a[2] ^ b[2]).count("1") <= 2:
                x, y = sorted((root[a[0]], root[b[0]]))
                root = [x if v == y else v for v in root]
    assert got == dict(enumerate(root))


def test_reused_ids_are_used_once(spark):
    old = spark.createDataFrame([(1, 10, 5, 0.0, 0.0, 4.0, 4.0), (1, 11, 5, 0.0, 0.0, 4.0, 4.0), (1, 12, 6, 0.0, 0.0, 4.0, 4.0)], "image_id long, ann_id long, label long, x double, y double, w double, h double")
    new = spark.createDataFrame([(1, k, 5, 0.00003 * (k == 1), 0.0, 4.0, 4.0) for k in range(3)] + [(1, 3, 6, 0.0002, 0.0, 4.0, 4.0)], "image_id long, pos long, label long, x double, y double, w double, h double")
    assert {r["pos"]: r["old_id"] for r in merging.reused_ids(new, old).collect()} == {0: 10, 1: 11, 2: None, 3: None}


def test_running_sums_and_numbers_cross_ranges(spark):
    rows = [(f"k{i % 3}" if i % 7 else None, i * 37 % 500, i % 5) for i in range(500)]
    got = rel.running_sum(spark.createDataFrame(rows, "k string, o long, v long"), ["k"], ["o"], F.col("v"), "before").collect()
    want = {r: sum(x[2] for x in rows if x[0] == r[0] and x[1] < r[1]) for r in rows}
    assert {(r["k"], r["o"], r["v"]): r["before"] for r in got} == want


def test_gates_report_and_raise(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k long, v string")
    assert [r["key"] for r in gates.unique_key(df, "k").collect()] == ["1"]
    assert gates.holds(df, "k", F.col("v") == "a", "is_a").count() == 2
    assert gates.row_count(df, 3).count() == 0
    try:
        gates.require(gates.row_count(df, 4))
    except ValueError as error:
        assert "row_count" in str(error)
    else:
        raise AssertionError


def test_scalars(spark):
    df = spark.createDataFrame([("", "x", 0.8, 5), (None, "", 0.81, 2)], "a string, b string, s double, n long")
    rows = df.select(sc.first_filled(F.col("a"), F.col("b"), F.lit("z")).alias("f"), sc.score_bucket(F.col("s")).alias("s"), sc.count_bin(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in rows] == [("x", "medium", "4+"), ("z", "high", "2")]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    sinks.write_jsonl(df, str(tmp_path / "rows"))
    assert files.read_jsonl(spark, str(tmp_path / "rows"), "id long, name string").orderBy("id").collect() == df.collect()
    (tmp_path / "coco.json").write_text(json.dumps({"categories": [{"id": 1, "name": "x"}], "images": [{"id": 4, "file_name": "f"}], "annotations": [{"id": 9, "image_id": 4, "bbox": [0.0, 1.0, 2.0, 3.0]}]}))
    assert files.read_coco(spark, str(tmp_path / "coco.json"), "train")["annotations"].first()["split"] == "train"
    (tmp_path / "v.xml").write_text("<annotation><filename>f.jpg</filename><object><name>cat</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>")
    assert tuple(files.read_voc(spark, str(tmp_path / "v.xml")).first()) == ("f.jpg", "cat", 1.0, 2.0, 3.0, 4.0)


def test_exports(spark):
    images = spark.createDataFrame([("train", 7, "b.jpg", 100, 50), ("train", 3, "a.jpg", 100, 50)], "split string, image_id long, file_name string, width int, height int")
    boxes = spark.createDataFrame([(7, 1, 2, 10.0, 5.0, 20.0, 10.0)], "image_id long, ann_id long, category_id int, x double, y double, w double, h double")
    document = json.loads(sinks.coco_document(images, boxes, spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")).first()["document"])
    assert [i["file_name"] for i in document["images"]] == ["a.jpg", "b.jpg"]
    assert document["annotations"][0]["image_id"] == 2
    labels = {r["file_name"]: r["labels"] for r in sinks.yolo_labels(images, boxes).collect()}
    assert labels == {"a.jpg": "", "b.jpg": "1 0.200000 0.200000 0.200000 0.200000"}


def test_ingest_takes_new_files_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    run = lambda: ingest_new(spark, str(source), "id long, v string", str(tmp_path / "out"), str(tmp_path / "state"), "id").awaitTermination()
    (source / "a.json").write_text('{"id": 1, "v": "x"}\n{"id": 1, "v": "y"}\n')
    run()
    (source / "b.json").write_text('{"id": 1, "v": "z"}\n{"id": 2, "v": "z"}\n')
    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_line_numbers_broken_lines_and_keys(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "n": 1}\n\n{"id": "y"\n{"id": "z", "n": 2}\n')
    assert [(r["line_number"], r["value"]) for r in files.broken_lines(spark, str(tmp_path / "a.jsonl"), "id string, n long").collect()] == [(3, '{"id": "y"')]
    (tmp_path / "b.jsonl").write_text('{"id": "x", "n": 1}\n{"id": "y", "n": 2}\n{"id": "x", "n": 3}\n')
    assert {r["id"]: r["n"] for r in files.read_latest(spark, str(tmp_path / "b.jsonl"), "id string, n long", "id").collect()} == {"x": 3, "y": 2}
    for text in ('{"id": "x", "n": 1}\n{"id": "x", "n": 2}\n', '{"id": " ", "n": 1}\n', '{"id": "x"}\n'):
        (tmp_path / "c.jsonl").write_text(text)
        with pytest.raises(ValueError):
            files.read_keyed_jsonl(spark, str(tmp_path / "c.jsonl"), "id string, n long", "id", ["n"])


def test_images_are_probed_from_their_headers(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (5).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + (9).to_bytes(2, "big") + (8).to_bytes(2, "big") + bytes(12)
    for name, data in (("a.PNG", png), ("b.jpg", jpeg), ("c.gif", b"GIF89a" + (3).to_bytes(2, "little") + (4).to_bytes(2, "little")), ("d.webp", b"RIFF0000WEBPVP8X" + bytes(8) + (11).to_bytes(3, "little") + (12).to_bytes(3, "little")), ("e.png", png[:12]), ("f.txt", b"x")):
        (tmp_path / "one").mkdir(exist_ok=True)
        (tmp_path / "one" / name).write_bytes(data)
    got = {r["path"].split("/")[-1]: (r["format"], r["width"], r["height"], r["error"]) for r in files.probe_images(spark, str(tmp_path)).collect()}
    assert got == {"a.PNG": ("PNG", 7, 5, None), "b.jpg": ("JPEG", 8, 9, None), "c.gif": ("GIF", 3, 4, None), "d.webp": ("WEBP", 12, 13, None), "e.png": (None, None, None, "truncated"), "f.txt": (None, None, None, "unknown format")}
    assert sorted(r["path"].split("/")[-1] for r in files.list_files(spark, str(tmp_path)).collect()) == ["a.PNG", "b.jpg", "d.webp", "e.png"]
    assert [r["folder"] for r in files.list_folders(spark, str(tmp_path)).collect()] == ["one"]


def test_exports_are_staged_and_checked(spark, tmp_path):
    images = spark.createDataFrame([(s, k, f"{k}.jpg", 100, 50, f"h{k}") for k, s in enumerate(("train", "valid", "test"))], "split string, image_id long, file_name string, width int, height int, pixel_hash string")
    boxes = spark.createDataFrame([(k, k, 1, 1.0, 1.0, 5.0, 5.0) for k in range(3)], "image_id long, ann_id long, category_id int, x double, y double, w double, h double")
    labels = spark.createDataFrame([(1, "x")], "id int, name string")
    sinks.write_export(images, boxes, labels, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("split=*"))) == 3
    with pytest.raises(FileExistsError):
        sinks.write_export(images, boxes, labels, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        sinks.write_export(images, boxes.where("ann_id > 0"), labels, str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()
    sinks.write_yolo(images, boxes, str(tmp_path / "yolo"))
    assert len(list((tmp_path / "yolo" / "labels").glob("split=*/stem=*"))) == 3
    with pytest.raises(ValueError):
        sinks.write_yolo(images, boxes.withColumn("w", F.lit(500.0)), str(tmp_path / "yolo2"))
    sinks.save_json(spark, str(tmp_path / "s.json"), {"a": 1})
    sinks.save_json(spark, str(tmp_path / "s.json"), {"a": 2})
    assert json.loads((tmp_path / "s.json").read_text()) == {"a": 2}
    with pytest.raises(ValueError):
        sinks.save_json(spark, str(tmp_path / "s.json"), {"a": float("nan")})
    assert sinks.markdown_table(labels, ["id", "name"]) == "| id | name |\n|---|---|\n| 1 | x |"
    runs = spark.createDataFrame([("p1", "r1", "f", True), ("p2", "r2", "f", False), ("p3", "r3", "g", True)], "path string, name string, fingerprint string, completed boolean")
    assert files.newest_run(runs, "f").first()["path"] == "p1"
