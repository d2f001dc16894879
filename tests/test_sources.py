import json

import pytest

from tablescribe.sources import scans, scratch


def test_tsv_words(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    rows = ["1\t1\t0\t0\t0\t0\t0\t0\t9\t9\t-1\t", '5\t1\t1\t1\t1\t1\t10\t20\t30\t8\t96.5\tNapa"', "5\t1\t1\t1\t1\t2\t50\t20\t5\t8\t-1\tx", "5\t1\t1\t1\t1\t3\t60\t20\t5\t8\t50\t ", "broken"]
    (tmp_path / "a.tsv").write_text(head + "\n".join(rows) + "\n")
    got = scans.read_tsv(spark, str(tmp_path)).collect()
    assert [(r["text"], r["x0"], r["x1"], r["y1"], r["confidence"]) for r in got] == [('Napa"', 10.0, 40.0, 28.0, 96.5)]


def test_hocr_words(spark):
    html = "<span class='ocr_line'><span class='ocrx_word' id='w1' title='bbox 1 2 30 40; x_wconf 91'><b>Total</b></span>\n<span class=\"ocrx_word\" title=\"bbox 5 6 7 8\"> 12 </span><span class='ocrx_word' title='bbox 0 0 1 1'></span></span>"
    got = scans.hocr_words(spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, h string"), "id", "h").orderBy("place").collect()
    assert [(r["id"], r["text"], r["x0"], r["y1"], r["confidence"]) for r in got] == [(1, "Total", 1.0, 40.0, 91.0), (1, "12", 5.0, 8.0, None)]


def test_answers(spark):
    box = {"x0": 1, "y0": 2, "x1": 3, "y1": 4}
    deep = {"deep": {"rows": [{"index": 0, "cells": [{"col": 0, "text": "a", "confidence": 0.5, "bbox": box}, {"col": 1, "text": "b", "confidence": 0.6, "bbox": box}]}]}, "engines": [{"name": "p", "status": "ok", "ms": 3, "characters": [{"text": "x", "confidence": 0.9, "word": 0, "bbox": box}]}, {"name": "q", "status": "failed"}]}
    brief = {"brief": {"lines": [{"text": "line", "confidence": 0.7, "bbox": box}]}}
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, json.dumps(brief)), (3, "nonsense"), (4, None)], "id int, j string")
    assert sorted((r["id"], r["place"], r["text"]) for r in scans.regions(df, "id", "j").collect()) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "line")]
    assert sorted((r["engine"], r["status"], r["text"]) for r in scans.engine_readings(df, "id", "j").collect()) == [("p", "ok", "x"), ("q", "failed", None)]


def test_lists_tables_and_ground_truth(spark, tmp_path):
    (tmp_path / "words.txt").write_text("Napa\n\n napa \nSeclo\n")
    assert sorted(r["word"] for r in scans.read_words(spark, str(tmp_path / "words.txt")).collect()) == ["napa", "seclo"]
    (tmp_path / "t.json").write_text(json.dumps({"a|b|c": 4, "a|b": 2}))
    assert [tuple(r) for r in scans.read_trigrams(spark, str(tmp_path / "t.json")).collect()] == [("a", "b", "c", 4.0)]
    (tmp_path / "g.json").write_text(json.dumps({"images": [{"id": "i", "url": "u", "width": 9, "height": 9}], "annotations": [{"id": "1", "imageId": "i", "label": "x", "bbox": [0, 0, 2, 2]}, {"id": "2", "imageId": "j", "label": "", "bbox": [0, 0, 0, 2]}]}))
    images, annotations = scans.ground_truth(spark, str(tmp_path / "g.json"))
    assert sorted(tuple(r) for r in scans.faults(images, annotations).collect()) == [("2", "box"), ("2", "image"), ("2", "label")]


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})

    with pytest.raises(ValueError):
        scratch.shared_folder(Session())
