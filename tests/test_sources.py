"""Readers on files with valid, blank, broken and aliased records."""

import json

import numpy as np
from pyspark.sql import functions as F

from crossloom.operators import reporting as R
from crossloom.sources import readers as I
from crossloom.sources import sinks as O


def test_interactions(spark, tmp_path, rows):
    lines = ['{"user_id": "u1", "item_id": "i1", "timestamp": 5}', "", '{"reviewerID": "u2", "asin": "i2", "unixReviewTime": 7}',
             "{broken", '{"user_id": "u3"}', "   "]
    p = tmp_path / "reviews.jsonl"
    p.write_text("\n".join(lines))
    assert rows(I.read_interactions(spark, str(p), "X"), "user_id", "item_id", "ts", "domain") == [
        ("u1", "i1", 5, "X"), ("u2", "i2", 7, "X"), ("u3", "", 0, "X")]


def test_times_and_strictness(spark, tmp_path, rows):
    lines = ['{"user_id": "s", "item_id": "i", "timestamp": "1400000000"}', '{"user_id": "f", "item_id": "i", "timestamp": 1400000000.0}',
             '{"user_id": "h", "item_id": "i", "timestamp": 7.9}', '{"user_id": "n", "item_id": "i", "timestamp": "soon"}',
             "{'user_id': 'q', 'item_id': 'i'}", '{"user_id": "t", "item_id": "i"} and more', '{"user_id": "u"}, {"user_id": "v"}', "[1]", "{}}", '{"user_id": 5, "asin": 6}']
    p = tmp_path / "reviews.jsonl"
    p.write_text("\n".join(lines))
    assert rows(I.read_interactions(spark, str(p), "X"), "user_id", "ts") == [("5", 0), ("f", 1400000000), ("h", 7), ("s", 1400000000)]


def test_items(spark, tmp_path):
    lines = [
        {"asin": "a", "title": "first"}, {"item_id": "b", "description": ["x", "y"], "category": ["k", "l"], "brand": "br"},
        {"asin": "a", "title": "second", "categories": [["m", "n"], ["o"]], "description": "plain"}, {"asin": "c", "category": "single"},
    ]
    p = tmp_path / "meta.jsonl"
    p.write_text("\n".join(json.dumps(x) for x in lines) + "\nnope")
    got = {r.item_id: r for r in I.read_items(spark, str(p), "Y").collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].title, got["a"].category, got["a"].description) == ("second", ["m", "n", "o"], "plain")
    assert (got["b"].description, got["b"].category, got["b"].brand) == ("x y", ["k", "l"], "br")
    assert got["c"].category == ["single"] and got["c"].title == ""


def test_catalogue(spark, tmp_path, rows):
    x, y = tmp_path / "x.csv", tmp_path / "y.csv"
    x.write_text('idBefore,item_title,idAfter\nA1,"One, ""two""",0\nA2,Bad,n/a\nA3,"two\nlines",1\n')
    y.write_text("idBefore,item_title,idAfter,more\nB1,Three,2,extra\n")
    got = rows(I.read_catalogue(spark, {"X": str(x), "Y": str(y)}), "item_id", "title", "idx", "domain")
    assert got == [("A1", 'One, "two"', 0, "X"), ("A3", "two\nlines", 1, "X"), ("B1", "Three", 2, "Y")]


def test_packed_sequences(spark, tmp_path, rows):
    p = tmp_path / "train.txt"
    p.write_text("0\t3\t7|1|10\t9|2|20\t\t8|3|30\t\n1\t1\t4|1|5\tx|y\t6|2|6\t\n")
    ev = I.parse_packed(I.read_lines(spark, str(p)).drop("file"))
    assert rows(ev, "user_id", "item", "pos", "ts") == [("0", 7, 1, 10), ("0", 8, 3, 30), ("0", 9, 2, 20), ("1", 4, 1, 5), ("1", 6, 2, 6)]
    history, truth = I.split_ground_truth(ev)
    assert rows(truth, "user_id", "item") == [("0", 8), ("1", 4)] and history.count() == 3
    assert rows(I.last_as_truth(ev, 7), "user_id", "item", "flag") == [("0", 8, 1), ("1", 6, 0)]
    other = tmp_path / "other.txt"
    other.write_text("0\t7|1|10\t9|2|20\n")
    assert rows(I.parse_packed(I.read_lines(spark, str(other)), first_cell=2), "item") == [(7,), (9,)]


def test_response_tree(spark, tmp_path, rows):
    def entry(qqid, content):
        return {"id": "c", "model": "m", "qqid": qqid, "usage": {"n": 1},
                "choices": [{"index": 0, "message": {"role": "assistant", "content": content}, "finish_reason": "stop"}]}

    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "GM_exat_1.json").write_text(json.dumps([entry(1, "[1]"), entry(2, "")], indent=1))
    (tmp_path / "deep" / "er" / "GM_exat_2.json").write_text(json.dumps([entry(3, "x")]))
    (tmp_path / "deep" / "other.json").write_text(json.dumps([entry(9, "no")]))
    assert rows(I.read_responses(spark, str(tmp_path)), "qqid", "content") == [(1, "[1]"), (2, ""), (3, "x")]


def test_keyed_objects(spark, tmp_path, rows):
    p = tmp_path / "attributes.json"
    p.write_text(json.dumps({"a": {"intro": "i", "attributes": ["x", "y"]}, "b": {"intro": "", "attributes": []}}, indent=2))
    df = I.read_keyed(spark, str(p), "struct<intro:string,attributes:array<string>>")
    assert rows(df.select("id", "intro", F.size("attributes"))) == [("a", "i", 2), ("b", "", 0)]
    back = I.parse_keyed(I.to_keyed(df), "struct<intro:string,attributes:array<string>>")
    assert rows(back.select("id", "intro")) == [("a", "i"), ("b", "")]
    lists = tmp_path / "lists.json"
    lists.write_text(json.dumps({"u": ["a", "b"]}))
    assert rows(I.read_keyed(spark, str(lists), "array<string>").select("id", F.size("value"))) == [("u", 2)]


def test_matrix(spark, tmp_path):
    m = np.arange(12, dtype=np.float64).reshape(4, 3)
    np.save(tmp_path / "test_x.npy", m)
    got = I.read_matrix(spark, str(tmp_path / "test_x.npy")).orderBy("row").collect()
    assert [r.embedding for r in got] == m.tolist() and [r.row for r in got] == [0, 1, 2, 3]
    from crossloom.operators.sequences import every_second_row

    even = every_second_row(I.read_matrix(spark, str(tmp_path)), ["row"])
    assert sorted(r.row for r in even.collect()) == [0, 2]
    assert I.long_scores(I.read_matrix(spark, str(tmp_path))).count() == 12


def test_training_log(spark, tmp_path):
    log = {"log_history": [{"step": 1, "loss": 0.51239, "learning_rate": 1e-5, "epoch": 0.1}, {"step": 2, "eval_loss": 0.4}, {"step": 3, "loss": 0.3, "epoch": 0.2}],
           "best_metric": None, "global_step": 3}
    (tmp_path / "state.json").write_text(json.dumps(log, indent=1))
    entries, runs = I.read_training_logs(spark, str(tmp_path / "state.json"))
    assert [(r.step, r.loss) for r in R.training_curve(entries).orderBy("step").collect()] == [(1, 0.5124), (3, 0.3)]
    s = R.training_summary(entries, runs).first()
    assert (s.best_step, s.best_eval_loss, s.total_steps, s.final_loss) == (2, 0.4, 3, 0.3)


def test_answer_log(spark, tmp_path, rows):
    p = tmp_path / "answers.txt"
    p.write_text("0@@first\nline\n##@#\n1@@a@@b\n##@#\nbroken\n##@#\n")
    assert rows(I.read_answers(spark, str(p)), "idx", "answer") == [(0, "first\nline"), (1, "a@@b")]


def test_sinks(spark, tmp_path, rows):
    df = spark.createDataFrame([("train", 1), ("test", 2)], "split string, k int")
    O.write_tables({"splits": df, "plain": df}, str(tmp_path), {"splits": ["split"]})
    assert (tmp_path / "splits" / "split=train").is_dir()
    assert rows(spark.read.parquet(str(tmp_path / "splits")), "split", "k") == rows(df)
    O.write_table(df, str(tmp_path / "j"), fmt="json")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    O.append_answers(df, str(tmp_path / "plain"))
    assert spark.read.parquet(str(tmp_path / "plain")).count() == 4
