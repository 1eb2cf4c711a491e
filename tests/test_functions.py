import json

import pytest
from pyspark.sql import functions as F

from gateledger.functions import answers, diffs, replies, text
from gateledger.operators import filters
from gateledger.schemas import CLOSEOUT, DECISIONS

DIFF8 = "+++ b/x\n--- a/x\n" + "+a\n" * 5 + "-b\n" * 3


def one(spark, value, build, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "files, diff, trivial, reason",
    [
        ([], "+x", True, "no files changed"),
        (None, "+x", True, "no files changed"),
        (["a.md", "docs/x.ts", ".github/w.yml", "yarn.lock"], DIFF8, True, "only docs/lockfile/generated files"),
        (["src/changelogService.ts"], "+x\n" * 20, True, "only docs/lockfile/generated files"),
        (["requirements.txt"], "+x\n" * 20, True, "only docs/lockfile/generated files"),
        (["web/dist/a.js", "a.min.CSS", "x.snap"], "+x\n" * 20, True, "only docs/lockfile/generated files"),
        (["x/docs/a.ts"], "+x\n" * 9, False, "1 substantive file(s), 9 changed lines"),
        (["a.md\n"], "+x\n" * 9, False, "1 substantive file(s), 9 changed lines"),
        (["a.ts"], DIFF8, True, "tiny change (8 lines)"),
        (["a.ts", "b.md", "c.py"], DIFF8 + "+c", False, "2 substantive file(s), 9 changed lines"),
        (["a.ts"], "+x\n" * 8 + "+++i\n---j\n", True, "tiny change (8 lines)"),
        (["a.ts"], "+x\r+y\n" * 8, True, "tiny change (8 lines)"),
        (["a.ts"], None, True, "tiny change (0 lines)"),
    ],
)
def test_classify(spark, files, diff, trivial, reason):
    df = spark.createDataFrame([(files, diff)], "files array<string>, diff string")
    row = filters.classify_prs(df).first()
    assert (row.trivial, row.reason) == (trivial, reason)


def test_changed_lines_count_like_a_split(spark):
    texts = ["", "+", "-", "+++", "---", "++", "a\n+b\n\n-c\n", "+a\n+++b\n+++", "\n+", "+ +x"]
    df = spark.createDataFrame([(t,) for t in texts], "diff string")
    for row in filters.changed_lines(df).collect():
        lines = row.diff.split("\n")
        assert row.added == sum(x.startswith("+") and not x.startswith("+++") for x in lines)
        assert row.removed == sum(x.startswith("-") and not x.startswith("---") for x in lines)


def test_trim_and_length_follow_javascript(spark):
    assert one(spark, "\n\t ﻿ a b  \n", text.js_trim) == "a b"
    assert one(spark, "\x85a", text.js_trim) == "\x85a"  # not white space in JavaScript
    assert one(spark, "a🌊", text.js_length) == 3


@pytest.mark.parametrize("value, n, want", [("abc", 5, "abc"), ("abcdef", 3, "abc"), ("ab🌊c", 3, "ab"), ("ab🌊c", 4, "ab🌊"), ("éééé", 2, "éé")])
def test_clip(spark, value, n, want):
    assert one(spark, value, lambda c: text.clip(c, n)) == want


@pytest.mark.parametrize("seed", ["", "whole", "a|b^", "naïve", "wave 🌊 here", "x" * 300])
def test_pick_index(spark, seed):
    units = seed.encode("utf-16-be")
    h = 0
    for i in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[i : i + 2], "big")) % 2**32
    assert one(spark, seed, lambda c: text.pick_index(c, 5)) == h % 5


def test_small_texts(spark):
    assert one(spark, "[]", text.hash16) == "4f53cda18c2baa0c"
    assert one(spark, " A — B–C ,d ", text.no_dash) == "A, B, C,d"
    assert one(spark, "--rate_limit-key  x_", text.humanize) == "rate limit key x"
    assert tuple(one(spark, "o/r/extra", text.split_full_name)) == ("o", "r")
    assert tuple(one(spark, "o", text.split_full_name)) == ("o", None)


def test_decision_texts(spark):
    rows = [([("a-b", "s1", " q? "), ("c_d", "s/2", "  ")],), ([],), (None,)]
    df = spark.createDataFrame(rows, f"d {DECISIONS}")
    got = df.select(
        text.decisions_hash(F.col("d")).alias("h"),
        text.ground_truth(F.col("d")).alias("t"),
        F.transform("d", text.ask_for).alias("asks"),
    ).collect()
    import hashlib

    packed = '[{"concept":"a-b","summary":"s1","question":" q? "},{"concept":"c_d","summary":"s/2","question":"  "}]'
    assert got[0].h == hashlib.sha256(packed.encode()).hexdigest()[:16]
    assert got[1].h == got[2].h == "4f53cda18c2baa0c"
    assert [r.t for r in got] == ["1. a-b: s1\n\n2. c_d: s/2", "", ""]
    assert got[0].asks == ["q?", "the c d: how it works and why"]


TOPIC = {"concept": "c", "verdict": "strong", "note": "n"}


@pytest.mark.parametrize(
    "raw, want",
    [
        ('x ```json\n{"topics": [%s]}\n``` {y}' % json.dumps(TOPIC), [("c", "strong", "n")]),
        ("```\n%s\n```" % json.dumps({"topics": [TOPIC]}), [("c", "strong", "n")]),
        ("chat %s chat" % json.dumps({"topics": [TOPIC]}), [("c", "strong", "n")]),
        ("} {", None),
        ("no braces", None),
        ("", None),
        (None, None),
        ("{'topics': [{'concept': 'c'}]}", None),
        ('{"topics": "c"}', None),
        ('{"topics": []}', None),
        ('{"topics": [{"concept": ""}, {"concept": false}, null, "c", 3]}', None),
        ('{"topics": [{"concept": 12, "verdict": "great", "note": false}]}', [("12", "solid", "")]),
        ('{"topics": [{"concept": true, "verdict": 1, "note": {"a": 1}}]}', [("true", "solid", "[object Object]")]),
        ('{"topics": [{"concept": ["a", "b"], "verdict": null, "note": 0}]}', [("a,b", "solid", "")]),
        ('{"topics": 1, "topics": [{"concept": "a", "concept": "b"}]}', [("b", "solid", "")]),
        ('{"topics": [{"concept": "%s", "note": "%s"}]}' % ("k" * 130, "n" * 250), [("k" * 120, "solid", "n" * 240)]),
    ],
)
def test_normalise_closeout(spark, raw, want):
    got = one(spark, raw, answers.normalise_closeout)
    assert (None if got is None else [tuple(t) for t in got.topics]) == want
    if got is not None:
        assert got.strongest == "" and got.growth_edge == "" and got.one_line == ""


def test_replies(spark):
    df = spark.createDataFrame(
        [([("rate-limit", "s", "Why — so?")], "h — ole", "me", (None, "s — t", "", "done")), ([], "", "me", None)],
        f"d {DECISIONS}, hole string, login string, c {CLOSEOUT}",
    )
    got = df.select(
        replies.elicit_body(F.col("d")).alias("elicit"),
        replies.rescue_body(F.col("hole")).alias("rescue"),
        replies.pass_body(F.col("login"), F.col("c")).alias("passed"),
    ).collect()
    assert "- Why, so?" in got[0].elicit and any(x in got[0].elicit for x in replies.PLAIN.openings)
    assert not any(x in got[1].elicit for x in replies.PLAIN.lead_ins)
    assert "h, ole" in got[0].rescue
    assert "s, t" in got[0].passed and "done" in got[0].passed and "Go deeper" not in got[0].passed
    assert got[1].passed.count("\n\n") == 1


def test_path_patterns_are_caseless(spark):
    assert one(spark, "A/LICENSE.old", diffs.is_trivial_path)
    assert one(spark, "x/Poetry.LOCK", diffs.is_trivial_path)
    assert one(spark, "a/Vendor/b.go", diffs.is_generated_path)
    assert not one(spark, "a/vendored/b.go", diffs.is_generated_path)


def test_text_of_json_values_as_javascript_has_it(spark):
    cases = {
        "1e3": "1000", "1e21": "1e+21", "1.5e-7": "1.5e-7", "123456789.5": "123456789.5", "12": "12", "1.50": "1.5", "0": "", "-0.0": "",
        "[null,[1,2],3]": ",1,2,3", '[{"a":1}]': "[object Object]", "[[[1e3]]]": "1000", "[true,false]": "true,false", "[]": "",
        "[" * 10 + '1,"a,[b]\\n",[],{"x":[2,{"y":"}"}]},-2.50' + "]" * 10: "1,a,[b]\n,,[object Object],-2.5",
        "true": "true", "false": "", "null": "", '{"a":1}': "[object Object]", '"x"': "x",
    }
    df = spark.createDataFrame(list(cases), "string")
    assert {r.value: r.t for r in df.select("value", answers.js_text(F.parse_json("value")).alias("t")).collect()} == cases


def test_many_source_ngrams_are_hashed_not_sorted(spark, monkeypatch):
    from gateledger.operators import overlap

    told = spark.createDataFrame([(i, " ".join(f"w{(i + j) % 30}" for j in range(12))) for i in range(40)], "id int, explanation string")
    sources = spark.createDataFrame([(" ".join(f"w{j}" for j in range(9)),), (None,)], "source string")
    few = sorted(overlap.overlap_band(told, sources).collect())
    assert {r.overlap for r in few} == {"low", "medium", "high"}
    monkeypatch.setattr(overlap, "FEW_NGRAMS", 0)
    many = overlap.overlap_band(told, sources)
    assert "ShuffledHashJoin" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(many.collect()) == few
