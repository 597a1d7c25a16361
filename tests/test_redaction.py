"""Masked ranges against a plain version, and the order of the request scan."""

from pyspark.sql import functions as F

from turnlake.operators import redaction

SECRET = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(90))


def test_request(spark):
    loose = " ".join(SECRET[k : k + 9] for k in range(0, 90, 9))
    rows = [(1, f"é, {loose}; 😀 Z9", True, False), (2, f"out {SECRET}", True, True), (3, f"said {SECRET}", False, False), (4, f"sk1 {SECRET}", True, True), (5, None, True, False), (6, SECRET[:40], True, False), (7, f"{SECRET}!{'x1 ' * 40}{SECRET[:70]}", True, False)]
    fields = spark.createDataFrame(rows, "k long, text string, model_input boolean, tool_result boolean")
    corpus = spark.createDataFrame([(0, SECRET)], "i long, text string")
    got = {r.k: (r.way, r.text) for r in redaction.scan_request(fields, "k", "sk1", corpus, "i", "BLOCK").collect()}
    assert got == {
        1: ("file", f"é, {' '.join(['x' * 9] * 10)}; 😀 Z9"), 2: ("file", "BLOCK"), 4: ("content", f"[secret] {SECRET}"),
        7: ("file", f"{'x' * 90}!{'x1 ' * 40}{'x' * 70}"),
    }


def test_masked_ranges(spark):
    df = spark.createDataFrame([("a-b-c-d e", [(1, 3), (4, 5)]), ("ab", []), ("", []), ("😀a😀b", [(0, 2)])], "t string, r array<struct<s:int,e:int>>")
    assert [r.m for r in df.select(redaction.mask_ranges(F.col("t"), F.col("r")).alias("m")).collect()] == ["a-x-x-d x", "ab", "", "😀x😀x"]


def test_response(spark):
    rows = [(1, "s", "[[0000000a]][[0000000b]]", True), (2, "t", "[[0000000a]]", True), (3, "s", "k [[0000000a]]", False), (4, "s", None, True), (5, "s", "none", True)]
    fields = spark.createDataFrame(rows, "k int, s string, text string, tool_related boolean")
    vault = spark.createDataFrame([("s", "[[0000000a]]", "[[0000000b]]"), ("s", "[[0000000b]]", "$1")], "session string, token string, secret string")
    got = {r.k: r.text for r in redaction.scan_response(fields, "k", "s", vault, "k").collect()}
    assert got == {1: "[[0000000b]]$1", 2: "[[0000000a]]", 3: "[secret] [[0000000a]]", 4: None, 5: "none"}
