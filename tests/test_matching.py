import xxhash
from pyspark.sql import functions as F

from turnlake import registry
from turnlake.functions import matching as M


def test_short_hash(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.hash for r in registry.queries()["fn1_short_hash"](spark, sf_dir).collect()}
    assert got == {k: xxhash.xxh64_hexdigest(t.encode()) for k, t in texts.items()}


def test_answers_after_failures(spark):
    def complete(system, prompt):
        if prompt == "never":
            raise OSError("down")
        return f"{system}: {prompt}"

    df = spark.createDataFrame([("s", "a"), ("s", "never")], "system string, prompt string")
    got = {r.prompt: r.answer for r in M.ask(df, "system", "prompt", complete, wait=0.01).collect()}
    assert got == {"a": "s: a", "never": None}


def test_patterns_and_placeholders(spark):
    one = spark.range(1)
    a = lambda *x: F.array(*map(F.lit, x))
    cases = [(M.matches_run(a("Read", "Exec"), a("x", "Read(f)", "Exec(ls)")), True), (M.matches_run(a("Read", "Exec"), a("Read(f)", "no", "Exec")), False), (M.matches_run(a("a", "b"), a("a")), False)]
    cases += [(M.only_tokens_differ(F.lit(o), F.lit(n)), w) for o, n, w in [("my key is K", "my key is [[0000abcd]]", True), ("my key is K", "my key is K", False), ("my key is K", "your key [[0000abcd]]", False)]]
    cases += [(M.mentions_path(F.lit(p), F.lit(t)), w) for p, t, w in [("/a/b", "cat /a/b", True), ("/a/b", "cat /a/bc", False), ("/a/b", r"del \a\b\c", True), ("", "x", False)]]
    got = one.select(*[c.alias(f"c{k}") for k, (c, _) in enumerate(cases)]).first()
    assert list(got) == [w for _, w in cases]
