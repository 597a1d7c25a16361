from pyspark.sql import functions as F

from turnlake.functions import bodies, text
from turnlake.operators import sequences


def loop_edges(kinds):
    """The graph rule as a plain loop over (kind, audit)."""
    root = chain = dec = act = up = None
    before, out = ("", ""), []
    for n, (k, a) in enumerate(kinds):
        first = lambda *x: next((v for v in x if v is not None), None)
        if k in ("goal", "sub_goal"):
            p, label = (root if k == "sub_goal" else None), "sub-goal"
            root = chain = n
            dec = act = up = None
        elif k == "decision":
            p, label = first(act, dec, chain), "decides"
            dec = chain = n
            act = None
        elif k == "action":
            if before == ("action", a):
                p, label = up, "acts"
            else:
                p, label = first(dec, chain, act), "executes" if dec is not None else "acts"
            act, up = n, p
        elif k == "observation":
            p, label = first(act, chain), "observes"
            chain, dec, up = n, None, None
        elif k == "state_transition":
            p, label = first(act, chain), "enters"
            chain = n
        else:
            p, label = first(chain, act, dec), "results in" if k == "result" else "reflects"
            chain, dec = n, None
        before = (k, a)
        if p is not None and p != n:
            out.append((n, p, label))
    return out


def test_graph_edges(spark):
    import random

    r = random.Random(3)
    kinds = ["goal", "sub_goal", "decision", "action", "action", "observation", "result", "reflection", "state_transition"]
    cases = [[("goal", "a"), *[(r.choice(kinds), r.choice("ab")) for _ in range(12)]] for _ in range(12)]
    rows = [(c, i, k, a) for c, case in enumerate(cases) for i, (k, a) in enumerate(case)]
    got = sequences.graph_edges(spark.createDataFrame(rows, "c int, seq int, kind string, audit string"), ["c"], "seq", "kind", "audit").collect()
    for c, case in enumerate(cases):
        assert sorted((x.node, x.parent, x.label) for x in got if x.c == c) == sorted(loop_edges(case))


def test_token_batches(spark):
    df = spark.createDataFrame([(0, i, c) for i, c in enumerate([60, 50, 10, 120, 5])], "k int, seq long, cost long")
    assert [r.batch for r in sequences.token_batches(df, ["k"], "seq", "cost", 100).orderBy("seq").collect()] == [0, 1, 1, 2, 3]


def test_ranges_touching_and_apart(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 11, 12), (1, 1, 2)], "k int, s int, e int")
    assert [(r.s, r.e) for r in sequences.merge_ranges(df, ["k"]).orderBy("s").collect()] == [(0, 9), (11, 12)]


def test_sse_round_trip(spark):
    texts = ["", "a", "x" * 700, 'quote " and \\ and é\nline']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(bodies.sse_text(bodies.to_sse(F.col("t")))).collect()] == texts


def test_paths_masks_keywords(spark):
    df = spark.createDataFrame([("C:\\a\\\\b\\", "Ab9某!"), ("//s/x//y/", ""), ("/", "ñ"), ("a", "かカー한 Жω ไع ×!")], "p string, t string")
    got = df.select(text.clean_path(F.col("p")).alias("p"), text.mask(F.col("t")).alias("m")).collect()
    assert [r.p for r in got] == ["C:/a/b", "//s/x/y", "/", "a"] and [r.m for r in got] == ["Xx7某!", "", "é", "某某某某 жж กก é!"]
    k = spark.createDataFrame([("新任务开始 Fix the BUG",)], "t string").select(text.keywords(F.col("t"))).first()[0]
    assert set(k) >= {"fix", "the", "bug", "任务"}
