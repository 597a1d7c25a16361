"""Secrets are found and masked in whole texts."""

import re

from turnlake import registry
from turnlake.functions import text as T

ADDED = [" sk-" + "a1" * 12, " AKIA" + "Z9" * 8, " ghp_" + "q" * 25, ""]


def test_whole_texts(spark, sf_dir, tmp_path):
    late = "word " * 100 + "sk-" + "b2" * 12 + " tail " * 50
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spark.createDataFrame([(3, late), (7, "nothing here")], "doc_id long, text string").union(given.where("doc_id > 7")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    got = {r.doc_id: (r.redacted, r.hit) for r in registry.queries()["fn24_preset_secrets"](spark, str(tmp_path)).collect()}
    secret = re.compile("|".join(T.PRESETS), re.ASCII)
    for r in rows:
        t = r.text + ADDED[r.doc_id % 4]
        assert got[r.doc_id] == (secret.sub("[secret]", t), bool(secret.search(t)))
    assert got[3] == ("word " * 100 + "[secret]" + " tail " * 50, True) and not got[7][1]
