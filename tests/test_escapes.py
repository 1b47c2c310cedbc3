import json

import pytest
from pyspark.sql import functions as F

from faultline.functions.fingerprints import canonical_json

TEXTS = ["é", "\\" * 60 + "é", "\\" * 61 + "É ü", "\\u00E9", "\\\\u00E9 é", "a\n\\é\"", "\U0001f600 \\" * 30, ""]


@pytest.mark.parametrize("text", TEXTS)
def test_escapes_behind_backslashes(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(canonical_json(a=F.col("t")).alias("j")).first()
    assert row["j"] == json.dumps({"a": text}, separators=(",", ":"))
