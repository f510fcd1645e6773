"""Display of literals against plain Python."""

import json

from pyspark.sql import functions as F

from spanweave.functions import literals


def test_truncated_cuts_between_characters(spark):
    texts = ["", "abc", "añb", "€€", "a𝄞b", "ééé", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in range(8):
        got = [r[0] for r in rows.select(literals.truncated(F.col("t"), most)).collect()]
        want = [t if t is None or len(t.encode()) <= most else t.encode()[:most].decode(errors="ignore") + "…" for t in texts]
        assert got == want


def test_quoted_is_json_without_controls(spark):
    texts = ["", "plain é", 'a"b\\c', "".join(map(chr, range(33))) + "\x7f", "\\n\n", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(literals.quoted(F.col("t"))).collect()]
    want = [None if t is None else json.dumps(t, ensure_ascii=False).replace("\x7f", "\\u007f") for t in texts]
    assert got == want


def test_colour_of_unknown_kinds_is_empty(spark):
    rows = spark.createDataFrame([("keyword",), ("recovery",), ("odd",), (None,)], "k string")
    assert [r[0] for r in rows.select(literals.colour(F.col("k"))).collect()] == ["\x1b[1;34m", "", "", None]
