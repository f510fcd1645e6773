"""Token files: every text is encoded once, its ids lie in the shared folder until they have a code."""

from pathlib import Path

import numpy as np
import pytest

from spanweave.llm import queries, store, tokens


@pytest.mark.parametrize("top", [0, 65535, 65536])
def test_ids_are_packed_without_loss(top):
    ids = np.array([1, top, 0, 7], np.uint32)
    raw = tokens._packed(ids)
    assert len(raw) == (16 if top > 65535 else 8) and tokens._unpacked(raw, 4).tolist() == ids.tolist()
    assert tokens._unpacked(tokens._packed(ids[:0]), 0).tolist() == []


def test_every_text_is_encoded_once(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words {i} of text") for i in range(40)] + [(None, None)], "doc_id long, text string")
    passes, files = [], []
    encode, drop = tokens.encoded_ids, store.drop
    monkeypatch.setattr(tokens, "encoded_ids", lambda *a: passes.append(a) or encode(*a))
    monkeypatch.setattr(store, "drop", lambda df: files.extend(df.inputFiles()) or drop(df))
    counted = []
    count = tokens.count_ids
    monkeypatch.setattr(tokens, "count_ids", lambda df: counted.append(df.columns) or count(df))
    tokens.write_ids(docs, str(tmp_path / "t"), queries.tokenizer_json(), shards=3)
    assert len(passes) == 1 and counted == [["shard", "before", "doc_ids", "n_ids", "ids"]]
    assert files and not any(Path(f.removeprefix("file://")).exists() for f in files)
    got = tokens.read_ids(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, *range(40)] and got[0].n_tokens == 1
