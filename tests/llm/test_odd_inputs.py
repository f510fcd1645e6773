"""Cases that no clean table shows: names that clash, repeated rows, hashes that could collide, empty tables."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from spanweave.llm import decontam, grading, langid, mixing, pii, queries, rules, secret_scan, store, tokens
from spanweave.llm.bytescan import Texts, same_spans, span_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def regular(depth):
    """Two different self-similar words of the same length."""
    a = "a"
    for _ in range(depth):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_hashes_of_regular_words_differ():
    words = [w for depth in range(12) for w in regular(depth)] + ["ab" * k for k in range(1, 400)] + ["ba" * k for k in range(1, 400)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    hashes = span_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(words))
    order = np.random.default_rng(1).permutation(len(words))
    assert same_spans(data, starts, ends, data, starts, ends)
    assert not same_spans(data, starts, ends, data, starts[order], ends[order])
    near = data.copy()
    near[ends[-1] - 1] ^= 1
    assert not same_spans(data, starts, ends, near, starts, ends)


def test_ids_of_regular_words_are_the_tokenizers(monkeypatch):
    enc = tokens.WordEncoder(queries.tokenizer_json())
    texts = pa.array([" ".join(regular(10)), "Don't STOP!! (now) \"x\"", "", "abc " * 50 + regular(10)[1]], pa.large_string())
    want = enc.plain(texts, 1)
    got = enc.encode(texts)
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    # Even if many words share a hash.
    monkeypatch.setattr(Texts, "hashes", lambda self, starts, ends: span_hashes(self.data, starts, ends) % np.uint64(8))
    for again in (False, True):
        if not again:
            enc.clear()
        got = enc.encode(texts)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
        assert np.array_equal(enc.counts(texts), np.bincount(want[0], minlength=2))


def test_different_lines_of_regular_letters_are_no_repeats(spark):
    a, b = regular(10)
    got = rules.quality_rules(spark.createDataFrame([(1, f"{a}\n{b}"), (2, f"{a}\n{a}")], "doc_id long, text string"))
    assert {r.doc_id: r.n_dup_lines for r in got.collect()} == {1: 0, 2: 1}


def test_rows_of_one_doc_id_keep_the_stated_order(spark, tmp_path):
    rows = [(5, w * n) for n in range(30, 0, -1) for w in ("ab ", "ba ")] + [(None, "x"), (None, None), (7, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens.write_ids(docs, str(tmp_path / "ids"), queries.tokenizer_json(), shards=5)
    got = [r for r in tokens.read_ids(spark, str(tmp_path / "ids")).orderBy("start").collect()]
    assert [r.doc_id for r in got] == [None, None] + [5] * 60 + [7]
    sizes = [r.n_tokens for r in got[2:-1]]
    assert sizes == sorted(sizes) and [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


def test_texts_without_letters_have_no_language(spark):
    rows = [(i, t, "en") for i, t in enumerate(["²", "½ Ⅷ ①", "12_3", None, "é", "ß1", "中", "the cat"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.train(docs)).collect()}
    assert [got[i] for i in range(8)] == ["und"] * 4 + ["en"] * 4


def test_helper_columns_take_free_names(spark):
    docs = spark.createDataFrame([(i, f"the good word number {'x' * i}", "en", "s", 1, "mine", "keep", 7) for i in range(20)], DOCS + ", _lang_pred string, _kept string, _leaks int")
    out = corpus_pipeline.language(spark, docs, "")
    assert out.columns == docs.columns and {r._lang_pred for r in out.collect()} == {"mine"}
    some = spark.createDataFrame([(1, "q1t0"), (3, "q0t0")], "doc_id long, domain string")
    out = mixing.sample(docs, some)
    assert out.columns == docs.columns and {r._kept for r in out.collect()} <= {"keep"}


def test_near_copy_stage_keeps_one_row_of_a_group(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(4, text, "en", "a", 1), (4, text, "en", "a", 1), (9, text.upper(), "en", "a", 1), (2, "alone " + text[::-1], "en", "b", 2), (None, "x", "en", "c", 3), (None, "x", "en", "c", 3), (6, "", "en", "d", 0), (6, None, "en", "d", 0)]
    out = corpus_pipeline.near_copy_groups(spark, spark.createDataFrame(rows, DOCS), "")
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(str(r.doc_id) for r in out.collect()) == ["2", "4", "6", "None", "None"]


@pytest.mark.parametrize("stage", [x for _, x in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, stage):
    assert stage(spark, spark.createDataFrame([], DOCS), "/root/testdata/sf0.001").count() == 0


@pytest.mark.parametrize("text", ["7" * 300_000, "1." * 150_000, "1.2.3." + "0" * 300_000, "a" * 300_000 + "%", "\\" + "Ab1" * 100_000, "a@" * 150_000, "+1" + " (" * 150_000, "%41" * 100_000, "x " * 200_000, "- " * 200_000])
def test_long_unbroken_texts(text):
    """Linear in the length: far below a second each, or this takes hours."""
    pii.base_spans(text)
    secret_scan.scan(text)
    assert pii.base_spans("1.2.3." + "0" * 5000) == [("ip", 0, 5006)]


def test_addresses_of_four_parts_as_the_plain_pattern_has_them():
    import random
    import re

    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("01259...  x") for _ in range(rng.randrange(40)))
        want = [("ip", *m.span()) for m in plain.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [s for s in pii.base_spans(text) if s[0] == "ip"] == want


def test_empty_tables_and_clashing_columns(spark):
    schema = DOCS + ", kept string, spans string, base string, _leaks string, score string, n_words int"
    rows = [(1, "good words here", "en", "s", 1, *"abcde", 2), (1, "good words here", "en", "s", 1, *"abcde", 2), (2, None, None, None, None, None, None, None, None, None, None), (3, "", "en", "s", 1, *"abcde", 2)]
    items = spark.createDataFrame([(1, "good words"), (2, None)], "item_id long, text string")
    for data, n in (([], 0), (rows, 4)):
        docs = spark.createDataFrame(data, schema)
        assert rules.quality_rules(docs).count() == n
        assert secret_scan.secrets(docs).count() == n
        assert pii.personal_data(docs).count() == n
        assert langid.identify(docs, langid.train(docs)).count() == n
        model = grading.train(docs, spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, grade int"))
        assert grading.grade_documents(docs, model).count() == n
        assert decontam.leaks(docs, items).count() == n // 2
        kept = decontam.clean(docs, items)
        assert kept.columns == docs.columns and kept.count() == n // 2


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_hand_their_workers_small_batches(spark, stage):
    own = spark.newSession()
    stage(own, own.createDataFrame([], DOCS), "/root/testdata/sf0.001")
    docs = own.range(24, numPartitions=1).selectExpr("id AS doc_id", "repeat('abcdefgh', 1 << 17) AS text")

    def work(batch, texts):  # a slice knows the buffer of the batch that it is of
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([texts.buffers()[2].size] * len(texts))], ["doc_id", "held"])

    rows = store.map_slices(docs, "text", work, "doc_id long, held long").collect()
    assert sorted(r.doc_id for r in rows) == list(range(24))
    assert max(r.held for r in rows) <= 6 << 20
