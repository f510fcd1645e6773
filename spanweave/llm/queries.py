"""The registered queries of this subpackage: each runs its operator over whole tables with production parameters."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import decontam, grading, langid, mixing, near_copies, pii, rules, secret_scan, site_tree, store, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_json() -> str:
    import public_tokenizers

    return Path(public_tokenizers.path("word_bpe_49k.json")).read_text()


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "token-files")
    tokens.write_ids(_table(spark, sf_dir, "documents"), path, tokenizer_json())
    return tokens.read_ids(spark, path)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return grading.grade_documents(docs, grading.train(docs, grading.graded(_table(spark, sf_dir, "labels"))))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.main_texts(_table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.label_domains(_table(spark, sf_dir, "labels"))
    return mixing.document_rates(_table(spark, sf_dir, "documents"), labelled)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(_table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op10_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(_table(spark, sf_dir, "documents"), n=4, num=85)


def base_of_op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_of_op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def base_of_op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def base_of_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_near_copies(spark, sf_dir).select("doc_id", "n_shingles")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_token_files": op2_token_files,
    "op3_quality_rules": op3_quality_rules,
    "op4_language": op4_language,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_html": op6_html,
    "op7_mixing": op7_mixing,
    "op8_secrets": op8_secrets,
    "op9_personal_data": op9_personal_data,
    "op10_near_copies": op10_near_copies,
    # What SQL can express of some of these, through the same operators.
    "base_of_op3": base_of_op3,
    "base_of_op8": base_of_op8,
    "base_of_op9": base_of_op9,
    "base_of_op10": base_of_op10,
}


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_ASSIGN = f"({'|'.join(map(_any_case, ('password', 'passwd', 'secret', 'token')))}|{_any_case('api')}_?{_any_case('key')})" + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_FOUND = "len(list_filter({0}, lambda m: {1}))"
_ALL = "regexp_extract_all(coalesce(text, ''), '{0}'{1})"
_OCTETS = "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 and coalesce(try_cast(right('0' || p, 4) AS INTEGER), 0) <= 255))"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({_DIGITS}), i, 1)::INT ELSE (2 * substr(reverse({_DIGITS}), i, 1)::INT) % 10 + (2 * substr(reverse({_DIGITS}), i, 1)::INT) // 10 END)) % 10 = 0"

#: SQL for DuckDB of the queries that it can express.
ORACLE_SQL: dict[str, str] = {
    "base_of_op3": f"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, {_WORDS.format("text")} AS w FROM t),
        n AS (SELECT *, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
        lines AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
        windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
        twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
        covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(3) AS o(k) GROUP BY r)
        SELECT doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
            coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
        FROM n LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)""",
    "base_of_op8": f"""
        SELECT doc_id, {_FOUND.format(_ALL.format(_ASSIGN, ", 2"), "length(m) >= 12")}::BIGINT AS n_assign,
            {_FOUND.format(_ALL.format("AKIA[A-Z0-9]+", ""), "length(m) >= 18")}::BIGINT AS n_access,
            {_FOUND.format(_ALL.format("[0-9a-f]+", ""), "length(m) >= 16")}::BIGINT AS n_hex FROM documents""",
    "base_of_op9": f"""
        SELECT doc_id, len({_ALL.format(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "")})::BIGINT AS n_email,
            {_FOUND.format(_ALL.format(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", ""), _OCTETS)}::BIGINT AS n_ip,
            {_FOUND.format(_ALL.format("[0-9]([ -]?[0-9])+", ""), f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}")}::BIGINT AS n_card,
            {_FOUND.format(_ALL.format(r"\+[0-9][ ().0-9-]+[0-9]", ""), f"length({_DIGITS}) BETWEEN 10 AND 15")}::BIGINT AS n_phone FROM documents""",
    "base_of_op10": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents)
        SELECT doc_id, CASE WHEN len(w) < 4 THEN least(len(w), 1) ELSE len(list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))) END::BIGINT AS n_shingles FROM w""",
}
