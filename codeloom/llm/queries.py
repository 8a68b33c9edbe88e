"""Queries of the training-data operators (problems tagged llm) and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import checkpoint
from ..tables import table
from . import distinctive, functions, mixing, personal, provenance, similar, syntax, tokenizer


def p3_found(spark, sf_dir):
    return similar.similar_pairs(table(spark, sf_dir, "search_vector"))


def p3_neighbours(spark, sf_dir):
    """The five most similar other ids of every valid id, however far they are."""
    found = similar.similar_vectors(table(spark, sf_dir, "search_vector"))
    return found.select("id", "other", F.round("similarity", 6).alias("similarity"))


def p3_search(spark, sf_dir):
    """Every id divisible by 50 as a query against all rows."""
    vectors = table(spark, sf_dir, "search_vector")
    number = F.try_to_number(F.regexp_extract("id", r"(\d+)$", 1), F.lit("999999999999999999"))
    index = checkpoint(similar.build_index(vectors))
    found = similar.search_index(index, vectors.where(number % 50 == 0))
    return found.select("id", "other", F.round("similarity", 6).alias("similarity"))


def p4_found(spark, sf_dir):
    return provenance.foreign_files(table(spark, sf_dir, "code_file"), table(spark, sf_dir, "file_text"))


def p4_scores(spark, sf_dir):
    return provenance.judge_files(table(spark, sf_dir, "code_file"), table(spark, sf_dir, "file_text"))


def p5_found(spark, sf_dir):
    return distinctive.top_terms(table(spark, sf_dir, "fts_entry"))


def p5_scores(spark, sf_dir):
    return distinctive.score_terms(table(spark, sf_dir, "fts_entry"))


def p5_elite(spark, sf_dir):
    """The term each entry is most surely about, by the fitted mixture alone."""
    return distinctive.elite_terms(table(spark, sf_dir, "fts_entry"))


def p6_found(spark, sf_dir):
    return syntax.invalid_files(table(spark, sf_dir, "code_file"), table(spark, sf_dir, "file_text")).select("file_id")


def p6_failures(spark, sf_dir):
    return syntax.invalid_files(table(spark, sf_dir, "code_file"), table(spark, sf_dir, "file_text"))


def p6_rates(spark, sf_dir):
    return syntax.syntax_rates(table(spark, sf_dir, "code_file"), table(spark, sf_dir, "file_text"))


def p7_found(spark, sf_dir):
    return functions.documented_methods(table(spark, sf_dir, "code_method"))


def p7_pairs(spark, sf_dir):
    return functions.method_pairs(table(spark, sf_dir, "code_method"))


def p7_file_functions(spark, sf_dir):
    return functions.file_pairs(table(spark, sf_dir, "code_file"), table(spark, sf_dir, "file_text"))


def p8_ids(spark, sf_dir):
    return tokenizer.encode_texts(table(spark, sf_dir, "documents"))


def p8_round_trip(spark, sf_dir):
    return tokenizer.round_trip(table(spark, sf_dir, "documents"))


def p9_mix(spark, sf_dir):
    return mixing.mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[0]


def p9_shares(spark, sf_dir):
    targets = table(spark, sf_dir, "mix_target")
    return mixing.mix_shares(*mixing.mix_documents(table(spark, sf_dir, "documents"), targets), targets)


def _personal(spark, sf_dir):
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "known_name")


def _key(spark) -> str | None:
    return spark.conf.get("codeloom.redaction.key", None)


def p10_found(spark, sf_dir):
    return personal.personal_cases(*_personal(spark, sf_dir))


def p10_redacted(spark, sf_dir):
    return personal.redact_documents(*_personal(spark, sf_dir), _key(spark))


def p10_surrogates(spark, sf_dir):
    return personal.redact_documents(*_personal(spark, sf_dir), _key(spark), "surrogate")


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_neighbours, p3_search, p4_found, p4_scores, p5_found, p5_scores, p5_elite, p6_found, p6_failures, p6_rates, p7_found, p7_pairs, p7_file_functions,
        p8_ids, p8_round_trip, p9_mix, p9_shares, p10_found, p10_redacted, p10_surrogates,
    )
}

_TERMS = """WITH once AS (SELECT id, max(tokens) AS tokens FROM fts_entry WHERE id IS NOT NULL AND tokens IS NOT NULL GROUP BY id),
cnt AS (SELECT id, term, count(*) AS c FROM (SELECT id, lower(trim(unnest(tokens))) AS term FROM once) WHERE term <> '' GROUP BY ALL),
df AS (SELECT term, count(*) AS d FROM cnt GROUP BY term)"""

ORACLES: dict[str, str] = {
    "p5_found": _TERMS + """
SELECT id, term FROM (SELECT id, cnt.term, row_number() OVER (PARTITION BY id ORDER BY c * log2(((SELECT count(*) FROM once) + 1) / d) DESC, cnt.term) AS rn
  FROM cnt JOIN df USING (term) WHERE d >= 2) WHERE rn = 1""",
}
