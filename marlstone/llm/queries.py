"""The registered queries of this subpackage and, where SQL can express them, the same as DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe_words, chat_format, exact_digest, hidden_markov, jaccard_groups, language_id, packing, quality_rules, site_style, stable_projections, suffix_sigma, token_files, tokens, whitening
from marlstone.llm.common import crc_mod, read_table, stored
from marlstone.sources.tables import checkpoint_dir


#: The end-of-document id: of <|endoftext|> in the public vocabulary, which no text encodes to.
END_ID = 50256


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids need 16 bits. The files stay in the shared folder, as the result reads them."""
    path = f"{checkpoint_dir(spark)}/token_files-{uuid.uuid4().hex}"
    return token_files.counted(read_table(spark, sf_dir, "documents"), path, end_id=END_ID, width=2, **tokens.public_codec())


def op2_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extracted(read_table(spark, sf_dir, "pages"), stored)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text")
    )
    turns = chat_format.canonical(chat_format.turn_records(rows.unionByName(extra)))
    read = chat_format.parsed(chat_format.formatted(turns))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)' AS p FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), p, '\1\\\2\3', 'g')) + 1
    + length(regexp_replace(text, p, '\1\\\2\3', 'g')) + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(read_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 4]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM g WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        length(regexp_replace(text, '\P{Lu}+', '', 'g'))::BIGINT AS n_upper, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
        + CASE WHEN 2 * n_upper > word_chars THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two policies on one stored ledger: what each of their rules rejects, and what it alone does."""
    entries = stored(quality_rules.ledger(read_table(spark, sf_dir, "documents")).select("fail_bits"), "ledger")
    return quality_rules.ablation(entries, quality_rules.BASE).unionByName(quality_rules.ablation(entries, quality_rules.STRICT))


#: Names of the rules by bit.
RULE_NAMES = "few_words repeated_windows symbols duplicate_lines short_words long_words upper_case".split()
ABLATION_SQL = f"""
WITH l AS (SELECT fail_bits FROM ({OP4_SQL})), p(policy, version, mask) AS (VALUES ('base', 1, 3::BIGINT), ('strict', 1, 127::BIGINT)),
r(bit, rule) AS (VALUES {", ".join(f"({k}, '{name}')" for k, name in enumerate(RULE_NAMES))})
SELECT policy, version, bit, rule, count(*) FILTER (WHERE (fail_bits & (1::BIGINT << bit)) <> 0)::BIGINT AS n_failed, count(*) FILTER (WHERE (fail_bits & mask) = (1::BIGINT << bit))::BIGINT AS n_only_this
FROM l, p, r WHERE (mask & (1::BIGINT << bit)) <> 0 GROUP BY policy, version, bit, rule
"""


def op5_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_digest.fingerprinted(read_table(spark, sf_dir, "documents"), stored)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), **tokens.public_tokenizer())


def op7_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.linked_components(read_table(spark, sf_dir, "documents"), stored)


def op8_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.scored(read_table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2, stored)


def op9_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_words.round_trip(read_table(spark, sf_dir, "documents"), **tokens.public_codec())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(crc_mod("doc_id", 5) != 0))
    held_out = (crc_mod("doc_id", 5) == 0).alias("held_out")
    return language_id.predict(docs, model, [F.col("doc_id"), held_out])


def op11_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable_projections.nearest(read_table(spark, sf_dir, "embeddings"), stored, F.col("vec_id") % 20 == 0)


def op12_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return whitening.whitened(rows, whitening.fitted(rows, stored))


def op13_suffix_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sigma.collocations(read_table(spark, sf_dir, "documents"), stored)


OP13_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS p FROM t),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
e AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
s AS (SELECT lang, w[i:least(i + m - 1, len(w))] AS g, m FROM e, (VALUES (1), (2), (3)) v(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, g, m, count(*) AS n FROM s GROUP BY ALL),
t1 AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, g, m, n AS a FROM f WHERE m > 1 AND n >= 10),
k AS (SELECT c.*, unnest(range(1, m)) AS k FROM c),
b AS (SELECT k.lang, k.g, k.m, k.a, k.k, x.n AS l, y.n AS r, (1000000::HUGEINT * k.a * k.a) // (x.n::HUGEINT * y.n) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.g = k.g[1:k.k] JOIN f y ON y.lang = k.lang AND y.g = k.g[k.k + 1:k.m]),
o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
i AS (SELECT lang, sub, max(a) AS longer FROM (SELECT lang, a, unnest([g[1:2], g[2:3]]) AS sub FROM c WHERE m = 3) GROUP BY lang, sub),
d AS (SELECT o.lang, array_to_string(o.g, ' ') AS phrase, a, l, r, score::BIGINT AS score FROM o LEFT JOIN i ON i.lang = o.lang AND i.sub = o.g WHERE i.longer IS NULL OR 100 * i.longer < 50 * a)
SELECT d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM d JOIN t1 ON t1.lang = d.lang QUALIFY rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_separator_scan": op1_separator_scan,
    "op2_site_style": op2_site_style,
    "op3_chat_format": op3_chat_format,
    "op4_quality_rules": op4_quality_rules,
    "quality_ablation": quality_ablation,
    "op5_exact_digest": op5_exact_digest,
    "op6_packing": op6_packing,
    "op7_jaccard_groups": op7_jaccard_groups,
    "op8_hidden_markov": op8_hidden_markov,
    "op9_bpe_words": op9_bpe_words,
    "op10_language_id": op10_language_id,
    "op11_stable_projections": op11_stable_projections,
    "op12_jacobi_whitening": op12_jacobi_whitening,
    "op13_suffix_sigma": op13_suffix_sigma,
}
SQL: dict[str, str] = {"op3_chat_format": OP3_SQL, "op4_quality_rules": OP4_SQL, "quality_ablation": ABLATION_SQL, "op13_suffix_sigma": OP13_SQL}
