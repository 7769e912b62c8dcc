"""The queries of this subpackage, one for each operator, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_ann, exact_dedup, html_tree, langid, line_dedup, mixing, packing, secrets, simhash, toxicity
from .common import col, crc_mod, read


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(col("doc_id"), 5) == 0
    labels = read(spark, sf_dir, "labels").where(~held).select("doc_id", "toxic")
    model = toxicity.train(toxicity.labelled(docs, labels))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_ann.search(read(spark, sf_dir, "embeddings"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_kept", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_best_fit_packing, op2_site_style_tree, op3_simhash, op4_toxicity, op5_additive_quantisation,
            op6_language_id, op7_fuzzy_lines, op8_secrets, op9_mixing, op10_exact_dedup,
        )
    }


EXACT_SQL = r"""
with t as (
  select doc_id,
         sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents)
select doc_id, max(doc_id) over w as keep_id, (count(*) over w)::bigint as group_size,
       doc_id is not distinct from max(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)
"""

#: Fixed value: 2^48, the range of the digits of md5 that make a uniform number.
MIX_SQL = r"""
with d as (
  select doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':17'), 1, 12))::bigint::double + 0.5) / 281474976710656.0)
           / greatest(0.05, length(regexp_replace(coalesce(text, ''), '[\x21-\x2B\x2D\x2F-\x40\x5B-\x60\x7B-\x7E]+', '', 'g'))::double
                            / greatest(length(coalesce(text, '')), 1)) as key
  from documents),
s as (
  select source, sum(size)::bigint as source_size, 2.0 * sum(size)::double as most,
         [3.0, 1.0, 2.0][((row_number() over (order by source nulls last)) - 1) % 3 + 1]::double as weight
  from d group by source),
l as (
  select *, row_number() over up as place,
         (1.5 * sum(source_size) over () - coalesce(sum(most) over (up rows between unbounded preceding and 1 preceding), 0))
         / (sum(weight) over () - coalesce(sum(weight) over (up rows between unbounded preceding and 1 preceding), 0)) as level
  from s window up as (order by most / weight, source nulls last)),
f as (select min_by(level, place) filter (where level * weight < most) as final from l),
t as (
  select source, source_size, least(most, coalesce(final * weight, most))::double as target from l, f),
r as (
  select d.doc_id, d.size, t.source_size, t.target,
         coalesce(floor(t.target / nullif(t.source_size, 0)), 0) as whole,
         sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows unbounded preceding) as upto
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (size * (whole + case when target - whole * source_size > 0 and upto - size / 2.0 <= target - whole * source_size
                             then 1 else 0 end))::bigint as taken
from r
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": MIX_SQL, "op10_exact_dedup": EXACT_SQL}
