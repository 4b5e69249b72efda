"""One registered query for each operator, over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import (
    decontamination, fill_in_middle, language_id, license_scan, line_dedup, mixing, packing, pii, quality_rules, sharding, simhash, spelling,
    token_counts,
)
from changelens.llm.common import table

# Shares of all tokens after mixing. Some texts labelled toxic have nothing that tells them from good ones, so nonnegative
# rates cannot bring the toxic share of the true mixture much lower than this.
TARGETS = {"good": 0.8, "plain": 0.14, "toxic": 0.06}


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents")).drop("digest")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Runs of fewer words are stock phrases of clean documents ("Of.", a license line) and stay.
    found = line_dedup.removals(table(spark, sf_dir, "documents"), run_words=15).drop("digest")
    return found.withColumnsRenamed({"first_id": "first_doc_id"})


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shards(table(spark, sf_dir, "documents"))
    return dealt.drop("source").withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("digest")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.labelled_domains(table(spark, sf_dir, "labels"))
    return mixing.mixed(table(spark, sf_dir, "documents"), labels, "domain", weights=TARGETS).drop("digest")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = {f"n_{k}": F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint") for k in pii.PATTERNS}  # noqa: B023
    terms = F.size("all") - F.size("base")
    made = found.withColumns({**counts, "n_term": terms.cast("bigint"), "base_sha256": F.sha2(pii.listed(F.col("base")), 256), "spans": pii.listed(F.col("all"))})
    return made.drop("digest", "base", "all")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.filled_in_middle(table(spark, sf_dir, "documents"))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")), 256)}
    return made.withColumns(digests).drop("output")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_license_scan, op3_quality_rules, op4_line_dedup, op5_simhash,
        op6_sharding, op7_decontamination, op8_mixing, op9_language_id, op10_personal_data,
        op11_fill_in_middle, op12_spelling_variants, op13_packing,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"string_split_regex({0}, '[\x20\x09-\x0D]+')"
_WORDS = "list_filter(" + _SPLIT + ", lambda w: w <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql() -> str:
    """Exact containment of each template's five-word shingles in the whole text."""
    values = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in license_scan.TEMPLATES.items())
    plain = f"translate(translate(t, '{_UPPER}', '{_LOWER}'), {_quoted(license_scan.PUNCTUATION)}, '')"
    grams = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))"
    return f"""
with given(license, t) as (values {values}),
templates as (select license, {grams} g from (select license, {_WORDS.format(plain)} w from given)),
docs as (select doc_id, {grams} g from (select doc_id, {_WORDS.format(plain)} w from (select doc_id, coalesce(text, '') t from documents)))
select doc_id, license, containment, cast(list_position(dg, tg[1]) - 1 as bigint) word from (
  select doc_id, license, d.g dg, t.g tg, len(list_intersect(list_distinct(t.g), d.g)) / len(list_distinct(t.g)) containment
  from docs d, templates t where list_has_any(t.g, d.g)
) where containment >= {license_scan.CONTAINMENT}
"""


def quality_sql() -> str:
    letters = f"translate(translate(l, '{_UPPER}', '{_LOWER}'), '123456789', '000000000')"
    return f"""
with docs as (
  select doc_id, source, t, {_WORDS.format("t")} w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) ls
  from (select doc_id, source, coalesce(text, '') t from documents)
),
windows as (
  select doc_id, i, array_to_string(w[i:i+7], ' ') v from (select doc_id, w, unnest(range(1, len(w) - 6)) i from docs)
),
repeated as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, v) n from windows) where n > 1
),
covered as (
  select doc_id, cast(sum(least(8, coalesce(after - i, 8))) as bigint) n from (
    select doc_id, i, lead(i) over (partition by doc_id order by i) after from repeated
  ) group by doc_id
),
lines as (
  select doc_id, source, t, array_to_string({_WORDS.format(letters)}, ' ') v, len({_WORDS.format("l")}) n
  from (select doc_id, source, t, unnest(ls) l from docs)
),
frequent as (select source, v from lines group by source, v having count(distinct t) > {quality_rules.LINE_DOCS}),
gone as (select doc_id, cast(sum(n) as bigint) n from lines l semi join frequent f on l.source is not distinct from f.source and l.v = f.v group by doc_id),
measured as (
  select doc_id, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) n_dup_lines,
    coalesce(c.n, 0) n_repeat_words, coalesce(g.n, 0) n_removed
  from docs left join covered c using (doc_id) left join gone g using (doc_id)
),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from measured)
select *, not base_failed and n_words - n_removed >= 20 and n_words - n_removed >= 0.2 * n_words kept from judged
"""


SHARDING_SQL = f"""
with crc as (
  select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) tab
  from range(256) r(i)
),
docs as (
  select doc_id, 's' || coalesce(source, chr(0)) s, cast(strlen(t) + 1 as bigint) size, md5('{sharding.SEED}:' || coalesce(cast(doc_id as varchar), 'null')) h,
    list_prepend(cast(4294967295 as bigint), list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: cast('0x' || x as bigint))) bytes
  from (select doc_id, source, coalesce(text, '') t from documents)
),
summed as (
  select doc_id, s, size, h, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) text_crc32 from docs, crc
),
ranked as (
  select *, row_number() over (partition by s order by h, doc_id, text_crc32, size) r, count(*) over (partition by s) n, count(*) over () total from summed
),
placed as (select *, row_number() over (order by (2 * r - 1) / (2 * n), s, r) - 1 place from ranked)
select doc_id, size, text_crc32, cast(place * 8 // total as int) shard,
  cast(place - (place * 8 // total * total + 7) // 8 as bigint) slot, 'rows' law, cast(null as int) grown_shard
from placed
"""

MIDDLE_SQL = r"""
with docs as (
  select doc_id, coalesce(text, '') t, sha256('7:' || coalesce(cast(doc_id as varchar), 'null')) h from documents
),
lines as (select doc_id, t, h, regexp_extract_all(t, '[^\n]*\n|[^\n]+') us from docs),
drawn as (
  select *, cast(len(us) as bigint) n, cast('0x' || h[1:8] as bigint) % (len(us) + 1) a, cast('0x' || h[9:16] as bigint) % (len(us) + 1) b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or cast('0x' || h[17:24] as bigint) % 100 >= 100 then 'plain'
      when cast('0x' || h[25:32] as bigint) % 100 < 50 then 'spm' else 'psm' end form
  from lines
),
cut as (
  select doc_id, t, n, form, coalesce(array_to_string(us[1:least(a, b)], ''), '') p,
    coalesce(array_to_string(us[least(a, b) + 1:greatest(a, b)], ''), '') m, coalesce(array_to_string(us[greatest(a, b) + 1:n], ''), '') s
  from drawn
)
select doc_id, n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
  sha256(t) restored_sha256
from cut
"""

_LATIN = "".join(map(chr, range(0xC0, 0x100)))
_BYTES = "".join(map(chr, range(33, 97)))

SPELLING_SQL = f"""
with recursive crc as (
  select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) tab
  from range(256) r(i)
),
runs as (
  select id, run, count(*) n from (
    select coalesce(cast(doc_id as varchar), 'null') id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) run from documents
  ) where length(run) >= 5 group by id, run
),
summed as (
  select run, n, xor(list_reduce(list_prepend(cast(4294967295 as bigint),
    list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda x: cast('0x' || x as bigint))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) h
  from runs, crc
),
words as (
  select word, cast(sum(n) as bigint) n from (
    select case when h % 97 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end word, n from summed
  ) where length(word) >= 5 group by word having sum(n) >= 3
),
-- One byte for each letter, as distances are counted over bytes.
single as materialized (select word, n, translate(word, '{_LATIN}', {_quoted(_BYTES)}) w, length(word) l from words),
roles as (select *, unnest([0, 1]) longer from single),
-- An edit leaves the first or the last half of the shorter length as it is.
sides as (select *, l - longer base, unnest([0, 1]) side from roles),
halves as (select *, case side when 0 then w[:base // 2] else w[-(base // 2):] end half from sides),
near as materialized (
  select distinct a.word, a.n, b.word other, b.n m from halves a join halves b on a.base = b.base and a.side = b.side and a.half = b.half
  where a.longer + b.longer < 2 and a.w <> b.w and levenshtein(a.w, b.w) = 1
),
best as (
  select word, count(*) n_near, first(other order by m desc, other) form, max(m) form_n, max(n) n from near group by word
),
formed as materialized (
  select s.word, s.n, coalesce(n_near, 0) n_near, case when form_n >= 2 * s.n then form end form, case when form_n >= 2 * s.n then form_n end form_n
  from single s left join best b on b.word = s.word
),
chain as (
  select word, word here, 0 step from formed
  union all
  select c.word, f.form, step + 1 from chain c join formed f on f.word = c.here where f.form is not null
)
select f.word, n, n_near, form, form_n, arg_max(here, step) root from formed f join chain c on c.word = f.word group by f.word, n, n_near, form, form_n
"""

ORACLES: dict[str, str] = {
    "op2_license_scan": license_sql(),
    "op3_quality_rules": quality_sql(),
    "op6_sharding": SHARDING_SQL,
    "op11_fill_in_middle": MIDDLE_SQL,
    "op12_spelling_variants": SPELLING_SQL,
}
