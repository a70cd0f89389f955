"""One query per operator on the given tables, with production parameters, and the SQL for it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import pin
from . import chats, collocations, decontamination, embedding_links, mixing, near_duplicates, quality, ranked_search, substring_dedup, surrogates, token_files, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return pin(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(read(spark, sf_dir, "documents")).drop("kept_text")


QUERIES["op1_substring_dedup"] = op1_substring_dedup


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents")).drop("text_hash")


QUERIES["op2_near_duplicates"] = op2_near_duplicates


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages")).drop("url")


QUERIES["op3_warc"] = op3_warc


# Target weights, in shares.
SHARES = {"src0": 5, "src1": 3, "src2": 2, **{f"src{i}": 1 for i in range(3, 20)}}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(read(spark, sf_dir, "documents"), SHARES).drop("text_hash")


QUERIES["op6_mixing"] = op6_mixing
CHECKS["op6_mixing"] = f"""
with recursive shares(g, a) as (values {", ".join(f"('{g}', {a})" for g, a in [*SHARES.items(), (mixing.OTHER, 1)])}),
total as (select sum(a) as p from shares),
state(t, pick, done) as (
    select 0, cast(null as varchar), cast([] as varchar[])
    union all
    select t + 1, g, list_append(done, g) from (
        select t, done, g, row_number() over (order by ceil((k + 1) * p / a), g) as nth
        from (select t, done, g, a, len(list_filter(done, lambda x: x = g)) as k from state, shares) s, total
        where t < p and k < a and floor(k * p / a) <= t)
    where nth = 1),
slots as (select t - 1 as slot_at, pick as g, row_number() over (partition by pick order by t) - 1 as nth from state where t > 0),
docs as (
    select doc_id, source, coalesce(g, '{mixing.OTHER}') as mix_group from documents left join shares on source = g),
ranked as (
    select *, row_number() over (partition by mix_group order by doc_id) - 1 as rank from docs),
blocks as (select *, rank // {mixing.BLOCK} as block, rank % {mixing.BLOCK} as place from ranked)
select doc_id, source, mix_group, block, cast((block // a) * p + slot_at as bigint) as slot, place
from blocks join shares on shares.g = mix_group join slots on slots.g = mix_group and nth = block % a, total
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scores.withColumn("kept", quality.accepted(scores["p_quality"], scores["p_toxic"]))


QUERIES["op8_quality"] = op8_quality


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("items", "text_hash")


QUERIES["op7_decontamination"] = op7_decontamination
CHECKS["op7_decontamination"] = """
with w as (
    select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as a
    from documents),
b as (
    select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as a
    from benchmark),
wins as (
    select distinct item_id, least(len(a), 10) as k, array_to_string(a[i + 1 : i + least(len(a), 10)], ' ') as phrase
    from (select item_id, a, unnest(range(greatest(len(a) - 9, 1))) as i from b where len(a) > 0)),
sizes as (select distinct k from wins),
places as (
    select doc_id, k, i, array_to_string(a[i + 1 : i + k], ' ') as phrase
    from (select doc_id, a, k, unnest(range(len(a) - k + 1)) as i from w, sizes where len(a) >= k)),
found as (select doc_id, i, p.k, item_id from places p join wins using (phrase)),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from found) group by doc_id),
items as (
    select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
    from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select doc_id, coalesce(len(a), 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join hits using (doc_id) left join items using (doc_id)
"""


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokenise(read(spark, sf_dir, "documents"), TOKENIZER)


QUERIES["op9_token_files"] = op9_token_files


def op5_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.chats(read(spark, sf_dir, "conversations"))


QUERIES["op5_chats"] = op5_chats
CHECKS["op5_chats"] = f"""
with turns as (select distinct conv_id, turn, role, text from conversations where conv_id is not null),
placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as position
    from turns),
whole as (
    select conv_id, count(*) as length, list(struct_pack(r := role, t := text) order by position) as turns
    from placed group by conv_id),
prefixes as (select distinct length, turns[1:n] as turns from (select length, turns, unnest(range(1, length)) as n from whole)),
kept as (
    select min(conv_id) as conv_id from whole
    where turns not in (select turns from prefixes) group by turns)
select conv_id, (position - 1) // {chats.PART} as part, count(*) as n_turns,
    string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' order by position) as text
from placed where conv_id in (select conv_id from kept) group by all
"""


def op10_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.embedding_links(read(spark, sf_dir, "embeddings"))


QUERIES["op10_embedding_links"] = op10_embedding_links


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(read(spark, sf_dir, "documents"))


QUERIES["op4_surrogates"] = op4_surrogates


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents")).drop("words")


QUERIES["op11_collocations"] = op11_collocations
CHECKS["op11_collocations"] = f"""
with pieces as (
    select lang, row_number() over () as piece, w from (
        select coalesce(lang, 'und') as lang, unnest(string_split_regex(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as w
        from documents)),
placed as (select lang, piece, unnest(a) as word, generate_subscripts(a, 1) as i
    from (select lang, piece, regexp_extract_all(w, '[^\\x20\\x09]+') as a from pieces)),
grams as (
    select lang, word as w1, lead(word) over p as w2, lead(word, 2) over p as w3
    from placed window p as (partition by piece order by i)),
f1 as (select lang, w1, count(*) as f from grams group by all),
f2 as (select lang, w1, w2, count(*) as f from grams where w2 is not null group by all),
f3 as (select lang, w1, w2, w3, count(*) as f from grams where w3 is not null group by all having count(*) >= {collocations.LEAST}),
cuts as (
    select x.lang, w1 || ' ' || w2 as phrase, 1 as k, x.f as a, l.f as l, r.f as r
    from f2 x join f1 l using (lang, w1) join f1 r on r.lang = x.lang and r.w1 = x.w2 where x.f >= {collocations.LEAST}
    union all
    select x.lang, w1 || ' ' || x.w2 || ' ' || x.w3, 1, x.f, l.f, r.f
    from f3 x join f1 l using (lang, w1) join f2 r on r.lang = x.lang and r.w1 = x.w2 and r.w2 = x.w3
    union all
    select x.lang, w1 || ' ' || w2 || ' ' || w3, 2, x.f, l.f, r.f
    from f3 x join f2 l using (lang, w1, w2) join f1 r on r.lang = x.lang and r.w1 = x.w3),
scored as (select *, 1000000::hugeint * a * a // (l::hugeint * r) as score from cuts),
lowest as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as nth from scored) where nth = 1),
longer as (
    select lang, phrase, max(f) as f from (
        select lang, w1 || ' ' || w2 as phrase, f from f3 union all select lang, w2 || ' ' || w3, f from f3) group by all),
kept as (
    select lowest.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
    from lowest left join longer using (lang, phrase) where not coalesce(100 * longer.f >= {collocations.COVERED} * a, false))
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score
from kept join (select lang, sum(f)::bigint as n from f1 group by lang) using (lang) where rank <= {collocations.TOP}
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES["op13_ranked_search"] = op13_ranked_search
CHECKS["op13_ranked_search"] = f"""
with docs as (
    select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as a
    from documents),
items as (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
    from benchmark),
total as (select count(*) as docs, sum(len(a))::bigint as terms from docs where len(a) > 0),
strata as (select doc_id, a, 75 + (25 * len(a) * docs) // terms as m from docs, total where len(a) > 0),
postings as (select doc_id, m, term, count(*) as tf from (select doc_id, m, unnest(a) as term from strata) group by all),
weights as (
    select term, floor(1000 * ln((2.0 * docs + 2) / (2 * df + 1)))::bigint as w
    from (select term, count(*) as df from postings group by term), total),
scores as (
    select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
    from items join weights using (term) join postings using (term) group by all),
ranked as (
    select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= {ranked_search.TOP}
"""


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES["op12_toxicity"] = op12_toxicity
