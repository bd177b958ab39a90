"""The operators' registered queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import (alignment, decontaminate, fingerprints, jaccard_join, katz, langid, licenses,
                            mixing, prefix_trie, substrings, token_counts, url_filter, warc)
from tallyhouse.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block",
         "com/fr/": "allow", "com/de/": "block"}
TOKENIZER = "word_bpe_49k.json"


def register(name: str, *tables: str, sql: str | None = None):
    """Add a query over whole tables, and the SQL that must give the same rows if there is one."""

    def add(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            read = configure(spark).read.parquet
            return query(*[read(f"{folder.rstrip('/')}/{t}.parquet") for t in tables])

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


@register("op1_language_id", "documents")
def language_id(docs: DataFrame) -> DataFrame:
    return langid.identify(docs)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op2_token_counts", "documents")
def tokens(docs: DataFrame) -> DataFrame:
    return token_counts.count_tokens(docs, tokenizer_path())


_WORDS3 = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@register("op3_decontamination", "documents", "benchmark", sql=rf"""
with d as (select doc_id, {_WORDS3} as w from documents),
b as (select item_id, {_WORDS3} as w from benchmark),
win as (select distinct item_id, array_to_string(list_slice(w, i + 1, i + 10), ' ') as k,
          least(len(w), 10) as n
        from (select item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) as i from b where len(w) > 0)),
places as (select doc_id, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') as k
           from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as i
                 from d, (select distinct n from win) where len(w) >= n)),
found as (select doc_id, i, p.n, item_id from places p join win using (k, n)),
hit as (select doc_id, count(distinct pos) as n_hit
        from (select doc_id, unnest(range(i, i + n)) as pos from found) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
          from (select distinct doc_id, cast(item_id as varchar) as id from found) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)""")
def decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    return decontaminate.decontaminate(docs, items)


@register("op4_warc_derivatives", "pages")
def warc_derivatives(pages: DataFrame) -> DataFrame:
    return warc.derive(warc.responses(pages))


@register("op5_fingerprints", "documents")
def document_fingerprints(docs: DataFrame) -> DataFrame:
    return fingerprints.fingerprint_pairs(docs)


_SPACE = r"[^\x20\x09-\x0D]+"


@register("op6_substring_dedup", "documents", sql=rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') as w from documents),
places as (select doc_id, i, array_to_string(list_slice(w, i + 1, i + 50), ' ') as k
           from (select doc_id, w, unnest(range(0, len(w) - 49)) as i from d where len(w) >= 50)),
first as (select k, min(doc_id) as owner from places group by 1),
gone as (select distinct doc_id, pos
         from (select doc_id, unnest(range(i, i + 50)) as pos
               from places join first using (k) where owner < doc_id)),
each as (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as pos from d),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by pos) as t
         from each anti join gone using (doc_id, pos) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
  sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)""")
def substring_dedup(docs: DataFrame) -> DataFrame:
    return substrings.remove_repeats(docs)


@register("op7_license_scan", "documents")
def license_scan(docs: DataFrame) -> DataFrame:
    """Documents as files of their sources, in folders of 1,000 and 100 ids; the first of a
    folder is its license file."""
    number = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 100 == 0, "LICENSE").otherwise(F.concat(number, F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")),
                       F.expr("cast(doc_id div 1000 as string)"),
                       F.expr("cast(doc_id div 100 as string)"), name)
    found = licenses.scan(docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text"))
    return found.withColumnRenamed("id", "doc_id")


@register("op8_source_mix", "documents")
def source_mix(docs: DataFrame) -> DataFrame:
    return mixing.mix_sources(docs)


@register("op9_url_filter", "pages")
def url_verdicts(pages: DataFrame) -> DataFrame:
    return url_filter.judge(pages, RULES)


@register("op10_jaccard_join", "documents", sql=rf"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}') as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i + 1, i + 3), ' ') as g
      from (select doc_id, w, unnest(range(0, greatest(len(w) - 2, 1))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c
          from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b
          where 100 * c >= 90 * (x.n + y.n - c)),
reach(doc_id, to_id) as (select doc_id, doc_id from d union
  select r.doc_id, l.b from reach r join links l on l.a = r.to_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(to_id) as component_id
from d left join n using (doc_id) join reach using (doc_id) group by 1, 2""")
def jaccard_classes(docs: DataFrame) -> DataFrame:
    return jaccard_join.similarity_classes(docs)


def tokenizer_a() -> str:
    return tokenizer_path("byte_bpe_50k.json")


def tokenizer_b() -> str:
    return tokenizer_path("piece_bpe_32k.model")


@register("op11_token_alignment", "documents")
def token_alignment(docs: DataFrame) -> DataFrame:
    return alignment.align(docs, tokenizer_a, tokenizer_b)


@register("op12_katz_score", "documents")
def katz_score(docs: DataFrame) -> DataFrame:
    return katz.score_texts(docs)


# CRC-32 (polynomial 0xEDB88320) of a decimal number, byte by byte from a table of 256.
_CRC = """
crc_table as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b:
    case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) as t
  from (select unnest(range(256)) as i)),
crcs as (select id, xor(list_reduce([4294967295] || list_transform(string_split(cast(id as varchar), ''),
    lambda x: cast(ascii(x) as bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as crc
  from (select distinct {id} as id from {table} where {id} is not null), crc_table)"""


@register("op13_prefix_trie", "conversations", sql=f"""
with {_CRC.format(id="conv_id", table="conversations")},
own as (select conv_id, row_number() over (partition by conv_id order by turn nulls first,
          coalesce(role, ''), sha256(coalesce(text, ''))) as i,
          coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
conv as (select id as c, id - id % 5 as base, crc % 9 as h,
           (select count(*) from own where conv_id = id - id % 5) as n_base from crcs),
turns as (select c, i as d, role, text from conv join own on conv_id = base and i <= h
          union all select c, i - h + least(h, n_base), role, text from conv join own on conv_id = c and i > h),
paths as (select c, d, strlen(text) as bytes, sha256(string_agg(
            concat(strlen(role), ' ', strlen(text), ' ', role, text), '') over (partition by c order by d)) as k
          from turns union all select c, 0, 0, '' from conv),
steps as (select *, lag(k) over (partition by c order by d) as p, lead(k) over (partition by c order by d) is null as last
          from paths),
nodes as (select k, min(d) as d, min(c) as rep, count(*) as n, min(p) as p, min(bytes) as bytes,
            coalesce(string_agg(case when last then cast(c as varchar) end, ',' order by c), '') as ids from steps group by k),
kids as (select p as k, count(*) as n_children from nodes group by p),
tree as (select u.k, count(*) filter (where x.k not in (select k from kids where k is not null)) as n_leaves,
           sum((x.n - 1) * x.bytes) as saved
         from nodes x join paths y on y.c = x.rep and y.d <= x.d join nodes u on u.k = y.k group by u.k)
select nodes.rep as conv_id, cast(nodes.d as bigint) as depth, up.rep as parent_conv_id, nodes.n as n_convs,
  coalesce(n_children, 0) as n_children, n_leaves, cast(saved as bigint) as saved_tokens,
  sha256(nodes.ids) as ends_sha256
from nodes left join nodes up on up.k = nodes.p left join kids on kids.k = nodes.k join tree on tree.k = nodes.k""")
def conversation_trie(conversations: DataFrame) -> DataFrame:
    return prefix_trie.trie(conversations)
