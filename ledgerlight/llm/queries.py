"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import token_digests
from .chat_format import format_and_read_back
from .common import table
from .exact_dedup import exact_groups
from .grid_join import link_vectors
from .maxscore import build_index, search
from .mixing import mix
from .ngram_join import near_copies
from .prefix_trie import prefix_trie
from .secret_scan import scan_history
from .sharding import shard_documents
from .toxicity import toxicity
from .warc import archive_and_read_back
from .wavelet import write_and_read_back

#: The tokenizer files, in a package that all executors have; the operators take any path. END closes each document in op13's files.
TOKENIZER, BYTE_TOKENIZER, END = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json"), 2


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read_back(table(spark, sf_dir, "pages")).drop("key")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one ledger: the first scans all blobs that it doesn't know, the second none, and reads what is known."""
    documents = table(spark, sf_dir, "documents")
    _, ledger = scan_history(documents, ["doc_id"], "text")
    found, _ = scan_history(documents, ["doc_id"], "text", ledger)
    counts = [F.col("counts")[i].alias(f"n_{kind}") for i, kind in enumerate(("assign", "access", "hex"))]
    return found.select("doc_id", *counts, F.sha2("spans", 256).alias("base_sha256"), "spans")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.sql(f"select * from values (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') as t (conv_id, turn, role, text)")
    return format_and_read_back(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read_back(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, END)


QUERIES = {f.__name__: f for f in (op1_warc, op2_secret_scan, op3_ngram_join, op4_bpe, op5_sharding, op6_mixing, op7_toxicity, op8_exact_dedup, op9_chat_format, op10_embedding_dedup, op11_ranked_search, op12_prefix_trie, op13_token_files)}

_NORM = "translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')"

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _pieces(kind: str, at: int, pattern: str, group: int, least: int) -> str:
    return f"""
    select doc_id, '{kind}' as kind, {at} as k, no,
           length(split[no]) as gap, length(whole[no]) as w, length(tested[no]) >= {least} as good
    from (select doc_id, string_split_regex(t, '{pattern}') as split, regexp_extract_all(t, '{pattern}') as whole,
                 regexp_extract_all(t, '{pattern}', {group}) as tested from texts) x,
         lateral (select unnest(range(1, len(whole) + 1)) as no) y"""


_SECRETS = f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
pieces as ({_pieces("assign", 0, _ASSIGN, 2, 6)} union all {_pieces("access", 1, "AKIA[A-Z0-9]+", 0, 20)} union all {_pieces("hex", 2, "[0-9a-f]+", 0, 24)}),
ends as (select *, sum(gap + w) over (partition by doc_id, k order by no) as e from pieces),
spans as (select doc_id, kind, k, e - w as s, kind || ':' || cast(cast(e - w as bigint) as varchar) || ':' || cast(cast(e as bigint) as varchar) as span from ends where good),
found as (select doc_id, count(*) filter (k = 0) as a, count(*) filter (k = 1) as b, count(*) filter (k = 2) as c, string_agg(span, ',' order by s, k) as spans from spans group by doc_id)
select t.doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex,
       sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from texts t left join found f on t.doc_id = f.doc_id"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_SEARCH = f"""
with words as (select r, doc_id, unnest({_TERMS}) as term from (select row_number() over () as r, doc_id, text from documents)),
tfs as (select r, any_value(doc_id) as doc_id, term, count(*) as tf from words group by r, term),
sizes as (select r, count(*) as n from words group by r),
total as (select count(*) as docs, cast(sum(n) as bigint) as terms from sizes),
ms as (select r, 10 + (90 * n * docs) // terms as m from sizes, total),
weights as (select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as w from tfs, total group by term),
asked as (select distinct i, item_id, unnest({_TERMS}) as term from (select row_number() over () as i, item_id, text from benchmark)),
scores as (
    select i, any_value(item_id) as item_id, t.r, any_value(t.doc_id) as doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
    from asked a join tfs t on a.term = t.term join weights w on a.term = w.term join ms on t.r = ms.r group by i, t.r),
ranked as (select *, row_number() over (partition by i order by score desc, doc_id) as rank from scores where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10"""

#: crc32 of the decimal id: a byte goes in, then eight steps of a bit each; 3988292384 is its polynomial.
_CRC32 = "xor(list_reduce(list_prepend(4294967295, flatten([[ascii(x), -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(cast(c as varchar), '')])), lambda s, b: case when b >= 0 then xor(s, b) when s % 2 = 1 then xor(s >> 1, 3988292384) else s >> 1 end), 4294967295)"

_TRIE = f"""
with own as (
    select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) as k
    from conversations where conv_id is not null),
ids as (select c, {_CRC32} % 6 as h from (select distinct c from own)),
rebuilt as (
    select i.c, 0 as part, k, role, text from ids i join own b on b.c = i.c - i.c % 100 and b.k <= i.h
    union all select o.c, 1, k, role, text from own o join ids i on o.c = i.c and o.k > i.h),
placed as (select c, row_number() over (partition by c order by part, k) as d, length(text) as chars, length(role) || ':' || role || length(text) || ':' || text as turn from rebuilt),
members as (
    select c, d, chars, string_agg(turn, '' order by d) over (partition by c order by d) as prefix,
           coalesce(string_agg(turn, '' order by d) over (partition by c order by d rows between unbounded preceding and 1 preceding), '') as parent
    from placed union all select c, 0, 0, '', null from ids),
nodes as (select d, prefix, any_value(parent) as parent, any_value(chars) as chars, min(c) as c, count(*) as n from members group by d, prefix),
children as (select parent, count(*) as n_children from nodes where d > 0 group by parent),
whole as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join children h on n.prefix = h.parent),
sums as (
    select m.prefix, count(*) filter (y.n_children = 0) as n_leaves, sum((y.n - 1) * y.chars) as saved
    from whole y join members m on m.c = y.c and m.d <= y.d group by m.prefix),
ends as (
    select prefix, string_agg(cast(m.c as varchar), ',' order by m.c) as said
    from members m join (select c, max(d) as d from members group by c) l on m.c = l.c and m.d = l.d group by prefix)
select w.c as conv_id, w.d as depth, p.c as parent_conv_id, w.n as n_convs, w.n_children, s.n_leaves, cast(s.saved as bigint) as saved_tokens, sha256(coalesce(e.said, '')) as ends_sha256
from whole w join sums s on w.prefix = s.prefix left join nodes p on w.parent = p.prefix left join ends e on w.prefix = e.prefix"""

ORACLE_SQL = {
    "op11_ranked_search": _SEARCH,
    "op12_prefix_trie": _TRIE,
    "op2_secret_scan": _SECRETS,
    "op8_exact_dedup": f"""
with norm as (select doc_id, length(coalesce(text, '')) as chars, {_NORM} as t from documents),
best as (select t, count(*) as group_size, arg_min(doc_id, (-chars, doc_id)) as keep_id from norm group by t)
select n.doc_id, b.keep_id, b.group_size, n.doc_id = b.keep_id as kept, sha256(n.t) as text_sha256
from norm n join best b on n.t = b.t""",
    "op9_chat_format": r"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked as (
    select *, length(replace(text, '\', '\\')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]')) + length(replace(role, '\', '\\'))
              + case when role = 'user' then 16 else 10 end as chars from turns),
whole as (
    select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said,
           coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as loss, sum(chars) as chars
    from marked group by conv_id)
select conv_id, n_turns, sha256(said) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
       cast(chars as bigint) as formatted_chars
from whole""",
}
