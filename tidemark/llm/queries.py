"""The queries of this package, one for each operator, over the whole of its table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import contamination, embedding_dedup, extract, minhash, order_minhash, pieces, pii, prefix_trie, quality, quotes, spelling, suffix_dedup, warc
from tidemark.llm._common import table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op3_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_likeness(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(table(spark, sf_dir, "pages"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


#: Words and shingle lists of a table in DuckDB: A-Z lower-cased, ASCII white space between words, five words a shingle.
_SHINGLES = """select {id} id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
   when len(w) > 0 then [array_to_string(w, ' ')] else [] end s
 from (select {id}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from {table})"""

_REPEATS = """with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
b as (select doc_id, unnest(range(length(h)//2)) p, unnest(list_transform(range(length(h)//2), lambda i: substr(h, 2*i + 1, 2))) x from d),
g as (select doc_id, unnest(range(length(h)//2 - 49)) p, unnest(list_transform(range(length(h)//2 - 49), lambda i: substr(h, 2*i + 1, 100))) gram from d where length(h) >= 100),
f as (select gram, min(doc_id) least from g group by gram),
r as (select g.doc_id, g.p from g join f on f.gram = g.gram where f.least < g.doc_id),
c as (select b.doc_id, b.p, b.x, coalesce(max(case when r.p is not null then 1 else 0 end) over (partition by b.doc_id order by b.p rows between 49 preceding and current row), 0) gone
  from b left join r on r.doc_id = b.doc_id and r.p = b.p),
e as (select *, gone = 1 and coalesce(lag(gone) over (partition by doc_id order by p), 0) = 0 as opens from c),
t as (select doc_id, sum(gone) n_removed, count_if(opens) n_spans, string_agg(case when gone = 0 then x end, '' order by p) kept from e group by doc_id)
select d.doc_id, length(d.h)//2 n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, cast(coalesce(n_spans, 0) as bigint) n_spans, sha256(unhex(coalesce(kept, ''))) kept_sha256 from d left join t on t.doc_id = d.doc_id"""

_LEAKS = f"""with d as ({_SHINGLES.format(id="doc_id", table="documents")}), i as ({_SHINGLES.format(id="item_id", table="benchmark")}),
du as (select id, unnest(s) x from d), iu as (select id, unnest(s) x from i),
n as (select du.id doc_id, iu.id item_id, count(*) n_shared from du join iu on iu.x = du.x group by 1, 2)
select doc_id, item_id, cast(len(i.s) as bigint) n_item, n_shared, n_shared/len(i.s) containment from n join i on i.id = n.item_id where 5*n_shared >= 4*len(i.s)"""

_WARC = """with p as (select page_id, regexp_replace(coalesce(url, ''), '[\\r\\n]', '%0A', 'g') url, coalesce(html, '') h from pages),
q as (select *, octet_length(encode(h)) n, max(page_id) over (partition by h) best from p)
select page_id, n payload_bytes, sha1(h) payload_digest, case when n >= 1000 and best <> page_id then 'revisit' else 'response' end record_type,
 case when n >= 1000 and best <> page_id then best end refers_to, url from q"""

_NEAR = f"""with recursive d as ({_SHINGLES.format(id="doc_id", table="documents")}), u as (select id, len(s) n, unnest(s) x from d),
l as (select a.id a, b.id b from u a join u b on a.x = b.x and a.id < b.id group by a.id, b.id, a.n, b.n having 100*count(*) >= 85*(a.n + b.n - count(*))),
e as (select a, b from l union all select b, a from l),
reach(id, root) as (select id, id from d union select e.b, reach.root from reach join e on e.a = reach.id where reach.root < e.b),
c as (select id, min(root) root from reach group by id)
select d.id doc_id, cast(len(s) as bigint) n_shingles, c.root component_id, c.root = d.id kept from d join c on c.id = d.id"""


#: CRC-32 of a string column in DuckDB: the table of its 256 one-byte values, then a fold over the UTF-8 bytes.
_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))"
_BYTES = "list_transform(range(octet_length(encode({s}))), lambda i: cast(('0x' || substr(hex(encode({s})), 2*i + 1, 2)) as bigint))"
_CRC = "xor(list_reduce(list_prepend(4294967295, {b}), lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295)"

_VARIANTS = f"""with recursive tab as (select {_CRC_TABLE} tab),
runs as (select doc_id, run, count(*) k from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) run from documents)
  where length(run) >= 6 group by 1, 2),
h as (select run, k, {_CRC.format(b=_BYTES.format(s="coalesce(cast(doc_id as varchar), '') || ':' || run"))} h from runs, tab),
w as (select case when h % 199 = 0 then left(run, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2) else run end word, k from h),
v as (select word, cast(sum(k) as bigint) n from w where length(word) >= 6 group by 1 having sum(k) >= 5),
cut as (select word, n, i, left(word, i) || substr(word, i + 2) rest from (select word, n, unnest(range(length(word))) i from v)),
near as (select a.word a, b.word b, b.n from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from cut a join v b on b.word = a.rest union select b.word, a.word, a.n from cut a join v b on b.word = a.rest),
best as (select a, count(distinct b) n_near, max(n) most from near group by a),
f as (select v.word, v.n, coalesce(n_near, 0) n_near, case when most >= 5*v.n then (select min(b) from near where near.a = v.word and near.n = most) end form, case when most >= 5*v.n then most end form_n from v left join best on a = v.word),
up(word, top) as (select word, word from f union select up.word, f.form from up join f on f.word = up.top where f.form is not null)
select f.word, f.form, up.top root, f.n, f.n_near, f.form_n from f join up on up.word = f.word join f g on g.word = up.top and g.form is null"""

_TRIE = f"""with tab as (select {_CRC_TABLE} tab),
t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 pos,
  sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) digest, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) words from conversations where conv_id is not null),
c as (select conv_id, count(*) own, {_CRC.format(b=_BYTES.format(s="cast(conv_id as varchar)"))} % 4 h from t, tab group by conv_id, tab),
k as (select c.conv_id, c.conv_id - c.conv_id % 20 base, c.h, least(c.h, coalesce(b.own, 0)) k from c left join c b on b.conv_id = c.conv_id - c.conv_id % 20),
x as (select k.conv_id, t.pos + 1 depth, digest, words from k join t on t.conv_id = k.base where t.pos < k.h
  union all select k.conv_id, k.k + t.pos - k.h + 1, digest, words from k join t on t.conv_id = k.conv_id where t.pos >= k.h),
p as (select conv_id, depth, words, string_agg(digest, '') over (partition by conv_id order by depth rows unbounded preceding) key from x),
full_ as (select k.conv_id, coalesce(m.depth, 0) depth from k left join (select conv_id, max(depth) depth from p group by 1) m on m.conv_id = k.conv_id),
member as (select conv_id, depth, words, key from p union all select conv_id, 0, 0, '' from k),
n as (select key, depth, min(conv_id) conv_id, count(*) n_convs, max(words) words from member group by 1, 2),
e as (select m.key, string_agg(cast(m.conv_id as varchar), ',' order by m.conv_id) ids from member m join full_ f on f.conv_id = m.conv_id and f.depth = m.depth group by 1),
kids as (select left(key, 64*(depth - 1)) key, count(*) n_children from n where depth > 0 group by 1),
y as (select n.*, coalesce(n_children, 0) n_children from n left join kids on kids.key = n.key),
s as (select a.key, sum(case when b.n_children = 0 then 1 else 0 end) n_leaves, sum((b.n_convs - 1)*b.words) saved from y a join y b on starts_with(b.key, a.key) group by 1)
select y.conv_id, cast(y.depth as bigint) depth, q.conv_id parent_conv_id, y.n_convs, y.n_children, cast(n_leaves as bigint) n_leaves, cast(saved as bigint) saved_tokens, sha256(coalesce(ids, '')) ends_sha256
 from y join s on s.key = y.key left join y q on q.depth = y.depth - 1 and q.key = left(y.key, 64*(y.depth - 1)) left join e on e.key = y.key"""

_VECTORS = """with recursive v as (select row_number() over (order by vec_id) r, vec_id, label, cast(embedding as double[]) e from embeddings),
g as (select *, sqrt(list_sum(list_transform(e, lambda x: x*x))) size from v where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
l as (select a.r a, b.r b from g a join g b on a.label = b.label and len(a.e) = len(b.e) and a.r < b.r and a.size > 0 and b.size > 0 and list_dot_product(a.e, b.e)/(a.size*b.size) >= 0.98),
d as (select a, b from l union all select b, a from l),
reach(id, root) as (select r, r from v union select d.b, reach.root from reach join d on d.a = reach.id where reach.root < d.b),
c as (select id, min(root) root from reach group by id), n as (select a, count(*) k from d group by a)
select v.vec_id, coalesce(k, 0) n_links, w.vec_id component_id, v.r = c.root kept from v join c on c.id = v.r join v w on w.r = c.root left join n on n.a = v.r"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_array_dedup": _REPEATS, "op6_benchmark_decontamination": _LEAKS, "op8_warc_revisits": _WARC, "op10_minhash_near_dedup": _NEAR,
            "op11_spelling_variants": _VARIANTS, "op12_prefix_trie": _TRIE, "op13_embedding_near_dedup": _VECTORS}
