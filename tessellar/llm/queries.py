"""The registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, conversations, decontaminate, html_text, line_dedup, near_duplicates, neighbours, packing, passages, quality, spelling, token_files, url_filter
from .common import spread

URL_RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens with the corpus's mixture of sources in each."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, length=1024)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the five rules and the method's own."""
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near duplicates (five-word shingles, similarity 0.8) and its links."""
    return near_duplicates.classes(table(spark, sf_dir, "documents"), threshold=0.8, size=5)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded into files in id order, digested as read back from them."""
    read = token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_files.digests(read)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that three documents hold stay in the largest id alone."""
    kept = line_dedup.dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth vector."""
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of fifty words or more that are near duplicates of passages of other documents."""
    return passages.repeated(table(spark, sf_dir, "documents"), min_words=50, size=5, threshold=0.8)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items that overlap in 13 words or more, four fifths of them equal."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by byte-level BPE and decoded again, both digested."""
    import public_tokenizers

    how = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = table(spark, sf_dir, "documents").select("doc_id", byte_bpe.token_ids(F.col("text"), *how).alias("ids"))
    both = coded.select("doc_id", "ids", byte_bpe.decoded(F.col("ids"), *how).alias("bytes"))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired by the cheapest edits."""
    mended = conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))
    return mended.withColumn("repaired_sha256", F.sha2(conversations.repaired_text(F.col("repaired")), 256)).drop("repaired")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of six letters or more that occurs five times, with its frequent form."""
    words = spelling.occurrences(table(spark, sf_dir, "documents").select("doc_id", "text"), least=6)
    return spelling.variants(spelling.vocabulary(words, often=5), times=5)


def queries() -> dict:
    first = (op1_packing, op2_url_filter, op3_ngram_jaccard_join, op4_quality, op5_html_text, op6_token_files, op7_line_dedup, op8_nearest_neighbours, op9_substring_dedup, op10_decontaminate)
    return {f.__name__: f for f in (*first, op11_byte_bpe, op12_conversation_repair, op13_spelling_variants)}


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP2_SQL = f"""
with rules(rule, rhost, rpath, v) as (values {", ".join(f"('{r.name}', '{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES)}),
u as (select row_number() over () as id, page_id, case when contains(url, '://') then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') else '' end as r from pages),
p as (select id, page_id, translate(regexp_extract(r, '^[^/]*'), '{_UP}', '{_LOW}') as host, substr(r, length(regexp_extract(r, '^[^/]*')) + 1) as path from u),
f as (select id, arg_max(rule, length(rule)) as rule, arg_max(v, length(rule)) as v from p join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by id)
select page_id, host, path, rule,
 coalesce(v, case when regexp_matches(host, '(^|[.-])({"|".join(url_filter.JUNK_WORDS)})([.-]|$)') then 'block' else 'allow' end) as verdict
from p left join f using (id)
"""

_OP7_SQL = f"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select r, doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from d),
k as (select *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{_UP}', '{_LOW}') as key from l),
c as (select key, max(doc_id) as top from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.*, coalesce(k.doc_id < c.top, false) as dropped from k left join c on k.key = c.key)
select doc_id, count(*) as n_lines, cast(sum(dropped::int) as bigint) as n_dropped,
 sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from m group by r, doc_id
"""


_OP3_SQL = r"""
with recursive d as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') as ws from documents),
s as (select distinct r, sh from (select r, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh from d)),
n as (select r, count(*) as n from s group by r),
p as (select a.r as a, b.r as b, count(*) as c from s a join s b on a.sh = b.sh and a.r < b.r group by a.r, b.r),
e as (select a, b from p join n na on na.r = a join n nb on nb.r = b where c >= 0.8 * (na.n + nb.n - c)),
e2 as (select a, b from e union all select b, a from e),
walk(r, s) as (select r, r from d union select w.r, e2.b from walk w join e2 on e2.a = w.s),
c as (select w.r, min(d.doc_id) as class_id from walk w join d on d.r = w.s group by w.r),
l as (select a as r, count(*) as n_links from e2 group by a)
select d.doc_id, c.class_id, coalesce(l.n_links, 0) as n_links from d join c using (r) left join l using (r)
"""


_WORDS_SQL = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
#: Items with fewer words than the longest mask must be equal in all of them.
_LONGEST = max(map(len, decontaminate.MASKS))

# No seeds: every diagonal of every document and item with an equal word is looked at.
_OP10_SQL = f"""
with d as (select row_number() over () as did, doc_id, words from (select distinct doc_id, {_WORDS_SQL} as words from documents)),
i as (select row_number() over () as pid, item_id, words, len(words) as m from (select distinct item_id, {_WORDS_SQL} as words from benchmark where item_id is not null)),
dw as (select did, unnest(words) as w, unnest(range(len(words))) as pos from d),
iw as (select pid, m, unnest(words) as w, unnest(range(m)) as p from i),
e as (select did, pid, m, pos - p as diag, p from dw join iw using (w)),
c as (select *, count(*) over (partition by did, pid, diag) as n, row_number() over (partition by did, pid, diag order by p) as k from e),
q as (select * from c where n >= case when m < {_LONGEST} then m else ceil(0.8 * least(13, m)) end),
r as (select a.did, a.pid, a.m, a.diag + a.p as start_word, b.p - a.p + 1 as n_words, b.k - a.k + 1 as n_equal from q a join q b on a.did = b.did and a.pid = b.pid and a.diag = b.diag and a.p <= b.p),
s as (select * from r where (m < {_LONGEST} and n_equal = m) or (m >= {_LONGEST} and n_words >= least(13, m) and n_equal >= n_words * 0.8))
select d.doc_id, i.item_id, start_word, n_words, n_equal from s join d using (did) join i using (pid)
qualify row_number() over (partition by d.doc_id, i.item_id order by n_words desc, n_equal desc, start_word) = 1
"""


# CRC-32 by its table, which its rule makes; ``{bytes}`` is a list of byte values.
_CRC_TABLE = "crc(t) as (select list(c order by i) from (select i, list_reduce(range(8), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i) as c from range(256) r(i)))"


def _crc(byte_list: str) -> str:
    return f"xor(list_reduce({byte_list}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _plus(state: str, cost: str, op: str) -> str:
    """A state is its cost in nine digits and its audit, so that texts are in order of both."""
    return f"(lpad(cast(cast(left({state}, 9) as int) + {cost} as varchar), 9, '0') || substr({state}, 10) || '{op}')"


_NEVER = "'400000000'"


def _stay(state: str, initial: str) -> str:
    kept = _plus(state, "x.more", "K")
    return f"case when x.bad then {_NEVER} when x.c = '{initial}' then {kept} else {_plus(state, 'x.more + 2', 'R')} end"


def _mended(rows: str) -> str:
    """Rows (r, i, e, s, u, a) after inserts."""
    u = f"least(u, {_plus('e', '2', 'I')}, {_plus('s', '2', 'I')}, {_plus('a', '2', 'I')})"
    return f"select r, i, e, s, u, least(a, {_plus('u', '2', 'I')}) as a from (select r, i, e, s, {u} as u, a from ({rows}))"


_OP12_SQL = rf"""
with recursive {_CRC_TABLE},
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, dense_rank() over (order by conv_id) as r,
 coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations),
h as (select r, turn, role, text, {_crc("list_transform(string_split(key, ''), lambda ch: cast(unicode(ch) as bigint))")} % 20 as h from k, crc),
m as (select r, turn, case when h = 4 then 'user' else role end as role, case h when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when h = 3 then 2 else 1 end)) as again from h where h <> 0),
o as (select *, row_number() over (partition by r order by turn nulls first, role, text, again) as i, row_number() over (partition by r, role, text order by turn nulls first, again) as n, regexp_replace(text, '[\x20\x09-\x0D]+$', '') as s from m),
f as (select r, i, turn, role, text, left(role, 1) as c, lag(left(role, 1)) over (partition by r order by i) as p,
 case when s = '' then 'blank' when n > 1 then 'duplicate' when right(s, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from o),
x as (select r, i, c, fault in ('blank', 'duplicate') as bad, (fault = 'truncated')::int as more from f),
dp(r, i, e, s, u, a) as (({_mended(f"select distinct r, cast(0 as bigint) as i, '000000000' as e, {_NEVER} as s, {_NEVER} as u, {_NEVER} as a from k")})
 union all ({_mended(f"select d.r, x.i, {_plus('d.e', '3', 'D')} as e, least({_plus('d.s', '3', 'D')}, case when not x.bad and x.c = 's' then {_plus('d.e', 'x.more', 'K')} else {_NEVER} end) as s, least({_plus('d.u', '3', 'D')}, {_stay('least(d.e, d.s, d.a)', 'u')}) as u, least({_plus('d.a', '3', 'D')}, {_stay('d.u', 'a')}) as a from dp d join x on x.r = d.r and x.i = d.i + 1")})),
b as (select r, cast(left(v, 9) as bigint) as cost, substr(v, 10) as audit from (select r, arg_max(least(e, a), i) as v from dp group by r)),
ch as (select r, unnest(string_split(audit, '')) as op, unnest(range(length(audit))) as j from b where audit <> ''),
w as (select *, sum((op <> 'I')::int) over q as i, sum((op <> 'D')::int) over q as e from ch window q as (partition by r order by j)),
y as (select w.*, f.role, f.text, bool_or(w.op = 'K' and w.e = 1 and left(f.role, 1) = 's') over (partition by w.r) as sys from w left join f on f.r = w.r and f.i = w.i),
z as (select r, string_agg(case when op = 'K' then role when (e - sys::int) % 2 = 1 then 'user' else 'assistant' end || ':' || case when op = 'I' then '' else text end, chr(10) order by j) as said from y where op <> 'D' group by r),
g as (select r, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (p || c not in ('su', 'ua', 'au')) as illegal from f group by r)
select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cost, audit, sha256(coalesce(said, '')) as repaired_sha256
from (select distinct r, conv_id from k) join b using (r) left join g using (r) left join z using (r)
"""

# No keys: words without one letter, at its place, are compared.
_OP13_SQL = f"""
with recursive {_CRC_TABLE},
l as (select coalesce(cast(doc_id as varchar), '') as id, translate(run, '{_UP}', '{_LOW}') as run from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) as run from documents) where length(run) >= 6),
h as (select run, {_crc("flatten(list_transform(string_split(id || ':' || run, ''), lambda ch: case when unicode(ch) < 128 then [cast(unicode(ch) as bigint)] else [195, cast(unicode(ch) as bigint) - 64] end))")} as h from l, crc),
w as (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word from h),
v as (select word, count(*) as n from w where length(word) >= 6 group by word having count(*) >= 5),
d as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as x from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
p as (select a.word, b.word as other, b.n from d a join d b on a.x = b.x and a.i = b.i and a.word <> b.word union select d.word, v.word, v.n from d join v on d.x = v.word union select v.word, d.word, d.n from d join v on d.x = v.word),
q as (select word, count(*) as n_near, first(other order by n desc, other) as other, max(n) as top from p group by word),
g as (select word, v.n, coalesce(n_near, 0) as n_near, case when top >= 5 * v.n then other end as form, case when top >= 5 * v.n then top end as form_n from v left join q using (word)),
walk(word, stop) as (select word, word from g union all select walk.word, g.form from walk join g on g.word = walk.stop where g.form is not null)
select g.word, g.form, walk.stop as root, g.n, g.n_near, g.form_n from g join walk using (word) join g e on e.word = walk.stop and e.form is null
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": _OP2_SQL, "op3_ngram_jaccard_join": _OP3_SQL, "op7_line_dedup": _OP7_SQL, "op10_decontaminate": _OP10_SQL, "op12_conversation_repair": _OP12_SQL, "op13_spelling_variants": _OP13_SQL}
