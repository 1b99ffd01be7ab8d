"""One query per operator over its whole table, and the SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard_join, langid, license_scan, merkle, quality, suffix_dedup, topk, toxicity, turns, url_filters, warc
from .common import group_key, join_small, text_remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Fixed values of the url filter: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Strings of this many words ("over 50") count as a passage, however few their bytes.
PASSAGE_WORDS = 51

#: crc32 of the text ``k``, unsigned, in DuckDB: eight shifts per byte.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
        regexp_extract_all(k, '.', 0, 's'), lambda ch: [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: xor(xor(c, greatest(x, 0)) >> 1, (xor(c, greatest(x, 0)) & 1) * 3988292384)), 4294967295)"""


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"])


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = text_remainder(F.col("doc_id"), 5) == 0
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(F.col("toxic").isNotNull() & ~held)
    model = toxicity.fit(join_small(documents.where(~held), labels, ["doc_id"]))
    scored = toxicity.score_texts(documents, model, keep=["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


@query(
    "op8_url_filter",
    """
    with recursive parts as (
      select page_id, url,
             translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') as path
      from pages
    ), rules(verdict, h, p) as (values
      ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
      ('block', 'net', '/es/'), ('block', 'net', '/fr/')
    ), urls as (
      select url, any_value(host) as host, any_value(path) as path from parts where url is not null group by url
    ), targets as (
      select url as src, unnest(
        regexp_extract_all(html, '<link\\b[^>]*\\bhref\\s*=\\s*["'']?([^"''\\s>]+)[^>]*\\brel\\s*=\\s*["'']?canonical\\b', 1, 'is')
        || regexp_extract_all(html, '<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is')
        || regexp_extract_all(html, '<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*\\bcontent\\s*=\\s*["'']?\\s*[0-9.]*\\s*;\\s*url\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is')
      ) as dst
      from pages where url is not null and html is not null
    ), edges as (
      select src, dst from targets where instr(dst, '://') > 0 and src <> dst
      union
      select dst, src from targets where instr(dst, '://') > 0 and src <> dst
    ), reach(src, dst) as (
      select src, dst from edges
      union
      select reach.src, edges.dst from reach join edges on reach.dst = edges.src
    ), nodes as (
      select distinct src as url,
             translate(regexp_extract(src, '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(src, '^.*?://([^/?#]*)([^?#]*)', 2, 's') as path
      from edges
    ), own as (
      select n.url, arg_max(r.verdict, length(r.h || r.p)) as verdict
      from nodes n join rules r
        on (n.host = r.h or ends_with(n.host, '.' || r.h)) and starts_with(n.path, r.p)
      group by n.url
    ), shared as (
      select reach.src as url,
             case when bool_or(verdict = 'allow') then 'allow' when bool_or(verdict = 'block') then 'block' end as verdict
      from reach join own on own.url = reach.dst group by reach.src
    ), judged as (
      select u.url, arg_max(r.h || r.p, length(r.h || r.p)) as rule, arg_max(r.verdict, length(r.h || r.p)) as verdict
      from urls u join rules r
        on (u.host = r.h or ends_with(u.host, '.' || r.h)) and starts_with(u.path, r.p)
      group by u.url
    )
    select p.page_id, p.host, p.path, j.rule, coalesce(j.verdict, s.verdict, 'allow') as verdict
    from parts p left join judged j on j.url = p.url left join shared s on s.url = p.url
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = langid.held_out(F.col("doc_id"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(documents.where(~held))
    predicted = langid.predict(documents, model, keep=["doc_id"])
    return predicted.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query(
    "op3_decontamination",
    """
    with docs as (
      select row_number() over () as row, doc_id,
             coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w
      from documents
    ), items as (
      select item_id,
             coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w
      from benchmark
    ), windows as (
      select distinct item_id, least(len(w), 10) as n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') as g
      from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as s from items where len(w) > 0)
    ), sizes as (select distinct n from windows
    ), grams as (
      select row, n, s, array_to_string(w[s : s + n - 1], ' ') as g
      from (select row, w, n, unnest(range(1, len(w) - n + 2)) as s from docs, sizes where len(w) >= n)
    ), hits as (
      select row, s, n, item_id from grams join windows using (n, g)
    ), spots as (
      select row, count(distinct p) as n_hit
      from (select distinct row, unnest(range(s, s + n)) as p from hits) group by row
    ), named as (
      select row, count(id) as n_items, string_agg(id, ',' order by id) as ids
      from (select distinct row, cast(item_id as varchar) as id from hits) group by row
    )
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
           sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from docs left join spots using (row) left join named using (row)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


@query(
    "op10_warc",
    """
    with own as (
      select page_id, coalesce(html, '') as payload from pages
    ), largest as (select payload, max(page_id) as response from own group by payload
    ), digits as (
      select page_id, payload, response, sha1(payload) as hex,
             list_transform(range(32), lambda i: (('0x' || substr(sha1(payload), (i * 5 // 4 + 1)::int, 2) || '0')::int
                 >> (7 - (i * 5) % 4)::int) & 31) as d
      from own join largest using (payload)
    )
    select page_id, cast(octet_length(encode(payload)) as bigint) as payload_bytes,
           array_to_string(list_transform(d, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x + 1, 1)), '') as payload_digest,
           case when page_id is distinct from response then 'revisit' else 'response' end as record_type,
           case when page_id is distinct from response then response end as refers_to
    from digits
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    index = warc.write(table(spark, sf_dir, "pages"), folder, "2024-01-01T00:00:00Z")
    page = lambda urn: F.nullif(F.split(urn, ":")[2], F.lit("")).cast("long")
    return warc.read(index, folder).select(
        page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page(F.col("refers_to")).alias("refers_to"),
    )


@query(
    "op2_topk",
    """
    with v as (
      select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q
      from embeddings
      where embedding is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), scored as (
      select a.row, a.vec_id as query_id, b.vec_id, cast(list_dot_product(a.q, b.q) as bigint) as score
      from v a join v b on a.row <> b.row and len(a.q) = len(b.q)
      where a.vec_id % 50 = 0
    ), ranked as (
      select *, row_number() over (partition by row order by score desc, vec_id) as rank from scored
    )
    select query_id, cast(rank as int) as rank, vec_id, score from ranked where rank <= 5
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), (F.col("vec_id") % 50 == 0).alias("is_query"), topk.quantised(F.col("embedding")).alias("vector")
    )
    found = topk.search(vectors, 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"), words=PASSAGE_WORDS)


@query("op1_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query("op13_quality")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = text_remainder(F.col("doc_id"), 3) == 1
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(F.col("quality").isNotNull() & ~held)
    model = quality.fit(join_small(documents.where(~held), labels, ["doc_id"]))
    scored = quality.score_texts(documents, model, keep=["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def _sql_field(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::varchar)) || ':' || {column}::varchar, '-')"


def _sql_leaf(text: str) -> str:
    return f"sha256({' || '.join(_sql_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: Siblings before and behind a node ``p`` of its run in the tree ``t`` at level ``l``.
_SQL_SIDES = """
      select t, l, p, coalesce(string_agg(d, '') over (run rows between unbounded preceding and 1 preceding), '') as a,
             coalesce(string_agg(d, '') over (run rows between 1 following and unbounded following), '') as b
      from {nodes} where n > 1 window run as (partition by t, l, p // 3 order by p)"""


@query(
    "op11_merkle_manifest",
    f"""
    with recursive docs as (
      select row_number() over () as row, doc_id, coalesce('=' || source, '') as t, {_sql_leaf("text")} as leaf,
             case when ({CRC32_SQL}) % 2 = 0 then {_sql_leaf("replace(text, chr(10), '')")} end as other
      from (select *, doc_id::varchar as k from documents)
    ), placed as (
      select *, row_number() over (partition by t order by doc_id nulls first, leaf) - 1 as p, count(*) over (partition by t) as n from docs
    ), nodes(t, l, p, n, d) as (
      select t, 0, p, n, leaf from placed
      union all
      select t, l + 1, p // 3, (n + 2) // 3, sha256(string_agg(d, '' order by p)) from nodes where n > 1 group by t, l, p // 3, n
    ), sides as ({_SQL_SIDES.format(nodes="nodes")}
    ), subroots as (
      select t as g, d, row_number() over (order by t) - 1 as p, count(*) over () as n from nodes where n = 1
    ), tops(t, l, p, n, d) as (
      select '', 0, p, n, d from subroots
      union all
      select t, l + 1, p // 3, (n + 2) // 3, sha256(string_agg(d, '' order by p)) from tops where n > 1 group by t, l, p // 3, n
    ), top_sides as ({_SQL_SIDES.format(nodes="tops")}
    ), up(row, t, l, p, n, proof, folded) as (
      select row, t, 0, p, n, '', coalesce(other, leaf) from placed
      union all
      select row, t, l + 1, p // 3, (n + 2) // 3, proof || a || b, sha256(a || folded || b) from up join sides using (t, l, p) where n > 1
    ), above(row, t, l, p, n, proof, folded) as (
      select row, '', 0, s.p, s.n, proof, folded from up join subroots s on s.g = up.t where up.n = 1
      union all
      select row, t, l + 1, p // 3, (n + 2) // 3, proof || a || b, sha256(a || folded || b) from above join top_sides using (t, l, p) where n > 1
    )
    select doc_id, leaf, s.d as subroot, r.d as root, sha256(proof) as proof_sha256, folded as folded_root, folded = r.d as verified
    from above join docs using (row) join subroots s on s.g = docs.t cross join (select d from tops where n = 1) r where above.n = 1
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    parts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    damaged = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    other = F.when(damaged, merkle.leaf(*parts, F.translate("text", "\n", "")))
    found = merkle.manifest(documents, "source", "doc_id", merkle.leaf(*parts, F.col("text")), carry=other)
    return merkle.audited(found, "doc_id")


def damaged(conversations: DataFrame) -> DataFrame:
    """The damage that op12 repairs, by a hash of conversation and turn."""
    key = F.concat(*[F.coalesce(x, F.lit(" ")) for x in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))])
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("fault")
    )
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1)))
    role = F.when(fault == 4, "user").otherwise(F.col("role"))
    return rows.where(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy"))


@query(
    "op12_conversation_repair",
    f"""
    with recursive keyed as (
      select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
             coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k
      from conversations
    ), convs as (select conv_id, row_number() over () as c from (select distinct conv_id from conversations)
    ), hashed as (select c, turn, role, text, {CRC32_SQL} % 20 as fault from keyed join convs on keyed.conv_id is not distinct from convs.conv_id
    ), damaged as (
      select c, turn, case when fault = 4 then 'user' else role end as role,
             case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
      from hashed, (values (1), (2)) copies(copy) where fault <> 0 and (copy = 1 or fault = 3)
    ), ordered as (
      select *, row_number() over (partition by c order by turn nulls first, role, sha256(text)) as i,
             not regexp_matches(text, '[^\\x20\\x09-\\x0D]') as blank, not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') as cut
      from damaged
    ), faults as (
      select c, turn, role, text, i, left(role, 1) as initial,
             case when blank then 'blank' when row_number() over (partition by c, role, text order by i) > 1 then 'duplicate'
                  when cut then 'truncated' else '' end as fault,
             lag(left(role, 1)) over (partition by c order by i) || left(role, 1) not in ('su', 'ua', 'au') as illegal
      from ordered
    ), counted as (
      select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) as n,
             count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
             count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where illegal) as illegal
      from faults group by c
    ), inserts(t, j, u, o) as (values
      (0, 0, 0, []::varchar[]), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']),
      (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
      (2, 0, 2, []), (2, 1, 3, ['assistant:']), (3, 0, 3, []), (3, 1, 2, ['user:'])
    ), moves(t, op, initial, u, price) as (values
      (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (3, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0),
      (0, 'R', null, 2, 2), (1, 'R', null, 2, 2), (3, 'R', null, 2, 2), (2, 'R', null, 3, 2),
      (0, 'D', null, 0, 3), (1, 'D', null, 1, 3), (2, 'D', null, 2, 3), (3, 'D', null, 3, 3)
    ), best(c, i, t, cost, audit, turns) as (
      select c, 0::bigint, s.u, (2 * j)::bigint, repeat('I', j), s.o from counted, inserts s where s.t = 0
      union all
      select c, i, u, cost, audit, turns from (
        select b.c, f.i, s.u, b.cost + m.price + 2 * s.j + case when m.op <> 'D' and f.fault = 'truncated' then 1 else 0 end as cost,
               b.audit || m.op || repeat('I', s.j) as audit,
               b.turns || case m.op when 'D' then [] when 'K' then [f.role || ':' || f.text]
                 else [case m.u when 2 then 'user:' else 'assistant:' end || f.text] end || s.o as turns
        from best b join faults f on f.c = b.c and f.i = b.i + 1
        join moves m on m.t = b.t and (m.initial is null or m.initial = f.initial) and (m.op = 'D' or f.fault not in ('blank', 'duplicate'))
        join inserts s on s.t = m.u
      ) qualify row_number() over (partition by c, u order by cost, audit) = 1
    ), ended as (
      select c, cost, audit, turns from best join counted using (c) where i = n and t in (0, 3)
      qualify row_number() over (partition by c order by cost, audit) = 1
    )
    select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
           coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit,
           sha256(coalesce(array_to_string(turns, chr(10)), '')) as repaired_sha256
    from convs left join counted using (c) left join ended using (c)
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    repaired, account = turns.repair(damaged(conversations))
    every = conversations.select("conv_id").distinct().select("conv_id", group_key(F.col("conv_id")).alias("c"))
    out = every.join(account.drop("conv_id"), "c", "left").join(turns.digests(repaired), "c", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in turns.ACCOUNT[:-1]]
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256")
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), digest)
