"""The corpus operators' queries and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from pagewright.llm import arc_warc, centroid_clusters, chat_format, embedding_dedup, mixing, ordinal_quality, packing, piece_codec, quality_rules, simhash_dedup, suffix_dedup, token_counts, turn_repair
from pagewright.llm.common import materialize


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.find_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.size("spans").cast("long").alias("n_spans"), "sources")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(read(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = ordinal_quality.score(docs, ordinal_quality.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.col("__pw_expected").alias("expected_grade"), F.col("__pw_tail").alias("tail_probability"), F.col("__pw_kept").alias("kept"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digest(chat_format.examples(turns.union(planted)))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_warc.archive_pages(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damage(read(spark, sf_dir, "conversations")))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster_vectors(read(spark, sf_dir, "embeddings"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return piece_codec.digests(piece_codec.decode_ids(piece_codec.encode_texts(read(spark, sf_dir, "documents"), path), path))


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word statistics and base rules of op1 alone, which SQL can express."""
    found = quality_rules.measure(read(spark, sf_dir, "documents"), None)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality_rules.base_failed().alias("base_failed"))


def fingerprint_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index, links and components of op10 over fingerprints that SQL can make: sixty documents share one but for two to five bits that follow from their number."""
    n = F.col("doc_id")
    group = F.conv(F.substring(F.md5(F.floor(n / 60).cast("long").cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    bit = lambda k: F.expr(f"shiftleft(1L, cast({k} as int))")
    own = bit("(doc_id * 7) % 59").bitwiseXOR(bit("(doc_id * 11 + 5) % 61")).bitwiseXOR(F.when(n % 3 == 0, bit("(doc_id * 13 + 1) % 53").bitwiseXOR(bit("(doc_id * 17 + 3) % 47"))).otherwise(F.lit(0).cast("long")))
    prints = read(spark, sf_dir, "documents").select(n.cast("long").alias("doc_id"), F.when(n % 10 == 0, group).otherwise(group.bitwiseXOR(own)).alias("fp"), n.cast("long").alias("tid"))
    return simhash_dedup.components(materialize(prints, "fingerprints")).select("doc_id", "fp", "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_OP3_SQL = r"""
with sized as (
  select doc_id, source is null as no_source, coalesce(source, '') as src,
         coalesce(len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')), 0)::bigint as size,
         md5('mix-1|' || coalesce(doc_id::varchar, '') || '|' || coalesce(source, '') || '|' || md5(coalesce(text, ''))) as key,
         ('0x' || substr(key, 1, 8))::bigint / 4294967296.0::double as draw, row_number() over (partition by key) - 1 as k
  from documents),
totals as (select no_source, src, sum(size)::bigint as source_size from sized group by all),
weighed as (
  select *, [3.0, 1.0, 2.0][((row_number() over (order by no_source, encode(src)) - 1) % 3 + 1)::int]::double as weight, source_size * 2.0::double as cap from totals),
ordered as (
  select *, cap / weight as bound,
         sum(source_size) over ()::double * 1.5::double - coalesce(sum(cap) over before, 0) as money,
         sum(weight) over () - coalesce(sum(weight) over before, 0) as weight_left
  from weighed window before as (order by cap / weight, no_source, encode(src) rows between unbounded preceding and 1 preceding)),
levels as (select *, first_value(case when money / weight_left <= bound then money / weight_left end ignore nulls)
                       over (order by bound, no_source, encode(src) rows between unbounded preceding and unbounded following) as level from ordered),
goals as (select no_source, src, source_size, least(cap, coalesce(level * weight, cap))::double as target from levels),
rated as (select s.*, g.source_size, g.target, case when g.source_size > 0 then g.target / g.source_size else 0 end as rate from sized s join goals g using (no_source, src)),
copied as (select *, (floor(rate) + ceil((k + 1) * (rate - floor(rate)) - draw) - ceil(k * (rate - floor(rate)) - draw))::bigint as copies from rated)
select doc_id, size, source_size, target, size * copies as taken, copies from copied
"""

_OP5_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
safe as (
  select *, length(regexp_replace(replace(text, '\', '\\'), '([\[<])(/?(?:INST|SYS|TURN)\]|OUT\]|AS\]|/?s>)', '\1\\\2', 'g')) as n,
         length(regexp_replace(replace(role, '\', '\\'), '([\[<])(/?(?:INST|SYS|TURN)\]|OUT\]|AS\]|/?s>)', '\1\\\2', 'g')) as r from turns),
placed as (
  select *, sum(n + case role when 'user' then 15 when 'system' then 13 when 'assistant' then 11 else 21 + r end) over w as upto,
         row_number() over w = count(*) over (partition by conv_id) as last
  from safe window w as (partition by conv_id order by turn nulls first, role, text rows unbounded preceding))
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       coalesce(sum(upto + 3) filter (role = 'assistant' or last), 0)::bigint as formatted_chars
from placed group by conv_id
"""


_STATISTICS_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\f\r]+') as w from documents),
spans as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, s) as n from spans) where n > 1),
covered as (select doc_id, count(distinct i + j) as n from twice, (select unnest(range(0, 8)) as j) group by 1),
lines as (select doc_id, line, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^ \t\n\x0b\f\r]') group by 1, 2),
dup as (select doc_id, sum(n - 1) as n from lines group by 1),
stats as (
  select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words
  from d left join dup on dup.doc_id = d.doc_id left join covered on covered.doc_id = d.doc_id)
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from stats
"""

_PRINTS_SQL = r"""
with recursive p as (
  select doc_id, ('0x' || substr(md5((doc_id // 60)::varchar), 1, 15))::bigint as g,
         xor(1::bigint << ((doc_id * 7) % 59)::int, 1::bigint << ((doc_id * 11 + 5) % 61)::int) as a, xor(1::bigint << ((doc_id * 13 + 1) % 53)::int, 1::bigint << ((doc_id * 17 + 3) % 47)::int) as b from documents),
f as (select doc_id, case when doc_id % 10 = 0 then g else xor(g, xor(a, case when doc_id % 3 = 0 then b else 0 end)) end as fp from p),
links as (select x.doc_id as a, y.doc_id as b from f x join f y on x.doc_id <> y.doc_id where bit_count(xor(x.fp, y.fp)) <= 4),
reach(doc_id, other) as (select doc_id, doc_id from f union select reach.doc_id, links.b from reach join links on reach.other = links.a),
lowest as (select doc_id, min(other)::bigint as component_id from reach group by 1)
select f.doc_id, fp, component_id from f join lowest on lowest.doc_id = f.doc_id
"""

_OP6_SQL = r"""
with recursive
rows_ as (select row_number() over () as r, vec_id, [x::double for x in embedding] as e from embeddings),
sound as (
  select * from rows_ where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.r as a, b.r as b from sound a join sound b on a.r <> b.r and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
reach(r, other) as (select r, r from rows_ union select reach.r, links.b from reach join links on reach.other = links.a),
lowest as (select reach.r, min(o.vec_id) as component_id from reach join rows_ o on o.r = reach.other group by 1),
counted as (select a as r, count(*) as n from links group by 1)
select v.vec_id, coalesce(c.n, 0)::bigint as n_links, l.component_id, v.vec_id is not distinct from l.component_id as kept
from rows_ v join lowest l on l.r = v.r left join counted c on c.r = v.r
"""

_OP9_SQL = r"""
with hashed as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as hex from pages),
digested as (
  select page_id, payload_bytes,
         list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
           lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (5 * i + 1)::int, 5))::bigint >> s) & 31) + 1)::int, 1)), 'string_agg', '')), 'string_agg', '') as payload_digest
  from hashed),
ranked as (select *, max(page_id) over (partition by payload_digest) as best from digested)
select page_id, payload_bytes, payload_digest,
       case when best is null or page_id is not distinct from best then 'response' else 'revisit' end as record_type,
       case when best is null or page_id is not distinct from best then null else best end as refers_to
from ranked
"""


_CENTROIDS_HEAD = """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x, sha256('2:' || coalesce(vec_id::varchar, '')) as key
  from embeddings
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
c0 as (select row_number() over (order by key, x) - 1 as k, x from v order by key, x limit 40),
"""
_CENTROIDS_NEAREST = """
a{n} as materialized (
  select r, any_value(v.vec_id) as vec_id, any_value(v.x) as x, min_by(k, d * 64 + k) as k, min(d)::bigint as d
  from (select v.*, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::hugeint as d from v cross join c{n} c) v group by r),
"""
_CENTROIDS_MOVED = """
c{m} as materialized (
  select c.k, coalesce(m.x, c.x) as x from c{n} c left join (
    select k, list(((s - ((s % n) + n) % n) / n)::bigint order by j) as x
    from (select k, j, sum(y)::hugeint as s, count(*)::hugeint as n from (select k, unnest(x) as y, generate_subscripts(x, 1) as j from a{n}) group by k, j) group by k) m on m.k = c.k),
"""


def _centroids_sql(rounds: int = 5) -> str:
    steps = "".join(_CENTROIDS_NEAREST.format(n=n) + _CENTROIDS_MOVED.format(n=n, m=n + 1) for n in range(rounds))
    last = f"""
s as (select k, sum(d)::bigint as own from a{rounds} group by k)
select a.vec_id, a.k::int as cluster, a.d as distance, s.own as cluster_inertia, (select sum(d)::bigint from a{rounds}) as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
from a{rounds} a join s on s.k = a.k join c{rounds} c on c.k = a.k
"""
    return _CENTROIDS_HEAD + steps + _CENTROIDS_NEAREST.format(n=rounds) + last


#: Conversations with faults by CRC-32 of conv_id:turn, their rows' first faults, the least cost from every state before every row (backwards), then the edits (forwards).
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
_OP11_SQL = r"""
with recursive
steps as (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, z: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from (select unnest(range(256)) as i)),
crc as (select list(v order by i) as tab from steps),
src as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint)),
                         lambda a, b: xor(a >> 8, tab[((xor(a, b) & 255) + 1)::int])), 4294967295::bigint) % 20 as f
  from conversations, crc),
hit as (
  select conv_id, turn, case when f = 4 then 'user' else role end as role, case f when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select *, unnest(range(case f when 0 then 0 when 3 then 2 else 1 end)) as again from src)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, count(*) over (partition by conv_id) as n, rtrim(text, E' \t\n\x0b\f\r') as seen from hit),
r as (
  select *, left(role, 1) as kind,
         case when seen = '' then 1 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2 when right(seen, 1) not in ('.', '!', '?') then 3 else 0 end as fault,
         lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair from placed),
back(conv_id, i, c0, c1, c2, c3) as (
  select distinct conv_id, n + 1, 0, 4, 2, 0 from r
  union all
  select conv_id, i, least(b0, 2 + b2, 4 + b3), least(b1, 2 + b2, 4 + b3), least(b2, 2 + b3), least(b3, 2 + b2) from (
    select conv_id, i, least(3 + c0, more + 2 + c2, case kind when 's' then more + c1 when 'u' then more + c2 else 999999 end) as b0, least(3 + c1, more + 2 + c2, case kind when 'u' then more + c2 else 999999 end) as b1,
           least(3 + c2, more + 2 + c3, case kind when 'a' then more + c3 else 999999 end) as b2, least(3 + c3, more + 2 + c2, case kind when 'u' then more + c2 else 999999 end) as b3
    from (select r.conv_id, r.i, r.kind, case r.fault when 1 then 999999 when 2 then 999999 when 3 then 1 else 0 end as more, b.c0, b.c1, b.c2, b.c3 from back b join r on r.conv_id is not distinct from b.conv_id and r.i = b.i - 1))),
costs as (
  select r.*, [h.c0, h.c1, h.c2, h.c3] as now, [b.c0, b.c1, b.c2, b.c3] as after, case fault when 1 then 999999 when 2 then 999999 when 3 then 1 else 0 end as more,
         case kind when 's' then [1, -1, -1, -1] when 'u' then [2, 2, -1, 2] when 'a' then [-1, -1, 3, -1] else [-1, -1, -1, -1] end as keeps
  from r join back h on h.conv_id is not distinct from r.conv_id and h.i = r.i join back b on b.conv_id is not distinct from r.conv_id and b.i = r.i + 1),
walk(conv_id, i, state, audit, lines) as (
  select distinct conv_id, 1::bigint, 0, '', []::varchar[] from r
  union all
  select conv_id, case when letter = 'I' then i else i + 1 end, case letter when 'D' then state when 'K' then keeps[state + 1] else written end, audit || letter,
         case letter when 'D' then lines when 'I' then list_append(lines, said || ':') when 'K' then list_append(lines, role || ':' || text) else list_append(lines, said || ':' || text) end
  from (
    select *, case when 3 + after[state + 1] = now[state + 1] then 'D' when 2 + now[written + 1] = now[state + 1] then 'I' when keeps[state + 1] >= 0 and more + after[keeps[state + 1] + 1] = now[state + 1] then 'K' else 'R' end as letter
    from (
      select c.*, w.state, w.audit, w.lines, case w.state when 2 then 3 else 2 end as written, case w.state when 2 then 'assistant' else 'user' end as said
      from walk w join costs c on c.conv_id is not distinct from w.conv_id and c.i = w.i))),
ended as (
  select w.conv_id, audit || ['', 'II', 'I', ''][state + 1] as audit, list_concat(lines, case state when 1 then ['user:', 'assistant:'] when 2 then ['assistant:'] else [] end) as lines
  from walk w join (select distinct conv_id, n from r) t on t.conv_id is not distinct from w.conv_id and w.i = t.n + 1),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
  from r group by 1)
select s.conv_id, coalesce(c.gaps, 0)::bigint as gaps, coalesce(c.blank, 0)::bigint as blank, coalesce(c.duplicate, 0)::bigint as duplicate, coalesce(c.truncated, 0)::bigint as truncated, coalesce(c.illegal, 0)::bigint as illegal,
       coalesce(b.c0, 0)::bigint as cost, coalesce(e.audit, '') as audit, sha256(coalesce(array_to_string(e.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) s left join counts c on c.conv_id is not distinct from s.conv_id left join back b on b.conv_id is not distinct from s.conv_id and b.i = 1 left join ended e on e.conv_id is not distinct from s.conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_mix": op3_mix,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_chat": op5_chat,
        "op6_embeddings": op6_embeddings,
        "op7_token_counts": op7_token_counts,
        "op8_packing": op8_packing,
        "op9_warc": op9_warc,
        "op10_simhash": op10_simhash,
        "op11_turn_repair": op11_turn_repair,
        "op12_centroids": op12_centroids,
        "op13_pieces": op13_pieces,
        "pipeline": pipeline,
        "quality_statistics": quality_statistics,
        "fingerprint_components": fingerprint_components,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mix": _OP3_SQL, "op5_chat": _OP5_SQL, "op6_embeddings": _OP6_SQL, "op9_warc": _OP9_SQL, "op11_turn_repair": _OP11_SQL, "op12_centroids": _centroids_sql(), "quality_statistics": _STATISTICS_SQL, "fingerprint_components": _PRINTS_SQL}
