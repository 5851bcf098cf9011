"""The queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each document, whole text, fitted on labels outside the held-out third. Null texts score as empty; ties of 0.5 predict 1."""
    from tallyloom.llm import quality

    third = F.crc32(F.col("doc_id").cast("string")) % 3
    model = quality.fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable=third != 1)
    out = quality.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return out.select("doc_id", (third == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors. Vectors that are null, zero or not finite link with nothing."""
    from tallyloom.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), floor=0.95)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back. Null html: empty; rows without an id are responses; an empty table gives no row."""
    from tallyloom.llm import warc
    from tallyloom.llm.scratch import shared_path, written

    folder = shared_path(spark, "warc")
    warc.write_archives(warc.planned(table(spark, sf_dir, "pages"), least_bytes=1000), folder)
    records = warc.read_archives(warc.archive_files(spark, folder), keep_payload=False).drop("payload")
    return warc.resolved(written(records, "records"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and components of all documents. Null texts have the empty set and link with nothing."""
    from tallyloom.llm.ngram_join import jaccard_components

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, n=3, threshold=(90, 100))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated passages. Null texts have no words."""
    from tallyloom.llm.substring_dedup import drop_repeated_passages

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_passages(docs, window=50).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts. Null texts are empty; rows of one id follow each other by text."""
    from tallyloom.llm.order_minhash import fingerprinted

    found = fingerprinted(table(spark, sf_dir, "documents"), filled=True)
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document. Null texts have size 0; null sources are one source, the last."""
    from tallyloom.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2).drop("source", "copies")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all pieces. Null texts are an end token alone."""
    from tallyloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), capacity=1024, end_id=2, keep_ids=False)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from what was rendered. Null text: empty; a null role stays null."""
    from tallyloom.llm import chat

    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.sql(f"values (-1L, 0L, 'user', '{tricky}'), (-1L, 1L, 'assistant', '{tricky}') as t(conv_id, turn, role, text)"))
    out = chat.formatted_chats(chat.events_from_turns(turns))
    out = out.withColumn("turns", chat.parsed(F.col("formatted"))).withColumn("learned", chat.learned(F.col("formatted"), F.col("loss")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that a smaller id holds. Null texts are one empty line."""
    from tallyloom.llm.line_dedup import drop_shared_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_shared_lines(docs, min_chars=10, min_docs=2).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of 64 finite components; others are left out. Rows without an id are assigned too, as the last to be seeds."""
    from tallyloom.llm.ball_tree import cluster_vectors

    found = cluster_vectors(table(spark, sf_dir, "embeddings"), dims=64, k=40, rounds=5, scale=256, seed="2:")
    said = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(said, 256).alias("centroid_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents. Null texts are empty; of rows without an id one stays if no row of the group has an id."""
    from tallyloom.llm.exact_dedup import copy_groups

    return copy_groups(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in one of three forms, and what is read back from it. Null texts are empty and plain."""
    from tallyloom.llm.fill_middle import fill_middle, restored

    out = fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=42, rate=50, spm_rate=80)
    sizes = [F.char_length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return out.select("doc_id", "n", "form", *sizes, F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that do not depend on how fingerprints are made."""
    return op6_order_minhash(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that do not depend on how rates are rounded; targets in hundredths of a word."""
    return op7_source_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round(F.col("target") * 100).cast("long").alias("target_cents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"edited_texts": edited_texts, "mixing_targets": mixing_targets}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": WARC_SQL,
        "op9_chat_format": CHAT_SQL,
        "op5_substring_dedup": SUBSTRING_SQL,
        "op10_line_dedup": LINE_SQL,
        "op2_embedding_dedup": VECTOR_SQL,
        "op4_ngram_join": JACCARD_SQL,
        "op11_centroid_clustering": cluster_sql(),
        "op12_exact_dedup": COPIES_SQL,
        "op13_fill_in_middle": MIDDLE_SQL,
        "edited_texts": EDITED_SQL,
        "mixing_targets": TARGET_SQL,
    }


WARC_SQL = r"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select payload_digest, max(page_id) as first from p where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
       case when page_id < first then 'revisit' else 'response' end as record_type,
       case when page_id < first then first end as refers_to
from p left join m using (payload_digest)
"""

CHAT_SQL = r"""
with t as (select conv_id, turn, role, coalesce(text, '') as text from conversations
           union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&#91;') as safe,
             replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&#91;') as safe_role from t)
select conv_id, count(*) as n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length(safe) + length('<|turn|><|end|>') + coalesce(1 + length(safe_role), 0))::bigint as formatted_chars
from e group by conv_id
"""

SUBSTRING_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
p as (select doc_id, unnest(range(1, len(words) - 48)) as pos, words from w where len(words) >= 50),
g as (select doc_id, pos, md5(array_to_string(words[pos:pos + 49], ' ')) as h from p),
m as (select h, min(doc_id) as least from g group by h),
hit as (select g.doc_id, g.pos from g join m using (h) where g.doc_id > m.least),
gone as (select distinct doc_id, unnest(range(pos, pos + 50)) as pos from hit),
each as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as pos from w),
kept as (select each.doc_id, count(*) as n, string_agg(word, ' ' order by each.pos) as t
         from each left join gone on gone.doc_id = each.doc_id and gone.pos = each.pos where gone.pos is null group by each.doc_id)
select w.doc_id, len(words) as n_words, len(words) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept on kept.doc_id = w.doc_id
"""

LINE_SQL = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
s as (select key, min(doc_id) as least from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
f as (select k.doc_id, k.pos, k.line, s.least is not null and k.doc_id > s.least as gone from k left join s using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from f group by doc_id
"""

_REACH = """
reach(node, component) as (select node, node from nodes union select l.b, r.component from reach r join links l on l.a = r.node)"""

VECTOR_SQL = f"""
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
good as (select * from v where vec_id is not null and len(e) > 0 and len([x for x in e if x is null or isnan(x) or isinf(x)]) = 0 and len([x for x in e if x <> 0]) > 0),
links as (select x.vec_id as a, y.vec_id as b from good x join good y on x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.95),
nodes as (select distinct a as node from links), {_REACH},
least as (select node, min(component) as component from reach group by node),
n as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n.n, 0) as n_links, coalesce(least.component, vec_id) as component_id, vec_id is not null and vec_id = coalesce(least.component, vec_id) as kept
from v left join n on n.a = v.vec_id left join least on least.node = v.vec_id
"""

JACCARD_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
g as (select distinct doc_id, md5(array_to_string(g, ' ')) as h from (
  select doc_id, words[i:i + 2] as g from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w where len(words) >= 3)
  union all select doc_id, words from w where len(words) between 1 and 2)),
n as (select doc_id, count(*) as n from g group by doc_id),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as common from g x join g y on x.h = y.h and x.doc_id <> y.doc_id group by 1, 2),
links as (select a, b from shared join n p on p.doc_id = a join n q on q.doc_id = b where 100 * common >= 90 * (p.n + q.n - common)),
nodes as (select distinct a as node from links), {_REACH},
least as (select node, min(component) as component from reach group by node)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(least.component, w.doc_id) as component_id
from w left join n using (doc_id) left join least on least.node = w.doc_id
"""

EDITED_SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents),
o as (select doc_id, t, coalesce(lead(t) over (order by doc_id desc), first_value(t) over (order by doc_id desc)) as after from d)
select doc_id, length(t) as n_chars, sha256(left(t, length(t) - length(t) // 2) || left(after, length(t) // 2)) as edited_sha256 from o
"""

TARGET_SQL = r"""
with recursive d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from s),
f(round, source, source_size, weight, stopped) as (
  select 0, source, source_size, weight, false from w
  union all
  select round + 1, source, source_size, weight,
    stopped or (sum(source_size) over () * 1.5 - coalesce(sum(2.0 * source_size) filter (where stopped) over (), 0)) * weight / sum(weight) filter (where not stopped) over () >= 2 * source_size
  from f where round < 20 and not stopped or round < 20 and stopped),
z as (select * from f where round = 20),
t as (select source, source_size, case when stopped then 2.0 * source_size else (sum(source_size) over () * 1.5 - coalesce(sum(2.0 * source_size) filter (where stopped) over (), 0)) * weight / sum(weight) filter (where not stopped) over () end as target from z)
select doc_id, size, source_size, round(target * 100)::bigint as target_cents from d join t on t.source is not distinct from d.source
"""

COPIES_SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256
from d window same as (partition by t)
"""

MIDDLE_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as x from documents),
u as (select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u,
             [('0x' || substr(x, 1 + 8 * i, 8))::bigint for i in range(4)] as h from d),
c as (select *, len(u) as n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) as lo, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) as hi,
             case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 50 then 'plain' when h[4] % 100 < 80 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(u[1:lo], '') as prefix, array_to_string(u[lo + 1:hi], '') as middle, array_to_string(u[hi + 1:], '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(t) as restored_sha256
from p
"""


def cluster_sql(k: int = 40, rounds: int = 5) -> str:
    """All rounds, one after the other: centroids as rows, distances from sums of products of whole numbers."""
    text = f"""
with v as materialized (select row_number() over () as r, vec_id, [floor(256 * y::double) for y in embedding] as x from embeddings
      where len(embedding) = 64 and len([y for y in embedding if y is null or isnan(y) or isinf(y)]) = 0),
c0 as materialized (select row_number() over (order by sha256('2:' || vec_id) nulls last, x) - 1 as j, x as c from v order by j limit {k})"""
    near = "select r, min_by(j, (list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)) * {k} + j) as j from v cross join c{n} group by r"
    for n in range(rounds):
        text += f""",
a{n} as materialized ({near.format(k=k, n=n)}),
s{n} as (select j, i, sum(x[i]::bigint) as total, count(*) as n from a{n} join v using (r) cross join range(1, 65) t(i) group by j, i),
m{n} as (select j, list(floor_div order by i) as c from (select j, i, ((total - ((total % n) + n) % n) // n)::double as floor_div from s{n}) group by j),
c{n + 1} as materialized (select j, coalesce(m{n}.c, c{n}.c) as c from c{n} left join m{n} using (j))"""
    return text + f""",
a as materialized ({near.format(k=k, n=rounds)}),
f as (select vec_id, j, c, (list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::bigint as distance from a join v using (r) join c{rounds} using (j))
select vec_id, j::int as cluster, distance, (sum(distance) over (partition by j))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,
       sha256(array_to_string([y::bigint for y in c], ',')) as centroid_sha256
from f
"""
