"""The queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import chat, jaccard, langid, mixing, negatives, phrases, pieces, pii, quality_conv, rules, substrings, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.format_conversations(rows.unionByName(planted)))


def _held_out() -> Column:
    """The fold that no model learns from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(documents, pii.fit_from(documents))
    base = F.filter("spans", lambda s: s.base)
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s.base & (s.kind == kind))).cast("long").alias(f"n_{kind}")
    counts = [of_kind(kind) for kind in pii.KINDS[:4]]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s.kind == "secret")).cast("long").alias("n_secret"),
        F.size(F.filter("spans", lambda s: ~s.base)).cast("long").alias("n_added"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_conv.fit_from(documents.filter(~_held_out()), _table(spark, sf_dir, "labels").filter(~_held_out()))
    scored = quality_conv.predict(documents, model)
    return scored.select("doc_id", _held_out().alias("held_out"), "score", "predicted")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(documents.filter(~_held_out()))
    labelled = langid.predict(documents.drop("lang"), model)
    return labelled.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def piece_model() -> str:
    """Path of the public vocabulary file; its package is installed wherever Python workers run."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model())
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.element_at("ends", -1).cast("long").alias("spanned_bytes"),
        F.xxhash64("begins", "ends").alias("spans_hash"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixing.in_training_order(mixed).select("doc_id", "size", "source_size", "target", "taken", "copies", "first_position", "first_token")


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = rules.learn_from(documents, _table(spark, sf_dir, "labels"))
    judged = rules.judge(documents, learned, prefix="")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents").select("text", "lang"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the stated anchors: ids divisible by 100, against all rows
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of operator 3: the base spans."""
    return op3_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of operator 10: the statistics and the base rule."""
    return op10_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {"op1_warc": op1_warc, "op2_chat": op2_chat, "op3_pii": op3_pii, "op4_quality": op4_quality, "op5_jaccard": op5_jaccard, "op6_language": op6_language, "op7_pieces": op7_pieces, "op8_mixing": op8_mixing, "op9_vectors": op9_vectors, "op10_rules": op10_rules, "op11_phrases": op11_phrases, "op12_negatives": op12_negatives, "op13_substrings": op13_substrings, "pii_base": pii_base, "rule_statistics": rule_statistics}

_ESCAPED = r"""regexp_replace({x}, '([<\[])(\\*)(\|(?:turn|text|also|end|im_start|im_end|endoftext)\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')"""

_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_HELD = {
    "email": "true",
    "ip": "len(list_filter(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) > 3 or (length(ltrim(x, '0')) = 3 and ltrim(x, '0') > '255'))) = 0",
    "card": "length(digits) between 13 and 19 and list_sum(list_transform(range(length(digits)), lambda i: case when i % 2 = 0 then ascii(reverse(digits)[i + 1]) - 48"
    " when ascii(reverse(digits)[i + 1]) - 48 > 4 then 2 * (ascii(reverse(digits)[i + 1]) - 48) - 9 else 2 * (ascii(reverse(digits)[i + 1]) - 48) end)) % 10 = 0",
    "phone": "length(digits) between 9 and 15",
}
_MATCHED = " union all ".join(f"select doc_id, '{kind}' as kind, {k} as place, regexp_extract_all(text, '{p}') as hits, regexp_split_to_array(text, '{p}') as gaps from texts" for k, (kind, p) in enumerate(_PATTERNS.items()))

SQL = {
    "pii_base": f"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
matched as (select * from ({_MATCHED}) where len(hits) > 0),
each as (
  select doc_id, kind, place, unnest(hits) as hit,
    unnest(list_transform(range(len(hits)), lambda i: list_sum(list_transform(gaps[1:i + 1], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i], lambda h: length(h))), 0))) as b
  from matched
), held as (
  select * from (select *, regexp_replace(hit, '[^0-9]', '', 'g') as digits from each)
  where case kind when 'email' then {_HELD["email"]} when 'ip' then {_HELD["ip"]} when 'card' then {_HELD["card"]} else {_HELD["phone"]} end
), digested as (
  select doc_id, count(*) filter (where kind = 'email') as n_email, count(*) filter (where kind = 'ip') as n_ip, count(*) filter (where kind = 'card') as n_card,
    count(*) filter (where kind = 'phone') as n_phone, string_agg(kind || ':' || b::bigint || ':' || (b + length(hit))::bigint, ',' order by place, b) as listed
  from held group by doc_id
)
select d.doc_id, coalesce(n_email, 0)::bigint as n_email, coalesce(n_ip, 0)::bigint as n_ip, coalesce(n_card, 0)::bigint as n_card, coalesce(n_phone, 0)::bigint as n_phone,
  sha256(coalesce(listed, '')) as base_sha256
from documents d left join digested g on d.doc_id = g.doc_id
""",
    "rule_statistics": r"""
with texts as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents
), grams as (
  select doc_id, unnest(range(1, len(w) - 6)) as pos, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) as gram from texts where len(w) >= 8
), twice as (
  select doc_id, pos from (select doc_id, pos, count(*) over (partition by doc_id, gram) as n from grams) where n > 1
), held as (
  select doc_id, count(distinct word) as n from (select doc_id, unnest(range(pos, pos + 8)) as word from twice) group by doc_id
)
select t.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
  coalesce(n, 0)::bigint as n_repeat_words, len(w) < 20 or 100 * coalesce(n, 0) > 30 * len(w) as base_failed
from texts t left join held h on t.doc_id = h.doc_id
""",
    "op1_warc": """
with page as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as h from pages
), named as (
  select page_id, payload_bytes, translate(
    to_base(('0x' || substr(h, 1, 10))::bigint, 32, 8) || to_base(('0x' || substr(h, 11, 10))::bigint, 32, 8)
    || to_base(('0x' || substr(h, 21, 10))::bigint, 32, 8) || to_base(('0x' || substr(h, 31, 10))::bigint, 32, 8),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest, min(page_id) over (partition by h) as least from page
)
select page_id, payload_bytes, payload_digest, case when page_id > least then 'revisit' else 'response' end as record_type,
  case when page_id > least then least end as refers_to from named
""",
    "op8_mixing": r"""
with sized as (
  select doc_id, source, coalesce(text, '') as text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), src as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighed as (
  select *, 3 * source_size as cap, (3 * source_size)::double / weight as level, sum(source_size) over () as total, count(*) over () as n from (
    select *, place, [5, 2, 1][place % 3 + 1] as weight from (select *, row_number() over (order by source nulls last) - 1 as place from src))
), filled as (
  select *, (total - coalesce(sum(cap) over (order by level, place rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (order by level, place rows between current row and unbounded following) as share from weighed
), water as (select level as w_level, place as w_place, share as w_share from filled where level >= share order by level, place limit 1),
targets as (
  select *, sum(target * (1 - tilt)) over () as steady, sum(target * tilt) over () as rising from (select source, source_size, 0.5::double * (1 - 2 * place / greatest(n - 1, 1)::double) as tilt,
    case when w_level is not null and (level > w_level or (level = w_level and place >= w_place)) then least(weight * w_share, cap::double) else cap::double end as target
  from filled left join water on true)
), placed as (
  select s.doc_id, s.size, t.source_size, t.target, t.tilt, t.steady, t.rising, coalesce(sum(s.size) over (partition by s.source order by md5(coalesce(s.doc_id::varchar, '')), s.doc_id nulls first, s.text
      rows between unbounded preceding and 1 preceding), 0) + s.size / 2.0::double as middle
  from sized s join targets t on s.source is not distinct from t.source
), taken as (
  select *, case when size = 0 then 0 else floor(target / greatest(source_size, 1)) + case when middle < target - floor(target / greatest(source_size, 1)) * greatest(source_size, 1) then 1 else 0 end end::bigint as copies,
    least(middle / greatest(target, 1.0::double), 1.0::double) as u, 1 - tilt as b from placed
), timed as (
  select *, case when copies > 0 then round(case when abs(tilt) < 1e-12 then u else (sqrt(b * b + 4 * tilt * u) - b) / (2 * tilt) end, 12) end as first_position from taken
)
select doc_id, size, source_size, round(target, 6) as target, size * copies as taken, copies, first_position,
  round(steady * first_position + rising * first_position * first_position, 3) as first_token from timed
""",
    "op2_chat": f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked as (
  select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) as before from rows
)
select conv_id,
  count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  sum(length({_ESCAPED.format(x="text")}) + case when before = role then 8
      else 16 + length({_ESCAPED.format(x="role")}) + 7 end)::bigint as formatted_chars,
  sum(case when before = role then 0 else 1 end)::bigint as n_groups,
  count(*) filter (where role = 'assistant')::bigint as n_loss_spans
from marked group by conv_id
""",
    "op11_phrases": r"""
with piece as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), listed as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from piece),
often as materialized (
  select lang, phrase, count(*)::bigint as f from (
    select lang, unnest(w) as phrase from listed
    union all select lang, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) from listed
    union all select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) from listed
  ) group by lang, phrase having count(*) >= 10
), total as (select lang, sum(len(w))::bigint as n from listed group by lang),
candidate as materialized (select lang, phrase, f as a, string_split(phrase, ' ') as w from often where contains(phrase, ' ')),
cut as materialized (select lang, phrase, a, k, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:], ' ') as tail from (select *, unnest(range(1, len(w))) as k from candidate)),
scored as (
  select c.lang, c.phrase, c.a, l.f as l, r.f as r, (1000000::hugeint * c.a * c.a // (l.f::hugeint * r.f))::bigint as score from cut c
  join often l on l.lang = c.lang and l.phrase = c.head join often r on r.lang = c.lang and r.phrase = c.tail
  qualify row_number() over (partition by c.lang, c.phrase order by score, c.k) = 1
), longer as (
  select lang, phrase, max(a) as most from (
    select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase from candidate where len(w) = 3) group by lang, phrase
)
select s.lang, row_number() over (partition by s.lang order by score desc, a desc, s.phrase) as rank, s.phrase, a, l, r, n, score
from scored s join total using (lang) left join longer g on g.lang = s.lang and g.phrase = s.phrase where most is null or 100 * most < 50 * a
qualify rank <= 2000
""",
    "op13_substrings": r"""
with texts as materialized (
  select doc_id, row_number() over (order by doc_id nulls first, sha256(coalesce(text, ''))) as place, encode(coalesce(text, '')) as b from documents
), run as (select place, p, md5(b[p + 1:p + 100]) as h from (select place, b, unnest(range(0, octet_length(b) - 99)) as p from texts)),
again as materialized (select place, p from run qualify row_number() over (partition by h order by place, p) > 1),
edge as (select place, p, case when p - lag(p) over (partition by place order by p) <= 100 then 0 else 1 end as fresh from again),
span as materialized (
  select place, min(p) as lo, max(p) + 100 as hi from (select place, p, sum(fresh) over (partition by place order by p rows unbounded preceding) as k from edge) group by place, k
), cut as (
  select place, sum(hi - lo) as n_removed, count(*) as n_spans, list(lo order by lo) as los, list(hi order by lo) as his from span group by place
)
select doc_id, octet_length(b)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  case when n_spans is null then sha256(b) else sha256(unhex(array_to_string(list_transform(range(1, n_spans + 2), lambda k:
    hex(b[case when k = 1 then 1 else his[k - 1] + 1 end:case when k > n_spans then octet_length(b) else los[k] end])), ''))) end as kept_sha256
from texts left join cut using (place)
""",
    "op12_negatives": """
with sound as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from sound a join sound b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
), positive as (
  select anchor_id, id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, id)::int as rank, id as negative_id, positive_score, score as negative_score
from positive p join scored s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, id) <= 5
""",
    "op9_vectors": """
with recursive sound as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), link as (
  select a.vec_id as a, b.vec_id as b from sound a join sound b
  on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.93
), reach(vec_id, node) as (
  select vec_id, vec_id from embeddings union select r.vec_id, l.b from reach r join link l on l.a = r.node
), component as (select vec_id, min(node) as component_id from reach group by vec_id),
degree as (select a as vec_id, count(*) as n from link group by a)
select c.vec_id, coalesce(d.n, 0)::bigint as n_links, c.component_id, c.vec_id = c.component_id as kept
from component c left join degree d using (vec_id)
""",
}
