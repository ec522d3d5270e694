"""The same results in DuckDB's SQL, built from a chain of common table expressions."""

from __future__ import annotations


def canon(x: str) -> str:
    out = f"regexp_replace(lower({x}), '^\\s+|\\s+$', '', 'g')"
    for article in ("the ", "a ", "an "):
        out = f"regexp_replace({out}, '^{article}', '')"
    out = f"regexp_replace({out}, '\\s*\\(.*?\\)\\s*', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({out}, '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def embed(x: str) -> str:
    words = f"regexp_extract_all(lower({x}), '[a-z]+')"
    bucket = "lambda w: (ascii(substr(w,1,1))*961 + ascii(substr(w,2,1))*31 + ascii(substr(w,3,1))*17 + ascii(substr(w,-1,1))*3 + length(w)*7) % 64"
    return f"list_transform(range(64), lambda b: len(list_filter(list_transform({words}, {bucket}), lambda y: y = b))::double)"


def cosine(a: str, b: str) -> str:
    return f"round(list_dot_product({a},{b}) / (sqrt(list_dot_product({a},{a})) * sqrt(list_dot_product({b},{b})) + 1e-9), 6)"


def pick(index: str, names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + f"][({index}) % {len(names)} + 1]"


TYPES = ["PERSON", "TECHNOLOGY", "ORGANIZATION", "EVENT", "CONCEPT", "PRODUCT", "DEPARTMENT"]
RELATIONS = ["caused", "led to", "developed"]
SOURCE = "coalesce(substr(list_filter(list_transform(string_split({t}, chr(10))[1:3], lambda l: " + strip("l") + "), lambda l: length(l) > 10 and not starts_with(l, '('))[1], 1, 80), 'unknown')"


def best(rows: str, score: str, tie: str, k: int, least: float | None = None) -> str:
    keep = f" and ({score} >= {least} or rank = 1)" if least is not None else ""
    return f"select * from (select *, row_number() over (partition by qid order by {score} desc, {tie}) as rank from ({rows})) where rank <= {k}{keep}"


CTES: dict[str, str] = {
    "chunk0": f"""select doc_id, row_number() over (partition by doc_id order by p) - 1 as idx, txt as text from (
        select doc_id, p, {strip("substr(text, p + 1, 1500)")} as txt from documents, unnest(range(0, length(text), 1350)) as u(p)) where txt <> ''""",
    "chunk": f"select doc_id || '_chunk_' || idx as chunk_id, doc_id, idx, text, {embed('text')} as embedding from chunk0",
    "question": f"select item_id as qid, text as query, {embed('text')} as q from benchmark",
    "mention": f"""select doc_id, idx, pos, name, {pick("length(name)", TYPES)} as type, 'seen at ' || pos || ' of chunk ' || idx as description from (
        select doc_id, idx, unnest(l) as name, generate_subscripts(l, 1) - 1 as pos from (select doc_id, idx, regexp_extract_all(text, '[A-Z][a-z]{{5,}}') as l from chunk0))""",
    "entity": f"""select canon, first(name order by length(name) desc, doc_id, idx, pos) as name, first(type order by doc_id, idx, pos) as type,
        first(description order by length(description) desc, doc_id, idx, pos) as description, first(doc_id order by doc_id, idx, pos) as doc_id,
        first(idx order by doc_id, idx, pos) as idx, first(pos order by doc_id, idx, pos) as pos, count(*) as n_mentions
        from (select *, {canon("name")} as canon from mention) where canon <> '' group by canon""",
    "raw_relation": f"""select doc_id, idx, pos, source, target, {pick("length(source) + length(target)", RELATIONS)} as type, source || ' then ' || target as evidence
        from (select doc_id, idx, pos, name as source, lead(name) over (partition by doc_id, idx order by pos) as target from mention) where target is not null""",
    "clean_relation": f"""select * from (select *, row_number() over (partition by source_key, kind, target_key order by doc_id, idx, pos) as rn from (
        select r.doc_id, r.idx, r.pos, coalesce(s.name, r.source) as source, coalesce(t.name, r.target) as target, r.type, r.evidence, lower(r.type) as kind,
          {canon("coalesce(s.name, r.source)")} as source_key, {canon("coalesce(t.name, r.target)")} as target_key
        from raw_relation r left join entity s on s.canon = {canon("r.source")} left join entity t on t.canon = {canon("r.target")})
        where source <> target) where rn = 1""",
    "relation": """select source, ty as type, target, last(evidence order by doc_id, idx, pos) as evidence from (
        select *, regexp_replace(upper(type), '[^A-Z0-9_]', '_', 'g') as ty from clean_relation)
        where source in (select name from entity) and target in (select name from entity) group by source, ty, target""",
    "has_entity": "select doc_id || '_chunk_' || idx as chunk_id, name as entity from entity",
    "numbered": "select *, row_number() over (order by doc_id, idx, pos, canon) - 1 as n from entity",
    "draft": """select 'Theme ' || (batch + 1) || '.' || (run + 1) as concept, member, k - run * 5 + 1 as place from (
          select *, count(*) over (partition by batch, run) as size from (
            select name as member, n // 25 as batch, n % 25 as k, unnest(case when n % 25 > 0 and n % 25 % 5 = 0 then [n % 25 // 5 - 1, n % 25 // 5] else [n % 25 // 5] end) as run from numbered))
          where size > 1 or run = 0""",
    "concept_member": "select distinct concept, e.name as entity from draft join entity e on e.name = member where concept in (select concept from draft join entity e2 on e2.name = member group by concept having count(distinct e2.name) >= 2)",
    "concept": f"select concept, {embed('description')} as embedding from (select concept, string_agg(entity, ' ' order by entity) as description from concept_member group by concept)",
    "overlap": "select a.concept as a, b.concept as b, count(distinct lower(a.entity)) as weight from concept_member a join concept_member b on lower(a.entity) = lower(b.entity) and a.concept < b.concept group by 1, 2",
    "reach": "select distinct concept, concept as node from concept_member union select r.concept, case when o.a = r.node then o.b else o.a end from reach r join overlap o on o.a = r.node or o.b = r.node",
    "label": "select concept, case when (select count(*) from overlap) = 0 then (select min(concept) from concept_member) else min(node) end as root from reach group by concept",
    "community": f"""select root, 'community_' || k as community, 'Community ' || (k + 1) as name, n_concepts, members, summary, {embed('summary')} as embedding from (
        select root, row_number() over (order by root) - 1 as k, n_concepts, members, 'Community covering: ' || substr(array_to_string(members, ', '), 1, 200) as summary from (
          select root, count(distinct l.concept) as n_concepts, list_sort(list(distinct entity)) as members from label l join concept_member using (concept) group by root))""",
    "community_concept": "select community, concept from label join community using (root)",
    "matched": best(f"select qid, community, {cosine('embedding', 'q')} as similarity from community, question", "similarity", "community", 3, 0.35),
    "drilled": best(
        f"""select qid, c.concept, d.community, {cosine('c.embedding', 'q')} as relevance from (
          select qid, concept, first(community order by rank) as community from matched join community_concept using (community) group by qid, concept) d
          join concept c using (concept) join question using (qid)""",
        "relevance", "concept", 10, 0.3,
    ),
    "seed": "select qid, entity as name, first(concept order by rank) as from_concept from drilled join concept_member using (concept) group by qid, entity",
    "both_ways": "select source as u, target as v, type from relation union all select target, source, type from relation",
    "hop1": "select qid, v as name, min(row(u, type)) as via from seed join both_ways on name = u where (qid, v) not in (select (qid, name) from seed) group by qid, v",
    "hop2": "select h.qid, v as name, min((u, type)) as via from hop1 h join both_ways on h.name = u where (h.qid, v) not in (select (qid, name) from seed) and (h.qid, v) not in (select (qid, name) from hop1) group by h.qid, v",
    "reached": """select qid, name, from_concept, 0 as hop, null as reached_via from seed
        union all select qid, name, null, 1, via[1] || ' --[' || via[2] || ']--> ' || name from hop1
        union all select qid, name, null, 2, via[1] || ' --[' || via[2] || ']--> ' || name from hop2""",
    "described": f"select name, type, {embed(chr(39) + chr(39) + ' || name || ' + chr(39) + ': ' + chr(39) + ' || description')} as embedding from entity",
    "collected": best(f"select qid, name, type, from_concept, hop, reached_via, {cosine('embedding', 'q')} as relevance from reached join described using (name) join question using (qid)", "relevance", "name", 25),
    "touched": """select qid, source, type, target, first(evidence) as evidence, count(*) > 1 as inner_edge from (
        select qid, source, r.type, target, evidence from collected c join relation r on c.name = r.source
        union all select qid, source, r.type, target, evidence from collected c join relation r on c.name = r.target) group by qid, source, type, target""",
    "outer_edge": "select * from (select *, row_number() over (partition by qid order by source, type, target) as n from touched where not inner_edge) where n <= 30",
    "edge": """select qid, row_number() over (partition by qid order by phase, source, type, target) - 1 as place, source, type, target, evidence from (
        select 0 as phase, qid, source, type, target, evidence from touched where inner_edge
        union all select 1, qid, source, type, target, evidence from outer_edge)""",
    "bridge": "select distinct qid, name from (select qid, source as name from edge union all select qid, target from edge) where (qid, name) not in (select (qid, name) from collected)",
    "candidate": f"""select *, row_number() over (partition by qid order by similarity desc, chunk_id) as rank, count(*) over (partition by qid) as candidates from (
        select qid, chunk_id, doc_id, idx, {SOURCE.format(t="text")} as source, {cosine('embedding', 'q')} as similarity from (
          select distinct qid, chunk_id from (select qid, name from collected union select qid, name from bridge) n join has_entity h on h.entity = n.name)
        join chunk using (chunk_id) join question using (qid))""",
    "grouped": "select *, min(rank) over (partition by qid, source) as lead_rank, row_number() over (partition by qid, source order by rank) as nth from candidate",
    "context": """select * from (select qid, chunk_id, doc_id, idx, similarity, source, row_number() over (partition by qid order by
          case when nth <= 2 and candidates > 10 then 0 else 1 end, case when nth <= 2 and candidates > 10 then lead_rank else rank end,
          case when nth <= 2 and candidates > 10 then nth else 0 end) as choice from grouped) where choice <= 10""",
    "top_chunk": best(f"select qid, chunk_id, {cosine('embedding', 'q')} as similarity from chunk, question", "similarity", "chunk_id", 7),
    "flat_index": "select lower(name) as key, first(name order by doc_id, idx, pos) as name, first(type order by doc_id, idx, pos) as type, count(*) as n_chunks from mention where name <> '' group by lower(name)",
    "flat_match": "select qid, key, name from flat_index, question where contains(lower(query), key) or len(list_filter(regexp_split_to_array(key, '\\s+'), lambda w: length(w) > 3 and contains(lower(query), w))) > 0",
    # the trace has no least relevance, so its seeds are more than those of the retrieval
    "t_concept": f"select * from (select *, row_number() over (partition by qid order by relevance desc, concept) as rank from (select qid, concept, {cosine('embedding', 'q')} as relevance from (select distinct qid, concept from matched join community_concept using (community)) join concept using (concept) join question using (qid)))",
    "t_seed": "select qid, entity as name, first(concept order by rank) as from_concept from t_concept join concept_member using (concept) where rank <= 10 group by qid, entity",
    "t_hop1": "select qid, v as name, min(row(u, type)) as via from t_seed join both_ways on name = u where (qid, v) not in (select (qid, name) from t_seed) group by qid, v",
    "t_hop2": "select h.qid, v as name, min((u, type)) as via from t_hop1 h join both_ways on h.name = u where (h.qid, v) not in (select (qid, name) from t_seed) and (h.qid, v) not in (select (qid, name) from t_hop1) group by h.qid, v",
    "t_reached": """select qid, name, name || ' (from: ' || from_concept || ')' as way from t_seed
        union all select qid, name, 'hop 1: ' || via[1] || ' --[' || via[2] || ']--> ' || name from t_hop1
        union all select qid, name, 'hop 2: ' || via[1] || ' --[' || via[2] || ']--> ' || name from t_hop2""",
    "t_entity": f"select *, row_number() over (partition by qid order by relevance desc, name) as rank from (select qid, name, way, {cosine('embedding', 'q')} as relevance from t_reached join described using (name) join question using (qid))",
    "t_chunk": """select *, row_number() over (partition by qid order by doc_id, idx) as rank from (
        select t.qid, chunk_id, doc_id, idx, count(distinct t.name) as n from t_entity t join has_entity h on h.entity = t.name join chunk using (chunk_id) where t.rank <= 25 group by t.qid, chunk_id, doc_id, idx)""",
    # a question's edges one after the other: used are the places taken, free the starts still to try
    "edge_list": """select qid, list({'place': place, 's': source, 't': target} order by place) as e from edge group by qid""",
    "walk_start": """select qid, e, list_distinct(list_transform(e, lambda x: x.s)) as seen, list_filter(list_transform(e, lambda x: x.s), lambda s: not list_contains(list_transform(e, lambda y: y.t), s)) as roots from edge_list""",
    "walk": """select qid, e, []::bigint[] as used, null::varchar as node, case when len(e) <= 1 then []::varchar[] else
          list_transform(list_sort(list_transform(list_distinct(case when len(roots) > 0 then roots else list_transform(e, lambda x: x.s) end),
            lambda s: {'at': list_min(list_transform(list_filter(e, lambda x: x.s = s), lambda x: x.place)), 's': s})), lambda z: z.s) end as free, 0 as step from walk_start
        union all select qid, e, case when next is null then used else list_append(used, next) end, case when next is null then free[1] else list_filter(e, lambda x: x.place = next)[1].t end,
          case when next is null then free[2:] else free end, step + 1 from (
            select *, list_min(list_transform(list_filter(e, lambda x: x.s = node and not list_contains(used, x.place)), lambda x: x.place)) as next from walk)
          where next is not null or len(free) > 0""",
    "walked": "select qid, list_concat(used, list_filter(list_transform(e, lambda x: x.place), lambda p: not list_contains(used, p))) as places from (select *, row_number() over (partition by qid order by step desc) as r from walk) where r = 1",
    "chain_edge": """select c.qid, c.step, source, type, target, evidence from (
        select qid, unnest(places) as place, generate_subscripts(places, 1) - 1 as step from walked) c join edge e on e.qid = c.qid and e.place = c.place""",
}


def sql(final: str) -> str:
    """``final`` over every table that it, or a table it needs, names."""
    import re

    names = list(CTES)
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in names:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                need(CTES[name])

    need(final)
    chain = ",\n".join(f"{name} as ({CTES[name]})" for name in names if name in needed)
    return f"with recursive {chain}\n{final}" if chain else final
