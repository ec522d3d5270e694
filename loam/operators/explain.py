"""Traces, hierarchies and exports of a graph as tables of lines, nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.config import DEFAULT, Config
from loam.functions import text as X
from loam.operators import retrieve as R
from loam.operators.graph import Graph
from loam.operators.similar import nearest
from loam.store import materialize

# Display colours by entity type and layer.
COLOURS = {"PERSON": "#e74c3c", "TECHNOLOGY": "#3498db", "ORGANIZATION": "#2ecc71", "EVENT": "#f39c12", "CONCEPT": "#9b59b6", "PRODUCT": "#1abc9c", "DEPARTMENT": "#34495e"}


def trace(questions: DataFrame, graph: Graph, config: Config = DEFAULT, folder: str | None = None, candidates: int | None = None) -> DataFrame:
    """(qid, stage, rank, item, score, flag, bar): every candidate community and concept with its
    fate, every entity with the way it was reached, and the chunks in reading order.

    As the trace defines it, a missing vector scores 0, concepts have no least relevance, and all
    chunks of the kept entities are listed, of which a model reads the first ``judge_chunks``.
    ``candidates``: communities listed for a question, the best ones; all, if not given. They are scored where they are
    (``similar.nearest``), so of a list that is cut no more than this from each task becomes rows.
    """
    listed = max(1, graph.community.count()) if candidates is None else candidates
    rows = R.best(nearest(graph.community, questions, "community", listed, missing=0.0), "similarity", "community", listed)
    if folder:  # read twice
        rows = materialize(rows, folder, "trace-communities")
    keep = (F.col("rank") <= config.top_k_communities) & ((F.col("similarity") >= config.min_community_similarity) | (F.col("rank") == 1))
    flag = F.when(keep, "SELECTED").when(F.col("similarity") < config.min_community_similarity, "BELOW THRESHOLD").otherwise("DROPPED")
    first = rows.select("qid", F.lit("1 communities").alias("stage"), "rank", F.col("community").alias("item"), F.col("similarity").alias("score"), flag.alias("flag"))
    matched = rows.filter(keep).select("qid", "community", "rank")
    under = matched.join(graph.community_concept, "community").select("qid", "concept").distinct().join(R.embedded(graph.concept, "concept"), "concept").join(R.asked(questions), "qid")
    under = R.ranked(R.scored(under), "similarity", "concept")
    kept = F.when(F.col("rank") <= config.top_k_concepts, "SELECTED").otherwise("DROPPED")
    second = under.select("qid", F.lit("2 concepts").alias("stage"), "rank", F.col("concept").alias("item"), F.col("similarity").alias("score"), kept.alias("flag"))
    chosen = under.filter(F.col("rank") <= config.top_k_concepts).select("qid", "concept", "rank")
    reached = R.expand(R.seeds(chosen, graph), graph, config.max_hops)
    if folder:  # read three times
        reached = materialize(reached, folder, "trace-reached")
    entities = reached.join(R.embedded(graph.entity, "name"), "name").join(R.asked(questions), "qid")
    entities = R.ranked(R.scored(entities).na.fill(0.0, ["similarity"]), "similarity", "name")
    capped = F.col("rank") <= config.max_entities
    way = F.when(F.col("hop") == 0, F.concat(F.col("name"), F.lit(" (from: "), F.col("from_concept"), F.lit(")"))).otherwise(F.concat(F.lit("hop "), F.col("hop").cast("string"), F.lit(": "), F.col("reached_via")))
    third = entities.select("qid", F.lit("3 entities").alias("stage"), "rank", way.alias("item"), F.col("similarity").alias("score"), F.when(capped, "SELECTED").otherwise("DROPPED").alias("flag"))
    linked = entities.filter(capped).select("qid", "name").join(graph.has_entity, F.col("name") == F.col("entity")).groupBy("qid", "chunk_id").agg(F.count_distinct("name").alias("n"))
    linked = linked.join(graph.chunk.select("chunk_id", "doc_id", "idx"), "chunk_id")
    linked = linked.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("doc_id", "idx")))
    read = F.when(F.col("rank") <= config.judge_chunks, "READ").otherwise("LISTED")
    fourth = linked.select("qid", F.lit("4 chunks").alias("stage"), "rank", F.concat(F.col("chunk_id"), F.lit(" (via "), F.col("n").cast("string"), F.lit(" entities)")).alias("item"), F.lit(0.0).alias("score"), read.alias("flag"))
    return first.unionByName(second).unionByName(third).unionByName(fourth).withColumn("bar", X.bar(F.greatest("score", F.lit(0.0))))


def hop_counts(reached: DataFrame) -> DataFrame:
    """(qid, n_seeds, n_found): entities by hop."""
    return reached.groupBy("qid").agg(F.count_if(F.col("hop") == 0).alias("n_seeds"), F.count_if(F.col("hop") > 0).alias("n_found"))


def hierarchy(graph: Graph) -> DataFrame:
    """(community, tree): each community's concepts and their entities as indented lines."""
    entity = F.concat(F.lit("    - "), F.col("entity"))
    concepts = graph.concept_member.groupBy("concept").agg(F.array_join(F.sort_array(F.collect_set(entity)), "\n").alias("lines"))
    concepts = concepts.select("concept", F.concat(F.lit("  * "), F.col("concept"), F.lit("\n"), F.col("lines")).alias("lines"))
    rows = graph.community_concept.join(concepts, "concept").groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("concept", "lines"))), lambda x: x.lines), "\n").alias("lines"))
    return rows.join(graph.community.select("community", "name"), "community").select("community", F.concat("name", F.lit("\n"), F.col("lines")).alias("tree"))


def hierarchy_lines(graph: Graph) -> DataFrame:
    """(community, concept, entity, line): the lines of ``hierarchy`` as rows, so that no community is one value; the
    heading of a community or concept has an empty concept or entity and comes first in the order of these columns."""
    shown = graph.community_concept.join(graph.community.select("community", "name"), "community")
    line = lambda df, concept, entity, text: df.select("community", concept.alias("concept"), entity.alias("entity"), text.alias("line")).distinct()
    rows = line(shown, F.lit(""), F.lit(""), F.col("name"))
    under = shown.join(graph.concept_member, "concept")
    rows = rows.unionByName(line(under, F.col("concept"), F.lit(""), F.concat(F.lit("  * "), "concept")))
    return rows.unionByName(line(under, F.col("concept"), F.col("entity"), F.concat(F.lit("    - "), "entity")))


def type_counts(entity: DataFrame) -> DataFrame:
    return entity.groupBy(F.coalesce("type", F.lit("OTHER")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def nodes(graph: Graph) -> DataFrame:
    """(node_id, label, level, colour): all layers' nodes, once each."""
    colours = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    rows = graph.community.select(F.concat(F.lit("comm_"), F.col("community")).alias("node_id"), F.coalesce("name", F.lit("Community")).alias("label"), F.lit(0).alias("level"), F.lit("#c0392b").alias("colour"))
    rows = rows.unionByName(graph.concept.select(F.concat(F.lit("concept_"), F.col("concept")).alias("node_id"), F.col("concept").alias("label"), F.lit(1).alias("level"), F.lit("#2980b9").alias("colour")))
    colour = F.coalesce(F.try_element_at(colours, F.coalesce("type", F.lit("OTHER"))), F.lit("#7f8c8d"))
    return rows.unionByName(graph.entity.select(F.concat(F.lit("entity_"), F.col("name")).alias("node_id"), F.col("name").alias("label"), F.lit(2).alias("level"), colour.alias("colour")).distinct())


def edges(graph: Graph) -> DataFrame:
    """(source_id, target_id, label): edges whose both ends are shown."""
    known = nodes(graph).select("node_id")
    rows = graph.community_concept.select(F.concat(F.lit("comm_"), F.col("community")).alias("source_id"), F.concat(F.lit("concept_"), F.col("concept")).alias("target_id"), F.lit("contains").alias("label"))
    rows = rows.unionByName(graph.concept_member.select(F.concat(F.lit("concept_"), F.col("concept")).alias("source_id"), F.concat(F.lit("entity_"), F.col("entity")).alias("target_id"), F.lit("instantiated by").alias("label")))
    rows = rows.unionByName(graph.relation.select(F.concat(F.lit("entity_"), F.col("source")).alias("source_id"), F.concat(F.lit("entity_"), F.col("target")).alias("target_id"), X.shown_relation(F.coalesce("type", F.lit("RELATED_TO"))).alias("label")))
    return rows.join(known.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(known.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")


_HEAD = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>graph</title>
<style>body{margin:0;font:13px sans-serif}canvas{display:block}#bar{position:fixed;top:8px;left:8px;background:#fffc;padding:6px}</style></head>
<body><div id="bar"><input id="find" placeholder="node"> hops <input id="hops" type="number" value="2" min="0" max="9"> <select id="kind"><option value="">all relations</option></select> <span id="said"></span></div>
<canvas id="view"></canvas><script>const nodes=[],edges=[],path=[];"""
# The layers stand in rings, communities inside; a click or a search marks what is within so many hops.
_TAIL = """const at=new Map(),next=new Map();let marked=null;
const rings=[120,300,520],view=document.getElementById('view'),pen=view.getContext('2d'),said=document.getElementById('said');
[0,1,2].forEach(l=>{const own=nodes.filter(n=>n.level===l);own.forEach((n,k)=>{const a=2*Math.PI*k/own.length;at.set(n.node_id,{x:Math.cos(a)*rings[l],y:Math.sin(a)*rings[l],n})})});
edges.forEach(e=>{for(const[a,b]of[[e.source_id,e.target_id],[e.target_id,e.source_id]]){if(!next.has(a))next.set(a,[]);next.get(a).push(b)}});
[...new Set(edges.map(e=>e.label))].sort().forEach(t=>document.getElementById('kind').add(new Option(t,t)));
function within(id,hops){let seen=new Set([id]),edge=[id];while(hops-->0){edge=edge.flatMap(x=>next.get(x)||[]).filter(x=>!seen.has(x)&&seen.add(x))}return seen}
function draw(){view.width=innerWidth;view.height=innerHeight;const s=Math.min(innerWidth,innerHeight)/1120,X=p=>innerWidth/2+p.x*s,Y=p=>innerHeight/2+p.y*s,kind=document.getElementById('kind').value;
const lit=marked||(path.length?new Set(path):null),on=id=>!lit||lit.has(id);
edges.forEach(e=>{const a=at.get(e.source_id),b=at.get(e.target_id);if(!a||!b||kind&&e.label!==kind)return;pen.strokeStyle=lit&&on(e.source_id)&&on(e.target_id)?'#c0392b':lit?'#eee':'#ccc';pen.beginPath();pen.moveTo(X(a),Y(a));pen.lineTo(X(b),Y(b));pen.stroke()});
at.forEach((p,id)=>{pen.globalAlpha=on(id)?1:.15;pen.fillStyle=p.n.colour;pen.beginPath();pen.arc(X(p),Y(p),9-3*p.n.level,0,7);pen.fill();if(lit&&on(id)){pen.fillStyle='#000';pen.fillText(p.n.label,X(p)+8,Y(p))}});pen.globalAlpha=1;
said.textContent=nodes.length+' nodes, '+edges.length+' edges'+(lit?', '+lit.size+' marked':'')}
function mark(id){marked=id?within(id,+document.getElementById('hops').value):null;draw()}
view.onclick=e=>{const s=Math.min(innerWidth,innerHeight)/1120;let best=null,d=100;at.forEach((p,id)=>{const q=(innerWidth/2+p.x*s-e.clientX)**2+(innerHeight/2+p.y*s-e.clientY)**2;if(q<d){d=q;best=id}});mark(best)};
document.getElementById('find').onchange=e=>{const n=nodes.find(n=>n.label.toLowerCase()===e.target.value.toLowerCase());mark(n&&n.node_id)};
document.getElementById('kind').onchange=draw;onresize=draw;draw();</script></body></html>"""


def html(graph: Graph, shown: DataFrame | None = None) -> DataFrame:
    """(line): a self-contained page that draws the network, marks neighbourhoods and filters
    relations. ``shown`` (node_id): a retrieval's nodes, marked from the start (``overlay``)."""
    spark = graph.chunk.sparkSession
    line = lambda part, df, name: df.select(F.lit(part).alias("part"), F.concat(F.lit(f"{name}.push("), F.replace(F.to_json(F.struct("*")), F.lit("</"), F.lit("<\\/")), F.lit(");")).alias("line"))
    body = line(1, nodes(graph), "nodes").unionByName(line(2, edges(graph), "edges"))
    if shown is not None:
        body = body.unionByName(shown.distinct().select(F.lit(3).alias("part"), F.concat(F.lit("path.push("), F.replace(F.to_json(F.struct("node_id")), F.lit("</"), F.lit("<\\/")), F.lit(".node_id);")).alias("line")))
    ends = spark.createDataFrame([(0, _HEAD), (4, _TAIL)], "part int, line string")
    return ends.unionByName(body).orderBy("part", "line").select("line")


def overlay(found: R.Retrieval) -> DataFrame:
    """(node_id): the communities, concepts and entities that a retrieval went through."""
    named = lambda df, prefix, name: df.select(F.concat(F.lit(prefix), F.col(name)).alias("node_id"))
    return named(found.communities, "comm_", "community").unionByName(named(found.concepts, "concept_", "concept")).unionByName(named(found.entities, "entity_", "name")).distinct()
