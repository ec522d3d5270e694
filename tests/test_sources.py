"""Scans, sinks and the streaming path on small files."""

import pytest

from loam.operators import explain, extract, graph, resolve
from loam.sources import readers, sinks
from loam.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "b.TXT").write_bytes(b"second\r\nline \xff")
    (tmp_path / "a.txt").write_text("first é")
    (tmp_path / "c.pdf").write_bytes(b"one|two")
    (tmp_path / "d.md").write_text("ignored")
    return tmp_path


def test_directory_in_name_order(spark, folder):
    files, name = readers.read_input(spark, str(folder), lambda data: data.decode().split("|"))
    assert name == folder.name
    assert sorted(r.text for r in files.collect())[1] == "onetwo" and files.count() == 3


def test_single_files(spark, folder):
    files, name = readers.read_input(spark, str(folder / "a.txt"))
    assert (name, files.first().text) == ("a.txt", "first é")
    with pytest.raises(ValueError):
        readers.read_input(spark, str(folder / "c.pdf"))


def test_empty_directory(spark, tmp_path):
    (tmp_path / "x.md").write_text("x")
    with pytest.raises(FileNotFoundError):
        readers.read_directory(spark, str(tmp_path))


def test_questions(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,category,query,ground_truth\nq1,factual,"a, ""b""?",x\n,,c?,y\n')
    rows = readers.read_questions(spark, str(tmp_path / "q.csv")).collect()
    assert rows[0].query == 'a, "b"?' and rows[1].category == "general" and rows[1].id.startswith("q_")
    (tmp_path / "bad.csv").write_text("id\n1\n")
    with pytest.raises(ValueError):
        readers.read_questions(spark, str(tmp_path / "bad.csv"))


def test_cache_round_trip(spark, tmp_path):
    assert readers.read_cache(spark, str(tmp_path), "/doc") is None
    sinks.write_cache(spark.createDataFrame([(1, 0, [("A", None, None)], [])], readers.EXTRACTION), str(tmp_path), "/doc")
    (kept,) = readers.read_cache(spark, str(tmp_path), "/doc").collect()
    assert (kept.doc_id, kept.idx, kept.entities[0].name, kept.entities[0].type, kept.relationships) == (1, 0, "A", None, [])


def test_files_that_cannot_be_read_raise():
    from loam.sources import pdf

    with pytest.raises(ValueError, match="streams"):
        pdf.pages(b"%PDF-1.5 1 0 obj <</Type /ObjStm /N 1>> stream x endstream endobj")
    with pytest.raises(ValueError, match="inflated"):
        pdf.pages(b"%PDF-1.4\n1 0 obj <</Type /Page /Contents 2 0 R>> endobj\n2 0 obj <</Length 3 /Filter /FlateDecode>>\nstream\nabc\nendstream endobj\n")


DOCS = [
    (1, "Alphaone meets Betatwo and Gammathree.", "s0"), (2, "Alphaone leaves Deltafour. Betatwo stays.", "s1"),
    (3, "Epsilonfive knows Betatwo, Deltafour and Alphaone.", "s2"), (4, None, "s2"), (5, "", None),
]


def test_graph_is_stored_and_loaded(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    built = graph.build(docs)
    built.save(str(tmp_path / "g"))
    again = graph.Graph.load(spark, str(tmp_path / "g"))
    assert again.entity.count() == built.entity.count() == 5
    assert again.chunk.count() == 3
    ids = {r.node_id for r in explain.nodes(again).collect()}
    assert all(r.source_id in ids and r.target_id in ids for r in explain.edges(again).collect())
    stats = graph.statistics(again, docs).first()
    assert (stats.documents, stats.entities) == (5, 5)
    assert explain.html(again).first().line.startswith("<!DOCTYPE")


def test_streamed_documents_merge_as_the_batch_does(spark, tmp_path):
    docs = spark.createDataFrame(DOCS[:3], "doc_id long, text string, source string")
    for k in range(3):
        docs.filter(f"doc_id = {k + 1}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.ingest(spark, str(tmp_path / "in"), "doc_id long, text string, source string", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    whole = resolve.merge_entities(extract.mentions(extract.chunk(docs)))
    key = lambda df: sorted((r.canon, r.name, r.type, r.n_mentions) for r in df.collect())
    assert key(ingest.merged_entities(spark, str(tmp_path / "out"))) == key(whole)


def test_batches_in_any_order_make_the_store_of_one_build(spark, tmp_path):
    """Longest names that come late, ties of length over batches, replays and documents that come again."""
    texts = ["Zetaone meets Alphaone. Alphaone leaves Betatwo.", "Alphaone meets Gammathree here. Betatwo leaves Zetaone.", None, "", "Gammathree leaves Betatwo; Betatwo leaves Alphaone.", "Alphaone meets Betatwo. Alphaone leaves Betatwo."]
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    found = extract.mentions(extract.chunk(docs))
    entities = resolve.merge_entities(found)
    edges = resolve.ingest_edges(resolve.clean_relationships(extract.relationships(found), entities), resolve.upserted(entities))
    key = lambda df, names: sorted(map(str, df.select(*names).collect()))
    names, ends = ["canon", "name", "type", "description", "doc_id", "idx", "first_place", "n_mentions"], ["source", "type", "target", "evidence"]
    for n, order in enumerate([(0, 1, 2), (2, 1, 0), (1, 2, 0, 1)]):
        target = str(tmp_path / str(n))
        for k in order:
            ingest.absorb(docs.filter(f"doc_id % 3 = {k}"), k, target)
        ingest.absorb(docs.filter("doc_id = 1"), 9, target)  # is there already
        assert key(ingest.merged_entities(spark, target), names) == key(entities, names)
        assert key(ingest.merged_relations(spark, target), ends) == key(edges, ends) != []


def test_shares_with_ties_over_batches(spark):
    """A name as long as another of an earlier batch stands if it was written first."""
    rows = [(9, 0, 0, "The Alphax", "T", "dd"), (2, 0, 0, "AN alphaX", "U", "ee"), (1, 0, 0, "Alphax", "V", None), (3, 0, 0, "Alphax", None, "ff")]
    found = spark.createDataFrame(rows, "doc_id long, idx long, pos long, name string, type string, description string")
    want = resolve.merge_entities(found).collect()
    for cut in ("doc_id > 2", "doc_id % 2 = 1", "doc_id = 9"):
        parts = resolve.entity_shares(found.filter(cut)).unionByName(resolve.entity_shares(found.filter(f"not ({cut})")))
        assert resolve.merged_shares(parts).select(*want[0].asDict()).collect() == want


def test_components_extended_by_batches(spark, tmp_path):
    from loam.operators import community

    pairs = [(f"c{a:02}", f"c{b:02}") for a, b in ((1, 2), (3, 4), (5, 6), (2, 9), (9, 3), (11, 12), (7, 8), (8, 1))]
    edges = spark.createDataFrame(pairs, "a string, b string")
    concepts = spark.createDataFrame([(f"c{k:02}",) for k in range(14)], "concept string")
    want = sorted(community.components(concepts, edges, str(tmp_path / "all")).collect())
    labels = spark.createDataFrame([], "concept string, root string")
    for k in range(0, 8, 3):
        some = spark.createDataFrame(pairs[k : k + 3], "a string, b string")
        new = concepts if k == 6 else some.selectExpr("explode(array(a, b)) as concept")
        labels = community.extended(labels, new, some, str(tmp_path / f"step{k}"))
    assert sorted(labels.select("concept", "root").collect()) == want


def made_pdf(pages, deflate):
    import zlib

    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (3 + 2 * k) for k in range(len(pages))), len(pages))]
    for k, lines in enumerate(pages):
        shown = b" ".join(b"(%s) Tj 0 -14 Td" % x.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") for x in lines)
        body = b"BT /F1 12 Tf 72 700 Td " + shown + b" [(ker) -20 (ned)] TJ <48 69> Tj ET"
        packed = zlib.compress(body) if deflate else body
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * k), b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(packed), b" /Filter /FlateDecode" if deflate else b"", packed)]
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (k, o) for k, o in enumerate(objects, 1)) + b"\ntrailer << /Root 1 0 R >>\n%%EOF"


def test_pdf_pages(spark, tmp_path):
    from loam.sources import pdf, readers

    pages = [["Alphaone (UN) meets", "Betatwo \u00e9"], ["back\\slash"]]
    for deflate in (False, True):
        data = made_pdf(pages, deflate)
        assert pdf.pages(data) == ["Alphaone (UN) meets\nBetatwo \u00e9\nkernedHi\n", "back\\slash\nkernedHi\n"]
        (tmp_path / f"{deflate}.pdf").write_bytes(data)
    assert pdf.pages(b"no pdf") == [] and pdf.pages(b"") == []
    files, _ = readers.read_input(spark, str(tmp_path), pdf.pages)
    assert [r.text.startswith("Alphaone (UN) meets\nBetatwo") for r in files.collect()] == [True, True]
