"""Pages of providers and what is made of them: XML, stored pages, requests, receipts, registers, windows."""

import datetime
import hashlib
import json
import urllib.parse

from pyspark.sql import functions as F

from quillmark.operators import captures, registers, requests, traversal
from quillmark.sources import paging, xml_pages

NAMES = 'xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom" xmlns:opensearch="http://a9.com/-/spec/opensearch/1.1/"'
COUNTS = "<opensearch:totalResults>7</opensearch:totalResults><opensearch:startIndex>0</opensearch:startIndex><opensearch:itemsPerPage>5</opensearch:itemsPerPage>"
FIELDS = {
    "id": "<id> http://arxiv.org/abs/hep-th/9901001v2 </id>", "title": "<title>A &lt;b&gt; &amp; <![CDATA[<i>]]>\n c</title>", "summary": "<summary> two\nlines </summary>",
    "author": "<author><name>N</name><arxiv:affiliation>F</arxiv:affiliation><arxiv:affiliation> G </arxiv:affiliation></author><author><name>M</name></author>",
    "category": '<category term="hep-th" scheme="s"/><category term=" x "/>', "primary": '<arxiv:primary_category term="hep-th"/>', "published": "<published>2024-01-02T03:04:05Z</published>",
    "updated": "<updated>2024-01-02T03:04:05.5+02:00</updated>", "doi": "<arxiv:doi>10.1/a</arxiv:doi>", "journal": "<arxiv:journal_ref>J 1</arxiv:journal_ref>", "comment": "<arxiv:comment>5 pages</arxiv:comment>",
    "link": '<link href="https://a" rel="alternate" type="text/html"/><link href="https://b" title="pdf"/>',
}


def entry(**changed):
    return "<entry>" + "".join((FIELDS | changed).values()) + "</entry>"


def feed(*entries, names=NAMES, counts=COUNTS):
    return f"<?xml version='1.0'?><!-- c --><feed {names}>{counts}{''.join(entries)}</feed>"


def atom(spark, bodies):
    return xml_pages.atom_records(spark.createDataFrame([(n, b, 5) for n, b in enumerate(bodies)], "page_id long, body string, max_results int")).orderBy("page_id", "place").collect()


def test_whole_records(spark):
    other = feed(entry(), entry(id="<id>https://arxiv.org/abs/2401.00001</id>", summary="", doi="", primary="", link="")).replace("arxiv:", "q:").replace("xmlns:arxiv", "xmlns:q")
    a, b, c, d = atom(spark, [feed(entry(), entry(id="<id>https://arxiv.org/abs/2401.00001</id>", summary="", doi="", primary="", link="")), other])
    assert (a.id, a.base_id, a.version, a.url) == ("hep-th/9901001v2", "hep-th/9901001", 2, "https://arxiv.org/abs/hep-th/9901001v2")
    assert a.title == "A <b> & <i>\n c" and a.abstract == " two\nlines " and (a.doi, a.journal_ref, a.comment) == ("10.1/a", "J 1", "5 pages")
    assert [(x.name, list(x.affiliations)) for x in a.authors] == [("N", ["F", "G"]), ("M", [])]
    assert [tuple(x) for x in a.categories] == [("hep-th", "s"), ("x", None)] and a.primary_category == "hep-th"
    assert [tuple(x) for x in a.links] == [("https://a", "alternate", None, "text/html"), ("https://b", None, "pdf", None)]
    utc = lambda t: t.astimezone(datetime.timezone.utc).isoformat()
    assert (utc(a.published), utc(a.updated)) == ("2024-01-02T03:04:05+00:00", "2024-01-02T01:04:05.500000+00:00") and (a.total, a.start, a.items) == (7, 0, 5)
    assert (b.place, b.base_id, b.version, b.abstract, b.doi, b.primary_category, list(b.links)) == (1, "2401.00001", None, None, None, None, [])
    assert a[2:] == c[2:] and b[2:] == d[2:]


def test_refused_feeds(spark):
    cases = {
        None: "malformed_xml", "": "malformed_xml", "<feed>": "malformed_xml", "<!DOCTYPE x><feed/>": "xml_doctype_forbidden", "<x/>": "invalid_feed_namespace",
        feed(entry(), names=NAMES.replace("2005", "2006")): "invalid_feed_namespace", feed(entry(title="<title>a <b>x</b></title>")): "unsupported_text_markup",
        feed(entry(title=FIELDS["title"] * 2)): "duplicate_field", feed(entry(doi=FIELDS["doi"] * 2)): "duplicate_field", feed(entry(title="")): "missing_field", feed(entry(title="<title> </title>")): "empty_required_field",
        feed(entry(author="")): "missing_field", feed(entry(author="<author/>")): "missing_field", feed(entry(category="<category/>")): "invalid_category", feed(entry(primary='<arxiv:primary_category term="q"/>')): "invalid_primary_category",
        feed(entry(link="<link/>")): "invalid_link_metadata", feed(entry(updated="<updated>2024-01-02T03:04Z</updated>")): "invalid_timestamp", feed(entry(published="<published>2024-02-30T03:04:05Z</published>")): "invalid_timestamp",
        feed(entry(id="<id>http://arxiv.org/abs/2413.00001</id>")): "invalid_source_identity", feed(entry(id="<id>http://example.org/abs/2401.00001</id>")): "invalid_source_identity",
        feed(entry(id="<id>http://arxiv.org/api/errors#x</id>")): "arxiv_api_error", feed(entry(), counts=""): "missing_field", feed(entry(), counts=COUNTS.replace(">5<", ">6<")): "invalid_page_counts",
        feed(entry(), counts=COUNTS.replace(">5<", ">0<")): "invalid_page_counts", feed(entry(), counts=COUNTS.replace(">7<", ">x<")): "invalid_page_counts",
    }
    got = atom(spark, list(cases))
    assert [(r.page_id, r.error) for r in got] == list(enumerate(cases.values()))
    assert atom(spark, [feed()]) == []


def article(pmid="7", title="<ArticleTitle>A <i>b</i>&lt;c&gt;</ArticleTitle>", ids='<ArticleId IdType="doi">10.1/AB</ArticleId><ArticleId IdType="pmc">pmc12</ArticleId>', date="<Year>2024</Year><Month>Mar</Month><Day>5</Day>"):
    return f"<PubmedArticle><MedlineCitation><PMID Version='1'>{pmid}</PMID><Article><Journal><JournalIssue><PubDate>{date}</PubDate></JournalIssue><Title>J</Title></Journal>{title}<Abstract><AbstractText Label='AIM'>x\n y</AbstractText><AbstractText>z</AbstractText></Abstract><AuthorList><Author><LastName>K</LastName><Initials>J</Initials></Author><Author><CollectiveName>T</CollectiveName></Author></AuthorList><Language>fre</Language><Language>eng</Language><PublicationTypeList><PublicationType UI='D'>Review</PublicationType></PublicationTypeList></Article></MedlineCitation><PubmedData><ArticleIdList>{ids}</ArticleIdList></PubmedData></PubmedArticle>"


def articles(spark, pages):
    rows = [(n, b and f"<PubmedArticleSet>{b}</PubmedArticleSet>", e) for n, (b, e) in enumerate(pages)]
    return xml_pages.article_records(spark.createDataFrame(rows, "page_id long, body string, expected array<string>")).orderBy("page_id", "place").collect()


def test_articles(spark):
    a, b = articles(spark, [(article("007") + article("8", ids="", date="<MedlineDate>2024 Spring</MedlineDate>"), ["8", "7"])])
    assert (a.pmid, a.title, a.abstract, list(a.authors), a.journal) == ("7", "A b<c>", "AIM: x y\nz", ["K J", "T"], "J")
    assert (a.publication_date, a.precision, a.doi, a.pmcid, list(a.languages), list(a.publication_types)) == ("2024-Mar-5", "day", "10.1/ab", "PMC12", ["eng", "fre"], ["Review"])
    assert (b.publication_date, b.precision, b.doi, b.pmcid) == ("2024 Spring", "provider_text", None, None)


def test_refused_articles(spark):
    pages = [(None, None), (article("x"), None), (article("0"), None), (article(title=""), None), (article() * 2, None), (article(ids='<ArticleId IdType="pmc">12</ArticleId>'), None), (article(ids='<ArticleId IdType="doi">1</ArticleId>' * 2), None), (article(), ["8"]), (article(), ["7", "8"]), ("<x>", None), (" ", ["1"])]
    assert [r.error for r in articles(spark, pages)] == ["malformed_xml", "invalid_pubmed_identifier", "invalid_pubmed_identifier", "missing_field", "duplicate_page_identity", "invalid_pmc_identifier", "duplicate_field", "pubmed_batch_identity_mismatch", "pubmed_batch_identity_mismatch", "malformed_xml", "pubmed_batch_identity_mismatch"]


def test_pages_by_start(spark, tmp_path):
    path = str(tmp_path / "p")
    paging.store(spark.createDataFrame([("a", str(k * 10), f"é{k}") for k in range(7)] + [("b", "0", "x")], "search string, position string, body string").repartition(3), path)
    got = paging.by_start(spark, path, [("a", 75, 10), ("b", 5, 10), ("c", 1, 10), ("d", 0, 10)], pages=2)
    assert got.rdd.getNumPartitions() == 6
    assert sorted((r.search, int(r.position), r.body, r.error) for r in got.collect()) == [("a", k * 10, f"é{k}", None) for k in range(7)] + [("a", 70, None, "page_missing"), ("b", 0, "x", None), ("c", 0, None, "page_missing")]
    assert paging.by_start(spark, path, [], pages=2).count() == 0
    paging.store(spark.createDataFrame([("b", "0", "y")], "search string, position string, body string"), path)
    with open(f"{path}/{paging.place('a', '10')}", "w") as f:
        f.write('{"body":"z","sha256":"0","search":"a","position":"10"}')
    rows = {(r.search, r.position): (r.body, r.error) for r in paging.by_start(spark, f"file://{path}", [("a", 20, 10), ("b", 5, 10)]).collect()}
    assert rows["b", "0"] == ("y", None) and rows["a", "10"] == (None, "page_damaged")


def test_long_searches_by_start(spark, tmp_path):
    """No start is left out, however many there are, and partitions grow then."""
    paging.store(spark.createDataFrame([("a", "40000", "x")], "search string, position string, body string"), str(tmp_path))
    got = paging.by_start(spark, str(tmp_path), [("a", 40_001, 1), ("b", 3, 2)], pages=4)
    assert got.rdd.getNumPartitions() <= paging.PARTITIONS + 2
    counts = {(r.search, r.error): (r.n, r.least, r.most) for r in got.groupBy("search", "error").agg(F.count("*").alias("n"), F.min(F.col("position").cast("int")).alias("least"), F.max(F.col("position").cast("int")).alias("most")).collect()}
    assert counts == {("a", None): (1, 40_000, 40_000), ("a", "page_missing"): (40_000, 0, 39_999), ("b", "page_missing"): (2, 0, 2)}


def test_pages_by_cursor(spark, tmp_path, monkeypatch):
    """A stream follows the cursors, waits for a page that isn't there yet, and goes on from its checkpoint."""
    path, out = str(tmp_path / "p"), str(tmp_path / "o")
    body = lambda n, after: json.dumps({"message": {"items": list(range(n)), "next-cursor": after}})
    pages = [("s", "*", body(2, "b")), ("s", "b", body(2, "c")), ("s", "c", body(2, "d")), ("s", "d", body(1, "e")), ("s", "e", body(2, "f"))]
    put = lambda rows: paging.store(spark.createDataFrame(rows, "search string, position string, body string"), path)

    def read():
        paging.by_cursor(spark, path, "s", 2).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start().awaitTermination()
        return sorted(r.position for r in spark.read.schema("position string").parquet(out).collect())

    put(pages[:2])
    assert read() == ["*", "b"] and read() == ["*", "b"]
    put(pages[2:])
    assert read() == ["*", "b", "c", "d"] and read() == ["*", "b", "c", "d"]  # the last page is short, so e is not of this search
    put([("t", "*", body(2, "*"))])
    paging.by_cursor(spark, path, "t", 2).writeStream.format("parquet").option("path", out + "2").option("checkpointLocation", str(tmp_path / "c2")).trigger(once=True).start().awaitTermination()
    assert [r.error for r in spark.read.parquet(out + "2").collect()] == ["cursor_no_progress"]


def test_long_searches_by_cursor(spark, tmp_path):
    """All pages that are there are one batch's, in several partitions; a stream that starts again goes on behind them, and a circle ends."""
    path = str(tmp_path / "p")
    body = lambda k, after: ("*" if k == 0 else f"c{k}", json.dumps({"message": {"items": [k], "next-cursor": after}}))
    put = lambda search, pages: paging.store(spark.createDataFrame([(search, *p) for p in pages], "search string, position string, body string").repartition(4), path)

    def read(search):
        out = str(tmp_path / search)
        paging.by_cursor(spark, path, search, 1).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c").trigger(once=True).start().awaitTermination()
        return [(r.position, r.error) for r in spark.read.schema("position string, error string").parquet(out).collect()]

    names = ["*", *(f"c{k}" for k in range(1, 330))]
    put("s", [body(k, f"c{k + 1}") for k in range(250)])
    assert sorted(read("s")) == sorted((c, None) for c in names[:250])
    put("s", [body(k, f"c{k + 1}" if k < 329 else "c7") for k in range(250, 330)])
    want = sorted((c, "cursor_cycle" if c == "c329" else None) for c in names)
    assert sorted(read("s")) == want and sorted(read("s")) == want


def test_requests(spark):
    rows = [([], [], ["w"], [], [], []), (["b c", "a"], ["a"], [], ["z"], ["y", "z"], []), (["x" * 16_000], [], [], [], [], [])]
    df = spark.createDataFrame(rows, "a array<string>, i array<string>, w array<string>, e array<string>, u array<string>, l array<string>").coalesce(1)
    got = [r.s for r in df.select(requests.article_search(*map(F.col, "aiweul")).alias("s")).collect()]
    assert [s.error for s in got] == ["empty_discovery_scope", None, "query_too_large"]
    assert got[1].search == '("a"[Title/Abstract] OR "b c"[Title/Abstract]) NOT ("y"[Title/Abstract] OR "z"[Title/Abstract])'
    texts = ["a b*~é/&=+", "", "%"]
    assert [r.e for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(requests.encoded(F.col("t")).alias("e")).collect()] == [urllib.parse.quote_plus(t) for t in texts]


def test_registers(spark):
    rows = [("a", "x", 1), ("a", "x", 5), ("a", "y", 2), ("b", "x", 3), ("b", None, 4), ("c", "z", 6), ("d", "y", 7), (None, "q", 8), (None, "r", 9)]
    got = registers.content_register(spark.createDataFrame(rows, "k string, p string, n long"), "k", ["p"], "n").collect()
    assert sorted((r.first_seq, r.id, r.n, r.outcome, r.against) for r in got) == [(1, "a", 2, "kept", None), (2, "a", 1, "payload_conflict", 1), (3, "b", 1, "id_conflict", 1), (4, "b", 1, "payload_conflict", 3), (6, "c", 1, "kept", None), (7, "d", 1, "id_conflict", 2), (8, None, 1, "kept", None), (9, None, 1, "payload_conflict", 8)]


def receipt(key, fingerprint="f", **more):
    sha = hashlib.sha256(b"body").hexdigest()
    return json.dumps({"schema_version": 1, "attempt_key": key, "request": {"request_fingerprint": fingerprint}, "body_sha256": sha, "body_object_id": "raw:" + sha, "body_size": 4, "complete": True} | more)


def test_orphan_receipts_that_come_again(spark):
    """An object that comes twice is one."""
    contents = [receipt(f"p{k}") for k in range(40)] + [receipt("p39", pad="y")]
    rows = [("raw:" + hashlib.sha256(c.encode()).hexdigest(), hashlib.sha256(c.encode()).hexdigest(), len(c), "available", c) for c in contents]
    objects = spark.createDataFrame(rows + rows[:20], "object_id string, sha256 string, size long, state string, content string")
    pages = spark.createDataFrame([(f"p{k}", "f", k > 0) for k in range(41)], "page_id string, fingerprint string, active boolean")
    attempts = spark.createDataFrame([(rows[5][0],)], "receipt_id string")
    got = {r.page_id: (r.outcome, r.receipt_id) for r in captures.orphan_receipts(pages, objects, attempts).collect()}
    want = {f"p{k}": ("attached", rows[k][0]) for k in range(40)} | {"p0": ("crossref_orphan_page_not_active", None), "p5": ("none", None), "p39": ("crossref_orphan_receipt_ambiguous", None), "p40": ("none", None)}
    assert got == want


def test_orphan_receipts(spark):
    kept = lambda content, **more: {"sha256": hashlib.sha256(content.encode()).hexdigest(), "size": len(content.encode()), "state": "available", "content": content} | more
    contents = [receipt("one"), receipt("two"), receipt("two", complete=False), receipt("other", "g"), receipt("old", schema_version=2), receipt("noted"), "no json", "[1]", receipt(5)]
    objects = [{"object_id": "raw:" + kept(c)["sha256"]} | kept(c) for c in contents]
    schema = "object_id string, sha256 string, size long, state string, content string"
    pages = spark.createDataFrame([(k, "f", k != "off") for k in ("one", "two", "other", "old", "noted", "none", "off")], "page_id string, fingerprint string, active boolean")
    attempts = spark.createDataFrame([(objects[5]["object_id"],)], "receipt_id string")
    find = lambda objects: {r.page_id: (r.outcome, r.receipt_id) for r in captures.orphan_receipts(pages, spark.createDataFrame([tuple(o[c.split()[0]] for c in schema.split(", ")) for o in objects], schema), attempts).collect()}
    assert find(objects) == {
        "one": ("attached", objects[0]["object_id"]), "two": ("crossref_orphan_receipt_ambiguous", None), "other": ("crossref_orphan_request_mismatch", None),
        "old": ("crossref_orphan_receipt_invalid", None), "noted": ("none", None), "none": ("none", None), "off": ("crossref_orphan_page_not_active", None),
    }
    assert set(find([*objects, {"object_id": "raw:x"} | kept("q")]).values()) == {("crossref_orphan_registry_corrupt", None), ("crossref_orphan_page_not_active", None)}
    lost = {"object_id": "raw:" + kept("q")["sha256"]} | kept("q") | {"content": "changed"}
    assert find([*objects, lost])["none"] == ("crossref_orphan_object_unreadable", None)
    assert find([])["one"] == ("none", None)


def test_framing(spark):
    cases = [[], [("content-length", " 12 ")], [("content-length", "1"), ("content-length", "1")], [("transfer-encoding", "Chunked")], [("transfer-encoding", "gzip")], [("content-length", "1"), ("transfer-encoding", "chunked")], [("content-length", "x")], [("content-length", "9" * 19)]]
    df = spark.createDataFrame([(c,) for c in cases], "h array<struct<key:string,value:string>>").coalesce(1)
    bad = (None, "invalid_response_framing")
    assert [tuple(r.f) for r in df.select(captures.framing(F.col("h")).alias("f")).collect()] == [(None, None), (12, None), bad, (None, None), bad, bad, bad, bad]


def test_split_trees(spark):
    """A tree of six levels, one with a gap, one of which a half is missing, a circle, and a child of two parents."""
    windows, splits = [], []

    def grow(node, a, b, depth):
        windows.append((node, a, b))
        if depth:
            middle = (a + b) // 2
            splits.append((node, node * 2, node * 2 + 1))
            grow(node * 2, a, middle, depth - 1)
            grow(node * 2 + 1, middle, b, depth - 1)

    grow(1, 0, 1000, 6)
    windows += [(1000, 0, 10), (1001, 0, 4), (1002, 5, 10), (2000, 0, 10), (2001, 0, 5), (3000, 0, 10), (3001, 0, 5), (3002, 5, 10), (4000, 0, 10), (4001, 0, 5), (4002, 5, 10)]
    splits += [(1000, 1001, 1002), (2000, 2001, 2002), (3000, 3001, 3002), (3001, 3000, 3002), (4000, 4001, 4002), (4000, 4001, 4002)]
    args = spark.createDataFrame(windows, "window_id long, from_at long, until_at long"), spark.createDataFrame(splits, "parent_id long, left_id long, right_id long")
    got = {r.window_id: r for r in traversal.split_tree(*args).collect()}
    assert len(got) == len(windows) and all((got[n].root_id, got[n].depth, got[n].leaf, got[n].reason) == (1, n.bit_length() - 1, n >= 64, None) for n in range(1, 128))
    reasons = {n: r.reason for n, r in got.items() if r.reason}
    assert reasons == {1000: "gap_between", 2000: "window_missing", 3000: "too_deep", 3001: "too_deep", 3002: "two_parents", 4000: "split_twice", 4001: "two_parents", 4002: "two_parents"}
    shallow = {r.window_id: r.reason for r in traversal.split_tree(*args, most_depth=4).collect()}
    assert shallow[16] is None and shallow[32] == "too_deep"
