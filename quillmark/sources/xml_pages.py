"""Provider pages in XML, parsed in the JVM: feeds of preprints, and sets of articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import texts, timing
from quillmark.operators.rows import pinned

#: Namespaces, by the prefix that they get here.
ATOM = "http://www.w3.org/2005/Atom"
PREFIXES = {"arxiv": "http://arxiv.org/schemas/atom", "opensearch": "http://a9.com/-/spec/opensearch/1.1/"}
#: What is read of a feed. Everything that may come once is read as a list, so that a second one is seen.
FEED = """id array<string>, updated array<string>, `opensearch:totalResults` array<string>, `opensearch:startIndex` array<string>, `opensearch:itemsPerPage` array<string>,
  entry array<struct<id:array<string>, title:array<string>, summary:array<string>, published:array<string>, updated:array<string>,
    author:array<struct<name:array<string>, `arxiv:affiliation`:array<string>>>, category:array<struct<_term:string, _scheme:string>>,
    `arxiv:primary_category`:array<struct<_term:string, _none:string>>, `arxiv:doi`:array<string>, `arxiv:journal_ref`:array<string>, `arxiv:comment`:array<string>,
    link:array<struct<_href:string, _rel:string, _title:string, _type:string>>>>, _corrupt string"""
TEXTS = "id|title|summary|published|updated|name|arxiv:doi|arxiv:journal_ref|arxiv:comment|arxiv:affiliation|opensearch:totalResults|opensearch:startIndex|opensearch:itemsPerPage"
INNER = r"(?:[^<]|<!\[CDATA\[(?:[^\]]|\](?!\]>))*+\]\]>|<!--(?:[^-]|-(?!->))*+-->)*+"
ROOT = r"^\x{FEFF}?\s*(?:<\?xml(?:[^?]|\?(?!>))*+\?>)?(?:\s|<!--(?:[^-]|-(?!->))*+-->)*+<([\w:.-]+)((?:\s[^>]*?)?)/?>"
OPTIONS = {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"}


def prefixed(body: Column) -> Column:
    """With the usual prefixes, whichever ones the page declares for these namespaces."""
    for prefix, uri in PREFIXES.items():
        own = F.regexp_extract(body, rf"xmlns:([\w.-]+)\s*=\s*[\"']{uri.replace('.', '[.]')}[\"']", 1)
        body = F.when((own == "") | (own == prefix), body).otherwise(F.regexp_replace(body, F.concat(F.lit("(</?)"), own, F.lit(":")), F.lit(f"$1{prefix}:")))
    return body


def first_of(*errors: Column) -> Column:
    return F.coalesce(*errors)


def once(values: Column, needed: bool = False) -> Column:
    """Why a list isn't at most one text, or one that isn't blank where it is needed; null if it is."""
    missing = F.when(F.coalesce(F.size(values), F.lit(0)) == 0, "missing_field").when(texts.stripped(F.coalesce(values[0], F.lit(""))) == "", "empty_required_field") if needed else F.lit(None).cast("string")
    return F.when(F.size(values) > 1, "duplicate_field").otherwise(missing)


def one(values: Column) -> Column:
    return F.when(F.size(values) > 0, texts.stripped(F.coalesce(F.get(values, F.lit(0)), F.lit(""))))


def timestamp(value: Column) -> Column:
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})\z"), timing.instant(value))


IDENTITY = r"^https?://arxiv\.org/abs/((?:[0-9]{4}\.[0-9]{4,5}|[a-z][A-Za-z0-9.-]*/[0-9]{7}))(?:v([1-9][0-9]{0,8}))?\z"


def _entry_error(e: Column) -> Column:
    """The first thing wrong with an entry of a feed, in the order in which its fields are looked at."""
    get = lambda k: e[k]
    identity, serial = one(get("id")), F.regexp_extract(one(get("id")), IDENTITY, 1)
    month = F.regexp_extract(serial, r"(?:^|/)\d\d(\d\d)", 1).try_cast("int")
    n = lambda k: F.coalesce(F.size(get(k)), F.lit(0))
    some = lambda k, wrong: F.exists(F.coalesce(get(k), F.array()), wrong)
    term = lambda c: texts.stripped(F.coalesce(c["_term"], F.lit("")))
    names = F.get(F.filter(F.transform(get("author"), lambda a: once(a["name"], True)), lambda x: x.isNotNull()), F.lit(0))
    primary = term(F.get(get("arxiv:primary_category"), F.lit(0)))
    return first_of(
        F.when(identity.rlike(r"[\x00-\x20\x7F]") | ~identity.rlike(IDENTITY) | ~F.coalesce(month.between(1, 12), F.lit(False)), "invalid_source_identity"),
        once(get("title"), True),
        once(get("summary")),
        names,
        F.when(some("category", lambda c: term(c) == ""), "invalid_category"),
        F.when((n("author") == 0) | (n("category") == 0), "missing_field"),
        once(get("arxiv:primary_category")),
        F.when((n("arxiv:primary_category") > 0) & ~some("category", lambda c: term(c) == primary), "invalid_primary_category"),
        F.when(some("link", lambda x: texts.stripped(F.coalesce(x["_href"], F.lit(""))) == ""), "invalid_link_metadata"),
        *(x for k in ("published", "updated") for x in (once(get(k), True), F.when(timestamp(one(get(k))).isNull(), "invalid_timestamp"))),
        *(once(get(f"arxiv:{k}")) for k in ("doi", "journal_ref", "comment")),
    )


def atom_records(pages: DataFrame, most_bytes: int = 8_000_000) -> DataFrame:
    """A row for each entry of pages(page_id, body, max_results) of a feed: page_id, place, id, base_id, version, url, title, abstract, authors with affiliations,
    published, updated, categories with schemes, primary_category, doi, journal_ref, comment, links, and the page's total, start and items; error is null.

    A page that can't be taken whole gives one row with its error and nothing else: response_too_large, malformed_xml (a null body as well),
    xml_doctype_forbidden, invalid_feed_namespace, arxiv_api_error, invalid_page_counts, unsupported_text_markup, or the first of an entry's. A page without entries gives none.
    """
    own = ["page_id", "body", "max_results"]
    raw = pinned(pages, own, _x=prefixed(F.col("body")))
    rows = pinned(raw, [*own, "_x"], _p=F.from_xml("_x", FEED, OPTIONS), _root=F.regexp_extract("_x", ROOT, 1), _attributes=F.regexp_extract("_x", ROOT, 2))
    p = lambda k: F.col("_p")[k]
    entries = F.coalesce(p("entry"), F.array())
    count = lambda k: F.when(one(p(f"opensearch:{k}")).rlike(r"^[0-9]{1,10}\z"), one(p(f"opensearch:{k}")).try_cast("long"))
    total, start, items = (count(k) for k in ("totalResults", "startIndex", "itemsPerPage"))
    n, wanted = F.size(entries), F.col("max_results")
    atom = F.when(F.col("_root").contains(":"), F.concat(F.lit("xmlns:"), F.split_part("_root", F.lit(":"), F.lit(1)))).otherwise("xmlns")
    named = F.rlike("_attributes", F.concat(F.lit(r"\s"), atom, F.lit(rf"\s*=\s*[\"']{ATOM.replace('.', '[.]')}[\"']")))
    # an entry that the feed's own elements don't have the namespace for
    foreign = F.col("_x").rlike(r"<[\w.-]+:entry[\s>]") & ~F.col("_root").contains(":")
    errors = F.filter(F.transform(entries, _entry_error), lambda e: e.isNotNull())
    error = first_of(
        F.when(F.octet_length("body") > most_bytes, "response_too_large"),
        F.when(F.col("body").rlike("<!DOCTYPE"), "xml_doctype_forbidden"),
        F.when(F.col("body").isNull() | p("_corrupt").isNotNull() | (F.col("_root") == ""), "malformed_xml"),
        F.when((F.regexp_extract("_root", r"([\w.-]+)$", 1) != "feed") | ~named, "invalid_feed_namespace"),
        F.when(foreign, "invalid_entry_namespace"),
        F.get(F.filter(F.transform(entries, lambda e: once(e["id"], True)), lambda e: e.isNotNull()), F.lit(0)),
        F.when(F.exists(entries, lambda e: one(e["id"]).rlike(r"^https?://arxiv\.org/api/errors(?:[#?]|\z)")), "arxiv_api_error"),
        *(once(p(f"opensearch:{k}"), True) for k in ("totalResults", "startIndex", "itemsPerPage")),
        F.when(total.isNull() | start.isNull() | items.isNull() | (items > wanted) | (n > items), "invalid_page_counts"),
        F.when(F.col("_x").rlike(rf"<({TEXTS})(?:\s[^>]*[^/>])?>{INNER}<(?!/)"), "unsupported_text_markup"),
        F.get(errors, F.lit(0)),
    )
    rows = pinned(rows, ["page_id", "_p"], error=error, total=total, start=start, items=items)
    broken = rows.where("error is not null").select("page_id", "error")
    each = rows.where("error is null").select("page_id", "total", "start", "items", F.posexplode("_p.entry").alias("place", "e"))
    e = lambda k: F.col("e")[k]
    part = lambda k: F.regexp_extract(one(e("id")), IDENTITY, k)
    identity = F.regexp_extract(one(e("id")), r"/abs/(.*)\z", 1)
    record = each.select(
        "page_id", "place", identity.alias("id"), part(1).alias("base_id"), part(2).try_cast("int").alias("version"), F.concat(F.lit("https://arxiv.org/abs/"), identity).alias("url"),
        one(e("title")).alias("title"), F.get(e("summary"), F.lit(0)).alias("abstract"),
        F.transform(e("author"), lambda a: F.struct(one(a["name"]).alias("name"), F.transform(F.coalesce(a["arxiv:affiliation"], F.array()), lambda x: texts.stripped(F.coalesce(x, F.lit("")))).alias("affiliations"))).alias("authors"),
        timestamp(one(e("published"))).alias("published"), timestamp(one(e("updated"))).alias("updated"),
        F.transform(e("category"), lambda c: F.struct(texts.stripped(c["_term"]).alias("term"), c["_scheme"].alias("scheme"))).alias("categories"),
        texts.stripped(F.get(e("arxiv:primary_category"), F.lit(0))["_term"]).alias("primary_category"), *(one(e(f"arxiv:{k}")).alias(k) for k in ("doi", "journal_ref", "comment")),
        F.transform(F.coalesce(e("link"), F.array()), lambda x: F.struct(x["_href"].alias("href"), x["_rel"].alias("rel"), x["_title"].alias("title"), x["_type"].alias("type"))).alias("links"),
        "total", "start", "items", F.lit(None).cast("string").alias("error"),
    )
    return record.unionByName(broken, allowMissingColumns=True)


#: What is read of a set of articles.
ARTICLES = """PubmedArticle array<struct<
  MedlineCitation:struct<PMID:string, Article:struct<ArticleTitle:string, Abstract:struct<AbstractText:array<struct<_VALUE:string, _Label:string>>>,
    AuthorList:struct<Author:array<struct<CollectiveName:string, LastName:string, ForeName:string, Initials:string>>>,
    Journal:struct<Title:string, JournalIssue:struct<PubDate:struct<MedlineDate:string, Year:string, Month:string, Day:string>>>,
    Language:array<string>, PublicationTypeList:struct<PublicationType:array<struct<_VALUE:string, _UI:string>>>>>,
  PubmedData:struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string, _IdType:string>>>>>>, _corrupt string"""
#: Markup inside texts, whose own text counts.
INLINE = r"</?(?:b|i|u|sup|sub|em|strong|mml:[\w-]+|DispFormula)(?:\s[^>]*)?/?>"


def flat(value: Column) -> Column:
    """With single blanks; null for what is blank."""
    return F.nullif(texts.stripped(F.regexp_replace(value, r"[\s\p{Z}\x1C-\x1F\x85]+", " ")), F.lit(""))


def article_records(pages: DataFrame, most_bytes: int = 8_000_000) -> DataFrame:
    """A row for each article of pages(page_id, body, expected): page_id, place, pmid, title, abstract (parts by their labels, a line each), authors, journal,
    publication_date and its precision, doi, pmcid, languages (sorted), publication_types; error is null.

    expected: the ids that were asked for; null where that isn't known. A page that can't be taken whole gives one row with its error:
    response_too_large, malformed_xml, xml_doctype_forbidden, invalid_pubmed_bibliography, invalid_pubmed_identifier, duplicate_page_identity, missing_field, duplicate_field,
    invalid_pmc_identifier, pubmed_batch_identity_mismatch. Markup inside texts is taken off before they are read.
    """
    rows = pinned(pages, ["page_id", "body", "expected"], _p=F.from_xml(F.regexp_replace("body", INLINE, ""), ARTICLES, OPTIONS), _root=F.regexp_extract("body", ROOT, 1))
    articles = F.coalesce(F.col("_p.PubmedArticle"), F.array())
    pmid = lambda a: flat(a["MedlineCitation"]["PMID"])
    article = lambda a: a["MedlineCitation"]["Article"]
    ids = lambda a, kind: F.filter(F.transform(F.filter(F.coalesce(a["PubmedData"]["ArticleIdList"]["ArticleId"], F.array()), lambda i: i["_IdType"] == kind), lambda i: flat(i["_VALUE"])), lambda i: i.isNotNull())
    number = lambda a: F.when(pmid(a).rlike(r"^[0-9]{1,10}\z"), pmid(a).try_cast("long"))
    found = F.transform(articles, number)
    pmcid = lambda a: F.upper(F.get(ids(a, "pmc"), F.lit(0)))
    own = F.transform(
        articles,
        lambda a: first_of(
            F.when(~F.coalesce(number(a) > 0, F.lit(False)), "invalid_pubmed_identifier"),
            F.when(flat(article(a)["ArticleTitle"]).isNull(), "missing_field"),
            F.when((F.size(ids(a, "doi")) > 1) | (F.size(ids(a, "pmc")) > 1), "duplicate_field"),
            F.when(pmcid(a).isNotNull() & ~pmcid(a).rlike(r"^PMC[0-9]{1,10}\z"), "invalid_pmc_identifier"),
        ),
    )
    expected = F.transform(F.col("expected"), lambda i: i.try_cast("long"))
    error = first_of(
        F.when(F.octet_length("body") > most_bytes, "response_too_large"),
        F.when(F.col("body").rlike("<!DOCTYPE"), "xml_doctype_forbidden"),
        F.when(F.col("body").isNull() | F.col("_p._corrupt").isNotNull() | (F.col("_root") == ""), "malformed_xml"),
        F.when(F.col("_root") != "PubmedArticleSet", "invalid_pubmed_bibliography"),
        F.get(F.filter(own, lambda e: e.isNotNull()), F.lit(0)),
        F.when(F.size(F.array_distinct(found)) < F.size(found), "duplicate_page_identity"),
        F.when(expected.isNotNull() & ((F.size(expected) != F.size(found)) | (F.size(F.array_except(expected, found)) > 0)), "pubmed_batch_identity_mismatch"),
    )
    rows = pinned(rows, ["page_id", "_p"], error=error)
    broken = rows.where("error is not null").select("page_id", "error")
    each = rows.where("error is null").select("page_id", F.posexplode("_p.PubmedArticle").alias("place", "a"))
    a, of = F.col("a"), article(F.col("a"))
    parts = F.transform(F.coalesce(of["Abstract"]["AbstractText"], F.array()), lambda t: F.when(F.length(t["_Label"]) > 0, F.concat(t["_Label"], F.lit(": "), flat(t["_VALUE"]))).otherwise(flat(t["_VALUE"])))
    name = lambda x: F.coalesce(flat(x["CollectiveName"]), F.nullif(F.concat_ws(" ", flat(x["LastName"]), F.coalesce(flat(x["ForeName"]), flat(x["Initials"]))), F.lit("")))
    date = of["Journal"]["JournalIssue"]["PubDate"]
    year, month, day = (flat(date[k]) for k in ("Year", "Month", "Day"))
    precision = F.when(flat(date["MedlineDate"]).isNotNull(), "provider_text").when(year.isNull(), None).when(day.isNotNull(), "day").when(month.isNotNull(), "month").otherwise("year")
    record = each.select(
        "page_id", "place", number(a).cast("string").alias("pmid"), flat(of["ArticleTitle"]).alias("title"), F.nullif(F.array_join(F.array_compact(parts), "\n"), F.lit("")).alias("abstract"),
        F.array_compact(F.transform(F.coalesce(of["AuthorList"]["Author"], F.array()), name)).alias("authors"), flat(of["Journal"]["Title"]).alias("journal"),
        F.coalesce(flat(date["MedlineDate"]), F.when(year.isNotNull(), F.concat_ws("-", year, month, day))).alias("publication_date"), precision.alias("precision"),
        F.lower(F.get(ids(a, "doi"), F.lit(0))).alias("doi"), pmcid(a).alias("pmcid"),
        F.array_sort(F.array_distinct(F.array_compact(F.transform(F.coalesce(of["Language"], F.array()), flat)))).alias("languages"),
        F.array_compact(F.transform(F.coalesce(of["PublicationTypeList"]["PublicationType"], F.array()), lambda t: flat(t["_VALUE"]))).alias("publication_types"), F.lit(None).cast("string").alias("error"),
    )
    return record.unionByName(broken, allowMissingColumns=True)
