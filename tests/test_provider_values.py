"""Provider items against plain Python over random JSON: types, numbers, dates, rates."""

import hashlib
import json
import random
from datetime import datetime, timedelta, timezone
from email.utils import format_datetime, parsedate_to_datetime

import pytest
from pyspark.sql import functions as F

from quillmark.functions import rates, timing, values
from quillmark.operators import graph, providers


def texts(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, a string").repartition(2)
    return [r.out for r in rows.select("i", f(F.col("a")).alias("out")).orderBy("i").collect()]


def value(rng, depth=3):
    leaf = [0, -7, 12345678901234567890123456789012345678901, 1.0, 2.5, 1e16, -1.5e-7, 1e300, True, None, "", "x", "é ", 'q"\\/', " a\r\nb ", "\U0001f600"]
    if depth == 0 or rng.random() < 0.4:
        return rng.choice(leaf)
    if rng.random() < 0.5:
        return [value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["a", "b", "DOI", "id", "é", "x y"]) + str(k): value(rng, depth - 1) for k in range(rng.randint(0, 3))}


def spelled(rng, v):
    """The JSON of a value in one of the ways that a provider may write it."""
    text = json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
    return text.replace("2.5", "2.50").replace("/", "\\/") if rng.random() < 0.5 else text


def test_items_keep_what_was_sent(spark):
    rng = random.Random(1)
    pages, want = [], {}
    for n in range(60):
        items = [value(rng) if rng.random() < 0.3 else {"DOI": rng.choice(["10.1/x", 5, None, "", " a", "10.1/é"]), "score": rng.choice([1.0, 17.25, 3]), "v": value(rng)} for _ in range(rng.randint(0, 4))]
        body = spelled(rng, {"status": "ok", "message-type": "work-list", "message": {"items": items, "next-cursor": "c", "total-results": 7}})
        pages.append((n, body, "*", 10, hashlib.sha256(body.encode()).hexdigest(), 200))
        for k, item in enumerate(items):
            canonical = json.dumps(item, ensure_ascii=True, sort_keys=True, separators=(",", ":"))
            doi = item.get("DOI") if isinstance(item, dict) else None
            fine = isinstance(doi, str) and doi != "" and doi == doi.strip()
            want[n, k] = ("decoded" if fine else "quarantined", doi if isinstance(doi, str) else None, hashlib.sha256(canonical.encode()).hexdigest())
    decoded = providers.decoded_pages(spark.createDataFrame(pages, "page_id long, body string, cursor string, rows int, sha256 string, status int"))
    assert {(r.page_id, r.ordinal): (r.state, r.raw_doi, r.sha256) for r in providers.decoded_items(decoded).collect()} == want
    assert {(r.error, r.total, r.end_hint) for r in decoded.collect()} == {(None, 7, True)}


def test_envelopes(spark):
    page = lambda message, **more: json.dumps({"status": "ok", "message-type": "work-list", "message": message} | more)
    items = [{"DOI": "a"}, {"DOI": "b"}]
    cases = {
        page({"items": items, "next-cursor": "n", "total-results": "7"}): "invalid_crossref_envelope",
        page({"items": items, "next-cursor": "n", "total-results": 7.0}): "invalid_crossref_envelope",
        page({"items": items, "next-cursor": "n", "total-results": True}): "invalid_crossref_envelope",
        page({"items": items, "next-cursor": "n", "total-results": None}): None,
        page({"items": {}, "next-cursor": "n"}): "invalid_crossref_envelope",
        page({"items": items, "next-cursor": 5}): "invalid_crossref_cursor",
        page({"items": items, "next-cursor": None}): "crossref_next_cursor_missing",
        page({"items": items[:1], "next-cursor": None}): None,
        page({"items": items, "next-cursor": "n"}, status="no"): "invalid_crossref_envelope",
        page({"items": items, "next-cursor": "n"}) + " x": "invalid_crossref_json",
        page({"items": items, "next-cursor": "n", "deep": json.loads("[" * 63 + "]" * 63)}): "invalid_crossref_json",
        page({"items": items, "next-cursor": "n", "deep": json.loads("[" * 62 + "]" * 62)}): None,
        page({"items": items, "next-cursor": "n"}).replace('"DOI": "b"', '"DOI": "b", "DOI": "b"'): "invalid_crossref_json",
        page({"items": items, "next-cursor": "n"}).replace('"b"', "1e400"): "invalid_crossref_json",
        "[]": "invalid_crossref_envelope",
    }
    rows = [(n, body, "c", 2, hashlib.sha256(body.encode()).hexdigest(), 200) for n, body in enumerate(cases)]
    got = {r.page_id: r.error for r in providers.decoded_pages(spark.createDataFrame(rows, "page_id long, body string, cursor string, rows int, sha256 string, status int")).collect()}
    assert got == dict(enumerate(cases.values()))


def strict(text, most_depth=5, most_nodes=40):
    depth = most = 0
    inside = escaped = False
    for c in text:
        if inside:
            inside, escaped = (inside if escaped else c != '"'), (not escaped and c == "\\")
        elif c == '"':
            inside = True
        elif c in "[{":
            depth += 1
            most = max(most, depth)
        elif c in "]}":
            depth -= 1
    if most > most_depth:
        return "too_deep"

    def unique(pairs):
        if len(dict(pairs)) < len(pairs):
            raise KeyError
        return dict(pairs)

    def constant(_):
        raise ArithmeticError

    def count(v):
        if isinstance(v, float) and v in (float("inf"), float("-inf")):
            raise ArithmeticError
        return 1 + sum(map(count, v.values() if isinstance(v, dict) else v if isinstance(v, list) else []))

    try:
        v = json.loads(text, object_pairs_hook=unique, parse_constant=constant)
        return "too_large" if count(v) > most_nodes else None
    except KeyError:
        return "duplicate_key"
    except ArithmeticError:
        return "not_finite"
    except ValueError:
        return "invalid"


def test_strict_json(spark):
    rng = random.Random(2)
    cases = [spelled(rng, value(rng, rng.randint(1, 7))) for _ in range(200)]
    for c in cases[:120]:  # one character changed
        at = rng.randrange(len(c))
        cases.append(c[:at] + rng.choice(['"', "{", "}", "[", "]", ",", ":", "0", "", "x", "\\"]) + c[at + 1 :])
    cases += ["NaN", '{"a":-Infinity}', '{"a":"NaN Infinity"}', '["Infinity"]', "[1e999]", '[-1e999,"Infinity"]', "{'a':1}", "[1]]", "[1] [2]", "{}", "[]", " 5 ", '"x"', "", " ", "[[[[[[1]]]]]]", '"[[[[[["', "[01]", "[1,]", "﻿[]", '{"a":{"b":1,"b":2}}', "[" + "1," * 45 + "1]"]
    got = texts(spark, cases, lambda c: values.problem(c, 5, 40))
    for c, g in zip(cases, got, strict=True):
        w = strict(c)
        assert g == w or {g, w} <= {"invalid", "duplicate_key", "too_deep", "too_large", "not_finite"} and None not in (g, w), (c, g, w)
    assert sum(g == strict(c) for c, g in zip(cases, got, strict=True)) > 0.9 * len(cases)


def test_relations_by_type(spark):
    items = ['{"relation":[1]}', '{"relation":"x"}', '{"relation":null}', "{}", '{"relation":{}}', '{"relation":{"":[{"id-type":"doi","id":"1"}]}}', '{"relation":{"cites":[{"id-type":5,"id":"1"}]}}', '{"relation":{"cites":{"id":1}}}', '{"relation":{"cites":[1,{"id-type":"doi","id":"1","asserted-by":7},{"id-type":"doi","id":"1","asserted-by":null}],"a":[]}}']
    rows = graph.relation_entries(spark.createDataFrame(list(enumerate(items)), "item_id long, json string")).collect()
    got = sorted((r.item_id, r.predicate or "", -1 if r.place is None else r.place, r.gap or "", r.ordinal) for r in rows)
    assert got == [(0, "", -1, "not_object", None), (1, "", -1, "not_object", None), (5, "", -1, "predicate_invalid", None), (6, "cites", 0, "target_missing", None), (7, "cites", -1, "entries_not_list", None), (8, "cites", 0, "entry_not_object", None), (8, "cites", 1, "asserted_by_invalid", None), (8, "cites", 2, "", 0)]


def test_updates_by_type(spark):
    items = ['{"update-to":[{"DOI":5,"type":"correction"}]}', '{"update-to":[{"DOI":"10.1/x","type":["correction"],"updated":{"date-time":"2024-01-02T03:04Z"}}]}', '{"updated-by":{}}', '{"update-to":[],"updated-by":[7]}', '{"update-to":[{"DOI":"10.1/x","type":"retraction","updated":"2024"}]}']
    df = spark.createDataFrame(list(enumerate(items)), "item_id long, json string")
    assert sorted((r.item_id, r.counterparty, r.kind, r.updated) for r in graph.integrity_entries(df).collect()) == [(0, None, "correction", None), (1, "10.1/x", "other_update", "2024-01-02T03:04:00+00:00"), (4, "10.1/x", "retraction", None)]
    assert sorted((r.item_id, r.path, r.code) for r in graph.integrity_gaps(df).collect()) == [(0, "update-to[0].DOI", "integrity_counterparty_doi_invalid_text"), (1, "update-to[0].type", "integrity_field_invalid"), (2, "updated-by", "integrity_updates_not_list"), (3, "updated-by[0]", "integrity_update_not_object"), (4, "update-to[0].updated", "integrity_updated_invalid")]


def test_instants(spark):
    rng = random.Random(3)
    cases = ["2024-01-02T03:04Z", "2024-01-02 03Z", "20240102T030405Z", "2024-01-02T03:04:05.1234567Z", "2024-01-02T03:04:05,5+02:30", "2024-02-30T00:00Z", "2024-01-02T03:04:05", "2024-01-02", "2024-01-02T25:00Z", "2024-01-02T03:04:05+24:00", "2024-01-02T03:04:60Z", "", "x", "2024-01-02T030405+0530", "2024-01-02T03:04:05-00:00:30", None]
    cases += [(datetime(2000, 1, 1) + timedelta(microseconds=rng.randrange(10**15))).isoformat() + rng.choice(["Z", "+05:45", "-11:00", ""]) for _ in range(60)]

    def plain(c):
        try:
            at = datetime.fromisoformat(c.replace("Z", "+00:00"))
            return at.astimezone(timezone.utc).isoformat() if at.tzinfo else None
        except (ValueError, AttributeError):
            return None

    assert texts(spark, cases, timing.instant_text) == [plain(c) for c in cases]


def test_titles_and_dates(spark):
    items = ['{"title":["A\\r\\nB "]}', '{"title":[" \\u3000", 5, "\\tx"]}', '{"title":"x"}', '{"title":[]}', "{}", '{"title":null,"indexed":{"date-time":"2024-01-01T00:00:00Z"},"created":{"date-time":5},"deposited":{"date-time":"soon"},"published":{"date-parts":[[2024,2]]}}', '{"indexed":[],"published":{"date-parts":[["2024"]]}}', '{"published":{"date-parts":[[2024,13]]}}', '{"published":5}', '{"published":{"date-parts":[[2024,2,30]]}}']
    rows = providers.provider_dates(spark.createDataFrame(list(enumerate(items)), "i long, json string")).orderBy("i").collect()
    assert [r.title for r in rows[:5]] == ["A\r\nB", "x", None, None, None]
    assert [list(r.warnings) for r in rows] == [[], [], ["title_shape_invalid"], ["title_missing_text"], [], ["created_shape_invalid", "deposited_time_invalid"], ["indexed_shape_invalid", "published_shape_invalid"], ["published_date_invalid"], ["published_shape_invalid"], ["published_date_invalid"]]
    assert (rows[5].indexed, rows[5].published, rows[5].published_precision) == ("2024-01-01T00:00:00+00:00", "2024-02", "month")


NOW = datetime(2024, 3, 1, 12, tzinfo=timezone.utc)


def decided(status, headers, failures, jitter, error):
    """(action, code, delay, interval, concurrency, rate_type, warnings, halts)."""
    own = {}
    for k, v in headers:
        own.setdefault(k.lower(), []).append(v.strip())
    one = lambda k: own[k][0] if len(own.get(k, [])) == 1 else None
    warnings, interval = [], 1.0
    if "x-rate-limit-limit" not in own and "x-rate-limit-interval" not in own:
        warnings.append("crossref_rate_headers_missing")
    else:
        limit, period = one("x-rate-limit-limit"), one("x-rate-limit-interval")
        if limit and limit.isdecimal() and 1 <= int(limit) <= 10**6 and period and period.endswith("s") and period[:-1].replace(".", "", 1).isdecimal() and 0 < float(period[:-1]) <= 31 * 86400:
            interval = max(1.0, float(period[:-1]) / int(limit))
        else:
            warnings.append("crossref_rate_headers_invalid")
    concurrency = one("x-concurrency-limit")
    concurrency = int(concurrency) if concurrency and concurrency.isdecimal() and 1 <= int(concurrency) <= 1024 else None
    if "x-concurrency-limit" in own and concurrency is None:
        warnings.append("crossref_concurrency_header_invalid")
    kind = one("x-rate-limit-type")
    kind = kind if kind and len(kind) <= 64 else None
    if "x-rate-limit-type" in own and kind is None:
        warnings.append("crossref_rate_type_invalid")
    rest = (interval, concurrency, kind, warnings)
    if status == 403:
        return ("stop", "crossref_forbidden", 0.0, *rest, True)
    if status == 429 or status is not None and status >= 500 or status in (None, 200) and error in rates.RETRYABLE:
        after, wait = own.get("retry-after"), 0.0
        try:
            if after:
                assert len(after) == 1
                if after[0].isdecimal():
                    wait = float(after[0])
                else:
                    due = parsedate_to_datetime(after[0])
                    wait = max(0.0, (due - NOW).total_seconds())
                    if one("date") and one("date") != "now":
                        wait = max(wait, (due - parsedate_to_datetime(one("date"))).total_seconds())
            assert wait <= 31 * 86400
        except (AssertionError, ValueError, TypeError):
            return ("stop", "crossref_retry_after_invalid", 0.0, *rest, True)
        code = "crossref_rate_limited" if status == 429 else "crossref_server_error" if status and status >= 500 else error
        return ("retry", code, max(interval, wait, min(300.0, 2.0 ** min(failures + 1, 9)) * (0.5 + 0.5 * jitter)), *rest, False)
    if status == 200 and error is None:
        return ("accept", None, 0.0, *rest, False)
    return ("stop", error or ("crossref_redirect" if status and 300 <= status < 400 else "crossref_http_error" if status else "crossref_no_response"), 0.0, *rest, False)


def test_rate_decisions(spark):
    rng = random.Random(4)
    date = lambda days: format_datetime(NOW + timedelta(days=days), usegmt=True)
    choices = {"X-Rate-Limit-Limit": ["50", "0", "x", "1"], "x-rate-limit-interval": ["1s", "10.5s", "5", "0s"], "X-Concurrency-Limit": ["3", "2000", ""], "x-rate-limit-type": ["pool", "", "y" * 70], "Retry-After": ["5", "9999999999", date(1), date(-1), date(40), "soon"], "Date": [date(-3), date(2), "now"]}
    rows = []
    for n in range(400):
        headers = [(k, rng.choice(v)) for k, v in choices.items() if rng.random() < 0.5]
        headers += [rng.choice(headers)] if headers and rng.random() < 0.1 else []
        rows.append((n, rng.choice([200, 200, 403, 404, 302, 429, 429, 503, None]), headers, rng.randint(0, 12), rng.choice([0.0, 0.5, 1.0]), rng.choice([None, None, None, "source_timeout", "body_too_large"])))
    df = spark.createDataFrame(rows, "n long, status int, headers array<struct<key:string,value:string>>, failures int, jitter double, error string")
    made = rates.decision(F.col("status"), F.col("headers"), F.lit(NOW), F.col("failures"), F.col("jitter"), F.col("error"))
    got = {r.n: tuple(r.d) for r in df.select("n", made.alias("d")).collect()}
    for n, status, headers, failures, jitter, error in rows:
        want = decided(status, headers, failures, jitter, error)
        assert got[n] == (*want[:2], pytest.approx(want[2]), pytest.approx(want[3]), *want[4:]), (rows[n], got[n], want)


def test_unsound_rates(spark):
    rows = [(200, [("a b", "x")], 0, 0.5), (403, [("a", "\n")], 0, 0.5), (99, [], 0, 0.5), (200, [], -1, 0.5), (200, [], 0, 1.5), (200, None, 0, 0.5)]
    df = spark.createDataFrame(rows, "status int, headers array<struct<key:string,value:string>>, failures int, jitter double").coalesce(1)
    got = df.select(rates.decision(F.col("status"), F.col("headers"), F.lit(NOW), F.col("failures"), F.col("jitter"), F.lit(None).cast("string")).alias("d")).collect()
    assert [r.d.code for r in got] == ["invalid_crossref_headers", "crossref_forbidden", *["invalid_crossref_rate_input"] * 3, "invalid_crossref_headers"]
