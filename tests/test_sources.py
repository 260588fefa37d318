import json

import pytest
from pyspark.errors import PySparkException

from pyspark.sql import functions as F

from vacantia.sources import digests, exports, feeds, mail, notifications, pages, registry

FEEDS = {
    "greenhouse": {"jobs": [{"id": 7, "title": "Data <b>Engineer</b> &amp; more", "absolute_url": "https://a.example/j/7?gh_src=x#top", "location": {"name": "Oslo"}, "first_published": None, "updated_at": "2025-02-03T00:00:00Z", "content": "<p>One</p><p>two &lt;</p>"}, "broken", {"id": 8, "title": "", "absolute_url": "https://a.example/j/8"}, {"id": 9, "title": "x", "absolute_url": "ftp://a"}]},
    "lever": [{"id": "u1", "text": "QA", "hostedUrl": "https://b.example/u1/", "createdAt": 1738540800000, "country": "de", "categories": {"location": "Berlin", "allLocations": ["Bonn", "Ulm"]}, "descriptionPlain": "", "description": "<i>d</i>"}, 5],
    "ashby": {"jobs": [{"id": "x", "title": "Dev", "jobUrl": "https://c.example/x", "location": "Haifa", "publishedAt": "2025-01-02T10:00:00Z", "isListed": True, "secondaryLocations": [{"location": "Jaffa"}], "address": {"postalAddress": {"addressCountry": "Israel", "addressLocality": "H"}}, "descriptionHtml": "<p>t</p>"}, {"id": "y", "title": "Gone", "jobUrl": "https://c.example/y", "isListed": False}]},
    "smartrecruiters": {"content": [{"uuid": "42", "name": "Ops", "releasedDate": "2025-03-04", "location": {"city": "Lyon", "country": "fr"}}]},
    "workable": {"jobs": [{"shortcode": "AB", "title": "SRE", "url": "https://d.example/AB", "city": "Wien", "country": "Austria", "locations": [{"city": "Wien", "country_code": "at"}, {"city": "Graz", "country_code": "at"}], "created_at": "2025-05-06"}]},
}
WANT = {
    "greenhouse": ("7", "Data Engineer & more", "Oslo", "2025-02-03", "https://a.example/j/7", "One two <", [], "Oslo"),
    "lever": ("u1", "QA", "Berlin", "2025-02-03", "https://b.example/u1", "d", ["DE"], "Berlin Bonn Ulm"),
    "ashby": ("x", "Dev", "Haifa", "2025-01-02", "https://c.example/x", "t", ["IL"], "Haifa Jaffa Israel H"),
    "smartrecruiters": ("42", "Ops", "Lyon, fr", "2025-03-04", "https://jobs.smartrecruiters.com/acme/42", "Ops", ["FR"], "Lyon, fr"),
    "workable": ("AB", "SRE", "Wien, Austria", "2025-05-06", "https://d.example/AB", "", ["AT"], "Wien, Austria Wien   at Graz   at"),
}


@pytest.mark.parametrize("name", FEEDS)
def test_feeds(spark, name):
    raw = spark.createDataFrame([("s", "acme", json.dumps(FEEDS[name]))], "source_id string, company string, payload string")
    rows = [tuple(r)[2:] for r in feeds.postings(raw, name).collect()]
    assert [(*r[:-1], " ".join(r[-1].split())) for r in rows] == [(*WANT[name][:-1], " ".join(WANT[name][-1].split()))]
    bad = raw.selectExpr("source_id", "company", "'{\"a\": 1}' AS payload")
    with pytest.raises(PySparkException, match="no list of jobs"):
        feeds.postings(bad, name).collect()
    assert feeds.to_jobs(feeds.postings(raw, name), name).count() == 1


def test_relevance_and_sitemap(spark):
    rows = spark.createDataFrame([(1, ["XA"], "a"), (2, None, "in Pelagia"), (3, [], "b"), (4, None, None)], "i int, country_codes array<string>, location_search_text string")
    assert [r.i for r in feeds.relevant(rows, ["XA"], ["pelagia"]).collect()] == [1, 2]
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://h.example/job/2</loc></url><url><loc>https://h.example/job/1</loc></url><url><loc>https://h.example/job/2</loc></url><url><loc>http://h.example/job/3</loc></url><url><loc>https://other.example/job/4</loc></url></urlset>'
    got = feeds.sitemap_urls(spark.createDataFrame([("s", xml)], "source_id string, payload string"), "h.example", "/job/").orderBy("n").collect()
    assert [r.job_url for r in got] == ["https://h.example/job/2", "https://h.example/job/1"]


def channel(messages, **root):
    return json.dumps({"name": "c", "type": "public_channel", "id": 5, "messages": messages} | root)


def test_channel_export(spark):
    text = ["Dev @ Acme\nLocation: Oslo\nPosted on: 03-02-2025\n", {"type": "text_link", "text": "apply", "href": "https://a.example/1?utm_source=x"}]
    ms = [{"id": 1, "type": "service", "action": "x"}, {"id": 2, "type": "message", "date_unixtime": "1737540000", "from": "c", "text": text, "text_entities": [{"type": "text_link", "text": "apply", "href": "https://a.example/1?utm_source=x"}]}, {"id": 3, "type": "message", "date_unixtime": "1737540001", "text": "", "text_entities": []}]
    files = spark.createDataFrame([(channel(ms),)], "payload string")
    got = exports.channel_messages(files, "g").orderBy("source_message_id").collect()
    assert [(r.source_message_id, r.message_date, r.urls) for r in got] == [("2", "2025-01-22T10:00:00+00:00", ["https://a.example/1?utm_source=x"]), ("3", "2025-01-22T10:00:01+00:00", [])]
    assert tuple(exports.export_summary(files).first()) == (2, 1)
    job = digests.channel_digest(exports.channel_messages(files, "g")).collect()
    assert [(r.title, r.company, r.location, r.posted_on, r.job_url, r.parse_confidence) for r in job] == [("Dev", "Acme", "Oslo", "2025-02-03", "https://a.example/1", 1.0)]
    for bad in (channel([], type="private"), channel([{"id": 1, "type": "poll"}]), channel([{"id": 1, "type": "message", "text": "x"}])):
        with pytest.raises(PySparkException):
            exports.channel_messages(spark.createDataFrame([(bad,)], "payload string"), "g").collect()


CHAT = "1/22/25, 10:00 - Group created\n1/22/25, 10:05 - Ann: *Data Engineer*\n📈 Level: Mid\nPosted today\nhttps://jobs.a.example/1\n1/22/25, 10:05 - Ann: hello\n1/22/25, 10:05 - Ann: hello\n"


def test_group_export(spark):
    files = spark.createDataFrame([("p", CHAT)], "path string, payload string")
    rows = exports.group_messages(files, "g").collect()
    assert len(rows) == 4 and len({r.source_message_id for r in rows}) == 4
    assert {r.source_message_id for r in exports.group_messages(files, "g").collect()} == {r.source_message_id for r in rows}
    jobs = digests.group_digest(exports.group_messages(files, "g")).collect()
    assert [(r.title, r.posted_on, r.job_url, r.parse_confidence) for r in jobs] == [("Data Engineer", "2025-01-22", "https://jobs.a.example/1", 0.75)]
    with pytest.raises(PySparkException):
        exports.group_messages(spark.createDataFrame([("p", "early\n" + CHAT)], "path string, payload string"), "g").collect()


def test_registry(spark):
    files = spark.createDataFrame([("p", CHAT)], "path string, payload string")
    r = digests.ParserRegistry()
    r.register("WhatsApp", "*", digests.group_digest)
    assert r.resolve("whatsapp", "any") is digests.group_digest
    assert r.parse(exports.group_messages(files, "g")).count() == 1
    with pytest.raises(ValueError):
        r.register("whatsapp", "*", digests.group_digest)
    with pytest.raises(LookupError):
        r.resolve("mail", "g")


def test_notifications(spark):
    good = {"type": "notification", "protocol_version": 1, "group_identifier": "g", "source_message_id": "wa_notification_" + "a" * 64, "message_date": "2025-01-01T00:00:00Z", "body_lines": ["Ann: QA engineer"]}
    lines = [json.dumps(x) for x in (good, good | {"extra": 1}, good | {"group_identifier": "h"}, good | {"source_message_id": "x"}, good | {"message_date": "soon"}, good | {"body_lines": []}, good | {"protocol_version": 2}, good | {"body_lines": ["Bo", "*Dev*"]})] + ["no json"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    reasons = [r.reason for r in notifications.checked(df, "g").collect()]
    assert [x is None for x in reasons] == [True, False, False, False, False, False, False, True, False]
    assert [(r.sender, r.raw_text) for r in notifications.messages(df, "g").collect()] == [("Ann", "QA engineer"), ("Bo", "*Dev*")]
    assert [(r.title, r.parse_confidence) for r in digests.group_digest(notifications.messages(df, "g")).collect()] == [("QA engineer", 0.35)]
    basic = {"type": "diagnostic", "protocol_version": 1} | dict.fromkeys(notifications.BASIC_COUNTS, 3)
    later = [dict.fromkeys(names, 1) for names in notifications.LATER_COUNTS]
    later[1] = {"application_info_error_categories": {"Fault, HRESULT 0x80070005": 2}}
    forms = [basic]
    for more in later:
        forms.append(forms[-1] | more)
    bad = [basic | {"more": 1}, basic | {"total_notifications": -1}, basic | {"total_notifications": 2_000_000}, basic | {"protocol_version": 2}, forms[2] | {"application_info_error_categories": {"x": 1}}, forms[2] | {"application_info_error_categories": {f"F{k}, HRESULT 0x80070005": 1 for k in range(17)}}, basic | later[3]]
    ds = spark.createDataFrame([(json.dumps(x),) for x in forms + bad] + [("[1]",), ("x",)], "value string")
    got = notifications.diagnostics(ds).collect()
    assert [r.form for r in got] == [1, 2, 3, 4, 5, None, 1, 1, 1, 3, 3, None, None, None] and [r.valid for r in got] == [True] * 5 + [False] * 9
    assert notifications.diagnostic_totals(ds).first().total_notifications == 15


MAIL = b"From: Jobs <jobs-noreply@linkedin.com>\nSubject: x\nDate: Wed, 22 Jan 2025 10:00:00 +0200\nMIME-Version: 1.0\nContent-Type: text/html; charset=utf-8\n\n<table><tr><td><a class='text-color-brand' href='https://www.linkedin.com/comm/jobs/view/12?trk=a'>Data Engineer</a><p class='text-system-gray-100'>Acme &middot; Oslo</p></td></tr></table><table><tr><td><a class='text-color-brand' href='https://www.linkedin.com/comm/jobs/view/13'>No place</a></td></tr></table>"
STORE = b"From: noreply@mail.amazon.jobs\nSubject: Recommended Amazon jobs for you\nMIME-Version: 1.0\nContent-Type: text/html\n\n<div><table><tr><td><a href='https://x.awstrack.me/L0/https:%252F%252Fwww.amazon.jobs%252Fen%252Fjobs%252F2912345%252Fdev/1'>Dev II</a><div>Haifa, Israel</div><div>Basic Qualifications</div></td></tr></table><a href='https://a.example'>other</a></div>"
#: The place of the second card is known by its made-up country.
PASTED = "Dev II\nHaifa, Israel\n|\nJob ID: 2912345\nPosted today\nWrite to a@b.example\nQA Lead\nDemo Metro, Exampleland\nJob ID: 2912346\n"


def test_notification_of_too_many_lines_is_rejected(spark, tmp_path):
    from vacantia.plans import messages

    rows = [("g", "1", "line\n" * 199 + "line"), ("g", "2", "line\n" * 200 + "line"), ("g", "3", ""), ("g", "4", None)]
    spark.createDataFrame(rows, "source_group string, source_message_id string, raw_text string").write.parquet(f"{tmp_path}/source_messages.parquet")
    got = messages.QUERIES["notification_records"](spark, str(tmp_path)).collect()
    assert {r.outcome: r.records for r in got} == {"accepted": 1, "rejected": 3}


def test_cards(spark):
    raw = spark.createDataFrame([("a", MAIL), ("b", MAIL), ("c", b"From: x@y.example\n\nhi"), ("d", b"")], "path string, content binary")
    got = mail.read_cards(raw, "network_mail")
    assert [(r.reason, r.skipped) for r in got.orderBy("path").collect()][:3] == [(None, 1), (None, 1), ("another sender", 0)]
    jobs = mail.to_jobs(got, "linkedin_email", "mail", 0.9).collect()
    assert [(r.source_message_id, r.title, r.company, r.location, r.message_date) for r in jobs] == [("12", "Data Engineer", "Acme", "Oslo", "2025-01-22T10:00:00+02:00")]
    store = mail.to_jobs(mail.read_cards(spark.createDataFrame([("a", STORE)], "path string, content binary"), "store_mail"), "amazon_email", "g", 0.9).collect()
    assert [(r.source_message_id, r.title, r.location, r.company) for r in store] == [("2912345", "Dev II", "Haifa, Israel", "Amazon")]
    pasted = mail.read_cards(spark.createDataFrame([("a", PASTED), ("b", "nothing")], "path string, content string"), "pasted").orderBy("path").collect()
    assert [(c.job_id, c.title, c.location) for c in pasted[0].cards] == [("2912345", "Dev II", "Haifa, Israel"), ("2912346", "QA Lead", "Demo Metro, Exampleland")] and pasted[1].reason == "no cards"
    page = "<li class=card><h3 class=t>Dev</h3><p class=p>Oslo</p><a class='btn' href='https://h.example/job/5/'>go</a></li><li class=card><h3 class=t>x</h3></li>"
    cards = mail.read_page_cards(spark.createDataFrame([(page,)], "payload string"), mail.page_cards("card", "t", "p", "d", "btn", "x", "h.example", r"/job/(\d+)/?")).first()
    assert [(c.job_id, c.title, c.job_url) for c in cards.cards] == [("5", "Dev", "https://h.example/job/5")] and cards.skipped == 1


def test_pages(spark):
    text = "Long text of the posting " * 12
    ld = '<title>T</title><script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph": [{"@type": ["jobposting"], "title": "Dev", "hiringOrganization": {"name": "Acme"}, "jobLocation": [{"address": {"streetAddress": "Way 1", "addressLocality": "Oslo", "addressCountry": "NO"}}, "Remote"], "description": "<p>' + text + '</p><p>more</p>", "skills": [{"name": "Go"}, "Java"]}]}</script>'
    short = '<html><head><title> </title></head><body><h1>H</h1><nav>menu</nav><script type="application/ld+json">{"@type": "JobPosting", "jobLocationType": "TELECOMMUTE", "hiringOrganization": "Bo", "description": "x"}</script><div class="my-job_description-2">' + "word " * 60 + "</div></body></html>"
    body = '<html><body><svg>s</svg><p>' + "plain " * 50 + '</p><script type="application/ld+json">{"@type": "Organization", "url": "https://a.example/", "name": "Org"}</script><main><i class="location x">Ulm</i></main></body></html>'
    rows = spark.createDataFrame([(1, ld, None), (2, short, None), (3, body, "https://a.example/1"), (4, "<p>short", None), (5, None, None), (6, "<main itemtype='x/JobPosting'>" + "w " * 100, "no address ]")], "i int, html string, final_url string")
    got = [tuple(r)[3:] for r in pages.read_pages(rows).orderBy("i").collect()]
    assert got[0] == ("Dev", "Acme", "Way 1, Oslo, NO, Remote", text.strip() + "\nmore\nGo\nJava", "json-ld")
    assert got[1][:3] == ("H", "Bo", "Remote") and got[1][3] == ("word " * 60).strip() and got[1][4] == "html-fallback"
    assert got[2][1:3] == ("Org", "Ulm") and got[2][3].startswith("plain") and "s" != got[2][3][0]
    assert got[3] == (None, None, None, None, "html-fallback") and got[4] == (None,) * 5 and got[5][3] is None


def test_job_pages(spark):
    page = lambda **k: '<script type="application/ld+json">' + json.dumps({"@type": "JobPosting"} | k) + "</script>"
    place = {"address": {"addressLocality": "Haifa", "addressCountry": "IL"}}
    rows = spark.createDataFrame([(1, page(identifier={"value": 9}, title="Dev", jobLocation=[place, place, 5], datePosted="2025-01-02T00")), (2, page(identifier="a", title="Dev")), (3, "<p>x"), (4, None)], "i int, html string")
    got = pages.read_job_pages(rows).orderBy("i").collect()
    assert tuple(got[0])[2:] == ("9", "Dev", "Haifa, IL", "2025-01-02", "", None, ["IL"]) and [r.reason for r in got[1:]] == ["incomplete posting data", "no posting data", "no page"]
    assert pages.usable(pages.read_job_pages(rows.filter("i = 1"))).count() == 1
    with pytest.raises(PySparkException, match="posting data|no page"):
        pages.usable(pages.read_job_pages(rows)).collect()


def test_outcomes(spark):
    rows = [(None, None, None, True, True, True), (200, 900, "text/html", False, False, True), (None, None, None, False, True, False), (None, None, None, False, True, True), (429, None, None, False, True, True), (500, None, None, False, True, True), (200, 900, "application/pdf", False, True, True), (200, 9, "text/html", False, True, True), (200, 900, "text/plain", None, True, True)]
    df = spark.createDataFrame(rows, "s int, n int, k string, p boolean, r boolean, u boolean")
    got = [x.o for x in df.select(pages.fetch_outcome(*map(F.col, "snkpru")).alias("o")).collect()]
    assert got == ["source_automation_prohibited", "source_resolution_error", "unsafe_url", "request_error", "blocked", "http_error", "unsupported_content", "insufficient_content", "success"]


def test_what_must_raise(spark, tmp_path):
    empty = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"></urlset>'
    with pytest.raises(PySparkException, match="no address"):
        feeds.sitemap_urls(spark.createDataFrame([("s", empty)], "source_id string, payload string"), "h.example").collect()
    twice = channel([{"id": 2, "type": "message", "date_unixtime": "1737540000", "text": "x"}] * 2)
    with pytest.raises(PySparkException, match="twice"):
        exports.channel_messages(spark.createDataFrame([(twice,)], "payload string"), "g").collect()
    with pytest.raises(ValueError):
        feeds.page_requests(2001)
    assert feeds.page_requests(250) == [0, 100, 200]
    feeds.land(spark.createDataFrame([("a%3Ab", 25, "{}")], "source_id string, page int, value string"), f"{tmp_path}/land")
    with pytest.raises(PySparkException, match="over 20 pages"):
        feeds.landed(spark, f"{tmp_path}/land").collect()
    for bad in ({"days": 0}, {"most": 51}):
        with pytest.raises(ValueError):
            mail.recent(spark.range(1), "id", F.current_timestamp(), **bad)
    with pytest.raises(ValueError):
        digests.preview(spark.range(1), lambda x: x, -1)


def test_mail_contents(spark):
    import base64

    web = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    rows = spark.createDataFrame([(web(b"\xff\xfe?a"),), (web(b"ab") + "=",), ("",), (None,), ("a*b",), ("abcde",), (web(b"x" * 50),)], "raw string")
    got = mail.decoded(rows, most=40).collect()
    assert [None if r.content is None else bytes(r.content) for r in got] == [b"\xff\xfe?a", b"ab", None, None, None, None, None]
    assert [r.reason for r in got] == [None, None, "no content", "no content", "invalid content", "invalid content", "too large"]


def test_live_urls_and_allowed_ones(spark):
    df = spark.createDataFrame([([("text_link", "t", "https://a.example/1"), ("url", "https://b.example/", None), ("bold", "x", None)], "see https://a.example/1?utm_x=1 now", [["https://c.example/x"], None, [None]], "https://d.example"), (None, None, None, None)], "e array<struct<type:string,text:string,href:string>>, t string, b array<array<string>>, p string")
    got = [r.u for r in df.select(digests.live_urls(F.col("e"), F.col("t"), F.col("b"), F.col("p")).alias("u")).collect()]
    assert got == [["https://a.example/1", "https://b.example/", "https://c.example/x", "https://d.example"], []]
    urls = F.array(F.lit("https://x.jobs.example/postings/1"), F.lit("https://jobs.example/other"), F.lit("HTTPS://Jobs.example/postings/7/?ref=a"))
    assert spark.range(1).select(digests.allowed_url(urls, "jobs.example", r"/postings/\d+/?").alias("u")).first().u == "https://jobs.example/postings/7"


def test_shape_of_exported_jobs(spark):
    good = "Dev @ Acme\nPosted on: 1-2-2025\nLocation: Oslo"
    rows = [(1, good, ["https://a.example"]), (2, good, []), (3, good.replace(" @ ", " at "), ["u"]), (4, "Dev @ Acme\nLocation: x", ["u"]), (5, None, None)]
    assert [r.i for r in digests.channel_shape(spark.createDataFrame(rows, "i int, raw_text string, urls array<string>")).collect()] == [1]


def test_files_of_the_driver(spark, tmp_path):
    own, example = tmp_path / "own.json", tmp_path / "example.json"
    with pytest.raises(ValueError, match="missing"):
        registry.load(own, example)
    source = {"id": "a", "adapter": "lever", "company": "A", "enabled": True}
    registry.replace_json(example, {"sources": [source]})
    assert registry.sources(spark, registry.load(own, example)).first().source_id == "a"
    own.write_text("{")
    with pytest.raises(ValueError, match="no JSON"):
        registry.load(own, example)
    for bad in ([source, source | {"id": "A"}], [source | {"adapter": "x"}], [source | {"id": " "}]):
        with pytest.raises(ValueError):
            registry.sources(spark, {"sources": bad})
    assert registry.read_progress(own) == {} and registry.read_progress(tmp_path / "none") == {}
    registry.replace_json(own, {"stage": "x", "total": 3, "secret": "y", "status": ["z"]})
    assert registry.read_progress(own) == {"stage": "x", "total": 3}
    with pytest.raises(TypeError):
        registry.replace_json(own, {"stage": object()})
    assert registry.read_progress(own)["stage"] == "x" and len(list(tmp_path.iterdir())) == 2
